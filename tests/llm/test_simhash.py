import re
from itertools import combinations

import numpy as np
from xxhash import xxh64_intdigest

from weftline.llm.components import connected_components
from weftline.llm.simhash import fingerprint, keep_one, near_duplicates

SCHEMA = "doc_id long, text string"


def plain(text, k=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hs = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows):
    prints = {i: plain(t) for i, t in rows}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {(i, f"{prints[i]:016x}", find(i)) for i in prints}


def test_fingerprint_matches_plain_definition():
    for t in ["", None, "one", "Two Words", "a b c", "É a\x0bB\tc  d e f", "x " * 500, "a b c d e f g h"]:
        assert fingerprint(t) == plain(t)


def test_near_duplicates_against_brute_force(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(25):
        base = [words[i] for i in rng.integers(0, 400, 120)]
        for _ in range(8):
            edit = list(base)
            for _ in range(rng.integers(0, 3)):
                edit[rng.integers(0, len(edit))] = "zz"
            rows.append((n, " ".join(edit)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \t"), (n + 3, "one"), (n + 4, "ONE")]
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert {tuple(r) for r in got} == brute(rows) and len(got) == len(rows)
    assert len({r.component_id for r in got}) < len({r.fingerprint for r in got})  # links between different texts exist


def test_sample_table_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert {tuple(r) for r in near_duplicates(docs).collect()} == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_repeats_nulls_empty_and_extra_columns(spark):
    rows = [(1, "a b c d", "x"), (1, "a b c d", "x"), (None, "a b c d", "y"), (None, "zz", "y"), (5, "a b c d", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in near_duplicates(df).collect())
    assert got == [(-1, -1), (-1, 1), (1, 1), (1, 1), (5, 1)]
    assert near_duplicates(df.filter("false")).count() == 0
    assert sorted(str(r.doc_id) for r in keep_one(df).collect()) == ["1", "1", "None", "None"]


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 200 + i) for i in range(50)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, **{200 + i: 100 for i in range(50)}}
