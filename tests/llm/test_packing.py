import gc
import weakref
import zlib
from collections import defaultdict
from itertools import product

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from weftline.llm.common import by_group, let_go
from weftline.llm.packing import _WORD, WordEncoder, _encoder, default_tokenizer, fill_window, is_usual, minimum_bin_slack, pack_documents, pieces, sequences

DEFINITION = open(default_tokenizer(), encoding="utf-8").read()
TOKENIZER, ENCODER = Tokenizer.from_str(DEFINITION), WordEncoder(DEFINITION)


def plain(text):
    return np.array(TOKENIZER.encode(text or "", add_special_tokens=False).ids + [2], "<u4")


ODD = ["it's <|endoftext|> ok", "a b\x85c\xa0d", "!'s 'S 'Re don't'll ''' _a_1²", "ÀÉ œŒ ß ÿ engeß", "İx ΑΣ 中文", "é", "", " \t\n", "\x00\x1f x"]


def test_encoder_on_odd_texts():
    assert [x for x in ODD if ENCODER.encode([x])[0] + b"\2\0\0\0" != plain(x).tobytes()] == []


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("abAB'sSt12 \n.,-_éÉßœŸÿ²ªİı́\x85<|"), max_size=40))
def test_encoder_equals_tokenizer(text):
    assert ENCODER.encode([text])[0] + b"\2\0\0\0" == plain(text).tobytes()


def test_learned_words_are_not_normalised_again():
    """Words of usual texts are normalised and split already; encoding them without those steps gives the tokenizer's own ids."""
    words = sorted({w for t in ODD if is_usual(t) for w in _WORD.findall(t.lower())} | {"'", "'s", "!?.", "àéß", "ÿ", "<", "|", "|>", "ab", "7"})
    assert ENCODER.of_words.normalizer is None and len(words) > 8
    assert ENCODER._ids(ENCODER.of_words, " ".join(words)).tolist() == plain(" ".join(words)).tolist()[:-1]


def test_encoder_forgets_without_harm(monkeypatch):
    monkeypatch.setattr("weftline.llm.packing.CACHED", 3)
    own = WordEncoder(DEFINITION)
    for t in ["one two three four five", "six one seven", "two eight nine ten", "one two"]:
        assert own.encode([t])[0] + b"\2\0\0\0" == plain(t).tobytes()


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 3), min_size=1, max_size=5), st.integers(0, 60))
def test_fill_is_the_best_sum(counts, room):
    used = fill_window(counts, sorted(counts, reverse=True), room)
    assert all(n <= counts[x] for x, n in used.items())
    best = max(s for c in product(*(range(n + 1) for n in counts.values())) if (s := sum(x * n for x, n in zip(counts, c, strict=True))) <= room)
    assert sum(x * n for x, n in used.items()) == best


def test_windows_use_every_length_once():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 4097, 3000).tolist()
    used = minimum_bin_slack(lengths)
    seen = defaultdict(int)
    for u in used:
        assert sum(x * n for x, n in u.items()) <= 4096
        for x, n in u.items():
            seen[x] += n
    assert sorted(x for x, n in seen.items() for _ in range(n)) == sorted(lengths)
    assert len(used) <= -(-sum(lengths) // 4096) * 1.03 + 1


def test_round_trip(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate([*ODD, None, "word " * 30_000])] + [(None, "x"), (7_000, "same"), (7_000, "same")], "doc_id long, text string")
    rows = docs.union(extra).withColumnRenamed("text", "text")
    got = pack_documents(rows).collect()
    ids = defaultdict(list)
    for r in rows.collect():
        ids[r.doc_id].append(plain(r.text))
    seen, used = defaultdict(list), defaultdict(list)
    for r in got:
        seen[r.doc_id].append((r.start, r.length))
        whole = ids[r.doc_id][0]
        assert r.doc_tokens == len(whole) and r.ids_crc32 == zlib.crc32(whole[r.start : r.start + r.length].tobytes())
        used[r.sequence_id].append((r.offset, r.length))
    for d, cuts in seen.items():
        n, copies = len(ids[d][0]), len(ids[d])
        assert sum(x for _, x in cuts) == n * copies
        assert sorted(set(cuts))[0][0] == 0 and all(a + x in {b for b, _ in cuts} | {n} for a, x in cuts)
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(len(x) for v in ids.values() for x in v)
    assert len(used) <= -(-total // 4096) + 2


def test_sequences_hold_the_ids(spark):
    rows = spark.createDataFrame([(i, "token stream " * (i * 40)) for i in range(60)], "doc_id long, text string")
    packed = pack_documents(rows)
    packed.cache()
    got = {r.sequence_id: r.input_ids for r in sequences(packed, pieces(rows, with_ids=True)).collect()}
    for r in packed.collect():
        assert zlib.crc32(np.array(got[r.sequence_id][r.offset : r.offset + r.length], "<u4").tobytes()) == r.ids_crc32
    assert all(len(x) == 4096 or len(x) & (len(x) - 1) == 0 for x in got.values())


def test_empty(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_tokenizer_that_splits_otherwise_encodes_whole_texts(spark):
    import json

    from weftline.llm.packing import WordEncoder, splits_as_known

    with open(default_tokenizer(), encoding="utf-8") as f:
        definition = json.load(f)
    assert splits_as_known(json.dumps(definition))
    definition["normalizer"]["normalizers"] = definition["normalizer"]["normalizers"][:2]  # keeps capitals
    other = json.dumps(definition)
    assert not splits_as_known(other)
    texts = ["The Cat sat. THE END", "plain words", ""]
    plain = Tokenizer.from_str(other)
    assert WordEncoder(other).encode(texts) == [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", 5, "x"), (1, "a b", 5, "x")], "doc_id long, text string, rid int, `group` string")
    assert sorted((r.doc_id, r.offset) for r in pack_documents(df).collect()) == [(1, 0), (1, 3)]


def test_a_worker_lets_go_of_its_tokenizer_for_other_work():
    with open(default_tokenizer(), encoding="utf-8") as f:
        definition = f.read()
    first = _encoder(definition)
    let_go("packing")
    assert _encoder(definition) is first
    held = weakref.ref(first)
    del first
    by_group(lambda group: group)(None)
    gc.collect()
    assert held() is None
