"""Secret scans with corpus-wide ownership frequency."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import in_batches, materialise

#: Fixed patterns of the base kinds, and the least length of what must be that long (group 2, else the match).
_ASSIGN = re.compile(r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # the same matches as AKIA[A-Z0-9]+ of 20 or more: a run's later starts are shorter
_HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGNED = 6
#: Free-standing candidates that only the method judges: long runs with letters and digits.
_LONG = re.compile(r"[A-Za-z0-9+/_-]{20,}")
#: A text without any of these has no span. The search is a superset of all patterns above.
_ANY = r"(?i:passw|secret|token|api_?key)|AKIA[A-Z0-9]{16}|[0-9a-f]{24}|[A-Za-z0-9+/_-]{20}"
#: Kinds in the order that ties at one start are listed in; the last two are the method's own.
KINDS = ("assign", "access", "hex", "live", "example")
#: A value that this many owners hold is a copied example; one that a single owner holds, and that looks random, is live.
COPIED_OWNERS = 3
#: So is a value that this many repositories hold, whoever owns them.
COPIED_REPOSITORIES = 10
#: Least characters and bits per character (Shannon, over its own characters) of a value that looks random.
LIVE_LENGTH, LIVE_ENTROPY = 12, 2.75


def looks_random(value: str) -> bool:
    """Whether a value could be a generated credential: long, mixed, and of high entropy."""
    if len(value) < LIVE_LENGTH or value.isalpha() or not any(c.isalpha() for c in value):
        return False
    n = len(value)
    return -sum(k / n * math.log2(k / n) for k in Counter(value).values()) >= LIVE_ENTROPY


def base_spans(text: str) -> list[tuple[int, int, str, int, int]]:
    """(start, end, kind, value start, value end) of the base kinds, in order of start, then kind."""
    out = [(m.start(), m.end(), "assign", m.start(2), m.end(2)) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGNED]
    for kind, pattern in (("access", _ACCESS), ("hex", _HEX)):
        out += [(*m.span(), kind, *m.span()) for m in pattern.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def candidates(text: str, base: list[tuple[int, int, str, int, int]]) -> list[tuple[int, int]]:
    """Distinct places of values to judge: those of the base spans, and long mixed runs outside them."""
    out, taken = {(a, b) for *_, a, b in base}, []
    for a, b, *_ in sorted(base):  # disjoint stretches that base spans cover
        if taken and a < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    at = 0
    for m in _LONG.finditer(text):
        a, b = m.span()
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if (at == len(taken) or taken[at][0] >= b) and any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0]):
            out.add((a, b))
    return sorted(out)


def _join(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


_SCANNED = "rid long, doc_id long, owner string, repository string, n_assign long, n_access long, n_hex long, base_spans string, found array<struct<hash:string,start:long,stop:long,random:boolean>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_col: str = "doc_id") -> DataFrame:
    """One row per document: counts and spans of the base kinds, and every candidate value's hash and place."""
    fields = pa.schema(
        [("rid", pa.int64()), ("doc_id", pa.int64()), ("owner", pa.string()), ("repository", pa.string()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_spans", pa.string())]
        + [("found", pa.list_(pa.struct([("hash", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("random", pa.bool_())])))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(4)
            hit = pc.match_substring_regex(texts, _ANY).to_pylist()
            counts, spans, found = [], [], []
            for k, h in enumerate(hit):
                if not h:
                    counts.append((0, 0, 0))
                    spans.append("")
                    found.append([])
                    continue
                text = texts[k].as_py()
                base = base_spans(text)
                n = Counter(x[2] for x in base)
                counts.append((n["assign"], n["access"], n["hex"]))
                spans.append(_join([x[:3] for x in base]))
                found.append([{"hash": hashlib.sha256(text[a:b].encode()).hexdigest(), "start": a, "stop": b, "random": looks_random(text[a:b])} for a, b in candidates(text, base)])
            numbers = [pa.array(list(c), pa.int64()) for c in zip(*counts, strict=True)] if counts else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *numbers, pa.array(spans, pa.string()), pa.array(found, fields.field("found").type)], schema=fields)

    slim = docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.col(owner_col).cast("string").alias("owner"), F.col(repository_col).cast("string").alias("repository"), F.col(text_col).cast("string").alias("text")
    )
    return in_batches(slim, run, _SCANNED)


def ownership(found: DataFrame) -> DataFrame:
    """(hash, n_repositories, n_owners, n_uses) of every candidate value, over the whole corpus; a repository that two owners
    hold is one.

    Counted in steps whose keys hold the owner and the repository, so a value copied everywhere is combined map-side and
    spread, never gathered.
    """
    uses = found.groupBy("hash", "owner", "repository").agg(F.count("*").alias("n"))
    repositories = uses.groupBy("hash", "repository").agg(F.sum("n").alias("n")).groupBy("hash").agg(F.count("*").alias("n_repositories"), F.sum("n").alias("n_uses"))
    owners = uses.groupBy("hash", "owner").agg(F.count("*").alias("n")).groupBy("hash").agg(F.count("*").alias("n_owners"))
    return repositories.join(owners, "hash").select("hash", "n_repositories", "n_owners", "n_uses")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_col: str = "doc_id", copied_owners: int = COPIED_OWNERS, copied_repositories: int = COPIED_REPOSITORIES) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example.

    ``spans`` joins kind:start:end of the base spans and of the method's: over the whole corpus each candidate value is
    counted by distinct repositories and owners; one held by at least ``copied_owners`` owners or in at least ``copied_repositories``
    repositories is an ``example``, one in fewer repositories of a single owner that looks random is ``live``. A value in few
    repositories of several owners, fewer than ``copied_owners``, gets neither: it is nobody's own, nor widely copied. Places are
    code points, the end exclusive; order is by start, then kind as in ``KINDS``, then end. A null owner or repository counts as one of its own.

    Null text is empty and has no spans. Null ids and repeated rows are documents like any other; repeats of a row are one
    repository. An empty table gives an empty result. Other columns are ignored.
    """
    scanned = materialise(scan(docs, id_col, text_col, owner_col, repository_col), "scanned")
    places = scanned.filter("size(found) > 0").select("rid", "owner", "repository", F.explode("found").alias("f")).select("rid", "owner", "repository", "f.*")
    owned = materialise(ownership(places), "owned")
    kind = F.when((F.col("n_owners") >= copied_owners) | (F.col("n_repositories") >= copied_repositories), F.lit("example")).when(F.col("random") & (F.col("n_owners") == 1), F.lit("live"))
    judged = places.join(owned.withColumnRenamed("hash", "_hash"), F.col("hash") == F.col("_hash")).withColumn("kind", kind).filter("kind IS NOT NULL")
    added = judged.groupBy("rid").agg(F.collect_list(F.struct("start", F.when(F.col("kind") == "live", 3).otherwise(4).alias("rank"), "stop", "kind")).alias("added")).withColumnRenamed("rid", "_rid")
    # Base spans are split again only in rows that the method adds to; a document's spans are bounded by its text.
    rank = " ".join(f"WHEN '{k}' THEN {n}" for n, k in enumerate(KINDS))
    base = F.expr(
        "transform(filter(split(base_spans, ','), x -> x <> ''), x -> named_struct('start', cast(split_part(x, ':', 2) AS bigint), 'rank',"
        f" CASE split_part(x, ':', 1) {rank} END, 'stop', cast(split_part(x, ':', 3) AS bigint), 'kind', split_part(x, ':', 1)))"
    )
    both = scanned.join(added, F.col("rid") == F.col("_rid"), "left")
    text = F.expr("array_join(transform(whole, x -> concat_ws(':', x.kind, x.start, x.stop)), ',')")
    out = both.withColumn("whole", F.when(F.col("added").isNotNull(), F.array_sort(F.concat(base, "added")))).withColumn("spans", F.coalesce(text, F.col("base_spans")))
    count = lambda k: F.coalesce(F.size(F.filter("added", lambda x: x["kind"] == k)), F.lit(0)).cast("long")
    n_added = lambda k: F.when(F.col("added").isNull(), F.lit(0).cast("long")).otherwise(count(k))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", n_added("live").alias("n_live"), n_added("example").alias("n_example"))
