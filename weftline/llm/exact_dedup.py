"""Exact deduplication by two-pass Bloom filtering (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import ascii_lower, fresh, materialise, quoted, small

#: Bits of the filter per row, and its largest size (2**27 bits: 2**21 words of 64 bits, 32 MB of rows when broadcast).
BITS_PER_ROW, MAX_BITS, MIN_BITS = 16, 1 << 27, 1 << 16


def filter_bits(rows: int) -> int:
    """A power of two with about ``BITS_PER_ROW`` bits a row, within [MIN_BITS, MAX_BITS]."""
    return min(MAX_BITS, max(MIN_BITS, 1 << (max(1, rows * BITS_PER_ROW) - 1).bit_length()))


def _slot(digest: Column, bits: int) -> Column:
    return F.xxhash64(digest).bitwiseAND(F.lit(bits - 1))


def repeated_filter(digests: DataFrame, bits: int) -> DataFrame:
    """(word, mask): the slots that at least two rows set, 64 to a word; words without such a slot are absent.

    First pass. Each row sets one slot. What is shuffled are slot numbers with counts, combined map-side, never rows: a
    group of copies of any size adds one count per map task, and a unique text eight bytes.
    """
    hit = digests.groupBy(_slot(F.col("digest"), bits).alias("slot")).agg(F.count("*").alias("n")).filter("n >= 2")
    return hit.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 AS int)))").alias("mask"))


def text_digest(docs: DataFrame, text_col: str) -> Column:
    """SHA-256 (binary) of the text in UTF-8, lower-cased in A-Z only; null counts as empty."""
    return F.unhex(F.sha2(ascii_lower(F.coalesce(docs[text_col].cast("string"), F.lit(""))), 256))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z only; of equal texts the row with the largest id stays. The first
    pass builds a Bloom filter of the hashes that occur more than once; the second tests every row against it. A row that
    the filter rules out is unique and passes straight through; only possibly repeated rows (with a digest, never a text)
    are shuffled and counted exactly. False positives (about one unique row in 16, more once the filter has its largest size: half of the
    unique rows at 1e8) cost a little shuffle and never change a result, so the filter's size is bounded whatever the input.

    Null text counts as empty. Rows with a null id are kept as rows; a null id is smaller than any other. Of repeated rows
    with one id and one text exactly one is kept. An empty table gives an empty result. Other columns are ignored.
    """
    digests = materialise(docs.select(F.col(id_col).alias("doc_id"), text_digest(docs, text_col).alias("digest"), F.monotonically_increasing_id().alias("rid")), "digests")
    bits = filter_bits(digests.count())
    seen = materialise(repeated_filter(digests, bits), "bloom").withColumnRenamed("word", "_word")
    tested = digests.withColumn("slot", _slot(F.col("digest"), bits)).join(F.broadcast(seen), F.shiftright("slot", 6) == F.col("_word"), "left")  # at most MAX_BITS / 64 words
    tested = tested.withColumn("maybe", F.expr("coalesce(shiftright(mask, cast(slot & 63 AS int)) & 1, 0) = 1"))
    alone = tested.filter("NOT maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    maybe = tested.filter("maybe").select("doc_id", "digest", "rid")
    groups = maybe.groupBy("digest").agg(F.max(F.struct("doc_id", "rid")).alias("top"), F.count("*").alias("group_size"))
    groups = materialise(groups.select(F.col("digest").alias("_digest"), F.col("top.doc_id").alias("keep_id"), F.col("top.rid").alias("keep_rid"), "group_size"), "groups")
    counted = maybe.join(small(groups), F.col("digest") == F.col("_digest")).select("doc_id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), "digest")
    return alone.unionByName(counted).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``exact_dedup`` drops, columns unchanged.

    A row is dropped by its id and digest together, so other texts under the same id are not touched. What is dropped is few
    and slim, so texts stay where they are unless that list is too large to broadcast. Of rows that repeat one id and one
    text one stays (any of them where other columns differ).
    """
    decided = materialise(exact_dedup(docs, id_col, text_col).select("doc_id", "kept", F.unhex("text_sha256").alias("digest")), "decided")
    per = decided.groupBy("doc_id", "digest").agg(F.max("kept").alias("stays"), F.count("*").alias("rows"))
    listed = materialise(per.filter("NOT stays OR rows > 1"), "listed")
    key, gone_id, gone_key = fresh(docs, "digest", "gone_id", "gone_digest")
    marked = docs.withColumn(key, text_digest(docs, text_col))
    named = [F.col("doc_id").alias(gone_id), F.col("digest").alias(gone_key)]
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(gone_id)) & (F.col(key) == F.col(gone_key))
    keep = marked.join(small(listed.select(*named)), same, "left_anti").select(*quoted(docs.columns))
    twice = materialise(listed.filter("stays").select(*named), "twice")
    if twice.isEmpty():
        return keep
    copies = marked.join(small(twice), same, "left_semi")
    whole = F.first(F.struct(*quoted(docs.columns))).alias(gone_id)
    firsts = copies.groupBy(F.col(f"`{id_col}`").alias(gone_key), F.col(key)).agg(whole)
    return keep.unionByName(firsts.select(*[F.col(gone_id)[c].alias(c) for c in docs.columns]))
