"""Line deduplication over a corpus (DataFrame operations only): repeated lines stay in the first document that holds them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import BROADCAST_BYTES, LOWER, UPPER, fresh, materialise, quoted
from weftline.sources.workspace import table_bytes

#: Keys of fewer code points are never dropped.
LEAST = 10
BLANK = " \t\n\x0b\x0c\r"
#: One line in so many is looked at to find frequent keys; a key is taken for one from this share of a partition's rows on.
SAMPLED, SHARE = 16, 0.25


def text_lines(text: Column) -> Column:
    """The pieces between line feeds; a null or empty text has one empty line."""
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, LOWER)


def text_name(text: Column) -> Column:
    """What tells texts under one id apart."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def line_rows(docs: DataFrame, id_col: str, text_col: str, least: int = LEAST) -> DataFrame:
    """(key, doc, name, pos): a 16-byte digest for each line whose key has ``least`` code points or more. Texts stay behind."""
    named = docs.select(F.col(id_col).alias("doc"), text_name(F.col(text_col)).alias("name"), text_lines(F.col(text_col)).alias("lines"))  # once a text, not once a line
    lines = named.select("doc", "name", F.posexplode("lines").alias("pos", "line"))
    keyed = lines.select("doc", "name", "pos", line_key(F.col("line")).alias("line")).filter(F.char_length("line") >= least)
    return keyed.select(F.unhex(F.md5("line")).alias("key"), "doc", "name", "pos")


def _first(doc: str = "doc") -> Column:
    """Documents in order; a null id comes after all others."""
    return F.struct(F.col(doc).isNull().alias("none"), F.col(doc).alias("id"))


def frequent_keys(lines: DataFrame) -> DataFrame:
    """(key) whose rows could fill a good part of one partition of the sort, from one line in ``SAMPLED`` (by a hash, so every run finds the
    same). At most 1 / SHARE for each partition, give or take what sampling does. Results do not depend on which keys these are."""
    looked = lines.filter(F.pmod(F.xxhash64("doc", "pos", "key"), F.lit(SAMPLED)) == 0)
    partitions = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = materialise(looked.groupBy("key").agg(F.count("*").alias("n")).filter("n >= 3"), "line_counts")
    bound = looked.count() * SHARE / max(1, partitions)
    return counts.filter(F.col("n") >= max(3.0, bound)).select("key")


def dropped_lines(lines: DataFrame) -> DataFrame:
    """(doc, name, pos) of the lines that go: those of a key outside the first document that holds it. ``lines``: a written table.

    Hashes are range-partitioned and sorted by document and position within each partition, so the first document of a key
    is the first row of its run and all others stream past it. A frequent key takes no part: its first document comes from a minimum that every task
    takes of its own rows, and its lines are marked where they lie, so no run is longer than a fraction of a partition.
    """
    often = materialise(frequent_keys(lines).select(F.col("key").alias("_key")), "frequent")
    listed = F.broadcast(often)  # at most 1 / SHARE keys for each partition
    same = F.col("key") == F.col("_key")
    owners = materialise(lines.join(listed, same, "left_semi").groupBy(F.col("key").alias("_key")).agg(F.min(_first()).alias("owner")), "owners")
    hot = lines.join(F.broadcast(owners), same).withColumn("first", F.col("owner.id"))
    run = Window.partitionBy("key").orderBy(F.col("doc").asc_nulls_last(), "pos")
    cold = lines.join(listed, same, "left_anti").repartitionByRange("key").withColumn("first", F.first("doc").over(run.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    gone = lambda df: df.filter(~F.col("doc").eqNullSafe(F.col("first"))).select("doc", "name", "pos")
    return gone(cold).unionByName(gone(hot))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(doc, name, keep array<struct<word, mask>>): of every document that loses lines, the words of its bitmap that have a cleared bit.

    Bit ``pos & 63`` of word ``pos >> 6`` is set if that line stays; words that are absent keep all, so what is stored follows what is dropped.
    ``name`` tells texts under one id apart (``text_name``).
    """
    lines = materialise(line_rows(docs, id_col, text_col, least), "lines")
    word = dropped_lines(lines).groupBy("doc", "name", F.shiftright("pos", 6).alias("word")).agg(F.expr("~bit_or(shiftleft(1L, pos & 63))").alias("mask"))
    rows = word.groupBy("doc", "name").agg(F.array_sort(F.collect_list(F.struct("word", "mask"))).alias("keep"))
    return materialise(rows, "bitmaps")


def _dense(keep: Column) -> Column:
    """All words up to the last that has a cleared bit; ``keep`` has to be a stored column (it is looked at once for each word)."""
    gap = lambda x, k: x["word"] - F.when(k > 0, F.get(keep, k - 1)["word"]).otherwise(F.lit(-1)) - 1
    return F.flatten(F.transform(keep, lambda x, k: F.concat(F.array_repeat(F.lit(-1).cast("long"), gap(x, k)), F.array(x["mask"]))))


def _with_words(docs: DataFrame, bitmaps: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """``docs`` with a column of bitmap words (null: all lines stay), and that column's name."""
    doc, name, words = fresh(docs, "doc", "name", "words")
    slim = bitmaps.select(F.col("doc").alias(doc), F.col("name").alias(name), _dense(F.col("keep")).alias(words))
    slim = slim.hint("broadcast" if table_bytes(bitmaps) <= BROADCAST_BYTES else "shuffle_hash")  # texts need no sort
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(doc)) & (text_name(F.col(text_col)) == F.col(name))
    return docs.join(slim, same, "left"), words


def _stays(words: str, pos: Column) -> Column:
    word = F.get(F.col(words), F.shiftright(pos, 6))
    return word.isNull() | (F.call_function("shiftright", word, pos.bitwiseAND(F.lit(63))).bitwiseAND(F.lit(1).cast("long")) == 1)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """``docs`` with ``text`` less the lines that ``keep_bitmaps`` drops, and n_lines (before) and n_dropped; these two replace columns of
    those names.

    A line's key is the line without blanks at its ends, A-Z lower-cased. Keys of at least ``least`` code points found in two documents
    or more lose all their lines except in the document with the smallest id that holds it, where all of them stay. Other lines stay as they
    are. Text goes to its bitmap (one shuffle of the corpus) unless all bitmaps together are small enough to be broadcast.

    A null text is an empty one, with one empty line. Rows with one id are one document: a key's lines stay in all of them or in
    none. Rows with a null id are one document too, after all others. A repeated row is treated as its twin. An empty table gives no rows.
    """
    joined, words = _with_words(docs, keep_bitmaps(docs, id_col, text_col, least), id_col, text_col)
    lines = text_lines(F.col(text_col))
    kept = F.when(F.col(words).isNull(), F.coalesce(F.col(text_col).cast("string"), F.lit(""))).otherwise(F.array_join(F.filter(lines, lambda _, k: _stays(words, k)), "\n"))
    gone = F.coalesce(F.aggregate(F.col(words), F.lit(0), lambda n, w: n + F.lit(64) - F.bit_count(w)), F.lit(0))
    others = [c for c in docs.columns if c.lower() not in (text_col.lower(), "n_lines", "n_dropped")]
    return joined.select(*quoted(others), kept.alias(text_col), F.size(lines).cast("long").alias("n_lines"), gone.cast("long").alias("n_dropped"))


def line_dedup_digests(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, kept_sha256 (see ``dedup_lines``)."""
    return dedup_lines(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))
