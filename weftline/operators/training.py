"""Training data: filters, text building, label encoding, samples and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline import rules
from weftline.functions import text as X
from weftline.operators.dedup import first_wins


def without_nulls(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.na.drop(subset=columns)


def usable_replies(df: DataFrame, reply: str = "reply", pos: str = "pos", low: Column | None = None, negative: Column | None = None) -> DataFrame:
    """``df`` with a cleaned ``answer``: replies of over 5 characters whose answer has 50 to 600, is not of low quality, reports no
    fruitless visit, and is the first of its kind. ``low`` and ``negative`` replace those tests (over column answer)."""
    least, most = rules.REPLY_LENGTHS
    rows = df.filter(F.char_length(reply) > 5).withColumn("answer", X.clean_reply(F.col(reply)))
    rows = rows.filter(F.char_length("answer").between(least, most))
    rows = rows.filter(~(X.is_low_quality(F.col("answer")) if low is None else low)).filter(~(X.is_on_site_negative(F.col("answer")) if negative is None else negative))
    return first_wins(rows, ["answer"], pos)


def label_map(df: DataFrame, label: str) -> DataFrame:
    """(label_id, label): the sorted distinct labels from 0. What one task numbers is the distinct labels, a class list."""
    from pyspark.sql import Window

    kinds = df.select(label).filter(F.col(label).isNotNull()).distinct()
    return kinds.select((F.row_number().over(Window.orderBy(label)) - 1).alias("label_id"), label)


def encoded(df: DataFrame, label: str) -> DataFrame:
    return df.join(label_map(df, label), label)


def _order(key: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), key)


def sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """``n`` rows at random, the same for one seed whatever the partitioning; all rows if there are no more."""
    return df.orderBy(_order(key, seed), key).limit(n)


def portable_order(key: str, seed: int = 42) -> Column:
    """An order that any engine with MD5 gives: the hex digest of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))


def portable_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """``sample`` in the portable order."""
    return df.orderBy(portable_order(key, seed), key).limit(n)


def portable_split(df: DataFrame, key: str, test_size: float = 0.05, seed: int = 42) -> DataFrame:
    """``hash_split`` in the portable order: tested are the keys whose first eight digits are below ``test_size`` of their range."""
    return df.withColumn("part", F.when(F.conv(F.substring(portable_order(key, seed), 1, 8), 16, 10).cast("long") < int(test_size * (1 << 32)), "test").otherwise("train"))


def stratified_split(df: DataFrame, label: str, key: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """``df`` with ``part`` train or test: of each label the rows with the smallest hashes are tested, ``test_size`` of it to
    the nearest row.

    A label's size gives the hash near which the cut lies; only rows within that band are ranked, so no task sorts a label.
    """
    place = (_order(key, seed) / F.lit(float(1 << 64)) + 0.5).alias("place")
    keyed = df.withColumn("_place", place)
    sizes = keyed.groupBy(label).agg(F.count("*").alias("_n"))
    joined = keyed.join(sizes.withColumnRenamed(label, "_label"), F.col(label).eqNullSafe(F.col("_label"))).drop("_label")
    band = 6 * F.sqrt(F.lit(test_size * (1 - test_size)) / F.col("_n")) + 1 / F.col("_n")
    below, within = F.col("_place") < test_size - band, F.abs(F.col("_place") - test_size) <= band
    counted = joined.groupBy(label).agg(F.count_if(below).alias("_below")).withColumnRenamed(label, "_label")
    from pyspark.sql import Window

    w = Window.partitionBy(label).orderBy("_place", key)
    near = joined.filter(within).withColumn("_rank", F.row_number().over(w)).join(counted, F.col(label).eqNullSafe(F.col("_label"))).drop("_label")
    want = F.floor(F.lit(test_size) * F.col("_n") + 0.5)
    near = near.withColumn("part", F.when(F.col("_rank") + F.col("_below") <= want, "test").otherwise("train"))
    far = joined.filter(~within).withColumn("part", F.when(below, "test").otherwise("train"))
    return near.select(*df.columns, "part").unionByName(far.select(*df.columns, "part"))


def hash_split(df: DataFrame, key: str, test_size: float = 0.05, seed: int = 42) -> DataFrame:
    """``df`` with ``part`` train or test by a hash of the key; nothing is shuffled."""
    return df.withColumn("part", F.when(F.pmod(_order(key, seed), F.lit(10_000)) < int(test_size * 10_000), "test").otherwise("train"))


def answered_turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(conv_id, turn, question, reply): each user turn that an assistant turn follows directly."""
    user = conversations.filter("role = 'user'").select(conv, turn, F.col("text").alias("question"))
    answer = conversations.filter("role = 'assistant'").select(F.col(conv).alias("_c"), (F.col(turn) - 1).alias("_t"), F.col("text").alias("reply"))
    return user.join(answer, (F.col(conv) == F.col("_c")) & (F.col(turn) == F.col("_t"))).select(conv, turn, "question", "reply")
