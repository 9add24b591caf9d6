"""Feedback store: append, look up, search, statistics, export and delete."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.schemas import FEEDBACK
from weftline.sources.log_table import LogTable


def with_defaults(records: DataFrame, now: datetime | None = None, client_ip: str = "", user_agent: str = "") -> DataFrame:
    """Records of any subset of the fields in the store's shape: empty texts, 0 for numbers, helpful as 0 or 1, the request's
    time and client."""
    texts = ("tag", "title", "body", "reply", "unit", "district", "feedback_type", "comments")
    have = set(records.columns)
    c = lambda n, default: F.coalesce(F.col(n), F.lit(default)) if n in have else F.lit(default)
    stamp = F.lit((now or datetime.now()).isoformat())
    out = {n: c(n, "").cast("string") for n in texts}
    out |= {"timestamp": F.coalesce(F.col("timestamp"), stamp) if "timestamp" in have else stamp, "is_helpful": F.when(F.col("is_helpful").cast("boolean"), 1).otherwise(0) if "is_helpful" in have else F.lit(0)}
    out |= {"client_ip": c("client_ip", client_ip), "user_agent": c("user_agent", user_agent), "processing_time": c("processing_time", 0.0).cast("double")}
    return records.select(*[v.alias(k) for k, v in out.items()])


def append(store: str, records: DataFrame, created_at: datetime) -> int:
    """Write records with new ids to the table at ``store`` and return the largest id. Several writers at a time get different ids."""
    rows = records.withColumn("created_at", F.lit(created_at)).withColumn("created_on", F.to_date("created_at"))
    return LogTable(records.sparkSession, store).append(rows)


def read(store: str, spark: SparkSession) -> DataFrame:
    """The rows of the table at ``store`` as they are now."""
    rows = LogTable(spark, store).read()
    return rows if rows is not None else spark.createDataFrame([], f"{FEEDBACK}, created_on date")


def by_id(store: DataFrame, row_id: int, id_col: str = "id") -> DataFrame:
    return store.filter(F.col(id_col) == row_id)


def _page(df: DataFrame, order: list[Column], limit: int, offset: int) -> DataFrame:
    """A page of an ordered table; a negative limit means all."""
    df = df.orderBy(*order)
    df = df.offset(offset) if offset > 0 else df
    return df if limit < 0 else df.limit(limit)


def listing(store: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    return _page(store, [F.desc("created_at"), F.desc("id")], limit, offset)


def matching(store: DataFrame, keyword: str | None = None, tag: str | None = None, district: str | None = None, is_helpful: bool | None = None, start: datetime | date | None = None, end: datetime | date | None = None) -> DataFrame:
    """Rows that meet every given filter; an empty or absent filter is dropped. ``%`` and ``_`` in the keyword are wildcards;
    an end date is its midnight, so its own day is outside."""
    test = F.lit(True)
    if keyword:
        any_ = F.lit(False)
        for c in ("title", "body", "reply"):
            if c in store.columns:
                any_ = any_ | F.coalesce(F.col(c).ilike(f"%{keyword}%"), F.lit(False))
        test = test & any_
    for c, v in (("tag", tag), ("district", district)):
        if v:
            test = test & (F.col(c) == v)
    if is_helpful is not None:
        test = test & (F.col("is_helpful") == int(is_helpful))
    if start is not None:
        test = test & (F.col("created_at") >= F.lit(start))
    if end is not None:
        test = test & (F.col("created_at") <= F.lit(end))
    return store.filter(test)


def search(store: DataFrame, limit: int = 100, offset: int = 0, **filters) -> DataFrame:
    return _page(matching(store, **filters), [F.desc("created_at"), F.desc("id")], limit, offset)


def helpful_rate(helpful: Column, total: Column) -> Column:
    """Percent to two decimals; 0 of nothing."""
    return F.round(F.coalesce(F.try_divide(helpful * 100.0, total), F.lit(0.0)), 2)


def totals(store: DataFrame) -> DataFrame:
    out = store.agg(F.count("*").alias("total_count"), F.count_if(F.col("is_helpful") == 1).alias("helpful_count"), F.count_if(F.col("is_helpful") == 0).alias("unhelpful_count"))
    return out.withColumn("helpful_rate", helpful_rate(F.col("helpful_count"), F.col("total_count")))


def distribution(store: DataFrame, column: str, top: int = 10, drop_empty: bool = False) -> DataFrame:
    """The ``top`` values by rows, ties by value. ``drop_empty`` leaves out empty and null values."""
    rows = store.filter(F.col(column) != "") if drop_empty else store
    return rows.groupBy(column).agg(F.count("*").alias("count")).orderBy(F.desc("count"), F.asc_nulls_first(column)).limit(top)


def trend(store: DataFrame, as_of: date, days: int = 7) -> DataFrame:
    """Rows and helpful rows of each day from ``days`` before ``as_of`` on: up to days + 1 calendar days."""
    recent = store.filter(F.col("created_at") >= F.date_sub(F.lit(as_of), days).cast("timestamp_ntz"))
    return recent.groupBy(F.to_date("created_at").alias("date")).agg(F.count("*").alias("count"), F.count_if(F.col("is_helpful") == 1).alias("helpful")).orderBy("date")


def stats_view(store: DataFrame) -> DataFrame:
    """One row of sums and distinct counts. ``helpful_rate`` here averages an indicator of a helpful value being given at all,
    so it is 1 where every row has one."""
    return store.agg(
        F.count("*").alias("total_feedback"), F.sum(F.when(F.col("is_helpful") == 1, 1).otherwise(0)).alias("helpful_count"), F.sum(F.when(F.col("is_helpful") == 0, 1).otherwise(0)).alias("unhelpful_count"),
        F.avg(F.when(F.col("is_helpful").isNotNull(), 1.0).otherwise(0.0)).alias("helpful_rate"), F.countDistinct("tag").alias("unique_tags"), F.countDistinct("unit").alias("unique_units"), F.countDistinct("district").alias("unique_districts"),
    )


def delete(store: str, spark: SparkSession, row_id: int) -> bool:
    """Delete the row with this id; whether there was one."""
    return LogTable(spark, store).delete(row_id)


def export(store: DataFrame, path: str) -> int:
    """All rows as JSON lines, newest first; how many."""
    listing(store, -1).write.mode("overwrite").json(path)
    return store.count()
