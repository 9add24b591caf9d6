"""What is broadcast: by the memory that rows take, not by their files alone."""

from pyspark.sql import functions as F

from weftline.sources import workspace
from weftline.sources.workspace import MEMORY_BYTES, small, store, table_bytes


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_many_rows_of_a_small_file_are_not_broadcast(spark):
    """Rows that repeat take few bytes of a file and many of the driver."""
    pairs = store(spark.range(0, 1_500_000, 1, 2).select((F.col("id") / 1000).cast("int").cast("string").alias("query_id"), (F.col("id") % 8).alias("block")), "pairs")
    few = store(spark.range(1000).select(F.col("id").cast("string").alias("query_id")), "few")
    big = spark.range(5_000_000).select(F.col("id").cast("string").alias("query_id"))
    assert table_bytes(pairs) < workspace.BROADCAST_BYTES and workspace.memory_bytes(pairs) > MEMORY_BYTES
    assert "BroadcastHashJoin" in plan(big.join(pairs, "query_id"))  # the planner's own choice
    assert "BroadcastHashJoin" not in plan(big.join(small(pairs), "query_id")) and "BroadcastHashJoin" in plan(big.join(small(few), "query_id"))
