"""Structured Streaming: rate limit, daily quota, deduplicated and appended ingestion, newest answer per session.

Each flow has a batch twin in ``weftline.operators`` with the same results on the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weftline.sources.log_table import LogTable


def read_files(spark: SparkSession, path: str, schema, form: str = "parquet", files_per_batch: int = 100) -> DataFrame:
    """A stream of the files of a folder, or of the one file that ``path`` names."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(form)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile():
        folder, _, name = path.rpartition("/")
        return reader.option("pathGlobFilter", name).load(folder)
    return reader.load(path)


def rate_limited(events: DataFrame, key: str = "user_id", ts: str = "ts", id_col: str = "event_id", gap_seconds: float = 3.0, idle: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Accepted events: at least ``gap_seconds`` after the key's last accepted one, which alone moves the clock.

    State is one timestamp per key and goes once the watermark is ``idle`` past it. Within a batch events are taken in time order.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    source = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["_ts", id_col])
        kept = []
        for i, t in zip(rows[id_col], rows["_ts"], strict=True):
            now = t.timestamp()
            if last is None or now - last >= gap_seconds:
                kept.append((k[0], int(i), t))
                last = now
        state.update((last,))
        state.setTimeoutTimestamp(max(int(last * 1000), state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame(kept, columns=[key, id_col, ts])

    kind = dict(events.dtypes)
    shape = f"{key} {kind[key]}, {id_col} bigint, {ts} timestamp"
    return source.groupBy(key).applyInPandasWithState(step, shape, "last double", "append", GroupStateTimeout.EventTimeTimeout)


def first_by_key(events: DataFrame, key: str, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """The first event of each key; state of a key goes with the watermark."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def within_quota(events: DataFrame, per_day: int, ts: str = "ts", id_col: str = "event_id", late: str = "1 hour") -> DataFrame:
    """Events within the daily quota, keyed by day: the day's counter is the whole state."""
    source = events.withColumn("_ts", F.col(ts).cast("timestamp")).withColumn("_day", F.to_date("_ts")).withWatermark("_ts", late)

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        used = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values(["_ts", id_col]).head(max(0, per_day - used))
        state.update((used + len(rows),))
        state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + 2 * 86_400_000)
        yield rows[[id_col, "_ts"]].rename(columns={"_ts": ts})

    return source.groupBy("_day").applyInPandasWithState(step, f"{id_col} bigint, {ts} timestamp", "used long", "append", GroupStateTimeout.EventTimeTimeout)


def append_to(df: DataFrame, path: str, checkpoint: str, form: str = "parquet") -> StreamingQuery:
    """Append all that is available to files; restarts resume at the checkpoint."""
    return df.writeStream.format(form).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def ingest(df: DataFrame, write, checkpoint: str) -> StreamingQuery:
    """Give each micro-batch to ``write(batch, epoch)``; a repeated epoch is the caller's to recognise."""
    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_once(df: DataFrame, table: LogTable, app: str, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch to ``table`` once: its epoch is committed with its rows, so a batch that is repeated after a crash, or after the
    checkpoint was lost, adds nothing."""
    return ingest(df, lambda batch, epoch: table.append(batch, app, epoch) and None, checkpoint)


def newest(answers: DataFrame, session: str = "session", seq: str = "seq") -> DataFrame:
    """The payload of the newest request of each session."""
    return answers.groupBy(session).agg(F.max(seq).alias(seq), F.max_by("payload", seq).alias("payload"))
