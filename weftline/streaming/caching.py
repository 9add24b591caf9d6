"""The expiring cache as a stream: entries in map state, a timer that clears what nobody asks for again."""

from __future__ import annotations

import contextlib
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from weftline.operators.cache import OUTCOME, ExpiringCache

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """The state store that map state and timers need, for queries started inside; the session's own setting is put back."""
    was = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, was) if was else spark.conf.unset(_PROVIDER)


class CacheProcessor(StatefulProcessor):
    """One cache for each key. Its state is an entry for each item; a timer at the time the newest entry expires deletes it all."""

    def __init__(self, max_size: int, ttl: int) -> None:
        self.max_size, self.ttl = max_size, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.items = handle.getMapState("items", "item string", "at long, place long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = {k[0]: (int(v[0]), int(v[1])) for k, v in self.items.iterator()} if self.items.exists() else {}
        cache = ExpiringCache(self.max_size, self.ttl, before)
        log = pd.concat(list(rows)).sort_values(["now", "id"], kind="stable")
        done = [cache.access(k, int(now)) for k, now in zip(log["item"], log["now"], strict=True)]
        for item in before.keys() - cache.entries.keys():
            self.items.removeKey((item,))
        for item, entry in cache.entries.items():
            if before.get(item) != entry:
                self.items.updateValue((item,), entry)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        last = max(at for at, _ in cache.entries.values()) if cache.entries else 0
        self.handle.registerTimer(max((last + self.ttl) // 1000, timerValues.getCurrentWatermarkInMs()) + 1)
        outcome, evicted, held = zip(*done, strict=True)
        yield pd.DataFrame({"cache": key[0], "id": log["id"].to_numpy(), "outcome": outcome, "evicted": evicted, "held": held})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.items.clear()
        return iter(())

    def close(self) -> None:
        pass


def cached(accesses: DataFrame, max_size: int, ttl_seconds: float, cache: str = "user_id", item: str = "event_type", ts: str = "ts", id_col: str = "event_id", late: str = "1 hour") -> DataFrame:
    """(cache, id, outcome, evicted, held) of a stream of accesses: ``operators.cache.replay`` as they come in. Start it inside ``keyed_state``.

    Within a micro-batch accesses are taken in time order (ties by id). State of a cache is at most ``max_size`` entries, and none once the watermark has passed the
    newest entry's time to live.
    """
    for name in (__name__, ExpiringCache.__module__):  # one of the processes that load the processor knows neither shipped files nor the driver's path
        cloudpickle.register_pickle_by_value(sys.modules[name])
    kinds = dict(accesses.dtypes)
    at = F.col(ts).cast("timestamp")
    slim = accesses.select(F.col(cache).alias("cache"), F.col(id_col).alias("id"), F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.unix_micros(at).alias("now"), at.alias("_ts")).withWatermark("_ts", late)
    shape = f"cache {kinds[cache]}, id {kinds[id_col]}, {OUTCOME}"
    out = slim.groupBy("cache").transformWithStateInPandas(CacheProcessor(max_size, int(ttl_seconds * 1_000_000)), shape, "Append", "EventTime")
    return out.withColumnRenamed("cache", cache).withColumnRenamed("id", id_col)
