"""A cache of bounded size whose entries expire, replayed over a log of accesses."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUTCOME = "outcome string, evicted string, held int"


class ExpiringCache:
    """Entries by item with the time of their last use (microseconds).

    An access of an entry no older than the time to live is a hit and renews it. Any other access is a miss and puts the item in: entries that are too old go, and if the cache is still full so does the one unused for longest, of several
    the one that was put in first.
    """

    def __init__(self, max_size: int, ttl: int, entries: dict[str, tuple[int, int]] | None = None) -> None:
        self.max_size, self.ttl, self.entries = max_size, ttl, dict(entries or {})

    def expire(self, now: int) -> list[str]:
        gone = [k for k, (at, _) in self.entries.items() if now - at > self.ttl]
        for k in gone:
            del self.entries[k]
        return gone

    def access(self, item: str, now: int) -> tuple[str, str | None, int]:
        """(outcome, evicted item, entries held afterwards)"""
        at, order = self.entries.get(item, (None, 0))
        if at is not None and now - at <= self.ttl:
            self.entries[item] = (now, order)
            return "hit", None, len(self.entries)
        self.expire(now)
        evicted = min(self.entries, key=self.entries.__getitem__) if len(self.entries) >= self.max_size else None
        if evicted is not None:
            del self.entries[evicted]
        self.entries[item] = (now, max((o for _, o in self.entries.values()), default=0) + 1)
        return "miss", evicted, len(self.entries)


def replay(accesses: DataFrame, max_size: int, ttl_seconds: float, cache: str = "user_id", item: str = "event_type", ts: str = "ts", id_col: str = "event_id") -> DataFrame:
    """(cache, id, outcome, evicted, held): each access of each cache in time order (ties by id).

    Accesses are sorted by Spark within the partition of their cache and stream past it; what is held is one cache of ``max_size`` entries, however long its log.
    Null items are one item; rows without a time come first, at the beginning of time.
    """
    kinds, ttl = dict(accesses.dtypes), int(ttl_seconds * 1_000_000)
    micros = F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")), F.lit(-(1 << 62)))
    slim = accesses.select(F.col(cache).alias("cache"), F.col(id_col).alias("id"), F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), micros.alias("now"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = object(), None
        for batch in batches:
            rows = []
            for c, k, now in zip(*(batch.column(j).to_pylist() for j in (0, 2, 3)), strict=True):
                if held is None or c != name:
                    name, held = c, ExpiringCache(max_size, ttl)
                rows.append(held.access(k, now))
            out = [pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.string(), pa.string(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *out], names=[cache, id_col, "outcome", "evicted", "held"])

    dealt = slim.repartition("cache").sortWithinPartitions("cache", "now", "id")
    return dealt.mapInArrow(run, f"`{cache}` {kinds[cache]}, `{id_col}` {kinds[id_col]}, {OUTCOME}")
