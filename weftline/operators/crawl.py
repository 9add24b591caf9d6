"""Crawl state: pages asked and empty, universe, progress, quotas, and landed service answers to rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import places as P
from weftline.functions import urls as U
from weftline.functions.text import no_space
from weftline.operators.dedup import first_wins, new_rows
from weftline.operators.gazetteer import sorted_set_per


def landed_state(records: DataFrame, source: str = "amap_community") -> DataFrame:
    """(district, keyword, crawled_pages) rebuilt from the URLs of landed rows of one source."""
    a = U.asked(F.col("source_url"))
    rows = records.filter(F.col("source") == source).select(a.alias("a")).select("a.*").filter((F.col("district") != "") & (F.col("keyword") != "") & F.col("page").isNotNull())
    return rows.distinct().groupBy("district", "keyword").agg(F.array_sort(F.collect_list("page")).alias("crawled_pages"))


def universe(districts: DataFrame, keywords: DataFrame, existing: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Every (district, keyword) with its state: persisted overrides of known keys, else what exists, else empty."""
    keys = districts.select("district").join(F.broadcast(keywords.select("keyword")), F.lit(True), "inner")  # two short lists
    fields = {"count": "int", "total_pages": "int", "crawled_pages": "array<int>", "empty_pages": "array<int>"}
    for name, df in (("e", existing), ("o", overrides)):
        if df is not None:
            have = set(df.columns)
            side = df.select(F.col("district").alias(f"_{name}d"), F.col("keyword").alias(f"_{name}k"), *[(F.col(c).cast(t) if c in have else F.lit(None).cast(t)).alias(f"_{name}_{c}") for c, t in fields.items()])
            keys = keys.join(side, (F.col("district") == F.col(f"_{name}d")) & (F.col("keyword") == F.col(f"_{name}k")), "left")
    pick = lambda c, t: F.coalesce(*[F.col(f"_{n}_{c}") for n, df in (("o", overrides), ("e", existing)) if df is not None], (F.array() if "array" in t else F.lit(None)).cast(t)).alias(c)
    return keys.select("district", "keyword", *[pick(c, t) for c, t in fields.items()])


def progress(state: DataFrame) -> DataFrame:
    """Remaining pages of queries with a known total, unknown queries, known and crawled pages."""
    done = F.size(F.array_distinct("crawled_pages"))
    return state.agg(
        F.coalesce(F.sum(F.when(F.col("total_pages").isNotNull(), U.remaining_pages(F.col("total_pages"), F.col("crawled_pages")))), F.lit(0)).alias("known_remaining_pages"),
        F.count_if(F.col("total_pages").isNull()).alias("unknown_queries"), F.coalesce(F.sum("total_pages"), F.lit(0)).alias("known_total_pages"), F.coalesce(F.sum(done), F.lit(0)).alias("crawled_pages_in_universe"),
    )


def schedule(state: DataFrame, budget: int) -> DataFrame:
    """(district, keyword, page): the next page of each open query, queries of unknown size first, up to the request budget."""
    page = U.next_page(F.col("total_pages"), F.col("crawled_pages"))
    return state.withColumn("page", page).filter("page IS NOT NULL").orderBy(F.col("total_pages").isNotNull(), "district", "keyword").select("district", "keyword", "page").limit(budget)


def apply_answer(state: DataFrame, answers: DataFrame) -> DataFrame:
    """State after answers (district, keyword, page, answer_count, rows): count, total pages, crawled and empty pages."""
    a = answers.select(F.col("district").alias("_d"), F.col("keyword").alias("_k"), "page", "answer_count", "rows")
    j = state.join(a, (F.col("district") == F.col("_d")) & (F.col("keyword") == F.col("_k")), "left")
    hit, plus = F.col("page").isNotNull(), lambda c: F.array_sort(F.array_union(c, F.array("page")))
    out = j.select(
        "district", "keyword", F.when(hit, F.col("answer_count")).otherwise(F.col("count")).cast("int").alias("count"), F.when(hit, U.total_pages(F.col("answer_count"), F.col("page"))).otherwise(F.col("total_pages")).alias("total_pages"),
        F.when(hit, plus("crawled_pages")).otherwise(F.col("crawled_pages")).alias("crawled_pages"), F.when(hit & (F.col("rows") == 0), plus("empty_pages")).otherwise(F.col("empty_pages")).alias("empty_pages"),
    )
    return out


def api_records(pois: DataFrame, category: str, source: str, same_district: bool = True) -> DataFrame:
    """Place records of landed search answers (asked_district, name, adname, address, location, adcode, url): names cleaned, rows of
    another district than asked dropped, streets only with a street name."""
    name = P.clean_api_name(F.col("name"), F.lit(category))
    rows = pois.withColumn("district", P.valid_district(F.col("adname"))).withColumn("name", name).filter(F.col("name") != "")
    if same_district:
        rows = rows.filter(F.col("district") == F.col("asked_district"))
    if category == "street":
        rows = rows.filter(F.col("name").contains("街道") & ~F.col("name").contains("驻北京"))
    return rows.select("name", "district", F.lit(category).alias("category"), F.lit(source).alias("source"), U.without_parameter(F.col("url")).alias("source_url"), *[no_space(F.col(c)).alias(c) for c in ("address", "location", "adcode")])


def pages_before_stop(pages: DataFrame, key: str = "cell", full: int = 25, most: int = 10) -> DataFrame:
    """Pages that a caller would read: up to the first with under ``full`` rows, at most ``most`` (columns key, page, rows)."""
    stop = pages.filter(F.col("rows") < full).groupBy(key).agg(F.min("page").alias("_stop"))
    return pages.join(stop, key, "left").filter((F.col("page") <= F.coalesce("_stop", F.lit(most))) & (F.col("page") <= most)).drop("_stop")


def road_bindings(answers: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """(road, district, township, high_precision_zone): first of each, of landed reverse-geocode answers (pos, district, township,
    roads); answers without district or township bind nothing."""
    rows = answers.filter((F.coalesce("district", F.lit("")) != "") & (F.coalesce("township", F.lit("")) != "")).select((F.col("pos") * 1000).alias("base"), "district", "township", F.posexplode("roads").alias("k", "road"))
    rows = rows.filter(F.coalesce("road", F.lit("")) != "").withColumn("pos", F.col("base") + F.col("k"))
    keys = ["road", "district", "township"]
    kept = first_wins(rows, keys) if history is None else new_rows(rows, history, keys)
    return kept.select(*keys, P.precision_zone(F.col("district"), F.col("township")).alias("high_precision_zone"))


def quota(events: DataFrame, per_day: int, ts: str = "ts", key: str = "event_id") -> DataFrame:
    """Events within the daily quota, first come first served. Hours are counted first, so only the hour in which a day's quota
    runs out is ranked row by row."""
    day, hour = F.to_date(ts), F.date_trunc("hour", F.col(ts))
    hours = events.groupBy(day.alias("_day"), hour.alias("_hour")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_day").orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1))
    hours = hours.withColumn("_before", F.coalesce(before, F.lit(0)))
    rows = events.withColumn("_h", hour).join(hours, F.col("_h") == F.col("_hour")).filter(F.col("_before") < per_day)
    whole = rows.filter(F.col("_before") + F.col("_n") <= per_day)
    last = rows.filter(F.col("_before") + F.col("_n") > per_day).withColumn("_k", F.row_number().over(Window.partitionBy("_h").orderBy(ts, key))).filter(F.col("_k") + F.col("_before") <= per_day)
    return whole.select(*events.columns).unionByName(last.select(*events.columns))


def rate_limited(events: DataFrame, gap_seconds: float = 3.0, key: str = "user_id", ts: str = "ts", id_col: str = "event_id") -> DataFrame:
    """(key, id, ts) of the events at least ``gap_seconds`` after the key's last accepted one, which alone moves the clock; ties by id. Events without a time are
    not accepted.

    Events are sorted by Spark within the partition of their key and stream past it: what is held is one time, however many events a key has.
    """
    kinds, gap = dict(events.dtypes), int(gap_seconds * 1_000_000)
    slim = events.filter(F.col(ts).isNotNull()).select(F.col(key).alias("key"), F.col(id_col).alias("id"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.col(ts).alias("ts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, last = object(), None
        for batch in batches:
            kept = []
            for row, (k, at) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if k != name or last is None:
                    name, last = k, None
                if last is None or at - last >= gap:
                    kept.append(row)
                    last = at
            out = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([out.column(0), out.column(1), out.column(3)], names=[key, id_col, ts])

    return slim.repartition("key").sortWithinPartitions("key", "at", "id").mapInArrow(run, f"`{key}` {kinds[key]}, `{id_col}` {kinds[id_col]}, `{ts}` {kinds[ts]}")


def station_names(scripts: DataFrame, text: str = "text", pattern: str | None = None, plausible: Column | None = None) -> DataFrame:
    """Distinct plausible station names mined from script text, without their 站."""
    from weftline import rules

    found = scripts.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern or rules.STATION_PATTERN), F.lit(0))).alias("name"))
    rows = found.filter(P.plausible_station(F.col("name")) if plausible is None else plausible)
    return rows.select(F.regexp_replace("name", "站$", "").alias("name")).distinct()


__all__ = ["api_records", "apply_answer", "landed_state", "pages_before_stop", "progress", "quota", "rate_limited", "road_bindings", "schedule", "sorted_set_per", "station_names", "universe"]
