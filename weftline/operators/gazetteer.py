"""Gazetteer: clean and curate place records, merge per-district aliases, build the scored alias catalog, purify POIs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline import rules
from weftline.functions import places as P
from weftline.functions.text import no_space, strip
from weftline.operators.dedup import first_by_priority, last_wins, most_confident


def district_table(spark: SparkSession, names: Sequence[str] = tuple(rules.DISTRICTS)) -> DataFrame:
    """(ord, district), one row per name in list order."""
    return spark.createDataFrame(list(enumerate(names)), "ord int, district string")


def sorted_set_per(df: DataFrame, key: str, value: str, dimension: DataFrame | None = None, out: str = "values") -> DataFrame:
    """Sorted distinct values of each key; with a dimension (column of the key's name) every one of its keys, empty sets included.

    Distinct first, so what is collected for a key is its set and not its rows.
    """
    sets = df.select(key, value).distinct().groupBy(key).agg(F.array_sort(F.collect_list(value)).alias(out))
    if dimension is None:
        return sets
    joined = dimension.select(key).distinct().join(sets, key, "left")
    return joined.withColumn(out, F.coalesce(out, F.array().cast("array<string>")))


def curate(records: DataFrame, names: Sequence[str] = tuple(rules.DISTRICTS)) -> DataFrame:
    """``records`` with (district, alias, kept): kept rows have a listed district and a name that curation leaves."""
    district, category = no_space(F.col("district")), no_space(F.col("category"))
    alias = P.curated_name(F.col("name"), category)
    return records.withColumns({"district": district, "alias": alias}).withColumn("kept", F.col("district").isin(*names) & ~P.should_drop(F.col("alias")))


def merge_communities(records: DataFrame, names: Sequence[str] = tuple(rules.DISTRICTS)) -> DataFrame:
    """``records`` with (district, alias, kept) by the community cleaner."""
    out = records.withColumns({"district": no_space(F.col("district")), "alias": P.community_name(F.col("name"))})
    return out.withColumn("kept", F.col("district").isin(*names) & (F.col("alias") != ""))


def kept_report(marked: DataFrame) -> DataFrame:
    """Rows in, kept and dropped (rows, not distinct aliases)."""
    return marked.agg(F.count("*").alias("input_records"), F.count_if("kept").alias("kept_aliases"), F.count_if(~F.col("kept")).alias("dropped_records"))


def alias_union(*parts: DataFrame) -> DataFrame:
    """Distinct (district, alias) of all parts."""
    out = parts[0].select("district", "alias")
    for p in parts[1:]:
        out = out.unionByName(p.select("district", "alias"))
    return out.distinct()


def catalog_candidates(merged: DataFrame, communities: DataFrame, rows: DataFrame, names: Sequence[str] = tuple(rules.DISTRICTS)) -> DataFrame:
    """(alias, district, category, confidence, source, pos) of merged aliases, then of raw records (with column pos)."""
    score = lambda c, default: F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in rules.CATEGORY_CONFIDENCE.items()], F.lit(default))
    known = communities.select(F.col("district").alias("_d"), F.col("alias").alias("_a")).distinct()
    base = merged.filter(F.col("district").isin(*names) & ~F.col("alias").isin(*rules.CITY_NAMES)).join(known, (F.col("district") == F.col("_d")) & (F.col("alias") == F.col("_a")), "left")
    base = base.withColumn("category", F.when(F.col("_a").isNotNull(), "community").otherwise("dictionary_core"))
    base = base.select("alias", "district", "category", score(F.col("category"), 0.8).alias("confidence"), F.lit("merged_dictionary").alias("source"), F.lit(-1).cast("bigint").alias("pos"))
    category = P.taxonomy_category(F.col("name"), no_space(F.col("category")))
    raw = rows.withColumn("district", no_space(F.col("district"))).filter(F.col("district").isin(*names)).withColumn("category", category)
    raw = raw.withColumn("alias", P.clean_alias(F.col("name"), F.col("category"))).filter((F.col("alias") != "") & ~F.col("alias").isin(*rules.CITY_NAMES))
    raw = raw.select("alias", "district", "category", score(F.col("category"), 0.52).alias("confidence"), F.coalesce("source", F.lit("raw_poi")).alias("source"), F.col("pos").cast("bigint").alias("pos"))
    return base.unionByName(raw)


def alias_catalog(candidates: DataFrame) -> DataFrame:
    """The most confident entry of each (alias, district), in (category, district, alias) order."""
    return most_confident(candidates).select("alias", "district", "category", "confidence", "source").orderBy("category", "district", "alias")


def category_counts(candidates: DataFrame) -> DataFrame:
    """Distinct aliases of each category and district. Membership counts even where the catalog prefers another category."""
    return candidates.groupBy("category", "district").agg(F.countDistinct("alias").alias("aliases"))


def purify(sources: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """One row per name and rounded coordinates, the first source preferred, with its category. ``sources``: (name, rows with
    name, district, location, address, pos). Rows without a name are left out."""
    rows = None
    for k, (name, df) in enumerate(sources):
        text = lambda c: strip(F.coalesce(F.col(c), F.lit("")))
        one = df.select(text("name").alias("name"), text("district").alias("district"), text("location").alias("location"), text("address").alias("address"), F.lit(name).alias("source"), F.lit(k).alias("priority"), F.col("pos").cast("bigint").alias("pos"))
        rows = one if rows is None else rows.unionByName(one)
    named = rows.filter(F.col("name") != "")
    unique = first_by_priority(named, [P.place_key(F.col("name"), F.col("location"))])
    return unique.withColumn("category", P.purified_category(F.col("name")))


def crawl_records(records: DataFrame) -> DataFrame:
    """Crawled place records, the last of each (name, district, category), in the order their keys came."""
    return last_wins(records, ["name", "district", "category"]).orderBy("first_pos")


def fill_districts(records: DataFrame, lookup: DataFrame) -> DataFrame:
    """Missing districts from a landed lookup (name, found); rows that it does not know stay as they are."""
    found = lookup.select(F.col("name").alias("_name"), P.valid_district(F.col("found")).alias("_found")).dropDuplicates(["_name"])
    out = records.join(found, (F.col("name") == F.col("_name")) & (F.coalesce("district", F.lit("")) == ""), "left")
    return out.withColumn("district", F.coalesce(F.nullif(F.col("_found"), F.lit("")), F.col("district"))).drop("_name", "_found")


def crawl_report(records: DataFrame, dimension: DataFrame) -> DataFrame:
    """Distinct names of each district of the dimension, none included."""
    n = records.filter(F.col("name") != "").groupBy("district").agg(F.countDistinct("name").alias("names"))
    return dimension.select("district").join(n, "district", "left").select("district", F.coalesce("names", F.lit(0)).alias("names"))
