"""Functions of place names: categories, clean-up, districts, keys and grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline import rules
from weftline.functions.text import contains_any, first_group, let, no_space, within


def _match(c: Column, pattern: str) -> Column:
    """The first match, null if none."""
    return F.nullif(F.regexp_extract(c, pattern, 0), F.lit(""))


def purified_category(name: Column, table: Sequence = tuple(rules.PURIFY_RULES), default: str = rules.PURIFY_DEFAULT) -> Column:
    return first_group(name, table, default)


def taxonomy_category(name: Column, given: Column, table: Sequence = tuple(rules.TAXONOMY_RULES)) -> Column:
    """The given category if it is one that is kept, else by keyword, community or road ending, else ``poi_misc``."""
    def by_rule(text: Column) -> Column:
        road = F.lit(False)
        for end in rules.ROAD_ENDS:
            road = road | text.endswith(end)
        by_name = F.when(text.rlike(rules.COMMUNITY_NAME), F.lit("community")).when(road, F.lit("road")).otherwise(F.lit("poi_misc"))
        return F.coalesce(*[F.when(contains_any(text, words), F.lit(label)) for label, words in table], by_name)

    return F.when(given.isin(*rules.TAXONOMY_KEPT), given).otherwise(let(no_space(name), by_rule))


def clean_alias(name: Column, category: Column) -> Column:
    """Alias of a place by category; empty if none is left."""
    strip = lambda t: F.when(category == "subway_station", F.replace(t, F.lit("地铁站"), F.lit(""))).when(category == "bus_stop", F.replace(t, F.lit("公交站"), F.lit(""))).otherwise(t)
    pick = lambda t: F.when(category == "street", F.regexp_extract(t, rules.ALIAS_STREET, 0)).when(within(t, 2, 30), t).otherwise(F.lit(""))
    return let(let(F.regexp_replace(no_space(name), rules.BRACKETED, ""), strip), pick)


def curated_name(name: Column, category: Column) -> Column:
    """Curated name of a street, station or community; empty for anything else."""
    text = no_space(name)
    station = F.replace(F.regexp_replace(text, rules.BRACKETED, ""), F.lit("地铁站"), F.lit(""))
    return (
        F.when(category == "street", F.regexp_extract(text, rules.CURATE_STREET, 0))
        .when((category == "subway_station") & within(station, 2, 10), station)
        .when(category == "community", F.regexp_extract(text, rules.CURATE_COMMUNITY, 0))
        .otherwise(F.lit(""))
    )


def should_drop(name: Column, words: Sequence[str] = tuple(rules.CURATE_DROP), names: Sequence[str] = ("北京",)) -> Column:
    return (F.coalesce(name, F.lit("")) == "") | name.isin(*names) | contains_any(name, words)


def community_name(name: Column, words: Sequence[str] = tuple(rules.COMMUNITY_DROP), patterns: Sequence[str] = tuple(rules.COMMUNITY_PATTERNS)) -> Column:
    """A community's name by the first pattern that fits; empty if dropped."""
    found = lambda t: F.coalesce(*[_match(t, p) for p in patterns], F.lit(""))
    return let(F.regexp_replace(no_space(name), rules.BRACKETED, ""), lambda t: F.when(contains_any(t, words) | ~within(t, 2, 24), F.lit("")).otherwise(found(t)))


def coordinates(location: Column) -> tuple[Column, Column]:
    """Longitude and latitude of a "lng,lat" text; null unless both are numbers."""
    parts = F.split(location, ",")
    lng, lat = (F.get(parts, k).try_cast("double") for k in (F.lit(0), F.lit(1)))
    both = lng.isNotNull() & lat.isNotNull()
    return F.when(both, lng), F.when(both, lat)


def place_key(name: Column, location: Column) -> Column:
    """struct(name, lng, lat, raw): coordinates to three decimals as numbers, or the raw location where they cannot be read."""
    lng, lat = coordinates(location)
    return F.struct(name.alias("name"), F.round(lng, 3).alias("lng"), F.round(lat, 3).alias("lat"), F.when(lng.isNull(), F.coalesce(location, F.lit(""))).alias("raw"))


def district_by_list(text: Column, names: Sequence[str] = tuple(rules.DISTRICTS), suffix: str = "区") -> Column:
    """The first district of the list whose full or short name occurs; empty if none."""
    return let(no_space(text), lambda t: F.coalesce(*[F.when(t.contains(n) | t.contains(n.removesuffix(suffix)), F.lit(n)) for n in names], F.lit("")))


def district_by_position(title: Column, content: Column, pattern: str = rules.DISTRICT_IN_TEXT, default: str = rules.DEFAULT_DISTRICT, suffix: str = "区") -> Column:
    """The district named first in the text, else the default."""
    found = F.regexp_extract(F.concat(F.coalesce(title, F.lit("")), F.coalesce(content, F.lit(""))), pattern, 1)
    return F.when(found == "", F.lit(default)).otherwise(F.concat(found, F.lit(suffix)))


def valid_district(text: Column, names: Sequence[str] = tuple(rules.DISTRICTS)) -> Column:
    t = no_space(text)
    return F.when(t.isin(*names), t).otherwise(F.lit(""))


def clean_api_name(name: Column, category: Column) -> Column:
    text = F.replace(F.regexp_replace(no_space(name), "[（(]地铁站[）)]", ""), F.lit("地铁站"), F.lit(""))
    street = F.replace(F.replace(text, F.lit("街道办事处"), F.lit("街道")), F.lit("办事处"), F.lit(""))
    return F.when(category == "street", street).otherwise(text)


def plausible_station(text: Column) -> Column:
    return within(text, 2, 8) & ~text.isin(*rules.STATION_BLACKLIST) & ~contains_any(text, rules.STATION_WORDS) & text.rlike("[一-鿿]")


def looks_blocked(html: Column, markers: Sequence[str] = tuple(rules.BLOCKED_MARKERS)) -> Column:
    return let(F.lower(F.coalesce(html, F.lit(""))), lambda low: contains_any(low, [m.lower() for m in markers]))


def precision_zone(district: Column, township: Column) -> Column:
    return F.concat(F.coalesce(district, F.lit("")), F.coalesce(township, F.lit("")))


def grid(spark: SparkSession, south: float, north: float, west: float, east: float, step: float, digits: int = 5) -> DataFrame:
    """(lng, lat) of a grid over a box, both ends included; whole steps are counted, so no drift adds up."""
    rows, cols = (int(round((b - a) / step, 6)) for a, b in ((south, north), (west, east)))
    lat = spark.range(rows + 1).select(F.round(F.lit(south) + F.col("id") * step, digits).alias("lat"))
    lng = spark.range(cols + 1).select(F.round(F.lit(west) + F.col("id") * step, digits).alias("lng"))
    return lat.crossJoin(F.broadcast(lng)).select("lng", "lat")  # both sides are bounded by the box
