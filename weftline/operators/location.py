"""Location resolver: direct district mentions and aliases in a text, scored per district."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline import rules
from weftline.functions.text import distinct_matches, no_space
from weftline.operators.segment import segmented_places, word_parts
from weftline.sources.workspace import spread, store

#: Aliases of one automaton; a longer dictionary takes one pass over the texts per part.
ALIASES_AT_ONCE = 200_000
#: Confidence of a direct mention, of an alias that is its district's name, of any other alias.
DIRECT, OWN_NAME, ALIAS = 0.99, 0.90, 0.84


def dictionary_aliases(dictionary: DataFrame, suffix: str = "区") -> DataFrame:
    """(alias, district, category, confidence, source, pos) of a dictionary (ord, district, aliases): the name, its short form and
    its aliases; a later entry of an alias replaces an earlier one."""
    own = F.array(F.col("district"), F.regexp_replace("district", suffix + "$", ""))
    names = F.filter(F.concat(own, F.coalesce("aliases", F.array().cast("array<string>"))), lambda a: a.isNotNull() & (a != ""))
    rows = dictionary.select("ord", "district", F.posexplode(names).alias("k", "alias")).withColumn("pos", F.col("ord").cast("bigint") * 1_000_000 + F.col("k"))
    kept = rows.groupBy("alias").agg(F.max_by("district", "pos").alias("district"), F.min("pos").alias("pos"))
    score = F.when(F.col("district") == F.col("alias"), F.lit(OWN_NAME)).otherwise(F.lit(ALIAS))
    return kept.select("alias", "district", F.lit("dictionary").alias("category"), score.alias("confidence"), F.lit("dictionary").alias("source"), "pos")


def contained(texts: DataFrame, aliases: DataFrame, id_col: str, text_col: str, stop: Sequence[str] = tuple(rules.CITY_NAMES)) -> DataFrame:
    """(id, alias): every alias that occurs in a text, once, overlaps included.

    The distinct aliases make a multi-pattern automaton that each worker runs over its texts: linear in the text, whatever the
    number of aliases, and texts are not moved. An automaton holds about ``ALIASES_AT_ONCE`` aliases; more take one pass for each lot.
    """
    names = aliases.select("alias").distinct().filter((F.col("alias") != "") & ~F.col("alias").isin(*stop))
    slim = spread(texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    kind = dict(slim.dtypes)["id"]
    out = None
    for lot in word_parts(names, ALIASES_AT_ONCE):
        shared = texts.sparkSession.sparkContext.broadcast([r.alias for r in lot])  # bounded by ALIASES_AT_ONCE

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for name in shared.value:
                automaton.add_word(name, name)
            if len(automaton):
                automaton.make_automaton()
            for batch in batches:
                rows, found = [], []
                for k, text in enumerate(batch.column(1).to_pylist() if len(automaton) else []):
                    hits = {name for _, name in automaton.iter(text)} if text else ()
                    rows += [k] * len(hits)
                    found += sorted(hits)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(found, pa.string())], names=["id", "alias"])

        part = slim.mapInArrow(run, f"id {kind}, alias string")
        out = part if out is None else out.unionByName(part)
    return out


def location_hits(texts: DataFrame, aliases: DataFrame, id_col: str = "id", text_col: str = "text", names: Sequence[str] = tuple(rules.DISTRICTS)) -> DataFrame:
    """(id, pos, district, matched_text, source, confidence, category): direct mentions in text order, then alias hits, longest
    alias first (ties by dictionary position)."""
    plain = texts.select(F.col(id_col).alias("id"), no_space(F.col(text_col)).alias("text"))
    pattern = "|".join(names) if names else "(?!)"
    direct = plain.select("id", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("pos", "district"))
    direct = direct.select("id", F.struct(F.lit(0).alias("kind"), F.lit(0).alias("shorter"), F.col("pos").cast("bigint").alias("at")).alias("pos"), "district", F.col("district").alias("matched_text"), F.lit("direct_district").alias("source"), F.lit(DIRECT).alias("confidence"), F.lit("district").alias("category"))
    order = F.struct(F.lit(1).alias("kind"), (-F.char_length("alias")).alias("shorter"), F.col("pos").cast("bigint").alias("at"))
    by_alias = contained(plain, aliases, "id", "text").join(aliases, "alias").select("id", order.alias("pos"), "district", F.col("alias").alias("matched_text"), "source", "confidence", "category")
    return direct.unionByName(by_alias)


def pick_district(hits: DataFrame) -> DataFrame:
    """(id, district, confidence, method): the district of the largest summed confidence, a tie to the one hit first.

    Sums are of ten-thousandths, so they do not depend on order. The divisor is the hits of all districts. The method is the
    district's first source, replaced by every later hit above 0.9.
    """
    sure = F.col("confidence") > 0.9
    per = hits.groupBy("id", "district").agg(
        F.sum(F.round(F.col("confidence") * 10_000).cast("bigint")).alias("score"), F.min("pos").alias("first"), F.count("*").alias("n"),
        F.coalesce(F.max_by(F.when(sure, F.col("source")), F.when(sure, F.col("pos"))), F.min_by("source", "pos")).alias("method"),
    )
    best = F.min_by(F.struct("district", "score", "method"), F.struct((-F.col("score")).alias("s"), "first"))
    out = per.groupBy("id").agg(best.alias("b"), F.sum("n").alias("hits"))
    return out.select("id", "b.district", F.round(F.least(F.col("b.score") / 10_000 / F.col("hits"), F.lit(0.99)), 3).alias("confidence"), "b.method")


def resolve(
    texts: DataFrame, aliases: DataFrame, id_col: str = "id", text_col: str = "text", names: Sequence[str] = tuple(rules.DISTRICTS), words: DataFrame | None = None, geocode: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """One row per text: id, district, confidence, method, places, address_snippets, districts, categories; a text without a
    hit has no district, confidence 0 and method ``none``.

    ``words`` (a lexicon of ``operators.segment``) adds the places that are words of a text's best segmentation. ``geocode`` gets the rows of
    ``texts`` that have no hit at all and gives hits of its own (as ``operators.nearby.geocoded`` does).
    """
    hits = location_hits(texts, aliases, id_col, text_col, names)
    if words is not None:
        hits = hits.unionByName(segmented_places(texts, aliases, words, id_col, text_col, tuple(rules.CITY_NAMES)))
    if geocode is not None:
        hits = store(hits, "hits")
        without = texts.join(hits.select(F.col("id").alias("_hit")).distinct(), F.col(id_col) == F.col("_hit"), "left_anti")
        hits = hits.unionByName(geocode(without))
    place = F.struct("pos", "district", "matched_text", "source", "confidence", "category")
    lists = hits.groupBy("id").agg(F.array_sort(F.collect_list(place)).alias("p"))  # bounded by the aliases that a text holds
    lists = lists.select("id", F.transform("p", lambda x: x.dropFields("pos")).alias("places"))
    found = pick_district(hits).join(lists, "id")
    base = texts.select(F.col(id_col).alias("id"), distinct_matches(no_space(F.col(text_col)), rules.ADDRESS_SNIPPET).alias("address_snippets"))
    sets = lambda c: F.array_sort(F.array_distinct(F.transform("places", lambda x: x[c])))
    out = base.join(found, "id", "left").withColumns({"districts": sets("district"), "categories": sets("category")})
    none = F.array().cast("array<string>")
    return out.select("id", "district", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("method", F.lit("none")).alias("method"), "places", "address_snippets", F.coalesce("districts", none).alias("districts"), F.coalesce("categories", none).alias("categories"))


def longest_first(aliases: DataFrame) -> DataFrame:
    """Aliases with their place in longest-first order (ties by position)."""
    return aliases.withColumn("ord", F.row_number().over(Window.orderBy(F.desc(F.char_length("alias")), "pos")))
