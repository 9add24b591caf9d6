"""Readers of landed files, and the registry of named sources."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline import rules, schemas
from weftline.sources.workbook import read_workbook, sheet_names


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped, a broken line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def lenient_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines without broken ones; a missing path is an empty table."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def alias_dictionary(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(ord, district, aliases) of JSON objects district -> aliases, in load order; missing files are skipped."""
    parts = []
    for k, path in enumerate(p for p in paths if exists(spark, p)):
        text = spark.read.option("wholetext", True).text(path)
        rows = text.select(F.posexplode(F.map_entries(F.from_json(F.regexp_replace("value", "^\\ufeff", ""), schemas.ALIAS_DICTIONARY))).alias("k", "e"))
        parts.append(rows.select((F.lit(k * 100_000) + F.col("k")).alias("ord"), F.col("e.key").alias("district"), F.col("e.value").alias("aliases")))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "ord int, district string, aliases array<string>")


def dictionary_paths(spark: SparkSession, base: str, merged: str, curated: str, extra: str) -> list[str]:
    """The base dictionary and the first of merged, curated and extra that exists (extra by default)."""
    return [base, next((p for p in (merged, curated) if exists(spark, p)), extra)]


def alias_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Catalog rows with an alias; several rows of one alias stay several."""
    return lenient_json_lines(spark, path, schemas.ALIAS_CATALOG).filter(F.coalesce("alias", F.lit("")) != "")


def corpus(spark: SparkSession, path: str, sample: str | None = None) -> DataFrame:
    """Corpus documents with defaults; the sample file stands in for a missing corpus, an empty table for both."""
    from weftline.operators.corpus import normalised

    chosen = path if exists(spark, path) or not sample else sample
    if not exists(spark, chosen):
        return normalised(spark.createDataFrame([], schemas.CORPUS_DOC))
    return normalised(json_lines(spark, chosen, schemas.CORPUS_DOC))


def first_sheet(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of a workbook, all columns as strings."""
    return read_workbook(spark, path, sheet=sheet_names(path)[0])


def training_table(spark: SparkSession, path: str, required: Sequence[str] = tuple(rules.TRAINING_COLUMNS)) -> DataFrame:
    """A CSV with header (quoted line ends allowed), or the first sheet of a workbook."""
    if path.endswith(".xlsx"):
        df = first_sheet(spark, path)
    else:
        df = spark.read.options(header=True, multiLine=True, escape='"').csv(path)
    return schemas.require_columns(df, list(required))


def pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def jdbc_table(spark: SparkSession, url: str, table: str, partition_column: str | None = None, bounds: tuple[int, int] = (0, 0), parts: int = 1) -> DataFrame:
    """A database table, read in ranges of a numeric column where one is given."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if partition_column:
        reader = reader.options(partitionColumn=partition_column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    return reader.load()


_ANSWER = "pos bigint, asked_district string, keyword string, page int, url string, payload string"
_POIS = "count string, pois array<struct<id:string,name:string,type:string,adname:string,address:string,pname:string,location:string,adcode:string>>"
_REGEO = "addressComponent struct<district:string,township:string>, roads array<struct<name:string>>, pois array<struct<id:string,name:string,type:string,address:string,location:string>>"


def landed_answers(spark: SparkSession, path: str) -> DataFrame:
    """Raw service answers as they were landed: what was asked, and the payload text."""
    return json_lines(spark, path, _ANSWER)


def search_pois(answers: DataFrame) -> DataFrame:
    """(asked_district, keyword, page, url, answer_count, name, adname, address, location, adcode) of paged searches. A list where
    a text is due (an empty field of the service) reads as its JSON and is made empty."""
    plain = lambda c: F.when(F.col(c).startswith("["), F.lit("")).otherwise(F.coalesce(c, F.lit(""))).alias(c)
    rows = answers.withColumn("p", F.from_json("payload", _POIS)).select("asked_district", "keyword", "page", "url", F.coalesce(F.col("p.count").try_cast("int"), F.lit(0)).alias("answer_count"), F.explode("p.pois").alias("poi"))
    return rows.select("asked_district", "keyword", "page", "url", "answer_count", "poi.*").select("asked_district", "keyword", "page", "url", "answer_count", *[plain(c) for c in ("id", "name", "type", "adname", "address", "location", "adcode")])


def reverse_geocodes(answers: DataFrame) -> DataFrame:
    """(pos, district, township, roads, pois) of landed reverse-geocode answers."""
    field = lambda k: F.get_json_object("payload", f"$.regeocode.addressComponent.{k}")
    text = lambda k: F.when(field(k).startswith("["), F.lit("")).otherwise(F.coalesce(field(k), F.lit("")))
    geo = F.from_json(F.get_json_object("payload", "$.regeocode"), _REGEO)
    return answers.select("pos", text("district").alias("district"), text("township").alias("township"), F.transform(F.coalesce(geo["roads"], F.array()), lambda r: r["name"]).alias("roads"), geo["pois"].alias("pois"))


def listing_names(pages: DataFrame, css_class: str, html: str = "html", url: str = "url") -> DataFrame:
    """(url, name): texts of the elements of a class on listing pages, by the HTML parser."""
    @F.pandas_udf("array<string>")
    def names(texts: pd.Series) -> pd.Series:
        from weftline.functions.html import _clean, _Tree

        def one(text: str | None) -> list[str]:
            tree = _Tree()
            tree.feed(text or "")
            tree.close()
            return [t for n in tree.root.walk() if css_class in n.attrs.get("class", "").split() and (t := _clean(n.text()))]

        return texts.map(one)

    return pages.select(url, F.explode(names(F.coalesce(html, F.lit("")))).alias("name"))


Reader = Callable[[SparkSession, str], DataFrame]
#: Sources by name; those of a paid service need its key.
OPEN_SOURCES: dict[str, Reader] = {"pages": pages, "alias_catalog": alias_catalog, "corpus": corpus}
KEYED_SOURCES: dict[str, Reader] = {"search": lambda s, p: search_pois(landed_answers(s, p)), "reverse_geocode": lambda s, p: reverse_geocodes(landed_answers(s, p))}


def build_sources(names: Sequence[str], key: str = "") -> list[Reader]:
    """Readers of the named sources in order; unknown names, and keyed sources without a key, are left out."""
    known = OPEN_SOURCES | (KEYED_SOURCES if key else {})
    return [known[n] for n in names if n in known]


SAMPLE_CORPUS = [
    {"id": "sample-1", "title": "Night noise on building sites", "doc_type": "政策", "district": "全市", "content": "Work that makes noise stops between ten and six; the site lead answers within a day.", "tags": ["noise"]},
    {"id": "sample-2", "title": "Blocked fire lane cleared", "doc_type": "案例", "district": "朝阳区", "content": "The property manager removed parked bicycles from the fire lane and marked it.", "tags": ["fire"]},
]


def sample_corpus(spark: SparkSession) -> DataFrame:
    from weftline.operators.corpus import normalised

    return normalised(spark.createDataFrame(SAMPLE_CORPUS, "id string, title string, doc_type string, district string, content string, tags array<string>"))
