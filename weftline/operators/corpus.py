"""Corpus ETL: defaults, pages to documents, link harvest, template expansion, reports."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline import rules
from weftline.functions import html as H
from weftline.functions.places import district_by_position
from weftline.functions.urls import document_id, source_label
from weftline.operators.dedup import first_wins, top_per_group
from weftline.sources.workspace import spread


def normalised(docs: DataFrame) -> DataFrame:
    """Corpus documents with every field of the shape; missing and null fields get their default. Other columns stay."""
    have = set(docs.columns)
    filled = {c: F.coalesce(F.col(c).cast("string"), F.lit(v)) if c in have else F.lit(v) for c, v in rules.CORPUS_DEFAULTS.items()}
    empty = F.array().cast("array<string>")
    filled |= {c: F.coalesce(F.col(c).cast("array<string>"), empty) if c in have else empty for c in ("tags", "applicable_tags")}
    return docs.withColumns(filled)


def imported(rows: DataFrame, pos: str = "pos") -> DataFrame:
    """Rows to import: a missing id becomes ``doc-`` and the five-digit position from 1, a missing source the import's name."""
    have = set(rows.columns)
    col = lambda c: F.nullif(F.col(c).cast("string"), F.lit("")) if c in have else F.lit(None).cast("string")
    numbered = rows.withColumns({"id": F.coalesce(col("id"), F.format_string("doc-%05d", F.col(pos))), "source": F.coalesce(col("source"), F.lit(rules.IMPORT_SOURCE))})
    return normalised(numbered)


def page_documents(pages: DataFrame, crawl_time: datetime, url: str = "url", html: str = "html", least: int = 100) -> DataFrame:
    """Documents of pages by the HTML parser: id, title[:200], doc_type, district, source, source_url, crawl_time, tags,
    content[:5000]; pages of under ``least`` characters of content are dropped."""
    slim = spread(pages.select(F.col(url).alias("source_url"), F.coalesce(html, F.lit("")).alias("html")))
    parts = slim.select("source_url", H.parse_page("html").alias("p"))
    rows = parts.select("source_url", F.coalesce("p.title", F.lit("未知标题")).alias("title"), F.col("p.content").alias("content")).filter(F.char_length("content") >= least)
    return rows.select(
        document_id(F.col("source_url")).alias("id"), F.substring("title", 1, 200).alias("title"), F.lit("政策").alias("doc_type"), district_by_position(F.col("title"), F.col("content")).alias("district"),
        source_label(F.col("source_url")).alias("source"), "source_url", F.lit(crawl_time).alias("crawl_time"), F.array().cast("array<string>").alias("tags"), F.substring("content", 1, 5000).alias("content"),
    )


def harvest(pages: DataFrame, base: str, part: str, per_page: int, suffixes: Sequence[str] = (".htm", ".html"), least: int = 30, seen: DataFrame | None = None, url: str = "url", html: str = "html", ties: Sequence[str] = ()) -> DataFrame:
    """(url, rank, link): the first ``per_page`` links of each page that contain ``part``, end in one of ``suffixes`` (any if
    empty), are at least ``least`` long, are no office files and have not been seen. Relative links start at ``base``. Links at one place of pages
    of one URL come by the columns ``ties`` of the pages, then by themselves, so that any run gives the same."""
    link = F.when(F.col("href").rlike("^[a-zA-Z]+:"), F.col("href")).otherwise(F.concat(F.lit(base.rstrip("/")), F.when(F.col("href").startswith("/"), F.col("href")).otherwise(F.concat(F.lit("/"), "href"))))
    rows = pages.select(F.col(url).alias("url"), *[F.col(c).alias(f"_tie{k}") for k, c in enumerate(ties)], F.posexplode(H.hrefs(F.col(html))).alias("pos", "href")).withColumn("link", link)
    office = F.lit(False)
    for s in rules.FILE_SUFFIXES:
        office = office | F.col("link").contains(s)
    ends = F.lit(not suffixes)
    for s in suffixes:
        ends = ends | F.col("link").endswith(s)
    rows = rows.filter(~office & (F.char_length("link") >= least) & F.col("link").contains(part) & ends)
    if seen is not None:
        rows = rows.join(seen.select(F.col("url").alias("link")).distinct(), "link", "left_anti")
    return top_per_group(rows, ["url"], [F.col("pos"), *[F.col(f"_tie{k}") for k in range(len(ties))], F.col("link")], per_page).select("url", "rank", "link")


def unseen_pages(pages: DataFrame, pos: str = "pos", url: str = "url") -> DataFrame:
    """The first page of each URL."""
    return first_wins(pages, [url], pos)


def expand_templates(districts: DataFrame, templates: DataFrame, prefix: str, start: int, doc_type: str, source_suffix: str) -> DataFrame:
    """Every template for every district, numbered on from ``start`` in (district, template) order.

    ``districts``: ord, district; ``templates``: t_ord, title_template (with {}), tags, content. Both are short lists by nature.
    """
    pairs = districts.join(F.broadcast(templates), F.lit(True), "inner")
    k = F.row_number().over(Window.orderBy("ord", "t_ord")) - 1 + start
    return pairs.select(
        F.format_string(f"{prefix}-%03d", k).alias("id"), F.replace("title_template", F.lit("{}"), F.col("district")).alias("title"), F.lit(doc_type).alias("doc_type"), "district",
        F.concat("district", F.lit(source_suffix)).alias("source"), "tags", "content",
    )


def document_counts(docs: DataFrame, by: str) -> DataFrame:
    return docs.groupBy(by).agg(F.count("*").alias("documents"))


def type_counts(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count_if(F.col("doc_type") == "政策").alias("policies"), F.count_if(F.col("doc_type") == "案例").alias("cases"), F.count("*").alias("total"))
