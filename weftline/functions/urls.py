"""URL and paging functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline import rules
from weftline.functions.text import let


def without_parameter(url: Column, name: str = "key") -> Column:
    """The URL without a query parameter (name in any case), other parameters as they are."""
    dropped = F.regexp_replace(url, f"(?i)([?&]){name}=[^&#]*", "$1")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(dropped, "&{2,}", "&"), r"\?&", "?"), "[?&](?=#|$)", "")


def query_parameter(url: Column, name: str) -> Column:
    """A decoded query parameter, null if absent or not decodable."""
    return F.try_url_decode(F.nullif(F.regexp_extract(url, f"[?&]{name}=([^&#]*)", 1), F.lit("")))


def asked(url: Column, districts: list[str] | tuple[str, ...] = tuple(rules.DISTRICTS)) -> Column:
    """struct(district, keyword, page) that a paged search URL asked for; district and keyword empty if no district leads."""
    page = F.coalesce(query_parameter(url, "page"), F.lit("1")).try_cast("int")

    def split(words: Column) -> Column:
        cut = lambda d: F.struct(F.lit(d).alias("district"), F.substring(words, len(d) + 1, 1_000_000).alias("keyword"), page.alias("page"))
        none = F.struct(F.lit("").alias("district"), F.lit("").alias("keyword"), page.alias("page"))
        return F.coalesce(*[F.when(words.startswith(d), cut(d)) for d in districts], none)

    return let(F.coalesce(query_parameter(url, "keywords"), F.lit("")), split)


def document_id(url: Column) -> Column:
    return F.substring(F.md5(url.cast("binary")), 1, 12)


def source_label(url: Column, table: list[tuple[str, str]] | tuple = tuple(rules.PORTAL_LABELS), default: str = rules.PORTAL_DEFAULT) -> Column:
    return F.coalesce(*[F.when(url.contains(part), F.lit(label)) for part, label in table], F.lit(default))


def total_pages(count: Column, page: Column, per_page: int = 20, most: int = 50) -> Column:
    """Pages of a search of ``count`` rows; the page itself where the count is zero; never more than ``most``."""
    n = F.ceil(F.coalesce(count, F.lit(0)) / per_page)
    return F.least(F.when(n > 0, n).otherwise(page), F.lit(most)).cast("int")


def remaining_pages(total: Column, crawled: Column) -> Column:
    return F.when(total.isNotNull(), F.greatest(total - F.size(F.array_distinct(crawled)), F.lit(0)))


def next_page(total: Column, crawled: Column) -> Column:
    """The smallest page that is missing; with an unknown total page 1, then 2; null when complete."""
    known = F.when(total >= 1, F.array_min(F.array_except(F.sequence(F.lit(1), F.greatest(total, F.lit(1))), crawled)))
    return F.when(total.isNull(), F.when(F.array_contains(crawled, 1), F.lit(2)).otherwise(F.lit(1))).otherwise(known)
