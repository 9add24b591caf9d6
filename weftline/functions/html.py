"""Pages to text and links, by the standard library's parser in an Arrow-batched UDF."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.text import one_space, unescape_html
from weftline.functions.urls import document_id, source_label

_VOID = set("area base br col embed hr img input link meta source track wbr".split())
_SKIPPED = {"script", "style", "nav", "footer", "header"}
_TITLE, _CONTENT, _CONTENT_ID = re.compile("title|Title|TITLE"), re.compile("content|Content|article|Article|TRS"), re.compile("content|Content")
_BLANKS = re.compile(r"\s+")


class _Node:
    __slots__ = ("tag", "attrs", "parts")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.parts = tag, attrs, []

    def walk(self):
        yield self
        for p in self.parts:
            if isinstance(p, _Node):
                yield from p.walk()

    def text(self, skipped: frozenset | set = frozenset({"script", "style"})) -> str:
        if self.tag in skipped:
            return ""
        return "".join(p if isinstance(p, str) else p.text(skipped) for p in self.parts)


class _Tree(HTMLParser):
    """A tolerant tree: an end tag closes the nearest open element of its name, and is ignored if there is none."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = _Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = _Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].parts.append(node)
        if tag not in _VOID and len(self.open) < 400:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.open[-1].parts.append(_Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].parts.append(data)


def _clean(text: str) -> str:
    return _BLANKS.sub(" ", text).strip()


def page_parts(html: str | None) -> tuple[str | None, str]:
    """(title, content): the first h1, title or element of a title class; the first content div, article, content id or the body."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    nodes = list(tree.root.walk())
    first = lambda test: next((n for n in nodes if test(n)), None)
    title = first(lambda n: n.tag == "h1") or first(lambda n: n.tag == "title") or first(lambda n: _TITLE.search(n.attrs.get("class", "")))
    content = (
        first(lambda n: n.tag == "div" and _CONTENT.search(n.attrs.get("class", "")))
        or first(lambda n: n.tag == "article")
        or first(lambda n: _CONTENT_ID.search(n.attrs.get("id", "")))
        or first(lambda n: n.tag == "body")
    )
    return (_clean(title.text()) if title else None), (_clean(content.text(_SKIPPED)) if content else "")


@F.pandas_udf(T.StructType([T.StructField("title", T.StringType()), T.StructField("content", T.StringType())]))
def parse_page(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([page_parts(h) for h in html], columns=["title", "content"])


def tag_texts(html: Column, tag: str) -> Column:
    """Texts of all elements of a tag that hold no other element, tidied: the part of a page that SQL can express too."""
    return F.transform(F.regexp_extract_all(html, F.lit(f"<{tag}[^>]*>([^<]*)</{tag}>"), F.lit(1)), one_space)


def plain_heading(html: Column, tag: str = "h1") -> Column:
    """The text of the first element of a tag that holds no other element, '' where there is none: blanks of HTML as one, spaces cut at the ends, and only
    the references that ``escape_html`` writes read. Unlike ``parse_page`` it has no other place to take a title from."""
    found = F.regexp_extract(html, f"<{tag}[^>]*>([^<]*)</{tag}>", 1)
    return unescape_html(F.regexp_replace(F.regexp_replace(found, r"[\t\n\f\r ]+", " "), r"^\p{Zs}+|\p{Zs}+\z", ""))


def hrefs(html: Column) -> Column:
    """All quoted link targets, in order."""
    return F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))


__all__ = ["document_id", "hrefs", "page_parts", "parse_page", "plain_heading", "source_label", "tag_texts"]
