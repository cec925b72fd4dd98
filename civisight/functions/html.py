"""Page metadata out of HTML, and JSON out of noisy replies.

Tags are found with expressions in the JVM. Three short Arrow helpers remain in Python: decoding of
character references, on fields only, the walk over JSON-LD blocks, and the lines of a page's body.
"""
from __future__ import annotations

import html
import json
from collections.abc import Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civisight.functions.dates import parse_timestamp
from civisight.functions.text import ColumnOrName, as_col, clean_text

@F.pandas_udf(T.StringType())
def unescape(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


def decoded(c: ColumnOrName) -> Column:
    """Text without character references; only fields that hold one are decoded."""
    col = as_col(c)
    return F.when(col.contains("&"), unescape(F.when(col.contains("&"), col))).otherwise(col)


_DATES = ("datePublished", "dateCreated", "dateModified", "uploadDate")
_LISTS = T.StructType([T.StructField(n, T.ArrayType(T.StringType())) for n in ("headline", "description", "publisher", "author", *_DATES)])


def _listed(value: object) -> list:
    return value if isinstance(value, list) else [value]


def _sound(text: str) -> str:
    """Text without lone halves of surrogate pairs, which cut descriptions end in and no encoding takes."""
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _walk(block: object, out: dict[str, list[str]]) -> None:
    """Strings of the fields, an object's own before those of the objects inside it, at any depth."""
    left = [block]
    while left:
        node = left.pop()
        if isinstance(node, dict):
            found = {key: [node.get(key)] for key in ("headline", "description", *_DATES)}
            found["publisher"] = [x.get("name") for x in _listed(node.get("publisher")) if isinstance(x, dict)]
            found["author"] = []
            for x in _listed(node.get("author")):
                if isinstance(x, dict):
                    name = x.get("name")
                    x = x.get("alternateName") if name is None or isinstance(name, str) and not name.strip() else name
                found["author"].append(x)
            for key, values in found.items():
                out[key] += [_sound(x) for x in values if isinstance(x, str)]
            left += reversed(node.values())
        elif isinstance(node, list):
            left += reversed(node)


@F.pandas_udf(_LISTS)
def _jsonld_lists(blocks: pd.Series) -> pd.DataFrame:
    rows = []
    for texts in blocks:
        out = {f.name: [] for f in _LISTS}
        for text in texts if texts is not None else []:
            _walk(json.loads(text, strict=False, parse_int=float), out)
        rows.append(out)
    return pd.DataFrame(rows, columns=_LISTS.names)


def jsonld_fields(blocks: Column) -> Column:
    """struct(title, description, site_name, published_at, author_names) out of JSON-LD blocks.

    Blocks that do not parse are skipped. Fields are the first value, an object's own before those inside it; the date
    is the first that can be read, published before created before modified before uploaded.
    """
    lists = _jsonld_lists(F.filter(blocks, lambda b: F.try_parse_json(b).isNotNull()))
    clean = lambda key: F.filter(F.transform(lists[key], lambda x: clean_text(x)), lambda x: x.isNotNull())
    first = lambda values: F.try_element_at(values, F.lit(1))
    dates = F.concat(*[clean(k) for k in _DATES])
    return F.struct(
        first(clean("headline")).alias("title"), first(clean("description")).alias("description"), first(clean("publisher")).alias("site_name"),
        F.coalesce(first(F.filter(dates, lambda d: parse_timestamp(d).isNotNull())), first(dates)).alias("published_at"),
        F.when(blocks.isNotNull(), clean("author")).alias("author_names"))


def jsonld_blocks(c: ColumnOrName) -> Column:
    return F.regexp_extract_all(
        as_col(c), F.lit(r"(?is)<script[^>]*type\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), F.lit(1)
    )


def without_code(c: ColumnOrName) -> Column:
    """HTML without comments, scripts, styles, noscript and svg blocks."""
    out = F.regexp_replace(as_col(c), r"(?s)<!--.*?-->", "")
    return F.regexp_replace(out, r"(?is)<(script|style|noscript|svg)\b[^>]*>.*?</\1\s*>", "")


# the functions below expect HTML that went through ``without_code`` once

def page_text(c: ColumnOrName) -> Column:
    """Whole visible text with collapsed spaces (entities still encoded)."""
    return clean_text(F.regexp_replace(as_col(c), r"(?s)<[^>]*>", " "))


def first_tag_text(c: ColumnOrName, tag: str, css_class: str | None = None) -> Column:
    """Text of the first element of a tag, optionally only of one with a class."""
    mark = rf"[^>]*class\s*=\s*[\"'][^\"']*\b{css_class}\b[^>]*" if css_class else r"\b[^>]*"
    inner = F.regexp_extract(as_col(c), rf"(?is)<{tag}{mark}>(.*?)</{tag}\s*>", 1)
    return clean_text(F.regexp_replace(inner, r"(?s)<[^>]*>", " "))


def attribute(tag: ColumnOrName, name: str) -> Column:
    pattern = rf"(?is)\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    return F.concat(*[F.regexp_extract(as_col(tag), pattern, i) for i in (1, 2, 3)])


def tags(c: ColumnOrName, tag: str) -> Column:
    return F.regexp_extract_all(as_col(c), F.lit(rf"(?is)<{tag}\b[^>]*>"), F.lit(0))


def attr_values(tag_array: Column, where: tuple[str, str] | None, attr: str) -> Column:
    """Values of ``attr`` over tags, optionally only where another attribute has a value."""
    chosen = tag_array if where is None else F.filter(tag_array, lambda t: F.lower(attribute(t, where[0])) == where[1].lower())
    return F.filter(F.transform(chosen, lambda t: clean_text(attribute(t, attr))), lambda v: v.isNotNull())


def first_attr(tag_array: Column, rules: list[tuple[tuple[str, str] | None, str]]) -> Column:
    return F.coalesce(*[F.try_element_at(attr_values(tag_array, where, attr), F.lit(1)) for where, attr in rules])


def links(c: ColumnOrName) -> Column:
    """Array of struct(href, text) of all anchors, in page order."""
    anchors = F.regexp_extract_all(as_col(c), F.lit(r"(?is)<a\b[^>]*>.*?</a\s*>"), F.lit(0))
    return F.filter(
        F.transform(anchors, lambda a: F.struct(
            F.trim(attribute(F.regexp_extract(a, r"(?is)^<a\b[^>]*>", 0), "href")).alias("href"),
            F.coalesce(clean_text(F.regexp_replace(a, r"(?s)<[^>]*>", " ")), F.lit("")).alias("text"),
        )),
        lambda x: x["href"] != "",
    )


_BLOCKS = {"p", "li", "blockquote", "h2", "h3"}
_SKIPPED = {"script", "style", "noscript", "iframe", "form", "button", "header", "footer", "nav", "aside", "figure", "figcaption"}
_VOID = {"br", "img", "hr", "input", "meta", "link", "source", "wbr"}


class _Body(HTMLParser):
    """Text blocks inside the first element that matches an id or a tag name."""

    def __init__(self, want_id: str | None, want_tag: str | None):
        super().__init__(convert_charrefs=True)
        self.want_id, self.want_tag = want_id, want_tag
        self.open: list[str] = []       # elements inside the container, the container first
        self.skip = 0                   # depth of skipped elements
        self.done = False
        self.blocks: list[list[str]] = []
        self.active: list[tuple[int, list[str]]] = []
        self.everything: list[str] = []

    def handle_starttag(self, tag, attrs):
        if self.done or tag in _VOID:
            return
        if not self.open:
            hit = dict(attrs).get("id") == self.want_id if self.want_id else tag == self.want_tag
            if hit:
                self.open.append(tag)
            return
        self.open.append(tag)
        if tag in _SKIPPED:
            self.skip += 1
        elif tag in _BLOCKS and not self.skip:
            self.blocks.append([])
            self.active.append((len(self.open), self.blocks[-1]))

    def handle_endtag(self, tag):
        if self.done or tag not in self.open:
            return
        while self.open:
            last = self.open.pop()
            if last in _SKIPPED:
                self.skip = max(0, self.skip - 1)
            while self.active and self.active[-1][0] > len(self.open):
                self.active.pop()
            if last == tag:
                break
        self.done = not self.open

    def handle_data(self, data):
        if self.open and not self.done and not self.skip:
            self.everything.append(data)
            for _, block in self.active:
                block.append(data)


def _lines(page: str, containers: Sequence[tuple[str | None, str | None]], min_chars: int) -> list[str]:
    best: list[str] = []
    for want_id, want_tag in containers:
        body = _Body(want_id, want_tag)
        body.feed(page)
        lines = [line for line in (" ".join(" ".join(b).split()) for b in body.blocks) if line]
        if not lines:
            lines = [line for line in [" ".join(" ".join(body.everything).split())] if line]
        if sum(map(len, lines)) >= min_chars:
            return lines
        best = max(best, lines, key=lambda x: sum(map(len, x)))
    return best


# Containers of the body, in order of preference.
BODY_CONTAINERS = (("parent-fieldname-text", None), ("content-core", None), (None, "article"), (None, "main"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def body_lines(pages: pd.Series) -> pd.Series:
    """Paragraphs, list items, quotes and sub-headings of the main container of a page: the first
    with 160 characters, else the one with most text."""
    return pages.map(lambda page: _lines(page or "", BODY_CONTAINERS, 160))


def repair_json(c: ColumnOrName, schema: str) -> Column:
    """struct(value, ok): the whole reply as JSON, else its outermost ``{...}``."""
    text = F.trim(as_col(c))
    inner = F.regexp_extract(text, r"(?s)\{.*\}", 0)

    def valid(t: Column) -> Column:
        # a top-level object that the strict parser takes
        return t.startswith("{") & F.try_parse_json(t).isNotNull()

    chosen = F.when(valid(text), text).when(valid(inner), inner)
    return F.struct(F.from_json(chosen, schema).alias("value"), chosen.isNotNull().alias("ok"))
