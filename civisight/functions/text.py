"""Text expressions. Everything returns a ``Column`` and stays in the JVM, except
``fold_exact`` which is an Arrow UDF for full-Unicode input."""
from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ColumnOrName = Column | str


def as_col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- cleaning

def clean_text(c: ColumnOrName, markers: Sequence[str] = ()) -> Column:
    """Drop BOMs, collapse whitespace, trim; empty text and null markers become null."""
    out = F.trim(F.regexp_replace(F.regexp_replace(as_col(c), "﻿", ""), r"(?U)\s+", " "))
    absent = out == ""
    if markers:
        absent = absent | F.lower(out).isin([m.lower() for m in markers])
    return F.when(~absent, out)


def has_text(c: ColumnOrName) -> Column:
    """Whether ``clean_text`` leaves anything, found at the first character that stays."""
    return as_col(c).rlike(r"(?U)[^\s\x{FEFF}]")


def first_present(*cols: ColumnOrName, default: str | None = None) -> Column:
    """First non-empty value of several columns, else the default."""
    parts = [clean_text(c) for c in cols]
    if default is not None:
        parts.append(F.lit(default))
    return F.coalesce(*parts)


def strip_tags(c: ColumnOrName) -> Column:
    """Remove markup and the few entities that occur in listings."""
    out = F.regexp_replace(as_col(c), r"<[^>]+>", "")
    for entity, plain in (("&nbsp;", " "), ("&aacute;", "á"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(plain))
    return clean_text(out)


# ----------------------------------------------------------------- folding

@lru_cache(maxsize=1)
def _fold_pairs() -> tuple[str, str]:
    """(from, to) strings for ``translate``: accented lower-case letters to their
    base letter, then the combining marks, which translate to nothing."""
    src, dst = [], []
    for code in [*range(0x00A0, 0x0250), *range(0x1E00, 0x1F00)]:
        ch = chr(code)
        base = "".join(x for x in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(x))
        if len(base) == 1 and base != ch:
            src.append(ch)
            dst.append(base)
    marks = "".join(chr(code) for code in range(0x0300, 0x0370))
    return "".join(src) + marks, "".join(dst)


def strip_accents(c: ColumnOrName) -> Column:
    src, dst = _fold_pairs()
    # plain ASCII has as many bytes as characters and nothing to strip
    return F.when(F.octet_length(as_col(c)) == F.char_length(as_col(c)), as_col(c)).otherwise(F.translate(as_col(c), src, dst))


def fold(c: ColumnOrName, ascii_only: bool = False) -> Column:
    """Lower-case, accent-free text with collapsed spaces (empty stays empty).

    ``ascii_only`` additionally drops every character outside ASCII.
    """
    out = F.lower(strip_accents(F.regexp_replace(F.coalesce(as_col(c), F.lit("")), "﻿", " ")))
    if ascii_only:
        out = F.regexp_replace(out, r"[^\x00-\x7F]", "")
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


@F.pandas_udf(T.StringType())
def fold_exact(s: pd.Series) -> pd.Series:
    """``fold`` for any script, through the Unicode tables."""
    flat = s.fillna("").str.replace("﻿", " ").str.normalize("NFKD").str.lower()
    flat = flat.map(lambda x: "".join(ch for ch in x if not unicodedata.combining(ch)))
    return flat.str.replace(r"\s+", " ", regex=True).str.strip()


def fold_text(value: str | None) -> str:
    """Driver-side twin of ``fold`` for rule words."""
    flat = unicodedata.normalize("NFKD", (value or "").replace("﻿", " "))
    flat = "".join(ch for ch in flat if not unicodedata.combining(ch)).lower()
    return re.sub(r"\s+", " ", flat).strip()


def match_key(value: str | None) -> str:
    """Driver-side twin of ``match_text``."""
    return re.sub(r"[^a-z0-9]+", " ", fold_text(value)).strip()


def _plain(c: ColumnOrName) -> Column:
    """Lower-case without accents, spaces as they are."""
    return F.lower(strip_accents(F.coalesce(as_col(c), F.lit(""))))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a costly value to a name, so that a body that uses it often computes it once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def upper_key(c: ColumnOrName) -> Column:
    return F.trim(F.regexp_replace(F.upper(_plain(c)), "[^A-Z0-9]+", " "))


def match_text(c: ColumnOrName) -> Column:
    """Folded text where every run of non-alphanumerics is one space."""
    return F.trim(F.regexp_replace(_plain(c), "[^a-z0-9]+", " "))


def match_tokens(c: ColumnOrName) -> Column:
    """Tokens of ``match_text`` (an empty text has no tokens)."""
    return F.array_remove(F.split(match_text(c), " "), "")


def compact_key(c: ColumnOrName) -> Column:
    return F.regexp_replace(_plain(c), "[^a-z0-9]+", "")


def slug(c: ColumnOrName, default: str = "item") -> Column:
    out = F.replace(match_text(c), F.lit(" "), F.lit("-"))
    return F.when(out != "", out).otherwise(F.lit(default))


def snake(name: str) -> str:
    """Header name to a snake-case key (driver-side, metadata only)."""
    return re.sub(r"[^a-z0-9]+", "_", fold_text(name)).strip("_")


# ----------------------------------------------------------------- shaping

def doc_digits(c: ColumnOrName) -> Column:
    """Digits of a document number; a masked one is kept as it is."""
    text = clean_text(c)
    return F.when(text.contains("*"), text).otherwise(F.regexp_replace(text, r"\D+", ""))


def is_masked(c: ColumnOrName) -> Column:
    return F.coalesce(F.lower(as_col(c)).contains("x"), F.lit(False))


def truncate(c: ColumnOrName, n: int) -> Column:
    text = clean_text(c)
    return F.when(F.length(text) > n, F.concat(F.rtrim(F.substring(text, 1, n - 3)), F.lit("..."))).otherwise(text)


def excerpt_around(c: ColumnOrName, names: Sequence[str], before: int = 180, after: int = 240, plain: int = 420) -> Column:
    """Window around the first hit of any name, else the opening of the text."""
    def positions(text: Column) -> Column:
        return let(fold(text, ascii_only=True), lambda flat: F.array_min(F.filter(
            F.array(*[F.instr(flat, fold_text(n)) for n in names]), lambda p: p > 0)) - 1)

    def window(x: Column) -> Column:
        text, hit, size = x["text"], x["hit"], F.length(x["text"])
        start, end = F.greatest(F.lit(0), hit - before), F.least(size, hit + after)
        around = F.concat(
            F.when(start > 0, F.lit("... ")).otherwise(F.lit("")), F.substring(text, start + 1, end - start),
            F.when(end < size, F.lit(" ...")).otherwise(F.lit("")))
        return F.when(hit.isNotNull(), around).otherwise(F.substring(text, 1, plain))

    text = F.coalesce(clean_text(c), F.lit(""))
    if not names:
        return F.substring(text, 1, plain)
    return let(text, lambda t: let(F.struct(t.alias("text"), positions(t).alias("hit")), window))


def join_nonempty(*cols: ColumnOrName, sep: str = " ") -> Column:
    return F.concat_ws(sep, *[clean_text(c) for c in cols])


def cap_first(c: ColumnOrName) -> Column:
    text = as_col(c)
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))


def title_case(c: ColumnOrName) -> Column:
    """Upper-case every letter that follows a non-letter, lower-case the rest."""
    pieces = F.split(F.lower(as_col(c)), r"(?<=[^\p{L}])")
    return F.array_join(F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))), "")


def zpad(c: ColumnOrName, n: int) -> Column:
    return F.lpad(as_col(c).cast("string"), n, "0")


def word_count(c: ColumnOrName) -> Column:
    return F.regexp_count(F.coalesce(as_col(c), F.lit("")), F.lit(r"(?U)\w+"))


def first_line(c: ColumnOrName, n: int, default: str) -> Column:
    line = F.substring(F.trim(F.substring_index(F.trim(as_col(c)), "\n", 1)), 1, n)
    return F.when(line != "", line).otherwise(F.lit(default))


def snippet(c: ColumnOrName, aliases: ColumnOrName, n: int = 340) -> Column:
    """First sentence or line that holds an alias, else the opening of the text."""
    return let(snippet_source(c), lambda source: snippet_of(source, aliases, n))


def snippet_source(c: ColumnOrName) -> Column:
    """struct(text, keyed sentences) for ``snippet_of``, so that several snippets of a text take it apart once."""
    text = F.coalesce(as_col(c), F.lit(""))
    segments = F.transform(F.filter(F.split(text, r"\n+|(?<=[.!?])\s+"), has_text), lambda s: clean_text(s))
    keyed = let(segments, lambda a: F.transform(a, lambda s: F.struct(s.alias("s"), match_text(s).alias("k"))))
    return F.struct(text.alias("text"), keyed.alias("keyed"))


def snippet_of(source: Column, aliases: ColumnOrName, n: int = 340) -> Column:
    """Snippet out of a bound ``snippet_source``."""
    wanted = F.filter(F.transform(as_col(aliases), match_text), lambda a: a != "")

    def holding(words: Column) -> Column:
        return F.get(F.filter(source["keyed"], lambda s: F.exists(words, lambda a: s["k"].contains(a))), F.lit(0))["s"]

    def shaped(found: Column) -> Column:
        text = source["text"]
        cut = F.concat(F.rtrim(F.substring(found, 1, n - 3)), F.lit("..."))
        opening = F.coalesce(clean_text(F.substring(text, 1, n)), F.lit(""))
        fallback = F.when(F.length(text) > F.length(opening), F.concat(opening, F.lit("..."))).otherwise(opening)
        return F.when(text == "", "").when(found.isNotNull(), F.when(F.length(found) > n, cut).otherwise(found)).otherwise(fallback)

    return let(let(wanted, holding), shaped)


# Separators between a title and the name of its site, in order of trial.
TITLE_SEPARATORS = (" | ", " - ", " — ", " – ")


def strip_suffix(title: ColumnOrName, site: ColumnOrName | None = None, hints: Sequence[str] = ()) -> Column:
    """Remove the part after the last separator when it names the site."""
    site_key = fold(site, ascii_only=True) if site is not None else F.lit("")
    known = [fold_text(h) for h in hints]

    def split_at(x: Column, sep: Column) -> Column:
        right = F.call_function("substring_index", x["text"], sep, F.lit(-1))
        left = F.substring(x["text"], F.lit(1), F.length(x["text"]) - F.length(right) - F.length(sep))
        return F.struct(x["text"].contains(sep).alias("found"), F.coalesce(clean_text(left), F.lit("")).alias("left"), fold(right, ascii_only=True).alias("right"))

    def names_site(x: Column, s: Column) -> Column:
        named = (x["site"] != "") & (x["site"].contains(s["right"]) | s["right"].contains(x["site"]))
        return s["found"] & (s["left"] != "") & (named | s["right"].isin(known) if known else named)

    def body(x: Column) -> Column:
        parts = F.transform(F.array(*[F.lit(sep) for sep in TITLE_SEPARATORS]), lambda sep: split_at(x, sep))
        return F.coalesce(F.get(F.filter(parts, lambda s: names_site(x, s)), F.lit(0))["left"], x["text"])

    return let(F.struct(F.coalesce(clean_text(title), F.lit("")).alias("text"), site_key.alias("site")), body)


def array_unique_folded(a: ColumnOrName) -> Column:
    """Drop later elements whose folded key occurred before; keeps order."""
    keyed = F.filter(
        F.transform(as_col(a), lambda x: F.struct(match_text(x).alias("k"), clean_text(x).alias("v"))), lambda s: s["k"] != "")

    def firsts(x: Column) -> Column:
        chosen = F.filter(x["items"], lambda s, i: F.array_position(x["keys"], s["k"]) == i + 1)
        return F.transform(chosen, lambda s: s["v"])

    return let(keyed, lambda items: let(F.struct(items.alias("items"), F.transform(items, lambda s: s["k"]).alias("keys")), firsts))


def format_id(c: ColumnOrName) -> Column:
    """``BR067312026`` to ``BR-06731/2026``; any other shape is null."""
    pattern = r"^([A-Z]{2})[- ]?(\d{5})/?(\d{4})$"
    raw = F.upper(F.trim(as_col(c)))
    return F.when(raw.rlike(pattern), F.regexp_replace(raw, pattern, "$1-$2/$3"))


def format_prefix(c: ColumnOrName) -> Column:
    """``PTABC`` to ``PT-ABC``; other marks are kept in upper case."""
    pattern = r"^([A-Z]{2})([A-Z0-9]{3})$"
    raw = F.upper(F.trim(as_col(c)))
    return F.regexp_replace(raw, pattern, "$1-$2")


def plausible_year(c: ColumnOrName, low: int = 1900, high: int = 2100) -> Column:
    raw = F.trim(as_col(c).cast("string"))
    year = F.when(raw.rlike(r"^[0-9]{4}$"), raw.try_cast("int"))
    return F.when(year.between(low, high), year)


def any_of(words: Sequence[str], whole_words: bool = False) -> str:
    """One pattern for a list of literal words, with shared beginnings factored out: at most
    positions of a text it fails on the first character, however long the list."""
    tree: dict = {}
    for word in words:
        node = tree
        for ch in word:
            node = node.setdefault(ch, {})
        node[""] = {}

    def emit(node: dict) -> str:
        if "" in node and not whole_words:
            return ""               # a shorter word already decides
        parts = [re.escape(ch) + emit(child) for ch, child in node.items() if ch]
        if not parts:
            return ""
        body = parts[0] if len(parts) == 1 and "" not in node else f"(?:{'|'.join(parts)})"
        return body + "?" if "" in node else body

    return rf"\b{emit(tree)}\b" if whole_words else emit(tree)


def case_when(rules: Sequence[tuple[Column, Column]], default: Column) -> Column:
    """One flat CASE: the first rule that holds. Flat, so that an expression shared by the
    conditions is computed once per row."""
    if not rules:
        return default
    out = F.when(*rules[0])
    for test, value in rules[1:]:
        out = out.when(test, value)
    return out.otherwise(default)
