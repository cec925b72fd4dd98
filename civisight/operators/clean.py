"""Row predicates and record projections."""
from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civisight import rules as tables
from civisight.functions.text import ColumnOrName, any_of, as_col, clean_text, fold, fold_text


def project_map(df: DataFrame, mapping: dict[str, str], markers: Sequence[str] = ("null",), keep: Sequence[str] = ()) -> DataFrame:
    """Rename wanted columns to short keys, cleaned; rows with nothing left are dropped."""
    out = df.select(*keep, *[clean_text(F.col(f"`{src}`"), markers).alias(dst) for src, dst in mapping.items()])
    return out.dropna("all", subset=list(mapping.values()))


def is_active(start: ColumnOrName, end: ColumnOrName, asof: dt.date) -> Column:
    """Start known and not after the day; end open or not before it."""
    day = F.lit(asof)
    return F.coalesce((as_col(start) <= day) & (as_col(end).isNull() | (as_col(end) >= day)), F.lit(False))


def recent_or_active(active: ColumnOrName, dates: Sequence[ColumnOrName], asof: dt.date, years: int = 6) -> Column:
    """Active, or any of the dates within the last years."""
    newest = F.greatest(*[as_col(d) for d in dates]) if len(dates) > 1 else as_col(dates[0])
    return as_col(active) | F.coalesce(newest >= F.add_months(F.lit(asof), -12 * years), F.lit(False))


def encoded_size(df: DataFrame) -> DataFrame:
    """One row: rows and bytes of the encoded table, as a plain metric."""
    return df.agg(F.count("*").alias("rows"), F.sum(F.octet_length(F.to_json(F.struct(*[F.col(c) for c in df.columns])))).alias("bytes"))


# Navigation titles that say nothing about a page.
PLACEHOLDER_TITLES = ("read full story", "view workshop on udemy", "brazil", "uk", "usa", "sweden", "malaysia", "portugal", "ned", "oxford")
PLACEHOLDER_STARTS = ("http://", "https://", "read full story", "view workshop", "ver mais ")
# Path and title parts of legal, feed and listing pages.
NOISE_PATHS = (
    "/termos-de-uso", "/politica-de-privacidade", "/privacy-policy", "/politica-de-cookies", "/cookie-policy",
    "/cookies", "/newsletter", "/feed", "/tag/", "/category/", "/categoria/",
)
NOISE_TITLES = (
    "termos de uso", "politica de privacidade", "privacy policy", "cookie policy", "politica de cookies",
)


def is_placeholder(title: ColumnOrName, words: Sequence[str] = PLACEHOLDER_TITLES, starts: Sequence[str] = PLACEHOLDER_STARTS) -> Column:
    flat = fold(title, ascii_only=True)
    return (
        (flat == "") | flat.isin(list(words)) | flat.rlike("^" + any_of(starts)) | flat.rlike(any_of(NOISE_TITLES))
    )


def is_noise(url: ColumnOrName, title: ColumnOrName | None = None, paths: Sequence[str] = NOISE_PATHS, titles: Sequence[str] = NOISE_TITLES) -> Column:
    test = fold(url, ascii_only=True).rlike(any_of(paths))
    return test if title is None else test | fold(title, ascii_only=True).rlike(any_of(titles))


# Wording of pages served to blocked robots.
BLOCKED_PAGE = (
    "evitar o acesso automatizado", "qual codigo esta sendo exibido", "support id", "request rejected",
    "the requested url was rejected",
)


def is_blocked_page(text: ColumnOrName) -> Column:
    return fold(text).rlike(any_of(BLOCKED_PAGE))


# Titles of rejected pages.
BAD_TITLES = ("request rejected", "the requested url was rejected")


def is_bad_record(title: ColumnOrName, text: ColumnOrName, source: ColumnOrName, long_sources: Sequence[str], bad_titles: Sequence[str] = BAD_TITLES, min_chars: int = 200) -> Column:
    """No or a blocked-page title, or a long-form source with hardly any text."""
    name = F.lower(F.trim(F.coalesce(as_col(title), F.lit(""))))
    body = F.length(F.trim(F.coalesce(as_col(text), F.lit(""))))
    return name.isin(["", *bad_titles]) | F.coalesce(as_col(source).isin(list(long_sources)) & (body < min_chars), F.lit(False))


def in_scope(period: ColumnOrName, source: ColumnOrName, slug: ColumnOrName, url: ColumnOrName, periods: Sequence[str], sources: Sequence[str], slugs: Sequence[str], url_parts: Sequence[str]) -> Column:
    """Record belongs to a wanted period, source or person, by label or by URL."""
    test = clean_text(period).isin(list(periods)) | fold(source).isin([fold_text(s) for s in sources]) | fold(slug).isin(list(slugs))
    if url_parts:
        test = test | F.lower(F.coalesce(as_col(url), F.lit(""))).rlike(any_of([u.lower() for u in url_parts]))
    return F.coalesce(test, F.lit(False))


def eligible_place(location: ColumnOrName, positive: Sequence[str], remote: str, excluded: Sequence[str], whole_words: Sequence[str] = ()) -> Column:
    """A wanted place, or remote work without an excluded region.

    ``excluded`` are patterns; ``whole_words`` are places that must stand alone.
    """
    text = F.lower(F.coalesce(clean_text(location), F.lit("")))
    good = text.rlike(any_of([p for p in positive if p not in whole_words]))
    if whole_words:
        good = good | text.rlike(any_of(whole_words, whole_words=True))
    barred = text.rlike("|".join(f"(?:{p})" for p in excluded)) if excluded else F.lit(False)
    return good | (text.contains(remote) & ~barred)


def keep_link(
    base: ColumnOrName, href: ColumnOrName, text: ColumnOrName, mode: ColumnOrName,
    articles: Sequence[str] = tables.ARTICLE_PATHS, listings: Sequence[str] = tables.LISTING_PATHS,
) -> Column:
    """Admission of a link found on a page, by crawl mode."""
    from civisight.functions.urls import canonical_url, domain, url_part

    path = F.coalesce(F.nullif(url_part(href, "path"), F.lit("")), F.lit("/"))
    holds = lambda parts: path.rlike("|".join(map(re.escape, parts)))
    slashes = F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))
    by_mode = (
        F.when(as_col(mode) == "articles", holds(articles))
        .when(as_col(mode) == "year_paths", path.rlike(r"/20\d\d/"))
        .when(as_col(mode) == "contributor",
              ~holds(listings) & (slashes >= 2)
              & (F.length(F.coalesce(clean_text(text), F.lit(""))) >= 12))
        .otherwise(F.lit(False))
    )
    return F.coalesce(
        as_col(href).startswith("http") & (domain(href) == domain(base))
        & (canonical_url(href) != canonical_url(base)) & ~is_noise(href, text) & by_mode, F.lit(False),
    )


def sanitize_record(df: DataFrame, text_fields: Sequence[str], int_fields: Sequence[str], state: str, status: str, allowed: Sequence[str]) -> DataFrame:
    """Types of an extracted record: trimmed text, counts (zero when unreadable), two-letter
    state, a status only out of the allowed set."""
    changes = {f: clean_text(f) for f in text_fields}
    changes |= {f: F.coalesce(F.trim(F.col(f).cast("string")).try_cast("int"), F.lit(0)) for f in int_fields}
    value = F.lower(F.trim(F.col(status)))
    changes[state] = F.nullif(F.substring(F.upper(F.trim(F.col(state))), 1, 2), F.lit(""))
    changes[status] = F.when(value.isin(list(allowed)), value)
    return df.withColumns(changes)


def blank_echo(c: ColumnOrName, *echo: str) -> Column:
    """Null when the field repeats the wording of the extraction prompt."""
    low, test = F.lower(as_col(c)), F.lit(True)
    for word in echo:
        test = test & low.contains(word.lower())
    return F.when(~test, as_col(c))


def lean_items(df: DataFrame, text: str = "text") -> DataFrame:
    """Everything but the body, whose length is kept."""
    return df.withColumn("text_length", F.length(F.coalesce(F.col(text), F.lit("")))).drop(text)


def has_reliable_date(date: ColumnOrName, category: ColumnOrName, relation: ColumnOrName, profile: str = "profile", author_page: str = "author page") -> Column:
    return (
        as_col(date).isNotNull() & (F.coalesce(as_col(category), F.lit("")) != profile)
        & (F.coalesce(as_col(relation), F.lit("")) != author_page)
    )


def assemble_record(listing: DataFrame, previous: DataFrame, parsed: DataFrame, key: str, fields: dict[str, str | None], forced: Sequence[str] = ()) -> DataFrame:
    """One record per listed key: listing value, else previous, else parsed, else default.
    ``forced`` fields take the parsed value first."""
    def renamed(df: DataFrame, tag: str) -> DataFrame:
        return df.select(key, *[F.col(f).alias(f"_{tag}_{f}") for f in fields if f in df.columns])

    joined = renamed(listing, "l").join(renamed(previous, "p"), key, "left").join(renamed(parsed, "n"), key, "left")
    out = []
    for f, default in fields.items():
        order = ("n", "l", "p") if f in forced else ("l", "p", "n")
        tries = [F.nullif(F.col(f"_{t}_{f}"), F.lit("")) for t in order if f"_{t}_{f}" in joined.columns]
        out.append(F.coalesce(*tries, F.lit(default).cast("string")).alias(f))
    return joined.select(key, *out)


def label_missing(c: ColumnOrName, default: str, upper: bool = False) -> Column:
    text = clean_text(c)
    return F.coalesce(F.upper(text) if upper else text, F.lit(default))
