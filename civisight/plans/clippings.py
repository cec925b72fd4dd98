"""Web mentions: page metadata, candidate merge, two-pass classification, archive views."""
from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civisight.functions import html
from civisight.functions.arrays import short_id, union_distinct
from civisight.functions.dates import parse_timestamp
from civisight.functions.text import clean_text, excerpt_around, strip_suffix
from civisight.functions.urls import canonical_url, domain, in_domains, url_part
from civisight.operators import clean, lookups, profiles, ranking
from civisight.operators.classify import RELATIONS, PersonRules, classify_two_pass

SECTION_ORDER = ("authored", "republication", "echo", "quoted", "mention", "interview", "talk", "profile")


def page_metadata(pages: DataFrame, names: Sequence[str], site_hints: Sequence[str] = ()) -> DataFrame:
    """Title, description, site, canonical link, authors, date and excerpt of landed pages
    (``url``, ``html``). The whole page text is read."""
    prepared = pages.select(
        "url", html.without_code("html").alias("_c"), html.jsonld_fields(html.jsonld_blocks("html")).alias("_ld"))
    meta, links = html.tags("_c", "meta"), html.tags("_c", "link")
    content = lambda *where: html.first_attr(meta, [(w, "content") for w in where])
    stamps = F.concat(
        html.attr_values(meta, ("property", "article:published_time"), "content"), html.attr_values(meta, ("name", "parsely-pub-date"), "content"),
        html.attr_values(meta, ("itemprop", "datePublished"), "content"), html.attr_values(html.tags("_c", "time"), None, "datetime"), F.array(F.col("_ld.published_at")))
    published = F.try_element_at(F.filter(F.transform(stamps, lambda s: parse_timestamp(s)), lambda x: x.isNotNull()), F.lit(1))
    authors = F.concat(
        html.attr_values(meta, ("name", "author"), "content"), html.attr_values(meta, ("property", "article:author"), "content"),
        html.attr_values(meta, ("itemprop", "author"), "content"), F.col("_ld.author_names"))
    found = prepared.select(
        "url", F.coalesce(html.decoded(html.first_tag_text("_c", "title")), F.col("_ld.title")).alias("_title"), html.decoded(html.first_tag_text("_c", "h1")).alias("_h1"),
        content(("property", "og:title")).alias("_og"), content(("name", "twitter:title")).alias("_tw"),
        F.coalesce(content(("name", "description"), ("property", "og:description"), ("name", "twitter:description")), F.col("_ld.description")).alias("description"),
        F.coalesce(content(("property", "og:site_name"), ("name", "application-name")), F.col("_ld.site_name")).alias("site_name"),
        F.coalesce(html.first_attr(links, [(("rel", "canonical"), "href")]), content(("property", "og:url"))).alias("canonical_url"),
        published.alias("published_at"), union_distinct(authors).alias("author_names"), html.decoded(html.page_text("_c")).alias("text"))
    return found.select(
        "url", preferred_title(["_h1", "_og", "_tw", "_title"], "url", "site_name", site_hints).alias("title"), "description", "site_name",
        F.coalesce(canonical_url("canonical_url"), canonical_url("url")).alias("canonical_url"), "published_at", "author_names",
        excerpt_around("text", names).alias("text_excerpt"), F.length("text").alias("text_length"))


def preferred_title(candidates: Sequence[str], url: str, site: str, hints: Sequence[str]) -> Column:
    """First usable candidate (they come in order of weight) without the site's name; the
    last one when none is usable."""
    usable = F.filter(
        F.array(*[F.col(c) for c in candidates]), lambda c: ~clean.is_placeholder(c) & ~clean.is_noise(url, c))
    return F.coalesce(F.get(F.transform(F.slice(usable, 1, 1), lambda c: strip_suffix(c, site, hints)), F.lit(0)), F.col(candidates[-1]))


def reader_metadata(pages: DataFrame, names: Sequence[str]) -> DataFrame:
    """Variant for pages landed as text with a key-value head (``url``, ``text``)."""
    head = lambda key: clean_text(F.regexp_extract("text", rf"(?m)^{key}: (.*)$", 1))
    body = F.regexp_replace("text", r"(?s)^.*?\nMarkdown Content:\n?", "")
    out = pages.select(
        "url", head("Title").alias("title"), F.coalesce(canonical_url(head("URL Source")), canonical_url("url")).alias("canonical_url"),
        parse_timestamp(head("Published Time")).alias("published_at"), excerpt_around(body, names).alias("text_excerpt"), domain("url").alias("site_name"))
    return out.withColumn("description", F.col("text_excerpt"))


def candidates(rows: DataFrame, order: str = "row_no") -> DataFrame:
    """One candidate per canonical URL out of seeds and search results."""
    keyed = rows.withColumn("url", canonical_url("url")).filter("url is not null")
    merged = lookups.merge_candidates(
        keyed, "url", order, ["category_hint", "relation_hint", "notes", "published_at"], "title", "description", ["source_label", "query"])
    return merged.withColumnRenamed("querys", "queries")


def needs_fetch(existing: DataFrame, forced_domains: Sequence[str], dated_domains: Sequence[str]) -> DataFrame:
    """Known items whose page must be read again."""
    path = url_part("url", "path")
    weak = clean.is_placeholder("title") | clean.is_noise("url", "title")
    forced = in_domains(F.col("domain"), forced_domains) & (weak | path.rlike(r"/20\d\d/") | path.contains("/articles/"))
    undated = F.col("domain").isin(list(dated_domains)) & F.col("published_at").isNull()
    return existing.withColumn("refetch", ~F.coalesce("fetch_ok", F.lit(False)) | clean.is_placeholder("title") | forced | undated)


def enriched(merged: DataFrame, pages: DataFrame, existing: DataFrame, now: Column, hidden_prefix: str = "portfolio-") -> DataFrame:
    """Candidates with page fields where the page gave one, and first/last seen."""
    page = pages.select("url", *[F.col(c).alias(f"_p_{c}") for c in ("title", "description", "site_name", "author_names", "published_at", "text_excerpt")])
    seen = existing.select("url", F.col("first_seen_at").alias("_first"), F.col("id").alias("_id"))
    out = merged.join(page, "url", "left").join(seen, "url", "left")
    return out.select(
        "url", F.coalesce("_id", short_id("url", 16)).alias("id"), domain("url").alias("domain"),
        F.coalesce(F.when(~clean.is_placeholder("_p_title"), F.col("_p_title")), F.col("title")).alias("title"),
        F.coalesce("_p_description", "description").alias("description"), F.coalesce(F.col("_p_site_name"), domain("url")).alias("site_name"),
        union_distinct(F.coalesce("_p_author_names", F.array().cast("array<string>"))).alias("author_names"),
        F.coalesce("_p_published_at", parse_timestamp("published_at")).alias("published_at"), F.col("_p_text_excerpt").alias("text_excerpt"),
        "category_hint", "relation_hint", "notes", F.filter("source_labels", lambda x: ~x.startswith(hidden_prefix)).alias("source_labels"), "queries",
        F.coalesce("_first", now).alias("first_seen_at"), now.alias("last_seen_at"))


def classified(items: DataFrame, rules: PersonRules) -> DataFrame:
    return classify_two_pass(items, rules)


def archive(items: DataFrame) -> DataFrame:
    """Newest first; undated last."""
    return ranking.export_order(items, [("published_at", False), ("first_seen_at", False), ("match_score", False), ("title", False)])


def dated(items: DataFrame) -> DataFrame:
    return items.filter(clean.has_reliable_date("published_at", "category", "relation"))


def sections(items: DataFrame, asof: dt.date, days: int = 30) -> DataFrame:
    age = F.date_diff(F.lit(asof), F.col("published_at"))
    recent = clean.has_reliable_date("published_at", "category", "relation") & age.between(0, days)
    return ranking.sections(items, "category", SECTION_ORDER, recent)


def latest_items(items: DataFrame, asof: dt.date, days: int = 30, n: int = 12) -> DataFrame:
    age = F.date_diff(F.lit(asof), F.col("published_at"))
    return archive(dated(items).filter(age.between(0, days))).limit(n)


def metadata(items: DataFrame, asof: dt.date) -> dict[str, DataFrame]:
    return {
        "counts": profiles.corpus_profile(items, ["category", "domain"], labels={"category": list(RELATIONS)}),
        "recent": profiles.recency_counts(dated(items), "published_at", asof, (1, 7, 30)),
        "range": items.agg(F.min("published_at").alias("first"), F.max("published_at").alias("last"), F.count_distinct("domain").alias("domains")),
    }
