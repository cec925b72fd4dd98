"""Speech corpus: records out of pages, terms of office, people mentioned."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civisight.functions import html
from civisight.functions.arrays import short_id
from civisight.functions.dates import iso_week, month_key, prose_date, prose_place
from civisight.functions.text import clean_text, fold, has_text, let, snippet_of, snippet_source, title_case, word_count
from civisight.functions.urls import article_url, doc_type, slug_after, url_part
from civisight.operators import clean, entities, lookups, profiles, ranking, sets, state
from civisight.operators.windows import dedupe_last

# Terms of office by person, ends inclusive.
TERMS = [
    {"slug": "luiz-inacio-lula-da-silva", "start": "2003-01-01", "end": "2006-12-31", "label": "Lula 1 (2003-2006)"},
    {"slug": "luiz-inacio-lula-da-silva", "start": "2007-01-01", "end": "2010-12-31", "label": "Lula 2 (2007-2010)"},
    {"slug": "luiz-inacio-lula-da-silva", "start": "2023-01-01", "end": "2030-12-31", "label": "Lula 3 (2023-)"},
    {"slug": "bolsonaro", "start": "2019-01-01", "end": "2022-12-31", "label": "Bolsonaro (2019-2022)"},
    {"slug": "michel-temer", "start": "2016-08-31", "end": "2018-12-31", "label": "Temer (2016-2018)"},
    {"slug": "dilma-rousseff", "start": "2011-01-01", "end": "2014-12-31", "label": "Dilma 1 (2011-2014)"},
    {"slug": "dilma-rousseff", "start": "2015-01-01", "end": "2016-08-30", "label": "Dilma 2 (2015-2016)"},
    {"slug": "fernando-henrique-cardoso", "start": "1995-01-01", "end": "1998-12-31", "label": "FHC 1 (1995-1998)"},
    {"slug": "fernando-henrique-cardoso", "start": "1999-01-01", "end": "2002-12-31", "label": "FHC 2 (1999-2002)"},
    {"slug": "itamar-franco", "start": "1992-12-29", "end": "1994-12-31", "label": "Itamar (1992-1994)"},
    {"slug": "fernando-collor", "start": "1990-03-15", "end": "1992-12-29", "label": "Collor (1990-1992)"},
    {"slug": "jose-sarney", "start": "1985-03-15", "end": "1990-03-14", "label": "Sarney (1985-1990)"},
    {"slug": "jb-figueiredo", "start": "1979-03-15", "end": "1985-03-14", "label": "Figueiredo (1979-1985)"},
    {"slug": "ernesto-geisel", "start": "1974-03-15", "end": "1979-03-14", "label": "Geisel (1974-1979)"},
    {"slug": "emilio-medici", "start": "1969-10-30", "end": "1974-03-14", "label": "Medici (1969-1974)"},
    {"slug": "costa-silva", "start": "1967-03-15", "end": "1969-08-31", "label": "Costa e Silva (1967-1969)"},
    {"slug": "castello-branco", "start": "1964-04-15", "end": "1967-03-14", "label": "Castelo Branco (1964-1967)"},
    {"slug": "joao-goulart", "start": "1961-09-08", "end": "1964-04-01", "label": "Joao Goulart (1961-1964)"},
    {"slug": "janio-quadros", "start": "1961-01-31", "end": "1961-08-25", "label": "Janio Quadros (1961)"},
    {"slug": "jk", "start": "1956-01-31", "end": "1961-01-30", "label": "Juscelino (1956-1961)"},
    {"slug": "getulio-vargas", "start": "1930-11-03", "end": "1945-10-29", "label": "Vargas 1 (1930-1945)"},
    {"slug": "getulio-vargas", "start": "1951-01-31", "end": "1954-08-24", "label": "Vargas 2 (1951-1954)"},
]
UNDATED_TERMS = {
    "dilma-rousseff": "Dilma (2011-2016)", "fernando-henrique-cardoso": "FHC (1995-2002)",
    "getulio-vargas": "Vargas (1930-1945 / 1951-1954)",
}
URL_TERMS = [
    {"slug": "luiz-inacio-lula-da-silva", "segment": "/1o-mandato/", "label": "Lula 1 (2003-2006)"},
    {"slug": "luiz-inacio-lula-da-silva", "segment": "/2o-mandato/", "label": "Lula 2 (2007-2010)"},
]

RECORD_FIELDS = ("title", "description", "location", "text", "date", "date_source")


def document_pages(pages: DataFrame, last_year: int) -> DataFrame:
    """Fields of landed document pages (``url``, ``html``)."""
    page = pages.select(
        article_url("url").alias("url"), html.without_code("html").alias("_c"))
    meta = html.tags("_c", "meta")
    parsed = page.select(
        "url",
        F.coalesce(
            html.first_tag_text("_c", "h1", "documentFirstHeading"), html.first_tag_text("_c", "h1"),
            html.first_attr(meta, [(("property", "og:title"), "content")]), html.first_tag_text("_c", "title")).alias("title"),
        F.coalesce(
            html.first_tag_text("_c", "div", "documentDescription"), html.first_tag_text("_c", "p", "documentDescription"),
            html.first_attr(meta, [(("name", "description"), "content")])).alias("description"),
        F.coalesce(html.first_tag_text("_c", "span", "documentPublished"), html.first_tag_text("_c", "time")).alias("published_line"),
        html.body_lines("_c").alias("lines"))
    parsed = parsed.withColumns({c: html.decoded(c) for c in ("title", "description", "published_line")})
    line = lambda i: F.get("lines", F.lit(i))
    return parsed.withColumn("_d", prose_date(["description", "published_line", line(0), line(1), line(2), "title"], "url", last_year)).select(
        "url", "title", "description", F.array_join("lines", "\n").alias("text"), F.length(F.array_join("lines", "\n")).alias("text_length"), F.col("_d.date").alias("date"), F.col("_d.source").alias("date_source"),
        prose_place([line(0), line(1), line(2), "description", "title"]).alias("location"))


def text_documents(files: DataFrame, listing: DataFrame, previous: DataFrame, last_year: int) -> DataFrame:
    """Fields of landed text files (``url``, ``text``), as of ``document_pages``: title by the listing, the previous record or its
    description; date and place by title, description and the first five lines that hold something. Files without text are left out."""
    lines = F.transform(F.slice(F.filter(F.split("text", r"\r\n|\r|\n"), has_text), 1, 5), lambda x: clean_text(x))
    before = previous.select("url", F.col("title").alias("_old"), F.col("description").alias("description"))
    known = files.select(article_url("url").alias("url"), "text").filter(has_text("text")).withColumn("lines", lines)
    known = known.join(listing.select("url", F.col("title").alias("_listed")), "url", "left").join(before, "url", "left")
    known = known.withColumn("title", F.coalesce(clean_text("_listed"), clean_text("_old"), clean_text("description")))
    at = [F.get("lines", F.lit(i)) for i in range(5)]
    dated = known.withColumn("_d", prose_date(["title", "description", *at], "url", last_year))
    body = F.regexp_replace("text", r"^\s+|\s+$", "")
    return dated.select(
        "url", "title", "description", body.alias("text"), F.length(body).alias("text_length"), F.col("_d.date").alias("date"),
        F.col("_d.source").alias("date_source"), prose_place([*at, F.col("description"), F.col("title")]).alias("location"))


def records(listing: DataFrame, previous: DataFrame, parsed: DataFrame, names: dict[str, str], forced_source: str, forced_slug: str, types: dict[str, str], default_type: str, default_source: str, slug_segment: str) -> DataFrame:
    """Corpus records by precedence: listing, previous record, page, inference, default."""
    base = clean.assemble_record(
        listing, previous, parsed.withColumn("date", F.col("date").cast("string")), "url",
        {"source": default_source, "type": None, "slug": None, "person": None} | {f: None for f in RECORD_FIELDS}, forced=RECORD_FIELDS)
    slug = F.coalesce("slug", slug_after("url", slug_segment))
    slug = F.when(F.col("source") == forced_source, F.lit(forced_slug)).otherwise(slug)
    known = F.create_map(*[F.lit(x) for kv in names.items() for x in kv]) if names else F.create_map().cast("map<string,string>")
    out = base.withColumns({"slug": slug, "type": F.coalesce("type", doc_type("url", "title", types, default_type)), "date": F.col("date").try_cast("date")})
    spoken = F.coalesce("person", F.try_element_at(known, F.col("slug")), title_case(F.regexp_replace("slug", "[-_]+", " ")))
    out = out.withColumns({"person": spoken, "id": short_id("url", 20), "word_count": word_count("text")})
    return lookups.term_label(out, "slug", "person", "date", "url", TERMS, URL_TERMS, undated=UNDATED_TERMS)


def pending_details(known: DataFrame, found: DataFrame, max_failures: int) -> DataFrame:
    """URLs to fetch: new ones, and known ones without text or title that may still be tried."""
    rows = found.join(known.select("url", "title", "text", "failures"), "url", "left")
    tries = F.coalesce("failures", F.lit(0))
    weak = clean_text("text").isNull() | clean_text("title").isNull()
    open_ = (tries < max_failures) if max_failures > 0 else F.lit(True)
    return ranking.fetch_priority(rows.filter(weak & open_).select("url", tries.alias("failures")), "failures", "url")


def merged_corpus(old: DataFrame, new: DataFrame, posts: DataFrame) -> DataFrame:
    """Latest record per URL, crawled ones and posts together."""
    both = sets.union_tagged({"0": old, "1": new, "2": posts}, "_gen")
    return dedupe_last(both, ["url"], "_gen").drop("_gen")


def upload_rows(local: DataFrame, remote: DataFrame, long_sources: Sequence[str]) -> DataFrame:
    """Good records that the remote table lacks or has in another version."""
    good = local.filter(~clean.is_bad_record("title", "text", "source", long_sources))
    return lookups.changed_rows(good, remote, "id", "updated_at")


def metadata(rows: DataFrame) -> DataFrame:
    return profiles.corpus_profile(rows, ["source", "type", "person", "term"])


def mention_rows(docs: DataFrame, aliases: DataFrame, people: DataFrame) -> DataFrame:
    """One row per document and person, with count, aliases, snippet and period keys."""
    counts = entities.mention_counts(entities.accepted_mentions(entities.alias_hits(docs, aliases)))
    # one row per document, so that its text is taken apart once, however many people it mentions
    found = counts.groupBy("doc_id").agg(F.collect_list(F.struct("entity_id", "occurrences", "matched_aliases")).alias("_found"))
    about = found.join(docs.select("doc_id", "url", "title", "date", "text"), "doc_id")
    shown = let(snippet_source("text"), lambda source: F.transform("_found", lambda m: F.struct(m.alias("m"), snippet_of(source, m["matched_aliases"]).alias("snippet"))))
    rows = about.select("doc_id", "url", "title", "date", F.explode(shown).alias("_x")).select("doc_id", "url", "title", "date", "_x.m.*", "_x.snippet")
    out = rows.join(people.select(F.col("id").alias("entity_id"), "kind", "name"), "entity_id")
    return out.select(
        "entity_id", "kind", "name", "doc_id", "url", "title", "date", month_key("date").alias("month"), iso_week("date").alias("week"),
        F.year("date").alias("year"), "occurrences", "matched_aliases", "snippet")


def listing_rule(kind: Column, url: Column, slug: str | None, sections: dict[str, Sequence[str]], index_pages: Sequence[str]) -> Column:
    """Admission of a listing link: inside the section of its type, not an index page."""
    low = F.lower(url)
    inside = F.lit(False)
    for name, parts in sections.items():
        test = F.lit(True)
        for part in parts:
            test = test & low.contains(part)
        inside = inside | ((kind == name) & test)
    if slug:
        inside = inside & low.contains(f"/{slug}/")
    for page in index_pages:
        inside = inside & ~low.endswith(page)
    return inside


def category_rule(url: Column, text: Column, names: Sequence[str]) -> Column:
    """A child category: a year, a term of office, or a known listing name."""
    last = F.lower(F.element_at(F.split(F.regexp_replace(url_part(url, "path"), "/+$", ""), "/"), -1))
    return last.rlike(r"^\d{4}$") | last.contains("mandato") | fold(text).contains("mandato") | last.isin(list(names))


def advance_failures(known: DataFrame, observed: DataFrame, limit: int) -> DataFrame:
    return state.count_failures(known, observed, "url", "ok", limit)
