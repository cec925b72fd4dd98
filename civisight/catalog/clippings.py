"""Web items on pages and documents: URL keys, links, merge, identity, categories."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civisight.catalog.base import Tables, query
from civisight.functions import text, urls
from civisight.operators import classify, clean, lookups
from civisight.plans import clippings as plan

HOST = r"regexp_replace(lower(regexp_extract({u}, '^[a-z]+://([^/?#]*)', 1)), '^www\.', '')"
PATH = r"regexp_extract({u}, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
PARAMS = r"array_to_string(list_filter(string_split(regexp_extract({u}, '\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT starts_with(p, 'utm_')), '&')"
CANON = f"""regexp_extract({{u}}, '^([a-z]+)://', 1) || '://' || {HOST} || CASE WHEN {PATH} IN ('', '/') THEN '/' ELSE regexp_replace({PATH}, '/+$', '') END
 || CASE WHEN {PARAMS} = '' THEN '' ELSE '?' || {PARAMS} END"""


@query("canonical_urls", f"""SELECT page_id, {CANON.format(u='url')} AS url_key, {HOST.format(u='url')} AS domain,
 regexp_extract(url, '^([a-z]+)://', 1) || '://' || lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) || regexp_replace({PATH.format(u='url')}, '/+$', '') AS article_key FROM pages""")
def canonical_urls(t: Tables) -> DataFrame:
    return t.pages.select("page_id", urls.canonical_url("url").alias("url_key"), urls.domain("url").alias("domain"), urls.article_url("url").alias("article_key"))


@query("listing_urls", r"""SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) || '://' || lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) || regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', '')
 || CASE WHEN regexp_extract(url, '[?&](page=[^&#]*)', 1) = '' THEN '' ELSE '?' || regexp_extract(url, '[?&](page=[^&#]*)', 1) END AS listing_key FROM pages""")
def listing_urls(t: Tables) -> DataFrame:
    return t.pages.select("page_id", urls.listing_url("url").alias("listing_key"))


@query("unwrapped_urls", f"""SELECT page_id, CASE WHEN starts_with(url, 'https://m.') THEN 'https://www.youtube.com/watch?v=' || page_id WHEN starts_with(url, 'https') THEN url WHEN contains(url, 'blog.') THEN 'https://www.youtube.com/watch?v=v' || page_id ELSE 'https:' || substr(url, 6) END AS target FROM pages""")
def unwrapped_urls(t: Tables) -> DataFrame:
    """Search redirects, embeds, short links and scheme-relative links."""
    secure, page = F.col("url").startswith("https"), F.col("page_id").cast("string")
    wrapped = (
        F.when(F.col("url").startswith("https://m."), F.concat(F.lit("https://www.youtube.com/embed/"), page, F.lit("/?rel=0")))
        .when(secure, F.concat(F.lit("//duckduckgo.com/l/?kh=1&uddg="), F.url_encode("url"), F.lit("&rut=x")))
        .when(F.col("url").contains("blog."), F.concat(F.lit("https://youtu.be/v"), page))
        .otherwise(F.substr("url", F.lit(6))))
    return t.pages.select("page_id", urls.unwrap_url(wrapped).alias("target"))


@query("aggregator_tokens", """SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'T' || page_id WHEN 1 THEN 'R' || page_id WHEN 2 THEN 'A' || page_id END AS token FROM pages""")
def aggregator_tokens(t: Tables) -> DataFrame:
    """Tokens of feed, read and article links of an aggregator; none for other paths and hosts."""
    page = F.col("page_id").cast("string")
    paths = [F.concat(F.lit("https://news.google.com/rss/articles/T"), page, F.lit("?oc=5")), F.concat(F.lit("https://news.google.com/read/R"), page),
             F.concat(F.lit("https://News.Google.com/x/articles/A"), page, F.lit("/")), F.concat(F.lit("https://news.google.com/topics/"), page)]
    url = F.coalesce(*[F.when(F.col("page_id") % 5 == i, u) for i, u in enumerate(paths)], F.concat(F.col("url"), F.lit("/articles/x")))
    return t.pages.select("page_id", urls.aggregator_token(url).alias("token"))


@query("in_domains", f"""SELECT page_id, {HOST.format(u='url')} IN ('ththre.example.com') OR {HOST.format(u='url')} LIKE '%.example.net' AS wanted FROM pages""")
def in_domains(t: Tables) -> DataFrame:
    return t.pages.select("page_id", urls.in_domains(urls.domain("url"), ["ththre.example.com", "example.net"]).alias("wanted"))


@query("url_parts", r"""SELECT page_id, nullif(lower(regexp_extract(url, '/(?:en|fr)/+([^/?#]+)', 1)), '') AS slug, CASE WHEN contains(lower(url), '.html') THEN 'page' WHEN contains(lower(url), 'blog') THEN 'post' ELSE 'other' END AS kind FROM pages""")
def url_parts(t: Tables) -> DataFrame:
    """Path segment after a given one; type by words of URL or title."""
    return t.pages.select("page_id", urls.slug_after("url", "(?:en|fr)").alias("slug"), urls.doc_type("url", F.lit(""), {".html": "page", "blog": "post"}, "other").alias("kind"))


CODE = r"regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<script\b[^>]*>.*?</script\s*>', '', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', '', 'g')"
LINK_SQL = rf"""a AS (SELECT url, unnest(regexp_extract_all({CODE}, '(?is)<a\b[^>]*>.*?</a\s*>')) AS a, unnest(range(0, len(regexp_extract_all({CODE}, '(?is)<a\b[^>]*>.*?</a\s*>')))) AS pos FROM pages),
l AS (SELECT url AS page_url, pos, trim(regexp_extract(a, 'href="([^"]*)"', 1)) AS h, coalesce(nullif(trim(regexp_replace(regexp_replace(a, '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')), ''), '') AS text FROM a),
r AS (SELECT page_url, pos, text, CASE WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.\-]*:') THEN h WHEN starts_with(h, '/') THEN regexp_extract(page_url, '^[a-z]+://[^/?#]*', 0) || h
  ELSE regexp_extract(page_url, '^[a-z]+://[^/?#]*', 0) || coalesce(nullif(regexp_replace({PATH.format(u='page_url')}, '[^/]*$', ''), ''), '/') || h END AS href FROM l WHERE h <> '')"""


@query("page_links", f"""WITH {LINK_SQL} SELECT page_url, href, min(pos)::INTEGER AS pos, first(text ORDER BY pos) AS text FROM r GROUP BY page_url, href""")
def page_links(t: Tables) -> DataFrame:
    """Links of whole pages, resolved, one row per page and target."""
    links = lookups.extract_links(t.pages)
    return links.groupBy("page_url", "href").agg(F.min("pos").alias("pos"), F.min_by("text", "pos").alias("text"))


@query("link_admission", f"""SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*', 0) LIKE '%example.com' AS kept FROM pages""")
def link_admission(t: Tables) -> DataFrame:
    """Links to year folders and articles of the same site are admitted."""
    base = F.regexp_extract("url", r"^[a-z]+://[^/?#]*", 0)
    same = F.regexp_replace(base, r"^([a-z]+://)", "$1www.")
    host = F.when(base.endswith("example.com"), same).otherwise(F.lit("https://elsewhere.example"))
    href = F.concat(host, F.lit("/2024/articles/"), F.col("page_id").cast("string"))
    mode = F.when(F.col("url").startswith("https"), "articles").otherwise("year_paths")
    own = F.regexp_replace("url", r"^([a-z]+://)www\.", "$1")
    return t.pages.select("page_id", clean.keep_link(own, F.regexp_replace(href, r"//www\.www\.", "//www."), F.lit("title"), mode).alias("kept"))


@query("merge_candidates", """WITH c AS (SELECT source AS url, doc_id AS o, CASE WHEN lang = 'de' THEN 'UK' WHEN lang = 'es' THEN '' ELSE lang || doc_id END AS title, text AS description,
  CASE WHEN lang = 'fr' THEN 'hint' || doc_id ELSE '' END AS hint, lang AS label FROM documents)
SELECT url, count(*) AS n_rows, first(hint ORDER BY o) FILTER (hint <> '') AS hint, coalesce(first(title ORDER BY o) FILTER (title NOT IN ('UK', '')), last(title ORDER BY o) FILTER (title <> '')) AS title,
 coalesce(first(description ORDER BY o) FILTER (length(description) >= 40), last(description ORDER BY o) FILTER (description <> '')) AS description, (SELECT string_agg(x.label, ',' ORDER BY x.m) FROM (SELECT label, min(o) AS m FROM c c2 WHERE c2.url = c.url GROUP BY label) x) AS labels
FROM c GROUP BY url""")
def merge_candidates(t: Tables) -> DataFrame:
    """One record per key; keys are hot here (twenty sources hold all documents)."""
    rows = t.documents.select(
        F.col("source").alias("url"), F.col("doc_id").alias("o"),
        F.when(F.col("lang") == "de", "UK").when(F.col("lang") == "es", "").otherwise(F.concat("lang", F.col("doc_id").cast("string"))).alias("title"),
        F.col("text").alias("description"),
        F.when(F.col("lang") == "fr", F.concat(F.lit("hint"), F.col("doc_id").cast("string"))).otherwise("").alias("hint"), F.col("lang").alias("label"))
    out = lookups.merge_candidates(rows, "url", "o", ["hint"], "title", "description", ["label"])
    return out.withColumn("labels", F.array_join("labels", ","))


@query("title_suffix", """SELECT doc_id, CASE WHEN lang IN ('en', 'fr') THEN 'Title ' || doc_id ELSE 'Title ' || doc_id || ' - other' END AS title FROM documents""")
def title_suffix(t: Tables) -> DataFrame:
    """Site names and known hints after the last separator go, other suffixes stay."""
    tail = F.when(F.col("lang") == "en", " | Src Site").when(F.col("lang") == "fr", " — Agência").otherwise(" - other")
    title = F.concat(F.lit("Title "), F.col("doc_id").cast("string"), tail)
    return t.documents.select("doc_id", text.strip_suffix(title, F.lit("The SRC SITE online"), ["agencia"]).alias("title"))


@query("noise_pages", """SELECT doc_id FROM documents WHERE lang = 'es' OR source = 'src7'""")
def noise_pages(t: Tables) -> DataFrame:
    """Legal, feed and listing pages by path or title."""
    url = F.concat(F.lit("https://x.example/"), F.when(F.col("lang") == "es", "Feed/").otherwise("news/"), F.col("doc_id").cast("string"))
    title = F.when(F.col("source") == "src7", "Política  de Privacidade").otherwise("News")
    return t.documents.filter(clean.is_noise(url, title)).select("doc_id")


PERSON = classify.PersonRules(
    names=["Of the", "And the"], context=["whou", "hand"], profile_domains=["src3.example"], author_domains=["src4.example"],
    dropped_domains=["src5.example"], exact_queries=["of the"])
ITEM_SQL = f"""it AS (SELECT doc_id, 'https://' || source || '.example/' || CASE WHEN lang = 'es' THEN 'staff/' ELSE '' END || doc_id AS url, source || '.example' AS host,
  CASE WHEN n_chars > 3000 THEN 'Podcast ' || doc_id WHEN n_chars > 1500 THEN 'Title ' || source ELSE 'Workshop ' || doc_id END AS title, trim(regexp_replace(regexp_replace(lower(strip_accents(text)), '[^\\x00-\\x7F]', '', 'g'), '\\s+', ' ', 'g')) AS b,
  CASE WHEN lang = 'de' THEN 'And the' ELSE '' END AS author, CASE WHEN source = 'src6' THEN 'of the' ELSE 'other' END AS q, CASE WHEN source = 'src9' AND lang = 'en' THEN 'echo' ELSE '' END AS hint FROM documents),
m AS (SELECT *, contains(b, 'of the') OR contains(b, 'and the') OR lang_author AS named, contains(b, 'whou') OR contains(b, 'hand') AS ctx, lang_author AS byline FROM (SELECT *, author <> '' AS lang_author FROM it)),
s AS (SELECT *, CASE WHEN hint <> '' THEN 2 ELSE 0 END + CASE WHEN named THEN 3 ELSE 0 END + CASE WHEN ctx THEN 2 ELSE 0 END + CASE WHEN byline THEN 4 ELSE 0 END
  + CASE WHEN cred THEN 4 ELSE 0 END + CASE WHEN host = 'src3.example' THEN 1 ELSE 0 END AS score
 FROM (SELECT *, host = 'src4.example' AND (contains(b, 'of the') OR contains(b, 'and the')) AS cred FROM m))"""


def items(t: Tables) -> DataFrame:
    n = F.col("doc_id").cast("string")
    return t.documents.select(
        "doc_id", F.concat(F.lit("https://"), F.col("source"), F.lit(".example/"), F.when(F.col("lang") == "es", "staff/").otherwise(""), n).alias("url"),
        F.when(F.col("n_chars") > 3000, F.concat(F.lit("Podcast "), n)).when(F.col("n_chars") > 1500, F.concat(F.lit("Title "), F.col("source"))).otherwise(F.concat(F.lit("Workshop "), n)).alias("title"),
        F.lit("").alias("description"), F.col("text").alias("text_excerpt"), F.when(F.col("lang") == "de", F.array(F.lit("And the"))).alias("author_names"),
        F.lit("").alias("notes"), F.lit("").alias("site_name"), F.array(F.when(F.col("source") == "src6", '"Of the"').otherwise("other")).alias("queries"),
        F.lit("").alias("relation_hint"), F.when((F.col("source") == "src9") & (F.col("lang") == "en"), "echo").otherwise("").alias("category_hint"),
        F.array(F.lit("page:crawl")).alias("source_labels"))


@query("identity_score", f"""WITH {ITEM_SQL} SELECT doc_id, score::INTEGER AS match_score, named, ctx, byline, cred FROM s""")
def identity_score(t: Tables) -> DataFrame:
    rows = classify.identity_score(items(t), PERSON)
    return rows.select(
        "doc_id", "match_score", (F.size("matched_names") > 0).alias("named"), (F.size("matched_context") > 0).alias("ctx"),
        F.col("has_byline").alias("byline"), F.col("has_credit").alias("cred"))


CAT_SQL = f"""{ITEM_SQL}, c AS (SELECT *, CASE WHEN hint <> '' THEN hint WHEN byline OR cred THEN 'authored' WHEN contains(lower(title), 'workshop') THEN 'talk' WHEN contains(lower(title), 'podcast') THEN 'interview'
  WHEN host = 'src3.example' OR contains(url, '/staff/') THEN 'profile' WHEN named AND q = 'of the' THEN 'mention' WHEN named AND ctx THEN 'mention' END AS category FROM s WHERE host <> 'src5.example' AND score >= 2),
kept AS (SELECT * FROM c WHERE category IS NOT NULL)"""


@query("classify_items", f"""WITH {CAT_SQL} SELECT doc_id, category, score::INTEGER AS match_score FROM kept""")
def classify_items(t: Tables) -> DataFrame:
    rows = classify.classify_items(classify.identity_score(items(t), PERSON), PERSON)
    return rows.select("doc_id", "category", "match_score")


@query("republished", f"""WITH {CAT_SQL}, au AS (SELECT DISTINCT title FROM kept WHERE category = 'authored')
SELECT doc_id, CASE WHEN category = 'mention' AND title IN (FROM au) THEN 'republication' ELSE category END AS category,
 CASE WHEN category = 'mention' AND title IN (FROM au) THEN 'republication / syndication' WHEN category = 'authored' THEN 'author' WHEN category = 'talk' THEN 'speaker' WHEN category = 'interview' THEN 'interviewee'
  WHEN category = 'profile' THEN 'profile' WHEN category = 'echo' THEN 'follow-up of own work' ELSE 'mentioned' END AS relation FROM kept""")
def republished(t: Tables) -> DataFrame:
    """Both passes."""
    return plan.classified(items(t), PERSON).select("doc_id", "category", "relation")


def _archive(t: Tables) -> DataFrame:
    dated = t.orders.select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").cast("date").alias("published_at"))
    return plan.classified(items(t), PERSON).join(dated, "doc_id", "left").withColumn("first_seen_at", F.col("doc_id"))


ARCH_SQL = f"""{CAT_SQL}, ar AS (SELECT doc_id, title, score, CASE WHEN category = 'mention' AND title IN (SELECT title FROM kept WHERE category = 'authored') THEN 'republication' ELSE category END AS category, CAST(o_orderdate AS DATE) AS d
 FROM kept LEFT JOIN orders ON o_orderkey = doc_id)"""
ASOF = dt.date(1999, 6, 30)


@query("archive_sections", f"""WITH {ARCH_SQL}, o AS (SELECT unnest(['authored','republication','echo','quoted','mention','interview','talk','profile']) AS category, unnest(range(0, 8))::INTEGER AS ordinal)
SELECT ordinal, o.category, count(ar.doc_id) AS n, count(*) FILTER (d IS NOT NULL AND ar.category <> 'profile' AND DATE '1999-06-30' - d BETWEEN 0 AND 365) AS n_recent FROM o LEFT JOIN ar ON ar.category = o.category GROUP BY ALL""")
def archive_sections(t: Tables) -> DataFrame:
    return plan.sections(_archive(t), ASOF, 365)


@query("latest_items", f"""WITH {ARCH_SQL} SELECT doc_id, CAST(d AS VARCHAR) AS published, category FROM ar WHERE category <> 'profile' AND DATE '1999-06-30' - d BETWEEN 0 AND 365 ORDER BY d DESC, doc_id DESC LIMIT 12""")
def latest_items(t: Tables) -> DataFrame:
    return plan.latest_items(_archive(t), ASOF, 365).select("doc_id", F.col("published_at").cast("string").alias("published"), "category")


@query("category_counts", f"""WITH {ARCH_SQL}, cc AS (SELECT category AS label, count(*) AS n FROM ar GROUP BY ALL)
SELECT 'category' AS dimension, label, coalesce(n, 0)::BIGINT AS n FROM (SELECT unnest(['authored','talk','interview','profile','quoted','echo','republication','mention']) AS label) LEFT JOIN cc USING (label)""")
def category_counts(t: Tables) -> DataFrame:
    """Zero-filled category counts."""
    return plan.metadata(_archive(t), ASOF)["counts"].filter("dimension = 'category'")


@query("page_metadata")
def page_metadata(t: Tables) -> DataFrame:
    """Title, description, links, authors and excerpt of whole pages."""
    rows = plan.page_metadata(t.pages, ["Of the"])
    return rows.withColumns({"author_names": F.array_join("author_names", "|"), "published_at": F.col("published_at").cast("string")})


@query("document_pages")
def document_pages(t: Tables) -> DataFrame:
    """Record fields and body lines of document pages."""
    from civisight.plans.corpus import document_pages as parse

    return parse(t.pages, 2030).withColumn("date", F.col("date").cast("string"))
