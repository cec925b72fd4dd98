"""URL expressions on a lenient split, so that dirty URLs never fail a task."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from civisight.functions.text import ColumnOrName, as_col, case_when

_SPLIT = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"

# Query parameters that never identify a page.
TRACKING_PREFIX = "utm_"
TRACKING_PARAMS = ("oc", "gaa_at", "ga_src", "ga_hp")
# Hosts where only some parameters identify a page.
KEEP_PARAMS_BY_HOST = {"youtube.com": ("v", "t", "start")}
# Parameters that page through a listing.
PAGING_PARAMS = ("b_start:int", "page", "pagina")


def url_part(c: ColumnOrName, part: str) -> Column:
    """scheme, host (with port and user, as written), path, query or fragment; ``""`` when absent."""
    index = {"scheme": 1, "host": 2, "path": 3, "query": 4, "fragment": 5}[part]
    return F.regexp_extract(F.coalesce(F.trim(as_col(c)), F.lit("")), _SPLIT, index)


def domain(c: ColumnOrName) -> Column:
    return F.regexp_replace(F.lower(url_part(c, "host")), r"^www\.", "")


def in_domains(host: ColumnOrName, domains: Sequence[str]) -> Column:
    """The host is one of the domains or a subdomain of one."""
    h = as_col(host)
    test = h.isin(list(domains))
    for d in domains:
        test = test | h.endswith("." + d)
    return test


def query_param(c: ColumnOrName, name: str) -> Column:
    """Decoded value of a query parameter, or null."""
    raw = F.regexp_extract(url_part(c, "query"), rf"(?:^|&){name}=([^&]*)", 1)
    return F.when(raw != "", F.coalesce(F.try_url_decode(raw), raw))


def unwrap_url(c: ColumnOrName) -> Column:
    """Target of a search redirect, a video embed, a short video link or an episode embed."""
    url = F.trim(as_col(c))
    url = F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).otherwise(url)
    host, path = F.lower(url_part(url, "host")), url_part(url, "path")
    target = query_param(url, "uddg")
    video = F.element_at(F.split(F.regexp_replace(path, r"/+$", ""), "/"), -1)
    short = F.regexp_replace(path, r"^/+|/+$", "")
    watch = F.lit("https://www.youtube.com/watch?v=")
    return (
        F.when(host.contains("duckduckgo.com") & path.startswith("/l/"),
               F.coalesce(F.try_url_decode(target), target, url))
        .when(host.contains("youtube.com") & path.contains("/embed/"), F.concat(watch, video))
        .when((host == "youtu.be") & (short != ""), F.concat(watch, short))
        .when(host.contains("spotify.com") & path.contains("/embed/episode/"),
              F.replace(url, F.lit("/embed/episode/"), F.lit("/episode/")))
        .otherwise(url)
    )


def aggregator_token(c: ColumnOrName, host: str = "news.google.com") -> Column:
    """Token of an article behind a news aggregator's URL, or null: what follows ``/rss/articles/``, else the last part
    of the path after ``articles`` or ``read``."""
    parts = F.filter(F.split(url_part(c, "path"), "/"), lambda p: p != "")
    at = lambda i: F.try_element_at(parts, F.lit(i))
    feed = (at(1) == "rss") & (at(2) == "articles") & (F.size(parts) >= 3)
    return F.when(F.lower(url_part(c, "host")) == host, F.when(feed, at(3)).when(at(-2).isin("articles", "read"), at(-1)))


def _encode(c: Column) -> Column:
    out = F.url_encode(c)
    return F.replace(F.replace(out, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _pairs(query: Column) -> Column:
    """Array of struct(k, v), decoded, blanks kept, in order."""
    def pair(p: Column) -> Column:
        k, v = F.substring_index(p, "=", 1), F.regexp_replace(p, r"^[^=]*=?", "")
        return F.struct(F.coalesce(F.try_url_decode(k), k).alias("k"), F.coalesce(F.try_url_decode(v), v).alias("v"))
    return F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), pair)


def canonical_url(
    c: ColumnOrName,
    tracking_prefix: str = TRACKING_PREFIX,
    tracking: Sequence[str] = TRACKING_PARAMS,
    keep_by_host: dict[str, Sequence[str]] = KEEP_PARAMS_BY_HOST,
) -> Column:
    """Key of a page: lower host without ``www.``, no tracking, no fragment, no trailing slash."""
    url = unwrap_url(c)
    scheme = F.lower(url_part(url, "scheme"))
    host = domain(url)
    path = url_part(url, "path")
    path = F.when(path == "", "/").when(path == "/", "/").otherwise(F.regexp_replace(path, r"/+$", ""))

    def wanted(p: Column) -> Column:
        key = F.lower(p["k"])
        keep = ~key.startswith(tracking_prefix) & ~key.isin(list(tracking))
        for h, names in keep_by_host.items():
            keep = keep & (~host.contains(h) | key.isin(list(names)))
        return keep

    pairs = F.transform(F.filter(_pairs(url_part(url, "query")), wanted),
                        lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"])))
    query = F.array_join(pairs, "&")
    built = F.concat(
        F.when(scheme == "", "https").otherwise(scheme), F.lit("://"), host, path,
        F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)),
    )
    return F.when(F.coalesce(url, F.lit("")) != "", built)


def article_url(c: ColumnOrName) -> Column:
    """Key of an article: scheme, host and path only."""
    scheme = F.lower(url_part(c, "scheme"))
    built = F.concat(
        F.when(scheme == "", "https").otherwise(scheme), F.lit("://"), F.lower(url_part(c, "host")),
        F.regexp_replace(url_part(c, "path"), r"/+$", ""),
    )
    return F.when(F.coalesce(F.trim(as_col(c)), F.lit("")) != "", built)


def listing_url(c: ColumnOrName, paging: Sequence[str] = PAGING_PARAMS) -> Column:
    """Key of a listing page: an article key plus its paging parameters, sorted."""
    kept = F.array_sort(F.filter(_pairs(url_part(c, "query")), lambda p: F.trim(p["k"]).isin(list(paging))))
    query = F.array_join(F.transform(kept, lambda p: F.concat(F.trim(p["k"]), F.lit("="), F.trim(p["v"]))), "&")
    return F.concat(article_url(c), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def absolute_url(base: ColumnOrName, href: ColumnOrName) -> Column:
    """Resolve a link against its page (absolute, scheme-relative, rooted, relative)."""
    b, h = as_col(base), F.trim(as_col(href))
    root = F.concat(url_part(b, "scheme"), F.lit("://"), url_part(b, "host"))
    folder = F.regexp_replace(url_part(b, "path"), r"[^/]*$", "")
    return (
        F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), h)
        .when(h.startswith("//"), F.concat(url_part(b, "scheme"), F.lit(":"), h))
        .when(h.startswith("/"), F.concat(root, h))
        .otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), h))
    )


def best_link(*cols: ColumnOrName) -> Column:
    """First column that is shaped like a web link."""
    return F.coalesce(*[F.when(F.trim(as_col(c)).rlike(r"^https?://[^\s]+$"), F.trim(as_col(c))) for c in cols])


def link_for_id(prefix: str, c: ColumnOrName) -> Column:
    key = F.trim(as_col(c).cast("string"))
    return F.when(key != "", F.concat(F.lit(prefix), key))


def slug_after(c: ColumnOrName, segment: str) -> Column:
    """Path segment that follows a given one, lower-cased; null when absent."""
    hit = F.lower(F.regexp_extract(url_part(c, "path"), rf"(?:^|/){segment}/+([^/]+)", 1))
    return F.when(hit != "", hit)


def doc_type(url: ColumnOrName, title: ColumnOrName, words: dict[str, str], default: str) -> Column:
    """Document type by the first word found in URL or title."""
    ref = F.lower(F.concat_ws(" ", as_col(url), as_col(title)))
    return case_when([(ref.contains(word), F.lit(label)) for word, label in words.items()], F.lit(default))


def op_meta(text: ColumnOrName, url: ColumnOrName, states: Sequence[str]) -> Column:
    """struct(year, op_num, kind, states) of a labour report, from its title and URL."""
    title, link = F.coalesce(as_col(text), F.lit("")), F.coalesce(as_col(url), F.lit(""))
    both = F.concat_ws(" ", title, link)
    numbered = r"(?i)Op[\s.\-]*(\d+)[\s.\-]+de[\s\-]+(\d{4})"
    yearly = r"(?i)(?:operacoe?s?|relatorios?[\s\-_]op)[\s\-_]+?(\d{4})"
    has_number, has_year = both.rlike(numbered), link.rlike(yearly)
    return F.struct(
        F.when(has_number, F.regexp_extract(both, numbered, 2).try_cast("int"))
        .when(has_year, F.regexp_extract(link, yearly, 1).try_cast("int")).alias("year"),
        F.when(has_number, F.regexp_extract(both, numbered, 1).try_cast("int")).alias("op_num"),
        F.when(has_number, "single").when(has_year, "yearly").otherwise("other").alias("kind"),
        F.array_sort(F.array_distinct(
            F.regexp_extract_all(title, F.lit(rf"\b({'|'.join(states)})\b"), F.lit(1)))).alias("states"),
    )
