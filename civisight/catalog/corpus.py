"""Corpus operators on documents, with people whose names open the benchmark passages."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civisight.catalog.base import Tables, query
from civisight.functions import dates, text
from civisight.operators import clean, entities, lookups, profiles, search
from civisight.plans import corpus as plan
from civisight.session import settle

FOLD = "trim(regexp_replace(lower(strip_accents({c})), '\\s+', ' ', 'g'))"
KEY = "trim(regexp_replace(lower(strip_accents({c})), '[^a-z0-9]+', ' ', 'g'))"
MONTHS = "['janeiro','fevereiro','março','abril','maio','junho','julho','agosto','setembro','outubro','novembro','dezembro']"


# --------------------------------------------------------------------- text

@query("folded_texts", f"""SELECT doc_id, md5({FOLD.format(c='text')}) AS folded, md5({KEY.format(c='text')}) AS match_text, md5(replace({KEY.format(c='text')}, ' ', '')) AS compact,
 md5(upper({KEY.format(c='text')})) AS upper_key FROM documents""")
def folded_texts(t: Tables) -> DataFrame:
    """Folding, match text, compact and upper keys over whole texts."""
    return t.documents.select(
        "doc_id", F.md5(text.fold("text").cast("binary")).alias("folded"), F.md5(text.match_text("text").cast("binary")).alias("match_text"),
        F.md5(text.compact_key("text").cast("binary")).alias("compact"), F.md5(text.upper_key(F.regexp_replace("text", "ß", " ")).cast("binary")).alias("upper_key"))


@query("word_counts", r"""SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+'))::INTEGER AS words, length(text)::INTEGER AS text_length FROM documents""")
def word_counts(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", text.word_count("text").alias("words"), "text")
    return clean.lean_items(rows)


@query("excerpts", r"""WITH c AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS x, split_part(trim(text), chr(10), 1) AS l FROM documents)
SELECT doc_id, CASE WHEN length(x) > 280 THEN rtrim(left(x, 277)) || '...' ELSE x END AS excerpt, left(trim(l), 120) AS title, upper(left(x, 1)) || substr(x, 2) AS capped FROM c""")
def excerpts(t: Tables) -> DataFrame:
    return t.documents.select(
        "doc_id", text.truncate("text", 280).alias("excerpt"), text.first_line("text", 120, "(untitled)").alias("title"), text.cap_first(text.clean_text("text")).alias("capped"))


@query("name_windows", f"""WITH c AS (SELECT doc_id, trim(regexp_replace(regexp_replace(lower(strip_accents(text)), '[^\\x00-\\x7F]', '', 'g'), '\\s+', ' ', 'g')) AS f, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS x FROM documents),
p AS (SELECT *, CASE WHEN contains(f, 'of the') AND contains(f, 'and the') THEN least(instr(f, 'of the'), instr(f, 'and the')) WHEN contains(f, 'of the') THEN instr(f, 'of the') WHEN contains(f, 'and the') THEN instr(f, 'and the') END - 1 AS h FROM c)
SELECT doc_id, CASE WHEN h IS NULL THEN left(x, 420) ELSE CASE WHEN h > 180 THEN '... ' ELSE '' END || substr(x, greatest(0, h - 180) + 1, least(length(x), h + 240) - greatest(0, h - 180)) || CASE WHEN h + 240 < length(x) THEN ' ...' ELSE '' END END AS excerpt FROM p""")
def name_windows(t: Tables) -> DataFrame:
    """Window around the first hit of a name."""
    return t.documents.select("doc_id", text.excerpt_around("text", ["Of the", "And the"]).alias("excerpt"))


_SNIPPET_SEGMENTS = r"""list_filter(list_transform(string_split_regex(regexp_replace(coalesce(text, ''), '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(10), 'g'), '\n+'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '')"""


@query("snippets", f"""WITH s AS (SELECT doc_id, coalesce(text, '') AS text, {_SNIPPET_SEGMENTS} AS seg, trim(regexp_replace(left(coalesce(text, ''), 340), '\\s+', ' ', 'g')) AS opening FROM documents),
f AS (SELECT *, list_filter(seg, lambda x: contains({KEY.format(c='x')}, 'of the') OR contains({KEY.format(c='x')}, 'and the'))[1] AS hit FROM s)
SELECT doc_id, CASE WHEN text = '' THEN '' WHEN hit IS NOT NULL THEN CASE WHEN length(hit) > 340 THEN rtrim(left(hit, 337)) || '...' ELSE hit END
 ELSE opening || CASE WHEN length(text) > length(opening) THEN '...' ELSE '' END END AS snippet FROM f""")
def snippets(t: Tables) -> DataFrame:
    """First sentence of a document that holds one of two phrases."""
    return t.documents.select("doc_id", text.snippet("text", F.array(F.lit("of the"), F.lit("and the"))).alias("snippet"))


@query("joined_fields", """SELECT doc_id, CASE WHEN lang = 'en' THEN source ELSE lang || ' ' || source END AS label, upper(left(lang, 1)) || substr(lang, 2) || '/' || upper(left(source, 1)) || substr(source, 2) AS title, lang || '-' || source AS slug FROM documents""")
def joined_fields(t: Tables) -> DataFrame:
    """Non-empty join, title case and slug."""
    return t.documents.select(
        "doc_id", text.join_nonempty(F.when(F.col("lang") != "en", F.col("lang")), "source").alias("label"),
        text.title_case(F.concat_ws("/", "lang", "source")).alias("title"), text.slug(F.concat_ws(" & ", "lang", "source")).alias("slug"))


# -------------------------------------------------------------------- dates

@query("prose_dates", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y') || '-01-01' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date, CASE WHEN o_orderstatus = 'F' THEN 'url-year' ELSE 'text' END AS source FROM orders""")
def prose_dates(t: Tables) -> DataFrame:
    """Dates spelled out, numeric ones behind an impossible one, or only a year in the URL."""
    day = F.col("o_orderdate").cast("date")
    long = F.concat(F.lit("Discurso em São Paulo, "), F.when(F.dayofmonth(day) == 1, "1º").otherwise(F.dayofmonth(day).cast("string")), F.lit(" de "),
                    F.initcap(dates.month_label(F.month(day))), F.lit(" de "), F.year(day).cast("string"))
    short = F.concat(F.lit("visto 31/02/1999, depois "), F.date_format(day, "d/M/yyyy"))
    body = F.when(F.col("o_orderstatus") == "O", long).when(F.col("o_orderstatus") == "P", short).otherwise("sem data")
    url = F.concat(F.lit("https://x.example/"), F.year(day).cast("string"), F.lit("/a"))
    return t.orders.select("o_orderkey", dates.prose_date([F.lit(None).cast("string"), body], url, 2030).alias("d")).select(
        "o_orderkey", F.col("d.date").cast("string").alias("date"), "d.source")


@query("prose_places", """SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'Brasília - ' || o_orderpriority WHEN 'P' THEN 'Recife' END AS place FROM orders""")
def prose_places(t: Tables) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    opening = F.concat(F.lit("Em Brasília - "), F.col("o_orderpriority"), F.lit(", "), F.dayofmonth(day).cast("string"), F.lit(" de março de 2001"))
    inner = F.lit("Fala do presidente em no Recife, no dia 3 de maio de 2003")
    body = F.when(F.col("o_orderstatus") == "O", opening).when(F.col("o_orderstatus") == "P", inner).otherwise("nada")
    return t.orders.select("o_orderkey", dates.prose_place([body, F.lit("")]).alias("place"))


@query("calendar_keys", f"""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, strftime(o_orderdate, '%G-W%V') AS week, CAST(date_trunc('week', o_orderdate)::DATE AS VARCHAR) AS week_start,
 CAST((date_trunc('week', o_orderdate)::DATE + 6) AS VARCHAR) AS week_end, {MONTHS}[month(o_orderdate)] AS month_name, lpad(month(o_orderdate)::VARCHAR, 2, '0') AS month_no FROM orders""")
def calendar_keys(t: Tables) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    week = dates.week_range(day)
    return t.orders.select(
        "o_orderkey", dates.month_key(day).alias("month"), dates.iso_week(day).alias("week"), week["start"].cast("string").alias("week_start"),
        week["end"].cast("string").alias("week_end"), dates.month_label(F.month(day)).alias("month_name"), text.zpad(F.month(day), 2).alias("month_no"))


@query("months_from_parts", """SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity BETWEEN 1 AND 12 THEN '2001-' || lpad(l_quantity::INTEGER::VARCHAR, 2, '0') ELSE strftime(l_shipdate, '%Y-%m') END AS month FROM lineitem""")
def months_from_parts(t: Tables) -> DataFrame:
    """Month out of two columns when valid, else the fallback."""
    return t.lineitem.select("l_orderkey", "l_linenumber", dates.month_from_parts(F.lit("2001"), F.col("l_quantity").cast("int"), dates.month_key("l_shipdate")).alias("month"))


TERMS = [
    {"slug": "F", "start": "1995-01-01", "end": "1996-12-31", "label": "F one"}, {"slug": "F", "start": "1998-01-01", "end": None, "label": "F two"},
    {"slug": "O", "start": "1995-01-01", "end": "1999-12-31", "label": "O only"},
]


@query("term_labels", """WITH x AS (SELECT o_orderkey, o_orderstatus AS s, o_orderpriority AS p, CASE WHEN o_orderpriority = '3-MEDIUM' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS d FROM orders)
SELECT o_orderkey, CASE WHEN s = 'P' AND p = '5-LOW' THEN 'forced' WHEN s = 'F' AND p = '1-URGENT' THEN 'F by url' WHEN s = 'F' AND d BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' THEN 'F one' WHEN s = 'F' AND d >= DATE '1998-01-01' THEN 'F two'
 WHEN s = 'O' AND d <= DATE '1999-12-31' THEN 'O only' WHEN s = 'O' AND d IS NULL THEN 'O only' WHEN s = 'F' AND d IS NULL THEN 'F undated'
 WHEN d IS NOT NULL THEN 'Person ' || s || ' (' || year(d) || ')' ELSE 'Person ' || s || ' (term unknown)' END AS term FROM x""")
def term_labels(t: Tables) -> DataFrame:
    """Term by source, URL segment, date, sole term, or year."""
    rows = t.orders.select(
        "o_orderkey", F.col("o_orderstatus").alias("slug"), F.concat(F.lit("Person "), F.col("o_orderstatus")).alias("person"), F.col("o_orderpriority").alias("source"),
        F.when(F.col("o_orderpriority") != "3-MEDIUM", F.col("o_orderdate").cast("date")).alias("date"), F.concat(F.lit("https://x/"), F.lower("o_orderpriority"), F.lit("/")).alias("url"))
    out = lookups.term_label(rows, "slug", "person", "date", "url", TERMS, [{"slug": "F", "segment": "/1-urgent/", "label": "F by url"}],
                             [{"source": "5-LOW", "slug": "P", "label": "forced"}], {"F": "F undated"})
    return out.select("o_orderkey", "term")


# ------------------------------------------------------------------ records

@query("record_precedence", """WITH p AS (SELECT l_orderkey AS k, max(l_returnflag) FILTER (l_quantity > 40) AS flag, min(l_linestatus) AS st FROM lineitem GROUP BY ALL)
SELECT o_orderkey AS key, coalesce(CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END, flag, 'none') AS title, coalesce(st, o_orderstatus) AS status FROM orders LEFT JOIN p ON k = o_orderkey""")
def record_precedence(t: Tables) -> DataFrame:
    """Listing, then previous, then parsed value, then default; one field is forced to the parsed one."""
    listing = t.orders.select(F.col("o_orderkey").alias("key"), F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise(F.col("o_orderpriority")).alias("title"), F.col("o_orderstatus").alias("status"))
    previous = t.lineitem.filter("l_quantity > 40").groupBy(F.col("l_orderkey").alias("key")).agg(F.max("l_returnflag").alias("title"))
    parsed = t.lineitem.groupBy(F.col("l_orderkey").alias("key")).agg(F.min("l_linestatus").alias("status"))
    return clean.assemble_record(listing, previous, parsed, "key", {"title": "none", "status": None}, forced=["status"])


@query("text_records", """WITH d AS (SELECT doc_id, text, CAST(o_orderdate AS DATE) AS day, CASE WHEN doc_id % 3 = 0 THEN 'Listed ' || doc_id WHEN doc_id % 3 = 1 THEN 'Old ' || doc_id ELSE 'About ' || doc_id END AS title
 FROM documents JOIN orders ON o_orderkey = doc_id WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '')
SELECT doc_id, title, CASE WHEN doc_id % 2 = 0 THEN day ELSE make_date((1950 + doc_id % 50)::INTEGER, 1, 1) END::VARCHAR AS date, CASE WHEN doc_id % 2 = 0 THEN 'text' ELSE 'url-year' END AS date_source,
 CASE WHEN doc_id % 3 = 0 THEN 'listed' ELSE 'library' END AS source, md5(regexp_replace(CASE WHEN doc_id % 2 = 0 THEN strftime(day, '%d/%m/%Y') || chr(10) ELSE '' END || text, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g')) AS text
FROM d WHERE doc_id % 2 = 0 OR NOT regexp_matches(text, '[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2}| de [0-9]{4}')""")
def text_records(t: Tables) -> DataFrame:
    """Records out of landed text files: title by precedence, date by the first lines or the address, source by the listing."""
    dated = t.orders.select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").cast("date").alias("day"))
    head = F.when(F.col("doc_id") % 2 == 0, F.concat(F.date_format("day", "dd/MM/yyyy"), F.lit("\n"))).otherwise("")
    url = F.concat(F.lit("https://library.example/"), (F.lit(1950) + F.col("doc_id") % 50).cast("string"), F.lit("/n"), F.col("doc_id").cast("string"), F.lit(".txt"))
    odd = F.col("text").rlike(r"[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2}| de [0-9]{4}") & (F.col("doc_id") % 2 == 1)
    rows = t.documents.filter(~odd).join(dated, "doc_id").select("doc_id", F.concat(head, F.col("text")).alias("text"), url.alias("url")).filter(text.has_text("text"))
    rows = settle(rows)  # as landed
    kind = F.col("doc_id") % 3
    title = lambda word: F.concat(F.lit(word), F.col("doc_id").cast("string"))
    listing = rows.select("url", F.when(kind == 0, title("Listed ")).alias("title"), F.when(kind == 0, "listed").alias("source"))
    previous = rows.select("url", F.when(kind == 1, title("Old ")).alias("title"), title("About ").alias("description"))
    parsed = plan.text_documents(rows, listing, previous, 2030)
    out = plan.records(listing, previous, parsed, {}, "none", "none", {}, "text", "library", "/x/")
    return out.join(rows.select("url", "doc_id"), "url").select("doc_id", "title", F.col("date").cast("string").alias("date"), "date_source", "source", F.md5("text").alias("text"))


@query("bad_records", """SELECT doc_id FROM documents WHERE (source IN ('src1', 'src2') AND length(trim(text, ' ')) < 400) OR lower(trim(lang)) IN ('', 'es')""")
def bad_records(t: Tables) -> DataFrame:
    """Blocked titles and long-form sources without text."""
    return t.documents.filter(clean.is_bad_record("lang", "text", "source", ["src1", "src2"], ["es"], 400)).select("doc_id")


@query("in_scope", """SELECT doc_id FROM documents WHERE lang = 'fr' OR source IN ('src3', 'src4') OR (lang = 'de' AND doc_id IN (SELECT page_id FROM pages WHERE contains(url, 'spam')))""")
def in_scope(t: Tables) -> DataFrame:
    """Records wanted by period, source, person or URL."""
    rows = t.documents.join(t.pages.select(F.col("page_id").alias("doc_id"), "url"), "doc_id", "left")
    url = F.when(F.col("lang") == "de", F.col("url"))
    return rows.filter(clean.in_scope("lang", "source", F.lit(None).cast("string"), url, ["fr"], ["SRC3", "src4"], ["nobody"], ["SPAM"])).select("doc_id")


@query("corpus_profile", """WITH x AS (SELECT 'lang' AS dimension, lang AS label FROM documents UNION ALL SELECT 'source', source FROM documents),
c AS (SELECT dimension, label, count(*) AS n, dimension = 'lang' AND label IN ('en', 'pt') AS listed FROM x GROUP BY ALL UNION ALL SELECT 'lang', 'pt', 0, true), r AS (SELECT *, row_number() OVER (PARTITION BY dimension, listed ORDER BY n DESC, label) AS rn FROM c)
SELECT dimension, label, n FROM r WHERE rn <= 2 OR listed""")
def corpus_profile(t: Tables) -> DataFrame:
    """Largest labels of several dimensions; listed labels keep their zeros."""
    return profiles.corpus_profile(t.documents, ["lang", "source"], 2, {"lang": ["en", "pt"]})


@query("flag_counts", """SELECT count(*) FILTER (n_chars > 1000) AS long_texts, count(*) FILTER (lang = 'en') AS english, count(*) FILTER (quality IS NULL) AS unlabelled FROM documents LEFT JOIN labels USING (doc_id)""")
def flag_counts(t: Tables) -> DataFrame:
    from civisight.operators.rollups import count_flags

    rows = t.documents.join(t.labels, "doc_id", "left")
    return count_flags(rows, {"long_texts": F.col("n_chars") > 1000, "english": F.col("lang") == "en", "unlabelled": F.col("quality").isNull()})


# ------------------------------------------------------------ index, people

TOK_SQL = f"""tok AS (SELECT doc_id, unnest(list_filter(string_split({KEY.format(c='text')}, ' '), lambda x: x <> '')) AS token FROM documents)"""


@query("inverted_index", f"""WITH {TOK_SQL} SELECT token, doc_id, count(*) AS tf FROM tok GROUP BY ALL""")
def inverted_index(t: Tables) -> DataFrame:
    return search.build_index(t.documents, "doc_id", ["text"])


@query("index_lookup", f"""WITH {TOK_SQL} SELECT doc_id, count(*) AS tf FROM tok WHERE token IN ('the', 'whou') GROUP BY doc_id HAVING count(DISTINCT token) = 2""")
def index_lookup(t: Tables) -> DataFrame:
    postings = search.build_index(t.documents, "doc_id", ["text"])
    return search.search_index(postings, "doc_id", ["The", "whou"])


RULES = entities.AliasRules(pair_kinds=("long",), strict_kinds=("short",), banned=("that",), min_single=5)
ENT_SQL = f"""src AS (SELECT item_id, CASE WHEN length(text) > 230 THEN 'long' ELSE 'short' END AS kind, string_split({KEY.format(c='text')}, ' ') AS w FROM benchmark),
ent AS (SELECT item_id AS id, kind, w[1] || ' ' || w[2] AS name, w[1] || ' ' || w[2] || ' ' || w[3] AS official FROM src)"""


def people(t: Tables) -> DataFrame:
    """Two-word display names and three-word official names from the openings of passages."""
    w = text.match_tokens("text")
    return t.benchmark.select(
        F.col("item_id").alias("id"), F.when(F.length("text") > 230, "long").otherwise("short").alias("kind"),
        F.array_join(F.slice(w, 1, 2), " ").alias("name"), F.array_join(F.slice(w, 1, 3), " ").alias("official_name"), F.array().cast("array<string>").alias("aliases_source"))


PARTS = "['a','as','da','das','de','del','della','di','do','dos','du','e']"
CAND_SQL = f"""{ENT_SQL},
tk AS (SELECT *, list_filter(string_split(name, ' '), lambda x: NOT list_contains({PARTS}, x)) AS d, list_filter(string_split(official, ' '), lambda x: NOT list_contains({PARTS}, x)) AS o FROM ent),
sets AS (SELECT id, kind, o AS v FROM tk WHERE kind = 'long' UNION ALL SELECT id, kind, d FROM tk WHERE kind = 'long' AND d <> o),
ij AS (SELECT id, v, i, j FROM sets, range(1, 4) a(i), range(1, 4) b(j) WHERE i < j AND j <= len(v)),
prs AS (SELECT id, v[i] || ' ' || v[j] AS k FROM ij WHERE ((j = i + 1 OR i = 1 OR j = len(v) OR v[j] IN ('filho','neto','junior')) AND length(v[i]) >= 3 AND length(v[j]) >= 3) OR (i = 1 AND j = len(v))
  OR (j = len(v) AND i = j - 1 AND v[j] IN ('filho','neto','junior'))),
bs AS (SELECT id, CASE WHEN len(d) > 0 THEN d ELSE o END AS b FROM tk WHERE kind = 'long'),
sgl AS (SELECT id, unnest(CASE WHEN len(b) = 2 THEN b ELSE b[1:1] END) AS k FROM bs),
cand AS (SELECT DISTINCT c.id, kind, c.k, name, official FROM (SELECT id, name AS k FROM ent UNION ALL SELECT id, official FROM ent UNION ALL FROM prs UNION ALL FROM sgl) c JOIN ent ON ent.id = c.id WHERE length(c.k) >= 3)"""


@query("alias_candidates", f"""WITH {CAND_SQL} SELECT id AS entity_id, kind, k AS alias_key FROM cand""")
def alias_candidates(t: Tables) -> DataFrame:
    return entities.candidate_aliases(people(t), RULES).select("entity_id", "kind", "alias_key")


OWN_SQL = f"""{CAND_SQL}, ow AS (SELECT k, count(DISTINCT id) AS owners FROM cand GROUP BY k),
tw AS (SELECT token, count(DISTINCT id) AS owners FROM (SELECT id, unnest(list_filter(string_split(k, ' '), lambda x: NOT list_contains({PARTS}, x))) AS token FROM cand) GROUP BY token)"""


@query("alias_owner_counts", f"""WITH {OWN_SQL} SELECT k AS alias_key, owners FROM ow""")
def alias_owner_counts(t: Tables) -> DataFrame:
    return entities.alias_owner_counts(entities.candidate_aliases(people(t), RULES))


@query("token_owner_counts", f"""WITH {OWN_SQL} SELECT token, owners AS token_owners FROM tw""")
def token_owner_counts(t: Tables) -> DataFrame:
    return entities.token_owner_counts(entities.candidate_aliases(people(t), RULES))


@query("alias_table", f"""WITH {OWN_SQL} SELECT id AS entity_id, cand.k AS alias_key, len(string_split(cand.k, ' '))::INTEGER AS n_tokens FROM cand JOIN ow ON ow.k = cand.k LEFT JOIN tw ON tw.token = cand.k
WHERE CASE WHEN contains(cand.k, ' ') THEN (ow.owners <= 1 OR cand.k = name OR cand.k = official) AND NOT (kind = 'short' AND list_contains({PARTS}, split_part(cand.k, ' ', 1)))
 ELSE kind <> 'short' AND length(cand.k) >= 5 AND tw.owners = 1 AND cand.k <> 'that' END""")
def alias_table(t: Tables) -> DataFrame:
    return entities.alias_table(people(t), RULES).select("entity_id", "alias_key", "n_tokens")


# people with exactly two aliases, one inside the other: the long one is placed first, then the
# short one in what is left, each from left to right (also where an alias overlaps itself)
NEST = entities.AliasRules(strict_kinds=("short",))
HIT_SQL = f"""{ENT_SQL}, al AS (SELECT id, name AS k, 2 AS n FROM ent UNION ALL SELECT id, official, 3 FROM ent),
al2 AS (SELECT DISTINCT id, k, n FROM al WHERE NOT list_contains({PARTS}, split_part(k, ' ', 1))),
dt AS (SELECT doc_id, list_filter(string_split({KEY.format(c='text')}, ' '), lambda x: x <> '') AS w FROM documents),
gr AS (SELECT doc_id, unnest(range(1, len(w))) AS i, w FROM dt), h AS (
 SELECT doc_id, id, k, n, i FROM (SELECT doc_id, i, w[i] || ' ' || w[i+1] AS g FROM gr) JOIN al2 ON g = k WHERE n = 2
 UNION ALL SELECT doc_id, id, k, n, i FROM (SELECT doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS g FROM gr WHERE i + 2 <= len(w)) JOIN al2 ON g = k WHERE n = 3),
h3 AS (SELECT doc_id, id, k, i FROM h WHERE n = 3),
n3 AS (SELECT a.doc_id, a.id, a.k, a.i, min(b.i) AS nxt FROM h3 a LEFT JOIN h3 b ON b.doc_id = a.doc_id AND b.id = a.id AND b.k = a.k AND b.i >= a.i + 3 GROUP BY ALL),
a3 AS (SELECT doc_id, id, k, min(i) AS i FROM h3 GROUP BY ALL UNION ALL SELECT a3.doc_id, a3.id, a3.k, nxt FROM a3 JOIN n3 USING (doc_id, id, k, i) WHERE nxt IS NOT NULL),
h2 AS (SELECT doc_id, id, k, i FROM h a WHERE n = 2 AND NOT EXISTS (SELECT 1 FROM a3 b WHERE b.id = a.id AND b.doc_id = a.doc_id AND b.i < a.i + 2 AND a.i < b.i + 3)),
n2 AS (SELECT a.doc_id, a.id, a.k, a.i, min(b.i) AS nxt FROM h2 a LEFT JOIN h2 b ON b.doc_id = a.doc_id AND b.id = a.id AND b.k = a.k AND b.i >= a.i + 2 GROUP BY ALL),
a2 AS (SELECT doc_id, id, k, min(i) AS i FROM h2 GROUP BY ALL UNION ALL SELECT a2.doc_id, a2.id, a2.k, nxt FROM a2 JOIN n2 USING (doc_id, id, k, i) WHERE nxt IS NOT NULL),
hit AS (FROM a3 UNION ALL FROM a2)"""


def _mentions(t: Tables) -> DataFrame:
    names = people(t).withColumn("kind", F.lit("short"))
    return entities.accepted_mentions(entities.alias_hits(t.documents, entities.alias_table(names, NEST)))


@query("mention_counts", f"""WITH RECURSIVE {HIT_SQL} SELECT doc_id, id AS entity_id, count(*) AS occurrences, string_agg(DISTINCT k, '|' ORDER BY k) AS matched_aliases FROM hit GROUP BY ALL""")
def mention_counts(t: Tables) -> DataFrame:
    """Mentions per document and person, overlaps resolved."""
    rows = entities.mention_counts(_mentions(t))
    return rows.withColumn("matched_aliases", F.array_join("matched_aliases", "|"))


@query("entity_directory", f"""WITH RECURSIVE {HIT_SQL}, tot AS (SELECT id, count(*) AS occurrences, count(DISTINCT doc_id) AS docs FROM hit GROUP BY id),
st AS (SELECT id, k, count(*) AS o, count(DISTINCT doc_id) AS d, len(list_filter(string_split(k, ' '), lambda x: NOT list_contains({PARTS}, x))) AS w FROM hit GROUP BY ALL),
best AS (SELECT id, first(k ORDER BY d DESC, o DESC, w DESC, k) AS k FROM st WHERE w >= 2 GROUP BY id)
SELECT id AS entity_id, 'short' AS kind, coalesce(k, name) AS display_name, occurrences, docs FROM tot LEFT JOIN best USING (id) JOIN ent USING (id)""")
def entity_directory(t: Tables) -> DataFrame:
    return entities.entity_directory(_mentions(t), people(t).withColumn("kind", F.lit("short")))


@query("mention_rows")
def mention_rows(t: Tables) -> DataFrame:
    """Mentions with snippet and period keys (general aliases, with overlapping pairs)."""
    names = people(t)
    docs = t.documents.join(t.orders.select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").cast("date").alias("date")), "doc_id", "left").select(
        "doc_id", F.col("source").alias("url"), F.col("lang").alias("title"), "date", "text")
    rows = plan.mention_rows(docs, entities.alias_table(names, RULES), names)
    return rows.withColumns({"matched_aliases": F.array_join("matched_aliases", "|"), "date": F.col("date").cast("string")})
