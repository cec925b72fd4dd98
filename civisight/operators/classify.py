"""Rule classifiers. A rule table becomes one CASE expression: one pass, whatever its length."""
from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civisight import rules as tables
from civisight.functions.text import ColumnOrName, any_of, as_col, cap_first, case_when, clean_text, fold, fold_text
from civisight.functions.urls import domain, in_domains
from civisight.operators.clean import is_noise


def canonical_label(c: ColumnOrName, labels: Sequence[str], missing: str, other: str, max_len: int = 120) -> Column:
    """Known label, also when followed by more words; long free text goes to one bucket."""
    text, flat = clean_text(c), fold(c)
    known = [((flat == fold_text(x)) | flat.startswith(fold_text(x) + " "), F.lit(x)) for x in labels]
    return case_when([*known, (text.isNull(), F.lit(missing)), (F.length(text) > max_len, F.lit(other))], text)


def canonical_by_map(c: ColumnOrName, mapping: dict[str, str], missing: str, other: str, max_len: int = 180) -> Column:
    """Dictionary form: folded text to label; unknown text keeps its spelling, capitalised."""
    text = clean_text(c)
    table = F.create_map(*[F.lit(x) for k, v in {fold_text(k): v for k, v in mapping.items()}.items() for x in (k, v)])
    return (
        F.when(text.isNull(), F.lit(missing)).when(F.length(text) > max_len, F.lit(other))
        .otherwise(F.coalesce(F.try_element_at(table, fold(text)), cap_first(text))))


def normalize_value(c: ColumnOrName, mapping: dict[str, str]) -> Column:
    """Known spellings to one value; unknown values stay."""
    text = clean_text(c)
    table = F.create_map(*[F.lit(x) for k, v in {fold_text(k): v for k, v in mapping.items()}.items() for x in (k, v)])
    return F.coalesce(F.try_element_at(table, fold(text)), text)


def first_match(c: ColumnOrName, rules: Sequence[tuple[str, Sequence[str]]], default: str, whole_words: bool = False) -> Column:
    """Label of the first rule with a keyword in the lower-cased text (accents kept)."""
    text = F.lower(F.coalesce(as_col(c), F.lit("")))
    tests = [(text.rlike(any_of([w.lower() for w in words], whole_words)), F.lit(label)) for label, words in rules]
    return case_when(tests, F.lit(default))


def keyword_flag(c: ColumnOrName, words: Sequence[str]) -> Column:
    """Any keyword occurs in the folded text."""
    return fold(c).rlike(any_of(sorted({fold_text(w) for w in words})))


# ---------------------------------------------------------------- web items

@dataclass(frozen=True)
class PersonRules:
    """Who is looked for, and the sites around that person. Names are folded once."""
    names: Sequence[str]
    context: Sequence[str] = ()                  # words that make a namesake unlikely
    profile_domains: Sequence[str] = ()
    author_domains: Sequence[str] = ()           # sites whose author page was crawled
    dropped_domains: Sequence[str] = ()          # aggregators and own site
    exact_queries: Sequence[str] = ()
    echo_words: Sequence[str] = ()               # outlet-specific additions
    citation_words: Sequence[str] = ()
    hint_renames: dict[str, str] = field(default_factory=dict)
    categories: dict[str, str] = field(default_factory=lambda: dict(RELATIONS))
    # wording that reveals what an item is; {} stands for the person's name
    event_words: Sequence[str] = tables.EVENT_WORDS
    interview_words: Sequence[str] = tables.INTERVIEW_WORDS
    profile_words: Sequence[str] = tables.PROFILE_WORDS
    profile_paths: Sequence[str] = tables.PROFILE_PATHS
    echo_leads: Sequence[str] = tables.ECHO_LEADS
    echo_by_name: Sequence[str] = tables.ECHO_BY_NAME
    citation_by_name: Sequence[str] = tables.CITATION_BY_NAME
    byline_by_name: Sequence[str] = tables.BYLINE_BY_NAME
    social_hosts: Sequence[str] = tables.SOCIAL_HOSTS


# category -> default relation, in order of precedence
RELATIONS = {
    "authored": "author", "talk": "speaker", "interview": "interviewee", "profile": "profile",
    "quoted": "quoted as source", "echo": "follow-up of own work", "republication": "republication / syndication",
    "mention": "mentioned",
}


def _flat(*cols: ColumnOrName) -> Column:
    parts = [F.coalesce(as_col(c).cast("string"), F.lit("")) for c in cols]
    return fold(F.concat_ws(" ", *parts), ascii_only=True)


def _joined(array: str) -> Column:
    return F.array_join(F.coalesce(F.col(array), F.array().cast("array<string>")), " ")


def _found(hay: Column, words: Sequence[str]) -> Column:
    """Words of the rule table that occur in the text, in table order."""
    if not words:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*[F.when(hay.contains(fold_text(w)), F.lit(w)) for w in words]))


def _templates(templates: Sequence[str], names: Sequence[str]) -> list[str]:
    return [t.format(n) for n in names for t in templates]


def textual_byline(rules: PersonRules) -> Column:
    """The text itself credits the person (needs ``_hay``, the folded title, description and text)."""
    names = [fold_text(n) for n in rules.names]
    hay = F.col("_hay")
    any_name = any_of(names)
    named = hay.rlike(any_name)
    credited = hay.rlike(any_of(_templates(rules.byline_by_name, names)))
    listed = F.regexp_extract(hay, r"author,\s*(.{0,200}?)(?:role,|$)", 1).rlike(any_name)
    crawled = F.lit(False)
    if rules.author_domains:
        crawled = domain("url").isin(list(rules.author_domains)) & _joined("source_labels").contains("crawl") & named
    near = hay.rlike(r"reportera?\b.{0,80}" + any_name) | hay.rlike(r"neste video.{0,40}" + any_name)
    return credited | listed | crawled | near


def identity_score(items: DataFrame, rules: PersonRules) -> DataFrame:
    """Adds how sure it is that an item is about the person: score, matched names and words."""
    names = [fold_text(n) for n in rules.names]
    # long texts are folded once; the rules below read the folded columns
    work = items.withColumns({"_hay": _flat("title", "description", "text_excerpt"), "_by": _flat(_joined("author_names")), "_notes": _flat("notes")})
    work = work.withColumns({
        "_about": F.concat_ws(" ", "_hay", "_by", "_notes"),
        "_wide": F.concat_ws(" ", F.col("_hay"), _flat("site_name"), F.col("_by"), _flat(_joined("queries")), F.col("_notes"), _flat("relation_hint"))})
    work = work.withColumns({
        "matched_names": _found(F.col("_about"), rules.names), "matched_context": _found(F.col("_wide"), rules.context),
        "has_byline": F.col("_by").rlike(any_of(names)), "has_credit": textual_byline(rules),
    }).drop("_hay", "_by", "_notes", "_about", "_wide")
    on_profile = in_domains(domain("url"), rules.profile_domains) if rules.profile_domains else F.lit(False)
    # fixed values: weights of the identity score
    score = (
        F.when(F.coalesce("category_hint", F.lit("")) != "", 2).otherwise(0)
        + F.when(F.size("matched_names") > 0, 3).otherwise(0) + F.when(F.size("matched_context") > 0, 2).otherwise(0)
        + F.when(F.col("has_byline"), 4).otherwise(0) + F.when(F.col("has_credit"), 4).otherwise(0)
        + F.when(on_profile, 1).otherwise(0))
    return work.withColumn("match_score", score)


def classify_items(scored: DataFrame, rules: PersonRules) -> DataFrame:
    """First pass: admission, then the first category that applies. Dropped items are absent."""
    names = [fold_text(n) for n in rules.names]
    host = domain("url")
    scored = scored.withColumns({"_title": _flat("title"), "_full": F.concat_ws(" ", _flat("title", "description", "notes"), _flat("text_excerpt"))})
    title, full = F.col("_title"), F.col("_full")
    hint = F.coalesce("category_hint", F.lit(""))
    for old, new in rules.hint_renames.items():
        hint = F.when(hint == old, F.lit(new)).otherwise(hint)
    signed = F.col("has_byline") | F.col("has_credit")
    stale = (hint == "authored") & ~signed
    hint, relation = F.when(stale, F.lit("")).otherwise(hint), F.when(stale, F.lit("")).otherwise(F.coalesce("relation_hint", F.lit("")))

    named, context = F.size("matched_names") > 0, F.size("matched_context") > 0
    exact = F.exists(
        F.coalesce(F.col("queries"), F.array().cast("array<string>")),
        lambda q: fold(F.replace(q, F.lit('"'), F.lit("")), ascii_only=True).isin([fold_text(x) for x in (rules.exact_queries or rules.names)]))
    on_profile = in_domains(host, rules.profile_domains) if rules.profile_domains else F.lit(False)
    cites = [*_templates(rules.citation_by_name, names), *[fold_text(w) for w in rules.citation_words]]
    echoes = [*rules.echo_leads, *_templates(rules.echo_by_name, names), *[fold_text(w) for w in rules.echo_words]]
    category = (
        F.when(hint != "", hint)
        .when(signed, "authored").when(title.rlike(any_of(rules.event_words)), "talk").when(title.rlike(any_of(rules.interview_words)), "interview")
        .when(on_profile | F.col("url").rlike("|".join(map(re.escape, rules.profile_paths))) | title.rlike(any_of(rules.profile_words)), "profile")
        .when(named & full.rlike(any_of(cites)), "quoted").when(full.rlike(any_of(echoes)), "echo")
        .when(named & exact, "mention").when(named & context, "mention"))
    admitted = (
        ~host.isin(list(rules.dropped_domains) or [""]) & ~is_noise("url", "title") & (F.col("match_score") >= 2)
        & ~(host.isin(list(rules.social_hosts)) & (F.col("match_score") < 4)))
    # exploding one or no category drops the rest, like a filter, but is not pushed below the
    # folded columns, where the rule chain would fold the text again for every rule
    chosen = F.array_compact(F.array(F.when(admitted, category)))
    out = scored.select(*scored.columns, F.explode(chosen).alias("category"))
    return out.withColumn("relation", _relation(F.col("category"), relation, rules)).withColumn("domain", host).drop("_title", "_full")


def _relation(category: Column, given: Column, rules: PersonRules) -> Column:
    named = [(category == name, F.lit(label)) for name, label in rules.categories.items()]
    return case_when([(given != "", given), *named], F.lit("mentioned"))


def mark_republished(items: DataFrame, rules: PersonRules) -> DataFrame:
    """Second pass: an unhinted mention with the title of an authored item is a republication."""
    key = _flat("title")
    titles = items.filter("category = 'authored'").select(key.alias("_key")).filter("_key <> ''").distinct().withColumn("_authored", F.lit(True))
    work = items.withColumn("_key", key).join(titles, "_key", "left")
    again = (F.col("category") == "mention") & (F.coalesce("category_hint", F.lit("")) == "") & F.col("_authored")
    given = F.coalesce("relation_hint", F.lit(""))
    return work.withColumns({
        "relation": F.when(again, _relation(F.lit("republication"), given, rules)).otherwise(F.col("relation")),
        "category": F.when(again, F.lit("republication")).otherwise(F.col("category")),
    }).drop("_key", "_authored")


def classify_two_pass(items: DataFrame, rules: PersonRules) -> DataFrame:
    return mark_republished(classify_items(identity_score(items, rules), rules), rules)
