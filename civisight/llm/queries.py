"""Registered queries of this package, next to SQL where SQL can express them."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civisight.llm.common import prepare
from civisight.llm.decontamination import template_matches
from civisight.llm.exact_dedup import exact_groups
from civisight.llm.hard_negatives import hard_negatives
from civisight.llm.langid import predict_languages
from civisight.llm.licenses import RULES, SENTENCES, license_matches
from civisight.llm.line_dedup import line_dedup
from civisight.llm.lm_score import lm_scores
from civisight.llm.ngram_join import ngram_components
from civisight.llm.packing import pack_documents
from civisight.llm.periodic import periodic_runs, run_digests, tile_words
from civisight.llm.quality import quality_scores
from civisight.llm.quality_rules import quality_rules
from civisight.llm.substring_dedup import substring_dedup


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_components(_table(spark, folder, "documents"))


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(_table(spark, folder, "documents"))


def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality_scores(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op4_langid(spark: SparkSession, folder: str) -> DataFrame:
    return predict_languages(_table(spark, folder, "documents"))


def op5_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    return lm_scores(_table(spark, folder, "documents"))


def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return template_matches(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op7_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_groups(_table(spark, folder, "documents"))


def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = line_dedup(_table(spark, folder, "documents"))
    return out.withColumn("kept_sha256", F.sha2(F.coalesce("kept_text", F.lit("")), 256)).drop("kept_text", "longest_run")


def op9_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return license_matches(_table(spark, folder, "documents"))


def op10_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup(_table(spark, folder, "documents")).drop("kept_text")


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return run_digests(periodic_runs(tile_words(_table(spark, folder, "documents"))))


def op12_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules(_table(spark, folder, "documents"))


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = _table(spark, folder, "embeddings")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", shifted), anchor=F.col("vec_id") % 100 == 0)


QUERIES = {f.__name__: f for f in (op1_ngram_join, op2_packing, op3_quality, op4_langid, op5_lm_score, op6_decontamination,
                                  op7_exact_dedup, op8_line_dedup, op9_licenses, op10_substring_dedup, op11_periodic_runs,
                                  op12_quality_rules, op13_hard_negatives)}

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_BLANK = "' ' || chr(9) || chr(13) || chr(11) || chr(12)"
_SENTENCES = ", ".join(f"('{i}', '{s}')" for i, s in SENTENCES.items())
_STEPS = ", ".join(f"('{r}', {k}, '{i}', {len(ids)})" for r, ids in RULES.items() for k, i in enumerate(ids))

ORACLES = {
    "op1_ngram_join": f"""
        with recursive w as (select doc_id, {_WORDS.format(_LOW)} as t from documents),
        g as (select doc_id, list_distinct(case when len(t) = 0 then [] when len(t) < 5 then [array_to_string(t, ' ')]
              else list_transform(range(1, len(t) - 3), lambda p: array_to_string(t[p:p + 4], ' ')) end) as s from w),
        u as (select doc_id, len(s) as n, unnest(s) as x from g),
        e as (select a.doc_id as p, b.doc_id as q from u a join u b on a.x = b.x and a.doc_id < b.doc_id
              group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
        links as (select p, q from e union all select q, p from e),
        reach as (select doc_id as p, doc_id as q from documents union select r.p, b.q from reach r join links b on r.q = b.p)
        select doc_id, len(s)::bigint as n_shingles, (select min(q) from reach where p = doc_id) as component_id from g""",
    "op7_exact_dedup": f"""
        select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
               doc_id = max(doc_id) over g as kept, sha256({_LOW}) as text_sha256
        from documents window g as (partition by {_LOW})""",
    "op8_line_dedup": f"""
        with l as (select doc_id, unnest(list_zip(string_split(text, chr(10)), range(len(string_split(text, chr(10)))))) as z from documents),
        n as (select doc_id, z[1] as raw, z[2] as number, trim(z[1], {_BLANK}) as line from l),
        b as (select doc_id, number, line, row_number() over (partition by doc_id order by number) as place from n where line <> ''),
        v as (select *, lead(line) over (partition by doc_id order by place) as next_line from b),
        f as (select *, min(struct_pack(d := doc_id, a := place)) over (partition by line, next_line) as first from v where next_line is not null),
        c as (select doc_id, place from f where first <> struct_pack(d := doc_id, a := place)),
        gone as (select distinct b.doc_id, b.number from b join c on b.doc_id = c.doc_id and b.place in (c.place, c.place + 1)),
        m as (select n.*, gone.number is not null as cut from n left join gone using (doc_id, number)),
        k as (select doc_id, count(*) as n_lines, count(*) filter (cut) as n_removed,
              coalesce(string_agg(raw, chr(10) order by number) filter (not cut), '') as kept from m group by doc_id)
        select doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
        from documents left join k using (doc_id)""",
    "op9_licenses": f"""
        with known(sentence_id, sentence) as (values {_SENTENCES}), steps(license_id, step, sentence_id, steps) as (values {_STEPS}),
        t as (select doc_id, string_split_regex(regexp_replace(text, '([.!?])[ \t\r]+', '\1' || chr(10), 'g'), '\n+') as s from documents),
        u as (select doc_id, unnest(list_zip(s, range(len(s)))) as z from t),
        r as (select doc_id, z[2] as number, sentence_id, row_number() over (partition by doc_id order by z[2]) as place
              from u join known on trim(regexp_replace(lower(z[1]), '[^a-z0-9]+', ' ', 'g')) = sentence),
        m as (select doc_id, license_id, place - step as begin, min(number) as number from r join steps using (sentence_id)
              group by doc_id, license_id, place - step, steps having count(distinct step) = steps)
        select doc_id, license_id, count(*) as n_matches, min(number) as first_sentence from m group by doc_id, license_id""",
    "op10_substring_dedup": f"""
        with w as (select doc_id, {_WORDS.format("coalesce(text, '')")} as t from documents),
        g as (select doc_id, list_transform(range(1, greatest(len(t) - 11, 1)), lambda p: struct_pack(p := p, s := array_to_string(t[p:p + 12], ' '))) as s from w),
        u as (select doc_id, unnest(s, recursive := true) from g),
        m as (select doc_id, p, min(doc_id) over (partition by s) as f from u),
        r as (select distinct doc_id, unnest(range(p, p + 13)) as q from m where f < doc_id),
        x as (select doc_id, list(q) as gone from r group by doc_id)
        select doc_id, len(t)::bigint as n_words, coalesce(len(gone), 0)::bigint as n_removed,
               sha256(array_to_string(case when gone is null then t else list_filter(t, lambda v, i: not list_contains(gone, i)) end, ' ')) as kept_sha256
        from w left join x using (doc_id)""",
    "op12_quality_rules": f"""
        with t as (select rowid as r, doc_id, source, coalesce(text, '') as text from (select row_number() over () as rowid, * from documents)),
        w as (select r, {_WORDS.format("text")} as w from t),
        g as (select r, list_transform(range(1, greatest(len(w) - 1, 1)), lambda p: struct_pack(p := p, s := array_to_string(w[p:p + 2], ' '))) as s from w),
        u as (select r, unnest(s, recursive := true) from g),
        m as (select r, p, count(*) over (partition by r, s) as n from u),
        rep as (select r, count(distinct q) as n_repeat_words from (select r, unnest([p, p + 1, p + 2]) as q from m where n > 1) group by r),
        raw as (select r, unnest(string_split(text, chr(10))) as line from t),
        norm as (select r, line, trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'), '[ 	]+', ' ', 'g')) as l from raw),
        lines as (select norm.*, source, text from norm join t using (r) where l <> ''),
        dup as (select r, count(*) - count(distinct line) as n_dup_lines from lines group by r),
        hosts as (select source, count(distinct text) as all_texts from t group by source),
        high as (select source, l from lines group by source, l having count(distinct text) > 10),
        seen as (select source, l, count(distinct text) as n from lines semi join high using (source, l) group by source, l),
        over_limit as (select source, l from seen join hosts using (source) where 100 * n > 5 * all_texts),
        gone as (select r, count(*) as n_lines_removed, sum(len(string_split(l, ' '))) as n_words_removed from lines join over_limit using (source, l) group by r),
        f as (select doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
              (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines,
              coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(n_lines_removed, 0) as n_lines_removed, coalesce(n_words_removed, 0)::bigint as n_words_removed
              from t join w using (r) left join rep using (r) left join dup using (r) left join gone using (r)),
        b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from f)
        select *, not base_failed and n_words - n_words_removed >= 50 and 100 * n_words_removed <= 50 * n_words as kept from b""",
    "op13_hard_negatives": """
        with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, embedding from embeddings
              where vec_id is not null and label is not null and embedding is not null
              and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))),
        e as (select vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)) as x from v),
        s as (select a.vec_id as a, a.label as la, b.vec_id as b, b.label as lb, list_inner_product(a.x, b.x)::bigint as score
              from e a, e b where a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
        p as (select a, b, la, score from s where la = lb qualify row_number() over (partition by a order by score desc, b) <= 5)
        select p.a as anchor_id, p.b as positive_id, row_number() over (partition by p.a, p.b order by s.score desc, s.b)::int as rank,
               s.b as negative_id, p.score as positive_score, s.score as negative_score
        from p join s on p.a = s.a and s.lb <> p.la and 100 * s.score between 80 * p.score and 100 * p.score
        qualify rank <= 5""",
}
