"""Polls, questionnaires, labour reports and job adverts: normalise, dedupe, find what is new."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civisight import rules
from civisight.functions.arrays import content_hash
from civisight.functions.dates import parse_timestamp
from civisight.functions.html import links, repair_json, without_code
from civisight.functions.money import optional_int, parse_money
from civisight.functions.text import clean_text, format_id, strip_tags
from civisight.functions.urls import absolute_url, op_meta
from civisight.operators import clean, lookups, ranking, state, windows

# Null markers of the poll registry.
POLL_NULLS = ("#NULO#", "#NE#", "#NULO", "#NE")
# Statuses of an extracted report.
RESCUE_STATUS = ("com_resgate", "sem_resgate")
REPORT_SCHEMA = (
    "empresa string, cnpj_cpf string, trabalhadores_resgatados string, tipo_trabalho string, municipio string, uf string, "
    "data_fatos string, resumo string, punicao string, resgate_status string"
)
# Places wanted and not wanted in job adverts.
HOME_PLACES = (
    "united kingdom", "uk", "london", "england", "scotland", "wales", "northern ireland", "oxford", "cambridge", "manchester",
    "edinburgh", "glasgow", "belfast", "cardiff", "bristol", "birmingham", "leeds", "liverpool", "newcastle", "sheffield",
    "nottingham", "brighton", "various in the uk",
)
AWAY_PATTERNS = (
    r"\bin (?:the )?(?:u\.?s\.?|usa|united states)\b",
    r"\b(?:u\.?s\.?|usa)[ -]?(?:only|based)\b",
    r"\b(?:africa|asia|europe|latin america|middle east|oceania)\b",
    r"\b(?:india|canada|australia|new zealand|germany|france|spain|italy|brazil|mexico|argentina|colombia|chile|peru|japan|china|"
    r"singapore|philippines|indonesia|south korea|nigeria|kenya|south africa|uganda|tanzania|rwanda|egypt|israel|turkey|ukraine|"
    r"poland|netherlands|sweden|norway|denmark|finland|switzerland|ireland)\b",
)


def landed_polls(raw: DataFrame, state_code: str = "BR") -> DataFrame:
    """National polls, typed, undated last."""
    text = lambda c: clean_text(c, POLL_NULLS)
    typed = raw.filter(F.trim("SG_UF") == state_code).select(
        text("NR_PROTOCOLO_REGISTRO").alias("id"), format_id("NR_PROTOCOLO_REGISTRO").alias("protocol"), text("SG_UF").alias("state"), text("NM_UE").alias("place"), text("DS_CARGO").alias("office"),
        *[parse_timestamp(text(c)).alias(n) for c, n in (
            ("DT_REGISTRO", "registered"), ("DT_INICIO_PESQUISA", "field_start"), ("DT_FIM_PESQUISA", "field_end"), ("DT_DIVULGACAO", "published"))],
        F.coalesce(text("NM_EMPRESA_FANTASIA"), text("NM_EMPRESA")).alias("company"), text("NR_CNPJ_EMPRESA").alias("company_document"),
        optional_int("QT_ENTREVISTADO").alias("interviews"), parse_money("VR_PESQUISA").alias("cost"), text("NM_ESTATISTICO_RESP").alias("statistician"),
        (F.upper(F.trim("ST_PESQUISA_PROPRIA")) == "S").alias("own_poll"), text("DS_METODOLOGIA_PESQUISA").alias("method"), text("DS_PLANO_AMOSTRAL").alias("sample_plan"))
    return typed.filter("id is not null")


def export_polls(polls: DataFrame) -> DataFrame:
    return ranking.export_order(polls, [("published", True), ("registered", True), ("id", True)])


def poll_alerts(polls: DataFrame, seen: DataFrame, first_run: bool) -> DataFrame:
    return lookups.new_keys(polls, seen, ["id"], first_run)


def questionnaire_targets(polls: DataFrame, status: DataFrame, retry_errors: bool = False) -> DataFrame:
    return state.next_targets(polls.select("id"), status, "id", retry_errors)


def questionnaire_status(observed: DataFrame) -> DataFrame:
    """(id, status, sha256, ...) of attempts: ``outcome``, ``text`` and ``content`` are inputs."""
    return observed.withColumns({
        "status": state.observed_status(F.col("outcome"), F.col("text")), "sha256": content_hash("content"),
        "txt_bytes": F.octet_length("text"), "pdf_bytes": F.octet_length("content")})


def report_list(pages: DataFrame, states: Sequence[str] = rules.STATES) -> DataFrame:
    """Reports linked from landed pages (``url``, ``html``): one row per link, first title kept."""
    rows = pages.select(F.col("url").alias("origin"), F.posexplode(links(without_code("html"))).alias("pos", "link"))
    rows = rows.select(
        absolute_url("origin", "link.href").alias("url"), strip_tags("link.text").alias("title"), "origin", F.struct("origin", "pos").alias("row_no"))
    first = windows.dedupe_first(rows.filter(F.lower("url").rlike(r"\.pdf($|[?#])|@@download|/view$")), ["url"], "row_no")
    return first.withColumn("m", op_meta("title", "url", states)).select("url", "title", "origin", "m.year", "m.op_num", F.col("m.kind").alias("kind"), "m.states")


def extracted_reports(replies: DataFrame) -> DataFrame:
    """(url, reply) to typed records; an unreadable reply becomes an error row."""
    parsed = replies.withColumn("p", repair_json("reply", REPORT_SCHEMA))
    rows = parsed.select("url", F.when(F.col("p.ok"), F.lit(None)).otherwise("unreadable").cast("string").alias("error"), "p.value.*")
    fields = ["empresa", "cnpj_cpf", "tipo_trabalho", "municipio", "data_fatos", "resumo", "punicao"]
    clean_rows = clean.sanitize_record(rows, fields, ["trabalhadores_resgatados"], "uf", "resgate_status", RESCUE_STATUS)
    return clean_rows.withColumns({"empresa": clean.blank_echo("empresa", "nome da empresa"), "cnpj_cpf": clean.blank_echo("cnpj_cpf", "cnpj", "aparec")})


def job_alerts(jobs: DataFrame, seen: DataFrame, first_run: bool, places: Sequence[str] = HOME_PLACES, away: Sequence[str] = AWAY_PATTERNS) -> DataFrame:
    """Eligible adverts with a URL not seen before."""
    fitting = jobs.filter(clean.eligible_place("location", places, "remote", away, whole_words=["uk"]))
    return lookups.new_keys(fitting, seen, ["url"], first_run)


def slots(df: DataFrame, column: str = "slots") -> DataFrame:
    """map<date, array<struct<start, end, avail>>> to rows."""
    days = df.select(F.explode(column).alias("date", "list"))
    return days.select("date", F.explode("list").alias("s")).select("date", "s.*")
