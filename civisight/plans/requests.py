"""Information requests: denial and restriction rates, concentration, alerts."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civisight import rules
from civisight.functions.dates import parse_date
from civisight.functions.money import ratio
from civisight.functions.text import any_of, clean_text, fold_text, join_nonempty, truncate
from civisight.functions.urls import best_link, link_for_id
from civisight.operators import classify, concentration, lookups, rollups, spines

LANDED = (
    "IdPedido", "IdSolicitante", "DataRegistro", "OrgaoDestinatario", "AssuntoPedido", "ResumoSolicitacao",
    "DetalhamentoSolicitacao", "Resposta", "Decisao", "EspecificacaoDecisao", "DetalhamentoDecisao", "MotivoNegativaAcesso",
)
MASKS = ("total", "denied", "restricted", "personal")


def landed_requests(raw: DataFrame, themes: Sequence[tuple[str, Sequence[str]]] = rules.THEMES, year: int | None = None, whole_words: bool = False) -> DataFrame:
    """Typed projection of a landed request file (columns of ``LANDED``, absent ones null)."""
    decision = classify.canonical_label("Decisao", rules.DECISIONS, rules.NO_DECISION, rules.FREE_TEXT, 120)
    reason = classify.canonical_by_map(
        F.coalesce(clean_text("EspecificacaoDecisao"), clean_text("MotivoNegativaAcesso")), rules.REASONS, rules.NO_REASON, rules.FREE_TEXT, 180)
    text = join_nonempty("AssuntoPedido", "ResumoSolicitacao", "DetalhamentoSolicitacao")
    day = parse_date(F.substring(clean_text("DataRegistro"), 1, 10))
    requester = clean_text("IdSolicitante", ["0"])
    return with_masks(raw.select(
        clean_text("IdPedido").alias("id"), requester.alias("requester"), clean_text("OrgaoDestinatario").alias("body"), day.alias("date"),
        (F.lit(year) if year else F.year(day)).alias("year"), F.month(day).alias("month"), decision.alias("decision"), reason.alias("reason"),
        clean_text("AssuntoPedido").alias("subject"), text.alias("request_text"),
        join_nonempty("Resposta", "DetalhamentoDecisao").alias("response_text"),
        classify.first_match(text, themes, rules.OTHER_THEMES, whole_words).alias("theme"),
    ))


def with_masks(df: DataFrame, denied: Column | None = None, restricted: Column | None = None, personal: Column | None = None) -> DataFrame:
    """Boolean columns: denied, restricted (wider) and personal (within restricted)."""
    denied = denied if denied is not None else F.col("decision") == rules.DENIED
    restricted = restricted if restricted is not None else F.col("decision").isin(list(rules.RESTRICTED))
    personal = personal if personal is not None else classify.keyword_flag("reason", rules.PERSONAL_WORDS)
    return df.withColumns({"is_denied": denied, "is_restricted": restricted, "is_personal": restricted & personal})


def mask_counts() -> dict[str, Column]:
    return {
        "total": F.count("*"), "denied": F.count_if("is_denied"), "restricted": F.count_if("is_restricted"),
        "personal": F.count_if("is_personal"),
    }


REQUEST_SETS = {
    "year": ["year"], "month": ["year", "month"], "body": ["year", "body"], "theme": ["year", "theme"],
    "body_month": ["year", "body", "month"], "theme_month": ["year", "theme", "month"],
    "body_theme": ["year", "body", "theme"], "body_theme_decision": ["year", "body", "theme", "decision"],
}


def request_counts(requests: DataFrame, sets: dict[str, Sequence[str]] = REQUEST_SETS) -> DataFrame:
    """All counters of a year in one scan. A row without a body or a valid month stays out of
    the key sets that need one."""
    cube = rollups.roll_up(requests, sets, mask_counts())
    for key in ("body", "month"):
        needs = [n for n, s in sets.items() if key in s]
        if needs:
            cube = cube.filter(~F.col("grain").isin(needs) | F.col(key).isNotNull())
    return cube


def with_rates(df: DataFrame) -> DataFrame:
    return rollups.rates(df, {
        "denied_rate": ("denied", "total"), "restricted_rate": ("restricted", "total"),
        "personal_rate": ("personal", "total"), "personal_in_restricted": ("personal", "restricted")})


def grain(cube: DataFrame, name: str, sets: dict[str, Sequence[str]] = REQUEST_SETS) -> DataFrame:
    return cube.filter(F.col("grain") == name).select(*sets[name], *MASKS)


def over_years(rows: DataFrame, *keys: str) -> DataFrame:
    """Whole-series counters out of yearly partials."""
    return rollups.merge_partials(rows, keys, MASKS)


def monthly_grid(cube: DataFrame) -> DataFrame:
    """Twelve months for every year, with rates."""
    return with_rates(spines.fill_year_months(grain(cube, "month"), "year", "month", MASKS))


def body_concentration(requests: DataFrame) -> DataFrame:
    """Per body: concentration on one requester and the adjusted rate; a later year overwrites
    an earlier one."""
    named = requests.filter("body is not null")
    per_year = named.groupBy("body", "year").agg(F.count("*").alias("total"), F.count_if("is_denied").alias("denied"))
    top = concentration.dominant_contributor(named.filter("requester is not null"), ["body", "year"], "requester", F.col("is_denied"))
    flagged = concentration.adjusted_rate(per_year.join(top, ["body", "year"], "left"))
    return concentration.latest_by_year(flagged, "body", "year")


def best_attachments(files: DataFrame) -> DataFrame:
    """One link per request: an answer before a request before anything else, first seen wins."""
    kind = F.lower(clean_text("TipoAnexo"))
    priority = F.when(kind.contains("resposta"), 2).when(kind.contains("pedido"), 1).otherwise(0)
    usable = files.select(clean_text("IdPedido").alias("id"), best_link("UrlArquivo").alias("attachment"), priority.alias("_p"), "row_no")
    return lookups.best_by_priority(usable.filter("id is not null and attachment is not null"), "id", "_p", "row_no").select("id", "attachment")


def denied_samples(requests: DataFrame, attachments: DataFrame, public_prefix: str, search_prefix: str, excerpt: int = 420) -> DataFrame:
    """Denied requests with excerpts and links."""
    rows = requests.filter("is_denied").join(attachments, "id", "left")
    return rows.select(
        "id", "year", "body", "decision", "reason", "theme", "subject",
        truncate("request_text", excerpt).alias("text_excerpt"), truncate("response_text", excerpt).alias("response_excerpt"),
        link_for_id(public_prefix, "id").alias("public_link"), link_for_id(search_prefix, "id").alias("search_link"), "attachment", "is_restricted")


def pinned_body(pattern_words: Sequence[str], column: str = "body") -> Column:
    from civisight.functions.text import fold

    return fold(column).rlike(any_of([fold_text(w) for w in pattern_words]))


def shares_of_year(rows: DataFrame, totals: DataFrame, n: str, total: str) -> DataFrame:
    return rows.join(totals.select("year", total), "year").withColumn("share", ratio(n, total)).drop(total)
