"""How often voters and groups vote as advised."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civisight import rules
from civisight.functions.money import pct
from civisight.functions.text import ColumnOrName, as_col, clean_text
from civisight.operators.classify import keyword_flag, normalize_value
from civisight.operators.lookups import join_orientation, period_of
from civisight.operators.rollups import roll_up
from civisight.operators.spines import fill_months
from civisight.operators.windows import carry_forward, dedupe_first, latest_known

NO_GROUP, NO_STATE = "Sem partido", "--"


def landed_votes(raw: DataFrame) -> DataFrame:
    """Typed projection of a landed vote file."""
    person, name = clean_text("deputado_id"), clean_text("deputado_nome")
    return raw.select(
        clean_text("idVotacao").alias("event_id"), F.coalesce(person, F.concat(F.lit("name::"), F.coalesce(name, F.lit("")))).alias("person_id"),
        name.alias("person_name"), clean_text("deputado_siglaPartido").alias("group"), clean_text("deputado_siglaUf").alias("state"),
        normalize_value("voto", rules.VOTE_VALUES).alias("value"), "row_no",
    ).filter("event_id is not null and value is not null")


def landed_events(raw: DataFrame, body: str = "180") -> DataFrame:
    return raw.filter(F.trim("idOrgao") == body).select(
        clean_text("id").alias("event_id"), F.try_to_date(clean_text("data"), "yyyy-MM-dd").alias("date"),
        clean_text("dataHoraRegistro").alias("event_time"), clean_text("descricao").alias("description"), clean_text("aprovacao").alias("approval"),
        clean_text("uri").alias("event_uri"), clean_text("ultimaApresentacaoProposicao_uriProposicao").alias("proposal_uri"),
    ).filter("event_id is not null")


def landed_advice(raw: DataFrame, side: str = "Governo") -> DataFrame:
    return raw.filter(F.lower(F.trim("siglaBancada")) == side.lower()).select(
        clean_text("idVotacao").alias("event_id"), normalize_value("orientacao", rules.VOTE_VALUES).alias("advice"), "row_no")


def aligned_votes(
    votes: DataFrame, events: DataFrame, advice: DataFrame, periods: Sequence[dict] = rules.GOVERNMENT_PERIODS,
    procedural: Sequence[str] = rules.PROCEDURAL_WORDS, fill_labels: bool = False, chunk: ColumnOrName | None = None,
) -> DataFrame:
    """One row per counted vote, with period, kind and agreement.

    Joined by event first: the partitioning then also serves the dedupe by (event, person).
    ``fill_labels`` carries an earlier group and state of the person into empty cells; it
    needs ``chunk``, a non-decreasing cut of ``row_no``.
    """
    period = period_of("date", periods)
    about = F.concat_ws(" ", *[F.col(c) for c in ("description", "approval") if c in events.columns])
    typed = events.filter("date is not null").withColumns({
        "period": period["id"], "period_label": period["label"],
        "kind": F.when(keyword_flag(about, procedural), "procedural").otherwise("merit")})
    joined = dedupe_first(join_orientation(votes, typed, advice), ["event_id", "person_id"], "row_no")
    if fill_labels:
        joined = carry_forward(
            joined.withColumn("_year", F.year("date")), ["_year", "person_id"], ["group", "state"], "row_no",
            as_col(chunk), {"group": NO_GROUP, "state": NO_STATE}).drop("_year")
    return joined.withColumns({"month": F.to_date(F.trunc("date", "month")), "year": F.year("date"), "pro": F.col("value") == F.col("advice")})


def event_tallies(aligned: DataFrame) -> DataFrame:
    """One row per roll call."""
    return aligned.groupBy("event_id", "date", "month", "year", "period", "kind").agg(
        F.count_if("pro").alias("pro"), F.count_if(~F.col("pro")).alias("anti"), F.count("*").alias("total"))


def alignment_by(aligned: DataFrame, *keys: str) -> DataFrame:
    """Agreement per key, with the number of roll calls."""
    out = aligned.groupBy(*keys).agg(
        F.count_if("pro").alias("pro"), F.count_if(~F.col("pro")).alias("anti"), F.count("*").alias("total"),
        F.count_distinct("event_id").alias("events"))
    return out.withColumn("pct", pct("pro", "total"))


def time_cube(tallies: DataFrame) -> DataFrame:
    """Agreement by month, year and period, each also by kind."""
    sets = {
        "month": ["month"], "month_kind": ["month", "kind"], "year": ["year"],
        "period": ["period"], "period_kind": ["period", "kind"],
    }
    measures = {"pro": F.sum("pro"), "anti": F.sum("anti"), "total": F.sum("total"), "events": F.count("*")}
    return roll_up(tallies, sets, measures).withColumn("pct", pct("pro", "total"))


def member_cube(aligned: DataFrame, who: str) -> DataFrame:
    """Agreement by group or person, each also by period, kind and both."""
    sets = {who: [who], f"{who}_period": [who, "period"], f"{who}_kind": [who, "kind"], f"{who}_period_kind": [who, "period", "kind"]}
    measures = {"pro": F.count_if("pro"), "anti": F.count_if(~F.col("pro")), "total": F.count("*")}
    return roll_up(aligned, sets, measures).withColumn("pct", pct("pro", "total"))


def monthly_filled(tallies: DataFrame, periods: Sequence[dict] = rules.GOVERNMENT_PERIODS) -> DataFrame:
    """Every month between first and last; a month without votes has counts 0 and no rate."""
    months = tallies.groupBy("month").agg(
        F.sum("pro").alias("pro"), F.sum("anti").alias("anti"), F.sum("total").alias("total"), F.count("*").alias("events"))
    out = fill_months(months, "month", ["pro", "anti", "total", "events"])
    return out.withColumns({
        "pct": F.when(F.col("has_rows"), pct("pro", "total")), "period": period_of("month", periods)["id"]})


def slice_period(cube: DataFrame, grain: str, period: str | None) -> DataFrame:
    """Rows of one period out of a cube, or of all periods together."""
    if period is None:
        return cube.filter(F.col("grain") == grain)
    return cube.filter((F.col("grain") == f"{grain}_period") & (F.col("period") == period))


def person_directory(aligned: DataFrame) -> DataFrame:
    """Latest real group and state per person: a default never replaces a value."""
    named = aligned.withColumn("_seq", F.struct("date", "event_id", "row_no"))
    return latest_known(named, ["person_id"], ["group", "state"], "_seq", {"group": NO_GROUP, "state": NO_STATE})


def summary(tallies: DataFrame, include_unlisted: bool = False) -> DataFrame:
    """Grand total (listed periods only, unless asked) and totals by kind (all periods)."""
    measures = [F.sum("pro").alias("pro"), F.sum("anti").alias("anti"), F.sum("total").alias("total"), F.count("*").alias("events")]
    listed = tallies if include_unlisted else tallies.filter("period <> 'other'")
    total = listed.agg(*measures).select(F.lit("all").alias("kind"), "*")
    return total.unionByName(tallies.groupBy("kind").agg(*measures)).withColumn("pct", pct("pro", "total"))


def recent_events(tallies: DataFrame, n: int = 80, period: str | None = None) -> DataFrame:
    """Latest roll calls; lost ones have less than half of the votes on the advised side."""
    chosen = tallies if period is None else tallies.filter(F.col("period") == period)
    rate = pct("pro", "total")
    return chosen.withColumns({"pct": rate, "lost": rate < 50}).orderBy(F.col("date").desc(), F.col("event_id").desc()).limit(n)
