"""Sanction registry: typed rows of two lists, activity, retention, summary."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civisight.functions.dates import parse_date
from civisight.functions.text import clean_text, doc_digits, upper_key
from civisight.operators import clean, profiles, ranking, rollups
from civisight.sources.readers import select_resolved

# Headers of the lists, exact names first, then words a header must hold.
HEADERS = {
    "person_type": {"exact": ["TIPO DE PESSOA"], "contains": [["TIPO", "PESSOA"]]},
    "document": {"exact": ["CPF OU CNPJ DO SANCIONADO"], "contains": [["CPF", "CNPJ", "SANCIONADO"]]},
    "name": {"exact": ["NOME DO SANCIONADO"], "contains": [["NOME", "SANCIONADO"]]},
    "legal_name": {"exact": ["RAZÃO SOCIAL - CADASTRO RECEITA"], "contains": [["RAZAO", "SOCIAL"]]},
    "trade_name": {"exact": ["NOME FANTASIA - CADASTRO RECEITA"], "contains": [["NOME", "FANTASIA"]]},
    "category": {"exact": ["CATEGORIA DA SANÇÃO"], "contains": [["CATEGORIA", "SANCAO"]]},
    "body": {"contains": [["ORGAO", "SANCIONADOR"], ["NOME", "ORGAO", "SANCIONADOR"]]},
    "process": {"exact": ["NÚMERO DO PROCESSO"], "contains": [["NUMERO", "PROCESSO"]]},
    "start": {"exact": ["DATA INÍCIO SANÇÃO"], "contains": [["DATA", "INICIO", "SANCAO"]]},
    "end": {"exact": ["DATA FINAL SANÇÃO"], "contains": [["DATA", "FINAL", "SANCAO"]]},
    "published": {"exact": ["DATA PUBLICAÇÃO"], "contains": [["DATA", "PUBLICACAO"]]},
    "scope": {"contains": [["ABRANGENCIA"]]},
    "legal_basis": {"contains": [["FUNDAMENTACAO"], ["FUNDAMENTO", "LEGAL"], ["DISPOSITIVO", "LEGAL"]]},
}


def landed_sanctions(raw: DataFrame, source: str, asof: dt.date) -> DataFrame:
    """Typed rows with an activity flag; headers are resolved by words."""
    rows = select_resolved(raw, HEADERS, keep=[c for c in ("row_no",) if c in raw.columns])
    typed = rows.withColumns({d: parse_date(d) for d in ("start", "end", "published")}).withColumn("document", doc_digits("document"))
    return typed.withColumns({"source": F.lit(source), "active": clean.is_active("start", "end", asof)}).filter("name is not null or document is not null")


def retained(rows: DataFrame, asof: dt.date, years: int = 6) -> DataFrame:
    return rows.filter(clean.recent_or_active("active", ["start", "end", "published"], asof, years))


def summary(rows: DataFrame, asof: dt.date) -> dict[str, DataFrame]:
    """Report tables of the registry."""
    active = rows.filter("active")
    return {
        "totals": rows.agg(F.count("*").alias("rows"), F.count_if("active").alias("active")),
        "recent": profiles.recency_counts(rows, "published", asof, (30, 90)),
        "by_source": rollups.value_counts(rows, ["source"], F.col("active")),
        "by_category": ranking.top_n(rollups.value_counts(active, ["category"]), "n", "category", 20),
        "by_body": ranking.top_n(rollups.value_counts(active, ["body"]), "n", "body", 20),
    }


def search_fields() -> list[str]:
    return ["name", "legal_name", "trade_name", "category", "body"]


def person_key(column: str) -> F.Column:
    return upper_key(clean_text(column))
