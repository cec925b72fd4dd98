"""Aircraft registry: compact records, profile, snapshot gate, search."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civisight.functions.arrays import first_owner, owners
from civisight.functions.text import format_prefix, is_masked, plausible_year
from civisight.operators import clean, profiles, search

# Landed columns and their short names.
COLUMNS = {
    "MARCA": "prefix",
    "SG_UF": "state",
    "NM_OPERADOR": "operator",
    "OUTROS_OPERADORES": "other_operators",
    "UF_OPERADOR": "operator_state",
    "CPF_CNPJ": "document",
    "PROPRIETARIOS": "owners",
    "DS_MODELO": "model",
    "NM_FABRICANTE": "manufacturer",
    "CD_TIPO_ICAO": "icao_type",
    "NR_ANO_FABRICACAO": "year",
    "DT_MATRICULA": "registered",
    "DT_CANC": "cancel_date",
    "DS_MOTIVO_CANC": "cancel_reason",
    "CF_OPERACIONAL": "operational_rule",
    "DS_CATEGORIA_HOMOLOGACAO": "category",
    "TP_OPERACAO": "operation_type",
    "DS_GRAVAME": "encumbrance",
    "TP_CA": "airworthiness_type",
    "TP_MOTOR": "engine_type",
    "QT_MOTOR": "engines",
    "NR_PASSAGEIROS_MAX": "passengers",
    "NR_ASSENTOS": "seats",
    "CD_INTERDICAO": "interdiction",
}


def landed_registry(raw: DataFrame, columns: dict[str, str] = COLUMNS) -> DataFrame:
    """Compact records: short names, empty and ``null`` cells dropped, all-empty rows dropped."""
    present = {src: dst for src, dst in columns.items() if src in raw.columns}
    out = clean.project_map(raw, present)
    for dst in columns.values():
        if dst not in out.columns:
            out = out.withColumn(dst, F.lit(None).cast("string"))
    return out.withColumns({
        "prefix_display": format_prefix("prefix"), "document_masked": is_masked("document"), "build_year": plausible_year("year"),
        "main_owner": first_owner("owners"), "owner_list": owners("owners")})


def profile(records: DataFrame) -> DataFrame:
    return profiles.registry_profile(records, "prefix", "cancel_date", "document", "operator", "state", "year")


def gate(candidate: DataFrame, current: DataFrame) -> DataFrame:
    return profiles.accept_snapshot(candidate, current, ["prefix", "owners", "operator", "document"], "prefix", "operator")


def find(records: DataFrame, queries: list[str], limit: int = 20) -> DataFrame:
    return search.search_registry(
        records, queries, limit, more=["other_operators", "state", "operator_state", "category", "operation_type", "operational_rule"],
        more_compact=["other_operators"])
