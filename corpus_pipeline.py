"""A corpus pipeline over ``documents``: five stages, each on what the one before kept."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from civisight.llm.common import Shelf, prepare
from civisight.llm.decontamination import decontaminate
from civisight.llm.exact_dedup import exact_dedup
from civisight.llm.ngram_join import ngram_dedup
from civisight.llm.packing import pack_documents
from civisight.llm.quality import quality_filter


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labelled ones among docs, does not reject."""
    return quality_filter(docs, _table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, with the largest id, of each group of equal texts."""
    prepare(spark)
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, with the smallest id, of each component of similar texts."""
    prepare(spark)
    return ngram_dedup(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token sequences, with their places in packed sequences."""
    prepare(spark)
    return pack_documents(docs)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("benchmark", benchmark), ("pack", pack)]

#: The first stage is a trained classifier, which SQL cannot express; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again."""
    docs, shelf = _table(spark, sf_dir, "documents"), Shelf(spark)
    for name, stage in STAGES[:-1]:
        docs = shelf.put(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
