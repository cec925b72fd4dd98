"""Licence scans: known sentences in order.

Texts are cut into sentences, sentences are normalised (lower case, letters and digits, single blanks) and
looked up in a map of known licence sentences; the ids that a document's sentences give are matched
against ordered rules: the steps of a rule must follow each other among the recognised sentences.

Only documents with a match give rows. Null and empty texts have none; repeated rows give repeated matches
of their id, counted together; further columns are ignored; no rows give no rows.
"""
from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from civisight.llm.common import prepare

# Sentences of public licences, normalised, by identifier.
SENTENCES = {
    "apache-short": "licensed under the apache license version 2 0",
    "apache-grant": "licensed under the apache license version 2 0 the license",
    "apache-use": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "mit-short": "released under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "gpl3-short": "this work is licensed under the gnu general public license version 3",
    "gpl3-grant": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "cc-by-nc-short": "licensed under cc by nc 4 0",
    "cc-by-short": "licensed under cc by 4 0",
    "cc-by-sa-short": "licensed under cc by sa 4 0",
    "reserved": "all rights reserved",
}
RULES = {
    "Apache-2.0": ["apache-short"],
    "Apache-2.0-header": ["apache-grant", "apache-use", "apache-copy"],
    "MIT": ["mit-short"],
    "MIT-text": ["mit-grant", "mit-notice"],
    "GPL-3.0": ["gpl3-short"],
    "GPL-3.0-header": ["gpl3-grant", "gpl-hope"],
    "BSD": ["bsd-grant", "bsd-source"],
    "CC-BY-NC-4.0": ["cc-by-nc-short"],
    "CC-BY-4.0": ["cc-by-short"],
    "CC-BY-SA-4.0": ["cc-by-sa-short"],
    "All-rights-reserved": ["reserved"],
}


def _table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A short list as a table whose size Spark knows, so that it is not shuffled against documents."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("r")).select("r.*")


def recognised(docs: DataFrame, sentences: dict[str, str]) -> DataFrame:
    """(doc_id, number, sentence_id): recognised sentences with their numbers in the text, from 0.

    Every sentence is normalised, however long it was, and looked up in a map of the known ones where it is read.
    """
    names = F.create_map(*[F.lit(x) for i, s in sentences.items() for x in (s, i)]) if sentences else F.lit(None).cast("map<string,string>")
    parts = F.split(F.regexp_replace(F.col("text").cast("string"), "([.!?])[ \t\r]+", "$1\n"), "\n+")
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(parts).alias("number", "s")).filter(F.length("s") >= 3)
            .select("doc_id", "number", F.try_element_at(names, F.trim(F.regexp_replace(F.lower("s"), "[^a-z0-9]+", " "))).alias("sentence_id"))
            .filter("sentence_id is not null"))


def license_matches(docs: DataFrame, sentences: dict[str, str] | None = None, rules: dict[str, list[str]] | None = None) -> DataFrame:
    """(doc_id, license_id, n_matches, first_sentence), one row per document and matched rule."""
    spark = prepare(docs.sparkSession)
    sentences, rules = sentences or SENTENCES, rules or RULES
    steps = _table(spark, [{"license_id": r, "step": i, "sentence_id": s, "steps": len(ids)} for r, ids in rules.items() for i, s in enumerate(ids)],
                   "license_id:string,step:int,sentence_id:string,steps:int")
    found = recognised(docs, sentences).withColumn("place", F.row_number().over(W.partitionBy("doc_id").orderBy("number", "sentence_id")))
    return (found.join(steps, "sentence_id").groupBy("doc_id", "license_id", (F.col("place") - F.col("step")).alias("begin"))
            .agg(F.count_distinct("step").alias("met"), F.first("steps").alias("steps"), F.min("number").alias("number"))
            .filter("met = steps").groupBy("doc_id", "license_id")
            .agg(F.count("*").alias("n_matches"), F.min("number").cast("long").alias("first_sentence")))
