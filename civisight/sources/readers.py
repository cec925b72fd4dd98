"""Scans of landed public-data files.

Every delimited scan adds ``row_no``, an orderable position (file, block, row in block),
because several operators keep the first or the last row of a key in file order. Raw dumps
are text and, in archives, not splittable: land them to Parquet once and query that.
"""
from __future__ import annotations

import codecs
import csv
import io
import re
import zipfile
from collections.abc import Callable, Iterator, Sequence
from urllib.parse import unquote

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civisight.functions.text import clean_text, fold_text, snake
from civisight.sources.landed import LandedCsv, corpus_shares, corpus_store, open_store, read_corpus

ENCODINGS = ("utf-8-sig", "utf-8", "latin-1")
BATCH_ROWS = 20_000


def _position() -> F.Column:
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def _first_lines(batches: Iterator[pa.RecordBatch], encoding: str) -> Iterator[pa.RecordBatch]:
    """(file, line) of files given by name; only the beginning of a file is read."""
    for batch in batches:
        files, lines = batch.column(0).to_pylist(), []
        for file in files:
            store, inner = open_store(file)
            decoder, line = codecs.getincrementaldecoder(encoding)("replace"), ""
            with store.open_input_stream(inner) as stream:
                while "\n" not in line and (chunk := stream.read(1 << 14)):
                    line += decoder.decode(chunk)
            lines.append(line.split("\n")[0].rstrip("\r") if line else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lines, pa.string())], names=["file", "line"])


def file_headers(spark: SparkSession, path: str | Sequence[str], sep: str = ";", encoding: str = "UTF-8") -> dict[str, tuple[str, ...]]:
    """Column names of every file, by one job that reads the first line of each.

    The result has a row per file, as the listing that any scan keeps on the driver. Empty files have no header.
    In a store that only Spark can open, that job scans the files.
    """
    lines = spark.read.text(path if isinstance(path, str) else list(path))
    files = lines.inputFiles()
    if not files:
        return {}
    try:
        open_store(files[0])
    except (ValueError, OSError, NotImplementedError):
        raw = spark.read.schema("line string").option("sep", "\u0001").option("quote", "").option("encoding", encoding).csv(files)
        firsts = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"), "line")
        rows = firsts.filter("_b = 0").groupBy("file").agg(F.min_by("line", "_i").alias("line")).collect()
    else:
        tasks = min(len(files), 4 * spark.sparkContext.defaultParallelism)
        names = spark.createDataFrame(pd.DataFrame({"file": files})).repartition(tasks)
        rows = names.mapInArrow(lambda b: _first_lines(b, encoding), "file string, line string").collect()
    return {unquote(r.file): _names(r.line, sep) for r in rows if r.line}


def _names(line: str, sep: str) -> tuple[str, ...]:
    """Names of a header line; nameless columns and repeated names get their place."""
    raw = [h.replace("\ufeff", "").strip() for h in next(csv.reader([line], delimiter=sep), [])]
    return tuple(f"_c{i}" if not n else f"{n}{i}" if n in raw[:i] else n for i, n in enumerate(raw))


def read_delimited(
    spark: SparkSession, path: str | Sequence[str], sep: str = ";", encoding: str = "UTF-8",
    multiline: bool = False, drop_malformed: bool = False, year_pattern: str | None = None,
) -> DataFrame:
    """Delimited text, all columns as strings, plus ``row_no``.

    Columns go by name: files whose headers differ, in order or in columns, are read in groups of
    equal headers, found by one job (``file_headers``); a column that a file lacks is null. ``year_pattern`` (one
    group) adds ``year`` taken from the file path, for inputs that come as one file per year.
    """
    reader = (
        spark.read.option("header", True).option("sep", sep).option("encoding", encoding)
        .option("multiLine", multiline).option("escape", '"')
        .option("mode", "DROPMALFORMED" if drop_malformed else "PERMISSIVE")
    )
    extra = {"row_no": _position()}
    if year_pattern:
        extra["year"] = F.regexp_extract(F.col("_metadata.file_path"), year_pattern, 1).try_cast("int")
    groups: dict[tuple[str, ...], list[str]] = {}
    for file, names in sorted(file_headers(spark, path, sep, encoding).items()):
        groups.setdefault(names, []).append(file)
    if not groups:  # empty files only
        return reader.csv(path if isinstance(path, str) else list(path)).withColumns(extra)
    parts = [reader.schema(_ddl(names)).csv(files).withColumns(extra) for names, files in groups.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.select(*[c for c in out.columns if c not in extra], *extra)


def read_with_preamble(spark: SparkSession, path: str, sep: str = ";", date_pattern: str = r"(\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4})") -> DataFrame:
    """All columns of files whose first line carries the source date and whose second is the header, per file, each
    with its own date and its own order of columns; rows, quotes and all, by the ``landed_csv`` source."""
    spark.dataSource.register(LandedCsv)
    rows = spark.read.format("landed_csv").options(sep=sep, preamble="1", date_pattern=date_pattern).load(path)
    stamp = F.col("source_date")
    return rows.withColumn("source_date", F.coalesce(F.try_to_date(stamp, "yyyy-MM-dd"), F.try_to_date(stamp, "dd/MM/yyyy")))


def _ddl(names: Sequence[str]) -> str:
    return ", ".join("`" + n.replace("`", "``") + "` string" for n in names)


def pick_member(names: Sequence[str], contains: Sequence[str] = (), excludes: Sequence[str] = (), suffix: str = ".csv") -> str | None:
    """Archive member to read: the first by name that fits; any delimited file otherwise."""
    wanted = [n for n in sorted(names) if n.lower().endswith(suffix.lower())]
    fitting = [n for n in wanted if all(x.lower() in n.lower() for x in contains) and not any(x.lower() in n.lower() for x in excludes)]
    return next(iter(fitting or ([] if contains else wanted)), None)


def _decoded(raw: zipfile.ZipFile, member: str, encodings: Sequence[str]) -> io.TextIOBase:
    """Text stream in the encoding of the byte-order mark, else in the first that fits the whole member."""
    with raw.open(member) as probe:
        mark = probe.read(4)
    if mark.startswith((codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE)):
        return io.TextIOWrapper(raw.open(member), encoding="utf-16", newline="")
    for encoding in encodings[:-1]:
        try:
            with raw.open(member) as probe:
                stream = io.TextIOWrapper(probe, encoding=encoding)
                while stream.read(1 << 20):
                    pass
        except UnicodeError:
            continue
        return io.TextIOWrapper(raw.open(member), encoding=encoding, newline="")
    return io.TextIOWrapper(raw.open(member), encoding=encodings[-1], newline="")


def read_zip_member(
    spark: SparkSession, path: str, columns: Sequence[str], member: Callable[[list[str]], str | None] = pick_member,
    sep: str = ";", encodings: Sequence[str] = ENCODINGS, skip_malformed: bool = False,
) -> DataFrame:
    """Wanted columns of one delimited member per ZIP archive, as strings, streamed in batches.

    Headers match after folding, a column the archive lacks is null. One task per archive:
    ZIP cannot be split, so the parallelism is the number of archives.
    """
    wanted = [(c, snake(c)) for c in columns]
    schema = T.StructType(
        [T.StructField("archive", T.StringType()), T.StructField("member", T.StringType()), T.StructField("row_no", T.LongType())]
        + [T.StructField(c, T.StringType()) for c in columns]
    )

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as raw:
                    name = member(raw.namelist())
                    if name is None:
                        continue
                    csv.field_size_limit(2**31 - 1)
                    reader = csv.reader(_decoded(raw, name, encodings), delimiter=sep)
                    raw_header = next(reader, [])
                    header = {snake(h): i for i, h in reversed(list(enumerate(raw_header)))}
                    width = len(raw_header)
                    places = [header.get(key) for _, key in wanted]
                    rows: list[tuple] = []
                    for number, row in enumerate(reader):
                        if not row or (skip_malformed and len(row) > width):
                            continue
                        rows.append((archive, name, number, *(row[i] if i is not None and i < len(row) else None for i in places)))
                        if len(rows) >= BATCH_ROWS:
                            yield pd.DataFrame(rows, columns=schema.names)
                            rows = []
                    if rows:
                        yield pd.DataFrame(rows, columns=schema.names)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(unpack, schema)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One JSON object per line (plain or gz); lines that do not parse are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_state(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet") -> DataFrame:
    """State table, or an empty one when it has never been written."""
    try:
        return spark.read.schema(schema).format(fmt).load(path)
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND",):
            raise
        return spark.createDataFrame([], schema)


def read_text_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files: ``file_name``, ``doc_key`` (name without suffix), ``text``.

    Spark's reader counts each file as 4 MB and so makes a task of a few; in a store that can be opened here a task
    takes as many as fill it. Patterns, packed files and other stores are left to Spark.
    """
    uri = corpus_store(spark, path)
    if shares := corpus_shares(uri) if uri else []:
        files = read_corpus(spark, uri, shares)
    else:
        files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text"))
    return files.select("file_name", F.regexp_replace("file_name", r"\.[^.]*$", "").alias("doc_key"), "text")


# ------------------------------------------------------------ landed feeds

def flatten_json(df: DataFrame, column: str, schema: str, array: str | None = None) -> DataFrame:
    """Rows out of JSON documents; ``array`` names the nested list to explode."""
    parsed = df.withColumn("_doc", F.from_json(F.col(column), schema))
    if array is None:
        return parsed.select("_doc.*")
    return parsed.select(F.explode(F.col(f"_doc.{array}")).alias("_item")).select("_item.*")


def flatten_xml(df: DataFrame, column: str, schema: str, array: str, row_tag: str) -> DataFrame:
    """Rows out of XML documents, e.g. a member list or the items of a feed."""
    parsed = F.from_xml(F.col(column), schema, {"rowTag": row_tag})
    return df.select(F.explode(parsed.getField(array) if "." not in array else _path(parsed, array)).alias("_item")).select("_item.*")


def _path(col: F.Column, dotted: str) -> F.Column:
    for part in dotted.split("."):
        col = col.getField(part)
    return col


# ----------------------------------------------------------------- headers

def resolve_columns(headers: Sequence[str], spec: dict[str, dict]) -> dict[str, str | None]:
    """Header for every wanted field (metadata only).

    ``spec[field]`` has ``exact`` names, tried first, and ``contains`` groups of words, of
    which the shortest header that holds all words of a group wins.
    """
    words = {h: snake(h).replace("_", " ") for h in headers}

    def fit(header: str, wanted: dict) -> tuple | None:
        """Rank of a header for a field: place among the exact names, then length and name."""
        exact = [snake(n).replace("_", " ") for n in wanted.get("exact", ())]
        if words[header] in exact:
            return exact.index(words[header]), 0, ""
        if any(all(fold_text(w) in words[header] for w in group) for group in wanted.get("contains", ())):
            return len(exact), len(words[header]), header
        return None

    ranked = {field: sorted((rank, h) for h in headers if (rank := fit(h, wanted)) is not None) for field, wanted in spec.items()}
    return {field: found[0][1] if found else None for field, found in ranked.items()}


def select_resolved(df: DataFrame, spec: dict[str, dict], keep: Sequence[str] = ()) -> DataFrame:
    """Project the resolved headers; a field without a header is null."""
    found = resolve_columns([c for c in df.columns if c not in keep], spec)
    cols = [clean_text(F.col(f"`{h}`")).alias(f) if h else F.lit(None).cast("string").alias(f) for f, h in found.items()]
    return df.select(*keep, *cols)


def select_available(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Wanted columns in order; an absent one is null."""
    have = {fold_text(c): c for c in df.columns}
    return df.select([
        F.col(f"`{have[fold_text(c)]}`").alias(c) if fold_text(c) in have else F.lit(None).cast("string").alias(c)
        for c in columns
    ])
