"""Data sources for landed delimited files that Spark's own reader cannot take apart.

``landed_csv`` reads and writes delimited text with a preamble, plain or as members of ZIP archives:

* one partition per file, or per (archive, member); only the wanted columns are built;
* rows are found by a reader that knows quotes, so a quoted line break stays in its row, and the preamble and
  the header are skipped by place, never by value;
* columns go by name, per file: a column that a file lacks is null;
* per file, the date in its preamble.

Files are opened through ``pyarrow.fs``, so a path may be local or a URI of any store that it knows (hdfs, s3, gs).
Where only Spark itself can open a path, land the files to such a store first.
"""
from __future__ import annotations

import csv
import fnmatch
import io
import json
import re
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from civisight.functions.text import snake

BATCH_ROWS = 20_000
ABOUT = {"file": "string", "member": "string", "row_no": "bigint", "source_date": "string"}
_MARKS = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))
_DATE = r"(\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4})"


def open_store(path: str):
    """(file system, path in it) of a path or URI."""
    from pyarrow import fs

    if re.match(r"file:/", path):
        return fs.LocalFileSystem(), unquote(re.sub(r"^file:/+", "/", path))
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def list_files(path: str) -> list[str]:
    """Files of a folder, or those that fit a pattern in the last part of a path."""
    from pyarrow import fs

    store, inner = open_store(path)
    head, _, last = inner.rpartition("/")
    pattern = last if any(c in last for c in "*?[") else None
    info = store.get_file_info(fs.FileSelector(head)) if pattern else None
    if info is None:
        one = store.get_file_info(inner)
        info = store.get_file_info(fs.FileSelector(inner)) if one.type == fs.FileType.Directory else [one]
    prefix = path[:len(path) - len(inner)] if path.endswith(inner) else ""
    names = [f.path for f in info if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")) and (pattern is None or fnmatch.fnmatch(f.base_name, pattern))]
    return sorted(prefix + n for n in names)


@dataclass
class Piece(InputPartition):
    """A file, or a member of an archive."""
    file: str
    member: str | None


def _options(given) -> dict:
    text = lambda name, default: given.get(name, default)
    return {
        "path": text("path", None), "sep": text("sep", ";"), "archive": text("archive", "false").lower() == "true",
        "preamble": int(text("preamble", "0")), "date": text("date_pattern", _DATE), "skip_malformed": text("skip_malformed", "false").lower() == "true",
        "contains": [x for x in text("contains", "").split(",") if x], "excludes": [x for x in text("excludes", "").split(",") if x],
        "suffix": text("suffix", ".csv"), "members": text("members", "first"), "encodings": text("encodings", "utf-8-sig,latin-1").split(",")}


def _text(raw: io.BufferedIOBase, reopen, encodings: Sequence[str]) -> io.TextIOBase:
    """Text in the encoding of the byte-order mark, else in the first of ``encodings`` that fits it all."""
    head = raw.read(4)
    raw.close()
    for mark, name in _MARKS:
        if head.startswith(mark):
            return io.TextIOWrapper(reopen(), encoding=name, newline="")
    for name in encodings[:-1]:
        with reopen() as probe:
            stream = io.TextIOWrapper(probe, encoding=name)
            try:
                while stream.read(1 << 20):
                    pass
                return io.TextIOWrapper(reopen(), encoding=name, newline="")
            except UnicodeError:
                continue
    return io.TextIOWrapper(reopen(), encoding=encodings[-1], newline="")


def _records(stream: io.TextIOBase, sep: str, preamble: int, pattern: str):
    """(names, date, rows) of one file: preamble lines, then the header, then rows."""
    csv.field_size_limit(2**31 - 1)
    first = [stream.readline() for _ in range(preamble)]
    stamp = re.search(pattern, first[0]) if first else None
    rows = csv.reader(stream, delimiter=sep)
    names = [h.replace("﻿", "").strip() for h in next(rows, [])]
    return names, stamp.group(1) if stamp else None, rows


class LandedReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.names = options, schema.names

    def partitions(self) -> Sequence[InputPartition]:
        o, pieces = self.options, []
        for file in list_files(o["path"]):
            if not o["archive"]:
                pieces.append(Piece(file, None))
                continue
            store, inner = open_store(file)
            with store.open_input_file(inner) as f, zipfile.ZipFile(f) as raw:
                fits = [n for n in sorted(raw.namelist()) if n.lower().endswith(o["suffix"].lower())
                        and all(x.lower() in n.lower() for x in o["contains"]) and not any(x.lower() in n.lower() for x in o["excludes"])]
            pieces += [Piece(file, n) for n in (fits if o["members"] == "all" else fits[:1])]
        return pieces

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        o = self.options
        store, inner = open_store(partition.file)
        if partition.member is None:
            reopen = lambda: store.open_input_stream(inner)
            yield from self._batches(_text(reopen(), reopen, o["encodings"]), partition)
            return
        with store.open_input_file(inner) as f, zipfile.ZipFile(f) as raw:
            reopen = lambda: raw.open(partition.member)
            yield from self._batches(_text(reopen(), reopen, o["encodings"]), partition)

    def _batches(self, stream: io.TextIOBase, piece: Piece) -> Iterator[pa.RecordBatch]:
        names, stamp, rows = _records(stream, self.options["sep"], self.options["preamble"], self.options["date"])
        place = {snake(h): i for i, h in reversed(list(enumerate(names)))}
        wanted = [None if c in ABOUT else place.get(snake(c)) for c in self.names]
        columns: list[list] = [[] for _ in self.names]
        numbers: list[int] = []

        def flush() -> pa.RecordBatch:
            about = {"file": piece.file, "member": piece.member, "source_date": stamp}
            n = len(numbers)
            arrays = [pa.array(numbers, pa.int64()) if c == "row_no" else pa.array([about[c]] * n, pa.string()) if c in about else pa.array(v, pa.string())
                      for c, v in zip(self.names, columns)]
            out = pa.RecordBatch.from_arrays(arrays, names=self.names)
            numbers.clear()
            for v in columns:
                v.clear()
            return out

        for number, row in enumerate(rows):
            if not row or self.options["skip_malformed"] and len(row) > len(names):
                continue
            numbers.append(number)
            for v, i in zip(columns, wanted):
                if i is not None:
                    v.append(row[i] if i < len(row) else None)
            if len(numbers) == BATCH_ROWS:
                self._fill(columns, wanted, numbers)
                yield flush()
        if numbers:
            self._fill(columns, wanted, numbers)
            yield flush()

    @staticmethod
    def _fill(columns: list[list], wanted: list[int | None], numbers: list[int]) -> None:
        for v, i in zip(columns, wanted):
            if i is None:
                v.extend([None] * len(numbers))


@dataclass
class Written(WriterCommitMessage):
    """A file as it was written, and as it is called once the job is done."""
    held: str
    name: str


class LandedWriter(DataSourceWriter):
    """One file, or one archive with one member, per partition; files get their names when all are written."""

    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        from pyarrow import fs

        self.options, self.names, self.id = options, schema.names, uuid.uuid4().hex
        store, inner = open_store(options["path"])
        there = store.get_file_info(inner).type != fs.FileType.NotFound
        if there and overwrite:
            store.delete_dir_contents(inner, missing_dir_ok=True)
        store.create_dir(inner, recursive=True)

    def write(self, iterator) -> Written:
        from pyspark import TaskContext

        o, task = self.options, TaskContext.get()
        store, inner = open_store(o["path"])
        name = f"part-{task.partitionId():05d}-{self.id}{'.zip' if o['archive'] else '.csv'}"
        held = f"{inner}/_{name}.{task.taskAttemptId()}"

        def fill(out: io.TextIOBase) -> None:
            if o["preamble"]:
                out.write(o["title"] + "\n")
            rows = csv.writer(out, delimiter=o["sep"], lineterminator="\n")
            rows.writerow(self.names)
            rows.writerows(iterator)

        with store.open_output_stream(held) as f:
            if o["archive"]:
                with zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as raw, raw.open(o["member"], "w") as member, io.TextIOWrapper(member, "utf-8", newline="") as out:
                    fill(out)
            else:
                out = io.TextIOWrapper(f, "utf-8", newline="")
                fill(out)
                out.flush()
                out.detach()
        return Written(held, f"{inner}/{name}")

    def commit(self, messages) -> None:
        store, _ = open_store(self.options["path"])
        for m in messages:
            if m is not None:
                store.move(m.held, m.name)

    def abort(self, messages) -> None:
        store, _ = open_store(self.options["path"])
        for m in messages:
            if m is not None:
                store.delete_file(m.held)


class LandedCsv(DataSource):
    """``spark.read.format("landed_csv").schema("wanted columns, as strings")``; further columns of a schema may be
    ``file``, ``member``, ``row_no`` (long) and ``source_date``."""

    @classmethod
    def name(cls) -> str:
        return "landed_csv"

    def schema(self) -> str:
        """All columns of all files, by the headers; give a schema where there are many files."""
        o, names = _options(self.options), {}
        for piece in LandedReader(o, StructType()).partitions():
            store, inner = open_store(piece.file)
            f = store.open_input_file(inner)
            raw = zipfile.ZipFile(f) if piece.member else None
            reopen = (lambda r=raw, m=piece.member: r.open(m)) if raw else (lambda s=store, i=inner: s.open_input_stream(i))
            names |= dict.fromkeys(_records(_text(reopen(), reopen, o["encodings"]), o["sep"], o["preamble"], o["date"])[0])
            f.close()
        return ", ".join(f"`{n.replace('`', '``')}` string" for n in names) + ", row_no bigint, source_date string"

    def reader(self, schema: StructType) -> LandedReader:
        return LandedReader(_options(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> LandedWriter:
        more = {"title": self.options.get("title", ""), "member": self.options.get("member", "data.csv")}
        return LandedWriter(_options(self.options) | more, schema, overwrite)


def _scan(spark: SparkSession, path: str, columns: Sequence[str], **options: str) -> DataFrame:
    spark.dataSource.register(LandedCsv)
    fields = [f"`{c.replace('`', '``')}` {ABOUT.get(c, 'string')}" for c in columns]
    return spark.read.format("landed_csv").schema(", ".join(fields)).options(**options).load(path)


def read_archives(spark: SparkSession, path: str, columns: Sequence[str], sep: str = ";", contains: Sequence[str] = (), excludes: Sequence[str] = (),
                  suffix: str = ".csv", every_member: bool = False, skip_malformed: bool = False) -> DataFrame:
    """Wanted columns of the fitting member (or of every one) of each ZIP archive, with file, member and row_no."""
    return _scan(spark, path, [*columns, "file", "member", "row_no"], sep=sep, archive="true", contains=",".join(contains), excludes=",".join(excludes),
                 suffix=suffix, members="all" if every_member else "first", skip_malformed=str(skip_malformed))


def read_preamble(spark: SparkSession, path: str, columns: Sequence[str], sep: str = ";", date_pattern: str = _DATE) -> DataFrame:
    """Wanted columns of files whose first line carries a date and whose second is the header, with file, row_no and source_date."""
    return _scan(spark, path, [*columns, "file", "row_no", "source_date"], sep=sep, preamble="1", date_pattern=date_pattern)


def write_archives(df: DataFrame, path: str, sep: str = ";", member: str = "data.csv") -> None:
    """Rows, as text, as one archive per partition."""
    df.sparkSession.dataSource.register(LandedCsv)
    df.selectExpr(*[f"cast(`{c}` as string) as `{c}`" for c in df.columns]).write.format("landed_csv").options(sep=sep, archive="true", member=member).mode("append").save(path)


def write_preamble(df: DataFrame, path: str, title: str, sep: str = ";") -> None:
    """Rows, as text, in files that begin with a title line."""
    df.sparkSession.dataSource.register(LandedCsv)
    df.selectExpr(*[f"cast(`{c}` as string) as `{c}`" for c in df.columns]).write.format("landed_csv").options(sep=sep, preamble="1", title=title).mode("append").save(path)


# ------------------------------------------------------------- text corpora

CORPUS_FILES, CORPUS_BYTES, CORPUS_BATCH = 2000, 32 << 20, 4 << 20  # files and bytes of a task, bytes of a batch
_PACKED = (".gz", ".bz2", ".deflate", ".lz4", ".snappy", ".zst", ".xz")


def corpus_store(spark: SparkSession, path: str) -> str | None:
    """URI of a folder in a store whose files are opened here, one by one, at less than what Spark asks for each; else None."""
    if any(c in path for c in "*?[]{}%"):
        return None
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()
    try:
        store, _ = open_store(uri)
    except (OSError, ValueError, pa.ArrowException):
        return None
    return uri if store.type_name in ("local", "hdfs") else None


def _corpus_files(store, folder: str) -> tuple[list, list[str]]:
    """(files, folders of partitions) of a folder, as Spark's readers see it."""
    from pyarrow import fs

    info = [f for f in store.get_file_info(fs.FileSelector(folder))
            if not (f.base_name.startswith(".") or f.base_name.startswith("_") and "=" not in f.base_name or f.base_name.endswith("._COPYING_"))]
    return [f for f in info if f.type == fs.FileType.File], [f.path for f in info if f.type == fs.FileType.Directory and "=" in f.base_name]


def corpus_shares(uri: str) -> list[tuple[str, int, int]]:
    """(folder, i, n) for every task: each n-th file of the folder; none where the folder is one for Spark's own reader."""
    from pyarrow import fs

    store, inner = open_store(uri)
    if store.get_file_info(inner).type != fs.FileType.Directory:
        return []
    out, open_folders = [], [inner]
    while open_folders:
        folder = open_folders.pop()
        files, more = _corpus_files(store, folder)
        if files and more or any(f.base_name.endswith(_PACKED) for f in files):
            return []
        n = max(-(-len(files) // CORPUS_FILES), -(-sum(f.size for f in files) // CORPUS_BYTES))
        out += [(folder, i, n) for i in range(n)]
        open_folders += more
    return out


@dataclass
class Share(InputPartition):
    folder: str
    index: int
    of: int


class CorpusReader(DataSourceReader):
    def __init__(self, options: dict):
        self.uri, self.shares = options["uri"], json.loads(options["shares"])

    def partitions(self) -> list[Share]:
        return [Share(*s) for s in self.shares]

    def read(self, share: Share) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(self.uri)
        files = sorted(_corpus_files(store, share.folder)[0], key=lambda f: f.base_name)[share.index::share.of]
        names, texts, held = [], [], 0

        def flush() -> pa.RecordBatch:
            blobs = pa.array(texts, pa.binary())  # bytes are taken as they are, as Spark does
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.Array.from_buffers(pa.string(), len(blobs), blobs.buffers())], names=["file_name", "text"])

        for f in files:
            with store.open_input_file(f.path) as opened:
                texts.append(opened.read())
            names.append(f.base_name)
            held += len(texts[-1])
            if held >= CORPUS_BATCH:
                yield flush()
                names, texts, held = [], [], 0
        if names:
            yield flush()


class TextCorpus(DataSource):
    """Whole files of a folder, many in a task; see ``readers.read_text_corpus``."""

    @classmethod
    def name(cls) -> str:
        return "text_corpus"

    def schema(self) -> str:
        return "file_name string, text string"

    def reader(self, schema: StructType) -> CorpusReader:
        return CorpusReader(self.options)


def read_corpus(spark: SparkSession, uri: str, shares: list[tuple[str, int, int]]) -> DataFrame:
    """(file_name, text) of the files of the shares."""
    spark.dataSource.register(TextCorpus)
    return spark.read.format("text_corpus").options(uri=uri, shares=json.dumps(shares)).load()


def _write_texts(batches: Iterator[pa.RecordBatch], uri: str, held: str) -> Iterator[pa.RecordBatch]:
    """A file for every text, in a folder of the task's attempt; yields that folder and the name it gets in the end."""
    from pyspark import TaskContext

    task = TaskContext.get()
    store, inner = open_store(uri)
    part, n = task.partitionId(), 0
    folder = f"{inner}/{held}/{part}.{task.taskAttemptId()}"
    for batch in batches:
        for text in batch.column(0).cast(pa.binary()).to_pylist():
            if not n:
                store.create_dir(folder, recursive=True)
            with store.open_output_stream(f"{folder}/part-{part:05d}-{n:07d}.txt") as out:
                out.write((text or b"") + b"\n")
            n += 1
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([folder]), pa.array([f"{inner}/folder={part}"])], names=["held", "name"])


def write_corpus(texts: DataFrame, uri: str) -> bool:
    """One file per row of texts(value) in a folder per task, which gets its name when all are written; False if there is something at the URI."""
    from pyarrow import fs

    store, inner = open_store(uri)
    if store.get_file_info(inner).type != fs.FileType.NotFound:
        return False
    held = f"_temporary-{uuid.uuid4().hex}"
    store.create_dir(f"{inner}/{held}", recursive=True)
    try:
        for r in texts.mapInArrow(lambda b: _write_texts(b, uri, held), "held string, name string").collect():  # a row per task
            store.move(r.held, r.name)
    finally:
        store.delete_dir(f"{inner}/{held}")
    store.open_output_stream(f"{inner}/_SUCCESS").close()
    return True
