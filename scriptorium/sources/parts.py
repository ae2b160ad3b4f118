"""Folders of parts as data sources: tab-separated files, JSON arrays and binary files, written and read by tasks.

    df.write.format("scriptorium_tsv").mode("append").save(folder)
    spark.read.format("scriptorium_tsv").load(folder)

Each task writes its own parts beside the others, in a folder of the job. When all tasks are done, the driver moves the parts to
their places by name and adds a manifest that lists them with their rows; a part counts from then on. A task that fails leaves
nothing that is read, a job that fails leaves nothing at all, and a retried task writes again. An appended batch with a name
(option batch) that is already there changes nothing, so a batch that is delivered twice counts once. Manifests are
small: a name and a number for each part. No row passes through the driver, and no task reads or writes more than its parts.

Rows keep the order of the tasks' partitions; place is a row's number in all of the folder, from 0. The folder may be in any file
system that Arrow knows (file, hdfs, s3, gs, ..); it has one writer at a time. Binary files go to their names themselves: a task moves
them there when all of its own are written.

Defined cases: null cells are empty texts in tab-separated files. An empty table makes a manifest without parts, which reads
as an empty table; a folder without manifest is an error. Cells may hold tabs, quotes and line breaks. Overwriting
removes the parts of earlier batches when the new ones are there.
"""

from __future__ import annotations

import csv
import io
import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Rows of a part at most, and of a batch that is read.
ROWS, AT_ONCE = 200_000, 4_096
MANIFEST = "_committed-"


class Folder:
    """A folder in any file system."""

    def __init__(self, path: str) -> None:
        self.fs, self.path = arrow_fs.FileSystem.from_uri(path)
        self.path = self.path.rstrip("/")

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def make(self, name: str) -> None:
        self.fs.create_dir(self.at(name), recursive=True)

    def drop(self, name: str) -> None:
        if self.fs.get_file_info(self.at(name)).type == arrow_fs.FileType.Directory:
            self.fs.delete_dir(self.at(name))

    def move(self, old: str, new: str) -> None:
        if "/" in new:
            self.make(new.rpartition("/")[0])
        self.fs.move(self.at(old), self.at(new))

    def manifests(self) -> list[tuple[str, dict]]:
        """In their order, from the last one that replaces all before."""
        found = []
        infos = self.fs.get_file_info(arrow_fs.FileSelector(self.path, allow_not_found=True))
        for name in sorted(i.base_name for i in infos if i.base_name.startswith(MANIFEST)):
            with self.fs.open_input_stream(self.at(name)) as f:
                manifest = json.loads(f.read())
            found = [(name, manifest)] if manifest["replaces"] else [*found, (name, manifest)]
        return found

    def put(self, name: str, text: str) -> None:
        """Whole or not at all."""
        with self.fs.open_output_stream(self.at(made := f"_making-{uuid.uuid4().hex}")) as f:
            f.write(text.encode())
        self.move(made, name)


@dataclass
class Written(WriterCommitMessage):
    task: int
    parts: list[tuple[str, int]] = field(default_factory=list)


class _Writer(DataSourceArrowWriter):
    ending = ""

    def __init__(self, schema: StructType, options, overwrite: bool) -> None:
        self.names, self.path, self.overwrite = schema.names, options["path"], overwrite
        self.batch = options.get("batch")
        self.job = f"_writing-{uuid.uuid4().hex}"

    def one(self, out, rows: Iterator[pa.RecordBatch]) -> int:
        """Writes rows to an open stream; how many."""
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        context = TaskContext.get()
        folder, done = Folder(self.path), Written(context.partitionId())
        folder.make(self.job)
        for rows in _in_parts(iterator):
            name = f"{self.job}/{context.taskAttemptId()}-{len(done.parts)}"
            with folder.fs.open_output_stream(folder.at(name)) as f:
                done.parts.append((name, self.one(f, rows)))
        return done

    def commit(self, messages: list[Written | None]) -> None:
        folder = Folder(self.path)
        folder.make("")
        old = folder.manifests()
        if self.overwrite or self.batch is None or self.batch not in (m["batch"] for _, m in old):
            number = 1 + max((int(name.removeprefix(MANIFEST)[:6]) for name, _ in old), default=-1)
            parts = []
            for m in sorted((m for m in messages if m), key=lambda m: m.task):
                for k, (name, rows) in enumerate(m.parts):
                    parts.append((f"part-{number:06d}-{m.task:05d}-{k:03d}{self.ending}", rows))
                    folder.move(name, parts[-1][0])
            folder.put(f"{MANIFEST}{number:06d}.json", json.dumps({"batch": self.batch, "replaces": self.overwrite, "parts": parts}))
            for name, manifest in old if self.overwrite else ():
                for x in [name, *(p for p, _ in manifest["parts"])]:
                    folder.fs.delete_file(folder.at(x))
        folder.drop(self.job)

    def abort(self, messages: list[Written | None]) -> None:
        Folder(self.path).drop(self.job)


def _in_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[Iterator[pa.RecordBatch]]:
    """Batches of at most ROWS rows together, again and again; nothing if there is no row."""
    held = None
    ended = False

    def part() -> Iterator[pa.RecordBatch]:
        nonlocal held, ended
        left = ROWS
        while left:
            if held is None or not held.num_rows:
                held = next(batches, None)
                if held is None:
                    ended = True
                    return
                continue
            yield held.slice(0, left)
            taken = min(left, held.num_rows)
            held, left = held.slice(taken), left - taken

    batches = iter(batches)
    while True:
        held = next((b for b in ([held] if held is not None and held.num_rows else batches) if b.num_rows), None)
        if held is None or ended:
            return
        yield part()


class _TsvWriter(_Writer):
    ending = ".tsv"

    def one(self, out, rows: Iterator[pa.RecordBatch]) -> int:
        n, text = 0, io.StringIO()
        w = csv.writer(text, delimiter="\t")
        w.writerow(self.names)
        for batch in rows:
            w.writerows(zip(*(["" if x is None else x for x in c.to_pylist()] for c in batch.columns), strict=True))
            n += batch.num_rows
            out.write(text.getvalue().encode())
            text.seek(0)
            text.truncate()
        return n


class _JsonWriter(_Writer):
    ending = ".json"

    def one(self, out, rows: Iterator[pa.RecordBatch]) -> int:
        n = 0
        for batch in rows:
            for x in batch.column("value").to_pylist():
                out.write((b",\n" if n else b"[\n") + x.encode())
                n += 1
        out.write(b"\n]\n")
        return n


class _FileWriter(_Writer):
    """Each row is a file of its own."""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        context = TaskContext.get()
        folder, own, names = Folder(self.path), f"{self.job}/{context.taskAttemptId()}", []
        for batch in iterator:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                made = f"{own}/{name}"
                folder.make(made.rpartition("/")[0])
                with folder.fs.open_output_stream(folder.at(made)) as f:
                    f.write(content or b"")
                names.append(name)
        for name in names:
            folder.move(f"{own}/{name}", name)
        return Written(context.partitionId())

    def commit(self, messages: list[Written | None]) -> None:
        """The files are in their places already; there is no manifest."""
        folder = Folder(self.path)
        folder.make("")
        folder.drop(self.job)


@dataclass
class Part(InputPartition):
    name: str
    first: int


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options) -> None:
        self.path, self.names = options["path"], [c for c in schema.names if c != "place"]

    def partitions(self) -> Sequence[Part]:
        out, first = [], 0
        for _, manifest in Folder(self.path).manifests():
            for name, rows in manifest["parts"]:
                out.append(Part(name, first))
                first += rows
        return out

    def columns(self, text: io.TextIOBase) -> Iterator[list[list[str]]]:
        """Columns of some rows at a time."""
        raise NotImplementedError

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, Part):  # a folder without parts
            return
        folder, at = Folder(self.path), partition.first
        with folder.fs.open_input_stream(folder.at(partition.name)) as f, io.TextIOWrapper(f, "utf-8", newline="") as text:
            for columns in self.columns(text):
                n = len(columns[0])
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns), pa.array(range(at, at + n), pa.int64())], [*self.names, "place"])
                at += n


def _some(rows: Iterator) -> Iterator[list]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) == AT_ONCE:
            yield held
            held = []
    if held:
        yield held


class _TsvReader(_Reader):
    def columns(self, text: io.TextIOBase) -> Iterator[list[list[str]]]:
        rows = csv.reader(text, delimiter="\t")
        at = {c: k for k, c in enumerate(next(rows))}
        for some in _some(rows):
            yield [[r[at[c]] if c in at and at[c] < len(r) else "" for r in some] for c in self.names]


class _JsonReader(_Reader):
    def columns(self, text: io.TextIOBase) -> Iterator[list[list[str]]]:
        lines = (x.rstrip("\n").removesuffix(",") for x in text)
        for some in _some(x for x in lines if x not in ("[", "]", "")):
            yield [some]


class _Parts(DataSource):
    writes, reads = _Writer, _Reader

    def reader(self, schema: StructType) -> DataSourceReader:
        return self.reads(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return self.writes(schema, self.options, overwrite)


class TsvParts(_Parts):
    """Tab-separated parts, each with a header. Reads as texts, columns as in the first part, and place."""

    writes, reads = _TsvWriter, _TsvReader

    @classmethod
    def name(cls) -> str:
        return "scriptorium_tsv"

    def schema(self) -> str:
        folder = Folder(self.options["path"])
        manifests = folder.manifests()
        if not manifests:
            raise FileNotFoundError(f"no parts in {self.options['path']}")
        names = next((p for _, m in manifests for p, _ in m["parts"]), None)
        if names is None:
            return "place long"
        with folder.fs.open_input_stream(folder.at(names)) as f, io.TextIOWrapper(f, "utf-8", newline="") as text:
            return ", ".join([*(f"`{c}` string" for c in next(csv.reader(text, delimiter="\t"))), "place long"])


class JsonParts(_Parts):
    """JSON arrays, an element a line. Rows are value, the element's JSON, and place."""

    writes, reads = _JsonWriter, _JsonReader

    @classmethod
    def name(cls) -> str:
        return "scriptorium_json"

    def schema(self) -> str:
        return "value string, place long"


class BinaryFiles(_Parts):
    """Files of name and content; Spark's binaryFile reads them."""

    writes = _FileWriter

    @classmethod
    def name(cls) -> str:
        return "scriptorium_files"


def _registered(spark: SparkSession) -> SparkSession:
    for source in (TsvParts, JsonParts, BinaryFiles):
        spark.dataSource.register(source)
    return spark


def _write(df: DataFrame, kind: str, path: str, append: bool, batch: str | None) -> None:
    _registered(df.sparkSession)
    out = df.write.format(f"scriptorium_{kind}").mode("append" if append else "overwrite")
    (out.option("batch", batch) if batch is not None else out).save(path)


def _ordered(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.repartitionByRange(*by).sortWithinPartitions(*by) if by else df


def write_tsv(records: DataFrame, path: str, by: Sequence[str] = (), append: bool = False, batch: str | None = None, drop: Sequence[str] = ()) -> None:
    """records in order of by, without the columns in drop."""
    _write(_ordered(records, by).drop(*drop), "tsv", path, append, batch)


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    return _registered(spark).read.format("scriptorium_tsv").load(path)


def write_json(rows: DataFrame, path: str, by: Sequence[str] = (), append: bool = False, batch: str | None = None, drop: Sequence[str] = ()) -> None:
    """Each row as an object of a JSON array, in order of by, without the columns in drop."""
    names = [c for c in rows.columns if c not in drop]
    _write(_ordered(rows, by).select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in names))).alias("value")), "json", path, append, batch)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The elements' fields by schema, and place."""
    return _registered(spark).read.format("scriptorium_json").load(path).select(F.from_json("value", schema).alias("x"), "place").select("x.*", "place")


def write_files(files: DataFrame, path: str) -> None:
    """Binary files (name, content) into a folder."""
    _write(files.select("name", "content"), "files", path, True, None)
