"""Streams that pull rows of files of lines in their order, so many at a time and within bounds, and go on where they ended."""

from __future__ import annotations

import json
import time
from bisect import bisect_right
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI and the path in it."""
    return pafs.FileSystem.from_uri("file:///" + uri[5:].lstrip("/") if uri.startswith("file:") else uri)


MARK_BYTES = 4 << 20


def scan(file: str) -> tuple[int, list[tuple[int, int]]]:
    """The number of lines of a file, and (line, byte) where some begin, one for some ``MARK_BYTES``, so that a batch need not read from the start."""
    store, path = _store(file)
    found, ended = [], True
    with store.open_input_file(path) as f:
        line = at = last = 0
        while got := f.read(1 << 20):
            if at - last >= MARK_BYTES and (end := got.find(b"\n")) >= 0:
                last = at + end + 1
                found.append((line + 1, last))
            line += got.count(b"\n")
            at += len(got)
            ended = got.endswith(b"\n")
    return line + (not ended), found


def marks(file: str) -> list[tuple[int, int]]:
    return scan(file)[1]


@dataclass
class Lines(InputPartition):
    file: str
    first: int  # the number of the first line in the stream
    skip: int
    take: int
    line: int = 0  # of the file, which begins at byte ``at``, at or before the lines wanted
    at: int = 0


class PullReader(DataSourceStreamReader):
    """Offsets are numbers of rows, of those from ``low`` to ``high``. A trigger admits ``batch`` of them, none beyond ``most`` rows in all or after the deadline.

    Spark's log of offsets says what is read; how far it has been planned is kept beside it, for a restart to go on from.
    """

    def __init__(self, options: dict[str, str]):
        self.files = json.loads(options["files"])  # [[uri, lines, marks], ...]
        self.batch, self.progress = int(options["batch"]), options["progress"]
        total = sum(n for _, n, _ in self.files)
        self.low, high = int(options.get("low") or 0), int(options.get("high") or total)
        self.most = min(high, int(options["most"])) if options.get("most") else high
        self.deadline = time.time() + float(options["seconds"]) if options.get("seconds") else None
        store, path = _store(self.progress)
        self.row = self.planned = self.low
        if store.get_file_info(path).type != pafs.FileType.NotFound:
            with store.open_input_stream(path) as f:
                self.row = self.planned = json.loads(f.read())["row"]

    def initialOffset(self) -> dict:
        return {"row": self.low}

    def latestOffset(self) -> dict:
        late = self.deadline is not None and time.time() >= self.deadline
        if not late and self.row == self.planned:  # else what was offered last is still to be planned
            self.row = max(self.row, min(self.row + self.batch, self.most))
        return {"row": self.row}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.row = self.planned = max(self.planned, end["row"])
        store, path = _store(self.progress)
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with store.open_output_stream(path) as f:
            f.write(json.dumps({"row": self.planned}).encode())
        parts, first = [], 0
        for file, n, known in self.files:
            low, high = max(start["row"], first), min(end["row"], first + n)
            if low < high:
                k = bisect_right(known, low - first, key=lambda m: m[0])
                parts.append(Lines(file, low, low - first, high - low, *(known[k - 1] if k else (0, 0))))
            first += n
        return parts

    def read(self, partition: Lines) -> Iterator[tuple]:
        store, path = _store(partition.file)
        with store.open_input_file(path) as f:
            f.seek(partition.at)
            held, line = b"", partition.line
            while line < partition.skip + partition.take:
                got = f.read(1 << 20)
                *whole, held = (held + got).split(b"\n") if got else [held, b""]
                for x in whole:
                    if partition.skip <= line < partition.skip + partition.take:
                        yield partition.first + line - partition.skip, x.removesuffix(b"\r").decode("utf-8", "replace")
                    line += 1
                if not got:
                    return

    def commit(self, end: dict) -> None:
        pass


class Pull(DataSource):
    @classmethod
    def name(cls) -> str:
        return "docloom_pull"

    def schema(self) -> str:
        return "row long, value string"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return PullReader(dict(self.options))


Files = list[tuple[str, int, list[tuple[int, int]]]]


def files(spark: SparkSession, path: str) -> Files:
    """(file, lines, marks) of the files of a folder, in the order of their names, each read once by Spark."""
    names = sorted(spark.read.text(path).inputFiles())
    if not names:
        return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column("file").to_pylist():
                n, found = scan(file)
                rows = [(0, n), *found]  # first the number of lines
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(rows), pa.string()), pa.array([m for m, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.int64())], ["file", "line", "at"])

    known: dict[str, list[tuple[int, int]]] = {}
    listed = spark.createDataFrame([(x,) for x in names], "file string").repartition(len(names))
    for r in listed.mapInArrow(run, "file string, line long, at long").collect():  # a row for each file and 4 MB
        known.setdefault(r.file, []).append((r.line, r.at))
    return [(x, n, found) for x in names for (_, n), *found in [sorted(known[x])] if n]


def lines(spark: SparkSession, path: str | Files, progress: str, batch: int = 1000, most: int | None = None, seconds: float | None = None, share: tuple[int, int] = (0, 1)) -> DataFrame:
    """A stream (row, value) of the lines of the files of a folder, in the order of their names; ``row`` counts from 0.

    A trigger takes ``batch`` rows; none come beyond ``most`` rows in all, or once ``seconds`` of this run are over. ``progress`` names a small file of the
    query's own. Files are counted by Spark when the stream is made, with where some of their lines begin, and are not to change afterwards; several streams can
    share what ``files`` has found. Blank lines are rows, and only a line feed, after a carriage return or not, ends one.

    ``share`` (k, n) takes the k-th of n equal ranges of the rows, so that n queries, each with a checkpoint and progress of its own, pull side by side, as a
    trigger of few rows costs far more than they do. Over restarts n stays the same; ``row`` and ``most`` count rows of the whole.
    """
    found = files(spark, path) if isinstance(path, str) else path
    total, (k, n) = sum(x for _, x, _ in found), share
    low, high = total * k // n, total * (k + 1) // n
    firsts = accumulate((x for _, x, _ in found), initial=0)
    own = [(file, x, known if first < high and low < first + x else []) for (file, x, known), first in zip(found, firsts)]
    spark.dataSource.register(Pull)
    options = {"files": json.dumps(own), "batch": str(batch), "progress": progress, "low": str(low), "high": str(high)}
    return spark.readStream.format("docloom_pull").options(**options, **({"most": str(most)} if most is not None else {}), **({"seconds": str(seconds)} if seconds is not None else {})).load()


@contextmanager
def plain_renames(spark: SparkSession, folder: str) -> Iterator[None]:
    """Within it, queries with checkpoints in a local or mounted folder rename their files there directly, which is atomic; Spark's default asks a shell about each, many
    times a trigger, where Hadoop's native library is absent. Elsewhere nothing changes, nor afterwards for the session."""
    name = "spark.sql.streaming.checkpointFileManagerClass"
    before = spark.conf.get(name, None)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getScheme() == "file":
        spark.conf.set(name, "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def until(query: StreamingQuery, reached: Callable[[], bool], every: float = 0.2) -> None:
    """Let a query run until ``reached`` holds, such as a target of accepted rows, or it ends by itself, and stop it. Rows of a batch under way still count."""
    try:
        while query.isActive and not reached():
            time.sleep(every)
        if query.exception():
            raise query.exception()
    finally:
        query.stop()
