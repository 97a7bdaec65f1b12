"""A sink that shows several tables as JSON lines at once, or none of them."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI and the path in it."""
    return pafs.FileSystem.from_uri("file:///" + uri[5:].lstrip("/") if uri.startswith("file:") else uri)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class TablesWriter(DataSourceWriter):
    """Each attempt of a task writes files of its own names below a hidden folder; a commit keeps what the tasks' last messages name and renames it into place."""

    def __init__(self, path: str):
        self.path = path
        self.building = f"{path.rstrip('/')}.building-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Written:
        store, folder = _store(self.building)
        attempt, open_, files = uuid.uuid4().hex, {}, []
        try:
            for row in iterator:
                out = open_.get(row["table"])
                if out is None:
                    store.create_dir(f"{folder}/{row['table']}", recursive=True)
                    files.append(f"{row['table']}/part-{attempt}.jsonl")
                    out = open_[row["table"]] = store.open_output_stream(f"{folder}/{files[-1]}", compression=None)
                out.write(row["value"].encode("utf-8") + b"\n")
        finally:
            for out in open_.values():
                out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = _store(self.building)
        _, target = _store(self.path)
        store.create_dir(folder, recursive=True)
        named = {f"{folder}/{f}" for m in messages if m for f in m.files}
        for info in store.get_file_info(pafs.FileSelector(folder, recursive=True)):
            if info.is_file and info.path not in named:
                store.delete_file(info.path)
        store.move(folder, target)

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = _store(self.building)
        if store.get_file_info(folder).type != pafs.FileType.NotFound:
            store.delete_dir(folder)


class Tables(DataSource):
    @classmethod
    def name(cls) -> str:
        return "docloom_tables"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        store, target = _store(self.options["path"])
        if store.get_file_info(target).type != pafs.FileType.NotFound:
            raise FileExistsError(self.options["path"])
        return TablesWriter(self.options["path"])


def write_tables(spark: SparkSession, tables: dict[str, DataFrame], path: str) -> None:
    """Write all ``tables`` as JSON lines, a folder for each with rows, below ``path``, in one job: readers see all of them or nothing.

    Nulls are written. A failed task is tried again, and what it left is deleted; a failed job shows nothing,
    though a task that outlives it may leave files in the hidden folder. Refuses a path that is there.
    """
    spark.dataSource.register(Tables)
    lines = [df.select(F.lit(name).alias("table"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")) for name, df in tables.items()]
    reduce(DataFrame.union, lines).write.format("docloom_tables").mode("append").save(path)


def observed(df: DataFrame, path: str, counters: dict[str, object], fmt: str = "parquet") -> dict[str, int]:
    """Write ``df`` and return ``counters``, aggregates that are computed in the pass that writes; no other scan is made."""
    from pyspark.sql import Observation

    seen = Observation()
    df.observe(seen, *[c.alias(n) for n, c in counters.items()]).write.format(fmt).save(path)
    return seen.get
