"""Helpers that several of the operators in this folder use."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that the cluster names in ``spark.checkpoint.dir``.

    Where that is unset, a cluster's warehouse takes its place, which its machines share as well. Only a session that runs
    in one process, as in tests, gets a temporary folder, which is deleted at exit.
    """
    context = spark.sparkContext
    base = spark.conf.get(_SETTING, None) or context.getConf().get(_SETTING)
    if not base and context.master != "local" and not context.master.startswith("local["):
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/docloom-steps"
    if not base:
        base = _own.get(context.applicationId)
        if not base:
            made = tempfile.mkdtemp(prefix="docloom-")
            atexit.register(shutil.rmtree, made, ignore_errors=True)
            base = _own[context.applicationId] = "file://" + made
    _written.append(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _written[-1]


_written: list[str] = []


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def forget(spark: SparkSession) -> None:
    """Delete the tables that this session's operators have written; call it once the results that read them are stored."""
    while _written:
        _delete(spark, _written.pop())


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back; this cuts its lineage."""
    return _stored(df, shared_folder(df.sparkSession, name))


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Rounds:
    """The tables of an iteration: one is deleted once the next, which is made from it alone, is stored."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.last = spark, name, None

    def store(self, df: DataFrame) -> DataFrame:
        path = shared_folder(self.spark, self.name)
        out = _stored(df, path)
        if self.last:
            _delete(self.spark, self.last)
            _written.remove(self.last)
        self.last = path
        return out


def sorted_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Cut Arrow batches that are sorted by ``key`` into tables that hold whole keys.

    A table ends where the key changes, so that a key never spans two of them; several keys may share one.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        change = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        first = held[-1].column(key)[-1].as_py() != keys[0] if held else False
        if first:
            yield pa.Table.from_batches(held)
            held = []
        if len(change):
            held.append(batch.slice(0, int(change[-1])))
            yield pa.Table.from_batches(held)
            held = [batch.slice(int(change[-1]))]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def per_batch(work: Callable[[pa.RecordBatch], pa.RecordBatch], rows: int) -> Callable:
    """For ``mapInArrow``: call ``work`` on slices of at most ``rows`` rows, which bounds what is in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield work(batch.slice(at, rows))

    return run
