"""Tables between the steps of a run: written once and read as often as needed."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def steps_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset the warehouse of a cluster, and in a session of one process a temporary folder."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if context.master != "local" and not context.master.startswith("local["):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/docloom-steps"
    if context.applicationId not in _local:
        made = tempfile.mkdtemp(prefix="docloom-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        _local[context.applicationId] = f"file://{made}"
    return _local[context.applicationId]


BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches() -> None:
    """Have rows sent to Python ``BATCH_BYTES`` at a time in this session, unless it asks for less.

    By default a batch holds 10,000 rows, whatever their size, so that what a worker needs grows with the texts until all batches are full.
    """
    spark = SparkSession.active()
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


_written: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A name for a folder of this session, which ``forget`` deletes."""
    _written.append(f"{steps_folder(spark)}/{name}-{uuid.uuid4().hex}")
    return _written[-1]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` and read it back: what reads it several times computes it once, and a lost executor costs no recomputation of it."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _written.remove(path)


def forget(spark: SparkSession) -> None:
    """Delete what ``stored`` has written in this session; call it once the results that read it are written elsewhere."""
    for path in list(_written):
        _delete(spark, path)


class Rounds:
    """The tables of an iteration: one is deleted once the next, which is made from it alone, is stored."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.last = spark, name, None

    def store(self, df: DataFrame) -> DataFrame:
        out = stored(df, self.name)
        if self.last:
            _delete(self.spark, self.last)
        self.last = _written[-1]
        return out
