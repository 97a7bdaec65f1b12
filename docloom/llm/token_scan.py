"""Token counts of the documents in flat token files that have no index.

A file is a run of little-endian 16- or 32-bit ids in which each document ends with a separator id. Files are read
in blocks of equal size by independent tasks. A block yields, by one vectorised comparison, how many separators it has, where
the first and the last are, and the lengths of the documents between them. Documents that cross blocks are stitched
by a prefix scan over the blocks of a file: a running count gives a block's first document its number, and a running
maximum gives the last separator before the block, however many blocks ago. The scan sees five numbers a block, not its
documents. A file's name holds the attempt of its task, and only listed files are read, so leftovers of a lost executor don't count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._files import put, read_range
from ._shared import materialize

BLOCK_TOKENS = 1 << 20
FILE_TOKENS = 1 << 23
SEPARATOR = 50_256


def write_token_files(docs: DataFrame, folder: str, ranks: str, pattern: str, separator: int = SEPARATOR, width: int = 2, file_tokens: int = FILE_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of whole texts into flat files in ``folder``; (file, nth, id, bytes), the id of the nth document of each file, and the file's size.

    Texts are encoded as ordinary text, so the separator, which must not be an id of the rank file, cannot occur in one. A null
    text is empty: its separator alone.
    """
    from .byte_bpe import Codec

    frame = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(frame.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(ranks, pattern)
        if separator < len(codec.pieces) and codec.pieces[separator]:
            raise ValueError(f"{separator} is a token of the rank file")
        if max(separator, len(codec.pieces) - 1) >= 256**width:
            raise ValueError(f"ids do not fit into {width} bytes")
        task = TaskContext.get()
        part, attempt = task.partitionId(), str(task.taskAttemptId())
        held: list[np.ndarray] = []
        ids: list = []
        size = files = 0
        end = np.array([separator], f"<u{width}")

        def flush() -> pa.RecordBatch:
            nonlocal held, ids, size, files
            name, data = f"part-{part:06d}-{files:05d}-{attempt}.bin", np.concatenate(held).tobytes()
            put(folder, name, data)
            out = pa.RecordBatch.from_arrays([pa.array([name] * len(ids)), pa.array(np.arange(len(ids))), pa.array(ids, kind_arrow), pa.array(np.full(len(ids), len(data)))], ["file", "nth", "id", "bytes"])
            held, ids, size, files = [], [], 0, files + 1
            return out

        for batch in batches:
            kind_arrow = batch.schema.field("id").type
            for own, text in zip(batch.column("id"), batch.column("text")):
                made = codec.encode(text.as_py() or "").astype(end.dtype)
                held += [made, end]
                ids.append(own.as_py())
                size += len(made) + 1
                if size >= file_tokens:
                    yield flush()
        if ids:
            yield flush()

    return materialize(frame.mapInArrow(run, f"file string, nth long, id {kind}, bytes long"), "tokens-listed")


def scan_block(tokens: np.ndarray, separator: int, at: int) -> tuple[int, int | None, int | None, list[int]]:
    """(separators, place of the first and of the last in the file, lengths between them) of a block that starts at ``at``."""
    places = np.flatnonzero(tokens == separator) + at
    if not len(places):
        return 0, None, None, []
    return len(places), int(places[0]), int(places[-1]), (np.diff(places) - 1).tolist()


def count_tokens(spark: SparkSession, folder: str, separator: int = SEPARATOR, width: int = 2, block_tokens: int = BLOCK_TOKENS, pattern: str = "*.bin", files: DataFrame | None = None) -> DataFrame:
    """(file, nth, n_tokens, ended): the tokens of each document of each file in ``folder``, without separators.

    The files are those of ``files`` (path, length), or else all whose names fit ``pattern``.

    Tokens after a file's last separator are a last document with ``ended`` false; a file that ends with a separator
    has none. Two separators in a row enclose a document of no tokens, and an empty file has no documents. A size
    that is not a whole number of ids is an error.
    """
    if files is None:
        files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "length")  # contents are not read here
    whole = F.when(F.col("length") % width == 0, F.col("length")).otherwise(F.raise_error(F.concat(F.lit("not a whole number of ids: "), F.col("path"))).cast("long"))
    step = block_tokens * width
    blocks = files.select("path", whole.alias("length")).where("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / step).cast("long"))).alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                data = np.frombuffer(read_range(r["path"], r["block"] * step, min(step, r["length"] - r["block"] * step)), f"<u{width}")
                n, first, last, inside = scan_block(data, separator, r["block"] * block_tokens)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["path"]]), pa.array([r["block"]]), pa.array([r["length"] // width]), pa.array([n], pa.int64()), pa.array([first], pa.int64()), pa.array([last], pa.int64()), pa.array([inside], pa.list_(pa.int64()))],
                    ["path", "block", "size", "n", "first", "last", "inside"],
                )

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    scanned = blocks.repartition(parts, "path", "block").mapInArrow(run, "path string, block long, size long, n long, first long, last long, inside array<long>")
    scanned = materialize(scanned, "tokens-blocks")
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    stitched = scanned.select(
        "path", "block",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
        F.coalesce(F.max("last").over(earlier), F.lit(-1)).alias("since"),
    )
    stitched = scanned.select("path", "block", "n", "first", "inside").join(materialize(stitched, "tokens-stitched"), ["path", "block"])
    lengths = F.when(F.col("n") > 0, F.concat(F.array(F.col("first") - F.col("since") - 1), F.col("inside"))).otherwise(F.expr("array()").cast("array<long>"))
    closed = stitched.select("path", F.posexplode(lengths).alias("i", "n_tokens"), "before").select("path", (F.col("before") + F.col("i")).alias("nth"), "n_tokens", F.lit(True).alias("ended"))
    tails = scanned.groupBy("path").agg(F.sum("n").alias("nth"), F.max("size").alias("size"), F.coalesce(F.max("last"), F.lit(-1)).alias("since"))
    open_ = tails.where(F.col("size") - F.col("since") > 1).select("path", "nth", (F.col("size") - F.col("since") - 1).alias("n_tokens"), F.lit(False).alias("ended"))
    return closed.unionByName(open_).select(F.element_at(F.split("path", "/"), -1).alias("file"), "nth", "n_tokens", "ended")


def document_tokens(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(id, file, nth, n_tokens): write ``docs`` as flat token files in the shared folder, scan these, and name the documents.

    One row for each row of ``docs``, repeated rows and null ids included; null and empty texts have no tokens. Other
    columns play no part. An empty table gives an empty result.
    """
    from ._shared import shared_folder

    spark = docs.sparkSession
    folder = shared_folder(spark, "tokens")
    listed = write_token_files(docs, folder, ranks, pattern, id_col=id_col, text_col=text_col, **how)
    if listed.isEmpty():
        return listed.select(F.col("id").alias(id_col), "file", "nth", F.lit(0).cast("long").alias("n_tokens"))
    files = listed.groupBy("file").agg(F.first("bytes").alias("length")).select(F.concat(F.lit(folder + "/"), F.col("file")).alias("path"), "length")
    same = {k: how[k] for k in ("separator", "width") if k in how}
    found = materialize(count_tokens(spark, folder, files=files, **same), "tokens-found")
    return listed.join(found, ["file", "nth"]).select(F.col("id").alias(id_col), "file", "nth", "n_tokens")
