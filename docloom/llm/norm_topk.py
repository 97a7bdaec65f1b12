"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are ordered by length and cut into buckets of similar length. Queries first meet the bucket of the longest
vectors, which gives each a k-th score as its lower bound. That bound, divided by the query's length and by the
largest length in a bucket, is the local cosine threshold there. Over 1, the bucket is skipped for the query. A high
threshold prunes by coordinates: where the query has its largest coordinates, a vector whose cosine reaches the threshold must lie in a
known interval. A low one prunes by length alone. What is left is verified by exact products, and the
best k of all buckets are merged.

The queries are a stated set. Query blocks and buckets travel packed, one row for each, and meet in tiles of a group of either.
A bucket goes only to groups of queries of which one can still reach its largest length. In a tile the buckets come longest
first and raise each query's bound, and a vector must beat the k-th score, or equal it with a smaller id, to be held at all. So a tile
returns at most k rows for a query, however many vectors tie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import materialize, sorted_groups

BUCKET_ROWS = 2048
BLOCK_ROWS = 512
GROUP_BUCKETS = 32
GROUP_BLOCKS = 8
COORDINATES = 4
HIGH_COSINE = 0.7


def usable(vector: Column) -> Column:
    """Not null, not empty, and without null or non-finite components."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, odd)


def _scaled(embeddings: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    whole = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return embeddings.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"))


def _packed(frame: DataFrame, rows: int) -> DataFrame:
    """Rows of (id, v) packed in the order in which they come: (block, n, dim, top, ids, data); ``top`` is the largest length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            ids = table.column("id").to_numpy()
            lists = table.column("v").chunk(0)
            width = np.diff(lists.offsets.to_numpy())
            flat, ends = lists.flatten().to_numpy(), np.cumsum(width)
            for dim in np.unique(width).tolist():  # vectors of another length make blocks of their own
                mine = np.flatnonzero(width == dim)
                m = flat[(ends[mine] - dim)[:, None] + np.arange(dim)]
                norm = np.sqrt((m.astype(np.float64) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_pydict(
                    {"n": [len(mine)], "dim": [dim], "top": [float(norm.max())], "ids": [ids[mine].tobytes()], "data": [m.astype("<i4" if np.abs(m).max(initial=0) < 2**31 else "<i8").tobytes()]},
                    schema=pa.schema([("n", pa.int64()), ("dim", pa.int64()), ("top", pa.float64()), ("ids", pa.binary()), ("data", pa.binary())]),
                )

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, rows - size)
                held.append(part)
                size += part.num_rows
                at += part.num_rows
                if size == rows:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    made = frame.mapInArrow(run, "n long, dim long, top double, ids binary, data binary")
    return made.withColumn("block", F.monotonically_increasing_id())


def _matrix(data: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{len(data) // (n * dim)}").reshape(n, dim).astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products a @ b.T: in doubles while every sum is below 2^53, which BLAS is fast at."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if bound < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


NONE = np.iinfo(np.int64).min  # of scores: no bound


def _beats(s: np.ndarray, ids: np.ndarray, score: np.ndarray | int, last: np.ndarray | int) -> np.ndarray:
    return (s > score) | ((s == score) & (ids < last))


def search_cell(q: np.ndarray, qids: np.ndarray, score: np.ndarray, last: np.ndarray, v: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place of the query, ids, scores) of the best k of one bucket that beat the query's bound, a k-th ``score`` and its id, where there are any."""
    qn, vn = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1)), np.sqrt((v.astype(np.float64) ** 2).sum(axis=1))
    reach = qn * vn.max(initial=0)
    live = np.flatnonzero((score <= reach * (1 + 1e-9)) | (score <= 0))
    if not len(live):
        return
    cosine = np.where(score[live] > 0, score[live] / np.maximum(reach[live], 1e-300), -1.0)
    # Low thresholds: by length alone, for the block at once; the shortest useful vector serves all of these queries.
    low = live[cosine < HIGH_COSINE]
    if len(low):
        least = np.where(score[low] > 0, score[low] / np.maximum(qn[low], 1e-300), -1.0).min()
        rows = np.flatnonzero(vn >= least * (1 - 1e-9))
        some = ids[rows]
        s = _products(q[low], v[rows])
        fit = _beats(s, some, score[low][:, None], last[low][:, None]) & (some != qids[low][:, None])
        for at in np.flatnonzero(fit.any(axis=1)).tolist():
            mine = np.flatnonzero(fit[at])
            chosen = mine[_best(s[at][mine], some[mine], k)]
            yield int(low[at]), some[chosen], s[at][chosen]
    # High ones: with unit vectors x and y and cosine at least t, y_f lies in x_f t +- sqrt((1 - x_f^2)(1 - t^2)).
    unit = v / np.maximum(vn, 1e-300)[:, None] if (cosine >= HIGH_COSINE).any() else None
    for i, t in zip(live[cosine >= HIGH_COSINE].tolist(), cosine[cosine >= HIGH_COSINE].tolist()):
        x = q[i] / max(qn[i], 1e-300)
        keep = vn >= score[i] / max(qn[i], 1e-300) * (1 - 1e-9)
        t = min(t, 1.0)
        for f in np.argsort(-np.abs(x))[:COORDINATES].tolist():
            wide = np.sqrt(max(0.0, 1 - x[f] ** 2) * (1 - t**2)) + 1e-9
            lower, upper = x[f] * t - wide, x[f] * t + wide
            if x[f] >= t:  # the interval is that of all cosines from t to 1
                upper = 1.0 + 1e-9
            elif x[f] <= -t:
                lower = -1.0 - 1e-9
            keep &= (unit[:, f] >= lower) & (unit[:, f] <= upper)
        rows = np.flatnonzero(keep & (ids != qids[i]))
        s = _products(q[i : i + 1], v[rows])[0]
        mine = np.flatnonzero(_beats(s, ids[rows], score[i], last[i]))
        if len(mine):
            chosen = mine[_best(s[mine], ids[rows][mine], k)]
            yield i, ids[rows][chosen], s[chosen]


class _Block:
    """A block of queries, their bounds, and the best that they have found in a tile."""

    def __init__(self, r: dict, k: int):
        self.q, self.qids, self.k = _matrix(r["data"], r["n"], r["dim"]), np.frombuffer(r["ids"], np.int64), k
        bound = np.frombuffer(r["bound"], np.int64).reshape(2, -1) if r["bound"] else np.array([[NONE], [0]]).repeat(len(self.qids), axis=1)
        self.score, self.last = bound.copy()
        self.found: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def meet(self, v: np.ndarray, ids: np.ndarray) -> None:
        for i, near, s in search_cell(self.q, self.qids, self.score, self.last, v, ids, self.k):
            if i in self.found:
                near, s = np.concatenate((self.found[i][0], near)), np.concatenate((self.found[i][1], s))
                order = np.lexsort((near, -s))[: self.k]
                near, s = near[order], s[order]
            self.found[i] = near, s
            if len(s) == self.k and _beats(s[-1], near[-1], self.score[i], self.last[i]):
                self.score[i], self.last[i] = s[-1], near[-1]

    def rows(self) -> pa.RecordBatch:
        size = [len(x[0]) for x in self.found.values()]
        flat = lambda at: np.concatenate([x[at] for x in self.found.values()]) if size else np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.qids[list(self.found)], size)), pa.array(flat(0)), pa.array(flat(1))], ["query_id", "vec_id", "score"])


_FOUND = "query_id long, vec_id long, score long"


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, "tile"):
            blocks: list[_Block] = []
            tile = None
            for at in range(table.num_rows):
                r = {c: table.column(c)[at].as_py() for c in table.column_names}
                if r["tile"] != tile:
                    yield from (b.rows() for b in blocks)
                    blocks, tile = [], r["tile"]
                if r["asks"]:
                    blocks.append(_Block(r, k))
                elif blocks:
                    v, ids = _matrix(r["data"], r["n"], r["dim"]), np.frombuffer(r["ids"], np.int64)
                    for b in blocks:
                        b.meet(v, ids)
            yield from (b.rows() for b in blocks)

    return run


def _with_bounds(queries: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Query blocks with the k-th score and id of each query in ``found`` as ``bound``, and the length that a vector needs for any as ``need``."""
    best = found.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))).where(F.col("n") <= k)
    kth = best.where(F.col("n") == k).select("query_id", "score", F.col("vec_id").alias("last"))

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, raw in zip(batch.column("block"), batch.column("ids")):
                made = np.frombuffer(raw.as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(made), block.as_py())), pa.array(np.arange(len(made))), pa.array(made)], ["block", "place", "query_id"])

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, need = [], []
            for r in batch.to_pylist():
                bound = np.array([[NONE], [0]]).repeat(r["n"], axis=1)
                for one in r["bounds"] or ():
                    bound[:, one["place"]] = one["score"], one["last"]
                length = np.sqrt((_matrix(r["data"], r["n"], r["dim"]).astype(np.float64) ** 2).sum(axis=1))
                made.append(bound.tobytes())
                need.append(float(np.where(bound[0] > 0, bound[0] / np.maximum(length, 1e-300), -1.0).min()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("block", "n", "dim", "ids", "data")), pa.array(made, pa.binary()), pa.array(need)], ["block", "n", "dim", "ids", "data", "bound", "need"])

    # A block's queries number BLOCK_ROWS at most, so is what is gathered for it.
    each = queries.select("block", "ids").mapInArrow(ids, "block long, place long, query_id long")
    listed = each.join(kth, "query_id").groupBy("block").agg(F.collect_list(F.struct("place", "score", "last")).alias("bounds"))
    whole = queries.select("block", "n", "dim", "ids", "data").join(listed, "block", "left")
    return whole.mapInArrow(bounds, "block long, n long, dim long, ids binary, data binary, bound binary, need double")


def _tiles(queries: DataFrame, buckets: DataFrame, blocks: int, many: int) -> DataFrame:
    """Rows of (tile, asks, n, dim, ids, data, bound): query blocks, then the buckets that some query of their group can use, longest first."""
    g = max(1, -(-blocks // GROUP_BLOCKS))
    # As many tiles as tasks, where there are few buckets.
    h = max(1, -(-many // GROUP_BUCKETS), min(many, -(-int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")) // g)))
    # Blocks of like needs form a group, so that one of low need does not draw buckets for the others.
    groups = queries.select("block", "need").repartitionByRange(g, "need", F.xxhash64("block")).select("block", F.spark_partition_id().alias("g"))
    asked = queries.join(materialize(groups, "topk-groups"), "block")
    needs = materialize(asked.groupBy("dim", "g").agg(F.min("need").alias("need")), "topk-needs")
    tile = F.xxhash64("dim", "g", "h")
    held = buckets.withColumn("h", F.pmod(F.xxhash64("block"), F.lit(h)).cast("int"))
    # Which groups a bucket goes to is found without its vectors, which are then sent there only.
    sent = held.select("block", "dim", "h", "top").join(needs, "dim").where(F.col("top") * (1 + 1e-9) >= F.col("need")).select("block", "g", tile.alias("tile"))
    cells = held.join(sent, "block").select("tile", F.lit(False).alias("asks"), "n", "dim", "ids", "data", F.lit(None).cast("binary").alias("bound"), F.col("top"))
    used = sent.join(held.select("block", "dim", "h"), "block").select("dim", "g", "tile").distinct()
    mine = asked.join(used, ["dim", "g"]).select("tile", F.lit(True).alias("asks"), "n", "dim", "ids", "data", "bound", F.lit(None).cast("double").alias("top"))
    return mine.unionByName(cells).repartition("tile").sortWithinPartitions("tile", F.col("asks").desc(), F.col("top").desc()).drop("top")


def top_k(embeddings: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k largest integer inner products, ties to the smaller id.

    Components become floor(scale * x). Vectors that are null or empty or hold null or non-finite components take no
    part, nor do rows without id; zero vectors do. A query meets vectors of its own number of components and never its
    own id. With fewer than k candidates all are returned, and an empty table gives an empty result. Ids are taken
    to be distinct: rows that repeat an id are candidates each. Other columns play no part.
    """
    spark = embeddings.sparkSession
    rows = _scaled(embeddings, id_col, vector_col, scale)
    chosen = _scaled(embeddings.where(is_query), id_col, vector_col, scale)
    square = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)
    n = rows.count()
    # Ranges of a few buckets each, as far as there are tasks, so that buckets are full.
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // (4 * BUCKET_ROWS))))
    ordered = rows.withColumn("square", square).repartitionByRange(parts, F.col("square").desc(), "id").sortWithinPartitions(F.col("square").desc(), "id").select("id", "v")
    buckets = materialize(_packed(ordered, BUCKET_ROWS), "topk-buckets")
    queries = materialize(_packed(chosen, BLOCK_ROWS), "topk-queries")
    blocks, many = queries.count(), buckets.count()

    # The first bucket of each dimension gives the bounds; there is one row for each dimension.
    first = materialize(buckets.groupBy("dim").agg(F.max_by("block", F.struct("top", -F.col("block"))).alias("block")), "topk-first")
    start = buckets.join(first.select("block"), "block", "left_semi")
    free = queries.select("block", "n", "dim", "ids", "data", F.lit(None).cast("binary").alias("bound"), F.lit(-1.0).alias("need"))
    begun = materialize(_tiles(free, start, blocks, 1).mapInArrow(_search(k), _FOUND), "topk-begun")
    bounded = materialize(_with_bounds(queries, begun, k), "topk-bounded")
    rest = buckets.join(first.select("block"), "block", "left_anti")
    found = begun.unionByName(_tiles(bounded, rest, blocks, many).mapInArrow(_search(k), _FOUND))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
