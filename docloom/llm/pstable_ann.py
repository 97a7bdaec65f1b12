"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each table hashes a vector to the cell of a random grid: floor((a . x + b) / width) for several Gaussian a. A query
visits its own cell and perturbed ones in the order of their estimated success: a neighbour at distance d lies, along
each a, normally distributed around the query with deviation d, so the chance of a cell is a product of normal
intervals. A query goes on until its cells add up to ``per_table`` of that chance in each table; over independent
tables a neighbour is then missed with probability (1 - per_table)^tables. Candidates of all tables are reranked by
their exact product.

The largest inner product becomes the smallest distance when each vector gets one more component that brings it to
the largest length M; queries get zero there. M is taken over all rows. d, the distance of the k-th neighbour, is fitted on
a sample of at most ``SAMPLE_QUERIES`` queries and ``SAMPLE_ROWS`` rows, which overestimates it and so adds cells.
The number of hash functions grows with the number of rows so that a cell keeps about ``CELL_ROWS`` of them, but only as
long as ``MOST_CELLS`` cells can reach ``per_table``. Fuller cells are cut into shards which the query visits one by one.
Queries whose cells, which lie within two steps of their own, fall short of that chance, or that found fewer than k, are
compared with all rows, block by block, so nothing is capped.

Probes are pairs of a query and a cell until the empty cells are gone; only then do they get their vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import materialize, sorted_groups

CELL_ROWS = 1024
SHARD_ROWS = 1024
SAMPLE_QUERIES = 256
SAMPLE_ROWS = 4096
MOST_CELLS = 1024
HELD_ROWS = 400_000
QUERY_ROWS = 512  # of a product
EXACT_ROWS = 16_384  # rows, and queries, of a block
WIDTH = 1.5
_STEPS = np.arange(-2, 3)


def usable(vector: Column) -> Column:
    """Not null, neither empty nor all zero, and without null or non-finite components."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return vector.isNotNull() & F.exists(vector, lambda x: x != 0) & ~F.exists(vector, odd)


def _normal(x: np.ndarray) -> np.ndarray:
    """The normal distribution function, to about 1e-4; used for orders only."""
    return 1 / (1 + np.exp(-np.clip(1.5976 * x + 0.070566 * x**3, -500, 500)))


class Grid:
    """Hash functions for vectors of ``dim`` components, made from a seed, so that every task has the same."""

    def __init__(self, dim: int, tables: int, functions: int, longest: float, distance: float):
        r = np.random.RandomState(1000 + dim)
        self.a = r.standard_normal((tables, dim + 1, functions))
        self.scale = longest or 1.0
        self.b = r.random_sample((tables, functions)) * WIDTH
        self.odd = r.randint(1, 2**62, functions + 2).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self.distance, self.dim, self.tables = max(distance / self.scale, 1e-6), dim, tables

    def _places(self, table: int, x: np.ndarray, last: np.ndarray) -> np.ndarray:
        return (np.column_stack((x, last)) / self.scale @ self.a[table] + self.b[table]) / WIDTH

    def _keys(self, table: int, codes: np.ndarray) -> np.ndarray:
        """64-bit keys of (table, dim, codes)."""
        h = np.full(codes.shape[:-1], (self.dim * 4096 + table) * 2 + 1, np.uint64) * self.odd[-1]
        for k in range(codes.shape[-1]):
            h = (h ^ (codes[..., k].astype(np.int64).view(np.uint64) * self.odd[k])) * self.odd[-2]
            h ^= h >> np.uint64(29)
        return h.view(np.int64)

    def cells(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables): the cell of each vector in each table."""
        last = np.sqrt(np.maximum(0, self.scale**2 - (x**2).sum(axis=1)))
        return np.stack([self._keys(t, np.floor(self._places(t, x, last)).astype(np.int64)) for t in range(self.tables)], axis=1)

    def probes(self, q: np.ndarray, per_table: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each table (row, cell) pairs: the cells to visit, best first for each row."""
        none = np.zeros(len(q))
        for t in range(self.tables):
            place = self._places(t, q, none)
            code = np.floor(place).astype(np.int64)
            inside = place - code
            best, steps = _perturbed(inside, self.distance)
            before = np.cumsum(best, axis=1) - best
            visit = before < per_table
            row, at = np.nonzero(visit)
            yield row, self._keys(t, code[row] + steps[row, at])


    def short(self, q: np.ndarray, per_table: float) -> np.ndarray:
        """Queries that miss a neighbour with more than the chance that ``per_table`` leaves over all tables."""
        miss, none = np.ones(len(q)), np.zeros(len(q))
        for t in range(self.tables):
            place = self._places(t, q, none)
            miss *= 1 - np.minimum(_perturbed(place - np.floor(place), self.distance)[0].sum(axis=1), 1)
        return miss > (1 - per_table) ** self.tables


def _perturbed(inside: np.ndarray, distance: float) -> tuple[np.ndarray, np.ndarray]:
    """For places (rows, functions) inside their cells: the chances (rows, cells), best first, and the steps of at most ``MOST_CELLS`` cells."""
    edge = (_STEPS - inside[..., None]) * WIDTH / distance
    chance = _normal(edge + WIDTH / distance) - _normal(edge)
    best = np.ones((len(inside), 1))
    steps = np.zeros((len(inside), 1, 0), np.int64)
    for k in range(inside.shape[1]):  # extend the best partial perturbations by each function in turn
        each = (best[:, :, None] * chance[:, None, k, :]).reshape(len(inside), -1)
        order = np.argsort(-each, axis=1, kind="stable")[:, :MOST_CELLS]
        best = np.take_along_axis(each, order, axis=1)
        old = np.take_along_axis(steps, (order // len(_STEPS))[:, :, None], axis=1)
        steps = np.concatenate((old, _STEPS[order % len(_STEPS)][:, :, None]), axis=2)
    return best, steps


def hash_functions(n: int, distance: float, per_table: float) -> int:
    """As many as keep ``CELL_ROWS`` rows in a cell, or the most with which nine in ten queries reach ``per_table``, if any."""
    most = max(1, min(16, round(log(max(n, 2) / CELL_ROWS) / log(3.2))))
    places = np.random.RandomState(5).random_sample((64, most))
    for f in range(most, 0, -1):
        if (_perturbed(places[:, :f], distance)[0].sum(axis=1) >= per_table).mean() >= 0.9:
            return f
    return most


def _lists(batch: pa.RecordBatch, name: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each number of components in a list column."""
    column = batch.column(name)
    column = column if column.offset == 0 else pa.concat_arrays([column])
    width = np.diff(column.offsets.to_numpy())
    flat, ends = column.flatten().to_numpy(), np.cumsum(width)
    for dim in np.unique(width).tolist():
        mine = np.flatnonzero(width == dim)
        yield mine, flat[(ends[mine] - dim)[:, None] + np.arange(dim)]


def _exact(q: np.ndarray, qids: np.ndarray, v: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of the k best of each query; equal vectors get equal scores, and ties go to the smaller id."""
    rough = q @ v.T
    rough[qids[:, None] == ids] = -np.inf
    least = np.partition(rough, len(v) - k, axis=1)[:, len(v) - k] if len(v) > k else np.full(len(q), -np.inf)
    # Products by rows and columns differ in rounding, so those near the k-th are computed again, one way for all.
    floor_ = np.where(np.isfinite(least), least - 1e-9 * (1 + np.abs(least)), -np.finfo(float).max)
    row, at = np.nonzero(rough >= floor_[:, None])
    score = np.empty(len(row))
    for i in range(0, len(row), 65_536):
        score[i : i + 65_536] = (v[at[i : i + 65_536]] * q[row[i : i + 65_536]]).sum(axis=1)
    order = np.lexsort((ids[at], -score, row))
    row, at, score = row[order], at[order], score[order]
    begin = np.searchsorted(row, np.arange(len(q)))
    first = np.arange(len(row)) - begin[row] < k
    return qids[row[first]], ids[at[first]], score[first]


def _merged(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query so far, each vector once."""
    q, v, s = (np.concatenate(x) for x in zip(*held))
    order = np.lexsort((v, -s, q))
    q, v, s = q[order], v[order], s[order]
    fresh = np.ones(len(q), bool)
    fresh[1:] = (q[1:] != q[:-1]) | (v[1:] != v[:-1])
    q, v, s = q[fresh], v[fresh], s[fresh]
    first = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.concatenate((first, [len(q)]))))
    return q[rank < k], v[rank < k], s[rank < k]


def _fit(rows: DataFrame, queries: DataFrame, k: int) -> tuple[int, float, float]:
    """The number of rows, the largest length, and the typical distance of a k-th neighbour."""
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    n, longest = rows.agg(F.count("*"), F.max(length)).first()
    if not n:
        return 0, 1.0, 1.0
    mixed = F.xxhash64("id", F.lit(11))
    some = rows.orderBy(mixed, "id").limit(SAMPLE_ROWS).collect()
    asked = queries.orderBy(mixed, "id").limit(SAMPLE_QUERIES).collect()
    found: list[float] = []
    for dim in {len(r["v"]) for r in asked}:
        mine, theirs = [r for r in asked if len(r["v"]) == dim], [x for x in some if len(x["v"]) == dim]
        if not theirs:
            continue
        q, v = np.array([r["v"] for r in mine], np.float64), np.array([x["v"] for x in theirs], np.float64)
        near = q @ v.T
        near[np.array([r["id"] for r in mine])[:, None] == np.array([x["id"] for x in theirs])] = -np.inf
        near = -np.sort(-near, axis=1)
        many = np.isfinite(near).sum(axis=1)
        at = np.clip(np.round(k * many / n).astype(int), 0, np.maximum(many - 1, 0))
        some_ = many > 0
        found += ((q**2).sum(axis=1) + longest**2 - 2 * near[np.arange(len(q)), at])[some_].tolist()
    return n, longest, float(np.sqrt(max(np.median(found), 1e-12))) if found else longest


def search(
    embeddings: DataFrame,
    is_query: Column,
    k: int = 20,
    tables: int = 6,
    per_table: float | None = None,
    recall: float = 0.93,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k largest inner products found, ties to the smaller id.

    Scores are computed in double precision on the vectors as they are. Vectors that are null, empty or zero or hold
    null or non-finite components take no part, nor do rows without id. A query meets vectors of its own number of
    components and never its own id; with fewer than k candidates found it has fewer rows. Cells are visited as far as ``recall``, the
    chance to find a neighbour, asks for, unless ``per_table`` says how far in each table. Rows that repeat an id count as one. An empty table gives
    an empty result. Other columns play no part.
    """
    kind = "array<float>" if dict(embeddings.dtypes)[vector_col] == "array<float>" else "array<double>"
    whole = F.col(vector_col).cast(kind)
    fit_rows = embeddings.where(F.col(id_col).isNotNull() & usable(F.col(vector_col)))
    rows = fit_rows.select(F.col(id_col).cast("long").alias("id"), whole.alias("v"))
    queries = fit_rows.where(is_query).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"))
    if per_table is None:
        per_table = 1 - (1 - recall) ** (1 / tables)
    n, longest, distance = _fit(rows, queries, k)
    functions = hash_functions(n, max(distance / (longest or 1.0), 1e-6), per_table)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for mine, x in _lists(batch, "v"):
                x = x.astype(np.float64)
                cells = Grid(x.shape[1], tables, functions, longest, distance).cells(x)
                at = pa.array(np.repeat(mine, tables))
                yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("v").take(at), pa.array(cells.ravel())], ["id", "v", "cell"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                for mine, q in _lists(some, "v"):
                    q = q.astype(np.float64)
                    for row, cells in Grid(q.shape[1], tables, functions, longest, distance).probes(q, per_table):
                        yield pa.RecordBatch.from_arrays([some.column("id").take(pa.array(mine[row])), pa.array(cells)], ["id", "cell"])

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                for mine, q in _lists(some, "v"):
                    q = q.astype(np.float64)
                    at = mine[Grid(q.shape[1], tables, functions, longest, distance).short(q, per_table)]
                    yield pa.RecordBatch.from_arrays([some.column("id").take(pa.array(at))], ["id"])

    placed = rows.mapInArrow(index, f"id long, v {kind}, cell long")
    counts = placed.groupBy("cell").count()
    # A row for each cell that holds any; Spark broadcasts or shuffles it by its size.
    filled = materialize(counts.select("cell", F.when(F.col("count") > SHARD_ROWS, F.ceil(F.col("count") / SHARD_ROWS)).otherwise(1).cast("int").alias("shards")), "ann-filled")
    large = materialize(filled.where("shards > 1"), "ann-large")
    shard = F.pmod(F.xxhash64("id", F.lit(5)), F.col("shards"))
    placed = placed.join(large, "cell", "left").select("id", "v", F.when(F.col("shards").isNull(), F.col("cell")).otherwise(F.xxhash64("cell", shard)).alias("cell"), F.lit(False).alias("asks"))
    parts = F.transform(F.sequence(F.lit(0).cast("long"), F.col("shards").cast("long") - 1), lambda s: F.xxhash64("cell", s))
    visits = queries.mapInArrow(probe, "id long, cell long").join(filled, "cell").select("id", F.explode(F.when(F.col("shards") == 1, F.array("cell")).otherwise(parts)).alias("cell"))
    asked = materialize(visits, "ann-visits").join(queries, "id").select("id", "v", "cell", F.lit(True).alias("asks"))

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rows = 0
        for table in sorted_groups(batches, "cell"):
            batch = table.combine_chunks().to_batches()[0]
            cells, asks = batch.column("cell").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
            ids = batch.column("id").to_numpy()
            cuts = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1).tolist(), len(cells)]
            for a, b in zip(cuts, cuts[1:]):
                if asks[a] or not asks[b - 1]:  # sorted: the vectors of a cell, then its queries
                    continue
                for mine, x in _lists(batch.slice(a, b - a), "v"):
                    x = x.astype(np.float64)
                    is_q, own = asks[a:b][mine], ids[a:b][mine]
                    v, vids = x[~is_q], own[~is_q]
                    asking = np.flatnonzero(is_q)
                    for some in (asking[i : i + QUERY_ROWS] for i in range(0, len(asking) if len(v) else 0, QUERY_ROWS)):
                        held.append(_exact(x[some], own[some], v, vids, k))
                        rows += len(held[-1][0])
            if rows > HELD_ROWS:
                held = [_merged(held, k)]
                rows = len(held[0][0])
                if rows > HELD_ROWS // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["query_id", "vec_id", "score"])
                    held, rows = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _merged(held, k)], ["query_id", "vec_id", "score"])

    dealt = placed.unionByName(asked).repartition("cell").sortWithinPartitions("cell", "asks")
    found = dealt.mapInArrow(rerank, "query_id long, vec_id long, score double")
    once = materialize(found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), "ann-found")

    enough = once.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("n")).where(F.col("n") >= k)
    few = queries.select("id").join(enough, "id", "left_anti")
    lacking = materialize(few.union(queries.mapInArrow(short, "id long")).distinct(), "ann-lacking")
    m = lacking.count()
    if m:
        blocks = lambda size: F.sequence(F.lit(0), F.lit(-(-size // EXACT_ROWS) - 1))
        block = lambda size: F.pmod(F.xxhash64("id", F.lit(9)), F.lit(-(-size // EXACT_ROWS))).cast("int")
        every = rows.select("id", "v", block(n).alias("r"), F.explode(blocks(m)).alias("q"), F.lit(False).alias("asks"))
        them = queries.join(lacking, "id").select("id", "v", F.explode(blocks(n)).alias("r"), block(m).alias("q"), F.lit(True).alias("asks"))
        dealt = every.unionByName(them).select("id", "v", F.xxhash64("r", "q").alias("cell"), "asks")
        exact = dealt.repartition("cell").sortWithinPartitions("cell", "asks").mapInArrow(rerank, "query_id long, vec_id long, score double")
        once = once.unionByName(exact).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
