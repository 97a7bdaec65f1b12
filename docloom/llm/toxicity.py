"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its distinct lower-case words and their beginnings, hashed into ``BUCKETS`` buckets. Training
takes at most ``SAMPLE_ROWS`` labelled rows, those with the smallest hash of their id, and keeps the buckets whose
share among toxic rows differs significantly from that among the others. The machine has a weight for each of these and
a vector for each, whose products are the weights of pairs: an insult together with the mention of a group can
count for more, or less, than both alone. Spark counts the terms of the sample by class and chooses the buckets, so the driver
gets these and, for each row of the sample, which of them it has: at most ``SAMPLE_ROWS`` times ``FEATURES`` numbers, however long
the texts. Scoring reads each whole text once and needs no shuffle.

Parameters of the model: with ``FEATURES`` and ``LEAST_Z`` a bucket counts that tells the classes apart beyond chance (z of 4 is one
in 16,000), the strongest 1,024 at most; weaker signs are left out of scores.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import materialize

BUCKETS = 1 << 22
SAMPLE_ROWS = 10_000
FEATURES = 1024
LEAST_Z = 4
LEAST_ROWS = 3
FACTORS = 8
STARTS = (4, 5, 6)
_WORD = re.compile(r"\w+")
_KNOWN_WORDS = 500_000


def _buckets(word: str) -> list[int]:
    terms = [word, *(f"{word[:n]}\0" for n in STARTS if len(word) > n)]
    return [xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass"), 42) % BUCKETS for t in terms]


def terms(text: str | None) -> np.ndarray:
    """The distinct buckets of a whole text, ascending."""
    found: set[int] = set()
    for word in set(_WORD.findall((text or "").lower())):
        found.update(_buckets(word))
    return np.array(sorted(found), np.int64)


class Machine:
    """w0 + sum w_i + sum over pairs <v_i, v_j>, through the logistic function."""

    def __init__(self, features: np.ndarray, bias: float, weights: np.ndarray, vectors: np.ndarray):
        self.features, self.bias, self.weights, self.vectors = features, bias, weights, vectors
        self.place = {int(b): i for i, b in enumerate(features)}
        self.known: dict[str, tuple[int, ...]] = {}

    def logit(self, places: np.ndarray) -> float:
        v = self.vectors[places]
        return float(self.bias + self.weights[places].sum() + 0.5 * ((v.sum(axis=0) ** 2) - (v**2).sum(axis=0)).sum())

    def score(self, text: str | None) -> float:
        found: set[int] = set()
        known, place = self.known, self.place
        for word in set(_WORD.findall((text or "").lower())):
            hit = known.get(word)
            if hit is None:
                if len(known) >= _KNOWN_WORDS:
                    known.clear()
                hit = known[word] = tuple(place[b] for b in _buckets(word) if b in place)
            if hit:
                found.update(hit)
        z = self.logit(np.array(sorted(found), np.int64))
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def prior(positive: int, n: int) -> Machine:
    """The machine of one class alone, or of no features: the smoothed share of toxic rows."""
    share = (positive + 1) / (n + 2)
    return Machine(np.empty(0, np.int64), float(np.log(share / (1 - share))), np.empty(0), np.empty((0, FACTORS)))


def choose(counts: DataFrame, positive: int, n: int) -> DataFrame:
    """(bucket): of ``counts`` (bucket, both, toxic: rows), at most ``FEATURES``, by the pooled z of the two shares."""
    share = (F.col("both") + 1) / F.lit(n + 2)
    gap = F.abs(F.col("toxic") / F.lit(positive) - (F.col("both") - F.col("toxic")) / F.lit(n - positive))
    z = gap / F.sqrt(share * (1 - share) * F.lit(1 / positive + 1 / (n - positive)))
    some = counts.where(F.col("both") >= LEAST_ROWS).select("bucket", z.alias("z")).where(F.col("z") >= LEAST_Z)
    return some.orderBy(F.col("z").desc(), "bucket").limit(FEATURES).select("bucket")


def train(bucket: np.ndarray, rows: list[np.ndarray], labels: np.ndarray, steps: int = 300, rate: float = 0.05, decay: float = 1e-3, seed: int = 1) -> Machine:
    """Fit a machine over the ascending ``bucket`` to the places in it that each row has, in full batches by Adam."""
    y = np.asarray(labels, np.float32)
    start = prior(int(y.sum()), len(y))
    if not len(bucket):
        return start
    x = np.zeros((len(rows), len(bucket)), np.float32)
    for i, places in enumerate(rows):
        x[i, places] = 1
    r = np.random.RandomState(seed)
    params = [np.array([start.bias], np.float32), np.zeros(len(bucket), np.float32), (r.standard_normal((len(bucket), FACTORS)) * 0.01).astype(np.float32)]
    mean, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        xv = x @ params[2]
        logit = params[0] + x @ params[1] + 0.5 * (xv**2 - x @ params[2] ** 2).sum(axis=1)
        g = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) / len(y)
        gx = x.T @ g
        grads = [np.array([g.sum()], np.float32), gx + decay * params[1] / len(bucket), x.T @ (g[:, None] * xv) - params[2] * gx[:, None] + decay * params[2]]
        for i, grad in enumerate(grads):
            mean[i] = 0.9 * mean[i] + 0.1 * grad
            square[i] = 0.999 * square[i] + 0.001 * grad**2
            params[i] -= rate * (mean[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.999**step)) + 1e-8)
    return Machine(bucket, float(params[0][0]), params[1].astype(np.float64), params[2].astype(np.float64))


def held_out(id_col: Column) -> Column:
    """True for the fold that no label is learnt from; false for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Machine:
    """A machine fitted to at most ``sample_rows`` labelled rows outside the held-out fold. Rows with a null id or label take no part.

    Of an id's repeated texts one counts, and of its labels the smallest, whichever partition they are in.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("id")).agg(F.min(F.col(label_col).cast("int")).alias("y"))
    some = known.orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                made = [terms(t.as_py()).astype("<i4") for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("y"), pa.array(made, pa.list_(pa.int32()))], ["id", "y", "terms"])

    joined = texts.join(F.broadcast(some), "id").select("id", "y", "text")  # at most sample_rows ids
    kind = dict(joined.dtypes)["id"]
    sample = joined.mapInArrow(work, f"id {kind}, y int, terms array<int>")
    sample = materialize(sample.groupBy("id").agg(F.min(F.struct("terms", "y")).alias("one")).select("id", "one.terms", "one.y"), "toxicity-sample")
    n, positive = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not positive or positive == n:
        return prior(positive, n)
    counts = sample.select("y", F.explode("terms").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("both"), F.sum("y").alias("toxic"))
    bucket = np.array(sorted(r["bucket"] for r in choose(counts, positive, n).collect()), np.int64)  # FEATURES at most

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.searchsorted(bucket, np.intersect1d(np.array(t, np.int64), bucket)).astype("<i2").tobytes() for t in batch.column("terms").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), pa.array(found, pa.binary())], ["id", "y", "places"])

    rows = sorted(sample.mapInArrow(places, f"id {kind}, y int, places binary").collect(), key=lambda r: r["id"])  # sample_rows at most
    return train(bucket, [np.frombuffer(r["places"], "<i2") for r in rows], np.array([r["y"] for r in rows]))


def score(docs: DataFrame, machine: Machine, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1; null and empty texts get that of no terms. All rows and columns stay; a column named like ``score_col`` is replaced."""
    model = docs.sparkSession.sparkContext.broadcast((machine.features, machine.bias, machine.weights, machine.vectors))

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Machine(*model.value)
        for texts in parts:
            yield pd.Series([own.score(t) for t in texts])

    return docs.withColumn(score_col, scored(F.col(text_col).cast("string")))
