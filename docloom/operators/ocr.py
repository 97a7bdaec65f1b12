"""Spacing: a character n-gram model learnt in Spark, scores by it, and repair of split words with offsets kept."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.sources.steps import small_batches, stored

SMOOTHING, LEAST_ALPHABET = 0.1, 16
START, END = "\x02", "\x03"
MODEL_GRAMS = 2_000_000  # sixteen bytes each


def _codes(text: str) -> np.ndarray:
    """Three code points, of 21 bits each, at each position of a text that is padded at both ends."""
    c = np.frombuffer(f"{START}{START}{text}{END}".encode("utf-32-le"), "<u4").astype(np.int64)
    return (c[:-2] << 42) | (c[1:-1] << 21) | c[2:]


def _counted(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, times): the grams of each text, counted; empty texts have none."""
    rows, codes, times = [], [], []
    for i, text in enumerate(texts):
        if text := text.as_py():
            code, n = np.unique(_codes(text), return_counts=True)
            rows.append(np.full(len(code), i))
            codes.append(code)
            times.append(n)
    none = np.empty(0, np.int64)
    return tuple(np.concatenate(x) if x else none for x in (rows, codes, times))


def _spelled(codes: np.ndarray) -> pa.Array:
    """The grams as strings."""
    points = np.stack((codes >> 42, codes >> 21 & 0x1FFFFF, codes & 0x1FFFFF), axis=1).astype("<u4")
    flat = points.tobytes().decode("utf-32-le")
    return pa.array([flat[i : i + 3] for i in range(0, len(flat), 3)], pa.string())


def _gram_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(key, n) of all grams: an Arrow stage counts them by batch, so that what is shuffled are distinct grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, code, times = _counted(batch.column("text"))
            code, at = np.unique(code, return_inverse=True)
            yield pa.RecordBatch.from_arrays([_spelled(code), pa.array(np.bincount(at, times, len(code)).astype(np.int64))], ["key", "n"])

    small_batches()
    normal = docs.select(T.normalize(F.col(text_col)).alias("text"))
    return normal.mapInArrow(run, "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, text_col: str = "text", word_min: int = 3) -> dict[str, DataFrame]:
    """Tables of a model: grams and contexts (key, n), words (key, n) seen ``word_min`` times, and meta (alphabet_size). Null and empty texts teach nothing."""
    grams = stored(_gram_counts(docs, text_col), "ocr-grams")  # the other tables are made from it
    words = docs.select(F.explode(F.regexp_extract_all(T.normalize(F.col(text_col)), F.lit(r"(\p{L}+)"), 1)).alias("key"))
    # Each character of a text is the last of a gram; the mark of the end is the one besides.
    letters = grams.select(F.substring("key", 3, 1).alias("key")).where(F.col("key") != END)
    return {
        "grams": grams,
        "contexts": grams.groupBy(F.substring("key", 1, 2).alias("key")).agg(F.sum("n").alias("n")),
        "words": words.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= word_min),
        "meta": letters.agg((F.count_distinct("key") + 1).alias("alphabet_size")),
    }


def save(model: dict[str, DataFrame], path: str) -> None:
    for name, table in model.items():
        table.write.mode("errorifexists").parquet(f"{path}/{name}")


def load(spark, path: str) -> dict[str, DataFrame]:
    model = {name: spark.read.parquet(f"{path}/{name}") for name in ("grams", "contexts", "words", "meta")}
    for name, columns in {"grams": ["key", "n"], "contexts": ["key", "n"], "words": ["key", "n"], "meta": ["alphabet_size"]}.items():
        if model[name].columns != columns:
            raise ValueError(f"{path}/{name} is not a table of a spacing model")
    return model


def mean_log_probability(docs: DataFrame, model: dict[str, DataFrame], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, mean_log_probability) over the positions of each text; texts that are null or empty have no row, and rows of one id are one text.

    A model of up to ``MODEL_GRAMS`` grams goes to every worker, and texts are read once; a larger one is joined with the
    grams of each text, counted before.
    """
    small_batches()
    size = F.greatest(F.lit(LEAST_ALPHABET), F.lit(int(model["meta"].first()[0])))
    chance = lambda g, c: F.log((F.coalesce(g, F.lit(0)) + SMOOTHING) / (F.coalesce(c, F.lit(0)) + SMOOTHING * size))
    contexts = model["contexts"].select(F.col("key").alias("context"), F.col("n").alias("c"))
    known = stored(model["grams"].withColumn("context", F.substring("key", 1, 2)).join(contexts, "context").select("key", chance(F.col("n"), F.col("c")).alias("log")), "ocr-model")
    # A gram that is not in the model has the chance of its context, or of none.
    unseen = stored(contexts.select("context", chance(F.lit(0), F.col("c")).alias("log")), "ocr-unseen")
    never = float(docs.sparkSession.range(1).select(chance(F.lit(0), F.lit(0))).first()[0])
    frame = docs.select(F.col(id_col).alias("id"), T.normalize(F.col(text_col)).alias("text")).where(F.length("text") > 0)
    kind = dict(frame.dtypes)["id"]
    if known.count() <= MODEL_GRAMS and unseen.count() <= MODEL_GRAMS:
        tables = []
        for df, key, width in ((known, "key", 3), (unseen, "context", 2)):
            t = df.toPandas()
            points = np.frombuffer("".join(t[key]).encode("utf-32-le"), "<u4").reshape(-1, width).astype(np.int64)
            code = sum(points[:, k] << 21 * (width - 1 - k) for k in range(width)) if len(t) else np.empty(0, np.int64)
            order = np.argsort(code)
            tables.append((np.append(code[order], np.iinfo(np.int64).max), np.append(t["log"].to_numpy()[order], 0.0)))
        held = docs.sparkSession.sparkContext.broadcast(tables)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (grams, logs), (pairs, rest) = held.value
            for batch in batches:
                sums, many = [], []
                for text in batch.column("text"):
                    code = _codes(text.as_py())
                    at, pair = np.searchsorted(grams, code), np.searchsorted(pairs, code >> 21)
                    other = np.where(pairs[pair] == code >> 21, rest[pair], never)
                    sums.append(float(np.where(grams[at] == code, logs[at], other).sum()))
                    many.append(len(code))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sums, pa.float64()), pa.array(many, pa.int64())], ["id", "s", "n"])

        scored = frame.mapInArrow(run, f"id {kind}, s double, n long")
    else:

        def grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                row, code, times = _counted(batch.column("text"))
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row)), _spelled(code), pa.array(times)], ["id", "key", "times"])

        own = frame.mapInArrow(grams_of, f"id {kind}, key string, times long").withColumn("context", F.substring("key", 1, 2))
        log = F.coalesce(F.col("k.log"), F.col("u.log"), F.lit(never))
        scored = own.alias("o").join(known.alias("k"), "key", "left").join(unseen.alias("u"), "context", "left").select("id", (log * F.col("times")).alias("s"), F.col("times").alias("n"))
    return scored.groupBy(F.col("id").alias(id_col)).agg((F.sum("s") / F.sum("n")).alias("mean_log_probability"))


# ---- normalisation with offsets -------------------------------------------------------------------------------

_DROPPED = set("​‌‍⁠﻿­")
_DROPPED_CODES = np.array([ord(c) for c in sorted(_DROPPED)], "<u4")
_SPACE_CODES = np.array([i for i in range(sys.maxunicode + 1) if chr(i).isspace() and chr(i) not in "\r\n"], "<u4")
NORMAL_CHARS = 1 << 20  # of texts that are given back at once, with two offsets each


def _normalized(text: str) -> tuple[str, np.ndarray, np.ndarray]:
    c = np.frombuffer(text.encode("utf-32-le"), "<u4")
    after_return = np.zeros(len(c), bool)  # a newline that is one with the return before it
    after_return[1:] = (c[1:] == 10) & (c[:-1] == 13)
    at = np.flatnonzero(~after_return & ~np.isin(c, _DROPPED_CODES))
    kept = np.where(c[at] == 13, 10, np.where(np.isin(c[at], _SPACE_CODES), 32, c[at])).astype("<u4")
    end = at + 1 + np.append(after_return, False)[at + 1]
    first = np.ones(len(kept), bool)
    first[1:] = (kept[1:] != 32) | (kept[:-1] != 32)
    begin = np.flatnonzero(first)
    last = np.append(begin[1:], len(kept))[: len(begin)] - 1
    return kept[begin].tobytes().decode("utf-32-le"), at[begin].astype(np.int32), end[last].astype(np.int32)


def normalize_spacing(text: str) -> tuple[str, list[int], list[int]]:
    """Without zero-width characters, with newlines alone and single spaces; and where each character began and ended in the source."""
    plain, starts, ends = _normalized(text)
    return plain, starts.tolist(), ends.tolist()


def source_span(starts: list[int], ends: list[int], start: int, end: int) -> tuple[int, int]:
    """The span in the source that covers one in the normalized text."""
    return starts[start], ends[end - 1]


class Model:
    """The tables of a model in memory, for repairs inside a worker."""

    def __init__(self, grams: dict[str, int], contexts: dict[str, int], words: dict[str, int], alphabet: int):
        self.grams, self.contexts, self.words, self.alphabet = grams, contexts, words, max(LEAST_ALPHABET, alphabet)

    def mean(self, text: str) -> float:
        chars = START * 2 + re.sub(r"\s+", " ", unicodedata.normalize("NFC", text).lower()).strip() + END
        parts = [log((self.grams.get(chars[i : i + 3], 0) + SMOOTHING) / (self.contexts.get(chars[i : i + 2], 0) + SMOOTHING * self.alphabet)) for i in range(len(chars) - 2)]
        return sum(parts) / len(parts) if parts else 0.0


def repair(model: Model, text: str, most_parts: int = 4, most_chars: int = 24, least_gain: float = 0.18, least_count: int = 3) -> tuple[str, list[int], list[int], list[dict]]:
    """(text, starts, ends, joins): split words put together where the word is known and the model gains enough.

    Fragments are words of letters between single spaces. A lone ASCII capital, which may be a marker, is never part of
    one. Of joins that share fragments the one of the largest gain is made, then of most parts, then the first.
    """
    plain, starts, ends = normalize_spacing(text)
    tokens = [m for m in re.finditer(r"\S+", plain)]
    letters = [m.group().isalpha() and not re.fullmatch(r"[A-Z]", m.group()) for m in tokens]
    found = []
    for i in range(len(tokens)):
        for n in range(2, most_parts + 1):
            group = tokens[i : i + n]
            if len(group) < n or not all(letters[i : i + n]):
                break
            if any(plain[a.end() : b.start()] != " " for a, b in zip(group, group[1:])):
                break
            joined = "".join(m.group() for m in group)
            if len(joined) > most_chars:
                break
            if model.words.get(unicodedata.normalize("NFC", joined).lower(), 0) < least_count:
                continue
            a, b = group[0].start(), group[-1].end()
            left, right = plain[max(0, a - 8) : a], plain[b : b + 8]
            gain = model.mean(left + joined + right) - model.mean(left + plain[a:b] + right)
            if gain >= least_gain:
                found.append((-gain, -n, a, b, i))
    taken: set[int] = set()
    joins, drop = [], set()
    for gain, n, a, b, i in sorted(found):
        if taken.isdisjoint(range(i, i - n)):
            taken.update(range(i, i - n))
            drop.update(k for k in range(a, b) if plain[k] == " ")
            joins.append({"source_start": starts[a], "source_end": ends[b - 1], "parts": -n, "ngram_gain": -gain})
    keep = [k for k in range(len(plain)) if k not in drop]
    return "".join(plain[k] for k in keep), [starts[k] for k in keep], [ends[k] for k in keep], sorted(joins, key=lambda j: j["source_start"])


def normalize_documents(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """(id, text, source_starts, source_ends, joins): each text normalized, and repaired if a model is given, with its offset map."""
    small_batches()
    frame = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(frame.dtypes)["id"]

    joins = "array<struct<source_start:int,source_end:int,parts:int,ngram_gain:double>>"
    join = pa.list_(pa.struct([("source_start", pa.int32()), ("source_end", pa.int32()), ("parts", pa.int32()), ("ngram_gain", pa.float64())]))

    def lists(arrays: list) -> pa.Array:
        ends = np.cumsum([0, *map(len, arrays)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays).astype(np.int32)))

    def packed(ids: pa.Array, made: list[tuple]) -> pa.RecordBatch:
        text, starts, ends, found = zip(*made)
        return pa.RecordBatch.from_arrays([ids, pa.array(text, pa.string()), lists(starts), lists(ends), pa.array(found, join)], ["id", "text", "source_starts", "source_ends", "joins"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, chars, first = [], 0, 0
            for i, text in enumerate(batch.column("text")):
                text = text.as_py()
                made.append(repair(held.value, text, **limits) if held.value else (*_normalized(text), []))
                chars += len(text)
                if chars >= NORMAL_CHARS or i + 1 == batch.num_rows:
                    yield packed(batch.column("id").slice(first, i + 1 - first), made)
                    made, chars, first = [], 0, i + 1

    return frame.mapInArrow(run, f"id {kind}, text string, source_starts array<int>, source_ends array<int>, joins {joins}").withColumnRenamed("id", id_col)


def map_back(mentions: DataFrame, normalized: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Mentions of normalized texts with their spans in the sources."""
    joined = mentions.join(normalized.select(id_col, "source_starts", "source_ends"), id_col)
    return joined.withColumns({"source_start": F.element_at("source_starts", F.col("start") + 1), "source_end": F.element_at("source_ends", F.col("end"))}).drop("source_starts", "source_ends")
