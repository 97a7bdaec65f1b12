"""Best-fit packing of documents into fixed-length sequences, after a Martello-Toth dominance reduction.

Only the number of pieces of each length matters for where they go, so the plan is made from a histogram that has
at most ``capacity`` entries however large the corpus is. The reduction fixes sets that provably dominate every
other way to place their largest piece: a piece that nothing fits beside, a pair that fills a sequence exactly, and
the pairs and triples that leave no better partner. Best fit, longest first, places what remains. All pieces of
one length are handled at once: a step moves a range of sequences, so the plan has a few thousand steps at most.

A piece finds its place by its length and its rank among pieces of that length. Ranks need no sort: each input
partition numbers its own pieces, and the counts of earlier partitions are added.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import materialize

END_ID = 2
KNOWN_WORDS = 300_000
_DOUBLE_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]{2}"
_LATIN = r"^[\x00-\x{24F}]*$"


class Encoder:
    """Token ids of whole texts, exactly as the tokenizer file gives them.

    A single space between two other characters always starts a new token, so texts are cut there and each distinct
    cut is encoded once a batch. Texts with other white space next to each other, or with a special token, are encoded as a whole.
    """

    def __init__(self, tokenizer_json: str, ranks: str, pattern: str):
        import base64

        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(tokenizer_json)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.known: dict[str, list[int]] = {}

    def batch(self, texts: pa.Array) -> list[np.ndarray]:
        texts = pc.fill_null(texts.cast(pa.string()), "")
        alone = pc.match_substring_regex(texts, _DOUBLE_SPACE)
        for special in self.special:
            alone = pc.or_(alone, pc.match_substring(texts, special))
        lists = pc.split_pattern(pc.if_else(alone, "", texts), " ")
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        values = lists.flatten()
        first = np.zeros(len(values), bool)
        first[offsets[:-1]] = True
        values = pc.if_else(pa.array(first), values, pc.binary_join_element_wise(" ", values, ""))
        coded = values.dictionary_encode()
        words, at = coded.dictionary, coded.indices.to_numpy()
        known, encode = self.known, self.fast.encode_ordinary
        made = []
        for word in words.to_pylist():
            ids = known.get(word)
            if ids is None:
                ids = encode(word)
                if len(word) < 32:
                    known[word] = ids
            made.append(ids)
        if len(known) > KNOWN_WORDS:
            known.clear()
        for i in np.flatnonzero(~pc.match_substring_regex(words, _LATIN).to_numpy(zero_copy_only=False)).tolist():
            made[i] = self.whole.encode(words[i].as_py(), add_special_tokens=False).ids
        size = np.fromiter(map(len, made), np.int64, len(made))
        flat = np.fromiter(chain.from_iterable(made), np.uint32, int(size.sum()))
        start = np.cumsum(size) - size
        lens = size[at]
        before = np.cumsum(lens) - lens
        ids = flat[np.repeat(start[at] - before, lens) + np.arange(int(lens.sum()))]
        ends = np.concatenate((before, [len(ids)]))[offsets]
        out = [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        for i in np.flatnonzero(alone.to_numpy(zero_copy_only=False)).tolist():
            out[i] = np.array(self.whole.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32)
        return out


# ---- the plan -----------------------------------------------------------------------------------------------


class Plan:
    """Segments (length, first rank, pieces, pieces a sequence, first sequence, offset) and the number of sequences."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = {k: n for k, n in counts.items() if n}
        self.rank: dict[int, int] = defaultdict(int)
        self.segments: list[tuple[int, int, int, int, int, int]] = []
        self.sequences = 0
        self.fixed = 0
        self._reduce()
        self._best_fit()

    def _put(self, length: int, pieces: int, each: int, sequence: int, offset: int) -> None:
        self.segments.append((length, self.rank[length], pieces, each, sequence, offset))
        self.rank[length] += pieces
        self.left[length] -= pieces
        if not self.left[length]:
            del self.left[length]

    def _fix(self, lengths: list[int], times: int) -> None:
        offset = 0
        for x in lengths:
            self._put(x, times, 1, self.sequences, offset)
            offset += x
        self.sequences += times
        self.fixed += times

    def _others(self, length: int, most: int) -> list[int]:
        """Lengths present besides one piece of ``length``, ascending, up to ``most``; at most three copies of each."""
        return [x for x in sorted(self.left) if x <= most for _ in range(min(3, self.left[x] - (x == length)))]

    def _dominating(self, length: int) -> list[int] | None:
        """A set with ``length`` that dominates every other feasible set with it, or None where none is proven."""
        room = self.capacity - length
        others = self._others(length, room)
        if not others:
            return [length]
        best = others[-1]
        if best == room or len(others) == 1 or others[0] + others[1] > room:
            return [length, best]
        if len(others) > 2 and sum(others[:3]) <= room:
            return None
        pairs = [(others[k], y) for i, y in enumerate(others) if (k := bisect_right(others, room - y) - 1) > i]
        if max(x + y for x, y in pairs) <= best:
            return [length, best]
        # At most two pieces fit beside it: the largest, with the largest second, dominates when no pair has a larger second.
        second = bisect_right(others[:-1], room - best) - 1
        if second >= 0 and others[second] >= max(min(p) for p in pairs):
            return [length, best, others[second]]
        return None

    def _reduce(self) -> None:
        changed = True
        while changed:
            changed = False
            for length in sorted(self.left, reverse=True):
                while length in self.left and (chosen := self._dominating(length)):
                    need: dict[int, int] = defaultdict(int)
                    for x in chosen:
                        need[x] += 1
                    times = min(self.left[x] // n for x, n in need.items())
                    if len(chosen) == 3 or len(chosen) == 2 and sum(chosen) < self.capacity:
                        times = max(1, times - 3)  # the proof holds while none of them has run low
                    self._fix(chosen, times)
                    changed = True

    def _best_fit(self) -> None:
        open_: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by room: ranges of sequences
        for length in sorted(self.left, reverse=True):
            while left := self.left.get(length, 0):
                room = next((r for r in range(length, self.capacity) if open_.get(r)), self.capacity)
                each = room // length
                if room == self.capacity:
                    first, many = self.sequences, -(-left // each)
                    self.sequences += many
                else:
                    first, many = open_[room].pop()
                full = min(many, left // each)
                if full:
                    self._put(length, full * each, each, first, self.capacity - room)
                    open_[room - each * length].append((first, full))
                if full < many:
                    rest = left - full * each
                    if rest:
                        self._put(length, rest, rest, first + full, self.capacity - room)
                        open_[room - rest * length].append((first + full, 1))
                        full += 1
                    if full < many:
                        open_[room].append((first + full, many - full))

    def arrays(self) -> np.ndarray:
        """The segments, sorted by length and rank."""
        return np.array(sorted(self.segments), np.int64).reshape(-1, 6)



# ---- the operator -------------------------------------------------------------------------------------------


def pieces(docs: DataFrame, tokenizer_json: str, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024) -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32, and the partition and its own number of that length.

    A null text is empty; it still has its end id. Texts longer than ``capacity`` are cut, and their first piece is the shorter one.
    """
    frame = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(frame.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer_json, ranks, pattern)
        seen = np.zeros(capacity + 1, np.int64)
        part = TaskContext.get().partitionId()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                rows: list[tuple[int, int, int, int, int, int]] = []
                for i, ids in enumerate(encoder.batch(some.column("text"))):
                    data = np.append(ids, np.uint32(END_ID)).astype("<u4")
                    many = -(-len(data) // capacity)
                    first = len(data) - capacity * (many - 1)
                    for k in range(many):
                        a = 0 if not k else first + capacity * (k - 1)
                        b = first + capacity * k
                        rows.append((i, k, a, b - a, zlib.crc32(data[a:b].tobytes()), seen[b - a]))
                        seen[b - a] += 1
                made = np.array(rows, np.int64).reshape(-1, 6).T
                yield pa.RecordBatch.from_arrays(
                    [some.column("id").take(pa.array(made[0])), pa.array(made[1], pa.int32()), *(pa.array(x) for x in made[2:]), pa.array(np.full(len(rows), part, np.int32))],
                    ["id", "piece", "start", "length", "ids_crc32", "nth", "part"],
                )

    return frame.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long, nth long, part int")


def pack(cut: DataFrame, capacity: int = 1024) -> DataFrame:
    """Add sequence_id and offset to a written table of ``pieces``."""
    spark = cut.sparkSession
    counts = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = materialize(counts.select("length", "part", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "packing-bases")
    histogram = {r["length"]: r["n"] for r in bases.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    table = spark.sparkContext.broadcast(Plan(histogram, capacity).arrays())

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, _, each, sequence, offset = table.value.T
        keys = (length << 44) + first
        for batch in batches:
            size, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, (size << 44) + rank, side="right") - 1
            nth = rank - first[at]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("id", "piece", "start", "length", "ids_crc32")), pa.array(sequence[at] + nth // each[at]), pa.array(offset[at] + nth % each[at] * size)],
                ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    ranked = cut.join(bases.select("length", "part", "base"), ["length", "part"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    kind = dict(cut.dtypes)["id"]
    return ranked.mapInArrow(place, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_json: str, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024) -> DataFrame:
    """Pack all ``docs``: one row for each piece with its sequence and offset there, gapless from 0.

    Null and empty texts have a piece of one id. Repeated rows and null ids are packed like any other row. An empty
    table gives an empty result. Other columns of ``docs`` play no part.
    """
    cut = materialize(pieces(docs, tokenizer_json, ranks, pattern, id_col, text_col, capacity), "packing-pieces")
    return pack(cut, capacity).withColumnRenamed("id", id_col)
