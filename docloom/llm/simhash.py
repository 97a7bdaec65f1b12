"""SimHash near-duplicate groups by bit-sliced comparison.

Rows of equal fingerprints are folded first, so copies cost nothing. The distinct fingerprints are dealt into
cells of rows that could link. In a cell the fingerprints lie as bit planes: one machine word holds one bit of 64
of them. A row is compared with 64 others at once: the words in which they differ go through carry-save adders
into vertical counters, and a word of 64 rows is abandoned as soon as all of them are beyond the radius.
A cell returns a spanning forest of its links, never all pairs, and connected components are found in Spark.

Cells. Without ``bands`` they are exact for any radius: the planes are cut into ``radius + m`` parts, and two
fingerprints within the radius agree in at least ``m`` of them, so each choice of ``m`` parts is a table. ``m``
grows with the number of fingerprints, so that cells stay small; it changes the cost, not the result. With
``bands=(tables, bits)``, for radii too wide for that, each table is keyed by so many planes, and a link of
distance d is found with probability 1 - (1 - (1 - d/planes)^bits)^tables. Cells of too many rows are cut
into shards, and each pair of shards becomes a cell of its own, so nothing is capped.

Verification. With ``similar`` the links only propose. Documents that they connect form a group, and in each group all
pairs count whose sets of shingles have at least that Jaccard similarity, computed from the sets themselves. A group of
large sets is cut into shards like a cell. A pivot is compared, by an inverted index, with the rows that have no
component yet, and what it reaches become pivots; rows that are placed leave the index.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import Rounds, materialize, per_batch, sorted_groups

BLOCK_ROWS = 1024  # small cells share a block of so many rows
CELL_ROWS = 1024  # fuller cells are cut
BAND_CELL_ROWS = 16_384  # the same where many tables overlap and each cut repeats rows
PAIR_ROWS = 2048  # rows of which all pairs are compared at once, which bounds the memory
SEEDS = 8  # from which a full cell is searched for groups before all pairs are compared
LANES = 1 << 18
BROADCAST_CELLS = 100_000
SET_BYTES = 8 << 20  # of the sets in a shard of a group
ROW_BITS = 32  # for each row of the smaller side of a join
MOST_BITS = 1 << 26  # of a bitmap, which is broadcast: 8 MB
_BUCKET_BITS = 1 << 15  # of each row that ``bitmap_construct_agg`` makes
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8).reshape(-1, 1), axis=1).view(np.uint64).ravel()


def _shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())
    return np.fromiter((digest(joined[a:b], 42) for a, b in spans), np.uint64, len(words) - k + 1)


def _more_words(h: np.ndarray, words: int) -> np.ndarray:
    """(n, words): the hashes themselves, then further ones mixed from them for fingerprints of over 64 planes."""
    out = np.empty((len(h), words), np.uint64)
    out[:, 0] = h
    for k in range(1, words):
        z = h + np.uint64((0x9E3779B97F4A7C15 * k) % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, k] = z ^ (z >> np.uint64(31))
    return out


def fingerprint(text: str | None, shingle: int = 4, planes: int = 64) -> bytes:
    """Big-endian bytes of the fingerprint: a bit is 1 if it is set in over half the shingle hashes."""
    h = _shingle_hashes(text, shingle)
    words = planes // 64
    if not len(h):
        return bytes(planes // 8)
    totals = np.zeros(planes, np.int64)
    for at in range(0, len(h), 16_384):
        raw = _more_words(h[at : at + 16_384], words).astype(">u8").view(np.uint8)
        for part in range(0, len(raw), 255):  # eight counters of a byte each, in one word
            totals += _SPREAD[raw[part : part + 255]].sum(axis=0).view(np.uint8)
    return np.packbits(totals * 2 > len(h)).tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, planes: int = 64) -> DataFrame:
    """One row for each row of ``docs``: its id and ``fp`` (binary). A null text counts as empty, an empty one is zero."""
    frame = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [fingerprint(x.as_py(), shingle, planes) for x in batch.column("text")]
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(made, pa.binary())], ["id", "fp"])

    kind = dict(frame.dtypes)["id"]
    return frame.mapInArrow(per_batch(work, 500), f"id {kind}, fp binary")


def _versions(docs: DataFrame, id_col: str, text_col: str, shingle: int, planes: int) -> DataFrame:
    """(id, version, fp): fingerprints with a hash of the text."""
    text = F.col(text_col).cast("string")
    named = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("version")).alias("id"), text.alias("text"))
    return fingerprints(named, "id", "text", shingle, planes).select("id.id", "id.version", "fp")


# ---- comparison inside a cell -------------------------------------------------------------------------------


def _full_adder(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def _beyond(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose vertical count is over ``radius``."""
    over, level = np.zeros_like(counters[0]), ~np.zeros_like(counters[0])
    for k in range(len(counters) - 1, -1, -1):
        if radius >> k & 1:
            level &= counters[k]
        else:
            over |= level & counters[k]
            level &= ~counters[k]
    return over


def _lanes_of(words: np.ndarray) -> np.ndarray:
    """(words, 64): the bits of each word."""
    return np.unpackbits(words.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


class _Planes:
    """Fingerprints (n, bytes) as bit planes: a word holds one bit of 64 of them."""

    def __init__(self, fps: np.ndarray):
        self.n, self.words, self.planes = len(fps), -(-len(fps) // 64), fps.shape[1] * 8
        bits = np.unpackbits(fps, axis=1)
        self.lanes = np.zeros((self.planes, self.words * 8), np.uint8)
        packed = np.packbits(bits.T, axis=1, bitorder="little")
        self.lanes[:, : packed.shape[1]] = packed
        self.lanes = self.lanes.view(np.uint64)
        total = bits.sum(axis=0, dtype=np.int64)
        self.ones, self.mixed = total == self.n, (total > 0) & (total < self.n)

    def within(self, pivots: np.ndarray, row: np.ndarray, word: np.ndarray, dead: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of pairs of a row of ``pivots`` and a word, those in which some lane is within the radius: (row, word, lanes that are not). ``dead`` are lanes that don't count."""
        bits = np.unpackbits(pivots, axis=1)
        # A plane in which all lanes and all pivots agree adds nothing.
        same = ~self.mixed & (bits == self.ones).all(axis=0)
        used = np.flatnonzero(~same)
        masks = np.where(bits[:, used].T.astype(bool), ~np.uint64(0), np.uint64(0))
        if self.n % 64:
            dead = np.where(word == self.words - 1, dead | (~np.uint64(0) << np.uint64(self.n % 64)), dead)
        depth = max(4, int(self.planes).bit_length())
        counters = [np.zeros(len(row), np.uint64) for _ in range(depth)]
        blank = np.zeros(len(row), np.uint64)
        for at in range(0, len(used), 8):
            d = [self.lanes[used[p]][word] ^ masks[p][row] for p in range(at, min(at + 8, len(used)))]
            d += [blank[: len(row)]] * (8 - len(d))
            one, a = _full_adder(counters[0], d[0], d[1])
            one, b = _full_adder(one, d[2], d[3])
            one, c = _full_adder(one, d[4], d[5])
            one, e = _full_adder(one, d[6], d[7])
            two, f = _full_adder(counters[1], a, b)
            two, g = _full_adder(two, c, e)
            four, carry = _full_adder(counters[2], f, g)
            counters[:3] = one, two, four
            for k in range(3, depth):
                counters[k], carry = counters[k] ^ carry, counters[k] & carry
            if (at + 8) > radius:
                dead = dead | _beyond(counters, radius)
                alive = dead != ~np.uint64(0)
                if alive.mean() < 0.7:
                    row, word, dead = row[alive], word[alive], dead[alive]
                    counters = [x[alive] for x in counters]
                    if not len(row):
                        break
        dead = dead | _beyond(counters, radius)
        hit = np.flatnonzero(dead != ~np.uint64(0))
        return row[hit], word[hit], dead[hit]


def linked_pairs(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (i, j), i < j, of all fingerprints (n, bytes) that differ in at most ``radius`` bits."""
    n = len(fps)
    if n < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    planes_ = _Planes(fps)
    words = planes_.words
    row, word = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(words), indexing="ij"))
    keep = word >= row // 64
    row, word = row[keep], word[keep]
    # Lanes at or before the row itself are out from the start.
    first = row + 1 - word * 64
    dead = np.where(first >= 64, ~np.uint64(0), np.where(first <= 0, np.uint64(0), (np.uint64(1) << np.clip(first, 0, 63).astype(np.uint64)) - np.uint64(1)))
    row, word, dead = planes_.within(fps, row, word, dead, radius)
    if not len(row):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    which, lane = np.nonzero(_lanes_of(~dead))
    return row[which].astype(np.int64), word[which] * 64 + lane


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row of each row's component."""
    label = np.arange(n)
    while len(a):
        left, right = label[a], label[b]
        low = np.minimum(left, right)
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        while (label[label] != label).any():
            label = label[label]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def cell_components(fps: np.ndarray, radius: int) -> np.ndarray:
    """The smallest row of each row's component, where rows within the radius are linked.

    A full cell mostly holds one group of near copies. From a few seeds its groups are followed to their ends first: what was
    found last is compared with what is left, so a group of n costs about n comparisons rather than all pairs. A
    group that is complete has no link to what is left, of which all pairs are then compared, part by part.
    """
    n = len(fps)
    label, left = np.arange(n), np.arange(n)
    order = np.random.RandomState(n)
    for _ in range(SEEDS if n > PAIR_ROWS else 0):
        if len(left) <= PAIR_ROWS:
            break
        front = left[[order.randint(len(left))]]
        left = left[left != front[0]]
        group = [front]
        while len(front) and len(left):
            rest = _Planes(fps[left])
            near = np.zeros(rest.words, np.uint64)
            step = max(1, LANES // rest.words)
            for at in range(0, len(front), step):
                some = fps[front[at : at + step]]
                row, word = (x.ravel() for x in np.meshgrid(np.arange(len(some)), np.arange(rest.words), indexing="ij"))
                _, word, far = rest.within(some, row, word, np.repeat(near[None], len(some), axis=0).ravel(), radius)
                np.bitwise_or.at(near, word, ~far)
            found = _lanes_of(near).ravel()[: len(left)].astype(bool)
            front, left = left[found], left[~found]
            group.append(front)
        group = np.concatenate(group)
        label[group] = group.min()
    a, b = [], []
    parts = [left[i : i + PAIR_ROWS // 2] for i in range(0, len(left), PAIR_ROWS // 2)] if len(left) > PAIR_ROWS else [left]
    for i, one in enumerate(parts):
        for other in parts[i + 1 :] if len(parts) > 1 else [one[:0]]:
            both = np.concatenate((one, other))
            x, y = linked_pairs(fps[both], radius)
            a.append(both[x])
            b.append(both[y])
    if a:
        rest = _forest(n, np.concatenate(a), np.concatenate(b))
        label[left] = rest[left]
    return label


def _cell_links(radius: int, size: int):
    def links(fp: list[bytes]) -> pa.RecordBatch:
        fp = sorted(set(fp))  # so that the cells of a group mostly name the same row
        fps = np.frombuffer(b"".join(fp), np.uint8).reshape(len(fp), size)
        label = cell_components(fps, radius)
        linked = np.flatnonzero(label != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array([fp[i] for i in linked], pa.binary()), pa.array([fp[i] for i in label[linked]], pa.binary())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        for table in sorted_groups(batches, "cell"):
            cells = table.column("cell").to_numpy()
            fps = table.column("fp").to_pylist()
            cuts = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1).tolist(), len(cells)]
            for x, y in zip(cuts, cuts[1:]):  # small cells share a comparison; what it finds besides is a link too
                if held and len(held) + y - x > BLOCK_ROWS:
                    yield links(held)
                    held = []
                held += fps[x:y]
        if held:
            yield links(held)

    return run


def _cells(planes: int, radius: int, rows: int, bands: tuple[int, int] | None) -> list[list[int]]:
    """For each table the planes that key it."""
    if bands:
        order = np.random.RandomState(7)
        return [sorted(order.choice(planes, bands[1], replace=False).tolist()) for _ in range(bands[0])]
    for m in range(1, 5):
        parts = radius + m
        bits = planes * m // parts
        if rows / 2.0**bits <= 128 or comb(parts + 1, m + 1) > 128:
            break
    edges = [round(i * planes / parts) for i in range(parts + 1)]
    return [[p for i in chosen for p in range(edges[i], edges[i + 1])] for chosen in combinations(range(parts), m)]


def _key(planes: list[int], size: int) -> Column:
    """A hash of the given planes of the binary column ``fp``."""
    masks = np.zeros(size * 8, np.uint8)
    masks[planes] = 1
    parts = []
    for i, word in enumerate(np.packbits(masks).view(">u8").astype(np.int64).tolist()):
        if word:
            parts.append(F.expr(f"w[{i}]").bitwiseAND(F.lit(word)))
    return F.xxhash64(*parts)


def _words(size: int) -> Column:
    """The fingerprint as an array of longs."""
    read = "transform(sequence(0, {n}), i -> cast(conv(substr(hex(fp), i * 16 + 1, 16), 16, -10) as bigint))"
    return F.expr(read.format(n=size // 8 - 1))


def links(distinct: DataFrame, planes: int, radius: int, bands: tuple[int, int] | None = None) -> DataFrame:
    """(a, b): a spanning forest, cell by cell, of the links between the distinct fingerprints ``fp``."""
    size = planes // 8
    tables = _cells(planes, radius, distinct.count(), bands)
    keyed = distinct.select("fp", _words(size).alias("w")).select(
        "fp", F.explode(F.array(*[F.xxhash64(F.lit(t), _key(p, size)) for t, p in enumerate(tables)])).alias("cell")
    )
    most = BAND_CELL_ROWS if bands else CELL_ROWS
    half = most // 2
    large = materialize(keyed.groupBy("cell").count().where(F.col("count") > most), "simhash-large")
    if large.count() <= BROADCAST_CELLS:  # else Spark shuffles both
        large = F.broadcast(large)
    shards = F.coalesce(F.ceil(F.col("count") / half), F.lit(1)).cast("int")
    mine = F.pmod(F.xxhash64("fp", F.lit(3)), F.col("shards")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("shards") - 1), lambda o: F.xxhash64("cell", F.least(o, F.col("mine")), F.greatest(o, F.col("mine"))))
    dealt = (
        keyed.join(large, "cell", "left")
        .select("fp", "cell", shards.alias("shards"))
        .withColumn("mine", mine)
        .select("fp", F.explode(F.when(F.col("shards") == 1, F.array("cell")).otherwise(pairs)).alias("cell"))
    )
    return dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(_cell_links(radius, size), "a binary, b binary")


def stars(edges: DataFrame) -> DataFrame:
    """(a, b): as few edges as connect the same vertices, where each cell links its rows ``a`` to one row ``b``.

    The rows to which cells link a row are linked to the smallest of them, and the row to that alone. So a group has about
    as many edges as rows, however many tables have found it. A row has as many links at most as cells.
    """
    linked = edges.where("a <> b").groupBy("a").agg(F.min("b").alias("b"), F.collect_set("b").alias("all"))
    return linked.select(F.explode(F.array_union(F.array("a"), "all")).alias("a"), "b").where("a <> b").distinct()


# ---- verification -------------------------------------------------------------------------------------------


def possible(rows: DataFrame, few: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with ``possible``: false only if no row of ``few`` has the same in the columns ``by``, so that a join need not shuffle the row.

    What is broadcast is a bitmap of hashes, of a bounded size. With more rows in ``few`` than it has bits for, more rows are possible in vain.
    """
    bits = min(MOST_BITS, max(_BUCKET_BITS, 1 << (few.count() * ROW_BITS).bit_length()))
    slot = F.pmod(F.xxhash64(*by, F.lit(5)), F.lit(bits))
    bucket, place = F.floor(slot / _BUCKET_BITS).alias("_bucket"), (slot % _BUCKET_BITS).alias("_place")
    bitmap = few.select(bucket, place).groupBy("_bucket").agg(F.bitmap_construct_agg("_place").alias("_bits"))
    byte = "cast(conv(hex(substring(_bits, cast(_place div 8 as int) + 1, 1)), 16, 10) as int)"
    held = rows.select("*", bucket, place).join(F.broadcast(bitmap), "_bucket", "left")
    return held.select(*rows.columns, F.expr(f"coalesce(getbit({byte}, cast(_place % 8 as int)), 0) = 1").alias("possible"))


def similar_forest(sets: list[np.ndarray], similar: float) -> np.ndarray:
    """A row of each row's component, where sets of a Jaccard similarity of at least ``similar`` are linked. Each set is sorted and without repeats; two empty ones are equal."""
    n = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), sizes)[shared := count[code] > 1]
    code = code[shared]
    ends = np.cumsum(np.bincount(row, minlength=n))
    own = [code[a:b] for a, b in zip(np.concatenate(([0], ends[:-1])).tolist(), ends.tolist())]
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]  # the index: rows by shingle
    stop = np.cumsum(np.bincount(code, minlength=len(count)))
    label, open_, indexed, left = np.full(n, -1), np.ones(n, bool), n, n
    for first in range(n):
        if label[first] >= 0:
            continue
        label[first], open_[first], todo = first, False, [first]
        left -= 1
        while todo:
            p = todo.pop()
            if left * 2 < indexed:
                row, code, indexed = row[stay := open_[row]], code[stay], left
                stop = np.cumsum(np.bincount(code, minlength=len(count)))
            to = stop[own[p]]
            many = to - np.where(own[p] > 0, stop[own[p] - 1], 0)
            at = np.repeat(to - np.cumsum(many), many) + np.arange(many.sum())
            both = np.bincount(row[at], minlength=n)
            found = np.flatnonzero(open_ & (both >= similar * (sizes[p] + sizes - both)))
            label[found], open_[found] = first, False
            left -= len(found)
            todo += found.tolist()
    return label


def _verified(similar: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, "cell"):
            cells, versions = table.column("cell").to_numpy(), table.column("version").to_numpy()
            sets = table.column("shingles")
            cuts = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1).tolist(), len(cells)]
            for x, y in zip(cuts, cuts[1:]):
                label = similar_forest([np.frombuffer(b.as_buffer(), np.uint64) for b in sets.slice(x, y - x)], similar)
                linked = np.flatnonzero(label != np.arange(y - x))
                if len(linked):
                    yield pa.RecordBatch.from_arrays([pa.array(versions[x:y][linked]), pa.array(versions[x:y][label[linked]])], ["a", "b"])

    return run


def _similar_links(docs: DataFrame, placed: DataFrame, id_col: str, text_col: str, shingle: int, similar: float) -> DataFrame:
    """(a, b): a spanning forest, cell by cell, of the links between versions that share a ``label`` in ``placed``.

    Of copies only the row of the smallest id, ``least``, is read, and other texts are not shuffled.
    """
    groups = placed.groupBy("label").agg(F.count("*").alias("n")).where("n > 1").select("label")
    asked = materialize(placed.join(groups, "label").select("version", "least", F.xxhash64("label").alias("cell")), "simhash-asked")
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).alias("least"), F.xxhash64(text).alias("version"), text.alias("text"))
    texts = possible(texts, asked, ["least", "version"]).where("possible").alias("t")
    same = (F.col("t.version") == F.col("a.version")) & F.col("t.least").eqNullSafe(F.col("a.least"))
    texts = texts.join(asked.alias("a"), same).select("t.version", "t.text", "a.cell")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [np.unique(_shingle_hashes(x.as_py(), shingle)).tobytes() for x in batch.column("text")]
        return pa.RecordBatch.from_arrays([batch.column("version"), batch.column("cell"), pa.array(made, pa.binary())], ["version", "cell", "shingles"])

    sets = texts.mapInArrow(per_batch(work, 500), "version long, cell long, shingles binary").groupBy("version", "cell").agg(F.first("shingles").alias("shingles"))
    sets = materialize(sets, "simhash-sets")
    large = sets.groupBy("cell").agg(F.ceil(F.sum(F.octet_length("shingles")) / SET_BYTES).cast("int").alias("shards")).where("shards > 2")
    large = materialize(large, "simhash-large-sets")
    mine = F.pmod(F.xxhash64("version", F.lit(3)), F.col("shards")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("shards") - 1), lambda o: F.xxhash64("cell", F.least(o, F.col("mine")), F.greatest(o, F.col("mine"))))
    dealt = sets.join(large, "cell", "left").withColumn("mine", mine)
    dealt = dealt.select("version", "shingles", F.explode(F.when(F.col("shards").isNull(), F.array("cell")).otherwise(pairs)).alias("cell"))
    return dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(_verified(similar), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(v, label): for each vertex of ``edges`` (a, b) the smallest vertex that it reaches.

    Labels spread along edges and are then replaced by their own labels, so paths halve in each round. Each round is
    written, and the one before it deleted, and joins read written tables, which lets Spark split the rows of a much-linked vertex.
    """
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "simhash-edges")
    labels = materialize(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("v")).alias("label")), "simhash-labels")
    rounds = Rounds(edges.sparkSession, "simhash-round")
    while True:
        offered = both.join(labels, both.a == labels.v).select(F.col("b").alias("v"), "label", F.lit(None).cast(dict(edges.dtypes)["a"]).alias("old"))
        spread = offered.union(labels.select("v", "label", F.col("label").alias("old"))).groupBy("v").agg(F.min("label").alias("label"), F.max("old").alias("old"))
        spread = rounds.store(spread)
        up = spread.select(F.col("v").alias("label"), F.col("label").alias("top"))
        jumped = spread.join(up, "label", "left").select("v", F.least("label", "top").alias("label"), "old")
        jumped = rounds.store(jumped)
        labels = jumped.select("v", "label")
        if jumped.where(F.col("label") != F.col("old")).isEmpty():
            return labels


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 4,
    planes: int = 64,
    radius: int = 4,
    bands: tuple[int, int] | None = None,
    similar: float | None = None,
) -> DataFrame:
    """One row for each row of ``docs``: its id, ``fp`` (binary) and ``component_id``, the smallest id it reaches.

    With ``similar``, only texts whose sets of shingles have at least that Jaccard similarity are linked, and ``radius``
    and ``bands`` say which are tried.

    Null and blank texts have the zero fingerprint and link like any other. Repeated rows and ids stay as they are.
    A row without id keeps its component; only a component in which no row has an id has a null ``component_id``.
    An empty table gives an empty result. Columns of ``docs`` other than the two named play no part.
    """
    found = _grouped(docs, id_col, text_col, shingle, planes, radius, bands, similar, similar is not None)
    return found.select(F.col("id").alias(id_col), "fp", "component_id")


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, planes: int, radius: int, bands: tuple[int, int] | None, similar: float | None, versions: bool) -> DataFrame:
    """(id, fp, label, component_id), and with ``versions`` a hash of the text: rows of a component have the same ``label``."""
    rows = materialize((_versions if versions else fingerprints)(docs, id_col, text_col, shingle, planes), "simhash-rows")
    distinct = materialize(rows.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
    found = links(distinct, planes, radius, bands)
    if similar is not None:  # links only propose, so hashes may stand for long fingerprints
        found = found.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b"))
    labels = components(materialize(stars(found), "simhash-links"))  # read twice, and dear to compute
    by = "fp" if similar is None else "version"
    if similar is None:
        placed = materialize(distinct.join(labels.withColumnRenamed("v", "fp"), "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label")), "simhash-placed")
    else:
        kinds = materialize(rows.groupBy(F.xxhash64("fp").alias("v"), "version").agg(F.min("id").alias("least")), "simhash-versions")
        tried = materialize(kinds.join(labels, "v", "left").select("version", "least", F.coalesce("label", "v").alias("label")), "simhash-tried")
        found = materialize(_similar_links(docs, tried, id_col, text_col, shingle, similar), "simhash-similar")
        labels = components(found).withColumnsRenamed({"v": "version", "label": "linked"})
        placed = materialize(tried.join(labels, "version", "left").select("version", "least", F.coalesce("linked", "version").alias("label")), "simhash-verified")
    smallest = materialize(placed.groupBy("label").agg(F.min("least").alias("component_id")), "simhash-smallest")
    named = materialize(placed.join(smallest, "label").select(by, "label", "component_id"), "simhash-named")
    return rows.join(named, by)


def one_of_each(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 4,
    planes: int = 64,
    radius: int = 4,
    bands: tuple[int, int] | None = None,
    similar: float | None = None,
) -> DataFrame:
    """``docs`` without near duplicates: the row of the smallest id of each component stays.

    Rows without id stay. Of rows that repeat a kept id one stays in each component, so different texts of an id do.
    """
    found = _grouped(docs, id_col, text_col, shingle, planes, radius, bands, similar, True).where("id is not null")
    texts = materialize(found.groupBy("id", "version", "label").agg((F.col("id") == F.first("component_id")).alias("stays"), F.count("*").alias("n")), "simhash-found")
    # What goes is far less than what stays, so texts are joined with that, and only those that may be among it.
    gone = texts.where("not stays").select("id", "version")
    repeated = materialize(texts.where("stays").groupBy("id", "label").agg(F.min("version").alias("first"), F.sum("n").alias("n")).where("n > 1"), "simhash-repeated")
    again = not repeated.isEmpty()
    if again:
        gone = gone.unionByName(texts.where("stays").join(repeated.select("id", "label", "first"), ["id", "label"]).where("version <> first").select("id", "version"))
    gone = materialize(gone, "simhash-gone")
    # The row travels as one column, so that its own columns may have any names.
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("version"))
    marked = possible(marked, gone, ["id", "version"])
    kept = marked.where("not possible").unionByName(marked.where("possible").join(gone, ["id", "version"], "left_anti"))
    if again:
        kept = kept.where(F.col("id").isNotNull()).dropDuplicates(["id", "version"]).unionByName(marked.where(F.col("id").isNull()))
    return kept.select("row.*")
