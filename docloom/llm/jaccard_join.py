"""Jaccard self-join of shingle sets, light sets by subsets and heavy ones by inverted lists.

Texts of equal sets are folded first, so copies cost nothing. For the distinct sets links are proposed, none of which is
lost, and then verified from the sets themselves.

Light sets, of at most ``x`` shingles: two sets of sizes a and b that link share ``overlap(a, b)`` shingles. For each size b
that can link with its own, a set emits all its subsets of that many shingles; equal subsets propose a link.

Heavy sets: shingles are put into one order, those that many texts hold last. Two sets that link share one of the first
``a - need(a) + 1`` shingles of each, so only these enter inverted lists, cut into bands of sizes that can link. Lists of the same sets count
once. A list is scanned with sketches, the parities of about as many hash slots as a set has shingles: two sets differ in at least as many
shingles as their sketches in bits, so what a sketch rules out is no link. Long lists are cut into shards, and each
pair of shards becomes a cell of its own. Cells return spanning forests, never all pairs.

The boundary ``x`` is that of the least cost, counted in rows: subsets of the light sets against what scanning the
lists of the others reads. It changes the cost, not the result.

What proposals connect forms a group, and in a group all pairs are compared by an inverted index over whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import materialize, per_batch, sorted_groups
from .simhash import SET_BYTES, _forest, _verified, components, possible, stars

LIGHT_MOST = 40  # shingles, up to which the boundary is looked for
CHUNK_SHINGLES = 1 << 21  # in which frequent shingles are counted
CHUNK_COUNT = 3  # from which a chunk reports a shingle
CLASSES = (8, 256, 8192)  # texts, from which a shingle is put behind rarer ones
CLASS_BITS = 1 << 26  # of a bitmap for each class: 8 MB
LIST_ROWS = 4096
COPIES = 256  # rows of a set, from which they are dealt over several tasks
SALTS = 64
_BUCKET_BITS = 1 << 15  # of each row that ``bitmap_construct_agg`` makes


class _Words(dict):
    """Hashes of words; short ones are kept."""

    def __missing__(self, word: bytes) -> int:
        made = xxhash.xxh64_intdigest(word, 42)
        if len(word) <= 64:
            if len(self) >= 1 << 20:
                self.clear()
            self[word] = made
        return made


_words = _Words()


def shingle_set(text: bytes | None, shingle: int = 3) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text in UTF-8; with fewer words the whole sequence is one, without words there is none."""
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    k = min(shingle, n)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    made = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        made = (made ^ h[j : n - k + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        made ^= made >> np.uint64(29)
    made *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(made ^ (made >> np.uint64(32)))


def set_digest(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


def _key(digest: bytes) -> int:
    """What stands for a set where links are only proposed."""
    return int.from_bytes(digest[:8], "little", signed=True)


def need(size: int, num: int, den: int) -> int:
    """The least overlap of a set of this size with any that it links with, which is also the least size of such a one."""
    return -(-num * size // den)


def overlap(a: int, b: int, num: int, den: int) -> int:
    """The least overlap of two sets of these sizes that link."""
    return -(-num * (a + b) // (num + den))


def partners(size: int, most: int, num: int, den: int) -> range:
    """The sizes up to ``most`` of sets that can link with one of ``size``."""
    return range(need(size, num, den), min(most, den * size // num) + 1)


def sketch(found: np.ndarray) -> bytes:
    """Parities of hash slots, at least as many as there are shingles and a power of two."""
    bits = max(64, 1 << max(0, len(found) - 1).bit_length())
    odd = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


# ---- sets of all texts --------------------------------------------------------------------------------------


def _collected(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """One row for each text with its set's size, digest and sketch, and rows with a null digest for shingles that recur in a chunk of texts."""
    text = F.col(text_col).cast("string")
    frame = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("version"), text.cast("binary").alias("text"))
    kind = frame.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        held: dict[bytes, np.ndarray] = {}
        total, id_type = 0, to_arrow_type(kind)

        def recurring() -> pa.RecordBatch:
            shingles, count = np.unique(np.concatenate(list(held.values())), return_counts=True)
            often = count >= CHUNK_COUNT
            n = int(often.sum())
            none = [pa.nulls(n, t) for t in (id_type, pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.binary())]
            return pa.RecordBatch.from_arrays([*none, pa.array(shingles[often].view(np.int64)), pa.array(count[often])], names)

        names = ["id", "version", "n", "digest", "k", "sketch", "light", "shingle", "texts"]
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                sets = [shingle_set(x.as_py(), shingle) for x in batch.column("text")]
                digests = [set_digest(s) for s in sets]
                blank = pa.nulls(len(sets), pa.int64())
                columns = [
                    batch.column("id").cast(id_type),
                    batch.column("version"),
                    pa.array([len(s) for s in sets], pa.int32()),
                    pa.array(digests, pa.binary()),
                    pa.array([_key(d) for d in digests], pa.int64()),
                    pa.array([sketch(s) for s in sets], pa.binary()),
                    pa.array([s.tobytes() if len(s) <= LIGHT_MOST else b"" for s in sets], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays([*columns, blank, blank], names)
                for d, s in zip(digests, sets):
                    if d not in held:
                        held[d] = s
                        total += len(s)
                        if total >= CHUNK_SHINGLES:
                            yield recurring()
                            held, total = {}, 0
        if held:
            yield recurring()

    schema = f"id {dict(frame.dtypes)['id']}, version long, n int, digest binary, k long, sketch binary, light binary, shingle long, texts long"
    return frame.mapInArrow(run, schema)


def _slot(shingle: Column, bits: int) -> Column:
    return F.shiftrightunsigned(shingle, 20).bitwiseAND(F.lit(bits - 1))


def _classes(collected: DataFrame) -> list[np.ndarray]:
    """For each of CLASSES a bitmap of the shingles that so many texts hold, by counts that may be too low.

    Any bitmaps give one order for all sets, so wrong bits cost time only.
    """
    counts = materialize(collected.where("digest is null").groupBy("shingle").agg(F.sum("texts").alias("texts")).where(F.col("texts") >= CLASSES[0]), "jaccard-frequent")
    bits = min(CLASS_BITS, max(_BUCKET_BITS, 1 << (counts.count() * 32).bit_length()))
    out = []
    for least in CLASSES:
        slot = _slot(F.col("shingle"), bits)
        rows = counts.where(F.col("texts") >= least).select(F.floor(slot / _BUCKET_BITS).alias("bucket"), (slot % _BUCKET_BITS).alias("place"))
        bitmap = np.zeros(bits // 8, np.uint8)
        for r in rows.groupBy("bucket").agg(F.bitmap_construct_agg("place").alias("bits")).collect():  # at most CLASS_BITS in all
            part = np.frombuffer(r.bits, np.uint8)
            bitmap[r.bucket * _BUCKET_BITS // 8 :][: len(part)] = part[: bits // 8]
        out.append(bitmap)
    return out


def first_shingles(found: np.ndarray, bitmaps: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Those of a set that enter inverted lists: the first by class, then by hash."""
    n = len(found)
    if not n:
        return found
    slot = (found >> np.uint64(20)) & np.uint64(len(bitmaps[0]) * 8 - 1)
    byte, bit = (slot >> np.uint64(3)).astype(np.int64), (slot & np.uint64(7)).astype(np.uint8)
    rank = np.zeros(n, np.uint8)
    for b in bitmaps:
        rank += b[byte] >> bit & 1
    return found[np.argsort(rank, kind="stable")[: n - need(n, num, den) + 1]]


def _listed(docs: DataFrame, text_col: str, shingle: int, bitmaps: list[np.ndarray], num: int, den: int) -> DataFrame:
    """(shingle, k, n): the entries of the inverted lists; equal sets of several batches repeat theirs."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmaps)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen, first, many, keys, sizes = set(), [], [], [], []
        for x in batch.column("text"):
            found = shingle_set(x.as_py(), shingle)
            digest = set_digest(found)
            if len(found) and digest not in seen:
                seen.add(digest)
                first.append(first_shingles(found, shared.value, num, den))
                many.append(len(first[-1]))
                keys.append(_key(digest))
                sizes.append(len(found))
        shingles = np.concatenate(first).view(np.int64) if first else np.empty(0, np.int64)
        columns = [pa.array(shingles), pa.array(np.repeat(np.array(keys, np.int64), many)), pa.array(np.repeat(np.array(sizes, np.int32), many))]
        return pa.RecordBatch.from_arrays(columns, ["shingle", "k", "n"])

    return docs.select(F.col(text_col).cast("string").cast("binary").alias("text")).mapInArrow(per_batch(work, 500), "shingle long, k long, n int")


# ---- light sets ---------------------------------------------------------------------------------------------


def subsets_of(size: int, most: int, num: int, den: int) -> int:
    """How many subsets a set emits."""
    return sum(comb(size, overlap(size, b, num, den)) for b in partners(size, most, num, den))


def boundary(sets: dict[int, int], scanned: dict[int, int], num: int, den: int) -> int:
    """The size up to which sets are light, of the least cost; ``sets`` and ``scanned`` have, by size, the sets and the rows that their lists hold."""

    def cost(x: int) -> int:
        light = sum(n * subsets_of(a, x, num, den) for a, n in sets.items() if 0 < a <= x)
        return light + sum(rows for a, rows in scanned.items() if a >= need(x + 1, num, den))

    return min(range(LIGHT_MOST + 1), key=lambda x: (cost(x), x))


@lru_cache(256)
def _left_out(size: int, out: int) -> np.ndarray:
    return np.array(list(combinations(range(size), out)), np.int64).reshape(comb(size, out), out)


def subset_keys(found: np.ndarray, most: int, num: int, den: int) -> np.ndarray:
    """A hash of each subset that the set shares with a light set it links with."""
    a, total, out = len(found), found.sum(dtype=np.uint64), []
    for b in partners(a, most, num, den):
        t = overlap(a, b, num, den)
        part = total - found[_left_out(a, a - t)].sum(axis=1, dtype=np.uint64)
        part ^= np.uint64((min(a, b) << 32) + max(a, b))
        part *= np.uint64(0x9E3779B97F4A7C15)
        out.append(part ^ (part >> np.uint64(31)))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _light_links(sets: DataFrame, most: int, num: int, den: int) -> DataFrame:
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [subset_keys(np.frombuffer(x.as_buffer(), np.uint64), most, num, den) for x in batch.column("light")]
        keys = np.concatenate(made).view(np.int64) if made else np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(batch.column("k").to_numpy(), [len(m) for m in made]))], ["subset", "k"])

    light = sets.where(F.col("n") <= most).select("k", "light")
    keys = materialize(light.mapInArrow(per_batch(work, 100), "subset long, k long"), "jaccard-subsets")
    common = keys.groupBy("subset").agg(F.min("k").alias("b"), F.max("k").alias("last")).where("b <> last").select("subset", "b")
    common = materialize(common, "jaccard-common")
    return possible(keys, common, ["subset"]).where("possible").join(common, "subset").where("k <> b").select(F.col("k").alias("a"), "b").distinct()


# ---- heavy sets ---------------------------------------------------------------------------------------------


def plausible(ham: np.ndarray, a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """False only for sets of sizes a and b that can't link, given in how many bits their sketches differ."""
    return ((num + den) * ham <= (den - num) * (a + b)) & (den * np.minimum(a, b) >= num * np.maximum(a, b))


def plausible_forest(sizes: np.ndarray, sketches: list[bytes], num: int, den: int) -> np.ndarray:
    """A row of each row's component, where rows whose sketches allow a link are connected.

    Sketches are compared with those of their width and with those of twice that, folded. What was found last is compared with what is left.
    """
    n = len(sizes)
    width = np.fromiter(map(len, sketches), np.int64, n)
    a, b = [], []
    for w in np.unique(width).tolist():
        own, up = np.flatnonzero(width == w), np.flatnonzero(width == 2 * w)
        bits = np.frombuffer(b"".join(sketches[i] for i in own), np.uint64).reshape(len(own), w // 8)
        if len(up):
            wide = np.frombuffer(b"".join(sketches[i] for i in up), np.uint64).reshape(len(up), w // 4)
            bits = np.concatenate((bits, wide[:, : w // 8] ^ wide[:, w // 8 :]))
        rows = np.concatenate((own, up))
        size, narrow = sizes[rows], np.arange(len(rows)) < len(own)
        left = np.arange(len(rows))
        while len(left) > 1:
            todo, left = [left[0]], left[1:]
            while todo and len(left):
                p = todo.pop()
                ham = np.bitwise_count(bits[left] ^ bits[p]).sum(axis=1, dtype=np.int64)
                near = plausible(ham, size[left], size[p], num, den) & (narrow[left] | narrow[p])
                found, left = left[near], left[~near]
                a.append(np.full(len(found), rows[p]))
                b.append(rows[found])
                todo += found.tolist()
    return _forest(n, np.concatenate(a), np.concatenate(b)) if a else np.arange(n)


def _list_links(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, "cell"):
            cells, keys, sizes = (table.column(c).to_numpy() for c in ("cell", "k", "n"))
            sketches, sizes = table.column("sketch").to_pylist(), sizes.astype(np.int64)
            cuts = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1).tolist(), len(cells)]
            a, b = [], []
            for x, y in zip(cuts, cuts[1:]):
                label = plausible_forest(sizes[x:y], sketches[x:y], num, den)
                linked = np.flatnonzero(label != np.arange(y - x))
                a.append(keys[x:y][linked])
                b.append(keys[x:y][label[linked]])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return run


def _heavy_links(entries: DataFrame, lists: DataFrame, sets: DataFrame, light: int, num: int, den: int) -> DataFrame:
    least = need(light + 1, num, den)  # smaller sets link with light ones only
    some = possible(entries.where(F.col("n") >= least), lists, ["shingle"]).where("possible")
    some = some.join(lists.select("shingle"), "shingle").select("shingle", "k", "n").distinct()
    # Sizes of sets that link lie in one band or in neighbouring ones, so each entry enters the cells of two.
    band = F.floor(F.log(F.col("n").cast("double")) / (math.log(den / num) * (1 + 1e-9)))
    cell = F.explode(F.array(*[F.xxhash64("shingle", band + i) for i in (0, 1)])).alias("cell")
    cells = materialize(some.select(cell, "k", "n"), "jaccard-entries")
    once = cells.groupBy("cell").agg(F.count("*").alias("rows"), F.max("n").alias("largest"), *_digest("k")).where((F.col("rows") > 1) & (F.col("largest") > light))
    once = materialize(once.groupBy("rows", "d1", "d2", "d3", "d4").agg(F.min("cell").alias("cell")).select("cell", "rows"), "jaccard-lists")
    cells = materialize(possible(cells, once, ["cell"]).where("possible").join(once, "cell").select("cell", "k", "n", "rows"), "jaccard-cells")
    asked = cells.select("k").distinct()
    sketches = materialize(possible(sets, asked, ["k"]).where("possible").select("k", "n", "sketch"), "jaccard-sketches")
    half = LIST_ROWS // 2
    shards = F.when(F.col("rows") > LIST_ROWS, F.ceil(F.col("rows") / half)).otherwise(1).cast("int")
    mine = F.pmod(F.xxhash64("k", F.lit(3)), F.col("shards")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("shards") - 1), lambda o: F.xxhash64("cell", F.least(o, F.col("mine")), F.greatest(o, F.col("mine"))))
    dealt = cells.select("cell", "k", "n", shards.alias("shards")).withColumn("mine", mine)
    dealt = dealt.select("k", "n", F.explode(F.when(F.col("shards") == 1, F.array("cell")).otherwise(pairs)).alias("cell"))
    return dealt.join(sketches, ["k", "n"]).select("cell", "k", "n", "sketch").repartition("cell").sortWithinPartitions("cell").mapInArrow(_list_links(num, den), "a long, b long")


def _digest(name: str) -> list[Column]:
    """Sums that tell which rows of a group have which values."""
    out = []
    for seed in (1, 2):
        h = F.xxhash64(name, F.lit(seed))
        out += [F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))), F.sum(F.shiftrightunsigned(h, 32))]
    return [c.alias(f"d{i}") for i, c in enumerate(out, 1)]


def _proposed(entries: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    lists = entries.groupBy("shingle").agg(F.min("k").alias("low"), F.max("k").alias("high"), F.count("*").alias("rows")).where("low <> high")
    lists = materialize(lists.select("shingle", "rows"), "jaccard-shared")
    small = F.col("n") <= LIGHT_MOST
    counts = {r.n: r.sets for r in sets.where(small).groupBy("n").agg(F.count("*").alias("sets")).collect()}
    scanned = possible(entries.where(small), lists, ["shingle"]).where("possible").join(lists, "shingle")
    light = boundary(counts, {r.n: r.scanned for r in scanned.groupBy("n").agg(F.sum("rows").alias("scanned")).collect()}, num, den)
    return _light_links(sets, light, num, den).union(_heavy_links(entries, lists, sets, light, num, den))


# ---- verification -------------------------------------------------------------------------------------------


def _verify(docs: DataFrame, asked: DataFrame, id_col: str, text_col: str, shingle: int, similar: float) -> DataFrame:
    """(a, b): a spanning forest, cell by cell, of the links between sets that share a ``cell`` in ``asked``. Of equal sets one text is read."""
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).alias("least"), F.xxhash64(text).alias("version"), text.cast("binary").alias("text"))
    texts = possible(texts, asked, ["least", "version"]).where("possible").alias("t")
    same = (F.col("t.version") == F.col("a.version")) & F.col("t.least").eqNullSafe(F.col("a.least"))
    texts = texts.join(asked.alias("a"), same).select("t.text", "a.cell", "a.digest")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [shingle_set(x.as_py(), shingle).tobytes() for x in batch.column("text")]
        return pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("cell"), pa.array(made, pa.binary())], ["version", "cell", "shingles"])

    sets = texts.mapInArrow(per_batch(work, 500), "version binary, cell long, shingles binary").dropDuplicates(["version", "cell"])
    sets = materialize(sets, "jaccard-sets")
    large = sets.groupBy("cell").agg(F.ceil(F.sum(F.octet_length("shingles")) / SET_BYTES).cast("int").alias("shards")).where("shards > 2")
    large = materialize(large, "jaccard-large")
    mine = F.pmod(F.xxhash64("version", F.lit(3)), F.col("shards")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("shards") - 1), lambda o: F.xxhash64("cell", F.least(o, F.col("mine")), F.greatest(o, F.col("mine"))))
    dealt = sets.join(large, "cell", "left").withColumn("mine", mine)
    dealt = dealt.select("version", "shingles", F.explode(F.when(F.col("shards").isNull(), F.array("cell")).otherwise(pairs)).alias("cell"))
    return dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(_verified(similar), "a binary, b binary")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """One row for each row of ``docs``: its id, ``n_shingles`` and ``component_id``, the smallest id that links reach.

    Texts link when ``den`` times the common shingles are at least ``num`` times those of either. A null text, or one
    without words, has no shingles and links with nothing: its ``component_id`` is its own id. Repeated rows and ids stay as
    they are. A row without id keeps its component; only one in which no row has an id has a null ``component_id``. An empty
    table gives an empty result. Columns of ``docs`` other than the two named play no part. ``num`` is over half of ``den``.
    """
    collected = materialize(_collected(docs, id_col, text_col, shingle), "jaccard-rows")
    rows = collected.where("digest is not null")
    version = F.coalesce(F.min_by("version", "id"), F.min("version")).alias("version")
    kinds = rows.where("n > 0").groupBy("digest", "k", "n", "sketch", "light").agg(F.min("id").alias("least"), version, F.count("*").alias("copies"))
    sets = materialize(kinds, "jaccard-distinct")
    entries = materialize(_listed(docs, text_col, shingle, _classes(collected), num, den), "jaccard-listed")
    proposed = materialize(stars(_proposed(entries, sets, num, den)), "jaccard-proposed")
    groups = components(proposed).select(F.col("v").alias("k"), F.col("label").alias("cell"))
    asked = materialize(sets.join(groups, "k").select("digest", "least", "version", "cell"), "jaccard-asked")
    labels = components(materialize(_verify(docs, asked, id_col, text_col, shingle, num / den), "jaccard-links")).withColumnRenamed("v", "digest")
    placed = materialize(sets.join(labels, "digest", "left").select("digest", "least", "copies", F.coalesce("label", "digest").alias("label")), "jaccard-placed")
    smallest = placed.groupBy("label").agg(F.min("least").alias("component_id"))
    named = materialize(placed.join(smallest, "label").select("digest", "copies", "component_id"), "jaccard-named")
    # Rows of a set with many copies are dealt over several tasks.
    many = materialize(named.where(F.col("copies") > COPIES).select("digest"), "jaccard-copies")
    salt = F.when(F.col("possible") | (F.col("n") == 0), F.monotonically_increasing_id() % SALTS).otherwise(F.lit(0))
    left = possible(rows.select("id", "n", "digest"), many, ["digest"]).select("id", "n", "digest", salt.alias("salt"))
    salts = F.when(F.col("possible"), F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    right = possible(named, many, ["digest"]).select("digest", "component_id", F.explode(salts).alias("salt"))
    found = left.join(right, ["digest", "salt"], "left")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    return found.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))
