"""The prefix tree of conversations: what they share from their first turn on.

A prefix is named by its depth and the sum of hashes of its turns with their places, so prefixes come from running sums, by
blocks, whatever length a conversation has. A node, a distinct prefix, belongs to the smallest conversation that starts with it.
Whoever owns a prefix owns all its longer ones, so a binary search finds each conversation's first owned depth: in each
round all conversations ask one prefix each of the smallest owners of shared prefixes, and keep half of theirs.

What a conversation owns is a chain of nodes, which hangs on a node of another chain. Chains are aggregated bottom-up, each
adding what it has gathered to the chain so many steps above it, and steps double in each round. Sums along a chain
then give each of its nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import Rounds, materialize

BLOCK = 4096  # turns of a conversation that one group has
PIECE = 512  # ids that are hashed together
_SUMS = ("s1", "s2", "s3", "s4")
_GATHERED = ("ends", "end_bytes", "owned", "leaves")
_NOTHING = hashlib.sha256().hexdigest()


def _block(place: Column) -> Column:
    return F.floor(place / BLOCK)


def _to_turns(rows: DataFrame, own: DataFrame, place: str, low: Column, high: Column) -> DataFrame:
    """``rows`` joined with the row of their conversation in ``own``, which has their places from ``low`` to ``high``; no group has over BLOCK rows."""
    blocks = own.withColumn("_block", F.explode(F.sequence(_block(low), _block(high))))
    return rows.withColumn("_block", _block(F.col(place))).join(blocks, ["conv", "_block"]).drop("_block")


def numbered(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, pos, content, bytes): each turn's place in its conversation, from 1, a digest of role and text, and the text's bytes in UTF-8.

    Turns go by ``turn``, null first, then by role and text; null roles and texts are empty. Rows without conversation play no part.
    """
    blank = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = conversations.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), blank(role_col).alias("role"), blank(text_col).alias("text"))
    rows = rows.where("conv is not null").withColumn("row", F.monotonically_increasing_id())  # parts equal rows
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("row")]
    content = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    turns = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    turns = turns.select("conv", content.alias("content"), F.octet_length("text").cast("long").alias("bytes"), F.monotonically_increasing_id().alias("at"))
    turns = materialize(turns.withColumn("part", F.shiftrightunsigned("at", 33)), "trie-turns")
    parts = turns.groupBy("conv", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("part")) - F.col("n")
    parts = parts.select("conv", "part", (before + 1 - F.col("first")).alias("shift"))
    return turns.join(parts, ["conv", "part"]).select("conv", (F.col("at") + F.col("shift")).alias("pos"), "content", "bytes")


def grafted(turns: DataFrame, base: Callable[[Column], Column], head: Callable[[Column], Column], most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt from the first ``head`` turns of their ``base`` and their own turns after as many; and all of them, also without turns.

    ``turns`` are numbered; ``head`` is at most ``most``.
    """
    turns = materialize(turns, "trie-numbered")
    sizes = turns.groupBy("conv").agg(F.max("pos").alias("size")).select("conv", "size", base(F.col("conv")).alias("base"), head(F.col("conv")).cast("long").alias("head"))
    sizes = materialize(sizes, "trie-sizes")
    have = sizes.select(F.col("conv").alias("base"), F.col("size").alias("base_size"))
    plan = sizes.join(have, "base", "left").select("conv", "size", "base", "head", F.least("head", F.coalesce("base_size", F.lit(0))).alias("taken"))
    plan = materialize(plan, "trie-plan")
    first = turns.where(F.col("pos") <= most).select(F.col("conv").alias("base"), "pos", "content", "bytes")
    first = first.join(plan.where("taken > 0").select("conv", "base", "taken"), "base").where("pos <= taken").select("conv", "pos", "content", "bytes")
    own = _to_turns(turns, plan.where("size > head").select("conv", "size", "head", "taken"), "pos", F.col("head") + 1, F.col("size"))
    own = own.where("pos > head").select("conv", (F.col("pos") - F.col("head") + F.col("taken")).alias("pos"), "content", "bytes")
    return first.unionByName(own), plan.select("conv")


def running(rows: DataFrame, columns: tuple[str, ...], most: int) -> DataFrame:
    """``rows`` with each of ``columns`` summed up to and with the row, in each ``conv`` by ``pos``, which has no gaps and is at most ``most``.

    Sums are made by blocks, then over the blocks' sums in the same way.
    """
    rows = rows.withColumn("_block", _block(F.col("pos")))
    inside = Window.partitionBy("conv", "_block").orderBy("pos")
    local = rows.withColumns({c: F.sum(c).over(inside) for c in columns})
    if most < BLOCK:
        return local.drop("_block")
    totals = rows.groupBy("conv", "_block").agg(*[F.sum(c).alias(c) for c in columns]).withColumnRenamed("_block", "pos")
    before = running(totals, columns, most // BLOCK).select("conv", (F.col("pos") + 1).alias("_block"), *[F.col(c).alias(f"_{c}") for c in columns])
    return local.join(before, ["conv", "_block"], "left").select(*[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) if c in columns else F.col(c) for c in local.columns if c != "_block"])


def _prefixes(turns: DataFrame, sizes: DataFrame, most: int) -> DataFrame:
    """(conv, size, depth, k1, k2, bytes, total): each prefix's name, its last turn's bytes and those of all its turns."""
    parts = []
    for seed in (1, 2):
        h = F.xxhash64("pos", "content", F.lit(seed))
        parts += [h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32)]
    summed = turns.select("conv", "pos", "bytes", F.col("bytes").alias("total"), *[p.alias(s) for p, s in zip(parts, _SUMS)])
    summed = running(summed, (*_SUMS, "total"), most)
    named = summed.select("conv", F.col("pos").alias("depth"), F.xxhash64("pos", *_SUMS, F.lit(3)).alias("k1"), F.xxhash64("pos", *_SUMS, F.lit(4)).alias("k2"), "bytes", "total")
    return _to_turns(named, sizes.select("conv", "size"), "depth", F.lit(1), F.col("size"))


def _first_owned(prefixes: DataFrame) -> DataFrame:
    """(conv, first, parent, parent_total): the first depth that a conversation owns, its size and one if none, and who owns the one before."""
    key = ["depth", "k1", "k2"]
    minima = prefixes.groupBy(*key).agg(F.min("conv").alias("owner"), F.count("*").alias("n")).where("n > 1").select(*key, "owner")
    minima = materialize(minima, "trie-minima")
    parent = F.lit(None).cast(dict(prefixes.dtypes)["conv"])
    open_ = prefixes.select("conv", *key, "total", F.lit(1).cast("long").alias("low"), (F.col("size") + 1).alias("high"), parent.alias("parent"), F.lit(0).cast("long").alias("parent_total"))
    held, found = Rounds(prefixes.sparkSession, "trie-open"), None
    while True:
        asked = open_.where(F.col("depth") == F.floor((F.col("low") + F.col("high")) / 2)).join(minima, key, "left")
        mine = F.col("owner").isNull() | (F.col("owner") == F.col("conv"))
        pick = lambda yes, no: F.when(mine, yes).otherwise(no)
        moved = {"low": pick(F.col("low"), F.col("depth") + 1), "high": pick(F.col("depth"), F.col("high")), "parent": pick(F.col("parent"), F.col("owner")), "parent_total": pick(F.col("parent_total"), F.col("total"))}
        asked = materialize(asked.select("conv", *[c.alias(n) for n, c in moved.items()]), "trie-answers")
        done = asked.where("low = high").select("conv", F.col("low").alias("first"), "parent", "parent_total")
        found = done if found is None else found.union(done)
        left = asked.where("low < high")
        if left.isEmpty():
            return found
        open_ = held.store(_to_turns(open_.select("conv", *key, "total"), left, "depth", F.col("low"), F.col("high") - 1).where("depth >= low and depth < high"))


def _gather(chains: DataFrame, top) -> DataFrame:
    """``chains`` (conv, hop, and sums) with what lies below added to their sums. Those that hang on ``top`` reach it in one step."""
    rounds = Rounds(chains.sparkSession, "trie-chains")
    chains = rounds.store(chains)
    while not chains.where("hop is not null").isEmpty():
        sent = chains.where("hop is not null").groupBy(F.col("hop").alias("conv")).agg(*[F.sum(c).alias(f"_{c}") for c in _GATHERED])
        further = chains.select(F.col("conv").alias("hop"), F.col("hop").alias("_hop")).where("_hop is not null")
        last = chains.where(F.col("hop").isNull() | (F.col("hop") == F.lit(top))).withColumn("_hop", F.lit(None).cast(dict(chains.dtypes)["hop"]))
        moved = chains.where(F.col("hop") != F.lit(top)).join(further, "hop", "left").select(*last.columns).unionByName(last)
        added = moved.join(sent, "conv", "left")
        chains = rounds.store(added.select("conv", F.col("_hop").alias("hop"), *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in _GATHERED]))
    return chains


def _ends_digests(ends: DataFrame) -> DataFrame:
    """(conv, depth, ends_sha256): for each node the SHA-256 of the ids in ``member``, ascending and joined by commas.

    Ids are sorted over all tasks and joined to pieces, and a node's pieces are hashed one after the other.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            conv, depth, member = (batch.column(c) for c in ("conv", "depth", "member"))
            c, d = (np.unique(x.to_numpy(zero_copy_only=False), return_inverse=True)[1] for x in (conv, depth))
            change = np.flatnonzero((c[1:] != c[:-1]) | (d[1:] != d[:-1])) + 1
            cuts = sorted({0, batch.num_rows, *change.tolist(), *range(0, batch.num_rows, PIECE)})
            names = member.cast(pa.string()).to_pylist()
            at = pa.array(cuts[:-1])
            joined = pa.array([",".join(names[x:y]) for x, y in zip(cuts, cuts[1:])], pa.string())
            yield pa.RecordBatch.from_arrays([conv.take(at), depth.take(at), member.take(at), joined], ["conv", "depth", "member", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, made = None, None
        for batch in batches:
            out = []
            for conv, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("conv", "depth", "ids"))):
                if (conv, depth) != node:
                    if node:
                        out.append((*node, made.hexdigest()))
                    node, made = (conv, depth), hashlib.sha256(ids.encode())
                else:
                    made.update(b"," + ids.encode())
            if out:
                yield batch_of(out, batch)
            last = batch
        if node:
            yield batch_of([(*node, made.hexdigest())], last)

    def batch_of(rows: list[tuple], like: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], like.column("conv").type), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], ["conv", "depth", "ends_sha256"])

    kind = dict(ends.dtypes)["conv"]
    order = ("conv", "depth", "member")
    short = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pieces, f"conv {kind}, depth long, member {kind}, ids string")
    return short.repartition("conv", "depth").sortWithinPartitions(*order).mapInArrow(digests, f"conv {kind}, depth long, ends_sha256 string")


def prefix_trie(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """One row for each distinct prefix of the numbered ``turns``, the root of depth 0 included.

    ``conv_id`` is the smallest conversation that starts with it and ``parent_conv_id`` the same of its parent, null for the root;
    ``n_convs`` start with it, ``n_children`` prefixes go one turn on, ``n_leaves`` below or at it go none; ``saved_tokens`` is what
    storing each text of the subtree once spares, in bytes; ``ends_sha256`` digests the conversations that end there. ``conversations``
    (conv) names them all where some have no turns. Without any conversation there is no node, not even the root.
    """
    turns = materialize(turns, "trie-all")
    totals = turns.groupBy("conv").agg(F.max("pos").alias("size"), F.sum("bytes").alias("all_bytes"))
    sizes = materialize(totals, "trie-totals")
    every = sizes if conversations is None else conversations.select("conv").distinct().join(sizes, "conv", "left").fillna(0, ["size", "all_bytes"])
    bounds = every.agg(F.min("conv").alias("top"), F.max("size").alias("most")).first()
    top, most = bounds.top, bounds.most or 0
    prefixes = materialize(_prefixes(turns, sizes, most), "trie-prefixes")
    mine = F.col("conv") == F.lit(top)
    found = every.join(_first_owned(prefixes), "conv", "left")
    first = F.when(mine, 0).otherwise(F.coalesce("first", F.lit(1)))  # of conversations the least owns the root
    found = found.select("conv", "size", "all_bytes", first.cast("long").alias("first"), F.when(~mine, F.coalesce("parent", F.lit(top))).alias("parent"), F.coalesce("parent_total", F.lit(0)).alias("before"))
    found = materialize(found, "trie-found")
    owns = F.col("first") <= F.col("size")
    ends = materialize(found.select(F.when(owns, F.col("conv")).otherwise(F.col("parent")).alias("conv"), F.col("size").alias("depth"), F.col("conv").alias("member"), "all_bytes"), "trie-ends")
    at_ends = ends.groupBy("conv", "depth").agg(F.count("*").alias("ends"), F.sum("all_bytes").alias("end_bytes"))
    chains = found.where(owns)
    hangs = chains.where("parent is not null").select(F.col("parent").alias("conv"), (F.col("first") - 1).alias("depth"), F.col("conv").alias("below"))
    tips = hangs.select("conv", F.col("depth").alias("size")).distinct().withColumn("goes_on", F.lit(True))
    here = at_ends.groupBy("conv").agg(F.sum("ends").alias("ends"), F.sum("end_bytes").alias("end_bytes"))
    owned = (F.col("all_bytes") - F.col("before")).alias("owned")
    leaves = F.when(F.col("goes_on"), 0).otherwise(1).cast("long").alias("leaves")
    start = chains.join(tips, ["conv", "size"], "left").join(here, "conv", "left").select("conv", F.col("parent").alias("hop"), "ends", "end_bytes", owned, leaves)
    sums = _gather(start, top)
    hung = hangs.join(sums.withColumnRenamed("conv", "below"), "below").groupBy("conv", "depth").agg(F.count("*").alias("hung"), *[F.sum(c).alias(c) for c in _GATHERED])
    zero = F.lit(0).cast("long")
    at_ends = at_ends.select("conv", "depth", zero.alias("hung"), "ends", "end_bytes", zero.alias("owned"), zero.alias("leaves"))
    events = hung.unionByName(at_ends).groupBy("conv", "depth").agg(*[F.sum(c).alias(c) for c in ("hung", *_GATHERED)])
    # A node has what its chain has gathered but for what lies before it on the chain.
    facts = chains.select("conv", "size", "first", "parent", "before").join(sums.select("conv", *[F.col(c).alias(f"all_{c}") for c in _GATHERED]), "conv")
    facts = materialize(facts, "trie-facts")
    nodes = _to_turns(prefixes.select("conv", "depth", "bytes", "total"), facts, "depth", F.col("first"), F.col("size")).where("depth >= first")
    root = facts.where(mine).select("conv", zero.alias("depth"), zero.alias("bytes"), zero.alias("total"), *facts.columns[1:])
    nodes = nodes.unionByName(root).join(events, ["conv", "depth"], "left").withColumn("pos", F.col("depth"))
    nodes = nodes.fillna(0, ["hung", *_GATHERED]).withColumns({f"own_{c}": F.col(c) for c in _GATHERED})
    nodes = running(materialize(nodes, "trie-nodes"), _GATHERED, most)
    rest = {c: F.col(f"all_{c}") - F.col(c) + F.col(f"own_{c}") for c in _GATHERED}
    prior = F.col("total") - F.col("bytes")
    saved = rest["end_bytes"] - rest["ends"] * prior - (rest["owned"] - (prior - F.col("before")))
    return nodes.join(_ends_digests(ends.select("conv", "depth", "member")), ["conv", "depth"], "left").select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.when(F.col("depth") > F.col("first"), F.col("conv")).otherwise(F.col("parent")).alias("parent_conv_id"),
        rest["ends"].alias("n_convs"),
        (F.col("hung") + (F.col("depth") < F.col("size")).cast("long")).alias("n_children"),
        rest["leaves"].alias("n_leaves"),
        saved.alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(_NOTHING)).alias("ends_sha256"),
    )
