"""Clustering of a document's mentions under must-link and cannot-link constraints.

Complete linkage never joins what no link of at least the threshold connects, and two clusters that prefer each other to all
others are joined whatever happens elsewhere. So a document of any size can be clustered: one of few links is a
group of its own; of a larger one the connected components are, and in a component that is still too large all clusters that
prefer each other are joined, in rounds over the table of its links, until few enough are left.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import text as T
from docloom.operators import graph
from docloom.sources.steps import Rounds, stored

#: Links of a group that one worker takes; more are joined in rounds before. It changes the cost, not the result.
GROUP_LINKS = 150_000
ALWAYS = float("inf")


def merges(n: int, link: dict[tuple[int, int], float], threshold: float, must: Iterable[tuple[int, int]] = (), cannot: Iterable[tuple[int, int]] = ()) -> list[tuple[float, int, int]]:
    """(linkage, a, b): the joins of complete linkage over mentions 0 to n - 1, in order; the cluster of b goes into that of a, the smaller.

    Must-links join first, in order, unless the clusters are kept apart; their linkage is ALWAYS. Then the pair of clusters with the
    highest linkage of at least ``threshold`` is joined, again and again; of equal ones that with the smaller left, then
    right, first member. Linkage is the lowest score between members; a pair without a score prevents it.
    """
    key = lambda i, j: (i, j) if i < j else (j, i)
    made: list[tuple[float, int, int]] = []
    members = {i: [i] for i in range(n)}
    root = list(range(n))
    near: dict[int, dict[int, float]] = {i: {} for i in range(n)}
    blocked: dict[int, set[int]] = {i: set() for i in range(n)}
    for (i, j), s in link.items():
        near[i][j] = near[j][i] = s
    for i, j in cannot:
        blocked[i].add(j)
        blocked[j].add(i)

    def join(s: float, a: int, b: int) -> None:
        """What either is kept apart from stays so, and a missing linkage stays missing."""
        made.append((s, a, b))
        for other in list(near[b]):
            del near[other][b]
        kept = {o: min(s, near[b][o]) for o, s in near[a].items() if o in near[b]}
        for other in near[a]:
            if other != b and other not in kept:
                del near[other][a]
        near[a] = kept
        for other, s in kept.items():
            near[other][a] = s
        for other in blocked[b]:
            blocked[other].discard(b)
            blocked[other].add(a)
        blocked[a] |= blocked[b]
        members[a] += members.pop(b)
        for m in members[a]:
            root[m] = a
        near.pop(b)
        blocked.pop(b)

    for i, j in sorted(key(i, j) for i, j in must):
        a, b = key(root[i], root[j])
        if a != b and b not in blocked[a]:
            join(ALWAYS, a, b)
    for a, others in blocked.items():  # from here on, apart is as good as without a score
        for b in others:
            near[a].pop(b, None)
    _join_equals(near, threshold, made)
    heap = [(-s, i, j) for i in near for j, s in near[i].items() if i < j and s >= threshold and j not in blocked[i]]
    heapq.heapify(heap)
    while heap:
        s, a, b = heapq.heappop(heap)
        if a not in near or near[a].get(b) != -s or b in blocked[a]:
            continue
        join(-s, a, b)
        for other, t in near[a].items():
            if t >= threshold and other not in blocked[a]:
                heapq.heappush(heap, (-t, *key(a, other)))
    return made


def _join_equals(near: dict[int, dict[int, float]], threshold: float, made: list[tuple[float, int, int]]) -> None:
    """Join sets whose pairs have the same highest score, which none of them has with any other, before anything is put in order: often equal names."""
    top = {v: max(scores.values()) for v, scores in near.items() if scores}
    ties = {v: {o for o, s in near[v].items() if s == t} | {v} for v, t in top.items() if t >= threshold}
    for v in sorted(ties):
        own = ties[v]
        if min(own) != v or not all(top[w] == top[v] and ties.get(w) == own for w in own):
            continue
        rest = sorted(own - {v})
        made += [(top[v], v, w) for w in rest]
        kept = {o: s for o, s in near[v].items() if o not in own}
        for w in rest:
            mine = near.pop(w)
            kept = {o: min(s, mine[o]) for o, s in kept.items() if o in mine}
            for o in mine:
                if o not in own:
                    near[o].pop(w, None)
        for o in near[v]:
            if o not in own and o not in kept:
                near[o].pop(v, None)
        near[v] = kept
        for o, s in kept.items():
            near[o][v] = s


def complete_link(labels: list[str], scores: dict[tuple[int, int], float], threshold: float, must: Iterable[tuple[int, int]] = (), cannot: Iterable[tuple[int, int]] = ()) -> list[list[int]]:
    """Clusters of mention numbers, each sorted, in the order of their first members. Scores between different or empty labels don't count."""
    names = [(x or "").casefold() for x in labels]
    link = {(min(i, j), max(i, j)): s for (i, j), s in scores.items() if names[i] == names[j] != ""}
    members = {i: [i] for i in range(len(labels))}
    for _, a, b in merges(len(labels), link, threshold, must, cannot):
        members[a] += members.pop(b)
    return sorted((sorted(m) for m in members.values()), key=lambda m: m[0])


# ---- links --------------------------------------------------------------------------------------------------------


def _links(mentions: DataFrame, pairs: DataFrame, least: float, id_col: str) -> DataFrame:
    """(id, i, j, score, must, cannot), i < j: what can join mentions of one label, and what is apart in documents with must-links.

    Of scores that repeat a pair the least counts.
    """
    named = mentions.select(F.col(id_col).alias("id"), F.col("mention_no").cast("int").alias("i"), T.normalize(F.col("label")).alias("name")).where("name <> ''")
    both = pairs.select(F.col(id_col).alias("id"), F.least("i", "j").cast("int").alias("i"), F.greatest("i", "j").cast("int").alias("j"), F.col("score").cast("double").alias("score"), "decision").where("i < j")
    kinds = both.groupBy("id", "i", "j").agg(F.min(F.when(F.col("decision") == "score", F.col("score"))).alias("score"), F.bool_or(F.col("decision") == "must").alias("must"), F.bool_or(F.col("decision") == "cannot").alias("cannot"))
    kinds = kinds.where((F.coalesce("score", F.lit(-1.0)) >= least) | F.col("must") | F.col("cannot"))
    found = kinds.join(named, ["id", "i"]).join(named.withColumnsRenamed({"i": "j", "name": "other"}), ["id", "j"]).where("name = other")
    found = stored(found.select("id", "i", "j", F.when(F.col("score") >= least, F.col("score")).alias("score"), F.col("must") & ~F.col("cannot"), "cannot").toDF("id", "i", "j", "score", "must", "cannot"), "cluster-links")
    musts = found.where("must").select("id").distinct()
    return found.where("not cannot").unionByName(found.where("cannot").join(musts, "id", "left_semi"))


def _spans_in_groups(links: DataFrame, keys: list[str], least: float) -> DataFrame:
    """(id, v, root, low, high) of the mentions that ``links`` name, a group of ``keys`` in a worker: ``root`` is the cluster over ``low`` and up to ``high``, open where null."""
    kind = dict(links.dtypes)["id"]
    names = [*keys, "i", "j", "score", "must", "cannot"]

    def spans(rows: list[tuple]) -> list[tuple]:
        ends = [r[-5:] for r in rows]
        nodes = sorted({x for r in ends for x in r[:2]})
        place = {v: k for k, v in enumerate(nodes)}
        link = {(place[i], place[j]): s for i, j, s, _, apart in ends if s is not None and not apart}
        must, cannot = ([(place[r[0]], place[r[1]]) for r in ends if r[at]] for at in (3, 4))
        members, high, out = {k: [k] for k in range(len(nodes))}, {}, []
        for s, a, b in merges(len(nodes), link, least, must, cannot):
            if s != ALWAYS:
                out += [(nodes[m], nodes[b], s, high.get(m)) for m in members[b]]
                high.update((m, s) for m in members[b])
            members[a] += members.pop(b)
        return out + [(nodes[m], nodes[r], None, high.get(m)) for r, ms in members.items() for m in ms]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, made, kind_of = [], None, [], None

        def batch_of() -> pa.RecordBatch:
            kinds = (kind_of, pa.int32(), pa.int32(), pa.float64(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], ["id", "v", "root", "low", "high"])

        for batch in batches:
            kind_of = batch.schema.field("id").type
            for row in zip(*(batch.column(c).to_pylist() for c in names)):
                if held and row[: len(keys)] != last:
                    made += [(last[0], *x) for x in spans(held)]
                    held = []
                    if len(made) > 50_000:
                        yield batch_of()
                        made = []
                last = row[: len(keys)]
                held.append(row)
        if held:
            made += [(last[0], *x) for x in spans(held)]
        if made:
            yield batch_of()

    rows = links.select(*names).repartition(*keys).sortWithinPartitions(*keys)
    return rows.mapInArrow(run, f"id {kind}, v int, root int, low double, high double")


def _contracted(links: DataFrame, roots: DataFrame, sizes: DataFrame) -> DataFrame:
    """(id, i, j, score, n) between the clusters ``roots`` (id, v, root): only those that have all scores between their members."""
    to = lambda df, c: df.join(roots.select("id", F.col("v").alias(c), F.col("root").alias(f"root_{c}")), ["id", c], "left").withColumn(c, F.coalesce(f"root_{c}", c)).drop(f"root_{c}")
    moved = to(to(links, "i"), "j").where("i <> j").groupBy("id", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.min("score").alias("score"), F.sum("n").alias("n"))
    size = lambda c: sizes.select("id", F.col("root").alias(c), F.col("size").alias(f"size_{c}"))
    held = moved.join(size("i"), ["id", "i"], "left").join(size("j"), ["id", "j"], "left")
    return held.where(F.col("n") == F.coalesce("size_i", F.lit(1)) * F.coalesce("size_j", F.lit(1))).select("id", "i", "j", "score", "n")


def _must_roots(links: DataFrame) -> DataFrame:
    """(id, v, root): what must-links join. Where some of it is kept apart, the order of the links decides, in a group of these links alone."""
    musts = links.where("must")
    found = stored(graph.components(musts.select("id", F.col("i").alias("a"), F.col("j").alias("b"))), "cluster-musts")
    at = lambda c: found.select("id", F.col("v").alias(c), F.col("label").alias(f"part_{c}"))
    inside = links.where("must or cannot").join(at("i"), ["id", "i"]).join(at("j"), ["id", "j"]).where("part_i = part_j").withColumnRenamed("part_i", "part")
    inside = stored(inside.select("id", "part", "i", "j", F.lit(None).cast("double").alias("score"), "must", "cannot"), "cluster-inside")
    torn = inside.where("cannot").select("id", "part").distinct()
    by_order = _spans_in_groups(inside.join(torn, ["id", "part"], "left_semi"), ["id", "part"], 0.0).select("id", "v", "root")
    return found.join(torn.withColumnRenamed("part", "label"), ["id", "label"], "left_anti").select("id", "v", F.col("label").alias("root")).unionByName(by_order)


def _joins(pairs: DataFrame) -> DataFrame:
    """(id, v, root, score): what is joined in a round of ``pairs`` (id, i, j, score) between clusters, as one after the other would be.

    Two clusters that prefer each other to all others are joined. So are all of a set at once whose pairs have the same highest score, if
    none of them has that with any other: whatever is joined elsewhere, these come to one cluster.
    """
    ends = F.explode(F.array(F.struct(F.col("i").alias("v"), F.col("j").alias("other")), F.struct(F.col("j").alias("v"), F.col("i").alias("other")))).alias("e")
    tops = pairs.select("id", "i", "j", "score", ends).groupBy("id", "e.v").agg(F.max("score").alias("top"), F.max_by(F.struct("i", "j"), F.struct("score", -F.col("i"), -F.col("j"))).alias("best"))
    tops = stored(tops, "cluster-tops")
    at = lambda c: tops.select("id", F.col("v").alias(c), F.col("top").alias(f"top_{c}"), F.col("best").alias(f"best_{c}"))
    known = stored(pairs.select("id", "i", "j", "score").join(at("i"), ["id", "i"]).join(at("j"), ["id", "j"]).where("score = top_i or score = top_j"), "cluster-known")
    mutual = (F.col("score") == F.col("top_i")) & (F.col("score") == F.col("top_j"))
    sides = known.select("id", "score", mutual.alias("mutual"), ends).select("id", "score", "mutual", "e.*").join(tops.select("id", "v", "top"), ["id", "v"]).where("score = top")
    each = sides.groupBy("id", "v").agg(F.count("*").alias("n"), F.count_if("mutual").alias("mutual"), F.least(F.col("v"), F.min(F.when(F.col("mutual"), F.col("other")))).alias("least"), F.max("top").alias("top"))
    each = stored(each, "cluster-each")
    to = lambda c: each.select("id", F.col("v").alias(c), F.col("least").alias(f"least_{c}"))
    inside = known.where(mutual).join(to("i"), ["id", "i"]).join(to("j"), ["id", "j"]).where("least_i = least_j").groupBy("id", F.col("least_i").alias("least")).agg(F.count("*").alias("inside"))
    sets = each.groupBy("id", "least").agg(F.count("*").alias("size"), F.min(F.least("n", "mutual")).alias("fewest"), F.max(F.greatest("n", "mutual")).alias("most"))
    whole = sets.join(inside, ["id", "least"]).where("size > 1 and fewest = size - 1 and most = size - 1 and 2 * inside = size * (size - 1)").select("id", "least")
    whole = stored(each.join(whole, ["id", "least"]).select("id", "v", F.col("least").alias("root"), F.col("top").alias("score")), "cluster-whole")
    own = F.struct("i", "j")
    one = known.where((F.col("best_i") == own) & (F.col("best_j") == own)).select("id", F.col("j").alias("v"), F.col("i").alias("root"), "score")
    alone = one.join(whole.select("id", "v"), ["id", "v"], "left_anti")
    return whole.where("v <> root").unionByName(alone)


def _spans_in_rounds(links: DataFrame, least: float, most: int) -> DataFrame:
    """As ``_spans_in_groups``, for documents of any number of links."""
    spark = links.sparkSession
    joined, members, open_ = Rounds(spark, "cluster-joined"), Rounds(spark, "cluster-members"), Rounds(spark, "cluster-open")
    every = links.select("id", F.col("i").alias("v")).union(links.select("id", F.col("j").alias("v"))).distinct()
    roots = _must_roots(links)
    inside = members.store(every.join(roots, ["id", "v"], "left").select("id", "v", F.coalesce("root", "v").alias("root"), F.lit(None).cast("double").alias("high")))
    sizes = inside.groupBy("id", "root").agg(F.count("*").alias("size"))
    scored = links.where("score is not null and not cannot").select("id", "i", "j", "score", F.lit(1).cast("long").alias("n"))
    pairs = joined.store(_contracted(scored, inside.select("id", "v", "root"), sizes))
    parts = stored(graph.components(pairs.select("id", F.col("i").alias("a"), F.col("j").alias("b"))), "cluster-parts")
    pairs = joined.store(pairs.join(parts.select("id", F.col("v").alias("i"), F.col("label").alias("part")), ["id", "i"]).select("id", "part", "i", "j", "score", "n"))
    small, closed = [], []
    while True:
        count = stored(pairs.groupBy("id", "part").agg((F.count("*") > most).alias("large")), "cluster-counts")
        told = pairs.join(count, ["id", "part"])
        small.append(stored(told.where("not large").drop("large"), "cluster-small"))
        left = open_.store(told.where("large").drop("large"))
        if left.isEmpty():
            break
        both = stored(_joins(left), "cluster-both")
        moved = inside.join(both.select("id", F.col("v").alias("root"), F.col("root").alias("into"), F.col("score").alias("at")), ["id", "root"], "left")
        closed.append(stored(moved.where("into is not null").select("id", "v", "root", F.col("at").alias("low"), "high"), "cluster-closed"))
        inside = members.store(moved.select("id", "v", F.coalesce("into", "root").alias("root"), F.coalesce("at", "high").alias("high")))
        sizes = inside.groupBy("id", "root").agg(F.count("*").alias("size"))
        part = left.select("id", F.col("i").alias("v"), "part").union(left.select("id", F.col("j").alias("v"), "part")).distinct().withColumnRenamed("v", "i")
        pairs = joined.store(_contracted(left.drop("part"), both.select("id", "v", "root"), sizes).join(part, ["id", "i"]).select("id", "part", "i", "j", "score", "n"))
    rest = reduce(DataFrame.unionByName, small).select("id", "part", "i", "j", "score", F.lit(False).alias("must"), F.lit(False).alias("cannot"))
    ended = _spans_in_groups(rest, ["id", "part"], least).toDF("id", "root", "last", "low", "until")
    ended = inside.join(ended, ["id", "root"], "left").select("id", "v", F.coalesce("last", "root").alias("root"), "low", F.coalesce("until", "high").alias("high"))
    return reduce(DataFrame.unionByName, closed, ended)


def merge_history(mentions: DataFrame, pairs: DataFrame, least: float = 0.0, id_col: str = "doc_id", group_links: int | None = None) -> DataFrame:
    """(id, mention_no, root, low, high): a mention belongs to the cluster of mention ``root`` at thresholds over ``low`` and up to ``high``.

    Made once for all thresholds from ``least`` on; null bounds are open. ``pairs`` are (id, i, j, score, decision), and ``decision``
    is must, cannot or score. A pair that is missing, of different or blank labels, or names a mention that isn't there joins
    nothing. Documents without pairs have each mention alone; empty tables give an empty one. No document is too large.
    """
    most = GROUP_LINKS if group_links is None else group_links
    links = _links(mentions, pairs, least, id_col)
    large = stored(links.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") > most).select("id"), "cluster-large")
    many = not large.isEmpty()
    spans = _spans_in_groups(links.join(large, "id", "left_anti") if many else links, ["id"], least)
    if many:
        spans = spans.unionByName(_spans_in_rounds(stored(links.join(large, "id", "left_semi"), "cluster-many"), least, most))
    known = mentions.select(F.col(id_col).alias("id"), F.col("mention_no").cast("int").alias("v"))
    found = known.join(spans, ["id", "v"], "left")
    return found.select(F.col("id").alias(id_col), F.col("v").alias("mention_no"), F.coalesce("root", "v").alias("root"), "low", "high")


def cut(history: DataFrame, thresholds: list[float]) -> DataFrame:
    """``history`` at each of ``thresholds``: (threshold, id, mention_no, root), by a range join."""
    steps = F.broadcast(history.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double"))
    holds = (F.col("low").isNull() | (F.col("threshold") > F.col("low"))) & (F.col("high").isNull() | (F.col("threshold") <= F.col("high")))
    return history.join(steps, holds).drop("low", "high")


def cluster_documents(mentions: DataFrame, pairs: DataFrame, threshold: float, id_col: str = "doc_id") -> DataFrame:
    """(id, mention_no, label, cluster_no): mentions (id, mention_no, label) clustered by ``pairs`` as ``merge_history`` does, clusters numbered in the order of their first members."""
    last = merge_history(mentions, pairs, threshold, id_col).where("low is null").select(id_col, "mention_no", "root")
    last = stored(last, "clusters")
    number = F.row_number().over(Window.partitionBy(id_col).orderBy("root")).alias("cluster_no")
    numbers = last.select(id_col, "root").distinct().select(id_col, "root", number)
    labels = mentions.select(id_col, F.col("mention_no").cast("int").alias("mention_no"), "label")
    return labels.join(last, [id_col, "mention_no"]).join(numbers, [id_col, "root"]).select(id_col, "mention_no", "label", "cluster_no")


def cluster_ids(clustered: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Add ``cluster_id``: the document and the number of the cluster."""
    return clustered.withColumn("cluster_id", F.when(F.col("cluster_no").isNotNull(), F.concat(F.col(id_col).cast("string"), F.lit(":E"), F.lpad(F.col("cluster_no").cast("string"), 4, "0"))))


def numbered_by_first(mentions: DataFrame, group_col: str, id_col: str = "doc_id") -> DataFrame:
    """Add ``group_no``: groups numbered by where they come first in the document."""
    first = F.min("start").over(Window.partitionBy(id_col, group_col))
    return mentions.withColumn("_first", first).withColumn("group_no", F.dense_rank().over(Window.partitionBy(id_col).orderBy("_first", group_col))).drop("_first")
