"""Mention pairs: candidates, features, rankings, quotas, collisions and identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import rules
from docloom.functions import text as T
from docloom.operators.curate import unused
from docloom.sources.steps import stored

_SIDE = ("start", "end", "surface", "label")


def mention(df: DataFrame, text: Column, window: int = 160) -> DataFrame:
    """Add ``context`` with tags, and where the mention lies in it."""
    made = df.withColumn("context", T.marked_context(text, F.col("start"), F.col("end"), window))
    left = F.least(F.col("start"), F.lit(window)) + len("[MENTION]")
    return made.withColumns({"context_mention_start": left, "context_mention_end": left + F.col("end") - F.col("start")})


#: Mentions of a group that are paired in one tile. It changes the cost, not the result.
TILE = 1024


def tiled(rows: DataFrame, by: list[str], *order: str) -> DataFrame:
    """``rows`` with ``tile``: two rows of a group ``by`` share exactly one tile (low, high, mine) in which ``mine`` differs, or the one of their part.

    A group of at most TILE rows is one tile. A larger one is cut into parts by a hash of ``order``, and each two parts make a
    tile, so that no group of a join has over TILE rows. Groups with a null key have no pairs.
    """
    held = stored(rows.dropna(subset=by), "tiled")
    large = held.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") > TILE).select(*by, F.ceil(F.col("n") / (TILE // 2)).cast("int").alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    mine = F.pmod(F.xxhash64(*order), parts).cast("int")
    dealt = held.join(large, by, "left").withColumn("mine", mine).withColumn("parts", parts)
    low, high = (lambda o: F.least(o, F.col("mine"))), (lambda o: F.greatest(o, F.col("mine")))
    every = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(low(o).alias("low"), high(o).alias("high"), F.col("mine").alias("mine")))
    return dealt.withColumn("tile", F.explode(every)).drop("mine", "parts")


def candidates(mentions: DataFrame, keys: list[str], id_col: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of mentions of a document that agree in ``keys``, the earlier one first: a self equi-join by tiles.

    A long document's pairs are made by many tasks. Mentions of equal start and end make no pair, nor do those with a null key.
    Columns get the suffixes _a and _b.
    """
    columns = [c for c in dict.fromkeys((*_SIDE, *keep)) if c not in keys]
    rows = tiled(mentions.select(id_col, *keys, *columns), [id_col, *keys], "start", "end")
    side = lambda s: rows.select(id_col, *keys, F.col("tile.low").alias("low"), F.col("tile.high").alias("high"), F.col("tile.mine").alias(f"mine_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in columns])
    both = side("a").join(side("b"), [id_col, *keys, "low", "high"])
    earlier = F.struct("start_a", "end_a") < F.struct("start_b", "end_b")
    return both.where(earlier & ((F.col("low") == F.col("high")) | (F.col("mine_a") != F.col("mine_b")))).drop("low", "high", "mine_a", "mine_b")


def best(pairs: DataFrame, k: int, by: list[str], *order: Column) -> DataFrame:
    """The first ``k`` pairs of each group, with their ``rank``. Each task that makes pairs keeps ``k`` of a group, and only these are shuffled."""
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def pair_id(doc: Column, *parts: Column) -> Column:
    """The document and twenty hex digits of a hash of what identifies the pair."""
    return F.concat(doc.cast("string"), F.lit(":"), F.substring(F.sha2(F.concat_ws(T.SEPARATOR, doc.cast("string"), *[p.cast("string") for p in parts]), 256), 1, 20))


def legacy_features(label_a: Column, label_b: Column, a: Column, b: Column, start_a: Column, start_b: Column, marker_a: Column, marker_b: Column) -> dict[str, Column]:
    """The eight features of marked text."""
    same = lambda x, y: F.coalesce(x == y, F.lit(False)).cast("double")
    family_a, family_b = T.marker_family(marker_a), T.marker_family(marker_b)
    return {
        "same_label": same(label_a, label_b),
        "same_surface": same(T.normalize(a), T.normalize(b)),
        "same_marker": same(marker_a, marker_b),
        "same_marker_family": same(family_a, family_b),
        "different_number": F.coalesce((family_a == family_b) & ~T.number_suffix(marker_a).eqNullSafe(T.number_suffix(marker_b)), F.lit(False)).cast("double"),
        "surface_length_gap": F.least(F.abs(F.length(a) - F.length(b)) / 20.0, F.lit(1.0)),
        "token_jaccard": T.jaccard(T.tokens(a), T.tokens(b)),
        "log_distance": log_distance(start_a, start_b),
    }


def same_sentence(text: Column, start_a: Column, start_b: Column) -> Column:
    """1.0 if neither an end of a sentence nor a blank line stands between the two starts."""
    low = F.least(start_a, start_b)
    between = F.substring(text, low + 1, F.greatest(start_a, start_b) - low)
    return (~between.rlike(rules.SENTENCE_END)).cast("double")


def log_distance(start_a: Column, start_b: Column) -> Column:
    return F.least(F.log1p(F.abs(start_a - start_b).cast("double")) / 10.0, F.lit(1.0))


def surface_features(label_a: Column, label_b: Column, a: Column, b: Column, start_a: Column, start_b: Column, role_a: Column, role_b: Column) -> dict[str, Column]:
    """Features of plain text; those of places come from ``geo.pair_features``."""
    ta, tb = T.tokens(a), T.tokens(b)
    same = lambda x, y: F.coalesce(x == y, F.lit(False)).cast("double")
    return {
        "same_label": same(F.lower(label_a), F.lower(label_b)),
        "same_surface": same(T.normalize(a), T.normalize(b)),
        "same_role": F.when(role_a.isNotNull() & (role_a != ""), same(role_a, role_b)).otherwise(0.0),
        "token_jaccard": T.jaccard(ta, tb),
        "same_first_token": same(F.try_element_at(ta, F.lit(1)), F.try_element_at(tb, F.lit(1))),
        "same_last_token": same(F.try_element_at(ta, F.lit(-1)), F.try_element_at(tb, F.lit(-1))),
        "one_contains_other": ((F.length(T.normalize(a)) > 0) & (F.length(T.normalize(b)) > 0) & (F.contains(T.normalize(a), T.normalize(b)) | F.contains(T.normalize(b), T.normalize(a)))).cast("double"),
        "surface_length_gap": F.least(F.abs(F.length(a) - F.length(b)) / 20.0, F.lit(1.0)),
        "log_distance": log_distance(start_a, start_b),
    }


def vector_features(a: Column, b: Column) -> dict[str, Column]:
    """Of two vectors: their cosine, absolute differences and products, as the head of a pair model takes them."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return {
        "cosine": F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b))), F.lit(0.0)),
        "difference": F.zip_with(a, b, lambda p, q: F.abs(p - q)),
        "product": F.zip_with(a, b, lambda p, q: p * q),
    }


def positive_order(a: str, b: str, start_a: str, start_b: str, seed: str | int, *ids: Column) -> list[Column]:
    """Different surfaces first, then a large gap of lengths, then near ones, then by hash."""
    gap = F.abs(F.length(a) - F.length(b))
    return [(T.normalize(F.col(a)) == T.normalize(F.col(b))).cast("int"), -gap, F.abs(F.col(start_a) - F.col(start_b)), T.stable_hash(str(seed), *ids)]


def difficulty(features: dict[str, Column], positive: Column, location_conflict: Column | None = None) -> Column:
    """Why a negative is hard, by precedence; distance plays no part, so that it does not leak into the choice."""
    chain = F.when(positive, "positive").when(features["same_surface"] == 1, "same_label_surface")
    if location_conflict is not None:
        chain = chain.when(location_conflict, "same_label_location_conflict")
    if "same_marker" in features:
        chain = chain.when(features["same_marker"] == 1, "same_label_marker").when(features["same_marker_family"] == 1, "same_label_marker_family")
    chain = chain.when(features["token_jaccard"] > 0, "same_label_name_overlap").when(features["same_label"] == 1, "same_label")
    return chain.otherwise("cross_label")


#: The order in which negatives are taken.
NEGATIVE_ORDER = ("same_label_surface", "same_label_location_conflict", "same_label_marker", "same_label_marker_family", "same_label_name_overlap", "same_label", "cross_label")


def negative_priority(kind: Column) -> Column:
    return F.coalesce(*[F.when(kind == k, F.lit(i)) for i, k in enumerate(NEGATIVE_ORDER)], F.lit(len(NEGATIVE_ORDER)))


def top_positives(pairs: DataFrame, k: int = 8, seed: str | int = 42, id_col: str = "doc_id") -> DataFrame:
    """At most k positive pairs of each entity."""
    order = positive_order("surface_a", "surface_b", "start_a", "start_b", seed, F.col(id_col), F.col("start_a"), F.col("start_b"))
    return best(pairs.where("entity_a = entity_b"), k, [id_col, "entity_a"], *order)


def balanced(pairs: DataFrame, cap: int, id_col: str = "doc_id", label_col: str = "label", rank_col: str = "rank") -> DataFrame:
    """At most ``cap`` pairs of a document, half of them positive while there are enough, others filling up. ``rank`` orders each label."""
    by = Window.partitionBy(id_col)
    of_p, of_n = unused(pairs, "_p"), unused(pairs, "_n")
    counted = pairs.withColumns({of_p: F.count_if(F.col(label_col) == 1).over(by), of_n: F.count_if(F.col(label_col) == 0).over(by)})
    half = cap // 2
    p = F.least(F.col(of_p), F.greatest(F.lit(half), F.lit(cap) - F.col(of_n)))
    n = F.least(F.col(of_n), F.greatest(F.lit(cap - half), F.lit(cap) - F.col(of_p)))
    return counted.where(F.when(F.col(label_col) == 1, F.col(rank_col) <= p).otherwise(F.col(rank_col) <= n)).drop(of_p, of_n)


def nearest_across(mentions: DataFrame, id_col: str = "doc_id", entity_col: str = "entity_id") -> DataFrame:
    """(id, entity, start, other_entity, other_start): for each mention the nearest one of another entity before and after it.

    The last start of another entity is the last mention if that is another's, or else the one before the present run of
    the same entity; so two window sums do, and no pairs are made.
    """
    by = Window.partitionBy(id_col).orderBy("start")
    marked = mentions.select(id_col, F.col(entity_col).alias("entity"), "start")
    for side, order in (("before", by), ("after", Window.partitionBy(id_col).orderBy(F.col("start").desc()))):
        changed = ~F.col("entity").eqNullSafe(F.lag("entity").over(order))
        marked = marked.withColumn("_prev", F.when(changed, F.struct(F.lag("entity").over(order).alias("entity"), F.lag("start").over(order).alias("start"))))
        marked = marked.withColumn(side, F.last("_prev", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_prev")
    found = marked.select(id_col, "entity", "start", F.explode(F.array("before", "after")).alias("o")).where(F.col("o.start").isNotNull())
    return found.select(id_col, "entity", "start", F.col("o.entity").alias("other_entity"), F.col("o.start").alias("other_start"))


def nearest_and_farthest(mentions: DataFrame, limit: int = 4, id_col: str = "doc_id", entity_col: str = "entity_id") -> DataFrame:
    """Cross-entity pairs of each pair of entities: the nearest up to limit - 1, and the farthest one."""
    near = nearest_across(mentions, id_col, entity_col)
    low, high = F.least("entity", "other_entity"), F.greatest("entity", "other_entity")
    pairs = near.select(id_col, low.alias("low"), high.alias("high"), F.least("start", "other_start").alias("a"), F.greatest("start", "other_start").alias("b")).distinct()
    rank = F.row_number().over(Window.partitionBy(id_col, "low", "high").orderBy(F.col("b") - F.col("a"), "a"))
    close = pairs.withColumn("rank", rank).where(F.col("rank") <= limit - 1).drop("rank")
    ends = mentions.groupBy(id_col, F.col(entity_col).alias("e")).agg(F.min("start").alias("first"), F.max("start").alias("last"))
    ends = tiled(ends, [id_col], "e")
    x, y = (ends.select(id_col, "tile.low", "tile.high", F.col("tile.mine").alias(f"mine_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in ("e", "first", "last")]) for s in ("x", "y"))
    both = x.join(y, [id_col, "low", "high"]).where((F.col("e_x") < F.col("e_y")) & ((F.col("low") == F.col("high")) | (F.col("mine_x") != F.col("mine_y")))).drop("low", "high")
    forward, back = F.abs(F.col("last_y") - F.col("first_x")), F.abs(F.col("last_x") - F.col("first_y"))
    far_a = F.when(forward >= back, F.struct(F.least("first_x", "last_y").alias("a"), F.greatest("first_x", "last_y").alias("b"))).otherwise(F.struct(F.least("first_y", "last_x").alias("a"), F.greatest("first_y", "last_x").alias("b")))
    far = both.select(id_col, F.col("e_x").alias("low"), F.col("e_y").alias("high"), far_a.alias("f")).select(id_col, "low", "high", "f.a", "f.b")
    return close.unionByName(far).distinct()


def marker_like(surface: Column) -> Column:
    """At most three characters, the first a capital."""
    return F.coalesce((F.length(surface) <= 3) & surface.rlike(r"(?U)^\p{Lu}[\w.]*$"), F.lit(False))


def collision_candidates(mentions: DataFrame, most: int = 8, seed: str | int = 42, id_col: str = "doc_id", entity_col: str = "entity_id") -> DataFrame:
    """Pairs of people of a document who could be given the same alias: (id, recipient, donor, start, end, alias, replacement).

    Each must have a mention of two words or more, and aliases must be of equal length and different; at most ``most`` a document.
    """
    people = mentions.where("label = 'PER'")
    anchored = people.groupBy(id_col, F.col(entity_col).alias("entity")).agg(F.max(F.size(T.tokens(F.col("surface")))).alias("n")).where("n >= 2").drop("n")
    short = people.where(marker_like(F.col("surface"))).select(id_col, F.col(entity_col).alias("entity"), "start", "end", "surface").join(anchored, [id_col, "entity"])
    first = short.withColumn("_r", F.row_number().over(Window.partitionBy(id_col, "entity").orderBy("start"))).where("_r = 1").drop("_r")
    give = first.select(id_col, F.col("entity").alias("donor"), F.col("surface").alias("replacement"))
    take = first.select(id_col, F.col("entity").alias("recipient"), "start", "end", F.col("surface").alias("alias"))
    pairs = take.join(give, id_col).where((F.col("recipient") != F.col("donor")) & (F.length("alias") == F.length("replacement")) & (F.col("alias") != F.col("replacement")))
    order = Window.partitionBy(id_col).orderBy(T.stable_hash(str(seed), F.col(id_col), F.col("recipient"), F.col("donor")))
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def collision_pairs(collisions: DataFrame, anchors: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Three pairs of each collision: the changed mention with its own anchor, the donor's alias with its anchor, and both aliases.

    ``anchors`` are (id, entity, anchor_start, alias_start): where each person's full name and alias stand.
    """
    r = anchors.select(id_col, F.col("entity").alias("recipient"), F.col("anchor_start").alias("r_anchor"))
    d = anchors.select(id_col, F.col("entity").alias("donor"), F.col("anchor_start").alias("d_anchor"), F.col("alias_start").alias("d_alias"))
    one = lambda kind, a, b, y: F.struct(F.lit(kind).alias("difficulty"), F.col(a).alias("a"), F.col(b).alias("b"), F.lit(y).alias("label"))
    made = F.array(one("collision_recipient_positive", "start", "r_anchor", 1), one("collision_donor_positive", "d_alias", "d_anchor", 1), one("collision_same_surface_negative", "start", "d_alias", 0))
    return collisions.join(r, [id_col, "recipient"]).join(d, [id_col, "donor"]).select(id_col, "recipient", "donor", "replacement", F.inline(made))
