"""Datasets of mention pairs: from documents with replacement maps to labelled pairs, collisions and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import text as T
from docloom.operators import geo, pairs
from docloom.operators import spans as S
from docloom.operators.curate import unused
from docloom.sources import readers, writers
from docloom.sources.steps import stored

#: What a clean document may carry on: everything else could give identities away.
PUBLIC = ("doc_id", "text", "case_type", "doc_type", "category", "instance_level", "cap_xet_xu", "issued_date", "primary_challenge", "split", "source_sha256")


def public_columns(df: DataFrame, allowed: tuple[str, ...] = PUBLIC) -> DataFrame:
    """Only the columns on the list."""
    return df.select(*[c for c in df.columns if c in allowed])


def compact_map(entities: Column, replacements: Column) -> tuple[Column, Column]:
    """Entities that could be reconstructed, as (entity_id, label, marker, role), and the replacements of these."""
    kept = F.filter(entities, lambda e: e["reconstructable"])
    ids = F.transform(kept, lambda e: e["entity_id"])
    slim = F.transform(kept, lambda e: F.struct(*[e[c].alias(c) for c in ("entity_id", "label", "marker", "role")]))
    return slim, F.filter(replacements, lambda r: F.array_contains(ids, r["entity_id"]))


def aligned(docs: DataFrame, maps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents with the map of the same id and text hash; raises where either lacks the other."""
    return readers.align(readers.with_text_hash(docs, text_col), maps, [id_col, "source_sha256"])


def map_mentions(joined: DataFrame, id_col: str = "doc_id", text_col: str = "text", target: bool = False) -> DataFrame:
    """Mentions of aligned documents with their entity, label, marker, family and role; in the source, or where replacements lie in the target.

    Replacements without an entity, and spans that do not fit, drop out.
    """
    ents = joined.select(id_col, F.inline("entities")).select(id_col, "entity_id", F.col("label").alias("_label"), "marker", "role")
    reps = joined.select(id_col, F.col(text_col).alias("_text"), F.inline("replacements"))
    reps = reps.where(S.valid_span(F.col("_text"), F.col("start"), F.col("end"), F.col("original")))
    if target:
        reps = S.with_target_offsets(reps.drop("label"), id_col)
        reps = reps.select(id_col, "entity_id", F.col("target_start").alias("start"), F.col("target_end").alias("end"), F.col("replacement").alias("surface"))
        lead = F.length("surface") - F.length(F.regexp_replace("surface", r"(?U)^\s+", ""))
        reps = reps.withColumn("start", F.col("start") + lead).withColumn("surface", T.strip_space(F.col("surface"))).withColumn("end", F.col("start") + F.length("surface"))
    else:
        reps = reps.select(id_col, "entity_id", "start", "end", F.col("original").alias("surface"))
    found = reps.join(ents, [id_col, "entity_id"])
    return found.withColumn("marker_family", T.marker_family(F.col("marker"))).withColumnRenamed("_label", "label")


def raw_pairs(mentions: DataFrame, docs: DataFrame, positives: int = 8, ratio: float = 1.0, cap: int = 128, seed: str | int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Labelled pairs of each document: up to ``positives`` of each entity, and negatives, also across labels, in proportion, at most ``cap`` in all.

    Negatives are ranked by how hard they are and then by hash, never by distance. Caps act where pairs are made, and contexts
    are joined to what is kept. Documents without text or mentions have no pairs.
    """
    both = _pairs_with_features(mentions, [], id_col)
    order = pairs.positive_order("surface_a", "surface_b", "start_a", "start_b", seed, F.col("pair_id"))
    pos = stored(pairs.best(both.where("label = 1"), positives, [id_col, "entity_id_a"], *order), "positives")
    wanted = pos.groupBy(id_col).agg(F.greatest(F.lit(2), F.ceil(F.count("*") * ratio)).alias("wanted"))
    neg = pairs.best(both.where("label = 0"), cap, [id_col], pairs.negative_priority(F.col("difficulty")), T.stable_hash(str(seed), F.col("pair_id")))
    neg = neg.join(wanted, id_col, "left").where(F.col("rank") <= F.coalesce("wanted", F.lit(2))).drop("wanted")
    kept = pos.unionByName(neg).withColumnRenamed("rank", "in_label")
    kept = pairs.best(kept, cap, [id_col], F.col("label").desc(), F.col("in_label"), F.col("pair_id")).drop("rank", "in_label")
    return _with_contexts(kept, mentions, docs, id_col, text_col)


def natural_pairs(mentions: DataFrame, docs: DataFrame, gazetteer: DataFrame | None = None, cap: int = 128, seed: str | int = 42, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(pairs, left out): labelled pairs within labels, half of each kind while there are enough; pairs that a place rule contradicts are counted, not relabelled.

    The second table has (id, reason, n). Roles are not in the pairs. Of each kind a task keeps ``cap`` pairs of a document at most, which
    is all that quotas can take, and contexts are joined to what is kept.
    """
    if gazetteer is not None:
        own = unused(mentions, "_text")
        text = docs.select(F.col(id_col), F.col(text_col).alias(own))
        mentions = stored(geo.signatures(pairs.mention(mentions.join(text, id_col), F.col(own)).drop(own), gazetteer).select(*mentions.columns, "place"), "placed")
    both = _pairs_with_features(mentions, ["label"], id_col)
    wrong = F.when((F.col("label") == 1) & (F.col("place_rule") == "block"), "positive_blocked").when((F.col("label") == 0) & (F.col("place_rule") == "link"), "negative_linked")
    left_out = both.where(wrong.isNotNull()).groupBy(id_col, wrong.alias("reason")).agg(F.count("*").alias("n"))
    order = F.when(F.col("label") == 1, F.lit(0)).otherwise(pairs.negative_priority(F.col("difficulty")))
    ranked = pairs.best(both.where(wrong.isNull()), cap, [id_col, "label"], order, T.stable_hash(str(seed), F.col("pair_id")))
    return _with_contexts(pairs.balanced(ranked, cap, id_col).drop("rank"), mentions, docs, id_col, text_col), left_out


def _with_contexts(found: DataFrame, mentions: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``found`` with the contexts of both mentions."""
    found = stored(found, "pairs")
    spans = [found.select(id_col, F.col(f"start_{s}").alias("start"), F.col(f"end_{s}").alias("end")) for s in "ab"]
    wanted = spans[0].union(spans[1]).distinct()
    rows = pairs.mention(wanted.join(docs.select(id_col, F.col(text_col).alias("_text")), id_col), F.col("_text")).select(id_col, "start", "end", "context").distinct()
    rows = stored(rows, "contexts")
    for s in "ab":
        found = found.join(rows.toDF(id_col, f"start_{s}", f"end_{s}", f"context_{s}"), [id_col, f"start_{s}", f"end_{s}"])
    return found


def _pairs_with_features(mentions: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    keep = ("entity_id", "marker") + (("place",) if "place" in mentions.columns else ())
    both = pairs.candidates(mentions, keys, id_col, keep)
    c = F.col
    la, lb = (c("label"), c("label")) if "label" in keys else (c("label_a"), c("label_b"))
    made = pairs.surface_features(la, lb, c("surface_a"), c("surface_b"), c("start_a"), c("start_b"), F.lit(None), F.lit(None))
    rule = F.lit("defer")
    if "place" in keep:
        rule = geo.rule_decision(la, lb, c("place_a"), c("place_b"))
        made |= geo.pair_features(la, lb, c("place_a"), c("place_b"))
    linked = c("entity_id_a") == c("entity_id_b")
    out = both.withColumns({"_same_label": la, "place_rule": rule, **made}).withColumn("difficulty", pairs.difficulty({k: c(k) for k in made}, linked, c("place_rule") == "block"))
    out = out.withColumn("pair_id", pairs.pair_id(c(id_col), c("start_a"), c("end_a"), c("start_b"), c("end_b")))
    drop = ["label", "label_a", "label_b", "place_a", "place_b"]
    return out.drop(*[d for d in drop if d in out.columns]).withColumn("label", linked.cast("int")).withColumnRenamed("_same_label", "mention_label")


def shared_alias_variants(joined: DataFrame, rate: float = 0.1, seed: str | int = 42, id_col: str = "doc_id") -> DataFrame:
    """(id, recipient, donor, alias): documents, drawn by hash at a rate, in which one person takes over the one-word alias of another.

    Both have an alias of one word longer than a letter, their markers share an initial, and the alias begins with it.
    """
    drawn = joined.where(T.below_ratio(T.stable_u64(str(seed), F.col(id_col), F.lit("collision")), rate))
    ents = drawn.select(id_col, F.inline("entities")).where("label = 'PER'").select(id_col, "entity_id", F.lower(F.regexp_extract("marker", r"(\p{L})", 1)).alias("initial"))
    bare = T.strip_space(F.col("replacement"))
    short = drawn.select(id_col, F.inline("replacements")).where((F.length(bare) > 1) & ~bare.rlike(r"(?U)\s")).groupBy(id_col, "entity_id").agg(F.min_by(bare, "start").alias("alias"))
    people = ents.join(short, [id_col, "entity_id"])
    donors = people.where(F.lower(F.substring("alias", 1, 1)) == F.col("initial")).select(id_col, "initial", F.col("entity_id").alias("donor"), "alias")
    takers = people.select(id_col, "initial", F.col("entity_id").alias("recipient"))
    order = Window.partitionBy(id_col).orderBy(T.stable_hash(str(seed), F.col(id_col), F.col("donor")), T.stable_hash(str(seed), F.col(id_col), F.col("recipient")))
    found = donors.join(takers, [id_col, "initial"]).where("donor <> recipient")
    return found.withColumn("_r", F.row_number().over(order)).where("_r = 1").select(id_col, "recipient", "donor", "alias")


def with_shared_aliases(joined: DataFrame, variants: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Aligned documents of the variants with the recipient's one-word replacements changed to the alias; spaces around them stay."""
    both = joined.join(variants, id_col)
    one = lambda r: ~T.strip_space(r["replacement"]).rlike(r"(?U)\s") & (r["entity_id"] == F.col("recipient"))
    new = lambda r: F.concat(F.regexp_extract(r["replacement"], r"(?U)^(\s*)", 1), F.col("alias"), F.regexp_extract(r["replacement"], r"(?U)(\s*)$", 1))
    changed = F.transform("replacements", lambda r: r.withField("replacement", F.when(one(r), new(r)).otherwise(r["replacement"])))
    return both.withColumn("replacements", changed)


def assert_private(made: DataFrame, secret: DataFrame, columns: list[str], secret_col: str, id_col: str = "doc_id") -> None:
    """Raises if a secret of a document, such as a real name or an internal id, stands in any of the columns of its rows."""
    text = F.concat_ws("\n", *[F.col(c).cast("string") for c in columns])
    rows = made.select(id_col, text.alias("_all"))
    leak = rows.join(secret.select(id_col, F.col(secret_col).alias("_secret")), id_col).where((F.length("_secret") > 0) & F.contains(F.col("_all"), F.col("_secret"))).limit(1).collect()
    if leak:
        raise ValueError(f"document {leak[0][id_col]} gives away what it must not")


def publish(spark, path: str, found: DataFrame, clean: DataFrame, assignment: DataFrame, extra: dict[str, DataFrame] | None = None, id_col: str = "doc_id") -> list[dict]:
    """Write pairs and clean documents by split, with other tables beside them, and a manifest; all of it or nothing. Returns the manifest's rows."""
    split_of = assignment.select(id_col, "split")
    with_split = found.join(split_of, id_col)
    counts = writers.pair_manifest(with_split.withColumnRenamed(id_col, "doc_id"))
    writers.publish(spark, {"pairs": with_split, "documents": public_columns(clean.join(split_of, id_col)), **(extra or {})}, path, {"pairs": counts}, partition_by={"pairs": ["split"], "documents": ["split"]})
    return counts
