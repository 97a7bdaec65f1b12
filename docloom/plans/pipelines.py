"""Whole runs: anonymizing documents, reconstructing masked ones, and choosing thresholds by validation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import text as T
from docloom.operators import anonymize, cluster, curate, evaluate, geo, markers, ner, pairs, quality, roles, scoring
from docloom.sources.steps import stored


def _read(mentions: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str, str]:
    """``mentions`` with their context, and the columns of the gender of a title before them and of a person's last name: once for each, not for each pair."""
    text = curate.unused(mentions, "_t")
    # Sorted: by Spark's estimate of a text all of them would go through the driver to every worker.
    rows = pairs.mention(mentions.join(docs.select(id_col, F.col(text_col).alias(text)).hint("merge"), id_col), F.col(text)).drop(text)
    gender, last = curate.unused(rows, "_gender"), curate.unused(rows, "_last")
    return rows.withColumns({gender: scoring.gender(scoring.nearest_title(F.col("context"))), last: scoring.last_name(F.col("surface"), F.col("label"))}), gender, last


def _scored(rows: DataFrame, gender: str, last: str, score: Callable[[DataFrame], Column], gazetteer: DataFrame | None, cutoff: float | None, id_col: str, keep: tuple[str, ...], keys: tuple[str, ...] = ("label",)) -> DataFrame:
    both = pairs.candidates(rows, [*keys], id_col, ("mention_no", gender, last, *keep))
    c = F.col
    rule = geo.rule_decision(c("label"), c("label"), c("place_a"), c("place_b")) if gazetteer is not None else F.lit("defer")
    differ = lambda x: F.coalesce(c(f"{x}_a") != c(f"{x}_b"), F.lit(False))
    apart = differ(last) | differ(gender)
    if cutoff is not None:
        apart = apart | ((c("label") == "PER") & scoring.full_name_conflict(c("surface_a"), c("surface_b"), cutoff))
    made = both.withColumn("decision", scoring.decisions(rule, apart))
    return made.withColumn("score", score(made)).select(id_col, c("mention_no_a").alias("i"), c("mention_no_b").alias("j"), "score", "decision")


def scored_pairs(mentions: DataFrame, docs: DataFrame, score: Callable[[DataFrame], Column], gazetteer: DataFrame | None = None, cutoff: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, i, j, score, decision) of the pairs of a label: places link or block, people of different last names are kept apart, the rest is scored.

    With a cutoff, full names that overlap no more than it are kept apart as well.
    """
    rows, gender, last = _read(mentions, docs, id_col, text_col)
    keep = ("context",)
    if gazetteer is not None:
        rows, keep = geo.signatures(rows, gazetteer), (*keep, "place")
    return _scored(rows, gender, last, score, gazetteer, cutoff, id_col, keep)


def _same(df: DataFrame) -> Column:
    return scoring.exact_surface(F.lit("defer"), F.col("label"), F.col("label"), F.col("surface_a"), F.col("surface_b")).cast("double")


def _clusters_of_equal_names(numbered: DataFrame, docs: DataFrame, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """(id, mention_no, cluster_id), as ``scored_pairs`` by equal names alone would give them.

    Mentions of an equal name are one cluster if none is kept apart from another, so their first stands for them all. Only where titles or last
    names differ, or two mentions of one place have no score, are pairs made.
    """
    rows, gender, last = _read(numbered, docs, id_col, text_col)
    named = F.when(T.normalize(F.col("label")) != "", T.normalize(F.col("surface")))
    rows = stored(rows.select(id_col, "mention_no", "label", "start", "end", "surface", F.col(gender).alias("gender"), F.col(last).alias("last"), named.alias("name")), "read-mentions")
    by = [id_col, "label", "name"]
    one = lambda x: F.min(x).eqNullSafe(F.max(x))
    groups = rows.dropna(subset=by).groupBy(*by).agg(F.min("mention_no").alias("first"), (one("gender") & one("last") & (F.count("*") == F.count_distinct("start", "end"))).alias("agree"))
    told = stored(rows.join(groups, by, "left").withColumn("first", F.when(F.col("agree"), F.col("first")).otherwise(F.col("mention_no"))), "mention-groups")
    links = _scored(told.where("not agree").drop("first", "agree"), "gender", "last", _same, None, None, id_col, (), ("label", "name"))
    firsts = told.where("first = mention_no").select(id_col, "mention_no", "label").distinct()
    found = cluster.cluster_ids(cluster.cluster_documents(firsts, links, threshold, id_col), id_col)
    members = told.select(id_col, "mention_no", "first").distinct()
    return members.join(found.select(id_col, F.col("mention_no").alias("first"), "cluster_no", "cluster_id"), [id_col, "first"]).drop("first")


def predict(docs: DataFrame, mentions: DataFrame, threshold: float, score: Callable[[DataFrame], Column] | None = None, gazetteer: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Mentions with mention_no, cluster_id, role and preserve: scored, clustered, and with court personnel protected by cluster."""
    numbered = mentions.withColumn("mention_no", (F.row_number().over(Window.partitionBy(id_col).orderBy("start", "end", "label")) - 1).cast("int"))
    numbered = stored(numbered, "numbered-mentions")
    if score is None and gazetteer is None and 0 < threshold <= 1:
        found = _clusters_of_equal_names(numbered, docs, threshold, id_col, text_col)
    else:
        links = scored_pairs(numbered, docs, score or _same, gazetteer, id_col=id_col, text_col=text_col)
        found = cluster.cluster_ids(cluster.cluster_documents(numbered, links, threshold, id_col), id_col).drop("label")
    joined = numbered.join(found, [id_col, "mention_no"])
    return roles.preserve_clusters(roles.classify_mentions(joined, docs, id_col, text_col), "cluster_id", id_col)


def anonymize_batch(docs: DataFrame, tagger, threshold: float = 0.8, score=None, gazetteer: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents with their plan and ``released_text``, which is there for all of them or for none.

    A document that the tagger failed on, or gave no prediction or one of another text for, needs review, so that it holds
    back the batch.
    """
    predictions = stored(ner.tag(docs, tagger, id_col, text_col), "predictions")
    checked = ner.join_predictions(docs.select(id_col, F.coalesce(text_col, F.lit("")).alias(text_col)), predictions, id_col, text_col)
    failures = checked.where(F.size("review_reasons") > 0).select(id_col, F.concat_ws(", ", F.concat_ws(",", "review_reasons"), "ner_error").alias("error"))
    found = ner.observations(predictions, docs, id_col, text_col)
    known = predict(docs, found, threshold, score, gazetteer, id_col, text_col)
    return anonymize.release(anonymize.plan_documents(docs, known, gazetteer, id_col, text_col, failures))


def reconstruct_batch(docs: DataFrame, tagger=None, id_col: str = "doc_id", text_col: str = "text", seed: str | int = 42) -> DataFrame:
    """Documents rewritten with synthetic names, with statistics and quality; cheap filters belong before this, as it runs Python."""
    predictions = ner.tag(docs, tagger, id_col, text_col) if tagger else None
    seen = ner.observations(predictions, docs, id_col, text_col) if tagger else None
    done, found, _ = markers.reconstruct(docs, seen, id_col, text_col, seed)
    audit = done.select(id_col, "entity_reasons", F.col("roundtrip_ok").alias("roundtrip_verified"), "replacements")
    if tagger:
        audit = audit.join(ner.join_predictions(docs, predictions, id_col, text_col).select(id_col, "review_reasons"), id_col)
    by_label = found.groupBy(id_col).agg(*[F.count_if((F.col("label") == x) & F.col("reconstructable")).alias(f"{x.lower()}_mentions") for x in ("PER", "LOC", "ORG", "ADDR")])
    scores = quality.score(audit, quality.reasons_of(audit, id_col), id_col).drop("replacements", "roundtrip_verified")
    return done.join(by_label, id_col, "left").join(scores, id_col)


def threshold_by_clusters(mentions: DataFrame, links: DataFrame, thresholds: list[float] | None = None, id_col: str = "doc_id") -> DataFrame:
    """(threshold, metrics) of clustering at each threshold against ``gold``: links are clustered once, and the history is cut at all of them.

    The best is the first row in order of B-cubed F1, B-cubed precision, pairwise precision and threshold.
    """
    steps = thresholds or [k / 20 for k in range(1, 20)]
    found = cluster.cut(cluster.merge_history(mentions, links, min(steps), id_col), steps)
    counts = evaluate.cluster_counts(found.join(mentions.select(id_col, "mention_no", "gold"), [id_col, "mention_no"]).withColumn("part", F.struct("threshold", id_col)), "part", predicted_col="root")
    made = evaluate.corpus_metrics(counts.withColumn("threshold", F.col("part.threshold")), "threshold")
    return made.orderBy(F.col("b3_f1").desc(), F.col("b3_precision").desc(), F.col("pair_precision").desc(), F.col("threshold").desc())


def cutoff_by_clusters(mentions: DataFrame, docs: DataFrame, score: Callable[[DataFrame], Column], threshold: float, cutoffs: list[float], id_col: str = "doc_id") -> DataFrame:
    """(cutoff, metrics) for cutoffs of the overlap of full names, in the same order of preference."""
    mentions, made = stored(mentions, "mentions"), None
    for x in cutoffs:
        links = scored_pairs(mentions, docs, score, cutoff=x, id_col=id_col)
        row = threshold_by_clusters(mentions, links, [threshold], id_col).withColumn("cutoff", F.lit(x))
        made = row if made is None else made.unionByName(row)
    return made.orderBy(F.col("b3_f1").desc(), F.col("b3_precision").desc(), F.col("pair_precision").desc(), "cutoff")
