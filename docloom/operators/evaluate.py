"""Metrics of pairs and of clusters, sweeps of thresholds, and examples of errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.operators.curate import unused


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def f1(precision: Column, recall: Column) -> Column:
    return ratio(2 * precision * recall, precision + recall)


def confusion(label: Column, predicted: Column) -> list[Column]:
    """tp, fp, tn, fn as aggregates of 0/1 columns."""
    made = {"tp": (label == 1) & (predicted == 1), "fp": (label == 0) & (predicted == 1), "tn": (label == 0) & (predicted == 0), "fn": (label == 1) & (predicted == 0)}
    return [F.count_if(c).alias(n) for n, c in made.items()]


def with_rates(counts: DataFrame) -> DataFrame:
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    # F1 from the counts is one division, so that equal counts give equal bits in any engine.
    return counts.withColumns({"accuracy": ratio(tp + tn, tp + fp + tn + fn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def grouped_metrics(pairs: DataFrame, groups: list[str], label_col: str = "label", predicted_col: str = "predicted") -> DataFrame:
    """(scope, value, tp, fp, tn, fn, accuracy, precision, recall, f1): in all and by each group, in one aggregate over grouping sets."""
    view = pairs.select(F.col(label_col).alias("_y"), F.col(predicted_col).alias("_p"), *[F.coalesce(F.col(g).cast("string"), F.lit("Unknown")).alias(g) for g in groups])
    sets = [[], *[[F.col(g)] for g in groups]]
    counted = view.groupingSets(sets, *[F.col(g) for g in groups]).agg(F.grouping_id().alias("_id"), *confusion(F.col("_y"), F.col("_p")))
    n = len(groups)
    scope, value = F.lit("all"), F.lit("")
    for i, g in enumerate(groups):
        mine = (2**n - 1) - 2 ** (n - 1 - i)
        scope, value = F.when(F.col("_id") == mine, F.lit(g)).otherwise(scope), F.when(F.col("_id") == mine, F.col(g)).otherwise(value)
    return with_rates(counted.select(scope.alias("scope"), value.alias("value"), "tp", "fp", "tn", "fn"))


def error_summary(pairs: DataFrame, label_col: str = "label", predicted_col: str = "predicted") -> DataFrame:
    """One row: negatives, false links and their share; the share is null without negatives."""
    y, p = F.col(label_col), F.col(predicted_col)
    counted = pairs.agg(F.count_if(y == 0).alias("negatives"), F.count_if((y == 0) & (p == 1)).alias("false_links"), F.count_if(y == 1).alias("positives"), F.count_if((y == 1) & (p == 0)).alias("missed_links"))
    return counted.withColumns({"false_link_rate": F.try_divide(F.col("false_links").cast("double"), F.col("negatives")), "missed_link_rate": F.try_divide(F.col("missed_links").cast("double"), F.col("positives"))})


def effective_score(score: Column, rule: Column) -> Column:
    """A rule's link counts as 2 and its block as -1; else the score."""
    return F.when(rule == "link", 2.0).when(rule == "block", -1.0).otherwise(score)


def effective_prediction(score: Column, rule: Column, threshold: float) -> Column:
    return (effective_score(score, rule) >= threshold).cast("int")


def grid_sweep(pairs: DataFrame, label_col: str = "label", score_col: str = "score", steps: int = 19) -> DataFrame:
    """Metrics at 0.05, 0.10, ... : scores are counted by the step they reach, so rows are not multiplied by thresholds."""
    top = steps + 1
    # A score reaches the k-th threshold if it is at least k / 20; whole steps are compared to keep sums exact.
    reached = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(0), lambda a, k: a + F.when(F.col(score_col) >= k.cast("double") / top, 1).otherwise(0))
    counts = pairs.groupBy(reached.alias("step")).agg(F.count_if(F.col(label_col) == 1).alias("p"), F.count_if(F.col(label_col) == 0).alias("n"))
    thresholds = pairs.sparkSession.range(1, top).select(F.col("id").cast("int").alias("k"))
    joined = thresholds.join(F.broadcast(counts), F.lit(True), "left")  # both have at most steps + 1 rows
    hit = F.col("step") >= F.col("k")
    total = lambda c, cond: F.coalesce(F.sum(F.when(cond, F.col(c)).otherwise(0)), F.lit(0))
    swept = joined.groupBy("k").agg(total("p", hit).alias("tp"), total("n", hit).alias("fp"), total("n", ~hit).alias("tn"), total("p", ~hit).alias("fn"))
    return with_rates(swept.withColumn("threshold", F.col("k").cast("double") / top).drop("k"))


def best_grid_threshold(swept: DataFrame) -> DataFrame:
    """The row of the highest (f1, accuracy), closest to a half."""
    return swept.orderBy(F.col("f1").desc(), F.col("accuracy").desc(), F.abs(F.col("threshold") - 0.5), "threshold").limit(1)


def exhaustive_sweep(pairs: DataFrame, label_col: str = "label", score_col: str = "score", digits: int = 6) -> DataFrame:
    """Metrics at every distinct rounded score, and at 0 and 1; one aggregate and running sums over distinct scores.

    The running sums go over at most 10^digits + 1 rows, whatever the number of pairs.
    """
    at = F.round(F.col(score_col), digits)
    counts = pairs.groupBy(at.alias("threshold")).agg(F.count_if(F.col(label_col) == 1).alias("p"), F.count_if(F.col(label_col) == 0).alias("n"))
    ends = pairs.sparkSession.createDataFrame([(0.0, 0, 0), (1.0, 0, 0)], "threshold double, p long, n long")
    merged = counts.unionByName(ends).groupBy("threshold").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    above = Window.orderBy(F.col("threshold").desc()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    summed = merged.withColumns({"tp": F.sum("p").over(above), "fp": F.sum("n").over(above), "_p": F.sum("p").over(whole), "_n": F.sum("n").over(whole)})
    return with_rates(summed.select("threshold", "tp", "fp", (F.col("_n") - F.col("fp")).alias("tn"), (F.col("_p") - F.col("tp")).alias("fn")))


def best_exhaustive_threshold(swept: DataFrame) -> DataFrame:
    return swept.orderBy(F.col("f1").desc(), F.col("precision").desc(), F.col("threshold").desc()).limit(1)


# ---- clusters -----------------------------------------------------------------------------------------------------


def cluster_counts(mentions: DataFrame, doc_col: str = "doc_id", gold_col: str = "gold", predicted_col: str = "predicted") -> DataFrame:
    """(doc, mentions, b3_precision_sum, b3_recall_sum, tp, fp, fn) of each document, from counts of (gold, predicted) alone.

    B-cubed sums are those over mentions: n_gp^2 / n_p and n_gp^2 / n_g; pairs within clusters are n choose 2.
    """
    cells = mentions.groupBy(doc_col, F.col(gold_col).alias("_g"), F.col(predicted_col).alias("_p")).agg(F.count("*").alias("n"))
    of = lambda c: F.sum("n").over(Window.partitionBy(doc_col, c))
    rows = cells.withColumns({"n_g": of("_g"), "n_p": of("_p")})
    two = lambda c: (F.col(c) * (F.col(c) - 1) / 2).cast("long")
    # A cluster's own pairs are counted once, at its first cell.
    first = lambda c: F.row_number().over(Window.partitionBy(doc_col, c).orderBy("_g", "_p")) == 1
    rows = rows.withColumns({"pairs": two("n"), "pairs_g": F.when(first("_g"), two("n_g")).otherwise(0), "pairs_p": F.when(first("_p"), two("n_p")).otherwise(0)})
    summed = rows.groupBy(doc_col).agg(
        F.sum("n").alias("mentions"),
        F.sum(F.col("n") * F.col("n") / F.col("n_p")).alias("b3_precision_sum"),
        F.sum(F.col("n") * F.col("n") / F.col("n_g")).alias("b3_recall_sum"),
        F.sum("pairs").alias("tp"),
        F.sum("pairs_g").alias("_pg"),
        F.sum("pairs_p").alias("_pp"),
    )
    return summed.select(doc_col, "mentions", "b3_precision_sum", "b3_recall_sum", "tp", (F.col("_pp") - F.col("tp")).alias("fp"), (F.col("_pg") - F.col("tp")).alias("fn"))


def document_metrics(counts: DataFrame) -> DataFrame:
    """B-cubed and pairwise precision, recall and F1 of each document, and whether its partition is exact."""
    p, r = ratio(F.col("b3_precision_sum"), F.col("mentions")), ratio(F.col("b3_recall_sum"), F.col("mentions"))
    made = counts.withColumns({"b3_precision": p, "b3_recall": r, "pair_precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "pair_recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return made.withColumns({"b3_f1": f1(F.col("b3_precision"), F.col("b3_recall")), "pair_f1": ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), "exact": (F.col("fp") == 0) & (F.col("fn") == 0)})


def corpus_metrics(counts: DataFrame, *groups: str) -> DataFrame:
    """Mention-weighted B-cubed, micro-averaged pairs and the share of exact partitions, in all or by ``groups``."""
    summed = counts.groupBy(*groups).agg(
        F.count("*").alias("documents"), *[F.sum(c).alias(c) for c in ("mentions", "b3_precision_sum", "b3_recall_sum", "tp", "fp", "fn")],
        F.count_if((F.col("fp") == 0) & (F.col("fn") == 0)).alias("exact"),
    )
    return document_metrics(summed.withColumnRenamed("exact", "exact_documents")).drop("exact").withColumn("exact_accuracy", ratio(F.col("exact_documents"), F.col("documents")))


def same_mentions(gold: DataFrame, predicted: DataFrame, keys: list[str]) -> bool:
    """Whether both partition the same mentions."""
    return gold.join(predicted, keys, "left_anti").isEmpty() and predicted.join(gold, keys, "left_anti").isEmpty()


# ---- examples -----------------------------------------------------------------------------------------------------


def examples(pairs: DataFrame, per_kind: int, label_col: str = "label", predicted_col: str = "predicted", score_col: str = "score", order_col: str = "pair_id") -> DataFrame:
    """Per outcome: false positives by falling and false negatives by rising score, others by their order; ``outcome`` and ``rank`` are added."""
    y, p = F.col(label_col), F.col(predicted_col)
    outcome = F.when((y == 0) & (p == 1), "fp").when((y == 1) & (p == 0), "fn").when(y == 1, "tp").otherwise("tn")
    key = F.when(F.col("outcome") == "fp", -F.col(score_col)).when(F.col("outcome") == "fn", F.col(score_col)).otherwise(0.0)
    named = pairs.withColumn("outcome", outcome)
    return named.withColumn("rank", F.row_number().over(Window.partitionBy("outcome").orderBy(key, order_col))).where(F.col("rank") <= per_kind)


def one_per_document(rows: DataFrame, group_col: str, k: int, order_col: str, doc_col: str = "doc_id") -> DataFrame:
    """The first k rows of each group, at most one from a document."""
    own = unused(rows, "_r")
    single = rows.withColumn(own, F.row_number().over(Window.partitionBy(group_col, doc_col).orderBy(order_col))).where(F.col(own) == 1).drop(own)
    return single.withColumn("rank", F.row_number().over(Window.partitionBy(group_col).orderBy(order_col))).where(F.col("rank") <= k)
