"""Pair scorers: exact surfaces, ordered substrings, sparse logistic weights, and hooks for models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import rules
from docloom.functions import text as T
from docloom.operators.pairs import tiled


def exact_surface(rule: Column, label_a: Column, label_b: Column, a: Column, b: Column) -> Column:
    """A place rule decides if it can; else equal labels and equal surfaces link."""
    same = (F.lower(label_a) == F.lower(label_b)) & (T.normalize(a) == T.normalize(b))
    return F.when(rule == "link", 1).when(rule == "block", 0).otherwise(same.cast("int"))


def person_roots(mentions: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """People's mentions with ``root_start``: the first mention of the document whose surface contains theirs.

    What contains a mention and comes first comes no later than the mention's own surface does, so only distinct surfaces of a
    document are compared, by tiles; mentions are joined to what these find. A null surface has no root.
    """
    people = mentions.where("label = 'PER'").where(F.col("surface").isNotNull())
    forms = tiled(people.groupBy(id_col, "surface").agg(F.min("start").alias("first")), [id_col], "surface")
    side = lambda s: forms.select(id_col, "tile.low", "tile.high", F.col("tile.mine").alias(f"mine_{s}"), F.col("surface").alias(f"surface_{s}"), F.col("first").alias(f"first_{s}"))
    both = side("a").join(side("b"), [id_col, "low", "high"]).where(((F.col("low") == F.col("high")) | (F.col("mine_a") != F.col("mine_b"))) & F.contains("surface_a", "surface_b"))
    roots = both.groupBy(id_col, F.col("surface_b").alias("surface")).agg(F.min("first_a").alias("root_start"))
    return people.select(id_col, "start", "end", "surface").distinct().join(roots, [id_col, "surface"]).select(id_col, "start", "end", "surface", "root_start")


def nearest_title(context: Column) -> Column:
    """The last title word, folded, within four words on the left of the mention."""
    left = F.slice(F.reverse(T.words(T.split_context(context)["left"])), 1, 4)
    return F.try_element_at(F.filter(left, lambda w: w.isin(*rules.FOLDED_GENDER, "em", "bac", "cu")), F.lit(1))


def gender(title: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for tg in rules.FOLDED_GENDER.items() for x in tg]), title)


def conflicting_titles(context_a: Column, context_b: Column) -> Column:
    """Both titles have a gender, and these differ."""
    return F.coalesce(gender(nearest_title(context_a)) != gender(nearest_title(context_b)), F.lit(False))


def nearest_role(context: Column, window: int = 120) -> Column:
    """The procedural role whose cue stands last on the left."""
    left = F.right(T.split_context(context)["left"], F.lit(window))
    cues = {r: f"(?iU){rules.any_of(p)}" for r, p in rules.ROLE_CUES.items()}
    hits = [F.struct((-F.length(F.element_at(F.split(left, p, -1), -1))).alias("at"), F.lit(r).alias("role")) for r, p in cues.items()]
    seen = [F.when(left.rlike(p), h) for p, h in zip(cues.values(), hits)]
    return F.greatest(*seen)["role"]


def birth_year(context: Column, window: int = 70) -> Column:
    """A year of birth stated near the mention, or null."""
    parts = T.split_context(context)
    near = F.concat(F.right(parts["left"], F.lit(window)), F.lit(" "), F.left(parts["right"], F.lit(window)))
    return F.nullif(F.regexp_extract(near, r"(?iU)sinh\s+(?:năm|ngày[^\d]{0,8}\d{1,2}/\d{1,2}/)\s*((?:19|20)\d{2})", 1), F.lit(""))


def sparse_features(a: Column, b: Column, context_a: Column, context_b: Column, dense: dict[str, Column]) -> Column:
    """A map of features: the dense ones, shared and unshared words, and agreements of title, role and year of birth."""
    wa, wb = T.words(a), T.words(b)
    named = lambda prefix, words: F.transform(words, lambda w: F.struct(F.concat(F.lit(prefix), w).alias("key"), F.lit(1.0).alias("value")))
    cue = lambda name, x, y: F.when(x.isNull() | y.isNull(), F.lit(f"{name}:unknown")).when(x == y, F.lit(f"{name}:same")).otherwise(F.lit(f"{name}:different"))
    cues = F.array(cue("title", nearest_title(context_a), nearest_title(context_b)), cue("role", nearest_role(context_a), nearest_role(context_b)), cue("born", birth_year(context_a), birth_year(context_b)))
    parts = [
        F.array(*[F.struct(F.lit(k).alias("key"), v.cast("double").alias("value")) for k, v in dense.items()]),
        named("shared:", F.array_distinct(F.array_intersect(wa, wb))),
        named("only:", F.array_union(F.array_except(wa, wb), F.array_except(wb, wa))),
        named("", cues),
    ]
    return F.map_from_entries(F.concat(*parts))


def logistic_scores(pairs: DataFrame, weights: DataFrame, intercept: float, id_col: str = "pair_id", features_col: str = "features") -> DataFrame:
    """(id, score): the logistic function of the weighted sum of each pair's map of features; features without weight count nothing."""
    long = pairs.select(id_col, F.explode_outer(features_col).alias("feature", "value"))
    summed = long.join(weights, "feature", "left").groupBy(id_col).agg(F.sum(F.coalesce(F.col("value") * F.col("weight"), F.lit(0.0))).alias("z"))
    z = F.col("z") + F.lit(float(intercept))
    return summed.select(id_col, sigmoid(z).alias("score"))


def sigmoid(z: Column) -> Column:
    """Without overflow for large values of either sign."""
    e = F.exp(-F.abs(z))
    return F.when(z >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def rule_first(label_a: Column, label_b: Column, place_rule: Column, title_conflict: Column, score: Column, threshold: float) -> Column:
    """Labels, then places, then titles, then the score."""
    return F.when(F.lower(label_a) != F.lower(label_b), 0).when(place_rule == "link", 1).when(place_rule == "block", 0).when(title_conflict, 0).otherwise((score >= threshold).cast("int"))


def decisions(place_rule: Column, name_conflict: Column) -> Column:
    """must, cannot or score for each pair, as clustering takes them."""
    return F.when(place_rule == "block", "cannot").when(name_conflict, "cannot").when(place_rule == "link", "must").otherwise("score")


def last_name(surface: Column, label: Column) -> Column:
    """The last word of a person's name, folded in case only; null for others."""
    return F.when(label == "PER", F.try_element_at(T.tokens(surface), F.lit(-1)))


def different_last_names(a: Column, b: Column, label_a: Column, label_b: Column) -> Column:
    return F.coalesce(last_name(a, label_a) != last_name(b, label_b), F.lit(False))


def full_name_conflict(a: Column, b: Column, cutoff: float) -> Column:
    """Both have several words, and these overlap no more than the cutoff."""
    ta, tb = T.tokens(a), T.tokens(b)
    return (F.size(ta) > 1) & (F.size(tb) > 1) & (T.jaccard(ta, tb) <= cutoff)


def train_logistic(pairs: DataFrame, features: list[str], label_col: str = "label", c: float = 0.5, weight_col: str | None = None) -> tuple[DataFrame, float]:
    """((feature, weight), intercept) of an L2 logistic regression over dense columns, by Spark ML."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep").transform(pairs.withColumn("_y", F.col(label_col).cast("double")))
    n = max(1, rows.count())
    model = LogisticRegression(featuresCol="_x", labelCol="_y", regParam=1.0 / (c * n), standardization=False, maxIter=200, tol=1e-9, **({"weightCol": weight_col} if weight_col else {})).fit(rows)
    found = [(f, float(w)) for f, w in zip(features, model.coefficients)]
    return pairs.sparkSession.createDataFrame(found, "feature string, weight double"), float(model.intercept)


#: Features that a sparse model may have; their names go to the driver and to the workers.
MOST_FEATURES = 1_000_000


def train_sparse(pairs: DataFrame, features_col: str = "features", label_col: str = "label", c: float = 0.5, least_pairs: int = 1, weight_col: str | None = None) -> tuple[DataFrame, float]:
    """((feature, weight), intercept) of an L2 logistic regression over maps of features, as ``sparse_features`` makes them.

    Features of fewer than ``least_pairs`` pairs are left out; if over ``MOST_FEATURES`` remain, that is an error, as a sample of them would be another model.
    A null map has no features. Pairs without a label take no part.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import SparseVector, VectorUDT

    known = pairs.where(F.col(label_col).isNotNull())
    counts = known.select(F.explode(F.map_keys(features_col)).alias("feature")).groupBy("feature").agg(F.count("*").alias("n")).where(F.col("n") >= least_pairs)
    names = [r["feature"] for r in counts.select("feature").orderBy("feature").limit(MOST_FEATURES + 1).collect()]
    if len(names) > MOST_FEATURES:
        raise ValueError(f"more than {MOST_FEATURES} features; ask for more pairs of each")
    if not names:
        names = [""]
    place = pairs.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(names)})

    @F.udf(VectorUDT())
    def vector(features):
        own = place.value
        return SparseVector(len(own), sorted((own[k], float(v)) for k, v in (features or {}).items() if k in own and v))

    rows = known.select(vector(features_col).alias("_x"), F.col(label_col).cast("double").alias("_y"), *([F.col(weight_col)] if weight_col else []))
    n = max(1, known.count())
    model = LogisticRegression(featuresCol="_x", labelCol="_y", regParam=1.0 / (c * n), standardization=False, maxIter=200, tol=1e-9, **({"weightCol": weight_col} if weight_col else {})).fit(rows)
    found = [(f, float(w)) for f, w in zip(names, model.coefficients.toArray()) if w]
    return pairs.sparkSession.createDataFrame(found, "feature string, weight double"), float(model.intercept)


def score_mentions_once(pairs: DataFrame, mentions: DataFrame, encode: Callable[[pd.Series], pd.Series], head: Callable[[pd.DataFrame], pd.Series], key: str = "context") -> DataFrame:
    """Pairs with ``score`` from a model of two parts: each distinct context is encoded once, and the head scores pairs of vectors.

    ``encode`` maps a series of contexts to one of vectors; ``head`` a frame with the columns of ``pairs`` and vector_a, vector_b to one of scores.
    """

    def encoded(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({key: part[key], "vector": encode(part[key])})

    vectors = mentions.select(key).distinct().mapInPandas(encoded, f"{key} string, vector array<double>")
    both = pairs.join(vectors.select(F.col(key).alias(f"{key}_a"), F.col("vector").alias("vector_a")), f"{key}_a").join(vectors.select(F.col(key).alias(f"{key}_b"), F.col("vector").alias("vector_b")), f"{key}_b")

    def scored(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(score=head(part))

    schema = ", ".join(f"`{n}` {t}" for n, t in both.dtypes) + ", score double"
    return both.mapInPandas(scored, schema).drop("vector_a", "vector_b")
