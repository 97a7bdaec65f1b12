"""Connected components of many small graphs, or of a few large ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.sources.steps import Rounds, stored


def components(edges: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, v, label): for each vertex of ``edges`` (id, a, b) the smallest vertex of its graph ``id`` that it reaches.

    Each vertex takes the least label of its neighbours, and then the label of that label, which halves the paths in each
    round. No vertex is a row with its neighbours, so one with many does not make a task large. Edges that repeat, loops and an
    empty table are allowed; edges with a null end play no part.
    """
    edges = edges.select(id_col, "a", "b").where("a is not null and b is not null")
    both = stored(edges.union(edges.select(id_col, F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "component-edges")
    rounds = Rounds(edges.sparkSession, "component-labels")
    labels = rounds.store(both.groupBy(id_col, F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("v")).alias("label"), F.lit(True).alias("moved")))
    while not labels.where("moved").isEmpty():
        near = both.join(labels.select(id_col, F.col("v").alias("a"), "label"), [id_col, "a"]).select(id_col, F.col("b").alias("v"), "label", F.lit(None).cast(dict(labels.dtypes)["label"]).alias("had"))
        least = near.union(labels.select(id_col, "v", "label", F.col("label").alias("had"))).groupBy(id_col, "v").agg(F.min("label").alias("label"), F.max("had").alias("had"))
        least = stored(least, "component-least")
        top = least.select(id_col, F.col("v").alias("label"), F.col("label").alias("top"))
        jumped = least.join(top, [id_col, "label"], "left").select(id_col, "v", F.least("label", "top").alias("new"), "had")
        labels = rounds.store(jumped.select(id_col, "v", F.col("new").alias("label"), (F.col("new") != F.col("had")).alias("moved")))
    return labels.select(id_col, "v", "label")
