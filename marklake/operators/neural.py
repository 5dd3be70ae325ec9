"""Ternary weights and attention over a few slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marklake.functions.phases import let


def ternary_weights(vector: Column, share: float = 0.7) -> Column:
    """-1, 0, 1 by a threshold of `share` times the mean absolute weight."""
    absolute = F.aggregate(vector, F.lit(0.0), lambda s, x: s + F.abs(x.cast("double")))
    cut = absolute * F.lit(float(share)) / F.size(vector)
    return let(cut, lambda c: F.transform(vector, lambda x: F.when(x.cast("double") > c, 1).when(x.cast("double") < -c, -1).otherwise(0)))


def attended(scores: DataFrame, values: DataFrame, scale: float, least: float = 0.01) -> DataFrame:
    """(qid, place, value): softmax of score / scale over the slots, weights of `least` and below dropped, values added up by weight. scores: (qid, id, score), values: (id, vector)."""
    w = Window.partitionBy("qid")
    z = scores.withColumn("z", F.col("score") / F.lit(float(scale)))
    e = z.withColumn("e", F.exp(F.col("z") - F.max("z").over(w)))
    weights = e.select("qid", "id", (F.col("e") / F.sum("e").over(w)).alias("weight")).where(F.col("weight") > least)
    places = values.select("id", F.posexplode("vector").alias("place", "v"))
    return weights.join(places, "id").groupBy("qid", "place").agg(F.sum(F.col("weight") * F.col("v")).alias("value"))
