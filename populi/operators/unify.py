"""Results of several prediction methods in one schema, and the choice among results for the same stimulus."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from populi.operators.groups import keep_top


def to_results(df: DataFrame, method: str, *, user: Column, product: Column, accuracy: Column, recall: Column,
               extra: Mapping[str, Column] | None = None) -> DataFrame:
    """user_id, stimulus_product_id, simulation_method, overall_accuracy, recall_at_max3k and any extra columns."""
    return df.select(user.alias("user_id"), product.alias("stimulus_product_id"), F.lit(method).alias("simulation_method"),
                     accuracy.cast("double").alias("overall_accuracy"), recall.cast("double").alias("recall_at_max3k"),
                     *[c.alias(n) for n, c in (extra or {}).items()])


def best_results(parts: Sequence[DataFrame], keys: Sequence[str], position: str, keep: str = "best") -> DataFrame:
    """One result per key: best score, first or last by position. The score is the accuracy, or the recall where the
    accuracy is 0 or missing; the earlier result wins a tie."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    accuracy = F.coalesce("overall_accuracy", F.lit(0.0))
    score = F.when(accuracy == 0, F.coalesce("recall_at_max3k", F.lit(0.0))).otherwise(accuracy)
    orders = {"best": [score.desc(), F.col(position).asc()], "first": [F.col(position).asc()], "last": [F.col(position).desc()]}
    return keep_top(rows, keys, orders.get(keep, orders["first"]))
