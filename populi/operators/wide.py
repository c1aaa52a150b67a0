"""Long-form distribution comparison for supports too wide for maps: one row per (review, theme)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from populi.functions.dist import EPSILON, jsd_term


def compare_long(sides: DataFrame, keys: str | Sequence[str], theme: str, actual: str, predicted: str) -> DataFrame:
    """JSD, WD and support size per key from (keys, theme, actual mass, predicted mass).

    Totals are aggregated and joined back, so even one key's themes may be spread over many tasks."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    cells = sides.groupBy(*keys, theme).agg(F.coalesce(F.sum(actual), F.lit(0.0)).alias("x"),
                                            F.coalesce(F.sum(predicted), F.lit(0.0)).alias("y"))
    totals = cells.groupBy(*keys).agg(F.sum("x").alias("a"), F.sum("y").alias("b"), F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    smooth = lambda mass, total: F.when(F.col(total) != 0, (F.col(mass) / F.col(total) + EPSILON) / (1.0 + n * EPSILON)
                                        ).otherwise(1.0 / n)
    placed = cells.join(totals, keys).select(
        *keys, "n", smooth("x", "a").alias("p"), smooth("y", "b").alias("q"),
        F.when((F.col("a") != 0) & (F.col("b") != 0), F.abs(F.col("x") / F.col("a") - F.col("y") / F.col("b"))).alias("g"))
    return placed.groupBy(*keys).agg(F.sum(jsd_term(F.col("p"), F.col("q"))).alias("jsd"),
                                     (0.5 * F.sum("g")).alias("wd"), F.max("n").alias("support"))


def theme_map(long: DataFrame, key: str, theme: str, **values: str) -> DataFrame:
    """Maps per key out of (key, theme, value columns); repeated themes are summed first.

    Rows are dealt by the key alone, which serves both aggregations: themes seldom repeat, so sums ahead would save little."""
    summed = long.repartition(key).groupBy(key, theme).agg(*[F.sum(c).alias(c) for c in values.values()])
    return summed.groupBy(key).agg(*[
        F.map_from_entries(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(theme, c)))).alias(name)
        for name, c in values.items()])


def audit(df: DataFrame, stored: str, recomputed: str, tolerance: float = 1e-6) -> DataFrame:
    """One row: how many stored values a recomputation confirms, and the largest difference."""
    gap = F.abs(F.col(stored) - F.col(recomputed))
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(gap < tolerance).alias("n_agree"), F.max(gap).alias("largest_gap"))
