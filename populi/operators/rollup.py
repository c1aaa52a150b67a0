"""Summary tables: metric statistics at several levels, shares, thresholds, comparisons and costs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from populi.functions import fixed_values as fixed
from populi.operators.groups import at_levels, describe, rank_within
from populi.operators.wide import compare_long

QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def stack_metrics(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Long form (keys, metric, value) of numeric columns, without nulls and NaN."""
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return (df.select(*keys, F.explode(cells).alias("__m")).select(*keys, "__m.metric", "__m.value")
            .filter(F.col("value").isNotNull() & ~F.isnan("value")))


def metric_stats(long: DataFrame, keys: Sequence[str], quantiles: Mapping[str, float] | None = None) -> DataFrame:
    """count, mean, std (population), min, max and exact quantiles of `value` per group."""
    keys = list(keys)
    quantiles = QUARTILES if quantiles is None else quantiles
    if quantiles:
        return describe(long, keys, "value", dict(quantiles))
    return long.groupBy(*keys).agg(F.count("value").alias("n"), F.avg("value").alias("mean"),
                                   F.stddev_pop("value").alias("std"), F.min("value").alias("min"),
                                   F.max("value").alias("max"))


def level_stats(df: DataFrame, path: Sequence[str], metrics: Sequence[str],
                quantiles: Mapping[str, float] | None = None) -> DataFrame:
    """metric_stats of several metrics at every level of the path."""
    long = stack_metrics(df, path, metrics)
    quantiles = QUARTILES if quantiles is None else quantiles
    if quantiles:
        return describe(long, ["metric"], "value", dict(quantiles), path)
    return metric_stats(at_levels(long, path), [*path, "metric"], quantiles)


def threshold_stats(df: DataFrame, path: Sequence[str], metric: str, threshold: float) -> DataFrame:
    """Count and share of rows at or below a threshold, and means over all and over those rows, per level."""
    value, below = F.col(metric), F.col(metric) <= threshold
    return (at_levels(df.select(*path, metric).filter(value.isNotNull()), path).groupBy(*path)
            .agg(F.count(F.lit(1)).alias("n"), F.count_if(below).alias("n_below"), F.avg(value).alias("mean_all"),
                 F.avg(F.when(below, value)).alias("mean_below"))
            .withColumn("pct_below", F.col("n_below") / F.col("n") * 100.0))


def group_means(df: DataFrame, keys: Sequence[str], metrics: Sequence[str], min_reviews: int,
                name: str | None = None) -> DataFrame:
    """Mean of each metric for groups of at least min_reviews rows, with any one name of the group."""
    extra = [F.max(name).alias(name)] if name else []
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(f"mean_{m}") for m in metrics], *extra)
            .filter(F.col("n") >= min_reviews))


def two_means(df: DataFrame, outer: str, inner: str, metric: str) -> DataFrame:
    """A group's mean over its rows and over its inner groups' means, from one pass over the rows."""
    per_inner = df.groupBy(outer, inner).agg(F.sum(metric).alias("s"), F.count(metric).alias("c"))
    return per_inner.groupBy(outer).agg(
        (F.sum("s") / F.sum("c")).alias("mean_over_rows"), F.avg(F.col("s") / F.col("c")).alias("mean_of_means"),
        F.count(F.lit(1)).alias("n_inner"), F.sum("c").alias("n_rows"))


def histogram(df: DataFrame, metric: str, edges: int = 30) -> DataFrame:
    """Rows per bin of edges - 1 equal bins from minimum to maximum; the last bin includes its right edge."""
    bins = edges - 1
    span = df.agg(F.struct(F.min(metric).alias("lo"), F.max(metric).alias("hi"), F.count(metric).alias("n"))).scalar()
    placed = (df.filter(F.col(metric).isNotNull()).select(F.col(metric).alias("v"), span.alias("s"))
              .withColumn("w", (F.col("s.hi") - F.col("s.lo")) / F.lit(bins))
              .withColumn("bin", F.when(F.col("w") > 0, F.least(
                  F.lit(bins - 1), F.floor((F.col("v") - F.col("s.lo")) / F.col("w")))).otherwise(0).cast("int")))
    return (placed.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.max("s").alias("s"), F.max("w").alias("w"))
            .select("bin", (F.col("s.lo") + (F.col("bin") + 0.5) * F.col("w")).alias("center"), "n",
                    (F.col("n") / F.col("s.n") * 100.0).alias("pct")))


def shares(counted: DataFrame, count: str = "n", name: str = "pct", within: Sequence[str] = ()) -> DataFrame:
    """Percentage of the total of an already aggregated table (its rows are one per category, reason or the like)."""
    return counted.withColumn(name, F.col(count) / F.sum(count).over(Window.partitionBy(*within)) * 100.0)


def reason_counts(df: DataFrame, reason: str = "reason") -> DataFrame:
    """Rows per reason with 'matched' for rows without one."""
    return shares(df.groupBy(F.coalesce(reason, F.lit("matched")).alias("outcome"))
                  .agg(F.count(F.lit(1)).alias("n")))


def pooled_theme_distributions(df: DataFrame, path: Sequence[str], average: bool = False) -> DataFrame:
    """Mass per (level, side, theme) of normalised maps `actual` and `predicted`: summed, or averaged over the
    reviews in which the theme occurs."""
    entries = lambda side: F.transform(F.map_entries(side), lambda e: F.struct(
        F.lit(side).alias("side"), e["key"].alias("theme"), e["value"].alias("p")))
    long = (df.select(*path, F.explode(F.concat(entries("actual"), entries("predicted"))).alias("e"))
            .select(*path, "e.side", "e.theme", "e.p"))
    finest = long.groupBy(*path, "side", "theme").agg(F.sum("p").alias("s"), F.count(F.lit(1)).alias("c"))
    pooled = at_levels(finest, path).groupBy(*path, "side", "theme").agg(F.sum("s").alias("s"), F.sum("c").alias("c"))
    return pooled.withColumn("mass", F.col("s") / F.col("c") if average else F.col("s")).drop("s", "c")


def pooled_divergence(df: DataFrame, path: Sequence[str], *, average: bool = False, truth_only: bool = False,
                      min_reviews: int = 1) -> DataFrame:
    """Pool first, compare afterwards: JSD and WD of a level's pooled sides. Only the deepest level is subject to
    min_reviews; truth_only keeps the themes the actual side has."""
    both = pooled_theme_distributions(df, path, average).groupBy(*path, "theme").agg(
        F.coalesce(F.max(F.when(F.col("side") == "actual", F.col("mass"))), F.lit(0.0)).alias("a"),
        F.coalesce(F.max(F.when(F.col("side") == "predicted", F.col("mass"))), F.lit(0.0)).alias("p"))
    if truth_only:
        both = both.filter(F.col("a") > 0)
    sizes = at_levels(df.select(*path), path).groupBy(*path).agg(F.count(F.lit(1)).alias("n_reviews"))
    result = (compare_long(both, path, "theme", "a", "p").join(sizes, list(path))
              .select(*path, "n_reviews", "jsd", "wd", F.col("support").cast("int").alias("n_themes")))
    return result.filter((F.col(path[-1]) == "ALL") | (F.col("n_reviews") >= min_reviews))


def quantitative_summary(df: DataFrame, keys: Sequence[str], rating: str = "rating",
                         sentiment: str = "sentiment") -> DataFrame:
    """Mean rating to two decimals and the share of each sentiment to one, per group."""
    counted = df.groupBy(*keys, F.coalesce(sentiment, F.lit("Unknown")).alias("__s")).agg(
        F.count(F.lit(1)).alias("c"), F.sum(rating).alias("s"), F.count(rating).alias("r"))
    packed = counted.groupBy(*keys).agg(
        F.sum("c").alias("n"), (F.sum("s") / F.sum("r")).alias("__mean"),
        F.map_from_entries(F.collect_list(F.struct("__s", "c"))).alias("__m"))
    return packed.select(*keys, "n", F.round("__mean", 2).alias("average_rating"), F.transform_values(
        "__m", lambda _, c: F.round(c / F.col("n") * 100.0, 1)).alias("sentiment_percent"))


def empty_theme_rates(df: DataFrame, category: str, empty: Column) -> DataFrame:
    """Rows, rows without themes and their share, per category and in total."""
    return (at_levels(df.select(F.coalesce(category, F.lit("Unknown")).alias("category"), empty.alias("e")),
                      ["category"]).groupBy("category")
            .agg(F.count(F.lit(1)).alias("total"), F.count_if("e").alias("empty"))
            .withColumns({"with_themes": F.col("total") - F.col("empty"),
                          "empty_pct": F.col("empty") / F.col("total") * 100.0}))


def topic_universe(df: DataFrame, category: str, theme: str) -> DataFrame:
    """Sorted distinct themes and their number per category; distinct pairs are formed before they are gathered."""
    return (df.select(category, theme).distinct().groupBy(category)
            .agg(F.array_sort(F.collect_list(theme)).alias("topics"), F.count(F.lit(1)).alias("n_topics")))


def ranked_groups(groups: DataFrame, score: str, path: Sequence[str]) -> DataFrame:
    """One row per group with rank, 1 for the best score; the path breaks ties."""
    order = [F.desc(score), *[F.asc(p) for p in path]]
    down = groups.withColumn("__all", F.lit(1))
    return rank_within(down, ["__all"], order, rank="rank").drop("__all")


def composite_score(jsd: Column, wd: Column, recall_3k: Column, recall_4k: Column) -> Column:
    """Weighted mean of the improvements that are known; 0 when none is."""
    parts = [(jsd, 0.3), (wd, 0.3), (recall_3k, 0.2), (recall_4k, 0.2)]
    score, weight = F.lit(0.0), F.lit(0.0)
    for value, w in parts:
        known = value.isNotNull() & ~F.isnan(value)
        score = score + F.when(known, value * w).otherwise(0.0)
        weight = weight + F.when(known, F.lit(w)).otherwise(0.0)
    return F.when(weight > 0, score / weight).otherwise(0.0)


def lower_is_better_pct(before: Column, after: Column) -> Column:
    both = before.isNotNull() & after.isNotNull()
    return F.when(both & (before > 0), (before - after) / before * 100.0).when(both, 0.0)


def higher_is_better_pct(before: Column, after: Column) -> Column:
    """From zero to something counts as 1000 percent."""
    both = before.isNotNull() & after.isNotNull()
    return (F.when(both & (before > 0), (after - before) / before * 100.0)
            .when(both & (before == 0) & (after > 0), 1000.0).when(both, 0.0))


def method_pivot(df: DataFrame, keys: Sequence[str], method: str, methods: Sequence[str], metric: str) -> DataFrame:
    """One row per group with the metric's mean under every method."""
    return df.groupBy(*keys).pivot(method, list(methods)).agg(F.avg(metric))


def before_and_after(before: DataFrame, after: DataFrame, keys: Sequence[str], metric: str) -> DataFrame:
    """Full outer comparison of two group means, with the difference and whether both sides exist."""
    mean = lambda df, name: df.groupBy(*keys).agg(F.avg(metric).alias(f"{name}_mean"), F.count(metric).alias(f"{name}_n"))
    return (mean(before, "pre").join(mean(after, "post"), list(keys), "full")
            .withColumn("improvement_pct", lower_is_better_pct(F.col("pre_mean"), F.col("post_mean")))
            .withColumn("in_both", F.col("pre_n").isNotNull() & F.col("post_n").isNotNull()))


def priced_model(model: Column) -> Column:
    """Name under which a model is priced; an unknown model keeps its lower-cased name."""
    name, known = F.lower(model), list(fixed.MODEL_PRICES)
    return (F.when(name.isin(known), name).when(F.contains(name, F.lit("o3")), "o3")
            .when(F.contains(name, F.lit("gpt-5.2")), "gpt-5.2")
            .when(F.contains(name, F.lit("gpt-4o")) & ~F.contains(name, F.lit("mini")), "gpt-4o")
            .when(F.contains(name, F.lit("gpt-4o-mini")), "gpt-4o-mini")
            .when(F.contains(name, F.lit("gpt-5-mini")), "gpt-5-mini").otherwise(name))


def usage_costs(calls: DataFrame, prices: Mapping[str, tuple[float, float, float]] | None = None) -> DataFrame:
    """Calls, tokens and cost in USD per model and call type, per model and in total; unknown models cost nothing."""
    prices = fixed.MODEL_PRICES if prices is None else prices
    table = F.create_map(*[x for m, p in prices.items() for x in (F.lit(m), F.array(*[F.lit(float(v)) for v in p]))])
    priced = calls.withColumn("model", priced_model(F.col("model"))).withColumn("__p", F.try_element_at(table, F.col("model")))
    million = lambda tokens, i: F.coalesce(tokens, F.lit(0)) / 1e6 * F.get("__p", i)
    cost = F.coalesce(million(F.col("input_tokens"), 0) + million(F.col("cached_input_tokens"), 1)
                      + million(F.col("output_tokens"), 2), F.lit(0.0))
    rows = priced.select("model", "call_type", "input_tokens", "output_tokens", "cached_input_tokens", cost.alias("cost"))
    return at_levels(rows, ["model", "call_type"]).groupBy("model", "call_type").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"), F.sum("cached_input_tokens").alias("cached_input_tokens"),
        F.sum("cost").alias("cost"))


def population_by_category(reviews: DataFrame, user: str, category: str) -> DataFrame:
    """Users, reviews, reviews per user and share of all reviews for each category."""
    counted = reviews.groupBy(category).agg(F.countDistinct(user).alias("users"), F.count(F.lit(1)).alias("reviews"))
    return shares(counted.withColumn("per_user", F.col("reviews") / F.col("users")), "reviews")


def users_by_category_count(reviews: DataFrame, user: str, category: str) -> DataFrame:
    per_user = reviews.select(user, category).distinct().groupBy(user).agg(F.count(F.lit(1)).alias("n_categories"))
    return shares(per_user.groupBy("n_categories").agg(F.count(F.lit(1)).alias("users")), "users")


def reviews_per_user_histogram(reviews: DataFrame, user: str) -> DataFrame:
    per_user = reviews.groupBy(user).agg(F.count(F.lit(1)).alias("n_reviews"))
    return shares(per_user.groupBy("n_reviews").agg(F.count(F.lit(1)).alias("users")), "users")


def split_counts(reviews: DataFrame, user: str, category: str, split: str = "split") -> DataFrame:
    """Reviews per category and split, and distinct users per category over both splits."""
    return reviews.groupBy(category).agg(F.count_if(F.col(split) == "train").alias("train"),
                                         F.count_if(F.col(split) == "test").alias("test"),
                                         F.countDistinct(user).alias("users"))
