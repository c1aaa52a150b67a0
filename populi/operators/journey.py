"""Correction journeys: each review's initial deltas and its corrected ones, as many as were observed.

Limits on iterations are the caller's: `last` is None for all that the data hold.

Nested form: initial struct<theme, overall, text>, steps array<struct<iteration, theme, overall, text, prediction>>.
Long form: (review_key, iteration, delta), iteration 0 being the initial prediction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from populi.functions import fixed_values as fixed
from populi.functions.base import let
from populi.functions.dist import compare, jsd
from populi.functions.recall import ranked, recall_at_max_nk
from populi.operators.groups import at_levels


def overall_delta(text: Column, theme: Column, stated: Column | None = None) -> Column:
    weighted = fixed.TEXT_WEIGHT * text + fixed.THEME_WEIGHT * theme
    return weighted if stated is None else F.coalesce(stated, weighted)


def nest_steps(long: DataFrame, keys: Sequence[str], fields: Sequence[str], last: int | None = None) -> DataFrame:
    """Iteration-sorted steps per review from the long form.

    Repeated iterations keep the smallest row, so the array has one entry an iteration."""
    row = F.struct("iteration", *fields)
    kept = F.col("iteration") >= 0 if last is None else F.col("iteration").between(0, last)
    single = (long.filter(kept).groupBy(*keys, "iteration").agg(F.min(row).alias("__s")))
    return single.groupBy(*keys).agg(F.array_sort(F.collect_list("__s")).alias("steps"))


def _last(steps: Column, last: int | Column | None) -> Column:
    """The stated last iteration, or the review's own; steps are sorted."""
    if last is None:
        return F.greatest(F.coalesce(F.element_at(steps, -1)["iteration"], F.lit(0)), F.lit(0)).cast("int")
    return F.lit(last) if isinstance(last, int) else last.cast("int")


def running_best(steps: Column, field: str, last: int | Column | None = None) -> Column:
    """Smallest value seen up to each iteration 0..last; null before the first one. One pass over the sorted steps."""
    grow = lambda acc, s: F.concat(acc, F.array(F.least(F.get(acc, F.size(acc) - 1), s[field].cast("double"))))

    def spread(given: Column) -> Column:
        """Each minimum repeated up to the next step's iteration."""
        end = given["end"]
        best = F.reduce(given["steps"], F.array().cast("array<double>"), grow)
        at = F.transform(given["steps"], lambda s: s["iteration"].cast("int"))
        until = F.concat(F.slice(at, 2, F.greatest(F.size(at), F.lit(1))), F.array(end + 1))
        runs = F.zip_with(best, F.zip_with(at, until, lambda x, y: y - x), lambda v, n: F.array_repeat(v, n))
        before = F.array_repeat(F.lit(None).cast("double"), F.coalesce(F.get(at, 0), end + 1))
        return F.concat(before, F.when(F.size(at) > 0, F.flatten(runs)).otherwise(F.array().cast("array<double>")))
    end = _last(steps, last)
    kept = F.filter(steps, lambda s: (s["iteration"] >= 0) & (s["iteration"] <= end))
    return F.when(steps.isNotNull(), let(F.struct(kept.alias("steps"), end.alias("end")), spread))


def dense_grid(nested: DataFrame, keys: Sequence[str], fields: Sequence[str], fill: float | None = None,
               last: int | Column | None = None) -> DataFrame:
    """(keys, iteration, one running minimum per field) for every iteration; fill replaces a missing value."""
    zipped = F.arrays_zip(*[running_best(F.col("steps"), f, last).alias(f) for f in fields])
    grid = nested.select(*keys, F.posexplode(zipped).alias("iteration", "__g"))
    value = lambda f: F.col(f"__g.{f}") if fill is None else F.coalesce(F.col(f"__g.{f}"), F.lit(fill))
    return grid.select(*keys, "iteration", *[value(f).alias(f) for f in fields])


def convergence(nested: DataFrame, path: Sequence[str], fields: Sequence[str], fill: float | None = None,
                last: int | Column | None = None) -> DataFrame:
    """Mean first and last running minimum and the improvement, per level and delta kind."""
    within = lambda f, upto: F.array_min(F.transform(F.filter(F.col("steps"), lambda s: s["iteration"] <= upto), lambda s: s[f]))
    ends = F.array(*[F.struct(F.lit(f.upper()).alias("kind"), within(f, F.lit(0)).alias("i0"),
                              within(f, _last(F.col("steps"), last)).alias("i_last")) for f in fields])
    rows = nested.select(*path, F.explode(ends).alias("e")).select(*path, "e.kind", "e.i0", "e.i_last")
    if fill is not None:
        rows = rows.fillna(fill, ["i0", "i_last"])
    means = at_levels(rows, path).groupBy(*path, "kind").agg(
        F.avg("i0").alias("i0_mean"), F.avg("i_last").alias("i_last_mean"), F.count(F.lit(1)).alias("n"))
    gain = F.col("i0_mean") - F.col("i_last_mean")
    return means.withColumn("improvement", gain).withColumn(
        "improvement_pct", F.when(F.col("i0_mean") > 0, gain / F.col("i0_mean") * 100.0).otherwise(0.0))


def best_by_theme(initial: Column, steps: Column, same: float = fixed.SAME_DELTA) -> Column:
    """Best step by the order-dependent rule: a smaller theme delta, or nearly the same one and a smaller overall delta.

    Steps without a prediction are passed over. Returns struct<iteration, theme, overall, prediction>; iteration 0 is
    the initial prediction. The rule is not associative, so it stays a fold over one review's few steps."""
    start = F.struct(F.lit(0).alias("iteration"), F.coalesce(initial["theme"], F.lit(1.0)).alias("theme"),
                     F.coalesce(initial["overall"], F.lit(1.0)).alias("overall"),
                     initial["prediction"].alias("prediction"))

    def step(acc: Column, s: Column) -> Column:
        better = s["prediction"].isNotNull() & s["theme"].isNotNull() & (
            (s["theme"] < acc["theme"]) | ((F.abs(s["theme"] - acc["theme"]) < same)
                                           & F.coalesce(s["overall"] < acc["overall"], F.lit(False))))
        return F.when(better, F.struct(s["iteration"].cast("int").alias("iteration"), s["theme"].alias("theme"),
                                       F.coalesce(s["overall"], acc["overall"]).alias("overall"),
                                       s["prediction"].alias("prediction"))).otherwise(acc)
    return F.aggregate(F.filter(steps, lambda s: s["iteration"] >= 1), start, step)


def improves_on(best: Column, initial: Column, same: float = fixed.SAME_DELTA) -> Column:
    """Whether the best step beats the initial prediction by the same rule."""
    theme, overall = F.coalesce(initial["theme"], F.lit(1.0)), F.coalesce(initial["overall"], F.lit(1.0))
    return (best["theme"] < theme) | ((F.abs(best["theme"] - theme) < same) & (best["overall"] < overall))


def best_by_overall(initial: Column, steps: Column) -> Column:
    """Step with the strictly smallest overall delta; the earliest wins, the initial prediction included."""
    entry = lambda it, s: F.struct(F.coalesce(s["overall"], F.lit(float("inf"))).alias("overall"),
                                   it.alias("iteration"), s["theme"].alias("theme"),
                                   s["prediction"].alias("prediction"))
    later = F.transform(F.filter(steps, lambda s: (s["iteration"] >= 1) & s["overall"].isNotNull()),
                        lambda s: entry(s["iteration"].cast("int"), s))
    return F.array_min(F.concat(F.array(entry(F.lit(0), initial)), later))


def mean_of_minima(long: DataFrame, review: Sequence[str], group: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Mean over a group's reviews of each review's smallest delta."""
    per = long.groupBy(*group, *review).agg(*[F.min(v).alias(v) for v in values])
    return per.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(f"best_{v}_mean") for v in values])


def behaviour_loss(long: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Smallest delta of a group and the loss against its mean initial delta, in percent."""
    sums = long.groupBy(*group).agg(F.min(value).alias("best"),
                                    F.avg(F.when(F.col("iteration") == 0, F.col(value))).alias("initial_mean"))
    return sums.withColumn("loss_pct", F.when(F.col("initial_mean") != 0, (F.col("initial_mean") - F.col("best"))
                                              / F.col("initial_mean") * 100.0))


def status(before: Column, after: Column) -> Column:
    return F.when(after < before, "IMPROVED").when(after > before, "WORSE").otherwise("UNCHANGED")


def revoked(before: Column, after: Column) -> Column:
    """Whether the analysis behind a correction is to be taken back: the delta got worse."""
    return F.coalesce(after > before, F.lit(False))


def worklist(nested: DataFrame, keys: Sequence[str], threshold: float = 0.3,
             failed: DataFrame | None = None) -> DataFrame:
    """Reviews whose latest theme delta exceeds the threshold, together with earlier failures."""
    latest = F.element_at("steps", -1)
    due = (nested.filter(F.size("steps") > 0)
           .select(*keys, latest["iteration"].alias("iteration"), latest["theme"].alias("theme"))
           .filter(F.col("theme") > threshold).withColumn("cause", F.lit("above_threshold")))
    if failed is None:
        return due
    again = failed.select(*keys, "iteration", F.lit(None).cast("double").alias("theme"), F.lit("failed").alias("cause"))
    return due.unionByName(again.join(due.select(*keys), list(keys), "left_anti").dropDuplicates(list(keys)))


def best_metrics(actual: Column, initial: Column, steps: Column, truth: Column) -> Column:
    """struct<iteration, jsd, wd, recall_at_max3k, recall_at_max4k> of the best prediction of a journey.

    steps: array<struct<iteration, theme, predicted>>. The initial prediction stands with its own JSD as delta; a step
    replaces it with a strictly smaller stated delta, the earliest of the smallest. Only the winner is measured."""
    usable = F.filter(steps, lambda s: s["theme"].isNotNull() & ~F.isnan(s["theme"]) & (F.size(s["predicted"]) > 0))
    lead = F.array_min(F.transform(usable, lambda s: F.struct(s["theme"].alias("theme"), s["iteration"].alias("iteration"))))
    start = F.when(F.size(initial) > 0, jsd(actual, initial))
    def measured(w: Column) -> Column:
        order = ranked(w["p"])
        return let(compare(actual, w["p"]), lambda c: F.struct(
            w["i"].alias("iteration"), c["jsd"].alias("jsd"), c["wd"].alias("wd"),
            recall_at_max_nk(order, truth, 3, no_truth=None).alias("recall_at_max3k"),
            recall_at_max_nk(order, truth, 4, no_truth=None).alias("recall_at_max4k")))

    def chosen(x: Column) -> Column:
        stepped = x["lead"].isNotNull() & (x["start"].isNull() | (x["lead"]["theme"] < x["start"]))
        won = F.when(stepped, F.get(F.filter(usable, lambda s: s["iteration"] == x["lead"]["iteration"]), 0)["predicted"]).otherwise(initial)
        best = F.struct(won.alias("p"), F.when(stepped, x["lead"]["iteration"]).otherwise(0).cast("int").alias("i"))
        return let(best, lambda w: F.when(F.size(w["p"]) > 0, measured(w)))
    return let(F.struct(start.alias("start"), lead.alias("lead")), chosen)  # bound: each is compared once
