"""Theme distributions held as map<string,double>, one row per review.

Lambdas over maps suit supports of tens of themes; operators/wide.py has the long form for wide ones.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from populi.functions.base import let, non_empty

EPSILON = 1e-10


def total(m: Column) -> Column:
    return F.aggregate(F.map_values(m), F.lit(0.0), lambda acc, v: acc + F.coalesce(v, F.lit(0.0)))


def empty_map() -> Column:
    return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))


def normalise(m: Column) -> Column:
    """Scale a map to sum 1; an all-zero or empty map becomes the empty map."""
    return let(total(m), lambda s: F.when(s != 0, F.transform_values(m, lambda _, v: v / s)).otherwise(empty_map()))


def uniform(themes: Column) -> Column:
    """A list of names as a uniform distribution over its distinct names."""
    return let(F.array_distinct(themes), lambda names: F.map_from_entries(F.transform(
        names, lambda t: F.struct(t.alias("key"), (F.lit(1.0) / F.size(names)).alias("value")))))


def positive_entries(m: Column) -> Column:
    return F.map_filter(m, lambda _, v: v > 0)


def finite_entries(m: Column) -> Column:
    return F.map_filter(m, lambda _, v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))


def align(actual: Column, predicted: Column) -> Column:
    """Both sides on the union of their themes, zero filled: map<theme, struct<x,y>>."""
    return F.map_zip_with(actual, predicted, lambda _, x, y: F.struct(
        F.coalesce(x, F.lit(0.0)).alias("x"), F.coalesce(y, F.lit(0.0)).alias("y")))


def zero_fill(m: Column, themes: Column) -> Column:
    """The map restricted to and zero filled over a fixed theme list."""
    return F.map_from_entries(F.transform(F.array_distinct(themes), lambda t: F.struct(
        t.alias("key"), F.coalesce(F.element_at(m, t), F.lit(0.0)).alias("value"))))


def _smoothed(mass: Column, side_total: Column, n: Column) -> Column:
    """epsilon is added after normalising, then the side is normalised again; an all-zero side counts as uniform."""
    return F.when(side_total != 0, (mass / side_total + EPSILON) / (1.0 + n * EPSILON)).otherwise(1.0 / n)


def jsd_term(p: Column, q: Column) -> Column:
    """One theme's share of the base-2 Jensen-Shannon divergence; p and q must be positive."""
    return 0.5 * (p * F.log2(2.0 * p / (p + q)) + q * F.log2(2.0 * q / (p + q)))


def compare(actual: Column, predicted: Column, support: Column | None = None) -> Column:
    """struct<jsd, wd, support, overlap> of two maps in one pass over the union of their themes.

    wd is the Wasserstein-1 distance with unit cost, i.e. half the L1 distance; it is null when a side has no mass.
    support: the size of a theme list that holds the union; its other themes, zero on both sides, have equal terms."""

    def measured(c: Column) -> Column:
        rows = F.transform(c["cells"], lambda s: F.struct(
            _smoothed(s["x"], c["a"], c["n"]).alias("p"),
            _smoothed(s["y"], c["b"], c["n"]).alias("q"),
            F.when((c["a"] != 0) & (c["b"] != 0), F.abs(s["x"] / c["a"] - s["y"] / c["b"]))
            .otherwise(0.0).alias("gap")))
        folded = F.aggregate(
            rows, F.struct(F.lit(0.0).alias("jsd"), F.lit(0.0).alias("gap")),
            lambda acc, r: F.struct((acc["jsd"] + jsd_term(r["p"], r["q"])).alias("jsd"),
                                    (acc["gap"] + r["gap"]).alias("gap")))
        zero = F.lit(0.0)
        rest = 0.0 if support is None else (c["n"] - F.size(c["cells"])) * jsd_term(_smoothed(zero, c["a"], c["n"]), _smoothed(zero, c["b"], c["n"]))
        return let(folded, lambda f: F.struct(
            (f["jsd"] + rest).alias("jsd"),
            F.when((c["a"] != 0) & (c["b"] != 0), 0.5 * f["gap"]).alias("wd"),
            c["n"].alias("support"),
            (F.size(actual) + F.size(predicted) - F.size(c["cells"])).alias("overlap")))

    cells = F.map_values(align(actual, predicted))
    context = F.struct(total(actual).alias("a"), total(predicted).alias("b"), (F.size(cells) if support is None else support).alias("n"),
                       cells.alias("cells"))
    return F.when((F.size(cells) if support is None else support) > 0, let(context, measured))


def jsd(actual: Column, predicted: Column) -> Column:
    return compare(actual, predicted)["jsd"]


def wasserstein(actual: Column, predicted: Column) -> Column:
    return compare(actual, predicted)["wd"]


def jsd_over_category(predicted: Column, actual: Column, themes: Column) -> Column:
    """JSD over the category's whole theme list, with the training loss's rules for empty sides."""
    listed = lambda m: F.map_filter(m, lambda t, _: F.array_contains(themes, t))
    return (F.when(non_empty(actual).isNull(), 0.0)
            .when(non_empty(predicted).isNull(), 1.0)
            .when(F.size(themes) > 0, compare(listed(actual), listed(predicted), F.size(F.array_distinct(themes)))["jsd"])
            .otherwise(jsd(actual, predicted)))


def softmax(logprobs: Column) -> Column:
    """Stable softmax over the values of a map of log probabilities."""
    def scaled(top: Column) -> Column:
        shifted = F.transform_values(logprobs, lambda _, v: F.exp(v - top))
        return normalise(shifted)
    return F.when(F.size(logprobs) > 0, let(F.array_max(F.map_values(logprobs)), scaled)).otherwise(empty_map())


def yes_share(yes: Column, no: Column) -> Column:
    """p_yes / (p_yes + p_no) from two log probabilities."""
    return let(F.struct(F.exp(yes).alias("y"), F.exp(no).alias("n")),
               lambda p: F.when(p["y"] + p["n"] > 0, p["y"] / (p["y"] + p["n"])).otherwise(0.0))


def exp_logprobs(logprobs: Column) -> Column:
    """map<theme, struct<logprob_yes, logprob_no>> to map<theme, struct<prob_yes, prob_no>>."""
    return F.transform_values(logprobs, lambda _, v: F.struct(
        F.exp(v["logprob_yes"]).alias("prob_yes"), F.exp(v["logprob_no"]).alias("prob_no")))


def primary_topic(probabilities: Column, themes: Column) -> Column:
    """Theme of highest probability (name breaks ties), else the first listed theme."""
    best = F.array_min(F.transform(F.map_entries(probabilities), lambda e: F.struct(
        (-e["value"]).alias("minus"), e["key"].alias("theme"))))["theme"]
    return F.coalesce(best, F.get(themes, 0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two equally long arrays; null when a vector is all zero."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0),
                           lambda acc, v: acc + v)
    return let(F.struct(dot(a, b).alias("ab"), dot(a, a).alias("aa"), dot(b, b).alias("bb")),
               lambda s: F.when((s["aa"] > 0) & (s["bb"] > 0), s["ab"] / F.sqrt(s["aa"] * s["bb"])))


def unit_vector(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return let(norm, lambda s: F.when(s > 0, F.transform(v, lambda x: x.cast("double") / s)))


def relaxed_transport(actual: Column, predicted: Column, position: Column, costs: Column) -> Column:
    """Relaxed optimal-transport bound with semantic cost (Kusner et al. 2015).

    Both sides are maps that sum to one; position is map<theme, index> and costs array<array<double>> over a category's
    themes, all of which must be listed. Every theme's mass moves to the nearest theme of the other side; the larger of
    the two directions is returned."""
    def one_way(source: Column, target: Column) -> Column:
        places = F.transform(F.map_keys(target), lambda t: F.element_at(position, t))
        return let(places, lambda at: F.aggregate(F.map_entries(source), F.lit(0.0), lambda acc, e: acc + e["value"] * let(
            F.get(costs, F.element_at(position, e["key"])),
            lambda row: F.array_min(F.transform(at, lambda j: F.get(row, j))))))
    return F.when((F.size(actual) > 0) & (F.size(predicted) > 0),
                  F.greatest(one_way(actual, predicted), one_way(predicted, actual)))
