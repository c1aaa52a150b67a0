"""Row choice, ranks, running sums and quantiles per group that stay exact when one group holds most of the rows.

A null key is a group like any other.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from populi.session import written

def keep_top(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int | Column = 1) -> DataFrame:
    """First n rows of each key in the given total order.

    For a literal n below 1000 Spark limits every map task's groups before the shuffle (WindowGroupLimit)."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(window)).filter(F.col("__rank") <= n).drop("__rank")


def keep_first(df: DataFrame, keys: Sequence[str], *position: str) -> DataFrame:
    return keep_top(df, keys, [F.col(p).asc() for p in position])


def keep_last(df: DataFrame, keys: Sequence[str], *position: str) -> DataFrame:
    return keep_top(df, keys, [F.col(p).desc() for p in position])


def _null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys where null equals null; the right side's keys are dropped."""
    renamed = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__right_{k}")) for k in keys])
    return left.join(renamed, same, how).drop(*[f"__right_{k}" for k in keys])


def dealt_in_order(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """df written in parts of about equal size that follow each other by key and order; adds `__part` and `__tie`.

    Rows are dealt by sampled bounds of (keys, order, hash of the row), so neither a hot key nor a hot order value stays
    in one part; only rows equal in every column do. Maps take no part in the hash. The parts are written in the shared
    folder, because their bounds must be the same for whoever reads them."""
    hashed = [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn("__tie", F.xxhash64(*hashed)).repartitionByRange(parts, *keys, *order, "__tie")
    return written(dealt.withColumn("__part", F.spark_partition_id()))


def rank_within(df: DataFrame, keys: Sequence[str], order: Sequence[Column], *, rank: str = "rank",
                size: str | None = None, weight: Column | None = None, running: str | None = None) -> DataFrame:
    """Exact 1-based rank per key, and on request the group's size and the running sum of a weight.

    Groups of any size, a null key's too, are ranked part by part (see dealt_in_order) and shifted by prefix sums of
    the parts' totals, so no task holds a whole group. Ties of the order go by a hash of the row, the same in every run."""
    key = F.struct(*keys)  # never null, and its fields compare null-safe
    marked = dealt_in_order(df, keys, order).withColumns({"__key": key, "__w": F.lit(0).cast("long") if weight is None else weight})
    totals = marked.groupBy("__key", "__part").agg(F.count(F.lit(1)).alias("__c"), F.sum("__w").alias("__cw"))
    whole = Window.partitionBy("__key")  # one row for each part that has rows of the key
    ahead = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select("__key", "__part", F.coalesce(F.sum("__c").over(ahead), F.lit(0)).alias("__before"),
                           F.coalesce(F.sum("__cw").over(ahead), F.lit(0)).alias("__before_w"), F.sum("__c").over(whole).alias("__n"))
    ordered = Window.partitionBy("__key", "__part").orderBy(*order, "__tie")
    ranked = marked.withColumn("__r", F.row_number().over(ordered))
    if running:
        ranked = ranked.withColumn("__rw", F.sum("__w").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    placed = (ranked.join(shifts, ["__key", "__part"])
              .withColumn(rank, (F.col("__r") + F.col("__before")).cast("long")))
    if size:
        placed = placed.withColumn(size, F.col("__n"))
    if running:
        placed = placed.withColumn(running, F.col("__rw") + F.col("__before_w"))
    return placed.drop("__key", "__w", "__n", "__part", "__tie", "__r", "__rw", "__before", "__before_w")


DIGITS = (40, 20, 0)  # lowest bit of each radix digit of a 64-bit key


def ordered_key(value: Column) -> Column:
    """A 64-bit whole number in the order of the double (no NaN): sign, exponent and mantissa as numbers; both zeros are 0."""
    size = F.abs(value)
    guess = F.floor(F.log2(size)).cast("int")
    power = lambda e: F.pow(F.lit(2.0), e)  # noqa: E731  exact for whole exponents
    exponent = F.greatest(F.lit(-1022), F.when(power(guess) > size, guess - 1).when(power(guess) * 2.0 <= size, guess + 1).otherwise(guess))
    exponent = F.when(guess >= 1024, F.lit(1023)).otherwise(exponent)  # the logarithm of the largest doubles rounds up
    part = size * power(-exponent)  # from 1 up to 2, or below 1 under the smallest normal exponent
    key = (exponent.cast("long") + 1022) * F.lit(1 << 52) + (part * F.lit(float(1 << 52))).cast("long")
    whole = F.when(size == 0.0, F.lit(0).cast("long")).when(size == F.lit(float("inf")), F.lit(2047 << 52)).otherwise(key)
    return F.when(value < 0.0, -whole).otherwise(whole)


def at_levels(df: DataFrame, path: Sequence[str], label: str = "ALL") -> DataFrame:
    """Each row once per level of the path: everything, first key, first two keys, ... with ALL for what is rolled up.

    A missing key is named unknown, so that its rows stay in every total. Used ahead of an aggregation, whose map-side combine takes the copies in."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    levels = [F.struct(*[(named(c) if i < depth else F.lit(label)).alias(c) for i, c in enumerate(path)]) for depth in range(len(path) + 1)]
    rest = [c for c in df.columns if c not in path]
    return df.select(*rest, F.explode(F.array(*levels)).alias("__level")).select(
        *[F.col(f"__level.{c}").alias(c) for c in path], *rest)


def describe(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float],
             path: Sequence[str] = ()) -> DataFrame:
    """n, mean, std (population), min, max of each group and exact interpolated quantiles, one per entry of probs.

    With a path, groups are formed at every level of it (see at_levels) within the keys. Distinct values are counted
    first, in one shuffle that all later steps share. The wanted ranks are then found for all groups at once by radix
    selection on order-preserving keys: a histogram over the first digit, which also carries the moments, one over the
    second digit of the values that remain, one over the third. A histogram has 2^24 or 2^20 bins at most whatever the
    values are, so nothing larger is ever ordered in one task; levels multiply histograms and not rows."""
    keys = [*path, *keys]
    digit = lambda i: (F.shiftright("__key", DIGITS[i]) if not i else F.shiftright("__key", DIGITS[i]).bitwiseAND((1 << 20) - 1))
    # the joins below are null-safe: a missing key stays a group of its own, and no filter on keys is inferred that
    # would keep the uses of `counted` from sharing one shuffle
    counted = (df.filter(F.col(value).isNotNull() & ~F.isnan(value))
               .groupBy(*keys, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__c")))
    counted = counted.withColumn("__key", ordered_key(F.col("__v"))).withColumns({f"__d{i}": digit(i) for i in range(3)})
    if path:
        counted = at_levels(counted, path)
    whole, v, c = Window.partitionBy(*keys), F.col("__v"), F.col("__c")
    upto = lambda *more: F.sum("__hc").over(Window.partitionBy(*keys, *more[:-1]).orderBy(more[-1]).rowsBetween(Window.unboundedPreceding, 0))
    # sums are taken from a value of the bin itself, which keeps them small
    edge = F.signum(F.col("__d0")) * F.pow(F.lit(2.0), F.floor(F.abs("__d0") / 4096) - 1023) * (1.0 + F.abs("__d0") % 4096 / 4096.0)
    hist = counted.groupBy(*keys, "__d0").agg(
        F.sum(c).alias("__hc"), F.sum((v - edge) * c).alias("__s"), F.sum((v - edge) * (v - edge) * c).alias("__q"),
        F.min(v).alias("__lo"), F.max(v).alias("__hi"))
    hist = (hist.withColumn("__center", edge + F.col("__s") / F.col("__hc"))
            .withColumns({"__upto": upto("__d0"), "n": F.sum("__hc").over(whole),
                          "mean": F.sum(F.col("__center") * F.col("__hc")).over(whole) / F.sum("__hc").over(whole)}))
    # spread inside a bin plus spread of the bins' means around the mean
    center = F.col("__center")
    inside = F.greatest(F.lit(0.0), F.col("__q") - F.col("__s") * F.col("__s") / F.col("__hc"))
    around = inside + F.col("__hc") * (center - F.col("mean")) * (center - F.col("mean"))
    hist = hist.withColumns({"std": F.sqrt(F.sum(around).over(whole) / F.col("n")), "min": F.min("__lo").over(whole),
                             "max": F.max("__hi").over(whole), "__before": F.col("__upto") - F.col("__hc")})
    basics = ["n", "mean", "std", "min", "max"]
    spots = {name: (F.col("n") - 1) * F.lit(p) for name, p in probs.items()}
    ranks = {f"__{tag}_{name}": rank(spot) for name, spot in spots.items() for tag, rank in (("lo", F.floor), ("hi", F.ceil))}
    holds = lambda r: (r >= F.col("__before")) & (r < F.col("__upto"))
    wanted = reduce(lambda a, b: a | b, [holds(r) for r in ranks.values()], F.lit(False))
    seen = ["__d0"]
    for i in (1, 2):
        left = hist.filter(wanted).select(*keys, *seen, F.col("__before").alias("__ahead"), *basics)
        hist = (_null_safe_join(counted, left, keys + seen).groupBy(*keys, *seen, f"__d{i}")
                .agg(F.sum(c).alias("__hc"), F.max(v).alias("__v"), *[F.max(x).alias(x) for x in ("__ahead", *basics)]))
        seen.append(f"__d{i}")
        # partitioned by the keys alone, which serves the last aggregation too
        hist = (hist.repartition(*keys).withColumn("__upto", F.col("__ahead") + upto(*seen))
                .withColumn("__before", F.col("__upto") - F.col("__hc")))
    picks = [F.max(F.when(holds(r), F.col("__v"))).alias(name) for name, r in ranks.items()]
    outputs = [(F.col(f"__lo_{name}") + (F.col(f"__hi_{name}") - F.col(f"__lo_{name}")) * (spot - F.floor(spot))).alias(name)
               for name, spot in spots.items()]
    return hist.groupBy(*keys).agg(*[F.max(b).alias(b) for b in basics], *picks).select(*keys, *basics, *outputs)
