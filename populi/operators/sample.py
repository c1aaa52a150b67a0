"""Quotas, stratified samples and splits. Every random choice is a hash order with a seed, the same in every run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from populi.functions.base import unit_hash
from populi.operators.groups import rank_within


def user_split(df: DataFrame, user: str, key: str, *, ratio: float = 0.2, min_reviews: int = 4,
               seed: int = 0) -> DataFrame:
    """Adds split = train | test. A user with min_reviews or more gives max(1, floor(n * ratio)) rows to test."""
    hashed = df.withColumn("__h", unit_hash(F.col(key), seed=seed))
    ranked = rank_within(hashed, [user], [F.col("__h"), F.col(key)], rank="__rank", size="__size")
    quota = F.when(F.col("__size") >= min_reviews, F.greatest(F.lit(1), F.floor(F.col("__size") * ratio))).otherwise(0)
    return (ranked.withColumn("split", F.when(F.col("__rank") <= quota, "test").otherwise("train"))
            .drop("__h", "__rank", "__size"))


def within_quota(df: DataFrame, quotas: DataFrame, user: str, position: str) -> DataFrame:
    """First quota rows of each listed user in scan order. quotas: (user, quota)."""
    listed = df.join(quotas, user)
    return (rank_within(listed, [user], [F.col(position)], rank="__rank")
            .filter(F.col("__rank") <= F.col("quota")).drop("__rank", "quota"))


def first_distinct(df: DataFrame, keys: Sequence[str], position: str, n: int) -> DataFrame:
    """First n distinct keys of the scan, whoever the user is."""
    first = df.groupBy(*keys).agg(F.min(position).alias("__pos"))
    return df.join(first.orderBy("__pos").limit(n).select(F.col("__pos").alias(position)), position, "left_semi")


def top_up(df: DataFrame, taken: DataFrame, quotas: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """As many further distinct keys, in scan order, from rows not taken yet as the quotas are short of."""
    wanted = quotas.agg(F.coalesce(F.sum("quota"), F.lit(0)).alias("n")).first()["n"]  # one number
    rest = df.join(taken.select(*keys).distinct(), list(keys), "left_anti")
    return first_distinct(rest, keys, position, max(0, wanted - taken.count()))


def category_targets(counts: DataFrame, category: str, total: int, keep_ratios: bool = True) -> DataFrame:
    """(category, target) from (category, n): floors of the shares, the remainder one by one to the largest targets."""
    rows = sorted((r[category], r["n"]) for r in counts.collect())  # one row per category
    population = sum(n for _, n in rows)
    targets = {c: (int(total * (n / population)) if keep_ratios else total // len(rows)) for c, n in rows}
    rest = max(0, total - sum(targets.values()))
    for c in sorted(targets, key=lambda name: (-targets[name], name))[:rest]:
        targets[c] += 1
    return counts.sparkSession.createDataFrame(sorted(targets.items()), f"{category} string, target long")


def uniform_sample(df: DataFrame, category: str, key: str, targets: DataFrame, seed: int = 0) -> DataFrame:
    """Exactly target rows per category (or all of a smaller category)."""
    hashed = df.withColumn("__h", unit_hash(F.col(key), seed=seed)).join(targets, category)
    return (rank_within(hashed, [category], [F.col("__h"), F.col(key)], rank="__rank")
            .filter(F.col("__rank") <= F.col("target")).drop("__h", "__rank", "target"))


def balanced_sample(df: DataFrame, category: str, user: str, key: str, targets: DataFrame,
                    seed: int = 0) -> DataFrame:
    """Whole users in random order until a category's target is met; the last user gives only what is missing."""
    users = (df.groupBy(category, user).agg(F.count(F.lit(1)).alias("__cnt"))
             .withColumn("__h", unit_hash(F.col(user), seed=seed)))
    queued = (rank_within(users, [category], [F.col("__h"), F.col(user)], rank="__rank",
                          weight=F.col("__cnt"), running="__upto")
              .join(targets, category)
              .withColumn("__take", F.least(F.col("__cnt"), F.col("target") - (F.col("__upto") - F.col("__cnt"))))
              .filter(F.col("__take") > 0).select(category, user, "__take"))
    picked = df.withColumn("__h", unit_hash(F.col(key), seed=seed)).join(queued, [category, user])
    return (rank_within(picked, [category, user], [F.col("__h"), F.col(key)], rank="__rank")
            .filter(F.col("__rank") <= F.col("__take")).drop("__h", "__rank", "__take"))


def busiest_users(df: DataFrame, user: str, n: int) -> DataFrame:
    """Rows of the n users with most rows (user id breaks ties)."""
    top = df.groupBy(user).agg(F.count(F.lit(1)).alias("__cnt")).orderBy(F.desc("__cnt"), F.asc(user)).limit(n)
    return df.join(top.select(user), user, "left_semi")


def sampling_rounds(df: DataFrame, category: str, text: str, *, per_round: int = 1000, max_rounds: int | None = None,
                    seed: int = 0) -> DataFrame:
    """Distinct texts of each category dealt into numbered rounds without replacement; every text has a round."""
    distinct = df.select(category, text).distinct().withColumn("__h", unit_hash(F.col(text), seed=seed))
    dealt = (rank_within(distinct, [category], [F.col("__h"), F.col(text)], rank="__rank")
             .withColumn("round", F.ceil(F.col("__rank") / F.lit(per_round)).cast("int")).drop("__h", "__rank"))
    return dealt if max_rounds is None else dealt.filter(F.col("round") <= max_rounds)


def systematic_sample(df: DataFrame, keys: Sequence[str], position: str, m: int) -> DataFrame:
    """Every floor(n/m)-th row of a group in order, m rows at most; groups of m rows or fewer stay whole."""
    ranked = rank_within(df, keys, [F.col(position)], rank="__rank", size="__size")
    step = F.greatest(F.lit(1), F.floor(F.col("__size") / F.lit(m)))
    chosen = ((F.col("__rank") - 1) % step == 0) & ((F.col("__rank") - 1) / step < m)
    return ranked.filter((F.col("__size") <= m) | chosen).drop("__rank", "__size")


def pack_to_budget(df: DataFrame, keys: Sequence[str], order: Sequence[Column], length: Column,
                   budget: int, separator: int = 0) -> DataFrame:
    """The rows of each group before the first one that would overflow the budget; adds `used`, the sum so far."""
    ranked = rank_within(df, keys, order, rank="__rank", weight=length + F.lit(separator), running="used")
    return ranked.filter(F.col("used") <= budget).drop("__rank")


def position_labels(df: DataFrame, user: str, timestamp: str, key: str) -> DataFrame:
    """review_index from 0 in time order and review_type = first | intermediate | last."""
    ranked = rank_within(df, [user], [F.col(timestamp), F.col(key)], rank="__rank",
                         size="__size")
    return (ranked.withColumn("review_index", F.col("__rank") - 1)
            .withColumn("review_type", F.when(F.col("__rank") == 1, "first")
                        .when(F.col("__rank") == F.col("__size"), "last").otherwise("intermediate"))
            .drop("__rank", "__size"))


def leave_one_out_totals(df: DataFrame, user: str, values: Sequence[str]) -> DataFrame:
    """For each row, the number of the user's other rows and their mean of each value; no pairs are formed."""
    sums = df.groupBy(user).agg(F.count(F.lit(1)).alias("__n"), *[F.sum(v).alias(f"__s_{v}") for v in values],
                                *[F.count(v).alias(f"__c_{v}") for v in values])
    joined = df.join(sums, user).withColumn("others", F.col("__n") - 1)
    for v in values:
        own = F.when(F.col(v).isNotNull(), 1).otherwise(0)
        left = F.col(f"__c_{v}") - own
        joined = joined.withColumn(f"others_mean_{v}", F.when(
            left > 0, (F.col(f"__s_{v}") - F.coalesce(v, F.lit(0.0))) / left))
    return joined.drop("__n", *[f"__{t}_{v}" for v in values for t in "sc"])


def leave_one_out_history(df: DataFrame, user: str, timestamp: str, key: str, text: str, *,
                          budget: int | None = None) -> DataFrame:
    """history: texts of the user's other reviews in time order, on request cut before the first that overflows `budget`.

    With a budget only a prefix of each user's texts can ever fit, so that prefix (budget plus one longest text) is
    gathered once per user and every review drops itself from it. Without one the rows come back with `rank`, their
    place in the user's history, and the history itself is the user's rows but that place: n texts and never n^2."""
    if budget is None:
        return rank_within(df, [user], [F.col(timestamp), F.col(key)], rank="rank", size="others").withColumn(
            "others", F.col("others") - 1)
    ranked = rank_within(df, [user], [F.col(timestamp), F.col(key)], rank="__rank",
                         weight=F.length(text), running="__upto")
    longest = df.groupBy(user).agg(F.max(F.length(text)).alias("__longest"))
    entries = (ranked.join(longest, user).filter((F.length(text) > 0) & (F.col("__upto") <= F.col("__longest") + budget))
               .groupBy(user).agg(F.array_sort(F.collect_list(F.struct(
                   F.col("__rank").alias("r"), F.col("__upto").alias("upto"), F.col(text).alias("t"))))
                   .alias("__prefix")))
    own, size = F.col("__rank"), F.length(text)
    fits = F.filter(F.col("__prefix"), lambda e: (e["r"] != own) & (
        F.when(e["r"] < own, e["upto"]).otherwise(e["upto"] - size) <= budget))
    return (ranked.join(entries, user, "left")
            .withColumn("history", F.coalesce(F.transform(fits, lambda e: e["t"]), F.array().cast("array<string>")))
            .drop("__rank", "__upto", "__prefix"))
