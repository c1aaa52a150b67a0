"""The engine's tables seen through the driver's star schema.

review = order, user = customer, cluster = region, tribe = market segment, category = order priority, theme = part
brand. Actual theme mass is quantity; predicted mass is the price of lines not returned; corrected mass the price of all
lines. SQL holds the same views for the oracle.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from populi.functions.dist import compare
from populi.operators.wide import theme_map

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = (fn, sql)
        return fn
    return add


@lru_cache(maxsize=256)
def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """The table's lazy frame; remembered so that its footer is read once per session."""
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles at a fixed number of digits; rounding at 12 first settles values that sit on a rounding edge."""
    return df.select(*[F.round(F.round(c, 12), digits).alias(c) if t in ("double", "float") else F.col(c)
                       for c, t in df.dtypes])


def population(spark: SparkSession, sf: str) -> DataFrame:
    """user_id, review_key, category, cluster_id, tribe_id, rating, sentiment, ts, price: one row per review."""
    customer = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    place = (table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
             .select("n_nationkey", "r_name"))
    return (table(spark, sf, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
            .join(place, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(F.col("o_custkey").cast("string").alias("user_id"), F.col("o_orderkey").alias("review_key"),
                    F.col("o_orderpriority").alias("category"), F.col("r_name").alias("cluster_id"),
                    F.col("c_mktsegment").alias("tribe_id"),
                    (F.lit(1) + F.col("o_orderkey") % 5).cast("double").alias("rating"), sentiment_of_status(),
                    F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("price")))


def sentiment_of_status():
    return (F.when(F.col("o_orderstatus") == "F", "Positive").when(F.col("o_orderstatus") == "P", "Negative")
            .otherwise("Neutral").alias("sentiment"))


def sides(spark: SparkSession, sf: str, theme: str = "p_brand") -> DataFrame:
    """k, t, a, b, c rows as they come; theme masses are their sums."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag")
    part = table(spark, sf, "part").select("p_partkey", theme)
    return (lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
            .select(F.col("l_orderkey").alias("k"), F.col(theme).alias("t"), F.col("l_quantity").alias("a"),
                    F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice")).alias("b"),
                    F.col("l_extendedprice").alias("c"), F.col("l_returnflag").alias("flag")))


def distributions(spark: SparkSession, sf: str) -> DataFrame:
    """k with the maps actual, predicted, corrected and before (quantity over 50, the largest a line can have)."""
    maps = theme_map(sides(spark, sf), "k", "t", actual="a", predicted="b", corrected="c")
    return maps.withColumn("before", F.transform_values("actual", lambda _, v: v / 50.0))


def compared(spark: SparkSession, sf: str) -> DataFrame:
    """Population columns with jsd and wd before (pre) and after (post) correction; reviews with both sides only."""
    d = distributions(spark, sf).filter(F.size("predicted") > 0)
    scored = d.select("k", compare(F.col("actual"), F.col("predicted")).alias("x"),
                      compare(F.col("actual"), F.col("corrected")).alias("y"))
    return (population(spark, sf).join(scored, F.col("review_key") == F.col("k"))
            .select("user_id", "review_key", "category", "cluster_id", "tribe_id", "rating", "sentiment",
                    F.col("x.jsd").alias("jsd"), F.col("x.wd").alias("wd"), F.col("y.jsd").alias("jsd_post"),
                    F.col("y.wd").alias("wd_post")))


class SQL:
    """The same views as SQL common table expressions."""

    POP = """pop AS (SELECT CAST(o_custkey AS VARCHAR) user_id, o_orderkey review_key, o_orderpriority category,
      r_name cluster_id, c_mktsegment tribe_id, CAST(1 + o_orderkey % 5 AS DOUBLE) rating,
      CASE o_orderstatus WHEN 'F' THEN 'Positive' WHEN 'P' THEN 'Negative' ELSE 'Neutral' END sentiment,
      o_orderdate ts, o_totalprice price
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
      JOIN region ON n_regionkey = r_regionkey)"""

    SIDES = """sides AS (SELECT l_orderkey k, p_brand t, sum(l_quantity) a,
      sum(CASE WHEN l_returnflag <> 'R' THEN l_extendedprice END) b, sum(l_extendedprice) c
      FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""

    @staticmethod
    def divergence(name: str, source: str, keys: str, a: str = "a", b: str = "b", n: str = "count(*)") -> str:
        """CTE `name` with jsd, wd, support, overlap per key over `source` rows (keys, t, a, b)."""
        return f"""{name}_tot AS (SELECT {keys}, sum({a}) sa, coalesce(sum({b}), 0) sb, {n} n,
          count(*) FILTER (WHERE {a} > 0 AND {b} > 0) nb FROM {source} GROUP BY {keys}),
        {name}_cell AS (SELECT {keys}, n, nb, ({a} / sa + 1e-10) / (1 + n * 1e-10) p,
          CASE WHEN sb > 0 THEN (coalesce({b}, 0) / sb + 1e-10) / (1 + n * 1e-10) ELSE 1.0 / n END q,
          CASE WHEN sb > 0 THEN abs({a} / sa - coalesce({b}, 0) / sb) END g
          FROM {source} JOIN {name}_tot USING ({keys})),
        {name} AS (SELECT {keys}, sum(0.5 * (p * log2(2 * p / (p + q)) + q * log2(2 * q / (p + q)))) jsd,
          0.5 * sum(g) wd, CAST(max(n) AS INTEGER) support, CAST(max(nb) AS INTEGER) overlap
          FROM {name}_cell GROUP BY {keys})"""

    @classmethod
    def compared(cls) -> str:
        return f"""{cls.POP}, {cls.SIDES}, {cls.divergence('pre', 'sides', 'k')},
        {cls.divergence('post', 'sides', 'k', b='c')},
        compared AS (SELECT user_id, review_key, category, cluster_id, tribe_id, rating, sentiment, pre.jsd, pre.wd,
          post.jsd jsd_post, post.wd wd_post FROM pop JOIN pre ON review_key = pre.k JOIN post ON review_key = post.k
          WHERE pre.wd IS NOT NULL)"""

    RANKED = """ranked AS (SELECT k, t, b, row_number() OVER (PARTITION BY k ORDER BY b DESC, t) r FROM sides
        WHERE b IS NOT NULL),
      truth AS (SELECT k, t FROM sides WHERE a / 50 >= 0.65),
      truth_n AS (SELECT k, count(*) kt FROM truth GROUP BY k),
      has_b AS (SELECT k, count(*) h FROM ranked GROUP BY k)"""


STATS_SQL = """count(value) n, round(avg(value), 6) mean, round(stddev_pop(value), 6) std, round(min(value), 6) + 0.0 "min",
  round(max(value), 6) + 0.0 "max", round(quantile_cont(value, 0.25), 6) + 0.0 q25,
  round(quantile_cont(value, 0.5), 6) + 0.0 median, round(quantile_cont(value, 0.75), 6) + 0.0 q75"""
