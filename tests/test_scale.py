"""Plans and results that matter when the data is large or lopsided."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from populi.functions import dist
from populi.operators import cluster, fuzzy, groups, journey, rollup, wide
from populi.plans.testbed import population, table

SF = "/root/testdata/sf0.001"


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(table(spark, SF, "orders").filter(F.col("o_orderstatus") != "P").groupBy("o_orderpriority").count())
    assert "PushedFilters: [IsNotNull(o_orderstatus)" in plan and "o_totalprice" not in plan


def test_rows_are_read_once_for_statistics(spark):
    rows = population(spark, SF).select("cluster_id", "tribe_id", F.col("price").alias("v"))
    plan = plan_of(rollup.level_stats(rows, ["cluster_id", "tribe_id"], ["v"]))
    assert plan.count("orders.parquet") == plan_of(rows).count("orders.parquet")


def test_statistics_keep_rows_without_a_group(spark):
    data = [("a", "x", 1.0), (None, "x", 2.0), (None, None, 9.0), ("a", None, 4.0)]
    df = spark.createDataFrame(data, "c string, t string, v double")
    got = {(r["c"], r["t"]): (r["n"], r["median"]) for r in rollup.level_stats(df, ["c", "t"], ["v"]).collect()}
    assert got["ALL", "ALL"] == (4, 3.0) and got["unknown", "ALL"] == (2, 5.5) and got["a", "unknown"] == (1, 4.0)
    flat = {r["c"]: r["n"] for r in rollup.metric_stats(df.select("c", F.col("v").alias("value")), ["c"]).collect()}
    assert flat == {"a": 2, None: 2}


def test_level_statistics_of_lopsided_groups(spark):
    rng = np.random.default_rng(3)
    data = [("hot" if i % 3 else f"c{i % 7}", f"t{i % 5}", float(v)) for i, v in enumerate(rng.exponential(size=4000).round(2))]
    df = spark.createDataFrame(data, "c string, t string, v double")
    got = {(r["c"], r["t"]): r for r in rollup.level_stats(df, ["c", "t"], ["v"]).collect()}
    for c, t in [("ALL", "ALL"), ("hot", "ALL"), ("hot", "t1"), ("c0", "ALL")]:
        want = np.array([v for cc, tt, v in data if c in ("ALL", cc) and t in ("ALL", tt)])
        assert got[c, t]["n"] == len(want) and got[c, t]["std"] == pytest.approx(want.std())
        assert [got[c, t][q] for q in ("q25", "median", "q75")] == pytest.approx(list(np.percentile(want, [25, 50, 75])))


def test_partition_count_does_not_change_results(spark):
    rng = random.Random(4)
    data = [(i % 40, f"t{rng.randint(0, 9)}", rng.random(), rng.random()) for i in range(2000)]
    df = spark.createDataFrame(data, "k int, t string, x double, y double")
    runs = []
    for partitions in (2, 200):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        out = wide.compare_long(df, "k", "t", "x", "y").select("k", F.round("jsd", 9), F.round("wd", 9), "support")
        runs.append(sorted(map(tuple, out.collect())))
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert runs[0] == runs[1]


def test_journeys_hold_every_event(spark):
    from populi.plans.journey_suite import journey_rows, nested
    from populi.plans.testbed import table
    n = table(spark, SF, "events").count()
    assert journey_rows(spark, SF).count() == n
    assert nested(spark, SF).selectExpr("sum(size(steps)) AS n").first()["n"] == n


def test_journeys_with_repeated_iterations_stay_bounded(spark):
    long = spark.range(5000).select(F.lit("r").alias("k"), (F.col("id") % 13).cast("int").alias("iteration"), (F.col("id") / 5000).alias("theme"))
    row = journey.nest_steps(long, ["k"], ["theme"]).first()
    assert [s["iteration"] for s in row["steps"]] == list(range(13))


def test_keep_last_takes_one_row_per_key(spark):
    df = spark.range(1000).select(F.lit("same").alias("k"), F.col("id").alias("pos"))
    assert [tuple(r) for r in groups.keep_last(df, ["k"], "pos").collect()] == [("same", 999)]


def test_theme_tables_leave_reviews_where_they_are(spark):
    """One shuffle by key serves the sums, the join to themes and the grouping; no common theme lands in one task."""
    probs = spark.range(4000).select((F.col("id") % 900).alias("k"), F.concat(F.lit("t"), F.col("id") % 3).alias("theme"), F.lit(1.0).alias("p"))
    dealt = probs.repartition("k").groupBy("k", "theme").agg(F.sum("p").alias("p"))
    vectors = spark.range(9).select(F.concat(F.lit("t"), F.col("id") % 3).alias("theme"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("vector"))
    mapping = spark.range(9).select(F.lit("c").alias("category"), F.lit("t1").alias("from_theme"), F.lit("t2").alias("to_theme"))
    weighted = cluster.weighted_topic_vectors(dealt, vectors, "k")
    for df in (weighted, cluster.attach_theme_vectors(dealt, vectors, "k")):
        plan = plan_of(df)
        assert plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_COL") == 1 and "SortMergeJoin" not in plan
    assert {tuple(r["topic_vector"]) for r in weighted.filter("n_themes = 3").collect()} <= {(1.0, 1.0)}
    assert "SortMergeJoin" not in plan_of(fuzzy.rename_themes(dealt.withColumn("category", F.lit("c")), mapping, ["k"]))


def test_maps_take_one_shuffle(spark):
    long = spark.range(100).select((F.col("id") % 9).alias("k"), F.concat(F.lit("t"), F.col("id") % 3).alias("t"), F.lit(1.0).alias("v"))
    maps = wide.theme_map(long, "k", "t", m="v")
    assert plan_of(maps).count("Exchange") == 1 and sum(sum(r["m"].values()) for r in maps.collect()) == 100.0


@pytest.mark.parametrize("predicted", [{"b": 3.0, "x": 1.0}, {"x": 1.0}, {"b": 0.0}])
def test_divergence_over_a_list_needs_no_zeros(spark, predicted):
    themes = F.array(*[F.lit(t) for t in "abcdeef"])
    df = spark.createDataFrame([({"a": 1.0, "b": 2.0, "y": 5.0}, predicted)], "a map<string,double>, p map<string,double>")
    filled = dist.jsd(dist.zero_fill(F.col("a"), themes), dist.zero_fill(F.col("p"), themes))
    row = df.select(dist.jsd_over_category(F.col("p"), F.col("a"), themes).alias("got"), filled.alias("want"),
                    dist.compare(F.expr("map_filter(a, (t, v) -> t <> 'y')"), F.expr("map_filter(p, (t, v) -> t <> 'x')"), F.lit(6)).alias("c")).first()
    assert row["got"] == pytest.approx(row["want"], abs=1e-12) and row["c"]["jsd"] == row["got"] and row["c"]["support"] == 6


def test_best_metrics_compare_two_pairs_of_maps(spark):
    """The initial prediction and the winner, each once."""
    df = spark.createDataFrame([({"a": 1.0}, {"a": .5, "b": .5})], "a map<string,double>, p map<string,double>")
    steps = F.array(F.struct(F.lit(1).alias("iteration"), F.lit(.1).alias("theme"), F.col("a").alias("predicted")))
    best = journey.best_metrics(F.col("a"), F.col("p"), steps, F.map_keys("a"))
    count = lambda c: df.select(c.alias("c"))._jdf.queryExecution().analyzed().toString().count("map_zip_with")
    assert count(best) <= 2 * count(dist.compare(F.col("a"), F.col("p"))) and df.select(best["iteration"]).first()[0] == 1
