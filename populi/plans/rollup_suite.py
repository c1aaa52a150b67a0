"""Summary tables on the driver tables: levels, thresholds, comparisons, costs and population counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from populi.operators import match, rollup, sample
from populi.plans.metrics_suite import _BLOCK, review_metric_rows
from populi.plans.testbed import SQL, STATS_SQL, compared, population, query, rounded, sides, table

_PATH = ["cluster_id", "tribe_id"]
_LEVEL = "coalesce(cluster_id, 'ALL') cluster_id, coalesce(tribe_id, 'ALL') tribe_id"
_SETS = "GROUPING SETS ((), (cluster_id), (cluster_id, tribe_id))"
_SETS_M = "GROUPING SETS ((metric), (cluster_id, metric), (cluster_id, tribe_id, metric))"


@query("level_statistics", f"""WITH {SQL.compared()}, long AS (SELECT cluster_id, tribe_id, 'jsd' metric, jsd AS "value" FROM compared
  UNION ALL SELECT cluster_id, tribe_id, 'wd', wd FROM compared)
  SELECT {_LEVEL}, metric, {STATS_SQL} FROM long GROUP BY {_SETS_M}""")
def level_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rollup.level_stats(compared(spark, sf), _PATH, ["jsd", "wd"]))


@query("jsd_threshold_statistics", f"""WITH {SQL.compared()} SELECT {_LEVEL}, count(*) n, count(*) FILTER (WHERE jsd <= 0.35) n_below,
  round(avg(jsd), 6) mean_all, round(avg(jsd) FILTER (WHERE jsd <= 0.35), 6) mean_below,
  round(count(*) FILTER (WHERE jsd <= 0.35) * 100.0 / count(*), 6) pct_below FROM compared GROUP BY {_SETS}""")
def jsd_threshold_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rollup.threshold_stats(compared(spark, sf), _PATH, "jsd", 0.35))


@query("group_means_with_minimum", f"""WITH {SQL.compared()} SELECT cluster_id, tribe_id, count(*) n, round(avg(jsd), 6) mean_jsd,
  round(avg(wd), 6) mean_wd, max(category) category FROM compared GROUP BY 1, 2 HAVING count(*) >= 5""")
def group_means_with_minimum(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rollup.group_means(compared(spark, sf), _PATH, ["jsd", "wd"], 5, name="category"))


@query("cluster_means_two_ways", f"""WITH {SQL.compared()}, t AS (SELECT cluster_id, tribe_id, avg(jsd) m, count(*) c, sum(jsd) s
    FROM compared GROUP BY 1, 2)
  SELECT cluster_id, round(sum(s) / sum(c), 6) mean_over_rows, round(avg(m), 6) mean_of_means, count(*) n_inner,
    CAST(sum(c) AS BIGINT) n_rows FROM t GROUP BY 1""")
def cluster_means_two_ways(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rollup.two_means(compared(spark, sf), "cluster_id", "tribe_id", "jsd"))


@query("jsd_histogram", f"""WITH {SQL.compared()}, s AS (SELECT min(jsd) lo, max(jsd) hi, count(*) n FROM compared),
  b AS (SELECT CAST(least(28, floor((jsd - lo) / ((hi - lo) / 29))) AS INTEGER) bin, lo, hi, n FROM compared, s)
  SELECT bin, round(max(lo) + (bin + 0.5) * (max(hi) - max(lo)) / 29, 6) center, count(*) n, round(count(*) * 100.0 / max(n), 6) pct
  FROM b GROUP BY bin""")
def jsd_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rollup.histogram(compared(spark, sf), "jsd"))


@query("divergence_averages", f"""WITH {SQL.compared()} SELECT count(*) n, count(jsd) n_jsd, round(avg(jsd), 6) mean_jsd, count(wd) n_wd,
  round(avg(wd), 6) mean_wd FROM compared""")
def divergence_averages(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(compared(spark, sf).agg(
        F.count(F.lit(1)).alias("n"), F.count("jsd").alias("n_jsd"), F.avg("jsd").alias("mean_jsd"),
        F.count("wd").alias("n_wd"), F.avg("wd").alias("mean_wd")))


_TAGS = """tag AS (SELECT d.doc_id, lang category, quality IS NULL OR quality = 0 no_theme FROM documents d LEFT JOIN labels USING (doc_id))"""


def _tagged(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with the theme their label gives; a document without a good label has none."""
    rows = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id", "left")
    themes = F.when(F.col("quality") == 1, F.array(F.lit("good"))).otherwise(F.array().cast("array<string>"))
    return rows.select("doc_id", F.col("lang").alias("category"), themes.alias("themes"))


@query("empty_theme_rates", f"""WITH {_TAGS} SELECT coalesce(category, 'ALL') category, count(*) total, count(*) FILTER (WHERE no_theme) empty,
  round(count(*) FILTER (WHERE no_theme) * 100.0 / count(*), 6) empty_pct, count(*) FILTER (WHERE NOT no_theme) with_themes
  FROM tag GROUP BY GROUPING SETS ((), (category))""")
def empty_theme_rates(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rollup.empty_theme_rates(_tagged(spark, sf), "category", F.size("themes") == 0))


@query("worst_empty_categories", f"""WITH {_TAGS} SELECT category, round(avg(CAST(no_theme AS INTEGER)) * 100, 6) empty_pct FROM tag
  GROUP BY category ORDER BY 2 DESC, 1 LIMIT 3""")
def worst_empty_categories(spark: SparkSession, sf: str) -> DataFrame:
    rates = rollup.empty_theme_rates(_tagged(spark, sf), "category", F.size("themes") == 0)
    return rounded(rates.filter(F.col("category") != "ALL").orderBy(F.desc("empty_pct"), "category").limit(3)
                   .select("category", "empty_pct"))


@query("usage_costs", r"""WITH calls AS (SELECT CASE role WHEN 'user' THEN 'o3' WHEN 'assistant' THEN 'gpt-4o' ELSE 'other' END model,
    role call_type, len(string_split(text, ' ')) i, turn c, length(text) o FROM conversations),
  cost AS (SELECT *, CASE model WHEN 'o3' THEN (i * 2.0 + c * 0.5 + o * 8.0) / 1e6 WHEN 'gpt-4o' THEN (i * 2.5 + c * 1.25 + o * 10.0) / 1e6
    ELSE 0 END cost FROM calls)
  SELECT coalesce(model, 'ALL') model, coalesce(call_type, 'ALL') call_type, count(*) calls, CAST(sum(i) AS BIGINT) input_tokens,
    CAST(sum(o) AS BIGINT) output_tokens, CAST(sum(c) AS BIGINT) cached_input_tokens, CAST(round(sum(cost), 6) AS DOUBLE) cost
  FROM cost GROUP BY GROUPING SETS ((), (model), (model, call_type))""")
def usage_costs(spark: SparkSession, sf: str) -> DataFrame:
    calls = table(spark, sf, "conversations").select(
        F.when(F.col("role") == "user", "O3").when(F.col("role") == "assistant", "GPT-4o-2024").otherwise("other")
        .alias("model"), F.col("role").alias("call_type"), F.size(F.split("text", " ")).cast("long").alias("input_tokens"),
        F.length("text").cast("long").alias("output_tokens"), F.col("turn").alias("cached_input_tokens"))
    return rounded(rollup.usage_costs(calls))


@query("topic_universe_sizes", f"""WITH {SQL.POP}, {SQL.SIDES} SELECT category, count(DISTINCT t) n_topics, string_agg(DISTINCT t, ',' ORDER BY t) topics
  FROM sides JOIN pop ON review_key = k GROUP BY category""")
def topic_universe_sizes(spark: SparkSession, sf: str) -> DataFrame:
    rows = sides(spark, sf).select("k", "t").join(population(spark, sf), F.col("review_key") == F.col("k"))
    return rollup.topic_universe(rows, "category", "t").select("category", "n_topics",
                                                                F.array_join("topics", ",").alias("topics"))


_IMPROVED = f"""{SQL.compared()}, imp AS (SELECT *, CASE WHEN jsd > 0 THEN (jsd - jsd_post) / jsd * 100 ELSE 0 END ij,
    CASE WHEN wd > 0 THEN (wd - wd_post) / wd * 100 ELSE 0 END iw FROM compared)"""


def _improved(spark: SparkSession, sf: str) -> DataFrame:
    """Improvements per review; divergences at the level of rounding noise count as equal."""
    exact = lambda name: F.round(name, 9)
    rows = compared(spark, sf).withColumns({n: exact(n) for n in ("jsd", "wd", "jsd_post", "wd_post")})
    return rows.withColumns({"improvement_jsd": rollup.lower_is_better_pct(F.col("jsd"), F.col("jsd_post")),
                             "improvement_wd": rollup.lower_is_better_pct(F.col("wd"), F.col("wd_post"))})


_IMPROVED_R = _IMPROVED.replace("FROM compared)", """FROM (SELECT user_id, review_key, category, cluster_id, tribe_id, rating, sentiment,
    round(jsd, 9) jsd, round(wd, 9) wd, round(jsd_post, 9) jsd_post, round(wd_post, 9) wd_post FROM compared))""")


@query("improvement_by_tribe_ranked", f"""WITH {_IMPROVED_R}, t AS (SELECT cluster_id, tribe_id, avg(ij) j, avg(iw) w FROM imp GROUP BY 1, 2)
  SELECT cluster_id, tribe_id, round(j, 3) mean_improvement_jsd, round(w, 3) mean_improvement_wd,
    round((j * 0.3 + w * 0.3) / 0.6, 3) composite, row_number() OVER (ORDER BY round((j * 0.3 + w * 0.3) / 0.6, 3) DESC, cluster_id, tribe_id) "rank" FROM t""")
def improvement_by_tribe_ranked(spark: SparkSession, sf: str) -> DataFrame:
    means = rollup.group_means(_improved(spark, sf), _PATH, ["improvement_jsd", "improvement_wd"], 1).drop("n")
    none = F.lit(None).cast("double")
    score = rollup.composite_score(F.col("mean_improvement_jsd"), F.col("mean_improvement_wd"), none, none)
    scored = rounded(means.withColumn("composite", score), 3)
    return rollup.ranked_groups(scored, "composite", _PATH)


@query("top_and_bottom_tribes", f"""WITH {SQL.compared()}, t AS (SELECT cluster_id, tribe_id, avg(jsd) x, avg(jsd_post) y FROM compared GROUP BY 1, 2),
  p AS (SELECT cluster_id, tribe_id, round((x - y) / x * 100, 6) improvement_pct FROM t)
  (SELECT 'top' AS "end", * FROM p ORDER BY improvement_pct DESC, cluster_id, tribe_id LIMIT 3) UNION ALL
  (SELECT 'bottom', * FROM p ORDER BY improvement_pct, cluster_id, tribe_id LIMIT 3)""")
def top_and_bottom_tribes(spark: SparkSession, sf: str) -> DataFrame:
    """Improvement of the means, best and worst tribes."""
    means = compared(spark, sf).groupBy(*_PATH).agg(F.avg("jsd").alias("x"), F.avg("jsd_post").alias("y"))
    rows = rounded(means.select(*_PATH, rollup.lower_is_better_pct(F.col("x"), F.col("y")).alias("improvement_pct")))
    top = rows.orderBy(F.desc("improvement_pct"), *_PATH).limit(3).select(F.lit("top").alias("end"), "*")
    return top.unionByName(rows.orderBy("improvement_pct", *_PATH).limit(3).select(F.lit("bottom").alias("end"), "*"))


@query("recall_improvement_rule", f"""WITH {_BLOCK} SELECT review_key, round(CASE WHEN x > 0 THEN (y - x) / x * 100 WHEN y > 0 THEN 1000.0 ELSE 0.0 END, 6)
  improvement FROM (SELECT review_key, recall_at_1 x, recall_at_max3k y FROM metric)""")
def recall_improvement_rule(spark: SparkSession, sf: str) -> DataFrame:
    rows = review_metric_rows(spark, sf).filter(F.col("num_actual_themes").isNotNull())
    return rounded(rows.select("review_key", rollup.higher_is_better_pct(
        F.col("recall_at_1"), F.col("recall_at_max3k")).alias("improvement")))


@query("method_comparison", f"""WITH {SQL.compared()} SELECT {_LEVEL},
  round(avg(jsd), 6) predicted, round(avg(jsd_post), 6) corrected FROM compared GROUP BY GROUPING SETS ((cluster_id), (cluster_id, tribe_id))""")
def method_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """Two methods side by side per cluster and per tribe."""
    long = compared(spark, sf).withColumnsRenamed({"jsd": "predicted", "jsd_post": "corrected"}).unpivot(
        _PATH, ["predicted", "corrected"], "method", "value")
    leveled = rollup.at_levels(long, _PATH).filter(F.col("cluster_id") != "ALL")
    return rounded(rollup.method_pivot(leveled, _PATH, "method", ["predicted", "corrected"], "value"))


@query("pre_post_comparison", f"""WITH {SQL.compared()}, a AS (SELECT cluster_id, tribe_id, avg(jsd) m, count(*) n FROM compared
    WHERE sentiment <> 'Neutral' GROUP BY 1, 2),
  b AS (SELECT cluster_id, tribe_id, avg(jsd_post) m, count(*) n FROM compared WHERE tribe_id <> 'MACHINERY' GROUP BY 1, 2)
  SELECT cluster_id, tribe_id, round(a.m, 6) pre_mean, a.n pre_n, round(b.m, 6) post_mean, b.n post_n,
    round((a.m - b.m) / a.m * 100, 6) improvement_pct, a.n IS NOT NULL AND b.n IS NOT NULL in_both
  FROM a FULL JOIN b USING (cluster_id, tribe_id)""")
def pre_post_comparison(spark: SparkSession, sf: str) -> DataFrame:
    rows = compared(spark, sf)
    before = rows.filter(F.col("sentiment") != "Neutral").select(*_PATH, F.col("jsd").alias("m"))
    after = rows.filter(F.col("tribe_id") != "MACHINERY").select(*_PATH, F.col("jsd_post").alias("m"))
    return rounded(rollup.before_and_after(before, after, _PATH, "m"))


# ---- population counts ---------------------------------------------------------------------------------------------

@query("population_by_category", f"""WITH {SQL.POP} SELECT category, count(DISTINCT user_id) users, count(*) reviews,
  round(count(*) / CAST(count(DISTINCT user_id) AS DOUBLE), 6) per_user, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) pct
  FROM pop GROUP BY category""")
def population_by_category(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rollup.population_by_category(population(spark, sf), "user_id", "category"))


@query("users_by_category_count", f"""WITH {SQL.POP}, u AS (SELECT user_id, count(DISTINCT category) n_categories FROM pop GROUP BY 1)
  SELECT n_categories, count(*) users, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) pct FROM u GROUP BY 1""")
def users_by_category_count(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rollup.users_by_category_count(population(spark, sf), "user_id", "category"))


@query("reviews_per_user_histogram", f"""WITH {SQL.POP}, u AS (SELECT user_id, count(*) n_reviews FROM pop GROUP BY 1)
  SELECT n_reviews, count(*) users, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) pct FROM u GROUP BY 1""")
def reviews_per_user_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rollup.reviews_per_user_histogram(population(spark, sf), "user_id"))


@query("category_pairs", f"""WITH {SQL.POP}, d AS (SELECT DISTINCT user_id, category FROM pop)
  SELECT a.category category_a, b.category category_b, count(*) shared_users FROM d a JOIN d b ON a.user_id = b.user_id
  AND a.category < b.category GROUP BY 1, 2""")
def category_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return match.category_pairs(population(spark, sf), "user_id", "category")


@query("quantitative_summary", f"""WITH {SQL.POP}, c AS (SELECT cluster_id, tribe_id, count(*) n, round(avg(rating), 2) average_rating,
    round(count(*) FILTER (WHERE sentiment = 'Positive') * 100.0 / count(*), 1) positive,
    round(count(*) FILTER (WHERE sentiment = 'Negative') * 100.0 / count(*), 1) negative FROM pop GROUP BY 1, 2)
  SELECT cluster_id, tribe_id, n, average_rating, CAST(positive AS DOUBLE) positive, CAST(negative AS DOUBLE) negative FROM c""")
def quantitative_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = rollup.quantitative_summary(population(spark, sf), _PATH)
    return rows.select(*_PATH, "n", "average_rating", F.element_at("sentiment_percent", "Positive").alias("positive"),
                       F.element_at("sentiment_percent", "Negative").alias("negative"))


_SPLIT = """ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY md5('7|' || review_key), review_key) r,
    count(*) OVER (PARTITION BY user_id) n FROM pop),
  split AS (SELECT *, CASE WHEN n >= 4 AND r <= greatest(1, floor(n * 0.2)) THEN 'test' ELSE 'train' END split FROM ranked)"""


def split_population(spark: SparkSession, sf: str) -> DataFrame:
    return sample.user_split(population(spark, sf), "user_id", "review_key", ratio=0.2, min_reviews=4, seed=7)


@query("split_counts", f"""WITH {SQL.POP}, {_SPLIT} SELECT category, count(*) FILTER (WHERE split = 'train') train,
  count(*) FILTER (WHERE split = 'test') test, count(DISTINCT user_id) users FROM split GROUP BY category""")
def split_counts(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.split_counts(split_population(spark, sf), "user_id", "category")


@query("users_in_both_splits", f"""WITH {SQL.POP}, {_SPLIT} SELECT count(DISTINCT user_id) users,
  count(DISTINCT user_id) FILTER (WHERE split = 'test') test_users FROM split""")
def users_in_both_splits(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct users over the union of both splits."""
    rows = split_population(spark, sf).select("user_id", "split")
    train, test = (rows.filter(F.col("split") == s).select("user_id") for s in ("train", "test"))
    everyone = train.union(test).distinct().agg(F.count(F.lit(1)).alias("users"))
    return everyone.withColumn("test_users", test.distinct().agg(F.count(F.lit(1)).alias("n")).scalar())


@query("new_reviews_by_category", f"""WITH {SQL.POP} SELECT category, count(*) reviews, count(DISTINCT user_id) users FROM pop
  WHERE review_key NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY category""")
def new_reviews_by_category(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of reviews whose key is not in the existing data yet."""
    existing = table(spark, sf, "lineitem").filter(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("review_key"))
    fresh = match.unprocessed(population(spark, sf), existing, "review_key")
    return fresh.groupBy("category").agg(F.count(F.lit(1)).alias("reviews"), F.countDistinct("user_id").alias("users"))
