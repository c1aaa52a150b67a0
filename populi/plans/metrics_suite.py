"""Distribution metrics, recall and the matched evaluation on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from populi.functions import dist, recall
from populi.functions.text import themes_overlap
from populi.operators import fuzzy, match, rollup, wide
from populi.plans.testbed import SQL, STATS_SQL, distributions, population, query, rounded, sides, table
from populi.sources import readers


def _predictions(spark: SparkSession, sf: str) -> DataFrame:
    """A review whose priority is 'not specified' has no category."""
    pop = population(spark, sf).withColumn(
        "category", F.when(F.col("category") != "4-NOT SPECIFIED", F.col("category")))
    return (pop.join(distributions(spark, sf).select("k", "predicted"), F.col("review_key") == F.col("k"), "left")
            .select("review_key", "user_id", F.concat(F.lit("Order "), "review_key").alias("product_description"),
                    "category", "predicted"))


def _truth(spark: SparkSession, sf: str) -> DataFrame:
    """Ground truth in another spelling; pending orders have none."""
    return (table(spark, sf, "orders").filter(F.col("o_orderstatus") != "P")
            .join(distributions(spark, sf).select("k", "actual", "before"), F.col("o_orderkey") == F.col("k"))
            .select(F.col("o_custkey").cast("string").alias("user_id"),
                    F.concat(F.lit("  ORDER "), "k").alias("product_description"),
                    F.lower("o_orderpriority").alias("category"), "actual", "before", F.col("k").alias("pos")))


def evaluate(spark: SparkSession, sf: str) -> DataFrame:
    matched = match.match_to_truth(_predictions(spark, sf), _truth(spark, sf))
    return match.score_matches(matched, 0.65)


_OUTCOME = """outcome AS (SELECT review_key, pop.category, CASE WHEN pop.category = '4-NOT SPECIFIED' THEN 'missing_category'
    WHEN sentiment = 'Negative' OR tot.k IS NULL THEN 'no_ground_truth_match'
    WHEN coalesce(tot.sb, 0) = 0 THEN 'empty_distributions' ELSE 'matched' END outcome
    FROM pop LEFT JOIN (SELECT k, sum(b) sb FROM sides GROUP BY k) tot ON review_key = tot.k)"""
_HITS = """hit AS (SELECT k, r, h FROM truth JOIN ranked USING (k, t) JOIN has_b USING (k)),
    rec AS (SELECT k, kt, h, coalesce(count(r), 0) hits_all,
      {cols} FROM truth_n JOIN has_b USING (k) LEFT JOIN hit USING (k, h) GROUP BY k, kt, h)"""


def _hits(**cutoffs: str) -> str:
    return _HITS.format(cols=", ".join(f"count(*) FILTER (WHERE r <= {c}) / CAST(kt AS DOUBLE) {n}"
                                       for n, c in cutoffs.items()))


@query("evaluate_by_category", f"""WITH {SQL.POP}, {SQL.SIDES}, {SQL.divergence('pre', 'sides', 'k')}, {SQL.RANKED},
  {_OUTCOME}, {_hits(r3='greatest(3, kt)', r4='greatest(4, kt)')},
  rows AS (SELECT outcome.category, jsd, wd, r3, r4 FROM outcome JOIN pre ON review_key = pre.k LEFT JOIN rec ON review_key = rec.k
    WHERE outcome = 'matched'),
  long AS (SELECT category, 'jsd' metric, jsd AS "value" FROM rows UNION ALL SELECT category, 'wd', wd FROM rows
    UNION ALL SELECT category, 'recall_at_max3k', r3 FROM rows UNION ALL SELECT category, 'recall_at_max4k', r4 FROM rows)
  SELECT category, metric, {STATS_SQL} FROM long WHERE value IS NOT NULL GROUP BY category, metric""")
def evaluate_by_category(spark: SparkSession, sf: str) -> DataFrame:
    metrics = ["jsd", "wd", "recall_at_max3k", "recall_at_max4k"]
    long = rollup.stack_metrics(evaluate(spark, sf), ["category"], metrics)
    return rounded(rollup.metric_stats(long, ["category", "metric"]))


@query("match_outcomes", f"""WITH {SQL.POP}, {SQL.SIDES}, {_OUTCOME}
  SELECT outcome, count(*) n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) pct FROM outcome GROUP BY outcome""")
def match_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    matched = match.match_to_truth(_predictions(spark, sf), _truth(spark, sf))
    return rounded(rollup.reason_counts(matched))


@query("matched_review_scores", f"""WITH {SQL.POP}, {SQL.SIDES}, {SQL.divergence('pre', 'sides', 'k')}, {SQL.RANKED},
  {_OUTCOME}, {_hits(r3='greatest(3, kt)', r4='greatest(4, kt)')}
  SELECT review_key, round(jsd, 6) + 0.0 jsd, round(wd, 6) + 0.0 wd, round(r3, 6) recall_at_max3k, round(r4, 6) recall_at_max4k,
    CAST(kt AS INTEGER) k_actual, CAST(CASE WHEN kt IS NOT NULL THEN greatest(3, kt) END AS INTEGER) top_k_used_3
  FROM outcome JOIN pre ON review_key = pre.k LEFT JOIN rec ON review_key = rec.k WHERE outcome = 'matched'""")
def matched_review_scores(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(evaluate(spark, sf).select("review_key", "jsd", "wd", "recall_at_max3k", "recall_at_max4k", "k_actual",
                                              "top_k_used_3"))


_DIVERGENCE_SQL = f"""WITH {SQL.SIDES}, {SQL.divergence('pre', 'sides', 'k')}
  SELECT k, round(round(jsd, 12), 6) + 0.0 jsd, round(round(wd, 12), 6) + 0.0 wd, support, overlap FROM pre WHERE wd IS NOT NULL"""


@query("review_divergence", _DIVERGENCE_SQL)
def review_divergence(spark: SparkSession, sf: str) -> DataFrame:
    d = distributions(spark, sf).filter(F.size("predicted") > 0)
    return rounded(d.select("k", dist.compare(F.col("actual"), F.col("predicted")).alias("c")).select("k", "c.*"))


@query("review_divergence_long", f"""WITH {SQL.SIDES}, {SQL.divergence('pre', 'sides', 'k')}
  SELECT k, round(round(jsd, 12), 6) + 0.0 jsd, round(round(wd, 12), 6) + 0.0 wd, support FROM pre""")
def review_divergence_long(spark: SparkSession, sf: str) -> DataFrame:
    long = wide.compare_long(sides(spark, sf), "k", "t", "a", "b")
    return rounded(long.withColumn("support", F.col("support").cast("int")))


@query("jsd_over_category_list", f"""WITH {SQL.POP}, {SQL.SIDES},
  uni AS (SELECT category, count(DISTINCT t) un FROM sides JOIN pop ON review_key = k GROUP BY category),
  src AS (SELECT k, t, a, b, un FROM sides JOIN pop ON review_key = k JOIN uni USING (category)),
  {SQL.divergence('d', 'src', 'k', n='max(un)')}
  SELECT k, CASE WHEN wd IS NULL THEN 1.0 ELSE round(jsd, 6) + 0.0 END theme_jsd FROM d""")
def jsd_over_category_list(spark: SparkSession, sf: str) -> DataFrame:
    category = population(spark, sf).select(F.col("review_key").alias("k"), "category")
    themes = sides(spark, sf).select("k", "t").join(category, "k")
    universe = rollup.topic_universe(themes, "category", "t").select("category", "topics")
    rows = distributions(spark, sf).join(category, "k").join(universe, "category")
    return rounded(rows.select("k", dist.jsd_over_category(F.col("predicted"), F.col("actual"), F.col("topics"))
                               .alias("theme_jsd")))


def _normalised(spark: SparkSession, sf: str) -> DataFrame:
    d = distributions(spark, sf).filter(F.size("predicted") > 0)
    return population(spark, sf).join(d, F.col("review_key") == F.col("k")).select(
        "category", "cluster_id", "tribe_id", dist.normalise(F.col("actual")).alias("actual"),
        dist.normalise(F.col("predicted")).alias("predicted"))


_SHARES = f"""{SQL.POP}, {SQL.SIDES}, tot AS (SELECT k, sum(a) sa, sum(b) sb FROM sides GROUP BY k),
  share AS (SELECT category, cluster_id, tribe_id, k, t, a / sa p, b / sb q FROM sides JOIN tot USING (k)
    JOIN pop ON review_key = k WHERE sb > 0)"""
_LEVELS = """lv AS (SELECT coalesce(cluster_id, 'ALL') cluster_id, coalesce(tribe_id, 'ALL') tribe_id, t, {a} a, {b} b
    FROM share GROUP BY GROUPING SETS ((t), (cluster_id, t), (cluster_id, tribe_id, t))),
  sizes AS (SELECT coalesce(cluster_id, 'ALL') cluster_id, coalesce(tribe_id, 'ALL') tribe_id, count(DISTINCT k) n_reviews
    FROM share GROUP BY GROUPING SETS ((), (cluster_id), (cluster_id, tribe_id)))"""


@query("pooled_divergence_levels", f"""WITH {_SHARES}, {_LEVELS.format(a='sum(p)', b='coalesce(sum(q), 0)')},
  {SQL.divergence('d', 'lv', 'cluster_id, tribe_id')}
  SELECT cluster_id, tribe_id, n_reviews, round(jsd, 6) jsd, round(wd, 6) wd, support n_themes FROM d
  JOIN sizes USING (cluster_id, tribe_id) WHERE tribe_id = 'ALL' OR n_reviews >= 3""")
def pooled_divergence_levels(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rollup.pooled_divergence(_normalised(spark, sf), ["cluster_id", "tribe_id"], min_reviews=3))


@query("averaged_divergence_levels", f"""WITH {_SHARES}, {_LEVELS.format(a='avg(p)', b='coalesce(avg(q), 0)')},
  {SQL.divergence('d', 'lv', 'cluster_id, tribe_id')}
  SELECT cluster_id, tribe_id, n_reviews, round(jsd, 6) jsd, round(wd, 6) wd, support n_themes FROM d
  JOIN sizes USING (cluster_id, tribe_id)""")
def averaged_divergence_levels(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rollup.pooled_divergence(_normalised(spark, sf), ["cluster_id", "tribe_id"], average=True,
                                            truth_only=True))


@query("pooled_divergence_by_category", f"""WITH {_SHARES},
  lv AS (SELECT coalesce(category, 'ALL') category, t, sum(p) a, coalesce(sum(q), 0) b FROM share
    GROUP BY GROUPING SETS ((t), (category, t))), {SQL.divergence('d', 'lv', 'category')},
  sizes AS (SELECT coalesce(category, 'ALL') category, count(DISTINCT k) n_reviews FROM share GROUP BY GROUPING SETS ((), (category)))
  SELECT category, n_reviews, round(jsd, 6) jsd, round(wd, 6) wd, support n_themes FROM d JOIN sizes USING (category)""")
def pooled_divergence_by_category(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rollup.pooled_divergence(_normalised(spark, sf), ["category"]))


def brand_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """(theme, vector): brand n has the vector with id n."""
    brands = table(spark, sf, "part").select("p_brand").distinct()
    number = F.regexp_extract("p_brand", r"(\d+)", 1).cast("long")
    return brands.join(table(spark, sf, "embeddings"), number == F.col("vec_id")).select(
        F.col("p_brand").alias("theme"), F.col("embedding").alias("vector"))


@query("relaxed_semantic_distance", f"""WITH {SQL.SIDES},
  vec AS (SELECT DISTINCT p_brand t, CAST(embedding AS DOUBLE[]) v FROM part JOIN embeddings
    ON vec_id = CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT)),
  cost AS (SELECT x.t t1, y.t t2, CASE WHEN x.t = y.t THEN 0 ELSE greatest(0, 1 - list_cosine_similarity(x.v, y.v)) END cost
    FROM vec x CROSS JOIN vec y),
  tot AS (SELECT k, sum(a) sa, sum(b) sb FROM sides GROUP BY k HAVING sum(b) > 0),
  f AS (SELECT s.k, s.t, max(s.a / sa) p, min(cost) c FROM sides s JOIN tot USING (k) JOIN sides o ON o.k = s.k AND o.b IS NOT NULL
    JOIN cost ON t1 = s.t AND t2 = o.t GROUP BY s.k, s.t),
  g AS (SELECT s.k, s.t, max(s.b / sb) p, min(cost) c FROM sides s JOIN tot USING (k) JOIN sides o ON o.k = s.k
    JOIN cost ON t1 = s.t AND t2 = o.t WHERE s.b IS NOT NULL GROUP BY s.k, s.t),
  fs AS (SELECT k, sum(p * c) d FROM f GROUP BY k), gs AS (SELECT k, sum(p * c) d FROM g GROUP BY k)
  SELECT k, round(greatest(fs.d, gs.d), 6) + 0.0 relaxed_wd FROM fs JOIN gs USING (k)""")
def relaxed_semantic_distance(spark: SparkSession, sf: str) -> DataFrame:
    vectors = brand_vectors(spark, sf)
    topics = vectors.select(F.lit("all").alias("category"), "theme", F.regexp_extract("theme", r"(\d+)", 1).cast("int").alias("pos"))
    matrices = fuzzy.cost_matrices(topics, vectors)
    d = distributions(spark, sf).filter(F.size("predicted") > 0).select(
        "k", F.lit("all").alias("category"), dist.normalise(F.col("actual")).alias("x"), dist.normalise(F.col("predicted")).alias("y"))
    bound = dist.relaxed_transport(F.col("x"), F.col("y"), F.col("position"), F.col("costs"))
    return rounded(d.join(matrices, "category").select("k", bound.alias("relaxed_wd")))


@query("text_delta", """SELECT x.vec_id, round(1 - list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])), 6)
  text_delta FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1""")
def text_delta(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return rounded(e.join(other, "vec_id").select("vec_id", (1 - dist.cosine(F.col("embedding"), F.col("other")))
                                                  .alias("text_delta")))


@query("theme_delta", f"""WITH {SQL.SIDES}, {SQL.RANKED}, {_hits(r3='greatest(3, kt)')}
  SELECT sides_k.k, round(CASE WHEN truth_n.k IS NULL THEN 0.0 WHEN has_b.k IS NULL THEN 1.0 ELSE 1 - r3 END, 6) theme_delta
  FROM (SELECT DISTINCT k FROM sides) sides_k LEFT JOIN truth_n USING (k) LEFT JOIN has_b USING (k) LEFT JOIN rec USING (k)""")
def theme_delta(spark: SparkSession, sf: str) -> DataFrame:
    d = distributions(spark, sf)
    return rounded(d.select("k", recall.theme_delta(F.col("predicted"), recall.keys_at_least(F.col("before"), 0.65))
                            .alias("theme_delta")))


@query("actual_side_priority", """WITH line AS (SELECT l_orderkey k, p_brand t, l_quantity a, l_returnflag f FROM lineitem
    JOIN part ON l_partkey = p_partkey),
  n AS (SELECT k, count(DISTINCT t) FILTER (WHERE f = 'A') na, count(DISTINCT t) FILTER (WHERE f = 'N') nn, count(DISTINCT t) nr
    FROM line GROUP BY k)
  SELECT CASE WHEN na > 0 THEN 'topic_probabilities' WHEN nn > 0 THEN 'themes' ELSE 'predicted_themes' END AS "source",
    count(*) n_reviews, CAST(sum(CASE WHEN na > 0 THEN na WHEN nn > 0 THEN nn ELSE nr END) AS BIGINT) n_themes FROM n GROUP BY 1""")
def actual_side_priority(spark: SparkSession, sf: str) -> DataFrame:
    line = sides(spark, sf).groupBy("k", "t").agg(
        F.sum(F.when(F.col("flag") == "A", F.col("a"))).alias("pa"), F.max(F.col("flag") == "N").alias("n"),
        F.sum("a").alias("a"))
    rows = line.groupBy("k").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("pa").isNotNull(), F.struct("t", "pa")))).alias("first"),
        F.collect_list(F.when(F.col("n"), F.col("t"))).alias("second"),
        F.map_from_entries(F.collect_list(F.struct("t", "a"))).alias("third"))
    review = F.struct(F.to_json("first").alias("topic_probabilities"), F.to_json("second").alias("themes"), F.to_json("third").alias("predicted_themes"))
    source = (F.when(F.size("first") > 0, "topic_probabilities").when(F.size("second") > 0, "themes").otherwise("predicted_themes"))
    chosen = rows.select(source.alias("source"), F.size(readers.first_actual(review)).alias("m"))
    return chosen.groupBy("source").agg(F.count(F.lit(1)).alias("n_reviews"), F.sum("m").alias("n_themes"))


@query("stored_jsd_audit", f"""WITH {SQL.SIDES}, {SQL.divergence('pre', 'sides', 'k')}
  SELECT count(*) n, count(*) n_agree FROM pre WHERE wd IS NOT NULL""")
def stored_jsd_audit(spark: SparkSession, sf: str) -> DataFrame:
    stored = wide.compare_long(sides(spark, sf), "k", "t", "a", "b").filter(F.col("wd").isNotNull())
    again = distributions(spark, sf).select("k", dist.jsd(F.col("actual"), F.col("predicted")).alias("again"))
    return wide.audit(stored.join(again, "k"), "jsd", "again").select("n", "n_agree")


def _ranked(spark: SparkSession, sf: str) -> DataFrame:
    d = distributions(spark, sf).filter(F.size("predicted") > 0)
    return (d.withColumn("truth", recall.keys_at_least(F.col("before"), 0.65)).filter(F.size("truth") > 0)
            .withColumn("order", recall.ranked(F.col("predicted"))))


@query("recall_family", f"""WITH {SQL.SIDES}, {SQL.RANKED},
  {_hits(r1='1', r3='3', r5='5', rk='kt', r2k='2 * kt', rm3='greatest(3, kt)', rm4='greatest(4, kt)')}
  SELECT k, CAST(kt AS INTEGER) k_actual, round(r1, 6) recall_at_1, round(r3, 6) recall_at_3, round(r5, 6) recall_at_5,
    round(rk, 6) recall_at_k, round(r2k, 6) recall_at_2k, round(rm3, 6) recall_at_max3k, round(rm4, 6) recall_at_max4k FROM rec""")
def recall_family(spark: SparkSession, sf: str) -> DataFrame:
    order, truth, k = F.col("order"), F.col("truth"), F.size("truth")
    return rounded(_ranked(spark, sf).select(
        "k", k.alias("k_actual"), *[recall.recall_at(order, truth, n).alias(f"recall_at_{n}") for n in (1, 3, 5)],
        recall.recall_at(order, truth, k).alias("recall_at_k"), recall.recall_at(order, truth, 2 * k).alias("recall_at_2k"),
        recall.recall_at_max_nk(order, truth, 3).alias("recall_at_max3k"),
        recall.recall_at_max_nk(order, truth, 4).alias("recall_at_max4k")))


@query("recall_by_predicted_count", f"""WITH {SQL.SIDES}, {SQL.RANKED}, {_hits(rh='h', rm='greatest(4, h)', rn='3')}
  SELECT k, CAST(h AS INTEGER) h_predicted, CAST(greatest(4, h) AS INTEGER) top_h_used, round(rh, 6) recall_at_h,
    round(rm, 6) recall_at_max4h, round(rn, 6) recall_at_3 FROM rec""")
def recall_by_predicted_count(spark: SparkSession, sf: str) -> DataFrame:
    order, truth, h = F.col("order"), F.col("truth"), F.size("order")
    used = F.greatest(F.lit(4), h)
    return rounded(_ranked(spark, sf).select(
        "k", h.alias("h_predicted"), used.alias("top_h_used"), recall.recall_at(order, truth, h).alias("recall_at_h"),
        recall.recall_at(order, truth, used).alias("recall_at_max4h"), recall.recall_at(order, truth, 3).alias("recall_at_3")))


_SCORED = "scored AS (SELECT k, t, r, b / max(b) OVER (PARTITION BY k) s FROM ranked)"


@query("recall_with_score_rule", f"""WITH {SQL.SIDES}, {SQL.RANKED}, {_SCORED},
  j AS (SELECT k, kt, s, r, truth.t IS NOT NULL hit FROM scored JOIN truth_n USING (k) LEFT JOIN truth USING (k, t))
  SELECT k, round(count(*) FILTER (WHERE hit AND (r <= greatest(3, kt) OR s >= 0.8)) / CAST(kt AS DOUBLE), 6) recall_08,
    CAST(count(*) FILTER (WHERE s >= 0.8) AS INTEGER) above_08,
    CAST(count(*) FILTER (WHERE s >= 0.8 AND r > greatest(3, kt)) AS INTEGER) extra_08,
    round(count(*) FILTER (WHERE hit AND (r <= greatest(3, kt) OR s >= 0.85)) / CAST(kt AS DOUBLE), 6) recall_085,
    CAST(count(*) FILTER (WHERE s >= 0.85) AS INTEGER) above_085,
    CAST(count(*) FILTER (WHERE s >= 0.85 AND r > greatest(3, kt)) AS INTEGER) extra_085 FROM j GROUP BY k, kt""")
def recall_with_score_rule(spark: SparkSession, sf: str) -> DataFrame:
    top = F.array_max(F.map_values("predicted"))
    rows = _ranked(spark, sf).withColumn("top", top).withColumn(
        "score", F.transform_values("predicted", lambda _, v: v / F.col("top")))
    m, order, truth = F.col("score"), F.col("order"), F.col("truth")
    return rounded(rows.select(
        "k", *[c for name, s in (("08", 0.8), ("085", 0.85)) for c in (
            recall.recall_with_score(m, order, truth, s).alias(f"recall_{name}"),
            recall.above_score(m, s).alias(f"above_{name}"),
            recall.extra_above_score(m, order, truth, s).alias(f"extra_{name}"))]))


@query("recall_with_floor", f"""WITH {SQL.SIDES}, tot AS (SELECT k, count(*) n, sum(b) sb FROM sides GROUP BY k),
  p AS (SELECT k, t, row_number() OVER (PARTITION BY k ORDER BY b DESC, t) r FROM sides JOIN tot USING (k) WHERE b / sb >= 0.3)
  SELECT k, round(coalesce(count(p.t) FILTER (WHERE r <= 3), 0) / CAST(max(n) AS DOUBLE), 6) recall_floor
  FROM tot LEFT JOIN p USING (k) GROUP BY k""")
def recall_with_floor(spark: SparkSession, sf: str) -> DataFrame:
    d = distributions(spark, sf).select("k", dist.normalise(F.col("actual")).alias("x"),
                                        dist.normalise(F.col("predicted")).alias("y"))
    return rounded(d.select("k", recall.recall_with_floor(F.col("x"), F.col("y"), 3, 0.3).alias("recall_floor")))


@query("soft_recall", r"""WITH line AS (SELECT l_orderkey k, p_name t, sum(l_extendedprice) FILTER (WHERE l_returnflag = 'N') b,
    count(*) FILTER (WHERE l_returnflag = 'A') na FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
  truth AS (SELECT k, t FROM line WHERE na > 0), truth_n AS (SELECT k, count(*) kt FROM truth GROUP BY k),
  pred AS (SELECT k, t, row_number() OVER (PARTITION BY k ORDER BY b DESC, t) r FROM line WHERE b IS NOT NULL),
  hit AS (SELECT DISTINCT truth.k, truth.t FROM truth JOIN truth_n USING (k) JOIN pred ON pred.k = truth.k AND r <= greatest(3, kt)
    WHERE contains(truth.t, pred.t) OR contains(pred.t, truth.t)
    OR len(list_intersect(string_split(truth.t, ' '), string_split(pred.t, ' '))) >= 2)
  SELECT k, CAST(kt AS INTEGER) k_actual, round(count(hit.t) / CAST(kt AS DOUBLE), 6) soft_recall
  FROM truth_n LEFT JOIN hit USING (k) GROUP BY k, kt""")
def soft_recall(spark: SparkSession, sf: str) -> DataFrame:
    line = sides(spark, sf, "p_name").groupBy("k", F.lower(F.trim("t")).alias("t")).agg(
        F.sum(F.when(F.col("flag") == "N", F.col("c"))).alias("b"), F.max(F.col("flag") == "A").alias("actual"))
    rows = line.groupBy("k").agg(
        F.collect_list(F.when(F.col("actual"), F.col("t"))).alias("truth"),
        F.map_from_entries(F.collect_list(F.when(F.col("b").isNotNull(), F.struct("t", "b")))).alias("predicted"))
    top = recall.top_k(F.col("predicted"), recall.max_nk(F.col("truth"), 3))
    found = F.filter("truth", lambda t: F.exists(F.col("top"), lambda p: themes_overlap(p, t)))
    return rounded(rows.filter(F.size("truth") > 0).withColumn("top", top).select(
        "k", F.size("truth").alias("k_actual"), (F.size(found) / F.size("truth")).alias("soft_recall")))


@query("soft_accuracy_block", f"""WITH {SQL.POP}, line AS (SELECT l_orderkey k, p_name t, sum(l_extendedprice) FILTER (WHERE l_returnflag = 'N') b,
    count(*) FILTER (WHERE l_returnflag = 'A') na FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
  truth AS (SELECT k, t FROM line WHERE na > 0), truth_n AS (SELECT k, count(*) kt FROM truth GROUP BY k),
  pred AS (SELECT k, t, row_number() OVER (PARTITION BY k ORDER BY b DESC, t) r FROM line WHERE b IS NOT NULL),
  hit AS (SELECT DISTINCT truth.k, truth.t FROM truth JOIN truth_n USING (k) JOIN pred ON pred.k = truth.k AND r <= greatest(3, kt)
    WHERE contains(truth.t, pred.t) OR contains(pred.t, truth.t)
    OR len(list_intersect(string_split(truth.t, ' '), string_split(pred.t, ' '))) >= 2),
  m AS (SELECT k, kt, count(hit.t) / CAST(kt AS DOUBLE) soft FROM truth_n LEFT JOIN hit USING (k) GROUP BY k, kt),
  b AS (SELECT review_key, soft, CASE WHEN kt IS NULL THEN 0.0::DOUBLE ELSE greatest(0.0, 1 - abs(1 + CAST(user_id AS BIGINT) % 5 - rating) / 4.0) END rs,
      CASE WHEN kt IS NOT NULL AND sentiment = CASE WHEN price > 200000 THEN 'Positive' ELSE 'Neutral' END THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ss
    FROM pop JOIN (SELECT DISTINCT k FROM line) l ON review_key = l.k LEFT JOIN m ON review_key = m.k)
  SELECT review_key, round(rs, 6) rating_score, ss sentiment_score, round(coalesce(soft, 0.0), 6) soft_recall,
    round(0.4::DOUBLE * rs + 0.3::DOUBLE * ss + 0.3::DOUBLE * coalesce(soft, 0.0), 6) overall_accuracy FROM b""")
def soft_accuracy_block(spark: SparkSession, sf: str) -> DataFrame:
    """The accuracy block around soft recall, of every review that has themes on either side."""
    line = sides(spark, sf, "p_name").groupBy("k", F.lower(F.trim("t")).alias("t")).agg(
        F.sum(F.when(F.col("flag") == "N", F.col("c"))).alias("b"), F.max(F.col("flag") == "A").alias("actual"))
    rows = line.groupBy("k").agg(
        F.collect_list(F.when(F.col("actual"), F.col("t"))).alias("truth"),
        F.map_from_entries(F.collect_list(F.when(F.col("b").isNotNull(), F.struct("t", "b")))).alias("predicted"))
    reviews = population(spark, sf).join(rows, F.col("review_key") == F.col("k"))
    block = recall.soft_accuracy(F.col("predicted"), F.col("truth"), (F.lit(1) + F.col("user_id").cast("long") % 5).cast("double"), F.col("rating"),
                                 F.when(F.col("price") > 200000, "POSITIVE").otherwise("Neutral"), F.col("sentiment"))
    return rounded(reviews.select("review_key", *[c.alias(n) for n, c in block.items()]))


def review_metric_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Metric block of every review; the predicted rating follows the customer, the predicted sentiment the price."""
    d = distributions(spark, sf).withColumn("truth", recall.keys_at_least(F.col("before"), 0.65))
    rows = population(spark, sf).join(d, F.col("review_key") == F.col("k"))
    block = recall.review_metrics(
        F.col("predicted"), F.col("truth"), (F.lit(1) + F.col("user_id").cast("long") % 5).cast("double"), F.col("rating"),
        F.when(F.col("price") > 200000, "Positive").otherwise("Neutral"), F.col("sentiment"))
    return rows.select("review_key", "cluster_id", "tribe_id", *[c.alias(n) for n, c in block.items()])


_BLOCK = f"""{SQL.POP}, {SQL.SIDES}, {SQL.RANKED},
  hit AS (SELECT k, r FROM truth JOIN ranked USING (k, t)),
  block AS (SELECT review_key, cluster_id, tribe_id, kt,
    greatest(0.0, 1 - abs(1 + CAST(user_id AS BIGINT) % 5 - rating) / 4.0) rating_score,
    CASE WHEN sentiment = CASE WHEN price > 200000 THEN 'Positive' ELSE 'Neutral' END THEN 1.0 ELSE 0.0 END sentiment_score,
    count(*) FILTER (WHERE r <= 1) / CAST(kt AS DOUBLE) recall_at_1,
    count(*) FILTER (WHERE r <= greatest(3, kt)) / CAST(kt AS DOUBLE) recall_at_max3k
    FROM pop JOIN truth_n ON review_key = truth_n.k LEFT JOIN hit ON review_key = hit.k
    GROUP BY review_key, cluster_id, tribe_id, kt, user_id, rating, sentiment, price),
  metric AS (SELECT *, 0.4 * rating_score + 0.3 * sentiment_score + 0.3 * recall_at_max3k overall_accuracy FROM block)"""


@query("review_metric_block", f"""WITH {_BLOCK} SELECT review_key, CAST(rating_score AS DOUBLE) rating_score,
  CAST(sentiment_score AS DOUBLE) sentiment_score, round(recall_at_1, 6) recall_at_1, round(recall_at_max3k, 6) recall_at_max3k,
  round(overall_accuracy, 6) overall_accuracy, CAST(kt AS INTEGER) num_actual_themes FROM metric""")
def review_metric_block(spark: SparkSession, sf: str) -> DataFrame:
    rows = review_metric_rows(spark, sf).filter(F.col("num_actual_themes").isNotNull())
    return rounded(rows.select("review_key", "rating_score", "sentiment_score", "recall_at_1", "recall_at_max3k",
                               "overall_accuracy", "num_actual_themes"))


@query("tribe_metric_summary", f"""WITH {_BLOCK}, long AS (
  SELECT cluster_id, tribe_id, 'rating_score' metric, rating_score AS "value" FROM metric UNION ALL
  SELECT cluster_id, tribe_id, 'sentiment_score', sentiment_score FROM metric UNION ALL
  SELECT cluster_id, tribe_id, 'recall_at_max3k', recall_at_max3k FROM metric UNION ALL
  SELECT cluster_id, tribe_id, 'overall_accuracy', overall_accuracy FROM metric)
  SELECT coalesce(cluster_id, 'ALL') cluster_id, coalesce(tribe_id, 'ALL') tribe_id, metric, count(*) n, round(avg(value), 6) mean,
    round(stddev_pop(value), 6) std, CAST(round(min(value), 6) AS DOUBLE) "min", CAST(round(max(value), 6) AS DOUBLE) "max" FROM long
  GROUP BY GROUPING SETS ((metric), (cluster_id, metric), (cluster_id, tribe_id, metric))""")
def tribe_metric_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Pooled scores per tribe, cluster and overall."""
    names = ["rating_score", "sentiment_score", "recall_at_max3k", "overall_accuracy"]
    return rounded(rollup.level_stats(review_metric_rows(spark, sf), ["cluster_id", "tribe_id"], names, quantiles={}))


@query("recall_group_means", f"""WITH {SQL.POP}, {SQL.SIDES}, {SQL.RANKED}, {_hits(r1='1', r3='3', rm='greatest(3, kt)')}
  SELECT cluster_id, tribe_id, count(*) n, round(avg(r1), 6) mean_recall_at_1, round(avg(r3), 6) mean_recall_at_3,
    round(avg(rm), 6) mean_recall_at_max3k FROM rec JOIN pop ON review_key = k GROUP BY ALL HAVING count(*) >= 3""")
def recall_group_means(spark: SparkSession, sf: str) -> DataFrame:
    order, truth = F.col("order"), F.col("truth")
    scored = _ranked(spark, sf).select(
        "k", recall.recall_at(order, truth, 1).alias("recall_at_1"), recall.recall_at(order, truth, 3).alias("recall_at_3"),
        recall.recall_at_max_nk(order, truth, 3).alias("recall_at_max3k"))
    rows = population(spark, sf).join(scored, F.col("review_key") == F.col("k"))
    return rounded(rollup.group_means(rows, ["cluster_id", "tribe_id"], ["recall_at_1", "recall_at_3", "recall_at_max3k"], 3))
