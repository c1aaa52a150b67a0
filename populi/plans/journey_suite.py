"""Correction journeys on the driver tables: each thirteen events of a user, in time order, are the iterations of one review."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from populi.functions import recall
from populi.operators import journey
from populi.operators.groups import rank_within
from populi.operators.wide import theme_map
from populi.plans.testbed import SQL, distributions, query, rounded, sides, table

_FIELDS = ["theme", "overall", "text", "prediction"]


def journey_rows(spark: SparkSession, sf: str) -> DataFrame:
    """cluster_id, tribe_id, review_key, iteration, theme, overall, text, prediction (an error event yields none)."""
    order = [F.col("ts"), F.col("event_id")]
    placed = rank_within(table(spark, sf, "events"), ["user_id"], order, rank="r").withColumns(
        {"review": F.floor((F.col("r") - 1) / 13), "iteration": ((F.col("r") - 1) % 13).cast("int")})
    theme, text = F.floor(F.col("value")) / 500, F.length("props") / 20
    return placed.select(
        F.concat(F.lit("c"), F.col("user_id") % 4).alias("cluster_id"), F.concat(F.lit("t"), F.col("user_id") % 12).alias("tribe_id"),
        F.concat_ws("-", "user_id", "review").alias("review_key"), "iteration", theme.alias("theme"), journey.overall_delta(text, theme).alias("overall"),
        text.alias("text"), F.when(F.col("event_type") != "error", F.concat(F.lit("p"), "event_id")).alias("prediction"))


_ROWS = """j AS (SELECT 'c' || (user_id % 4) cluster_id, 't' || (user_id % 12) tribe_id, user_id || '-' || ((r - 1) // 13) review_key, (r - 1) % 13 AS iteration, floor(value) / 500 theme,
    0.7::DOUBLE * (length(props) / 20) + 0.3::DOUBLE * (floor(value) / 500) overall, length(props) / 20 AS text_delta,
    CASE WHEN event_type <> 'error' THEN 'p' || event_id END prediction
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) r FROM events))"""

_GROUP = ["cluster_id", "tribe_id"]


def nested(spark: SparkSession, sf: str) -> DataFrame:
    rows = journey.nest_steps(journey_rows(spark, sf), [*_GROUP, "review_key"], _FIELDS)
    return rows.withColumn("initial", F.get(F.filter("steps", lambda s: s["iteration"] == 0), 0))


@query("overall_deltas", f"WITH {_ROWS} SELECT review_key, CAST(iteration AS INTEGER) AS iteration, round(overall, 6) overall FROM j")
def overall_deltas(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(journey_rows(spark, sf).select("review_key", "iteration", "overall"))


@query("running_minimum_grid", f"""WITH {_ROWS}, g AS (SELECT review_key, unnest(range(13)) i FROM (SELECT DISTINCT review_key FROM j))
  SELECT g.review_key, CAST(i AS INTEGER) AS iteration, round(min(theme) OVER w, 6) + 0.0 theme, round(min(overall) OVER w, 6) + 0.0 overall
  FROM g LEFT JOIN j ON j.review_key = g.review_key AND iteration = i
  WINDOW w AS (PARTITION BY g.review_key ORDER BY i ROWS UNBOUNDED PRECEDING)""")
def running_minimum_grid(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(journey.dense_grid(nested(spark, sf), ["review_key"], ["theme", "overall"], last=12))


_ENDS = """e AS (SELECT cluster_id, tribe_id, review_key, max(theme) FILTER (WHERE iteration = 0) t0, min(theme) t1, max(overall) FILTER (WHERE iteration = 0) o0, min(overall) o1
    FROM j GROUP BY 1, 2, 3)"""


@query("convergence_by_level", f"""WITH {_ROWS}, {_ENDS}, l AS (SELECT cluster_id, tribe_id, 'THEME' kind, t0 i0, t1 i1 FROM e UNION ALL SELECT cluster_id, tribe_id, 'OVERALL', o0, o1 FROM e),
  m AS (SELECT coalesce(cluster_id, 'ALL') cluster_id, coalesce(tribe_id, 'ALL') tribe_id, kind, avg(i0) a, avg(i1) b, count(*) n FROM l
    GROUP BY GROUPING SETS ((kind), (cluster_id, kind), (cluster_id, tribe_id, kind)))
  SELECT cluster_id, tribe_id, kind, round(a, 6) i0_mean, round(b, 6) i_last_mean, n, round(a - b, 6) improvement,
    round(CASE WHEN a > 0 THEN (a - b) / a * 100 ELSE 0 END, 6) improvement_pct FROM m""")
def convergence_by_level(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(journey.convergence(nested(spark, sf), _GROUP, ["theme", "overall"]))


@query("convergence_filled_with_zero", f"""WITH {_ROWS}, e AS (SELECT review_key, coalesce(max(theme) FILTER (WHERE iteration = 0 AND prediction IS NOT NULL), 0) a,
    coalesce(min(theme) FILTER (WHERE prediction IS NOT NULL), 0) b FROM j GROUP BY 1)
  SELECT 'THEME' kind, count(*) n, round(avg(a), 6) i0_mean, round(avg(b), 6) i_last_mean FROM e""")
def convergence_filled_with_zero(spark: SparkSession, sf: str) -> DataFrame:
    """Compatibility mode: a review without an observation counts as 0."""
    rows = journey_rows(spark, sf).withColumn("theme", F.when(F.col("prediction").isNotNull(), F.col("theme")))
    packed = journey.nest_steps(rows, ["review_key"], ["theme"])
    return rounded(journey.convergence(packed, [], ["theme"], fill=0.0).select("kind", "n", "i0_mean", "i_last_mean"))


_FOLD = f"""{_ROWS}, RECURSIVE_STEP AS (SELECT review_key, 0 it, theme, overall, 0 best, prediction FROM j WHERE iteration = 0 AND prediction IS NOT NULL
  UNION ALL SELECT f.review_key, f.it + 1, CASE WHEN better THEN n_theme ELSE f.theme END, CASE WHEN better THEN n_overall ELSE f.overall END,
    CASE WHEN better THEN f.it + 1 ELSE f.best END, CASE WHEN better THEN n_prediction ELSE f.prediction END
  FROM (SELECT f.*, j.theme n_theme, j.overall n_overall, j.prediction n_prediction, coalesce(j.prediction IS NOT NULL AND (j.theme < f.theme
      OR (abs(j.theme - f.theme) < 0.001 AND j.overall < f.overall)), FALSE) better
    FROM RECURSIVE_STEP f LEFT JOIN j ON j.review_key = f.review_key AND j.iteration = f.it + 1 WHERE f.it < 12) f)"""


@query("best_step_by_theme", f"""WITH RECURSIVE {_FOLD.replace('RECURSIVE_STEP', 'fold')}
  SELECT review_key, CAST(best AS INTEGER) best_iteration, round(theme, 6) + 0.0 theme, round(overall, 6) overall, prediction, best > 0 improved FROM fold WHERE it = 12""")
def best_step_by_theme(spark: SparkSession, sf: str) -> DataFrame:
    rows = nested(spark, sf).filter(F.col("initial.prediction").isNotNull())
    initial = F.col("initial")
    best = rows.withColumn("best", journey.best_by_theme(initial, F.col("steps")))
    return rounded(best.select("review_key", F.col("best.iteration").alias("best_iteration"), "best.theme", "best.overall", "best.prediction",
                               journey.improves_on(F.col("best"), initial).alias("improved")))


@query("best_step_by_overall", f"""WITH {_ROWS}, r AS (SELECT *, row_number() OVER (PARTITION BY review_key ORDER BY overall, iteration) n FROM j)
  SELECT review_key, CAST(iteration AS INTEGER) best_iteration, round(overall, 6) overall, prediction FROM r WHERE n = 1""")
def best_step_by_overall(spark: SparkSession, sf: str) -> DataFrame:
    best = nested(spark, sf).withColumn("best", journey.best_by_overall(F.col("initial"), F.col("steps")))
    return rounded(best.select("review_key", F.col("best.iteration").alias("best_iteration"), "best.overall", "best.prediction"))


@query("mean_of_review_minima", f"""WITH {_ROWS}, m AS (SELECT cluster_id, tribe_id, review_key, min(overall) o, min(text_delta) t FROM j GROUP BY 1, 2, 3)
  SELECT cluster_id, tribe_id, count(*) n, round(avg(o), 6) best_overall_mean, round(avg(t), 6) best_text_mean FROM m GROUP BY 1, 2""")
def mean_of_review_minima(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(journey.mean_of_minima(journey_rows(spark, sf), ["review_key"], _GROUP, ["overall", "text"]))


@query("behaviour_loss", f"""WITH {_ROWS}, m AS (SELECT cluster_id, tribe_id, min(overall) best, avg(overall) FILTER (WHERE iteration = 0) im FROM j GROUP BY 1, 2)
  SELECT cluster_id, tribe_id, round(best, 6) best, round(im, 6) initial_mean, round((im - best) / im * 100, 6) loss_pct FROM m""")
def behaviour_loss(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(journey.behaviour_loss(journey_rows(spark, sf), _GROUP, "overall"))


@query("journey_best_metrics", f"""WITH {SQL.SIDES}, {SQL.divergence('pre', 'sides', 'k')}, {SQL.divergence('post', 'sides', 'k', b='c')},
  d AS (SELECT pre.k, CASE WHEN pre.wd IS NOT NULL THEN round(pre.jsd, 12) END d0, 1.0::DOUBLE / (1 + pre.support) d1, 0.3::DOUBLE d2, pre.jsd j0, pre.wd w0, post.jsd j1, post.wd w1
    FROM pre JOIN post USING (k)),
  c AS (SELECT *, CASE WHEN least(d1, d2) < coalesce(d0, 9) THEN CASE WHEN d1 <= d2 THEN 1 ELSE 2 END ELSE 0 END i FROM d)
  SELECT k, CAST(i AS INTEGER) AS iteration, round(CASE i WHEN 0 THEN j0 WHEN 1 THEN j1 ELSE 0 END, 5) + 0.0 jsd, round(CASE i WHEN 0 THEN w0 WHEN 1 THEN w1 ELSE 0 END, 5) + 0.0 wd FROM c""")
def journey_best_metrics(spark: SparkSession, sf: str) -> DataFrame:
    step = lambda i, delta, m: F.struct(F.lit(i).alias("iteration"), delta.alias("theme"), F.col(m).alias("predicted"))
    steps = F.array(step(1, F.lit(1.0) / (1 + F.size("actual")), "corrected"), step(2, F.lit(0.3), "before"))
    truth = recall.keys_at_least(F.col("before"), 0.65)
    best = distributions(spark, sf).select("k", journey.best_metrics(F.col("actual"), F.col("predicted"), steps, truth).alias("b"))
    return rounded(best.select("k", "b.iteration", "b.jsd", "b.wd"), 5)


@query("correction_status", f"""WITH {_ROWS}, p AS (SELECT review_key, iteration, theme, max(theme) FILTER (WHERE iteration = 0) OVER (PARTITION BY review_key) t0 FROM j)
  SELECT CAST(iteration AS INTEGER) AS iteration, CASE WHEN theme < t0 THEN 'IMPROVED' WHEN theme > t0 THEN 'WORSE' ELSE 'UNCHANGED' END status, theme > t0 revoked, count(*) n FROM p WHERE iteration > 0 GROUP BY 1, 2, 3""")
def correction_status(spark: SparkSession, sf: str) -> DataFrame:
    """A worse step has its analysis revoked."""
    rows = nested(spark, sf).select("initial", F.explode("steps").alias("s")).filter(F.col("s.iteration") > 0)
    status = journey.status(F.col("initial.theme"), F.col("s.theme"))
    worse = journey.revoked(F.col("initial.theme"), F.col("s.theme"))
    return rows.groupBy(F.col("s.iteration").alias("iteration"), status.alias("status"), worse.alias("revoked")).agg(
        F.count(F.lit(1)).alias("n"))


@query("correction_worklist", f"""WITH {_ROWS}, l AS (SELECT review_key, max(iteration) i, max_by(theme, iteration) theme, max(iteration) FILTER (WHERE prediction IS NULL) f FROM j GROUP BY 1)
  SELECT review_key, CASE WHEN theme > 0.3 THEN 'above_threshold' ELSE 'failed' END cause FROM l WHERE theme > 0.3 OR f = i""")
def correction_worklist(spark: SparkSession, sf: str) -> DataFrame:
    """Reviews still above the threshold, and those whose latest step failed."""
    packed = nested(spark, sf)
    failed = packed.withColumn("latest", F.element_at("steps", -1)).filter(F.col("latest.prediction").isNull()).select(
        "review_key", F.col("latest.iteration").alias("iteration"))
    return journey.worklist(packed, ["review_key"], 0.3, failed).select("review_key", "cause")
