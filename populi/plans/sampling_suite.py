"""Quotas, samples, splits and packing on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from populi.operators import sample
from populi.operators.groups import keep_top, rank_within
from populi.plans.rollup_suite import _SPLIT, split_population
from populi.plans.testbed import SQL, population, query, rounded, table
from populi.sources.writers import user_documents


@query("user_split", f"WITH {SQL.POP}, {_SPLIT} SELECT review_key, user_id, split FROM split")
def user_split(spark: SparkSession, sf: str) -> DataFrame:
    return split_population(spark, sf).select("review_key", "user_id", "split")


def _quotas(spark: SparkSession, sf: str) -> DataFrame:
    """Every building customer may give as many reviews as the tens of its balance, five at most."""
    quota = F.least(F.lit(5), F.floor(F.col("c_acctbal") / 1000).cast("int"))
    return (table(spark, sf, "customer").filter(F.col("c_mktsegment") == "BUILDING")
            .select(F.col("c_custkey").cast("string").alias("user_id"), quota.alias("quota")).filter(F.col("quota") > 0))


_QUOTA = """quota AS (SELECT CAST(c_custkey AS VARCHAR) user_id, least(5, CAST(floor(c_acctbal / 1000) AS INTEGER)) quota FROM customer
    WHERE c_mktsegment = 'BUILDING' AND floor(c_acctbal / 1000) > 0),
  taken AS (SELECT * FROM (SELECT review_key, user_id, category, quota, row_number() OVER (PARTITION BY user_id ORDER BY review_key) r
    FROM pop JOIN quota USING (user_id)) WHERE r <= quota)"""


@query("quota_sample", f"WITH {SQL.POP}, {_QUOTA} SELECT review_key, user_id FROM taken")
def quota_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sample.within_quota(population(spark, sf), _quotas(spark, sf), "user_id", "review_key").select("review_key", "user_id")


@query("quota_top_up", f"""WITH {SQL.POP}, {_QUOTA}, rest AS (SELECT user_id, category, min(review_key) p FROM pop
    WHERE (user_id, category) NOT IN (SELECT user_id, category FROM taken) GROUP BY 1, 2 ORDER BY p
    LIMIT (SELECT greatest(0, (SELECT sum(quota) FROM quota) - (SELECT count(*) FROM taken))::BIGINT))
  SELECT p review_key, user_id, category FROM rest""")
def quota_top_up(spark: SparkSession, sf: str) -> DataFrame:
    pop = population(spark, sf)
    taken = sample.within_quota(pop, _quotas(spark, sf), "user_id", "review_key")
    return sample.top_up(pop, taken, _quotas(spark, sf), ["user_id", "category"], "review_key").select("review_key", "user_id", "category")


_TARGETS = """cnt AS (SELECT category, count(*) n FROM pop GROUP BY 1),
  base AS (SELECT category, CAST(floor(2000 * (n / CAST(sum(n) OVER () AS DOUBLE))) AS BIGINT) t FROM cnt),
  target AS (SELECT category, t + CASE WHEN row_number() OVER (ORDER BY t DESC, category) <= 2000 - sum(t) OVER () THEN 1 ELSE 0 END
    target FROM base)"""


def _targets(spark: SparkSession, sf: str) -> DataFrame:
    counts = population(spark, sf).groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return sample.category_targets(counts, "category", 2000)


@query("category_targets", f"WITH {SQL.POP}, {_TARGETS} SELECT category, CAST(target AS BIGINT) target FROM target")
def category_targets(spark: SparkSession, sf: str) -> DataFrame:
    return _targets(spark, sf)


@query("category_targets_equal", f"""WITH {SQL.POP}, c AS (SELECT DISTINCT category FROM pop), n AS (SELECT *, 2003 // count(*) OVER () t,
    row_number() OVER (ORDER BY category) r, count(*) OVER () k FROM c)
  SELECT category, CAST(t + CASE WHEN r <= 2003 - t * k THEN 1 ELSE 0 END AS BIGINT) target FROM n""")
def category_targets_equal(spark: SparkSession, sf: str) -> DataFrame:
    counts = population(spark, sf).groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return sample.category_targets(counts, "category", 2003, keep_ratios=False)


@query("uniform_sample", f"""WITH {SQL.POP}, {_TARGETS}, r AS (SELECT review_key, category, row_number() OVER (PARTITION BY category
    ORDER BY md5('3|' || review_key), review_key) r FROM pop)
  SELECT review_key, category FROM r JOIN target USING (category) WHERE r <= target""")
def uniform_sample(spark: SparkSession, sf: str) -> DataFrame:
    rows = sample.uniform_sample(population(spark, sf), "category", "review_key", _targets(spark, sf), seed=3)
    return rows.select("review_key", "category")


_BALANCED = f"""{_TARGETS}, u AS (SELECT category, user_id, count(*) c FROM pop GROUP BY 1, 2),
  q AS (SELECT *, sum(c) OVER (PARTITION BY category ORDER BY md5('5|' || user_id), user_id ROWS UNBOUNDED PRECEDING) upto FROM u),
  take AS (SELECT category, user_id, least(c, target - (upto - c)) take FROM q JOIN target USING (category)
    WHERE least(c, target - (upto - c)) > 0),
  picked AS (SELECT review_key, category, user_id, take, row_number() OVER (PARTITION BY category, user_id
    ORDER BY md5('5|' || review_key), review_key) r FROM pop JOIN take USING (category, user_id)),
  balanced AS (SELECT review_key, category, user_id FROM picked WHERE r <= take)"""


@query("balanced_sample", f"WITH {SQL.POP}, {_BALANCED} SELECT * FROM balanced")
def balanced_sample(spark: SparkSession, sf: str) -> DataFrame:
    rows = sample.balanced_sample(population(spark, sf), "category", "user_id", "review_key", _targets(spark, sf), seed=5)
    return rows.select("review_key", "category", "user_id")


@query("busiest_users", f"""WITH {SQL.POP}, t AS (SELECT user_id FROM pop GROUP BY 1 ORDER BY count(*) DESC, user_id LIMIT 100)
  SELECT review_key, user_id FROM pop WHERE user_id IN (SELECT user_id FROM t)""")
def busiest_users(spark: SparkSession, sf: str) -> DataFrame:
    return sample.busiest_users(population(spark, sf), "user_id", 100).select("review_key", "user_id")


@query("sampling_rounds", """WITH t AS (SELECT DISTINCT lang, text FROM documents),
  r AS (SELECT lang, md5(text) text_md5, CAST(ceil(row_number() OVER (PARTITION BY lang ORDER BY md5('1|' || text), text) / 50.0) AS INTEGER)
    round FROM t) SELECT * FROM r""")
def sampling_rounds(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("lang", "text")
    rounds = sample.sampling_rounds(docs, "lang", "text", per_round=50, seed=1)
    return rounds.select("lang", F.md5("text").alias("text_md5"), "round")


@query("systematic_sample", """WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 r,
    count(*) OVER (PARTITION BY source) n FROM documents)
  SELECT doc_id, source FROM r WHERE n <= 20 OR (r % (n // 20) = 0 AND r // (n // 20) < 20)""")
def systematic_sample(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source")
    return sample.systematic_sample(docs, ["source"], "doc_id", 20).select("doc_id", "source")


@query("budget_packing", """WITH r AS (SELECT conv_id, turn, sum(length(text) + 7) OVER (PARTITION BY conv_id ORDER BY turn
    ROWS UNBOUNDED PRECEDING) used FROM conversations) SELECT conv_id, turn, CAST(used AS BIGINT) used FROM r WHERE used <= 1500""")
def budget_packing(spark: SparkSession, sf: str) -> DataFrame:
    rows = sample.pack_to_budget(table(spark, sf, "conversations"), ["conv_id"], [F.col("turn")],
                                 F.length("text"), 1500, separator=7)
    return rows.select("conv_id", "turn", "used")


@query("review_position_labels", f"""WITH {SQL.POP}, r AS (SELECT review_key, row_number() OVER (PARTITION BY user_id ORDER BY ts, review_key) r,
    count(*) OVER (PARTITION BY user_id) n FROM pop)
  SELECT review_key, r - 1 review_index, CASE WHEN r = 1 THEN 'first' WHEN r = n THEN 'last' ELSE 'intermediate' END review_type FROM r""")
def review_position_labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = sample.position_labels(population(spark, sf), "user_id", "ts", "review_key")
    return rows.select("review_key", "review_index", "review_type")


@query("leave_one_out_totals", f"""WITH {SQL.POP}, t AS (SELECT user_id, count(*) n, sum(rating) s FROM pop GROUP BY 1)
  SELECT review_key, n - 1 others, round(CASE WHEN n > 1 THEN (s - rating) / (n - 1) END, 6) others_mean_rating FROM pop JOIN t USING (user_id)""")
def leave_one_out_totals(spark: SparkSession, sf: str) -> DataFrame:
    rows = sample.leave_one_out_totals(population(spark, sf), "user_id", ["rating"])
    return rounded(rows.select("review_key", "others", "others_mean_rating"))


@query("leave_one_out_places", """SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) "rank", count(*) OVER (PARTITION BY conv_id) - 1 others, md5(text) text_md5
  FROM conversations""")
def leave_one_out_places(spark: SparkSession, sf: str) -> DataFrame:
    """All other reviews, without a budget: each user's texts once, and each row's own place to leave out."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "text", F.timestamp_seconds(F.col("turn")).alias("ts"))
    rows = sample.leave_one_out_history(turns, "conv_id", "ts", "turn", "text")
    return rows.select("conv_id", "turn", "rank", "others", F.md5("text").alias("text_md5"))


@query("leave_one_out_history", """WITH c AS (SELECT conv_id, turn, text, length(text) l FROM conversations),
  p AS (SELECT a.conv_id, a.turn, b.turn bt, b.text, sum(b.l) OVER (PARTITION BY a.conv_id, a.turn ORDER BY b.turn
    ROWS UNBOUNDED PRECEDING) used FROM c a JOIN c b ON a.conv_id = b.conv_id AND a.turn <> b.turn)
  SELECT c.conv_id, c.turn, count(bt) n_history, CAST(coalesce(sum(length(p.text)), 0) AS BIGINT) n_chars, md5(coalesce(string_agg(p.text, '|' ORDER BY bt), '')) history_md5
  FROM c LEFT JOIN p ON p.conv_id = c.conv_id AND p.turn = c.turn AND used <= 800 GROUP BY 1, 2""")
def leave_one_out_history(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select(
        "conv_id", "turn", "text", F.timestamp_seconds(F.col("turn")).alias("ts"))
    rows = sample.leave_one_out_history(turns, "conv_id", "ts", "turn", "text", budget=800)
    chars = F.aggregate(F.transform("history", lambda t: F.length(t).cast("long")), F.lit(0).cast("long"), lambda a, n: a + n)
    return rows.select("conv_id", "turn", F.size("history").cast("long").alias("n_history"), chars.alias("n_chars"),
                       F.md5(F.array_join("history", "|")).alias("history_md5"))


@query("nested_user_documents", f"""WITH {SQL.POP}, r AS (SELECT user_id, review_key, rating, (row_number() OVER (PARTITION BY user_id
    ORDER BY review_key) - 1) // 4 part FROM pop)
  SELECT user_id, CAST(part AS INTEGER) part, CAST(count(*) AS INTEGER) n_reviews, string_agg(CAST(review_key AS VARCHAR), ',' ORDER BY review_key) keys
  FROM r GROUP BY 1, 2""")
def nested_user_documents(spark: SparkSession, sf: str) -> DataFrame:
    """User documents in bounded parts, as the nested sink writes them."""
    docs = user_documents(population(spark, sf), "user_id", ["review_key"],
                          ["review_key", "rating"], per_part=4)
    return docs.select("user_id", "part", F.size("reviews").alias("n_reviews"), F.array_join(F.transform(
        "reviews", lambda r: r["review_key"].cast("string")), ",").alias("keys"))


@query("top_spenders_per_tribe", f"""WITH {SQL.POP}, r AS (SELECT tribe_id, review_key, row_number() OVER (PARTITION BY tribe_id
    ORDER BY price DESC, review_key) r FROM pop) SELECT tribe_id, review_key FROM r WHERE r <= 10""")
def top_spenders_per_tribe(spark: SparkSession, sf: str) -> DataFrame:
    """Greedy top-M of a candidate set."""
    rows = keep_top(population(spark, sf), ["tribe_id"], [F.col("price").desc(), F.col("review_key")], 10)
    return rows.select("tribe_id", "review_key")


@query("coverage_cut", f"""WITH {SQL.POP}, u AS (SELECT tribe_id, user_id, count(*) c FROM pop GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER w r, sum(c) OVER (w ROWS UNBOUNDED PRECEDING) upto,
    sum(c) OVER (PARTITION BY tribe_id) n FROM u WINDOW w AS (PARTITION BY tribe_id ORDER BY c DESC, user_id)),
  s AS (SELECT *, min(CASE WHEN upto >= 0.5 * n AND r >= 3 THEN r END) OVER (PARTITION BY tribe_id) stop FROM r)
  SELECT tribe_id, user_id, CAST(r AS BIGINT) r FROM s WHERE r <= stop""")
def coverage_cut(spark: SparkSession, sf: str) -> DataFrame:
    """Users in order of activity until they cover half of a tribe's reviews, three users at least."""
    users = (population(spark, sf).groupBy("tribe_id", "user_id").agg(F.count(F.lit(1)).alias("c"))
             .withColumn("down", -F.col("c")))
    queued = rank_within(users, ["tribe_id"], [F.col("down"), F.col("user_id")], rank="r",
                         weight=F.col("c"), running="upto")
    totals = users.groupBy("tribe_id").agg(F.sum("c").alias("n"))
    rows = queued.join(totals, "tribe_id")
    stops = (rows.filter((F.col("upto") >= 0.5 * F.col("n")) & (F.col("r") >= 3)).groupBy("tribe_id")
             .agg(F.min("r").alias("stop")))
    return rows.join(stops, "tribe_id").filter(F.col("r") <= F.col("stop")).select("tribe_id", "user_id", "r")
