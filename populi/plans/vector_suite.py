"""Vectors, segments and tribes on the driver tables."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from populi.operators import cluster, fuzzy, similarity, tribes
from populi.plans.metrics_suite import brand_vectors
from populi.plans.testbed import SQL, query, rounded, sides, table

_PAIR = """n AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) e FROM embeddings
    UNION ALL SELECT vec_id + 1000000000000, [round(x, 1) FOR x IN CAST(embedding AS DOUBLE[])] FROM embeddings)"""


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector and a near copy of it, rounded to one digit: whole vectors seldom come near each other by themselves."""
    rows = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return rows.unionByName(rows.select(F.col("vec_id") + 1000000000000, F.transform("e", lambda x: F.round(x, 1))).toDF("vec_id", "e"))


@query("similar_neighbour_counts", f"""WITH {_PAIR}, p AS (SELECT a.vec_id x, b.vec_id y FROM n a JOIN n b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.8)
  SELECT vec_id, count(y) neighbours FROM n LEFT JOIN p ON x = vec_id GROUP BY 1""")
def similar_neighbour_counts(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.neighbour_counts(_vectors(spark, sf), "vec_id", "e", 0.8)


@query("similar_pairs", f"""WITH {_PAIR} SELECT a.vec_id a, b.vec_id b, round(list_cosine_similarity(a.e, b.e), 6) similarity FROM n a JOIN n b
  ON a.vec_id < b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.8""")
def similar_pairs(spark: SparkSession, sf: str) -> DataFrame:
    pairs = similarity.row_pairs(_vectors(spark, sf), "vec_id", "e", 0.8)
    return pairs.withColumn("similarity", F.round("similarity", 6))  # once, as its SQL does


@query("standardised_embeddings", """WITH u AS (SELECT vec_id, generate_subscripts(embedding, 1) d, CAST(unnest(embedding) AS DOUBLE) x FROM embeddings)
  SELECT vec_id, CAST(d - 1 AS INTEGER) dim, round((x - avg(x) OVER (PARTITION BY d)) / stddev_pop(x) OVER (PARTITION BY d), 5) z FROM u""")
def standardised_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    scaled = cluster.standardise(table(spark, sf, "embeddings"), "embedding")
    return rounded(scaled.select("vec_id", F.posexplode(vector_to_array("features")).alias("dim", "z")), 5)


@query("cluster_quality", """WITH u AS (SELECT vec_id, label, generate_subscripts(embedding, 1) d, CAST(unnest(embedding) AS DOUBLE) x FROM embeddings),
  c AS (SELECT label, d, avg(x) m FROM u GROUP BY 1, 2), g AS (SELECT d, avg(x) m FROM u GROUP BY 1),
  dist AS (SELECT vec_id, label, sum((x - m) * (x - m)) q FROM u JOIN c USING (label, d) GROUP BY 1, 2),
  s AS (SELECT label, avg(sqrt(q)) s, sum(q) w, count(*) n FROM dist GROUP BY 1), b AS (SELECT label, sum((c.m - g.m) * (c.m - g.m)) q FROM c JOIN g USING (d) GROUP BY 1),
  p AS (SELECT x.label a, y.label b, sqrt(sum((x.m - y.m) * (x.m - y.m))) d FROM c x JOIN c y ON x.d = y.d AND x.label <> y.label GROUP BY 1, 2),
  r AS (SELECT a, max((x.s + y.s) / d) r FROM p JOIN s x ON x.label = a JOIN s y ON y.label = b GROUP BY 1)
  SELECT count(*) k, CAST(sum(n) AS BIGINT) n, round((SELECT avg(r) FROM r), 6) davies_bouldin,
    round((sum(b.q * n) / (count(*) - 1)) / (sum(w) / (sum(n) - count(*))), 6) calinski_harabasz, round(min(n) / CAST(max(n) AS DOUBLE), 6) balance_ratio FROM s JOIN b USING (label)""")
def cluster_quality(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").withColumn("features", array_to_vector(F.col("embedding").cast("array<double>")))
    return rounded(cluster.cluster_quality(rows, "label", "features"))


@query("user_segments")
def user_segments(spark: SparkSession, sf: str) -> DataFrame:
    """K-means sweep and assignment; seeded initialisation is Spark's own, so there is no SQL twin."""
    users = table(spark, sf, "embeddings").withColumn("user_id", F.col("vec_id").cast("string"))
    rows = cluster.segment_users(users, "user_id", "embedding", min_k=2, max_k=5, n_init=2)
    return rows.groupBy("segment_id").agg(F.count(F.lit(1)).alias("n_users"), F.max("cluster_metadata.cluster_size").alias("cluster_size"),
                                          F.max("cluster_metadata.silhouette_score").alias("silhouette_score"))


@query("projected_embeddings")
def projected_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """First two principal components (sign and rotation are the solver's)."""
    scaled = cluster.standardise(table(spark, sf, "embeddings"), "embedding")
    return cluster.project_2d(scaled, "features").select("vec_id", "x", "y")


def tribe_users(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("user_id"), F.concat(F.lit("segment_"), "label").alias("segment_id"),
        F.col("vec_id").alias("position"), F.col("embedding").alias("user_embedding"), (F.col("vec_id") % 5).alias("n_reviews"))


TEST_RULE = tribes.TribeRule(threshold=0.2, min_users=2, max_users=5, min_reviews=3, coverage_goal=0.7, min_tribes=2)


def _greedy(name: str, start: str, rule: tribes.TribeRule) -> str:
    """The rule one seed after another: a row per segment and step k, with the members m of its seed."""
    goal = "len(done) >= n" if rule.is_relaxed else f"len(done) / n >= {rule.coverage_goal} AND formed >= {rule.min_tribes}"
    return f"""{name}_near AS (SELECT x.segment_id, x.position, list({{'s': s, 'v': y}} ORDER BY s DESC, y) vs FROM users x JOIN sims ON x.position = sims.x
      WHERE s >= {rule.threshold} GROUP BY 1, 2),
  {name} AS ({start} UNION ALL
    SELECT segment_id, k + 1, CASE WHEN ok THEN list_concat(done, list_transform(m, lambda q: q.v)) ELSE list_append(done, seed) END, formed + ok::INT, ok, m, n, positions
    FROM (SELECT *, len(m) >= {max(1, rule.min_users)} AND list_sum(list_transform(m, lambda q: q.v % 5)) >= {rule.min_reviews} ok
      FROM (SELECT t.segment_id, k, done, formed, n, positions, seed, list_filter(vs, lambda q: NOT list_contains(done, q.v))[1:{rule.max_users}] m
        FROM (SELECT *, list_min(list_filter(positions, lambda q: NOT list_contains(done, q))) seed FROM {name} WHERE NOT (ok AND {goal})) t
        JOIN {name}_near w ON w.segment_id = t.segment_id AND w.position = seed)))"""


_TRIBES = f"""WITH RECURSIVE users AS (SELECT 'segment_' || label segment_id, vec_id AS position, CAST(embedding AS DOUBLE[]) e FROM embeddings),
  sims AS (SELECT a.position x, b.position y, CASE WHEN a.position = b.position THEN 1 ELSE round(list_cosine_similarity(a.e, b.e), 12) END s
    FROM users a JOIN users b ON a.segment_id = b.segment_id),
  {_greedy('main', """SELECT segment_id, 0 k, []::BIGINT[] done, 0 formed, FALSE ok, []::STRUCT(s DOUBLE, v BIGINT)[] m, count(*) n, list(position) positions
    FROM users GROUP BY 1""", TEST_RULE)},
  {_greedy('again', """SELECT segment_id, 0 k, done, formed, FALSE ok, []::STRUCT(s DOUBLE, v BIGINT)[] m, n, positions
    FROM (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY k DESC) r FROM main) WHERE r = 1""", TEST_RULE.relaxed())},
  formed_tribes AS (SELECT segment_id, segment_id || '_micro_' || (formed - 1) tribe_id, m, FALSE relaxed_criteria FROM main WHERE ok
    UNION ALL SELECT segment_id, segment_id || '_relaxed_micro_' || (formed - 1), m, TRUE FROM again WHERE ok AND k > 0),
  members AS (SELECT CAST(q.v AS VARCHAR) user_id, segment_id, tribe_id, round(greatest(0, least(1, q.s)), 6) similarity_score, q.v AS position,
    count(*) OVER (PARTITION BY tribe_id) total_users, CAST(sum(q.v % 5) OVER (PARTITION BY tribe_id) AS BIGINT) total_reviews, relaxed_criteria
    FROM (SELECT *, unnest(m) q FROM formed_tribes))"""


@query("user_tribes", f"{_TRIBES} SELECT * FROM members")
def user_tribes(spark: SparkSession, sf: str) -> DataFrame:
    """Greedy tribes in parallel rounds; the SQL plays the rule seed by seed."""
    return rounded(tribes.form_tribes(tribe_users(spark, sf), TEST_RULE))


@query("tribe_reviews", f"""{_TRIBES}, d AS (SELECT doc_id, text, CAST(doc_id % (SELECT count(*) FROM embeddings) AS VARCHAR) user_id FROM documents),
  r AS (SELECT tribe_id, count(*) n_reviews, arg_min(doc_id, (position, doc_id)) first_doc FROM members JOIN d USING (user_id) GROUP BY 1),
  l AS (SELECT user_id, max(length(text)) n FROM d GROUP BY 1 HAVING max(length(trim(text))) > 0)
  SELECT r.*, (SELECT CAST(sum(n) AS BIGINT) FROM members JOIN l USING (user_id) WHERE members.tribe_id = r.tribe_id) n_chars FROM r""")
def tribe_reviews(spark: SparkSession, sf: str) -> DataFrame:
    """Reviews of each tribe, the first in member and review order, and the characters of its users' longest texts."""
    members = tribes.form_tribes(tribe_users(spark, sf), TEST_RULE)
    docs = table(spark, sf, "documents")
    user = (F.col("doc_id") % table(spark, sf, "embeddings").count()).cast("string").alias("user_id")
    kept = tribes.tribe_reviews(members, docs.select(user, "doc_id"), "doc_id").groupBy("tribe_id").agg(
        F.count(F.lit(1)).alias("n_reviews"), F.max_by("doc_id", -F.col("review_no")).alias("first_doc"))
    longest = docs.groupBy(user).agg(F.max_by("text", F.struct(F.length("text"), "doc_id")).alias("summary"))
    text = tribes.tribe_summaries(members, longest).groupBy("tribe_id").agg(F.sum(F.length("summary")).alias("n_chars"))
    return kept.join(text, "tribe_id", "left")


_WEIGHTED = f"""{SQL.SIDES}, v AS (SELECT DISTINCT p_brand t, CAST(embedding AS DOUBLE[]) e FROM part JOIN embeddings ON vec_id = CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT))"""


@query("weighted_topic_vectors", f"""WITH {_WEIGHTED}, d AS (SELECT k, a, generate_subscripts(e, 1) - 1 dim, unnest(e) x FROM sides JOIN v USING (t)),
  n AS (SELECT k, count(DISTINCT t) n FROM sides JOIN v USING (t) GROUP BY 1)
  SELECT k, CAST(dim AS INTEGER) dim, round(sum(a * x) / sum(a), 6) + 0.0 x, n n_themes FROM d JOIN n USING (k) GROUP BY 1, 2, 4""")
def weighted_topic_vectors(spark: SparkSession, sf: str) -> DataFrame:
    probs = sides(spark, sf).repartition("k").groupBy("k", F.col("t").alias("theme")).agg(F.sum("a").alias("p"))
    rows = cluster.weighted_topic_vectors(probs, brand_vectors(spark, sf), "k")
    return rounded(rows.select("k", F.posexplode("topic_vector").alias("dim", "x"), "n_themes"))


@query("attached_theme_vectors", f"""WITH {_WEIGHTED} SELECT k, CAST(count(*) AS INTEGER) n_themes, CAST(count(e) FILTER (WHERE t <> 'Brand#7') AS INTEGER) n_vectors, sum(a) mass FROM sides LEFT JOIN v USING (t) GROUP BY k""")
def attached_theme_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """One brand has no vector."""
    probs = sides(spark, sf).repartition("k").groupBy("k", F.col("t").alias("theme")).agg(F.sum("a").alias("p"))
    vectors = brand_vectors(spark, sf).filter(F.col("theme") != "Brand#7")
    entries = F.map_values("theme_vectors")
    rows = cluster.attach_theme_vectors(probs, vectors, "k")
    return rows.select("k", F.size("theme_vectors").alias("n_themes"), F.size(F.filter(entries, lambda e: e["embedding"].isNotNull())).alias("n_vectors"),
                       F.aggregate(entries, F.lit(0.0), lambda acc, e: acc + e["probability"]).alias("mass"))


@query("theme_cost_rows", f"""WITH {_WEIGHTED}, c AS (SELECT x.t theme, CASE WHEN x.t = y.t THEN 0 ELSE greatest(0, 1 - list_cosine_similarity(x.e, y.e)) END cost FROM v x CROSS JOIN v y)
  SELECT theme, count(*) n_topics, round(min(cost), 6) + 0.0 nearest, round(avg(cost), 6) mean_cost FROM c GROUP BY 1""")
def theme_cost_rows(spark: SparkSession, sf: str) -> DataFrame:
    vectors = brand_vectors(spark, sf)
    names = vectors.select(F.lit("all").alias("category"), "theme")
    topics = names.withColumn("pos", F.regexp_extract("theme", r"(\d+)", 1).cast("int"))
    rows = fuzzy.theme_costs(names, topics, vectors)
    costs = F.transform("costs", lambda c: c["cost"])
    return rounded(rows.select("theme", F.size("costs").cast("long").alias("n_topics"), F.array_min(costs).alias("nearest"),
                               (F.aggregate(costs, F.lit(0.0), lambda a, c: a + c) / F.size("costs")).alias("mean_cost")))
