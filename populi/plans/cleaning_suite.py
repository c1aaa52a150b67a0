"""Cleaning, validation and deduplication on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from populi import schema
from populi.functions import dist, text
from populi.functions.base import present
from populi.operators import clean, rollup
from populi.plans.testbed import SQL, population, query, rounded, sides, table
from populi.sources.readers import category_texts, flatten_users
from populi.sources.writers import user_documents


@query("unified_ids", """SELECT o_orderkey, coalesce(nullif(CASE WHEN o_orderstatus = 'F' THEN '' ELSE CAST(o_custkey AS VARCHAR) END, ''), 'u' || o_custkey)
  user_id, coalesce(CASE WHEN o_orderstatus = 'O' THEN 'P' || o_orderkey END, 'A' || o_orderkey) asin FROM orders""")
def unified_ids(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "F", "").otherwise(F.col("o_custkey").cast("string")).alias("reviewerID"),
        F.concat(F.lit("u"), "o_custkey").alias("user_id"), F.concat(F.lit("A"), "o_orderkey").alias("asin"),
        F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("P"), "o_orderkey")).alias("parent_asin"))
    return clean.unify_ids(raw).select("o_orderkey", "user_id", "asin")


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("review_key"), F.col("l_linenumber").alias("line"),
        F.col("l_partkey").cast("string").alias("asin"))


@query("attached_products", """WITH p AS (SELECT CAST(p_partkey AS VARCHAR) asin, p_name title, p_type main_category,
    CASE WHEN p_size <= 10 THEN '' WHEN p_size <= 20 THEN '[]' WHEN p_size <= 30 THEN NULL ELSE p_brand || ' ' || p_name END description FROM part)
  SELECT coalesce(main_category, 'None') category, count(*) n, count(DISTINCT CASE WHEN description IS NULL OR trim(description) = '' OR description = '[]'
    THEN title ELSE description END) n_descriptions FROM lineitem LEFT JOIN p ON CAST(l_partkey AS VARCHAR) = asin GROUP BY 1""")
def attached_products(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    product = table(spark, sf, "part").select(
        F.lit(None).cast("string").alias("parent_asin"), F.col("p_partkey").cast("string").alias("asin"),
        F.col("p_name").alias("title"), F.col("p_type").alias("main_category"),
        F.when(size <= 10, "").when(size <= 20, "[]").when(size > 30, F.concat_ws(" ", "p_brand", "p_name"))
        .alias("description"), F.col("p_partkey").alias("pos"))
    lines = _lines(spark, sf)
    rows = clean.with_valid_description(clean.attach_product(lines, clean.needed_products(product, lines), "None"))
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("product_description").alias("n_descriptions"))


@query("new_keys_only", """WITH f AS (SELECT l_partkey, l_suppkey, min(l_orderkey * 100 + l_linenumber) pos FROM lineitem
    WHERE l_returnflag <> 'R' GROUP BY 1, 2)
  SELECT l_partkey, l_suppkey, pos FROM f WHERE (l_partkey, l_suppkey) NOT IN
    (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R')""")
def new_keys_only(spark: SparkSession, sf: str) -> DataFrame:
    """First row of each (product, supplier) that the existing data lacks."""
    rows = table(spark, sf, "lineitem").select(
        "l_partkey", "l_suppkey", "l_returnflag", (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("pos"))
    old = F.col("l_returnflag") == "R"
    return clean.new_rows(rows.filter(~old).drop("l_returnflag"), ["l_partkey", "l_suppkey"], rows.filter(old), ["pos"])


@query("prediction_duplicates", """SELECT lang, source, md5(text) text_md5, min(doc_id) doc_id FROM documents GROUP BY 1, 2, 3""")
def prediction_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    rows = clean.prediction_duplicates_removed(table(spark, sf, "documents"), "text", "lang", "source", "doc_id")
    return rows.select("lang", "source", F.md5("text").alias("text_md5"), "doc_id")


@query("task_duplicates", """SELECT user_id, event_type, CAST(ts AS DATE) AS "day", min(event_id) event_id FROM events GROUP BY 1, 2, 3, props""")
def task_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    kept = clean.task_duplicates_removed(rows, "user_id", "event_type", "day", "props", "event_id")
    return kept.select("user_id", "event_type", "day", "event_id")


_POLLUTED = """CASE WHEN trim(CASE WHEN quality = 0 THEN '  ' ELSE text END) = '' THEN 'missing_or_empty_review_text'
  WHEN source = 'src7' THEN 'missing_user_id' END"""


def _polluted(spark: SparkSession, sf: str) -> DataFrame:
    """Documents labelled as bad have blank text; one source is not known."""
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return rows.select("doc_id", F.when(F.col("quality") == 0, "  ").otherwise(F.col("text")).alias("text"),
                       F.when(F.col("source") != "src7", F.col("source")).alias("user_id"))


@query("polluted_split", f"""SELECT coalesce({_POLLUTED}, 'valid') outcome, count(*) n, CAST(sum(doc_id) AS BIGINT) ids
  FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def polluted_split(spark: SparkSession, sf: str) -> DataFrame:
    good, bad = clean.split_by_reason(_polluted(spark, sf), clean.pollution_reason(F.col("text"), F.col("user_id")))
    both = good.withColumn("outcome", F.lit("valid")).unionByName(bad.withColumnRenamed("reason", "outcome"))
    return both.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


@query("user_validity", f"""WITH d AS (SELECT coalesce(CASE WHEN source <> 'src7' THEN source END, '') user_id, trim(CASE WHEN quality = 0 THEN '  ' ELSE text END) <> '' ok
    FROM documents LEFT JOIN labels USING (doc_id))
  SELECT user_id, count(*) n_reviews, CASE WHEN user_id = '' THEN 'invalid_user_id' WHEN NOT bool_or(ok) THEN 'no_review_text' END reason FROM d GROUP BY 1""")
def user_validity(spark: SparkSession, sf: str) -> DataFrame:
    rows = _polluted(spark, sf).withColumn("user_id", F.coalesce("user_id", F.lit("")))
    return clean.user_validity(rows, "user_id", "text")


@query("themed_reviews", """SELECT l_orderkey k, count(DISTINCT p_brand) FILTER (WHERE l_returnflag = 'A') n_themes FROM lineitem JOIN part ON l_partkey = p_partkey
  GROUP BY 1 HAVING n_themes > 0""")
def themed_reviews(spark: SparkSession, sf: str) -> DataFrame:
    rows = sides(spark, sf).groupBy("k").agg(F.collect_set(F.when(F.col("flag") == "A", F.col("t"))).alias("themes"))
    return clean.themed_reviews(rows).select("k", F.size("themes").cast("long").alias("n_themes"))


@query("positive_entries", """WITH s AS (SELECT l_orderkey k, p_brand t, sum(l_discount) p FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
  SELECT k, count(*) FILTER (WHERE p > 0) n_positive, count(*) n_all FROM s GROUP BY 1""")
def positive_entries(spark: SparkSession, sf: str) -> DataFrame:
    discount = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    summed = discount.groupBy(F.col("l_orderkey").alias("k"), F.col("p_brand").alias("t")).agg(F.sum("l_discount").alias("p"))
    maps = summed.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("t", "p"))).alias("m"))
    return maps.select("k", F.size(dist.positive_entries(F.col("m"))).cast("long").alias("n_positive"),
                       F.size("m").cast("long").alias("n_all"))


@query("finite_values", """WITH e AS (SELECT event_id, event_type, value, CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'view' THEN NULL ELSE value END v FROM events)
  SELECT event_type, count(v) n_finite, round(avg(v), 6) mean_value FROM e GROUP BY 1""")
def finite_values(spark: SparkSession, sf: str) -> DataFrame:
    """NaN and infinite values become null."""
    raw = F.when(F.col("event_type") == "error", float("nan")).when(F.col("event_type") == "view", float("inf")).otherwise(F.col("value"))
    rows = clean.nan_to_null(table(spark, sf, "events").select("event_type", raw.alias("v")))
    return rounded(rows.groupBy("event_type").agg(F.count("v").alias("n_finite"), F.avg("v").alias("mean_value")))


@query("cluster_filter", """SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (3, 11, 20)""")
def cluster_filter(spark: SparkSession, sf: str) -> DataFrame:
    named = table(spark, sf, "customer").withColumn("cluster", F.concat(
        F.when(F.col("c_nationkey") < 10, "cluster_").when(F.col("c_nationkey") < 20, "segment_").otherwise(""), "c_nationkey"))
    return clean.in_clusters(named, "cluster", ["cluster_3", "segment_11", 20]).select("c_custkey", "c_nationkey")


@query("review_history_rows", f"""WITH d AS (SELECT source user_id, doc_id, CASE WHEN quality = 0 THEN '' ELSE text END text FROM documents LEFT JOIN labels USING (doc_id))
  SELECT user_id, count(*) n FROM d WHERE trim(text) <> '' GROUP BY 1""")
def review_history_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").select(
        F.col("source").alias("user_id"), F.col("lang").alias("product_description"),
        F.when(F.col("quality") == 0, "").otherwise(F.col("text")).alias("review_text"))
    return clean.history_rows(rows).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("validated_predictions", """WITH r AS (SELECT e.event_id, value / 100 text_delta, CAST(1 + user_id % 6 AS INTEGER) AS iteration, event_type FROM events e)
  SELECT text_delta > 1 bad_delta, event_type = 'error' bad_user, count(*) n FROM r GROUP BY 1, 2""")
def validated_predictions(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select(
        F.when(F.col("event_type") != "error", F.col("user_id").cast("string")).alias("user_id"),
        F.col("event_id").cast("string").alias("review_id"), (F.col("value") / 100).alias("text_delta"),
        F.lit(0.5).alias("theme_delta"), F.lit(0.5).alias("overall_behavior_loss"), F.lit(1.0).alias("overall_accuracy"),
        (F.lit(1) + F.col("user_id") % 6).alias("iteration"))
    tagged = schema.validate(rows, "behavior_loss")
    return tagged.groupBy(F.array_contains("broken_rules", "text_delta_in_0_1").alias("bad_delta"),
                          F.array_contains("broken_rules", "user_id_present").alias("bad_user")).agg(F.count(F.lit(1)).alias("n"))


@query("validated_embeddings", "SELECT len(embedding) = 64 AND len(embedding) > 0 valid, count(*) n FROM embeddings GROUP BY 1")
def validated_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("user_id"), F.col("embedding").alias("user_embedding"),
        F.lit(64).alias("embedding_dimension"))
    good, bad = schema.valid_and_rejected(rows, "user_embedding")
    tag = lambda df, ok: df.select(F.lit(ok).alias("valid"))
    return tag(good, True).unionByName(tag(bad, False)).groupBy("valid").agg(F.count(F.lit(1)).alias("n"))


@query("category_whitelist", f"WITH {SQL.POP} SELECT category, count(*) n FROM pop WHERE category IN ('1-URGENT', '2-HIGH') GROUP BY 1")
def category_whitelist(spark: SparkSession, sf: str) -> DataFrame:
    rows = clean.in_categories(population(spark, sf), "category", ["1-URGENT", "2-HIGH"])
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("required_themes", """WITH s AS (SELECT l_orderkey k, count(*) FILTER (WHERE l_returnflag = 'N') n FROM lineitem GROUP BY 1)
  SELECT CASE WHEN n = 0 THEN 'missing_themes' ELSE 'matched' END outcome, count(*) n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) pct FROM s GROUP BY 1""")
def required_themes(spark: SparkSession, sf: str) -> DataFrame:
    entries = F.collect_list(F.when(F.col("flag") == "N", F.struct("t", "c")))
    merged = sides(spark, sf).groupBy("k", "t").agg(
        F.max(F.when(F.col("flag") == "N", F.col("c"))).alias("c")).withColumn("flag", F.when(F.col("c").isNotNull(), "N"))
    rows = merged.groupBy("k").agg(F.map_from_entries(entries).alias("themes"))
    return rounded(rollup.reason_counts(clean.require_themes(rows, "themes")))


@query("flattened_user_documents", f"""WITH {SQL.POP} SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY review_key) - 1 AS INTEGER) review_idx,
  review_key, category FROM pop WHERE sentiment <> 'Negative'""")
def flattened_user_documents(spark: SparkSession, sf: str) -> DataFrame:
    """{{user: {{reviews: [...]}}}} documents flattened again; pending reviews have blank text and are dropped."""
    kept = population(spark, sf).filter(F.col("sentiment") != "Negative")
    docs = user_documents(kept, "user_id", ["review_key"], ["review_key", "category"], 1000)
    users = docs.select("part", F.create_map("user_id", F.struct("reviews")).alias("users"))
    return flatten_users(users, "part").select("user_id", (F.col("part") * 1000 + F.col("review_idx")).alias("review_idx"),
                                               "review_key", "category")


@query("category_text_pool", """SELECT lang, count(*) n, CAST(sum(length(trim(text))) AS BIGINT) n_chars FROM documents WHERE trim(text) <> '' AND lang = 'en' GROUP BY 1""")
def category_text_pool(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select(F.col("lang").alias("category"), F.col("text").alias("review_text"))
    texts = category_texts(rows.filter(present(F.col("review_text"))), "en")
    return texts.agg(F.lit("en").alias("lang"), F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("n_chars")).select(
        "lang", "n", "n_chars")


@query("review_ids", """SELECT doc_id, source || '_' || lang || '_unknown_' || md5(text) review_id FROM documents""")
def review_ids(spark: SparkSession, sf: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return table(spark, sf, "documents").select("doc_id", text.review_id(F.col("source"), F.col("lang"), none, F.col("text"))
                                                .alias("review_id"))
