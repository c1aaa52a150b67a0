"""Resumable runs on the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from populi.operators import clean, match
from populi.plans.testbed import query, table
from populi.session import ensure_checkpoint_dir
from populi.streaming.incremental import cache_hits_and_misses, merge_failures, run_available, score_batches


@query("unprocessed_reviews", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unprocessed_reviews(spark: SparkSession, sf: str) -> DataFrame:
    return match.unprocessed(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id").select("doc_id", "lang")


@query("embedding_cache", """SELECT doc_id, lang, CASE WHEN quality IS NULL THEN 'miss' ELSE 'hit' END outcome, quality AS "value" FROM documents LEFT JOIN labels USING (doc_id)""")
def embedding_cache(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "documents").select("doc_id", "lang")
    cache = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("value"))
    hits, misses = cache_hits_and_misses(items, cache, ["doc_id"])
    return (hits.withColumn("outcome", F.lit("hit")).unionByName(misses.withColumn("outcome", F.lit("miss")), allowMissingColumns=True)
            .select("doc_id", "lang", "outcome", "value"))


@query("merged_failures", """WITH l AS (SELECT DISTINCT user_id, event_type FROM events WHERE value > 150), n AS (SELECT DISTINCT user_id, event_type FROM events WHERE value BETWEEN 100 AND 200)
  SELECT user_id, event_type, 'logged' origin FROM l UNION ALL SELECT user_id, event_type, 'new' FROM n WHERE (user_id, event_type) NOT IN (SELECT user_id, event_type FROM l)""")
def merged_failures(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("user_id", "event_type", "value")
    log = rows.filter(F.col("value") > 150).select("user_id", "event_type", F.lit("logged").alias("origin"))
    new = rows.filter(F.col("value").between(100, 200)).select("user_id", "event_type", F.lit("new").alias("origin"))
    return merge_failures(log, new, ["user_id", "event_type"])


@query("streamed_clean_reviews", """SELECT doc_id, lang, length(text) n_text FROM documents WHERE trim(text) <> '' AND source IS NOT NULL""")
def streamed_clean_reviews(spark: SparkSession, sf: str) -> DataFrame:
    """Documents followed as a stream, cleaned and appended by the file sink in the shared folder, then read back."""
    ensure_checkpoint_dir(spark)
    place = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(table(spark, sf, "documents").schema).parquet(f"{sf}/documents*.parquet")
    tagged = stream.withColumn("reason", clean.pollution_reason(F.col("text"), F.col("source")))
    good = tagged.filter(F.col("reason").isNull()).select("doc_id", "lang", F.length("text").cast("long").alias("n_text"))
    run_available(good, f"{place}/rows", f"{place}/state", "parquet")
    return spark.read.schema("doc_id long, lang string, n_text long").parquet(f"{place}/rows")


@query("scored_batches", "SELECT doc_id, length(text) AS score FROM documents")
def scored_batches(spark: SparkSession, sf: str) -> DataFrame:
    """The hook for a user's own batch model, here a text length."""
    def lengths(batches):
        for part in batches:
            yield part.assign(score=part["text"].str.len())[["doc_id", "score"]]
    return score_batches(table(spark, sf, "documents").select("doc_id", "text"), lengths, "doc_id long, score long")
