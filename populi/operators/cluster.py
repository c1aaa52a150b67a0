"""Segments: standardised embeddings, a k-means sweep, quality measures and the assignment table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from populi.session import written


def standardise(df: DataFrame, vector: str, output: str = "features") -> DataFrame:
    """Zero mean and unit population deviation per dimension, as an ml vector; Spark's scaler divides by the sample
    deviation, hence the factor."""
    prepared = df.withColumn("__v", array_to_vector(F.col(vector).cast("array<double>")))
    model = StandardScaler(inputCol="__v", outputCol="__s", withMean=True, withStd=True).fit(prepared)
    n = prepared.count()
    factor = F.lit((n / (n - 1)) ** 0.5 if n > 1 else 1.0)
    scaled = F.transform(vector_to_array("__s"), lambda x: x * factor)
    return model.transform(prepared).withColumn(output, array_to_vector(scaled)).drop("__v", "__s")


def _squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, v: acc + v)


def centroids(df: DataFrame, label: str, features: str) -> DataFrame:
    """(label, size, centroid array): one row per cluster."""
    return (df.groupBy(label).agg(F.count(F.lit(1)).alias("size"), Summarizer.mean(F.col(features)).alias("__c"))
            .select(label, "size", vector_to_array("__c").alias("centroid")))


def cluster_quality(df: DataFrame, label: str, features: str) -> DataFrame:
    """One row: k, n, Davies-Bouldin, Calinski-Harabasz and the smallest-to-largest size ratio.

    Rows meet only their own centroid; the k centroids (k is small) are compared inside one array."""
    centers = centroids(df, label, features)
    overall = df.agg(vector_to_array(Summarizer.mean(F.col(features))).alias("m")).scalar()
    gap = _squared_distance(vector_to_array(features), F.col("centroid"))
    spread = (df.join(F.broadcast(centers), label)  # k rows
              .select(label, "size", "centroid", gap.alias("g"))
              .groupBy(label).agg(F.avg(F.sqrt("g")).alias("s"), F.sum("g").alias("w"), F.first("size").alias("size"),
                                  F.first("centroid").alias("c")))
    between = F.col("size") * _squared_distance(F.col("c"), F.col("__m"))
    folded = (spread.withColumn("__m", overall)
              .agg(F.collect_list(F.struct("s", "c")).alias("cs"), F.sum("w").alias("w"), F.sum(between).alias("b"),
                   F.sum("size").alias("n"), F.count(F.lit(1)).alias("k"), F.min("size").alias("lo"),
                   F.max("size").alias("hi")))
    distance = lambda i, j: F.sqrt(_squared_distance(i["c"], j["c"]))
    worst = F.transform("cs", lambda i: F.array_max(F.transform(
        F.filter("cs", lambda j: distance(i, j) > 0), lambda j: (i["s"] + j["s"]) / distance(i, j))))
    db = F.aggregate(worst, F.lit(0.0), lambda acc, v: acc + v) / F.col("k")
    ch = F.when((F.col("k") > 1) & (F.col("w") > 0),
                (F.col("b") / (F.col("k") - 1)) / (F.col("w") / (F.col("n") - F.col("k"))))
    return folded.select("k", "n", F.when(F.col("k") > 1, db).alias("davies_bouldin"), ch.alias("calinski_harabasz"),
                         (F.col("lo") / F.col("hi")).alias("balance_ratio"))


def _fit(df: DataFrame, features: str, k: int, seed: int, n_init: int):
    models = [KMeans(k=k, seed=seed + i, featuresCol=features, predictionCol="cluster").fit(df) for i in range(n_init)]
    return min(models, key=lambda m: m.summary.trainingCost)


def sweep(df: DataFrame, features: str, ks: Sequence[int], *, seed: int = 42, n_init: int = 10) -> list[dict]:
    """Quality of the best of n_init k-means runs for every k. The silhouette is Spark's, on squared distances."""
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        results = []
        for k in ks:
            model = _fit(cached, features, k, seed, n_init)
            assigned = model.transform(cached)
            quality = cluster_quality(assigned, "cluster", features).first()
            if quality["k"] < 2:
                continue
            silhouette = ClusteringEvaluator(featuresCol=features, predictionCol="cluster").evaluate(assigned)
            results.append({**quality.asDict(), "k": k, "silhouette": silhouette, "model": model})
        return results
    finally:
        cached.unpersist()


def choose_k(results: Sequence[dict], target: int | None = None, min_silhouette: float = 0.4,
             min_balance: float = 0.1) -> dict:
    """The target k when it is good enough, else the k of best silhouette (the smaller k wins a tie)."""
    wanted = next((r for r in results if r["k"] == target), None)
    if wanted and wanted["silhouette"] > min_silhouette and wanted["balance_ratio"] > min_balance:
        return wanted
    return max(results, key=lambda r: (r["silhouette"], -r["k"]))


def segment_users(df: DataFrame, user: str, vector: str, *, min_k: int = 2, max_k: int = 11, target: int | None = None,
                  seed: int = 42, n_init: int = 10, min_silhouette: float = 0.4,
                  min_balance: float = 0.1) -> DataFrame:
    """segment_id per user with the clustering's quality, from a k-means sweep on standardised embeddings."""
    scaled = standardise(df, vector)
    top = min(max_k, scaled.count() - 1)
    best = choose_k(sweep(scaled, "features", range(min_k, top + 1), seed=seed, n_init=n_init), target, min_silhouette,
                    min_balance)
    assigned = best["model"].transform(scaled)
    sizes = assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("cluster_size"))
    return (assigned.join(F.broadcast(sizes), "cluster")  # k rows
            .select(user, F.concat(F.lit("segment_"), "cluster").alias("segment_id"),
                    F.lit(None).cast("string").alias("segment_name"), F.col(vector).alias("user_embedding"),
                    F.struct(F.lit(best["silhouette"]).alias("silhouette_score"), "cluster_size",
                             F.lit(best["davies_bouldin"]).alias("davies_bouldin_score"),
                             F.lit(best["balance_ratio"]).alias("balance_ratio")).alias("cluster_metadata")))


def project_2d(df: DataFrame, features: str) -> DataFrame:
    """x, y of the first two principal components, for inspection only."""
    model = PCA(k=2, inputCol=features, outputCol="__xy").fit(df)
    xy = vector_to_array("__xy")
    return model.transform(df).withColumns({"x": F.get(xy, 0), "y": F.get(xy, 1)}).drop("__xy")


def _theme_vectors(vectors: DataFrame) -> DataFrame:
    """theme, vector with one row per theme; of several the smallest stands.

    A written table has a known size: Spark broadcasts it when that allows, and reviews stay where they are."""
    return written(vectors.groupBy("theme").agg(F.min(F.col("vector").cast("array<double>")).alias("vector")))


def weighted_topic_vectors(probs: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Probability-weighted mean of the theme vectors of each review. vectors: theme, vector, all of one length."""
    ready = _theme_vectors(vectors)
    length = ready.agg(F.max(F.size("vector"))).first()[0] or 0
    joined = probs.filter(F.col("p") > 0).join(ready.filter(F.col("vector").isNotNull()), "theme")
    sums = [F.sum(F.col("p") * F.get("vector", i)).alias(f"__s{i}") for i in range(length)]
    mean = F.array(*[F.col(f"__s{i}") / F.col("__w") for i in range(length)]).cast("array<double>")
    return joined.groupBy(key).agg(F.sum("p").alias("__w"), F.count(F.lit(1)).alias("n_themes"), *sums).select(
        key, mean.alias("topic_vector"), "n_themes")


def attach_theme_vectors(probs: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """map<theme, struct<probability, embedding>> of each review; a theme without a vector has a null one."""
    joined = probs.join(_theme_vectors(vectors), "theme", "left")
    entry = F.struct(F.col("theme").alias("key"), F.struct(F.col("p").alias("probability"),
                                                           F.col("vector").alias("embedding")).alias("value"))
    return joined.groupBy(key).agg(F.map_from_entries(F.collect_list(entry)).alias("theme_vectors"))
