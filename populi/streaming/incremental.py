"""Incremental runs: Structured Streaming for arriving files, and anti-join work lists for tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from populi.schema import CLASSIFICATION


def follow_json(spark: SparkSession, path: str, ddl: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(ddl)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).json(path)


def run_available(stream: DataFrame, path: str, checkpoint: str, file_format: str = "json") -> StreamingQuery:
    """Process what has arrived since the last run, then stop; the file sink and checkpoint make it exactly-once."""
    query = (stream.writeStream.format(file_format).option("path", path).option("checkpointLocation", checkpoint)
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    return query


def append_tagged(spark: SparkSession, source: str, sink: str, rejects: str, checkpoint: str,
                  transform: Callable[[DataFrame], DataFrame], ddl: str = CLASSIFICATION) -> None:
    """Clean arriving rows with a stateless transform that adds `reason`; good and rejected rows go to own sinks."""
    tagged = transform(follow_json(spark, source, ddl))
    run_available(tagged.filter(F.col("reason").isNull()).drop("reason"), sink, checkpoint + "/rows")
    run_available(tagged.filter(F.col("reason").isNotNull()), rejects, checkpoint + "/rejects")


def append_once(spark: SparkSession, source: str, sink: str, rejects: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame],
                keys: Sequence[str], ddl: str = CLASSIFICATION, event_time: str | None = None, delay: str = "7 days") -> None:
    """append_tagged from a single read, and every key once over all runs, however often files repeat it.

    The keys seen are the stream's state; with an event time only those of the last `delay` are kept. A batch writes good
    and rejected rows to folders of its own number and overwrites them when it is repeated after a failure."""
    arriving = follow_json(spark, source, ddl)
    if event_time is None:
        fresh = arriving.dropDuplicates(list(keys))
    else:
        fresh = arriving.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys))

    def both(batch: DataFrame, number: int) -> None:
        tagged = transform(batch).persist()
        tagged.filter(F.col("reason").isNull()).drop("reason").write.mode("overwrite").json(f"{sink}/batch={number}")
        tagged.filter(F.col("reason").isNotNull()).write.mode("overwrite").json(f"{rejects}/batch={number}")
        tagged.unpersist()
    query = (fresh.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()


def _single(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: of several the smallest by all other columns, the same in every run."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    return df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__row")).select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest])


def cache_hits_and_misses(items: DataFrame, cache: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(items with their cached value, items still to be computed). cache: keys and value."""
    known = _single(cache, keys)
    return items.join(known, keys), items.join(known.select(*keys), keys, "left_anti")


def merge_failures(log: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Failure log with the new failures, one row per key; a logged row stays."""
    fresh = _single(new, keys).join(log.select(*keys), keys, "left_anti")
    return _single(log, keys).unionByName(fresh)


def score_batches(df: DataFrame, fn, ddl: str) -> DataFrame:
    """Run a user's batch model over Arrow batches: fn maps an iterator of pandas frames to frames of the given columns."""
    return df.mapInPandas(fn, ddl)
