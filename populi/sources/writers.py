"""Sinks: nested JSON, JSON lines, parquet, CSV grids, partitioned layouts and reject tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from populi.operators.clean import nan_to_null
from populi.operators.groups import rank_within


def user_documents(reviews: DataFrame, user: str, order: Sequence[str], fields: Sequence[str],
                   per_part: int = 10_000) -> DataFrame:
    """(user, part, reviews array): a user's reviews in order, in parts of bounded size so that no user is too large."""
    ranked = rank_within(reviews, [user], [F.col(c) for c in order], rank="__rank")
    rows = ranked.withColumn("part", F.floor((F.col("__rank") - 1) / F.lit(per_part)).cast("int"))
    entry = F.struct(F.col("__rank").alias("r"), F.struct(*fields).alias("v"))
    packed = rows.groupBy(user, "part").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    return packed.select(user, "part", F.transform("e", lambda x: x["v"]).alias("reviews"))


def write_objects(df: DataFrame, key: str, record: Column, path: str, partition_by: Sequence[str] = (), mode: str = "error") -> None:
    """{key: record} files: one object a task with an entry a line or, laid out in folders by key, one object a line."""
    folders = list(partition_by)
    name = F.regexp_extract(F.to_json(F.struct(F.col(key).cast("string").alias("k"))), r'^\{"k":(.*)\}$', 1)  # with its quotes
    rows = df.select(*folders, F.concat(name, F.lit(": "), F.to_json(record)).alias("value"))
    if folders:
        rows = rows.withColumn("value", F.concat(F.lit("{"), "value", F.lit("}"))).hint("rebalance", *folders)
        return rows.write.mode(mode).partitionBy(*folders).text(path)

    def object_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line = lambda before, entries, after: pa.RecordBatch.from_arrays([pc.binary_join_element_wise(before, entries, after, "")], names=["value"])
        before, waiting = "{", None
        for batch in batches:
            if batch.num_rows:
                entries = batch.column(0)
                if waiting is not None:
                    yield line(before, waiting, ",")
                    before = ""
                if batch.num_rows > 1:
                    yield line(before, entries[:1], ",")
                    yield line("", entries[1:-1], ",")
                    before = ""
                waiting = entries[-1:]
        if waiting is not None:
            yield line(before, waiting, "}")
    rows.mapInArrow(object_lines, "value string").write.mode(mode).text(path)


def write_json(df: DataFrame, path: str, mode: str = "error") -> None:
    """JSON lines; NaN and infinite values are written as missing."""
    nan_to_null(df).write.mode(mode).option("ignoreNullFields", "true").json(path)


def append_json(df: DataFrame, path: str) -> None:
    write_json(df, path, "append")


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "error") -> None:
    """Parquet, on request laid out by key. Rows are spread by key first, so a key makes few files; AQE splits hot keys."""
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_grid(grid: DataFrame, keys: Sequence[str], value: str, path: str, last: int = 12, mode: str = "error") -> None:
    """One CSV row per review with columns I0..I<last>."""
    wide = (grid.withColumn("__i", F.concat(F.lit("I"), "iteration")).groupBy(*keys)
            .pivot("__i", [f"I{i}" for i in range(last + 1)]).agg(F.first(value)))
    wide.write.mode(mode).option("header", True).csv(path)


def write_with_rejects(tagged: DataFrame, path: str, reject_path: str, reason: str = "reason",
                       mode: str = "error") -> None:
    """Rows without a reason to one place, rows with one to another."""
    write_json(tagged.filter(F.col(reason).isNull()).drop(reason), path, mode)
    write_json(tagged.filter(F.col(reason).isNotNull()), reject_path, mode)
