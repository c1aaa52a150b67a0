"""Tables, the shared scratch folder and small Arrow helpers of the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Parquet tables of one operator run, in the shared folder that spark.checkpoint.dir names.

    Reading a written table cuts the lineage, and a lost executor costs its running tasks only. Tables that later steps
    no longer need are dropped; those behind a returned DataFrame stay, as it is evaluated later. Only a local session
    without the setting (as in tests) gets a folder of its own."""

    def __init__(self, spark: SparkSession, name: str):
        root = spark.conf.get("spark.checkpoint.dir", None)
        if root is None:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a shared folder")
            root = tempfile.mkdtemp(prefix="populi-llm-")
            spark.conf.set("spark.checkpoint.dir", root)
        self.spark, self.root = spark, f"{root.rstrip('/')}/populi-{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def per_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table], rows: int = 10_000) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adapter for mapInArrow: fn maps a batch, in slices of so many rows at most, to a batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = fn(batch.slice(at, rows))
                yield from out.to_batches() if isinstance(out, pa.Table) else [out]
    return run


def gathered(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    """All rows of a task, whose number the caller bounds by the partitioning; None without rows."""
    held = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(held) if held else None


def text_or_empty(column: str = "text") -> F.Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def held_out(modulus: int, remainder: int) -> F.Column:
    """Rows outside training: crc32 of the id's digits leaves the remainder; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus == remainder
