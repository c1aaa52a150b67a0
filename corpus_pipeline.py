"""A corpus from documents to packed sequences: the stages in order, each written as Parquet and read again by the next.

Every stage works on all rows its predecessor kept; all but the last return the columns of documents. An empty table
passes through; nulls follow each operator's defined results."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from populi.llm import decontaminate, line_dedup, packing, simhash, toxicity
from populi.llm.common import Scratch, held_out, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores below one half."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out(5, 0))
    return toxicity.drop_toxic(docs, model)


def delete_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without runs of lines that an earlier document has; a document that loses all its text goes."""
    cleaned = line_dedup.drop_repeated_lines(docs)
    touched = F.col("__runs").isNotNull() | F.col("__passages").isNotNull()
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.when(touched, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return cleaned.where(~(touched & (F.trim("text") == ""))).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_leaked(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences and places there."""
    scratch = Scratch(spark, "packing")
    pieces = packing.tokenised(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(scratch.write(pieces, "pieces"), scratch)


STAGES = [("toxicity", reject_toxic), ("line_dedup", delete_repeated_lines), ("simhash_near_dedup", drop_near_duplicates),
          ("decontamination", drop_contaminated), ("packing", pack_sequences)]

ORACLE_SQL = None  # no stage but the fourth can be said in SQL; tests/llm holds the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
