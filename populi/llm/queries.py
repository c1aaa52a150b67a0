"""Registered queries of the subpackage: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from populi.llm import ann, class_lm, decontaminate, html_crf, line_dedup, packing, periodic, pii, prefix_trie, quality, resharding, simhash, toxicity
from populi.llm.common import Scratch, held_out, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_personal_data(table(spark, sf_dir, "documents")))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents")))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out(3, 1))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resharding.digest(table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.digest(table(spark, sf_dir, "pages"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out(5, 0))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "packing")
    pieces = packing.tokenised(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(scratch.write(pieces, "pieces"), scratch)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(periodic.find_runs(periodic.planted(table(spark, sf_dir, "documents"))))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "trie")
    turns = scratch.write(prefix_trie.ordered(table(spark, sf_dir, "conversations")), "turns")
    return prefix_trie.digest(prefix_trie.prefix_trie(scratch.write(prefix_trie.spliced(turns), "spliced"), scratch))


def op13_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.digest(class_lm.scored(table(spark, sf_dir, "documents"), held_out(5, 1)))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_pii, op2_line_dedup, op3_quality, op4_nearest_neighbours, op5_resharding, op6_html_extraction,
                                                     op7_toxicity, op8_simhash_near_dedup, op9_best_fit_packing, op10_decontamination, op11_periodic_runs,
                                                     op12_prefix_trie, op13_class_lm)}
ORACLES: dict[str, str] = {"op10_decontamination": decontaminate.ORACLE}
