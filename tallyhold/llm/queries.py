"""The registered queries of the corpus operators, and their SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyhold.llm import decontaminate, langid, lattice, lines, oracles, packing, repeats, setjoin, shards, toxicity, warc
from tallyhold.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.measure(table(spark, sf_dir, "documents")).drop("clean_text")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(warc.read(spark, warc.write(table(spark, sf_dir, "pages"))))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(table(spark, sf_dir, "documents")))


def op7_heavy_light_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.components(table(spark, sf_dir, "documents")).drop("uid")


def op8_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.materialise(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(repeats.remove(table(spark, sf_dir, "documents")))


def op10_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_line_rules, op3_warc, op4_decontamination, op5_language_id, op6_packing, op7_heavy_light_join, op8_training_order, op9_suffix_dedup, op10_lattice)}


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that it can express; the trained, packed and permuted ones are held against plain versions in tests."""
    return {"op2_line_rules": oracles.OP2, "op3_warc": oracles.OP3, "op4_decontamination": oracles.OP4, "op7_heavy_light_join": oracles.OP7, "op9_suffix_dedup": oracles.OP9}
