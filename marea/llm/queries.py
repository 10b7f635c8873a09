"""The thin queries over the operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marea.llm import align, decontaminate, fmindex, gif, licenses, linedup, maxent, minhash, pieces, runs, secrets, suffixarray, toxicity
from marea.llm.common import documents


def op1_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.store_texts(documents(spark, sf_dir))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.link(documents(spark, sf_dir))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fmindex.digest(documents(spark, sf_dir))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(documents(spark, sf_dir))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linedup.digest(documents(spark, sf_dir))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(documents(spark, sf_dir))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixarray.digest(documents(spark, sf_dir))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.recognise(documents(spark, sf_dir))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digest(documents(spark, sf_dir))


def op12_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.judge(documents(spark, sf_dir))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.digest(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_gif, op2_decontamination, op3_minhash, op4_substring_dedup, op5_secrets, op6_toxicity, op7_line_dedup, op8_sentencepiece, op9_suffix_array_dedup, op10_licenses, op11_runs, op12_maxent, op13_alignment)}


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": decontaminate.sql(), "op10_licenses": licenses.sql()}
