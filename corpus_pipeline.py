"""A corpus pipeline: toxicity, line dedup, near-dedup, benchmark decontamination, sampled segmentations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marea.llm import common, decontaminate, linedup, minhash, pieces, toxicity

#: A document goes from this probability of being toxic on.
TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below TOXIC, by a model of all labels; those without a label are judged like the rest.

    Null and empty texts have no words and the labels' own share of toxic rows as score; rows with a null doc_id are judged too, repeated rows
    alike. Without labels nothing goes. No rows: none.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(toxicity.labelled(common.documents(spark, sf_dir), labels))
    scored = toxicity.score(docs.select("text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")), model)
    return scored.filter(F.col("score") < TOXIC).select("row.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier line equals or resembles; a document that loses all its words goes.

    `n_chars` follows the text where there is such a column. Null and empty texts, and rows with a null doc_id, stay as
    they are; repeated rows lose the same lines. No rows: none.
    """
    n, gone = (next(name for name in (f"{x}{'_' * i}" for i in range(len(docs.columns) + 1)) if name not in docs.columns) for x in ("n_lines", "n_removed"))
    left = linedup.remove_lines(docs, report=(n, gone))
    kept = left.filter(F.expr(f"`{gone}` = 0 or text rlike '[^ \\t-\\r]'"))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col(gone) > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies, that of the smallest doc_id: five-word shingles, similarity 0.8.

    Documents without words and rows with a null doc_id stay; repeated rows of a kept doc_id all stay, and so do the
    columns of any name. No rows: none.
    """
    gone = minhash.link(docs, words=5, percent=80).filter("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Null, empty and short texts, and rows with a null doc_id, match nothing and stay. Without items, or rows, nothing goes.
    """
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def segment(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Three distinct sampled segmentations of each text, a row a sample; fewer where a text has fewer.

    Null and empty texts have none. A null doc_id keeps its null and samples as key 0; repeated rows sample alike.
    """
    # smaller slices than alone: the executors hold what the stages before have left
    return pieces.digest(docs, held_bytes=1 << 18)


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_lines), ("near-dedup", drop_near_copies), ("decontamination", drop_benchmark), ("segmentation", segment)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = common.materialise(docs) if i < len(STAGES) - 1 else docs
    return docs
