"""The corpus pipeline: five stages over the documents, each on all that the one before kept.

1. toxicity: documents that the ordinal model rejects go.
2. jaccard: of each group of near copies the document with the least id stays.
3. decontaminate: documents that hold a benchmark item go.
4. pii: personal data in texts is replaced by its kind; n_chars follows.
5. mix: the mix of sources; a row for each document with how often it is taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovetally.llm import decontam, jaccard, mixing, pii, toxicity
from grovetally.llm._spark import col, fresh, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    keep = tuple(docs.columns)
    flag = fresh(docs, "toxic")[0]
    return toxicity.score(docs, model, keep).where(~F.col(flag)).select(*map(col, keep))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keep = tuple(docs.columns)
    flag = fresh(docs, "contaminated")[0]
    return decontam.matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep).where(~F.col(flag)).select(*map(col, keep))


def hide_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, keep=("doc_id", "source"))


STAGES = [("toxicity", drop_toxic), ("jaccard", drop_near_copies), ("decontaminate", drop_leaks), ("pii", hide_personal), ("mix", mix_sources)]

#: Iterative components and trained weights are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
