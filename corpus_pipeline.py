"""The corpus pipeline: good documents, without toxic ones, one of each group of near copies, none with benchmark text, as token ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.llm import bpe, decontaminate, neardup, quality, toxicity
from tarnlake.llm.common import discard, store, table
from tarnlake.llm.queries import vocabulary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, and whether they decode to it again."""
    content = vocabulary()
    encoded = bpe.encode(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), content)
    decoded = bpe.decode(encoded, content)
    return decoded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", (F.col("decoded") == F.col("text")).alias("exact"))


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("minhash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("bpe encoding and decoding", encoding_stage),
]
#: SQL can't express the trained classifiers and the sketches; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
