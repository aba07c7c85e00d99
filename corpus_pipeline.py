"""From raw documents to packed training sequences, each stage an operator of quietlog.llm.

Stages take the previous one's documents. All but the last return the columns of documents; a stage that cuts texts brings n_chars up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietlog.llm import decontamination, near_dedup, packing, substring_bwt, toxicity
from quietlog.llm.store import written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; a null text stays."""
    return toxicity.kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies, the document with the least doc_id."""
    return near_dedup.one_of_each(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the runs of 50 words or more that stand in a document with a smaller doc_id too: of each repeated passage one copy is trained on."""
    return substring_bwt.cut_later(docs)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaked."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of 2048."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", without_toxic), ("near_dedup", without_near_copies), ("substring_dedup", without_repeats), ("decontamination", without_leaks), ("packing", packed)]
#: A trained model, Burrows-Wheeler transforms and a tokenizer decide: SQL cannot say it. tests/llm holds it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
