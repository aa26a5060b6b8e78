"""The corpus pipeline: toxic documents go, of near copies one stays, benchmark leaks go, personal data is redacted, the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablehaul.llm import decontaminate, jaccard, packing, pii, toxicity
from tablehaul.llm.common import read, ship, staged

TOKENIZER = "word_bpe_49k.json"


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 stay. Labels come from the tables, examples and frequencies from ``docs``."""
    ship(spark)
    index, known = toxicity.train(docs, read(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, index, known)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return jaccard.keep_one(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return decontaminate.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans become their kind in angle brackets, and n_chars is the new text's."""
    ship(spark)
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("bigint"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ship(spark)
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("toxicity", toxic), ("jaccard_join", near_copies), ("decontamination", leaks), ("pii", personal_data), ("packing", pack)]
ORACLE_SQL = None  # no stage can be said in SQL; the tests hold run() against the stages' brute-force versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written as Parquet to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, f"pipeline-{name}")
    return docs
