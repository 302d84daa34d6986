"""From raw documents to packed training sequences, in five stages.

1. language: documents whose language can't be told (no letter, or a calibrated score under 0.3, little above chance among four) go.
2. near_duplicates: of each group of near copies (5-word shingles, similarity 0.8 or more) the smallest id stays.
3. benchmark: documents that hold a benchmark window (10 consecutive words of an item) go.
4. secrets: confirmed secrets are replaced by a mask; every document stays, n_chars follows its text.
5. packing: what is left becomes sequences of 2048 ids.

Each stage works on all its predecessor kept and, but for the last, returns the columns of its input. Rows with a
null text go in stage 1; rows with a null id stay through stage 2; an empty table passes through as such.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import decontamination, langid, packing, secrets, simhash
from marlstone.llm.common import row_keys, table, written

LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is known with the least score or more."""
    model = langid.train(docs)
    return langid.keep_identified(docs, model, LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.deduplicated(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no window of a benchmark item."""
    found = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    gone = found.filter("contaminated").select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).distinct()
    k1, k2 = row_keys("doc_id", "text")
    return docs.withColumns({"__k1": k1, "__k2": k2}).join(gone, ["__k1", "__k2"], "left_anti").drop("__k1", "__k2")


def secret(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, confirmed secrets masked."""
    clean = secrets.redact(docs, path_col="source")
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences."""
    return packing.pack(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("secrets", secret), ("packing", pack)]

#: Models and tokenizers are beyond SQL: tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order on documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
