"""A corpus in four stages: language ID, near-duplicates, benchmark decontamination, packing.

Each stage works on all rows that the one before it kept; what it returns is written as Parquet to
the shared folder and read again, so a lost executor costs no earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import decontamination, language_id, packing, simhash
from corpusmill.llm.common import stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; those without a letter or without a clear language go."""
    return language_id.identified(docs, language_id.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 (the smallest doc_id stays; texts without words are one group)."""
    return simhash.deduplicated(docs, shingle=5, similarity=0.8)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontamination.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boundary records of all documents in sequences of 4096 ids."""
    return packing.pack_documents(docs)


STAGES = [("language_id", language), ("near_dedup", near_duplicates), ("decontamination", decontaminated), ("packing", packed)]

#: SQL has neither the network nor XXH64 nor the tokenizer; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
