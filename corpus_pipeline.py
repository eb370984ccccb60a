"""From raw documents to packed training sequences: classify, de-duplicate twice, redact, pack.

Each stage takes (spark, docs, sf_dir) and decides on every row its predecessor kept. All but the
last return the columns of documents. A stage defines its result for null and empty texts, repeated rows,
empty tables and further columns as the operator it calls does.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from docstat.llm import exact_dedup, packing, pii, quality, simhash
from docstat.llm.common import delete, documents, recorded, scratch


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.accept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, a cosine of 0.8 or more."""
    return simhash.deduplicate(docs, simhash.wide())


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", accept_quality),
    ("exact dedup", drop_exact_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("PII", redact_personal_data),
    ("packing", pack_sequences),
]

#: The classifier's decisions have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, applied to documents; each result but the last is written once for the next to read.

    What a stage wrote on its way, and what it read, is deleted as soon as its result is written.
    """
    docs, done = documents(spark, sf_dir), []
    for name, step in STAGES[:-1]:
        with recorded() as made:
            out = step(spark, docs, sf_dir)
        path = scratch(spark, name.replace(" ", "-"))
        out.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        for old in (*made, *done):
            delete(old)
        done = [path]
    return STAGES[-1][1](spark, docs, sf_dir)
