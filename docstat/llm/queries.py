"""The driver-facing queries of the training-data operators: thin, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from docstat.llm import clusters, decontaminate, exact_dedup, lines, media, packing, pieces, pii, quality, search, secrets, simhash, substring
from docstat.llm.common import documents


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest_columns(pii.find(documents(spark, sf_dir)))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decide(documents(spark, sf_dir))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest_columns(simhash.near_components(documents(spark, sf_dir)))


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest_columns(documents(spark, sf_dir))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.describe(media.encode(documents(spark, sf_dir)))


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.deduplicate(documents(spark, sf_dir))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest_columns(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest_columns(secrets.find(documents(spark, sf_dir)))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest_columns(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {
    "op1_pii": op1_pii,
    "op2_quality": op2_quality,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_simhash": op4_simhash,
    "op5_lines": op5_lines,
    "op6_media": op6_media,
    "op7_substring": op7_substring,
    "op8_pieces": op8_pieces,
    "op9_secrets": op9_secrets,
    "op10_packing": op10_packing,
    "op11_search": op11_search,
    "op12_clusters": op12_clusters,
    "op13_decontaminate": op13_decontaminate,
}
ORACLES = {
    "op3_exact_dedup": exact_dedup.ORACLE,
    "op7_substring": substring.ORACLE,
    "op9_secrets": secrets.ORACLE,
    "op11_search": search.ORACLE,
    "op12_clusters": clusters.ORACLE,
    "op13_decontaminate": decontaminate.ORACLE,
}
