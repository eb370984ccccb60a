"""Which files exist and which are filled, listed once and joined, never probed row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def inventory(spark: SparkSession, directories: str | list[str]) -> DataFrame:
    """(path, length) of all files below the directories, from their metadata; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directories).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "length")


def missing(entries: DataFrame, files: DataFrame, columns: tuple[str, ...], name: str = "missing_files") -> DataFrame:
    """entries with the names of those path columns whose file isn't there, in the order given; an empty path is missing too."""
    paths = entries.select("document_id", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("c"), F.col(c).alias("path")) for i, c in enumerate(columns)])).alias("w")).select("document_id", "w.*")
    gone = paths.join(files.select("path").distinct(), "path", "left_anti")
    listed = gone.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_set(F.struct("i", "c"))), lambda x: x["c"]).alias(name))
    return entries.join(listed, "document_id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
