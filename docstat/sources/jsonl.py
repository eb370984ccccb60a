"""Line files: blank lines don't count, a line that is no JSON fails the read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docstat.functions import text


def filled_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, line_no, value) of each line that isn't blank; line_no orders the lines of a file.

    Files are split among tasks like any text, so a line's place is that of its block in the file and its place in the block.
    """
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), place.alias("line_no"), "value")
    return lines.where(text.strip(F.col("value")) != "")


def records(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """Typed records with their path and line; malformed lines raise."""
    parsed = filled_lines(spark, paths).select("path", "line_no", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"))
    return parsed.select("path", "line_no", "r.*")


def line_counts(wanted: DataFrame, lines: DataFrame) -> DataFrame:
    """(path, n) of each wanted path; null where there is no such file."""
    return wanted.join(lines.groupBy("path").agg(F.count(F.lit(1)).alias("n")), "path", "left")


def write_lines(frame: DataFrame, path: str) -> None:
    frame.select(F.to_json(F.struct(*frame.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)
