"""The decision log as a file stream that keeps the decision table up to date."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from docstat.operators.review import latest_decisions
from docstat.sources.segments import Latest


def follow(spark: SparkSession, log_path: str, into: Latest, checkpoint: str) -> StreamingQuery:
    """Start a query that puts the last decisions, by ord, of the documents that a batch touches into the table.

    A batch writes a folder of its own and nothing else, so its cost doesn't grow with the table. A decision that comes late, after one with a higher ord, changes nothing.
    """
    rows = latest_decisions(spark.readStream.schema(StructType(into.fields)).parquet(log_path)).select(*into.columns)
    return rows.writeStream.outputMode("update").foreachBatch(into.put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
