"""The quality gate, the review queue and extraction eligibility, kept up to date by the registry and decision logs as two streams.

Both logs meet in one streaming aggregation on the document. Its state is one row a document: the entry with the lowest place in the registry and the decision with the highest place
in the decision log. Only the documents that a batch touches come out of it, and what they get is the projection that the batch operators use, so the table is that of
`review.eligibility` over the whole logs, however they were split into batches and whichever log came first.

Late decisions: the place in the log rules, not the time of arrival. A decision that arrives after one with a higher place changes nothing; one that arrives
long after its own time, but has the highest place, counts. `rates` alone goes by time: behind its watermark a window is closed, and what comes later for it isn't counted there.
Defined results: a decision on a document without entry gives a row that says so, until the entry comes; repeated log rows change nothing; rows without document_id are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docstat.operators import quality, review
from docstat.sources.segments import Latest

QUEUE = "approved_for_extraction boolean, requires_manual_check boolean, review_status string, review_reasons array<string>"
#: What the table holds of each document.
SCHEMA = (
    "document_id string, eligible_for_extraction boolean, reason string, parse_quality_level string, review_decision string, required_files_present boolean, missing_required_files array<string>, "
    + QUEUE
)
ENTRY = ("parse_quality_level", "output_dir", "missing_files", "review_status", "review_reasons")
DECISION = ("review_decision", "approved_for_extraction", "requires_manual_check")


def merged(entries: DataFrame, decisions: DataFrame) -> DataFrame:
    """(document_id, entry, entry_ord, decision, decision_ord): the rows of both logs, each with its own half filled. entries: as quality.assess reads them, with missing_files and missing_outputs."""
    status, why = review.classify()
    assessed = quality.assess(entries).withColumns({"review_status": status, "review_reasons": why})
    left = assessed.select("document_id", F.struct(*ENTRY).alias("entry"), F.col("ord").alias("entry_ord"))
    right = decisions.select("document_id", F.struct(*DECISION).alias("decision"), F.col("ord").alias("decision_ord"))
    return left.unionByName(right, allowMissingColumns=True).where("document_id is not null")


def verdicts(rows: DataFrame) -> DataFrame:
    """One row for each document of merged logs, streams or not: its eligibility, and its place in the review queue."""
    state = rows.groupBy("document_id").agg(F.min_by("entry", "entry_ord").alias("e"), F.max_by("decision", "decision_ord").alias("last"))
    named = state.select("*", F.col("last.review_decision").alias("d"), F.col("last.approved_for_extraction").alias("ok"))
    return named.select(
        "document_id",
        *review.eligibility_columns(),
        F.coalesce("last.approved_for_extraction", F.lit(False)).alias("approved_for_extraction"),
        F.coalesce("last.requires_manual_check", F.lit(True)).alias("requires_manual_check"),
        "e.review_status",
        "e.review_reasons",
    )


def table(spark: SparkSession, path: str) -> Latest:
    return Latest(spark, path, "document_id", SCHEMA)


def follow(entries: DataFrame, decisions: DataFrame, into: Latest, checkpoint: str, **trigger) -> StreamingQuery:
    """Start the query over two streams; without a trigger it takes what is there and ends. Each batch writes the documents it touched, and nothing else."""
    rows = verdicts(merged(entries, decisions)).select(*into.columns)
    return rows.writeStream.outputMode("update").foreachBatch(into.put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def file_streams(spark: SparkSession, entries: tuple[str, object], decisions: tuple[str, object], files: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Both logs as streams of Parquet files: (path, schema) each; files: how many a batch takes at most."""
    read = lambda path, schema: (spark.readStream.schema(schema) if files is None else spark.readStream.schema(schema).option("maxFilesPerTrigger", files)).parquet(path)
    return read(*entries), read(*decisions)


def rates(decisions: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Decisions per window of updated_at and kind. On a stream a window closes when the watermark, the newest time less `late`, has passed its end; rows for it that come then are left out."""
    timed = decisions.withColumn("at", F.to_timestamp("updated_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")).withWatermark("at", late)
    counted = timed.groupBy(F.window("at", every), "review_decision").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("window_start"), "review_decision", "n")
