"""Financial table candidates and the gate in front of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docstat.functions import rules, text


def table_confidence(merged: Column, continuation: Column) -> Column:
    term = lambda c, v: F.when(c, F.lit(v)).otherwise(F.lit(0.0))
    score = (
        F.lit(0.5)
        + term(F.col("has_header"), 0.15)
        + term((F.col("row_count") >= 3) & (F.col("col_count") >= 2), 0.15)
        + term(F.col("numeric_cell_ratio") >= 0.15, 0.10)
        + F.when(merged, F.least(F.coalesce(continuation, F.lit(0.0)), F.lit(1.0)) * 0.10).otherwise(F.lit(0.0))
        - term(F.col("empty_cell_ratio") > 0.35, 0.10)
    )
    return text.clamp_score(score)


def select_candidates(tables: DataFrame) -> DataFrame:
    """Candidates among tables, numbered per document in table order.

    tables: the columns of tables.tables, and source_type, continuation_confidence, n_flags.
    """
    merged = F.col("source_type") == "merged_cross_page_table"
    order = Window.partitionBy("document_id").orderBy("table_ord")
    found = tables.where(F.col("candidate_statement_type").isin(*rules.CANDIDATE_TYPES)).withColumn("confidence", table_confidence(merged, F.col("continuation_confidence")))
    notes = text.reasons((merged, "cross_page_table_candidate"), (F.col("n_flags") > 0, "quality_flags_present"), (F.col("confidence") < rules.CANDIDATE_REVIEW_BELOW, "low_candidate_confidence"))
    found = found.withColumns({"candidate_id": F.format_string("%s_%04d", F.col("document_id"), F.row_number().over(order) - 1), "extraction_notes": notes})
    return found.withColumn("requires_review", F.size("extraction_notes") > 0)


def gate(documents: DataFrame, override: bool = False) -> DataFrame:
    """extraction_mode and warnings of each document. documents: (document_id, eligible_for_extraction, reason)."""
    eligible = F.col("eligible_for_extraction")
    none = F.array().cast("array<string>")
    if override:
        refused, warnings = "dry_run_override", F.array(F.lit("override_used"), F.concat(F.lit("eligibility_block_reason="), F.col("reason")))
    else:
        refused, warnings = "blocked", F.array("reason")
    return documents.withColumns({"extraction_mode": F.when(eligible, "eligible").otherwise(refused), "warnings": F.when(eligible, none).otherwise(warnings)})


def candidate_set(documents: DataFrame, tables: DataFrame, override: bool = False) -> DataFrame:
    """Candidates of the tables of documents that the gate lets through, with their extraction_mode."""
    passing = gate(documents, override).where("extraction_mode <> 'blocked'").select("document_id", "extraction_mode")
    return select_candidates(tables).join(passing, "document_id")


def candidate_summary(candidates: DataFrame) -> DataFrame:
    """Counts of candidates by type, source and review need, and their mean confidence."""
    return candidates.groupBy("candidate_statement_type", "source_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("requires_review").alias("n_review"), F.sum("row_count").alias("n_rows"), F.max("confidence").alias("top_confidence")
    )
