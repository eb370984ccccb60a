"""Review queue, decisions and extraction eligibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docstat.functions import rules, text
from docstat.operators.registry import newest, upsert


def classify() -> tuple[Column, Column]:
    """(review_status, review_reasons) of a registry entry with missing_outputs, an array of file names."""
    level, status = (F.coalesce(F.col(c), F.lit("")) for c in ("parse_quality_level", "parse_status"))
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    ratio = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    cross, visual = count("cross_page_table_candidate_count"), count("visual_table_route_pages_count")
    broken = (level == "failed") | status.isin("failed", "cancelled")
    missing = F.size("missing_outputs") > 0
    risks = text.reasons(
        (level == "needs_review", "parse_quality_level=needs_review"),
        (cross > 0, F.concat(F.lit("cross_page_table_candidate_count="), cross.cast("string"))),
        (visual > 0, F.concat(F.lit("visual_table_route_pages_count="), visual.cast("string"))),
        (ratio("ocr_ratio") >= rules.OCR_LIMIT, F.concat(F.lit("ocr_ratio="), text.fixed(ratio("ocr_ratio"), 4))),
        (ratio("heavy_parser_ratio") >= rules.HEAVY_LIMIT, F.concat(F.lit("heavy_parser_ratio="), text.fixed(ratio("heavy_parser_ratio"), 4))),
    )
    verdict = F.when(broken | missing, "failed").when(F.size(risks) > 0, "needs_review").when(level == "pass", "ready_for_extraction").when(level == "pass_with_warnings", "ready_with_warnings")
    why = (
        F.when(broken, F.array(F.concat(F.lit("parse_status="), status, F.lit(", parse_quality_level="), level)))
        .when(missing, F.array(F.concat(F.lit("missing_outputs="), text.quoted_list(F.col("missing_outputs")))))
        .when(F.size(risks) > 0, risks)
        .when(level == "pass", F.array(F.lit("parse_quality_level=pass")))
        .when(level == "pass_with_warnings", F.array(F.lit("parse_quality_level=pass_with_warnings without high-risk flags")))
    )
    return verdict.otherwise("needs_review"), why.otherwise(F.array(F.concat(F.lit("unrecognized parse_quality_level="), level)))


def latest_decisions(log: DataFrame) -> DataFrame:
    """The last decision of each document by ord."""
    return log.groupBy("document_id").agg(F.max_by(F.struct(*[c for c in log.columns if c != "document_id"]), "ord").alias("d")).select("document_id", "d.*")


def queue(entries: DataFrame, log: DataFrame, limit: int | None = None) -> DataFrame:
    """Review items of the latest entries with their decision, or its defaults."""
    status, why = classify()
    kept = entries if limit is None else newest(entries, limit)
    last = latest_decisions(log).select("document_id", "review_decision", "approved_for_extraction", "requires_manual_check")
    return kept.withColumns({"review_status": status, "review_reasons": why}).join(last, "document_id", "left").withColumns(
        {
            "review_decision": F.coalesce("review_decision", F.lit("pending_review")),
            "approved_for_extraction": F.coalesce("approved_for_extraction", F.lit(False)),
            "requires_manual_check": F.coalesce("requires_manual_check", F.lit(True)),
        }
    )


def queue_summary(items: DataFrame) -> DataFrame:
    return items.groupBy("review_status", "parse_quality_level").agg(F.count(F.lit(1)).alias("n"))


def eligibility_columns() -> list[Column]:
    """All but document_id of `eligibility`, of rows with e (the document's entry, or null), d and ok (its decision and approval, or null)."""
    decision = F.coalesce("d", F.lit("pending_review"))
    missing = F.when(F.col("e").isNull(), F.array(F.lit("registry_entry"))).otherwise(F.col("e.missing_files"))
    why = text.reasons(
        (F.col("e").isNull(), "registry entry not found"),
        (F.col("e.parse_quality_level") == "failed", "parse_quality_level=failed"),
        (decision.isin(*rules.BLOCKING), F.concat(F.lit("review_decision="), decision)),
        (~F.coalesce("ok", F.lit(False)), "approved_for_extraction=false"),
        (F.size(missing) > 0, F.concat(F.lit("missing_required_files="), text.quoted_list(missing))),
    )
    return [
        (F.size(why) == 0).alias("eligible_for_extraction"),
        F.when(F.size(why) == 0, "approved for extraction").otherwise(F.array_join(why, "; ")).alias("reason"),
        F.coalesce("e.parse_quality_level", F.lit("")).alias("parse_quality_level"),
        decision.alias("review_decision"),
        (F.size(missing) == 0).alias("required_files_present"),
        missing.alias("missing_required_files"),
    ]


def eligibility(requested: DataFrame, entries: DataFrame, log: DataFrame) -> DataFrame:
    """Whether each requested document may be extracted, and why not. entries have missing_files, an array."""
    first = entries.groupBy("document_id").agg(F.min_by(F.struct("parse_quality_level", "output_dir", "missing_files"), "ord").alias("e"))
    last = latest_decisions(log).select("document_id", F.col("review_decision").alias("d"), F.col("approved_for_extraction").alias("ok"))
    joined = requested.join(first, "document_id", "left").join(last, "document_id", "left")
    return joined.select("document_id", *eligibility_columns())


def eligibility_of_entries(entries: DataFrame, log: DataFrame, *more: str) -> DataFrame:
    """`eligibility` of the entries' own documents, with more of their columns, one row an entry: entries are dealt by document once, not once as requests and once to find each document's first."""
    first = F.first(F.struct("parse_quality_level", "output_dir", "missing_files")).over(Window.partitionBy("document_id").orderBy("ord"))
    last = latest_decisions(log).select("document_id", F.col("review_decision").alias("d"), F.col("approved_for_extraction").alias("ok"))
    return entries.withColumn("e", first).select("document_id", *more, "e").join(last, "document_id", "left").select("document_id", *more, *eligibility_columns())


def decide(entries: DataFrame, log: DataFrame, requests: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """(the decision log after the requests, the requests that are refused and why).

    requests: (document_id, review_decision, reviewer, review_notes, ord), one per document. A decision keeps its
    id and the time of the first decision on its document; unknown decisions and documents are refused.
    """
    known = entries.groupBy("document_id").agg(F.min_by(F.struct("parse_task_id", "pdf_name"), "ord").alias("e"))
    joined = requests.join(known, "document_id", "left").withColumn("error", F.when(F.col("e").isNull(), "registry entry not found").when(~F.col("review_decision").isin(*rules.DECISIONS), "unknown decision"))
    before = latest_decisions(log).select("document_id", F.col("decision_id").alias("old_id"), F.col("decided_at").alias("old_at"))
    made = joined.where("error is null").join(before, "document_id", "left").select(
        F.coalesce("old_id", text.decision_id(F.col("document_id"))).alias("decision_id"),
        "document_id",
        F.col("e.parse_task_id").alias("parse_task_id"),
        F.col("e.pdf_name").alias("pdf_name"),
        "review_decision",
        F.coalesce(F.nullif(F.col("reviewer"), F.lit("")), F.lit("local_user")).alias("reviewer"),
        F.coalesce("review_notes", F.lit("")).alias("review_notes"),
        F.col("review_decision").isin(*rules.APPROVING).alias("approved_for_extraction"),
        F.col("review_decision").isin(*rules.BLOCKING).alias("requires_manual_check"),
        F.coalesce("old_at", F.lit(as_of)).alias("decided_at"),
        F.lit(as_of).alias("updated_at"),
        "ord",
    )
    return upsert(log, made, "document_id", in_place=False), joined.where("error is not null").select("document_id", "review_decision", "error")
