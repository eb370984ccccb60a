"""Checks across stages as one table: check_name, status, n_failed.

`suite` takes each check's offending rows. `watched` is for the job that writes the documents' report: its seven checks are metrics that Spark observes while the rows go by, so they read nothing
of their own and are there when the write is done.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docstat.functions import rules


def check(name: str, offending: DataFrame) -> DataFrame:
    """One row: failed when a row offends, with the smallest offending key as an example."""
    n, first = F.count(F.lit(1)), F.min(F.col(offending.columns[0]).cast("string"))
    found = offending.agg(n.alias("n_failed"), F.coalesce(first, F.lit("")).alias("example"))
    return found.select(F.lit(name).alias("check_name"), F.when(F.col("n_failed") == 0, "passed").otherwise("failed").alias("status"), "n_failed", "example", F.lit(True).alias("machine_determined"))


def suite(checks: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, (check(name, rows) for name, rows in checks.items()))


def consistency(items: DataFrame, eligible: DataFrame, fields: DataFrame, kept: DataFrame, entries: DataFrame) -> dict[str, DataFrame]:
    """The invariants of the pipeline, each as the rows that break it."""
    both = items.select("document_id", F.col("review_decision").alias("decision"), "parse_quality_level").join(eligible.select("document_id", "eligible_for_extraction", "required_files_present"), "document_id")
    approved = F.col("decision").isin("approved_for_extraction", "approved_with_warnings")
    counts = fields.groupBy("document_id").agg(F.count(F.lit(1)).alias("n")).join(kept.groupBy("document_id").agg(F.count(F.lit(1)).alias("k")), "document_id", "full")
    return {
        "blocking_decisions_are_not_eligible": both.where(~approved & F.col("eligible_for_extraction")),
        "approved_with_files_is_eligible": both.where(approved & (F.col("parse_quality_level") != "failed") & F.col("required_files_present") & ~F.col("eligible_for_extraction")),
        "task_ids_are_unique": entries.groupBy("parse_task_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"),
        "pages_match_summary": entries.where("parse_quality_level <> 'failed' and pages_count <> total_pages"),
        "kept_fields_come_from_fields": counts.where("n is null or k is null or k > n"),
    }


def status_counts(checks: DataFrame) -> DataFrame:
    return checks.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


#: The data checks, in order.
CHECKS = ("registry", "quality_gate", "review_decision_eligibility", "table_normalization", "extraction_candidates", "statement_field_mapping_refinement", "minimal_extraction_dry_run")


def document_report(entries: DataFrame, eligible: DataFrame, tables: DataFrame, fields: DataFrame, kept: DataFrame, extracted: DataFrame, messages: dict[str, DataFrame]) -> DataFrame:
    """One row for each registry entry with what every stage made of its document, each stage's rows counted by one grouping.

    entries: assessed; eligible: of review.eligibility; tables: with source_pages and table_group_id; fields: all field candidates, kept: those that the mapping keeps; extracted: (document_id,
    statement_type, n_fields, periods); messages: by stage, "normalization" and "extraction" (of the dry run).
    """
    mapped = kept.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("fields_count"), F.count_if(F.col("unit") == "unknown").alias("unknown_unit_count"), F.count_if(F.col("period_label") == "unknown_period").alias("unknown_period_count"),
        F.count_if("requires_review").alias("requires_review_count"), F.sum("confidence").alias("confidence_sum"),
    )
    discarded = fields.groupBy("document_id").agg(F.count(F.lit(1)).alias("mapped_count"))
    chosen = extracted.groupBy("document_id").agg(F.count(F.lit(1)).alias("statement_count"), F.sum("n_fields").alias("field_count"))
    found = eligible.select("document_id", "eligible_for_extraction", "reason", "review_decision", "required_files_present")
    return report_of(entries.join(found, "document_id", "left"), tables, messages, discarded, mapped, chosen)


def report_of(entries: DataFrame, tables: DataFrame, messages: dict[str, DataFrame], *counts: DataFrame) -> DataFrame:
    """`document_report` of entries with what eligibility tells of them, and counts of their fields by document: mapped_count; fields_count, unknown_unit_count, unknown_period_count, requires_review_count, confidence_sum; statement_count, field_count."""
    count = lambda c: F.count_if(c)
    errors = lambda stage: messages[stage].where("severity = 'error'").groupBy("document_id").agg(F.count(F.lit(1)).alias(f"{stage}_errors"))
    made = tables.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("canonical_tables_count"), count(F.size("source_pages") == 0).alias("source_pages_missing"), count(F.coalesce("table_group_id", F.lit("")) != "").alias("table_group_id_count"),
        count(F.col("candidate_statement_type").isin(*rules.CANDIDATE_TYPES)).alias("candidates_count"),
    )
    report = entries.withColumn("task_copies", F.count(F.lit(1)).over(Window.partitionBy("parse_task_id")))
    for part in (made, *counts, errors("normalization"), errors("extraction")):
        report = report.join(part, "document_id", "left").fillna(0, [c for c in part.columns if c != "document_id"])
    return report.select(
        "document_id", "parse_task_id", F.when(F.coalesce("parse_task_id", F.lit("")) == "", 1).otherwise(F.col("task_copies")).alias("task_copies"), F.col("missing_files").alias("missing"), "pages_count", "total_pages",
        "parse_quality_level", (F.coalesce("merged_md", F.lit("missing")) == "ok").alias("merged_non_empty"), "review_decision", "eligible_for_extraction", "reason", "required_files_present",
        "canonical_tables_count", "source_pages_missing", "table_group_id_count", "normalization_errors",
        F.when(F.col("eligible_for_extraction"), "eligible").otherwise("blocked").alias("normal_mode"), "candidates_count",
        (F.col("mapped_count") - F.col("fields_count")).alias("discarded_candidates_count"), "fields_count", "unknown_unit_count", "unknown_period_count", "requires_review_count",
        F.when(F.col("fields_count") > 0, F.bround(F.col("confidence_sum") / F.col("fields_count"), 4)).otherwise(0.0).alias("average_confidence"),
        "statement_count", "field_count", "extraction_errors",
    )


def _offences() -> dict[str, list[Column]]:
    """What counts as an error of each check, by report row."""
    eligible, decision = F.col("eligible_for_extraction"), F.col("review_decision")
    return {
        "registry": [F.col("task_copies") > 1, F.size("missing") > 0],
        "quality_gate": [F.coalesce("parse_quality_level", F.lit("")) == "", ~F.col("pages_count").eqNullSafe(F.when(F.coalesce("total_pages", F.lit(0)) == 0, -1).otherwise(F.col("total_pages"))), ~F.col("merged_non_empty")],
        "review_decision_eligibility": [decision.isin(*rules.BLOCKING) & eligible, decision.isin(*rules.APPROVING) & ~eligible & F.col("required_files_present")],
        "table_normalization": [F.col("normalization_errors")],
        "extraction_candidates": [~eligible & (F.col("normal_mode") != "blocked")],
        "statement_field_mapping_refinement": [],
        "minimal_extraction_dry_run": [F.col("extraction_errors")],
    }


def _details() -> dict[str, dict[str, Column]]:
    """What each check says of all documents."""
    total = F.count(F.lit(1))
    return {
        "registry": {"registry_count": total, "duplicates": F.count_if(F.col("task_copies") > 1), "missing_files": F.count_if(F.size("missing") > 0)},
        "quality_gate": {"documents": total, "merged_non_empty": F.count_if("merged_non_empty")},
        "review_decision_eligibility": {"review_queue_count": total, "eligible_documents_count": F.count_if("eligible_for_extraction")},
        "table_normalization": {c: F.sum(c) for c in ("canonical_tables_count", "source_pages_missing", "table_group_id_count")},
        "extraction_candidates": {"dry_run_documents_count": total, "blocked": F.count_if(F.col("normal_mode") == "blocked"), "candidates_count": F.sum("candidates_count")},
        "statement_field_mapping_refinement": {c: F.sum(c) for c in ("fields_count", "unknown_unit_count", "unknown_period_count", "requires_review_count")},
        "minimal_extraction_dry_run": {"statement_count": F.sum("statement_count"), "field_count": F.sum("field_count")},
    }


def watched(report: DataFrame) -> tuple[DataFrame, Observation]:
    """The report, and what Spark counts of it on its way: errors, first offender and details of each check."""
    seen, metrics = Observation("validation"), []
    details = _details()
    for name, offences in _offences().items():
        counts = [c.cast("long") for c in offences] or [F.lit(0).cast("long")]
        each = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0)) for c in counts])
        metrics += [F.coalesce(F.sum(each), F.lit(0)).alias(f"{name}:errors"), F.min(F.when(each > 0, F.col("document_id"))).alias(f"{name}:example")]
        metrics += [F.coalesce(value, F.lit(0)).cast("long").alias(f"{name}:{key}") for key, value in details[name].items()]
    return report.observe(seen, *metrics), seen


def results(spark: SparkSession, seen: Observation) -> DataFrame:
    """The seven checks, once the watched report has been written: check_name, status, n_errors, example, details (JSON), machine_determined."""
    got = seen.get
    rows = []
    for name, details in _details().items():
        errors = got[f"{name}:errors"]
        rows.append((name, "failed" if errors else "passed", errors, got[f"{name}:example"] or "", json.dumps({k: got[f"{name}:{k}"] for k in details}, separators=(",", ":")), True))
    return spark.createDataFrame(rows, "check_name string, status string, n_errors long, example string, details string, machine_determined boolean")


def summary(checks: DataFrame) -> dict:
    """Counts by status and the totals of the details, as the suite's report has them."""
    counts = {r["status"]: r["n"] for r in status_counts(checks).collect()}
    details = {r["check_name"]: json.loads(r["details"]) for r in checks.collect()}
    return {
        **{f"{key}_count": counts.get(status, 0) for key, status in (("passed", "passed"), ("failed", "failed"), ("skipped", "skipped"), ("warnings", "warning"))},
        "registry_count": details["registry"]["registry_count"],
        "review_queue_count": details["review_decision_eligibility"]["review_queue_count"],
        "eligible_documents_count": details["review_decision_eligibility"]["eligible_documents_count"],
        "dry_run_documents_count": details["extraction_candidates"]["dry_run_documents_count"],
        "high_risk_items_count": details["statement_field_mapping_refinement"]["requires_review_count"],
    }


def markdown(checks: DataFrame, as_of: str) -> str:
    """The suite's report, rendered on the driver: it has one row a check."""
    lines = ["# FinancialResearch Validation Suite Results", "", f"Generated at: {as_of}", ""]
    lines += [f"- {key.removesuffix('_count') if key in ('passed_count', 'failed_count', 'skipped_count', 'warnings_count') else key}: {n}" for key, n in summary(checks).items()]
    lines += ["", "## Checks", ""]
    for r in sorted(checks.collect(), key=lambda r: CHECKS.index(r["check_name"])):
        lines += [f"### {r['check_name']}", "", f"- status: {r['status']}", f"- machine_determined: {r['machine_determined']}", ""]
    return "\n".join(lines)


def report_files(checks: DataFrame, as_of: str) -> DataFrame:
    """(document_id, suffix, value) of the suite's four files, for document_files.write."""
    rows = [r.asDict() | {"details": json.loads(r["details"])} for r in sorted(checks.collect(), key=lambda r: CHECKS.index(r["check_name"]))]
    shown = lambda value: json.dumps(value, ensure_ascii=False, indent=2)
    table = "".join(f"{r['check_name']},{r['status']},{r['machine_determined']}\r\n" for r in rows)
    files = [
        ("validation_suite_results", "json", shown({"generated_at": as_of, "checks": rows, **summary(checks)})),
        ("validation_suite_failures", "json", shown([r for r in rows if r["status"] == "failed"])),
        ("validation_suite_results", "md", markdown(checks, as_of)),
        ("validation_suite_summary", "csv", "check_name,status,machine_determined\r\n" + table),
    ]
    return checks.sparkSession.createDataFrame(files, "document_id string, suffix string, value string")


def normalization_stats(tables: DataFrame) -> DataFrame:
    """One row: tables, those of no known type, without header, source pages or group, cells, distinct documents."""
    grouped = F.coalesce("table_group_id", F.lit("")) != ""
    return tables.agg(
        F.count(F.lit(1)).alias("n_tables"), F.count_if(F.col("candidate_statement_type") == "unknown").alias("n_unknown"), F.count_if(~F.col("has_header")).alias("n_headless"),
        F.count_if(F.size("source_pages") == 0).alias("source_pages_missing"), F.count_if(grouped).alias("table_group_id_count"),
        F.sum("cell_count").alias("n_cells"), F.countDistinct("document_id").alias("n_documents"), F.max("col_count").alias("widest"),
    )


def readiness(tables: DataFrame) -> DataFrame:
    """One row per document: tables by source and type, distinct pages and groups."""
    grouped = F.when(F.coalesce("table_group_id", F.lit("")) != "", F.col("table_group_id"))
    return tables.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("total_tables"), F.count_if(F.col("source_type") == "merged_cross_page_table").alias("merged_cross_page_tables_count"),
        *[F.count_if(F.col("candidate_statement_type") == t).alias(f"n_{t}") for t in (*rules.CANDIDATE_TYPES, "unknown")],
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("source_pages")))).alias("source_pages"), F.array_sort(F.collect_set(grouped)).alias("table_group_ids"),
    )


def readiness_reports(documents: DataFrame, tables: DataFrame, messages: DataFrame) -> DataFrame:
    """(document_id, suffix, value) of a readiness report for each document, as text that its task renders: for document_files.write.

    documents: (document_id, review_decision, eligible_for_extraction, reason, pages_count, total_pages); tables: as `readiness` reads them; messages: (document_id, warnings, errors) of messages.lists.
    """
    types, sources = (*rules.CANDIDATE_TYPES, "unknown"), ("page_table", "merged_cross_page_table")
    counts = [F.count_if(F.col("source_type") == t).alias(f"source_{t}") for t in sources]
    rows = documents.join(readiness(tables), "document_id", "left").join(tables.groupBy("document_id").agg(*counts), "document_id", "left").join(messages, "document_id", "left")
    none = F.array().cast("array<string>")
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    value = {
        "document_id": F.col("document_id"), "current_review_decision": F.coalesce("review_decision", F.lit("pending_review")), "eligible_for_extraction": F.initcap(F.coalesce("eligible_for_extraction", F.lit(False)).cast("string")),
        "eligibility_reason": F.coalesce("reason", F.lit("")),
    }
    sizes = {
        "total_tables": number("total_tables"), "canonical_tables_count": number("total_tables"), "merged_cross_page_tables_count": number("merged_cross_page_tables_count"),
        "source_pages_count": F.coalesce(F.size("source_pages"), F.lit(0)).cast("string"), "table_group_id_count": F.coalesce(F.size("table_group_ids"), F.lit(0)).cast("string"),
        "pages_count": number("pages_count"), "summary_total_pages": F.coalesce(F.col("total_pages").cast("string"), F.lit("None")),
    }
    lines = lambda shown: [F.concat(F.lit(f"- `{k}`: `"), v, F.lit("`")) for k, v in shown.items()]
    spread = lambda prefix, names: F.to_json(F.map_filter(F.create_map(*(x for n in names for x in (F.lit(n), F.coalesce(F.col(f"{prefix}{n}"), F.lit(0))))), lambda _, n: n > 0), {"pretty": "true"})
    block = lambda name, value: [F.lit(""), F.lit(f"{name}:"), F.lit(""), F.lit("```json"), value, F.lit("```")]
    parts = [
        F.lit("# Financial Extraction Adapter Readiness Report"), F.lit(""), F.lit("## Document"), F.lit(""), *lines(value), F.lit(""), F.lit("## Table Normalization"), F.lit(""), *lines(sizes),
        *block("Candidate statement type distribution", spread("n_", types)), *block("Source type distribution", spread("source_", sources)),
        *block("Warnings", F.to_json(F.coalesce("warnings", none))), *block("Errors", F.to_json(F.coalesce("errors", none))), F.lit(""),
    ]
    return rows.select("document_id", F.lit("readiness.md").alias("suffix"), F.concat_ws("\n", *parts).alias("value"))
