"""Best candidates rolled up into statements, and the gates before extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstat.functions import rules
from docstat.operators.dedup import extraction_rank, first_discards, keep_best, mapping_rank, ranked


def deduplicate_fields(fields: DataFrame) -> DataFrame:
    """Best candidate of each (field, period, pages) of a document."""
    return keep_best(fields, ["document_id", "canonical_field_name", "period_label", "source_pages"], mapping_rank())


def best_fields(fields: DataFrame) -> DataFrame:
    """Best candidate of each (statement, field, period) of a document."""
    return keep_best(fields, ["document_id", "candidate_statement_type", "canonical_field_name", "period_label"], extraction_rank())


def discarded_counts(fields: DataFrame) -> DataFrame:
    """Rows and discarded rows of each document: rows less distinct keys."""
    keys = ["document_id", "candidate_statement_type", "canonical_field_name", "period_label"]
    each = fields.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("document_id").agg(F.sum("n").alias("n_fields"), (F.sum("n") - F.count(F.lit(1))).alias("n_discarded"))


def statements(best: DataFrame) -> DataFrame:
    """One row per document and statement type: fields in (period, name) order, periods, pages, review need."""
    one = F.struct("period_label", "canonical_field_name", "raw_value", "normalized_value", "unit", "currency", "confidence", "requires_review", F.concat(F.lit("extracted_"), F.col("field_id")).alias("field_id"), F.concat(F.lit("selected_best_candidate; "), F.col("mapping_reason")).alias("extraction_reason"))
    return best.groupBy("document_id", F.col("candidate_statement_type").alias("statement_type")).agg(
        F.array_sort(F.collect_list(one)).alias("fields"),
        F.array_sort(F.collect_set("period_label")).alias("periods_detected"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_pages")))).alias("source_pages"),
        F.bool_or("requires_review").alias("requires_review"),
    )


def extraction_mode(documents: DataFrame, override: bool = False) -> DataFrame:
    """extraction_mode of each document: role first, then eligibility.

    documents: (document_id, document_role, eligible_for_extraction).
    """
    role, eligible = F.col("document_role"), F.col("eligible_for_extraction")
    mode = F.when(role == "auxiliary_material", "auxiliary_material_dry_run" if override else "blocked_by_document_role")
    if not override:
        mode = mode.when(role == "unknown", "blocked_by_document_role").when(~eligible, "blocked")
    return documents.withColumn("extraction_mode", mode.otherwise(F.when(eligible, "eligible").otherwise("dry_run_override")))


def extraction_warnings(documents: DataFrame, override: bool = False) -> DataFrame:
    """documents with extraction_mode and warnings, in the order they are given.

    documents: (document_id, document_role, report_type, strategy, evidence, eligible_for_extraction, reason, and, of their
    mapping, n_discarded); warnings of the statements' own discards are those of `discarded_counts`.
    """
    say = lambda name, c: F.concat(F.lit(f"{name}="), F.col(c))
    role = [say("document_role", "document_role"), say("report_type", "report_type"), say("expected_extraction_strategy", "strategy")]
    discarded = F.when(F.col("n_discarded") > 0, F.concat(F.lit("discarded_candidates_count="), F.col("n_discarded").cast("string")))
    forced = [F.when(~F.col("eligible_for_extraction"), c) for c in (F.lit("override_used"), say("eligibility_block_reason", "reason"))] if override else []
    passing = F.array_compact(F.array(*role, discarded, *forced))
    found = F.when(F.col("document_role") == "auxiliary_material", F.array(F.lit("auxiliary_material_no_three_statement_expected"), *role))
    if not override:
        evidence = F.when(F.col("evidence") != "", F.array("evidence")).otherwise(F.array().cast("array<string>"))
        found = found.when(F.col("document_role") == "unknown", F.concat(F.array(F.lit("document_role_unknown_requires_review")), evidence)).when(~F.col("eligible_for_extraction"), F.array("reason"))
    return extraction_mode(documents, override).withColumn("warnings", found.otherwise(passing))


def mapping_discards(fields: DataFrame) -> DataFrame:
    """(document_id, n_fields, n_discarded, warning) of the mapping's own de-duplication; no warning without discards."""
    keys = ["document_id", "canonical_field_name", "period_label", "source_pages"]
    each = fields.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    found = each.groupBy("document_id").agg(F.sum("n").alias("n_fields"), (F.sum("n") - F.count(F.lit(1))).alias("n_discarded"))
    return found.withColumn("warning", F.when(F.col("n_discarded") > 0, F.concat(F.lit("discarded_candidates_count="), F.col("n_discarded").cast("string"))))


def document_counts(fields: DataFrame) -> DataFrame:
    """What `deduplicate_fields`, `best_fields`, `mapping_discards` and `discarded_counts` leave of each document, as numbers from one sort of its fields.

    n_fields; n_kept by the mapping and n_discarded; of the kept, n_chosen by the extraction and n_passed_over, n_statements, unknown_unit, unknown_period, n_review and confidence_sum. Fields are dealt by document, which all steps share.
    """
    parts = int(fields.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["document_id", "canonical_field_name", "period_label", "source_pages"]
    dealt = ranked(fields.repartition(parts, "document_id"), keys, mapping_rank())
    kept = F.col("__n") == 1
    of_key = dealt.groupBy("document_id", "candidate_statement_type", "canonical_field_name", "period_label").agg(
        F.count(F.lit(1)).alias("n_fields"), F.count_if(kept).alias("n_kept"), F.count_if(kept & (F.col("unit") == "unknown")).alias("unknown_unit"), F.count_if(kept & (F.col("period_label") == "unknown_period")).alias("unknown_period"),
        F.count_if(kept & F.col("requires_review")).alias("n_review"), F.sum(F.when(kept, F.col("confidence")).otherwise(0.0)).alias("confidence_sum"),
    )
    total = [F.sum(c).alias(c) for c in ("n_fields", "n_kept", "unknown_unit", "unknown_period", "n_review", "confidence_sum")]
    of_statement = of_key.groupBy("document_id", "candidate_statement_type").agg(*total, F.count_if(F.col("n_kept") > 0).alias("n_chosen"))
    found = of_statement.groupBy("document_id").agg(*total, F.sum("n_chosen").alias("n_chosen"), F.count_if(F.col("n_chosen") > 0).alias("n_statements"))
    return found.withColumns({"n_discarded": F.col("n_fields") - F.col("n_kept"), "n_passed_over": F.col("n_kept") - F.col("n_chosen")})


#: What the mapping result says of a discarded candidate.
DISCARDED = ["canonical_field_name", "raw_field_name", "raw_value", "table_id", "confidence", "mapping_reason"]


def discard_examples(fields: DataFrame, n: int = 10) -> DataFrame:
    """The first n candidates of each document that the mapping's de-duplication discards, in the order in which it does."""
    return first_discards(fields, ["document_id", "canonical_field_name", "period_label", "source_pages"], mapping_rank(), DISCARDED, "document_id", n)


def passing(documents: DataFrame, override: bool = False) -> DataFrame:
    """(document_id, extraction_mode) of the documents whose mode lets them through."""
    return extraction_mode(documents, override).where(F.col("extraction_mode").isin("eligible", "dry_run_override")).select("document_id", "extraction_mode")


def extract(documents: DataFrame, fields: DataFrame, override: bool = False) -> DataFrame:
    """Statements of the documents whose mode lets them through; fields that are mapped already meet the gate before they are ranked."""
    return extract_passing(passing(documents, override), fields)


def extract_passing(through: DataFrame, fields: DataFrame) -> DataFrame:
    """`extract` with what `passing` gave. Spark doesn't move this join below the windows that map fields, so leave out the other documents' rows before they are mapped."""
    return statements(best_fields(deduplicate_fields(fields.join(through.select("document_id"), "document_id", "left_semi")))).join(through, "document_id")


def mapping_stats(fields: DataFrame, *by: str) -> DataFrame:
    """Counts, mean confidence, unknown units and periods, review needs: one row, or one for each value of `by`."""
    return fields.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_fields"),
        F.avg("confidence").alias("mean_confidence"),
        F.count_if(F.col("unit") == "unknown").alias("unknown_unit"),
        F.count_if(F.col("period_label") == "unknown_period").alias("unknown_period"),
        F.count_if("requires_review").alias("n_review"),
    )
