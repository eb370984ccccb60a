"""Warnings and errors of all stages as one table: (document_id, stage, at, severity, text).

`at` is where a message stands among those of its document and severity: an array that is compared place by place. A stage takes the messages of the stage before under one place and puts
its own before or behind, so lists that hold one another, and repeat one another, keep their order without being gathered. `ordered` numbers them, `lists` gathers a document's own.

Defined results: null texts are no messages; documents that a stage doesn't let through have that stage's reasons only; messages of documents that aren't asked for are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docstat.operators import normalize

WARNING, ERROR = "warning", "error"
COLUMNS = ("document_id", "stage", "at", "severity", "text")


def said(documents: DataFrame, stage: str, place: int, severity: str, *texts: str | Column) -> DataFrame:
    """The texts of each document, in order, from `place` on."""
    each = F.posexplode(F.array_compact(F.array(*[F.lit(t) if isinstance(t, str) else t for t in texts])))
    rows = documents.select("document_id", each.alias("i", "text"))
    return rows.select("document_id", F.lit(stage).alias("stage"), F.array(F.lit(place), "i").alias("at"), F.lit(severity).alias("severity"), "text")


def under(messages: DataFrame, place: int, stage: str | None = None) -> DataFrame:
    """The messages of an earlier stage, at `place` of a later one; stage: who repeats them, if not said again by their own."""
    moved = messages.withColumn("at", F.concat(F.array(F.lit(place)), "at")).select(*COLUMNS)
    return moved if stage is None else moved.withColumn("stage", F.lit(stage))


def only(messages: DataFrame, documents: DataFrame) -> DataFrame:
    return messages.join(documents.select("document_id"), "document_id", "left_semi").select(*COLUMNS)


def together(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _say(name: str, value: str | Column) -> Column:
    return F.concat(F.lit(f"{name}="), (F.col(value) if isinstance(value, str) else value).cast("string"))


def of_normalization(found: DataFrame, unknown: DataFrame | None = None) -> DataFrame:
    """found: (document_id, severity, message) of normalize.normalize, the page file's error first; unknown: documents without registry entry, which have nothing else."""
    merged = F.col("message").startswith(normalize.ERROR["merged_cross_page_table"]).cast("int")
    rows = found.select("document_id", F.lit("normalization").alias("stage"), F.array(merged).alias("at"), "severity", F.col("message").alias("text"))
    if unknown is None:
        return rows
    gone = said(unknown, "normalization", 0, ERROR, F.concat(F.lit("document_id not found: "), "document_id"))
    return rows.join(unknown.select("document_id"), "document_id", "left_anti").select(*COLUMNS).unionByName(gone)


def _override(documents: DataFrame, stage: str, place: int) -> DataFrame:
    """What is said of documents that only the override lets through."""
    return said(documents.where(~F.col("eligible_for_extraction")), stage, place, WARNING, "override_used", _say("eligibility_block_reason", "reason"))


def of_candidates(documents: DataFrame, normalization: DataFrame, override: bool) -> DataFrame:
    """documents: (document_id, eligible_for_extraction, reason)."""
    eligible = F.col("eligible_for_extraction")
    passing = documents if override else documents.where(eligible)
    own = _override(documents, "candidates", 1) if override else said(documents.where(~eligible), "candidates", 1, WARNING, F.col("reason"))
    return together(under(only(normalization, passing), 0), own)


def of_mapping(documents: DataFrame, normalization: DataFrame, missing: DataFrame, discards: DataFrame, override: bool) -> DataFrame:
    """missing: (document_id, table_ord, message), candidates whose table isn't there; discards: (document_id, n_discarded) of the mapping. The errors of normalisation are repeated."""
    passing = documents if override else documents.where("eligible_for_extraction")
    lost = discards.where("n_discarded > 0").join(passing.select("document_id"), "document_id", "left_semi")
    order = F.row_number().over(Window.partitionBy("document_id").orderBy("table_ord"))
    gone = missing.select("document_id", F.lit("mapping").alias("stage"), F.array(F.lit(2), order).alias("at"), F.lit(ERROR).alias("severity"), F.col("message").alias("text"))
    return together(
        under(of_candidates(documents, normalization, override), 0),
        under(only(normalization.where(F.col("severity") == ERROR), passing), 1, "mapping"),
        said(lost, "mapping", 1, WARNING, _say("discarded_candidates_count", "n_discarded")),
        only(gone, passing),
    )


def of_extraction(documents: DataFrame, normalization: DataFrame, missing: DataFrame, discards: DataFrame, statement_discards: DataFrame, override: bool) -> DataFrame:
    """The messages of the extraction result of every document.

    documents: (document_id, document_role, report_type, strategy, evidence, eligible_for_extraction, reason); statement_discards: (document_id, n_discarded) of
    the choice among the mapping's fields. A document that gets so far is mapped as under an override.
    """
    role, eligible = F.col("document_role"), F.col("eligible_for_extraction")
    auxiliary, unknown = role == "auxiliary_material", role == "unknown"
    lines = (_say("document_role", "document_role"), _say("report_type", "report_type"), _say("expected_extraction_strategy", "strategy"))
    passing = documents.where(~auxiliary if override else ~auxiliary & ~unknown & eligible)
    lost = statement_discards.where("n_discarded > 0").join(passing.select("document_id"), "document_id", "left_semi")
    parts = [
        said(documents.where(auxiliary), "extraction", 0, WARNING, "auxiliary_material_no_three_statement_expected", *lines),
        said(passing, "extraction", 0, WARNING, *lines),
        under(of_mapping(passing, normalization, missing, discards, True), 1),
        said(lost, "extraction", 3, WARNING, _say("discarded_field_candidates_count", "n_discarded")),
    ]
    if override:
        parts.append(_override(passing, "extraction", 2))
    else:
        evidence = F.nullif(F.col("evidence"), F.lit(""))
        parts.append(said(documents.where(unknown), "extraction", 0, WARNING, "document_role_unknown_requires_review", evidence))
        parts.append(said(documents.where(~auxiliary & ~unknown & ~eligible), "extraction", 0, WARNING, F.col("reason")))
    return together(*parts)


def ordered(messages: DataFrame) -> DataFrame:
    """(document_id, stage, seq, severity, text); seq counts from 0 in each document and severity."""
    seq = F.row_number().over(Window.partitionBy("document_id", "severity").orderBy("at")) - 1
    return messages.select("document_id", "stage", seq.alias("seq"), "severity", "text")


def lists(messages: DataFrame) -> DataFrame:
    """(document_id, warnings, errors) of the documents that have any."""
    of = lambda severity: F.transform(F.array_sort(F.collect_list(F.when(F.col("severity") == severity, F.struct("at", "text")))), lambda m: m["text"])
    return messages.groupBy("document_id").agg(of(WARNING).alias("warnings"), of(ERROR).alias("errors"))
