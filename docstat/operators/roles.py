"""Document roles from names and contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docstat.functions import rules, text

UNKNOWN = "unknown"


def role(content: Column, source: str, table=rules.ROLES) -> Column:
    """Role, report type, strategy, confidence, evidence: the first group, then its first pattern, that content has."""
    return text.let(content, lambda whole: text.let(text.match_key(whole), lambda key: _role(key, source, table)))


def _role(key: Column, source: str, table) -> Column:
    out = None
    for kind, report, patterns in table:
        hit = [(p, key.contains("".join(p.lower().split()))) for p in patterns]
        pattern = F.coalesce(*[F.when(c, p) for p, c in hit])
        if kind == "primary_financial_report":
            strategy, confidence = "three_statement_extraction", 0.88
        else:
            strategy = "transcript_or_commentary_extraction" if report == "conference_call_transcript" else "auxiliary_performance_extraction"
            confidence = 0.86
        value = F.struct(
            F.lit(kind).alias("document_role"), F.lit(report).alias("report_type"), F.lit(strategy).alias("strategy"), F.lit(confidence).alias("confidence"), F.concat(F.lit(source + ":"), pattern).alias("evidence")
        )
        out = F.when(pattern.isNotNull(), value) if out is None else out.when(pattern.isNotNull(), value)
    none = F.struct(F.lit(UNKNOWN).alias("document_role"), F.lit(UNKNOWN).alias("report_type"), F.lit(UNKNOWN).alias("strategy"), F.lit(0.0).alias("confidence"), F.lit("").alias("evidence"))
    return out.otherwise(none)


def assess(documents: DataFrame, name: str = "pdf_name", content: str | None = None, table=rules.ROLES) -> DataFrame:
    """Role by name; where that is unknown, by content. Unknown roles require review."""
    found = documents.withColumn("__r", role(F.col(name), "filename", table))
    if content:
        found = found.withColumn("__r", F.when(F.col("__r.document_role") == UNKNOWN, role(F.col(content), "content", table)).otherwise(F.col("__r")))
    return found.select(*documents.columns, "__r.*", (F.col("__r.document_role") == UNKNOWN).alias("requires_review"))


def page_sample(pages: DataFrame, key: str, order: str, content: str, first: int = 3) -> DataFrame:
    """(key, sample): the first pages, of those that aren't blank, joined by line feeds."""
    filled = pages.where(text.strip(F.coalesce(F.col(content), F.lit(""))) != "")
    ranked = filled.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("__n") <= first)
    return ranked.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__n", content))), lambda r: r[content]), "\n").alias("sample"))
