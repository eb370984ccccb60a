"""The parse-quality gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docstat.functions import rules, text

LEVELS = ("pass", "pass_with_warnings", "needs_review", "failed")


def assess(summaries: DataFrame) -> DataFrame:
    """parse_quality_level and parse_quality_reasons of each row, in one projection.

    summaries: has_summary, total_pages, pages_count (null: file missing), merged_md (exists and filled: 'ok', else
    'missing', 'empty', or null when none is named), failed_pages_count, empty_pages_count, visual_table_route_pages_count,
    cross_page_table_candidate_count, ocr_ratio, heavy_parser_ratio, flag_counts map<string,bigint>.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    total, failed, empty = zero("total_pages"), zero("failed_pages_count"), zero("empty_pages_count")
    visual, cross = zero("visual_table_route_pages_count"), zero("cross_page_table_candidate_count")
    ocr, heavy = (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("ocr_ratio", "heavy_parser_ratio"))
    flagged = F.exists(F.coalesce(F.map_values("flag_counts"), F.array().cast("array<bigint>")), lambda n: n > 0)
    bad_share = failed / F.greatest(total, F.lit(1)) > rules.FAILED_PAGE_LIMIT
    say = lambda name, value: F.concat(F.lit(name + "="), value.cast("string"))
    checks: list[tuple[Column, Column | str, Column | str]] = [
        (~F.col("has_summary"), "summary is missing", "failed"),
        (total <= 0, "summary.total_pages is missing or zero", "failed"),
        (F.col("pages_count").isNotNull() & (total != 0) & (F.col("pages_count") != total), F.concat(F.lit("pages.jsonl row count "), F.col("pages_count").cast("string"), F.lit(" does not equal total_pages "), total.cast("string")), "failed"),
        (F.col("pages_count").isNull(), "pages.jsonl row count is unavailable", "failed"),
        (F.col("merged_md") == "missing", "merged.md is missing", "failed"),
        (F.col("merged_md") == "empty", "merged.md is empty", "failed"),
        (failed > 0, say("failed_pages_count", failed), F.when(bad_share, "needs_review").otherwise("pass_with_warnings")),
        (empty > 0, say("empty_pages_count", empty), "needs_review"),
        (visual > 0, say("visual_table_route_pages_count", visual), "pass_with_warnings"),
        (cross > 0, say("cross_page_table_candidate_count", cross), "pass_with_warnings"),
        (ocr >= rules.OCR_LIMIT, F.concat(F.lit("ocr_ratio="), text.fixed(ocr, 4), F.lit(" is high")), "needs_review"),
        (heavy >= rules.HEAVY_LIMIT, F.concat(F.lit("heavy_parser_ratio="), text.fixed(heavy, 4), F.lit(" is high")), "needs_review"),
        (flagged, "quality_flags contains flagged pages", "pass_with_warnings"),
    ]
    place = lambda level: F.array_position(F.array(*map(F.lit, LEVELS)), F.lit(level) if isinstance(level, str) else level)
    worst = F.greatest(F.lit(1).cast("long"), *[F.when(c, place(level)).otherwise(F.lit(1).cast("long")) for c, _, level in checks])
    found = text.reasons(*[(c, t) for c, t, _ in checks])
    baseline = F.array(F.lit("parse outputs passed baseline quality checks"))
    return summaries.withColumns({"parse_quality_level": F.element_at(F.array(*map(F.lit, LEVELS)), worst.cast("int")), "parse_quality_reasons": F.when(F.size(found) == 0, baseline).otherwise(found)})
