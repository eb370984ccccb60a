"""Human review items: fields, visual tables and document roles, by risk."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docstat.functions import rules, text
from docstat.sources.store import written

ITEM = ("document_id", "pdf_name", "review_type", "reason", "source_pages", "table_id", "table_group_id", "canonical_field_name", "raw_field_name", "raw_value", "normalized_value", "period_label", "unit", "currency", "confidence", "suggested_user_action", "evidence_excerpt")
# The texts of the review pack.
ACTIONS = {
    "field": "Compare this mapped field with the original PDF table and confirm value, period, unit, and row label.",
    "visual": "Open the original PDF page and confirm whether visual tables were recovered correctly.",
    "role": "Confirm whether this document is a primary financial report or auxiliary material before extraction.",
}


def continuation(fields: DataFrame, groups: DataFrame) -> DataFrame:
    """fields with continuation: that of their group, or the least of the groups an id lists, 0 for groups not known.

    groups: (document_id, table_group_id, continuation_confidence). A document's groups travel as one map.
    """
    known = groups.groupBy("document_id", "table_group_id").agg(F.max("continuation_confidence").alias("c"))
    known = known.groupBy("document_id").agg(F.map_from_entries(F.collect_list(F.struct("table_group_id", "c"))).alias("__groups"))
    group = F.coalesce("table_group_id", F.lit(""))
    of = lambda g: F.coalesce(F.try_element_at("__groups", g), F.lit(0.0))
    least = F.array_min(F.transform(F.filter(F.split(group, ","), lambda p: p != ""), of))
    found = F.coalesce(F.try_element_at("__groups", group), least, F.lit(0.0))
    return fields.join(known, "document_id", "left").withColumn("continuation", found).drop("__groups")


def field_items(fields: DataFrame) -> DataFrame:
    """Items of the fields that give a reason. fields have continuation, source_type and pdf_name."""
    return judged(fields).where("reason <> ''")


def judged(fields: DataFrame) -> DataFrame:
    """All fields as items; those that need no review have no reason."""
    group = F.coalesce("table_group_id", F.lit(""))
    cross = (F.col("source_type") == "merged_cross_page_table") | ((group != "") & (F.col("continuation") < rules.CROSS_PAGE_BELOW))
    broken = text.looks_broken(F.col("raw_value"), F.col("normalized_value"))
    parts = F.array_distinct(
        text.reasons(
            (cross, F.concat(F.lit("cross-page table confidence="), text.fixed(F.col("continuation"), 2))),
            (F.col("confidence") < rules.FIELD_REVIEW_BELOW, "confidence<0.75"),
            (F.col("mapping_reason").contains("weak_aliases"), "weak alias match"),
            (F.col("period_label") == "unknown_period", "unknown period"),
            (F.col("unit") == "unknown", "unknown unit"),
            (F.col("requires_review"), "field requires review"),
            (broken, "raw or normalized value looks suspicious"),
        )
    )
    kind = F.when(cross | (broken & (group != "")), "cross_page_numeric_check").otherwise("field_mapping_semantic_check")
    return fields.withColumns(
        {
            "review_type": kind,
            "reason": F.array_join(parts, "; "),
            "suggested_user_action": F.lit(ACTIONS["field"]),
            "evidence_excerpt": F.concat_ws(" = ", "raw_field_name", "raw_value"),
        }
    )


def visual_items(pages: DataFrame) -> DataFrame:
    """Pages whose tables were routed to visual parsing or look like a table without one.

    pages: (document_id, pdf_name, page_number, visual_table_route_triggered, table_intent_score, n_tables, table_group_id, final_text, ord).
    """
    score, routed = F.col("table_intent_score"), F.col("visual_table_route_triggered")
    likely = (F.coalesce(score, F.lit(0.0)) >= rules.VISUAL_INTENT) & (F.col("n_tables") <= rules.VISUAL_TABLES)
    shown = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    why = F.concat(F.lit("visual_table_route_triggered="), F.initcap(shown(routed)), F.lit("; table_intent_score="), shown(score), F.lit("; table_count="), F.col("n_tables").cast("string"))
    return pages.where(F.coalesce(routed, F.lit(False)) | likely).select(
        "document_id", "pdf_name", "ord", F.lit("visual_table_check").alias("review_type"), why.alias("reason"), F.array(F.col("page_number")).alias("source_pages"), F.coalesce("table_group_id", F.lit("")).alias("table_group_id"),
        F.coalesce(score, F.lit(0.0)).alias("confidence"), F.lit(ACTIONS["visual"]).alias("suggested_user_action"), F.substring("final_text", 1, 300).alias("evidence_excerpt"),
    )


def role_items(documents: DataFrame) -> DataFrame:
    """Documents whose role doesn't agree with what was found in them.

    documents: (document_id, pdf_name, document_role, confidence, evidence, n_three_statement, n_statements, ord).
    """
    role = F.col("document_role")
    why = (
        F.when(role == "unknown", "document role is unknown")
        .when((role == "auxiliary_material") & (F.col("n_three_statement") >= rules.AUXILIARY_CANDIDATES), F.concat(F.lit("auxiliary material has many three-statement candidates: "), F.col("n_three_statement").cast("string")))
        .when((role == "primary_financial_report") & (F.col("n_statements") < rules.PRIMARY_STATEMENTS), F.concat(F.lit("primary report has few extracted statements: "), F.col("n_statements").cast("string")))
    )
    return documents.withColumn("reason", why).where("reason is not null").select(
        "document_id", "pdf_name", "ord", F.lit("auxiliary_material_role_check").alias("review_type"), "reason", "confidence", F.lit(ACTIONS["role"]).alias("suggested_user_action"), F.col("evidence").alias("evidence_excerpt")
    )


def pack(*parts: DataFrame, limit: int = rules.PACK_LIMIT) -> DataFrame:
    """All items in the columns of ITEM, those of the highest risk first, at most `limit` a document: the pack is a top-k report.

    A text that an item lacks is empty; a number it lacks stays null.
    """
    items = None
    for i, part in enumerate(parts):
        part = part.withColumn("part", F.lit(i))
        items = part if items is None else items.unionByName(part, allowMissingColumns=True)
    kinds = dict(items.dtypes)
    blank = {"string": F.lit(""), "array<int>": F.array().cast("array<int>")}
    fill = {c: F.coalesce(F.col(c), blank[kinds[c]]) for c in ITEM if kinds.get(c) in blank} | {c: F.lit("") for c in ITEM if c not in kinds}
    items = items.withColumns(fill)
    risk = F.coalesce(*[F.when(F.col("review_type") == name, F.lit(score)) for name, score in rules.RISK], F.lit(0))
    order = Window.partitionBy("document_id").orderBy(F.col("risk").desc(), (1 - F.col("confidence")).desc(), "part", "ord")
    return items.withColumn("risk", risk).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def three_statement_counts(candidates: DataFrame) -> DataFrame:
    """(document_id, n_three_statement): candidates for one of the three statements."""
    return candidates.groupBy("document_id").agg(F.count_if(F.col("candidate_statement_type").isin(*rules.THREE_STATEMENTS)).alias("n_three_statement"))


def numbered(items: DataFrame) -> DataFrame:
    """review_item_id over the whole pack, documents in order of their id. The pack has at most PACK_LIMIT rows a document.

    Documents are dealt into ranges and the pack is written in order; what a range's rows are numbered from is the total of the ranges before, one row a range. Nothing of the pack is made or dealt a second time.
    """
    ranges = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = items.repartitionByRange(ranges, "document_id").sortWithinPartitions("document_id", "rank")
    dealt = written(dealt.withColumn("__at", F.monotonically_increasing_id()), "review-pack")  # the range above, the place in it below
    inside = dealt.withColumns({"__range": F.shiftright("__at", 33), "__place": F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))})
    totals = inside.groupBy("__range").agg(F.count(F.lit(1)).alias("total"))
    starts = totals.select("__range", (F.sum("total").over(Window.orderBy("__range")) - F.col("total")).alias("__start"))
    return inside.join(F.broadcast(starts), "__range").withColumn("review_item_id", F.format_string("hri_%05d", F.col("__start") + F.col("__place") + 1)).drop("__at", "__range", "__place", "__start")


def type_distribution(items: DataFrame) -> DataFrame:
    return items.groupBy("review_type").agg(F.count(F.lit(1)).alias("n"))


def markdown(items: DataFrame, first: int = 30) -> str:
    """The pack's report: counts and its first items, rendered on the driver. items are numbered."""
    kinds = {r.review_type: r.n for r in type_distribution(items).orderBy("review_type").collect()}
    lines = ["# Human Review Pack", "", f"- total_review_items: {sum(kinds.values())}", f"- review_type_distribution: `{json.dumps(kinds)}`", "", "## Top Items", ""]
    for r in items.orderBy("review_item_id").limit(first).collect():
        lines += [f"### {r.review_item_id} {r.review_type}", "", f"- document_id: `{r.document_id}`", f"- source_pages: `{r.source_pages}`", f"- reason: {r.reason}"]
        lines += [f"- field: `{r.canonical_field_name}`", f"- raw: `{r.raw_field_name} = {r.raw_value}`", f"- suggested action: {r.suggested_user_action}", ""]
    return "\n".join(lines)
