"""Queries over the registry, decisions, roles, text tables and number strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docstat.functions import rules, text
from docstat.operators import quality, registry, review, review_pack, roles, tables
from docstat.plans import inputs
from docstat.plans.inputs import DECISION_SQL, REGISTRY_SQL, TEXT_SQL
from docstat.plans.line_plans import APPROVED, ELIGIBILITY_SQL, sql_any, sql_first, sql_key, sql_number, sql_numeric_like, sql_role, sql_strip
from docstat.sources import json_tables

def _entries(spark, sf):
    return quality.assess(inputs.registry(spark, sf))


def registry_list(spark: SparkSession, sf: str) -> DataFrame:
    return registry.newest(_entries(spark, sf), 100, "needs_review").select("document_id", "registered_at", "parse_quality_level")


def registry_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """New results for every third task and for unknown ones, in place or at the end."""
    old = inputs.registry(spark, sf).select("parse_task_id", "pdf_name", "ord")
    new = inputs.registry(spark, sf).where("ord % 3 = 0").select(F.when(F.col("ord") % 2 == 0, F.col("parse_task_id")).otherwise(F.concat(F.lit("new_"), F.col("ord").cast("string"))).alias("parse_task_id"), F.lit("again.pdf").alias("pdf_name"), "ord")
    return registry.upsert(old, new)


def registry_find(spark: SparkSession, sf: str) -> DataFrame:
    known = _entries(spark, sf)
    return registry.by_document(known, "doc_7").unionByName(registry.by_task(known, "task_32")).select("document_id", "parse_task_id", "pdf_name", "parse_quality_level")


def registry_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return registry.duplicate_tasks(inputs.decision_log(spark, sf), "document_id")


def document_ids(spark: SparkSession, sf: str) -> DataFrame:
    path = F.concat(F.lit("/in/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    docs = inputs.read(spark, sf, "documents").select("doc_id", path.alias("path"), text.document_id(path, F.col("lang")).alias("document_id"))
    return docs.select("doc_id", "document_id", text.decision_id(F.col("document_id")).alias("decision_id"), text.basename(F.col("path")).alias("pdf_name"))


def quality_gate(spark: SparkSession, sf: str) -> DataFrame:
    return _entries(spark, sf).select("document_id", "parse_quality_level", F.array_join("parse_quality_reasons", "; ").alias("reasons"))


def latest_decision(spark: SparkSession, sf: str) -> DataFrame:
    return review.latest_decisions(inputs.decision_log(spark, sf)).select("document_id", "review_decision", "updated_at")


def decision_list(spark: SparkSession, sf: str) -> DataFrame:
    return registry.newest(inputs.decision_log(spark, sf), 50, "rejected", "updated_at", "review_decision").select("document_id", "updated_at", "ord")


def decision_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """The log's last decisions with new ones put at the end."""
    log = review.latest_decisions(inputs.decision_log(spark, sf)).select("document_id", "review_decision", "ord")
    new = log.where("ord % 5 = 0").withColumn("review_decision", F.lit("ignored"))
    return registry.upsert(log, new, "document_id", in_place=False)


def review_queue(spark: SparkSession, sf: str) -> DataFrame:
    items = review.queue(_entries(spark, sf), inputs.decision_log(spark, sf))
    return items.select("document_id", "review_status", F.array_join("review_reasons", "; ").alias("review_reasons"), "review_decision", "approved_for_extraction", "requires_manual_check")


def review_queue_latest(spark: SparkSession, sf: str) -> DataFrame:
    return review.queue(_entries(spark, sf), inputs.decision_log(spark, sf), 200).select("document_id", "review_status", "review_decision")


def queue_summary(spark: SparkSession, sf: str) -> DataFrame:
    return review.queue_summary(review.queue(_entries(spark, sf), inputs.decision_log(spark, sf)))


def _eligibility(spark, sf):
    known = _entries(spark, sf)
    wanted = known.select("document_id").unionByName(spark.createDataFrame([("doc_0",), ("nowhere",)], "document_id string"))
    return review.eligibility(wanted, known, inputs.decision_log(spark, sf))


def eligibility(spark: SparkSession, sf: str) -> DataFrame:
    return _eligibility(spark, sf).select("document_id", "eligible_for_extraction", "reason", "parse_quality_level", "review_decision", "required_files_present")


def role_by_name(spark: SparkSession, sf: str) -> DataFrame:
    pages = inputs.read(spark, sf, "pages").select("page_id", inputs.named(F.col("url"), F.col("page_id")).alias("pdf_name"))
    return roles.assess(pages).select("page_id", "document_role", "report_type", "strategy", "confidence", "evidence", "requires_review")


def page_sample(spark: SparkSession, sf: str) -> DataFrame:
    return roles.page_sample(inputs.read(spark, sf, "conversations"), "conv_id", "turn", "text")


def role_by_content(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("conv_id")
    sample = page_sample(spark, sf).withColumns({"pdf_name": F.when(n % 3 == 0, inputs.named(F.lit("conv"), n)).otherwise("conv"), "sample": inputs.named(F.col("sample"), n + 5)})
    return roles.assess(sample, content="sample").select("conv_id", "document_role", "report_type", "evidence")


def cells_text(spark: SparkSession, sf: str) -> DataFrame:
    return tables.cells(inputs.text_rows(spark, sf)).select("table_id", "row_index", "col_index", "text", "is_header")


def text_table_quality(spark: SparkSession, sf: str) -> DataFrame:
    return tables.tables(inputs.text_rows(spark, sf)).select("table_id", "row_count", "col_count", "empty_cells", "numeric_cells", "has_header", "empty_ratio_exact", "numeric_ratio_exact")


def statement_type(spark: SparkSession, sf: str) -> DataFrame:
    """Types of document texts; words of the test data stand in for some that don't occur in it."""
    body = F.concat(F.col("text"), F.when(F.col("doc_id") % 6 == 0, "\nCash Flow").when(F.col("doc_id") % 6 == 1, " 分部").otherwise(""))
    return inputs.read(spark, sf, "documents").select("doc_id", tables.statement_type(body).alias("statement_type"))


def merged_tables(spark: SparkSession, sf: str) -> DataFrame:
    """A customer's orders are the fragments of one cross-page table."""
    line = inputs.read(spark, sf, "lineitem").join(inputs.read(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    fragments = line.select(F.col("o_custkey").alias("group_id"), F.col("o_orderkey").alias("fragment_ord"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("row_ord"), F.array(F.col("l_partkey").cast("string"), F.col("l_returnflag")).alias("cells"))
    return tables.join_fragments(fragments).select("group_id", "row_index", F.array_join("cells", "|").alias("cells"))


def page_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Page tables with the last record of their page and the flags of either source."""
    line = inputs.read(spark, sf, "lineitem").withColumn("document_id", (F.col("l_orderkey") % 500).cast("string"))
    total = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    none = F.array().cast("array<string>")
    pages = tables.last_by_page(line.select("document_id", F.col("l_linenumber").alias("page_number"), F.when(F.col("l_returnflag") == "A", F.array("l_linestatus")).otherwise(none).alias("quality_flags"), F.col("l_returnflag").alias("parser_source"), F.lit("").alias("table_group_id"), "l_tax", total.alias("line_no")).withColumnRenamed("l_tax", "table_intent_score"))
    flags = spark.range(0, 500, 3).select(F.col("id").cast("string").alias("document_id"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("page_number")).withColumn("flags", F.array(F.lit("other")))
    records = spark.range(500).select(F.col("id").cast("string").alias("document_id"), F.explode(F.sequence(F.lit(1), F.lit(9))).alias("page_number"))
    return tables.lookup_flags(records, pages, flags).select("document_id", "page_number", "parser_source", F.array_join("quality_flags", ",").alias("quality_flags"))


def _numbers(spark, sf):
    shown = F.format_number("p_retailprice", 2)
    odd = F.col("p_partkey") % 8
    raw = F.when(odd == 0, F.concat(F.lit("（"), shown, F.lit("）"))).when(odd == 1, F.concat(shown, F.lit("%"))).when(odd == 2, F.concat(F.lit(" ("), shown, F.lit(") "))).when(odd == 3, F.col("p_name")).when(odd == 4, "-").when(odd == 5, "１２").when(odd == 6, F.concat(F.col("p_size").cast("string"), F.lit("\n1")))
    return inputs.read(spark, sf, "part").select("p_partkey", raw.otherwise(shown).alias("raw"))


def parse_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return _numbers(spark, sf).select("p_partkey", "raw", text.parse_number(F.col("raw")).alias("value"))


def numeric_like(spark: SparkSession, sf: str) -> DataFrame:
    return _numbers(spark, sf).select("p_partkey", text.is_numeric_like(F.col("raw")).alias("numeric_like"), text.looks_like_period(text.match_key(F.col("raw"))).alias("period_like"))


def suspicious_values(spark: SparkSession, sf: str) -> DataFrame:
    value = text.parse_number(F.col("raw"))
    return _numbers(spark, sf).select("p_partkey", text.is_suspicious(F.col("raw"), F.lit("number"), value).alias("suspicious"), text.looks_broken(F.col("raw"), value).alias("broken"))


def visual_items(spark: SparkSession, sf: str) -> DataFrame:
    return review_pack.visual_items(inputs.visual_pages(spark, sf)).select("document_id", "ord", "review_type", "reason", "confidence", "table_group_id", "suggested_user_action", "evidence_excerpt")


def role_items(spark: SparkSession, sf: str) -> DataFrame:
    pages = role_by_name(spark, sf)
    docs = pages.select(F.col("page_id").cast("string").alias("document_id"), F.lit("x.pdf").alias("pdf_name"), "document_role", "confidence", "evidence", (F.col("page_id") % 20).alias("n_three_statement"), (F.col("page_id") % 4).alias("n_statements"), F.col("page_id").alias("ord"))
    return review_pack.role_items(docs).select("document_id", "review_type", "reason", "confidence", "evidence_excerpt")


def task_manifests(spark: SparkSession, sf: str) -> DataFrame:
    """File paths of task results: those given, else the output folder's."""
    orders = inputs.read(spark, sf, "orders").select(F.concat(F.lit("/out/"), F.col("o_orderkey").cast("string")).alias("output_dir"), F.when(F.col("o_orderkey") % 2 == 0, F.create_map(F.lit("summary"), F.lit("/s.json"))).alias("output_files"), F.col("o_orderkey").alias("k"))
    return registry.manifest(orders).select("k", "summary_path", "pages_path", "merged_tables_path")


def registry_manifests(spark: SparkSession, sf: str) -> DataFrame:
    return registry.manifest_of(inputs.registry(spark, sf)).select("document_id", "task_id", "pdf_name", "summary_path")


def ingest_results(spark: SparkSession, sf: str) -> DataFrame:
    """Task results with their summary files, registered and put into a registry that has every other task already."""
    known = inputs.registry(spark, sf)
    pages = lambda c: F.array_repeat(F.lit(1), F.col(c).cast("int")).alias(c.removesuffix("_count"))
    text_of = F.to_json(F.struct("pdf_name", "total_pages", pages("failed_pages_count"), pages("empty_pages_count"), pages("visual_table_route_pages_count"), "cross_page_table_candidate_count", "heavy_parser_ratio", "ocr_ratio"))
    files = known.where("has_summary").select(F.col("parse_task_id").alias("document_id"), text_of.alias("value"))
    read = json_tables.summaries(files).join(known.select(F.col("parse_task_id").alias("document_id"), "flag_counts"), "document_id")
    results = known.select("parse_task_id", F.concat(F.lit("/in/"), F.col("pdf_name")).alias("pdf_path"), "output_dir", F.create_map(F.lit("summary"), F.lit("/s.json")).alias("output_files"), "parse_status", "ord")
    probes = known.where("merged_md <> 'missing'").select(F.concat("output_dir", F.lit("/merged.md")).alias("path"), (F.col("merged_md") == "ok").alias("filled"))
    entries = registry.ingest(results, read, known.select("parse_task_id", "pages_count"), probes, "2026-01-01T00:00:00Z")
    columns = ("parse_task_id", "document_id", "pdf_name", "parse_quality_level", "summary_path", "ord")
    old = entries.where("ord % 2 = 0").select(*columns).withColumn("parse_quality_level", F.lit("old"))
    return registry.upsert(old, entries.select(*columns))


QUERIES = {
    f.__name__: f
    for f in (
        registry_list, registry_upsert, registry_find, registry_duplicates, document_ids, quality_gate, latest_decision, decision_list, decision_upsert, review_queue, review_queue_latest, queue_summary, eligibility,
        role_by_name, page_sample, role_by_content, cells_text, text_table_quality, statement_type, merged_tables, page_flags, parse_numbers, numeric_like, suspicious_values, visual_items, role_items, task_manifests, registry_manifests, ingest_results,
    )
}

R = f"WITH {REGISTRY_SQL}"
RD = f"WITH {REGISTRY_SQL}, {DECISION_SQL}"
RISKS = """list_filter([CASE level WHEN 'needs_review' THEN 'parse_quality_level=needs_review' END, CASE WHEN cross_n > 0 THEN 'cross_page_table_candidate_count=' || cross_n END, CASE WHEN visual > 0 THEN 'visual_table_route_pages_count=' || visual END,
  CASE WHEN ocr >= 0.4 THEN printf('ocr_ratio=%.4f', ocr) END, CASE WHEN heavy >= 0.6 THEN printf('heavy_parser_ratio=%.4f', heavy) END], lambda x: x IS NOT NULL)"""
QUEUE = f"""{RD}, risk AS (SELECT gate.*, {RISKS} AS risks FROM gate),
queue AS (SELECT risk.*, CASE WHEN level = 'failed' OR parse_status = 'failed' OR len(missing_outputs) > 0 THEN 'failed' WHEN len(risks) > 0 THEN 'needs_review' WHEN level = 'pass' THEN 'ready_for_extraction' ELSE 'ready_with_warnings' END AS review_status,
  CASE WHEN level = 'failed' OR parse_status = 'failed' THEN 'parse_status=' || parse_status || ', parse_quality_level=' || level WHEN len(missing_outputs) > 0 THEN 'missing_outputs=[''' || array_to_string(missing_outputs, ''', ''') || ''']'
    WHEN len(risks) > 0 THEN array_to_string(risks, '; ') WHEN level = 'pass' THEN 'parse_quality_level=pass' ELSE 'parse_quality_level=pass_with_warnings without high-risk flags' END AS review_reasons,
  coalesce(last.review_decision, 'pending_review') AS review_decision FROM risk LEFT JOIN last USING (document_id))"""
ELIGIBLE = f"{RD}, want AS (SELECT document_id FROM reg UNION ALL SELECT unnest(['doc_0', 'nowhere'])), {ELIGIBILITY_SQL}"


SAMPLE = f"""WITH s AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY n) AS sample FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE {sql_strip("coalesce(text, '')")} <> '') WHERE n <= 3 GROUP BY 1)"""
NAMED = f"WITH pr AS (SELECT page_id, {sql_role(inputs.sql_named('url', 'page_id'), 'filename')} AS x FROM pages)"
NUMBERS = """WITH nb AS (SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN '（' || s || '）' WHEN 1 THEN s || '%' WHEN 2 THEN ' (' || s || ') ' WHEN 3 THEN p_name WHEN 4 THEN '-' WHEN 5 THEN '１２' WHEN 6 THEN p_size || chr(10) || '1' ELSE s END AS raw
  FROM (SELECT *, format('{:,.2f}', p_retailprice) AS s FROM part))"""
PLAIN = r"'^\(?-?[0-9,，]+(\.[0-9]+)?\)?%?$'"

ORACLES = {
    "registry_list": f"{R} SELECT document_id, registered_at, level AS parse_quality_level FROM gate WHERE level = 'needs_review' ORDER BY registered_at DESC, k LIMIT 100",
    "registry_upsert": f"{R}, new AS (SELECT CASE WHEN k % 2 = 0 THEN parse_task_id ELSE 'new_' || k END AS parse_task_id, 'again.pdf' AS pdf_name, k FROM reg WHERE k % 3 = 0) SELECT parse_task_id, pdf_name, k AS ord FROM reg WHERE parse_task_id NOT IN (SELECT parse_task_id FROM new) UNION ALL SELECT n.parse_task_id, n.pdf_name, coalesce(reg.k, n.k + (SELECT max(k) FROM reg) + 1) FROM new n LEFT JOIN reg USING (parse_task_id)",
    "registry_find": f"{R} SELECT document_id, parse_task_id, pdf_name, level AS parse_quality_level FROM gate WHERE document_id = 'doc_7' OR parse_task_id = 'task_32'",
    "registry_duplicates": f"WITH {DECISION_SQL} SELECT document_id, count(*) AS n FROM log GROUP BY 1 HAVING count(*) > 1",
    "document_ids": "SELECT doc_id, document_id, 'parse_review_decision_' || sha1(document_id)[:16] AS decision_id, doc_id || '.pdf' AS pdf_name FROM (SELECT doc_id, 'parsed_doc_' || sha1('/in/' || source || '/' || doc_id || '.pdf|' || lang)[:16] AS document_id FROM documents)",
    "quality_gate": f"{R} SELECT document_id, level AS parse_quality_level, array_to_string(reasons, '; ') AS reasons FROM gate",
    "latest_decision": f"WITH {DECISION_SQL} SELECT document_id, review_decision, updated_at FROM last",
    "decision_list": f"WITH {DECISION_SQL} SELECT document_id, updated_at, ord FROM log WHERE review_decision = 'rejected' ORDER BY updated_at DESC, ord LIMIT 50",
    "decision_upsert": f"WITH {DECISION_SQL} SELECT document_id, CASE WHEN ord % 5 = 0 THEN 'ignored' ELSE review_decision END AS review_decision, CASE WHEN ord % 5 = 0 THEN ord + (SELECT max(ord) FROM last) + 1 ELSE ord END AS ord FROM last",
    "review_queue": f"{QUEUE} SELECT document_id, review_status, review_reasons, review_decision, {APPROVED} AS approved_for_extraction, NOT {APPROVED} AS requires_manual_check FROM queue",
    "review_queue_latest": f"{QUEUE} SELECT document_id, review_status, review_decision FROM queue ORDER BY registered_at DESC, k LIMIT 200",
    "queue_summary": f"{QUEUE} SELECT review_status, level AS parse_quality_level, count(*) AS n FROM queue GROUP BY ALL",
    "eligibility": f"{ELIGIBLE} SELECT document_id, len(why) = 0 AS eligible_for_extraction, CASE WHEN len(why) = 0 THEN 'approved for extraction' ELSE array_to_string(why, '; ') END AS reason, level AS parse_quality_level, review_decision, len(missing) = 0 AS required_files_present FROM e",
    "role_by_name": f"{NAMED} SELECT page_id, x.document_role, x.report_type, x.strategy, x.confidence, x.evidence, x.document_role = 'unknown' AS requires_review FROM pr",
    "page_sample": f"{SAMPLE} SELECT conv_id, sample FROM s",
    "role_by_content": f"{SAMPLE}, a AS (SELECT conv_id, {sql_role("CASE WHEN conv_id % 3 = 0 THEN " + inputs.sql_named("'conv'", "conv_id") + " ELSE 'conv' END", "filename")} AS x, {sql_role(inputs.sql_named("sample", "(conv_id + 5)"), "content")} AS y FROM s) SELECT conv_id, CASE x.document_role WHEN 'unknown' THEN y.document_role ELSE x.document_role END AS document_role, CASE x.document_role WHEN 'unknown' THEN y.report_type ELSE x.report_type END AS report_type, CASE x.document_role WHEN 'unknown' THEN y.evidence ELSE x.evidence END AS evidence FROM a",
    "cells_text": f"WITH {TEXT_SQL} SELECT 'text_table_' || doc_id AS table_id, CAST(r AS INT) AS row_index, CAST(col AS INT) AS col_index, txt AS text, r = 0 AS is_header FROM tc",
    "text_table_quality": f"WITH {TEXT_SQL}, a AS (SELECT doc_id, count(*) AS row_count, max(len(cells)) AS col_count FROM tr GROUP BY 1), b AS (SELECT doc_id, count(*) AS cells, count(*) FILTER ({sql_strip('txt')} = '') AS empty_cells, count(*) FILTER ({sql_numeric_like('txt')}) AS numeric_cells, bool_or(r = 0 AND {sql_strip('txt')} <> '') AS has_header FROM tc GROUP BY 1) SELECT 'text_table_' || doc_id AS table_id, row_count, CAST(col_count AS BIGINT) AS col_count, empty_cells, numeric_cells, has_header, empty_cells / (row_count * col_count) AS empty_ratio_exact, numeric_cells / cells AS numeric_ratio_exact FROM a JOIN b USING (doc_id)",
    "statement_type": f"SELECT doc_id, {sql_first('lower(body)', rules.STATEMENT_KEYWORDS)} AS statement_type FROM (SELECT doc_id, text || CASE doc_id % 6 WHEN 0 THEN chr(10) || 'Cash Flow' WHEN 1 THEN ' 分部' ELSE '' END AS body FROM documents)",
    "merged_tables": "SELECT o_custkey AS group_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS INT) AS row_index, l_partkey || '|' || l_returnflag AS cells FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "page_flags": "WITH p AS (SELECT CAST(l_orderkey % 500 AS VARCHAR) AS document_id, l_linenumber AS page_number, l_returnflag, l_linestatus FROM lineitem WHERE l_linenumber <> 0 QUALIFY row_number() OVER (PARTITION BY l_orderkey % 500, l_linenumber ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC) = 1), d AS (SELECT CAST(a AS VARCHAR) AS document_id, CAST(b AS INT) AS page_number, a FROM range(500) x(a), range(1, 10) y(b)) SELECT document_id, page_number, l_returnflag AS parser_source, CASE WHEN l_returnflag = 'A' THEN l_linestatus WHEN a % 3 = 0 AND page_number <= 4 THEN 'other' ELSE '' END AS quality_flags FROM d LEFT JOIN p USING (document_id, page_number)",
    "parse_numbers": f"{NUMBERS} SELECT p_partkey, raw, {sql_number('raw')} AS value FROM nb",
    "numeric_like": f"{NUMBERS} SELECT p_partkey, regexp_matches(raw, '^[\\s,，\\-—()（）.%％0-9０-９]+$') AND regexp_matches(raw, '[0-9０-９]') AS numeric_like, {sql_any(sql_key('raw'), text.PERIOD_MARKERS)} AS period_like FROM nb",
    "suspicious_values": f"{NUMBERS}, v AS (SELECT *, {sql_number('raw')} AS value, {sql_strip('raw')} AS s FROM nb) SELECT p_partkey, s = '' OR (contains(s, chr(10)) AND length(s) <= 4) OR value IS NULL OR NOT regexp_matches(replace(s, ' ', ''), {PLAIN}) AS suspicious, s = '' OR (contains(s, chr(10)) AND length(s) <= 4) OR (value IS NULL AND regexp_matches(raw, '[0-9０-９]')) AS broken FROM v",
    "visual_items": f"WITH {inputs.VISUAL_SQL} SELECT document_id, ord, 'visual_table_check' AS review_type, reason, score AS confidence, table_group_id, 'Open the original PDF page and confirm whether visual tables were recovered correctly.' AS suggested_user_action, excerpt AS evidence_excerpt FROM vi",
    "registry_manifests": f"{R} SELECT document_id, parse_task_id AS task_id, pdf_name, '' AS summary_path FROM reg",
    "ingest_results": f"{R} SELECT parse_task_id, 'parsed_doc_' || sha1('/in/' || pdf_name || '|' || parse_task_id)[:16] AS document_id, pdf_name, level AS parse_quality_level, '/s.json' AS summary_path, CASE WHEN k % 2 = 0 THEN k ELSE k + (SELECT max(k) FROM reg WHERE k % 2 = 0) + 1 END AS ord FROM gate",
    "role_items": f"{NAMED}, y AS (SELECT page_id, x.*, page_id % 20 AS c, page_id % 4 AS s FROM pr) SELECT CAST(page_id AS VARCHAR) AS document_id, 'auxiliary_material_role_check' AS review_type, CASE document_role WHEN 'unknown' THEN 'document role is unknown' WHEN 'auxiliary_material' THEN 'auxiliary material has many three-statement candidates: ' || c ELSE 'primary report has few extracted statements: ' || s END AS reason, confidence, evidence AS evidence_excerpt FROM y WHERE document_role = 'unknown' OR (document_role = 'auxiliary_material' AND c >= 10) OR (document_role = 'primary_financial_report' AND s < 2)",
    "task_manifests": "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN '/s.json' ELSE '/out/' || o_orderkey || '/summary.json' END AS summary_path, '/out/' || o_orderkey || '/pages.jsonl' AS pages_path, '/out/' || o_orderkey || '/merged_tables.json' AS merged_tables_path FROM orders",
}
