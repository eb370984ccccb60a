"""Queries that follow documents through several stages: the continuous gate, messages, the validation suite."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docstat.functions import rules, text
from docstat.operators import mapping, messages, normalize, quality, registry, review, rule_tables, statements, tables, validation
from docstat.plans import inputs
from docstat.plans.inputs import DECISION_SQL, REGISTRY_SQL, line_origins, line_rows
from docstat.plans.line_plans import ALIAS_HIT, APPROVED, CHAIN, ELIGIBILITY_SQL, FIELD, GATE_SQL, ORACLES as LINE_ORACLES, ROLE_LINES, WEAK, _alias_values, _fields, _gate, _tables, sql_first, sql_key
from docstat.plans.registry_plans import QUEUE
from docstat.sources import store
from docstat.streaming import gate


def eligibility_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The table that both logs keep up to date as streams, each in several batches."""
    root = store.folder(spark, "gate")
    entries, log = inputs.registry(spark, sf), inputs.decision_log(spark, sf)
    entries.repartitionByRange(4, "ord").write.parquet(f"{root}/entries")
    log.repartitionByRange(6, F.col("ord").desc()).write.parquet(f"{root}/decisions")
    into = gate.table(spark, f"{root}/table")
    streams = gate.file_streams(spark, (f"{root}/entries", entries.schema), (f"{root}/decisions", log.schema), 3)
    gate.follow(*streams, into, f"{root}/checkpoint").awaitTermination()
    into.compact()
    return into.read().select("document_id", "eligible_for_extraction", "reason", "parse_quality_level", "review_decision", "required_files_present", "approved_for_extraction", "requires_manual_check", "review_status", F.array_join("review_reasons", "; ").alias("review_reasons"))


def decision_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions per hour and kind."""
    return gate.rates(inputs.decision_log(spark, sf))


#: What messages and report read of a field candidate.
COUNTED = ("document_id", "ord", "candidate_statement_type", "canonical_field_name", "period_label", "source_pages", "table_group_id", "mapping_reason", "confidence", "unit", "requires_review")


def _stages(spark, sf):
    """(gate, normalisation messages, candidates without table, tables, field candidates) of the line items' documents; candidates of every ninth table name one that is gone."""
    made = store.written(line_origins(tables.types(line_rows(spark, sf))).select(*tables.TABLE, "candidate_statement_type", "source_pages", "table_group_id"), "tables")  # types only: the fields come from the lines, whose shuffle is smaller than the tables
    fields = store.written(_fields(spark, sf).select(*COUNTED), "fields")
    found = normalize.file_messages(inputs.files_by_document(spark, sf))
    selected = made.where(F.col("candidate_statement_type").isin(*rules.CANDIDATE_TYPES))
    old = selected.where("table_ord % 9 = 0").withColumn("table_id", F.concat("table_id", F.lit("_old")))
    said, missing = messages.of_normalization(found), mapping.missing_tables(selected.unionByName(old), made, ordered=True)
    return store.written(_gate(spark, sf, *ASSESSED), "gate"), store.written(said, "messages"), store.written(missing, "missing"), made, fields


#: What the report reads of an assessed entry.
ASSESSED = ("parse_task_id", "missing_files", "pages_count", "total_pages", "parse_quality_level", "merged_md", "review_decision", "required_files_present")


def _of_extraction(gated, found, missing, counts, override):
    return messages.of_extraction(gated, found, missing, counts.select("document_id", "n_discarded"), counts.select("document_id", F.col("n_passed_over").alias("n_discarded")), override)


def extraction_messages(spark: SparkSession, sf: str) -> DataFrame:
    """What the extraction of every document of the registry says, in order, with and without override."""
    gated, found, missing, _, fields = _stages(spark, sf)
    counts = store.written(statements.document_counts(fields), "counts")
    shown = lambda forced: messages.ordered(_of_extraction(gated, found, missing, counts, forced)).withColumn("override", F.lit(forced))
    return shown(False).unionByName(shown(True))


def _report(spark, sf):
    gated, found, missing, made, fields = _stages(spark, sf)
    counts = store.written(statements.document_counts(fields), "counts")
    mapped = counts.select(
        "document_id", F.col("n_fields").alias("mapped_count"), F.col("n_kept").alias("fields_count"), F.col("unknown_unit").alias("unknown_unit_count"), F.col("unknown_period").alias("unknown_period_count"), F.col("n_review").alias("requires_review_count"), "confidence_sum",
    )
    passing = gated.where("document_role <> 'auxiliary_material'").select("document_id")
    chosen = counts.join(passing, "document_id", "left_semi").select("document_id", F.col("n_statements").alias("statement_count"), F.col("n_chosen").alias("field_count"))
    said = {"normalization": found, "extraction": _of_extraction(gated, found, missing, counts, True)}
    return validation.report_of(gated, made, said, mapped, chosen)


def document_report(spark: SparkSession, sf: str) -> DataFrame:
    """What every stage made of each document of the registry."""
    return _report(spark, sf).select("document_id", "task_copies", "normal_mode", "canonical_tables_count", "candidates_count", "discarded_candidates_count", "fields_count", "requires_review_count", "statement_count", "field_count", "normalization_errors", "extraction_errors")


def validation_suite(spark: SparkSession, sf: str) -> DataFrame:
    """The seven data checks, observed while the documents' report is written."""
    rows, seen = validation.watched(_report(spark, sf))
    rows.write.parquet(store.folder(spark, "report"))
    return validation.results(spark, seen)


def map_all_periods(spark: SparkSession, sf: str) -> DataFrame:
    """Field candidates with one for each period of a row."""
    return mapping.map_fields(_tables(spark, sf), all_periods=True).select(*FIELD)


def discard_examples(spark: SparkSession, sf: str) -> DataFrame:
    """The first ten candidates that each document's mapping discards."""
    return statements.discard_examples(_fields(spark, sf))


def map_fields_by_table(spark: SparkSession, sf: str) -> DataFrame:
    """map_fields with the rules as a table that labels are joined with."""
    return mapping.map_fields_by(store.written(_tables(spark, sf), "tables"), rules.aliases(spark)).select(*FIELD)


def _many_rules(spark, sf):
    """The rules, and thousands of others made of parts' names."""
    names = inputs.read(spark, sf, "part").select("p_partkey", "p_name")
    kind = F.element_at(F.array(*map(F.lit, rules.MAPPED_TYPES)), (F.col("p_partkey") % 4 + 1).cast("int"))
    alias = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.substring("p_name", 3, 9))
    more = names.select(kind.alias("statement_type"), F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("field"), F.lit("number").alias("value_type"), (F.col("p_partkey") + 100).cast("int").alias("rule_ord"), (F.col("p_partkey") % 3).cast("int").alias("class_ord"), text.match_key(alias).alias("key"))
    return rules.aliases(spark).unionByName(more.where("key <> ''"))


def rule_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Parts' names as labels of every type, against as many rules as there are parts."""
    labels = inputs.read(spark, sf, "part").select(F.explode(F.array(*map(F.lit, rules.MAPPED_TYPES))).alias("statement_type"), text.match_key(F.col("p_name")).alias("key")).distinct()
    return rule_tables.alias_matches(labels, _many_rules(spark, sf))


def roles_by_table(spark: SparkSession, sf: str) -> DataFrame:
    """The first role pattern in each page's name, with the patterns as a table."""
    patterns = [(i, "".join(p.lower().split())) for i, p in enumerate(p for _, _, ps in rules.ROLES for p in ps)]
    pages = inputs.read(spark, sf, "pages").select("page_id", text.match_key(inputs.named(F.col("url"), F.col("page_id"))).alias("key"))
    return rule_tables.first_matches(pages, spark.createDataFrame(patterns, "ord int, pattern string")).select("page_id", "ord")


def canonical_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Tables as the records of the canonical contract."""
    rows = line_rows(spark, sf)
    sources = line_origins(rows.select(*tables.TABLE).distinct()).withColumn("title", F.when(F.col("table_ord") % 10 == 4, "Balance Sheet").otherwise(""))
    made = tables.canonical(rows, sources)
    cell = F.transform("cells", lambda c: F.concat_ws(":", c["row_index"], c["col_index"], c["is_header"], c["row_span"], c["col_span"], c["text"]))
    return made.select("table_id", "title", "source.source_type", "source.table_group_id", "quality.row_count", "quality.continuation_confidence", F.size("cells").cast("long").alias("n_cells"), F.md5(F.array_join(cell, "|")).alias("cells_md5"), F.md5("raw_markdown").alias("markdown_md5"), "candidate_statement_type")


def registry_by_path(spark: SparkSession, sf: str) -> DataFrame:
    """Entries by a path, whichever way its separators lean."""
    path = F.concat(F.lit("C:/in/"), (F.col("ord") % 100).cast("string"), F.lit("/a.pdf"))
    entries = inputs.registry(spark, sf).select("document_id", "ord", F.when(F.col("ord") % 2 == 0, F.translate(path, "/", "\\")).otherwise(path).alias("pdf_path"))
    return registry.by_pdf_path(entries, r"C:\in/7\a.pdf").unionByName(registry.by_pdf_path(entries, "C:/in/8/a.pdf")).select("document_id", "pdf_path")


def manifest_files(spark: SparkSession, sf: str) -> DataFrame:
    """What normalisation reads of manifests that name their files in either way."""
    key = F.col("o_orderkey")
    named = lambda name, by: F.when(key % by == 0, F.concat(F.lit(f"/{name}/"), key.cast("string"))).otherwise("").alias(name)
    orders = inputs.read(spark, sf, "orders").select(key.cast("string").alias("document_id"), named("task_id", 2), F.concat(F.lit("t"), key).alias("parse_task_id"), named("tables_json_path", 3), named("tables_json", 2), named("pages_jsonl", 5))
    return registry.manifest_files(orders)


def readiness_reports(spark: SparkSession, sf: str) -> DataFrame:
    """The readiness report of every document of the registry."""
    known = quality.assess(inputs.registry(spark, sf))
    eligible = review.eligibility(known.select("document_id"), known, inputs.decision_log(spark, sf))
    documents = eligible.join(known.select("document_id", "pages_count", "total_pages"), "document_id")
    said = messages.lists(messages.of_normalization(normalize.normalize(*inputs.parser_files(spark, sf))[2]))
    return validation.readiness_reports(documents, _tables(spark, sf), said).select("document_id", F.md5("value").alias("report_md5"), F.length("value").alias("n_chars"))


QUERIES = {
    f.__name__: f
    for f in (eligibility_stream, decision_rates, extraction_messages, document_report, validation_suite, map_all_periods, discard_examples, map_fields_by_table, rule_matches, roles_by_table, canonical_tables, registry_by_path, manifest_files, readiness_reports)
}

MAPPED = ", ".join(f"'{kind}'" for kind in rules.MAPPED_TYPES)
#: Messages as lists in the order in which they are said, from the rules of each stage.
MESSAGES = f"""
dn AS (SELECT DISTINCT 'doc_' || (o // 8) AS document_id, o // 8 AS dno FROM l),
gone AS (SELECT document_id, list('canonical table not found for candidate table_id=' || table_id || '_old' ORDER BY o) AS gone FROM cand WHERE kind IN ({MAPPED}) AND o % 9 = 0 GROUP BY 1),
dm AS (SELECT document_id, count(*) - count(DISTINCT (field, period, page)) AS n1 FROM f GROUP BY 1),
ds AS (SELECT document_id, count(*) - count(DISTINCT (kind, field, period)) AS n2 FROM d GROUP BY 1),
m0 AS (SELECT gt.document_id, override, ok, role.document_role = 'auxiliary_material' AS aux, role.document_role = 'unknown' AS lost, role.evidence AS evidence, reason, {ROLE_LINES} AS lines,
  list_concat(CASE WHEN dno % 10 = 3 THEN ['tables_json normalization failed: not valid JSON'] ELSE [] END, CASE WHEN dno % 14 = 4 THEN ['merged_tables_json normalization failed: not a list'] ELSE [] END) AS ne,
  CASE WHEN dno % 10 = 3 THEN ['no canonical tables generated'] ELSE [] END AS nw, coalesce(gone, []) AS gone, coalesce(n1, 0) AS n1, coalesce(n2, 0) AS n2,
  CASE WHEN ok OR NOT override THEN [] ELSE ['override_used', 'eligibility_block_reason=' || reason] END AS forced
  FROM gt LEFT JOIN dn USING (document_id) LEFT JOIN gone USING (document_id) LEFT JOIN dm USING (document_id) LEFT JOIN ds USING (document_id), (VALUES (false), (true)) AS v(override)),
m1 AS (SELECT *, NOT aux AND (override OR (NOT lost AND ok)) AS passing FROM m0),
m2 AS (
  SELECT document_id, override, 'warning' AS severity, CASE
    WHEN aux THEN list_transform(list_concat(['auxiliary_material_no_three_statement_expected'], lines), lambda x: ['extraction', x])
    WHEN passing THEN list_concat(list_transform(lines, lambda x: ['extraction', x]), list_transform(nw, lambda x: ['normalization', x]), list_transform(forced, lambda x: ['candidates', x]),
      CASE WHEN n1 > 0 THEN [['mapping', 'discarded_candidates_count=' || n1]] ELSE [] END, list_transform(forced, lambda x: ['extraction', x]), CASE WHEN n2 > 0 THEN [['extraction', 'discarded_field_candidates_count=' || n2]] ELSE [] END)
    WHEN lost THEN list_concat([['extraction', 'document_role_unknown_requires_review']], CASE WHEN evidence <> '' THEN [['extraction', evidence]] ELSE [] END)
    ELSE [['extraction', reason]] END AS said FROM m1
  UNION ALL SELECT document_id, override, 'error', CASE WHEN passing THEN list_concat(list_transform(ne, lambda x: ['normalization', x]), list_transform(ne, lambda x: ['mapping', x]), list_transform(gone, lambda x: ['mapping', x])) ELSE [] END FROM m1),
said AS (SELECT document_id, override, severity, unnest(said) AS s, generate_subscripts(said, 1) - 1 AS seq FROM m2 WHERE len(said) > 0)
"""
REPORT = f"""{CHAIN}{GATE_SQL}, {MESSAGES},
tc AS (SELECT document_id, count(*) AS canonical_tables_count, count(*) FILTER (kind <> 'unknown') AS candidates_count, count(*) FILTER (table_group_id <> '') AS grouped FROM t GROUP BY 1),
fc AS (SELECT document_id, count(*) AS n FROM f GROUP BY 1),
kc AS (SELECT document_id, count(*) AS fields_count, count(*) FILTER (requires_review) AS requires_review_count, count(*) FILTER (unit = 'unknown') AS uu, count(*) FILTER (period = 'unknown_period') AS up FROM d GROUP BY 1),
sc AS (SELECT document_id, count(DISTINCT kind) AS statement_count, count(*) AS field_count FROM b JOIN gt USING (document_id) WHERE role.document_role <> 'auxiliary_material' GROUP BY 1),
nc AS (SELECT document_id, CASE WHEN dno % 10 = 3 THEN 1 ELSE 0 END + CASE WHEN dno % 14 = 4 THEN 1 ELSE 0 END AS normalization_errors FROM dn),
xc AS (SELECT document_id, count(*) AS extraction_errors FROM said WHERE override AND severity = 'error' GROUP BY 1),
rp AS (SELECT gate.document_id, gate.k, count(*) OVER (PARTITION BY gate.parse_task_id) AS task_copies, CASE WHEN gt.ok THEN 'eligible' ELSE 'blocked' END AS normal_mode, gt.ok, coalesce(canonical_tables_count, 0) AS canonical_tables_count, coalesce(grouped, 0) AS grouped,
  coalesce(candidates_count, 0) AS candidates_count, coalesce(fc.n, 0) - coalesce(fields_count, 0) AS discarded_candidates_count, coalesce(fields_count, 0) AS fields_count, coalesce(requires_review_count, 0) AS requires_review_count,
  coalesce(uu, 0) AS uu, coalesce(up, 0) AS up, coalesce(statement_count, 0) AS statement_count, coalesce(field_count, 0) AS field_count, CAST(coalesce(normalization_errors, 0) AS BIGINT) AS normalization_errors, coalesce(extraction_errors, 0) AS extraction_errors,
  len(gate.missing_files) > 0 AS incomplete, (CASE WHEN gate.pages_count IS DISTINCT FROM CASE WHEN coalesce(total, 0) = 0 THEN -1 ELSE total END THEN 1 ELSE 0 END) + (CASE WHEN md <> 'ok' THEN 1 ELSE 0 END) AS quality_errors, md, review_decision
  FROM gate JOIN gt USING (document_id) LEFT JOIN last USING (document_id) LEFT JOIN tc USING (document_id) LEFT JOIN fc USING (document_id) LEFT JOIN kc USING (document_id) LEFT JOIN sc USING (document_id) LEFT JOIN nc USING (document_id) LEFT JOIN xc USING (document_id))
"""
SUITE = f"""SELECT check_name, CASE n_errors WHEN 0 THEN 'passed' ELSE 'failed' END AS status, n_errors, coalesce(example, '') AS example, details, true AS machine_determined FROM (
  SELECT 'registry' AS check_name, CAST(count(*) FILTER (task_copies > 1) + count(*) FILTER (incomplete) AS BIGINT) AS n_errors, min(document_id) FILTER (task_copies > 1 OR incomplete) AS example,
    printf('{{"registry_count":%d,"duplicates":%d,"missing_files":%d}}', count(*), count(*) FILTER (task_copies > 1), count(*) FILTER (incomplete)) AS details FROM rp
  UNION ALL SELECT 'quality_gate', CAST(sum(quality_errors) AS BIGINT), min(document_id) FILTER (quality_errors > 0), printf('{{"documents":%d,"merged_non_empty":%d}}', count(*), count(*) FILTER (md = 'ok')) FROM rp
  UNION ALL SELECT 'review_decision_eligibility', count(*) FILTER (approved AND NOT ok AND len(missing) = 0) + count(*) FILTER (NOT approved AND ok), min(document_id) FILTER ((approved AND NOT ok AND len(missing) = 0) OR (NOT approved AND ok)),
    printf('{{"review_queue_count":%d,"eligible_documents_count":%d}}', count(*), count(*) FILTER (ok)) FROM (SELECT e.document_id, missing, len(why) = 0 AS ok, {APPROVED} AS approved FROM e)
  UNION ALL SELECT 'table_normalization', CAST(sum(normalization_errors) AS BIGINT), min(document_id) FILTER (normalization_errors > 0), printf('{{"canonical_tables_count":%d,"source_pages_missing":0,"table_group_id_count":%d}}', CAST(sum(canonical_tables_count) AS BIGINT), CAST(sum(grouped) AS BIGINT)) FROM rp
  UNION ALL SELECT 'extraction_candidates', CAST(0 AS BIGINT), NULL, printf('{{"dry_run_documents_count":%d,"blocked":%d,"candidates_count":%d}}', count(*), count(*) FILTER (NOT ok), CAST(sum(candidates_count) AS BIGINT)) FROM rp
  UNION ALL SELECT 'statement_field_mapping_refinement', CAST(0 AS BIGINT), NULL, printf('{{"fields_count":%d,"unknown_unit_count":%d,"unknown_period_count":%d,"requires_review_count":%d}}', CAST(sum(fields_count) AS BIGINT), CAST(sum(uu) AS BIGINT), CAST(sum(up) AS BIGINT), CAST(sum(requires_review_count) AS BIGINT)) FROM rp
  UNION ALL SELECT 'minimal_extraction_dry_run', CAST(sum(extraction_errors) AS BIGINT), min(document_id) FILTER (extraction_errors > 0), printf('{{"statement_count":%d,"field_count":%d}}', CAST(sum(statement_count) AS BIGINT), CAST(sum(field_count) AS BIGINT)) FROM rp)"""

#: CHAIN with one field for each period of a row.
ALL_PERIODS = CHAIN[: CHAIN.index("f1 AS (")] + f"""fp AS (SELECT n.o, n.r, n.col, num IS NOT NULL AS is_number, txt <> '' AS is_text FROM n JOIN p USING (o, col) WHERE n.col >= 1),
f1 AS (SELECT rm.o, rm.kind, field, value_type, class_ord, rm.txt AS raw_field_name, rm.r, coalesce(fp.col, CASE value_type WHEN 'number' THEN num_col ELSE txt_col END, 1) AS vcol, 0 AS part, rm.r AS p1, rm.col AS p2, rule_ord AS p3, 'row_alias_match' AS how
  FROM rm LEFT JOIN fv USING (o, r) LEFT JOIN fp ON fp.o = rm.o AND fp.r = rm.r AND CASE value_type WHEN 'number' THEN fp.is_number ELSE fp.is_text END WHERE class_ord < 2 OR (any_number AND ({WEAK}))),
""" + CHAIN[CHAIN.index("cm AS (") :].replace("part, p1, p2, p3)", "part, p1, p2, p3, vcol)")
def _spread(names: str, prefix: str) -> str:
    """A JSON object of the counts above 0, as Spark writes it with line breaks."""
    kinds = names.split()
    return "CASE WHEN " + " + ".join(f"{prefix}{n}" for n in kinds) + " = 0 THEN '{ }' ELSE '{' || chr(10) || concat_ws(',' || chr(10), " + ", ".join(f"CASE WHEN {prefix}{n} > 0 THEN '  \"{n}\" : ' || {prefix}{n} END" for n in kinds) + ") || chr(10) || '}' END"


_TYPES = " ".join((*rules.CANDIDATE_TYPES, "unknown"))
_BLOCK = "'', '{}:', '', '```json', {}, '```'"
_LINE = "'- `{}`: `' || {} || '`'"
READINESS = f"""{CHAIN}{GATE_SQL},
dn AS (SELECT DISTINCT 'doc_' || (o // 8) AS document_id, o // 8 AS dno FROM l),
rt AS (SELECT document_id, count(*) AS n, count(*) FILTER (source_type = 'page_table') AS source_page_table, count(*) FILTER (source_type = 'merged_cross_page_table') AS source_merged_cross_page_table, count(DISTINCT page) AS pages, count(DISTINCT table_group_id) FILTER (table_group_id <> '') AS groups,
  {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in _TYPES.split())} FROM t GROUP BY 1),
rd AS (SELECT e.document_id, e.review_decision, len(why) = 0 AS ok, CASE WHEN len(why) = 0 THEN 'approved for extraction' ELSE array_to_string(why, '; ') END AS reason, coalesce(gate.pages_count, 0) AS pages_count, gate.total, dno,
  {", ".join(f"coalesce({c}, 0) AS {c}" for c in ("n", "source_page_table", "source_merged_cross_page_table", "pages", "groups", *(f"n_{k}" for k in _TYPES.split())))}
  FROM e JOIN gate USING (document_id) LEFT JOIN rt USING (document_id) LEFT JOIN dn USING (document_id)),
rv AS (SELECT document_id, array_to_string(['# Financial Extraction Adapter Readiness Report', '', '## Document', '', {_LINE.format("document_id", "document_id")}, {_LINE.format("current_review_decision", "review_decision")}, {_LINE.format("eligible_for_extraction", "CASE WHEN ok THEN 'True' ELSE 'False' END")}, {_LINE.format("eligibility_reason", "reason")},
  '', '## Table Normalization', '', {_LINE.format("total_tables", "n")}, {_LINE.format("canonical_tables_count", "n")}, {_LINE.format("merged_cross_page_tables_count", "source_merged_cross_page_table")}, {_LINE.format("source_pages_count", "pages")}, {_LINE.format("table_group_id_count", "groups")}, {_LINE.format("pages_count", "pages_count")}, {_LINE.format("summary_total_pages", "coalesce(CAST(total AS VARCHAR), 'None')")},
  {_BLOCK.format("Candidate statement type distribution", _spread(_TYPES, "n_"))}, {_BLOCK.format("Source type distribution", _spread("page_table merged_cross_page_table", "source_"))},
  {_BLOCK.format("Warnings", "CASE WHEN dno % 10 = 3 THEN '[" + chr(34) + "no canonical tables generated" + chr(34) + "]' ELSE '[]' END")},
  {_BLOCK.format("Errors", "'[' || concat_ws(',', CASE WHEN dno % 10 = 3 THEN '" + chr(34) + "tables_json normalization failed: not valid JSON" + chr(34) + "' END, CASE WHEN dno % 14 = 4 THEN '" + chr(34) + "merged_tables_json normalization failed: not a list" + chr(34) + "' END) || ']'")}, ''], chr(10)) AS value FROM rd)
SELECT document_id, md5(value) AS report_md5, CAST(length(value) AS INT) AS n_chars FROM rv"""
MANY_RULES = f"""WITH rl AS (SELECT kind AS statement_type, field, value_type, rule_ord, class_ord, akey FROM {_alias_values()}
  UNION ALL SELECT (['balance_sheet', 'income_statement', 'cash_flow_statement', 'shareholder_table'])[p_partkey % 4 + 1], 'part_' || p_partkey, 'number', p_partkey + 100, p_partkey % 3, akey
  FROM (SELECT p_partkey, {sql_key("CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_name[3:11] END")} AS akey FROM part) WHERE akey <> ''),
lb AS (SELECT DISTINCT {sql_key("p_name")} AS ckey FROM part)"""

ORACLES = {
    "map_all_periods": ALL_PERIODS + LINE_ORACLES["map_fields"].removeprefix(CHAIN),
    "map_fields_by_table": LINE_ORACLES["map_fields"],
    "discard_examples": f"""{CHAIN}, run AS (SELECT *, max(struct_pack(a := alias_score, c := confidence, o := -ord)) OVER (PARTITION BY document_id, field, period, page ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM f),
lost AS (SELECT document_id, ord AS arrival, CASE WHEN (alias_score, confidence) > (best.a, best.c) THEN -best.o ELSE ord END AS gone FROM run WHERE best IS NOT NULL QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY ord) <= 10)
SELECT lost.document_id, CAST(row_number() OVER (PARTITION BY lost.document_id ORDER BY arrival) - 1 AS INT) AS place, field AS canonical_field_name, raw_field_name, raw_value, table_id, confidence, mapping_reason FROM lost JOIN f ON f.document_id = lost.document_id AND f.ord = gone""",
    "rule_matches": f"{MANY_RULES} SELECT statement_type, ckey AS key, first(field) AS field, first(value_type) AS value_type, CAST(rule_ord AS INT) AS rule_ord, CAST(min(class_ord) AS INT) AS class_ord FROM lb, rl WHERE ckey <> '' AND {ALIAS_HIT} GROUP BY statement_type, ckey, rule_ord",
    "roles_by_table": f"""SELECT page_id, CAST(CASE {" ".join(f"WHEN contains(key, '{''.join(p.lower().split())}') THEN {i}" for i, p in enumerate(p for _, _, ps in rules.ROLES for p in ps))} END AS INT) AS ord FROM (SELECT page_id, {sql_key(inputs.sql_named("url", "page_id"))} AS key FROM pages)""",
    "canonical_tables": CHAIN
    + f""", tt AS (SELECT *, CASE WHEN o % 10 = 4 THEN 'Balance Sheet' ELSE '' END AS title FROM t),
cl AS (SELECT o, count(*) AS n_cells, md5(string_agg(concat_ws(':', r, col, r = 0, 1, 1, txt), '|' ORDER BY r, col)) AS cells_md5 FROM c GROUP BY 1),
md AS (SELECT o, md5(string_agg('| ' || array_to_string(cells, ' | ') || ' |' || CASE r.r WHEN 0 THEN chr(10) || '| --- | --- | --- | --- |' ELSE '' END, chr(10) ORDER BY r.r)) AS markdown_md5 FROM r GROUP BY 1)
SELECT table_id, title, source_type, table_group_id, row_count, continuation_confidence::DOUBLE AS continuation_confidence, n_cells, cells_md5, markdown_md5, {sql_first("lower(title || chr(10) || raw_text)", rules.STATEMENT_KEYWORDS)} AS candidate_statement_type FROM tt JOIN cl USING (o) JOIN md USING (o)""",
    "registry_by_path": "SELECT 'doc_' || o_orderkey AS document_id, CASE WHEN o_orderkey % 2 = 0 THEN replace(p, '/', chr(92)) ELSE p END AS pdf_path FROM (SELECT o_orderkey, 'C:/in/' || (o_orderkey % 100) || '/a.pdf' AS p FROM orders) WHERE o_orderkey % 100 IN (7, 8)",
    "manifest_files": "SELECT CAST(k AS VARCHAR) AS document_id, CASE WHEN k % 2 = 0 THEN '/task_id/' || k ELSE 't' || k END AS task_id, '' AS pdf_name, CASE WHEN k % 3 = 0 THEN '/tables_json_path/' || k WHEN k % 2 = 0 THEN '/tables_json/' || k ELSE '' END AS tables_path, '' AS merged_tables_path, '' AS quality_flags_path, CASE WHEN k % 5 = 0 THEN '/pages_jsonl/' || k ELSE '' END AS pages_path FROM (SELECT o_orderkey AS k FROM orders)",
    "readiness_reports": READINESS,
    "eligibility_stream": f"""{QUEUE}, want AS (SELECT document_id FROM reg UNION SELECT document_id FROM last), {ELIGIBILITY_SQL}
SELECT e.document_id, len(why) = 0 AS eligible_for_extraction, CASE WHEN len(why) = 0 THEN 'approved for extraction' ELSE array_to_string(why, '; ') END AS reason, e.level AS parse_quality_level, e.review_decision,
  len(missing) = 0 AS required_files_present, e.{APPROVED} AS approved_for_extraction, NOT e.{APPROVED} AS requires_manual_check, review_status, review_reasons FROM e LEFT JOIN queue USING (document_id)""",
    "decision_rates": f"WITH {DECISION_SQL} SELECT date_trunc('hour', ts) AS window_start, review_decision, count(*) AS n FROM (SELECT review_decision, strptime(updated_at, '%Y-%m-%dT%H:%M:%SZ') AS ts FROM log) GROUP BY ALL",
    "extraction_messages": f"{CHAIN}{GATE_SQL}, {MESSAGES} SELECT document_id, override, severity, CAST(seq AS INT) AS seq, s[1] AS stage, s[2] AS text FROM said",
    "document_report": f"{REPORT} SELECT document_id, task_copies, normal_mode, canonical_tables_count, candidates_count, discarded_candidates_count, fields_count, requires_review_count, statement_count, field_count, normalization_errors, extraction_errors FROM rp",
    "validation_suite": f"{REPORT} {SUITE}",
}
