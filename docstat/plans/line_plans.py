"""Queries over tables made from line items: cells, quality, candidates, mapping, statements, review items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docstat.functions import rules, text
from docstat.operators import candidates, dedup, mapping, normalize, quality, review, review_pack, roles, statements, tables, validation
from docstat.plans import inputs
from docstat.plans.inputs import DECISION_SQL, LINE_SQL, REGISTRY_SQL, line_origins, line_rows
from docstat.sources import store

FIELD = ("ord", "document_id", "table_id", "candidate_statement_type", "canonical_field_name", "raw_field_name", "raw_value", "normalized_value", "unit", "currency", "period_label", "source_row_index", "source_col_index", "confidence", "mapping_reason", "requires_review", "field_id")


def _tables(spark, sf, documents=None):
    return line_origins(mapping.table_rows(line_rows(spark, sf, documents)))


def _fields(spark, sf, documents=None):
    return mapping.map_fields(_tables(spark, sf, documents))


def cells_page(spark: SparkSession, sf: str) -> DataFrame:
    return tables.cells(line_rows(spark, sf)).select("document_id", "table_id", "row_index", "col_index", "text", "is_header")


def sparse_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows rebuilt from the cells that aren't empty."""
    kept = tables.cells(line_rows(spark, sf)).where("text <> ''")
    return tables.rows_of(kept).select("table_id", "row_index", F.array_join("cells", "|").alias("cells"))


def table_quality(spark: SparkSession, sf: str) -> DataFrame:
    return tables.tables(line_rows(spark, sf)).select("table_id", "row_count", "col_count", "cell_count", "empty_cells", "numeric_cells", "has_header", "empty_ratio_exact", "numeric_ratio_exact", "candidate_statement_type")


def table_raw_text(spark: SparkSession, sf: str) -> DataFrame:
    return tables.tables(line_rows(spark, sf)).select("table_id", "raw_text")


def table_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return tables.markdown(line_rows(spark, sf)).select("table_id", "raw_markdown")


def table_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return candidates.select_candidates(_tables(spark, sf)).select("candidate_id", "table_id", "candidate_statement_type", "confidence", F.array_join("extraction_notes", "; ").alias("extraction_notes"), "requires_review")


def candidate_summary(spark: SparkSession, sf: str) -> DataFrame:
    return candidates.candidate_summary(candidates.select_candidates(_tables(spark, sf)))


def header_rows(spark: SparkSession, sf: str) -> DataFrame:
    return mapping.header_rows(_tables(spark, sf)).select("table_id", "row_index")


def period_columns(spark: SparkSession, sf: str) -> DataFrame:
    return mapping.period_columns(_tables(spark, sf)).select("table_id", "col_index", "period_label")


def unit_currency(spark: SparkSession, sf: str) -> DataFrame:
    return mapping.units(tables.tables(line_rows(spark, sf))).select("table_id", "unit", "currency")


def alias_match(spark: SparkSession, sf: str) -> DataFrame:
    """Parts' names and the aliases' own texts against all rules."""
    names = inputs.read(spark, sf, "part").select(F.col("p_name").alias("label")).distinct()
    own = rules.aliases(spark).select(F.concat(F.col("key"), F.lit(" 合计")).alias("label")).union(rules.aliases(spark).select(F.upper("key"))).distinct()
    kinds = F.explode(F.array(*map(F.lit, rules.MAPPED_TYPES))).alias("candidate_statement_type")
    return mapping.alias_matches(names.union(own).distinct().select("label", kinds)).select("candidate_statement_type", "label", "field", mapping.class_name(F.col("class_ord")).alias("match_type"))


def map_fields(spark: SparkSession, sf: str) -> DataFrame:
    return _fields(spark, sf).select(*FIELD)


def map_columns(spark: SparkSession, sf: str) -> DataFrame:
    return _fields(spark, sf).where(F.col("mapping_reason").startswith("shareholder_column")).select("table_id", "canonical_field_name", "raw_value", "source_row_index", "source_col_index", "confidence")


def dedup_fields(spark: SparkSession, sf: str) -> DataFrame:
    return statements.deduplicate_fields(_fields(spark, sf)).select("document_id", "ord", "canonical_field_name", "period_label", "confidence")


def discard_log(spark: SparkSession, sf: str) -> DataFrame:
    log = dedup.discard_log(_fields(spark, sf), ["document_id", "canonical_field_name", "period_label", "source_pages"], dedup.mapping_rank())
    return log.select("document_id", "canonical_field_name", "period_label", "arrival", "discarded")


def best_candidate(spark: SparkSession, sf: str) -> DataFrame:
    return statements.best_fields(statements.deduplicate_fields(_fields(spark, sf))).select("document_id", "ord", "candidate_statement_type", "canonical_field_name", "period_label", "raw_value", "confidence")


def discarded_counts(spark: SparkSession, sf: str) -> DataFrame:
    return statements.discarded_counts(_fields(spark, sf))


def statements_query(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: from rows to statements."""
    made = statements.statements(statements.best_fields(statements.deduplicate_fields(_fields(spark, sf))))
    shown = F.transform("fields", lambda f: F.concat_ws("=", f["period_label"], f["canonical_field_name"], f["raw_value"]))
    return made.select("document_id", "statement_type", F.array_join(shown, ";").alias("fields"), F.array_join("periods_detected", ",").alias("periods_detected"), F.array_join(F.col("source_pages").cast("array<string>"), ",").alias("source_pages"), "requires_review")


def mapping_stats(spark: SparkSession, sf: str) -> DataFrame:
    return statements.mapping_stats(_fields(spark, sf))


def field_distribution(spark: SparkSession, sf: str) -> DataFrame:
    """Mapping statistics of each canonical field."""
    return statements.mapping_stats(_fields(spark, sf), "canonical_field_name")


def mapping_warnings(spark: SparkSession, sf: str) -> DataFrame:
    return statements.mapping_discards(_fields(spark, sf)).select("document_id", "n_fields", "n_discarded", "warning")


def missing_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates against tables of which every ninth is lost."""
    made = _tables(spark, sf)
    return mapping.missing_tables(candidates.select_candidates(made), made.where("table_ord % 9 <> 0"))


def normalization_stats(spark: SparkSession, sf: str) -> DataFrame:
    return validation.normalization_stats(_tables(spark, sf))


def readiness(spark: SparkSession, sf: str) -> DataFrame:
    shown = lambda c: F.array_join(F.col(c).cast("array<string>"), ";").alias(c)
    return validation.readiness(_tables(spark, sf)).select("document_id", "total_tables", "merged_cross_page_tables_count", "n_balance_sheet", "n_income_statement", "n_cash_flow_statement", "n_shareholder_table", "n_unknown", shown("source_pages"), shown("table_group_ids"))


def three_statement_counts(spark: SparkSession, sf: str) -> DataFrame:
    return review_pack.three_statement_counts(candidates.select_candidates(_tables(spark, sf)))


def _gate(spark, sf, *more):
    """Role and eligibility of the registry's documents, and more columns of their assessed entries; the line items' documents are among them."""
    known = quality.assess(inputs.registry(spark, sf)).withColumn("pdf_name", inputs.named(F.col("pdf_name"), F.col("ord")))
    own = [c for c in ("pdf_name", *more) if c in known.columns and c != "parse_quality_level"]  # the level is eligibility's, too
    return roles.assess(review.eligibility_of_entries(known, inputs.decision_log(spark, sf), *own).select("document_id", "pdf_name", "eligible_for_extraction", "reason", *more))


def candidate_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Gate of every document with and without override."""
    gated = lambda forced: candidates.gate(_gate(spark, sf), forced).select("document_id", F.lit(forced).alias("override"), "extraction_mode", F.array_join("warnings", "; ").alias("warnings"))
    return gated(False).unionByName(gated(True))


def candidate_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates of eligible documents."""
    return candidates.candidate_set(_gate(spark, sf), _tables(spark, sf)).select("document_id", "table_id", "candidate_statement_type", "extraction_mode")


def normalized_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Tables of documents from their parser files, page and merged ones together; some files are damaged."""
    rows, source, messages = normalize.normalize(*inputs.parser_files(spark, sf))
    made = tables.tables(rows).join(source, list(tables.TABLE)).select("document_id", "table_id", "source_type", F.array_join(F.col("source_pages").cast("array<string>"), ",").alias("source_pages"), "table_group_id", "parser_source", F.array_join(F.flatten("quality_flags"), ",").alias("quality_flags"), "row_count", "cell_count")
    shown = messages.select("document_id", F.col("message").alias("table_id"), F.col("severity").alias("source_type"), *[F.lit("").alias(c) for c in ("source_pages", "table_group_id", "parser_source", "quality_flags")], F.lit(0).cast("long").alias("row_count"), F.lit(0).cast("long").alias("cell_count"))
    return made.unionByName(shown)


def _groups(spark, sf):
    grouped = F.col("table_group_id")
    order = inputs.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("table_ord")).distinct()
    made = line_origins(order).select(F.concat(F.lit("doc_"), F.expr("table_ord div 8").cast("string")).alias("document_id"), "table_group_id", "continuation_confidence")
    return made.where((grouped != "") & ~grouped.contains(",")).groupBy("document_id", "table_group_id").agg(F.max("continuation_confidence").alias("continuation_confidence"))


def continuation_min(spark: SparkSession, sf: str) -> DataFrame:
    return review_pack.continuation(_tables(spark, sf).select("document_id", "table_id", "table_group_id"), _groups(spark, sf)).select("table_id", "table_group_id", "continuation")


def _continued(fields, spark, sf):
    fields = review_pack.continuation(statements.deduplicate_fields(fields), _groups(spark, sf))
    return fields.withColumn("pdf_name", F.concat("document_id", F.lit(".pdf")))


def review_items(spark: SparkSession, sf: str) -> DataFrame:
    return review_pack.field_items(_continued(_fields(spark, sf), spark, sf)).select("document_id", "ord", "review_type", "reason", "evidence_excerpt")


#: What the pack's queries read of a field: the items, and the statements that fields make.
JUDGED = ("document_id", "ord", "candidate_statement_type", "review_type", "confidence", "table_group_id", "suggested_user_action")


def _pack(spark, sf):
    """Field, visual and role items of the same documents."""
    # judged in the lines' own parts, without a shuffle, and written as what is left to read
    fields = store.written(review_pack.judged(_continued(_fields(spark, sf), spark, sf)).select(*JUDGED, (F.col("reason") != "").alias("odd")), "fields")
    counts = review_pack.three_statement_counts(tables.types(line_rows(spark, sf)))
    gate = store.written(_gate(spark, sf).select("document_id", "pdf_name", "document_role", "confidence", "evidence", "eligible_for_extraction"), "gate")
    made = fields.select("document_id", "candidate_statement_type").distinct().groupBy("document_id").agg(F.count(F.lit(1)).alias("n_statements"))
    extracted = made.join(statements.passing(gate, override=True).select("document_id"), "document_id", "left_semi")
    none = {"n_three_statement": 0, "n_statements": 0}
    documents = gate.join(counts, "document_id", "left").join(extracted, "document_id", "left").fillna(none).withColumn("ord", F.lit(0).cast("long"))
    return review_pack.pack(fields.where("odd").drop("odd", "candidate_statement_type"), review_pack.visual_items(inputs.visual_pages(spark, sf)), review_pack.role_items(documents))


def review_top30(spark: SparkSession, sf: str) -> DataFrame:
    shown = ("document_id", "review_type", "ord", "rank", "table_group_id", "suggested_user_action")
    return review_pack.numbered(_pack(spark, sf).select(*shown)).select(*shown[:4], "review_item_id", *shown[4:])


def review_type_dist(spark: SparkSession, sf: str) -> DataFrame:
    return review_pack.type_distribution(_pack(spark, sf))


def gated_extraction(spark: SparkSession, sf: str) -> DataFrame:
    """Statements of documents that their role and eligibility let through."""
    through = store.written(statements.passing(_gate(spark, sf)), "passing")
    return statements.extract_passing(through, _fields(spark, sf, through)).select("document_id", "statement_type", "extraction_mode", F.size("fields").cast("long").alias("n_fields"))


def extraction_modes(spark: SparkSession, sf: str) -> DataFrame:
    """Mode and warnings of every document of the registry, with and without override."""
    gate = _gate(spark, sf).join(statements.mapping_discards(_fields(spark, sf)).select("document_id", "n_discarded"), "document_id", "left")
    shown = lambda forced: statements.extraction_warnings(gate, forced).select("document_id", F.lit(forced).alias("override"), "extraction_mode", F.array_join("warnings", "; ").alias("warnings"))
    return shown(False).unionByName(shown(True))


def validation_checks(spark: SparkSession, sf: str) -> DataFrame:
    """The consistency suite over the registry, and over all field candidates and those that de-duplication keeps."""
    known = quality.assess(inputs.registry(spark, sf))
    log = inputs.decision_log(spark, sf)
    fields = store.written(_fields(spark, sf).select("document_id", "ord", "canonical_field_name", "period_label", "source_pages", "mapping_reason", "confidence"), "fields")
    eligible = review.eligibility(known.select("document_id"), known, log)
    return validation.suite(validation.consistency(review.queue(known, log), eligible, fields, statements.deduplicate_fields(fields), known))


QUERIES = {
    f.__name__: f
    for f in (
        cells_page, sparse_rows, table_quality, table_raw_text, table_markdown, table_candidates, candidate_summary, header_rows, period_columns, unit_currency, alias_match, map_fields, map_columns,
        dedup_fields, discard_log, best_candidate, discarded_counts, mapping_stats, field_distribution, mapping_warnings, missing_tables,
        normalization_stats, readiness, three_statement_counts, candidate_gate, candidate_sets, normalized_documents, continuation_min, review_items, review_top30, review_type_dist, gated_extraction, extraction_modes, validation_checks,
    )
} | {"statements": statements_query}

# --- The same as DuckDB SQL, over cells in long form. ---

WS = r"[\x09-\x0D\x20\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def sql_key(x: str) -> str:
    return f"lower(regexp_replace({x}, '{WS}+', '', 'g'))"


def sql_number(x: str) -> str:
    t = f"translate({sql_strip(x)}, '{text.DROPPED}', '')"
    bare = f"translate(regexp_replace({t}, '^[{text.BRACKETS}]+|[{text.BRACKETS}]+$', '', 'g'), '{text.WIDE_DIGITS}', '{text.DIGITS}')"
    value = f"CASE WHEN regexp_matches({bare}, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN try_cast({bare} AS DOUBLE) END"
    return f"CASE WHEN ({t} LIKE '(%' AND {t} LIKE '%)') OR ({t} LIKE '（%' AND {t} LIKE '%）') THEN -({value}) ELSE {value} END"


def sql_numeric_like(x: str) -> str:
    return f"(regexp_matches({x}, '^[\\s,，\\-—()（）.%％\\d]+$') AND regexp_matches({x}, '\\d'))"


def sql_any(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


def sql_first(x: str, labelled) -> str:
    return "CASE " + " ".join(f"WHEN {sql_any(x, words)} THEN '{label}'" for label, words in labelled) + " ELSE 'unknown' END"


def sql_role(x: str, source: str) -> str:
    key, cases = sql_key(x), []
    for kind, report, patterns in rules.ROLES:
        primary = kind == "primary_financial_report"
        strategy = "three_statement_extraction" if primary else "transcript_or_commentary_extraction" if report == "conference_call_transcript" else "auxiliary_performance_extraction"
        for p in patterns:
            value = f"{{'document_role': '{kind}', 'report_type': '{report}', 'strategy': '{strategy}', 'confidence': {0.88 if primary else 0.86}::DOUBLE, 'evidence': '{source}:{p}'}}"
            cases.append(f"WHEN contains({key}, '{''.join(p.lower().split())}') THEN {value}")
    none = "{'document_role': 'unknown', 'report_type': 'unknown', 'strategy': 'unknown', 'confidence': 0::DOUBLE, 'evidence': ''}"
    return f"CASE {' '.join(cases)} ELSE {none} END"


APPROVED = "review_decision IN ('approved_for_extraction', 'approved_with_warnings')"
ELIGIBILITY_SQL = f"""
e0 AS (SELECT want.document_id, gate.k IS NOT NULL AS known, coalesce(level, '') AS level, coalesce(review_decision, 'pending_review') AS review_decision, CASE WHEN gate.k IS NULL THEN ['registry_entry'] ELSE missing_files END AS missing
  FROM want LEFT JOIN gate USING (document_id) LEFT JOIN last USING (document_id)),
e AS (SELECT *, list_filter([CASE WHEN NOT known THEN 'registry entry not found' END, CASE level WHEN 'failed' THEN 'parse_quality_level=failed' END, CASE WHEN NOT {APPROVED} THEN 'review_decision=' || review_decision END,
  CASE WHEN NOT {APPROVED} THEN 'approved_for_extraction=false' END, CASE WHEN len(missing) > 0 THEN 'missing_required_files=[''' || array_to_string(missing, ''', ''') || ''']' END], lambda x: x IS NOT NULL) AS why FROM e0)
"""
GATE_SQL = f""", {REGISTRY_SQL}, {DECISION_SQL}, want AS (SELECT document_id FROM reg), {ELIGIBILITY_SQL},
gt AS (SELECT e.document_id, len(e.why) = 0 AS ok, CASE WHEN len(e.why) = 0 THEN 'approved for extraction' ELSE array_to_string(e.why, '; ') END AS reason, {sql_role(inputs.sql_named("pdf_name", "reg.k"), "filename")} AS role FROM e JOIN reg USING (document_id))
"""
PACK_SQL = f""", {inputs.VISUAL_SQL},
ri AS (SELECT document_id, role, CASE role.document_role WHEN 'unknown' THEN true WHEN 'auxiliary_material' THEN coalesce(c, 0) >= 10 ELSE coalesce(s, 0) < 2 END AS odd
  FROM gt LEFT JOIN (SELECT document_id, count(*) FILTER (kind IN ('balance_sheet', 'income_statement', 'cash_flow_statement')) AS c FROM cand GROUP BY 1) USING (document_id)
  LEFT JOIN (SELECT document_id, count(DISTINCT kind) AS s FROM b GROUP BY 1) USING (document_id)),
all_items AS (SELECT document_id, ord, review_type, confidence, table_group_id, 0 AS part, 'Compare this mapped field with the original PDF table and confirm value, period, unit, and row label.' AS suggested_user_action FROM it WHERE len(why) > 0
  UNION ALL SELECT document_id, ord, 'visual_table_check', score, table_group_id, 1, 'Open the original PDF page and confirm whether visual tables were recovered correctly.' FROM vi
  UNION ALL SELECT document_id, 0, 'auxiliary_material_role_check', role.confidence, '', 2, 'Confirm whether this document is a primary financial report or auxiliary material before extraction.' FROM ri WHERE odd),
pk AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY CASE review_type WHEN 'cross_page_numeric_check' THEN 5 WHEN 'visual_table_check' THEN 4 WHEN 'field_mapping_semantic_check' THEN 3 ELSE 1 END DESC, 1 - confidence DESC, part, ord) AS rank FROM all_items QUALIFY rank <= 30)
"""


def _alias_values() -> str:
    rows = [(f[0], f[1], f[2], rule, k, "".join(a.split()).lower()) for rule, f in enumerate(rules.FIELDS) for k in range(3) for a in f[3 + k]]
    return "(VALUES " + ", ".join(f"('{a}', '{b}', '{c}', {d}, {e}, '{g}')" for a, b, c, d, e, g in rows) + ") AS t(kind, field, value_type, rule_ord, class_ord, akey)"


ALIAS_HIT = "((class_ord = 0 AND ckey = akey) OR (class_ord > 0 AND contains(ckey, akey)))"
CLASS_NAME = "(['exact_aliases', 'phrase_aliases', 'weak_aliases'])[class_ord + 1]"
SUSPICIOUS = f"({sql_strip('raw_value')} = '' OR (value_type = 'number' AND (normalized_value IS NULL OR NOT regexp_matches(replace({sql_strip('raw_value')}, ' ', ''), '{text.PLAIN_NUMBER}'))))"
WEAK = " OR ".join(f"(kind = '{k}' AND {sql_any('wkey', words)})" for k, words in rules.WEAK_CONTEXT)

CHAIN = f"""
WITH {LINE_SQL},
c AS (SELECT o, r, unnest(cells) AS txt, generate_subscripts(cells, 1) - 1 AS col FROM r),
n AS (SELECT *, {sql_number('txt')} AS num, {sql_key('txt')} AS ckey FROM c),
lines AS (SELECT o, r, array_to_string(cells, chr(9)) AS line, len(cells) AS width, array_to_string(cells, ' ') AS spaced FROM r),
raw AS (SELECT o, string_agg(line, chr(10) ORDER BY r) AS raw_text, count(*) AS row_count, max(width) AS col_count FROM lines GROUP BY o),
q AS (SELECT o, count(*) AS cell_count, count(*) FILTER ({sql_strip('txt')} = '') AS empty_cells, count(*) FILTER ({sql_numeric_like('txt')}) AS numeric_cells, bool_or(r = 0 AND {sql_strip('txt')} <> '') AS has_header FROM n GROUP BY o),
t AS (SELECT o.*, raw_text, row_count, col_count, cell_count, empty_cells, numeric_cells, has_header, empty_cells / (row_count * col_count) AS empty_exact, numeric_cells / cell_count AS numeric_exact,
  {sql_first('lower(raw_text)', rules.STATEMENT_KEYWORDS)} AS kind, {sql_first(sql_key('raw_text'), text.UNITS)} AS unit, {sql_first(sql_key('raw_text'), text.CURRENCIES)} AS currency FROM o JOIN raw USING (o) JOIN q USING (o)),
h0 AS (SELECT o, r, r < 3 AND ({sql_any(sql_key('spaced'), text.PERIOD_MARKERS)} OR (SELECT count(num) FROM n WHERE n.o = lines.o AND n.r = lines.r) <= greatest(1, width // 3)) AS likely FROM lines),
h AS (SELECT o, r, CASE WHEN bool_or(likely) OVER (PARTITION BY o) THEN likely ELSE r = 0 END AS is_header FROM h0),
p AS (SELECT o, col, arg_max({sql_strip('txt')}, r) AS period_label FROM n JOIN h USING (o, r) WHERE is_header AND {sql_any('ckey', text.PERIOD_MARKERS)} GROUP BY o, col),
w AS (SELECT o, r, {sql_key("string_agg(txt, ' ' ORDER BY col) FILTER (col < 2)")} AS wkey, bool_or(num IS NOT NULL AND col >= 1) AS any_number FROM n GROUP BY o, r),
lab AS (SELECT n.o, n.r, n.col, n.txt, n.ckey, t.kind, wkey, any_number FROM n JOIN h USING (o, r) JOIN t USING (o) JOIN w USING (o, r)
  WHERE NOT is_header AND n.col < 2 AND n.ckey <> '' AND n.num IS NULL AND t.kind IN ('balance_sheet', 'income_statement', 'cash_flow_statement', 'shareholder_table')
    AND (n.col = 0 OR EXISTS (FROM n m WHERE m.o = n.o AND m.r = n.r AND m.col > n.col AND m.num IS NOT NULL))
    AND EXISTS (FROM n m WHERE m.o = n.o AND m.r = n.r AND m.col > n.col AND CASE WHEN t.kind = 'shareholder_table' THEN {sql_strip('m.txt')} <> '' ELSE m.num IS NOT NULL END)),
al AS (SELECT * FROM {_alias_values()}),
rm AS (SELECT o, r, col, txt, kind, wkey, any_number, field, value_type, rule_ord, min(class_ord) AS class_ord FROM lab JOIN al USING (kind) WHERE {ALIAS_HIT} GROUP BY ALL),
fv AS (SELECT o, r, min(col) FILTER (num IS NOT NULL) AS num_col, min(col) FILTER (txt <> '') AS txt_col FROM n WHERE col >= 1 GROUP BY o, r),
f1 AS (SELECT rm.o, rm.kind, field, value_type, class_ord, rm.txt AS raw_field_name, rm.r, coalesce(CASE value_type WHEN 'number' THEN num_col ELSE txt_col END, 1) AS vcol, 0 AS part, rm.r AS p1, rm.col AS p2, rule_ord AS p3, 'row_alias_match' AS how
  FROM rm LEFT JOIN fv USING (o, r) WHERE class_ord < 2 OR (any_number AND ({WEAK}))),
cm AS (SELECT o, col, txt, t.kind, field, value_type, rule_ord, min(class_ord) AS class_ord FROM n JOIN t USING (o) JOIN al ON al.kind = t.kind WHERE t.kind = 'shareholder_table' AND r = 0 AND ckey <> '' AND {ALIAS_HIT} GROUP BY ALL),
f2 AS (SELECT cm.o, kind, field, value_type, class_ord, cm.txt AS raw_field_name, n.r, cm.col AS vcol, 1 AS part, cm.col AS p1, rule_ord AS p2, n.r AS p3, 'shareholder_column_alias_match' AS how
  FROM cm JOIN n ON n.o = cm.o AND n.col = cm.col AND n.r > 0 AND n.txt <> '' WHERE class_ord < 2),
f3 AS (SELECT * FROM f1 UNION ALL SELECT * FROM f2),
f4 AS (SELECT f3.*, t.* EXCLUDE (o, kind), v.txt AS raw_value, coalesce(period_label, 'unknown_period') AS period, CASE WHEN value_type = 'number' THEN v.num END AS normalized_value, how || ':' || {CLASS_NAME} AS mapping_reason
  FROM f3 JOIN t USING (o) JOIN n v ON v.o = f3.o AND v.r = f3.r AND v.col = f3.vcol LEFT JOIN p ON p.o = f3.o AND p.col = f3.vcol),
f5 AS (SELECT *, round(greatest(0, least(1, (([0.82, 0.72, 0.55])[class_ord + 1] + CASE WHEN period = 'unknown_period' THEN -0.08 ELSE 0.05 END + CASE unit WHEN 'unknown' THEN -0.05 ELSE 0.04 END
  + CASE WHEN numeric_exact >= 0.15 THEN 0.04 ELSE 0 END - CASE source_type WHEN 'page_table' THEN 0 ELSE 0.03 END - CASE WHEN value_type = 'number' AND normalized_value IS NULL THEN 0.18 ELSE 0 END)::DOUBLE)), 4) AS confidence,
  row_number() OVER (PARTITION BY o ORDER BY part, p1, p2, p3) - 1 AS seq, row_number() OVER (PARTITION BY document_id ORDER BY o, part, p1, p2, p3) AS ord FROM f4),
f AS (SELECT *, source_type <> 'page_table' OR raw_value = '' OR {SUSPICIOUS} OR period = 'unknown_period' OR unit = 'unknown' OR class_ord = 2 OR confidence < 0.75 AS requires_review,
  3 - class_ord AS alias_score FROM f5),
d AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY document_id, field, period, page ORDER BY alias_score DESC, confidence DESC, ord) = 1),
b AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY document_id, kind, field, period ORDER BY alias_score DESC, CASE period WHEN 'unknown_period' THEN 0 ELSE 1 END DESC,
  (CASE unit WHEN 'unknown' THEN 0 ELSE 1 END + CASE WHEN contains(table_group_id, ',') THEN 0 ELSE 1 END) DESC, confidence DESC, ord) = 1),
cand AS (SELECT *, round(0.5 + CASE WHEN has_header THEN 0.15 ELSE 0 END + CASE WHEN row_count >= 3 AND col_count >= 2 THEN 0.15 ELSE 0 END + CASE WHEN numeric_exact >= 0.15 THEN 0.10 ELSE 0 END
  + CASE source_type WHEN 'page_table' THEN 0 ELSE least(continuation_confidence, 1) * 0.10 END - CASE WHEN round(empty_exact, 4) > 0.35 THEN 0.10 ELSE 0 END, 4)::DOUBLE AS tconf,
  row_number() OVER (PARTITION BY document_id ORDER BY o) - 1 AS place FROM t WHERE kind <> 'unknown'),
g AS (SELECT document_id, table_group_id AS gid, max(continuation_confidence) AS gc FROM t WHERE table_group_id <> '' AND NOT contains(table_group_id, ',') GROUP BY ALL),
gp AS (SELECT document_id, table_group_id, min(coalesce(gc, 0)) AS continuation FROM (SELECT DISTINCT document_id, table_group_id, unnest(string_split(table_group_id, ',')) AS gid FROM t WHERE table_group_id <> '') LEFT JOIN g USING (document_id, gid) GROUP BY ALL),
it0 AS (SELECT d.*, coalesce(continuation, 0)::DOUBLE AS cont FROM d LEFT JOIN gp USING (document_id, table_group_id)),
it1 AS (SELECT *, source_type <> 'page_table' OR (table_group_id <> '' AND cont < 0.85) AS crossing, {sql_strip('raw_value')} = '' OR (normalized_value IS NULL AND regexp_matches(raw_value, '\\d')) AS broken FROM it0),
it AS (SELECT *, CASE WHEN crossing OR (broken AND table_group_id <> '') THEN 'cross_page_numeric_check' ELSE 'field_mapping_semantic_check' END AS review_type, list_filter([
  CASE WHEN crossing THEN printf('cross-page table confidence=%.2f', cont) END, CASE WHEN confidence < 0.75 THEN 'confidence<0.75' END, CASE class_ord WHEN 2 THEN 'weak alias match' END, CASE period WHEN 'unknown_period' THEN 'unknown period' END,
  CASE unit WHEN 'unknown' THEN 'unknown unit' END, CASE WHEN requires_review THEN 'field requires review' END, CASE WHEN broken THEN 'raw or normalized value looks suspicious' END], lambda x: x IS NOT NULL) AS why FROM it1)
"""

DISCARDS = "SELECT document_id, count(*) AS n_fields, count(*) - count(DISTINCT (field, period, page)) AS n_discarded FROM f GROUP BY 1"
ROLE_LINES = "['document_role=' || role.document_role, 'report_type=' || role.report_type, 'expected_extraction_strategy=' || role.strategy]"
EXTRACTION_MODES = f"""SELECT document_id, override, CASE WHEN aux AND override THEN 'auxiliary_material_dry_run' WHEN aux OR (lost AND NOT override) THEN 'blocked_by_document_role' WHEN ok THEN 'eligible' WHEN override THEN 'dry_run_override' ELSE 'blocked' END AS extraction_mode,
  array_to_string(CASE WHEN aux THEN list_concat(['auxiliary_material_no_three_statement_expected'], lines) WHEN lost AND NOT override THEN ['document_role_unknown_requires_review'] WHEN NOT ok AND NOT override THEN [reason]
    ELSE list_concat(lines, CASE WHEN n_discarded > 0 THEN ['discarded_candidates_count=' || n_discarded] ELSE [] END, CASE WHEN ok THEN [] ELSE ['override_used', 'eligibility_block_reason=' || reason] END) END, '; ') AS warnings
FROM (SELECT gt.*, n_discarded, {ROLE_LINES} AS lines, role.document_role = 'auxiliary_material' AS aux, role.document_role = 'unknown' AS lost FROM gt LEFT JOIN ({DISCARDS}) USING (document_id)), (VALUES (false), (true)) AS v(override)"""
VALIDATION_CHECKS = f"""SELECT check_name, CASE n_failed WHEN 0 THEN 'passed' ELSE 'failed' END AS status, n_failed, coalesce(example, '') AS example, true AS machine_determined FROM (
  SELECT 'blocking_decisions_are_not_eligible' AS check_name, count(*) AS n_failed, min(document_id) AS example FROM e WHERE NOT {APPROVED} AND len(why) = 0
  UNION ALL SELECT 'approved_with_files_is_eligible', count(*), min(document_id) FROM e WHERE {APPROVED} AND level <> 'failed' AND len(missing) = 0 AND len(why) > 0
  UNION ALL SELECT 'task_ids_are_unique', count(*), min(parse_task_id) FROM (SELECT parse_task_id FROM reg GROUP BY 1 HAVING count(*) > 1)
  UNION ALL SELECT 'pages_match_summary', count(*), min(document_id) FROM gate WHERE level <> 'failed' AND pages_count <> total
  UNION ALL SELECT 'kept_fields_come_from_fields', count(*), min(document_id) FROM (SELECT document_id, n, k FROM (SELECT document_id, count(*) AS n FROM f GROUP BY 1) FULL JOIN (SELECT document_id, count(*) AS k FROM d GROUP BY 1) USING (document_id) WHERE n IS NULL OR k IS NULL OR k > n))"""
NORMALIZED = inputs.NORMALIZED_SQL
#: Queries that need chains beside CHAIN.
GATED = ("candidate_gate", "candidate_sets", "gated_extraction", "extraction_modes", "validation_checks", "review_top30", "review_type_dist")
PACKED = ("review_top30", "review_type_dist")

ORACLES = {
    "cells_page": "SELECT document_id, table_id, CAST(r AS INT) AS row_index, CAST(col AS INT) AS col_index, txt AS text, r = 0 AS is_header FROM c JOIN o USING (o)",
    "sparse_rows": "SELECT table_id, CAST(dense_rank() OVER (PARTITION BY o ORDER BY r) - 1 AS INT) AS row_index, cells FROM (SELECT o, r, array_to_string(cells[:max(col) + 1], '|') AS cells FROM r JOIN c USING (o, r) WHERE txt <> '' GROUP BY o, r, r.cells) JOIN o USING (o)",
    "table_quality": "SELECT table_id, row_count, CAST(col_count AS BIGINT) AS col_count, cell_count, empty_cells, numeric_cells, has_header, empty_exact AS empty_ratio_exact, numeric_exact AS numeric_ratio_exact, kind AS candidate_statement_type FROM t",
    "table_raw_text": "SELECT table_id, raw_text FROM t",
    "table_markdown": "SELECT table_id, string_agg('| ' || array_to_string(cells, ' | ') || ' |' || CASE r.r WHEN 0 THEN chr(10) || '| --- | --- | --- | --- |' ELSE '' END, chr(10) ORDER BY r.r) AS raw_markdown FROM r JOIN o USING (o) GROUP BY table_id",
    "table_candidates": "SELECT document_id || '_' || printf('%04d', place) AS candidate_id, table_id, kind AS candidate_statement_type, tconf AS confidence, concat_ws('; ', CASE source_type WHEN 'page_table' THEN NULL ELSE 'cross_page_table_candidate' END, CASE WHEN n_flags > 0 THEN 'quality_flags_present' END, CASE WHEN tconf < 0.65 THEN 'low_candidate_confidence' END) AS extraction_notes, source_type <> 'page_table' OR n_flags > 0 OR tconf < 0.65 AS requires_review FROM cand",
    "candidate_summary": "SELECT kind AS candidate_statement_type, source_type, count(*) AS n, count(*) FILTER (source_type <> 'page_table' OR n_flags > 0 OR tconf < 0.65) AS n_review, CAST(sum(row_count) AS BIGINT) AS n_rows, max(tconf) AS top_confidence FROM cand GROUP BY ALL",
    "header_rows": "SELECT table_id, CAST(r AS INT) AS row_index FROM h JOIN o USING (o) WHERE is_header",
    "period_columns": "SELECT table_id, CAST(col AS INT) AS col_index, period_label FROM p JOIN o USING (o)",
    "unit_currency": "SELECT table_id, unit, currency FROM t",
    "alias_match": f"SELECT kind AS candidate_statement_type, label, field, {CLASS_NAME} AS match_type FROM (SELECT kind, label, field, min(class_ord) AS class_ord FROM (SELECT label, {sql_key('label')} AS ckey FROM (SELECT p_name AS label FROM part UNION SELECT akey || ' 合计' FROM al UNION SELECT upper(akey) FROM al)) CROSS JOIN al WHERE ckey <> '' AND {ALIAS_HIT} GROUP BY ALL)",
    "map_fields": "SELECT ord, document_id, table_id, kind AS candidate_statement_type, field AS canonical_field_name, raw_field_name, raw_value, normalized_value, unit, currency, period AS period_label, CAST(r AS INT) AS source_row_index, CAST(vcol AS INT) AS source_col_index, confidence, mapping_reason, requires_review, concat_ws('_', table_id, field, r, vcol, CASE part WHEN 1 THEN seq ELSE 0 END) AS field_id FROM f",
    "map_columns": "SELECT table_id, field AS canonical_field_name, raw_value, CAST(r AS INT) AS source_row_index, CAST(vcol AS INT) AS source_col_index, confidence FROM f WHERE part = 1",
    "dedup_fields": "SELECT document_id, ord, field AS canonical_field_name, period AS period_label, confidence FROM d",
    "discard_log": "SELECT document_id, field AS canonical_field_name, period AS period_label, ord AS arrival, CASE WHEN (alias_score, confidence) > (best.a, best.c) THEN -best.o ELSE ord END AS discarded FROM (SELECT *, max(struct_pack(a := alias_score, c := confidence, o := -ord)) OVER (PARTITION BY document_id, field, period, page ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM f) WHERE best IS NOT NULL",
    "best_candidate": "SELECT document_id, ord, kind AS candidate_statement_type, field AS canonical_field_name, period AS period_label, raw_value, confidence FROM b",
    "discarded_counts": "SELECT document_id, count(*) AS n_fields, count(*) - count(DISTINCT (kind, field, period)) AS n_discarded FROM f GROUP BY 1",
    "field_distribution": "SELECT field AS canonical_field_name, count(*) AS n_fields, avg(confidence) AS mean_confidence, count(*) FILTER (unit = 'unknown') AS unknown_unit, count(*) FILTER (period = 'unknown_period') AS unknown_period, count(*) FILTER (requires_review) AS n_review FROM f GROUP BY 1",
    "mapping_warnings": f"SELECT document_id, n_fields, n_discarded, CASE WHEN n_discarded > 0 THEN 'discarded_candidates_count=' || n_discarded END AS warning FROM ({DISCARDS})",
    "missing_tables": "SELECT document_id, 'canonical table not found for candidate table_id=' || table_id AS message FROM cand WHERE kind IN ('balance_sheet', 'income_statement', 'cash_flow_statement', 'shareholder_table') AND o % 9 = 0",
    "readiness": "SELECT document_id, count(*) AS total_tables, count(*) FILTER (source_type = 'merged_cross_page_table') AS merged_cross_page_tables_count, count(*) FILTER (kind = 'balance_sheet') AS n_balance_sheet, count(*) FILTER (kind = 'income_statement') AS n_income_statement, count(*) FILTER (kind = 'cash_flow_statement') AS n_cash_flow_statement, count(*) FILTER (kind = 'shareholder_table') AS n_shareholder_table, count(*) FILTER (kind = 'unknown') AS n_unknown, array_to_string(list_sort(list(DISTINCT page)), ';') AS source_pages, coalesce(array_to_string(list_sort(list(DISTINCT table_group_id) FILTER (table_group_id <> '')), ';'), '') AS table_group_ids FROM t GROUP BY 1",
    "three_statement_counts": "SELECT document_id, count(*) FILTER (kind IN ('balance_sheet', 'income_statement', 'cash_flow_statement')) AS n_three_statement FROM cand GROUP BY 1",
    "normalized_documents": NORMALIZED,
    "candidate_sets": "SELECT document_id, table_id, kind AS candidate_statement_type, 'eligible' AS extraction_mode FROM cand JOIN gt USING (document_id) WHERE ok",
    "gated_extraction": "SELECT document_id, kind AS statement_type, 'eligible' AS extraction_mode, count(*) AS n_fields FROM b JOIN gt USING (document_id) WHERE ok AND role.document_role = 'primary_financial_report' GROUP BY 1, 2",
    "statements": "SELECT document_id, kind AS statement_type, string_agg(period || '=' || field || '=' || raw_value, ';' ORDER BY period, field) AS fields, array_to_string(list_sort(list(DISTINCT period)), ',') AS periods_detected, array_to_string(list_sort(list(DISTINCT page)), ',') AS source_pages, bool_or(requires_review) AS requires_review FROM b GROUP BY ALL",
    "mapping_stats": "SELECT count(*) AS n_fields, avg(confidence) AS mean_confidence, count(*) FILTER (unit = 'unknown') AS unknown_unit, count(*) FILTER (period = 'unknown_period') AS unknown_period, count(*) FILTER (requires_review) AS n_review FROM f",
    "normalization_stats": "SELECT count(*) AS n_tables, count(*) FILTER (kind = 'unknown') AS n_unknown, count(*) FILTER (NOT has_header) AS n_headless, CAST(0 AS BIGINT) AS source_pages_missing, count(*) FILTER (table_group_id <> '') AS table_group_id_count, CAST(sum(cell_count) AS BIGINT) AS n_cells, count(DISTINCT document_id) AS n_documents, CAST(max(col_count) AS BIGINT) AS widest FROM t",
    "continuation_min": "SELECT table_id, table_group_id, coalesce(continuation, 0)::DOUBLE AS continuation FROM t LEFT JOIN gp USING (document_id, table_group_id)",
    "review_items": "SELECT document_id, ord, review_type, array_to_string(why, '; ') AS reason, raw_field_name || ' = ' || raw_value AS evidence_excerpt FROM it WHERE len(why) > 0",
    "review_top30": "SELECT document_id, review_type, ord, CAST(rank AS INT) AS rank, printf('hri_%05d', row_number() OVER (ORDER BY document_id, rank)) AS review_item_id, table_group_id, suggested_user_action FROM pk",
    "review_type_dist": "SELECT review_type, count(*) AS n FROM pk GROUP BY 1",
    "candidate_gate": "SELECT document_id, false AS override, CASE WHEN ok THEN 'eligible' ELSE 'blocked' END AS extraction_mode, CASE WHEN ok THEN '' ELSE reason END AS warnings FROM gt UNION ALL SELECT document_id, true, CASE WHEN ok THEN 'eligible' ELSE 'dry_run_override' END, CASE WHEN ok THEN '' ELSE 'override_used; eligibility_block_reason=' || reason END FROM gt",
    "extraction_modes": EXTRACTION_MODES,
    "validation_checks": VALIDATION_CHECKS,
}
ORACLES = {name: f"{CHAIN}{GATE_SQL * (name in GATED)}{PACK_SQL * (name in PACKED)}{', ' * (sql is NORMALIZED)}\n{sql}" for name, sql in ORACLES.items()}
