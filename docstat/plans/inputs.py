"""Engine relations made from the driver's tables, each with the same relation as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docstat.functions import rules

# First rows and row labels of the tables made from line items, by kind of table.
TOP_ROWS = (
    ("资产负债表", "本期", "上年同期", "note"),
    ("利润表", "本期", "上年同期", "note"),
    ("现金流量表", "本期", "上年同期", "note"),
    ("股东名称", "持股数量", "持股比例", "备注"),
    ("Notes", "a", "b", "c"),
)
UNIT_ROWS = ("单位：万元 人民币", "单位：元", "百万元", "RMB 千元", "n/a")
LABELS = (
    ("资产总计", "负债合计", "货币资金", "所有者权益合计", "Total cash 余额", "其他"),
    ("营业收入", "其中：营业收入", "净利润", "归属于上市公司股东的净利润", "营业利润", "Gross profit 经营"),
    ("经营活动产生的现金流量净额", "投资活动小计", "筹资活动产生的现金流量净额", "期末现金及现金等价物余额", "投资活动产生的现金流量净额", "x"),
    ("股东甲", "股东乙", "持股平台", "基金", " ", "质押"),
    ("alpha", "beta", "12", "", "gamma", "delta"),
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(table, by: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for x in table]), by.cast("int") + 1)


def line_rows(spark: SparkSession, sf_dir: str, documents: DataFrame | None = None) -> DataFrame:
    """Table rows: an order is a table, eight orders a document, a line a row below two header rows.

    Lines are dealt by document before they become texts, so what follows by table or document needs no shuffle of the rows. documents (document_id): lines of others are left out before that.
    """
    order = Window.partitionBy("document_id", "o").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    line = read(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("doc_"), F.expr("l_orderkey div 8").cast("string")).alias("document_id"), F.col("l_orderkey").alias("o"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus"
    )
    if documents is not None:
        line = line.join(documents.select("document_id"), "document_id", "left_semi")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a number, so that the parts aren't joined into few tasks: lines are small before they are texts
    line = line.repartition(parts, "document_id").withColumn("n", F.row_number().over(order))
    kind = F.col("o") % 5
    price = F.format_number("l_extendedprice", 2)
    data = F.array(
        F.element_at(_pick(LABELS, kind), (F.col("l_partkey") % 6).cast("int") + 1),
        F.when(F.col("l_returnflag") == "R", F.concat(F.lit("("), price, F.lit(")"))).otherwise(price),
        F.when(F.col("l_quantity") < 5, "").when(F.col("l_linestatus") == "O", F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("％"))).otherwise(F.col("l_quantity").cast("int").cast("string")),
        F.when(F.col("l_discount") >= 0.05, "-").otherwise(F.col("l_suppkey").cast("string")),
    )
    row = lambda i, cells: F.struct(i.cast("int").alias("row_index"), cells.alias("cells"))
    own = F.array(row(F.col("n") + 1, data))
    tops = F.array(row(F.lit(0), _pick(TOP_ROWS, kind)), row(F.lit(1), F.array(_pick(UNIT_ROWS, kind), F.lit("2024"), F.lit(""), F.lit(""))))
    rows = line.select("document_id", "o", F.inline_outer(F.when(F.col("n") == 1, F.concat(tops, own)).otherwise(own)))
    return rows.select(
        "document_id",
        F.concat(F.lit("page_table_"), (F.col("o") % 3 + 1).cast("string"), F.lit("_"), F.col("o").cast("string")).alias("table_id"), F.col("o").alias("table_ord"), "row_index", "cells",
    )


def line_origins(tables: DataFrame) -> DataFrame:
    """tables with source, pages, group and flags by their order number."""
    o = F.col("table_ord")
    return tables.withColumns(
        {
            "source_type": F.when(o % 7 == 0, "merged_cross_page_table").otherwise("page_table"),
            "source_pages": F.array((o % 3 + 1).cast("int")),
            "table_group_id": F.when(o % 2 == 0, "").when(o % 11 == 0, F.concat(F.lit("g"), (o % 4).cast("string"), F.lit(",g9"))).otherwise(F.concat(F.lit("g"), (o % 4).cast("string"))),
            "continuation_confidence": F.lit(0.5) + (o % 5) / F.lit(8.0),
            "n_flags": F.when(o % 13 == 0, 1).otherwise(0),
        }
    )


def _array(values) -> str:
    return "[" + ", ".join("'" + v + "'" if isinstance(v, str) else _array(v) for v in values) + "]"


LINE_SQL = f"""
l AS (SELECT l_orderkey AS o, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_returnflag, l_linestatus,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n FROM lineitem),
r AS (
  SELECT o, 0 AS r, ({_array(TOP_ROWS)})[o % 5 + 1] AS cells FROM l WHERE n = 1 UNION ALL
  SELECT o, 1, [({_array(UNIT_ROWS)})[o % 5 + 1], '2024', '', ''] FROM l WHERE n = 1 UNION ALL
  SELECT o, n + 1, [({_array(LABELS)})[o % 5 + 1][l_partkey % 6 + 1],
    CASE WHEN l_returnflag = 'R' THEN '(' || format('{{:,.2f}}', l_extendedprice) || ')' ELSE format('{{:,.2f}}', l_extendedprice) END,
    CASE WHEN l_quantity < 5 THEN '' WHEN l_linestatus = 'O' THEN CAST(l_quantity AS INT) || '％' ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR) END,
    CASE WHEN l_discount >= 0.05 THEN '-' ELSE CAST(l_suppkey AS VARCHAR) END] FROM l),
o AS (SELECT DISTINCT o, 'doc_' || (o // 8) AS document_id, 'page_table_' || (o % 3 + 1) || '_' || o AS table_id,
  CASE WHEN o % 7 = 0 THEN 'merged_cross_page_table' ELSE 'page_table' END AS source_type, o % 3 + 1 AS page,
  CASE WHEN o % 2 = 0 THEN '' WHEN o % 11 = 0 THEN 'g' || (o % 4) || ',g9' ELSE 'g' || (o % 4) END AS table_group_id,
  0.5 + (o % 5) / 8.0 AS continuation_confidence, CASE WHEN o % 13 = 0 THEN 1 ELSE 0 END AS n_flags FROM l)
"""


#: Every pattern of every role, and none: what the names and texts of the test data are given to carry.
ROLE_WORDS = (*(p for _, _, patterns in rules.ROLES for p in patterns), "")


def named(name: Column, by: Column) -> Column:
    """name with one of ROLE_WORDS behind it."""
    return F.concat(name, F.lit(" "), _pick(ROLE_WORDS, by % len(ROLE_WORDS)))


def sql_named(name: str, by: str) -> str:
    return f"{name} || ' ' || ({_array(ROLE_WORDS)})[{by} % {len(ROLE_WORDS)} + 1]"


def files_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_id, page_file, merged_file) as a parser leaves them, from one grouping of the lines; some files are damaged, a document without merged tables has no such file."""
    number = F.substring("document_id", 5, 20).cast("long")
    tables = line_rows(spark, sf_dir).groupBy("document_id", F.col("table_ord").alias("o")).agg(F.transform(F.sort_array(F.collect_list(F.struct("row_index", "cells"))), lambda r: r["cells"]).alias("rows"))
    each = F.sort_array(F.collect_list(F.struct("o", "rows")))
    page = tables.groupBy("document_id", (F.col("o") % 3 + 1).cast("int").alias("page_number")).agg(each.alias("t"))
    page = page.select("document_id", F.struct("page_number", F.col("t")["rows"].alias("tables")).alias("page"), F.slice("t", 1, 2).alias("first"))
    whole = page.groupBy("document_id").agg(F.sort_array(F.collect_list("page")).alias("pages"), F.sort_array(F.flatten(F.collect_list("first"))).alias("first"))
    parts = F.transform(F.slice("first", 1, 2), lambda t: F.struct(t["rows"].alias("table")))
    one = F.struct(F.array(F.lit("1"), F.lit("2"), F.lit("x")).alias("source_pages"), F.concat(F.lit("g"), (number % 4).cast("string")).alias("table_group_id"), F.lit(0.9).alias("continuation_confidence"), parts.alias("tables"))
    return whole.select(
        "document_id", F.when(number % 10 == 3, "{bad").otherwise(F.to_json("pages")).alias("page_file"),
        F.when(number % 2 == 0, F.when(number % 14 == 4, '{"a": 1}').otherwise(F.to_json(F.array(one)))).alias("merged_file"),
    )


def parser_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """(documents, page files, merged files, page records, flags) as a parser leaves them; some files are damaged."""
    number = F.substring("document_id", 5, 20).cast("long")
    files = files_by_document(spark, sf_dir)
    pages = files.select("document_id", F.col("page_file").alias("value"))
    merged = files.where(number % 2 == 0).select("document_id", F.col("merged_file").alias("value"))
    documents = line_rows(spark, sf_dir).select("document_id").distinct()
    numbered = documents.select("document_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("page_number"))
    none = F.array().cast("array<string>")
    records = numbered.select("document_id", "page_number", F.concat(F.lit("p"), F.col("page_number").cast("string")).alias("parser_source"), F.lit("").alias("table_group_id"), F.lit(0.5).alias("table_intent_score"), F.when(F.col("page_number") == 2, F.array(F.lit("own"))).otherwise(none).alias("quality_flags"))
    flags = numbered.where((F.col("page_number") == 1) & (number % 3 == 0)).select("document_id", "page_number", F.array(F.lit("other1"), F.lit("other2")).alias("flags"))
    return documents, pages, merged, records, flags


NORMALIZED_SQL = """
dn AS (SELECT DISTINCT o, o // 8 AS dno, 'doc_' || (o // 8) AS document_id FROM l),
rc AS (SELECT o, count(*) AS n FROM r GROUP BY o),
pt AS (SELECT document_id, dno, o % 3 + 1 AS page, row_number() OVER (PARTITION BY document_id, o % 3 ORDER BY o) - 1 AS i, n FROM dn JOIN rc USING (o) WHERE dno % 10 <> 3),
mt AS (SELECT document_id, dno, CAST(sum(n) AS BIGINT) AS n FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY o) AS k FROM dn JOIN rc USING (o)) WHERE k <= 2 AND dno % 2 = 0 AND dno % 14 <> 4 GROUP BY ALL),
ds AS (SELECT DISTINCT document_id, dno FROM dn)
SELECT document_id, 'page_table_' || page || '_' || i AS table_id, 'page_table' AS source_type, CAST(page AS VARCHAR) AS source_pages, '' AS table_group_id, 'p' || page AS parser_source,
  CASE WHEN page = 2 THEN 'own' WHEN page = 1 AND dno % 3 = 0 THEN 'other1,other2' ELSE '' END AS quality_flags, n AS row_count, 4 * n AS cell_count FROM pt
UNION ALL SELECT document_id, 'merged_cross_page_table_1_2_0', 'merged_cross_page_table', '1,2', 'g' || (dno % 4), '', CASE WHEN dno % 3 = 0 THEN 'other1,other2' ELSE '' END, n, 4 * n FROM mt
UNION ALL SELECT document_id, 'tables_json normalization failed: not valid JSON', 'error', '', '', '', '', 0, 0 FROM ds WHERE dno % 10 = 3
UNION ALL SELECT document_id, 'merged_tables_json normalization failed: not a list', 'error', '', '', '', '', 0, 0 FROM ds WHERE dno % 14 = 4
UNION ALL SELECT document_id, 'no canonical tables generated', 'warning', '', '', '', '', 0, 0 FROM ds WHERE dno % 10 = 3
"""


def visual_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page records: a document is a page, fifty pages a document."""
    n = F.col("doc_id")
    return read(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc_"), (n % 50).cast("string")).alias("document_id"), F.lit("x.pdf").alias("pdf_name"), n.cast("int").alias("page_number"), F.when(n % 10 != 7, n % 9 == 0).alias("visual_table_route_triggered"),
        ((F.col("n_chars") % 100) / F.lit(100.0)).alias("table_intent_score"), (n % 3).cast("int").alias("n_tables"), F.when(n % 4 == 0, "g1").otherwise("").alias("table_group_id"), F.col("text").alias("final_text"), n.cast("long").alias("ord"),
    )


VISUAL_SQL = """
vp AS (SELECT 'doc_' || (doc_id % 50) AS document_id, CAST(doc_id AS BIGINT) AS ord, CASE WHEN doc_id % 10 <> 7 THEN doc_id % 9 = 0 END AS routed, (n_chars % 100) / 100.0 AS score, doc_id % 3 AS n_tables, CASE WHEN doc_id % 4 = 0 THEN 'g1' ELSE '' END AS table_group_id, text[:300] AS excerpt FROM documents),
vi AS (SELECT *, 'visual_table_route_triggered=' || CASE WHEN routed IS NULL THEN 'None' WHEN routed THEN 'True' ELSE 'False' END || '; table_intent_score=' || score || '; table_count=' || n_tables AS reason FROM vp WHERE coalesce(routed, false) OR (score >= 0.8 AND n_tables <= 1))
"""


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry entries: an order is a document; its lines are its pages."""
    pages = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("total_pages"), F.count_if((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45)).alias("failed_pages_count"), F.count_if(F.col("l_quantity") < 2).alias("empty_pages_count"),
        F.count_if(F.col("l_discount") > 0.09).alias("visual_table_route_pages_count"), F.count_if(F.col("l_tax") > 0.07).alias("cross_page_table_candidate_count"),
        (F.count_if(F.col("l_discount") < 0.03) / F.count(F.lit(1))).alias("ocr_ratio"), (F.count_if(F.col("l_linestatus") == "F") / F.count(F.lit(1)) * 0.7).alias("heavy_parser_ratio"),
    )
    key = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").join(pages, "o_orderkey", "left").select(
        F.concat(F.lit("doc_"), key.cast("string")).alias("document_id"), F.concat(F.lit("task_"), key.cast("string")).alias("parse_task_id"), F.concat(F.lit("report_"), key.cast("string"), F.lit(".pdf")).alias("pdf_name"),
        F.when(F.col("o_orderstatus") == "F", "failed").otherwise("completed").alias("parse_status"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("registered_at"), key.cast("long").alias("ord"),
        F.col("total_pages").isNotNull().alias("has_summary"), "total_pages", F.when(key % 17 == 0, F.col("total_pages") - 1).when(key % 23 != 0, F.col("total_pages")).alias("pages_count"),
        F.when(key % 29 == 0, "missing").when(key % 31 == 0, "empty").otherwise("ok").alias("merged_md"), "failed_pages_count", "empty_pages_count", "visual_table_route_pages_count", "cross_page_table_candidate_count",
        "ocr_ratio", "heavy_parser_ratio", F.create_map(F.lit("x"), (key % 3 - 1).cast("long")).alias("flag_counts"),
        F.array_compact(F.array(F.when(key % 37 == 0, "summary_path"), F.when(key % 41 == 0, "merged_md_path"))).alias("missing_files"),
        F.array_compact(F.array(F.when(key % 37 == 0, "summary_path"), F.when(key % 41 == 0, "merged_md_path"), F.when(key % 43 == 0, "cross_page_candidates_path"))).alias("missing_outputs"),
        F.concat(F.lit("/out/"), key.cast("string")).alias("output_dir"),
    )


REGISTRY_SQL = """
pg AS (SELECT l_orderkey AS k, count(*) AS total, count(*) FILTER (l_returnflag = 'R' AND l_quantity > 45) AS failed, count(*) FILTER (l_quantity < 2) AS empty,
  count(*) FILTER (l_discount > 0.09) AS visual, count(*) FILTER (l_tax > 0.07) AS cross_n,
  count(*) FILTER (l_discount < 0.03) / count(*) AS ocr, count(*) FILTER (l_linestatus = 'F') / count(*) * 0.7::DOUBLE AS heavy FROM lineitem GROUP BY 1),
reg AS (SELECT o_orderkey AS k, 'doc_' || o_orderkey AS document_id, 'task_' || o_orderkey AS parse_task_id, 'report_' || o_orderkey || '.pdf' AS pdf_name,
  CASE o_orderstatus WHEN 'F' THEN 'failed' ELSE 'completed' END AS parse_status, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS registered_at,
  total, CASE WHEN o_orderkey % 17 = 0 THEN total - 1 WHEN o_orderkey % 23 <> 0 THEN total END AS pages_count,
  CASE WHEN o_orderkey % 29 = 0 THEN 'missing' WHEN o_orderkey % 31 = 0 THEN 'empty' ELSE 'ok' END AS md, failed, empty, visual, cross_n, ocr, heavy, o_orderkey % 3 = 2 AS flagged,
  list_filter([CASE WHEN o_orderkey % 37 = 0 THEN 'summary_path' END, CASE WHEN o_orderkey % 41 = 0 THEN 'merged_md_path' END], lambda x: x IS NOT NULL) AS missing_files,
  list_filter([CASE WHEN o_orderkey % 37 = 0 THEN 'summary_path' END, CASE WHEN o_orderkey % 41 = 0 THEN 'merged_md_path' END, CASE WHEN o_orderkey % 43 = 0 THEN 'cross_page_candidates_path' END], lambda x: x IS NOT NULL) AS missing_outputs
  FROM orders LEFT JOIN pg ON k = o_orderkey),
why AS (SELECT k, list_filter([
  CASE WHEN total IS NULL THEN 'summary is missing' END, CASE WHEN coalesce(total, 0) <= 0 THEN 'summary.total_pages is missing or zero' END,
  CASE WHEN pages_count <> total THEN 'pages.jsonl row count ' || pages_count || ' does not equal total_pages ' || total END, CASE WHEN pages_count IS NULL THEN 'pages.jsonl row count is unavailable' END,
  CASE md WHEN 'missing' THEN 'merged.md is missing' WHEN 'empty' THEN 'merged.md is empty' END, CASE WHEN failed > 0 THEN 'failed_pages_count=' || failed END, CASE WHEN empty > 0 THEN 'empty_pages_count=' || empty END,
  CASE WHEN visual > 0 THEN 'visual_table_route_pages_count=' || visual END, CASE WHEN cross_n > 0 THEN 'cross_page_table_candidate_count=' || cross_n END,
  CASE WHEN ocr >= 0.4 THEN printf('ocr_ratio=%.4f is high', ocr) END, CASE WHEN heavy >= 0.6 THEN printf('heavy_parser_ratio=%.4f is high', heavy) END, CASE WHEN flagged THEN 'quality_flags contains flagged pages' END], lambda x: x IS NOT NULL) AS reasons FROM reg),
gate AS (SELECT reg.*, CASE WHEN len(reasons) = 0 THEN ['parse outputs passed baseline quality checks'] ELSE reasons END AS reasons,
  CASE WHEN coalesce(total, 0) <= 0 OR pages_count IS NULL OR pages_count <> total OR md <> 'ok' THEN 'failed'
       WHEN failed / total > 0.01 OR empty > 0 OR ocr >= 0.4 OR heavy >= 0.6 THEN 'needs_review'
       WHEN failed > 0 OR visual > 0 OR cross_n > 0 OR flagged THEN 'pass_with_warnings' ELSE 'pass' END AS level FROM reg JOIN why USING (k))
"""


def decision_log(spark: SparkSession, sf_dir: str, documents: int = 1500) -> DataFrame:
    """Decisions in order of event_id; an event's document and decision follow from its numbers."""
    kind = F.element_at(F.array(*[F.lit(x) for x in DECISION_KINDS]), (F.col("event_id") % 6).cast("int") + 1)
    return read(spark, sf_dir, "events").select(
        F.concat(F.lit("doc_"), (F.col("event_id") * 7 % documents).cast("string")).alias("document_id"), kind.alias("review_decision"), kind.isin("approved_for_extraction", "approved_with_warnings").alias("approved_for_extraction"),
        kind.isin("pending_review", "rejected", "needs_reparse", "ignored").alias("requires_manual_check"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("updated_at"), F.col("event_id").cast("long").alias("ord"),
    )


DECISION_KINDS = ("pending_review", "approved_for_extraction", "approved_with_warnings", "rejected", "needs_reparse", "ignored")
DECISION_SQL = f"""
log AS (SELECT 'doc_' || (event_id * 7 % 1500) AS document_id, ({_array(DECISION_KINDS)})[event_id % 6 + 1] AS review_decision, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS updated_at, event_id AS ord FROM events),
last AS (SELECT document_id, arg_max(review_decision, ord) AS review_decision, arg_max(updated_at, ord) AS updated_at, max(ord) AS ord FROM log GROUP BY 1)
"""


def text_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table rows of documents: their lines with ` | ` in them, split there."""
    line = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line")).where(F.col("line").contains(" | "))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("at")) - 1
    return line.select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("document_id"), F.concat(F.lit("text_table_"), F.col("doc_id").cast("string")).alias("table_id"), F.col("doc_id").alias("table_ord"), place.alias("row_index"), F.split("line", r" \| ").alias("cells"))


TEXT_SQL = """
tl AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM documents),
tr AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ln) - 1 AS r, string_split(line, ' | ') AS cells FROM tl WHERE contains(line, ' | ')),
tc AS (SELECT doc_id, r, unnest(cells) AS txt, generate_subscripts(cells, 1) - 1 AS col FROM tr)
"""
