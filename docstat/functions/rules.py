"""Rule data, fixed values throughout, and its form as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docstat.functions.text import match_key

#: (role, report type, patterns), in the order they are tried.
ROLES = (
    ("auxiliary_material", "conference_call_transcript", ("电话会议", "conferencecall", "conference call", "transcript", "纪要")),
    ("auxiliary_material", "earnings_presentation", ("业绩简报", "presentation", "业绩演示")),
    ("auxiliary_material", "investor_presentation", ("投资者演示", "investorpresentation", "investor presentation")),
    ("auxiliary_material", "earnings_release", ("业绩新闻稿", "业绩发布", "earningsrelease", "earnings release")),
    ("auxiliary_material", "earnings_announcement", ("业绩公告", "resultsannouncement", "results announcement")),
    ("auxiliary_material", "other_announcement", ("公告", "announcement")),
    ("primary_financial_report", "annual_report", ("年报", "年度报告", "annualreport", "annual report")),
    ("primary_financial_report", "semi_annual_report", ("半年报", "半年度报告", "中期报告", "interimreport", "interim report")),
    ("primary_financial_report", "q1_report", ("一季报", "第一季度报告", "1季度报告", "q1report", "q1 report")),
    ("primary_financial_report", "q3_report", ("三季报", "第三季度报告", "3季度报告", "q3report", "q3 report")),
    ("primary_financial_report", "quarterly_report", ("季报", "季度报告", "quarterlyreport", "quarterly report")),
)

STATEMENT_KEYWORDS = (
    ("balance_sheet", ("资产负债表", "資產負債表", "balance sheet", "资产总计", "負債合計", "所有者权益")),
    ("income_statement", ("利润表", "利潤表", "income statement", "损益", "損益", "营业收入", "營業收入", "净利润", "淨利潤")),
    ("cash_flow_statement", ("现金流量表", "現金流量表", "cash flow", "经营活动", "經營活動", "投资活动", "籌資活動")),
    ("shareholder_table", ("股东信息", "股東信息", "前十名股东", "前十名股東", "质押", "質押", "持股数量", "持股比例")),
    ("segment_revenue_table", ("分部", "分行业", "分產品", "收益明细", "收益明細", "segment", "revenue by")),
)
CANDIDATE_TYPES = tuple(t for t, _ in STATEMENT_KEYWORDS)
MAPPED_TYPES = CANDIDATE_TYPES[:4]
THREE_STATEMENTS = CANDIDATE_TYPES[:3]

#: (type, field, value type, exact, phrase, weak aliases).
FIELDS = (
    ("balance_sheet", "total_assets", "number", ("资产总计", "总资产", "TOTAL ASSETS"), (), ("assets",)),
    ("balance_sheet", "total_liabilities", "number", ("负债合计", "负债总计", "TOTAL LIABILITIES"), (), ("liabilities",)),
    ("balance_sheet", "total_equity", "number", ("所有者权益合计", "股东权益合计", "TOTAL EQUITY"), ("归属于母公司所有者权益合计",), ("equity",)),
    ("balance_sheet", "cash_and_cash_equivalents", "number", ("货币资金", "现金及现金等价物"), ("现金及现金等价物余额",), ("cash",)),
    ("income_statement", "revenue", "number", ("营业收入",), ("主营业务收入", "营业总收入", "Revenue from contracts with customers"), ("收入", "收益", "Revenue")),
    ("income_statement", "operating_profit", "number", ("营业利润", "经营利润", "Operating profit"), (), ("profit",)),
    ("income_statement", "net_profit", "number", ("净利润", "本期净利润", "Profit for the period"), ("归属于上市公司股东的净利润",), ("Profit",)),
    ("income_statement", "net_profit_attributable_parent", "number", ("归母净利润",), ("归属于母公司所有者的净利润", "归属于上市公司股东的净利润"), ()),
    ("cash_flow_statement", "operating_cash_flow", "number", ("经营活动产生的现金流量净额", "经营活动现金流量净额", "Net cash flows from operating activities"), (), ("经营活动",)),
    ("cash_flow_statement", "investing_cash_flow", "number", ("投资活动产生的现金流量净额", "Net cash flows from investing activities"), (), ("投资活动",)),
    ("cash_flow_statement", "financing_cash_flow", "number", ("筹资活动产生的现金流量净额", "Net cash flows from financing activities"), (), ("筹资活动",)),
    ("cash_flow_statement", "cash_end_period", "number", ("期末现金及现金等价物余额", "现金及现金等价物期末余额"), ("现金及现金等价物的期末余额",), ()),
    ("shareholder_table", "shareholder_name", "text", ("股东名称", "股东姓名", "Name of shareholder"), (), ("名称",)),
    ("shareholder_table", "shares_held", "number", ("持股数量", "持股数"), (), ("持股",)),
    ("shareholder_table", "shareholding_ratio", "number", ("持股比例", "持股百分比"), (), ("比例",)),
    ("shareholder_table", "pledged_shares", "number", ("质押股份数量", "质押数量"), ("质押、标记或冻结情况",), ("质押",)),
)
CLASSES = ("exact_aliases", "phrase_aliases", "weak_aliases")

WEAK_CONTEXT = (
    ("income_statement", ("营业", "主营", "净利润", "经营", "operating")),
    ("balance_sheet", ("合计", "总计", "余额")),
    ("cash_flow_statement", ("现金流量", "活动", "cashflow")),
    ("shareholder_table", ("股东", "持股", "质押")),
)

OCR_LIMIT, HEAVY_LIMIT, FAILED_PAGE_LIMIT = 0.40, 0.60, 0.01
FIELD_REVIEW_BELOW, CANDIDATE_REVIEW_BELOW, CROSS_PAGE_BELOW = 0.75, 0.65, 0.85
VISUAL_INTENT, VISUAL_TABLES = 0.8, 1
AUXILIARY_CANDIDATES, PRIMARY_STATEMENTS, PACK_LIMIT = 10, 2, 30
RISK = (("cross_page_numeric_check", 5), ("visual_table_check", 4), ("field_mapping_semantic_check", 3), ("statement_type_check", 2), ("auxiliary_material_role_check", 1))
DECISIONS = ("pending_review", "approved_for_extraction", "approved_with_warnings", "rejected", "needs_reparse", "ignored")
APPROVING = DECISIONS[1:3]
BLOCKING = ("pending_review", "rejected", "needs_reparse", "ignored")
FINAL_TASK_STATES = ("completed", "failed", "cancelled")
#: Files of a parse: the queue needs all seven, extraction all but the last.
PARSE_FILES = ("summary_path", "pages_jsonl_path", "merged_md_path", "tables_json_path", "merged_tables_json_path", "quality_flags_path", "cross_page_candidates_path")
EXTRACTION_FILES = PARSE_FILES[:6]


def aliases(spark: SparkSession, fields=FIELDS) -> DataFrame:
    """One row per alias: statement_type, field, value_type, rule_ord, class_ord (0 exact, 1 phrase, 2 weak), key."""
    rows = [(f[0], f[1], f[2], rule, k, alias) for rule, f in enumerate(fields) for k in range(3) for alias in f[3 + k]]
    frame = spark.createDataFrame(rows, "statement_type string, field string, value_type string, rule_ord int, class_ord int, alias string")
    return frame.select("statement_type", "field", "value_type", "rule_ord", "class_ord", match_key(F.col("alias")).alias("key")).where("key <> ''")
