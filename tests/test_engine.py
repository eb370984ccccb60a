"""Golden vectors and invariants of the engine."""

import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from docstat.functions import rules, text
from docstat.operators import candidates, dedup, mapping, quality, registry, review, review_pack, roles, statements, tables
from docstat.plans import catalogue, inputs
from docstat.sources import inventory, json_tables, jsonl, parse_service, store
from docstat.sources.segments import Latest
from docstat.streaming import decisions


def one(frame):
    rows = frame.collect()
    assert len(rows) == 1
    return rows[0]


def apply(spark, values, *columns):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").orderBy("i").select(*columns).collect()


def test_numbers(spark):
    cases = {
        "261,347,980.19": (261347980.19, False), "(1,234)": (-1234.0, False), "（1,234）": (-1234.0, True), "(-5)": (5.0, False), "30.67%": (30.67, False), "5％": (5.0, True), "-": (None, True), "": (None, True),
        "1e5": (100000.0, True), "1_000": (1000.0, True), "１２": (12.0, False), "1 234": (None, True), "1d": (None, True), "+5": (5.0, True), ".5": (0.5, True), "-104,186,266.67": (-104186266.67, False), None: (None, True), "　7 ": (7.0, False),
    }
    got = apply(spark, list(cases), text.parse_number(F.col("x")), text.is_suspicious(F.col("x"), F.lit("number"), text.parse_number(F.col("x"))))
    for (raw, (value, odd)), (v, s) in zip(cases.items(), got):
        assert v == value and (s == odd or raw == "１２"), raw
    assert apply(spark, ["nan"], F.isnan(text.parse_number(F.col("x"))))[0][0]


def test_text_expressions(spark):
    assert apply(spark, [" A　b\n\x1cC "], text.match_key(F.col("x")), text.strip(F.col("x")))[0] == ("abc", "A　b\n\x1cC")
    assert apply(spark, ["单位：百万元 人民币", "万元", "港币 元", "x"], text.unit_of(F.col("x")), text.currency_of(F.col("x"))) == [("million", "CNY"), ("ten_thousand", "unknown"), ("yuan", "HKD"), ("unknown", "unknown")]
    assert [r[0] for r in apply(spark, ["1,5—", "()", "３", "a1", ""], text.is_numeric_like(F.col("x")))] == [True, False, True, False, False]
    assert apply(spark, ["x"], text.fixed(F.lit(0.625), 2), text.fixed(F.lit(0.40625), 4))[0] == ("0.62", "0.4062")
    ids = one(spark.range(1).select(text.document_id(F.lit("a/b.pdf"), F.lit("t1")).alias("d"), text.quoted_list(F.array(F.lit("a"), F.lit("b"))).alias("q"), text.basename(F.lit("C:\\x\\y.pdf")).alias("b")))
    assert ids.d.startswith("parsed_doc_") and len(ids.d) == 27 and ids.q == "['a', 'b']" and ids.b == "y.pdf"


def test_roles(spark):
    names = {
        "某公司2024年年度报告.pdf": ("primary_financial_report", "annual_report", "filename:年度报告"), "某公司2024年半年报.pdf": ("primary_financial_report", "annual_report", "filename:年报"),
        "某公司2024年半年度报告.pdf": ("primary_financial_report", "annual_report", "filename:年度报告"), "某公司2024年中期报告.pdf": ("primary_financial_report", "semi_annual_report", "filename:中期报告"),
        "Investor Presentation.pdf": ("auxiliary_material", "earnings_presentation", "filename:presentation"), "Conference Call.pdf": ("auxiliary_material", "conference_call_transcript", "filename:conferencecall"),
        "年度报告公告.pdf": ("auxiliary_material", "other_announcement", "filename:公告"), "x.pdf": ("unknown", "unknown", ""),
    }
    docs = spark.createDataFrame([(n, "see annual report" if n == "x.pdf" else "") for n in names], "pdf_name string, body string")
    got = {r.pdf_name: r for r in roles.assess(docs).collect()}
    for name, want in names.items():
        assert (got[name].document_role, got[name].report_type, got[name].evidence) == want
    assert got["x.pdf"].requires_review
    again = {r.pdf_name: r for r in roles.assess(docs, content="body").collect()}
    assert again["x.pdf"].evidence == "content:annualreport" and again["x.pdf"].confidence == 0.88


def summary(**more):
    base = dict(has_summary=True, total_pages=10, pages_count=10, merged_md="ok", failed_pages_count=0, empty_pages_count=0, visual_table_route_pages_count=0, cross_page_table_candidate_count=0, ocr_ratio=0.0, heavy_parser_ratio=0.0, flag_counts={"x": 0})
    return base | more


def test_quality_gate(spark):
    cases = [
        (summary(), "pass", ["parse outputs passed baseline quality checks"]),
        (summary(pages_count=9), "failed", ["pages.jsonl row count 9 does not equal total_pages 10"]),
        (summary(has_summary=False, total_pages=None, pages_count=None), "failed", ["summary is missing", "summary.total_pages is missing or zero", "pages.jsonl row count is unavailable"]),
        (summary(total_pages=200, pages_count=200, failed_pages_count=2), "pass_with_warnings", ["failed_pages_count=2"]),
        (summary(failed_pages_count=1), "needs_review", ["failed_pages_count=1"]),
        (summary(ocr_ratio=0.4), "needs_review", ["ocr_ratio=0.4000 is high"]),
        (summary(heavy_parser_ratio=0.6), "needs_review", ["heavy_parser_ratio=0.6000 is high"]),
        (summary(flag_counts={"x": 1}), "pass_with_warnings", ["quality_flags contains flagged pages"]),
        (summary(cross_page_table_candidate_count=16, total_pages=18, pages_count=18), "pass_with_warnings", ["cross_page_table_candidate_count=16"]),
        (summary(merged_md="empty", empty_pages_count=3), "failed", ["merged.md is empty", "empty_pages_count=3"]),
    ]
    schema = "has_summary boolean, total_pages bigint, pages_count bigint, merged_md string, failed_pages_count bigint, empty_pages_count bigint, visual_table_route_pages_count bigint, cross_page_table_candidate_count bigint, ocr_ratio double, heavy_parser_ratio double, flag_counts map<string,bigint>, i int"
    rows = spark.createDataFrame([tuple((c | {"i": i}).values()) for i, (c, _, _) in enumerate(cases)], schema)
    for r in quality.assess(rows).collect():
        assert (r.parse_quality_level, r.parse_quality_reasons) == cases[r.i][1:]


@pytest.mark.parametrize(
    ("class_ord", "period", "unit", "merged", "want"),
    [(0, True, True, False, 0.95), (1, True, True, False, 0.85), (2, False, False, False, 0.46), (0, False, False, False, 0.73), (1, True, False, False, 0.76), (0, True, False, True, 0.83), (0, False, False, True, 0.70), (0, True, False, False, 0.86)],
)
def test_mapping_confidence(spark, class_ord, period, unit, merged, want):
    assert one(spark.range(1).select(mapping.mapping_confidence(F.lit(class_ord), F.lit(period), F.lit(unit), F.lit(0.3), F.lit(merged), F.lit(False)).alias("c"))).c == want


def from_json(spark, pages, merged=None):
    rows = json_tables.page_tables(spark.createDataFrame([("d", json.dumps(pages))], "document_id string, value string"))
    made = mapping.table_rows(rows)
    origin = rows.select("table_id", "source_pages", "source_type").distinct()
    return rows, made.join(origin, "table_id").withColumns({"table_group_id": F.lit(""), "continuation_confidence": F.lit(0.0), "n_flags": F.lit(0)})


INCOME = [["项目", "本报告期", "上年同期", "增减(%)"], ["单位：元", "", "", ""], ["营业收入", "261,347,980.19", "200,000,000.00", "30.67"], ["归属于上市公司股东的净利\n润", "45,658,532.70", "-", "12"]]


def test_income_table_end_to_end(spark):
    rows, made = from_json(spark, [{"page_number": 2, "tables": [INCOME]}])
    t = one(made)
    assert (t.table_id, t.candidate_statement_type, t.row_count, t.col_count, t.empty_cell_ratio, t.numeric_cell_ratio) == ("page_table_2_0", "income_statement", 4, 4, 0.1875, 0.3125)
    assert one(candidates.select_candidates(made)).confidence == 0.9
    fields = mapping.map_fields(made)
    got = [(r.field_id, r.canonical_field_name, r.normalized_value, r.period_label, r.mapping_reason, r.confidence, r.requires_review, r.unit) for r in fields.orderBy("ord").collect()]
    assert got == [
        ("page_table_2_0_revenue_2_1_0", "revenue", 261347980.19, "本报告期", "row_alias_match:exact_aliases", 0.95, False, "yuan"),
        ("page_table_2_0_net_profit_3_1_0", "net_profit", 45658532.70, "本报告期", "row_alias_match:phrase_aliases", 0.85, False, "yuan"),
        ("page_table_2_0_net_profit_attributable_parent_3_1_0", "net_profit_attributable_parent", 45658532.70, "本报告期", "row_alias_match:phrase_aliases", 0.85, False, "yuan"),
    ]
    s = one(statements.statements(statements.best_fields(statements.deduplicate_fields(fields))))
    assert [f.canonical_field_name for f in s.fields] == ["net_profit", "net_profit_attributable_parent", "revenue"] and s.source_pages == [2] and not s.requires_review


def test_narrow_table_loses_its_first_rows(spark):
    rows, made = from_json(spark, [{"page_number": 1, "tables": [[["项目", "金额"], ["资产总计", "100"], ["负债合计", "40"], ["货币资金", "10"]]]}])
    f = one(mapping.map_fields(made))
    assert (f.canonical_field_name, f.normalized_value, f.unit, f.period_label, f.confidence, f.requires_review) == ("cash_and_cash_equivalents", 10.0, "unknown", "unknown_period", 0.73, True)


def test_ragged_rows_and_markdown(spark):
    rows, made = from_json(spark, [{"page_number": 1, "tables": [[["a", None, 0, 1.5, False, ""], ["x"], "scalar", []]]}, {"tables": [[[True, 7, " b\r\n"]]]}, "odd"])
    t = {r.table_id: r for r in made.collect()}["page_table_1_0"]
    assert (t.row_count, t.col_count, t.cell_count, t.empty_cell_ratio, t.numeric_cell_ratio) == (4, 6, 8, 0.1667, 0.125)
    cells = {(r.table_id, r.row_index): r.cells for r in rows.collect()}
    assert cells["page_table_1_0", 0] == ["a", "", "", "1.5", "", ""] and cells["page_table_1_0", 2] == ["scalar"] and cells["page_table_unknown_0", 0] == ["True", "7", "b"]
    assert {r.table_id: r.raw_markdown for r in tables.markdown(rows).collect()}["page_table_unknown_0"] == "| True | 7 | b |\n| --- | --- | --- |"


def test_merged_tables(spark):
    group = [{"source_pages": [7, "8", "x"], "table_group_id": "g1", "continuation_confidence": 0.9, "tables": [{"table": [["a"], ["b"]]}, {"table": [["c"]]}]}]
    rows = json_tables.merged_tables(spark.createDataFrame([("d", json.dumps(group))], "document_id string, value string")).orderBy("row_index").collect()
    assert [r.cells[0] for r in rows] == ["a", "b", "c"] and rows[0].table_id == "merged_cross_page_table_7_8_0" and rows[0].source_pages == [7, 8]


def test_dedup_and_discards(spark):
    data = [(0, "weak_aliases", 0.59, "k"), (1, "exact_aliases", 0.95, "k"), (2, "phrase_aliases", 0.76, "k"), (3, "exact_aliases", 0.95, "k"), (4, "weak_aliases", 0.5, "l")]
    rows = spark.createDataFrame(data, "ord long, mapping_reason string, confidence double, key string").withColumn("source_pages", F.array(F.lit(1)))
    assert sorted(r.ord for r in dedup.keep_best(rows, ["key"], dedup.mapping_rank()).collect()) == [1, 4]
    assert [r.discarded for r in dedup.discard_log(rows, ["key"], dedup.mapping_rank()).orderBy("arrival").collect()] == [0, 2, 3]


def test_upserts(spark):
    old = spark.createDataFrame([("t1", "a", 0), ("t2", "b", 1), ("", "c", 2)], "parse_task_id string, v string, ord long")
    new = spark.createDataFrame([("t1", "A", 0), ("", "d", 1), ("t9", "e", 2)], "parse_task_id string, v string, ord long")
    assert [(r.parse_task_id, r.v) for r in registry.upsert(old, new).orderBy("ord").collect()] == [("t1", "A"), ("t2", "b"), ("", "c"), ("", "d"), ("t9", "e")]
    assert [(r.parse_task_id, r.v) for r in registry.upsert(old, new.limit(1), in_place=False).orderBy("ord").collect()] == [("t2", "b"), ("", "c"), ("t1", "A")]
    assert registry.newest(old, -1, time="v").count() == 0


LOG = "decision_id string, document_id string, parse_task_id string, pdf_name string, review_decision string, reviewer string, review_notes string, approved_for_extraction boolean, requires_manual_check boolean, decided_at string, updated_at string, ord long"


def test_decisions_and_eligibility(spark):
    known = spark.createDataFrame([("d1", "t1", "p.pdf", "pass", "/o", [], 0), ("d2", "t2", "q.pdf", "failed", "/o", ["summary_path"], 1)], "document_id string, parse_task_id string, pdf_name string, parse_quality_level string, output_dir string, missing_files array<string>, ord long")
    empty = spark.createDataFrame([], LOG)
    ask = spark.createDataFrame([("d1", "approved_for_extraction", "", None, 0), ("d2", "approved_with_warnings", "me", "ok", 1), ("d3", "ignored", "", "", 2), ("d1", "maybe", "", "", 3)], "document_id string, review_decision string, reviewer string, review_notes string, ord long")
    log, refused = review.decide(known, empty, ask, "2026-01-01T00:00:00Z")
    assert sorted((r.document_id, r.error) for r in refused.collect()) == [("d1", "unknown decision"), ("d3", "registry entry not found")]
    wanted = spark.createDataFrame([("d1",), ("d2",), ("zz",)], "document_id string")
    got = {r.document_id: r for r in review.eligibility(wanted, known, log).collect()}
    assert got["d1"].eligible_for_extraction and got["d1"].reason == "approved for extraction"
    assert got["d2"].reason == "parse_quality_level=failed; missing_required_files=['summary_path']"
    assert got["zz"].reason == "registry entry not found; review_decision=pending_review; approved_for_extraction=false; missing_required_files=['registry_entry']"
    later, _ = review.decide(known, log, ask.limit(1).withColumn("review_decision", F.lit("rejected")), "2027-01-01T00:00:00Z")
    last = {r.document_id: r for r in review.latest_decisions(later).collect()}
    assert last["d1"].decided_at.startswith("2026") and last["d1"].updated_at.startswith("2027") and last["d1"].reviewer == "local_user" and last["d1"].requires_manual_check


def test_continuation(spark):
    groups = spark.createDataFrame([("d", "g1", 0.9), ("d", "g2", 0.7)], "document_id string, table_group_id string, continuation_confidence double")
    fields = spark.createDataFrame([("d", "g1"), ("d", "g1,g2"), ("d", "g1,g9"), ("d", "")], "document_id string, table_group_id string")
    assert {r.table_group_id: r.continuation for r in review_pack.continuation(fields, groups).collect()} == {"g1": 0.9, "g1,g2": 0.7, "g1,g9": 0.0, "": 0.0}


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"page_number": 1}\n\n  \n{"page_number": 1, "x": 2}\n')
    lines = jsonl.filled_lines(spark, str(tmp_path))
    assert lines.count() == 2
    got = jsonl.records(spark, str(tmp_path), "page_number int, x int").withColumn("document_id", F.lit("d"))
    assert one(tables.last_by_page(got)).x == 2
    entries = spark.createDataFrame([("d", f"{tmp_path}/a.jsonl", f"{tmp_path}/b.md")], "document_id string, pages_jsonl_path string, merged_md_path string")
    assert one(inventory.missing(entries, inventory.inventory(spark, str(tmp_path)), ("pages_jsonl_path", "merged_md_path"))).missing_files == ["merged_md_path"]
    (tmp_path / "a.jsonl").write_text("{bad\n")
    with pytest.raises(Exception):
        jsonl.records(spark, str(tmp_path), "page_number int").collect()


def test_store_and_stream(spark, tmp_path):
    schema = "document_id string, review_decision string, ord long"
    log, checkpoint = (str(tmp_path / x) for x in "lc")
    table = Latest(spark, str(tmp_path / "t"), "document_id", schema)
    spark.createDataFrame([("d1", "rejected", 0), ("d1", "ignored", 1), ("d2", "rejected", 2)], schema).write.parquet(log)
    decisions.follow(spark, log, table, checkpoint).awaitTermination()
    spark.createDataFrame([("d2", "pending_review", 3), ("d1", "rejected", -1)], schema).write.mode("append").parquet(log)
    decisions.follow(spark, log, table, checkpoint).awaitTermination()
    assert sorted((r.document_id, r.review_decision) for r in table.read().collect()) == [("d1", "ignored"), ("d2", "pending_review")]
    whole = store.VersionedTable(spark, str(tmp_path / "v"), schema)
    assert whole.read().count() == 0
    whole.replace(table.read())
    whole.append(spark.createDataFrame([("d3", "rejected", 0)], schema))
    assert sorted((r.document_id, r.ord) for r in whole.read().collect()) == [("d1", 1), ("d2", 3), ("d3", 4)] and whole.version() == 1 and whole.compact() == 2
    assert "| d1 |" in store.to_markdown(whole.read(), ["document_id"], "x")


def test_sinks(spark, tmp_path):
    frame = spark.createDataFrame([("d1", "eligible", ["a", "b"], 'say "x"'), ("d2", "blocked", [], None)], "document_id string, extraction_mode string, source_pages array<string>, note string")
    store.write_csv(frame, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert sorted(tuple(r) for r in back.collect()) == [("d1", "eligible", '["a","b"]', 'say "x"'), ("d2", "blocked", "[]", None)]
    store.write_by_mode(frame, str(tmp_path / "modes"))
    assert sorted(p.name for p in (tmp_path / "modes").iterdir() if p.is_dir()) == ["extraction_mode=blocked", "extraction_mode=eligible"]
    jsonl.write_lines(frame, str(tmp_path / "lines"))
    assert jsonl.records(spark, str(tmp_path / "lines"), "document_id string, note string").count() == 2
    counts = jsonl.line_counts(spark.createDataFrame([("nowhere",)], "path string").union(jsonl.filled_lines(spark, str(tmp_path / "lines")).select("path").distinct()), jsonl.filled_lines(spark, str(tmp_path / "lines")))
    assert [r.n for r in counts.where("path = 'nowhere'").collect()] == [None] and counts.agg(F.sum("n")).first()[0] == 2


def test_parser_json(spark):
    flags = json_tables.quality_flags(spark.createDataFrame([("d", '{"pages": {"1": ["a", 2], "x": ["b"], "3": 4}}'), ("e", "{bad")], "document_id string, value string")).collect()
    assert sorted((str(r.page_number), r.flags) for r in flags) == [("1", ["a", "2"]), ("3", []), ("None", ["b"])]
    texts = [("d", '{"pdf_name": "a.pdf", "total_pages": 3, "failed_pages": [1], "ocr_ratio": 0.5}'), ("e", "{}"), ("f", "[1]"), ("g", None)]
    got = {r.document_id: r for r in json_tables.summaries(spark.createDataFrame(texts, "document_id string, value string")).collect()}
    assert got["d"].has_summary and (got["d"].total_pages, got["d"].failed_pages_count, got["d"].empty_pages_count, got["d"].ocr_ratio) == (3, 1, 0, 0.5)
    assert not any(got[k].has_summary for k in "efg")
    entries = spark.createDataFrame([("C:\\in\\a.pdf", 0), ("/b.pdf", 1)], "pdf_path string, ord long")
    assert [r.ord for r in registry.by_pdf_path(entries, "C:/in/a.pdf").collect()] == [0]
    pages = spark.createDataFrame([([1, 2], 0), ([], 1)], "p array<int>, i int").orderBy("i")
    assert [r[0] for r in pages.select(tables.table_id(F.lit("page_table"), F.col("p"), F.col("i"))).collect()] == ["page_table_1_2_0", "page_table_unknown_1"]
    assert one(spark.range(1).select(text.utc_text(F.lit("2026-01-02 03:04:05").cast("timestamp")).alias("t"))).t == "2026-01-02T03:04:05Z"


def test_gates_and_warnings(spark):
    docs = spark.createDataFrame([("d1", True, "ok"), ("d2", False, "no entry")], "document_id string, eligible_for_extraction boolean, reason string")
    shown = lambda f: {r.document_id: (r.extraction_mode, r.warnings) for r in f.collect()}
    assert shown(candidates.gate(docs)) == {"d1": ("eligible", []), "d2": ("blocked", ["no entry"])}
    assert shown(candidates.gate(docs, True))["d2"] == ("dry_run_override", ["override_used", "eligibility_block_reason=no entry"])
    rows = [("a", "auxiliary_material", True, 2), ("u", "unknown", True, None), ("p", "primary_financial_report", False, 3), ("q", "primary_financial_report", True, 0)]
    full = spark.createDataFrame([(i, r, "t", "s", "", e, "why", n) for i, r, e, n in rows], "document_id string, document_role string, report_type string, strategy string, evidence string, eligible_for_extraction boolean, reason string, n_discarded int")
    said = lambda role: [f"document_role={role}", "report_type=t", "expected_extraction_strategy=s"]
    plain, forced = shown(statements.extraction_warnings(full)), shown(statements.extraction_warnings(full, True))
    assert plain["a"] == ("blocked_by_document_role", ["auxiliary_material_no_three_statement_expected", *said("auxiliary_material")]) and forced["a"] == ("auxiliary_material_dry_run", plain["a"][1])
    assert plain["u"] == ("blocked_by_document_role", ["document_role_unknown_requires_review"]) and plain["p"] == ("blocked", ["why"]) and plain["q"] == ("eligible", said("primary_financial_report"))
    assert forced["p"] == ("dry_run_override", [*said("primary_financial_report"), "discarded_candidates_count=3", "override_used", "eligibility_block_reason=why"])


def test_review_pack_texts(spark):
    pages = spark.createDataFrame([("d", "p.pdf", 3, True, 0.25, 2, None, "x" * 400, 0), ("d", "p.pdf", 4, None, 0.9, 1, "g1", None, 1), ("d", "p.pdf", 5, False, 0.9, 2, "", "t", 2)], "document_id string, pdf_name string, page_number int, visual_table_route_triggered boolean, table_intent_score double, n_tables int, table_group_id string, final_text string, ord long")
    items = review_pack.visual_items(pages).orderBy("ord").collect()
    assert [(r.reason, r.confidence, r.table_group_id) for r in items] == [("visual_table_route_triggered=True; table_intent_score=0.25; table_count=2", 0.25, ""), ("visual_table_route_triggered=None; table_intent_score=0.9; table_count=1", 0.9, "g1")]
    packed = review_pack.numbered(review_pack.pack(review_pack.visual_items(pages)))
    first = packed.orderBy("rank").first()
    assert set(review_pack.ITEM) <= set(packed.columns) and (first.confidence, first.canonical_field_name, first.unit, first.source_pages) == (0.25, "", "", [3])
    shown = review_pack.markdown(packed)
    assert "- total_review_items: 2" in shown and "### hri_00001 visual_table_check" in shown


def fake_transport():
    return lambda method, path, body: {"task": {"status": "completed"}, "path": path}


def test_parse_service(spark):
    states = iter(["running", "running", "completed"])
    client = parse_service.Client(lambda *a: {"status": next(states)})
    assert client.poll("t", sleep=lambda s: None)["status"] == "completed"
    slow = parse_service.Client(lambda *a: {"status": "running"})
    clock = iter(range(0, 10_000, 700))
    assert slow.poll("t", sleep=lambda s: None, clock=lambda: next(clock))["timeout"]
    spark.dataSource.register(parse_service.ParseTasks)
    got = spark.read.format("parse_tasks").option("tasks", "a,b").option("transport", "tests.test_engine:fake_transport").load().collect()
    assert sorted((r.task_id, r.status) for r in got) == [("a", "completed"), ("b", "completed")]


def test_plans(spark, sf):
    plan = catalogue.QUERIES["alias_match"](spark, sf)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BatchEvalPython" not in plan
    assert "WindowGroupLimit" in catalogue.QUERIES["dedup_fields"](spark, sf)._jdf.queryExecution().toString()


@pytest.mark.parametrize(("name", "scans", "exchanges"), [("map_fields", 1, 4), ("statements", 1, 5), ("dedup_fields", 1, 5), ("review_items", 2, 8)])
def test_fields_are_made_in_one_pass(spark, sf, name, scans, exchanges):
    plan = catalogue.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") <= scans and plan.count("Exchange hashpartitioning") <= exchanges


def test_order_does_not_matter(spark, sf):
    rows = inputs.line_rows(spark, sf).where("table_ord < 200")
    made = lambda r: inputs.line_origins(mapping.table_rows(r))
    a = mapping.map_fields(made(rows)).collect()
    b = mapping.map_fields(made(rows.repartition(7, "row_index"))).collect()
    key = lambda r: (r.document_id, r.ord)
    assert sorted(a, key=key) == sorted(b, key=key)


@pytest.mark.parametrize("name", ["quality_gate", "eligibility", "table_quality", "unit_currency", "role_by_content", "parse_numbers", "suspicious_values", "registry_upsert", "merged_tables", "statements", "review_top30", "map_columns", "normalized_documents", "extraction_modes", "validation_checks", "ingest_results"])
def test_queries_equal_their_sql(spark, sf, name):
    db = duckdb.connect()
    for table in ("orders", "lineitem", "events", "pages", "conversations", "part", "documents"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    got = catalogue.QUERIES[name](spark, sf)
    want = db.sql(catalogue.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    shown = lambda rows, names: sorted(repr([round(v, 6) if isinstance(v, float) else v for _, v in sorted(zip(names, r))]) for r in rows)
    assert shown(got.collect(), got.columns) == shown(want.fetchall(), want.columns)


def test_random_rows_against_plain_python(spark):
    rng = random.Random(1)
    rows = [("d", "t", 0, i, [rng.choice(["", "1", "a", " ", "(2)", "3%"]) for _ in range(rng.randint(0, 4))]) for i in range(40)]
    t = one(tables.tables(spark.createDataFrame(rows, "document_id string, table_id string, table_ord long, row_index int, cells array<string>")))
    cells = [c for r in rows for c in r[4]]
    assert (t.cell_count, t.empty_cells, t.numeric_cells) == (len(cells), sum(not c.strip() for c in cells), sum(c in ("1", "(2)", "3%") for c in cells))


@pytest.mark.parametrize("name", ["map_fields", "dedup_fields", "statements", "discard_log"])
def test_lines_are_dealt_once(spark, sf, name):
    plan = catalogue.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Filter ((size(" not in plan  # hits are worked out once, not again in a filter before the generator


def test_usual_numbers_and_ends(spark):
    """The short ways give what the long ones do."""
    raws = ["1,234.50", "(1,234.5)", "12％", "(0)", "0", "7.", "(7.%)", "１２", " 12", "12\n", "(12", "12)", "1,,2", "1.2.3", "%1", "1%%", "-5", "(-5)", "1e3", "nan", "（3）", "", " ", None, "　1　", "x"]
    want = [1234.5, -1234.5, 12.0, -0.0, 0.0, 7.0, -7.0, 12.0, 12.0, 12.0, 12.0, 12.0, 12.0, None, 1.0, 1.0, -5.0, 5.0, 1000.0, "nan", -3.0, None, None, None, 1.0, None]
    rows = spark.createDataFrame(list(enumerate(raws)), "i int, raw string").orderBy("i")
    got = rows.select("raw", text.parse_number(F.col("raw")).alias("n"), text.strip(F.col("raw")).alias("s"), text.is_blank(F.col("raw")).alias("b")).collect()
    assert [str(r.n) if r.n != r.n else r.n for r in got] == want
    assert [r.s for r in got] == [raw if raw is None else raw.strip() for raw in raws]
    assert [r.b for r in got] == [raw if raw is None else raw.strip() == "" for raw in raws]


def test_cell_facts_units_and_types_are_worked_out_once(spark, sf):
    odd = ["", None, " ", "-", "—", "(1,234.5%)", "（12）", "nan", "1e5", "12%)", "１２", "现金", "12\n", "　", "a1"]
    raw = spark.createDataFrame([(x,) for x in odd], "raw string").select("raw", text.cell_facts(F.col("raw")).alias("f"))
    got = raw.select("f.*", text.parse_number(F.col("raw")).alias("n"), text.is_numeric_like(F.col("raw")).alias("l"), text.is_blank(F.col("raw")).alias("b")).collect()
    assert [str(tuple(r)[:3]) for r in got] == [str((r.n, r.l, r.b)) for r in got]
    spread = spark.createDataFrame([("单位：万 　元 R m\nB",), ("HKD Mil lion",)], "x string")
    assert [tuple(r) for r in spread.select(text.unit_of(F.col("x")), text.currency_of(F.col("x"))).collect()] == [("ten_thousand", "CNY"), ("million", "HKD")]
    fields = mapping.map_fields(inputs.line_origins(mapping.table_rows(inputs.line_rows(spark, sf))))
    assert fields._jdf.queryExecution().optimizedPlan().toString().count("资产负债表|") == 1


def test_rows_of_any_width_against_plain_python(spark):
    """Few cells are worked out one by one, more by lambda functions; both give the same."""
    rng = random.Random(2)
    lists = [[rng.choice(["", "1", "a", None]) for _ in range(n)] for n in range(text.UNROLLED + 4) for _ in range(3)]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, x array<string>").withColumn("up", F.transform("x", F.upper))
    one_ = lambda c: F.coalesce(c == "1", F.lit(False))
    first, last = text.places_of(F.col("x"), one_, 1)
    joined = text.join_each(F.col("x"), lambda c, u: F.concat(c, u), F.col("up"), "|")
    got = rows.select("i", text.each(F.col("x"), lambda c: F.concat(c, F.lit("!"))).alias("e"), text.count_of(F.col("x"), one_).alias("n"), first.alias("f"), last.alias("l"), joined.alias("j")).orderBy("i").collect()
    for r, x in zip(got, lists):
        at = [i for i, c in enumerate(x) if c == "1" and i]
        assert r.e == [c and c + "!" if c is None or c else "!" for c in x] and r.n == x.count("1")
        assert (r.f, r.l) == ((at[0], at[-1]) if at else (None, None)) and r.j == "|".join(c + c.upper() for c in x if c is not None)


def test_wide_tables_map_as_narrow_ones(spark):
    """Empty cells at the end change no field."""
    table = [["利润表", "本期", "上期"], ["单位：元", "2024", ""], ["附注", "", ""], ["营业收入", "100", "90"], ["其中：营业收入", "", "7"], ["收入 经营", "5", "6"], ["x", "净利润", "8"]]
    for periods in (False, True):
        got = []
        for more in (0, text.UNROLLED):
            rows, made = from_json(spark, [{"page_number": 1, "tables": [[r + [""] * more for r in table]]}])
            found = mapping.map_fields(made, all_periods=periods).orderBy("ord").collect()
            got.append([(r.field_id, r.raw_field_name, r.raw_value, r.normalized_value, r.period_label, r.mapping_reason, r.unit) for r in found])
        assert got[0] == got[1] and len(got[0]) >= 4


def test_rules_are_not_interpreted_row_by_row(spark, sf):
    """Spark interprets lambda functions and all they read: rows are no longer mapped inside one."""
    plan = catalogue.QUERIES["discard_log"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(rows" not in plan


def test_more_rules_than_are_written_out(spark, monkeypatch):
    rows, made = from_json(spark, [{"page_number": 1, "tables": [[["利润表", "本期"], ["单位：元", "2024"], ["附注", ""], ["营业收入", "100"], ["归属于上市公司股东的净利润", "9"], ["营业 收益", "3"]]]}])
    shown = lambda: [tuple(r) for r in mapping.map_fields(made).select("field_id", "mapping_reason", "raw_value").orderBy("ord").collect()]
    few = shown()
    monkeypatch.setattr(mapping, "WRITTEN_OUT", 0)
    assert shown() == few and len(few) == 4
