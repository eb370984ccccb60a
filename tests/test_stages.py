"""The continuous gate, the task stream, files by document, messages through all stages and the observed suite."""

import json
import os
import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from docstat.functions import rules, text
from docstat.operators import incremental, mapping, messages, normalize, quality, registry, review, rule_tables, statements, tables, validation
from docstat.plans import catalogue, inputs, line_plans, stage_plans
from docstat.sources import document_files, file_probe, json_tables, parse_service, rule_file, store
from docstat.sources.segments import Latest, finished
from docstat.streaming import gate


def batches(frame, parts, seed):
    rows = frame.collect()
    random.Random(seed).shuffle(rows)
    return [frame.sparkSession.createDataFrame(rows[i::parts], frame.schema) for i in range(parts)]


@pytest.mark.parametrize(("seed", "n"), [(1, 3), (2, 1)])
def test_the_gate_equals_eligibility_after_any_split_and_order(spark, sf, tmp_path, seed, n):
    entries, log = inputs.registry(spark, sf).where("ord < 400"), inputs.decision_log(spark, sf, 120).where("ord < 600")
    again = log.where("ord % 50 = 0")  # log rows that come twice
    parts = [("e", p) for p in batches(entries, n, seed)] + [("d", p) for p in (*batches(log, n, seed), again)]
    random.Random(seed).shuffle(parts)
    where = {"e": str(tmp_path / "e"), "d": str(tmp_path / "d")}
    for kind, frame in (("e", entries.limit(0)), ("d", log.limit(0))):
        frame.write.parquet(where[kind])
    into, seen = gate.table(spark, str(tmp_path / "table")), 0
    for kind, part in parts:
        part.write.mode("append").parquet(where[kind])
        streams = gate.file_streams(spark, (where["e"], entries.schema), (where["d"], log.schema))
        gate.follow(*streams, into, str(tmp_path / "checkpoint")).awaitTermination()  # each a restart
        number = max(into.batches())
        touched = spark.read.parquet(f"{into.path}/b{number}")
        assert {r[0] for r in touched.select("document_id").collect()} == {r[0] for r in part.select("document_id").collect()}
        assert number == seen
        seen += 1
        if seen == 4:
            assert into.compact() == 3 and into.remove_old() == ["b0", "b1", "b2", "b3"]
    streams = gate.file_streams(spark, (where["e"], entries.schema), (where["d"], log.schema))
    gate.follow(*streams, into, str(tmp_path / "checkpoint")).awaitTermination()
    assert max(into.batches()) == seen - 1  # nothing new, nothing repeated
    known = quality.assess(entries)
    everyone = known.select("document_id").union(log.select("document_id")).distinct()
    want = review.eligibility(everyone, known, log)
    got = into.read()
    assert sorted(got.select(*want.columns).collect(), key=str) == sorted(want.collect(), key=str)
    queued = ["document_id", "review_status", "review_reasons", "review_decision", "approved_for_extraction", "requires_manual_check"]
    assert sorted(got.where("review_status is not null").select(*queued).collect(), key=str) == sorted(review.queue(known, log).select(*queued).collect(), key=str)


def test_late_decisions_count_for_the_gate_and_not_for_closed_windows(spark, tmp_path):
    schema = "document_id string, review_decision string, updated_at string, ord long"
    rows = [("a", "rejected", "2026-01-01T10:10:00Z", 0), ("b", "ignored", "2026-01-01T20:00:00Z", 1)]
    late = [("a", "approved_for_extraction", "2026-01-01T10:20:00Z", 5), ("c", "rejected", "2026-01-01T20:30:00Z", 6)]
    log, name = str(tmp_path / "log"), f"rates{time.time_ns()}"
    spark.createDataFrame(rows, schema).write.parquet(log)
    query = gate.rates(spark.readStream.schema(schema).parquet(log)).writeStream.outputMode("update").format("memory").queryName(name).start()
    query.processAllAvailable()
    spark.createDataFrame(late, schema).write.mode("append").parquet(log)
    query.processAllAvailable()
    query.stop()
    got = {(str(r.window_start), r.review_decision): r.n for r in spark.table(name).collect()}
    assert got == {("2026-01-01 10:00:00", "rejected"): 1, ("2026-01-01 20:00:00", "ignored"): 1, ("2026-01-01 20:00:00", "rejected"): 1}
    assert gate.rates(spark.read.schema(schema).parquet(log)).where("review_decision = 'approved_for_extraction'").count() == 1  # in a batch nothing is late


def test_latest_holds_the_last_row_of_each_key(spark, tmp_path):
    table = Latest(spark, str(tmp_path / "t"), "k", "k string, v int")
    assert table.read().count() == 0 and table.compact() is None and table.remove_old() == []
    make = lambda *rows: spark.createDataFrame(rows, "k string, v int")
    table.put(make(("a", 1), ("b", 1)), 0)
    table.put(make(("a", 2)), 1)
    table.put(make(("a", 3)), 1)  # run again
    assert sorted(table.read().collect()) == [("a", 3), ("b", 1)]
    table.compact()
    table.put(make(("c", 9)), 2)
    (tmp_path / "t" / "b7").mkdir()  # a batch that was never finished
    assert sorted(table.read().collect()) == [("a", 3), ("b", 1), ("c", 9)] and table.remove_old() == ["b0", "b1"] and table.batches() == [2]
    table.compact()
    table.remove_old()
    assert finished(spark, table.path) == ["upto2"] and table.read().count() == 3


def test_appending_writes_new_rows_only(spark, tmp_path):
    schema = "document_id string, ord long"
    table, make = store.VersionedTable(spark, str(tmp_path / "v"), schema), lambda *rows: spark.createDataFrame(rows, schema)
    sizes = []
    for i in range(4):
        table.append(make(*[(f"d{i}_{j}", j) for j in range(50)]))
        newest = max((p for p in (tmp_path / "v").iterdir()), key=lambda p: p.stat().st_mtime)
        sizes.append(sum(f.stat().st_size for f in newest.glob("*.parquet")))
    assert max(sizes) < 1.2 * min(sizes)
    rows = sorted(table.read().collect(), key=lambda r: r.ord)
    assert [r.ord for r in rows] == list(range(200)) and rows[75].document_id == "d1_25"
    table.append(make())
    table.append(make(("x", 0)))
    assert table.read().where("document_id = 'x'").first().ord == 200
    assert table.compact() == 1 and sorted(table.read().collect(), key=lambda r: r.ord)[:200] == rows
    table.append(make(("y", 0)))
    assert table.compact() == 2 and table.compact() == 2 and len(table.remove_old()) == 8 and table.read().count() == 202
    assert sorted(p.name for p in (tmp_path / "v").iterdir()) == ["v2"]



def scripted_transport():
    """A service whose answers a file gives, as executors have processes of their own."""
    with open("/tmp/docstat-test-service.json") as f:
        states = json.load(f)

    def call(method, path, body):
        task = path.split("/")[2]
        state = states.get(task, "running")
        return {"task": {"task_id": task, "status": state}, "result": path.endswith("result")}

    return call


def test_tasks_arrive_once_also_over_a_restart(spark, tmp_path):
    def now(**states):
        with open("/tmp/docstat-test-service.json", "w") as f:
            json.dump(states, f)

    def run(limit_s):
        stream = spark.readStream.format("parse_task_stream").option("tasks", "a,b,c,d,e").option("transport", "tests.test_stages:scripted_transport").option("pause_s", "0").option("limit_s", str(limit_s)).load()
        return stream.writeStream.foreachBatch(lambda rows, n: rows.write.mode("overwrite").json(f"{tmp_path}/out/b={n}")).option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="200 milliseconds").start()

    def rows():
        read = spark.read.schema("task_id string, status string, payload string, timeout boolean").json(f"{tmp_path}/out/*")
        return sorted((r.task_id, r.status, r.timeout) for r in read.collect())

    def until(n, query):
        for _ in range(150):
            if query.exception():
                raise query.exception()
            if (tmp_path / "out").exists() and len(rows()) >= n:
                break
            time.sleep(0.2)
        time.sleep(1)  # what might come twice

    spark.dataSource.register(parse_service.ParseTaskStream)
    now(b="completed", e="failed")
    query = run(3600)
    until(2, query)
    now(b="completed", e="failed", a="completed")
    until(3, query)
    query.stop()
    assert rows() == [("a", "completed", False), ("b", "completed", False), ("e", "failed", False)]
    query = run(0)  # a restart; what still runs is out of time
    until(5, query)
    now(**{t: "completed" for t in "abcde"})
    time.sleep(1)
    query.stop()
    query = run(0)
    time.sleep(3)
    query.stop()
    assert rows() == [("a", "completed", False), ("b", "completed", False), ("c", "running", True), ("d", "running", True), ("e", "failed", False)]


def test_one_file_for_each_document(spark, tmp_path):
    documents = spark.createDataFrame([("d1", "eligible"), ("d2", "blocked"), ("d/3 ü", "dry_run_override")], "document_id string, extraction_mode string")
    parts = spark.createDataFrame([("d1", 1, "y"), ("d1", 0, "x")], "document_id string, i int, table_id string")
    shown = document_files.results(documents, ("candidates", parts, "i"))
    path = str(tmp_path / "out")
    document_files.write(shown.join(documents, "document_id").withColumn("suffix", document_files.suffix_of(document_files.CANDIDATES, F.col("extraction_mode"))), path, document_files.CANDIDATES)
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_file()) == ["d%2F3 %C3%BC.financial_table_candidates.json", "d1.financial_table_candidates.json", "d2.blocked_extraction.json"]
    assert json.loads((tmp_path / "out" / "d1.financial_table_candidates.json").read_text()) == {"document_id": "d1", "extraction_mode": "eligible", "candidates": [{"table_id": "x"}, {"table_id": "y"}]}
    assert json.loads((tmp_path / "out" / "d2.blocked_extraction.json").read_text())["candidates"] == []
    later = spark.createDataFrame([("d2", document_files.CANDIDATES[0], "{}")], "document_id string, suffix string, value string")
    document_files.write(later, path, document_files.CANDIDATES)  # no longer blocked: no stale file
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if "d2" in p.name) == ["d2.financial_table_candidates.json"]
    bad = spark.range(4).select(F.col("id").cast("string").alias("document_id"), F.lit("x.json").alias("suffix"), F.when(F.col("id") < 3, "{}").alias("value")).coalesce(1)
    with pytest.raises(Exception):
        document_files.write(bad, str(tmp_path / "bad"))  # the last row has no value: the task fails
    assert [p for p in (tmp_path / "bad").rglob("*") if p.is_file()] == []


def said(frame, severity="warning"):
    out = {}
    for r in messages.ordered(frame).where(F.col("severity") == severity).orderBy("document_id", "seq").collect():
        out.setdefault(r.document_id, []).append(r.text)
    return out


def test_messages_keep_the_order_in_which_stages_say_them(spark):
    rows = [("aux", "auxiliary_material", True), ("lost", "unknown", True), ("ok", "primary_financial_report", True), ("no", "primary_financial_report", False)]
    docs = spark.createDataFrame([(d, r, "t", "s", "", e, "approved for extraction" if e else "why not") for d, r, e in rows], "document_id string, document_role string, report_type string, strategy string, evidence string, eligible_for_extraction boolean, reason string")
    found = spark.createDataFrame([("no", "warning", "no canonical tables generated"), ("no", "error", "merged_tables_json normalization failed: not a list"), ("no", "error", "tables_json normalization failed: not valid JSON")], "document_id string, severity string, message string")
    base = messages.of_normalization(found)
    missing = spark.createDataFrame([("no", 9, "second"), ("no", 2, "first"), ("ok", 1, "one")], "document_id string, table_ord long, message string")
    counts = lambda n: spark.createDataFrame([("no", n), ("ok", 0)], "document_id string, n_discarded long")
    lines = ["document_role=primary_financial_report", "report_type=t", "expected_extraction_strategy=s"]
    forced = ["override_used", "eligibility_block_reason=why not"]
    made = lambda o: messages.of_extraction(docs, base, missing, counts(3), counts(2), o)
    assert said(made(True))["no"] == [*lines, "no canonical tables generated", *forced, "discarded_candidates_count=3", *forced, "discarded_field_candidates_count=2"]
    errors = ["tables_json normalization failed: not valid JSON", "merged_tables_json normalization failed: not a list"]
    assert said(made(True), "error") == {"no": [*errors, *errors, "first", "second"], "ok": ["one"]}
    plain = said(made(False))
    assert plain["no"] == ["why not"] and plain["ok"] == lines and plain["lost"] == ["document_role_unknown_requires_review"] and plain["aux"][0] == "auxiliary_material_no_three_statement_expected"
    assert said(made(False), "error") == {"ok": ["one"]}
    assert said(messages.of_candidates(docs, base, False))["no"] == ["why not"] and said(messages.of_mapping(docs, base, missing, counts(3), False))["no"] == ["why not"]
    listed = {r.document_id: r for r in messages.lists(made(True)).collect()}
    assert listed["no"].warnings == said(made(True))["no"] and listed["no"].errors == [*errors, *errors, "first", "second"] and listed["aux"].errors == []
    unknown = docs.where("document_id = 'no'")
    assert said(messages.of_normalization(found, unknown), "error") == {"no": ["document_id not found: no"]}


def test_the_suite_is_observed_on_the_way(spark, sf, tmp_path):
    report = stage_plans._report(spark, sf)
    rows, seen = validation.watched(report)
    plan = lambda f: f._jdf.queryExecution().executedPlan().toString()
    assert plan(rows).count("FileScan") == plan(report).count("FileScan") and "CollectMetrics" in plan(rows)
    rows.write.parquet(str(tmp_path / "report"))
    checks = validation.results(spark, seen)
    assert [r.check_name for r in checks.collect()] == list(validation.CHECKS)
    total = validation.summary(checks)
    written = spark.read.parquet(str(tmp_path / "report"))
    assert total["registry_count"] == written.count() and total["high_risk_items_count"] == written.agg(F.sum("requires_review_count")).first()[0]
    assert total["passed_count"] + total["failed_count"] == 7 and total["skipped_count"] == 0
    document_files.write(validation.report_files(checks, "2026-01-01T00:00:00Z"), str(tmp_path / "files"))
    assert sorted(p.name for p in (tmp_path / "files").iterdir() if p.is_file()) == ["validation_suite_failures.json", "validation_suite_results.json", "validation_suite_results.md", "validation_suite_summary.csv"]
    assert (tmp_path / "files" / "validation_suite_summary.csv").read_text().startswith("check_name,status,machine_determined\nregistry,")
    assert len(json.loads((tmp_path / "files" / "validation_suite_results.json").read_text())["checks"]) == 7


def test_duplicate_tasks_and_missing_files_fail_the_registry_check(spark):
    rows = [("d1", "t1", [], 2, 2, "pass", "ok"), ("d2", "t1", [], 2, 2, "pass", "ok"), ("d3", "t3", ["summary_path"], 1, 2, "failed", "empty"), ("d4", "", [], None, None, "pass", "ok"), ("d5", "", [], 0, 0, "pass", "ok")]
    entries = spark.createDataFrame(rows, "document_id string, parse_task_id string, missing_files array<string>, pages_count long, total_pages long, parse_quality_level string, merged_md string")
    eligible = spark.createDataFrame([(r[0], i == 0, "x", "rejected" if i == 0 else "approved_for_extraction", True) for i, r in enumerate(rows)], "document_id string, eligible_for_extraction boolean, reason string, review_decision string, required_files_present boolean")
    none = lambda schema: spark.createDataFrame([], schema)
    fields = none("document_id string, unit string, period_label string, requires_review boolean, confidence double")
    errors = none("document_id string, severity string")
    report = validation.document_report(entries, eligible, none("document_id string, source_pages array<int>, table_group_id string, candidate_statement_type string"), fields, fields, none("document_id string, candidate_statement_type string, n_fields long"), {"normalization": errors, "extraction": errors})
    watched, seen = validation.watched(report)
    assert watched.count() == 5
    got = {r.check_name: (r.status, r.n_errors, r.example) for r in validation.results(spark, seen).collect()}
    assert got["registry"] == ("failed", 3, "d1")  # two rows of one task, one without a file; rows without a task are no copies
    assert got["quality_gate"] == ("failed", 4, "d3")  # d3: pages and merged.md; d4 and d5: no total is -1
    assert got["review_decision_eligibility"] == ("failed", 5, "d1") and got["table_normalization"][0] == "passed"


def test_rules_of_any_number_give_what_the_fixed_ones_give(spark, sf, monkeypatch):
    own = rules.aliases(spark)
    labels = [("".join(a.split()).lower() + tail, kind) for kind, _, _, *lists in rules.FIELDS for a in sum(lists, ()) for tail in ("", " 合计", "x")]
    frame = spark.createDataFrame(labels + [("", "balance_sheet"), ("净", "income_statement"), ("现金", "nowhere")], "label string, candidate_statement_type string")
    want = {(r.candidate_statement_type, "".join(r.label.split()).lower(), r.field, r.value_type, r.rule_ord, r.class_ord) for r in mapping.alias_matches(frame).collect()}
    keys = frame.select(F.col("candidate_statement_type").alias("statement_type"), text.match_key(F.col("label")).alias("key")).distinct()
    for limit in (100_000, 2):  # broadcast, and by shuffle
        monkeypatch.setattr(rule_tables, "BROADCAST_PATTERNS", limit)
        assert {tuple(r) for r in rule_tables.alias_matches(keys, own).collect()} == want
    tables = inputs.line_origins(mapping.table_rows(inputs.line_rows(spark, sf).where("table_ord < 700")))
    for periods in (False, True):
        a, b = mapping.map_fields(tables, all_periods=periods), mapping.map_fields_by(tables, own, periods)
        assert sorted(a.collect(), key=str) == sorted(b.select(*a.columns).collect(), key=str)


def test_contained_patterns_against_plain_python(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choices("abé1", k=n))
    keys = sorted({word(rng.randint(0, 12)) for _ in range(300)})
    patterns = sorted({word(rng.randint(1, 4)) for _ in range(60)} | {"zz", "abz"})
    got = rule_tables.contained(spark.createDataFrame([(k,) for k in keys], "key string"), spark.createDataFrame([(p,) for p in patterns], "pattern string"))
    assert sorted(map(tuple, got.collect())) == sorted((k, p) for k in keys for p in patterns if p in k)
    none = rule_tables.contained(spark.createDataFrame([("a",)], "key string"), spark.createDataFrame([], "pattern string"))
    assert none.count() == 0


def test_ten_thousand_rules_plan_in_seconds(spark):
    many = spark.range(10_000).select(F.lit("balance_sheet").alias("statement_type"), F.concat(F.lit("f"), "id").alias("field"), F.lit("number").alias("value_type"), F.col("id").cast("int").alias("rule_ord"), F.lit(1).alias("class_ord"), F.concat(F.lit("alias"), "id").alias("key"))
    labels = spark.range(500).select(F.lit("balance_sheet").alias("statement_type"), F.concat(F.lit("alias"), (F.col("id") * 20).cast("string"), F.lit("x")).alias("key"))
    began = time.perf_counter()
    found = rule_tables.alias_matches(labels, many)
    found._jdf.queryExecution().executedPlan().toString()
    assert time.perf_counter() - began < 5
    names = [f"alias{20 * i}x" for i in range(500)]
    assert found.count() == sum(n.startswith(f"alias{n[5:k]}") for n in names for k in range(6, len(n)))


def test_rule_file(spark, tmp_path):
    path = tmp_path / "rules.json"
    path.write_text(json.dumps({"balance_sheet": [{"canonical_field_name": "a", "exact_aliases": ["Total  A", " "], "weak_aliases": ["a"], "required": True}, {"canonical_field_name": "b", "value_type": "text", "phrase_aliases": ["b b"]}], "income_statement": []}))
    got = sorted(map(tuple, rule_file.mapping_rules(spark, str(path)).collect()))
    assert got == [("balance_sheet", "a", "number", 0, 0, "totala"), ("balance_sheet", "a", "number", 0, 2, "a"), ("balance_sheet", "b", "text", 1, 1, "bb")]
    for bad in ("[1]", "{bad", '{"balance_sheet": [{"value_type": "text"}]}'):
        path.write_text(bad)
        with pytest.raises(Exception):
            rule_file.mapping_rules(spark, str(path)).collect()


def test_one_changed_file_recomputes_one_document(spark, tmp_path):
    rows = [(f"d{i}", n, f"{n} of {i}") for i in range(30) for n in ("pages", "tables")]
    files = lambda rows: spark.createDataFrame(rows, "document_id string, name string, value string")
    results, read = incremental.StageResults(spark, str(tmp_path / "s"), "document_id string, n int"), []

    def stage(rows):
        def run(documents):
            mine = files(rows).join(documents, "document_id", "left_semi")
            read.append(mine.count())
            return mine.where("document_id <> 'd3'").groupBy("document_id").agg(F.sum(F.length("value")).cast("int").alias("n"))  # d3 gives no rows

        return run

    def go(rows, version="1"):
        prints = incremental.fingerprints(files(rows).select("document_id"), incremental.digests(files(rows)), version)
        n = results.update(prints, stage(rows))
        want = stage(rows)(files(rows).select("document_id").distinct())
        read.pop()
        assert sorted(results.read(prints).collect()) == sorted(want.collect())
        return n, prints

    assert go(rows)[0] == 30 and go(list(reversed(rows)))[0] == 0 and read == [60]
    prints = lambda rows: sorted(incremental.fingerprints(files(rows).select("document_id"), incremental.digests(files(rows)), "1").collect())
    assert prints(rows) == prints(rows[::-1] + rows[:5])
    changed = [(d, n, v + " more" if (d, n) == ("d7", "pages") else v) for d, n, v in rows]
    assert go(changed)[0] == 1 and read == [60, 2]
    assert go(rows)[0] == 0  # back again: the old results hold
    assert go(rows[2:])[0] == 0  # a document is gone
    n, now = go([(d, n, None if (d, n) == ("d8", "pages") else v) for d, n, v in rows])
    assert n == 1 and results.keep(now) == 3
    assert go([(d, n, None if (d, n) == ("d8", "pages") else v) for d, n, v in rows])[0] == 0
    assert len([p for p in (tmp_path / "s").iterdir()]) == 2
    assert go(rows, "2")[0] == 30  # another version of the stage


def test_blank_files_are_empty_and_long_ones_are_not_read_through(spark, tmp_path):
    for name, body in (("a", b"\n \t" * 10), ("b", b" " * 200_000 + "\u3000é".encode()), ("c", b"x" * 3_000_000), ("d", b""), ("e", b"\xff\xfe \xff")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "merged.md").write_bytes(body)
        (tmp_path / name / "other").write_bytes(b"x")
    got = {r.path.split("/")[-2]: (r.filled, r.bytes_read) for r in file_probe.probe(spark, str(tmp_path), "merged.md").collect()}
    assert {k: v[0] for k, v in got.items()} == {"a": False, "b": True, "c": True, "d": False, "e": False}
    assert got["c"][1] <= file_probe.CHUNK and got["b"][1] > 200_000
    results = spark.createDataFrame([(n, f"/in/{n}.pdf", str(tmp_path / n), "completed", i) for i, n in enumerate("abcdex")], "parse_task_id string, pdf_path string, output_dir string, parse_status string, ord long").withColumn("output_files", F.lit(None).cast("map<string,string>"))
    read = results.select(F.col("parse_task_id").alias("document_id"), F.lit('{"total_pages": 2}').alias("value"))
    read = json_tables.summaries(read).withColumn("flag_counts", F.lit(None).cast("map<string,bigint>"))
    pages = results.select("parse_task_id", F.lit(2).cast("long").alias("pages_count"))
    entries = registry.ingest(results, read, pages, file_probe.probe(spark, str(tmp_path), "merged.md"), "2026-01-01T00:00:00Z")
    levels = {r.parse_task_id: (r.merged_md, r.parse_quality_level, r.parse_quality_reasons) for r in entries.collect()}
    assert levels["a"] == levels["d"] == ("empty", "failed", ["merged.md is empty"]) and levels["x"][2] == ["merged.md is missing"] and levels["b"][:2] == ("ok", "pass")


def test_first_discards_against_plain_python(spark):
    rng = random.Random(2)
    rows = [(f"d{rng.randrange(3)}", i, rng.choice("fg"), rng.choice(["2024", "2023"]), [1], rng.choice(["exact_aliases", "phrase_aliases", "weak_aliases"]), round(rng.random(), 2), f"raw{i}") for i in range(200)]
    schema = "document_id string, ord long, canonical_field_name string, period_label string, source_pages array<int>, mapping_reason string, confidence double, raw_field_name string"
    frame = spark.createDataFrame(rows, schema).withColumns({"raw_value": F.col("ord").cast("string"), "table_id": F.lit("t")})
    score, want = {"exact_aliases": 3, "phrase_aliases": 2, "weak_aliases": 1}, {}
    best = {}
    for r in rows:
        key, rank = (r[0], r[2], r[3]), (score[r[5]], r[6])
        if key in best:
            gone = r
            if rank > (score[best[key][5]], best[key][6]):
                gone, best[key] = best[key], r
            want.setdefault(r[0], []).append((gone[2], gone[7], str(gone[1]), "t", gone[6], gone[5]))
        else:
            best[key] = r
    got = {}
    found = statements.discard_examples(frame)
    for r in found.orderBy("document_id", "place").collect():
        got.setdefault(r.document_id, []).append(tuple(r)[2:])
    assert got == {d: v[:10] for d, v in want.items()} and all(len(v) == 10 for v in got.values())
    assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString()


def test_canonical_records(spark):
    rows = spark.createDataFrame([("d", "t", 0, 0, [" a ", "b"]), ("d", "t", 0, 1, ["1"]), ("d", "u", 1, 0, [])], "document_id string, table_id string, table_ord long, row_index int, cells array<string>")
    sources = spark.createDataFrame([("d", "t", 0, "page_table", [3], "Cash Flow", [["f"]]), ("d", "u", 1, "page_table", [], None, None)], "document_id string, table_id string, table_ord long, source_type string, source_pages array<int>, title string, quality_flags array<array<string>>")
    got = {r.table_id: r.asDict(True) for r in tables.canonical(rows, sources).collect()}
    t = got["t"]
    assert t["title"] == "Cash Flow" and t["candidate_statement_type"] == "cash_flow_statement" and t["raw_markdown"] == "|  a  | b |\n| --- | --- |\n| 1 |  |"
    assert t["source"] == {"source_file": "", "source_pages": [3], "parser_source": "", "table_group_id": "", "source_type": "page_table"} and t["quality"]["quality_flags"] == [["f"]]
    assert t["cells"][0] == {"row_index": 0, "col_index": 0, "text": " a ", "normalized_text": "a", "is_header": True, "row_span": 1, "col_span": 1, "confidence": 1.0} and len(t["cells"]) == 3
    assert got["u"]["cells"] == [] and got["u"]["title"] == "" and got["u"]["raw_markdown"] == "" and got["u"]["quality"]["quality_flags"] == []


def test_scratch_tables_go_with_the_application(spark):
    assert store.folder(spark, "x").startswith(f"{spark.conf.get('spark.checkpoint.dir', store.LOCAL_SHARED)}/docstat-tables-{spark.sparkContext.applicationId}/x-")
    path = store.written(spark.range(3), "gone").inputFiles()[0]
    root = path.removeprefix("file:").rpartition("/gone-")[0]
    assert os.path.isdir(root)
    store._remove_at_exit(root)
    assert not os.path.exists(root)


@pytest.mark.parametrize("name", sorted(set(stage_plans.QUERIES) - {"document_report", "map_fields_by_table"}))  # covered by validation_suite and by the rules' own test
def test_stage_queries_equal_their_sql(spark, sf, name):
    db = duckdb.connect()
    for table in ("orders", "lineitem", "events", "pages", "conversations", "part", "documents"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    got, want = catalogue.QUERIES[name](spark, sf), db.sql(catalogue.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    shown = lambda rows, names: sorted(repr([v for _, v in sorted(zip(names, r))]) for r in rows)
    assert shown(got.collect(), got.columns) == shown(want.fetchall(), want.columns)


def test_stages_write_no_table_rows(spark, sf, monkeypatch):
    """What is written of tables and fields is what messages and report read."""
    kept = {}
    monkeypatch.setattr(store, "written", lambda frame, tag: kept.setdefault(tag, frame))
    stage_plans._stages(spark, sf)
    assert not {"rows", "raw_text", "head_periods"} & set(kept["tables"].columns)
    assert set(kept["fields"].columns) == set(stage_plans.COUNTED)


def test_only_lines_of_documents_that_pass_the_gate_are_mapped(spark, sf, monkeypatch):
    seen = []
    map_fields = mapping.map_fields
    monkeypatch.setattr(mapping, "map_fields", lambda made, *a, **k: seen.append(made) or map_fields(made, *a, **k))
    line_plans.gated_extraction(spark, sf)
    through = {r[0] for r in statements.passing(line_plans._gate(spark, sf)).select("document_id").collect()}
    mapped = {r[0] for r in seen[0].select("document_id").distinct().collect()}
    assert mapped and mapped <= through


def test_the_review_pack_is_made_once(spark, sf):
    """The pack is numbered as it was written: nothing of it is read or made again from the lines and the registry."""
    found = line_plans.review_top30(spark, sf)
    read = {path.rpartition("/")[0].rpartition("/")[2].partition("-")[0] for path in found.inputFiles()}
    assert read == {"review"} and len({path.rpartition("/")[0] for path in found.inputFiles()}) == 1


def test_types_alone_equal_those_of_the_tables(spark):
    texts = ["资产负债表", "Balance SHEET", "Balance", "SHEET", "股东 持股比例", "Kcash flow 1", "Ky 分部", "1,234.5", "(7)%", "", None, "净利润", "x"]
    rng = random.Random(3)
    rows = [("d", f"t{i // 4}", i // 4, i % 4, [rng.choice(texts) for _ in range(rng.randint(0, 9))]) for i in range(240)]
    frame = spark.createDataFrame(rows, "document_id string, table_id string, table_ord long, row_index int, cells array<string>")
    want = {(r.table_id, r.candidate_statement_type) for r in tables.tables(frame).collect()}
    assert {(r.table_id, r.candidate_statement_type) for r in tables.types(frame).collect()} == want and len({kind for _, kind in want}) > 4


def test_eligibility_of_entries_equals_that_of_requests(spark):
    rows = [("a", 2, "failed", ["x"]), ("a", 1, "pass", []), ("b", 3, "pass", []), ("c", 4, "pass", ["y"])]
    entries = spark.createDataFrame([(*r, "/out") for r in rows], "document_id string, ord long, parse_quality_level string, missing_files array<string>, output_dir string")
    log = spark.createDataFrame([("a", "approved_for_extraction", True, 1), ("b", "rejected", False, 2), ("b", "approved_with_warnings", True, 3)], "document_id string, review_decision string, approved_for_extraction boolean, ord long")
    key = lambda f: sorted(map(str, f.collect()))
    assert key(review.eligibility_of_entries(entries, log)) == key(review.eligibility(entries.select("document_id"), entries, log))


def test_files_are_parsed_once_for_their_messages(spark):
    """What `normalize` says of files, from one row a document that is read once."""
    page = lambda tables: json.dumps([{"page_number": 1, "tables": tables}])
    group = lambda tables: json.dumps([{"source_pages": ["1"], "table_group_id": "g", "tables": tables}])
    pages = {"a": page([[["x"]]]), "b": "{bad", "c": page([[], "x", None]), "d": '{"a": 1}', "e": "[]", "f": "[1, null]", "g": page([]), "h": "null", "i": page({"x": [["y"]]})}
    merged = {"b": group([{"table": [["x"]]}]), "c": '"text"', "d": group([{"table": []}]), "e": group("no list"), "f": "", "g": group([{"other": [["x"]]}, {"table": [[]]}])}
    files = spark.createDataFrame([(d, pages[d], merged.get(d)) for d in pages], "document_id string, page_file string, merged_file string")
    of = lambda found: spark.createDataFrame(list(found.items()), "document_id string, value string")
    none = lambda schema: spark.createDataFrame([], schema)
    records = none("document_id string, page_number int, parser_source string, table_group_id string, table_intent_score double, quality_flags array<string>")
    want = normalize.normalize(files.select("document_id"), of(pages), of(merged), records, none("document_id string, page_number int, flags array<string>"))[2]
    key = lambda frame: sorted(tuple(r) for r in frame.select("document_id", "severity", "message").collect())
    assert key(normalize.file_messages(files)) == key(want) and len(key(want)) > 8


def test_document_counts_equal_the_steps_they_stand_for(spark, sf):
    fields = line_plans._fields(spark, sf).select(*stage_plans.COUNTED)
    found = statements.document_counts(fields)
    got = {r.document_id: r for r in found.collect()}
    kept = statements.deduplicate_fields(fields).toPandas()
    mapped = {r.document_id: r.n_discarded for r in statements.mapping_discards(fields).collect()}
    chosen = {r.document_id: (r.n_fields, r.n_discarded) for r in statements.discarded_counts(statements.deduplicate_fields(fields)).collect()}
    best = statements.best_fields(statements.deduplicate_fields(fields)).groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("candidate_statement_type").alias("s")).collect()
    assert {d: r.n_discarded for d, r in got.items()} == mapped and {d: (r.n_kept, r.n_passed_over) for d, r in got.items()} == chosen
    assert {d: (r.n_chosen, r.n_statements) for d, r in got.items()} == {r.document_id: (r.n, r.s) for r in best}
    own = kept.groupby("document_id").agg(unit=("unit", lambda x: (x == "unknown").sum()), period=("period_label", lambda x: (x == "unknown_period").sum()), review=("requires_review", "sum"))
    assert all((r.unknown_unit, r.unknown_period, r.n_review) == tuple(own.loc[d]) for d, r in got.items())
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2  # the lines', and one for all counts


def test_stages_read_each_input_once(spark, sf, monkeypatch):
    """Files are made from one grouping of the lines, and messages count fields in one pass, whatever the number of results."""
    kept = {}
    monkeypatch.setattr(store, "written", lambda frame, tag: kept.setdefault(tag, frame))
    found = stage_plans._stages(spark, sf)[1]
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
    assert "collect_list" not in kept["tables"]._jdf.queryExecution().optimizedPlan().toString()
