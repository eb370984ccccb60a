import hashlib
import random
import re

from pyspark.sql import functions as F

from docstat.llm import exact_dedup, pii, secrets

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SECRET = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]+",
}


def luhn(s):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 * (int(c) > 4)) for i, c in enumerate(reversed(s))) % 10 == 0


def keeps(kind, m):
    d = re.sub("[^0-9]", "", m[0])
    return {
        "email": lambda: True,
        "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
        "card": lambda: 13 <= len(d) <= 19 and luhn(d),
        "phone": lambda: 9 <= len(d) <= 15,
        "assign": lambda: len(m[2]) >= 6,
        "access": lambda: len(m[0]) >= 20,
        "hex": lambda: len(m[0]) >= 24,
    }[kind]()


def brute(text, patterns):
    return [(k, m.start(), m.end()) for k, p in patterns.items() for m in re.finditer(p, text or "") if keeps(k, m)]


def texts():
    rng = random.Random(5)
    bits = ["a", "b.c", "@", "x@y", ".com", "+1", "(555)", "555-1234", "0049", " ", " ", "-", ".", "4111 1111 1111 1111", "4111111111111111", "1.2.3.4", "255.255.255.256", "10.0.0.", "é", "😀",
            "token", "=", ": ", "'", '"', "Password", "api_key", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", "secret=abc", "\n", "_", "%", "00000000001.1.1.1"]
    return [None, "", " ", "1" * 5000, "a" * 5000 + "@", "1 " * 4000, "a.b@c.d_e@f.g x", "token=token: abcdefgh"] + ["".join(rng.choices(bits, k=rng.randint(1, 40))) for _ in range(600)]


def test_base_spans_equal_brute_force(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in pii.digest_columns(pii.find(docs)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        want = ",".join(f"{k}:{a}:{b}" for k, a, b in brute(t, BASE))
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (t, want, got[i].spans)
        assert set(filter(None, want.split(","))) <= set(got[i].spans.split(","))
        assert [got[i][f"n_{k}"] for k in BASE] == [sum(x[0] == k for x in brute(t, BASE)) for k in BASE]


def test_secret_spans_equal_brute_force(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in secrets.digest_columns(secrets.find(docs)).collect()}
    kinds = list(SECRET)
    for i, t in rows:
        want = ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(brute(t, SECRET), key=lambda x: (x[1], kinds.index(x[0]))))
        assert got[i].spans == want, t


def test_ledger_scans_only_unseen_pairs(spark, tmp_path):
    old = spark.createDataFrame([(1, "token=abcdef1"), (2, "none")], "doc_id long, text string")
    new = spark.createDataFrame([(1, "token=abcdef1"), (3, "secret: zzzzzz9"), (4, "secret: zzzzzz9"), (None, None)], "doc_id long, text string")
    path = str(tmp_path / "ledger")
    assert secrets.update_ledger(old, path).count() == 2
    assert secrets.scan_unseen(secrets.versions(new), secrets.ledger_at(spark, path)).count() == 2
    assert secrets.scan_unseen(secrets.versions(new), secrets.ledger_at(spark, path), "v2").count() == 3
    before = {p.name for p in (tmp_path / "ledger").glob("*.parquet")}
    got = secrets.find(new, path).collect()
    assert sorted((str(r.doc_id), len(r.findings)) for r in got) == [("1", 1), ("3", 1), ("4", 1), ("None", 0)]
    assert before < {p.name for p in (tmp_path / "ledger").glob("*.parquet")} and secrets.ledger_at(spark, path).count() == 4
    assert secrets.scan_unseen(secrets.versions(new), secrets.ledger_at(spark, path)).count() == 0
    assert secrets.find(new, path).count() == 4 and secrets.ledger_at(spark, path).count() == 4
    assert "abcdef1" not in str(secrets.ledger_at(spark, path).collect())


def test_copies_of_a_blob_are_one_before_the_shuffle_in_every_instalment(spark, tmp_path):
    rows = [(i, "token=hothot9 in very many rows" if i % 3 == 0 else f"own {i} secret: value{i}") for i in range(300)]
    docs, path = spark.createDataFrame(rows, "doc_id long, text string").repartition(6), str(tmp_path / "ledger")
    secrets.update_ledger(docs.where("doc_id < 100"), path)
    unseen = secrets.scan_unseen(secrets.versions(docs), secrets.ledger_at(spark, path))
    plan = unseen._jdf.queryExecution().executedPlan().toString()
    exchanges = re.findall(r"Exchange hashpartitioning\(blob_id[^\n]*\n([^\n]*)", plan)
    assert any("partial_first(text" in x for x in exchanges) and all("Aggregate(key" in x for x in exchanges), plan
    found = secrets.find(docs, path)
    assert sorted((r.doc_id, len(r.findings)) for r in found.collect()) == [(i, 1) for i in range(300)] and secrets.ledger_at(spark, path).count() == 201


def test_contexts_discover_unseen_identifiers(spark):
    seeds = [(i, f"write to contact me: user{i}@site.example now") for i in range(12)]
    hidden = [(100, "please contact me: u9-at-site now"), (101, "see section b2 now")]
    docs = spark.createDataFrame(seeds + hidden, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.digest_columns(pii.find(docs)).collect()}
    assert got[100].spans == "email:19:29" and got[100].n_email == 0 and got[100].n_added == 1
    assert got[101].spans == ""
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert clean[100] == "please contact me: <EMAIL> now" and clean[3] == "write to contact me: <EMAIL> now" and clean[101] == hidden[1][1]


def test_empty_and_extra_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find(empty).count() == secrets.find(empty).count() == exact_dedup.decide(empty).count() == exact_dedup.deduplicate(empty).count() == pii.redact(empty).count() == 0
    docs = spark.createDataFrame([(1, "a@b.cd", "x", 1, 2, 9), (1, "a@b.cd", "x", 1, 2, 9), (None, None, None, None, None, None)], "doc_id long, text string, kind string, key int, base int, n_chars long")
    got = sorted(pii.redact(docs).collect(), key=lambda r: r.doc_id or 0)
    assert len(got) == 3 and got[1].text == "<EMAIL>" and got[1].n_chars == 7 and got[0].text is None
    assert exact_dedup.deduplicate(docs.withColumns({"n": F.lit(1), "top": F.lit(2), "text_sha256": F.lit("q")})).count() == 2


def test_exact_dedup_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a b", "ab", "a\tb ", "b", "", None, " ", "é é", "éé", f"u{i}"])) for i in range(400)] + [(400 + i, "hot text" + " " * (i % 3)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    for share in (0.0005, 0.1, 2.0):  # all groups heavy, some, none
        got = {r.doc_id: r for r in exact_dedup.decide(docs, share).collect()}
        assert len(got) == len(rows)
        for key, members in groups.items():
            for _, i in members:
                r = got[i]
                assert (r.keep_id, r.group_size, r.kept) == (min(members)[1], len(members), i == min(members)[1])
                assert r.text_sha256 == hashlib.sha256(key.encode()).hexdigest()
        assert sorted(r.doc_id for r in exact_dedup.deduplicate(docs, share).collect()) == sorted(min(m)[1] for m in groups.values())


def test_planted_identifiers_are_found_and_others_are_not(spark):
    rng = random.Random(4)
    kinds = {"email": lambda: f"u{rng.randrange(10**6)}@mail.example", "phone": lambda: f"+1 555 {rng.randrange(100, 999)} {rng.randrange(1000, 9999)}"}
    lead = {"email": "reach them under", "phone": "her mobile is"}
    rows, hidden = [], {}
    for kind, make in kinds.items():
        for _ in range(20):
            rows.append(f"{lead[kind]} {make()} or later")
        for _ in range(5):
            odd = f"x{rng.randrange(10**6)}-at-home" if kind == "email" else f"555-{rng.randrange(1000, 9999)}"
            hidden[len(rows)] = (kind, odd)
            rows.append(f"{lead[kind]} {odd} or later")
    later = hidden[22][1]
    again = [hidden[i][1] for i in (20, 21, 22, 23, 24)]
    for odd in again:  # known from the first round, in a context of their own
        hidden[len(rows)] = ("email", odd)
        rows.append(f"handle on chat {odd} , he said")
    hidden[len(rows)] = ("email", "y77-at-work")  # only that context shows it
    rows.append("handle on chat y77-at-work , he said")
    decoys = [f"see section {rng.randrange(99)} for more" for _ in range(20)] + [f"pay with 411111111111111{d} now" for d in (0, 2)] + [f"unlike {later} elsewhere"] + ["her mobile is 300.1.1.1 or later"]
    docs = spark.createDataFrame(list(enumerate(rows + decoys)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    for i, text in enumerate(rows + decoys):
        want = [(hidden[i][0], text.index(hidden[i][1]), text.index(hidden[i][1]) + len(hidden[i][1]))] if i in hidden else []
        assert [tuple(s) for s in got[i].added] == want, text


def test_candidates_side_by_side_have_contexts(spark):
    rows = [(i, f"write to or call {i}@a.bc and {i}x@d.ef now") for i in range(9)] + [(100, "write to or call u-1 and u-2 now")]
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got[100].added) == 2


def test_cost_is_linear_in_matches(spark):
    text = "a@b.cd 10.0.0.1 " * 6000
    found = pii.redact(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().text
    assert found == "<EMAIL> <IP> " * 6000
    assert len(pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().base) == 12_000


def test_every_query_takes_odd_rows(spark):
    from docstat.llm import lines, media, packing, pieces, simhash, substring
    import public_tokenizers as p

    words, marks = p.path("word_bpe_49k.json"), p.path("piece_bpe_32k.model")
    every = {
        "pii": lambda d: pii.digest_columns(pii.find(d)), "exact": exact_dedup.decide, "simhash": lambda d: simhash.digest_columns(simhash.near_components(d)), "lines": lines.digest_columns,
        "media": lambda d: media.describe(media.encode(d)), "substring": substring.deduplicate, "pieces": lambda d: pieces.digest_columns(d, marks), "secrets": lambda d: secrets.digest_columns(secrets.find(d)),
    }
    rows = [(1, "long word " * 30_000), (2, None), (3, ""), (3, ""), (None, "x"), (None, None), (4, "x" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("key", "blob_id", "path", "findings", "instance", "fp", "n", "media", "start", "TOP")})
    for name, run in every.items():
        got = run(docs).collect()
        assert len(got) == 7 and sum(r.doc_id is None for r in got) == 2, name
        assert run(docs.limit(0)).count() == 0, name
    assert {r.doc_id for r in packing.pack(docs, words).collect()} == {1, 2, 3, 4, None}
