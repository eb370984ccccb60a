"""Decontamination, ranked search and centroid clustering against plain versions of themselves."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docstat.llm import clusters, decontaminate, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def texts(n=120, seed=7, passages=()):
    rng = random.Random(seed)
    words = ["".join(rng.choices("aBcdÉ9", k=rng.randint(1, 3))) for _ in range(60)]
    out = []
    for i in range(n):
        body = rng.choices(words, k=rng.choice([0, 1, 5, 30, 200]))
        if passages and rng.random() < 0.4:
            body[len(body) // 2 : len(body) // 2] = rng.choice(passages).split()[rng.randrange(3) :]
        out.append((i, rng.choice([" ", ", ", "\n-- "]).join(body)))
    return out


PASSAGES = ["one two three four five six seven eight nine ten eleven twelve thirteen", "só short an item", "x " * 14 + "y"]
ITEMS = [(0, PASSAGES[0]), (1, PASSAGES[1].upper()), (2, PASSAGES[2]), (3, PASSAGES[0] + " and some more words"), (3, PASSAGES[1]), (None, "aB aB cd"), (5, ""), (6, None), (7, "--- !"), (8, "never seen in any document at all")]


def odd(spark, rows, schema="doc_id long, text string"):
    docs = spark.createDataFrame([*rows, rows[0], (None, rows[3][1]), (900, None), (901, ""), (902, " .;\t")], schema)
    return docs.withColumns({c: F.lit(i) for i, c in enumerate(("key", "n_words", "items", "spans", "rank", "score", "term"))})


@pytest.fixture(scope="module")
def corpus(spark):
    return odd(spark, texts(passages=PASSAGES))


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def plain_hits(text, benchmark):
    words, hit, found = terms(text), set(), set()
    for name, item in benchmark:
        own = terms(item)
        size = min(10, len(own))
        for i in range(len(own) - size + 1 if size else 0):
            for at in range(len(words) - size + 1):
                if words[at : at + size] == own[i : i + size]:
                    hit.update(range(at, at + size))
                    found.add("" if name is None else str(name))
    return len(words), len(hit), found


@pytest.mark.parametrize("block_words, segment", [(250_000, 4096), (9, 3)])
def test_contaminated_words_are_those_of_a_plain_search(monkeypatch, corpus, items, block_words, segment):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block_words)
    monkeypatch.setattr(decontaminate, "SEGMENT", segment)
    rows = corpus.select("doc_id", "text").collect()
    want = Counter()
    for r in rows:
        n, hit, found = plain_hits(r["text"], ITEMS)
        want[(r["doc_id"], n, hit, len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), hit > 0)] += 1
    got = Counter(tuple(r) for r in decontaminate.digest_columns(corpus, items).collect())
    assert got == want and any(x[2] for x in want) and any(not x[2] and x[1] for x in want)


def test_decontaminating_removes_documents_or_spans(spark, corpus, items):
    clean = decontaminate.decontaminate(corpus, items)
    assert clean.columns == corpus.columns
    want = Counter(tuple(r) for r in corpus.collect() if not plain_hits(r["text"], ITEMS)[1])
    assert Counter(tuple(r) for r in clean.collect()) == want
    cut = decontaminate.decontaminate(corpus, items, spans=True)
    assert cut.columns == corpus.columns and cut.count() == corpus.count()
    docs = spark.createDataFrame([(1, "Keep, (ONE two; three four\nfive six seven eight nine ten eleven twelve thirteen) but é this"), (2, None)], "doc_id long, text string")
    assert [r["text"] for r in decontaminate.decontaminate(docs, items, spans=True).orderBy("doc_id").collect()] == ["Keep, () but é this", None]
    assert decontaminate.digest_columns(docs, items.limit(0)).where("contaminated or n_items > 0").count() == 0
    assert decontaminate.digest_columns(docs.limit(0), items).count() == 0


def test_a_passage_that_a_third_of_the_rows_have_is_found_in_all(spark, items):
    rows = [(i, "some words before " + PASSAGES[0] if i % 3 == 0 else f"nothing here {i}") for i in range(300)]
    found = decontaminate.digest_columns(spark.createDataFrame(rows, "doc_id long, text string"), items)
    assert found.where("contaminated").count() == 100


def plain_ranking(docs, benchmark, top=50):
    counts = [(d, Counter(terms(t))) for d, t in docs]
    counts = [(d, c, sum(c.values())) for d, c in counts if c]
    n_docs, n_terms = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    wanted = {}
    for name, text in benchmark:
        wanted.setdefault(name, set()).update(terms(text))
    out = []
    for name, own in wanted.items():
        scored = []
        for d, c, n in counts:
            m = 50 + (50 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in own if c[t])
            if score > 0:
                scored.append((-score, d is None, d or 0))
        for rank, (score, none, d) in enumerate(sorted(scored)[:top], 1):
            out.append((name, rank, None if none else d, -score))
    return Counter(out)


@pytest.mark.parametrize("setting", [{}, {"ITEM_TERMS": 12, "FEW": 3, "TERMS_HELD": 5, "SPREAD": 2, "TRIED": 1}])
def test_ranking_is_that_of_scoring_every_document(monkeypatch, corpus, items, setting):
    for name, value in setting.items():
        monkeypatch.setattr(search, name, value)
    more = items.unionByName(items.sparkSession.createDataFrame([(i, t[:80]) for i, t in texts(15, seed=7)], "i long, text string").select((F.col("i") + 100).alias("item_id"), "text"))
    rows = [tuple(r) for r in corpus.select("doc_id", "text").collect()]
    want = plain_ranking(rows, [tuple(r) for r in more.collect()], 5)
    assert Counter(tuple(r) for r in search.search(corpus, more, 5).collect()) == want and sum(want.values()) > 50


def test_search_over_copies_and_nothing(spark, items):
    rows = [(i, "an item that a third of all have" if i % 3 == 0 else f"other words {i} {'item ' * (i % 5)}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = spark.createDataFrame([(1, "item third"), (2, "words"), (3, "zzz")], "item_id long, text string")
    assert Counter(tuple(r) for r in search.search(docs, wanted).collect()) == plain_ranking(rows, [(1, "item third"), (2, "words"), (3, "zzz")])
    for d, w in ((docs.limit(0), wanted), (docs, wanted.limit(0)), (docs.select("doc_id", F.lit("").alias("text")), wanted)):
        found = search.search(d, w)
        assert found.count() == 0 and found.columns == ["item_id", "rank", "doc_id", "score"]


def test_bounds_are_never_below_scores(corpus, items):
    made = search.index(corpus)
    df = {bytes(r["term"]): r["n"] for r in made.where("term is not null").groupBy("term").agg(F.sum("df").alias("n")).collect()}
    blocks = made.where("slices is not null").collect()
    lengths = [n for b in blocks for n in b["lengths"]]
    own = search.Items([0, 1], [{t.encode() for t in terms(PASSAGES[0])}, {t.encode() for t in terms("aB cd 9 É aa")}], df, len(lengths), sum(lengths))
    by_key = {r["key"]: Counter(t.encode() for t in terms(r["text"])) for r in corpus.select(search.row_key(corpus).alias("key"), "text").collect()}
    left_out = 0
    for b in blocks:
        slices = np.frombuffer(b["slices"], np.uint8).reshape(b["width"], -1)
        for lo, bounds in own.bounds(np.array(b["lengths"]), b["width"], slices):
            for i in range(2):
                for at in range(bounds.shape[1]):
                    c, m = by_key[b["keys"][lo + at]], search.damping(b["lengths"][lo + at], len(lengths), sum(lengths))
                    score = sum(own.weight[t] * search.share(c[t], m) for t in own.terms[i] if t in c)
                    assert bounds[i, at] >= score
                    left_out += bounds[i, at] == 0
    assert left_out  # bounds do say something


@pytest.mark.parametrize("probes, slices, matrix, documents", [(1, 2, 64, 8), (10, 30, 1 << 22, 4096), (3, 4, 1000, 24)])
def test_bounds_hold_with_few_slices_and_small_blocks(monkeypatch, probes, slices, matrix, documents):
    for name, value in {"PROBES": probes, "SLICES_A_PAIR": slices, "MATRIX": matrix, "DOCUMENTS": documents}.items():
        monkeypatch.setattr(search, name, value)
    rng = random.Random(5)
    words = [f"w{i}".encode() for i in range(300)]
    docs = [Counter(rng.choices(words, weights=[1 / (i + 1) for i in range(300)], k=rng.choice([3, 40, 2000]))) for _ in range(100)]
    blocks, done = {}, []
    for i, c in enumerate(docs):
        often = np.array(list(c.values()))
        width = search.width_for(int(np.searchsorted(search.LEVELS, often, "right").sum()))
        block = blocks.setdefault(width, search.Block(width))
        block.add(i, i, sum(c.values()), np.array([search.term_hash(t) for t in c], np.uint64), often)
        if len(block.docs) == block.room:
            done.append(blocks.pop(width))
    total = sum(sum(c.values()) for c in docs)
    items = search.Items(list(range(20)), [set(rng.sample(words, 12)) for _ in range(20)], dict(Counter(t for c in docs for t in c)), len(docs), total)
    seen = set()
    for block in [*done, *blocks.values()]:
        row = block.batch().to_pylist()[0]
        for lo, bounds in items.bounds(np.array(row["lengths"]), row["width"], np.frombuffer(row["slices"], np.uint8).reshape(row["width"], -1)):
            for at in range(bounds.shape[1]):
                c, m = docs[row["keys"][lo + at]], search.damping(row["lengths"][lo + at], len(docs), total)
                seen.add(row["keys"][lo + at])
                for i in range(20):
                    assert bounds[i, at] >= sum(items.weight[t] * search.share(c[t], m) for t in items.terms[i] if t in c)
    assert len(seen) == 100


def vectors(n=400, dims=64, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    return [(i, (centres[rng.integers(12)] + rng.normal(size=dims) * 0.4).astype(np.float32).tolist()) for i in range(n)]


def plain_clusters(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    hashed = sorted((hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    now = [v for _, v in hashed[:k]]
    data = np.array([v for _, v in kept])

    def assign():
        table = np.stack([((data - np.array(c)) ** 2).sum(axis=1) for c in now])
        return table.argmin(axis=0), table.min(axis=0)

    for _ in range(rounds):
        own, _d = assign()
        for c in range(len(now)):
            if (own == c).any():
                now[c] = [int(s) // int((own == c).sum()) for s in data[own == c].sum(axis=0)]
    own, d = assign()
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    return Counter((i, int(c), int(x), int(d[own == c].sum()), int(d.sum()), sha[c]) for (i, _), c, x in zip(kept, own, d))


def test_clusters_are_those_of_comparing_everything(spark):
    rows = vectors()
    odd_ones = [(1000, None), (1001, [0.5] * 63), (1002, [None] + [0.5] * 63), (1003, [float("nan")] * 64), (1004, [float("inf")] * 64), (None, rows[1][1]), rows[0], (1005, rows[2][1])]
    hot = [(2000 + i, rows[7][1]) for i in range(150)]  # ties and one vector that a fourth of all rows have
    frame = spark.createDataFrame(rows + odd_ones + hot, "vec_id long, embedding array<float>").withColumns({"own": F.lit(1), "vector": F.lit("x")})
    log = []
    got = Counter(tuple(r) for r in clusters.cluster(frame.repartition(5), log=log).collect())
    assert got == plain_clusters(rows + odd_ones + hot)
    assert log[0] == 553 and sum(log[2:]) < 0.8 * 553 * (len(log) - 2)  # the bounds leave most vectors alone
    few = frame.where("vec_id < 3")
    assert Counter(tuple(r) for r in clusters.cluster(few).collect()) == plain_clusters([(i, v) for i, v in rows[:3] + [rows[0]]])
    assert clusters.cluster(frame.limit(0)).count() == 0 and clusters.cluster(frame.where("vec_id = 1001")).count() == 0


def test_drift_in_the_plane_covers_every_vector_and_is_below_the_full_drift():
    rng = np.random.default_rng(1)
    tighter = 0
    for _ in range(200):
        before = rng.normal(size=(4, 3)) * 10
        after = before + rng.normal(size=(4, 3)) * rng.choice([0.1, 2, 10])
        radii = rng.uniform(0, 8, 4)
        off = clusters.loosening(before, after, radii)
        drift = np.linalg.norm(after - before, axis=1)
        for i in range(4):
            on = rng.normal(size=(300, 3))
            x = before[i] + on / np.linalg.norm(on, axis=1)[:, None] * radii[i] * rng.uniform(0, 1, 300)[:, None] ** 0.1
            for j in range(4):
                nearer = np.linalg.norm(x - before[j], axis=1) - np.linalg.norm(x - after[j], axis=1)
                assert nearer.max() <= off[i, j] + 1e-9 and off[i, j] <= drift[j] * 1.001 + 1e-6
                tighter += off[i, j] < 0.9 * drift[j]
    assert tighter > 800
