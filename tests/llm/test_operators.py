import hashlib
import random
import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from docstat.llm import common, components, lines, packing, pieces, quality, simhash, substring

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
SHORT = "doc_id long, text string"


def corpus(n=150, seed=4):
    """Random texts with copies, near copies, shared passages, odd white space, empty and null texts."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(400)]
    passage = " ".join(rng.choices(words, k=40))
    out = []
    for i in range(n):
        kind, body = rng.random(), rng.choices(words, k=rng.randint(0, 120))
        if kind < 0.15 and out:
            body = (rng.choice(out)[1] or "").split(" ")
        elif kind < 0.35 and out:
            body = (rng.choice(out)[1] or "").split(" ")
            body[rng.randrange(len(body))] = rng.choice(words)
        elif kind < 0.6:
            body[len(body) // 2 : len(body) // 2] = passage.split()[rng.randrange(20) :]
        text = " ".join(body)
        out.append((i * 3, None if kind > 0.98 else "" if kind > 0.96 else text.replace(" ", rng.choice(["\n", " ", "\t ", " "]), rng.randrange(4))))
    rng.shuffle(out)
    return out


def hot():
    """One text a third of all rows have."""
    return [(10_000 + i, "a hot text that very many of the rows here have word for word and more") for i in range(90)]


def odd_columns(spark, rows):
    """Repeated rows, a null doc_id, and columns with the names that the operators use inside."""
    docs = spark.createDataFrame([*rows, rows[0], (None, "no id here")], SHORT)
    return docs.withColumns({c: F.lit(i) for i, c in enumerate(("key", "fp", "slice", "h", "score", "n", "row", "keep", "lang"))})


def words_of(text):
    return (text or "").encode().split()


def simhash_of(text):
    w = words_of((text or "").encode().lower().decode())
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    counts = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def least_reachable(ids, linked):
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in linked:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    return {i: top(i) for i in ids}


@pytest.mark.parametrize("most", [simhash.MOST_NODES, 3])
def test_simhash_equals_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "MOST_NODES", most)
    rows = corpus() + hot() + [(20_000 + i, None if i % 2 else " \t") for i in range(6)]
    want = {i: simhash_of(t) for i, t in rows}
    reach = least_reachable(want, [(a, b) for a, b in combinations(want, 2) if (want[a] ^ want[b]).bit_count() <= 2])
    got = simhash.digest_columns(simhash.near_components(spark.createDataFrame(rows, SHORT).repartition(3))).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (format(want[i], "016x"), reach[i]) for i in want} and len(got) == len(rows)


def test_simhash_edges(spark):
    docs = odd_columns(spark, corpus(20))
    assert simhash.near_components(docs).count() == 22 and simhash.near_components(docs.limit(0)).count() == 0
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns and kept.where("doc_id is null").count() == 1
    tree = simhash.Tree(2)
    rng = random.Random(0)
    values = [rng.getrandbits(12) for _ in range(300)]
    links = [(i, j) for i, v in enumerate(values) for j in tree.add(v)]
    close = [(i, j) for i, j in combinations(range(300), 2) if (values[i] ^ values[j]).bit_count() <= 2]
    assert least_reachable(range(300), links) == least_reachable(range(300), close) and len(links) < 300


def test_near_copies_go_and_clean_documents_stay(spark):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(3000)]
    rows, copies = [], set()
    for i in range(60):
        body = rng.choices(words, k=300)
        rows.append((i, " ".join(body)))
        if i % 3 == 0:
            near = list(body)
            for _ in range(3):  # about 0.9 of the five-word shingles
                near[rng.randrange(300)] = "changed"
            rows.append((1000 + i, " ".join(near)))
            copies.add(1000 + i)
    kept = {r.doc_id for r in simhash.deduplicate(spark.createDataFrame(rows, SHORT)).collect()}
    assert {i for i in range(60)} <= kept and len(kept & copies) <= 1


def planted_pairs():
    """(rows, links): pairs at cosines of 0.75, 0.80 and 0.85, and a family of near copies whose members chain; links by brute force."""
    rng = random.Random(9)
    new = lambda n: ["".join(rng.choices("abcdefghij", k=8)) for _ in range(n)]
    bodies = []
    for common, tail in [(75, 25), (80, 20), (85, 15)]:
        for _ in range(60):
            body = new(common + 4)
            bodies += [body + new(tail), body + new(tail)]
    family = new(200)
    for _ in range(60):
        near = list(family)
        for at in rng.sample(range(200), rng.choice([1, 2, 3, 6])):
            near[at] = new(1)[0]
        bodies.append(near)
    sets = [{tuple(b[j : j + 5]) for j in range(len(b) - 4)} for b in bodies]
    links = [(i, j) for i, j in combinations(range(len(sets)), 2) if 25 * len(sets[i] & sets[j]) ** 2 >= 16 * len(sets[i]) * len(sets[j])]
    marks = lambda b, i: " ".join(w.title() + "." if (k + i) % 7 == 0 else w for k, w in enumerate(b))
    return [(i, marks(b, i)) for i, b in enumerate(bodies)], links


@pytest.mark.parametrize("change", [{}, {"MOST_NODES": 3}, {"BLOCK": 8, "ANCHORS": 2}])
def test_wide_links_by_shingle_similarity(spark, monkeypatch, change):
    for name, value in change.items():
        monkeypatch.setattr(simhash, name, value, raising=False)
    rows, links = planted_pairs()
    assert sum(i < 120 for i, _ in links) == 0 and sum(120 <= i < 360 for i, _ in links) == 120
    rows += [(5000, None), (5001, " \t"), (5002, "same words here " * 9), (5003, "SAME words here " * 9), (5004, "two words"), (5005, "two, Words!"), (5006, "?!"), (5007, "?!")]
    want = least_reachable([i for i, _ in rows], [*links, (5000, 5001), (5002, 5003), (5004, 5005), (5006, 5007)])
    found = simhash.near_components(spark.createDataFrame(rows, SHORT).repartition(3), simhash.wide())
    assert {r.doc_id: r.component_id for r in found.collect()} == want


def test_a_long_chain_of_unlike_texts_costs_in_proportion(spark, monkeypatch):
    """Windows that slide over one text: each is a candidate of the next ones, few are similar, all are one cluster."""
    monkeypatch.setattr(simhash, "BLOCK", 4)
    monkeypatch.setattr(simhash, "ANCHORS", 1)
    rng, compared, plain = random.Random(8), [], simhash.compare

    def counted(rows, inside):
        rows = simhash.stage(rows, "counted")
        compared.append(rows.count())
        return plain(rows, inside)

    monkeypatch.setattr(simhash, "compare", counted)
    sizes = {}
    for n in (250, 1000):
        words = [f"w{rng.randrange(10**9)}" for _ in range(25 * n + 100)]
        rows = [(i, " ".join(words[25 * i : 25 * i + 100])) for i in range(n)]
        compared.clear()
        found = simhash.near_components(spark.createDataFrame(rows, SHORT).repartition(4), simhash.wide())
        assert {r.doc_id: r.component_id for r in found.collect()} == {i: i for i in range(n)}
        sizes[n] = sum(compared)
    assert sizes[1000] < 5 * sizes[250] and len(compared) == 3, sizes


def test_equal_fingerprints_of_unlike_texts_stay_apart(spark):
    rows = [(i, "one two three four five " * 40 + " ".join(f"own{i}x{j}" for j in range(30))) for i in range(4)]
    assert {r.doc_id for r in simhash.deduplicate(spark.createDataFrame(rows, SHORT)).collect()} == set(range(4))


@pytest.mark.parametrize("few", [5, 1000])
def test_components_of_paths_and_stars(spark, monkeypatch, few):
    """few: with 5, the star's hub is a hot key."""
    monkeypatch.setattr(common, "FEW_ROWS", few)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 200), (5, 5)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("held", [500_000, 50])
def test_edges_of_a_group_are_thinned_out_before_they_are_joined(spark, monkeypatch, held):
    """A group of 400 near copies under 39 bands has 39 edges a node; a few nodes at a time leave more edges, but the same components."""
    monkeypatch.setattr(components, "MOST_HELD", held)
    made = {}
    monkeypatch.setattr(components, "stage", lambda frame, tag: made.setdefault(tag, common.stage(frame, tag)) if tag == "edges" and not made else common.stage(frame, tag))
    monkeypatch.setattr(components, "drop_staged", lambda frame: None)
    edges = [(bytes([1, n // 256, n % 256]), bytes([0, 0, band])) for n in range(400) for band in range(39)] + [(b"\x03", b"\x02"), (b"\x02", b"\x03"), (b"\x04", b"\x04"), (None, b"\x05")]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a binary, b binary").repartition(3)).collect()}
    low = bytes([0, 0, 0])
    assert got == {n: low for pair in edges[:-4] for n in pair} | {b"\x03": b"\x02", b"\x02": b"\x02"}
    if held > 50:
        assert made["edges"].count() < 2 * 400  # of 15,601 before


def without_repeats(rows, k=13):
    first = {}
    for i, t in rows:
        w = words_of(t)
        for j in range(len(w) - k + 1):
            key = tuple(w[j : j + k])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, t in rows:
        w = words_of(t)
        gone = {j + x for j in range(len(w) - k + 1) if first[tuple(w[j : j + k])] < i for x in range(k)}
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest())
    return out


@pytest.mark.parametrize("slice_bytes", [substring.SLICE_BYTES, 900])
def test_substring_equals_brute_force(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(substring, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(substring, "RANGE_ENTRIES", slice_bytes)
    rows = corpus() + hot() + [(30_000, "w " * 3000), (30_001, "w " * 20)]
    got = substring.deduplicate(spark.createDataFrame(rows, SHORT).repartition(3)).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == without_repeats(rows) and len(got) == len(rows)


def test_substring_edges(spark):
    docs = odd_columns(spark, corpus(20))
    got = substring.deduplicate(docs).collect()
    assert len(got) == 22 and [r.n_removed for r in got if r.doc_id is None] == [0]
    assert substring.deduplicate(docs.limit(0)).count() == 0
    assert substring.deduplicate(spark.createDataFrame([(1, None), (2, "")], SHORT)).count() == 2


def sent_bytes(spark, n):
    """Bytes that the window step of op7 sends for n documents half of which repeat others' passages."""
    rng = random.Random(5)
    passages = [" ".join(rng.choices("abcdefghij", k=1) [0] + str(rng.randrange(10**9)) for _ in range(30)) for _ in range(n // 4)]
    rows = [(i, " ".join([*(str(rng.randrange(10**9)) for _ in range(30)), passages[i % len(passages)] if i % 2 else ""])) for i in range(n)]
    plan = substring.Plan(sum(len(t) for _, t in rows))
    slices = defaultdict(list)
    for i, t in rows:
        slices[i % plan.slices].append((i, t.encode()))
    raw = lambda part: substring.pa.table({"doc_id": [i for i, _ in part], "z": [substring.zstandard.compress(t) for _, t in part]})
    key = lambda k: (substring.pa.scalar(k),)
    blocks = substring.pa.concat_tables([plan.send_blocks(key(k), raw(part)) for k, part in slices.items()])
    answers = [substring.answer_blocks((r,), blocks.filter(substring.pa.compute.equal(blocks["range"], r))) for r in set(blocks["range"].to_pylist())]
    hits = substring.pa.concat_tables(answers)
    sent = [plan.send_windows(key(k), raw(part), hits.filter(substring.pa.compute.equal(hits["slice"], k))) for k, part in slices.items()]
    size = lambda *columns: sum(len(v.as_py()) for t in sent for c in columns for v in t[c])
    return plan, size("ids", "high", "low", "least"), size("high") // 8


def test_substring_traffic_is_linear(spark, monkeypatch):
    import pyarrow.compute  # noqa: F401

    monkeypatch.setattr(substring, "SLICE_BYTES", 4000)
    monkeypatch.setattr(substring, "RANGE_ENTRIES", 400)
    for n in (200, 400, 800):
        plan, sent, windows = sent_bytes(spark, n)
        assert plan.slices > n / 10 and windows > 10 * n / 2 and sent <= 26 * windows


def test_lines_equal_brute_force(spark):
    rng = random.Random(6)
    pool = ["\n".join(f"line {rng.randrange(10**6)}" for _ in range(6)) for _ in range(5)]
    rows = [(i, None if i == 7 else "" if i == 8 else "\n".join([f"own {i}", *rng.sample(pool, rng.randint(0, 3)), f"tail {i}"] * rng.randint(1, 2))) for i in range(120)] + [(500 + i, pool[0]) for i in range(60)]
    owners = defaultdict(set)
    for i, t in rows:
        own = lines.lines_of(t)
        for a, b in lines.chunks(own):
            if b - a > 1:
                owners[b"\n".join(own[a:b])].add(i)
    got = {r.doc_id: r for r in lines.deduplicate(spark.createDataFrame(rows, SHORT).repartition(3)).collect()}
    removed = 0
    for i, t in rows:
        own, kept, seen = lines.lines_of(t), [], set()
        for a, b in lines.chunks(own):
            c = b"\n".join(own[a:b])
            if b - a > 1 and len(owners[c]) > 1 and (min(owners[c]) != i or c in seen):
                continue
            seen.add(c)
            kept += own[a:b]
        removed += len(own) - len(kept)
        assert (got[i].n_removed_lines, got[i].kept) == (len(own) - len(kept), None if t is None else b"\n".join(kept).decode())
    assert removed > 100


def test_a_chunk_that_most_documents_have_is_not_brought_together(spark, monkeypatch):
    monkeypatch.setattr(common, "FEW_ROWS", 50)
    block = "\n".join(f"licence line {i}" for i in range(40))
    docs = spark.createDataFrame([(i, f"own {i}\n{block}\ntail {i}") for i in range(200)], SHORT).repartition(4)
    got = {r.doc_id: r.n_removed_lines for r in lines.deduplicate(docs).collect()}
    assert got[0] == 0 and all(got[i] >= 30 for i in range(1, 200))
    places = lines.stage(docs.select("doc_id", "text").mapInArrow(lines._rows(False), "doc_id long, h binary"), "places")
    joined = common.join_hot(places, lines.repeated(docs), "h", places.count())
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == sum(1 for _ in joined.collect())


def test_line_chunks_equal_an_independent_chunker():
    rng = random.Random(12)
    for n in (0, 1, 2, 3, 40, 700):
        own = [rng.choice([b"", b"a", str(rng.random()).encode()]) for _ in range(n)]
        hashes = [xxhash.xxh64_intdigest(line) for line in own]
        cut, ends = 0, []
        for i in range(n):
            value = (hashes[i] + (hashes[i - 1] * 0x9E3779B97F4A7C15 if i else 0)) % 2**64
            mixed = (value ^ (value >> 31)) * 0xD6E8FEB86659FD93 % 2**64
            if i + 1 - cut == 32 or (i + 1 - cut >= 2 and mixed // 2**40 < 2**24 // 3):
                ends.append((cut, i + 1))
                cut = i + 1
        assert lines.chunks(own) == ends + [(cut, n)] * (cut < n)


def test_line_chunks_move_with_their_lines():
    rng = random.Random(1)
    body = [f"{rng.random()}".encode() for _ in range(400)]
    text = lambda own: {tuple(own[a:b]) for a, b in lines.chunks(own)}
    assert len(text(body) & text([b"new", *body])) > 0.8 * len(text(body))
    assert all(b - a <= lines.MOST_LINES for a, b in lines.chunks(body)) and sum(b - a for a, b in lines.chunks(body)) == 400 and lines.chunks([]) == []


def test_line_edges(spark):
    docs = odd_columns(spark, [(1, "a\nb\nc\nd"), (2, "a\nb\nc\nd")])
    got = lines.digest_columns(docs).collect()
    assert sorted((r.doc_id or 0, r.n_removed_lines) for r in got) == [(0, 0), (1, 0), (1, 0), (2, 4)]
    assert lines.deduplicate(docs.limit(0)).count() == 0


TEXTS = [None, "", " ", "  a  b ", "It's THE end\tof é <|endoftext|> x<|endoftext|>y", "▁x ▁", "é😀中 Ⅷ ﬁ\x00", "a" * 4000, "don't 12,5%!! ---", "<s> </s> <unk> <0x41>", "x　y\xa0z w"]


def test_pieces_equal_the_library_and_round_trip(spark):
    library = SentencePieceProcessor(model_file=PIECE_BPE)
    rng = random.Random(3)
    rows = list(enumerate(TEXTS + ["".join(rng.choices("abcdefghist  \n'é", k=rng.randint(1, 50))) for _ in range(400)] + [t for _, t in corpus(60)]))
    got = {r.doc_id: r for r in pieces.encode_column(spark.createDataFrame(rows, SHORT).repartition(3), PIECE_BPE).collect()}
    for i, t in rows:
        assert np.frombuffer(got[i].ids, "<u4").tolist() == library.encode(t or ""), t
        assert got[i].decoded == ((t or "").replace("▁", " ") if not (t or "").startswith("▁") else got[i].decoded)
    digest = {r.doc_id: r.score for r in pieces.digest_columns(spark.createDataFrame(rows, SHORT), PIECE_BPE).collect()}
    for i, t in rows:
        assert abs(digest[i] - sum(library.get_score(k) for k in library.encode(t or "") if not library.is_byte(k))) < 1e-6 * (1 + abs(digest[i])), t
    digest = {r.doc_id: r for r in pieces.digest_columns(odd_columns(spark, rows[:5]), PIECE_BPE).collect()}
    assert digest[3].round_trip and digest[3].n_ids == len(library.encode(TEXTS[3])) and digest[3].decoded_sha256 == hashlib.sha256(TEXTS[3].encode()).hexdigest()


def test_packing_places_every_id_once(spark):
    library = Tokenizer.from_file(WORD_BPE)
    rows = list(enumerate(TEXTS)) + [(100 + i, t) for i, t in corpus(120)] + [(5000, "word two " * 4000)]
    ids = {i: np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for i, t in rows}
    got = packing.pack(spark.createDataFrame(rows, SHORT).repartition(4), WORD_BPE).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(ids)
    for i, parts in by_doc.items():
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[i]) and r.ids_crc32 == zlib.crc32(ids[i][at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids[i])
    padding = 0
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        padding += 2048 - at
    assert padding < 0.1 * sum(map(len, ids.values())) + 2048


def test_packing_edges(spark):
    assert packing.pack(spark.createDataFrame([], SHORT), WORD_BPE).count() == 0
    assert {r.doc_id for r in packing.pack(odd_columns(spark, corpus(10)), WORD_BPE).collect()} >= {None}
    assert all(sum(packing.cuts(r)) == r for r in range(2048))


def quality_rows():
    rng = random.Random(2)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 8))) for _ in range(800)]
    make = {
        1: lambda: " ".join(rng.choices(words, k=rng.randint(30, 200))) + ".",
        0: lambda: rng.choice([" ".join(w.upper() + "!!" for w in rng.choices(words, k=60)), " ".join(w + rng.choice(["***", "###", "$$$"]) for w in rng.choices(words, k=60))]),
    }
    return [(i, make[i % 3 > 0](), int(i % 3 > 0)) for i in range(600)]


def test_quality_learns_and_ignores_held_out_labels(spark):
    rows = quality_rows()
    docs = spark.createDataFrame([r[:2] for r in rows] + [(9000, ""), (9001, None), (9002, "x" * 100_000), (None, "y")], SHORT)
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int")
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == 604 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert all(got[i].held_out == held(i) for i, _, _ in rows) and not got[None].held_out
    right = [got[i].predicted == q for i, _, q in rows if held(i)]
    assert len(right) > 50 and np.mean(right) > 0.97
    assert got[9000].score == got[9001].score
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in quality.classify(docs.limit(40), labels).collect()}
    assert again == {r.doc_id: r.score for r in quality.classify(docs.limit(40), turned).collect()}
    extra = docs.withColumns({"score": F.lit("s"), "quality": F.lit(1), "__text": F.lit("t")})
    kept = quality.accept(extra, labels)
    assert kept.columns == extra.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}


def test_quality_score_equals_a_plain_convolution():
    net, text = quality.Network(3), "Some text, é and more. ".encode() * 60
    p, scores = {k: v.astype(float) for k, v in net.p.items()}, []
    step = quality.CHUNK - quality.OVERLAP
    for sample in (text, b"short one", b""):
        logits = []
        for lo in range(0, max(1, len(sample) - quality.OVERLAP), step):
            chunk = sample[lo : lo + quality.CHUNK]
            used, padded = max(len(chunk), quality.WIDTH), chunk + b"\0" * (quality.CHUNK - len(chunk))
            response = []
            for at in range(0, used - quality.WIDTH + 1, quality.STRIDE):
                patch = np.concatenate([p["embed"][b] for b in padded[at : at + quality.WIDTH]])
                response.append([np.tanh(sum(patch * p["filters"][:, f]) + p["bias"][f]) for f in range(quality.FILTERS)])
            pools = np.concatenate([np.max(response, 0), np.mean(response, 0), [used / quality.CHUNK]])
            logits.append(np.tanh(pools @ p["hidden"] + p["hidden_bias"]) @ p["out"] + p["out_bias"][0])
        scores.append(1 / (1 + np.exp(-np.mean(logits))))
    assert np.allclose(net.scores([text, b"short one", b""], net.tables()), scores, atol=2e-5)


def test_quality_draws_from_whole_texts():
    long = ("a" * 200_000 + "z" * 200_000).encode().decode()
    batch = quality.pa.RecordBatch.from_arrays([quality.pa.array([1, 2], quality.pa.int64()), quality.pa.array([1, 0], quality.pa.int32()), quality.pa.array([long, ""])], names=["doc_id", "quality", "text"])
    drawn = next(quality.draw(iter([batch])))["drawn"].to_pylist()
    assert len(drawn[0]) == quality.CHUNKS_A_TEXT * quality.CHUNK and set(drawn[0]) <= {97, 122} and len(drawn[1]) == quality.CHUNK


def test_quality_chunks_cover_the_text_and_no_labels_give_a_half(spark):
    for n in (0, 1, 511, 512, 513, 5000):
        text = bytes(random.Random(n).choices(range(1, 256), k=n))
        step = quality.CHUNK - quality.OVERLAP
        back = b"".join(bytes(c[: step if i < len(quality.chunks(text)) - 1 else None]) for i, c in enumerate(quality.chunks(text)))
        assert back.rstrip(b"\0") == text
    docs = spark.createDataFrame([(1, "a")], SHORT)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.classify(docs, none).first().score == 0.5 and quality.classify(docs.limit(0), none).count() == 0
