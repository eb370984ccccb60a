import hashlib
import zlib

import numpy as np
import pytest

from docstat.llm import media, webp
from tests.llm import vp8l


def picture(kind, h, w, seed=1):
    rng = np.random.default_rng(seed)
    if kind == "noise":
        return rng.integers(0, 256, (h, w, 4), dtype=np.uint8)
    if kind == "flat":
        return np.full((h, w, 4), 7, np.uint8)
    few = rng.integers(0, 256, ({"two": 2, "four": 4, "sixteen": 16, "many": 90}[kind], 4), dtype=np.uint8)
    return few[rng.integers(0, len(few), (h, w))]


@pytest.mark.parametrize("transforms", [(), (webp.PREDICTOR,), (webp.CROSS_COLOUR,), (webp.SUBTRACT_GREEN,), (webp.PALETTE,), (webp.PREDICTOR, webp.CROSS_COLOUR, webp.SUBTRACT_GREEN), (webp.SUBTRACT_GREEN, webp.PREDICTOR)])
@pytest.mark.parametrize("how", [{}, {"cache_bits": 4}, {"back": True}, {"cache_bits": 7, "back": True, "groups": 3}, {"groups": 2}])
def test_decoder_inverts_every_feature(transforms, how):
    for kind in ("two", "four", "sixteen", "many", "flat", "noise"):
        if kind == "noise" and webp.PALETTE in transforms:
            continue
        p = picture(kind, 9, 13)
        assert np.array_equal(webp.decode_stream(vp8l.write(p, transforms, **how)), p), kind


def test_payloads_survive():
    rng = np.random.default_rng(2)
    for text in (b"", b"a", "é😀 ".encode() * 300, b"x" * 576, b"word " * 20_000, rng.bytes(300_000), bytes(range(256)) * 9):
        payload = webp.padded(text)
        images = webp.load(webp.store(payload))
        assert b"".join(i.tobytes() for i in images) == payload and len(payload) % 576 == 0 and len(payload) >= 576
    assert len(webp.load(webp.store(webp.padded(b"q" * 600_000)))) == 3


def test_damage_is_noticed():
    stored = bytearray(webp.store(webp.padded(b"hello")))
    stored[20] ^= 1
    with pytest.raises(ValueError):
        webp.load(bytes(stored))


def test_column(spark):
    rows = [(1, "hello"), (2, None), (3, "hello"), (None, ""), (4, "long é" * 30_000)]
    docs = spark.createDataFrame([(*r, "m") for r in rows], "doc_id long, text string, media string")
    got = media.describe(media.encode(docs)).collect()
    assert len(got) == 5
    by = {r.doc_id: r for r in got}
    for i, t in rows:
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or 576 * (not raw))
        r = by[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert by[1][1:] == by[3][1:] and by[2][1:] == by[None][1:]
    assert media.describe(media.encode(docs.limit(0))).count() == 0


def first_transform(stream):
    bits = webp.Bits(stream)
    bits.read(8 + 14 + 14 + 4)
    return bits.read(2) if bits.read(1) else None


def test_the_writer_uses_what_makes_a_file_smaller():
    rng = np.random.default_rng(0)
    row, noise = rng.integers(32, 120, 48, dtype=np.uint8), rng.integers(0, 120, 6000)
    lifted = rng.integers(0, 12, (3000, 4), dtype=np.uint8)
    lifted[:, 0] = lifted[:, 2] = lifted[:, 1] * 3 // 2
    crossed = np.stack([(noise * 16 >> 5) + 3 * (rng.random(6000) < 0.2), noise, (noise * 16 >> 5) + 5, np.full(6000, 65)], 1)
    crossed[::7, 0] = crossed[::7, 1]
    few = rng.integers(0, 256, (60, 4))
    want = {
        webp.PREDICTOR: np.tile(row, 400), webp.CROSS_COLOUR: crossed, webp.PALETTE: few[rng.integers(0, 60, 3000)], None: rng.integers(0, 256, 5760),
    }
    for kind, samples in want.items():
        payload = webp.padded(samples.astype(np.uint8).tobytes())
        stored = webp.store(payload)
        assert {first_transform(s) for s in webp.files(stored)} == {kind} and b"".join(i.tobytes() for i in webp.load(stored)) == payload
        assert kind is None or len(stored) < 0.9 * len(payload)
    steps = np.cumsum(np.concatenate([np.zeros((12, 4), np.uint8), np.repeat(np.where(rng.random((600, 1)) < 0.5, rng.integers(0, 9, (600, 1)), 0), 4, 1).astype(np.uint8)]).reshape(-1, 12, 4), axis=0, dtype=np.uint8)
    stored = webp.store(webp.padded(steps.tobytes()))
    assert webp.load(stored)[0].tobytes() == webp.padded(steps.tobytes())


def test_corpus_files_use_back_references_and_palettes(spark, sf):
    texts = [(r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()] + [b"no no no no " * 300]
    seen = {"tail": 0, "palette": 0}
    for text in texts:
        payload = webp.padded(text)
        stored = webp.store(payload)
        assert b"".join(i.tobytes() for i in webp.load(stored)) == payload
        seen["palette"] += any(first_transform(s) == webp.PALETTE for s in webp.files(stored))
        seen["tail"] += len(payload) - len(text) >= 12
    calls = []
    real = webp.repeated_tail
    webp.repeated_tail = lambda *a: calls.append(real(*a)) or calls[-1]
    try:
        for text in texts:
            webp.load(webp.store(webp.padded(text)))
    finally:
        webp.repeated_tail = real
    assert sum(n > 0 for n in calls) > 0.8 * seen["tail"] and seen["palette"] > 0
