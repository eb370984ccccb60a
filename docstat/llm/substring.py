"""Removal of word passages that a document with a smaller doc_id has too, by fixed-block anchors.

A repeat of WINDOW words holds, wherever it starts, a whole block of BLOCK words that begins at a multiple of
BLOCK in the document it repeats (WINDOW = 2 * BLOCK - 1). So the non-overlapping blocks of every document are the
index, and every rolling window of BLOCK words of every document is a probe. Only where a probe hits an indexed block of
another document can a repeat lie; the hits are extended to all windows around them, those are compared by hash, and
overlapping windows add up to maximal repeats.

Documents are dealt into slices by a hash of doc_id and stay there: their compressed texts are shuffled once, and three steps
read that exchange. In between travel only sorted hashes. A slice sends each distinct hash once, in a row for each range of
hashes, so a passage that a third of the corpus shares costs one entry a slice:

1. each slice sends its distinct block hashes, cut to a few bits over what tells random blocks apart and
   coded by their differences; each range answers every slice with a bit for each hash: indexed, and seen in another document too;
2. each slice sends the 128-bit hashes of the windows around its hits with the least doc_id that has
   them; each range answers with the hashes of which another slice has a smaller doc_id;
3. each slice drops the words under those windows, and under windows that a smaller document of the same slice has.

A row names only the documents that its own windows have, and a slice looks only at the ranges its hashes fall in, so what travels grows with
the windows. Cut block hashes only let in candidates by chance; they lose none. Windows count as equal when both of their 64-bit hashes are, which are made
of two different hashes of each word; the words themselves don't travel.

Defined results: a null text has no words; texts under WINDOW words lose none; a row without doc_id neither takes nor loses
words; rows that share a doc_id are versions of one document and take nothing from each other; an empty table gives an empty table;
other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstat.llm.common import text_or_empty

WINDOW = 13
BLOCK = (WINDOW + 1) // 2
#: Bytes of text of a slice, and entries that one range receives, about.
SLICE_BYTES = 4 << 20
RANGE_ENTRIES = 2 << 20
WORD_BYTES = 6
#: Bits of a cut block hash over the logarithm of the number of blocks.
SPARE_BITS = 6

SENT_BLOCKS = "range int, slice long, n int, keys binary, flags binary"
ANSWER_BLOCKS = "slice long, range int, hits binary"
SENT_WINDOWS = "range int, slice long, ids binary, high binary, low binary, least binary"
ANSWER_WINDOWS = "slice long, range int, taken binary, taken_low binary"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_OTHER = np.uint64(0xE7037ED1A0B428DB)
_HIGH, _LOW, _SHORT = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _rolled(words: np.ndarray, size: int, factor: np.uint64) -> np.ndarray:
    """A hash of each run of size words."""
    n = max(0, len(words) - size + 1)
    out = words[:n].copy()
    for j in range(1, size):
        out = out * factor + words[j : j + n]
    return _mixed(out)


class Slice:
    """The documents of a slice, in order of doc_id, as one sequence of word hashes."""

    def __init__(self, ids: list[int], texts: list[bytes]):
        order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
        self.rows = [(ids[i], texts[i]) for i in order]
        self.ids = np.array(sorted(set(ids)), np.int64)
        data = np.frombuffer(b" ".join([*(t for _, t in self.rows), b""]), np.uint8)
        space = _SPACE[data]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]])))
        start, stop = edge[::2], edge[1::2]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * _powers(_BASE, len(data)), dtype=np.uint64)])
        shift = _powers(_INVERSE, len(data) + 1)[start]
        self.words = _mixed((sums[stop] - sums[start]) * shift + (stop - start).astype(np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data ^ 255] * _powers(_BASE, len(data)), dtype=np.uint64)])
        self.others = _mixed((sums[stop] - sums[start]) * shift * _OTHER + (stop - start).astype(np.uint64))
        text_ends = np.cumsum([len(t) + 1 for _, t in self.rows])
        self.first = np.searchsorted(start, np.concatenate([[0], text_ends]))  # first word of each row
        self.row = np.repeat(np.arange(len(self.rows)), np.diff(self.first))  # row of each word
        self.doc = np.searchsorted(self.ids, np.array([i for i, _ in self.rows], np.int64))[self.row]  # its place in ids

    def runs(self, size: int, factor: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the run of size words at each place where one row has that many; the places."""
        hashes = _rolled(self.words, size, factor)
        at = np.flatnonzero(self.row[: len(hashes)] == self.row[size - 1 : size - 1 + len(hashes)])
        return hashes[at], at

    def blocks(self, bits: int):
        """Distinct cut block hashes in order; flags (1: at a block start, 2: in several documents); places and which hash each has."""
        hashes, at = self.runs(BLOCK, _SHORT)
        keys, inverse = np.unique(hashes >> np.uint64(64 - bits), return_inverse=True)
        flags = np.zeros(len(keys), np.uint8)
        flags[inverse[(at - self.first[self.row[at]]) % BLOCK == 0]] = 1
        low, high = np.full(len(keys), 1 << 62), np.full(len(keys), -1)
        np.minimum.at(low, inverse, self.doc[at])
        np.maximum.at(high, inverse, self.doc[at])
        flags[low != high] |= 2
        return keys, flags, at, inverse


def _group(table: pa.Table) -> Slice:
    raw = zstandard.ZstdDecompressor()
    return Slice(table["doc_id"].to_pylist(), [raw.decompress(z) for z in table["z"].to_pylist()])


def _coded(keys: np.ndarray) -> bytes:
    """Ascending integers as differences, byte plane by byte plane, compressed."""
    planes = np.diff(keys, prepend=keys[:1] * 0).astype("<u8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _decoded(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


class Plan:
    """Slices, ranges and hash bits for a corpus of so many bytes."""

    def __init__(self, n_bytes: int):
        words = max(1, n_bytes // WORD_BYTES)
        self.slices = max(1, math.ceil(n_bytes / SLICE_BYTES))
        self.ranges = max(1, math.ceil(words / RANGE_ENTRIES))
        self.bits = min(62, max(24, words.bit_length() + SPARE_BITS))

    def cuts(self, keys: np.ndarray, bits: int) -> dict[int, tuple[int, int]]:
        """Where each range that ascending keys of so many bits fall in starts and ends."""
        top = min(bits, 32)
        found = (keys >> np.uint64(bits - top)) * np.uint64(self.ranges) >> np.uint64(top)
        starts = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))[: len(keys)]
        return dict(zip(found[starts].tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(keys)])))

    def send_blocks(self, key: tuple, table: pa.Table) -> pa.Table:
        keys, flags, _, _ = _group(table).blocks(self.bits)
        cuts = self.cuts(keys, self.bits)
        rows = [(r, key[0].as_py(), b - a, _coded(keys[a:b]), zstandard.compress(flags[a:b].tobytes(), 1)) for r, (a, b) in cuts.items()]
        return _table(rows, SENT_BLOCKS)

    def send_windows(self, key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _table([], SENT_WINDOWS)
        part = _group(left)
        keys, _, at, inverse = part.blocks(self.bits)
        cuts, hit = self.cuts(keys, self.bits), np.zeros(len(keys), bool)
        for r, bits in zip(right["range"].to_pylist(), right["hits"].to_pylist()):
            a, b = cuts[r]
            hit[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a)
        anchored = np.zeros(len(part.words) + 1, np.int64)
        anchored[at[hit[inverse]] + 1] = 1
        anchored = np.cumsum(anchored)
        high, places = part.runs(WINDOW, _HIGH)
        near = anchored[places + WINDOW - BLOCK + 1] > anchored[places]
        high, places = high[near], places[near]
        low = _rolled(part.others, WINDOW, _LOW)[places]
        order = np.lexsort((part.doc[places], low, high))
        high, low, least = high[order], low[order], part.doc[places][order]
        new = np.ones(len(high), bool)
        new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        high, low, least = high[new], low[new], least[new]
        rows = []
        for r, (a, b) in self.cuts(high, 64).items():
            used, place = np.unique(least[a:b], return_inverse=True)
            width = np.uint8 if len(used) < 1 << 8 else np.uint16 if len(used) < 1 << 16 else np.uint32
            rows.append((r, key[0].as_py(), part.ids[used].tobytes(), high[a:b].tobytes(), low[a:b].tobytes(), place.astype(width).tobytes()))
        return _table(rows, SENT_WINDOWS)


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")]
    return pa.table({name: pa.array([row[i] for row in rows], kind) for i, (name, kind) in enumerate(fields)}, schema=pa.schema(fields))


def answer_blocks(key: tuple, table: pa.Table) -> pa.Table:
    sizes = table["n"].to_pylist()
    keys = np.concatenate([_decoded(k, n) for k, n in zip(table["keys"].to_pylist(), sizes)])
    flags = np.concatenate([np.frombuffer(zstandard.decompress(f), np.uint8) for f in table["flags"].to_pylist()])
    _, inverse, seen = np.unique(keys, return_inverse=True, return_counts=True)
    indexed, several = np.zeros(len(seen), bool), seen > 1
    indexed[inverse[flags & 1 > 0]] = True
    several[inverse[flags & 2 > 0]] = True
    hit = (indexed & several)[inverse]
    ends = np.cumsum(sizes)
    rows = [(s, r, np.packbits(hit[e - n : e]).tobytes()) for s, r, n, e in zip(table["slice"].to_pylist(), table["range"].to_pylist(), sizes, ends) if hit[e - n : e].any()]
    return _table(rows, ANSWER_BLOCKS)


def answer_windows(key: tuple, table: pa.Table) -> pa.Table:
    highs = [np.frombuffer(b, "<u8") for b in table["high"].to_pylist()]
    lows = [np.frombuffer(b, "<u8") for b in table["low"].to_pylist()]
    high, low, least = np.concatenate(highs), np.concatenate(lows), []
    for ids, b, h in zip(table["ids"].to_pylist(), table["least"].to_pylist(), highs):
        least.append(np.frombuffer(ids, np.int64)[np.frombuffer(b, {1: np.uint8, 2: np.uint16, 4: np.uint32}[len(b) // len(h)])])
    doc = np.concatenate(least)
    order = np.lexsort((doc, low, high))
    new = np.ones(len(order), bool)
    new[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
    first = doc[order][new][np.cumsum(new) - 1]
    taken = np.zeros(len(order), bool)
    taken[order] = first < doc[order]
    ends = np.cumsum([len(h) for h in highs])
    rows = []
    for s, r, h, other, e in zip(table["slice"].to_pylist(), table["range"].to_pylist(), highs, lows, ends):
        own = taken[e - len(h) : e]
        if own.any():
            rows.append((s, r, h[own].tobytes(), other[own].tobytes()))
    return _table(rows, ANSWER_WINDOWS)


def remove(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    if not left.num_rows:
        return _table([], RESULT)
    part = _group(left)
    high, places = part.runs(WINDOW, _HIGH)
    low = _rolled(part.others, WINDOW, _LOW)[places]
    whole = lambda c: np.concatenate([np.frombuffer(b, "<u8") for b in right[c].to_pylist()] or [np.zeros(0, np.uint64)])
    elsewhere, other = whole("taken"), whole("taken_low")
    sort = np.argsort(elsewhere, kind="stable")
    elsewhere, other = elsewhere[sort], other[sort]
    found = np.minimum(np.searchsorted(elsewhere, high), max(0, len(elsewhere) - 1))
    taken = np.zeros(len(high), bool)
    if len(elsewhere):
        same = np.flatnonzero(elsewhere[found] == high)
        taken[same[other[found[same]] == low[same]]] = True
        shared = np.flatnonzero(elsewhere[1:] == elsewhere[:-1])  # windows that agree in one half only: looked up by both
        if len(shared):
            pairs = set(zip(elsewhere.tolist(), other.tolist()))
            taken[same] = [pair in pairs for pair in zip(high[same].tolist(), low[same].tolist())]
    order = np.lexsort((part.doc[places], low, high))
    new = np.ones(len(order), bool)
    new[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
    doc = part.doc[places][order]
    taken[order] |= doc[new][np.cumsum(new) - 1] < doc
    under = np.zeros(len(part.words) + 1, np.int64)
    np.add.at(under, places[taken], 1)
    np.add.at(under, places[taken] + WINDOW, -1)
    keep = np.cumsum(under)[:-1] == 0
    rows = []
    for i, (doc_id, text) in enumerate(part.rows):
        kept = keep[part.first[i] : part.first[i + 1]]
        words = text.split()
        if not kept.all():
            words = [words[k] for k in np.flatnonzero(kept)]
        rows.append((doc_id, len(kept), int(len(kept) - kept.sum()), hashlib.sha256(b" ".join(words)).hexdigest()))
    return _table(rows, RESULT)


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        for lo in range(0, batch.num_rows, 1024):
            part = batch.slice(lo, 1024)
            z = pa.array([press.compress(t.encode()) for t in part.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), z], names=["slice", "doc_id", "z"])


def _unchanged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(None, len(w := t.encode().split()), 0, hashlib.sha256(b" ".join(w)).hexdigest()) for t in batch.column(0).to_pylist()]
        yield from _table(rows, RESULT).to_batches()


def deduplicate(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    plan = Plan(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(plan.slices / 4))
    range_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(plan.ranges / 2))
    named = rows.where("doc_id is not null").select(F.pmod(F.xxhash64("doc_id"), F.lit(plan.slices)).alias("slice"), "doc_id", "text")
    texts = named.mapInArrow(_compressed, "slice long, doc_id long, z binary").repartition(parts, "slice")
    hits = texts.groupBy("slice").applyInArrow(lambda key, table: plan.send_blocks(key, table), SENT_BLOCKS).repartition(range_parts, "range").groupBy("range").applyInArrow(answer_blocks, ANSWER_BLOCKS)
    windows = texts.groupBy("slice").cogroup(hits.groupBy("slice")).applyInArrow(lambda key, left, right: plan.send_windows(key, left, right), SENT_WINDOWS)
    taken = windows.repartition(range_parts, "range").groupBy("range").applyInArrow(answer_windows, ANSWER_WINDOWS)
    done = texts.groupBy("slice").cogroup(taken.groupBy("slice")).applyInArrow(remove, RESULT)
    return done.unionByName(rows.where("doc_id is null").select("text").mapInArrow(_unchanged, RESULT))


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 12], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
m AS (SELECT h, min(doc_id) AS first FROM p GROUP BY h),
t AS (SELECT doc_id, i FROM p JOIN m USING (h) WHERE first < doc_id),
c AS (SELECT DISTINCT doc_id, i + j AS i FROM t, range(13) AS r(j)),
x AS (SELECT doc_id, ws[i] AS word, i FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
k AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.i) AS kept, count(*) AS n FROM x LEFT JOIN c ON x.doc_id = c.doc_id AND x.i = c.i WHERE c.i IS NULL GROUP BY x.doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""
