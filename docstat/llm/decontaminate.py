"""Benchmark decontamination: windows of test items, broadcast as a hash set, against the word windows of every document.

An item's windows are its WINDOW consecutive words; an item of fewer is one window. Item words become numbers, a document's words are looked up among them,
and only windows all of whose words are known are hashed and looked for in the set. A hit is verified by its words: their numbers must be those of an item's window,
and equal numbers are equal words.

One broadcast holds at most about BLOCK_WORDS words of items (long items come as overlapping segments). A larger benchmark comes in blocks: the documents
pass once for each, and lie in the shared folder in between, so nothing has to fit but one block. With one block there is no shuffle and nothing is written.

Defined results: null and empty texts have no words, items without words no windows; repeated rows, of documents or of items, each give
the same result again and an item counts once; items with a null id count as one item with an empty name; rows with a null doc_id are judged like all others;
empty tables give no rows or no hits; further columns of documents are kept by `decontaminate`, whatever their names.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docstat.llm.common import delete, free_name, recorded, stage
from docstat.llm.terms import SQL_TERMS, terms_of

WINDOW = 10
#: A block's tables take about 300 bytes a word in each Python worker.
BLOCK_WORDS = 250_000
#: Windows that start in one segment of a long item.
SEGMENT = 4096
#: Windows of a document looked at together.
AT_ONCE = 1 << 15
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")

FOUND = "n_words long, items array<string>, spans array<struct<start:long,end:long>>"
_MARK = (pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))


class Windows:
    """The windows of some items, by the numbers of their words."""

    def __init__(self, items: list[tuple[str, bytes]]):
        self.numbers: dict[bytes, int] = {}
        owners = defaultdict(set)
        for name, text in items:
            own = np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in terms_of(text)], np.int64)
            size = min(WINDOW, len(own))
            for i in range(len(own) - size + 1 if size else 0):
                owners[own[i : i + size].tobytes()].add(name)
        self.owners = {w: tuple(sorted(names)) for w, names in owners.items()}
        self.powers = np.cumprod(np.full(WINDOW, 0x9E3779B97F4A7C15, np.uint64))
        by_size = defaultdict(list)
        for w in self.owners:
            by_size[len(w) // 8].append(w)
        self.hashes = {size: np.unique(self.hashed(np.frombuffer(b"".join(ws), np.int64).reshape(-1, size))) for size, ws in by_size.items()}

    def hashed(self, windows: np.ndarray) -> np.ndarray:
        out = (windows.astype(np.uint64) * self.powers[: windows.shape[1]]).sum(axis=1, dtype=np.uint64)
        return out ^ (out >> np.uint64(32))

    def find(self, words: list[bytes]) -> tuple[np.ndarray | None, set[str]]:
        """Which words are hit, if any, and the names of the items whose windows occur."""
        count = len(words)
        numbers = np.fromiter(map(self.numbers.get, words, repeat(0)), np.int64, count)
        known = np.concatenate([[0], np.cumsum(numbers > 0)])
        edges, names = None, set()
        for size, hashes in self.hashes.items():
            places = np.flatnonzero(known[size:] - known[:-size] == size)
            for lo in range(0, len(places), AT_ONCE):
                starts = places[lo : lo + AT_ONCE]
                windows = numbers[starts[:, None] + np.arange(size)]
                own = self.hashed(windows)
                maybe = np.flatnonzero(hashes[np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)] == own)
                for i in maybe.tolist():
                    owners = self.owners.get(windows[i].tobytes())
                    if owners:
                        edges = np.zeros(count + 1, np.int64) if edges is None else edges
                        edges[starts[i]] += 1
                        edges[starts[i] + size] -= 1
                        names.update(owners)
        return None if edges is None else np.cumsum(edges[:-1]) > 0, names


def runs(hit: np.ndarray) -> list[tuple[int, int]]:
    """(start, exclusive end) of each run of hit words."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """text less the bytes from the first to the last word of each span of words."""
    places, out, at = [m.span() for m in TERM.finditer(text)], [], 0
    for start, end in spans:
        out.append(text[at : places[start][0]])
        at = places[end - 1][1]
    return b"".join([*out, text[at:]])


def segments(benchmark: DataFrame) -> DataFrame:
    """(name, text, n) of each item's words, long items as segments that overlap by a window less one word."""
    words = F.split(F.trim(F.regexp_replace(F.col("text"), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " ")), " ")
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - WINDOW + 1, F.lit(1)), F.lit(SEGMENT))
    cut = benchmark.where("text is not null").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), words.alias("words"))
    each = cut.select("name", F.explode(F.transform(starts, lambda i: F.slice("words", i, SEGMENT + WINDOW - 1))).alias("words"))
    return each.select("name", F.array_join("words", " ").alias("text"), F.size("words").alias("n")).where("text <> ''").distinct()


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[str, bytes]]]:
    """The items' segments, about BLOCK_WORDS words at a time."""
    cut = segments(benchmark)
    total = cut.agg(F.sum("n")).first()[0] or 0
    count = -(-total // BLOCK_WORDS)
    for i in range(count):
        own = cut.where(F.pmod(F.xxhash64("name", "text"), F.lit(count)) == i)
        yield [(name, text.encode()) for name, text in own.select("name", "text").collect()]


def _scan(docs: DataFrame, held, text: int, found: int) -> DataFrame:
    """docs with the last three columns, from `found` on, extended by what one block of items hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = held.value
        for batch in batches:
            counts, items, spans = [], [], []
            texts = batch.column(text).cast(pa.binary())
            for raw, names, old in zip(texts.to_pylist(), batch.column(found + 1).to_pylist(), batch.column(found + 2).to_pylist()):
                words = terms_of(raw)
                hit, more = windows.find(words)
                if hit is not None:
                    for span in old:
                        hit[span["start"] : span["end"]] = True
                    names, old = sorted(more.union(names)), [{"start": a, "end": b} for a, b in runs(hit)]
                counts.append(len(words))
                items.append(names)
                spans.append(old)
            made = [pa.array(x, kind) for x, kind in zip((counts, items, spans), _MARK)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:found], *made], names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def mark(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with three more columns, and their names: number of words, names of the items that occur, spans of hit words (start, exclusive end)."""
    spark, text, found = docs.sparkSession, docs.columns.index("text"), len(docs.columns)
    names: list[str] = []
    for field in StructType.fromDDL(FOUND):
        names.append(free_name(docs, field.name))
        docs = docs.withColumn(names[-1], (F.lit(0) if field.name == "n_words" else F.array()).cast(field.dataType))
    held, before = None, []
    for items in blocks(benchmark):
        if held is not None:  # a further block: what those before found is written
            with recorded() as made:
                docs = stage(docs, "decontaminated")
            held.destroy()
            for old in before:
                delete(old)
            before = made
        held = spark.sparkContext.broadcast(Windows(items))
        docs = _scan(docs, held, text, found)
    return docs if held else _scan(docs, spark.sparkContext.broadcast(Windows([])), text, found), names


def decontaminate(docs: DataFrame, benchmark: DataFrame, spans: bool = False) -> DataFrame:
    """docs without the documents that hold a window of an item; with `spans`, all documents, each less the text from the first to the last word of every run of hit words."""
    marked, (_, items, hits) = mark(docs, benchmark)
    if not spans:
        return marked.where(F.size(items) == 0).select(*docs.columns)
    text, found = docs.columns.index("text"), marked.columns.index(hits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(text).cast(pa.binary()).to_pylist(), batch.column(found).to_pylist())
            cut = [without(raw, [(s["start"], s["end"]) for s in own]).decode() if own else None if raw is None else raw.decode() for raw, own in rows]
            yield batch.set_column(text, batch.schema.field(text), pa.array(cut, batch.schema.field(text).type)).select(list(range(width)))

    width = len(docs.columns)
    return marked.mapInArrow(run, docs.schema)


def digest_columns(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each document."""
    marked, (words, items, spans) = mark(docs.select("doc_id", "text"), benchmark)
    hit = F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return marked.select(
        "doc_id",
        F.col(words).alias("n_words"),
        hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce({SQL_TERMS.format("text")}, []) AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {SQL_TERMS.format("text")} AS w FROM benchmark WHERE text IS NOT NULL),
own AS (SELECT DISTINCT item, w[i:i + {WINDOW - 1}] AS win
        FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {WINDOW - 2}, 2))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(win) AS size FROM own),
places AS (SELECT doc_id, size, w, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size),
hits AS (SELECT p.doc_id, p.size, p.i, o.item FROM places p JOIN own o ON o.win = p.w[p.i:p.i + p.size - 1]),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
