"""Line de-duplication by content-defined chunks of lines.

A rolling hash over the last ROLLED line hashes chooses where a chunk ends, so boundaries depend on a few
lines only and move along when lines are put in before them. Chunks of at least two lines that several documents
have are removed from all but the document with the smallest doc_id, where the first of them stays.

Plan: one row for each document and distinct multi-line chunk goes to an aggregation keyed by the
hash and the chunk's own bytes: grouping compares bytes, and copies are combined map-side, so a chunk that a third of the
corpus has reaches its group as a row for each task. A hash under which two different chunks
turn up isn't used. Narrow (doc_id, hash) rows meet the repeated hashes, and each document is
joined once with the list of its own.

Defined results: a null text has no lines, an empty text one; a row without doc_id neither takes nor loses lines;
rows that share a doc_id take nothing from each other; an empty table gives an empty table; long texts
are handled whole; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstat.llm.common import join_hot, stage, text_or_empty

LEAST_LINES, MOST_LINES = 2, 32
ROLLED = 2
#: One place in so many ends a chunk.
EVERY = 3
MASK = (1 << 64) - 1
RESULT = "doc_id long, n_lines long, n_chunks long, n_removed_lines long, kept_sha256 string, kept string"


def chunks(lines: list[bytes]) -> list[tuple[int, int]]:
    """(first line, end) of each chunk, in order."""
    hashes = [xxhash.xxh64_intdigest(line) for line in lines]
    out, start, rolling = [], 0, 0
    for i, h in enumerate(hashes):
        rolling = (rolling * 0x9E3779B97F4A7C15 + h) & MASK
        if i >= ROLLED:
            rolling = (rolling - hashes[i - ROLLED] * pow(0x9E3779B97F4A7C15, ROLLED, 1 << 64)) & MASK
        size = i + 1 - start
        if size >= MOST_LINES or (size >= LEAST_LINES and ((rolling ^ rolling >> 31) * 0xD6E8FEB86659FD93 & MASK) >> 40 < (1 << 24) // EVERY):
            out.append((start, i + 1))
            start = i + 1
    if start < len(lines):
        out.append((start, len(lines)))
    return out


def lines_of(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode().split(b"\n")


def _hash(chunk: bytes) -> bytes:
    return xxhash.xxh3_128_digest(chunk)


def _rows(with_bytes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                rows = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    lines = lines_of(text)
                    own = {b"\n".join(lines[a:b]) for a, b in chunks(lines) if b - a >= LEAST_LINES}
                    rows += [(doc_id, _hash(c), c) for c in own]
                if rows:
                    doc, h, c = zip(*rows)
                    columns = [pa.array(doc, pa.int64()), pa.array(h, pa.binary())] + ([pa.array(c, pa.binary())] if with_bytes else [])
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "h", "chunk"][: len(columns)])

    return run


def repeated(docs: DataFrame) -> DataFrame:
    """(h, keep, n): chunks, equal byte by byte, of several documents, the smallest doc_id that has them, and how many rows do."""
    chunk_rows = docs.select("doc_id", "text").mapInArrow(_rows(True), "doc_id long, h binary, chunk binary")
    texts = chunk_rows.groupBy("h", "chunk").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("n"))
    return texts.groupBy("h").agg(F.count(F.lit(1)).alias("texts"), F.min("low").alias("keep"), F.max("high").alias("high"), F.sum("n").alias("n")).where("texts = 1 and high > keep").select("h", "keep", "n")


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 1024):
            part = batch.slice(lo, 1024)
            out = []
            for doc_id, text, marks in zip(*(part.column(i).to_pylist() for i in range(3))):
                keeps = {m["h"]: m["keep"] for m in marks or ()}
                lines, kept, seen, n = lines_of(text), [], set(), 0
                for a, b in chunks(lines):
                    n += 1
                    if b - a >= LEAST_LINES and keeps:
                        h = _hash(b"\n".join(lines[a:b]))
                        if h in keeps and (keeps[h] != doc_id or h in seen):
                            continue
                        seen.add(h)
                    kept += lines[a:b]
                rest = b"\n".join(kept)
                out.append((doc_id, len(lines), n, len(lines) - len(kept), hashlib.sha256(rest).hexdigest(), None if text is None else rest.decode()))
            if out:
                kinds = [pa.int64()] * 4 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[f.split()[0] for f in RESULT.split(", ")])


def deduplicate(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_chunks, n_removed_lines, kept_sha256, and kept, the text that is left, of each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = rows.where("doc_id is not null")
    hashes = stage(repeated(known), "chunks")
    places = stage(known.select("doc_id", "text").mapInArrow(_rows(False), "doc_id long, h binary"), "places")
    own = join_hot(places, hashes, "h", places.count()).distinct()
    marks = own.groupBy(F.col("doc_id").alias("d")).agg(F.collect_list(F.struct("h", "keep")).alias("marks"))
    return rows.join(marks, F.col("doc_id") == F.col("d"), "left").select("doc_id", "text", "marks").mapInArrow(_remove, RESULT)


def digest_columns(docs: DataFrame) -> DataFrame:
    return deduplicate(docs).drop("kept")
