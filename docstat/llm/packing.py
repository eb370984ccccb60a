"""Harmonic packing of token sequences.

A document's tokens are cut into whole sequences of CAPACITY tokens and a rest. The rest is
cut into pieces that fill their class well. Class j holds lengths over CAPACITY / (j + 1) and up to
CAPACITY / j, and a bin of class j takes exactly j pieces, whatever they are, so each task
fills its own bins and needs to know of no other. What a task has over at its end, fewer than j pieces
a class, is written as open pieces. These are few and bounded by the number of tasks, not
documents: WORKERS_A_GROUP tasks together fill further bins class by class, and what is then left of a group,
fewer than the sum of j over the classes, goes first-fit into mixed bins.

Defined results: a null or empty text has only the closing id; a document of any length is one
row per piece; a null doc_id stays null; repeated rows are packed as rows of their own; an empty table gives
an empty table; other columns are not read.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docstat.llm.common import Remembered, stage, text_or_empty

CAPACITY = 2048
END_ID = 1
#: A piece that fills this share of its class's bins is cut no further.
WELL_FILLED = 0.97
#: No cut makes a piece shorter than this.
SHORTEST_CUT = 32
#: Words whose ids a Python worker remembers.
REMEMBERED = 1_000_000
#: A special token of the tokenizer; no other text gives its id.
SEPARATOR, SEPARATOR_ID = "<|endoftext|>", 49407
#: Tasks that share the bins of their open pieces.
WORKERS_A_GROUP = 256
ROWS_A_BATCH = 20_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, worker long, class long"

_state: dict = {}


def tokens(tokenizer_path: str, texts: list[str]) -> list[bytes]:
    """The ids of each text as little-endian unsigned 32-bit integers.

    No token of this tokenizer spans white space, so each distinct word is encoded
    once and the texts are put together from the words' ids.
    """
    if _state.get("path") != tokenizer_path:
        from tokenizers import Tokenizer

        _state.update(path=tokenizer_path, tokenizer=Tokenizer.from_file(tokenizer_path), words=Remembered(REMEMBERED))
    words: Remembered = _state["words"]
    split = [text.encode().split() for text in texts]
    fresh = words.lacks(set().union(*split))
    words.update(zip(fresh, encode_words(_state["tokenizer"], [w.decode() for w in fresh])))
    return [b"".join(map(words.__getitem__, s)) for s in split]


def encode_words(tokenizer, words: list[str]) -> list[bytes]:
    """Ids of each word. One call takes all words, kept apart by a special token; words that hold one go alone."""
    apart = [w for w in words if SEPARATOR[:2] in w]
    plain = [w for w in words if SEPARATOR[:2] not in w]
    ids = array("I", tokenizer.encode_batch_fast([SEPARATOR.join(plain)], add_special_tokens=False)[0].ids) if plain else array("I")
    stops = [i for i, x in enumerate(ids) if x == SEPARATOR_ID] + [len(ids)]
    found = dict(zip(plain, (ids[a:b].tobytes() for a, b in zip([0] + [i + 1 for i in stops], stops))))
    found.update((w, array("I", e.ids).tobytes()) for w, e in zip(apart, tokenizer.encode_batch_fast(apart, add_special_tokens=False)))
    return [found[w] for w in words]


def cuts(rest: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces that a rest of fewer than capacity tokens is cut into."""
    out = []
    while rest:
        j = capacity // rest
        size = capacity // (j + 1)
        while rest - size < SHORTEST_CUT and size > SHORTEST_CUT:
            j += 1
            size = capacity // (j + 1)
        if rest * (capacity // rest) >= WELL_FILLED * capacity or rest < 2 * SHORTEST_CUT or size <= SHORTEST_CUT:
            out.append(rest)
            break
        out.append(size)
        rest -= size
    return out


def _pack_partition(tokenizer_path: str, capacity: int):
    end = END_ID.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker, made, rows = TaskContext.get().partitionId(), 0, []
        open_bins: dict[int, list[list]] = {}

        def flush() -> pa.RecordBatch:
            names = [c.split()[0] for c in PIECES.split(", ")]
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)
            rows.clear()
            return batch

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                for doc_id, ids in zip(part.column(0).to_pylist(), tokens(tokenizer_path, part.column(1).to_pylist())):
                    ids += end
                    n = len(ids) // 4
                    whole, rest = divmod(n, capacity)
                    at = 0
                    for length in [capacity] * whole + cuts(rest, capacity):
                        crc = zlib.crc32(memoryview(ids)[4 * at : 4 * (at + length)])
                        j = capacity // length
                        bin_ = open_bins.setdefault(j, [])
                        bin_.append([doc_id, at, length, crc, n, None, None, worker, j])
                        at += length
                        if len(bin_) == j:
                            offset = 0
                            for piece in bin_:
                                piece[5], piece[6] = (worker << 31) + made, offset
                                offset += piece[2]
                            rows += bin_
                            made += 1
                            open_bins[j] = []
                    if len(rows) >= ROWS_A_BATCH:
                        yield flush()
        rows += [piece for bin_ in open_bins.values() for piece in bin_]
        if rows:
            yield flush()

    return run


def _first_fit(capacity: int):
    def run(key, pieces):
        order = pieces.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable")
        room: list[int] = []
        bins, offsets = [], []
        for length in order["length"]:
            b = next((i for i, r in enumerate(room) if r >= length), len(room))
            if b == len(room):
                room.append(capacity)
            bins.append(b)
            offsets.append(capacity - room[b])
            room[b] -= length
        order["sequence_id"] = [(1 << 62) + (int(key[0]) << 32) + b for b in bins]
        order["offset"] = offsets
        return order

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    pieces = stage(source.mapInArrow(_pack_partition(tokenizer_path, capacity), PIECES), "pieces")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    group = (F.col("worker") / WORKERS_A_GROUP).cast("long").alias("group")
    open_pieces = pieces.where("sequence_id is null").withColumn("group", group)
    of_class = Window.partitionBy("group", "class")
    place = F.row_number().over(of_class.orderBy(F.col("length").desc(), "doc_id", "start", "worker")) - 1
    numbered = open_pieces.withColumns({"place": place, "n": F.count(F.lit(1)).over(of_class)})
    numbered = numbered.withColumn("bin", F.expr("place div class"))
    full = F.col("bin") < F.expr("n div class")
    before = Window.partitionBy("group", "class", "bin").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    numbered = numbered.withColumns(
        {
            "sequence_id": F.when(full, F.lit(1 << 61) + F.col("group") * (1 << 34) + F.col("class") * (1 << 22) + F.col("bin")),
            "offset": F.when(full, F.coalesce(F.sum("length").over(before), F.lit(0))),
        }
    )
    mixed = stage(numbered.select(*columns, "group"), "open-pieces")
    last = mixed.where("sequence_id is null").groupBy("group").applyInPandas(_first_fit(capacity), mixed.schema)
    return pieces.where("sequence_id is not null").select(*columns).unionByName(mixed.where("sequence_id is not null").select(*columns)).unionByName(last.select(*columns))
