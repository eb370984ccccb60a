"""Ranked lexical search over bit-sliced Bloom signatures.

`index` reads the documents once. Documents of like size are taken together in blocks; each has a Bloom signature of its (term, level) pairs, level j standing for LEVELS[j] occurrences or more, and a block's signatures
are stored as slices: one bitmap over its documents for each bit. The index also has the number of documents of each term.

`search` ranks the documents for some items. For a term, the AND of its slices is a bitmap that overestimates the documents that have it, and hence, by level, its
occurrences in them; summed with the terms' weights these give an upper bound of each document's score. The documents with the highest bounds, TRIED times TOP an item, are scored exactly; the TOP-th of their scores
is the item's bar. Then every document whose bound reaches the bar of an item is scored exactly from its text, whatever their number. A document that is left out has a bound, and so a score, below that
of TOP others, so results are exact.

Work is in proportion to the index; only weights and bars of a block of items are broadcast (at most about ITEM_TERMS terms at a time; more items come in several blocks), and the keys
of documents to score only up to FEW of them, beyond which they meet the documents by a shuffle.

Defined results: null and empty texts have no terms, are not counted and never found; items without terms have no rows; rows of one item_id are one item with the terms of all, a null
item_id being an item too; repeated rows of documents are ranked one by one; of equal scores a null doc_id comes last; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docstat.llm.common import Remembered, drop_staged, stage
from docstat.llm.terms import SQL_TERMS, terms_of

TOP = 50
#: Occurrences at which a term has one more pair in the signature.
LEVELS = (1, 2, 3, 4, 5, 6, 8, 10, 13, 18, 27, 50)
#: Slices that a pair sets, and slices for each pair that the largest document of a block may have.
PROBES, SLICES_A_PAIR = 10, 30
#: Blocks hold documents of up to FIRST, FIRST * RATIO, ... pairs, and up to CELLS bits. A longer document shares MOST_SLICES, which only loosens its bound.
FIRST, RATIO, CELLS, MOST_SLICES = 16, 1.5, 1 << 25, 1 << 22
DOCUMENTS = 4096
#: Terms that a task counts before it passes them on, and terms of the items searched at a time.
TERMS_HELD, ITEM_TERMS = 1 << 17, 1 << 15
#: Cells of the term by document matrix at a time.
MATRIX = 1 << 22
FEW = 300_000
SPREAD = 64
#: Documents scored for an item's bar, for each that is wanted.
TRIED = 3

INDEX = "term binary, df long, docs array<long>, keys array<long>, lengths array<long>, width int, slices binary"
_KINDS = (pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.binary())
_NAMES = [field.split()[0] for field in INDEX.split(", ")]


def row_key(docs: DataFrame) -> Column:
    """Names a document's text: copies are scored by one name. Other texts may share it, which costs time only."""
    return F.xxhash64(docs["text"])


def places(hashes: np.ndarray, level: int, width: int) -> Iterator[np.ndarray]:
    """The slices of each term hash at a level, one array for each of PROBES, in signatures of width slices."""
    mixed = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15 + 2 * level)
    step = (mixed >> np.uint64(32)) | np.uint64(1)
    at = mixed ^ (mixed >> np.uint64(29))
    for _ in range(PROBES):
        yield (at % np.uint64(width)).astype(np.int64)
        at = at + step


def term_hash(term: bytes) -> int:
    return xxhash.xxh64_intdigest(term)


class Block:
    """Documents of like size, until they are written as slices."""

    def __init__(self, width: int):
        self.width, self.docs, self.keys, self.lengths, self.hashes, self.counts = width, [], [], [], [], []
        self.room = max(8, min(DOCUMENTS, CELLS // width // 8 * 8))

    def add(self, doc: int | None, key: int, length: int, hashes: np.ndarray, counts: np.ndarray) -> None:
        self.docs.append(doc)
        self.keys.append(key)
        self.lengths.append(length)
        self.hashes.append(hashes)
        self.counts.append(counts)

    def batch(self) -> pa.RecordBatch:
        bits = np.zeros((self.width, -(-len(self.docs) // 8) * 8), np.uint8)
        own, hashes, counts = np.repeat(np.arange(len(self.docs)), [len(h) for h in self.hashes]), np.concatenate(self.hashes), np.concatenate(self.counts)
        for level, least in enumerate(LEVELS):
            some = counts >= least
            own, hashes, counts = own[some], hashes[some], counts[some]
            for at in places(hashes, level, self.width) if len(own) else ():
                bits[at, own] = 1
        values = (None, None, self.docs, self.keys, self.lengths, self.width, np.packbits(bits, axis=1).tobytes())
        return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(values, _KINDS)], names=_NAMES)


def width_for(pairs: int) -> int:
    steps = max(0, math.ceil(math.log(max(pairs, 1) / FIRST, RATIO)))
    return min(int(FIRST * RATIO**steps) * SLICES_A_PAIR, MOST_SLICES)


def _counted(counts: Counter) -> pa.RecordBatch:
    n = len(counts)
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64()), *(pa.nulls(n, kind) for kind in _KINDS[2:])], names=_NAMES)


def index(docs: DataFrame) -> DataFrame:
    """The blocks of documents and the counts of terms, in one written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, blocks, known = Counter(), {}, Remembered(1 << 18)
        levels = np.array(LEVELS)
        for batch in batches:
            for doc, key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                terms = terms_of(raw.as_py())
                if not terms:
                    continue
                counts = Counter(terms)
                frequent.update(counts.keys())
                if len(frequent) > TERMS_HELD:
                    yield _counted(frequent)
                    frequent = Counter()
                for term in known.lacks(counts):
                    known[term] = term_hash(term)
                hashes = np.fromiter(map(known.__getitem__, counts), np.uint64, len(counts))
                often = np.fromiter(counts.values(), np.int64, len(counts))
                width = width_for(int(np.searchsorted(levels, often, "right").sum()))
                block = blocks.setdefault(width, Block(width))
                block.add(doc, key, len(terms), hashes, often)
                if len(block.docs) == block.room:
                    yield blocks.pop(width).batch()
        for block in blocks.values():
            yield block.batch()
        if frequent:
            yield _counted(frequent)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(docs).alias("key"), F.col("text").cast("binary").alias("text"))
    return stage(rows.mapInArrow(run, INDEX), "index")


def share(tf, m):
    """What a term of weight 1 adds to a score, at most; whole where tf and m are Python's integers."""
    return 1_000_000_000 * tf // (1000 * tf + 20 * m) if isinstance(tf, int) else 1e9 * tf / (1000 * tf + 20 * m)


def damping(length: int, n_docs: int, n_terms: int) -> int:
    return 50 + 50 * length * n_docs // n_terms


class Items:
    """The items of one block, with the weights of their terms, and the totals of the collection."""

    def __init__(self, names: list[int | None], terms: list[set[bytes]], df: dict[bytes, int], n_docs: int, n_terms: int):
        self.names, self.n_docs, self.n_terms = names, n_docs, n_terms
        wanted = set().union(*terms)
        vocabulary = sorted(t for t in df if t in wanted)
        number = {t: i for i, t in enumerate(vocabulary)}
        self.weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in vocabulary}
        self.terms = [sorted(t for t in own if t in number and self.weight[t]) for own in terms]
        self.hashes = np.array([term_hash(t) for t in vocabulary], np.uint64)
        self.rows = [np.array([number[t] for t in own], np.int64) for own in self.terms]
        self.weights = [np.array([self.weight[t] for t in own], float) for own in self.terms]
        self.bars = [1.0] * len(names)

    def bounds(self, lengths: np.ndarray, width: int, slices: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(first document, upper bounds of each item and document), some documents at a time. slices: (width, bytes)."""
        m = np.array([damping(n, self.n_docs, self.n_terms) for n in lengths.tolist()], float)
        at_once = max(8, MATRIX // max(len(self.hashes), 1) // 8 * 8)
        for lo in range(0, len(lengths), at_once):
            own, damp = lengths[lo : lo + at_once].astype(float), m[lo : lo + at_once]
            out, held, before = np.zeros((len(self.rows), len(own))), None, 0.0
            for level, least in enumerate(LEVELS):
                mine = slices[:, lo // 8 : (lo + at_once) // 8]
                for at in places(self.hashes, level, width):
                    held = mine[at] if held is None else held & mine[at]
                some = held.any(axis=1)
                if not some.any():
                    break
                most = np.minimum(own, LEVELS[level + 1] - 1) if level + 1 < len(LEVELS) else own
                value = share(np.maximum(most, least - 1), damp)
                table = np.unpackbits(held, axis=1)[:, : len(own)].astype(float)
                for i, (rows, weights) in enumerate(zip(self.rows, self.weights)):
                    use = some[rows]
                    if use.any():
                        out[i] += (weights[use] @ table[rows[use]]) * (value - before)
                before = value
            yield lo, out * (1 + 1e-9) + (out > 0)


def _over_blocks(blocks: DataFrame, held, best: int | None) -> DataFrame:
    """(item, bound, key) of the documents whose bounds reach their item's bar; best: only so many, the highest ones, of each task and item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = held.value
        bars = np.array(items.bars)
        found = [[] for _ in bars]

        def rows(parts: list) -> pa.RecordBatch:
            columns = [np.concatenate([p[j] for p in parts]) if parts else [] for j in range(3)]
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int32(), pa.float64(), pa.int64()))], names=["item", "bound", "key"])

        def trim(i: int) -> None:
            bound, key = (np.concatenate([p[j] for p in found[i]]) for j in (1, 2))
            top = np.lexsort((key, -bound))[:best]
            found[i] = [(np.full(len(top), i), bound[top], key[top])]
            if len(top) == best:
                bars[i] = bound[top[-1]]

        for batch in batches:
            for r in range(batch.num_rows):
                keys, lengths, width = (np.array(batch.column(c)[r].as_py()) for c in (0, 1, 2))
                slices = np.frombuffer(batch.column(3)[r].as_py(), np.uint8).reshape(int(width), -1)
                for lo, bounds in items.bounds(lengths, int(width), slices):
                    item, doc = np.nonzero(bounds >= bars[:, None])
                    edges = np.searchsorted(item, np.arange(len(bars) + 1))
                    for i in np.unique(item).tolist():
                        own = doc[edges[i] : edges[i + 1]]
                        found[i].append((np.full(len(own), i), bounds[i, own], keys[lo + own]))
                        if best and sum(len(p[0]) for p in found[i]) > 4 * best:
                            trim(i)
                    if not best:
                        yield rows([p for own in found for p in own])
                        found = [[] for _ in bars]
        if best:
            for i in range(len(bars)):
                if found[i]:
                    trim(i)
            yield rows([p for own in found for p in own])

    return blocks.select("keys", "lengths", "width", "slices").mapInArrow(run, "item int, bound double, key long")


def highest(rows: DataFrame, order: list[Column], top: int, spread: str) -> DataFrame:
    """The top rows of each item, with rank; in two steps, so that no task has all rows of an item."""
    salt = Window.partitionBy("item", F.pmod(F.xxhash64(spread), F.lit(SPREAD))).orderBy(*order)
    some = rows.withColumn("rank", F.row_number().over(salt)).where(F.col("rank") <= top).drop("rank")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)


def _scored(docs: DataFrame, wanted: DataFrame, held) -> DataFrame:
    """(item, doc_id, score) of each document and item of wanted (item, key), from the whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = held.value
        for batch in batches:
            out = []
            for doc, raw, mine in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                terms = terms_of(raw)
                counts, m = Counter(terms), damping(len(terms), items.n_docs, items.n_terms)
                for i in mine:
                    score = sum(items.weight[t] * share(counts[t], m) for t in items.terms[i] if t in counts)
                    if score > 0:
                        out.append((i, doc, score))
            columns = list(zip(*out)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int32(), pa.int64(), pa.int64()))], names=["item", "doc_id", "score"])

    each = stage(wanted.groupBy("key").agg(F.collect_set("item").alias("items")), "to-score")
    each = F.broadcast(each) if each.limit(FEW + 1).count() <= FEW else each.hint("merge")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), row_key(docs).alias("key"))
    return rows.join(each, "key").select("doc_id", "text", "items").mapInArrow(run, "item int, doc_id long, score long")


def _search(docs: DataFrame, made: DataFrame, totals, items: list, top: int) -> DataFrame:
    spark, names = docs.sparkSession, [name for name, _ in items]
    terms = [{t for text in texts for t in terms_of(text.encode())} for _, texts in items]
    wanted = spark.createDataFrame([(t,) for t in sorted(set().union(*terms))], "term binary")
    counts = made.where("term is not null").join(F.broadcast(wanted), "term").groupBy("term").agg(F.sum("df"))
    context, block = spark.sparkContext, Items(names, terms, {bytes(t): n for t, n in counts.collect()}, *totals)
    blocks = made.where("slices is not null")
    held = context.broadcast(block)
    probes = highest(_over_blocks(blocks, held, TRIED * top), [F.col("bound").desc(), F.col("key")], TRIED * top, "key")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    bars = highest(_scored(docs, probes, held), order, top, "doc_id").groupBy("item").agg(F.min("score").alias("bar"), F.count(F.lit(1)).alias("n"))
    for row in bars.where(F.col("n") == top).collect():
        block.bars[row["item"]] = float(row["bar"])
    held.destroy()
    held = context.broadcast(block)
    scores = highest(_scored(docs, _over_blocks(blocks, held, None), held), order, top, "doc_id")
    number = spark.createDataFrame(list(enumerate(names)), "item int, item_id long")
    found = stage(scores.join(F.broadcast(number), "item").select("item_id", F.col("rank").cast("int").alias("rank"), F.col("doc_id").alias("doc_id"), "score"), "ranked")
    held.destroy()
    return found


def search(docs: DataFrame, items: DataFrame, top: int = TOP, made: DataFrame | None = None) -> DataFrame:
    """item_id, rank, doc_id, score: the top documents of each item of items (item_id, text). made: the documents' index, if there is one."""
    spark, own = docs.sparkSession, made is None
    made = index(docs) if own else made
    lengths = made.where("slices is not null").select(F.explode("lengths").alias("n")).agg(F.count(F.lit(1)), F.sum("n")).first()
    rows = items.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = rows.agg(F.sum(F.floor(F.length("text") / 2) + 1)).first()[0] or 0
    parts, found = -(-size // ITEM_TERMS), []
    for i in range(parts if lengths[0] else 0):
        mine = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == i).groupBy("item_id").agg(F.collect_list("text").alias("texts")).collect()
        if mine:
            found.append(_search(docs, made, lengths, [(r["item_id"], r["texts"]) for r in mine], top))
    if own:
        drop_staged(made)
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for part in found:
        out = out.unionByName(part)
    return out


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {SQL_TERMS.format("text")} AS w FROM documents WHERE text IS NOT NULL),
full_docs AS (SELECT r, doc_id, len(w)::BIGINT AS n, w FROM d WHERE len(w) > 0),
totals AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM full_docs),
q AS (SELECT DISTINCT item_id, unnest({SQL_TERMS.format("text")}) AS term FROM benchmark WHERE text IS NOT NULL),
tf AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS term FROM full_docs) GROUP BY r, term),
df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, totals),
s AS (SELECT q.item_id, f.doc_id, f.r, sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 20 * (50 + (50 * f.n * n_docs) // n_terms))))::BIGINT AS score
      FROM q JOIN w USING (term) JOIN tf USING (term) JOIN full_docs f ON f.r = tf.r, totals GROUP BY q.item_id, f.doc_id, f.r),
p AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM p WHERE rank <= {TOP}
"""
