"""Document quality by a byte-level convolutional network in numpy.

The network sees bytes only. A text's UTF-8 bytes are cut into chunks that overlap and cover the whole
text. Learned filters of WIDTH bytes slide over a chunk; each filter is max-pooled and mean-pooled over it; the pools and the chunk's filled share
go through a hidden layer to the chunk's logit, and the document's probability is
the logistic of the mean of its chunks' logits. Only filters and layers are learnt, by gradient descent on the
driver, from a bounded sample of labelled rows; scoring is spread over the corpus without a
shuffle and gives equal texts equal scores.

A filter's response is a sum of table entries, one for each byte of its window, so scoring adds rows of
tables of byte pairs and never builds the embedded text.

Defined results: a null or empty text is one chunk of padding and gets a score too; with no usable
label every score is 0.5; a doc_id that is null is not held out; repeated rows get equal scores; an
empty table gives an empty table; labels, lang, source and doc_id are never inputs of a score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docstat.llm.common import text_or_empty

#: Rows of each label that training may use, and chunks of one of their texts, drawn over its whole length: at most 2 * 1500 * 6 chunks of 512 bytes.
SAMPLE_A_LABEL = 1500
CHUNKS_A_TEXT = 6
CHUNK, OVERLAP = 512, 64
WIDTH, STRIDE = 8, 2
FILTERS, EMBEDDING, HIDDEN = 24, 8, 16
PASSES, RATE, BATCH, SEED = 12, 0.004, 64, 7
#: Share of training chunks that are cut short, so that short texts are learnt too.
SHORTENED = 0.35
THRESHOLD = 0.3
PAD = 0
HELD_OUT_OF = 5


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % HELD_OUT_OF == 0, F.lit(False))


def chunks(text: bytes) -> np.ndarray:
    """Overlapping chunks that cover the text; the last one is padded."""
    step = CHUNK - OVERLAP
    n = max(1, -(-(len(text) - OVERLAP) // step))
    data = np.full((n - 1) * step + CHUNK, PAD, np.uint8)
    data[: len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(data, CHUNK)[::step]


def windows_of(n_bytes: np.ndarray) -> np.ndarray:
    """Windows of a chunk that hold text: all, or those up to its last byte."""
    return np.clip((n_bytes - WIDTH) // STRIDE + 1, 1, (CHUNK - WIDTH) // STRIDE + 1)


class Network:
    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.p = {
            "embed": rng.normal(0, 0.5, (256, EMBEDDING)),
            "filters": rng.normal(0, (WIDTH * EMBEDDING) ** -0.5, (WIDTH * EMBEDDING, FILTERS)),
            "bias": np.zeros(FILTERS),
            "hidden": rng.normal(0, (2 * FILTERS) ** -0.5, (2 * FILTERS + 1, HIDDEN)),
            "hidden_bias": np.zeros(HIDDEN),
            "out": rng.normal(0, HIDDEN**-0.5, HIDDEN),
            "out_bias": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def train(self, drawn: list[np.ndarray], labels: list[int]) -> None:
        """drawn: chunks of each text."""
        rng, p = np.random.default_rng(SEED), self.p
        x = np.concatenate(drawn)
        y = np.repeat(np.array(labels, np.float32), [len(c) for c in drawn])
        weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
        used = np.maximum(WIDTH, CHUNK - (x[:, ::-1] != PAD).argmax(1))
        short = np.maximum(WIDTH, (used * rng.random(len(x)) ** 2).astype(int))  # a part of a text has the text's label
        shorten = rng.random(len(x)) < SHORTENED
        used = np.where(shorten, short, used)
        x = np.where(np.arange(CHUNK) < used[:, None], x, PAD).astype(np.uint8)
        first = {k: np.zeros_like(v) for k, v in p.items()}
        second = {k: np.zeros_like(v) for k, v in p.items()}
        at = np.arange(0, CHUNK - WIDTH + 1, STRIDE)
        step = 0
        for _ in range(PASSES):
            order = rng.permutation(len(x))
            for lo in range(0, len(x), BATCH):
                pick = order[lo : lo + BATCH]
                b = x[pick]
                live = (np.arange(len(at)) < windows_of(used[pick])[:, None])[:, :, None]
                windows = b[:, at[:, None] + np.arange(WIDTH)]
                patch = p["embed"][windows].reshape(len(b), len(at), -1)
                response = np.tanh(patch @ p["filters"] + p["bias"])
                top = np.where(live, response, -2).argmax(1)
                peak = np.take_along_axis(response, top[:, None], 1)[:, 0]
                share = live / live.sum(1, keepdims=True)
                pools = np.concatenate([peak, (response * share).sum(1), used[pick, None] / CHUNK], 1).astype(np.float32)
                inner = np.tanh(pools @ p["hidden"] + p["hidden_bias"])
                logit = inner @ p["out"] + p["out_bias"]
                d_logit = ((1 / (1 + np.exp(-logit)) - y[pick]) * weight[pick] / len(b)).astype(np.float32)
                g = {"out": inner.T @ d_logit, "out_bias": d_logit.sum(keepdims=True)}
                d_inner = d_logit[:, None] * p["out"] * (1 - inner**2)
                g |= {"hidden": pools.T @ d_inner, "hidden_bias": d_inner.sum(0)}
                d_pools = d_inner @ p["hidden"].T
                d_response = (d_pools[:, None, FILTERS:-1] * share).astype(np.float32)
                np.put_along_axis(d_response, top[:, None], np.take_along_axis(d_response, top[:, None], 1) + d_pools[:, None, :FILTERS], 1)
                d_response *= 1 - response**2
                flat = d_response.reshape(-1, FILTERS)
                g |= {"filters": patch.reshape(-1, WIDTH * EMBEDDING).T @ flat, "bias": flat.sum(0)}
                d_patch = (flat @ p["filters"].T).reshape(-1, EMBEDDING)
                cells = windows.ravel()
                g["embed"] = np.stack([np.bincount(cells, d_patch[:, k], 256) for k in range(EMBEDDING)], 1).astype(np.float32)
                step += 1
                for k in p:
                    first[k] = 0.9 * first[k] + 0.1 * g[k]
                    second[k] = 0.999 * second[k] + 0.001 * g[k] ** 2
                    p[k] -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)

    def tables(self) -> np.ndarray:
        """(WIDTH / 2, 65536, FILTERS): what the byte pair at each place of a window adds to the filters."""
        one = np.einsum("be,wef->wbf", self.p["embed"], self.p["filters"].reshape(WIDTH, EMBEDDING, FILTERS))
        return np.stack([(one[w][None, :, :] + one[w + 1][:, None, :]).reshape(65536, FILTERS) for w in range(0, WIDTH, 2)]).astype(np.float32)

    def logits(self, x: np.ndarray, used: np.ndarray, tables: np.ndarray) -> np.ndarray:
        p = self.p
        pairs = np.ascontiguousarray(x).view("<u2")
        n = (CHUNK - WIDTH) // STRIDE + 1
        response = tables[0][pairs[:, :n]]
        for k in range(1, WIDTH // 2):
            response += tables[k][pairs[:, k : k + n]]
        response += p["bias"]
        count = windows_of(used)
        peak, mean = np.empty((len(x), FILTERS), np.float32), np.empty((len(x), FILTERS), np.float32)
        np.tanh(response, out=response)
        whole = count == n
        peak[whole], mean[whole] = response[whole].max(1), response[whole].mean(1)
        for i in np.flatnonzero(~whole):
            peak[i], mean[i] = response[i, : count[i]].max(0), response[i, : count[i]].mean(0)
        pools = np.concatenate([peak, mean, (used / CHUNK).astype(np.float32)[:, None]], 1)
        inner = np.tanh((pools[:, :, None] * p["hidden"]).sum(1) + p["hidden_bias"])
        return (inner * p["out"]).sum(1) + p["out_bias"][0]

    def scores(self, texts: list[bytes], tables: np.ndarray) -> list[float]:
        cut = [chunks(t) for t in texts]
        sizes = np.array([len(c) for c in cut])
        x = np.concatenate(cut)
        used = np.full(len(x), CHUNK)
        ends = np.cumsum(sizes) - 1
        used[ends] = np.array([len(t) for t in texts]) - (sizes - 1) * (CHUNK - OVERLAP)
        logits = np.concatenate([self.logits(x[i : i + 64], np.maximum(used[i : i + 64], WIDTH), tables) for i in range(0, len(x), 64)])
        mean = np.add.reduceat(logits.astype(np.float64), ends - sizes + 1) / sizes
        return np.round(1 / (1 + np.exp(-np.clip(mean, -30, 30))), 6).tolist()


def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of each text, drawn by its own bytes, so that a text of any length sends a bounded few."""
    for batch in batches:
        doc_id, quality, drawn = [], [], []
        for i, q, text in zip(*(c.to_pylist() for c in batch.columns)):
            cut = chunks(text.encode())
            doc_id.append(i)
            quality.append(q)
            drawn.append(cut[np.random.default_rng(zlib.crc32(text.encode())).permutation(len(cut))[:CHUNKS_A_TEXT]].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(doc_id, pa.int64()), pa.array(quality, pa.int32()), pa.array(drawn, pa.binary())], names=["doc_id", "quality", "drawn"])


def fit(docs: DataFrame, labels: DataFrame) -> Network | None:
    """Train on a bounded sample of the labelled rows that are not held out; None without both labels."""
    known = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"), F.max("quality").cast("int").alias("most"))
    known = known.where((F.col("quality") == F.col("most")) & F.col("doc_id").isNotNull() & ~held_out())
    sample = None
    for label in (0, 1):
        pick = known.where(F.col("quality") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_A_LABEL).select("doc_id", "quality")
        sample = pick if sample is None else sample.unionByName(pick)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "quality", text_or_empty().alias("text"))
    drawn = texts.mapInArrow(draw, "doc_id long, quality int, drawn binary")
    rows = drawn.groupBy("doc_id", "quality").agg(F.min("drawn").alias("drawn")).orderBy("doc_id").collect()
    if len({r.quality for r in rows}) < 2:
        return None
    network = Network()
    network.train([np.frombuffer(r.drawn, np.uint8).reshape(-1, CHUNK) for r in rows], [r.quality for r in rows])
    return network


def score(docs: DataFrame, network: Network | None, *keep: str) -> DataFrame:
    """The columns of keep, and score, of each row. Names in keep may not be `score`."""
    source = docs.select(text_or_empty().alias("__text"), *keep)
    schema = source.drop("__text").schema.add("score", "double")
    sent = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        tables = net.tables() if net else None
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                texts = [t.encode() for t in part.column(0).to_pylist()]
                found = net.scores(texts, tables) if net else [0.5] * len(texts)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(found, pa.float64())], names=[*part.schema.names[1:], "score"])

    return source.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each row."""
    scored = score(docs.withColumn("doc_id", F.col("doc_id").cast("long")), fit(docs, labels), "doc_id")
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def accept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows, with all their columns, that the classifier does not reject."""
    renamed = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    text = renamed.columns[docs.columns.index("text")]
    scored = score(renamed.withColumn("text", F.col(text)), fit(docs, labels), *renamed.columns)
    return scored.where(F.col("score") >= THRESHOLD).drop("score").toDF(*docs.columns)
