"""A media column of lossless WebP files, and features of what is read back from it.

`encode` stores each text's UTF-8 bytes, padded with 255 to whole units, as pixel samples;
`describe` decodes the stored bytes to pixel arrays and computes the features from them. Rows are
independent: there is no shuffle, and a task holds one Arrow slice and one tile's arrays.

Feature: width x height of the first file, number of files, the samples' sum for each of red, green,
blue and alpha, and a 64-bit mean hash (bit i: the i-th of 64 equal parts of the payload has a mean over the whole's).

Defined results: a null text is empty, which is one unit of 255; texts of any length are stored
whole, in several files if need be; equal texts give equal values; a null doc_id stays null; an empty table
gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstat.llm import webp
from docstat.llm.common import text_or_empty

ROWS_A_SLICE = 256
DESCRIBED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS_A_SLICE):
            yield batch.slice(lo, ROWS_A_SLICE)


def encode(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the stored media of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = [t.encode() for t in part.column(1).to_pylist()]
            media = [webp.store(webp.padded(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def feature(images: list[np.ndarray], payload: np.ndarray) -> str:
    height, width, _ = images[0].shape
    sums = sum(image.reshape(-1, 4).sum(axis=0, dtype=np.int64) for image in images)
    parts = payload.reshape(64, -1).sum(axis=1, dtype=np.int64)
    bits = "".join("1" if 64 * int(p) > int(parts.sum()) else "0" for p in parts)
    return f"{width}x{height}x{len(images)}:{'/'.join(map(str, sums))}:{int(bits, 2):016x}"


def describe(media: DataFrame) -> DataFrame:
    """The columns of DESCRIBED, from the stored bytes of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = []
            for stored in part.column(2).to_pylist():
                images = webp.load(stored)
                payload = np.concatenate([image.ravel() for image in images])
                raw = payload.tobytes()
                rows.append((len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(images, payload)))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], names=[c.split()[0] for c in DESCRIBED.split(", ")])

    return media.mapInArrow(run, DESCRIBED)
