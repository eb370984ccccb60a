"""Exact de-duplication with a split for heavy hitters; DataFrame functions only.

Texts are equal when they are identical after every white-space character
(space and U+0009 to U+000D) has been deleted. Of equal texts the row with the most
code points in its original text stays, then the smallest doc_id.

Plan: one scan writes a narrow table of digests. A Misra-Gries frequent-items sketch,
kept per digest bucket and merged map-side, names the digests that may be frequent. A second pass
over the narrow table counts those exactly and picks their winners, so a false candidate
of the sketch costs nothing. The winners, at most BUCKETS * PER_BUCKET of them, are broadcast, and rows
with such a digest are decided where they lie. Only the remaining digests, none of which
has more than a small share of the rows, are shuffled.

Defined results: a null text counts as empty, and empty texts equal each other; a null doc_id
comes after all others; of rows that tie in length and doc_id (repeated rows) exactly one stays; an empty
table gives an empty table; extra columns are kept by `deduplicate` and ignored by `decide`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docstat.llm.common import WORD_SPACE, free_name, stage, text_or_empty

#: Sketches; each sees the digests of one bucket.
BUCKETS = 64
#: Candidates taken from each sketch, so that at most BUCKETS * PER_BUCKET rows are ever broadcast.
PER_BUCKET = 16
#: Counters of a sketch.
COUNTERS = 1024
#: A digest is a heavy hitter from this share of all rows on.
HEAVY_SHARE = 0.0005


def normalised(text: Column) -> Column:
    return F.translate(text_or_empty(text), WORD_SPACE, "")


def digest(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def narrow_rows(docs: DataFrame) -> DataFrame:
    """doc_id, length of the original text, digest, and a row number that breaks last ties; written once."""
    return stage(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.char_length(text_or_empty()).alias("n"),
            digest(F.col("text")).alias("text_sha256"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "digests",
    )


def best(n: str = "n", doc_id: str = "doc_id", row: str = "row") -> Column:
    """Ordering value of a row in its group: the largest stays."""
    return F.struct(
        F.col(n).alias("n"),
        F.col(doc_id).isNotNull().alias("known"),
        F.coalesce(-F.col(doc_id).cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)")).alias("back"),
        (-F.col(row)).alias("row"),
        F.col(doc_id).alias("doc_id"),
    )


def candidates(rows: DataFrame) -> DataFrame:
    """Digests that a Misra-Gries sketch of their bucket holds with a count over one."""
    bucket = F.pmod(F.xxhash64("text_sha256"), F.lit(BUCKETS))
    held = rows.groupBy(bucket.alias("bucket")).agg(F.expr(f"approx_top_k(text_sha256, {PER_BUCKET}, {COUNTERS})").alias("top"))
    return held.select(F.explode("top").alias("t")).where("t.count > 1").select(F.col("t.item").alias("text_sha256"))


def heavy_winners(rows: DataFrame, share: float = HEAVY_SHARE) -> DataFrame:
    """Exact count and winner of each candidate that proves frequent: (text_sha256, group_size, top)."""
    counted = rows.join(F.broadcast(candidates(rows)), "text_sha256").groupBy("text_sha256").agg(F.count(F.lit(1)).alias("group_size"), F.max(best()).alias("top"))
    return counted.where(F.col("group_size") > F.lit(share * rows.count()))


def decide(docs: DataFrame, share: float = HEAVY_SHARE) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = narrow_rows(docs)
    winners = stage(heavy_winners(rows, share), "winners")
    heavy = rows.join(F.broadcast(winners), "text_sha256")
    rest = rows.join(F.broadcast(winners), "text_sha256", "left_anti")
    group = Window.partitionBy("text_sha256")
    rest = rest.withColumns({"group_size": F.count(F.lit(1)).over(group), "top": F.max(best()).over(group)})
    return heavy.unionByName(rest).select(
        "doc_id",
        F.col("top.doc_id").alias("keep_id"),
        "group_size",
        (F.col("top.row") == -F.col("row")).alias("kept"),
        "text_sha256",
    )


def deduplicate(docs: DataFrame, share: float = HEAVY_SHARE) -> DataFrame:
    """The rows that stay, with all their columns.

    Rows of heavy digests are removed map-side against the broadcast winners. What is left of
    them, and all other rows, meets in one shuffle on the digest. Of rows that tie in length
    and doc_id any one stays.
    """
    rows = narrow_rows(docs)
    winners = stage(heavy_winners(rows, share), "winners")
    d, n, rank, top = (free_name(docs, x) for x in ("digest", "length", "rank", "top"))
    full = docs.withColumns({d: digest(F.col("text")), n: F.char_length(text_or_empty())})
    wide = F.broadcast(winners.select(F.col("text_sha256").alias(d), F.col("top").alias(top)))
    full = full.join(wide, d, "left").where(
        F.col(top).isNull() | ((F.col(n) == F.col(f"{top}.n")) & F.col("doc_id").cast("long").eqNullSafe(F.col(f"{top}.doc_id")))
    )
    order = Window.partitionBy(d).orderBy(F.col(n).desc(), F.col("doc_id").asc_nulls_last())
    return full.withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1).select(*docs.columns)


ORACLE = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY text_sha256) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k
"""
