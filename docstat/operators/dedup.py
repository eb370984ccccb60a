"""Best row per key, and the log of what a running best displaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docstat.functions import rules


def alias_score(reason: Column) -> Column:
    """3, 2, 1 for exact, phrase, weak aliases, else 0."""
    out = F
    for score, name in zip((3, 2, 1), rules.CLASSES):
        out = out.when(reason.contains(name), score)
    return out.otherwise(0)


def mapping_rank() -> Column:
    """Alias class, whether there are source pages, confidence."""
    return F.struct(alias_score(F.col("mapping_reason")).alias("a"), F.when(F.size("source_pages") > 0, 2).otherwise(0).alias("s"), F.col("confidence").alias("c"))


def extraction_rank() -> Column:
    """Alias class, known period, known unit plus single group, confidence."""
    known_unit = F.when(F.col("unit") == "unknown", 0).otherwise(1)
    single = F.when(F.coalesce("table_group_id", F.lit("")).contains(","), 0).otherwise(1)
    return F.struct(
        alias_score(F.col("mapping_reason")).alias("a"), F.when(F.col("period_label") == "unknown_period", 0).otherwise(1).alias("p"), (known_unit + single).alias("u"), F.col("confidence").alias("c")
    )


def keep_best(rows: DataFrame, key: list[str], rank: Column, order: str = "ord") -> DataFrame:
    """The highest rank of each key; of equals the first by order."""
    return ranked(rows, key, rank, order).where("__n = 1").drop("__rank", "__n")


def ranked(rows: DataFrame, key: list[str], rank: Column, order: str = "ord") -> DataFrame:
    """rows with __n, their place in their key: 1 for what `keep_best` keeps."""
    best = Window.partitionBy(*key).orderBy(F.col("__rank").desc(), F.col(order))
    return rows.withColumn("__rank", rank).withColumn("__n", F.row_number().over(best))


def discard_log(rows: DataFrame, key: list[str], rank: Column, order: str = "ord") -> DataFrame:
    """What is displaced when rows arrive in order: (key, order of the arrival, order of the row displaced).

    An arrival over the best so far displaces it, any other displaces itself.
    """
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.withColumn("__rank", rank).withColumn("__best", F.max(F.struct(F.col("__rank").alias("r"), (-F.col(order)).alias("o"))).over(w))
    lost = F.when(F.col("__rank") > F.col("__best.r"), -F.col("__best.o")).otherwise(F.col(order))
    return ranked.where("__best is not null").select(*key, F.col(order).alias("arrival"), lost.alias("discarded"))


def first_discards(rows: DataFrame, key: list[str], rank: Column, columns: list[str], by: str, n: int = 10, order: str = "ord") -> DataFrame:
    """The first n rows that the running best of each key displaces or turns away, of each value of `by`: (by, place, columns), place from 0 in the order of the arrivals.

    The running best carries the columns, so what an arrival displaces is at hand in the same window; of each task and value no more than n rows go on.
    """
    own = F.struct(*columns)
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.withColumns({"__rank": rank, "__own": own})
    ranked = ranked.withColumn("__best", F.max(F.struct(F.col("__rank").alias("r"), (-F.col(order)).alias("o"), F.col("__own").alias("own"))).over(w))
    lost = F.when(F.col("__rank") > F.col("__best.r"), F.col("__best.own")).otherwise(F.col("__own"))
    each = ranked.where("__best is not null").select(by, F.col(order).alias("__at"), lost.alias("__lost"))
    first = each.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy("__at"))).where(F.col("place") <= n)
    return first.select(by, (F.col("place") - 1).alias("place"), "__lost.*")
