"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstat.llm.common import delete, drop_staged, is_hot, join_hot, recorded, stage


#: Nodes that a task holds while it thins edges out.
MOST_HELD = 500_000


def thinned(edges: DataFrame) -> DataFrame:
    """(u, v), u > v: of each task's edges as many as connect what they connect, each node with the smallest of its part.

    Edges are dealt by their greater end, so a node with many neighbours, as a group of near copies has, goes on with about one edge; what is large by one end is split again. A task that holds MOST_HELD nodes writes
    their edges and begins anew, which leaves more edges, but the same components.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up, schema = {}, None

        def top(x):
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        def kept() -> pa.RecordBatch:
            pairs = [(x, root) for x in up if (root := top(x)) != x]
            columns = zip(*pairs) if pairs else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], names=["u", "v"])

        for batch in batches:
            schema = batch.schema
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                up.setdefault(u, u)
                up.setdefault(v, v)
                a, b = top(u), top(v)
                if a != b:
                    up[max(a, b)] = min(a, b)
                if len(up) > MOST_HELD:
                    yield kept()
                    up.clear()
        if up:
            yield kept()

    return edges.hint("rebalance", F.col("u")).mapInArrow(run, edges.schema)


def _least(pairs: DataFrame, total: int) -> DataFrame:
    """(u, v, least) of directed pairs; least: the smallest of u and its neighbours. A hub's pairs are not brought together."""
    lows = stage(pairs.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "lows")
    lows = lows.select("u", F.least("u", "m").alias("least"), "n")
    if lows.where(is_hot(total)).isEmpty():
        return pairs.join(lows.drop("n").hint("merge"), "u")
    return join_hot(pairs, lows, "u", total)


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """At most two edges for each one; what repeats goes in the small star."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least(both, 2 * total).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).where("u > v")


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """edges: u > v."""
    joined = _least(edges, total)
    moved = joined.where("v > least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return moved.union(joined.select("u", F.col("least").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of each node that has an edge (a, b); root: the smallest node it is connected with.

    Tasks thin their edges out first, so what the steps join grows with the nodes, not with the edges of a group.
    Each half of a step writes its minima and its edges to the shared folder, so that plans stay small, and a step compares its edges' checksum with
    the step before; a step is two grouped minima and joins on single nodes. No node's neighbours are gathered: a hub's minimum is broadcast.

    Defined results: an edge of a node with itself says nothing, repeated edges count once, edges with a null end are left out,
    and no edges give no rows; other columns are not read.
    """
    now = stage(thinned(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))).distinct(), "edges")
    seen = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == seen or state[0] == 0:
            break
        seen, before = state, now
        with recorded() as made:
            large = stage(_large_star(now, state[0]), "large-star")
            now = stage(_small_star(large, large.count()), "edges")
        for old in made[:-1]:
            delete(old)
        drop_staged(before)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
