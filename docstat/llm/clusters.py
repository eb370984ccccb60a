"""Centroid clustering with geometric drift tightening.

Components are integers, so distances, sums and centroids are exact and ties are real ties. A vector keeps an upper bound of its distance to its own centroid and a
lower bound of that to every other. When centroids move, the upper bound grows by the own centroid's drift, and the lower bound shrinks by less than the full drift of the others:
all vectors of a cluster lie in a sphere around its old centroid, and what a centroid's move can take off their distance is bounded in the plane of the sphere's centre and the
two ends of the move (`loosening`). A vector whose bounds stay apart keeps its cluster unseen; the ambiguous ones are compared exactly, first with their own centroid, then with all.

A round is one pass over the vectors, in the tasks that hold them, with no shuffle of vectors: it reads the rows of the round before from the shared folder and writes them with new bounds;
each task adds one row for each cluster (count, radius, component sums), and the driver sees one summed row for each cluster. The round before is deleted when its successor is written.

Defined results: vectors that are null, of another length, or hold a null or non-finite component are left out; repeated rows are vectors of their own; a null vec_id is
hashed as an empty one; rows of one hash start in the order of their components; fewer vectors than clusters give fewer clusters; an empty table gives no rows; other columns are not read.
A component beyond 2^27 in size after scaling raises an error, as distances would leave 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstat.llm.common import delete, recorded, stage

DIMS, SCALE, K, ROUNDS, SALT = 64, 1024, 8, 10, 3
#: Vectors compared at a time.
AT_ONCE = 4096
#: Bounds are kept apart by this much of their size, which covers rounding.
SLACK = 1e-9
LARGEST = 1 << 27

#: Rows of vectors have no cluster_n; a task's sums of a cluster have no vector.
STATE = "vec_id long, vector binary, own int, upper double, lower double, distance long, cluster_n long, radius double, inertia decimal(38,0), scanned long, sums array<long>"
_KINDS = (pa.int64(), pa.binary(), pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.decimal128(38, 0), pa.int64(), pa.list_(pa.int64()))
_NAMES = [field.split()[0] for field in STATE.split(", ")]


def loosening(before: np.ndarray, after: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """[i, j]: how much nearer centroid j can have come to any vector of cluster i, whose vectors lie within radii[i] of before[i].

    For a vector at x, d(x, b) - d(x, a) = 2 D p / (d(x, b) + d(x, a)) <= D p / d(x, m): D the drift, m the middle of the move from b to a, p the part of x - m along it. So it is at most
    D times the cosine of the angle at m between x and the move, and the least such angle in the sphere is the centre's angle less the sphere's half angle of sight. A sphere that holds m allows the
    full drift; one that lies behind m allows none.
    """
    out = np.zeros((len(before), len(before)))
    for j, (b, a) in enumerate(zip(before, after)):
        drift = float(np.linalg.norm(a - b))
        if drift == 0:
            continue
        from_middle = before - (a + b) / 2
        height = np.linalg.norm(from_middle, axis=1)
        along = from_middle @ (a - b) / drift
        for i, radius in enumerate(radii):
            if height[i] <= radius * (1 + SLACK) + SLACK:
                out[i, j] = drift
                continue
            angle = np.arccos(np.clip(along[i] / height[i], -1, 1)) - np.arcsin(radius / height[i])
            out[i, j] = drift * max(0.0, float(np.cos(max(0.0, angle))))
    return out * (1 + SLACK) + SLACK * (out > 0)


class Step:
    """What a pass needs of one round: the centroids, and how far the last move loosens the bounds of each cluster's vectors."""

    def __init__(self, centroids: list[list[int]], before: list[list[int]] | None = None, radii: list[float] | None = None, last: bool = False):
        self.centroids, self.last = np.array(centroids, np.int64), last
        self.grow = self.shrink = None
        now = self.centroids.astype(float)
        if before is not None:
            old = np.array(before, float)
            self.grow = np.linalg.norm(now - old, axis=1) * (1 + SLACK)
            off = loosening(old, now, np.array(radii))
            np.fill_diagonal(off, 0)
            self.shrink = off.max(axis=1)
        gaps = np.linalg.norm(now[:, None] - now[None], axis=2)
        np.fill_diagonal(gaps, np.inf)
        self.half = gaps.min(axis=1) / 2

    def distances(self, vectors: np.ndarray, to: np.ndarray) -> np.ndarray:
        gap = vectors - to
        return np.einsum("ij,ij->i", gap, gap)

    def assign(self, vectors: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
        """New bounds and clusters, in place; returns how many vectors were compared with all centroids."""
        if self.grow is None:
            scan = np.arange(len(vectors))
        else:
            upper += self.grow[own]
            lower -= self.shrink[own]
            apart = lambda at: upper[at] * (1 + SLACK) + SLACK < np.maximum(lower[at] * (1 - SLACK) - SLACK, self.half[own[at]] * (1 - SLACK))
            unsure = np.flatnonzero(~apart(slice(None)))
            upper[unsure] = np.sqrt(self.distances(vectors[unsure], self.centroids[own[unsure]]).astype(float))
            scan = unsure[~apart(unsure)]
        if len(scan):
            table = np.stack([self.distances(vectors[scan], c) for c in self.centroids], axis=1)
            nearest = table.argmin(axis=1)  # the first of equals
            rows = np.arange(len(scan))
            own[scan], upper[scan] = nearest, np.sqrt(table[rows, nearest].astype(float))
            others = table.astype(float)
            others[rows, nearest] = np.inf
            lower[scan] = np.sqrt(others.min(axis=1))
        return len(scan)


class Sums:
    """A task's counts, radii, distances and component sums of each cluster."""

    def __init__(self, k: int, dims: int):
        self.n, self.radius, self.inertia, self.scanned = [0] * k, [0.0] * k, [0] * k, 0
        self.sums = np.zeros((k, dims), np.int64)

    def add(self, vectors: np.ndarray, own: np.ndarray, upper: np.ndarray, distance: np.ndarray | None, scanned: int) -> None:
        self.scanned += scanned
        for c in np.unique(own).tolist():
            mine = own == c
            self.n[c] += int(mine.sum())
            self.radius[c] = max(self.radius[c], float(upper[mine].max()))
            self.sums[c] += vectors[mine].sum(axis=0)
            if distance is not None:
                self.inertia[c] += sum(distance[mine].tolist())

    def batch(self) -> pa.RecordBatch:
        k, none = len(self.n), [None] * len(self.n)
        values = (none, none, range(k), none, none, none, self.n, self.radius, map(Decimal, self.inertia), [self.scanned] + [0] * (k - 1), self.sums.tolist())
        return pa.RecordBatch.from_arrays([pa.array(list(v), kind) for v, kind in zip(values, _KINDS)], names=_NAMES)


def integers(column: pa.Array, dims: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """The places of the vectors that are kept, and their components as integers."""
    whole = np.flatnonzero((pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)) == dims)
    flat = column.take(pa.array(whole)).flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)  # null: not a number
    good = np.isfinite(values).all(axis=1)
    scaled = np.floor(values[good] * scale)
    if scaled.size and np.abs(scaled).max() > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST} after scaling by {scale}")
    return whole[good], scaled.astype(np.int64)


def _pass(rows: DataFrame, step: Step, dims: int, scale: float | None) -> DataFrame:
    """One round over the source (vec_id, vector; scale given) or over the rows of the round before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums(len(step.centroids), dims)
        for whole in batches:
            for lo in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(lo, AT_ONCE)
                if scale is not None:
                    kept, vectors = integers(batch.column(1), dims, scale)
                    ids = batch.column(0).take(pa.array(kept))
                    own, upper, lower = np.zeros(len(kept), np.int64), np.zeros(len(kept)), np.zeros(len(kept))
                else:
                    ids = batch.column(0)
                    vectors = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<i4").reshape(-1, dims).astype(np.int64)
                    own, upper, lower = batch.column(2).to_numpy().astype(np.int64), batch.column(3).to_numpy().copy(), batch.column(4).to_numpy().copy()
                scanned = step.assign(vectors, own, upper, lower)
                distance = step.distances(vectors, step.centroids[own]) if step.last else None
                if len(vectors):
                    sums.add(vectors, own, upper, distance, scanned)
                n, raw, width = len(vectors), b"" if step.last else vectors.astype("<i4").tobytes(), 4 * dims
                made = [None if step.last else raw[i * width : (i + 1) * width] for i in range(n)]
                columns = [ids, made, own, upper, lower, distance if step.last else [None] * n]
                arrays = [x if isinstance(x, pa.Array) else pa.array(x, kind) for x, kind in zip(columns, _KINDS)]
                yield pa.RecordBatch.from_arrays(arrays + [pa.nulls(n, kind) for kind in _KINDS[6:]], names=_NAMES)
        if any(sums.n):
            yield sums.batch()

    return rows.mapInArrow(run, STATE)


def first_centroids(rows: DataFrame, k: int, dims: int, scale: float, salt: int) -> list[list[int]]:
    """The kept vectors with the smallest hashes, as integers."""
    finite = lambda x: x.isNotNull() & (F.abs(x) < float("inf"))  # noqa: E731  # not a number is above infinity
    kept = rows.where((F.size("vector") == dims) & F.forall("vector", finite))
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    found = kept.select(key.alias("h"), "vector").orderBy("h", "vector").limit(k).collect()
    return [integers(pa.array([r["vector"]], pa.list_(pa.float64())), dims, scale)[1][0].tolist() for r in sorted(found, key=lambda r: (r["h"], r["vector"]))]


def summed(state: DataFrame, dims: int) -> dict[int, dict]:
    """One row for each cluster, from the tasks' rows."""
    parts = state.where("cluster_n is not null")
    sums = F.array(*(F.sum(F.get("sums", F.lit(i))) for i in range(dims))).alias("sums")
    totals = (F.sum("cluster_n").alias("n"), F.max("radius").alias("radius"), F.sum("inertia").alias("inertia"), F.sum("scanned").alias("scanned"))
    return {r["own"]: r.asDict() for r in parts.groupBy("own").agg(*totals, sums).collect() if r["n"] or r["scanned"]}


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: float = SCALE, salt: int = SALT, log: list | None = None) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each kept vector of vectors (vec_id, embedding).

    log: gets the number of vectors that each pass compared with all centroids.
    """
    source = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    now = first_centroids(source, k, dims, scale, salt)
    if not now:
        empty = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return vectors.sparkSession.createDataFrame([], empty)
    step, state, before = Step(now, last=not rounds), None, []
    for i in range(rounds + 1):
        with recorded() as made:
            state = stage(_pass(state.where("cluster_n is null") if i else source, step, dims, None if i else scale), "clusters")
        for old in before:
            delete(old)
        before, totals = made, summed(state, dims)
        if log is not None:
            log.append(sum(t["scanned"] for t in totals.values()))
        if i < rounds:
            moved = [[s // totals[c]["n"] for s in totals[c]["sums"]] if c in totals and totals[c]["n"] else old for c, old in enumerate(now)]
            step = Step(moved, now, [totals[c]["radius"] if c in totals else 0.0 for c in range(len(now))], last=i == rounds - 1)
            now = moved
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    named = lambda values, kind: F.create_map(*(x for c, v in enumerate(values) for x in (F.lit(c), F.lit(v).cast(kind))))
    inertias = [int(totals[c]["inertia"]) if c in totals else 0 for c in range(len(now))]
    return state.where("cluster_n is null").select(
        "vec_id",
        F.col("own").alias("cluster"),
        "distance",
        named(inertias, "long")[F.col("own")].alias("cluster_inertia"),
        F.lit(sum(inertias)).cast("long").alias("inertia"),
        named(sha, "string")[F.col("own")].alias("centroid_sha256"),
    )


def _oracle(k: int = K, rounds: int = ROUNDS) -> str:
    """The same in SQL, a pair of relations for each round."""
    square = "list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))"
    parts = [
        f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e: floor({SCALE} * e::DOUBLE)::BIGINT) AS x FROM embeddings
     WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {DIMS})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SALT}:' || vec_id)) - 1 AS c, x FROM v ORDER BY sha256('{SALT}:' || vec_id) LIMIT {k})",
    ]
    for r in range(rounds + 1):
        parts.append(
            f"""a{r} AS MATERIALIZED (SELECT vec_id, x, c, d FROM (SELECT v.vec_id, v.x, c.c, {square} AS d,
     row_number() OVER (PARTITION BY v.vec_id ORDER BY {square}, c.c) AS place FROM v, c{r} c) WHERE place = 1)"""
        )
        if r < rounds:
            parts.append(
                f"""m{r} AS (SELECT c, list(floor_div ORDER BY i) AS x FROM (SELECT c, i, floor(sum(x[i])::DOUBLE / count(*))::BIGINT AS floor_div
     FROM a{r}, range(1, {DIMS + 1}) t(i) GROUP BY c, i) GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.x, o.x) AS x FROM c{r} o LEFT JOIN m{r} m USING (c))"""
            )
    return f"""
WITH {", ".join(parts)}
SELECT vec_id, a.c::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(f.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} f ON a.c = f.c
"""


ORACLE = _oracle()
