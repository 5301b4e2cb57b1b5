"""Centroid clustering with Elkan's bounds.

Every vector keeps its cluster, an upper bound on the distance to that centroid, and a lower
bound for each centroid.  When centroids move, bounds move by as much.  A distance is measured
only where neither the lower bound nor half the distance between the two centroids shows that
the other centroid is strictly farther; bounds are rounded away from a decision, so ties are
always measured and go to the smaller number.  Vectors and distances are integers, so a run
gives the same result whatever the partitions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import materialize, quoted, release, scratch
from .integers import BLOCK, DOWN, UP, above, all_squared, below, finite, floor_means, floored, halves, lists, matrix, squared

STATE = "x array<int>, cluster int, upper double, lower array<double>, measured long, distance long, n long, sums array<long>"


def _visit(x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, half: np.ndarray) -> np.ndarray:
    """Move ``own``, ``upper`` and ``lower`` of a block to the nearest centroids in place; how many distances each row cost."""
    k, cost = len(centroids), np.zeros(len(x), np.int64)
    near = half.min(axis=1)
    left = np.flatnonzero(~(upper < near[own]))
    if left.size:
        open_ = ~(upper[left, None] < lower[left]) & ~(upper[left, None] < half[own[left]])
        open_[np.arange(len(left)), own[left]] = False
        left = left[open_.any(axis=1)]
    if not left.size:
        return cost
    xs, at, low = x[left], own[left], lower[left]
    best = squared(xs, centroids[at])
    up = above(best)
    low[np.arange(len(left)), at] = below(best)
    spent = np.ones(len(left), np.int64)
    for j in range(k):
        rows = np.flatnonzero((at != j) & ~(up < low[:, j]) & ~(up < half[at, j]))
        if not rows.size:
            continue
        d2 = squared(xs[rows], centroids[j])
        spent[rows] += 1
        low[rows, j] = below(d2)
        won = (d2 < best[rows]) | (d2 == best[rows]) & (j < at[rows])
        to = rows[won]
        at[to], best[to], up[to] = j, d2[won], above(d2[won])
    own[left], upper[left], lower[left], cost[left] = at, up, low, spent
    return cost


def _round(state: DataFrame, centroids: np.ndarray, moved: np.ndarray, *, last: bool) -> DataFrame:
    """Every vector's next state; behind them, one row per task and cluster with the count and the sums of its vectors."""
    k, dim = centroids.shape
    half = halves(centroids)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums, id_type = np.zeros(k, np.int64), np.zeros((k, dim), np.int64), None
        for whole in batches:
            id_type = whole.column(0).type
            for start in range(0, whole.num_rows, max(1, BLOCK // dim)):
                b = whole.slice(start, max(1, BLOCK // dim))
                x = matrix(b.column(1), dim).astype(np.int64)
                own = b.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
                upper = (b.column(3).to_numpy(zero_copy_only=False) + moved[own]) * UP
                lower = np.maximum(0.0, (matrix(b.column(4), k) - moved[None, :]) * DOWN)
                cost = b.column(5).to_numpy(zero_copy_only=False) + _visit(x, own, upper, lower, centroids, half)
                distance = pa.array(squared(x, centroids[own])) if last else pa.nulls(len(x), pa.int64())
                counts += np.bincount(own, minlength=k)
                np.add.at(sums, own, x)
                none = [pa.nulls(len(x), pa.int64()), pa.nulls(len(x), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own, pa.int32()), pa.array(upper), lists(lower, pa.float64()), pa.array(cost), distance, *none], names=names)
        seen = np.flatnonzero(counts)
        if len(seen) and not last:
            none = lambda t: pa.nulls(len(seen), t)
            empty = [none(id_type), none(pa.list_(pa.int32())), pa.array(seen, pa.int32()), none(pa.float64()), none(pa.list_(pa.float64())), none(pa.int64()), none(pa.int64())]
            yield pa.RecordBatch.from_arrays([*empty, pa.array(counts[seen]), lists(sums[seen], pa.int64())], names=names)

    names = ["id", "x", "cluster", "upper", "lower", "measured", "distance", "n", "sums"]
    return state.select("id", "x", "cluster", "upper", "lower", "measured").mapInArrow(task, f"id {dict(state.dtypes)['id']}, {STATE}")


def cluster(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = 64, factor: int = 64, k: int = 16, rounds: int = 3, seed: str = "1") -> DataFrame:
    """Clusters of all vectors of ``dim`` finite components: id, cluster, distance, cluster_inertia, inertia, centroid_sha256, measured.

    A component x counts as the integer floor(factor * x); one so large that squared distances
    would leave a long (beyond 2**28 or so) stops there.  The first centroids are the ``k`` vectors
    of the least SHA-256 of ``seed:id``, ties by id and vector; fewer vectors make fewer centroids.
    Each round assigns all vectors, then moves every centroid that has vectors to the floor of
    their mean; at the end all are assigned once more.  ``distance`` is squared and exact; inertias
    are sums of it (null where they don't fit a long).  ``measured`` is how many of the (rounds + 1) * k distances the bounds left to compute.

    Null vectors, those of another length, and those with a null or non-finite component are left
    out.  A null id is like the id ``null``; repeated rows count each; an empty table gives an empty
    one; of the other columns none is read or kept.  Of equally near centroids the smaller number wins.

    The state of all vectors is one table in the shared folder, rewritten by each round; the driver
    holds the centroids only.
    """
    spark = vectors.sparkSession
    id_type = dict(vectors.dtypes)[id_col]
    v = quoted(vector_col)
    good = vectors.filter((F.size(v) == dim) & finite(v)).select(quoted(id_col).alias("id"), floored(v, factor, dim).alias("x"))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null"))), 256)
    first = good.orderBy(order, F.col("id").asc_nulls_last(), "x").limit(k).collect()
    if not first:
        return spark.createDataFrame([], f"{id_col} {id_type}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, measured long")
    centroids = np.array([r.x for r in first], dtype=np.int64)
    k = len(first)
    with scratch():
        state = good.select("id", "x", F.lit(0).alias("cluster"), F.lit(float("inf")).alias("upper"), F.array_repeat(F.lit(0.0), k).alias("lower"), F.lit(0).cast("long").alias("measured"))
        moved, before = np.zeros(k), None
        for _ in range(rounds):
            done = materialize(_round(state, centroids, moved, last=False), "elkan")
            if before is not None:
                release(before)
            parts = done.filter("n IS NOT NULL").select("cluster", "n", F.posexplode("sums").alias("p", "s"))
            sums: dict[int, tuple[int, list[int]]] = {}
            for g in parts.groupBy("cluster", "p").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("cluster", "p").collect():  # k * dim rows
                sums.setdefault(g.cluster, (g.n, []))[1].append(g.s)
            new = floor_means(centroids, sums)
            moved, centroids, state, before = above(squared(new, centroids)), new, done.filter("n IS NULL"), done
        done = materialize(_round(state, centroids, moved, last=True), "clusters", outlive=True)
        sums_ = done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # k rows
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    fits = lambda n: n if n < 2**63 else None
    total = fits(sum(int(g.s) for g in sums_))
    facts = spark.createDataFrame([(g.cluster, fits(int(g.s)), total, shas[g.cluster]) for g in sums_], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = done.select(F.col("id"), "cluster", "distance", "measured").join(F.broadcast(facts), "cluster")
    return out.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "measured")

