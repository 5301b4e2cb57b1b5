"""Clusters, codes and shards against plain loops, with ties, odd vectors, repeated keys and empty tables."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import integers
from tessera.llm.clustering import cluster
from tessera.llm.codes import encode
from tessera.llm.sharding import assign, place, write_shards

VECTORS = "vec_id long, embedding array<float>, label int"


def nearest(x, entries):
    return min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), j) for j, y in enumerate(entries))


def moved(entries, points, own):
    out = []
    for j, e in enumerate(entries):
        rows = [x for x, o in zip(points, own, strict=True) if o == j]
        out.append([sum(c) // len(rows) for c in zip(*rows, strict=True)] if rows else e)
    return out


def slow_clusters(rows, k, rounds, factor):
    """id -> (cluster, distance) for rows of (id, floats), every distance measured."""
    ints = [(i, [math.floor(factor * v) for v in x]) for i, x in rows]
    c = [x for _, x in sorted(ints, key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[0], r[1]))[:k]]
    for _ in range(rounds):
        c = moved(c, [x for _, x in ints], [nearest(x, c)[1] for _, x in ints])
    return sorted((i, nearest(x, c)[1], nearest(x, c)[0], hashlib.sha256(",".join(map(str, c[nearest(x, c)[1]])).encode()).hexdigest()) for i, x in ints)


@pytest.mark.parametrize("grid", [3, 200])
def test_clusters_equal_loops(spark, grid):
    """A coarse grid makes most distances tie; a fine one makes nearly all differ."""
    rng = random.Random(grid)
    rows = [(i, [rng.randrange(-grid, grid) / 64 for _ in range(4)]) for i in range(300)]
    rows += rows[:20]  # repeated rows count each
    got = cluster(spark.createDataFrame([(i, x, 0) for i, x in rows], VECTORS).repartition(5), dim=4, factor=64, k=9, rounds=4).collect()
    assert sorted((r.vec_id, r.cluster, r.distance, r.centroid_sha256) for r in got) == slow_clusters(rows, 9, 4, 64)
    by = {}
    for r in got:
        by[r.cluster] = by.get(r.cluster, 0) + r.distance
    assert all(r.cluster_inertia == by[r.cluster] and r.inertia == sum(by.values()) for r in got)


def test_bounds_spare_distances(spark):
    """Vectors around far centres: nearly all distances are ruled out by the bounds, with the same result."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 16)) * 4
    rows = [(i, (centres[i % 8] + rng.normal(size=16) * 0.1).astype(np.float32).tolist()) for i in range(400)]
    got = cluster(spark.createDataFrame([(i, x, 0) for i, x in rows], VECTORS), dim=16, k=8, rounds=3).collect()
    assert sorted((r.vec_id, r.cluster, r.distance, r.centroid_sha256) for r in got) == slow_clusters(rows, 8, 3, 64)
    assert sum(r.measured for r in got) < 0.5 * len(rows) * 8 * 4


ODD = [
    (1, [0.5, 0.5, -0.25, 1.0], 1),
    (2, None, 1),
    (3, [], 1),
    (4, [1.0, None, 0.0, 0.0], 2),
    (5, [float("nan"), 0.0, 0.0, 0.0], 2),
    (6, [float("inf"), 0.0, 0.0, 0.0], None),
    (7, [1.0, 2.0], None),
    (8, [3e38, -3e38, 0.0, 0.0], None),
    (None, [0.5, 0.5, -0.25, 1.0], None),
    (1, [0.5, 0.5, -0.25, 1.0], 1),
]


def test_odd_vectors(spark):
    df = spark.createDataFrame(ODD, VECTORS).withColumn("x", F.lit(1)).withColumn("cluster", F.lit("a")).withColumn("n", F.lit(2.0)).withColumn("codes", F.lit(0)).withColumn("key", F.lit(0))
    got = cluster(df, dim=4, k=3, rounds=2).collect()
    assert sorted(str(r.vec_id) for r in got) == ["1", "1", "8", "None"]
    assert len({r.cluster for r in got if r.vec_id != 8}) == 1 and all(r.distance == 0 for r in got)
    codes = encode(df, parts=2, entries=3).collect()
    assert sorted(str(r.vec_id) for r in codes) == ["1", "1", "3", "7", "8", "None"]
    assert [r.code for r in codes if r.vec_id in (3, 7)] == [None, None]
    assert {str(r.label): r.label_error for r in codes} == {"1": 0, "None": 0}


def test_empty_vector_tables(spark):
    none = spark.createDataFrame([], VECTORS)
    assert cluster(none).collect() == [] and encode(none).collect() == []
    only = spark.createDataFrame([(2, None, 1), (3, [], 1)], VECTORS)
    assert cluster(only).collect() == []
    assert [(r.vec_id, r.code, r.error, r.label_error) for r in encode(only).collect()] == [(3, None, None, None)]


@pytest.mark.parametrize("grid", [2, 300])
def test_codes_equal_loops(spark, grid):
    rng = random.Random(grid)
    rows = [(i, [rng.randrange(-grid, grid) / 256 for _ in range(6)], rng.choice([0, 1, None])) for i in range(250)]
    rows += rows[:15]
    ints = [[math.floor(256 * v) for v in x] for _, x, _ in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0], ints[i]))
    books = [[ints[i][2 * p : 2 * p + 2] for i in order[:12]] for p in range(3)]
    part = lambda p: [x[2 * p : 2 * p + 2] for x in ints]
    for _ in range(3):
        books = [moved(b, part(p), [nearest(x, b)[1] for x in part(p)]) for p, b in enumerate(books)]
    sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    want = []
    for (i, _, label), x in zip(rows, ints, strict=True):
        near = [nearest(x[2 * p : 2 * p + 2], books[p]) for p in range(3)]
        want.append((i, str(label), "".join(f"{j:02x}" for _, j in near), sum(d for d, _ in near)))
    errors = {}
    for _, label, _, e in want:
        errors[label] = errors.get(label, 0) + e
    got = encode(spark.createDataFrame(rows, VECTORS).repartition(3), parts=3, entries=12, rounds=3).collect()
    assert sorted((r.vec_id, str(r.label), r.code, r.error) for r in got) == sorted(want)
    assert all(r.codebooks_sha256 == sha and r.label_error == errors[str(r.label)] for r in got)


def test_code_bounds_spare_scans(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(10, 8))
    rows = [(i, (centres[i % 10] + rng.normal(size=8) * 0.001).astype(np.float32).tolist(), 0) for i in range(500)]
    got = encode(spark.createDataFrame(rows, VECTORS), parts=4, entries=10, rounds=4).collect()
    assert sum(r.scanned for r in got) < 0.6 * len(rows) * 4 * 5


def test_large_integers_are_exact():
    rng = random.Random(1)
    most = integers.largest(5)
    x = [[rng.randint(-most, most) for _ in range(5)] for _ in range(20)] + [[most] * 5, [-most] * 5]
    got = integers.all_squared(np.array(x), np.array(x))
    assert got.tolist() == [[sum((a - b) ** 2 for a, b in zip(r, s, strict=True)) for s in x] for r in x]
    roots = np.array([r for row in got.tolist() for r in row])
    assert all(b * b <= d <= a * a for a, b, d in zip(map(int, integers.above(roots) * 2**20), map(int, integers.below(roots) * 2**20), [int(r) << 40 for r in roots.tolist()], strict=True) if d)


def shard_by_hand(key, weights):
    best = None
    for s, w in enumerate(weights):
        digest = hashlib.md5(f"{s // 4}:{'' if key is None else key}".encode()).hexdigest()
        draw = -math.log((int(digest[8 * (s % 4) : 8 * (s % 4) + 8], 16) + 0.5) / 2**32) / w
        best = min(best or (draw, s), (draw, s))
    return best[1]


def test_shards_by_hand(spark):
    weights = [1.0, 2.0, 1.0, 0.5, 3.0]
    keys = [*range(2000), None, 7, 7]
    got = assign(spark.createDataFrame([(k, "a") for k in keys], "doc_id long, Shard string"), key="doc_id", shards=5, weights=weights, grown_weight=1.5)
    assert got.columns == ["doc_id", "shard", "grown_shard"]
    rows = got.collect()
    assert all(r.shard == shard_by_hand(r.doc_id, weights) and r.grown_shard == shard_by_hand(r.doc_id, [*weights, 1.5]) for r in rows)
    assert all(r.grown_shard in (r.shard, 5) for r in rows)
    share = lambda s: sum(r.shard == s for r in rows) / len(rows)
    assert all(abs(share(s) - w / 7.5) < 0.04 for s, w in enumerate(weights))
    assert abs(sum(r.grown_shard == 5 for r in rows) / len(rows) - 1.5 / 9) < 0.04


def gapless(rows):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    return all(sorted(s) == list(range(len(s))) for s in by.values())


@pytest.mark.parametrize("group_rows", [65_536, 16])
def test_slots(spark, group_rows):
    """A key of half of all rows, most of them equal in all columns: nothing is lost, slots have no gaps, whether or not its group is split."""
    rows = [(i, f"t{i}") for i in range(300)] + [(7, "same")] * 400 + [(7, f"other {i}") for i in range(50)] + [(None, None)] * 90
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = place(assign(df, key="doc_id", shards=3), key="doc_id", shards=3, group_rows=group_rows).collect()
    assert gapless(got) and sorted(map(str, [(r.doc_id, r.text) for r in got])) == sorted(map(str, rows))
    assert len({r.shard for r in got if r.doc_id == 7}) == 1
    again = place(assign(df.repartition(2), key="doc_id", shards=3), key="doc_id", shards=3, group_rows=group_rows).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_slots_with_clashing_names(spark):
    df = spark.createDataFrame([(1, 2, 3, "x"), (4, 5, 6, "y")], "doc_id long, slot int, _tessera_group int, `a.b` string")
    got = place(assign(df, key="doc_id", shards=2), key="doc_id", shards=2)
    assert got.columns == ["doc_id", "_tessera_group", "a.b", "shard", "grown_shard", "slot"] and gapless(got.collect())
    none = df.limit(0)
    assert place(assign(none, key="doc_id", shards=2), key="doc_id", shards=2).collect() == []
    with pytest.raises(ValueError):
        assign(df, key="doc_id", shards=2, weights=[1.0, 0.0])


def test_written_shards(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(500)], "doc_id long, text string")
    placed = place(assign(df, key="doc_id", shards=4), key="doc_id", shards=4)
    write_shards(placed, str(tmp_path / "out"), max_rows=50)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.doc_id, r.shard, r.slot) for r in back.collect()) == sorted((r.doc_id, r.shard, r.slot) for r in placed.collect())
    for f in (tmp_path / "out").glob("shard=*/*.parquet"):
        slots = [r.slot for r in spark.read.parquet(str(f)).collect()]
        assert slots == list(range(slots[0], slots[0] + len(slots))) and len(slots) <= 50
