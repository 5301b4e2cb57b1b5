"""Near-duplicate documents by MinHash bands and odd sketches.

Each document's shingle set gives ``k`` MinHash samples.  Some of them, in bands, are
keys under which documents meet; all of them, folded into a bitmap where each sample
flips one bit, are its odd sketch.  The population count of the XOR of two sketches
estimates high similarities well, and pairs that it rules out are not looked at
further.  What is left is confirmed on the full sets.

Only components matter, so not every pair is needed.  Documents with equal sets form a
class, and class representatives are compared: first each with the most central
document of its buckets (its hub), one pair per document and bucket; then, only where a
bucket is still in several components, what is outside the largest of them with the
rest, in blocks of bounded size.  No pair between different components is left
untested, and no task holds an unbounded group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import bounded_batches, hot_join, materialize, maybe_broadcast, scratch, unused
from .components import components
from .shingles import in_chunks, mix64, shingle_sets

ROWS = 5
SKETCH_BITS = 512
#: Members of one side in a block of comparisons.
LEFT, RIGHT = 128, 256
BROADCAST_ROWS = 500_000


def banding(threshold: float, rows: int = ROWS) -> tuple[int, int]:
    """(bands, samples): bands so that a pair at the threshold shares none of them once in a million; sketches may rule out a few more."""
    bands = math.ceil(math.log(1e-6) / math.log(1 - threshold**rows))
    return bands, max(128, bands * rows)


def sketch_bound(threshold: float, samples: int, bits: int = SKETCH_BITS) -> int:
    """XOR population count up to which a pair may reach the threshold (4.5 standard deviations of the samples, 3 of the folding)."""
    differ = samples * (1 - threshold) + 4.5 * math.sqrt(samples * threshold * (1 - threshold))
    p = (1 - (1 - 2 / bits) ** (2 * min(differ, samples))) / 2
    return math.ceil(bits * p + 3 * math.sqrt(bits * p * (1 - p)))


def _samples(u: np.ndarray, by: np.ndarray) -> np.ndarray:
    least = np.full(len(by), np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(u), 1024):
        np.minimum(least, (u[i : i + 1024, None] * by[None, :]).min(axis=0), out=least)
    return least


def odd_sketch(samples: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """Bitmap (uint8) in which every sample, with its number, flips one bit."""
    at = mix64(samples ^ (np.arange(len(samples), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))) % np.uint64(bits)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(np.uint8))


#: Two hashes of a whole set, as sums of its mixed codes.
FIRST, SECOND = 0x5851F42D4C957F2D, 0x14057B7EF767814F


def _digest(u: np.ndarray, salt: int) -> int:
    return int(mix64(u ^ np.uint64(salt)).sum(dtype=np.uint64).astype(np.int64))


def signatures(docs: DataFrame, *, width: int, threshold: float) -> DataFrame:
    """doc_id, n_shingles, f1, f2 (hash of the whole set), bands and sketch of each row."""
    bands, k = banding(threshold)

    def sign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by = np.random.default_rng(5).integers(1, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        salt = np.arange(bands, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for part in parts:
            texts = [t if isinstance(t, str) else None for t in part["text"]]
            rows = []
            for a, b in in_chunks(texts):
                for u in shingle_sets(texts[a:b], width):
                    if not len(u):
                        rows.append((0, 0, 0, None, None))
                        continue
                    s = _samples(u, by)
                    keys = salt.copy()
                    for j in range(ROWS):
                        keys = mix64(keys + s[j : bands * ROWS : ROWS])
                    rows.append((len(u), _digest(u, FIRST), _digest(u, SECOND), keys.astype(np.int64), odd_sketch(s).tobytes()))
            out = pd.DataFrame(rows, columns=["n_shingles", "f1", "f2", "bands", "sketch"])
            out.insert(0, "doc_id", part["doc_id"].to_numpy())
            out.insert(1, "named", part["named"].to_numpy())
            yield out

    bounded_batches(docs.sparkSession)
    # Null ids would turn all ids of a batch into floating point numbers.
    one = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNotNull().alias("named"), "text")
    out = one.mapInPandas(sign, "doc_id long, named boolean, n_shingles long, f1 long, f2 long, bands array<long>, sketch binary")
    return out.withColumn("doc_id", F.when(F.col("named"), F.col("doc_id"))).drop("named")


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """id, f1, codes: the full shingle sets of the representatives (id, f1) in ``wanted``; a document may have several."""

    def make(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = [t if isinstance(t, str) else None for t in part["text"]]
            for a, b in in_chunks(texts):
                sets = shingle_sets(texts[a:b], width)
                yield pd.DataFrame({"id": part["doc_id"].iloc[a:b].to_numpy(), "f1": [_digest(u, FIRST) for u in sets], "codes": [u.tobytes() for u in sets]})

    ids = maybe_broadcast(wanted.select("id").distinct(), BROADCAST_ROWS)
    named = docs.filter("doc_id IS NOT NULL")
    return named.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, F.col("doc_id") == F.col("id"), "left_semi").mapInPandas(make, "id long, f1 long, codes binary")


def links_between(left: list, right: list, threshold: float, bound: int) -> list[tuple[int, int]]:
    """Linked pairs of two lists of (id, component, bands, sketch, codes); pairs within a component are passed over."""
    sk = lambda x: np.frombuffer(b"".join(m[3] for m in x), dtype=np.uint64).reshape(len(x), -1)
    lb, rb = np.array([m[2] for m in left]), np.array([m[2] for m in right])
    rid, rcomp, rs = np.array([m[0] for m in right]), np.array([m[1] for m in right]), sk(right)
    percent = round(threshold * 100)
    sets = [np.frombuffer(m[4], dtype=np.uint64) for m in right]
    sizes = np.array([len(s) for s in sets])
    found = []
    for i, (one, s) in enumerate(zip(left, sk(left), strict=True)):
        may = (rcomp != one[1]) & (rid != one[0])
        may &= (rb == lb[i]).any(axis=1)
        may &= np.bitwise_count(rs ^ s).sum(axis=1) <= bound
        u = np.frombuffer(one[4], dtype=np.uint64)
        may &= (100 * np.minimum(sizes, len(u)) >= percent * np.maximum(sizes, len(u)))
        for j in np.flatnonzero(may):
            both = len(np.intersect1d(u, sets[j], assume_unique=True))
            if 100 * both >= percent * (len(u) + len(sets[j]) - both):
                found.append((one[0], int(rid[j])))
    return found


def _compare(groups: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) found in groups (unit, l, r, side, id, component); every group is bounded."""
    _, k = banding(threshold)
    bound = sketch_bound(threshold, k)

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        rows = list(zip(part["id"], part["component"], part["bands"], part["sketch"], part["codes"], strict=True))
        left, right = [x for x, s in zip(rows, part["side"], strict=True) if s == 0], [x for x, s in zip(rows, part["side"], strict=True) if s == 1]
        return pd.DataFrame(links_between(left, right, threshold, bound) if left and right else [], columns=["a", "b"], dtype="int64")

    return groups.join(sets, "id").groupBy("unit", "l", "r").applyInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, *, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """Components of the documents whose shingle sets have a Jaccard similarity of ``threshold`` or more.

    Words are parted by ASCII white space, A-Z lower-cased; a text of fewer than ``width``
    words is one shingle, a very long one is taken whole.  Null, empty and blank texts have no
    shingle and are linked with nothing.  Returns per row doc_id, n_shingles, component_id (the
    least doc_id of the component), kept (doc_id is that one).  Rows that share a doc_id are one
    document, linked by any of their texts.  Rows without doc_id are linked with nothing; their
    component_id is null and they are kept.  doc_ids are whole numbers; an empty table gives an
    empty one; further columns are ignored, whatever their names.
    """
    with scratch():
        return materialize(_linked(docs.select("doc_id", "text"), width, threshold), "near", outlive=True)


def _linked(docs: DataFrame, width: int, threshold: float) -> DataFrame:
    """What ``near_duplicates`` returns; reads tables that go with the scratch space it is called in."""
    signed = materialize(signatures(docs, width=width, threshold=threshold), "signed")
    some = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    same = ["f1", "f2", "n_shingles"]
    # Classes of equal sets, with the bands and sketch that equal sets share: one aggregation, however many copies there are.
    classes = some.groupBy(*same).agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    reps = classes = materialize(classes, "classes")
    # Documents of several texts link the classes of these.
    several = some.groupBy("doc_id").agg(F.min(F.struct(*same)).alias("a"), F.max(F.struct(*same)).alias("b")).filter("a <> b").select("doc_id")
    several = maybe_broadcast(several, BROADCAST_ROWS)
    owned = some.select("doc_id", *same).join(several, "doc_id", "left_semi").join(classes.select(*same, "id"), same).select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    keyed = reps.select("id", F.explode("bands").alias("key"))
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    buckets = materialize(hot_join(keyed, counts, "key"), "buckets")
    central = buckets.groupBy("id").agg(F.sum("n").alias("c"))
    hubs = buckets.join(central, "id").groupBy("key").agg(F.max(F.struct("c", (-F.col("id")).alias("m"))).alias("h"), F.count(F.lit(1)).alias("n")).select("key", (-F.col("h.m")).alias("hub"), "n")
    star = materialize(hot_join(buckets.select("id", "key"), hubs, "key").filter("id <> hub").select("id", "hub").distinct(), "star")
    # With bands and sketch, so that comparisons join once; both steps need the same exchange.
    sets = _sets(docs, buckets.select("id"), width).join(reps.select("id", "f1", "bands", "sketch"), ["id", "f1"])
    sets = materialize(sets.dropDuplicates(["id", "f1"]), "sets")

    # Each hub with its documents; a hub of many is dealt out over several groups.
    spread = star.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / RIGHT).cast("int").alias("parts"), F.count(F.lit(1)).alias("n"))
    dealt = hot_join(star, spread, "hub").withColumn("r", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    first = dealt.select(F.col("hub").alias("unit"), F.lit(0).alias("l"), "r", F.lit(1).alias("side"), "id", F.col("id").alias("component"))
    first = first.unionByName(
        spread.select(F.col("hub").alias("unit"), F.lit(0).alias("l"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("r"), F.lit(0).alias("side"), F.col("hub").alias("id"), F.col("hub").alias("component"))
    )
    links = materialize(_compare(first, sets, threshold).unionByName(owned.filter("a <> b")), "links")
    found = components(links)

    # Buckets that lie in several components: what is outside their largest one is compared with all members.
    def placed(members: DataFrame) -> DataFrame:
        return members.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))

    def open_units(members: DataFrame) -> DataFrame:
        """unit, n, n_left, most of the units with more than one component."""
        per = members.groupBy("unit", "component").agg(F.count(F.lit(1)).alias("c"))
        return per.groupBy("unit").agg(F.sum("c").alias("n"), (F.sum("c") - F.max("c")).alias("n_left"), F.max_by("component", "c").alias("most")).filter("n_left > 0")

    by_bucket = materialize(placed(buckets.select(F.col("key").alias("unit"), "id")), "placed")
    open_buckets = materialize(open_units(by_bucket), "open")
    if open_buckets.limit(1).count():
        # Where buckets overlap, comparing the cluster that they form costs less than each of them.
        touched = by_bucket.join(open_buckets.select("unit"), "unit", "left_semi")
        anchors = touched.groupBy("unit").agg(F.min("id").alias("a"))
        clusters = components(touched.join(anchors, "unit").select(F.col("id").alias("b"), "a"))
        in_clusters = placed(clusters.select(F.col("component").alias("unit"), "id"))
        open_clusters = materialize(open_units(in_clusters), "open")
        home = anchors.join(clusters, F.col("a") == F.col("id")).select("unit", F.col("component").alias("cluster"))
        cost = open_buckets.join(home, "unit").groupBy("cluster").agg(F.sum(F.col("n") * F.col("n_left")).alias("apart"))
        whole = open_clusters.join(cost, F.col("unit") == F.col("cluster")).filter(F.col("n") * F.col("n_left") <= F.col("apart"))
        whole = materialize(whole.select("unit", "n", "n_left", "most"), "whole")
        apart = open_buckets.join(home.join(whole.select(F.col("unit").alias("cluster")), "cluster", "left_anti"), "unit").select("unit", "n", "n_left", "most")
        members = in_clusters.join(whole, "unit").select("unit", "id", "component", "n", "n_left", "most", F.lit(0).alias("kind"))
        members = members.unionByName(by_bucket.join(apart, "unit").select("unit", "id", "component", "n", "n_left", "most", F.lit(1).alias("kind")))
        members = materialize(members, "members")  # both sides read it; else each would plan all of the above again
        ls, rs = F.ceil(F.col("n_left") / LEFT).cast("int"), F.ceil(F.col("n") / RIGHT).cast("int")
        unit = F.xxhash64("kind", "unit")
        every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        left = members.filter("component <> most").select(unit.alias("unit"), F.pmod(F.xxhash64("id"), ls).cast("int").alias("l"), every(rs).alias("r"), F.lit(0).alias("side"), "id", "component")
        right = members.select(unit.alias("unit"), every(ls).alias("l"), F.pmod(F.xxhash64("id"), rs).cast("int").alias("r"), F.lit(1).alias("side"), "id", "component")
        more = _compare(left.unionByName(right), sets, threshold)
        found = components(links.unionByName(more))
    # Classes get their component first, so that only they meet the documents, of which one class may have any share.
    ends = classes.select(*same, "id", "n").join(found, "id", "left").select(*same, F.coalesce("component", "id").alias("component_id"), "n")
    final = hot_join(some.select("doc_id", *same), ends, same).select("doc_id", "n_shingles", "component_id")
    others = signed.filter("NOT (n_shingles > 0 AND doc_id IS NOT NULL)")
    final = final.unionByName(others.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return final.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with one document of each component, the one with the least doc_id; all columns stay, whatever their names.

    Rows that share the doc_id that stays all stay, as they are one document.  Nulls, empty and
    very long texts, repeated rows and empty tables are taken as by ``near_duplicates``.
    """
    mark = unused("gone", docs)
    gone = near_duplicates(docs, **how).filter("NOT kept").select(F.col("doc_id").alias(mark)).distinct()
    gone = maybe_broadcast(gone, BROADCAST_ROWS)
    return docs.join(gone, F.col("doc_id") == F.col(mark), "left_anti")
