"""Vector compression by product codes, trained with Hamerly's bounds.

A vector is cut into parts, and each part is replaced by the number of the nearest entry of
its position's codebook.  Every part keeps an upper bound on the distance to its entry and a
lower bound on the distance to any other; only where neither that lower bound nor half the
distance to the entry's nearest neighbour is strictly above the upper bound, all entries are
compared, in integers.  Bounds are rounded away from a decision, so ties are always compared
and go to the lower number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import hot_join, materialize, quoted, release, scratch
from .integers import BLOCK, DOWN, UP, above, all_squared, below, finite, floor_means, floored, halves, lists, matrix, squared

NAMES = ["id", "label", "x", "codes", "upper", "lower", "scanned", "error", "part", "entry", "n", "sums"]
STATE = "x array<int>, codes array<int>, upper array<double>, lower array<double>, scanned long, error long, part int, entry int, n long, sums array<long>"


def _visit(x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, book: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Move ``own``, ``upper`` and ``lower`` of a block of one part to the nearest entries in place; which rows compared all entries."""
    fails = lambda at: ~(upper[at] < np.maximum(lower[at], near[own[at]]))
    left = np.arange(len(x))
    left = left[fails(left)]
    upper[left] = np.minimum(upper[left], above(squared(x[left], book[own[left]])))
    left = left[fails(left)]
    scanned = np.zeros(len(x), np.int64)
    if left.size:
        d2 = all_squared(x[left], book)
        own[left] = d2.argmin(axis=1)  # the first of equals
        upper[left] = above(d2[np.arange(len(left)), own[left]])
        lower[left] = below(np.partition(d2, 1, axis=1)[:, 1]) if len(book) > 1 else np.inf
        scanned[left] = 1
    return scanned


def _round(state: DataFrame, books: np.ndarray, moved: np.ndarray, *, last: bool) -> DataFrame:
    """Every vector's next state; behind them, one row per task, part and entry with the count and the sums of its parts."""
    parts, m, width = books.shape
    near = np.stack([halves(b).min(axis=1) for b in books])
    # How far any other entry has come: the farthest of all, for that one the second.
    farthest = np.stack([[np.delete(mv, j).max(initial=0.0) for j in range(m)] for mv in moved])
    dim, step = parts * width, max(1, BLOCK // max(parts * width, m))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums, types = np.zeros((parts, m), np.int64), np.zeros((parts, m, width), np.int64), None
        for whole in batches:
            types = whole.column(0).type, whole.column(1).type
            for start in range(0, whole.num_rows, step):
                b = whole.slice(start, step)
                n = b.num_rows
                x = matrix(b.column(2), dim).astype(np.int64)
                codes, upper, lower = matrix(b.column(3), parts).astype(np.int64), matrix(b.column(4), parts).copy(), matrix(b.column(5), parts).copy()
                scanned, error = b.column(6).to_numpy(zero_copy_only=False).copy(), np.zeros(n, np.int64)
                for p in range(parts):
                    xp, own = np.ascontiguousarray(x[:, p * width : (p + 1) * width]), codes[:, p].copy()
                    up = (upper[:, p] + moved[p, own]) * UP
                    low = np.maximum(0.0, (lower[:, p] - farthest[p, own]) * DOWN)
                    scanned += _visit(xp, own, up, low, books[p], near[p])
                    codes[:, p], upper[:, p], lower[:, p] = own, up, low
                    if last:
                        error += squared(xp, books[p][own])
                    else:
                        counts[p] += np.bincount(own, minlength=m)
                        np.add.at(sums[p], own, xp)
                none = [pa.nulls(n, t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))]
                own = [b.column(0), b.column(1), b.column(2), lists(codes, pa.int32()), lists(upper, pa.float64()), lists(lower, pa.float64()), pa.array(scanned), pa.array(error)]
                yield pa.RecordBatch.from_arrays([*own, *none], names=NAMES)
        at = np.argwhere(counts)
        if len(at):
            kinds = (*types, pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(at), t) for t in kinds), pa.array(at[:, 0], pa.int32()), pa.array(at[:, 1], pa.int32()), pa.array(counts[at[:, 0], at[:, 1]]), lists(sums[at[:, 0], at[:, 1]], pa.int64())], names=NAMES)

    kinds = dict(state.dtypes)
    return state.select(*NAMES[:7]).mapInArrow(task, f"id {kinds['id']}, label {kinds['label']}, {STATE}")


def encode(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", factor: int = 256, parts: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """Codes of all vectors: id, label, code, error, label_error, codebooks_sha256, scanned.

    A component x counts as the integer floor(factor * x); one so large that squared distances
    would leave a long stops there.  Codebooks start as the parts of the ``entries`` least ids (ties by
    vector); fewer vectors make shorter ones.  Each round assigns all parts, then moves every entry
    in use to the floor of its parts' mean; at the end all parts are assigned once more.  ``code`` has
    two hexadecimal digits per part; ``error`` is the exact squared distance to what the code stands for, and
    ``label_error`` its sum over equal labels, nulls together (null where it doesn't fit a long).
    ``scanned`` is how often a part of the vector compared all entries; without bounds (rounds + 1) * parts.

    Null vectors and those with a null or non-finite component are left out.  The vector of the least id whose
    length ``parts`` divides sets the length; vectors of other lengths stay, with null code and error.  A null
    id is greater than others; repeated rows count each; an empty table gives an empty one; of the other columns
    none is read or kept.

    The state of all vectors is one table in the shared folder, rewritten by each round; the
    driver holds the codebooks only.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be 1 to 256")
    spark = vectors.sparkSession
    types = dict(vectors.dtypes)
    v = quoted(vector_col)
    good = vectors.filter(finite(v)).select(quoted(id_col).alias("id"), quoted(label_col).alias("label"), v.alias("v"))
    order = [F.col("id").asc_nulls_last(), "v"]
    head = good.filter((F.size("v") > 0) & (F.size("v") % parts == 0)).orderBy(*order).select(F.size("v").alias("d")).limit(1).first()
    nothing = f"{id_col} {types[id_col]}, {label_col} {types[label_col]}, code string, error long, label_error long, codebooks_sha256 string, scanned long"
    if head is None:
        return good.select(F.col("id").alias(id_col), F.col("label").alias(label_col), *[F.lit(None).cast(t).alias(n) for n, t in (("code", "string"), ("error", "long"), ("label_error", "long"), ("codebooks_sha256", "string"), ("scanned", "long"))]).to(spark.createDataFrame([], nothing).schema)
    dim, width = head.d, head.d // parts
    sized = good.filter(F.size("v") == dim).select("id", "label", floored(F.col("v"), factor, dim).alias("x"))
    first = sized.orderBy(F.col("id").asc_nulls_last(), "x").select("x").limit(entries).collect()
    start = np.array([r.x for r in first], dtype=np.int64)
    m = len(start)
    books = np.ascontiguousarray(start.reshape(m, parts, width).transpose(1, 0, 2))
    with scratch():
        per = lambda value: F.array_repeat(F.lit(value), parts)
        state = sized.select("id", "label", "x", per(0).alias("codes"), per(float("inf")).alias("upper"), per(0.0).alias("lower"), F.lit(0).cast("long").alias("scanned"))
        moved, before = np.zeros((parts, m)), None
        for _ in range(rounds):
            done = materialize(_round(state, books, moved, last=False), "hamerly")
            if before is not None:
                release(before)
            sums = done.filter("n IS NOT NULL").groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(width)]).collect()  # parts * entries rows
            by: list[dict[int, tuple[int, list[int]]]] = [{} for _ in range(parts)]
            for g in sums:
                by[g.part][g.entry] = (g.n, [g[f"s{j}"] for j in range(width)])
            new = np.stack([floor_means(b, s) for b, s in zip(books, by, strict=True)])
            moved = np.stack([above(squared(a, b)) for a, b in zip(new, books, strict=True)])
            books, state, before = new, done.filter("n IS NULL"), done
        final = materialize(_round(state, books, moved, last=True).select("id", "label", "codes", "error", "scanned"), "codes", outlive=True)
    sha = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    digits = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    rows = final.select("id", "label", digits.alias("code"), "error", F.lit(sha).alias("codebooks_sha256"), "scanned")
    others = good.filter(F.size("v") != dim).select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"), F.lit(sha).alias("codebooks_sha256"), F.lit(None).cast("long").alias("scanned"))
    # Labels as text, nulls apart, so that nulls meet too; one label may have any share of the rows.
    keyed = rows.unionByName(others).withColumn("none", F.col("label").isNull()).withColumn("key", F.coalesce(F.col("label").cast("string"), F.lit("")))
    sums_ = keyed.groupBy("none", "key").agg(F.count(F.lit(1)).alias("n"), F.expr("try_cast(sum(CAST(error AS DECIMAL(38, 0))) AS BIGINT)").alias("label_error"))
    return hot_join(keyed, sums_, ["none", "key"]).select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error", "label_error", "codebooks_sha256", "scanned")
