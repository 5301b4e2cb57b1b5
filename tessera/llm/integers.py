"""Vectors of integers: exact distances, bounds that are rounded the safe way, and floors of means."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Factors that move a rounded root past its true value: a double holds 53 bits, these leave 5 for what is summed.
UP, DOWN = 1 + 2.0**-48, 1 - 2.0**-48
#: Numbers of vectors that a task turns into 64-bit integers at a time.
BLOCK = 1 << 20


def largest(dim: int) -> int:
    """The largest component for which every squared distance of ``dim`` components fits a long."""
    return math.isqrt((2**63 - 1) // max(1, dim)) // 2


def finite(vector: Column) -> Column:
    """Whether a vector and all its components are there and finite."""
    return vector.isNotNull() & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) != float("inf")))


def floored(vector: Column, factor: int, dim: int) -> Column:
    """Components as integers floor(factor * x), x as double; beyond what ``largest`` allows they stop there."""
    most = float(largest(dim))
    return F.transform(vector, lambda v: F.floor(F.greatest(F.lit(-most), F.least(F.lit(most), v.cast("double") * factor))).cast("int"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column of lists of ``width`` numbers as a matrix."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), width)


def lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A matrix as a column of lists."""
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(rows).reshape(-1), kind))


def squared(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` and ``to``, row by row, or of all rows to one."""
    d = x - to
    return np.einsum("ij,ij->i", d, d)


def all_squared(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row of ``x`` to every row of ``to``.

    Products of doubles are exact while their sums stay below 2**53; beyond that integers are used.
    """
    reach = int(max(np.abs(x).max(initial=0), np.abs(to).max(initial=0)))
    if 4 * reach * reach * x.shape[1] < 2**53:
        a, b = x.astype(float), to.astype(float)
        return (np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None, :] - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([squared(x, t) for t in to], axis=1) if len(to) else np.zeros((len(x), 0), np.int64)


def above(d2: np.ndarray) -> np.ndarray:
    """Doubles that are no less than the roots."""
    return np.sqrt(d2.astype(float)) * UP


def below(d2: np.ndarray) -> np.ndarray:
    """Doubles that are no greater than the roots."""
    return np.sqrt(d2.astype(float)) * DOWN


def halves(entries: np.ndarray) -> np.ndarray:
    """Half the distance of every two entries, no greater than it is; infinite on the diagonal."""
    out = 0.5 * below(all_squared(entries, entries))
    np.fill_diagonal(out, np.inf)
    return out


def floor_means(old: np.ndarray, sums: dict[int, tuple[int, list[int]]]) -> np.ndarray:
    """``old`` with every row that ``sums`` has (row: count, sums of components) replaced by floor(sum / count)."""
    new = old.copy()
    for i, (n, s) in sums.items():
        new[i] = [v // n for v in s]
    return new
