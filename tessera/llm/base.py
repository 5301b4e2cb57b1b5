"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..session import bounded_batches  # noqa: F401  the operators take it from here
from ..sources.shared import shared_dir

#: ASCII white space: space and the code points 9 to 13.
WS = " \t\n\x0b\x0c\r"
#: One word in Java's regular expressions, and what parts words.
WORD_RE = r"[^\x20\x09-\x0D]+"
GAP_RE = r"[\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


#: Bytes up to which a table may be broadcast, as its copy in the executors measures.
BROADCAST_BYTES = 64 << 20
#: Rows of one key from which a join sends that key's other side to all tasks instead of its rows to one.
HOT_ROWS = 1_000
#: Tasks over which a salted join deals the rows of a key.
SALTS = 8

#: What the blocks of ``scratch`` that are open have written or cached, innermost last.
_OPEN: list[list[DataFrame]] = []


def materialize(df: DataFrame, tag: str, *, outlive: bool = False) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back.

    This cuts the lineage: a lost executor costs the tasks it ran, not the job.  The files go
    with ``release``, at the end of the innermost open ``scratch`` (with ``outlive`` of the one
    around it), or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, at = _file(spark, path)
    fs.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    if len(_OPEN) > outlive:
        _OPEN[-1 - outlive].append(out)
    return out


def _file(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def release(*frames: DataFrame) -> None:
    """Delete the files of materialized frames, or drop the copies of cached ones; they can't be read after."""
    for df in frames:
        path = getattr(df, "_written", None)
        if path:
            fs, at = _file(df.sparkSession, path)
            fs.delete(at, True)
        else:
            df.unpersist()


@contextmanager
def scratch() -> Iterator[None]:
    """What is materialized or cached inside goes at the end; materialize what is to outlast it outside."""
    _OPEN.append([])
    try:
        yield
    finally:
        release(*_OPEN.pop())


def unused(name: str, *frames: DataFrame) -> str:
    """A column name like ``name`` that no column of the frames has, whatever the case."""
    taken = {c.lower() for f in frames for c in f.columns}
    i, out = 0, f"_tessera_{name}"
    while out.lower() in taken:
        i, out = i + 1, f"_tessera_{name}_{i}"
    return out


def quoted(name: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else; plain ``lower`` serves texts of ASCII only."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def words(col: Column) -> Column:
    """Array of the words of a text; empty for null and for texts without words."""
    t = F.trim(F.coalesce(col, F.lit("")), F.lit(WS))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, GAP_RE))


def _counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``df``, cached until the innermost open ``scratch`` ends, and its number of rows; what a lost executor held is computed again."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    if _OPEN:
        _OPEN[-1].append(df)
    return df, df.count()


def _sent(df: DataFrame, size: int = BROADCAST_BYTES) -> DataFrame:
    """The cached ``df`` marked for broadcast if its copy has at most ``size`` bytes, else as it is."""
    # The plan of a new query over the cached copy knows the copy's true size.
    return F.broadcast(df) if int(df.select("*")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= size else df


def maybe_broadcast(df: DataFrame, rows: int, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows and ``size`` bytes, else as it is (shuffled join).

    It is counted and measured first, which is the proof that a broadcast needs; it is kept
    in the executors meanwhile.
    """
    df, n = _counted(df)
    return _sent(df, size) if n <= rows else df


def salted_join(many: DataFrame, few: DataFrame, on: str, salts: int = SALTS) -> DataFrame:
    """Inner join of ``many`` with ``few``, which has one row per key: every key's rows are dealt over ``salts`` tasks, and its one row is sent to each."""
    salt = unused("salt", many, few)
    dealt = many.withColumn(salt, F.pmod(F.xxhash64(*many.columns), F.lit(salts)).cast("int"))
    return dealt.join(few.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), [on, salt]).drop(salt)


def hot_join(many: DataFrame, few: DataFrame, on: str | list[str], *, count: str = "n", rows: int = 200_000) -> DataFrame:
    """Inner join of ``many`` with ``few``, which has one row per key and in ``count`` how many rows of ``many`` the key has.

    Keys of HOT_ROWS rows or more are few; their rows stay where they are and the side of one
    row a key is sent to them, so that no task gets a whole key.  The others are joined by shuffle;
    where no key has that many rows, that is the only join, as each one adds to what the driver holds.
    """
    hot, n = _counted(few.filter(F.col(count) >= HOT_ROWS))
    if not n:
        return many.join(few, on)
    hot = _sent(hot) if n <= rows else hot
    cold = many.join(hot.select(on), on, "left_anti").join(few.filter(F.col(count) < HOT_ROWS), on)
    return many.join(hot, on).unionByName(cold)


def measured_join(many: DataFrame, few: DataFrame, on: str | list[str], *, count: str = "n", rows: int = 200_000, size: int = BROADCAST_BYTES) -> DataFrame:
    """Inner join as by ``hot_join``, with all of ``few`` sent to the tasks if it has at most ``rows`` rows and ``size`` bytes."""
    held = few.persist(StorageLevel.MEMORY_AND_DISK)
    if _OPEN:
        _OPEN[-1].append(held)
    if held.count() <= rows and int(held.select("*")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= size:
        return many.join(F.broadcast(held), on)
    return hot_join(many, held, on, count=count, rows=rows)
