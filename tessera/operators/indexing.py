"""Index maintenance: what changed, what to prune, replacing by file, merging versions, counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def content_hash(files: DataFrame, *, content: str = "content") -> DataFrame:
    """``files`` with file_hash, the SHA-256 of the content; empty where there is none."""
    return files.withColumn("file_hash", F.coalesce(F.sha2(F.col(content).cast("binary"), 256), F.lit("")))


def file_table(index: DataFrame) -> DataFrame:
    """One row per file: file_path, file_hash, scope."""
    return index.select("file_path", "file_hash", "scope").distinct()


def change_plan(seen: DataFrame, stored: DataFrame, *, scope: str | None = None, prune: bool = True) -> DataFrame:
    """file_path, seen_hash, stored_hash and status of every file seen or stored.

    status is new, changed, unchanged or pruned (stored, but not seen).  ``scope`` limits the
    stored files that are compared; without ``prune`` missing files stay.  Repeated rows count once.
    """
    s = seen.select("file_path", F.col("file_hash").alias("seen_hash")).dropDuplicates(["file_path"])
    o = (stored if scope is None else stored.filter(F.col("scope") == scope)).select("file_path", F.col("file_hash").alias("stored_hash")).dropDuplicates(["file_path"])
    both = s.join(o, "file_path", "full" if prune else "left")
    status = F.when(F.col("seen_hash").isNull(), "pruned").when(F.col("stored_hash").isNull(), "new").when(F.col("seen_hash") == F.col("stored_hash"), "unchanged").otherwise("changed")
    return both.withColumn("status", status)


def upsert(index: DataFrame, chunks: DataFrame) -> DataFrame:
    """``index`` with all rows of the files in ``chunks`` replaced by these."""
    return index.join(chunks.select("file_path").distinct(), "file_path", "left_anti").select(index.columns).unionByName(chunks.select(index.columns))


def delete_files(index: DataFrame, paths: DataFrame) -> DataFrame:
    """``index`` without the files in ``paths`` (file_path)."""
    return index.join(paths.select("file_path").distinct(), "file_path", "left_anti").select(index.columns)


def apply_plan(index: DataFrame, plan: DataFrame, chunks: DataFrame) -> DataFrame:
    """The next version: pruned and changed files go, ``chunks`` of new and changed ones come.

    A changed file without chunks (empty now, or too large) loses its old ones.
    """
    gone = plan.filter(F.col("status").isin("pruned", "changed", "new")).select("file_path")
    return delete_files(index, gone).unionByName(chunks.select(index.columns))


def chunks_per_file(index: DataFrame) -> DataFrame:
    return index.groupBy("file_path").agg(F.count(F.lit(1)).alias("n_chunks"))


def index_stats(index: DataFrame) -> DataFrame:
    """files and chunks, in all (scope null) and by scope."""
    return index.groupingSets([[], ["scope"]], "scope").agg(F.count_distinct("file_path").alias("files"), F.count("file_path").alias("chunks"), F.grouping("scope").cast("int").alias("is_total"))


def run_counters(plan: DataFrame, chunks: DataFrame) -> DataFrame:
    """files_seen, files_embedded, files_skipped, files_deleted, chunks_upserted of one run, as one row."""
    status = lambda *s: F.count_if(F.col("status").isin(*s)).alias
    one = plan.agg(status("new", "changed", "unchanged")("files_seen"), status("new", "changed")("files_embedded"), status("unchanged")("files_skipped"), status("pruned")("files_deleted"))
    return one.crossJoin(chunks.agg(F.count(F.lit(1)).alias("chunks_upserted")))  # two tables of one row


def merge_counters(*runs: DataFrame) -> DataFrame:
    """The sums of several runs' counters."""
    rows = runs[0]
    for r in runs[1:]:
        rows = rows.unionByName(r)
    return rows.agg(*[F.sum(c).alias(c) for c in rows.columns])


def merge_union(current: DataFrame, other: DataFrame, ancestor: DataFrame | None = None, *, keys: tuple[str, ...] = ("file_hash", "model", "chunk_idx")) -> DataFrame:
    """All rows of the versions, one per key: from current, else other, else the ancestor."""
    sides = [x.withColumn("_side", F.lit(i)) for i, x in enumerate((current, other, ancestor)) if x is not None]
    rows = sides[0]
    for s in sides[1:]:
        rows = rows.unionByName(s)
    first = F.min_by(F.struct(*[c for c in rows.columns if c not in (*keys, "_side")]), "_side").alias("_v")
    return rows.groupBy(*keys).agg(first).select(*keys, "_v.*").select(current.columns)


def merge_three_way(ancestor: DataFrame, current: DataFrame, other: DataFrame) -> DataFrame:
    """Per file, the side that changed since the ancestor; current wins where both did.

    A file that one side deleted and the other left alone is gone.
    """
    h = lambda x, n: x.select("file_path", F.col("file_hash").alias(n)).distinct()
    files = h(current, "c").join(h(other, "o"), "file_path", "full").join(h(ancestor, "a"), "file_path", "full")
    same = lambda x, y: F.col(x).eqNullSafe(F.col(y))
    side = F.when(~same("c", "a"), "c").when(~same("o", "a"), "o").otherwise("c")
    chosen = files.select("file_path", side.alias("_side"))
    take = lambda x, s: x.join(chosen.filter(F.col("_side") == s), "file_path", "left_semi")
    return take(current, "c").unionByName(take(other, "o").select(current.columns))


def export(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Chunks with the hash and scope of their files, sorted within partitions by file and number."""
    own = [c for c in chunks.columns if c not in ("file_hash", "scope")]
    joined = chunks.select(*own).join(files.select("file_path", "file_hash", "scope"), "file_path")
    return joined.repartitionByRange("file_path", "chunk_idx").sortWithinPartitions("file_path", "chunk_idx")


def numbered(chunks: DataFrame, key: str = "file_path", order: tuple[str, ...] = ("chunk_idx",)) -> DataFrame:
    """Chunks numbered anew from 0 within each file."""
    return chunks.withColumn("chunk_idx", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)
