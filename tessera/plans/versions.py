"""Registered queries over stored versions: edits as deltas, compaction, branches and merges."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import indexing
from ..schema import CHUNKS
from ..sources.shared import file_of, shared_dir
from ..sources.store import VectorStore
from .queries import _D, ORACLE_SQL, _stored, _versions, docs_index
from .details import query


def _chunks(d: DataFrame) -> DataFrame:
    """``documents`` as rows of a store, with the length of the text for a vector."""
    own = {"index_name": F.lit("memory"), "embedding": F.array(F.length("text").cast("float")), "indexed_at": F.lit(None)}
    return d.select([(own[f.name] if f.name in own else F.col(f.name) if f.name in d.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in CHUNKS])


def _store(spark: SparkSession, name: str) -> VectorStore:
    """A new store in the shared folder that goes when the driver ends."""
    root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    fs, at = file_of(spark, root)
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return VectorStore(spark, root, dim=1, model="m1", buckets=8)


@query(_D + " SELECT file_path, file_hash, scope, CAST(length(text) AS BIGINT) AS n_chars FROM d WHERE doc_id % 11 <> 0 AND doc_id % 13 <> 0")
def store_edits(spark, sf):
    """An older index brought up to date by a plan, files deleted, half of the buckets compacted: what the last version holds."""
    store, d = _store(spark, "edits"), docs_index(spark, sf)
    store.write(_chunks(_stored(d)))
    seen = d.filter("doc_id % 11 <> 0")
    plan = indexing.change_plan(seen, store.files())
    store.apply(plan, _chunks(seen.join(plan.filter("status IN ('new', 'changed')").select("file_path"), "file_path", "left_semi")))
    store.compact({0, 2, 4, 6})
    store.delete(d.filter("doc_id % 13 = 0").select("file_path"))
    return store.read().select("file_path", "file_hash", "scope", F.length("text").cast("long").alias("n_chars"))


@query(f"SELECT file_path, file_hash FROM ({ORACLE_SQL['index_merge_three_way']})")
def store_merge(spark, sf):
    """Two branches of a store, each brought to its own state and merged: the files of the result."""
    base, current, other = (_chunks(v.withColumn("text", F.lit(""))) for v in _versions(spark, sf))
    main = _store(spark, "merge")
    main.write(base)
    side = main.branch("side")
    for store, rows in ((main, current), (side, other)):
        plan = indexing.change_plan(rows, store.files())
        store.apply(plan, rows.join(plan.filter("status IN ('new', 'changed')").select("file_path"), "file_path", "left_semi"))
    main.merge(side)
    return main.read().select("file_path", "file_hash")
