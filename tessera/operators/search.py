"""Filtered cosine top-k over vector tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..functions.vector import cosine
from ..schema import CODE_SCOPE, expand_scopes

MAX_K = 20


def clamp_k(k: int) -> int:
    return max(1, min(int(k), MAX_K))


def filter_scopes(index: DataFrame, scope: str | list[str] | None) -> DataFrame:
    """Rows of the scopes that ``scope`` stands for; None and an empty list set no limit."""
    return index if not scope else index.filter(F.col("scope").isin(expand_scopes(scope)))


def filter_tags(index: DataFrame, tags: list[str] | None, *, like: bool = False) -> DataFrame:
    """Rows with one of the tags at least; ``like`` matches tags that contain one, % and _ as in LIKE."""
    if not tags:
        return index
    if not like:
        return index.filter(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
    return index.filter(F.exists("tags", lambda t: _any(t, tags)))


def _any(t: Column, tags: list[str]) -> Column:
    out = t.like(f"%{tags[0]}%")
    for x in tags[1:]:
        out = out | t.like(f"%{x}%")
    return out


def check_dim(query: list[float], dim: int) -> None:
    if len(query) != dim:
        raise ValueError(f"a vector of length {dim} is needed, not {len(query)}")


def top_k(index: DataFrame, query: list[float], k: int, *, scope: str | list[str] | None = None, tags: list[str] | None = None, tags_like: bool = False, ties: tuple[str, ...] = ("file_path", "chunk_idx"), drop_degenerate: bool = False) -> DataFrame:
    """The ``k`` rows nearest to ``query`` by cosine, best first, with ``score``.

    Filters come before the limit and reach the scan.  Ties follow ``ties``.  A zero vector
    scores NaN, which sorts first, as in the data model; ``drop_degenerate`` leaves such out.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = filter_tags(filter_scopes(index, scope), tags, like=tags_like)
    scored = rows.withColumn("score", cosine(F.col("embedding"), q)).drop("embedding")
    if drop_degenerate:
        scored = scored.filter(~F.isnan("score"))
    return scored.orderBy(F.desc("score"), *ties).limit(k)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` greatest scores, ties by the least id; NaN is the greatest."""
    rank = np.where(np.isnan(scores), np.inf, scores)
    if k < len(rank):
        least = np.partition(rank, len(rank) - k)[len(rank) - k]
        sure, tied = np.flatnonzero(rank > least), np.flatnonzero(rank == least)
        at = np.concatenate([sure, tied[np.argsort(ids[tied], kind="stable")[: k - len(sure)]]])
    else:
        at = np.arange(len(rank))
    return at[np.lexsort((ids[at], -rank[at]))]


def top_k_batch(index: DataFrame, queries: DataFrame, k: int, *, id_col: str = "vec_id", query_id: str = "query_id", block: int = 4096, part: int = 65_536) -> DataFrame:
    """For each query the ``k`` nearest rows: query_id, id_col, score, rank.

    Queries (query_id, embedding) fall into blocks of about ``block`` and rows of the index into parts of
    about ``part``; each block meets each part in one task as two matrices, of which ``k`` rows a
    query are kept, and those of all parts are ranked.  Nothing goes through the driver but two counts,
    and the plan is the same for any number of queries; rows travel once per block, queries once per part.

    Scores that differ beyond the twelfth digit only are ties and go by the least id.  Rows and queries
    without a vector are passed over; a zero vector scores NaN, which sorts first, as in ``top_k``.
    Repeated rows count each.  No queries give an empty table.
    """
    types = dict(queries.dtypes) | dict(index.dtypes)
    rows = index.select(F.col(id_col).alias("_id"), F.col("embedding").alias("_v")).filter("_v IS NOT NULL")
    asked = queries.select(F.col(query_id).alias("_q"), F.col("embedding").alias("_v")).filter("_v IS NOT NULL")
    n = rows.count()
    parts = max(1, -(-n // part), min(-(-n // 1024), index.sparkSession.sparkContext.defaultParallelism))
    blocks = max(1, -(-asked.count() // block))
    # The partition's number deals out rows that are equal; it is the same when a task is run again.
    deal = lambda c, m: F.pmod(F.xxhash64(c) + F.spark_partition_id(), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = rows.withColumn("_part", deal("_id", parts)).withColumn("_block", every(blocks))
    right = asked.withColumn("_block", deal("_q", blocks)).withColumn("_part", every(parts))

    def meet(own: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own) and len(wanted):
            v, q, ids, names = np.array(own["_v"].tolist(), dtype=float), np.array(wanted["_v"].tolist(), dtype=float), own["_id"].to_numpy(), wanted["_q"].to_numpy()
            step = max(1, (1 << 23) // len(v))
            with np.errstate(invalid="ignore", divide="ignore"):
                norms, q = np.linalg.norm(v, axis=1), q / np.linalg.norm(q, axis=1, keepdims=True)
                for start in range(0, len(q), step):  # a slice of scores of 64 MB
                    s = (q[start : start + step] @ v.T) / norms[None, :]
                    for name, score, r in zip(names[start : start + step], s, np.round(s, 12), strict=True):
                        at = _best(r, ids, k)
                        out.append(pd.DataFrame({"_q": [name] * len(at), "_id": ids[at], "score": np.nan_to_num(score[at]), "_r": np.nan_to_num(r[at]), "_none": np.isnan(r[at])}))
        return pd.concat(out) if out else pd.DataFrame({"_q": [], "_id": [], "score": [], "_r": [], "_none": []})

    met = left.groupBy("_block", "_part").cogroup(right.groupBy("_block", "_part")).applyInPandas(meet, f"_q {types[query_id]}, _id {types[id_col]}, score double, _r double, _none boolean")
    nan = lambda c: F.when(F.col("_none"), F.lit(float("nan"))).otherwise(F.col(c))
    met = met.select(F.col("_q").alias(query_id), F.col("_id").alias(id_col), nan("score").alias("score"), nan("_r").alias("_r"))
    w = Window.partitionBy(query_id).orderBy(F.desc("_r"), id_col)
    return met.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("_r")


def merge_top_k(stores: list[DataFrame], query: list[float], k: int, **how) -> DataFrame:
    """Top-k over several tables as one: the scans are joined, ordered and cut once."""
    all_rows = stores[0]
    for s in stores[1:]:
        all_rows = all_rows.unionByName(s, allowMissingColumns=True)
    return top_k(all_rows, query, k, **how)


def rerank(hits: DataFrame, query: str, k: int, score: Callable[[Column, Column], Column], *, ties: tuple[str, ...] = ("file_path", "chunk_idx")) -> DataFrame:
    """The ``k`` best of ``hits`` under another score of (query, text); the first score stays as ``vector_score``."""
    scored = hits.withColumnRenamed("score", "vector_score").withColumn("score", score(F.lit(query), F.col("text")))
    return scored.orderBy(F.desc("score"), F.desc("vector_score"), *ties).limit(k)


def search_reranked(index: DataFrame, vector: list[float], query: str, k: int, score: Callable[[Column, Column], Column], *, over_fetch: int = 3, **how) -> DataFrame:
    """Fetch ``over_fetch * k`` by vector, then rerank and keep ``k``."""
    return rerank(top_k(index, vector, over_fetch * k, **how), query, k, score, ties=how.get("ties", ("file_path", "chunk_idx")))


def search_code(index: DataFrame, vector: list[float], k: int = 5, **how) -> DataFrame:
    """Hits in source code: file_path, language, start_line, end_line, score and the code itself."""
    hits = top_k(index.filter(F.col("scope") == CODE_SCOPE), vector, clamp_k(k), **how)
    p = X.parse_code_hit(F.col("text"))
    return hits.select("file_path", p["language"].alias("language"), p["start_line"].alias("start_line"), p["end_line"].alias("end_line"), "score", p["body"].alias("text"))


def union_hits(memory: DataFrame, code: DataFrame, k: int) -> DataFrame:
    """Memory and code hits in one ranking; they may come from different models, so scores compare only roughly."""
    both = memory.withColumn("kind", F.lit("memory")).unionByName(code.withColumn("kind", F.lit("code")), allowMissingColumns=True)
    return both.orderBy(F.desc("score"), "file_path").limit(k)


def hits_json(hits: DataFrame) -> DataFrame:
    """Each hit as one JSON text."""
    return hits.select(F.to_json(F.struct(*hits.columns)).alias("hit"))
