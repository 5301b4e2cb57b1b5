"""The registered queries of these operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .vector_sql import OP11_SQL, OP12_SQL, OP13_SQL


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chroma import PHASES, excerpts, fingerprints, render_vectors, search

    media = render_vectors(_table(spark, sf_dir, "embeddings"), id_col="vec_id", vector_col="embedding")
    probes = excerpts(media.filter("id % 20 = 0"), seconds=5.12)
    return search(fingerprints(media), fingerprints(probes, phases=PHASES)).withColumnRenamed("id", "vec_id")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    kept = dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1, keep="none")
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), width=3, threshold=0.85)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import extract

    return extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_quality

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_quality(docs, _table(spark, sf_dir, "labels"), threshold=0.3, text=False).select("doc_id", "held_out", "score", "predicted")


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import score_texts

    return score_texts(_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contained_items

    return contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), width=5, threshold=0.8)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan

    found = scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "word_no", F.char_length("candidate").cast("long").alias("n_chars"), F.sha2(F.encode("candidate", "UTF-8"), 256).alias("candidate_sha256"), F.round("score", 6).alias("score"), "is_secret")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    plan = mix(_table(spark, sf_dir, "documents"), weights=(5, 2, 1), max_repeats=3)
    return plan.select("doc_id", "size", "source_size", "target", "taken", "copies", "position")


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .clustering import cluster

    return cluster(_table(spark, sf_dir, "embeddings"), dim=64, factor=64, k=16, rounds=3).drop("measured")


def op12_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import assign, place

    text = F.coalesce("text", F.lit(""))
    sized = _table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = place(assign(sized, key="doc_id", shards=24), key="doc_id", shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .codes import encode

    return encode(_table(spark, sf_dir, "embeddings"), factor=256, parts=16, entries=64, rounds=2).drop("label", "scanned")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_chroma, op2_line_dedup, op3_near_dedup, op4_toxicity, op5_html_text, op6_quality, op7_lm_score, op8_decontamination, op9_secret_scan, op10_mixing, op11_clusters, op12_shards, op13_codes)}


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP2_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keys AS (SELECT doc_id, line, pos, translate(trim(line, {_WS}), '{_UP}', '{_LOW}') AS key FROM lines),
repeated AS (SELECT key FROM keys WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT k.doc_id, k.line, k.pos, r.key IS NOT NULL AS gone FROM keys k LEFT JOIN repeated r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, CAST(coalesce(sum(CASE WHEN gone THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN gone THEN NULL ELSE line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP8_SQL = f"""
WITH w AS (
  SELECT 0 AS kind, doc_id AS id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS ws FROM documents
  UNION ALL
  SELECT 1, item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') FROM benchmark),
s AS (SELECT DISTINCT kind, id, array_to_string(ws[i:i + 4], ' ') AS sh
      FROM (SELECT kind, id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
n AS (SELECT id AS item_id, count(*) AS n_shingles FROM s WHERE kind = 1 GROUP BY id),
both_sides AS (SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_shared
      FROM s d JOIN s b ON d.sh = b.sh AND d.kind = 0 AND b.kind = 1 GROUP BY ALL)
SELECT doc_id, item_id, n_shingles, n_shared, CAST(n_shared AS DOUBLE) / CAST(n_shingles AS DOUBLE) AS containment
FROM both_sides JOIN n USING (item_id) WHERE 5 * n_shared >= 4 * n_shingles
"""

OP10_SQL = """
WITH d AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '')) AS size,
         md5(CAST(doc_id AS VARCHAR)) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][(rank - 1) % 3 + 1]::DOUBLE AS weight, source_size * 3.0::DOUBLE AS cap FROM s),
r AS (SELECT *, cap / weight AS ratio, sum(source_size) OVER ()::DOUBLE AS total FROM w),
l AS (SELECT *, (total - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
      FROM r WINDOW before AS (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT level AS lev FROM l WHERE level <= ratio ORDER BY ratio, rank LIMIT 1),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT lev FROM f) * weight, cap)) AS target, (1.0 - (rank - 1) % 3)::DOUBLE AS tilt FROM l),
c AS (SELECT d.*, t.source_size, t.target, t.tilt,
             sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING)::DOUBLE - size / 2.0 AS middle
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
g AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM c),
h AS (SELECT *, CASE WHEN size = 0 THEN 0 ELSE least(floor(rate) + (CASE WHEN middle < (rate - floor(rate)) * source_size THEN 1 ELSE 0 END), 3) END::BIGINT AS copies FROM g),
p AS (SELECT *, least(middle / target, 1.0) AS demand, 1.0 - tilt / 2.0 AS a, tilt / 2.0 AS b FROM h)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, copies * size AS taken, copies,
       CASE WHEN copies > 0 THEN CASE WHEN tilt = 0 THEN demand
            ELSE (sqrt(greatest(a * a + 4.0 * b * demand, 0.0)) - a) / (2.0 * b) END END AS position
FROM p
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": OP2_SQL, "op8_decontamination": OP8_SQL, "op10_mixing": OP10_SQL, "op11_clusters": OP11_SQL, "op12_shards": OP12_SQL, "op13_codes": OP13_SQL}
