"""Registered queries over plans that are carried out and over replies of a plug-in."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.embed import KeywordEmbedder
from ..functions.requests import VectorTable, embed_table
from ..functions.yaml_values import nested_front_matter
from ..operators import chunking, effects, review, sessions
from ..sources.shared import file_of, shared_dir
from .details import query
from .queries import ORACLE_SQL, table, turns

_STRIPPED = "trim(text, ' ' || chr(10) || chr(9) || chr(13) || chr(11) || chr(12))"


@query(f"""WITH d AS (SELECT doc_id, doc_id % 500 AS n, text, lang, row_number() OVER (PARTITION BY doc_id % 500 ORDER BY doc_id DESC) AS r FROM documents)
 SELECT '/memory/note-' || n || '.md' AS path, CASE WHEN doc_id % 7 = 0 THEN 'delete' ELSE 'write' END AS kind, doc_id AS item_no,
 CASE WHEN doc_id % 7 <> 0 THEN sha256('---' || chr(10) || 'created_at: ' || CASE WHEN n % 3 = 0 THEN '2025-01-01' ELSE '2026-01-02' END || chr(10) || 'updated_at: 2026-01-02' || chr(10) || 'category: global_memory' || chr(10) || 'source: review' || chr(10)
 || 'tags: ["' || lang || '"]' || chr(10) || '---' || chr(10) || chr(10) || '# Note ' || n || chr(10) || chr(10) || {_STRIPPED} || chr(10)) END AS text_sha256
 FROM d WHERE r = 1""")
def memory_effects(spark, sf):
    """Every document as an item: which files are written or deleted in the end, and with what in them."""
    d = table(spark, sf, "documents").withColumn("n", F.col("doc_id") % 500)
    slug = F.concat(F.lit("note-"), F.col("n").cast("string"))
    plan = d.select(F.col("doc_id").alias("item_no"), F.lit(0).alias("part"), F.lit("global_memory").alias("category"), F.concat(F.lit("Note "), F.col("n").cast("string")).alias("title"), slug.alias("slug"), F.when(F.col("doc_id") % 7 == 0, "deleted").otherwise("written").alias("status"), F.lit(None).cast("string").alias("reason"))
    items = d.select(F.col("doc_id").alias("item_no"), F.col("text").alias("content"), F.array("lang").alias("tags"))
    old = d.filter("n % 3 = 0").select(F.concat(F.lit("/memory/"), slug, F.lit(".md")).alias("path"), F.lit("2025-01-01").alias("created_at")).distinct()
    out = effects.effects(effects.records(plan, {"global_memory": "/memory"}), items, old, "2026-01-02")
    return out.select("path", "kind", "item_no", F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"))


@query(f"SELECT conv_id, CAST(length(condensed) AS VARCHAR) AS report FROM ({ORACLE_SQL['session_condense']})")
def review_replies(spark, sf):
    """Every conversation put to a plug-in, here one that answers with the prompt's length; replies are kept by waves."""
    kept = f"{shared_dir(spark).rstrip('/')}/replies-{uuid.uuid4().hex}"
    fs, at = file_of(spark, kept)
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    asked = sessions.condense(turns(spark, sf), session="conv_id", max_turns=2, max_chars=80).withColumnRenamed("condensed", "prompt")
    return review.ask(asked, lambda prompt: str(len(prompt)), kept, session="conv_id", wave=100_000).select("conv_id", "report")


_PIECES = """WITH RECURSIVE d AS (SELECT doc_id, trim(replace(text, chr(10), chr(10) || chr(10)), ' ' || chr(10) || chr(9) || chr(13) || chr(11) || chr(12)) AS b FROM documents),
 q AS (SELECT doc_id, trim(x, ' ' || chr(10) || chr(9) || chr(13) || chr(11) || chr(12)) AS p, i FROM (SELECT doc_id, unnest(regexp_split_to_array(b, '\n\n+')) AS x, unnest(range(len(regexp_split_to_array(b, '\n\n+')))) AS i FROM d WHERE length(b) > 1500)),
 n AS (SELECT doc_id, p, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i FROM q WHERE p <> ''),
 g AS (SELECT doc_id, i, p, length(p) + 2 AS n, 1 AS piece FROM n WHERE i = 1
  UNION ALL SELECT n.doc_id, n.i, n.p, CASE WHEN g.n + length(n.p) + 2 > 1500 THEN length(n.p) ELSE g.n + length(n.p) + 2 END, g.piece + CASE WHEN g.n + length(n.p) + 2 > 1500 THEN 1 ELSE 0 END FROM g JOIN n ON n.doc_id = g.doc_id AND n.i = g.i + 1),
 k AS (SELECT doc_id, piece, string_agg(p, chr(10) || chr(10) ORDER BY i) AS t FROM g GROUP BY doc_id, piece),
 c AS (SELECT doc_id, piece, t FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS m FROM k) WHERE m = 1 OR length(t) >= 120 UNION ALL SELECT doc_id, 1, b FROM d WHERE length(b) <= 1500 AND b <> ''),
 e AS (SELECT doc_id, piece, t, 'A > B' AS path FROM c UNION ALL SELECT doc_id, 1, '# A' || chr(10) || chr(10) || '## B' || CASE WHEN b = '' THEN '' ELSE chr(10) || chr(10) || b END, '' FROM d WHERE doc_id NOT IN (SELECT doc_id FROM c))
 SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY piece) - 1 AS chunk_idx, path, sha256(t) AS text_sha256 FROM e"""


@query(_PIECES)
def markdown_chunks(spark, sf):
    """Documents under two headings, packed by paragraph."""
    d = table(spark, sf, "documents").select("doc_id", F.regexp_replace(F.concat(F.lit("# A\n## B\n"), "text"), "\n", "\n\n").alias("body"))
    return chunking.chunk_markdown(d).select("doc_id", F.col("chunk_idx").cast("long").alias("chunk_idx"), F.array_join("heading_path", " > ").alias("path"), F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"))


@query("SELECT doc_id, CAST(contains(lower(text), 'data') AS INT) AS about_data, CAST(contains(lower(text), 'the') AS INT) AS about_the, count(*) OVER (PARTITION BY text) AS n_equal FROM documents")
def embed_requests(spark, sf):
    """Every document embedded by packed requests, equal texts once, through a table of vectors by content hash."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    vectors = VectorTable(spark, f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}")
    out = embed_table(d, KeywordEmbedder([["data"], ["the"]]), vectors, "query", max_tokens=50_000)
    n = d.groupBy(F.sha2(F.encode("text", "UTF-8"), 256).alias("h")).agg(F.count(F.lit(1)).alias("n_equal"))
    keyed = out.withColumn("h", F.sha2(F.encode("text", "UTF-8"), 256)).join(n, "h")
    return keyed.select("doc_id", F.col("embedding")[0].cast("int").alias("about_data"), F.col("embedding")[1].cast("int").alias("about_the"), "n_equal")


@query("SELECT doc_id, lang, source, sha256(text) AS text_sha256, len(string_split(text, chr(10))) AS n_lines, string_split(text, chr(10))[1] AS first_line, 'Body of ' || doc_id AS body FROM documents")
def front_nested(spark, sf):
    """Whole texts put into nested front matter, as a quoted text in a flow map and as a list of lines, and read back."""
    d = table(spark, sf, "documents")
    quoted = F.concat(F.lit("'"), F.replace("source", F.lit("'"), F.lit("''")), F.lit("'"))
    front = F.concat(
        F.lit("---\nkeys:\n  lang: >-\n    "), F.col("lang"), F.lit("\n  source: "), quoted, F.lit("\nparts:\n- "), F.to_json(F.struct(F.col("text").alias("whole"))), F.lit("\n- lines: "), F.to_json(F.split("text", "\n")),
        F.lit("\n---\n\nBody of "), F.col("doc_id").cast("string"),
    )
    read = nested_front_matter(d.select("doc_id", front.alias("text")))
    at = lambda path, kind="string": F.variant_get("front", path, kind)
    return read.select(
        "doc_id", at("$.keys.lang").alias("lang"), at("$.keys.source").alias("source"), F.sha2(F.encode(at("$.parts[0].whole"), "UTF-8"), 256).alias("text_sha256"),
        F.size(at("$.parts[1].lines", "array<string>")).cast("long").alias("n_lines"), at("$.parts[1].lines[0]").alias("first_line"), "body",
    )
