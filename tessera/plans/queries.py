"""Queries over the test tables, one or more per operator, each on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..functions.embed import lexical_score
from ..functions.vector import cosine, dot, norm
from ..operators import catalog, chunking, indexing, ledger, recall, routing, search, sessions
from ..sources import files as scans

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as an index: the label gives scope and tags."""
    e = table(spark, sf_dir, "embeddings")
    scope = F.element_at(F.array(*map(F.lit, ("global", "project", "skill_global", "skill_project", "code"))), (F.col("label") % 5 + 1).cast("int"))
    tags = F.array(F.concat(F.lit("tag"), F.col("label").cast("string")), F.when(F.col("label") % 2 == 0, "even").otherwise("odd"))
    return e.select("vec_id", "embedding", "label", scope.alias("scope"), tags.alias("tags"))


def first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").filter("vec_id = 0").first().embedding)


def _scored(hits: DataFrame, *cols: str) -> DataFrame:
    return hits.select("vec_id", *cols, F.round("score", 6).alias("score"))


@query
def vector_topk(spark, sf):
    return _scored(search.top_k(vectors(spark, sf), first_vector(spark, sf), 10, ties=("vec_id",)))


@query
def vector_topk_scoped(spark, sf):
    return _scored(search.top_k(vectors(spark, sf), first_vector(spark, sf), 10, scope=["project", "skills"], ties=("vec_id",)), "scope")


@query
def vector_topk_tags(spark, sf):
    return _scored(search.top_k(vectors(spark, sf), first_vector(spark, sf), 10, tags=["even", "tag3"], ties=("vec_id",)))


@query
def vector_topk_tags_like(spark, sf):
    return _scored(search.top_k(vectors(spark, sf), first_vector(spark, sf), 10, tags=["g1", "%3"], tags_like=True, scope="all", ties=("vec_id",)))


@query
def vector_topk_batch(spark, sf):
    e = table(spark, sf, "embeddings")
    queries = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return search.top_k_batch(e, queries, 5).select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query
def vector_merge_stores(spark, sf):
    v = vectors(spark, sf)
    parts = [v.filter(F.col("vec_id") % 3 == i) for i in range(3)]
    return _scored(search.merge_top_k(parts, first_vector(spark, sf), 10, ties=("vec_id",)))


@query
def vector_overfetch_rerank(spark, sf):
    v = vectors(spark, sf).withColumn("text", F.concat_ws(" ", "tags"))
    return _scored(search.search_reranked(v, first_vector(spark, sf), "even tag3", 5, lexical_score, ties=("vec_id",)).withColumn("score", F.col("score") + 0.0))


@query
def vector_norms(spark, sf):
    e = table(spark, sf, "embeddings")
    q = F.array(*[F.lit(float(x)) for x in first_vector(spark, sf)])
    return e.select("vec_id", F.round(norm(F.col("embedding")), 6).alias("norm"), F.round(dot(F.col("embedding"), q), 6).alias("dot"), F.round(cosine(F.col("embedding"), q), 6).alias("cosine"))


def docs_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as chunks of files: a file per document."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.concat(F.lit("/memory/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file_path"), F.sha2(F.encode("text", "UTF-8"), 256).alias("file_hash"), F.col("lang").alias("scope"), F.lit("m1").alias("model"), (F.col("doc_id") % 3).cast("int").alias("chunk_idx"), "doc_id", "text"
    )


@query
def index_stats(spark, sf):
    return indexing.index_stats(docs_index(spark, sf))


@query
def index_chunks_per_file(spark, sf):
    c = chunking.chunk_lines(docs_index(spark, sf).drop("chunk_idx"), size=3)
    return indexing.chunks_per_file(c)


def _stored(d: DataFrame) -> DataFrame:
    """What an older index held: most documents, some with other content."""
    h = F.when(F.col("doc_id") % 7 == 0, F.sha2(F.concat(F.lit("old"), F.col("doc_id").cast("string")), 256)).otherwise(F.col("file_hash"))
    return d.filter("doc_id % 5 <> 0").withColumn("file_hash", h)


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs_index(spark, sf_dir)
    return indexing.change_plan(d.filter("doc_id % 11 <> 0"), _stored(d))


@query
def index_change_plan(spark, sf):
    return _plan(spark, sf)


@query
def index_prune(spark, sf):
    d = docs_index(spark, sf)
    return indexing.delete_files(d, d.filter("doc_id % 11 = 0").select("file_path")).groupBy("scope").agg(F.count(F.lit(1)).alias("chunks"))


@query
def index_upsert(spark, sf):
    d = docs_index(spark, sf)
    fresh = d.filter("doc_id % 7 = 0").withColumn("text", F.upper("lang") if "lang" in d.columns else F.lit("new"))
    return indexing.upsert(_stored(d), fresh).select("file_path", "file_hash", "scope", F.length("text").cast("long").alias("n_chars"))


@query
def index_run_counters(spark, sf):
    d = docs_index(spark, sf)
    plan = _plan(spark, sf)
    changed = d.join(plan.filter("status IN ('new', 'changed')").select("file_path"), "file_path", "left_semi")
    return indexing.run_counters(plan, chunking.chunk_lines(changed.drop("chunk_idx"), size=3))


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    d = docs_index(spark, sf_dir).select("file_path", "file_hash", "model", "chunk_idx", "scope", "doc_id")
    edited = F.sha2(F.concat(F.lit("edit"), F.col("doc_id").cast("string")), 256)
    base = d.filter("doc_id % 4 <> 1")
    current = d.filter("doc_id % 6 <> 0").withColumn("file_hash", F.when(F.col("doc_id") % 10 == 2, edited).otherwise(F.col("file_hash")))
    other = d.filter("doc_id % 9 <> 0").withColumn("file_hash", F.when(F.col("doc_id") % 10 == 3, edited).otherwise(F.col("file_hash")))
    return base, current, other


@query
def index_merge_union(spark, sf):
    a, c, o = (x.withColumn("side", F.lit(n)) for x, n in zip(_versions(spark, sf), ("ancestor", "current", "other"), strict=True))
    keys = ("file_path", "file_hash", "model", "chunk_idx")
    return indexing.merge_union(c, o, a, keys=keys).select("doc_id", "file_hash", "side")


@query
def index_merge_three_way(spark, sf):
    return indexing.merge_three_way(*_versions(spark, sf)).select("doc_id", "file_path", "file_hash")


@query
def export_sorted(spark, sf):
    d = docs_index(spark, sf)
    return indexing.export(d.select("file_path", "chunk_idx", "doc_id"), indexing.file_table(d)).select("doc_id", "file_path", "chunk_idx", "file_hash", "scope")


@query
def file_table_distinct(spark, sf):
    return indexing.file_table(docs_index(spark, sf))


@query
def chunk_lines(spark, sf):
    c = chunking.chunk_lines(table(spark, sf, "documents").select("doc_id", "text"), size=4, overlap=0.25)
    return c.select("doc_id", F.col("chunk_idx").cast("long").alias("chunk_idx"), F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"))


@query
def chunk_markdown(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.regexp_replace(F.concat(F.lit("# A\n## B\n"), "text"), "\n", "\n\n").alias("body"))
    return chunking.chunk_markdown(d).select("doc_id", F.col("chunk_idx").cast("long").alias("chunk_idx"), "heading_path", F.length("text").cast("long").alias("n_chars"))


@query
def code_breadcrumb_parse(spark, sf):
    d = table(spark, sf, "documents").select(F.concat(F.lit("src/"), F.col("source"), F.lit(".py")).alias("path"), "doc_id", F.col("text").alias("t"))
    start, end = (F.col("doc_id") % 90 + 1), (F.col("doc_id") % 90 + 40)
    d = d.withColumn("stored", X.code_stored_text(X.language(F.col("path")), F.col("path"), start, end, F.col("t")))
    p = X.parse_code_hit(F.col("stored"))
    return d.select("doc_id", "stored", *[c.alias(k) for k, c in p.items()])


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as turns; every third conversation's assistant writes a file."""
    c = table(spark, sf_dir, "conversations").filter("role <> 'system'")
    used = F.array(F.struct(F.lit("Write").alias("name"), F.concat(F.lit('{"file_path":"/w/'), F.col("turn").cast("string"), F.lit('.md"}')).alias("input")))
    none = F.array().cast("array<struct<name:string,input:string>>")
    return c.select("conv_id", "turn", "role", "text", F.when((F.col("role") == "assistant") & (F.col("conv_id") % 3 == 0), used).otherwise(none).alias("tool_uses"))


@query
def session_counts(spark, sf):
    return sessions.session_counts(turns(spark, sf), session="conv_id")


@query
def session_gate(spark, sf):
    return sessions.gate(sessions.session_counts(turns(spark, sf), session="conv_id"), min_user_messages=2, long_session=3)


@query
def session_file_writes(spark, sf):
    return sessions.file_writes(turns(spark, sf), session="conv_id")


@query
def session_condense(spark, sf):
    return sessions.condense(turns(spark, sf), session="conv_id", max_turns=2, max_chars=80)


@query
def session_markdown(spark, sf):
    m = sessions.markdown(turns(spark, sf), session="conv_id", max_chars=200)
    return m.select("conv_id", F.sha2(F.encode("markdown", "UTF-8"), 256).alias("markdown_sha256"))


@query
def digest_latest(spark, sf):
    d = sessions.digest(sessions.gate(sessions.session_counts(turns(spark, sf), session="conv_id")), None, "2026-01-02T03:04:05+00:00", session="conv_id")
    return sessions.latest(d, 10).select("conv_id", "file_name")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as ledger entries."""
    e = table(spark, sf_dir, "events")
    model = F.element_at(F.array(*map(F.lit, ("voyage-3.5", "voyage-code-3", "other", "voyage-3.5-lite"))), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select("event_id", "ts", F.col("event_type").alias("source"), F.concat(F.lit("p"), (F.col("user_id") % 5).cast("string")).alias("project"), model.alias("model"), F.coalesce(F.get_json_object("props", "$.k").cast("bigint"), F.lit(0)).alias("tokens"), F.round(F.col("value"), 4).alias("cost_usd"))


@query
def ledger_price(spark, sf):
    return ledger.price(entries(spark, sf)).select("event_id", F.round("cost_usd", 9).alias("cost_usd"))


@query
def ledger_totals(spark, sf):
    return ledger.totals(entries(spark, sf)).withColumn("total_usd", F.round("total_usd", 2))


@query
def ledger_summary_source(spark, sf):
    return ledger.totals_by(entries(spark, sf), "source").withColumn("total_usd", F.round("total_usd", 2))


@query
def ledger_summary_model(spark, sf):
    return ledger.totals_by(entries(spark, sf), "model").withColumn("total_usd", F.round("total_usd", 2))


@query
def ledger_summary_sets(spark, sf):
    return ledger.summary(entries(spark, sf)).withColumn("total_usd", F.round("total_usd", 2))


@query
def ledger_period(spark, sf):
    e = entries(spark, sf)
    now = e.agg(F.max("ts").alias("m")).first().m
    recent = ledger.since(e, "7d", F.lit(now).cast("timestamp_ntz"))
    return ledger.totals_by(recent, "project").withColumn("total_usd", F.round("total_usd", 2))


@query
def ledger_budget(spark, sf):
    return ledger.over_budget(entries(spark, sf), 100.0, ("click", "purchase")).withColumn("spent", F.round("spent", 2))


def ranked_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", "source", "text", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).alias("rank"))


@query
def recall_budget_pack(spark, sf):
    p = recall.pack_budget(ranked_docs(spark, sf), 2000, partition=["source"], body=F.col("text"))
    return p.select("doc_id", "source", F.col("rank").cast("long").alias("rank"), "used")


@query
def recall_scope_counts(spark, sf):
    return recall.scope_counts(vectors(spark, sf), "label")


@query
def state_merge(spark, sf):
    e = table(spark, sf, "events").select((F.col("user_id") % 20).alias("session_id"), F.concat(F.lit("t"), (F.col("event_id") % 13).cast("string")).alias("title"), F.col("event_type").alias("scope"), F.col("value").alias("score"), F.col("event_id").alias("seq"), "props")
    return recall.merge_state(e)


@query
def slugify(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", X.slugify(F.col("text")).alias("slug"))


@query
def slug_near_match(spark, sf):
    p = table(spark, sf, "part")
    names = p.select(X.slugify(F.col("p_name")).alias("slug")).distinct()
    nations = table(spark, sf, "nation").select(X.slugify(F.col("n_name")).alias("slug"))
    cut = table(spark, sf, "nation").select(F.concat(F.substring(F.lower("n_name"), 2, 30), F.lit("x")).alias("slug"))
    return routing.near_slugs(names.unionByName(cut), nations).filter("distance IS NOT NULL").select("slug", "target_slug", F.col("distance").cast("long").alias("distance"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    pick = lambda xs, c: F.element_at(F.array(*map(F.lit, xs)), (c % len(xs) + 1).cast("int"))
    cat = pick(("global_memory", "project_memory", "project_skill", "claude_md_patch", "global_skill", "other"), F.col("event_id"))
    action = pick(("write", "write", "write", "delete", "merge"), F.floor(F.col("event_id") / 6))
    return e.select(
        F.col("event_id").alias("item_no"), cat.alias("category"), action.alias("action"), F.when(F.col("event_id") % 17 == 0, "").otherwise(F.concat(F.lit("Note "), (F.col("event_id") % 40).cast("string"))).alias("title"), F.col("event_type").alias("content"),
        F.when(F.col("event_id") % 2 == 0, F.array(F.concat(F.lit("Note "), (F.col("event_id") % 50).cast("string")))).alias("merge_sources"),
    )


def known(spark: SparkSession) -> DataFrame:
    one = spark.range(60).select(F.explode(F.array(F.lit("global_memory"), F.lit("project_memory"))).alias("category"), F.concat(F.lit("note-"), F.lpad((F.col("id") * 1000).cast("string"), 7, "0")).alias("slug"), F.concat(F.lit("Note "), F.col("id").cast("string")).alias("title"))
    return one


@query
def route_plan(spark, sf):
    p = routing.dispatch(items(spark, sf), known(spark), has_project=True)
    return p.groupBy("category", "status", F.coalesce("reason", F.lit("-")).alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.min("item_no").alias("first_item"))


@query
def route_quota(spark, sf):
    p = routing.dispatch(items(spark, sf), known(spark), has_project=True)
    return p.filter(F.col("reason").startswith("project merge/delete limit")).select("item_no", "title", "status")


@query
def path_route(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.concat(F.lit("/"), F.regexp_replace("url", "^[a-z]+://", "")).alias("file_path"))
    inside: Column = F.when(F.col("file_path").startswith("/m."), F.concat(F.lit("/home/memory"), "file_path")).when(F.col("file_path").startswith("/blog."), F.concat(F.lit("/repo/skills"), "file_path")).otherwise(F.col("file_path"))
    return routing.route_paths(p.withColumn("file_path", inside), {"memory_global": "/home/memory", "skill_project": "/repo/skills"})


@query
def catalog_list(spark, sf):
    d = table(spark, sf, "documents")
    text = F.concat(F.lit("---\ncreated_at: 2026-01-01\ntags: [a, "), F.col("lang"), F.lit("]\ntitle: T\n---\n\n"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("# Head "), F.col("doc_id").cast("string"), F.lit("\n"))).otherwise(""), F.lit("body"))
    rows = d.select("doc_id", F.concat(F.lit("/m/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.lit("global").alias("scope"), text.alias("text"))
    return catalog.catalog(rows).select("slug", "title", F.array_join("tags", ",").alias("tags"), "created_at", F.trim("body").alias("body"))


@query
def catalog_merge(spark, sf):
    # Memories that are merged are few: here each run of 64 ids of a source is one request.
    d = table(spark, sf, "documents").select("source", F.expr("doc_id div 64").alias("request"), F.col("doc_id").alias("pos"), F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("title"), F.array("lang", F.concat(F.lit("m"), (F.col("doc_id") % 3).cast("string"))).alias("tags"), F.col("text").alias("body"))
    m = catalog.merge_groups(d, "source", "request")
    return m.select("source", "request", "title", F.array_join("tags", ",").alias("tags"), F.sha2(F.encode("body", "UTF-8"), 256).alias("body_sha256"), "n_sources")


@query
def content_hashes(spark, sf):
    return indexing.content_hash(table(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))).select("doc_id", "file_hash")


@query
def text_labels(spark, sf):
    e = entries(spark, sf)
    return e.select("event_id", X.token_label(F.col("tokens") * 1000).alias("tokens"), X.cache_key(F.col("project")).alias("key"), X.short_directory(F.concat(F.lit("/home/user/projects/of/"), F.col("project"), F.col("source"))).alias("directory"), X.hit_title(F.array().cast("array<string>"), F.concat(F.lit("/a/"), F.col("source"), F.lit(".md"))).alias("title"))


@query
def code_scan_filter(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.regexp_replace("url", r"\?.*$", "").alias("path"))
    return p.select("page_id", X.suffix(F.col("path")).alias("suffix"), X.language(F.col("path")).alias("language"), X.suffix(F.col("path")).isin(*scans.CODE_SUFFIXES).alias("is_code"))


@query
def transcript_parse(spark, sf):
    c = table(spark, sf, "conversations")
    content = F.when(F.col("turn") % 2 == 0, F.to_json(F.struct(F.col("text").alias("x")))).otherwise(F.to_json(F.struct(F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))).alias("x"))))
    inner = F.regexp_extract(content, r'(?s)^\{"x":(.*)\}$', 1)
    line = F.concat(F.lit('{"type":"'), F.col("role"), F.lit('","sessionId":"s'), F.col("conv_id").cast("string"), F.lit('","message":{"role":"'), F.col("role"), F.lit('","content":'), inner, F.lit("}}"))
    lines = c.select(F.col("conv_id").alias("file"), F.col("turn").alias("line_no"), line.alias("value"))
    t = sessions.parse_events(lines)
    return t.select(F.col("file").alias("conv_id"), "session_id", F.col("turn").cast("long").alias("turn"), "role", F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"))


_COS = "list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[])"
_V = """WITH v AS (SELECT vec_id, embedding, label, ['global','project','skill_global','skill_project','code'][label % 5 + 1] AS scope,
 ['tag' || label, CASE WHEN label % 2 = 0 THEN 'even' ELSE 'odd' END] AS tags FROM embeddings)"""
_TOP = f"SELECT vec_id, round({_COS}, 6) AS score FROM v WHERE {{}} ORDER BY {_COS} DESC, vec_id LIMIT 10"
_D = "WITH d AS (SELECT '/memory/' || source || '/' || doc_id || '.md' AS file_path, sha256(text) AS file_hash, lang AS scope, 'm1' AS model, CAST(doc_id % 3 AS INT) AS chunk_idx, doc_id, text FROM documents)"
_S = _D + ", s AS (SELECT file_path, CASE WHEN doc_id % 7 = 0 THEN sha256('old' || doc_id) ELSE file_hash END AS file_hash, scope, doc_id, text FROM d WHERE doc_id % 5 <> 0)"
_PLAN = _S + """, p AS (SELECT coalesce(a.file_path, s.file_path) AS file_path, a.file_hash AS seen_hash, s.file_hash AS stored_hash,
 CASE WHEN a.file_path IS NULL THEN 'pruned' WHEN s.file_path IS NULL THEN 'new' WHEN a.file_hash = s.file_hash THEN 'unchanged' ELSE 'changed' END AS status
 FROM (SELECT * FROM d WHERE doc_id % 11 <> 0) a FULL JOIN s ON a.file_path = s.file_path)"""
_LINES = """l AS (SELECT {id}, string_split(CASE WHEN ends_with(text, chr(10)) THEN text[:-2] ELSE text END, chr(10)) AS x FROM {t} WHERE text <> ''),
 w AS (SELECT {id}, x, unnest(range(0, len(x), {step})) AS s FROM l),
 c AS (SELECT {id}, s + 1 AS start_line, least(s + {size}, len(x)) AS end_line, array_to_string(x[s + 1:s + {size}], chr(10)) AS text FROM w WHERE s = 0 OR s + {over} < len(x)),
 k AS (SELECT *, row_number() OVER (PARTITION BY {id} ORDER BY start_line) - 1 AS chunk_idx FROM c WHERE regexp_replace(text, '\\s', '', 'g') <> '')"""
_VERSIONS = _D + """, h AS (SELECT file_path, file_hash, model, chunk_idx, scope, doc_id FROM d),
 a AS (SELECT * FROM h WHERE doc_id % 4 <> 1),
 c AS (SELECT * REPLACE (CASE WHEN doc_id % 10 = 2 THEN sha256('edit' || doc_id) ELSE file_hash END AS file_hash) FROM h WHERE doc_id % 6 <> 0),
 o AS (SELECT * REPLACE (CASE WHEN doc_id % 10 = 3 THEN sha256('edit' || doc_id) ELSE file_hash END AS file_hash) FROM h WHERE doc_id % 9 <> 0)"""
_TURNS = "WITH t AS (SELECT conv_id, turn, role, text, role = 'assistant' AND conv_id % 3 = 0 AS wrote, trim(replace(text, '[tool_result]', ''), ' ' || chr(10) || chr(9) || chr(13)) <> '' AND role = 'user' AS real FROM conversations WHERE role <> 'system')"
_COUNTS = _TURNS + """, n AS (SELECT conv_id, count_if(real) AS n_user_messages, CAST(count_if(wrote) AS BIGINT) AS n_file_writes,
 coalesce(bool_and(CASE WHEN real THEN regexp_matches(trim(text), '(?i)^commit( this)?$|^push( this)?$|^run tests?$|^fix the typo$') END), false) AS all_trivial FROM t GROUP BY conv_id)"""
_E = """WITH e AS (SELECT event_id, ts, event_type AS source, 'p' || (user_id % 5) AS project, ['voyage-3.5','voyage-code-3','other','voyage-3.5-lite'][event_id % 4 + 1] AS model,
 coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS tokens, round(value, 4) AS cost_usd FROM events)"""
_SUM = "count(*) AS count, CAST(sum(tokens) AS BIGINT) AS total_tokens, round(round(sum(cost_usd), 4), 2) AS total_usd"
_SLUG = "coalesce(nullif(left(regexp_replace(lower(trim(regexp_replace({}, '[^a-zA-Z0-9\\s-]', '', 'g'), ' ' || chr(10) || chr(9) || chr(13))), '[\\s-]+', '-', 'g'), 60), ''), 'item')"

ORACLE_SQL: dict[str, str] = {
    "vector_topk": f"{_V} " + _TOP.format("true"),
    "vector_topk_scoped": f"{_V} " + _TOP.format("scope IN ('project', 'skill_project', 'skill_global')").replace("SELECT vec_id,", "SELECT vec_id, scope,", 1),
    "vector_topk_tags": f"{_V} " + _TOP.format("list_has_any(tags, ['even', 'tag3'])"),
    "vector_topk_tags_like": f"{_V} " + _TOP.format("scope <> 'code' AND (tags[1] LIKE '%g1%' OR tags[2] LIKE '%g1%' OR tags[1] LIKE '%%3%' OR tags[2] LIKE '%%3%')"),
    "vector_topk_batch": """SELECT query_id, vec_id, round(s, 6) AS score, rank FROM (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s,
 row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 12) DESC, e.vec_id) AS rank
 FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0) WHERE rank <= 5""",
    "vector_merge_stores": f"{_V} " + _TOP.format("true"),
    "vector_overfetch_rerank": f"""{_V}, f AS (SELECT vec_id, tags, {_COS} AS c FROM v ORDER BY c DESC, vec_id LIMIT 15),
 r AS (SELECT vec_id, c, (CASE WHEN list_contains(tags, 'even') THEN 1 ELSE 0 END + CASE WHEN list_contains(tags, 'tag3') THEN 1 ELSE 0 END) / 2.0::DOUBLE AS s FROM f)
 SELECT vec_id, round(s, 6)::DOUBLE AS score FROM r ORDER BY s DESC, c DESC, vec_id LIMIT 5""",
    "vector_norms": f"SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, round(list_inner_product(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[]), 6) AS dot, round({_COS}, 6) AS cosine FROM embeddings",
    "index_stats": _D + " SELECT scope, count(DISTINCT file_path) AS files, count(file_path) AS chunks, CAST(grouping(scope) AS INT) AS is_total FROM d GROUP BY GROUPING SETS ((), (scope))",
    "index_chunks_per_file": _D + ", " + _LINES.format(id="file_path", t="d", step=3, size=3, over=0) + " SELECT file_path, count(*) AS n_chunks FROM k GROUP BY file_path",
    "index_change_plan": _PLAN + " SELECT file_path, seen_hash, stored_hash, status FROM p",
    "index_prune": _D + " SELECT scope, count(*) AS chunks FROM d WHERE doc_id % 11 <> 0 GROUP BY scope",
    "index_upsert": _S + " SELECT file_path, file_hash, scope, CAST(length(text) AS BIGINT) AS n_chars FROM s WHERE doc_id % 7 <> 0 UNION ALL SELECT file_path, file_hash, scope, 3 FROM d WHERE doc_id % 7 = 0",
    "index_run_counters": _PLAN + ", g AS (SELECT d.* FROM d JOIN p ON d.file_path = p.file_path AND p.status IN ('new', 'changed')), " + _LINES.format(id="file_path", t="g", step=3, size=3, over=0)
    + " SELECT count_if(status <> 'pruned') AS files_seen, count_if(status IN ('new', 'changed')) AS files_embedded, count_if(status = 'unchanged') AS files_skipped, count_if(status = 'pruned') AS files_deleted, (SELECT count(*) FROM k) AS chunks_upserted FROM p",
    "index_merge_union": _VERSIONS + """ SELECT doc_id, file_hash, side FROM (SELECT *, row_number() OVER (PARTITION BY file_path, file_hash, model, chunk_idx ORDER BY r) AS n FROM
 (SELECT *, 'current' AS side, 0 AS r FROM c UNION ALL SELECT *, 'other', 1 FROM o UNION ALL SELECT *, 'ancestor', 2 FROM a)) WHERE n = 1""",
    "index_merge_three_way": _VERSIONS + """, f AS (SELECT DISTINCT file_path FROM h),
 j AS (SELECT f.file_path, CASE WHEN c.file_hash IS DISTINCT FROM a.file_hash THEN 'c' WHEN o.file_hash IS DISTINCT FROM a.file_hash THEN 'o' ELSE 'c' END AS side
 FROM f LEFT JOIN c USING (file_path) LEFT JOIN o USING (file_path) LEFT JOIN a USING (file_path))
 SELECT c.doc_id, c.file_path, c.file_hash FROM c JOIN j USING (file_path) WHERE side = 'c' UNION ALL SELECT o.doc_id, o.file_path, o.file_hash FROM o JOIN j USING (file_path) WHERE side = 'o'""",
    "export_sorted": _D + " SELECT doc_id, file_path, chunk_idx, file_hash, scope FROM d ORDER BY file_path, chunk_idx",
    "file_table_distinct": _D + " SELECT DISTINCT file_path, file_hash, scope FROM d",
    "chunk_lines": "WITH " + _LINES.format(id="doc_id", t="documents", step=3, size=4, over=1) + " SELECT doc_id, chunk_idx, start_line, end_line, sha256(text) AS text_sha256 FROM k",
    "code_breadcrumb_parse": """SELECT doc_id, '[py] ' || source || '.py:' || (doc_id % 90 + 1) || '-' || (doc_id % 90 + 40) || chr(10) || chr(10) || text AS stored, 'py' AS language,
 CAST(doc_id % 90 + 1 AS INT) AS start_line, CAST(doc_id % 90 + 40 AS INT) AS end_line, text AS body FROM documents""",
    "session_counts": _COUNTS + " SELECT * FROM n",
    "session_gate": _COUNTS + """ SELECT *, CASE WHEN n_user_messages < 2 OR all_trivial OR (n_file_writes = 0 AND n_user_messages < 3) THEN 'skip' ELSE 'run' END AS decision,
 CASE WHEN n_user_messages < 2 OR all_trivial THEN 'trivial' WHEN n_file_writes = 0 AND n_user_messages < 3 THEN 'discussion' WHEN n_file_writes > 0 THEN 'implementation' ELSE 'discussion' END AS category,
 CASE WHEN n_user_messages < 2 THEN 'only ' || n_user_messages || ' user messages (min=2)' WHEN all_trivial THEN 'all user messages matched skip patterns'
 WHEN n_file_writes = 0 AND n_user_messages < 3 THEN 'no file writes and short session (likely Q&A)' ELSE n_user_messages || ' user messages, ' || n_file_writes || ' file writes' END AS reason FROM n""",
    "session_file_writes": _TURNS + " SELECT conv_id, turn, '/w/' || turn || '.md' AS path FROM t WHERE wrote",
    "session_condense": _TURNS + """, r AS (SELECT *, trim(text, ' ' || chr(10) || chr(9) || chr(13)) AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, count(*) OVER (PARTITION BY conv_id) AS k FROM t WHERE real)
 SELECT conv_id, string_agg('- ' || CASE WHEN length(x) > 80 THEN left(x, 80) || ' [...]' ELSE x END, chr(10) ORDER BY turn) || CASE WHEN any_value(k) > 2 THEN chr(10) || '- [' || (any_value(k) - 2) || ' more messages omitted]' ELSE '' END AS condensed FROM r WHERE n <= 2 GROUP BY conv_id""",
    "session_markdown": _TURNS + """, r AS (SELECT *, trim(text, ' ' || chr(10) || chr(9) || chr(13)) AS x FROM t),
 b AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN '## USER' ELSE '## ASSISTANT' END || chr(10) || CASE WHEN x <> '' THEN chr(10) || CASE WHEN length(x) > 200 THEN left(x, 200) || chr(10) || '[…truncated…]' ELSE x END ELSE '' END
 || CASE WHEN wrote THEN chr(10) || chr(10) || '_tools: Write(file_path=/w/' || turn || '.md)_' ELSE '' END || chr(10) AS y FROM r WHERE x <> '' OR wrote)
 SELECT conv_id, sha256(string_agg(y, chr(10) ORDER BY turn)) AS markdown_sha256 FROM b GROUP BY conv_id""",
    "digest_latest": _TURNS + " SELECT conv_id, '2026-01-02T030405-' || left(CAST(conv_id AS VARCHAR), 8) || '.md' AS file_name FROM (SELECT DISTINCT conv_id FROM t) ORDER BY file_name DESC LIMIT 10",
    "ledger_price": _E + " SELECT event_id, round(tokens * CASE model WHEN 'voyage-3.5' THEN 0.06 WHEN 'voyage-code-3' THEN 0.18 WHEN 'voyage-3.5-lite' THEN 0.02 ELSE 0.06 END::DOUBLE / 1e6, 9) AS cost_usd FROM e",
    "ledger_totals": _E + f" SELECT {_SUM} FROM e",
    "ledger_summary_source": _E + f" SELECT source, {_SUM} FROM e GROUP BY source ORDER BY source",
    "ledger_summary_model": _E + f" SELECT model, {_SUM} FROM e GROUP BY model ORDER BY model",
    "ledger_summary_sets": _E + f" SELECT CASE WHEN grouping(source) + grouping(model) = 2 THEN 'total' WHEN grouping(source) = 0 THEN 'source' ELSE 'model' END AS kind, coalesce(source, model) AS key, {_SUM} FROM e GROUP BY GROUPING SETS ((), (source), (model))",
    "ledger_period": _E + f" SELECT project, {_SUM} FROM e WHERE ts >= (SELECT max(ts) FROM e) - INTERVAL 7 DAYS GROUP BY project ORDER BY project",
    "ledger_budget": _E + " SELECT round(coalesce(sum(cost_usd), 0), 2) AS spent, coalesce(sum(cost_usd), 0) >= 100 AS exceeded FROM e WHERE source IN ('click', 'purchase')",
    "recall_budget_pack": """WITH r AS (SELECT doc_id, source, length(text) AS b, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents),
 s AS (SELECT *, CAST(30 + sum(b + 1) OVER (PARTITION BY source ORDER BY rank) AS BIGINT) AS used FROM r) SELECT doc_id, source, rank, used FROM s WHERE rank = 1 OR used - 1 <= 8000""",
    "recall_scope_counts": f"{_V} SELECT label, count(*) AS n_hits, count_if(contains(scope, 'skill')) AS n_skills, count_if(NOT contains(scope, 'skill')) AS n_memories FROM v GROUP BY label",
    "state_merge": "SELECT user_id % 20 AS session_id, 't' || (event_id % 13) AS title, event_type AS scope, round(max(value), 3) AS score, min(event_id) AS seq, arg_min(props, event_id) AS props FROM events GROUP BY ALL",
    "slugify": f"SELECT doc_id, {_SLUG.format('text')} AS slug FROM documents",
    "slug_near_match": f"""WITH w AS (SELECT DISTINCT {_SLUG.format('p_name')} AS slug FROM part UNION SELECT lower(n_name)[2:31] || 'x' FROM nation), n AS (SELECT DISTINCT {_SLUG.format('n_name')} AS e FROM nation),
 m AS (SELECT slug, e, levenshtein(slug, e) AS distance, row_number() OVER (PARTITION BY slug ORDER BY levenshtein(slug, e), e) AS r FROM w, n WHERE levenshtein(slug, e) <= 3) SELECT slug, e AS target_slug, distance FROM m WHERE r = 1""",
    "route_quota": """WITH i AS (SELECT event_id, CASE WHEN event_id % 17 = 0 THEN '' ELSE 'Note ' || (event_id % 40) END AS title, row_number() OVER (ORDER BY event_id) AS r FROM events
 WHERE event_id % 6 = 1 AND ['write','write','write','delete','merge'][CAST(floor(event_id / 6) AS BIGINT) % 5 + 1] IN ('delete', 'merge')) SELECT event_id AS item_no, title, 'skipped' AS status FROM i WHERE r > 5""",
    "path_route": """WITH p AS (SELECT page_id, '/' || regexp_replace(url, '^[a-z]+://', '') AS f FROM pages), q AS (SELECT page_id, CASE WHEN starts_with(f, '/m.') THEN '/home/memory' || f WHEN starts_with(f, '/blog.') THEN '/repo/skills' || f ELSE f END AS file_path FROM p)
 SELECT page_id, file_path, CASE WHEN starts_with(file_path, '/home/memory/') THEN 'memory_global' WHEN starts_with(file_path, '/repo/skills/') THEN 'skill_project' END AS kind,
 CASE WHEN starts_with(file_path, '/home/memory/') THEN 'global' WHEN starts_with(file_path, '/repo/skills/') THEN 'skill_project' END AS scope FROM q""",
    "catalog_list": "SELECT CAST(doc_id AS VARCHAR) AS slug, CASE WHEN doc_id % 2 = 0 THEN 'Head ' || doc_id ELSE 'T' END AS title, 'a,' || lang AS tags, '2026-01-01' AS created_at, CASE WHEN doc_id % 2 = 0 THEN '# Head ' || doc_id || chr(10) ELSE '' END || 'body' AS body FROM documents",
    "catalog_merge": """WITH d AS (SELECT source, doc_id // 64 AS request, doc_id, trim(text, ' ' || chr(10) || chr(9) || chr(13) || chr(11) || chr(12)) AS b, lang FROM documents),
 g AS (SELECT source, request, unnest([lang, 'm' || (doc_id % 3)]) AS tag FROM d), t AS (SELECT source, request, string_agg(tag, ',' ORDER BY tag) AS tags FROM (SELECT DISTINCT source, request, tag FROM g) GROUP BY source, request)
 SELECT d.source, d.request, 'Doc ' || min(doc_id) AS title, any_value(t.tags) AS tags, sha256(coalesce(string_agg(nullif(b, ''), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY doc_id), '')) AS body_sha256, count(*) AS n_sources
 FROM d JOIN t ON d.source = t.source AND d.request = t.request GROUP BY d.source, d.request""",
    "content_hashes": "SELECT doc_id, sha256(text) AS file_hash FROM documents",
    "text_labels": _E + """ SELECT event_id, CASE WHEN tokens * 1000 >= 1000000 THEN printf('%.1fM', tokens / 1e3) WHEN tokens * 1000 >= 1000 THEN printf('%.1fk', tokens * 1.0) ELSE CAST(tokens * 1000 AS VARCHAR) END AS tokens, left(sha256(project), 16) AS key,
 CASE WHEN length('/home/user/projects/of/' || project || source) > 30 THEN '...' || right('/home/user/projects/of/' || project || source, 27) ELSE '/home/user/projects/of/' || project || source END AS directory, source AS title FROM e""",
    "code_scan_filter": """WITH p AS (SELECT page_id, regexp_extract(regexp_replace(url, '\\?.*$', ''), '[^/]*$') AS n FROM pages), q AS (SELECT page_id, lower(regexp_extract(n, '.(\\.[^.]+)$', 1)) AS suffix FROM p)
 SELECT page_id, suffix, CASE WHEN suffix = '' THEN 'text' ELSE suffix[2:] END AS language, suffix IN ('.html', '.php', '.js', '.json', '.css', '.m', '.r', '.c') AS is_code FROM q""",
    "transcript_parse": "SELECT conv_id, 's' || conv_id AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, role, sha256(CASE WHEN turn % 2 = 1 THEN trim(text, ' ' || chr(10) || chr(9) || chr(13)) ELSE text END) AS text_sha256 FROM conversations WHERE role <> 'system'",
}

from . import details, versions, writes  # noqa: E402, F401  more queries and SQL in the same tables
