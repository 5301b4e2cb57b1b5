"""More registered queries: one for each small operator, with its SQL beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import catalog, indexing, ledger, recall, routing, search, sessions
from .queries import ORACLE_SQL, QUERIES, docs_index, entries, first_vector, table, turns, vectors

_COS = "list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[])"


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE sha256(text) END AS file_hash FROM documents")
def hash_or_empty(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 5 != 0, F.encode("text", "UTF-8")).alias("content"))
    return indexing.content_hash(d).select("doc_id", "file_hash")


@query("""WITH s AS (SELECT '/memory/' || source || '/' || doc_id || '.md' AS file_path, sha256(text) AS h, doc_id, lang FROM documents)
 SELECT file_path, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE h END AS seen_hash, CASE WHEN lang = 'en' THEN h END AS stored_hash,
 CASE WHEN doc_id % 3 = 0 THEN 'pruned' WHEN lang <> 'en' THEN 'new' ELSE 'unchanged' END AS status FROM s WHERE doc_id % 3 <> 0 OR lang = 'en'""")
def index_change_plan_scope(spark, sf):
    """Stored paths by scope."""
    d = docs_index(spark, sf)
    return indexing.change_plan(d.filter("doc_id % 3 <> 0"), d, scope="en")


@query("""SELECT count(*) * 2 AS files_seen, count(*) * 2 AS files_embedded, 0::BIGINT AS files_skipped, 0::BIGINT AS files_deleted, count(*) * 2 AS chunks_upserted FROM documents""")
def index_merge_counters(spark, sf):
    d = docs_index(spark, sf)
    runs = [indexing.run_counters(indexing.change_plan(d, d.limit(0)), d) for _ in range(2)]
    return indexing.merge_counters(*runs)


def code_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as stored chunks of code and of memories."""
    v = vectors(spark, sf_dir)
    path = F.concat(F.lit("/src/f"), F.col("vec_id").cast("string"), F.lit(".py"))
    stored = X.code_stored_text(X.language(path), path, F.lit(1), F.col("label") + 1, F.concat(F.lit("body "), F.col("vec_id").cast("string")))
    return v.select(path.alias("file_path"), F.lit(0).alias("chunk_idx"), "embedding", "scope", "tags", stored.alias("text"))


_CODE = f"""WITH c AS (SELECT '/src/f' || vec_id || '.py' AS file_path, 'py' AS language, 1 AS start_line, label + 1 AS end_line, round({_COS}, 6) AS score, 'body ' || vec_id AS text, label % 5 AS s, {_COS} AS x FROM embeddings)"""


@query(_CODE + " SELECT file_path, language, start_line, end_line, score, text FROM c WHERE s = 4 ORDER BY x DESC, file_path LIMIT 20")
def code_topk(spark, sf):
    """Code search, with a k beyond the bound."""
    return search.search_code(code_hits(spark, sf), first_vector(spark, sf), 50, ties=("file_path",)).withColumn("score", F.round("score", 6))


@query(_CODE + """, m AS (SELECT 'memory' AS kind, file_path, score, x FROM c WHERE s IN (0, 2) ORDER BY x DESC, file_path LIMIT 6), k AS (SELECT 'code' AS kind, file_path, score, x FROM c WHERE s = 4 ORDER BY x DESC, file_path LIMIT 6)
 SELECT kind, file_path, score FROM (SELECT * FROM m UNION ALL SELECT * FROM k) ORDER BY x DESC, file_path LIMIT 8""")
def memory_and_code_topk(spark, sf):
    v, q = code_hits(spark, sf), first_vector(spark, sf)
    return search.union_hits(search.top_k(v, q, 6, scope="global", ties=("file_path",)), search.search_code(v, q, 6, ties=("file_path",)), 8).select("kind", "file_path", F.round("score", 6).alias("score"))


@query("SELECT '{\"vec_id\":' || vec_id || ',\"label\":' || label || '}' AS hit FROM embeddings")
def hit_json(spark, sf):
    return search.hits_json(table(spark, sf, "embeddings").select("vec_id", "label"))


def tool_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as JSON of tool calls."""
    e = table(spark, sf_dir, "events")
    name = F.when(F.col("event_id") % 3 == 0, "Edit").when(F.col("event_id") % 3 == 1, "MultiEdit").otherwise("Read")
    path = lambda c: F.concat(F.lit("/w/"), c.cast("string"), F.lit(".py"))
    edit = lambda c: F.struct(path(c).alias("file_path"))
    given = F.struct(path(F.col("user_id")).alias("file_path"), F.array(edit(F.col("event_id") % 7), edit(F.col("user_id"))).alias("edits"))
    return e.select("event_id", F.to_json(F.struct(name.alias("tool_name"), given.alias("tool_input"))).alias("event"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 2 THEN '' WHEN event_id % 7 = user_id THEN '/w/' || user_id || '.py' ELSE '/w/' || user_id || '.py,/w/' || (event_id % 7) || '.py' END AS paths FROM events""")
def tool_paths(spark, sf):
    """Writing tools only; each path once, in order."""
    return sessions.edited_paths(tool_events(spark, sf)).select("event_id", F.array_join("paths", ",").alias("paths"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'ask ' || conv_id WHEN turn % 3 = 1 THEN 'nested ' || turn ELSE '' END AS prompt, CASE WHEN turn % 3 = 2 THEN 'empty prompt' END AS skip_reason FROM conversations""")
def prompt_events(spark, sf):
    """The prompt out of an event, outer fields first, and why it recalls nothing."""
    c = table(spark, sf, "conversations")
    ask, nested = F.concat(F.lit("ask "), F.col("conv_id").cast("string")), F.concat(F.lit("nested "), F.col("turn").cast("string"))
    outer = F.when(F.col("turn") % 3 == 0, F.concat(F.lit(" "), ask)).otherwise("  ")
    inner = F.when(F.col("turn") % 3 != 2, nested).otherwise("")
    event = F.to_json(F.struct(outer.alias("prompt"), F.struct(inner.alias("prompt")).alias("hookInput")))
    return recall.skip_reason(recall.prompt_text(c.select("conv_id", "turn", event.alias("event")))).drop("event")


@query("SELECT conv_id, turn FROM conversations WHERE role = 'user' AND regexp_replace(text, '\\s', '', 'g') <> ''")
def session_user_turns(spark, sf):
    return sessions.user_turns(turns(spark, sf)).select("conv_id", "turn")


@query("""SELECT page_id, 'Home > p' || page_id || chr(10) || chr(10) || 'b' AS breadcrumb, '[html] p' || page_id || '.html:1-' || (page_id % 9 + 1) || chr(10) || 'b' AS embed_text,
 '~/d/p' || page_id || '.html' AS short_path, '| ok | p' || page_id || ' |  |' AS row FROM pages""")
def page_labels(spark, sf):
    p = table(spark, sf, "pages")
    name = F.concat(F.lit("p"), F.col("page_id").cast("string"))
    path = F.concat(F.lit("/home/u/d/"), name, F.lit(".html"))
    return p.select(
        "page_id", X.breadcrumb(F.array(F.lit("Home"), name), F.lit("b")).alias("breadcrumb"), X.code_embed_text(X.language(path), path, F.lit(1), F.col("page_id") % 9 + 1, F.lit("b")).alias("embed_text"),
        X.short_path(path, "/home/u").alias("short_path"), X.table_row(F.lit("ok"), name, F.lit(None).cast("string")).alias("row"),
    )


@query("""SELECT vec_id, chr(10) || '### ' || (label + 1) || '. /f  ' || chr(10) || '_score=' || printf('%.3f', label / 8.0) || ' scope=global_' || chr(10) || chr(10) AS header, left('line ' || vec_id, 6) AS first FROM embeddings""")
def hit_headers(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", X.hit_header(F.col("label") + 1, F.lit("/f"), F.col("label") / F.lit(8.0), F.lit("global")).alias("header"), X.first_line(F.concat(F.lit("  line "), F.col("vec_id").cast("string"), F.lit("\nmore")), 6).alias("first"))


@query("""SELECT event_id, CASE WHEN strftime(ts, '%Y-%m-%d') = (SELECT strftime(min(ts), '%Y-%m-%d') FROM events) THEN strftime(ts, '%H:%M') ELSE strftime(ts, '%Y-%m-%d') END AS label, left(event_type, 4) AS preview FROM events""")
def time_labels(spark, sf):
    e = table(spark, sf, "events")
    today = str(e.agg(F.min("ts").alias("t")).first().t)[:10]
    return e.select("event_id", X.time_label(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), today).alias("label"), X.preview(F.col("event_type"), 4).alias("preview"))


@query("""SELECT doc_id, '---' || chr(10) || 'created_at: ' || CASE WHEN doc_id % 4 = 0 THEN 'old' ELSE 'now' END || chr(10) || 'updated_at: now' || chr(10) || 'scope: ' || lang || chr(10) || '---' || chr(10) || chr(10) || '# T' || doc_id || chr(10) || chr(10) || 'c' || chr(10) AS file FROM documents""")
def memory_files(spark, sf):
    """The file of a memory; a memory that exists keeps its time of creation."""
    d = table(spark, sf, "documents").select("doc_id", "lang", F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("slug"))
    old = d.filter("doc_id % 4 = 0").select("slug", F.lit("old").alias("created_at"))
    p = routing.kept_creation(d, old, "now")
    text = routing.memory_text(F.concat(F.lit("T"), F.col("doc_id").cast("string")), F.lit(" c "), F.col("created_at"), F.col("updated_at"), [("scope", F.col("lang"))])
    return p.select("doc_id", text.alias("file"))


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'head' || chr(10) || '<s>' || chr(10) || 'old' || chr(10) || '<!-- appended d -->' || chr(10) || lang || chr(10) || '<e>' || chr(10)
 ELSE 'head' || chr(10) || chr(10) || '<s>' || chr(10) || '<!-- appended d -->' || chr(10) || lang || chr(10) || '<e>' || chr(10) END AS text FROM documents""")
def marker_blocks(spark, sf):
    d = table(spark, sf, "documents")
    text = F.when(F.col("doc_id") % 2 == 0, "head\n<s>\nold\n<e>\n").otherwise("head\n \n")
    return d.select("doc_id", routing.append_block(text, F.col("lang"), "d", "<s>", "<e>").alias("text"))


@query("SELECT event_id, event_id % 2 = 0 AS should_persist, CASE WHEN event_id % 3 = 0 THEN event_type ELSE '' END AS summary, CASE WHEN event_id % 2 = 0 THEN 'T' || event_id ELSE '' END AS titles FROM events")
def agent_payloads(spark, sf):
    """Items out of an agent's report; structured output before a text that holds JSON."""
    e = table(spark, sf, "events")
    item = F.array(F.struct(F.lit("global_memory").alias("category"), F.concat(F.lit("T"), F.col("event_id").cast("string")).alias("title")))
    body = F.to_json(F.struct((F.col("event_id") % 2 == 0).alias("should_persist"), F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("summary"), F.when(F.col("event_id") % 2 == 0, item).alias("items")))
    report = F.when(F.col("event_id") % 4 < 2, F.concat(F.lit('{"structured_output":'), body, F.lit(',"result":"no"}'))).otherwise(F.to_json(F.struct(body.alias("result"))))
    p = sessions.payload(e.select("event_id", report.alias("report")))
    return p.select("event_id", "should_persist", "summary", F.array_join(F.transform("items", lambda x: x["title"]), ",").alias("titles"))


@query("SELECT event_id, CAST(event_id % 100 + 2 * user_id + 5 AS BIGINT) AS tokens, event_id % 8 / 4.0 AS cost_usd FROM events")
def agent_usages(spark, sf):
    e = table(spark, sf, "events")
    usage = F.struct((F.col("event_id") % 100).alias("input_tokens"), (F.col("user_id") * 2).alias("output_tokens"), F.lit(5).alias("cache_read_input_tokens"))
    return ledger.agent_usage(e.select("event_id", F.to_json(F.struct(usage.alias("usage"), (F.col("event_id") % 8 / 4.0).alias("total_cost_usd"))).alias("report"))).select("event_id", "tokens", "cost_usd")


@query("SELECT event_id FROM events WHERE event_type = 'click'")
def ledger_of_source(spark, sf):
    return ledger.of_source(entries(spark, sf), "click").select("event_id")


@query("SELECT event_id, event_type AS source, 'p' || (user_id % 5) AS project, printf('$%.4f', (event_id % 1000) / 16.0) AS cost FROM events")
def ledger_display(spark, sf):
    # The model column is shown as it is, so it carries the entry's number.
    e = entries(spark, sf).withColumn("cost_usd", F.col("event_id") % 1000 / 16.0).withColumn("ts", F.col("ts").cast("string"))
    shown = ledger.display(e.withColumn("model", F.col("event_id").cast("string")), "2020-01-01")
    return shown.select(F.col("model").cast("long").alias("event_id"), "source", "project", "cost")


@query("SELECT user_id, max(ts) AS updated_at FROM events GROUP BY user_id HAVING epoch((SELECT max(ts) FROM events)) - epoch(max(ts)) <= 3600")
def state_expiry(spark, sf):
    e = table(spark, sf, "events")
    now = e.agg(F.max("ts").alias("now"))  # one row
    state = e.groupBy("user_id").agg(F.max("ts").alias("updated_at")).crossJoin(F.broadcast(now))
    return recall.expire_state(state, F.col("now"), max_age=3600).drop("now")


@query("SELECT CAST(count(*) AS BIGINT) AS n, step FROM (SELECT conv_id, CASE WHEN count_if(role = 'user' AND regexp_replace(text, '\\s', '', 'g') <> '') < 2 THEN 'digest' ELSE 'over_budget' END AS step FROM conversations WHERE role <> 'system' GROUP BY conv_id) GROUP BY step")
def session_steps(spark, sf):
    """What happens at the end of each session once the budget is spent."""
    counts = sessions.session_counts(turns(spark, sf), session="conv_id", patterns=())
    gated = sessions.gate(counts, min_user_messages=2, long_session=2)
    spent = ledger.over_budget(entries(spark, sf), 0.0, ("click",))
    return sessions.session_plan(gated, spent, session="conv_id").groupBy("step").agg(F.count(F.lit(1)).alias("n"))


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as a catalog of memories."""
    d = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("m"), F.lpad(F.col("doc_id").cast("string"), 8, "0"))
    return d.select(F.when(F.col("doc_id") % 2 == 0, "global").otherwise("project").alias("scope"), F.concat(F.lit("m"), (F.col("doc_id") % 7).cast("string")).alias("slug"), name.alias("title"), F.concat(F.lit("/m/"), name, F.lit(".md")).alias("path"))


@query("SELECT '/m/m' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || '.md' AS path, 'm' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS title FROM documents ORDER BY doc_id LIMIT 50")
def catalog_titles(spark, sf):
    return catalog.titles(memories(spark, sf))


@query("""SELECT string_agg('  - "m' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || '"', chr(10) ORDER BY doc_id) || chr(10) || '  - … and ' || ((SELECT count(*) FROM documents) - 30) || ' more' AS block FROM (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 30)""")
def catalog_title_block(spark, sf):
    return catalog.title_block(memories(spark, sf))


@query("SELECT 'global' AS scope, 'm3' AS slug, '/m/m' || lpad(CAST(min(doc_id) AS VARCHAR), 8, '0') || '.md' AS path FROM documents WHERE doc_id % 7 = 3 AND doc_id % 2 = 0")
def catalog_find(spark, sf):
    return catalog.find(memories(spark, sf), "m3").select("scope", "slug", "path")


@query("SELECT CASE WHEN doc_id % 7 = 1 THEN 'project' WHEN doc_id % 2 = 0 THEN 'global' ELSE 'project' END AS scope, count(*) AS n FROM documents WHERE NOT (doc_id % 7 = 2 AND doc_id % 2 = 0) GROUP BY 1")
def catalog_move_and_remove(spark, sf):
    m = memories(spark, sf)
    gone = spark.createDataFrame([("global", "m2")], "scope string, slug string")
    return catalog.move(catalog.remove(m, gone), "m1", "project").groupBy("scope").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH n AS (SELECT n_nationkey, lower(replace(replace(n_name, '_', ''), ' ', '-')) AS slug, n_name FROM nation)
 SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN n_name WHEN n_nationkey % 3 = 1 THEN n_name || 'x' ELSE 'Nothing like it at all' END AS title, CASE WHEN n_nationkey % 3 < 2 THEN slug END AS found_slug FROM n""")
def route_titles(spark, sf):
    """The memory that a title means: its slug or one near it; none for others."""
    n = table(spark, sf, "nation")
    cat = n.select(X.slugify(F.col("n_name")).alias("slug"), F.col("n_name").alias("title"))
    third = F.col("n_nationkey") % 3
    asked = n.select("n_nationkey", F.when(third == 0, F.col("n_name")).when(third == 1, F.concat("n_name", F.lit("x"))).otherwise("Nothing like it at all").alias("title"))
    return routing.resolve_titles(asked, cat).select("n_nationkey", "title", "found_slug")
