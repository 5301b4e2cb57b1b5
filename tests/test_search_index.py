import pytest
from pyspark.sql import functions as F

from tessera.functions.embed import lexical_score
from tessera.operators import indexing, search
from tessera.schema import CHUNKS
from tessera.sources.store import VectorStore


def rows(spark, *items):
    """file, scope, tags, embedding, optionally hash, text and number."""
    full = []
    for f, scope, tags, e, *more in items:
        h, text, idx = (list(more) + [f"h-{f}", f"text of {f}", 0][len(more) :])[:3]
        full.append(("memory", f, h, idx, text, [], scope, tags, "m", e, None))
    return spark.createDataFrame(full, CHUNKS)


@pytest.fixture()
def index(spark):
    return rows(
        spark, ("a.md", "global", ["python", "tips"], [1.0, 0.0, 0.0, 0.0]), ("b.md", "project", ["git"], [0.0, 1.0, 0.0, 0.0]), ("c.md", "project", ["github"], [0.5, 0.5, 0.0, 0.0]), ("z.md", "global", None, [0.0, 0.0, 0.0, 0.0])
    )


def paths(df):
    return [r.file_path for r in df.collect()]


def test_top_k(index):
    q = [1.0, 0.0, 0.0, 0.0]
    assert paths(search.top_k(index, q, 2, drop_degenerate=True)) == ["a.md", "c.md"]
    assert paths(search.top_k(index, q, 1)) == ["z.md"]  # NaN sorts first
    assert paths(search.top_k(index, q, 5, scope="project")) == ["c.md", "b.md"]
    assert paths(search.top_k(index, q, 5, tags=["git"])) == ["b.md"]
    assert paths(search.top_k(index, q, 5, tags=["git"], tags_like=True)) == ["c.md", "b.md"]
    assert paths(search.top_k(index, q, 5, tags=["rust"])) == []
    assert paths(search.top_k(index, q, 5, scope="global", tags=["python", "git"])) == ["a.md"]
    assert search.top_k(index.limit(0), q, 5).count() == 0
    assert search.clamp_k(0) == 1 and search.clamp_k(99) == 20
    with pytest.raises(ValueError):
        search.check_dim(q, 3)


def test_batch_is_the_single_query_repeated(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    qs = e.filter("vec_id < 6").select(F.col("vec_id").alias("query_id"), "embedding")
    for block in (4096, 2):
        got = {(r.query_id, r["rank"]): r.vec_id for r in search.top_k_batch(e, qs, 3, block=block).collect()}
        for r in qs.collect():
            want = [x.vec_id for x in search.top_k(e, list(r.embedding), 3, ties=("vec_id",)).collect()]
            assert [got[r.query_id, i] for i in (1, 2, 3)] == want


def test_filters_reach_the_scan(spark, sf, tmp_path, index):
    index.write.parquet(str(tmp_path / "i"))
    plan = search.top_k(spark.read.parquet(str(tmp_path / "i")), [1.0, 0.0, 0.0, 0.0], 3, scope="global").select("file_path", "score")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(scope" in text and "TakeOrderedAndProject" in text and "Exchange" not in text
    assert "heading_path" not in text.split("ReadSchema")[1]


def test_rerank_and_code(spark, index):
    hits = search.search_reranked(index, [1.0, 0.0, 0.0, 0.0], "text b", 2, lexical_score, drop_degenerate=True)
    assert paths(hits)[0] == "b.md"
    code = rows(spark, ("x.py", "code", [], [1.0, 0.0, 0.0, 0.0], "h", "[py] x.py:1-2\n\nprint(1)"))
    r = search.search_code(index.unionByName(code), [1.0, 0.0, 0.0, 0.0]).first()
    assert (r.language, r.start_line, r.end_line, r.text) == ("py", 1, 2, "print(1)")
    both = search.union_hits(search.top_k(index, [1.0, 0.0, 0.0, 0.0], 2, drop_degenerate=True), search.search_code(code, [1.0, 0.0, 0.0, 0.0]), 3)
    assert {r.kind for r in both.collect()} == {"memory", "code"}
    assert '"file_path"' in search.hits_json(both).first().hit


def test_change_plan_and_upsert(spark):
    stored = rows(spark, ("same", "global", [], [1.0], "1"), ("old", "global", [], [1.0], "1"), ("gone", "global", [], [1.0], "1"), ("far", "project", [], [1.0], "1"))
    seen = spark.createDataFrame([("same", "1"), ("old", "2"), ("new", "1"), ("new", "1")], "file_path string, file_hash string")
    plan = indexing.change_plan(seen, indexing.file_table(stored), scope="global")
    assert {r.file_path: r.status for r in plan.collect()} == {"same": "unchanged", "old": "changed", "gone": "pruned", "new": "new"}
    kept = indexing.change_plan(seen, indexing.file_table(stored), scope="global", prune=False)
    assert "gone" not in {r.file_path for r in kept.collect()}
    chunks = rows(spark, ("old", "global", [], [1.0], "2"), ("new", "global", [], [1.0], "1"), ("new", "global", [], [1.0], "1", "t", 1))
    out = indexing.apply_plan(stored, plan, chunks)
    assert sorted((r.file_path, r.file_hash, r.chunk_idx) for r in out.collect()) == [("far", "1", 0), ("new", "1", 0), ("new", "1", 1), ("old", "2", 0), ("same", "1", 0)]
    assert indexing.run_counters(plan, chunks).first().asDict() == {"files_seen": 3, "files_embedded": 2, "files_skipped": 1, "files_deleted": 1, "chunks_upserted": 3}
    emptied = indexing.apply_plan(stored, plan, chunks.filter("file_path = 'new'"))
    assert "old" not in {r.file_path for r in emptied.collect()}
    stats = {r.scope: (r.files, r.chunks) for r in indexing.index_stats(out).collect()}
    assert stats == {None: (4, 5), "global": (3, 4), "project": (1, 1)}


def test_merges(spark):
    v = lambda *x: spark.createDataFrame(list(x), "file_path string, file_hash string, model string, chunk_idx int")
    a, c, o = v(("s", "shared", "m", 0)), v(("s", "shared", "m", 0), ("x", "hash2", "m", 0)), v(("s", "shared", "m", 0), ("x", "hash3", "m", 0))
    assert {r.file_hash for r in indexing.merge_union(c, o, a).collect()} == {"shared", "hash2", "hash3"}
    assert indexing.merge_union(c, o).count() == 3
    base = v(("s", "1", "m", 0), ("d", "1", "m", 0), ("e", "1", "m", 0))
    cur, oth = v(("s", "2", "m", 0), ("e", "1", "m", 0)), v(("s", "3", "m", 0), ("d", "1", "m", 0), ("e", "4", "m", 0), ("n", "1", "m", 0))
    got = {(r.file_path, r.file_hash) for r in indexing.merge_three_way(base, cur, oth).collect()}
    assert got == {("s", "2"), ("e", "4"), ("n", "1")}


def test_store(spark, tmp_path):
    s = VectorStore(spark, str(tmp_path / "s"), dim=4, model="m")
    assert s.read().count() == 0 and s.manifest()["version"] == 0
    s.upsert(rows(spark, ("a", "global", ["t"], [1.0, 0.0, 0.0, 0.0]), ("b", "project", [], [0.0, 1.0, 0.0, 0.0])))
    s.upsert(rows(spark, ("a", "global", ["t"], [0.0, 0.0, 1.0, 0.0], "h2")))
    assert sorted((r.file_path, r.file_hash) for r in s.read().collect()) == [("a", "h2"), ("b", "h-b")]
    assert s.delete(spark.createDataFrame([("b",), ("none",)], "file_path string")) == 1
    assert s.delete(spark.createDataFrame([("none",)], "file_path string")) == 0
    assert s.manifest()["version"] == 3 and s.read().count() == 1
    with pytest.raises(ValueError):
        s.write(rows(spark, ("a", "global", [], [1.0])))
    with pytest.raises(ValueError):
        VectorStore(spark, str(tmp_path / "s"), dim=5, model="m")
    assert VectorStore(spark, str(tmp_path / "s"), dim=4, model="m").read().count() == 1
    assert s.vacuum(keep=1) == ["v=1", "v=2"]
    other = VectorStore(spark, str(tmp_path / "s"), dim=4, model="other")
    assert other.read().count() == 0


def test_batch_search_knows_missing_and_zero_vectors(spark):
    from tessera.operators import search

    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [0.6, 0.8])], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(10, [1.0, 0.0]), (11, None)], "query_id long, embedding array<double>")
    got = sorted(search.top_k_batch(rows, queries, 3).collect(), key=lambda r: r["rank"])
    assert [(r.query_id, r.vec_id) for r in got] == [(10, 3), (10, 1), (10, 4)]
    one = search.top_k(rows, [1.0, 0.0], 3, ties=("vec_id",)).collect()
    assert [r.vec_id for r in one] == [3, 1, 4]
    assert search.top_k_batch(rows, queries.limit(0), 3).count() == 0


def test_batch_search_in_blocks_and_parts(spark):
    """Blocks and parts of a few rows, many ties, one row repeated a hundred times: as by a sort of all pairs, and no job per block."""
    import numpy as np

    from tessera.operators import search

    rng = np.random.default_rng(2)
    v = rng.integers(-1, 2, size=(60, 3)).astype(float)
    v[(v == 0).all(axis=1)] = 1.0
    rows = [(int(i), x.tolist()) for i, x in enumerate(v)] + [(7, v[7].tolist())] * 100
    asked = [(1000 + i, rng.integers(1, 4, size=3).astype(float).tolist()) for i in range(40)]
    index, queries = spark.createDataFrame(rows, "vec_id long, embedding array<double>"), spark.createDataFrame(asked, "query_id long, embedding array<double>")
    cos = lambda a, b: round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 12)
    want = sorted((q, i, n + 1) for q, x in asked for n, (_, i) in enumerate(sorted((-cos(x, y), i) for i, y in rows)[:5]))
    got = search.top_k_batch(index, queries, 5, block=7, part=16)
    assert sorted((r.query_id, r.vec_id, r["rank"]) for r in got.collect()) == want
    plans = [search.top_k_batch(index, queries.limit(n), 5, block=7)._jdf.queryExecution().optimizedPlan().toString().count("\n") for n in (7, 40)]
    assert plans[0] == plans[1]
