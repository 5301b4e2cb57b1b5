"""The corpus pipeline, stage by stage, and the registered queries on small tables."""

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from tessera.llm import queries  # noqa: E402


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n, last = docs.count(), docs
    assert [k for k, _ in pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "mixing"]
    for i, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, last, sf).cache()
        assert out.count() <= n and out.select("doc_id").distinct().count() == out.count()
        if i < 4:
            assert sorted(out.columns) == sorted(docs.columns)
            n, last = out.count(), out
    assert 0 < out.filter("copies > 0").count() and out.count() == n < docs.count()


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, sf, name):
    df = queries.queries()[name](spark, sf)
    cols = sorted(df.columns)
    rows = sorted(str(tuple(f"{r[c]:.9g}" if isinstance(r[c], float) else r[c] for c in cols)) for r in df.collect())
    if name not in queries.oracle_sql():
        assert rows or name == "op9_secret_scan"  # the smallest tables hold no secret
        return
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    cur = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    assert rows == sorted(str(tuple(f"{r[names.index(c)]:.9g}" if isinstance(r[names.index(c)], float) else r[names.index(c)] for c in cols)) for r in cur.fetchall())
