"""Every registered query with SQL against DuckDB on the same tables, and all others on rows alone."""

import math

import pytest

import __spark_entry__ as entry
from tessera.plans import queries as plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, sf, duck, name):
    df = plans.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    if name not in plans.ORACLE_SQL:
        assert got
        return
    cur = duck.execute(plans.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert got == want


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["vec_id", "scope", "score"]


def test_slugify_reads_whole_texts(spark, tmp_path):
    spark.createDataFrame([(1, "é" * 250 + " Late Words")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [r.slug for r in plans.QUERIES["slugify"](spark, str(tmp_path)).collect()] == ["late-words"]
