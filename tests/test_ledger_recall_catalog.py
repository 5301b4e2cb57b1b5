import json
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from tessera.operators import catalog, ledger, recall
from tessera.plans import queries as plans
from tessera.schema import LEDGER
from tessera.sources.files import read_ledger


def entries(spark, *rows):
    return spark.createDataFrame([tuple(r.get(k) for k in LEDGER.fieldNames()) for r in rows], LEDGER)


def test_summary(spark):
    e = entries(spark, *[dict(zip(("source", "model", "tokens", "cost_usd"), x, strict=True)) for x in (("index", "voyage-3.5", 1000, 0.06), ("index", "voyage-code-3", 2000, 0.36), ("dream", "haiku", 500, 0.01))])
    assert ledger.totals(e).first().asDict() == {"count": 3, "total_tokens": 3500, "total_usd": 0.43}
    assert {r.source: r.total_usd for r in ledger.totals_by(e, "source").collect()} == {"index": 0.42, "dream": 0.01}
    s = {(r.kind, r.key): r.total_usd for r in ledger.summary(e).collect()}
    assert s[("total", None)] == 0.43 and s[("source", "index")] == 0.42 and s[("model", "haiku")] == 0.01
    assert ledger.totals(e.limit(0)).first().asDict() == {"count": 0, "total_tokens": 0, "total_usd": 0.0}
    tiny = entries(spark, *[{"cost_usd": c} for c in (0.00001, 0.00002, 0.00003)], {})
    assert ledger.totals(tiny).first().total_usd == pytest.approx(0.0001) and ledger.totals_by(tiny, "source").first().source == "unknown"


def test_read_price_period_budget(spark):
    now = datetime(2026, 1, 31, tzinfo=UTC)
    raw = [json.dumps({"ts": "2026-01-30T00:00:00+00:00", "source": "dream", "model": "m", "tokens": 1, "cost_usd": 2.0}), "", "{bad", json.dumps({"ts": "never", "source": "index", "tokens": 5}), json.dumps({"ts": "2025-12-01T00:00:00+00:00", "source": "dream", "cost_usd": 3.0})]
    e = read_ledger(spark.createDataFrame([(x,) for x in raw], "value string"))
    assert e.count() == 3 and ledger.since(e, "30d", now).count() == 1 and ledger.since(e, "all", now).count() == 3
    with pytest.raises(ValueError):
        ledger.since(e, "2d", now)
    assert ledger.over_budget(e, 5.0).first().exceeded and not ledger.over_budget(e, 5.1).first().exceeded and not ledger.over_budget(e, None).first().exceeded
    p = ledger.price(entries(spark, {"model": "voyage-code-3", "tokens": 1_000_000}, {"model": "x", "tokens": 1_000_000}))
    assert {r.model: r.cost_usd for r in p.collect()} == {"voyage-code-3": 0.18, "x": 0.06}
    assert ledger.entry(spark, source="index", cost_usd=0.12345678).first().cost_usd == 0.123457
    r = ledger.agent_usage(spark.createDataFrame([(json.dumps({"total_cost_usd": 0.1, "usage": {"input_tokens": 3, "output_tokens": 4, "cache_read_input_tokens": 5}}),), ("?",)], "report string")).collect()
    assert [(x.tokens, x.cost_usd) for x in r] == [(12, 0.1), (0, 0.0)]
    assert ledger.display(entries(spark, {"ts": "2026-01-02T03:04:05", "tokens": 2000, "cost_usd": 0.5}), "2026-01-02").first().asDict() == {"time": "03:04", "source": None, "project": "global", "model": None, "tokens": "2.0k", "cost": "$0.5000"}


def test_pack_budget_is_the_loop(spark):
    import random

    r = random.Random(2)
    for budget in (0, 5, 30, 80):
        sizes = [r.randint(0, 60) for _ in range(12)]
        hits = spark.createDataFrame([(i + 1, "x" * n) for i, n in enumerate(sizes)], "rank int, text string")
        used, want = 30, []
        for i, n in enumerate(sizes):
            if want and used + n > budget * 4:
                break
            want.append(i + 1)
            used += n + 1
        assert [x["rank"] for x in recall.pack_budget(hits, budget).orderBy("rank").collect()] == want


def test_state(spark):
    h = spark.createDataFrame([("s", "A", "global", 0.5, 1, "auto"), ("s", "A", "global", 0.91239, 2, "search"), ("s", "B", "skill_project", 0.1, 3, "auto")], "session_id string, title string, scope string, score double, seq int, source string")
    m = {r.title: (r.score, r.seq, r.source) for r in recall.merge_state(h).collect()}
    assert m == {"A": (0.912, 1, "auto"), "B": (0.1, 3, "auto")}
    assert recall.scope_counts(recall.merge_state(h), "session_id").first().asDict() == {"session_id": "s", "n_hits": 2, "n_skills": 1, "n_memories": 1}
    s = spark.sql("SELECT 1 AS k, TIMESTAMP'2026-01-01 00:00:00' AS updated_at")
    assert recall.expire_state(s, F.expr("TIMESTAMP'2026-01-02 00:00:00'")).count() == 1 and recall.expire_state(s, F.expr("TIMESTAMP'2026-01-02 00:00:01'")).count() == 0
    ev = [{"prompt": " hi "}, {"prompt": " ", "userPrompt": "b"}, {"hookInput": {"prompt": "c"}}, {"payload": {"text": "d"}}, {}]
    assert [r.prompt for r in recall.prompt_text(spark.createDataFrame([(json.dumps(x),) for x in ev] + [("bad",)], "event string")).collect()] == ["hi", "b", "c", "d", "", ""]
    hits = spark.createDataFrame([("q", 1, "/h/a.md", 0.5, "global", " t ")], "q string, rank int, file_path string, score double, scope string, text string")
    assert "### 1. ~/a.md" in recall.render(hits, partition=["q"], home="/h").first().block


def test_catalog(spark):
    files = [
        ("/m/a.md", "global", "---\ncreated_at: 2026-01-01\ntags: [x, 'y']\ntitle: Other\n---\n\n# Head\nbody"), ("/m/b.md", "global", "---\ntitle: \"Quoted\"\ntags:\n  - p\n  - q\n---\ntext"),
        ("/p/c.md", "project", "no front"), ("/p/a.md", "project", ""), ("/p/d.md", "project", None),
    ]
    c = catalog.catalog(spark.createDataFrame(files, "path string, scope string, text string"))
    got = {r.path: (r.slug, r.title, list(r.tags), r.created_at) for r in c.collect()}
    assert got["/m/a.md"] == ("a", "Head", ["x", "y"], "2026-01-01") and got["/m/b.md"] == ("b", "Quoted", ["p", "q"], "") and got["/p/c.md"] == ("c", "c", [], "") and got["/p/d.md"][1] == "d"
    assert catalog.find(c, "a").first().scope == "global" and catalog.find(c, "a", "project").first().path == "/p/a.md" and catalog.find(c, "zz").first() is None
    assert catalog.move(c, "c", "global").filter("slug = 'c'").first().scope == "global"
    m = catalog.merge(c, ["b", "a"], title="New One")
    r = m.filter("slug = 'new-one'").first()
    assert (r.scope, list(r.tags), r.body.split("\n\n---\n\n"), m.count()) == ("global", ["p", "q", "x", "y"], ["text", "# Head\nbody"], 4)
    with pytest.raises(ValueError):
        catalog.merge(c, ["a"])
    with pytest.raises(ValueError):
        catalog.merge(c, ["a", "none"])
    assert catalog.title_block(c, 1).first().block == '  - "Head"\n  - … and 4 more' and catalog.title_block(c.limit(0)).first().block == "  (none)"


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_expiry_counts_fractions_of_seconds(spark, kind):
    s = spark.createDataFrame([(1, "2026-01-01 00:00:00.999999"), (2, "2026-01-01 00:00:00.000001"), (3, "2026-01-01 00:00:00"), (4, None)], "k int, t string").select("k", F.col("t").cast(kind).alias("updated_at"))
    now = F.lit("2026-01-01 01:00:00.000001").cast(kind)
    assert sorted(r.k for r in recall.expire_state(s, now, max_age=3600).collect()) == [1, 2]


def test_expiry_across_a_change_of_clocks(spark, tmp_path):
    """Times without a zone are as the tables write them, whatever the zone's clocks did."""
    spark.sql("SELECT * FROM VALUES (1, TIMESTAMP_NTZ'2024-03-31 01:30:00'), (2, TIMESTAMP_NTZ'2024-03-31 03:15:00.5'), (3, TIMESTAMP_NTZ'2024-03-31 02:15:00.25') AS t(user_id, ts)").write.parquet(f"{tmp_path}/events.parquet")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        assert [r.user_id for r in plans.QUERIES["state_expiry"](spark, str(tmp_path)).collect()] == [2]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
