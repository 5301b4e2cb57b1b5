import json
import os
import time

from pyspark.sql import functions as F

from tessera.schema import CHUNKS
from tessera.sources.store import VectorStore
from tessera.streaming import maintenance as M


def feed(spark, path, name, rows):
    path.mkdir(exist_ok=True)
    (path / name).write_text("\n".join(json.dumps(r) for r in rows))
    os.utime(path / name, (1_700_000_000 + int(name[0]),) * 2)  # files are taken in this order


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(path))


def drain(query):
    assert query.awaitTermination(60)


def test_index_edits(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "store"), dim=1, model="m")
    made = []

    def chunker(changed):
        made.append(changed.count())
        values = {"index_name": F.lit("memory"), "chunk_idx": F.lit(0), "heading_path": F.array(), "scope": F.lit("global"), "tags": F.array(), "model": F.lit("m"), "embedding": F.array(F.lit(1.0)), "indexed_at": F.current_timestamp()}
        return changed.select([values.get(f.name, F.col(f.name) if f.name in changed.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in CHUNKS]).filter("text IS NOT NULL")

    schema = "file_path string, text string, version int"
    for name, rows in (("1", [("a", "x", 1), ("a", "y", 2), ("b", "z", 1)]), ("2", [("a", "y", 3), ("b", None, 2), ("c", "n", 1)])):
        feed(spark, tmp_path / "in", f"{name}.json", [dict(zip(("file_path", "text", "version"), r, strict=True)) for r in rows])
        q = M.index_edits(stream(spark, tmp_path / "in", schema), store, chunker, str(tmp_path / "ck"))
        q.awaitTermination(120)
    assert sorted((r.file_path, r.text) for r in store.read().collect()) == [("a", "y"), ("c", "n")]
    assert made == [2, 1]  # what is unchanged isn't chunked again


def test_session_state(spark, tmp_path):
    schema = "session_id string, title string, scope string, score double"
    feed(spark, tmp_path / "in", "1.json", [dict(session_id="s", title="A", scope="global", score=0.5), dict(session_id="s", title="B", scope="skill_global", score=0.1)])
    feed(spark, tmp_path / "in", "2.json", [dict(session_id="s", title="A", scope="global", score=0.9)])
    q = M.session_state(stream(spark, tmp_path / "in", schema)).writeStream.format("memory").queryName("state").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).start()
    end = time.time() + 60  # a stream with time-outs is never idle
    while time.time() < end and q.isActive and spark.table("state").filter("n_hits = 2").count() < 1:
        time.sleep(0.5)
    q.stop()
    rows = spark.table("state").collect()
    assert {(r.n_hits, r.n_skills, r.n_memories, r.expired) for r in rows} == {(2, 1, 1, False)}


def test_windows(spark, tmp_path):
    t = lambda m: f"2026-01-01T{m // 60:02d}:{m % 60:02d}:00"
    feed(spark, tmp_path / "in", "1.json", [dict(session_id="s", ts=t(0), role="user"), dict(session_id="s", ts=t(5), role="assistant")])
    feed(spark, tmp_path / "in", "2.json", [dict(session_id="s", ts=t(120), role="user")])
    feed(spark, tmp_path / "in", "3.json", [dict(session_id="z", ts=t(121), role="user")])
    feed(spark, tmp_path / "in", "4.json", [dict(session_id="s", ts=t(1), role="user")])  # too late
    q = M.closed_sessions(stream(spark, tmp_path / "in", "session_id string, ts timestamp, role string"), gap="30 minutes", delay="10 minutes").writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    drain(q)
    assert [(r.session_id, r.n_user_messages, r.n_turns) for r in spark.table("closed").collect()] == [("s", 1, 2)]


def test_costs(spark, tmp_path):
    schema = "ts timestamp, source string, cost_usd double, tokens long"
    feed(spark, tmp_path / "in", "1.json", [dict(ts=f"2026-01-0{d}T10:00:00", source="index", cost_usd=0.5, tokens=10) for d in (1, 1, 5)])
    q = M.daily_costs(stream(spark, tmp_path / "in", schema), delay="1 hour").writeStream.format("memory").queryName("daily").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    drain(q)
    assert [(str(r.day), r.cost_usd, r.tokens, r.n) for r in spark.table("daily").collect()] == [("2026-01-01", 1.0, 20, 2)]
    q = M.running_spend(stream(spark, tmp_path / "in", schema)).writeStream.format("memory").queryName("spend").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    drain(q)
    assert spark.table("spend").first().spent == 1.5
