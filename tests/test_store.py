"""The store's deltas, compaction, racing writers, branches and merges, against a plain dict of files."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from tessera.schema import CHUNKS
from tessera.sources import shared
from tessera.sources.store import ConflictError, VectorStore, merge_tables


def chunks(spark, files, n=2):
    """Rows of files (path -> hash), ``n`` chunks each."""
    rows = [("memory", p, h, i, f"{p}{h}{i}", [], "global", [], "m", [1.0], None) for p, h in files.items() for i in range(n)]
    return spark.createDataFrame(rows, CHUNKS)


def paths(spark, names):
    return spark.createDataFrame([(n,) for n in names], "file_path string")


def held(store, version=None):
    rows = store.read(version).collect()
    out = {r.file_path: r.file_hash for r in rows}
    assert len(rows) == 2 * len(out) and {(r.file_path, r.file_hash) for r in store.files(version).collect()} == set(out.items())
    return out


def parts(root):
    return {str(p.relative_to(root)) for p in root.rglob("*.parquet")}


def test_an_edit_writes_its_bucket_only(spark, tmp_path):
    s = VectorStore(spark, str(tmp_path), dim=1, model="m", buckets=4)
    s.write(chunks(spark, {f"f{i}": "1" for i in range(40)}))
    before = parts(tmp_path)
    size = sum((tmp_path / p).stat().st_size for p in before)
    s.upsert(chunks(spark, {"f7": "2"}))
    fresh = parts(tmp_path) - before
    assert before <= parts(tmp_path) and len({p.split("_bucket=")[1].split("/")[0] for p in fresh}) == 1 and len(fresh) == 2
    assert sum((tmp_path / p).stat().st_size for p in fresh) < size
    assert held(s) == {f"f{i}": "2" if i == 7 else "1" for i in range(40)}
    plan = s.read().filter("scope = 'global'")._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "EqualTo(scope,global)" in plan


def test_random_edits_equal_a_dict(spark, tmp_path):
    rng, s, want, seen = random.Random(4), VectorStore(spark, str(tmp_path), dim=1, model="m", buckets=3, most_segments=4), {}, {}
    for step in range(12):
        names = rng.sample([f"f{i}" for i in range(12)], 3)
        kind = rng.choice(["upsert", "upsert", "delete", "compact", "write"] if step > 3 else ["upsert"])
        if kind == "upsert":
            new = {n: f"h{step}" for n in names}
            s.upsert(chunks(spark, new))
            want |= new
        elif kind == "delete":
            assert s.delete(paths(spark, names)) == 2 * len(set(names) & set(want))
            want = {k: v for k, v in want.items() if k not in names}
        elif kind == "compact":
            s.compact({rng.randrange(3)})
        else:
            want = {n: f"h{step}" for n in names}
            s.write(chunks(spark, want))
        assert held(s) == want
        seen[s.manifest()["version"]] = dict(want)
    some = rng.choice(sorted(seen))
    assert held(s, some) == seen[some]  # older versions stay as they were
    s.compact()
    assert held(s) == want and not s._shared(s.manifest())
    s.vacuum(keep=1)
    assert held(s) == want and len(s.versions()) == 1
    live = {x["id"] for x in s.manifest()["segments"]}
    assert {p.split("_seg=")[1].split("/")[0] for p in parts(tmp_path)} <= live


def test_racing_writers(spark, tmp_path):
    """Writers of different files all get through, whatever the order; of one that read an old version of a file, an error remains."""
    VectorStore(spark, str(tmp_path), dim=1, model="m", buckets=2).write(chunks(spark, {"a": "1", "b": "1"}))
    failed = []

    def run(name):
        try:
            VectorStore(spark, str(tmp_path), dim=1, model="m").upsert(chunks(spark, {name: "2"}))
        except Exception as error:  # noqa: BLE001
            failed.append(error)

    threads = [threading.Thread(target=run, args=(n,)) for n in ("a", "b", "c", "d")]
    [t.start() for t in threads]
    [t.join() for t in threads]
    s = VectorStore(spark, str(tmp_path), dim=1, model="m")
    assert not failed and held(s) == dict.fromkeys("abcd", "2")
    old = s.manifest()["version"]
    s.upsert(chunks(spark, {"a": "3"}))
    before = parts(tmp_path)
    with pytest.raises(ConflictError):
        s.upsert(chunks(spark, {"a": "4", "e": "1"}), base=old)
    with pytest.raises(ConflictError):
        s.write(chunks(spark, {"z": "1"}), base=old)
    assert parts(tmp_path) == before  # what lost leaves nothing
    s.upsert(chunks(spark, {"e": "1"}), base=old)
    s.compact()
    s.upsert(chunks(spark, {"f": "1"}), base=old)  # a compaction is no conflict
    assert held(s) == {"a": "3", "b": "2", "c": "2", "d": "2", "e": "1", "f": "1"}


def test_compaction_under_commits(spark, tmp_path):
    """A commit that comes while buckets are compacted stays on top; a second compaction of them gives way."""
    s = VectorStore(spark, str(tmp_path), dim=1, model="m", buckets=1)
    s.write(chunks(spark, {"a": "1", "b": "1"}))
    s.upsert(chunks(spark, {"a": "2"}))
    slow, segment = VectorStore(spark, str(tmp_path), dim=1, model="m"), VectorStore._segment

    def meanwhile(self, *args):
        out = segment(self, *args)
        s.upsert(chunks(spark, {"b": "3"}))
        return out

    slow._segment = meanwhile.__get__(slow)
    assert slow.compact() == [0] and held(s) == {"a": "2", "b": "3"}

    def other_first(self, *args):
        out = segment(self, *args)
        assert s.compact() == [0]
        return out

    slow._segment = other_first.__get__(slow)
    assert slow.compact() == [] and held(s) == {"a": "2", "b": "3"}


def test_exclusive_files(spark, tmp_path):
    at = str(tmp_path / "d" / "x.json")
    assert shared.write_text(spark, at, "one", exclusive=True) and not shared.write_text(spark, at, "two", exclusive=True)
    assert shared.read_text(spark, at) == "one" and shared.write_text(spark, at, "three é") and shared.read_text(spark, at) == "three é"
    assert shared.names_in(spark, str(tmp_path / "d")) == ["x.json"] or all(n.endswith(".crc") or n == "x.json" for n in shared.names_in(spark, str(tmp_path / "d")))


def test_branches_merge(spark, tmp_path):
    main = VectorStore(spark, str(tmp_path), dim=1, model="m", buckets=2)
    main.write(chunks(spark, {n: "1" for n in "abcdef"}))
    side = main.branch("side")
    with pytest.raises(ValueError):
        main.branch("side")
    main.upsert(chunks(spark, {"a": "2", "c": "2"}))
    main.delete(paths(spark, ["d"]))
    side.upsert(chunks(spark, {"b": "3", "c": "3", "g": "3"}))
    side.delete(paths(spark, ["e"]))
    assert held(side) == {"a": "1", "b": "3", "c": "3", "d": "1", "f": "1", "g": "3"}
    with pytest.raises(ConflictError):
        main.merge(side, prefer="error")
    assert main.merge(side) == {"conflicts": 1, "taken": 2, "deleted": 1}
    assert held(main) == {"a": "2", "b": "3", "c": "2", "f": "1", "g": "3"}
    # The merge is the new ancestor: what has come over isn't asked for again.
    side.upsert(chunks(spark, {"f": "4"}))
    assert main.merge(side) == {"conflicts": 0, "taken": 1, "deleted": 0} and held(main)["f"] == "4"
    assert side.merge(main)["conflicts"] == 0 and held(side)["a"] == "2"


def test_branches_without_an_ancestor(spark, tmp_path):
    main = VectorStore(spark, str(tmp_path), dim=1, model="m")
    main.upsert(chunks(spark, {"a": "1", "b": "1"}))
    side = main.branch("side")
    main.upsert(chunks(spark, {"a": "2"}))
    side.upsert(chunks(spark, {"c": "1"}))
    side.delete(paths(spark, ["b"]))
    main.vacuum(keep=1)
    assert main.ancestor(side) is None
    main.merge(side)
    assert held(main) == {"a": "2", "b": "1", "c": "1"}  # nothing counts as deleted
    assert held(side) == {"a": "1", "c": "1"}  # the branch still has its files


def table(spark, path, *hashes):
    rows = [(h, "m", 0, f"text {h}", [0.1]) for h in hashes]
    spark.createDataFrame(rows, "file_hash string, model string, chunk_idx int, text string, embedding array<float>").write.parquet(str(path))
    return str(path)


@pytest.mark.parametrize(("ancestor", "current", "other", "want"), [(["s"], ["s", "2"], ["s", "3"], {"s", "2", "3"}), (None, ["1"], ["2"], {"1", "2"}), (None, ["1"], None, {"1"}), (None, None, ["2"], {"2"})])
def test_merge_tables(spark, tmp_path, ancestor, current, other, want):
    at = {n: table(spark, tmp_path / n, *v) if v else str(tmp_path / n) for n, v in (("a", ancestor), ("c", current), ("o", other))}
    assert merge_tables(spark, at["a"], at["c"], at["o"])
    rows = spark.read.parquet(at["c"]).collect()
    assert {r.file_hash for r in rows} == want and len(rows) == len(want)


def test_merge_no_tables(spark, tmp_path):
    assert not merge_tables(spark, str(tmp_path / "a"), str(tmp_path / "c"), None) and not (tmp_path / "c").exists()
