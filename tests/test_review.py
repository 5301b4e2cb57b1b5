"""Plans carried out, with crashes in between, and reviews from gate to digest with a made-up reviewer."""

import json
from pathlib import Path

import pytest

from tessera.api import Memory
from tessera.functions.embed import HashingEmbedder
from tessera.operators import review
from tessera.schema import ITEMS

NOW = "2026-01-02T03:04:05+00:00"


def item(no, category, title, content="body", action="write", tags=None, sources=None):
    return (no, category, action, title, content, "why", tags, sources)


def items(spark, *rows):
    return spark.createDataFrame(list(rows), ITEMS)


@pytest.fixture
def memory(spark, tmp_path):
    (tmp_path / "p").mkdir()
    return Memory(spark, str(tmp_path / "h"), project_root=str(tmp_path / "p"), embedder=HashingEmbedder(dim=8))


def outcome(records):
    return sorted((r.item_no, r.part, r.status, r.path.rsplit("/", 1)[-1]) for r in records.collect())


def contents(root):
    return {str(p.relative_to(root)): p.read_text() for p in Path(root).rglob("*.md")}


def test_items_become_files(spark, memory):
    got = memory.carry_out(
        items(
            spark, item(1, "global_memory", "Commit style", tags=["git"]), item(2, "project_memory", "Layout", "use grid"), item(3, "project_skill", "Deploy it", "run make"), item(4, "claude_md_patch", "Note", "first"),
            item(5, "claude_md_patch", "Note", "second"), item(6, "nonsense", "x"), item(7, "global_skill", "x"), item(8, "global_memory", "", "x"),
        ), "r1", now=NOW,
    )
    assert [x[2] for x in outcome(got)] == ["written", "written", "written", "appended", "appended", "skipped", "skipped", "skipped"]
    home, project = Path(memory.root), Path(memory.project_root)
    text = (home / "memory/commit-style.md").read_text()
    assert text.startswith(f"---\ncreated_at: {NOW}\nupdated_at: {NOW}\ncategory: global_memory\nsource: review\ntags: [\"git\"]\n---\n\n# Commit style\n\nbody\n")
    assert "name: Deploy it\n" in (project / ".tessera/skills/deploy-it/SKILL.md").read_text()
    notes = (project / "CLAUDE.md").read_text()
    assert notes.index("first") < notes.index("second") and notes.count("tessera:notes:start") == 1
    assert memory.store.read().select("file_path").distinct().count() == 3  # indexed, the notes aren't
    # Again: the file is replaced, its creation stays, near titles mean the same file, notes grow.
    later = "2026-02-02T00:00:00+00:00"
    memory.carry_out(items(spark, item(1, "global_memory", "Commit styles", "new"), item(2, "project_skill", "Deploy its", "other"), item(3, "claude_md_patch", "n", "third")), "r2", now=later)
    assert {p.name for p in (home / "memory").iterdir()} == {"commit-style.md"}
    text = (home / "memory/commit-style.md").read_text()
    assert f"created_at: {NOW}\nupdated_at: {later}" in text and text.endswith("# Commit styles\n\nnew\n")
    assert (project / ".tessera/skills/deploy-it/SKILL.md").read_text().endswith("other\n")
    notes = (project / "CLAUDE.md").read_text()
    assert notes.count("tessera:notes:start") == 1 and notes.index("second") < notes.index("third")


def test_merges_and_deletions(spark, memory):
    memory.carry_out(items(spark, *[item(i, "project_memory", t) for i, t in enumerate(("Alpha one", "Beta two", "Gamma three", "Delta four"))]), "r1", now=NOW)
    got = memory.carry_out(
        items(
            spark, item(1, "project_memory", "Alpha one", "both", "merge", sources=["Alpha one", "Beta two", "Nothing such"]), item(2, "project_memory", "Gamma three", "", "delete"), item(3, "project_memory", "No such", "", "delete"),
            item(4, "project_memory", "x", "y", "merge", sources=[]), item(5, "global_memory", "x", "", "merge", sources=["a"]),
        ), "r2", now=NOW,
    )
    assert [(x[0], x[2]) for x in outcome(got)] == [(1, "merged"), (1, "merge_source_deleted"), (1, "skipped"), (2, "deleted"), (3, "skipped"), (4, "skipped"), (5, "skipped")]
    assert set(contents(f"{memory.project_root}/.tessera/memory")) == {"alpha-one.md", "delta-four.md"}
    assert {r.file_path.rsplit("/", 1)[-1] for r in memory.store.files().collect()} == {"alpha-one.md", "delta-four.md"}


def test_no_project(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "h"), embedder=HashingEmbedder(dim=8))
    got = m.carry_out(items(spark, item(1, "project_memory", "a"), item(2, "claude_md_patch", "a"), item(3, "global_memory", "a")), "r", now=NOW)
    assert [x[2] for x in outcome(got)] == ["skipped", "skipped", "written"]


@pytest.mark.parametrize("at", [2])
def test_a_run_that_is_cut_off_ends_the_same(spark, tmp_path, at):
    """Killed before its n-th effect and repeated, with another clock and other items at hand: the files are those of a run that was not."""
    ends = []
    for cut in (None, at):
        root = tmp_path / str(cut)
        (root / "p").mkdir(parents=True)
        m = Memory(spark, str(root / "h"), project_root=str(root / "p"), embedder=HashingEmbedder(dim=8))
        m.carry_out(items(spark, item(1, "project_memory", "Old one"), item(2, "project_memory", "Old two")), "r0", now=NOW)
        wanted = items(spark, item(1, "project_memory", "Old one", "sum", "merge", sources=["Old two"]), item(2, "global_memory", "Fresh"), item(3, "claude_md_patch", "n", "note"), item(4, "project_skill", "Skill s"))
        if cut is None:
            m.carry_out(wanted, "r1", now=NOW)
        else:
            seen = []

            def stop(effect, seen=seen, cut=cut):
                if len(seen) == cut:
                    raise KeyboardInterrupt
                seen.append(effect.path)

            with pytest.raises(KeyboardInterrupt):
                m.carry_out(wanted, "r1", now=NOW, before=stop)
            assert "old-two.md" in contents(root / "p/.tessera/memory")  # sources go last
            again = []
            m.carry_out(wanted.limit(0), "r1", now="2027-01-01T00:00:00+00:00", before=lambda e, again=again: again.append(e.path))
            assert not set(seen) & set(again) and len(seen) + len(again) == 5
        ends.append((contents(root / "h/memory"), contents(root / "p")))
    assert ends[0] == ends[1]


def event(role, text, **more):
    return json.dumps({"type": role, "message": {"role": role, "content": text}} | more)


def log(spark, **files):
    rows = [(f, i, e) for f, es in files.items() for i, e in enumerate(es)]
    return spark.createDataFrame(rows, "file string, line_no int, value string")


def work(n, session):
    wrote = [{"type": "tool_use", "name": "Write", "input": {"file_path": "/w/a.py"}}]
    return [*(event("user", f"please do part {i} of it", sessionId=session, cwd="/w") for i in range(n)), event("assistant", wrote, sessionId=session)]


def report(*titles, persist=True, cost=0.25):
    body = {"should_persist": persist, "summary": "Fine.", "items": [{"category": "global_memory", "title": t, "content": "x", "rationale": "r"} for t in titles]}
    return json.dumps({"structured_output": body, "total_cost_usd": cost, "usage": {"input_tokens": 10, "output_tokens": 5}})


def test_review_from_gate_to_digest(spark, memory, tmp_path):
    calls = tmp_path / "calls"
    good, no = report("Some rule"), report("Unused", persist=False)

    def call(prompt):
        with open(calls, "a") as f:
            f.write("c\n")
        assert "# Context" in prompt and "# Session" in prompt
        if "part 5" in prompt:
            raise RuntimeError("simulated timeout")
        return no if "part 4" in prompt else good

    events = log(spark, a=work(4, "sess-a"), b=work(1, "sess-b"), c=work(5, "sess-c"), d=work(6, "sess-d"))
    out = {r.file: r for r in memory.run_reviews(events, call, "n1", now=NOW, retries=1, pause=0.0).collect()}
    assert {f: (r.decision, r.step) for f, r in out.items()} == {"a": ("run", "review"), "b": ("skip", "digest"), "c": ("run", "review"), "d": ("run", "review")}
    assert (out["a"].n_items, out["a"].n_records, out["c"].n_records, out["c"].should_persist) == (1, 1, 0, False)
    assert "simulated timeout" in out["d"].error and out["a"].error is None and out["b"].error is None
    assert {p.name for p in Path(memory.root, "memory").iterdir()} == {"some-rule.md"}
    digest = {f: Path(r.digest).read_text() for f, r in out.items()}
    assert "Some rule" in digest["a"] and "Fine." in digest["c"] and "simulated timeout" in digest["d"] and "_Not reviewed._" in digest["b"] and "session_id: sess-b" in digest["b"]
    assert len({r.digest for r in out.values()}) == 4  # equal names get a number
    n = len(calls.read_text().split())
    assert n == 4  # d twice
    again = {r.file: r for r in memory.run_reviews(events, call, "n1", now="later").collect()}
    assert again == out and len(calls.read_text().split()) == n
    assert memory.costs(spark.read.text(f"{memory.root}/costs"), "all").filter("kind = 'total'").first().total_usd == 0.5


def test_force_and_judge(spark, memory, tmp_path):
    calls = tmp_path / "calls"
    good = report()

    def call(prompt):
        with open(calls, "a") as f:
            f.write("c\n")
        return good

    talk = [event("user", f"what about {i}, in general?") for i in range(7)]
    out = memory.run_reviews(log(spark, t=talk), call, "n1", judge=lambda text: (False, "small talk")).first()
    assert (out.decision, out.reason, out.n_records) == ("skip", "small talk", 0) and not calls.exists()
    out = memory.run_reviews(log(spark, t=talk[:1]), call, "n2", force=True).first()
    assert (out.decision, out.category, out.reason) == ("run", "manual", "forced via manual trigger") and calls.exists()
    assert memory.run_reviews(log(spark, t=[event("user", "x")]).limit(0), call, "n3").count() == 0


def test_replies_are_kept_wave_by_wave(spark, tmp_path):
    """The third wave is cut off; the next run asks those sessions only, and errors again if told to."""
    calls, stop = tmp_path / "calls", tmp_path / "stop"
    stop.touch()

    def call(prompt):
        with open(calls, "a") as f:
            f.write(f"{prompt}\n")
        if prompt == "p3" and stop.exists():
            raise ValueError("no")
        return f"r {prompt}"

    asked = spark.createDataFrame([(f"s{i}", f"p{i}") for i in range(20)] + [("s0", "p0")], "session_id string, prompt string")
    got = {r.session_id: r for r in review.ask(asked, call, str(tmp_path / "kept"), wave=4, tasks=2, retries=0).collect()}
    assert len(got) == 20 and got["s3"].error == "ValueError: no" and all(r.report == f"r p{s[1:]}" for s, r in got.items() if s != "s3")
    assert sorted(calls.read_text().split()) == sorted(f"p{i}" for i in range(20))
    (tmp_path / "kept/wave=000002/_SUCCESS").unlink()  # as if the job had been killed
    lost = spark.read.parquet(str(tmp_path / "kept/wave=000002")).count()
    calls.unlink()
    assert review.ask(asked, call, str(tmp_path / "kept"), wave=4, tasks=2, retries=0).count() == 20
    assert 0 < len(calls.read_text().split()) == lost < 20
    stop.unlink()
    calls.unlink()
    got = {r.session_id: r.report for r in review.ask(asked, call, str(tmp_path / "kept"), again=True).collect()}
    assert got["s3"] == "r p3" and calls.read_text() == "p3\n"
