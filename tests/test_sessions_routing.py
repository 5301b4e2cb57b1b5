import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import routing, sessions
from tessera.schema import ITEMS


def lines(spark, *events, file="f"):
    rows = [(file, i, e if isinstance(e, str) or e is None else json.dumps(e)) for i, e in enumerate(events)]
    return spark.createDataFrame(rows, "file string, line_no int, value string")


def user(text, **more):
    return {"type": "user", "message": {"role": "user", "content": text}, **more}


def assistant(*blocks):
    return {"type": "assistant", "message": {"role": "assistant", "content": list(blocks)}}


def write(path, name="Write"):
    return {"type": "tool_use", "name": name, "input": {"file_path": path}}


RESULT = {"type": "user", "message": {"role": "user", "content": [{"type": "tool_result", "content": "ok"}]}}


def test_parse_events(spark):
    ev = lines(
        spark, {"type": "summary"}, "", "{bad", user("hello", sessionId="s1", cwd="/w"), assistant({"type": "text", "text": "hi"}, write("/work/a.md")), RESULT, RESULT,
        user("meta", isMeta=True), user("<local-command-caveat>x"), {"type": "user", "sessionId": 5, "message": {"role": "user", "content": None}}, None,
    )
    t = sessions.parse_events(ev).orderBy("turn").collect()
    assert [(r.turn, r.role, r.text) for r in t] == [(0, "user", "hello"), (1, "assistant", "hi"), (2, "user", "[tool_result]"), (3, "user", "[tool_result]"), (4, "user", "")]
    assert {r.session_id for r in t} == {"s1"} and {r.cwd for r in t} == {"/w"}
    turns = sessions.parse_events(ev)
    assert [r.path for r in sessions.file_writes(turns).collect()] == ["/work/a.md"]
    assert sessions.user_turns(turns).count() == 3 and sessions.real_user_turns(turns).count() == 1
    c = sessions.session_counts(turns).first()
    assert (c.n_user_messages, c.n_file_writes, c.all_trivial) == (1, 1, False)
    assert "_tools: Write(file_path=/work/a.md)_" in sessions.markdown(turns).first().markdown
    assert sessions.parse_events(ev.limit(0)).count() == 0


@pytest.mark.parametrize(
    "texts,writes,least,want",
    [
        (["hello"], 0, 3, ("skip", "trivial")),
        (["commit this", "push", "run tests"], 0, 2, ("skip", "trivial")),
        (["a?", "b?", "c?"], 0, 3, ("skip", "discussion")),
        (list("abcdef"), 0, 3, ("run", "discussion")),
        (["a", "b", "c"], 2, 3, ("run", "implementation")),
        (["commit", "real a", "real b"], 1, 3, ("run", "implementation")),
    ],
)
def test_gate(spark, texts, writes, least, want):
    ev = lines(spark, *[user(t) for t in texts], *[assistant(write("/x"))] * writes)
    g = sessions.gate(sessions.session_counts(sessions.parse_events(ev), session="file"), min_user_messages=least).first()
    assert (g.decision, g.category) == want


def test_bad_patterns_are_passed_over(spark):
    assert sessions.valid_patterns(("(", "a")) == ["a"]
    df = spark.createDataFrame([("COMMIT ",)], "t string")
    assert df.select(sessions.matches_any(F.col("t"), ("(", "^commit$")).alias("x")).first().x
    assert not df.select(sessions.matches_any(F.col("t"), ()).alias("x")).first().x


def test_condense_judge_digest(spark):
    ev = lines(spark, *[user("x" * 20 + str(i)) for i in range(7)])
    turns = sessions.parse_events(ev).drop("session_id").withColumnRenamed("file", "session_id")
    c = sessions.condense(turns, max_turns=2, max_chars=5)
    assert c.first().condensed == "- xxxxx [...]\n- xxxxx [...]\n- [5 more messages omitted]"
    g = sessions.gate(sessions.session_counts(turns))
    assert sessions.judge(g, c, lambda t: (False, "nothing")).first().decision == "skip"
    assert sessions.judge(g, c, lambda t: 1 / 0).first().decision == "run"
    assert sessions.judge(g, c, None) is g
    records = spark.createDataFrame([("f", 1, "written", "global_memory", "T", "/p.md", None), ("f", 2, "skipped", "x", "U", "", "why")], "session_id string, record_no int, status string, category string, title string, path string, reason string")
    d = sessions.digest(g, records, "2026-01-02T03:04:05+00:00").first()
    assert d.file_name == "2026-01-02T030405-f.md" and "user_messages: 7" in d.digest
    assert "| written | global_memory | T | `/p.md` |  |" in d.digest and "| skipped | x | U | - | why |" in d.digest
    spent = spark.createDataFrame([(5.0, True)], "spent double, exceeded boolean")
    assert sessions.session_plan(g, spent).first().step == "over_budget"


def test_payload_and_edits(spark):
    item = {"category": "global_memory", "title": "T", "content": "c", "rationale": "r"}
    reports = [json.dumps({"structured_output": {"should_persist": True, "summary": "s", "items": [item]}}), json.dumps({"result": json.dumps({"items": [item]})}), json.dumps({"content": {}}), "nonsense"]
    got = sessions.payload(spark.createDataFrame([(r,) for r in reports], "report string")).collect()
    assert [len(r["items"]) for r in got] == [1, 1, 0, 0] and got[0].should_persist and got[0]["items"][0].title == "T"
    ev = {"tool_name": "MultiEdit", "tool_input": {"file_path": "/a", "edits": [{"file_path": "/b"}, {"file_path": "/a"}, {}]}}
    assert sessions.edited_paths(spark.createDataFrame([(json.dumps(ev),)], "event string")).first().paths == ["/a", "/b"]
    assert sessions.edited_paths(spark.createDataFrame([('{"tool_name":"Read"}',)], "event string")).first().paths == []


def plan(spark, items, catalog=(), **how):
    df = spark.createDataFrame([(i, *[x.get(k) for k in ("category", "action", "title", "content", "rationale", "tags", "merge_sources")]) for i, x in enumerate(items)], ITEMS)
    cat = spark.createDataFrame(list(catalog), "category string, slug string, title string")
    rows = routing.dispatch(df, cat, **({"has_project": True} | how)).orderBy("item_no", "part").collect()
    return [(r.item_no, r.status, r.slug, r.reason) for r in rows]


def item(title="T one", category="global_memory", action="write", content="c", **more):
    return {"category": category, "action": action, "title": title, "content": content, **more}


def test_dispatch_writes(spark):
    got = plan(
        spark, [item(), item(""), item(category="project_memory"), item(category="global_skill"), item(category="nope"), item(category="claude_md_patch"), item("Type hint requireds", action=None)], [("global_memory", "type-hints-required", "Type hints")]
    )
    assert [g[1] for g in got] == ["written", "skipped", "written", "skipped", "skipped", "appended", "written"]
    assert got[0][2] == "t-one" and got[1][3] == "missing title or content" and got[4][3] == "unknown category: 'nope'"
    assert got[6][2] == "type-hints-required"  # two edits away
    assert plan(spark, [item(category="project_skill")], has_project=False)[0][1:] == ("skipped", "", "no project detected")


def test_dispatch_merges_and_deletes(spark):
    cat = [("project_memory", s, t) for s, t in (("alpha-note", "Alpha"), ("beta-note", "Beta head"), ("merged-long", "M"))]
    got = plan(spark, [item("Merged long", "project_memory", "merge", merge_sources=["Alpha note", "Beta head", "Missing thing", "Merged long"])], cat)
    assert got == [(0, "merged", "merged-long", None), (0, "merge_source_deleted", "alpha-note", None), (0, "merge_source_deleted", "beta-note", None), (0, "skipped", "", "merge source not found: 'Missing thing'")]
    assert plan(spark, [item("Alpha note", "project_memory", "delete"), item("Nothing here", "global_memory", "delete")], cat) == [(0, "deleted", "alpha-note", None), (1, "skipped", "", "memory not found: 'Nothing here'")]
    assert plan(spark, [item(action="merge")])[0][3] == "merge: no merge_sources provided"
    assert plan(spark, [item(action="delete", category="project_skill")])[0][3].startswith("delete not supported")
    quota = plan(spark, [item(f"Note number {i}", "project_memory", "delete") for i in range(7)], cat)
    assert [g[3].startswith("project merge/delete limit") for g in quota] == [False] * 5 + [True] * 2


def test_near_slugs_is_the_full_comparison(spark):
    import random

    r = random.Random(5)
    word = lambda: "".join(r.choice("abc-") for _ in range(r.randint(0, 9)))
    a, b = {word() for _ in range(60)}, {word() for _ in range(60)}

    def lev(x, y):
        row = list(range(len(y) + 1))
        for i, cx in enumerate(x):
            new = [i + 1]
            for j, cy in enumerate(y):
                new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (cx != cy)))
            row = new
        return row[-1]

    df = lambda s: spark.createDataFrame([(x,) for x in s], "slug string")
    got = {x.slug: (x.distance, x.target_slug) for x in routing.near_slugs(df(a), df(b)).collect()}
    for x in a:
        best = min(((lev(x, y), y) for y in b if y), default=(9, ""))
        if x and best[0] <= 3 and max(len(x), len(best[1])) > 3:
            assert got[x] == best


def test_paths_and_texts(spark):
    roots = {"memory_global": "/g/memory", "skill_global": "/g/skills", "memory_project": "/p/.t/memory"}
    df = spark.createDataFrame([("/g/memory/a.md",), ("/g/memoryx/a.md",), ("/g/skills/s/SKILL.md",), ("/p/.t/memory/b.md",), ("/p/src/x.py",), ("/p/node_modules/x.py",), ("/p/x.bin",)], "file_path string")
    got = {r.file_path: (r.kind, r.scope, r.route) for r in routing.edit_route(df, roots, "/p", (".py",), ("node_modules",)).collect()}
    assert got["/g/memory/a.md"] == ("memory_global", "global", "memory") and got["/g/skills/s/SKILL.md"][:2] == ("skill_global", "skill_global")
    assert got["/g/memoryx/a.md"] == (None, None, None) and got["/p/src/x.py"][2] == "code" and got["/p/node_modules/x.py"][2] is None and got["/p/x.bin"][2] is None
    text = lambda t: spark.createDataFrame([(t,)], "t string").select(routing.append_block(F.col("t"), F.lit(" new "), "now", "<!--A-->", "<!--B-->").alias("x")).first().x
    assert text("x\n") == "x\n\n<!--A-->\n<!-- appended now -->\nnew\n<!--B-->\n"
    assert text("<!--A-->\nold\n<!--B-->\nend") == "<!--A-->\nold\n<!-- appended now -->\nnew\n<!--B-->\nend"
    m = spark.range(1).select(routing.memory_text(F.lit("T"), F.lit(" c "), F.lit("1"), F.lit("2"), [("scope", F.lit("global"))], F.array(F.lit("a"))).alias("x")).first().x
    assert m == '---\ncreated_at: 1\nupdated_at: 2\nscope: global\ntags: ["a"]\n---\n\n# T\n\nc\n'


def test_quota_holds_for_each_batch(spark):
    from tessera.operators import routing

    rows = [(i, "project_memory", "delete", f"T{i}", "c", None, i % 2) for i in range(16)]
    items = spark.createDataFrame(rows, "item_no long, category string, action string, title string, content string, merge_sources array<string>, session int")
    cat = spark.createDataFrame([("project_memory", f"t{i}", f"T{i}") for i in range(16)], "category string, slug string, title string")
    deleted = lambda **how: routing.dispatch(items, cat, has_project=True, **how).filter("status = 'deleted'").count()
    assert deleted() == 5 and deleted(batch="session") == 10


def test_last_of_repeated_front_matter_keys(spark):
    from tessera.operators import catalog

    one = spark.createDataFrame([("---\ntitle: a\ntags: [x]\ntitle: b\n---\nbody",), ("no front",)], "text string")
    got = [r.front for r in catalog.front_matter(one).collect()]
    assert got == [{"title": "b", "tags": "[x]"}, {}]
