import json
import os

import pytest
from pyspark.sql import functions as F

from tessera import config
from tessera.api import Memory
from tessera.functions.embed import KeywordEmbedder
from tessera.sources import files


@pytest.fixture()
def tree(tmp_path):
    make = {
        "a.py": "x = 1\n", "pkg/b.go": "package b\n", ".hidden/c.py": "1", ".github/ci.yml": "on: push\n", "node_modules/d.js": "1", "mine/e.py": "1", "f.bin": "1", ".env.py": "1", "empty.py": "", "big.py": "y" * 50, "UP.PY": "z\n",
    }
    for name, text in make.items():
        p = tmp_path / "repo" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return str(tmp_path / "repo")


def test_code_scan(spark, tree):
    rows = {os.path.relpath(r.path, tree): r for r in files.code_files(spark, tree, ignored=("mine",), max_bytes=40).collect()}
    assert set(rows) == {"a.py", "pkg/b.go", ".github/ci.yml", "empty.py", "big.py", "UP.PY"}
    assert rows["big.py"].too_large and rows["empty.py"].too_large and rows["big.py"].text is None and rows["UP.PY"].language == "py"
    assert files.code_files(spark, tree, max_files=2).count() == 2
    assert files.code_files(spark, tree + "/none").count() == 0


def test_markdown_and_latest(spark, tmp_path):
    (tmp_path / "m/sub").mkdir(parents=True)
    (tmp_path / "m/a.md").write_text("# A")
    (tmp_path / "m/sub/b.md").write_text("# B")
    (tmp_path / "m/c.txt").write_text("no")
    assert files.markdown_files(spark, str(tmp_path / "m")).count() == 2 and files.markdown_files(spark, str(tmp_path / "m"), recursive=False).count() == 1
    assert files.markdown_files(spark, str(tmp_path / "none")).count() == 0
    os.utime(tmp_path / "m/a.md", (1, 1))
    assert files.latest_file(spark, str(tmp_path / "m"), "*.md").first().path.endswith("b.md")
    assert files.latest_file(spark, str(tmp_path / "m"), "*.json").first() is None
    states = spark.sql("SELECT * FROM VALUES ('a', 1, 'x'), ('b', 2, 'y') AS t(session_id, modified, state)")
    assert files.session_state(states, "a").first().state == "x" and files.session_state(states, "zz").first().state == "y" and files.session_state(states, None).first().state == "y"


def test_event_lines_keep_order(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"a":1}\n\n{"a":2}\n')
    assert [r.value for r in files.event_lines(spark, str(tmp_path / "t.jsonl")).orderBy("line_no").collect()] == ['{"a":1}', "", '{"a":2}', ""]


EMBED = KeywordEmbedder([["git", "push"], ["react", "component"], ["database", "sql"]])


def test_memory_end_to_end(spark, tmp_path):
    root, project = tmp_path / "home", tmp_path / "proj"
    (root / "memory").mkdir(parents=True)
    (project / ".tessera/memory").mkdir(parents=True)
    (root / "memory/git.md").write_text("---\ntags: [vcs]\n---\n# Git\nHow to push branches.\n")
    (root / "memory/sql.md").write_text("# Data\nThe database uses sql.\n")
    (project / ".tessera/memory/ui.md").write_text("# UI\nA react component.\n")
    m = Memory(spark, str(root), project_root=str(project), embedder=EMBED)
    assert m.index() == {"files_seen": 3, "files_embedded": 3, "files_skipped": 0, "files_deleted": 0, "chunks_upserted": 3}
    again = m.index()
    assert again["files_skipped"] == 3 and again["chunks_upserted"] == 0 and m.store.manifest()["version"] == 1
    assert m.search("push to git", k=1).first().file_path.endswith("git.md")
    assert m.search("sql", scope="project", k=1).first().file_path.endswith("ui.md")
    assert m.search("x", tags=["vcs"]).count() == 1
    (root / "memory/git.md").write_text("# Git\nNow about a component.\n")
    (root / "memory/sql.md").unlink()
    third = m.index()
    assert (third["files_embedded"], third["files_deleted"], third["files_skipped"]) == (1, 1, 1)
    assert m.recall("react", budget_tokens=1).count() == 1
    w = m.write("All about sql and tables.", title="SQL rules", tags=["db"])
    assert w["written"].endswith("sql-rules.md") and "# SQL rules" in open(w["written"]).read()
    first = open(w["written"]).read().split("\n")[1]
    assert m.write("Changed sql.", title="SQL rulez")["written"] == w["written"] and open(w["written"]).read().split("\n")[1] == first
    assert m.search("database", k=1).first().file_path == w["written"]
    assert {r.slug for r in m.catalog().collect()} == {"git", "sql-rules", "ui"}
    assert m.move("ui", "global").endswith("home/memory/ui.md") and m.catalog("project").count() == 0
    assert m.merge(["git", "ui"], title="Both").endswith("both.md") and {r.slug for r in m.catalog().collect()} == {"both", "sql-rules"}
    assert m.remove("both").endswith("both.md") and m.search("react", k=5).count() == 1
    with pytest.raises(KeyError):
        m.remove("both")
    assert json.loads(m.status())["dim"] == 4
    assert m.reindex()["files_embedded"] == 1


def test_code_index(spark, tree, tmp_path):
    m = Memory(spark, str(tmp_path / "home"), project_root=tree, embedder=EMBED)
    assert m.index_code(ignored=("mine",))["files_seen"] == 6
    hit = m.search_code("anything", k=20).filter("file_path LIKE '%a.py'").first()
    assert (hit.language, hit.start_line, hit.end_line, hit.text) == ("py", 1, 1, "x = 1")
    open(f"{tree}/a.py", "w").write("")
    assert m.index_code(ignored=("mine",))["files_embedded"] >= 1
    assert m.search_code("anything", k=20).filter("file_path LIKE '%a.py'").count() == 0
    with pytest.raises(ValueError):
        Memory(spark, str(tmp_path / "other"), embedder=EMBED).index_code()


def test_review_and_costs(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "h"), embedder=EMBED)
    ev = [json.dumps({"type": "user", "message": {"role": "user", "content": f"m{i}"}}) for i in range(6)]
    lines = spark.createDataFrame([("f", i, e) for i, e in enumerate(ev)], "file string, line_no int, value string")
    assert m.review(lines).first().step == "review"
    assert m.costs(spark.createDataFrame([('{"source":"index","cost_usd":1.0}',)], "value string"), "all").count() == 3


def test_config(tmp_path, monkeypatch):
    monkeypatch.setenv(config.ROOT_VARIABLE, str(tmp_path))
    (tmp_path / "config.toml").write_text("[recall]\ntop_k = 7\n")
    (tmp_path / "p/.tessera").mkdir(parents=True)
    (tmp_path / "p/.tessera/config.toml").write_text("[recall]\nrerank = false\n")
    c = config.load_config(tmp_path / "p")
    assert config.get_key(c, "recall.top_k") == 7 and config.get_key(c, "recall.rerank") is False and config.get_key(c, "recall.budget_tokens") == 2000
    assert c["storage"]["root"] == str(tmp_path) and config.find_project_root(tmp_path / "p" / "x") == tmp_path / "p"
    with pytest.raises(KeyError):
        config.get_key(c, "recall.none")
    s = config.set_key(c, "a.b", "0.5")
    assert s["a"]["b"] == 0.5 and [config.typed(x) for x in ("true", "3", "x")] == [True, 3, "x"]
    assert config.masked({"api_key": "k", "n": {"token": "t", "x": 1}}) == {"api_key": "***", "n": {"token": "***", "x": 1}}
    import tomllib

    assert tomllib.loads(config.to_toml(config.DEFAULTS))["review"]["gate"]["min_user_messages"] == 3
