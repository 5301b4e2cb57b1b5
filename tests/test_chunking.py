import random

import pytest

from tessera.operators import chunking as C


def windows(text, size, overlap):
    """The plain loop that the expression stands for."""
    lines, out, s = text.splitlines(), [], 0
    while s < len(lines):
        w = lines[s : s + size]
        if "\n".join(w).strip():
            out.append((s + 1, s + len(w), "\n".join(w)))
        if s + size >= len(lines):
            break
        s += max(1, size - overlap)
    return out


def test_line_windows_match_the_loop(spark):
    r = random.Random(3)
    texts = [("\n".join(r.choice(["", "  ", "x", "line"]) for _ in range(r.randint(0, 30)))) for _ in range(60)] + ["", "\n\n", "one"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(-1, None)], "id int, text string")
    for size, share in ((4, 0.25), (5, 0.0), (3, 0.99)):
        got = {}
        for x in C.chunk_lines(df, size=size, overlap=share).collect():
            got.setdefault(x.id, []).append((x.chunk_idx, x.start_line, x.end_line, x.text))
        for i, t in enumerate(texts):
            assert sorted(got.get(i, [])) == [(k, *w) for k, w in enumerate(windows(t, size, int(size * share)))]
        assert -1 not in got


def chunks(spark, body, **how):
    rows = C.chunk_markdown(spark.createDataFrame([(body,)], "body string"), **how).orderBy("chunk_idx").collect()
    return [(list(r.heading_path), r.text) for r in rows]


def test_headings(spark):
    assert chunks(spark, "# A\n\n## B\nb\n### C\nc\n## D\nd\n# E\n") == [(["A", "B"], "b"), (["A", "B", "C"], "c"), (["A", "D"], "d")]
    assert chunks(spark, "just text") == [([], "just text")]
    assert chunks(spark, "pre\n#nohead\n# H \nx") == [([], "pre\n#nohead"), (["H"], "x")]
    assert chunks(spark, "# only") == [([], "# only")]
    assert chunks(spark, "") == chunks(spark, None) == chunks(spark, " \n ") == []
    code = "# A\n```\n# no\n```\n"
    assert chunks(spark, code) == [(["A"], "```"), (["no"], "```")]
    assert chunks(spark, code, fence_aware=True) == [(["A"], "```\n# no\n```")]


def test_oversized_sections(spark):
    body = "# Big\n\n" + "\n\n".join(f"Paragraph {i} " * 50 for i in range(10))
    got = chunks(spark, body)
    assert len(got) > 1 and all(len(t) <= 2000 for _, t in got) and all(p == ["Big"] for p, _ in got)
    # pieces of a packed section that are tiny go
    tiny = "# T\n\n" + "x" * 1490 + "\n\n" + "y" * 20
    assert [len(t) for _, t in chunks(spark, tiny)] == [1490]
    assert len(chunks(spark, "# T\n\n" + "z" * 5000)) == 1


def test_python_definitions(spark):
    src = "import os\n\nX = 1\n\n@deco\ndef f():\n    return 1\n\n\nclass A:\n    def g(self):\n        pass\n\nprint(f())\n"
    df = spark.createDataFrame([("a.py", "py", src), ("b.txt", "text", "x\ny"), ("c.py", "py", "def ("), ("d.py", "py", ""), ("e.go", "go", "package a\nfunc f() {\n}\n\ntype T struct {\n}\n")], "path string, language string, text string")
    got = {}
    for r in C.chunk_code(df).orderBy("chunk_idx").collect():
        got.setdefault(r.path, []).append((r.start_line, r.end_line))
    assert got["a.py"] == [(1, 4), (5, 7), (10, 12), (13, 14)]
    assert got["b.txt"] == [(1, 2)] and got["c.py"] == [(1, 1)] and "d.py" not in got
    assert got["e.go"] == [(1, 1), (2, 3), (5, 6)]


def test_large_definitions_are_cut_in_windows(spark):
    src = "def f():\n" + "    x = 1\n" * 60
    rows = C.chunk_code(spark.createDataFrame([("py", src)], "language string, text string")).orderBy("chunk_idx").collect()
    assert [(r.start_line, r.end_line) for r in rows] == [(1, 40), (31, 61)]


@pytest.mark.parametrize("n,spans,want", [(10, [(3, 5)], [(1, 2), (3, 5), (6, 10)]), (5, [(1, 5)], [(1, 5)]), (5, [(1, 3), (2, 4)], [(1, 3), (4, 4), (5, 5)])])
def test_regions(n, spans, want):
    assert C.regions(n, spans) == want


def slow_sections(body, fence_aware):
    """The plain loop: (headings above, text) of every section with text."""
    import re

    stack, lines, out, fence = [], [], [], False

    def close():
        if t := "\n".join(lines).strip():
            out.append(([t_ for _, t_ in stack], t))

    for line in body.splitlines():
        m = re.match(r"^(#{1,6})\s+(.+?)\s*$", line)
        if m and not fence:
            close()
            lines.clear()
            stack[:] = [h for h in stack if h[0] < len(m[1])] + [(len(m[1]), m[2])]
        else:
            lines.append(line)
        if fence_aware and re.match(r"^\s*(```|~~~)", line):
            fence = not fence
    close()
    return out or ([([], body.strip())] if body.strip() else [])


def slow_pieces(text, most):
    if len(text) <= most:
        return [text]
    done, open_, n = [], [], 0
    for p in filter(None, (x.strip() for x in __import__("re").split(r"\n{2,}", text))):
        if n + len(p) + 2 > most and open_:
            done.append("\n\n".join(open_))
            open_, n = [p], len(p)
        else:
            open_.append(p)
            n += len(p) + 2
    return done + (["\n\n".join(open_)] if open_ else [])


@pytest.mark.parametrize("fence_aware", [False, True])
def test_markdown_matches_the_loop(spark, fence_aware):
    from pyspark.sql import functions as F

    r = random.Random(8)
    line = lambda: r.choice(["", "", "text of it", "# One", "## Two two ", "#### Four", "#none", "```", "~~~ py", "###### Six", "  ", "x" * 40])
    bodies = ["\n".join(line() for _ in range(r.randint(0, 60))) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(bodies)), "id int, body string")
    got = df.select("id", C.sections(F.col("body"), fence_aware=fence_aware).alias("s"), C.pack_paragraphs(F.col("body"), 90).alias("p")).collect()
    for x in got:
        assert [(list(s.path), s.text) for s in x.s] == slow_sections(bodies[x.id], fence_aware)
        assert list(x.p) == slow_pieces(bodies[x.id], 90)


def test_markdown_is_linear(spark):
    """Four times the text takes far less than sixteen times as long."""
    import time

    def seconds(n):
        body = "\n\n".join(["# H", "some words of a paragraph"] * n)
        df = spark.createDataFrame([(body,)] * 2, "body string")
        took = []
        for _ in range(2):
            began = time.perf_counter()
            assert C.chunk_markdown(df).count() == 2 * n
            took.append(time.perf_counter() - began)
        return min(took)

    seconds(100)
    assert seconds(8000) < 9 * max(0.3, seconds(2000))
