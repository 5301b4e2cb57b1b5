import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions.embed import HashingEmbedder, KeywordEmbedder, embed_column, get_embedder, lexical_score, register_embedder, with_retry
from tessera.functions.vector import cosine
from tessera.schema import dim_of, expand_scopes, local_models, models_of


def one(spark, expr, **cols):
    return spark.createDataFrame([tuple(cols.values())], list(cols)).select(expr.alias("x")).first().x


@pytest.mark.parametrize("t", ["", "a", "a\n", "a\n\n", "a\r\nb", "a\x0bb\x0cc", "\n", "x\x1cy\x85z", "a b"])
def test_split_lines_is_pythons(spark, t):
    assert one(spark, X.split_lines(F.col("t")), t=t) == t.splitlines()


@pytest.mark.parametrize("t", ["  a b \n", "\t\x0b\x1c", " x ", "", "a"])
def test_strip_is_pythons(spark, t):
    assert one(spark, X.strip(F.col("t")), t=t) == t.strip()


@pytest.mark.parametrize("t,want", [("Type hints: required!", "type-hints-required"), ("  a -- b  ", "a-b"), ("***", "item"), ("é x", "x"), ("a" * 80, "a" * 60)])
def test_slug(spark, t, want):
    assert one(spark, X.slugify(F.col("t")), t=t) == want


@pytest.mark.parametrize(
    "t,want",
    [
        ("[py] foo.py:1-40\n\ndef foo(): pass", ("py", 1, 40, "def foo(): pass")),
        ("body only", ("", None, None, "body only")),
        ("garbage:not-a-range\n\nbody", ("", None, None, "body")),
        ("[go] a:b.go:3-9\n\nx\n\ny", ("go", 3, 9, "x\n\ny")),
    ],
)
def test_parse_code_hit(spark, t, want):
    p = X.parse_code_hit(F.col("t"))
    r = spark.createDataFrame([(t,)], "t string").select(*[c.alias(k) for k, c in p.items()]).first()
    assert (r.language, r.start_line, r.end_line, r.body) == want


def test_code_texts_round_trip(spark):
    args = (F.lit("py"), F.lit("/x/foo.py"), F.lit(3), F.lit(7), F.lit("code"))
    assert one(spark, X.code_embed_text(*args), a=1) == "[py] foo.py:3-7\ncode"
    assert one(spark, X.code_stored_text(*args), a=1) == "[py] foo.py:3-7\n\ncode"


def test_labels(spark):
    assert [one(spark, X.token_label(F.col("n")), n=n) for n in (5, 1000, 1_500_000)] == ["5", "1.0k", "1.5M"]
    assert one(spark, X.time_label(F.col("t"), "2026-01-02"), t="2026-01-02T03:04:05") == "03:04"
    assert one(spark, X.time_label(F.col("t"), "2026-01-03"), t="2026-01-02T03:04:05") == "2026-01-02"
    assert one(spark, X.short_path(F.col("p"), "/home/a"), p="/home/a/b/c.md") == "~/b/c.md"
    assert one(spark, X.hit_title(F.col("h"), F.lit("/a/n.md")), h=["A", "B"]) == "B"
    assert one(spark, X.breadcrumb(F.col("h"), F.lit("t")), h=["A", "B"]) == "A > B\n\nt"


def test_cosine_of_zero_is_nan(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0, 1.0])], "a array<float>, b array<float>")
    got = [r.x for r in df.select(cosine(F.col("a"), F.col("b")).alias("x")).collect()]
    assert got[0] == pytest.approx(math.sqrt(0.5)) and math.isnan(got[1]) and got[2] is None


def test_scopes_and_models():
    assert expand_scopes(None) == expand_scopes("all") == ["global", "project", "skill_global", "skill_project"]
    assert expand_scopes("skills") == ["skill_global", "skill_project"]
    assert expand_scopes(["project", "global", "skills"]) == ["project", "skill_project", "global", "skill_global"]
    assert expand_scopes("Other") == ["Other"]
    assert dim_of("all-minilm") == 384 and dim_of("x") is None and len(models_of("voyage")) == 3
    assert local_models(["all-minilm:latest", "llama3:8b", "my-embedder:1"]) == ["all-minilm", "my-embedder"]


def test_embedders(spark):
    e = HashingEmbedder(16)
    a, b = e.embed(["one two", "one two"])
    assert a == b and sum(x * x for x in a) == pytest.approx(1)
    k = KeywordEmbedder([["git", "push"], ["sql"]])
    assert k.embed(["Push it", "SQL", "none"]) == [[1, 0, 0], [0, 1, 0], [0, 0, 1]]
    df = spark.createDataFrame([("one two",), (None,)], "t string").select(embed_column(e, F.col("t"), batch=1).alias("v"))
    assert [len(r.v) for r in df.collect()] == [16, 16]
    register_embedder("mine", HashingEmbedder)
    assert get_embedder("mine", dim=8).dim == 8
    with pytest.raises(ValueError):
        get_embedder("nobody")


def test_retry():
    calls, waits = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert with_retry(call, sleep=waits.append) == "ok" and waits == [1.0, 2.0]
    with pytest.raises(ZeroDivisionError):
        with_retry(lambda: 1 / 0, attempts=2, sleep=waits.append)


def test_lexical_score(spark):
    assert one(spark, lexical_score(F.lit("alpha beta"), F.col("t")), t="Beta gamma") == 0.5
