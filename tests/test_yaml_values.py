"""Nested front matter: cases by hand, and against a full parser where one is at hand."""

import datetime
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from tessera.functions.yaml_values import nested_front_matter, read_values

CASES = [
    ("", {}), ("# only a comment\n", {}), ("a: 1\nb: two words # note\nc:\n", {"a": 1, "b": "two words", "c": None}), ("a:\n  b:\n    c: x\n  d: [1, 'two', \"th\\u0072ee\", {e: f}]\n", {"a": {"b": {"c": "x"}, "d": [1, "two", "three", {"e": "f"}]}}),
    ("tags:\n- a\n- b: 1\n  c: 2\n- - x\n  - y\n-\n", {"tags": ["a", {"b": 1, "c": 2}, ["x", "y"], None]}), ("t: |\n  one\n   two\n\n  three\n\nu: >-\n  a\n  b\n\n  c\n", {"t": "one\n two\n\nthree\n", "u": "a b\nc"}),
    ("a: 'it''s'\nb: \"x\n  y\"\nc: plain\n  goes on\n", {"a": "it's", "b": "x y", "c": "plain goes on"}), ("a: yes\nb: ~\nc: 0x1F\nd: 1.5\ne: 1_000\nf: 'no'\ng: 017\nh: a:b\n", {"a": True, "b": None, "c": 31, "d": 1.5, "e": 1000, "f": "no", "g": 15, "h": "a:b"}),
    ("a: 1\na: 2\n", {"a": 2}), ("\"k y\": 1\n'z': {}\n", {"k y": 1, "z": {}}), ("a: [\n  1,\n  2\n  ]\nb: 3", {"a": [1, 2], "b": 3}), ("a:\r\n  - b\r\n", {"a": ["b"]}),
]


@pytest.mark.parametrize("text,want", CASES)
def test_cases(text, want):
    assert read_values(text) == want


@pytest.mark.parametrize("text", ["- a\n- b", "just words", "a: b: c", "a: [1", "a: 'x", "a: *x", "a: !t x", "  a: 1\n b: 2", "a: 1\n  b: 2", "\ta: 1", 'a: "\\q"', "a: [" * 300, "\n".join(" " * i + "a:" for i in range(300))])
def test_not_understood(text):
    assert read_values(text) is None


def test_against_a_full_parser():
    yaml = pytest.importorskip("yaml")
    r = random.Random(6)
    word = lambda: r.choice(["a", "b c", "yes", "No", "12", "-3", "1.5", "x: y", "# n", "it's", 'say "x"', "", "é\n\nz", " lead", "long " * 30, "{a", "- d", "null", "0x10", "2024-01-02", "tab\tx", "\U0001f600"])

    def make(depth):
        kind = r.random() if depth < 4 else 1
        if kind < 0.3:
            return {word() or "k": make(depth + 1) for _ in range(r.randint(0, 4))}
        return [make(depth + 1) for _ in range(r.randint(0, 4))] if kind < 0.55 else r.choice([word(), word(), r.randint(-99, 99), None, True, 2.25])

    for i in range(1500):
        want = {f"k{j}": make(1) for j in range(r.randint(0, 4))}
        text = yaml.safe_dump(want, allow_unicode=True, default_flow_style=r.choice([None, False, True]), width=r.choice([20, 80]), indent=r.choice([2, 4]), default_style=r.choice([None, None, '"', "'", "|", ">"]))
        assert yaml.safe_load(text) == want
        if "!!" in text or "? " in text:
            continue  # tags and long keys aren't understood
        assert read_values(text) == want, text


def test_dates_stay_text():
    assert read_values("d: 2024-01-02") == {"d": str(datetime.date(2024, 1, 2))}


def test_variant(spark):
    rows = [(1, "---\na: {b: [1, x]}\n---\n\n# T\n"), (2, "no front"), (3, None), (4, ""), (5, "---\n---\nbody"), (6, "---\na: [\n---\nbody"), (7, "---\r\na: 1\r\n---\r\nbody")]
    df = spark.createDataFrame(rows, "id int, text string").withColumn("front", F.lit("clash")).withColumn("other", F.lit(1))
    got = {r.id: (r.j and json.loads(r.j), r.body) for r in nested_front_matter(df).select("id", F.to_json("front").alias("j"), "body").collect()}
    assert got == {1: ({"a": {"b": [1, "x"]}}, "# T\n"), 2: (None, "no front"), 3: (None, None), 4: (None, ""), 5: ({}, "body"), 6: (None, rows[5][1]), 7: ({"a": 1}, "body")}
    assert nested_front_matter(df.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["a: |\n" + "  x\n" * 100_000, 'a: "' + "x\n  " * 50_000 + '"', "a:\n" + "  - b\n" * 50_000, "a: [" + "1,\n  " * 50_000 + "]", "a: " + "x " * 200_000])
def test_long_values_take_linear_time(text):
    began = time.perf_counter()
    assert read_values(text) is not None and time.perf_counter() - began < 5


def test_batches_for_python_are_bounded(spark, monkeypatch):
    """A worker never holds thousands of whole texts at once."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    try:

        def sizes(raw):
            return F.pandas_udf(lambda part: part.map(lambda _: f'{{"n": {len(part)}}}'), "string")(raw)

        monkeypatch.setattr("tessera.functions.yaml_values.values", lambda raw: F.try_parse_json(sizes(raw)))
        files = spark.range(0, 3000, 1, 1).select(F.lit("---\na: 1\n---\nbody").alias("text"))
        seen = nested_front_matter(files).agg(F.max(F.variant_get("front", "$.n", "int")).alias("n"), F.count(F.lit(1)).alias("k")).first()
        assert seen.k == 3000 and seen.n <= 512
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
