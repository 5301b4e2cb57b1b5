"""Clients over an injected transport, packing, pace, and tables embedded by requests."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from tessera.functions.embed import HashingEmbedder
from tessera.functions.requests import LocalEmbedder, RemoteEmbedder, VectorTable, embed_table, packed, paced


def make():
    class Service:
        """A service that writes down what it is sent, one file a request; picklable."""

        def __init__(self, folder, fail_first=0):
            self.folder, self.fail_first, self.calls = str(folder), fail_first, []

        def __call__(self, url, body, headers):
            self.calls.append((url, body, headers))
            if len(self.calls) <= self.fail_first:
                raise OSError("busy")
            if url.endswith("rerank"):
                return {"data": [{"index": i, "relevance_score": float(len(t))} for i, t in enumerate(body["documents"])]}
            with open(os.path.join(self.folder, uuid.uuid4().hex), "w") as f:
                f.write("\n".join(body["input"]))
            rows = [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in enumerate(body["input"])]
            return {"data": rows[::-1], "usage": {"total_tokens": 10 * len(rows)}, "embeddings": [r["embedding"] for r in rows]}

    return Service


Service = make()  # a class that tasks get by value


def sent(folder):
    return [open(os.path.join(folder, n)).read().split("\n") for n in os.listdir(folder)]


def remote(service, **how):
    return RemoteEmbedder("key", "https://service/v1", transport=service, sleep=lambda s: None, **how)


def test_remote_client(tmp_path):
    s = Service(tmp_path)
    e = remote(s, batch=4)
    assert e.embed([]) == [] and not s.calls
    assert e.embed([("x" * i) for i in range(10)]) == [[float(i), 1.0] for i in range(10)]
    assert [len(b["input"]) for _, b, _ in s.calls] == [4, 4, 2]
    url, body, headers = s.calls[0]
    assert url == "https://service/v1/embeddings" and headers == {"Authorization": "Bearer key"} and body["input_type"] == "document"
    assert e.embed_query("abc") == [3.0, 1.0] and s.calls[-1][1]["input_type"] == "query"
    assert e.dim == 1024 and remote(s, model="voyage-3.5-lite").dim == 512
    assert e.rerank("q", []) == [] and e.rerank("q", ["a", "ccc", "bb"]) == [(1, 3.0), (2, 2.0), (0, 1.0)]
    with pytest.raises(ValueError, match="API key"):
        RemoteEmbedder("", "https://service/v1")


def test_retries(tmp_path):
    assert remote(Service(tmp_path, fail_first=4)).embed(["a"]) == [[1.0, 1.0]]
    s = Service(tmp_path, fail_first=5)
    with pytest.raises(OSError):
        remote(s).embed(["a"])
    assert len(s.calls) == 5


def test_local_client(tmp_path):
    s = Service(tmp_path)
    e = LocalEmbedder("unknown-model", transport=s)
    assert (e.dim, e.dim, len(s.calls)) == (2, 2, 1) and s.calls[0][0] == "http://localhost:11434/api/embed"
    assert LocalEmbedder(transport=s).dim == 768 and len(s.calls) == 1
    tags = lambda url, body, headers: {"models": [{"name": "all-minilm:latest"}, {"name": "chat:7b"}, {"name": "my-embed"}]}
    assert LocalEmbedder(transport=tags).models() == ["all-minilm", "my-embed"]

    def down(url, body, headers):
        raise OSError

    assert LocalEmbedder(transport=down).models() == []
    with pytest.raises(ValueError, match="no vectors"):
        LocalEmbedder("other", transport=lambda *a: {"embeddings": [[]]}).dim


def test_packed():
    assert list(packed(["x" * 8, "x" * 8, "x" * 9, "", "x" * 100, "y"], 4, 3)) == [[0, 1], [2, 3], [4], [5]]
    assert list(packed([], 4, 3)) == [] and list(packed(["a"] * 5, 100, 2)) == [[0, 1], [2, 3], [4]]


def test_paced():
    now, naps = [0.0], []

    def sleep(s):
        naps.append(s)
        now[0] += s

    wait = paced(2.0, lambda: now[0], sleep)
    for _ in range(3):
        wait()
    now[0] += 5
    wait()
    assert naps == [2.0, 2.0]


def test_equal_texts_are_sent_once(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    e, table = remote(Service(log)), VectorTable(spark, str(tmp_path / "vectors"))
    rows = [(i, t) for i, t in enumerate(["one", "two", None, "", "one", "three"] + ["hot"] * 300)]
    df = spark.createDataFrame(rows, "id int, text string").repartition(5).withColumn("vector", F.lit("clash")).withColumn("embedding", F.lit("old"))
    got = embed_table(df, e, table, "r1", max_texts=2, parallel=3)
    assert got.columns == df.columns
    assert {r.id: list(r.embedding) for r in got.collect()} == {i: [float(len(t or "")), 1.0] for i, t in rows}
    got.count()
    assert sorted(t for call in sent(log) for t in call) == ["", "hot", "one", "three", "two"] and max(map(len, sent(log))) <= 2
    again = spark.createDataFrame([(1, "two"), (2, "new")], "id int, text string")
    assert embed_table(again, e, table, "r2").count() == 2
    assert sorted(t for call in sent(log) for t in call) == ["", "hot", "new", "one", "three", "two"]
    assert {(r.run, r.texts, r.tokens) for r in table.usage().collect()} == {("r1", 5, 50), ("r2", 1, 10)}
    assert embed_table(again.limit(0), e, table, "r3").count() == 0


def test_any_embedder_will_do(spark, tmp_path):
    table, e = VectorTable(spark, str(tmp_path / "v")), HashingEmbedder(8)
    got = embed_table(spark.createDataFrame([("a b",), ("c",)], "t string"), e, table, "r", text="t", per_second=1000.0, parallel=2).collect()
    assert {r.t: [round(x, 5) for x in r.embedding] for r in got} == {t: [round(x, 5) for x in e.embed([t])[0]] for t in ("a b", "c")}
    assert table.usage().first().tokens == 2
