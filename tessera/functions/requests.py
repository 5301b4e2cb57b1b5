"""Embedding and reranking by requests: clients over an injected transport, and whole tables in packed, limited requests."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import dim_of, local_models
from .embed import Embedder, with_retry

#: POST (or GET where there is no body) of JSON: url, body, headers -> reply.  Must be picklable.
Transport = Callable[[str, dict | None, dict[str, str]], dict]


def http_json(url: str, body: dict | None, headers: dict[str, str]) -> dict:
    data = None if body is None else json.dumps(body).encode()
    with urllib.request.urlopen(urllib.request.Request(url, data, {"Content-Type": "application/json", **headers}), timeout=120) as reply:
        return json.load(reply)


@dataclass
class RemoteEmbedder:
    """A hosted model; ``embed`` sends documents, ``embed_query`` a question, ``rerank`` sorts texts by relevance."""

    api_key: str
    base_url: str
    model: str = "voyage-3.5"
    transport: Transport = http_json
    batch: int = 64
    sleep: Callable[[float], None] = time.sleep

    def __post_init__(self) -> None:
        if not self.api_key:
            raise ValueError("no API key for the embedding service")
        self.dim = dim_of(self.model) or 1024

    def _post(self, what: str, body: dict) -> dict:
        headers = {"Authorization": f"Bearer {self.api_key}"}
        return with_retry(lambda: self.transport(f"{self.base_url.rstrip('/')}/{what}", body, headers), sleep=self.sleep)

    def request(self, texts: list[str], input_type: str = "document") -> tuple[list[list[float]], int]:
        """Vectors in the order of the texts, and the tokens that the service counted; one request."""
        reply = self._post("embeddings", {"input": texts, "model": self.model, "input_type": input_type})
        rows = sorted(reply["data"], key=lambda r: r.get("index", 0))
        if len(rows) != len(texts):
            raise ValueError(f"{len(rows)} vectors for {len(texts)} texts")
        return [r["embedding"] for r in rows], int(reply.get("usage", {}).get("total_tokens", 0))

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [v for i in range(0, len(texts), self.batch) for v in self.request(texts[i : i + self.batch])[0]]

    def embed_query(self, text: str) -> list[float]:
        return self.request([text], "query")[0][0]

    def rerank(self, query: str, texts: list[str], *, model: str = "rerank-2-lite", top_k: int | None = None) -> list[tuple[int, float]]:
        """(position, score) by falling score; nothing is asked about no texts."""
        if not texts:
            return []
        reply = self._post("rerank", {"query": query, "documents": texts, "model": model, "top_k": top_k})
        return sorted(((r["index"], r["relevance_score"]) for r in reply["data"]), key=lambda r: (-r[1], r[0]))


@dataclass
class LocalEmbedder:
    """A model on a local server, free of cost; an unknown model's dimension is asked for once."""

    model: str = "nomic-embed-text"
    base_url: str = "http://localhost:11434"
    transport: Transport = http_json
    batch: int = 64
    sleep: Callable[[float], None] = time.sleep
    _dim: int | None = None

    @property
    def dim(self) -> int:
        if self._dim is None:
            self._dim = dim_of(self.model)
        if self._dim is None:
            probe = self.embed(["dim probe"])
            if not probe or not probe[0]:
                raise ValueError(f"the server gives no vectors of {self.model!r}")
            self._dim = len(probe[0])
        return self._dim

    def request(self, texts: list[str]) -> tuple[list[list[float]], int]:
        got = with_retry(lambda: self.transport(f"{self.base_url.rstrip('/')}/api/embed", {"model": self.model, "input": texts}, {})["embeddings"], sleep=self.sleep)
        return got, 0

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [v for i in range(0, len(texts), self.batch) for v in self.request(texts[i : i + self.batch])[0]]

    def models(self) -> list[str]:
        """Names of the server's embedding models; none if it doesn't answer."""
        try:
            listed = self.transport(f"{self.base_url.rstrip('/')}/api/tags", None, {})
        except (OSError, ValueError):
            return []
        return local_models([m.get("name", "") for m in listed.get("models", [])])


def packed(texts: list[str], max_tokens: int, max_texts: int, chars_per_token: int = 4) -> Iterator[list[int]]:
    """Positions of the texts of each request: in order, up to a number of estimated tokens and of texts; a longer text goes alone."""
    open_, load = [], 0
    for i, t in enumerate(texts):
        tokens = -(-len(t) // chars_per_token)
        if open_ and (load + tokens > max_tokens or len(open_) >= max_texts):
            yield open_
            open_, load = [], 0
        open_.append(i)
        load += tokens
    if open_:
        yield open_


def paced(interval: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> Callable[[], None]:
    """A call that returns no sooner than ``interval`` seconds after its last return."""
    due = [clock()]

    def wait() -> None:
        if (gap := due[0] - clock()) > 0:
            sleep(gap)
        due[0] = max(clock(), due[0]) + interval

    return wait


def request_vectors(texts: DataFrame, embedder: Embedder, *, max_tokens: int = 100_000, max_texts: int = 128, parallel: int = 8, per_second: float | None = None) -> DataFrame:
    """text_hash, vector, tokens for rows of (text_hash, text), by requests.

    Requests are packed within Arrow batches of ``parallel`` tasks, that is at most so many run at once,
    and all tasks together send at most ``per_second``.  The tokens of a request stand on its first row:
    those that the service counts, or else an estimate.  A task that is run again asks again, so write the
    result before reading it more than once.
    """
    interval = parallel / per_second if per_second else 0.0

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wait = paced(interval)
        ask = getattr(embedder, "request", None)
        for part in parts:
            rows = part["text"].tolist()
            for places in packed(rows, max_tokens, max_texts):
                wait()
                some = [rows[i] for i in places]
                vectors, tokens = ask(some) if ask else (with_retry(lambda some=some: embedder.embed(some)), sum(-(-len(t) // 4) for t in some))
                if len(vectors) != len(some):
                    raise ValueError(f"{len(vectors)} vectors for {len(some)} texts")
                yield pd.DataFrame({"text_hash": part["text_hash"].iloc[places], "vector": vectors, "tokens": [tokens] + [0] * (len(some) - 1)})

    return texts.select("text_hash", "text").repartition(parallel, "text_hash").mapInPandas(run, "text_hash string, vector array<float>, tokens long")


class VectorTable:
    """Vectors by content hash and model, as Parquet in a folder that executors share; runs add to it."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def read(self, model: str) -> DataFrame:
        """text_hash and vector, once each; empty before the first run."""
        schema = "text_hash string, vector array<float>, tokens long, run string, model string"
        from ..sources.shared import exists

        rows = self.spark.read.schema(schema).parquet(self.path) if exists(self.spark, self.path) else self.spark.createDataFrame([], schema)
        return rows.filter(F.col("model") == model).dropDuplicates(["text_hash"]).select("text_hash", "vector")

    def add(self, vectors: DataFrame, model: str, run: str) -> None:
        vectors.select("text_hash", "vector", "tokens", F.lit(run).alias("run"), F.lit(model).alias("model")).write.mode("append").parquet(self.path)

    def usage(self) -> DataFrame:
        """Texts and tokens by run and model: what the ledger is charged for."""
        return self.spark.read.parquet(self.path).groupBy("run", "model").agg(F.count(F.lit(1)).alias("texts"), F.sum("tokens").alias("tokens"))


def embed_table(rows: DataFrame, embedder: Embedder, table: VectorTable, run: str, *, text: str = "text", out: str = "embedding", **limits) -> DataFrame:
    """``rows`` with the vector of each text in ``out``; only texts that the table lacks are sent, equal ones once.

    Null texts are embedded as empty ones; an empty table sends nothing; columns named as ``out`` are
    replaced.  Equal texts are found by their SHA-256 with partial aggregation, so a text that a third of the rows have
    reaches one task once per task before it; rows are joined with unique hashes, whose hot parts AQE splits.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    digest = F.sha2(F.encode(body, "UTF-8"), 256)
    distinct = rows.select(digest.alias("text_hash"), body.alias("text")).groupBy("text_hash").agg(F.any_value("text").alias("text"))
    new = distinct.join(table.read(embedder.model).select("text_hash"), "text_hash", "left_anti")
    table.add(request_vectors(new, embedder, **limits), embedder.model, run)
    vectors = table.read(embedder.model).select(F.col("text_hash").alias("_text_hash"), F.col("vector").alias("_vector"))
    keyed = rows.withColumn("_text_hash", digest).join(vectors, "_text_hash", "left")
    return keyed.withColumn(out, F.col("_vector")).drop("_text_hash", "_vector")
