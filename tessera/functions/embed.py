"""Embedding and reranking as plug-in points, with deterministic offline defaults."""

from __future__ import annotations

import hashlib
import math
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"\w+")


class Embedder(Protocol):
    """What the index needs of an embedding model; must be picklable."""

    dim: int
    model: str

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashingEmbedder:
    """Signed counts of hashed words, of length 1; the same on every machine.  It knows no meaning."""

    def __init__(self, dim: int = 64):
        self.dim, self.model = dim, f"hashing-{dim}"

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.dim
            for w in _WORD.findall(t.lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % self.dim] += 1.0 if h >> 63 else -1.0
            n = math.sqrt(sum(x * x for x in v))
            out.append([x / n for x in v] if n else [1.0] + [0.0] * (self.dim - 1))
        return out


class KeywordEmbedder:
    """One dimension per list of key words and one for texts with none of them; for tests."""

    def __init__(self, topics: list[list[str]]):
        self.topics, self.dim, self.model = topics, len(topics) + 1, "keywords"

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [float(any(k in t.lower() for k in topic)) for topic in self.topics]
            out.append([*v, 0.0 if any(v) else 1.0])
        return out


_REGISTRY: dict[str, Callable[..., Embedder]] = {"hashing": HashingEmbedder, "keywords": KeywordEmbedder}


def register_embedder(name: str, make: Callable[..., Embedder]) -> None:
    _REGISTRY[name] = make


def get_embedder(name: str = "hashing", **how) -> Embedder:
    if name not in _REGISTRY:
        raise ValueError(f"no embedder {name!r}; known: {', '.join(sorted(_REGISTRY))}")
    return _REGISTRY[name](**how)


def with_retry(call: Callable[[], object], attempts: int = 5, sleep: Callable[[float], None] = time.sleep) -> object:
    """The call's result; after a failure it is tried again, with waits of 1, 2, 4 .. 16 seconds."""
    for i in range(attempts):
        try:
            return call()
        except Exception:
            if i == attempts - 1:
                raise
            sleep(min(2.0**i, 16.0))
    raise AssertionError


def embed_column(embedder: Embedder, text: Column, batch: int = 64) -> Column:
    """An array<float> column; the embedder gets ``batch`` texts a call, with retries."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts = [t or "" for t in part]
            made: list[list[float]] = []
            for i in range(0, len(texts), batch):
                made += with_retry(lambda i=i: embedder.embed(texts[i : i + batch]))
            yield pd.Series(made)

    return run(text)


def usage_rows(chunks: DataFrame, embedder: Embedder, project: str = "global", chars_per_token: int = 4) -> DataFrame:
    """One ledger row for the embedding of ``chunks``: tokens are estimated from characters."""
    tokens = F.sum(F.ceil(F.length("text") / chars_per_token)).cast("long")
    return chunks.agg(F.coalesce(tokens, F.lit(0)).alias("tokens")).select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("ts"), F.lit("index").alias("source"), F.lit(project).alias("project"), F.lit(embedder.model).alias("model"), "tokens"
    )


def lexical_score(query: Column, text: Column) -> Column:
    """Share of the query's distinct words that the text has: the offline reranker, in SQL."""
    ws = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\W+"), lambda x: x != ""))
    return F.size(F.array_intersect(ws(query), ws(text))) / F.greatest(F.size(ws(query)), F.lit(1))
