"""Tables, scopes, model and price lists."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

#: One chunk of a file in the index.
CHUNKS = T.StructType(
    [
        T.StructField("index_name", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("file_hash", T.StringType()),
        T.StructField("chunk_idx", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("heading_path", T.ArrayType(T.StringType())),
        T.StructField("scope", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("model", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("indexed_at", T.TimestampType()),
    ]
)

#: One line of the cost ledger.
LEDGER = T.StructType(
    [
        T.StructField("ts", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("project", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("tokens", T.LongType()),
        T.StructField("cost_usd", T.DoubleType()),
        T.StructField("context", T.StringType()),
    ]
)

#: One item that a session's review asks to be written.
ITEMS = T.StructType(
    [
        T.StructField("item_no", T.LongType()),
        T.StructField("category", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("rationale", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("merge_sources", T.ArrayType(T.StringType())),
    ]
)

SCOPES = ("global", "project", "skill_global", "skill_project")
CODE_SCOPE = "code"
#: What a scope's name stands for.
SCOPE_ALIASES = {
    "all": SCOPES,
    "global": ("global", "skill_global"),
    "project": ("project", "skill_project"),
    "skills": ("skill_global", "skill_project"),
}
#: Scope of each kind of directory.
KIND_SCOPES = {"memory_global": "global", "memory_project": "project", "skill_global": "skill_global", "skill_project": "skill_project"}


def expand_scopes(scope: str | list[str] | None) -> list[str]:
    """Scopes that a name or a list of names stands for, in order, each once; an unknown name stands for itself."""
    if scope is None:
        return list(SCOPES)
    names = [scope] if isinstance(scope, str) else list(scope)
    if not names:
        return list(SCOPES)
    return list(dict.fromkeys(s for n in names for s in SCOPE_ALIASES.get(n.lower(), (n,))))


@dataclass(frozen=True)
class ModelInfo:
    provider: str
    dim: int
    description: str


#: Known embedding models.
MODELS = {
    "voyage-3.5": ModelInfo("voyage", 1024, "general purpose"),
    "voyage-code-3": ModelInfo("voyage", 1024, "source code"),
    "voyage-3.5-lite": ModelInfo("voyage", 512, "lightweight"),
    "nomic-embed-text": ModelInfo("ollama", 768, "general purpose, local"),
    "mxbai-embed-large": ModelInfo("ollama", 1024, "large, local"),
    "all-minilm": ModelInfo("ollama", 384, "lightweight, local"),
    "snowflake-arctic-embed": ModelInfo("ollama", 1024, "general purpose, local"),
}
#: US dollars per million tokens, and the rate of any other model.
PRICES = {"voyage-3.5": 0.06, "voyage-3.5-lite": 0.02, "voyage-code-3": 0.18, "rerank-2-lite": 0.02}
DEFAULT_PRICE = 0.06


def dim_of(model: str) -> int | None:
    return MODELS[model].dim if model in MODELS else None


def models_of(provider: str) -> dict[str, ModelInfo]:
    return {k: v for k, v in MODELS.items() if v.provider == provider}


def local_models(listed: list[str]) -> list[str]:
    """Names of a local server's models that embed: known ones, or with ``embed`` in the name; versions dropped."""
    names = {n.split(":")[0] for n in listed}
    return sorted(n for n in names if n in models_of("ollama") or "embed" in n)
