"""Configuration: defaults under global under project files, in TOML."""

from __future__ import annotations

import copy
import os
import tomllib
from pathlib import Path

from .operators.sessions import SKIP_PATTERNS

DEFAULTS: dict = {
    "embeddings": {"provider": "hashing", "dim": 64, "batch_size": 64},
    "storage": {"root": "~/.tessera", "project_marker": ".tessera"},
    "review": {"enabled": True, "max_budget_usd": None, "gate": {"min_user_messages": 3, "skip_patterns": list(SKIP_PATTERNS), "judge_enabled": False}},
    "recall": {"enabled": True, "top_k": 5, "budget_tokens": 2000, "scopes": ["project", "global", "skills"], "rerank": True},
    "code": {"chunk_lines": 40, "ignore": ["node_modules", ".venv", "venv", "dist", "build", ".git"]},
}
ROOT_VARIABLE = "TESSERA_HOME"


def deep_merge(base: dict, over: dict) -> dict:
    """``over`` on ``base``: tables are merged, all else is replaced."""
    out = copy.deepcopy(base)
    for k, v in over.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def find_project_root(start: str | Path, marker: str = ".tessera") -> Path | None:
    """The nearest directory upwards that holds the marker or a .git."""
    for d in (Path(start).resolve(), *Path(start).resolve().parents):
        if (d / marker).exists() or (d / ".git").exists():
            return d
    return None


def _read(path: Path) -> dict:
    return tomllib.loads(path.read_text("utf-8")) if path.exists() else {}


def load_config(project_root: str | Path | None = None) -> dict:
    """Defaults, then the global file, then the project's; the environment decides the root."""
    root = Path(os.environ.get(ROOT_VARIABLE) or DEFAULTS["storage"]["root"]).expanduser()
    config = deep_merge(DEFAULTS, _read(root / "config.toml"))
    if project_root:
        config = deep_merge(config, _read(Path(project_root) / config["storage"]["project_marker"] / "config.toml"))
        config["project_root"] = str(project_root)
    if os.environ.get(ROOT_VARIABLE):
        config["storage"]["root"] = os.environ[ROOT_VARIABLE]
    return config


def get_key(config: dict, dotted: str) -> object:
    """The value at a path of keys parted by dots; KeyError if there is none."""
    at: object = config
    for k in dotted.split("."):
        if not isinstance(at, dict) or k not in at:
            raise KeyError(dotted)
        at = at[k]
    return at


def set_key(config: dict, dotted: str, value: str) -> dict:
    """``config`` with a value set; texts like true, 3 and 0.5 become what they look like."""
    out = copy.deepcopy(config)
    *above, last = dotted.split(".")
    at = out
    for k in above:
        at = at.setdefault(k, {})
        if not isinstance(at, dict):
            raise KeyError(dotted)
    at[last] = typed(value)
    return out


def typed(value: str) -> object:
    if value.lower() in ("true", "false"):
        return value.lower() == "true"
    for kind in (int, float):
        try:
            return kind(value)
        except ValueError:
            continue
    return value


def is_secret(key: str) -> bool:
    return any(w in key.lower() for w in ("api_key", "token", "secret"))


def masked(config: dict) -> dict:
    """``config`` for display: what secrets hold is hidden."""
    return {k: masked(v) if isinstance(v, dict) else ("***" if is_secret(k) and v else v) for k, v in config.items()}


def to_toml(config: dict, prefix: str = "") -> str:
    """TOML text of a configuration; None is left out."""

    def literal(v: object) -> str:
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, (int, float)):
            return repr(v)
        if isinstance(v, (list, tuple)):
            return "[" + ", ".join(map(literal, v)) + "]"
        return '"' + str(v).replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'

    plain = [f"{k} = {literal(v)}" for k, v in config.items() if v is not None and not isinstance(v, dict)]
    out = "\n".join(([f"[{prefix}]"] if prefix and plain else []) + plain)
    tables = [to_toml(v, f"{prefix}.{k}" if prefix else k) for k, v in config.items() if isinstance(v, dict)]
    return "\n\n".join(x for x in [out, *tables] if x)
