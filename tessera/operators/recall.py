"""What a prompt recalls: hits packed into a token budget, and what a session has seen so far."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X

CHARS_PER_TOKEN = 4
#: Length of the line above all hits.
HEADER_CHARS = 30
STATE_MAX_AGE_SECONDS = 86_400


def pack_budget(hits: DataFrame, budget_tokens: int, *, partition: list[str] | None = None, rank: str = "rank", header_chars: int = HEADER_CHARS, header: Column | None = None, body: Column | None = None) -> DataFrame:
    """The hits, in rank order, that fit the budget; the first always does, and none follows one that doesn't.

    Each hit uses the characters of its header and body and one more.  The running sum
    only grows, so a filter on it stops where a loop would.  Adds ``used`` (characters up to and with the hit).
    """
    h = F.length(header) if header is not None else F.lit(0)
    b = F.length(body if body is not None else X.strip(F.col("text")))
    w = Window.partitionBy(*(partition or [F.lit(1)])).orderBy(rank).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = Window.partitionBy(*(partition or [F.lit(1)])).orderBy(rank)
    rows = hits.withColumn("_n", F.row_number().over(first)).withColumn("used", F.lit(header_chars) + F.sum(h + b + 1).over(w))
    return rows.filter((F.col("_n") == 1) | (F.col("used") - 1 <= budget_tokens * CHARS_PER_TOKEN)).drop("_n")


def render(packed: DataFrame, *, partition: list[str], rank: str = "rank", home: str = "~") -> DataFrame:
    """Per partition the block of text that is handed to the prompt, and its number of hits."""
    part = F.concat(X.hit_header(F.col(rank), X.short_path(F.col("file_path"), home), F.col("score"), F.col("scope")), F.lit("\n"), X.strip(F.col("text")), F.lit("\n"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), part.alias("t"))))
    return packed.groupBy(*partition).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "\n").alias("block"), F.count(F.lit(1)).alias("n_hits"))


def scope_counts(hits: DataFrame, *keys: str) -> DataFrame:
    """n_hits, n_skills (scopes with ``skill``) and n_memories (the rest)."""
    skill = F.coalesce(F.contains("scope", F.lit("skill")), F.lit(False))
    return hits.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_hits"), F.count_if(skill).alias("n_skills"), F.count_if(~skill).alias("n_memories"))


def merge_state(hits: DataFrame, *, session: str = "session_id", order: str = "seq") -> DataFrame:
    """Hits of sessions, once per (title, scope): the highest score, and all else from the first seen.

    Scores are rounded to 3.  ``order`` tells what came first.
    """
    keys = [session, "title", "scope"]
    rest = [c for c in hits.columns if c not in (*keys, "score", order)]
    aggs = [F.round(F.max("score"), 3).alias("score"), F.min(order).alias(order), *([F.min_by(F.struct(*rest), order).alias("_r")] if rest else [])]
    out = hits.groupBy(*keys).agg(*aggs)
    return out.select(*keys, "score", order, *([f"_r.{c}" for c in rest]))


def expire_state(state: DataFrame, now: Column, *, updated: str = "updated_at", max_age: int = STATE_MAX_AGE_SECONDS) -> DataFrame:
    """Sessions whose last update is no older than ``max_age`` seconds, to the microsecond.

    Updates without a time zone are held against ``now`` as the clock of the session's zone shows it.
    """
    if dict(state.dtypes)[updated] == "timestamp_ntz":
        return state.filter(now.cast("timestamp_ntz") - F.col(updated) <= F.lit(timedelta(seconds=max_age)))
    return state.filter(F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(updated).cast("timestamp")) <= max_age * 1_000_000)


def prompt_text(event: DataFrame, column: str = "event") -> DataFrame:
    """``event`` (JSON) with the prompt: the first of several fields, outer before nested, that isn't blank."""
    v = F.try_parse_json(F.col(column))
    paths = [f"$.{k}" for k in ("prompt", "user_prompt", "userPrompt")] + [f"$.{n}.{k}" for n in ("hookInput", "payload") for k in ("prompt", "user_prompt", "text")]
    found = F.coalesce(*[F.nullif(X.strip(F.try_variant_get(v, p, "string")), F.lit("")) for p in paths], F.lit(""))
    return event.withColumn("prompt", found)


def skip_reason(prompts: DataFrame, *, enabled: bool = True, min_chars: int = 1) -> DataFrame:
    """Why a prompt recalls nothing: disabled or empty; null if it does."""
    reason = F.when(F.lit(not enabled), "disabled").when(F.length(X.strip(F.coalesce("prompt", F.lit("")))) < min_chars, "empty prompt")
    return prompts.withColumn("skip_reason", reason)
