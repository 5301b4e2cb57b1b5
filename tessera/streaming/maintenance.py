"""Incremental maintenance as streams: index edits, session state, gate at session end, ledger."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import indexing
from ..operators.recall import STATE_MAX_AGE_SECONDS
from ..sources.store import VectorStore


def index_edits(edits: DataFrame, store: VectorStore, chunker: Callable[[DataFrame], DataFrame], checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """Keep ``store`` up to date with a stream of files (file_path, text, version).

    In each batch the last version of a file counts (null text: deleted).  Files whose hash
    is stored already are passed over; of the others ``chunker`` makes rows of the store.
    A batch that is run again finds its hashes stored and changes nothing.
    """

    def apply(batch: DataFrame, _: int) -> None:
        last = batch.groupBy("file_path").agg(F.max_by("text", "version").alias("text"))
        hashed = last.withColumn("file_hash", F.when(F.col("text").isNotNull(), F.sha2(F.encode("text", "UTF-8"), 256)))
        base = store.manifest()["version"]
        stored = store.files(base).join(last.select("file_path"), "file_path", "left_semi")
        plan = indexing.change_plan(hashed.filter("file_hash IS NOT NULL"), stored)
        changed = hashed.join(plan.filter("status IN ('new', 'changed')").select("file_path"), "file_path", "left_semi")
        store.apply(plan, chunker(changed), base=base)

    writer = edits.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


STATE = "titles array<string>, scopes array<string>, scores array<double>"
OUT = "session_id string, n_hits long, n_skills long, n_memories long, titles array<string>, expired boolean"


def session_state(hits: DataFrame, *, max_age_seconds: int = STATE_MAX_AGE_SECONDS) -> DataFrame:
    """What each session has recalled so far, from a stream of hits (session_id, title, scope, score).

    A hit counts once per (title, scope), with its highest score.  A session without hits for
    ``max_age_seconds`` of processing time ends: its counts are put out once more, as expired.
    """

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        titles, scopes, scores = (list(x) for x in state.get) if state.exists else ([], [], [])
        if state.hasTimedOut:
            state.remove()
        else:
            at = {k: i for i, k in enumerate(zip(titles, scopes, strict=True))}
            for p in parts:
                for t, s, x in zip(p["title"], p["scope"], p["score"], strict=True):
                    if (t, s) in at:
                        scores[at[t, s]] = max(scores[at[t, s]], round(float(x), 3))
                    else:
                        at[t, s] = len(titles)
                        titles.append(t)
                        scopes.append(s)
                        scores.append(round(float(x), 3))
            state.update((titles, scopes, scores))
            state.setTimeoutDuration(max_age_seconds * 1000)
        skills = sum("skill" in s for s in scopes)
        yield pd.DataFrame({"session_id": [key[0]], "n_hits": [len(titles)], "n_skills": [skills], "n_memories": [len(titles) - skills], "titles": [titles], "expired": [state.hasTimedOut]})

    return hits.groupBy("session_id").applyInPandasWithState(update, OUT, STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)


def closed_sessions(turns: DataFrame, *, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Sessions that ended, from a stream of turns (session_id, ts, role): span, messages of users and turns.

    A session ends when no turn has come for ``gap``; turns later than ``delay`` are dropped.
    """
    w = F.session_window("ts", gap)
    out = turns.withWatermark("ts", delay).groupBy("session_id", w.alias("w")).agg(F.count_if(F.col("role") == "user").alias("n_user_messages"), F.count(F.lit(1)).alias("n_turns"))
    return out.select("session_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n_user_messages", "n_turns")


def daily_costs(entries: DataFrame, *, delay: str = "1 day") -> DataFrame:
    """Costs by day and source, from a stream of ledger entries (ts, source, cost_usd, tokens)."""
    out = entries.withWatermark("ts", delay).groupBy(F.window("ts", "1 day").alias("w"), "source").agg(F.sum("cost_usd").alias("cost_usd"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
    return out.select(F.to_date("w.start").alias("day"), "source", F.round("cost_usd", 6).alias("cost_usd"), "tokens", "n")


def running_spend(entries: DataFrame) -> DataFrame:
    """Spend by source since the stream began (for the budget's cap)."""
    return entries.groupBy("source").agg(F.round(F.sum("cost_usd"), 6).alias("spent"), F.count(F.lit(1)).alias("n"))
