"""Review of sessions by a plug-in: prompts, calls with bounded concurrency, replies that are kept."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import exists, names_in

MANY = 30
REPLY = "report string, error string, attempts int"


def title_lines(titles: list[str], shown: int = MANY) -> str:
    """Titles as a list in a prompt; beyond ``shown`` only their number."""
    if not titles:
        return "  (none)"
    more = [f"  - … and {len(titles) - shown} more"] if len(titles) > shown else []
    return "\n".join([*(f'  - "{t}"' for t in titles[:shown]), *more])


def context(project_root: str | None, global_titles: list[str], project_titles: list[str], skills: list[str]) -> str:
    """What a reviewer must know of the memory, the same for all sessions of a run."""
    crowded = "\n- There are many project memories: merge those that belong together." if len(project_titles) >= MANY else ""
    return (
        f"# Context\n\n- Project: {project_root or '(none)'}\n- Memories: {len(global_titles)} global, {len(project_titles)} of the project{crowded}\n\n"
        f"Global memories (a title used again, letter by letter, replaces that memory):\n{title_lines(global_titles)}\n\n"
        f"Memories of the project (the same holds):\n{title_lines(project_titles)}\n\nSkills:\n{title_lines(skills)}\n"
    )


def prompts(markdown: DataFrame, context: str, *, session: str = "session_id") -> DataFrame:
    """session and prompt, for sessions as Markdown (session, markdown)."""
    task = "# Task\n\nName what is worth keeping. Merge or delete memories that are superfluous. Answer with one JSON object: should_persist, summary, items.\n"
    return markdown.select(session, F.concat(F.lit(context), F.lit("\n# Session\n\n"), F.col("markdown"), F.lit("\n\n" + task)).alias("prompt"))


def ask(asked: DataFrame, call: Callable[[str], str], kept: str, *, session: str = "session_id", wave: int = 256, tasks: int = 8, threads: int = 4, retries: int = 2, pause: float = 1.0, again: bool = False) -> DataFrame:
    """Replies of ``call`` to all prompts (session, prompt): session, report, error, attempts.

    At most ``tasks * threads`` calls run at a time.  A call that fails is repeated ``retries`` times after
    ``pause`` seconds, twice as long each time; its last error is the reply then.  Sessions are asked in waves
    of about ``wave``, and the replies of a wave are added to the Parquet folder ``kept`` before the next: a run
    that is cut off asks only the waves without a mark again, and sessions that have a reply are never asked.
    With ``again`` those that have an error are.  Repeated rows of a session are asked once; a null prompt is empty.
    """
    spark, kind = asked.sparkSession, dict(asked.dtypes)[session]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(prompt: str) -> tuple[str | None, str | None, int]:
            for i in range(retries + 1):
                try:
                    return call(prompt), None, i + 1
                except Exception as error:  # noqa: BLE001  a plug-in may raise anything
                    text = f"{type(error).__name__}: {error}"
                    if i < retries:
                        time.sleep(pause * 2**i)
            return None, text, retries + 1

        with ThreadPoolExecutor(threads) as pool:
            for p in parts:
                got = list(pool.map(one, p["prompt"]))
                yield pd.DataFrame({session: p[session], "report": [g[0] for g in got], "error": [g[1] for g in got], "attempts": [g[2] for g in got]})

    def replies() -> DataFrame:
        waves = [n for n in names_in(spark, kept) if n.startswith("wave=") and exists(spark, f"{kept}/{n}/_SUCCESS")]
        if not waves:
            return spark.createDataFrame([], f"{session} {kind}, {REPLY}")
        rows = spark.read.schema(f"{session} {kind}, {REPLY}").parquet(*[f"{kept}/{n}" for n in waves])
        # An error counts only until a report comes.
        best = F.struct(F.col("report").isNotNull().alias("ok"), "attempts", "report", "error")
        return rows.groupBy(session).agg(F.max(best).alias("_b")).select(session, "_b.report", "_b.error", "_b.attempts")

    known = replies()
    known = known.filter("report IS NOT NULL") if again else known
    open_ = asked.groupBy(session).agg(F.coalesce(F.first("prompt"), F.lit("")).alias("prompt")).join(known.select(session), session, "left_anti")
    before = len([n for n in names_in(spark, kept) if n.startswith("wave=")])
    n = open_.count()
    waves = -(-n // wave)
    for i in range(waves):
        part = open_.filter(F.pmod(F.xxhash64(session), F.lit(waves)) == i) if waves > 1 else open_
        part.repartition(tasks, session).mapInPandas(run, f"{session} {kind}, {REPLY}").write.mode("overwrite").parquet(f"{kept}/wave={before + i:06d}")
    return replies()
