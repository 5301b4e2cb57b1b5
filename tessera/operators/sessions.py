"""Session logs: turns out of event lines, counts, the gate, condensed and rendered forms, digests."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X

#: Stands in a turn's text where a tool's result was.
TOOL_RESULT = "[tool_result]"
WRITE_TOOLS = ("Write", "Edit", "MultiEdit", "NotebookEdit")
#: What a user's message may be without being worth a review.
SKIP_PATTERNS = ("^commit( this)?$", "^push( this)?$", "^run tests?$", "^fix the typo$")
MIN_USER_MESSAGES, LONG_SESSION = 3, 6
_CAVEAT = "local-command-caveat"


def parse_events(lines: DataFrame, *, value: str = "value", file: str = "file", line_no: str = "line_no") -> DataFrame:
    """Turns out of event lines (JSON): file, session_id, cwd, turn, role, text, tool_uses, timestamp.

    Blank and malformed lines are passed over, as are events that aren't of a user or an
    assistant, and user events that are meta or caveats.  session_id and cwd are the file's
    first that are texts.  Content is a text or a list of blocks: texts are joined, tool uses
    listed (name, input as JSON), tool results marked.
    """
    v = F.try_parse_json(F.col(value))
    get = lambda p, t="string": F.try_variant_get(F.col("_v"), p, t)
    typed = lambda p: F.when(F.schema_of_variant(F.try_variant_get(F.col("_v"), p, "variant")) == "STRING", get(p))
    rows = lines.filter(X.strip(F.col(value)) != "").withColumn("_v", v).filter(F.col("_v").isNotNull())
    whole = Window.partitionBy(file).orderBy(line_no).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.select(
        file,
        line_no,
        F.first(typed("$.sessionId"), ignorenulls=True).over(whole).alias("session_id"),
        F.first(typed("$.cwd"), ignorenulls=True).over(whole).alias("cwd"),
        get("$.type").alias("type"),
        F.coalesce(get("$.isMeta", "boolean"), F.lit(False)).alias("meta"),
        get("$.timestamp").alias("timestamp"),
        F.coalesce(get("$.message.role"), get("$.type")).alias("role"),
        F.try_variant_get(F.col("_v"), "$.message.content", "variant").alias("_c"),
    ).filter(F.col("type").isin("user", "assistant"))
    blocks = F.try_variant_get(F.col("_c"), "$", "array<variant>")  # an array must be tried before a text
    of = lambda b, p: F.try_variant_get(b, p, "string")
    is_list = F.schema_of_variant(F.col("_c")).startswith("ARRAY")
    texts = F.filter(
        F.transform(blocks, lambda b: F.when(of(b, "$.type") == "text", of(b, "$.text")).when(of(b, "$.type") == "tool_result", F.lit(TOOL_RESULT))), lambda t: t.isNotNull()
    )
    tools = F.transform(
        F.filter(blocks, lambda b: F.coalesce(of(b, "$.type") == "tool_use", F.lit(False))),
        lambda b: F.struct(of(b, "$.name").alias("name"), F.to_json(F.try_variant_get(b, "$.input", "variant")).alias("input")),
    )
    none = F.array().cast("array<struct<name:string,input:string>>")
    text = F.when(is_list, X.strip(F.array_join(texts, "\n"))).when(F.schema_of_variant(F.col("_c")) == "STRING", F.try_variant_get(F.col("_c"), "$", "string")).otherwise("")
    turns = rows.withColumn("text", F.coalesce(text, F.lit(""))).withColumn("tool_uses", F.coalesce(F.when(is_list, tools), none))
    turns = turns.filter(~((F.col("type") == "user") & (F.col("meta") | F.contains("text", F.lit(_CAVEAT)))))
    turn = F.row_number().over(Window.partitionBy(file).orderBy(line_no)) - 1
    return turns.select(file, "session_id", "cwd", turn.alias("turn"), "role", "text", "tool_uses", "timestamp")


def is_real_user(role: str = "role", text: str = "text") -> Column:
    """A user's turn with words of the user's own, not only marks of tool results."""
    return (F.col(role) == "user") & (X.strip(F.replace(F.coalesce(text, F.lit("")), F.lit(TOOL_RESULT), F.lit(""))) != "")


def user_turns(turns: DataFrame) -> DataFrame:
    return turns.filter((F.col("role") == "user") & (X.strip("text") != ""))


def real_user_turns(turns: DataFrame) -> DataFrame:
    return turns.filter(is_real_user())


def assistant_turns(turns: DataFrame) -> DataFrame:
    return turns.filter(F.col("role") == "assistant")


def _paths(tool_uses: Column) -> Column:
    """Paths that writing tools were given, repeats kept."""
    path = lambda t: F.coalesce(F.nullif(F.get_json_object(t["input"], "$.file_path"), F.lit("")), F.get_json_object(t["input"], "$.notebook_path"))
    return F.filter(F.transform(F.filter(tool_uses, lambda t: t["name"].isin(*WRITE_TOOLS)), path), lambda p: p.isNotNull())


def file_writes(turns: DataFrame, *, session: str = "session_id") -> DataFrame:
    """session, turn and path of every file that a session wrote or edited."""
    return assistant_turns(turns).select(session, "turn", F.explode(_paths(F.col("tool_uses"))).alias("path"))


def edited_paths(event: DataFrame, column: str = "event") -> DataFrame:
    """``event`` (JSON of a tool call) with paths: its file, its notebook and those of its edits, each once, in order."""
    v = F.try_parse_json(F.col(column))
    g = lambda p: F.try_variant_get(v, p, "string")
    edits = F.transform(F.coalesce(F.try_variant_get(v, "$.tool_input.edits", "array<variant>"), F.array().cast("array<variant>")), lambda e: F.try_variant_get(e, "$.file_path", "string"))
    found = F.array_distinct(F.filter(F.concat(F.array(g("$.tool_input.file_path"), g("$.tool_input.notebook_path")), edits), lambda p: p.isNotNull()))
    return event.withColumn("paths", F.when(g("$.tool_name").isin(*WRITE_TOOLS), found).otherwise(F.array().cast("array<string>")))


def valid_patterns(patterns: tuple[str, ...]) -> list[str]:
    """Patterns that compile; others are passed over."""
    out = []
    for p in patterns:
        try:
            re.compile(p)
        except re.error:
            continue
        out.append(p)
    return out


def matches_any(text: Column, patterns: tuple[str, ...]) -> Column:
    """Whether a pattern is found in the stripped text, whatever the case."""
    ok = valid_patterns(patterns)
    return X.strip(text).rlike("(?i)" + "|".join(f"(?:{p})" for p in ok)) if ok else F.lit(False)


def session_counts(turns: DataFrame, *, session: str = "session_id", patterns: tuple[str, ...] = SKIP_PATTERNS) -> DataFrame:
    """Per session n_user_messages, n_file_writes and all_trivial (every user message matches a pattern)."""
    real = is_real_user()
    writes = F.when(F.col("role") == "assistant", F.size(_paths(F.col("tool_uses")))).otherwise(0) if "tool_uses" in turns.columns else F.lit(0)
    hit = F.when(real, matches_any(F.col("text"), patterns))
    return turns.groupBy(session).agg(
        F.count_if(real).alias("n_user_messages"), F.coalesce(F.sum(writes), F.lit(0)).cast("long").alias("n_file_writes"), F.coalesce(F.bool_and(hit), F.lit(False)).alias("all_trivial")
    )


def gate(counts: DataFrame, *, min_user_messages: int = MIN_USER_MESSAGES, long_session: int = LONG_SESSION) -> DataFrame:
    """Whether each session is worth a review: decision, category and reason, by the first rule that holds."""
    u, w = F.col("n_user_messages"), F.col("n_file_writes")
    few, trivial, short = u < min_user_messages, F.col("all_trivial"), (w == 0) & (u < long_session)
    return (
        counts.withColumn("decision", F.when(few | trivial | short, "skip").otherwise("run"))
        .withColumn("category", F.when(few | trivial, "trivial").when(short, "discussion").when(w > 0, "implementation").otherwise("discussion"))
        .withColumn(
            "reason",
            F.when(few, F.format_string(f"only %d user messages (min={min_user_messages})", u))
            .when(trivial, "all user messages matched skip patterns")
            .when(short, "no file writes and short session (likely Q&A)")
            .otherwise(F.format_string("%d user messages, %d file writes", u, w)),
        )
    )


def judge(gated: DataFrame, condensed: DataFrame, call: Callable[[str], tuple[bool, str]] | None, *, session: str = "session_id") -> DataFrame:
    """Ask ``call`` about sessions that the gate lets pass as discussions; any failure lets them pass."""
    if call is None:
        return gated
    ask = gated.filter("decision = 'run' AND category = 'discussion'").select(session).join(condensed, session)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for t in p["condensed"]:
                try:
                    out.append(call(t))
                except Exception as e:
                    out.append((True, f"judge failed: {e}"))
            yield pd.DataFrame({session: p[session], "_run": [bool(x[0]) for x in out], "_why": [str(x[1]) for x in out]})

    got = ask.mapInPandas(run, f"{session} {dict(gated.dtypes)[session]}, _run boolean, _why string")
    return (
        gated.join(got, session, "left")
        .withColumn("decision", F.when(F.col("_run").isNull() | F.col("_run"), F.col("decision")).otherwise("skip"))
        .withColumn("reason", F.coalesce("_why", "reason"))
        .drop("_run", "_why")
    )


def condense(turns: DataFrame, *, session: str = "session_id", max_turns: int = 15, max_chars: int = 500) -> DataFrame:
    """Per session the first user messages as a list, each cut at ``max_chars``, and how many more there are."""
    w = Window.partitionBy(session).orderBy("turn")
    rows = real_user_turns(turns).withColumn("_n", F.row_number().over(w))
    t = X.strip("text")
    line = F.concat(F.lit("- "), F.when(F.length(t) > max_chars, F.concat(F.substring(t, 1, max_chars), F.lit(" [...]"))).otherwise(t))
    some = F.array_sort(F.collect_list(F.when(F.col("_n") <= max_turns, F.struct("_n", line.alias("l")))))
    out = rows.groupBy(session).agg(some.alias("_l"), F.count(F.lit(1)).alias("_k"))
    more = F.when(F.col("_k") > max_turns, F.concat(F.lit("- ["), (F.col("_k") - max_turns).cast("string"), F.lit(" more messages omitted]")))
    return out.select(session, F.concat_ws("\n", F.transform("_l", lambda x: x["l"]), more).alias("condensed"))


def _summary(inp: Column) -> Column:
    """What a tool was called with: the first of some keys, else the names of the first two."""
    keys = F.json_object_keys(inp)
    first = [F.when(F.get_json_object(inp, f"$.{k}").isNotNull(), F.concat(F.lit(f"{k}="), F.substring(F.get_json_object(inp, f"$.{k}"), 1, 80))) for k in ("file_path", "notebook_path", "command", "pattern", "url")]
    return F.coalesce(*first, F.array_join(F.slice(keys, 1, 2), ","), F.lit(""))


def markdown(turns: DataFrame, *, session: str = "session_id", max_chars: int = 4000) -> DataFrame:
    """Per session its turns as Markdown; texts are cut at ``max_chars``, tool uses summed up in one line."""
    t = X.strip(F.coalesce("text", F.lit("")))
    tools = F.col("tool_uses") if "tool_uses" in turns.columns else F.array().cast("array<struct<name:string,input:string>>")
    head = F.when(F.col("role") == "user", "## USER\n").otherwise("## ASSISTANT\n")
    body = F.when(t != "", F.when(F.length(t) > max_chars, F.concat(F.substring(t, 1, max_chars), F.lit("\n[…truncated…]"))).otherwise(t))
    used = F.when(F.size(tools) > 0, F.concat(F.lit("\n_tools: "), F.array_join(F.transform(tools, lambda x: F.concat(F.coalesce(x["name"], F.lit("?")), F.lit("("), _summary(x["input"]), F.lit(")"))), ", "), F.lit("_")))
    rows = turns.filter((t != "") | (F.size(tools) > 0)).select(session, "turn", F.concat_ws("\n", head, body, used, F.lit("")).alias("_t"))
    ordered = F.array_sort(F.collect_list(F.struct("turn", "_t")))
    return rows.groupBy(session).agg(F.array_join(F.transform(ordered, lambda x: x["_t"]), "\n").alias("markdown"))


def digest(gated: DataFrame, records: DataFrame | None, now: str, *, session: str = "session_id", cwd: str | None = None, replies: DataFrame | None = None, raw_chars: int = 8000) -> DataFrame:
    """One digest per session: name of its file and text, with front matter, the gate's verdict and a table of what was written.

    ``replies`` (session, report, error, should_persist, summary, items) adds what the reviewer said, or the
    error, and up to ``raw_chars`` of the report itself.
    """
    s = F.coalesce(F.col(session).cast("string"), F.lit("unknown"))
    place = F.coalesce(F.col(cwd), F.lit("-")) if cwd else F.lit("-")
    front = X.yaml_front([("session_id", s), ("timestamp", F.lit(now)), ("cwd", place), ("gate_decision", F.col("decision")), ("category", F.col("category")), ("user_messages", F.col("n_user_messages").cast("string")), ("file_writes", F.col("n_file_writes").cast("string"))])
    rows = gated
    table = F.lit(None).cast("string")
    if records is not None:
        path = F.when(F.coalesce("path", F.lit("")) == "", "-").otherwise(F.concat(F.lit("`"), F.col("path"), F.lit("`")))
        line = X.table_row(F.col("status"), F.col("category"), F.col("title"), path, F.col("reason"))
        listed = records.groupBy(session).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("record_no", line.alias("l")))), lambda x: x["l"]), "\n").alias("_rows"))
        rows = gated.join(listed, session, "left")
        table = F.when(F.col("_rows").isNotNull(), F.concat(F.lit("## Items written\n\n| Status | Category | Title | Path | Reason |\n|---|---|---|---|---|\n"), F.col("_rows")))
    said, failed, raw = (F.lit(None).cast("string"),) * 3
    if replies is not None:
        own = F.struct(*[F.col(c) for c in ("report", "error", "should_persist", "summary", "items")])
        rows = rows.join(replies.select(session, own.alias("_reply")), session, "left")
        r = lambda k: F.col(f"_reply.{k}")
        summary = F.coalesce(F.nullif(r("summary"), F.lit("")), F.lit("_(none)_"))
        lines = F.concat_ws("\n", F.lit("## Review"), summary, F.concat(F.lit("\n- Persist: "), r("should_persist").cast("string")), F.concat(F.lit("- Items: "), F.size(r("items")).cast("string")))
        said = F.when(r("report").isNotNull(), lines)
        failed = F.when(r("error").isNotNull(), F.concat(F.lit("## Error\n```\n"), r("error"), F.lit("\n```")))
        raw = F.when(r("report").isNotNull(), F.concat(F.lit("<details><summary>Reply</summary>\n\n```json\n"), F.substring(r("report"), 1, raw_chars), F.lit("\n```\n</details>")))
    verdict = F.concat_ws("\n", F.lit("## Gate"), F.concat(F.lit("- Decision: **"), F.col("decision"), F.lit("**")), F.concat(F.lit("- Reason: "), F.col("reason")), F.concat(F.lit("- Category: "), F.col("category")))
    text = F.concat_ws("\n\n", front, F.lit(f"# Session digest — {now[:16].replace('T', ' ')}"), verdict, F.when(F.col("decision") == "skip", "_Not reviewed._"), said, table, failed, raw)
    name = F.concat(F.lit(re.sub(r"[:]", "", now[:19]) + "-"), F.substring(s, 1, 8), F.lit(".md"))
    return rows.select(session, name.alias("file_name"), text.alias("digest"))


def latest(digests: DataFrame, n: int = 10, *, name: str = "file_name") -> DataFrame:
    """The ``n`` last digests by name."""
    return digests.orderBy(F.desc(name)).limit(n)


def session_plan(gated: DataFrame, spent: DataFrame, *, session: str = "session_id") -> DataFrame:
    """What happens at the end of each session: digest (skipped), over_budget or review; ``spent`` is one row of ``over_budget``."""
    step = F.when(F.col("decision") == "skip", "digest").when(F.col("exceeded"), "over_budget").otherwise("review")
    return gated.crossJoin(F.broadcast(spent.select("exceeded"))).withColumn("step", step).drop("exceeded")  # one row


def payload(reports: DataFrame, column: str = "report") -> DataFrame:
    """``reports`` with items out of an agent's JSON report: structured output, else result, else content, decoded twice if a text."""
    v = F.try_parse_json(F.col(column))
    get = lambda k: F.try_variant_get(v, f"$.{k}", "variant")
    raw = F.coalesce(get("structured_output"), get("result"), get("content"))
    p = F.when(F.schema_of_variant(raw) == "STRING", F.try_parse_json(F.try_variant_get(raw, "$", "string"))).otherwise(raw)
    item = "array<struct<category:string,action:string,title:string,content:string,rationale:string,tags:array<string>,merge_sources:array<string>>>"
    out = reports.withColumn("_p", p)
    g = lambda path, t: F.try_variant_get(F.col("_p"), path, t)
    return out.select(
        *reports.columns, F.coalesce(g("$.should_persist", "boolean"), F.lit(False)).alias("should_persist"), F.coalesce(g("$.summary", "string"), F.lit("")).alias("summary"), F.coalesce(F.from_json(F.to_json(g("$.items", "variant")), item), F.array().cast(item)).alias("items")
    )
