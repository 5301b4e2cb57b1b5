"""Chunking of text, Markdown and source code; one row in, its chunks out, all without shuffles."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import bounded_batches
from .definitions import top_level_spans

CHUNK_LINES, OVERLAP = 40, 0.25
MAX_CHARS, MIN_PIECE = 1500, 120
MAX_FILE_BYTES = 500_000
_HEADING = r"^(#{1,6})\s+(.+?)\s*$"


def _windows(lines: Column, first: Column, size: int, overlap: int) -> Column:
    """Windows over lines as (start_line, end_line, text), the first line being number ``first``; blank ones are left out."""
    n = F.size(lines)
    step = max(1, size - overlap)
    starts = F.when(n > 0, F.filter(F.sequence(F.lit(0), n - 1, F.lit(step)), lambda s: (s == 0) | (s + F.lit(size - step) < n))).otherwise(F.array().cast("array<int>"))
    made = F.transform(
        starts,
        lambda s: F.struct(
            (s + first).cast("int").alias("start_line"), (F.least(s + size, n) + first - 1).cast("int").alias("end_line"), F.array_join(F.slice(lines, s + 1, F.lit(size)), "\n").alias("text")
        ),
    )
    return F.filter(made, lambda w: X.not_blank(w["text"]))


def chunk_lines(files: DataFrame, *, text: str = "text", size: int = CHUNK_LINES, overlap: float = OVERLAP) -> DataFrame:
    """``files`` with one row per window of ``size`` lines: chunk_idx, start_line, end_line and the window as ``text``.

    Windows overlap by a share of their size and stop with the one that reaches the end.
    Blank windows are dropped and take no number; null and empty texts have none.
    """
    windows = X.let(X.split_lines(F.coalesce(F.col(text), F.lit(""))), lambda x: _windows(x, F.lit(1), size, int(size * overlap)))
    out = files.withColumn("_w", windows).drop(*[c for c in (text, "chunk_idx", "start_line", "end_line") if c in files.columns])
    # The outer form, as the other would make every text's windows twice: once for a filter on their number.
    out = out.select("*", F.posexplode_outer("_w").alias("chunk_idx", "_c")).drop("_w").filter("chunk_idx IS NOT NULL")
    return out.select(*[c for c in out.columns if c != "_c"], "_c.start_line", "_c.end_line", F.col("_c.text").alias(text))


def sections(body: Column, *, fence_aware: bool = False) -> Column:
    """Sections of Markdown as array of (path, text): headings above, and the text between them.

    A heading ends all open headings of its level or a deeper one.  Sections without text
    are left out; a body without sections is one section without headings.  With
    ``fence_aware``, lines in fenced code are no headings.
    """
    head, place, out_type = "struct<level:int,title:string>", "struct<start:int,path:array<string>>", "array<struct<path:array<string>,text:string>>"

    def event(line: Column, i: Column) -> Column:
        """A heading, or with level 0 a mark of fenced code; null for any other line."""
        found = F.struct(i.alias("i"), F.length(F.regexp_extract(line, _HEADING, 1)).alias("level"), F.regexp_extract(line, _HEADING, 2).alias("title"))
        out = F.when(line.startswith("#"), X.let(found, lambda f: F.when(f["level"] > 0, f)))
        return out.when(line.rlike(r"^\s*(```|~~~)"), F.struct(i.alias("i"), F.lit(0).alias("level"), F.lit(None).cast("string").alias("title"))) if fence_aware else out

    # Only headings and marks are gone through one by one; a section's lines are a slice.
    empty = F.struct(F.array().cast(f"array<{head}>").alias("stack"), F.array(F.struct(F.lit(0).alias("start"), F.array().cast("array<string>").alias("path")).cast(place)).alias("out"), F.lit(False).alias("fence"))

    def step(s: Column, e: Column) -> Column:
        pushed = F.concat(F.filter(s["stack"], lambda h: h["level"] < e["level"]), F.array(F.struct(e["level"].alias("level"), e["title"].alias("title")).cast(head)))
        opened = lambda stack: F.struct(stack.alias("stack"), F.concat(s["out"], F.array(F.struct((e["i"] + 1).alias("start"), F.transform(stack, lambda h: h["title"]).alias("path")).cast(place))).alias("out"), s["fence"].alias("fence"))
        as_is = lambda fence: F.struct(s["stack"].alias("stack"), s["out"].alias("out"), fence.alias("fence"))
        return F.when(e["level"] == 0, as_is(~s["fence"])).when(s["fence"], as_is(s["fence"])).otherwise(X.let(pushed, opened))

    def cut(lines: Column) -> Column:
        events = F.filter(F.transform(lines, event), lambda e: e.isNotNull())
        places = F.aggregate(events, empty, step, lambda s: s["out"])

        def texts(at: Column) -> Column:
            end = lambda j: F.coalesce(F.get(at, j + 1)["start"] - 1, F.size(lines))
            made = F.transform(at, lambda o, j: F.struct(o["path"].alias("path"), X.strip(F.array_join(F.slice(lines, o["start"] + 1, F.greatest(end(j) - o["start"], F.lit(0))), "\n")).alias("text")))
            return F.filter(made, lambda x: x["text"] != "")

        return X.let(places, texts)

    whole = lambda x: F.array(F.struct(F.array().cast("array<string>").alias("path"), x.alias("text")))
    rest = X.let(X.strip(body), lambda x: F.when(x != "", whole(x)).otherwise(F.array().cast(out_type)))
    return X.let(X.let(X.split_lines(body), cut), lambda found: F.when(F.size(found) > 0, found).otherwise(rest))


def pack_paragraphs(body: Column, max_chars: int = MAX_CHARS) -> Column:
    """Pieces of at most ``max_chars`` made of whole paragraphs in order; a longer paragraph is a piece of its own."""
    paragraphs = F.filter(F.transform(F.split(body, r"\n{2,}", -1), X.strip), lambda p: p != "")
    # Ends of pieces, and the number and length of what is open: a piece is a slice of the paragraphs.
    start = F.struct(F.array().cast("array<int>").alias("ends"), F.lit(0).alias("open"), F.lit(0).alias("n"), F.lit(0).alias("at"))

    def step(s: Column, size: Column) -> Column:
        full = (s["n"] + size + 2 > max_chars) & (s["open"] > 0)
        new = F.struct(F.concat(s["ends"], F.array(s["at"])).alias("ends"), F.lit(1).alias("open"), size.alias("n"), (s["at"] + 1).alias("at"))
        return F.when(full, new).otherwise(F.struct(s["ends"].alias("ends"), (s["open"] + 1).alias("open"), (s["n"] + size + 2).alias("n"), (s["at"] + 1).alias("at")))

    def packed(ps: Column) -> Column:
        ends = F.aggregate(F.transform(ps, F.length), start, step, lambda s: F.when(s["open"] > 0, F.concat(s["ends"], F.array(s["at"]))).otherwise(s["ends"]))
        begin = lambda all_, j: F.coalesce(F.get(all_, j - 1), F.lit(0))
        return X.let(ends, lambda all_: F.transform(all_, lambda e, j: F.array_join(F.slice(ps, begin(all_, j) + 1, e - begin(all_, j)), "\n\n")))

    return F.when(F.length(body) <= max_chars, F.array(body)).otherwise(X.let(paragraphs, packed))


def chunk_markdown(files: DataFrame, *, body: str = "body", max_chars: int = MAX_CHARS, min_piece: int = MIN_PIECE, fence_aware: bool = False) -> DataFrame:
    """``files`` with one row per chunk: chunk_idx, heading_path, text, display_text.

    Sections of more than ``max_chars`` are packed by paragraph, and their pieces of less
    than ``min_piece`` dropped; numbers run over what is kept.  If nothing is, a body that
    isn't blank is one chunk.
    """
    b = F.coalesce(F.col(body), F.lit(""))

    def pieces(s: Column) -> Column:
        keep = lambda parts: F.filter(parts, lambda p: X.not_blank(p) & ((F.size(parts) <= 1) | (F.length(X.strip(p)) >= min_piece)))
        return F.transform(X.let(pack_paragraphs(s["text"], max_chars), keep), lambda p: F.struct(s["path"].alias("path"), p.alias("text")))

    found = F.flatten(F.transform(sections(b, fence_aware=fence_aware), pieces))
    whole = F.array(F.struct(F.array().cast("array<string>").alias("path"), X.strip(b).alias("text")))
    chunks = X.let(found, lambda x: F.when((F.size(x) == 0) & X.not_blank(b), whole).otherwise(x))
    out = files.withColumn("_c", chunks).drop(*[c for c in ("chunk_idx", "heading_path", "text", "display_text") if c in files.columns and c != body])
    out = out.select("*", F.posexplode_outer("_c").alias("chunk_idx", "_p")).drop("_c", body).filter("chunk_idx IS NOT NULL")  # outer as in chunk_lines
    return out.select(*[c for c in out.columns if c != "_p"], F.col("_p.path").alias("heading_path"), F.col("_p.text").alias("text"), X.breadcrumb(F.col("_p.path"), F.col("_p.text")).alias("display_text"))


def regions(n_lines: int, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans and the gaps between them, in order, over lines 1 to ``n_lines``."""
    out, at = [], 1
    for a, b in sorted(spans):
        if a > at:
            out.append((at, a - 1))
        if b >= at:
            out.append((max(a, at), b))
            at = b + 1
    if at <= n_lines:
        out.append((at, n_lines))
    return out


def chunk_code(files: DataFrame, *, text: str = "text", lang: str = "language", size: int = CHUNK_LINES, overlap: float = OVERLAP) -> DataFrame:
    """Like ``chunk_lines``, but along definitions: each, and each gap between them, is a chunk of its own.

    What is longer than ``size`` lines is cut in windows.  Files whose definitions aren't
    found are cut in windows as a whole.
    """
    bounded_batches(files.sparkSession)

    @F.pandas_udf("array<struct<a:int,b:int>>")
    def cut(source: pd.Series, language: pd.Series) -> pd.Series:
        out = []
        for s, g in zip(source, language, strict=True):
            spans = top_level_spans(s or "", g or "")
            out.append([{"a": a, "b": b} for a, b in regions(len((s or "").splitlines()), spans)] if spans else None)
        return pd.Series(out)

    lines = X.split_lines(F.coalesce(F.col(text), F.lit("")))
    rows = files.withColumn("_r", cut(F.col(text), F.col(lang))).withColumn("_l", lines)
    one = lambda r: F.slice(F.col("_l"), r["a"], r["b"] - r["a"] + 1)
    by_region = F.flatten(F.transform("_r", lambda r: _windows(one(r), r["a"], size, int(size * overlap))))
    rows = rows.withColumn("_w", F.when(F.col("_r").isNull(), _windows(F.col("_l"), F.lit(1), size, int(size * overlap))).otherwise(by_region))
    out = rows.drop("_r", "_l", text).select("*", F.posexplode("_w").alias("chunk_idx", "_c")).drop("_w")
    return out.select(*[c for c in out.columns if c != "_c"], "_c.start_line", "_c.end_line", F.col("_c.text").alias(text))
