"""Text functions on columns, with the meaning that Python gives to strip and splitlines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: The same characters one by one.
_SPACES = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_ODD_LINE = r"[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
_LINE = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(c, F.lit(_SPACES))


def not_blank(c: Column) -> Column:
    """Whether there is more than white space; stops at the first other character."""
    return c.rlike(_SPACE.replace("[", "[^", 1))


def split_lines(c: Column) -> Column:
    """Lines without their ends; a line end at the end of the text starts no further line."""
    cut = lambda x: F.when(F.element_at(x, -1) == "", F.slice(x, F.lit(1), F.size(x) - 1)).otherwise(x)
    # Plain line feeds, the common case, need no regular expression.
    parts = F.when(c.rlike(_ODD_LINE), F.split(c, _LINE, -1)).otherwise(F.split(c, "\n", -1))
    return F.when(c == "", F.array().cast("array<string>")).otherwise(let(parts, cut))


def slugify(c: Column, default: str = "item", length: int = 60) -> Column:
    """Lower-case ASCII words joined by single hyphens, cut at ``length``; ``default`` if nothing is left."""
    kept = F.lower(strip(F.regexp_replace(c, r"[^a-zA-Z0-9\s\-]", "")))
    slug = F.substring(F.regexp_replace(kept, r"[\s\-]+", "-"), 1, length)
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit(default))


def file_name(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def file_stem(c: Column) -> Column:
    return F.regexp_replace(file_name(c), r"(?<=.)\.[^.]*$", "")


def suffix(c: Column) -> Column:
    """The last suffix of a file name, lower-cased, with its dot; empty if it has none."""
    return F.lower(F.regexp_extract(file_name(c), r".(\.[^.]+)$", 1))


def language(path: Column) -> Column:
    """Suffix without the dot, or ``text``."""
    return F.coalesce(F.nullif(F.regexp_replace(suffix(path), r"^\.", ""), F.lit("")), F.lit("text"))


def breadcrumb(headings: Column, body: Column) -> Column:
    """``a > b`` above the body, or the body alone."""
    return F.when(F.size(headings) > 0, F.concat(F.array_join(headings, " > "), F.lit("\n\n"), body)).otherwise(body)


def code_header(lang: Column, path: Column, start: Column, end: Column) -> Column:
    mark = F.when(lang != "", F.concat(F.lit("["), lang, F.lit("] "))).otherwise("")
    return F.concat(mark, file_name(path), F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def code_embed_text(lang: Column, path: Column, start: Column, end: Column, body: Column) -> Column:
    """What is embedded for a chunk of code."""
    return F.concat(code_header(lang, path, start, end), F.lit("\n"), body)


def code_stored_text(lang: Column, path: Column, start: Column, end: Column, body: Column) -> Column:
    """What is stored for a chunk of code: an empty line stands after the header."""
    return F.concat(code_header(lang, path, start, end), F.lit("\n\n"), body)


def parse_code_hit(text: Column) -> dict[str, Column]:
    """language, start_line, end_line and body out of a stored chunk; what doesn't parse is empty or null."""
    at = F.instr(text, "\n\n")
    head = F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise("")
    body = F.when(at > 0, F.substring(text, at + 2, F.length(text))).otherwise(text)
    last = F.element_at(F.split(head, ":"), -1)
    numbers = F.when(head.contains(":"), last)
    ok = numbers.rlike(r"^\s*\d+\s*-\s*\d+\s*$")
    number = lambda i: F.when(ok, F.trim(F.split_part(numbers, F.lit("-"), F.lit(i))).try_cast("int"))
    return {"language": F.regexp_extract(head, r"^\[([^\]]*)\]", 1), "start_line": number(1), "end_line": number(2), "body": body}


def short_path(path: Column, home: str) -> Column:
    """``~/`` for the home directory."""
    h = home.rstrip("/") + "/"
    return F.when(path.startswith(h), F.concat(F.lit("~/"), F.substring(path, len(h) + 1, 1 << 20))).otherwise(path)


def short_directory(c: Column, length: int = 30) -> Column:
    """At most ``length`` characters: ``...`` and the end of a longer one."""
    return F.when(F.length(c) > length, F.concat(F.lit("..."), F.right(c, F.lit(length - 3)))).otherwise(c)


def hit_title(headings: Column, path: Column) -> Column:
    """The last heading, or the file's stem."""
    return F.coalesce(F.try_element_at(headings, F.lit(-1)), file_stem(path))


def hit_header(rank: Column, path: Column, score: Column, scope: Column) -> Column:
    return F.format_string("\n### %d. %s  \n_score=%.3f scope=%s_\n\n", rank, path, score, scope)


def first_line(c: Column, length: int = 120) -> Column:
    return F.substring(F.split_part(strip(c), F.lit("\n"), F.lit(1)), 1, length)


def preview(c: Column, length: int = 400) -> Column:
    return F.substring(c, 1, length)


def token_label(n: Column) -> Column:
    """1.0M, 1.0k or the number itself."""
    return (
        F.when(n >= 1_000_000, F.format_string("%.1fM", n / F.lit(1e6))).when(n >= 1_000, F.format_string("%.1fk", n / F.lit(1e3))).otherwise(n.cast("string"))
    )


def time_label(ts: Column, today: str) -> Column:
    """The time of day for a time stamp (text) of today, else its date."""
    t = F.replace(F.substring(ts, 1, 16), F.lit("T"), F.lit(" "))
    return F.when(F.substring(t, 1, 10) == today, F.substring(t, 12, 5)).otherwise(F.substring(t, 1, 10))


def cache_key(path: Column) -> Column:
    return F.substring(F.sha2(F.encode(path, "UTF-8"), 256), 1, 16)


def yaml_front(fields: list[tuple[str, Column | None]]) -> Column:
    """Front matter lines between marks; fields whose value is null are left out."""
    made = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v)) for k, v in fields if v is not None]
    return F.concat_ws("\n", F.lit("---"), *made, F.lit("---"))


def table_row(*cells: Column) -> Column:
    """A row of a Markdown table."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(c, F.lit("")) for c in cells]), F.lit(" |"))
