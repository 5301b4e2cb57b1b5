"""Front matter with nested values: indented maps and lists, flow forms, quoted and block texts, as JSON or a variant."""

from __future__ import annotations

import json
import math
import re
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import bounded_batches

MAX_DEPTH = 100
_KEY = re.compile(r"""("(?:\\.|[^"\\])*"|'(?:''|[^'])*'|[^\s"'\[\]{}#&*!|>%@`,][^\n]*?)\s*:(?:[ \t]+|$)""")
# Which plain words are no text, as YAML 1.1 has them.
_NULL = {"", "~", "null", "Null", "NULL"}
_TRUE = {"yes", "Yes", "YES", "true", "True", "TRUE", "on", "On", "ON"}
_FALSE = {"no", "No", "NO", "false", "False", "FALSE", "off", "Off", "OFF"}
_INT = re.compile(r"[-+]?(?:0|[1-9][0-9_]*)$")
_RADIX = re.compile(r"([-+]?)(?:0b([01_]+)|0x([0-9a-fA-F_]+)|0([0-7_]+))$")
_FLOAT = re.compile(r"[-+]?(?:[0-9][0-9_]*\.[0-9_]*(?:[eE][-+][0-9]+)?|\.[0-9][0-9_]*(?:[eE][-+][0-9]+)?)$")
_ESCAPES = {"0": "\0", "a": "\a", "b": "\b", "t": "\t", "\t": "\t", "n": "\n", "v": "\v", "f": "\f", "r": "\r", "e": "\x1b", " ": " ", '"': '"', "/": "/", "\\": "\\", "N": "\x85", "_": "\xa0", "L": "\u2028", "P": "\u2029"}
_QUOTED = {'"': re.compile(r'"((?:\\(?s:.)|[^"\\])*)"'), "'": re.compile(r"'((?:''|[^'])*)'")}


def _plain(word: str) -> Any:
    if word in _NULL:
        return None
    if word in _TRUE or word in _FALSE:
        return word in _TRUE
    if _INT.match(word):
        return int(word.replace("_", ""))
    if m := _RADIX.match(word):
        base = 2 if m[2] else 16 if m[3] else 8
        digits = (m[2] or m[3] or m[4]).replace("_", "")
        return int(m[1] + digits, base) if digits else word
    return float(word.replace("_", "")) if _FLOAT.match(word) else word


def _fold(text: str) -> str:
    """Line breaks inside a text become a blank; n of them in a row become n - 1 breaks."""
    return re.sub(r"[ \t]*\n[ \t\n]*", lambda m: " " if m[0].count("\n") == 1 else "\n" * (m[0].count("\n") - 1), text)


def _unquote(quote: str, inner: str) -> str:
    if quote == "'":
        return _fold(inner).replace("''", "'")
    inner = re.sub(r"\\[ \t]*\n[ \t]*", "", inner) if "\\\n" in inner else inner

    def one(m: re.Match[str]) -> str:
        if m[1]:
            return chr(int(m[1][1:], 16))
        if m[2] not in _ESCAPES:
            raise ValueError("unknown escape")
        return _ESCAPES[m[2]]

    text = re.sub(r"\\(?:(x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8})|(.))", one, _fold(inner))
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")  # two escaped halves are one character


class _Flow:
    """``[a, {b: c}]`` and quoted or plain texts, from a position of a text on."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def blank(self) -> str:
        self.at = re.compile(r"(?:\s|(?:(?<=\s)|^)#[^\n]*)*").match(self.text, self.at).end()
        return self.text[self.at : self.at + 1]

    def quoted(self) -> str:
        quote = self.text[self.at]
        m = _QUOTED[quote].match(self.text, self.at)
        if not m:
            raise EOFError
        self.at = m.end()
        return _unquote(quote, m[1])

    def value(self, depth: int = 0) -> Any:
        if depth > MAX_DEPTH:
            raise ValueError("too deep")
        c = self.blank()
        if not c:
            raise EOFError
        if c in "\"'":
            return self.quoted()
        if c in "[{":
            return self.group("]" if c == "[" else "}", depth)
        m = re.compile(r"(?:[^,\[\]{}:#\n]|:(?![\s,\[\]{}]|$)|(?<!\s)#|\n)*").match(self.text, self.at)
        if m.end() == self.at and c not in ",]}:":
            raise ValueError("unexpected character")
        if c in "&*!|>%@`":
            raise ValueError("not supported")
        self.at = m.end()
        return _plain(_fold(m[0].strip()))

    def group(self, end: str, depth: int) -> Any:
        self.at += 1
        items: list[Any] = []
        pairs: dict[str, Any] = {}
        while (c := self.blank()) != end:
            if not c:
                raise EOFError
            if c in ",]}":
                raise ValueError("value expected")
            quoted = c in "\"'"
            item, given = self.value(depth + 1), None
            c = self.blank()
            if c == ":" and (quoted or self.text[self.at + 1 : self.at + 2] in ("", " ", "\n", "\t", ",", "]", "}", "[", "{")):
                self.at += 1
                given = None if self.blank() in (",", end) else self.value(depth + 1)
                c = self.blank()
                if end == "]":
                    item = {_name(item): given}
            if end == "}":
                pairs[_name(item)] = given
            else:
                items.append(item)
            if c == ",":
                self.at += 1
            elif c and c != end:
                raise ValueError("comma expected")
        self.at += 1
        return pairs if end == "}" else items


def _name(key: Any) -> str:
    if isinstance(key, (dict, list)):
        raise ValueError("a key must be plain")
    return key if isinstance(key, str) else json.dumps(key)


class _Block:
    def __init__(self, text: str):
        self.lines, self.at = text.split("\n"), 0

    def indent(self) -> int:
        """The indent of the next line that isn't blank or a comment; -1 at the end."""
        while self.at < len(self.lines):
            line = self.lines[self.at]
            bare = line.lstrip(" ")
            if bare.strip() and not bare.startswith("#"):
                if bare.startswith("\t"):
                    raise ValueError("tab as indent")
                return len(line) - len(bare)
            self.at += 1
        return -1

    def value(self, above: int, depth: int = 0) -> Any:
        """What stands indented by more than ``above``."""
        if depth > MAX_DEPTH:
            raise ValueError("too deep")
        n = self.indent()
        if n <= above:
            return None
        bare = self.lines[self.at][n:]
        if bare == "-" or bare.startswith("- "):
            return self.items(n, depth)
        return self.pairs(n, depth) if _KEY.match(bare) else self.scalar(bare, above)

    def items(self, n: int, depth: int) -> list[Any]:
        out = []
        while self.indent() == n and (self.lines[self.at][n:] == "-" or self.lines[self.at].startswith("- ", n)):
            self.lines[self.at] = self.lines[self.at][:n] + " " + self.lines[self.at][n + 1 :]
            out.append(self.value(n, depth + 1))
        if self.indent() > n:
            raise ValueError("indent")
        return out

    def pairs(self, n: int, depth: int) -> dict[str, Any]:
        out: dict[str, Any] = {}
        while self.indent() == n:
            bare = self.lines[self.at][n:]
            m = _KEY.match(bare)
            if not m:
                raise ValueError("key expected")
            key = _unquote(m[1][0], m[1][1:-1]) if m[1][0] in "\"'" else _name(_plain(m[1]))
            rest = bare[m.end() :].strip()
            if rest and not rest.startswith("#"):
                out[key] = self.scalar(rest, n)
            else:
                self.at += 1
                inner = self.indent()
                same = inner == n and (self.lines[self.at][n:] == "-" or self.lines[self.at].startswith("- ", n))
                out[key] = self.items(n, depth + 1) if same else self.value(n, depth + 1)
        if self.indent() > n:
            raise ValueError("indent")
        return out

    def scalar(self, first: str, above: int) -> Any:
        """A value that begins with ``first`` on this line; it goes on in lines indented by more than ``above``."""
        self.at += 1
        if m := re.match(r"([|>])([-+]?)([1-9]?)([-+]?)(?:\s+#.*)?$", first):
            return self.long_text(m[1], m[2] or m[4], int(m[3]) if m[3] else 0, above)
        if first[0] in "\"'[{":
            begin, end = self.at, self.at
            while end < len(self.lines) and (not self.lines[end].strip() or len(self.lines[end]) - len(self.lines[end].lstrip(" ")) > above):
                end += 1
            # One line, then twice as many: long values are not read anew for every line.
            n = 0
            while True:
                flow = _Flow("\n".join([first, *self.lines[begin : begin + n]]))
                try:
                    got = flow.value()
                    break
                except EOFError:
                    if begin + n >= end:
                        raise ValueError("not closed") from None
                    n = min(max(1, 2 * n), end - begin)
            used, rest = flow.text[: flow.at].count("\n"), flow.text[flow.at :].split("\n", 1)[0].strip()
            if rest and not rest.startswith("#"):
                raise ValueError("more after the value")
            self.at = begin + used
            return got
        if first[0] in "&*!%@`|>":
            raise ValueError("not supported")
        parts = [re.split(r"(?:^|\s)#", first, maxsplit=1)[0].strip()]
        ended = "#" in first and parts[0] != first.strip()
        while self.at < len(self.lines) and not ended:
            line = self.lines[self.at]
            if line.strip() and (len(line) - len(line.lstrip(" ")) <= above or line.lstrip().startswith("#")):
                break
            parts.append(re.split(r"\s#", line, maxsplit=1)[0].strip())
            ended = " #" in line
            self.at += 1
        text = _fold("\n".join(parts).strip())
        if re.search(r":(?:\s|$)", text):
            raise ValueError("a key inside a plain value")
        return _plain(text)

    def long_text(self, kind: str, chomp: str, width: int, above: int) -> str:
        lines, n = [], above + width if width and above >= 0 else width
        while self.at < len(self.lines):
            line = self.lines[self.at]
            here = len(line) - len(line.lstrip(" "))
            if line.strip(" "):
                n = n or here
                if here < n or here <= above:
                    break
            lines.append(line[n:] if line.strip(" ") or len(line) > n else "")
            self.at += 1
        text = "\n".join(lines)
        body = text.rstrip("\n")
        if kind == ">":
            out: list[str] = []
            gap, loose = 0, True
            for x in body.split("\n"):
                if not x:
                    gap += 1
                    continue
                wide = x[0] in " \t"
                out.append("\n" * gap if gap and not (loose or wide) else "\n" * (gap + 1) if out and (loose or wide) else "\n" * gap if gap else " " if out else "")
                out.append(x)
                gap, loose = 0, wide
            body = "".join(out)
        if not body:
            return "\n" * len(lines) if chomp == "+" else ""
        return body if chomp == "-" else body + "\n" + ("\n" * (len(lines) - 1 - len(text.rstrip("\n").split("\n")) + 1) if chomp == "+" else "")


def read_values(text: str) -> dict[str, Any] | None:
    """The map that a front matter writes; {} for an empty one; None if it isn't a map or isn't understood.

    Anchors, tags and several documents are not understood; dates stay text.
    """
    try:
        block = _Block(re.sub(r"\r\n?", "\n", text))
        got = block.value(-1)
        if block.indent() >= 0:
            return None
    except (ValueError, EOFError, OverflowError, RecursionError):
        return None
    return {} if got is None else got if isinstance(got, dict) else None


def _json(value: Any) -> str:
    def finite(v: Any) -> Any:
        if isinstance(v, dict):
            return {k: finite(x) for k, x in v.items()}
        if isinstance(v, list):
            return [finite(x) for x in v]
        return str(v) if isinstance(v, float) and not math.isfinite(v) else v

    return json.dumps(finite(value), ensure_ascii=False)


def values(raw: Column) -> Column:
    """The front matter's text as a variant; null where it is null, no map, or not understood."""

    @F.pandas_udf("string")
    def as_json(part: pd.Series) -> pd.Series:
        made = (None if r is None else read_values(r) for r in part)
        return pd.Series([None if v is None else _json(v) for v in made], dtype=object)

    return F.try_parse_json(as_json(raw))


def nested_front_matter(files: DataFrame, *, text: str = "text", front: str = "front", body: str = "body") -> DataFrame:
    """``files`` with ``front`` (a variant) and ``body``, in place of columns of these names.

    A text without front matter (null and empty ones too) has a null ``front`` and is all body;
    so has one whose front matter isn't understood.  Of a key that comes twice the last counts.
    """
    bounded_batches(files.sparkSession)
    t = F.col(text)
    fence = r"(?s)\A---[ \t]*\r?\n(?:(.*?)\r?\n)?---[ \t]*(?:\r?\n|\z)"
    read = values(F.when(t.rlike(fence), F.regexp_extract(t, fence, 1)))
    return files.withColumn(front, read).withColumn(body, F.when(F.col(front).isNull(), t).otherwise(F.regexp_replace(t, fence + r"\n*", "")))
