"""Where definitions stand at the top level of source code: a lexer by language, without a parser.

The lexer knows comments, strings and brackets.  What stands outside all brackets is cut in
statements, and a statement is a definition if the words before its block say so.
"""

from __future__ import annotations

import ast
import bisect
import re
from itertools import accumulate

_BLOCK_COMMENT = r"/\*(?s:.*?)(?:\*/|\Z)"
_LINE_COMMENT = r"//[^\n]*"
_STRING = r'"(?:\\(?s:.)|[^"\\\n])*"?'
_QUOTED = r"'(?:\\(?s:.)|[^'\\\n])*'?"
_TRIPLE = r'"""(?s:.*?)(?:"""|\Z)'

#: By family: comments, texts.  A text that isn't closed ends with its line.
_FAMILIES = {
    "js": ([_BLOCK_COMMENT, _LINE_COMMENT, r"\A#![^\n]*"], [_STRING, _QUOTED]),
    "go": ([_BLOCK_COMMENT, _LINE_COMMENT], [r"`[^`]*`?", _STRING, _QUOTED]),
    "rs": ([_BLOCK_COMMENT, _LINE_COMMENT], [r'b?r(?P<hashes>#*)"(?s:.*?)(?:"(?P=hashes)|\Z)', r'"(?:\\(?s:.)|[^"\\])*"?', r"b?'(?:\\(?:u\{[^}\n]*\}|x..|.)|[^'\\\n])'", r"'\w+"]),
    "java": ([_BLOCK_COMMENT, _LINE_COMMENT], [_TRIPLE, _STRING, _QUOTED]),
    "cs": ([_BLOCK_COMMENT, _LINE_COMMENT, r"^[ \t]*#[^\n]*"], [_TRIPLE, r'(?:\$@|@\$|@)"(?:""|[^"])*"?', _STRING, _QUOTED]),
    "c": ([_BLOCK_COMMENT, _LINE_COMMENT, r"^[ \t]*#(?:\\\r?\n|[^\n])*"], [r'\b(?:u8|[uUL])?R"(?P<mark>[^()\s\\]*)\((?s:.*?)(?:\)(?P=mark)"|\Z)', _STRING, r"\b\d[\w.']*", _QUOTED]),
    "php": ([_BLOCK_COMMENT, _LINE_COMMENT, r"#(?!\[)[^\n]*", r"<\?(?:php\b|=)?|\?>(?s:.*?)(?:<\?(?:php\b|=)?|\Z)"], [r'"(?:\\(?s:.)|[^"\\])*"?', r"'(?:\\(?s:.)|[^'\\])*'?"]),
}

_MODIFIERS = r"^(?:[a-z_]+ (?:\( \) |\[ \] )?)*?"
#: By language: family, whether statements end with lines, and what a definition begins with (its words outside brackets).
_LANGUAGES = {
    "js": ("js", True, r"^(?:export|(?:async )?function|class|const|let)\b"),
    "ts": ("js", True, r"^(?:export|(?:async )?function|class|const|let|interface \w|type \w)"),
    "go": ("go", True, r"^(?:func|type)\b"),
    "rs": ("rs", False, r"^(?:pub (?:\( \) )?)?(?:(?:async|const|unsafe|extern|default|\") )*(?:fn|impl|struct|enum|trait|mod)\b"),
    "java": ("java", False, _MODIFIERS + r"(?:class|interface|enum)\b"),
    "kt": ("java", True, _MODIFIERS + r"(?:fun|class|object)\b"),
    "scala": ("java", True, _MODIFIERS + r"(?:def|class|object|trait)\b"),
    "swift": ("java", True, _MODIFIERS + r"(?:func|class|struct|enum)\b"),
    "cs": ("cs", False, _MODIFIERS + r"(?:class|interface|struct)\b"),
    "c": ("c", False, r"^(?:struct|enum)\b(?!.* (?:\(|=)).*\{$|^(?!typedef\b)(?!.*(?<!operator )(?<!operator . )=).*[\w=<>+*/-] \( \).*\{$"),
    "cpp": ("c", False, r"^(?:template .*> )?(?:class|struct)\b(?!.* (?:\(|=)).*\{$|^(?:inline )?namespace\b.*\{$|^(?!typedef\b)(?!.*(?<!operator )(?<!operator . )=).*[\w=<>+*/-] \( \).*\{$"),
    "php": ("php", False, r"^(?:(?:abstract|final|readonly) )*(?:function|class)\b"),
}
_SAME = {
    "jsx": "js", "mjs": "js", "cjs": "js", "tsx": "ts", "kts": "kt", "h": "c", "cc": "cpp", "hh": "cpp", "hpp": "cpp", "bash": "sh", "zsh": "sh",
}
#: Languages whose blocks end with a word, or whose texts are too free for a lexer: definitions start and end in the first column.
_BY_COLUMN = {"rb": r"(?:def|class|module)\b", "lua": r"(?:local\s+)?function\b", "sh": r"(?:function\s+\w+|\w+\s*\(\)\s*\{)"}

#: A line doesn't end a statement that stops with one of these, nor one that goes on with one of those.
_OPEN_ENDS = frozenset("= + - * / % & | ^ ~ < : , . =>".split()) | {"extends", "implements", "where", "throws"}
_GO_ON = frozenset(". ? : + - * / % & | ^ = , { < >".split()) | {"extends", "implements", "where", "throws", "else", "catch", "finally", "instanceof"}
_DECORATOR = re.compile(r"^(?:@ \w+(?: [.:] \w+)*(?: \( \))? ?|\[ \] ?|# \[ \] ?)+")
_CLOSERS = {"(": ")", "[": "]", "{": "}", "${": "}"}
_TEMPLATE = re.compile(r"\\(?s:.)|`|\$\{|[^\\`$]+|[$\\]")
_BEFORE_PATTERN = frozenset("( , = : [ ! & | ? { } ; + - * % < > ~ ^ return typeof case in of => ".split()) | {""}
_PATTERN = re.compile(r"/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/\w*")


def _compile(family: str) -> re.Pattern[str]:
    comments, texts = _FAMILIES[family]
    return re.compile(f"(?P<skip>{'|'.join(comments)}|[^\\S\\n]+)|(?P<line>\\n)|(?P<text>{'|'.join(texts)})|(?P<word>[\\w$]+)|(?P<open>[(\\[{{])|(?P<close>[)\\]}}])|(?P<other>=>|.)", re.MULTILINE)


_TOKENS = {family: _compile(family) for family in _FAMILIES}


def _kind(m: re.Match[str]) -> str:
    return next(k for k in ("skip", "line", "text", "word", "open", "close", "other") if m[k] is not None)


def statements(source: str, family: str, by_line: bool) -> list[tuple[int, int, str]]:
    """(first offset, last offset, words outside brackets up to the block) of each statement outside all brackets."""
    token, out, stack = _TOKENS[family], [], []
    waiting = dict.fromkeys(")]}", 0)  # how many open brackets wait for each closing one
    head: list[str] = []
    first, end, last = -1, -1, ""
    in_head, at_line, before = True, False, 0  # before: how many of the words are lines of decorators
    pos, size = 0, len(source)

    def close() -> None:
        nonlocal first, in_head, at_line, before
        if first >= 0:
            out.append((first, end, " ".join(head)))
        head.clear()
        first, in_head, at_line, before = -1, True, False, 0

    while pos < size:
        if stack and stack[-1] == "`":
            m = _TEMPLATE.match(source, pos)
            pos = m.end()
            end = pos - 1
            if m[0] == "`":
                stack.pop()
                last = '"'
            elif m[0] == "${":
                stack.append("${")
                waiting["}"] += 1
                last = "{"
            continue
        if family == "js" and source[pos] == "/" and last in _BEFORE_PATTERN and (m := _PATTERN.match(source, pos)):
            kind = "text"
        else:
            m = token.match(source, pos)
            kind = _kind(m)
        at, pos = pos, m.end()
        if kind == "skip":
            continue
        if kind == "line":
            if by_line and not stack and first >= 0 and _only_decorators(head[before:]):
                before = len(head)
            elif by_line and not stack and len(head) > before and last not in _OPEN_ENDS:
                at_line = True
            continue
        t = '"' if kind == "text" else m[0]
        if at_line:
            if t in _GO_ON and not (t == "{" and last == "}"):
                at_line = False
            else:
                close()
        if kind == "other" and t == ";" and not stack:
            end = at if first >= 0 else end
            close()
            last = t
            continue
        if first < 0:
            first = at
        end, last = pos - 1, t
        if not stack and in_head:
            if t == "{":
                in_head = False
            head.append(t)
        if kind == "open":
            stack.append(t)
            waiting[_CLOSERS[t]] += 1
        elif kind == "other" and t == "`" and family == "js":
            stack.append("`")
        elif kind == "close":
            while waiting[t]:  # up to the partner, all that was left open is closed
                c = _CLOSERS.get(stack.pop())
                if c:
                    waiting[c] -= 1
                if c == t:
                    break
            if not stack:
                if in_head:
                    head.append(t)
                if t == "}" and not by_line:
                    close()
                elif t == "]" and family in ("rs", "php", "cs") and _only_decorators(head):
                    head.clear()
                    if family == "rs":
                        first = -1
    close()
    return out


def _only_decorators(head: list[str]) -> bool:
    text = " ".join(head)
    return bool(text) and (text in ("# ! [ ]", "# [ ]", "[ ]") or _DECORATOR.sub("", text, count=1) == "")


def _by_column(source: str, pattern: str) -> list[tuple[int, int]]:
    lines = source.splitlines()
    starts = [i for i, x in enumerate(lines) if re.match(pattern, x)]
    out = []
    for i, nxt in zip(starts, [*starts, len(lines)][1:] if starts else [], strict=True):
        one_line = re.search(r"(?:\}|;\s*end|\bend)\s*$", lines[i])
        end = i if one_line else next((j for j in range(i, nxt) if re.match(r"\}|end\b", lines[j])), nxt - 1)
        while end > i and not lines[end].strip():
            end -= 1
        out.append((i + 1, end + 1))
    return out


def _python(source: str) -> list[tuple[int, int]]:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    found = [n for n in tree.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))]
    return [(min([n.lineno, *(d.lineno for d in n.decorator_list)]), n.end_lineno or n.lineno) for n in found]


def top_level_spans(source: str, lang: str) -> list[tuple[int, int]] | None:
    """First and last line (from 1) of each definition at the top level; None if there is none or the language isn't known."""
    lang = _SAME.get(lang, lang)
    if lang == "py":
        return _python(source) or None
    if lang in _BY_COLUMN:
        return _by_column(source, _BY_COLUMN[lang]) or None
    if lang not in _LANGUAGES:
        return None
    family, by_line, pattern = _LANGUAGES[lang]
    starts = list(accumulate(map(len, source.splitlines(keepends=True)), initial=0))  # of lines, as they are counted elsewhere
    line = lambda at: bisect.bisect_right(starts, at)
    found = [(line(a), line(b)) for a, b, head in statements(source, family, by_line) if re.search(pattern, _DECORATOR.sub("", head, count=1))]
    return found or None
