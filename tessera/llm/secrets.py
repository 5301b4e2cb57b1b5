"""Secret scans with a random forest that removes false positives.

Candidates are words of a text that look like keys.  For each, features describe its
length, its character transitions, how much of it dictionary words cover, the path it
was found at and the words beside it.  A random forest, grown on labelled findings on
the driver, becomes one SQL expression; texts are only read by SQL functions.
"""

from __future__ import annotations

import random
import string

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import GAP_RE, WS

#: Words that announce a secret, and words that announce something else.
ANNOUNCE_RE = r"(?i)(token|secret|passw|pwd|api[_.-]?key|access[_.-]?key|auth|credential|private[_.-]?key|client[_.-]?key|bearer)"
OTHER_RE = r"(?i)(?<![.@\w])(example|sample|dummy|placeholder|changeme|sha-?1|sha-?256|md5|checksum|digest|commit|revision|uuid|guid|version|build|test|fixture|hash)"
#: Formats that issuers document.
PREFIX_RE = r"^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{20,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}.*|AIza[0-9A-Za-z_-]{30,})"
#: A word, taken apart: what is before an assignment sign, and the value without quotes and trailing marks.
WORD_PARTS_RE = r"^(?:[\"'`(<\[{]*([A-Za-z0-9_.\-]*)[\"'`]?(?:=+>?|:=?)+)?[\"'`(<\[{]*([A-Za-z0-9+/_.\-]{8,}={0,2})[^A-Za-z0-9+/_=\-]*$"
#: Common words of identifiers and prose, for dictionary coverage.
DICTIONARY = (
    "the and that with this from have for not you are was but all one can will word value name user file path data list item "
    "table index key test main config service server client local host http https www com org net index html json java python "
    "class public static void return import package string number object function module version release build commit master "
    "branch change default example sample dummy placeholder password secret token your here insert replace xxxx todo none null "
    "true false type size time date year month page view read write open close start stop begin end first last next order line"
).split()
#: Issued formats anywhere in a word, and all values of a word that isn't one name and one value: those, and runs between signs.
ISSUED_RE = r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{20,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]+)?|AIza[0-9A-Za-z_-]{30,})"
VALUES_RE = ISSUED_RE + r"|(?:(?!" + ISSUED_RE + r")[A-Za-z0-9+/_.\-]){8,}(?:={0,2}(?![A-Za-z0-9+/_.\-]))?"
#: How issued formats begin.
BEGIN_RE = r"AKIA|gh[pousr]_|xox[abprs]-|sk-|eyJ|AIza"
#: The name that a value is assigned to, at the end of the text before it.
NAME_RE = r"([A-Za-z0-9_.\-]+)[\"'`]?(?:=+>?|:=?)+[\"'`(<\[{]*$"
FEATURES = ("n_chars", "digits", "uppers", "lowers", "others", "shifts", "mixed", "distinct", "dictionary", "hex", "slashes", "announced", "assigned", "other_words", "path_test", "issued")

#: Bound on the labelled findings that the forest is grown on.
MAX_FINDINGS = 6_000


def _share(col: Column, chars: str) -> Column:
    n = F.char_length(col)
    return (n - F.char_length(F.translate(col, chars, ""))) / F.greatest(n, F.lit(1))


def features(cand: Column, before: Column, after: Column, path: Column) -> dict[str, Column]:
    """Name and column of each feature of a finding; all are plain SQL functions."""
    n = F.greatest(F.char_length(cand), F.lit(1))
    v = "(?i)"
    shift = r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])"
    odd = v + r"(?=([bcdfghjklmnpqrstvwxz]{4}|[0-9][a-z][0-9]|[a-z][0-9][a-z]))"
    covered = F.regexp_replace(F.lower(cand), "|".join(sorted(set(DICTIONARY), key=lambda w: (-len(w), w))), "")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return {
        "n_chars": F.char_length(cand).cast("double"),
        "digits": _share(cand, string.digits),
        "uppers": _share(cand, string.ascii_uppercase),
        "lowers": _share(cand, string.ascii_lowercase),
        "others": _share(cand, "+/_=.-"),
        "shifts": F.regexp_count(cand, F.lit(shift)) / n,
        "mixed": F.regexp_count(cand, F.lit(odd)) / n,
        "distinct": F.size(F.array_distinct(F.split(cand, ""))) / n,
        "dictionary": 1.0 - F.char_length(covered) / n,
        "hex": flag(cand.rlike("^([0-9a-f]+|[0-9A-F]+)$")),
        "slashes": F.char_length(cand) - F.char_length(F.translate(cand, "/", "")).cast("double"),
        "announced": flag(before.rlike(ANNOUNCE_RE)),
        "assigned": flag(before.rlike(r"(=|:)[\"'`]?$")),
        "other_words": flag(F.concat_ws(" ", before, after).rlike(OTHER_RE)),
        "path_test": flag(path.rlike(r"(?i)(test|example|fixture|sample|mock|docs?/)")),
        "issued": flag(cand.rlike(PREFIX_RE)),
    }


def labelled_findings(n: int = 4_000, seed: int = 7) -> list[tuple[str, str, str, str, int]]:
    """Findings (candidate, words before, words after, path, label) to learn from.

    Half are keys in formats that issuers use, or random values and passwords that are
    assigned to a telling name; half are what scanners mistake for keys: hashes of commits and
    files, identifiers, paths, numbers, times, hosts, placeholders and long words, some of them
    right after an announcing word.
    """
    r = random.Random(seed)
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    alnum, hexa = string.ascii_letters + string.digits, "0123456789abcdef"
    syll = "the tion er on an re he in ed nd ha at en es of or nt ea ti to io le is ou ar as de rt ve".split()
    prose = lambda: "".join(r.choice(syll) for _ in range(r.randint(1, 4)))
    names = ["token", "api_key", "secret", "password", "AUTH_TOKEN", "client_secret", "access-key", "TOKEN", "Bearer", "passwd", "credential", "private_key"]
    host = lambda: ".".join([r.choice(["mail", "www", "auth", "cdn", "db"]) + str(r.randint(1, 99)), prose(), r.choice(["com", "net", "org", "io"])])
    moment = lambda: f"20{r.randint(10, 29)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}-{r.randint(10, 59)}Z"
    paths = ["src/app/main.py", "config/prod.yaml", "notes.txt", "src0", "web/page", "tests/fixtures/keys.json", "docs/example.md"]
    out = []
    while len(out) < n:
        label = len(out) % 2
        after = " ".join(prose() for _ in range(2))
        plain = " ".join(prose() for _ in range(3))
        path = r.choice(paths[:5])
        if label:
            before = f"{prose()} {r.choice(names)} {r.choice(['=', ':', '=', '=>', ''])}".strip()
            kind = r.randint(0, 6)
            if kind <= 1:
                cand = pick(hexa, r.choice((32, 40, 40, 64)))
                cand = cand.upper() if r.random() < 0.2 else cand
            elif kind == 2:
                cand = pick(alnum, r.randint(20, 48))
            elif kind == 3:
                cand = pick(alnum + "+/", r.randint(24, 64)) + "=" * r.randint(0, 2)
            elif kind == 4:
                cand = pick(alnum + "_-", r.randint(10, 20))
            elif kind == 6:  # what people choose
                word = lambda: (prose() + prose())[: r.randint(3, 8)]
                cand = r.choice([word() + pick(string.digits, 2) + word() + pick(string.digits, 1), word().title() + pick(string.digits, 4), word() + r.choice("-_.") + word() + pick(string.digits, 3)]).ljust(8, "7")
                before = f"{prose()} {r.choice(['password', 'passwd', 'pwd', 'PASSWORD', 'db_password'])} {r.choice(['=', ':'])}"
            else:
                cand = r.choice(["AKIA" + pick(string.ascii_uppercase + string.digits, 16), "ghp_" + pick(alnum, 36), "xoxb-" + pick(string.digits, 11) + "-" + pick(alnum, 24), "sk-" + pick(alnum, 40)])
                before = r.choice([before, plain])
        else:
            before, kind = plain, r.randint(0, 11)
            if kind == 0:
                cand, before = pick(hexa, r.choice((32, 40, 64))), f"{prose()} {r.choice(['commit', 'sha256', 'md5', 'revision', 'checksum'])} {r.choice(['', ':', '='])}".strip()
            elif kind == 1:
                cand, before = "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12)), f"{prose()} {r.choice(['uuid', 'id', 'request', 'guid'])} ="
            elif kind == 2:
                cand = "/".join(prose() for _ in range(r.randint(2, 5))) + r.choice(["", ".html", ".py", "/v2"])
            elif kind == 3:
                cand = pick(string.digits, r.choice((10, 13, 16, 19)))
            elif kind == 4:
                cand, before = r.choice(["your_api_key_here", "xxxxxxxxxxxxxxxx", "changeme123", "REPLACE_ME_WITH_KEY", "example-token-value", "insert-password-here"]), f"{prose()} {r.choice(names)} ="
            elif kind == 5:
                cand, before = "".join(r.choice(DICTIONARY) + r.choice(["_", "-", ""]) for _ in range(r.randint(3, 5))) + str(r.randint(0, 99)), r.choice([plain, f"{prose()} {r.choice(names)} ="])
            elif kind == 6:
                cand = "".join(prose() for _ in range(4)) + str(r.randint(0, 9))
            elif kind == 7:
                cand, before, path = pick(hexa, 40), f"{prose()} token =", r.choice(paths[5:])
                before = r.choice([before, f"example {before}"])
            elif kind == 8:  # hosts and addresses, as in running text
                cand, before = r.choice([host(), host() + "/" + prose() + str(r.randint(1, 9))]), r.choice([plain, f"{prose()} {r.choice(['mail', 'auth', 'host'])}"])
            elif kind == 9:  # an announcing word before what is none
                cand, before = r.choice([moment(), pick(string.digits, r.choice((10, 16))), host(), f"{prose()}/{prose()}{r.randint(1, 9)}/{prose()}"]), f"{prose()} {r.choice(names)} {r.choice(['', '=', ':'])}".strip()
            elif kind == 10:  # identifiers that name a secret but hold none
                cand, before = r.choice([f"get_{r.choice(names)}_v{r.randint(1, 9)}", f"{prose()}.{r.choice(names)}.{prose()}{r.randint(1, 9)}", f"{r.choice(names).upper()}_LENGTH_{r.randint(8, 64)}"]), plain
            else:
                cand = f"{r.randint(0, 30)}.{r.randint(0, 30)}.{r.randint(0, 300)}-{prose()}.{r.randint(0, 9)}"
        out.append((cand, before, after, path, label))
    return out


def _grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, least: int = 8):
    """A tree as nested tuples (feature, bound, left, right), or the share of label 1 at a leaf."""
    p = float((y.sum() + 0.5) / (len(y) + 1.0))
    if depth == 0 or len(y) < 2 * least or y.min() == y.max():
        return round(p, 4)
    best = None
    for f in rng.choice(x.shape[1], size=max(2, int(x.shape[1] ** 0.5)), replace=False):
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        k = np.arange(1, len(y))
        a, b = ones[:-1] / k, (ones[-1] - ones[:-1]) / (len(y) - k)
        gini = k * a * (1 - a) + (len(y) - k) * b * (1 - b)
        gini[(v[1:] == v[:-1]) | (k < least) | (len(y) - k < least)] = np.inf
        i = int(gini.argmin())
        if np.isfinite(gini[i]) and (best is None or gini[i] < best[0]):
            best = (gini[i], int(f), float((v[i] + v[i + 1]) / 2))
    if best is None:
        return round(p, 4)
    left = x[:, best[1]] <= best[2]
    return best[1], best[2], _grow(x[left], y[left], rng, depth - 1, least), _grow(x[~left], y[~left], rng, depth - 1, least)


def grow_forest(x: np.ndarray, y: np.ndarray, *, trees: int = 24, depth: int = 7, seed: int = 7) -> list:
    """Trees grown on bootstrap samples, each split on the best of a few random features."""
    rng = np.random.default_rng(seed)
    rows = [rng.integers(0, len(y), len(y)) for _ in range(trees)]
    return [_grow(x[i], y[i], rng, depth) for i in rows]


def forest_sql(forest: list, names: tuple[str, ...] = FEATURES) -> str:
    """The mean of the trees' leaves as SQL over columns called ``names``."""

    def sql(t) -> str:
        return f"{t}D" if not isinstance(t, tuple) else f"CASE WHEN {names[t[0]]} <= {t[1]!r}D THEN {sql(t[2])} ELSE {sql(t[3])} END"

    return f"({' + '.join(f'({sql(t)})' for t in forest)}) / {len(forest)}D"


def train_forest(spark: SparkSession, findings: list | None = None) -> list:
    """A forest from labelled findings (at most MAX_FINDINGS); features come from the same SQL as in scans."""
    rows = (findings or labelled_findings())[:MAX_FINDINGS]
    df = spark.createDataFrame(rows, "cand string, before string, after string, path string, label int")
    made = features(F.col("cand"), F.col("before"), F.col("after"), F.col("path"))
    got = df.select("label", *[c.cast("double").alias(k) for k, c in made.items()]).collect()
    x = np.array([[r[k] for k in FEATURES] for r in got])
    return grow_forest(x, np.array([r.label for r in got], dtype=float))


def candidates(docs: DataFrame, *, path_col: str | None = "source") -> DataFrame:
    """doc_id, word_no, candidate, before, after, path for each value in a word that looks like a key.

    A word of one name and one value gives that value; any other word gives all its issued
    formats and runs between signs, each with the name before it.
    A candidate has 16 characters or more with a digit and a letter among them, or 8 or
    more after an announcing word and an assignment sign, or a documented format.
    """
    # Texts without a digit, an announcing word or the beginning of an issued format have no candidate.
    some = docs.filter(F.col("text").rlike(f"[0-9]|{BEGIN_RE}|{ANNOUNCE_RE}"))
    path = F.col(path_col).cast("string") if path_col and path_col in docs.columns else F.lit(None).cast("string")
    ws = some.select("doc_id", path.alias("path"), F.split(F.trim("text", F.lit(WS)), GAP_RE).alias("_w"))
    likely = F.filter(F.sequence(F.lit(0), F.size("_w") - 1), lambda i: F.get("_w", i).rlike(r"^.*[A-Za-z0-9+/_.=\-]{8}"))
    one = ws.withColumn("word_no", F.explode(F.filter(likely, lambda i: F.get("_w", i).rlike(f"[0-9]|{BEGIN_RE}") | F.array_join(F.slice("_w", F.greatest(i - 1, F.lit(1)), F.least(i + 1, F.lit(3))), " ").rlike(ANNOUNCE_RE))))
    w = F.get("_w", F.col("word_no"))
    inner, value = F.regexp_extract(w, WORD_PARTS_RE, 1), F.regexp_extract(w, WORD_PARTS_RE, 2)
    named = lambda name: F.when(name != "", F.concat(name, F.lit("="))).otherwise("")
    found = lambda cand, name: F.struct(cand.alias("cand"), named(name).alias("own"))
    # Values are marked off: every second piece is one, and the pieces ahead of it are the text before it.
    one = one.withColumn("_p", F.split(F.regexp_replace(F.translate(w, "\x01", ""), VALUES_RE, "\x01$0\x01"), "\x01"))
    places = F.when(F.size("_p") > 2, F.sequence(F.lit(1), F.size("_p") - 2, F.lit(2))).otherwise(F.array().cast("array<int>"))
    each = F.transform(places, lambda i: found(F.get("_p", i), F.regexp_extract(F.array_join(F.slice("_p", F.lit(1), i), ""), NAME_RE, 1)))
    simple = (value != "") & (value.rlike(PREFIX_RE) | ~value.rlike(ISSUED_RE))
    one = one.withColumn("_v", F.explode(F.when(simple, F.array(found(value, inner))).otherwise(each)))
    pre = F.array_join(F.slice("_w", F.greatest(F.col("word_no") - 2, F.lit(1)), F.least("word_no", F.lit(3))), " ")
    out = one.select(
        "doc_id",
        F.col("word_no").cast("long").alias("word_no"),
        F.col("_v.cand").alias("candidate"),
        F.when(F.col("word_no") > 0, pre).otherwise("").alias("_pre"),
        F.col("_v.own").alias("_own"),
        F.array_join(F.slice("_w", F.col("word_no") + 2, F.lit(2)), " ").alias("after"),
        "path",
    ).withColumn("before", F.trim(F.concat_ws(" ", "_pre", "_own")))
    c = F.col("candidate")
    near = F.regexp_extract(F.col("before"), r"(\S+\s*\S*)$", 1).rlike(ANNOUNCE_RE) & F.col("before").rlike(r"[=:][\"'`]?$|=>$")
    ok = ((F.char_length(c) >= 16) & c.rlike("[0-9]") & c.rlike("[A-Za-z]")) | ((F.char_length(c) >= 8) & near) | c.rlike(PREFIX_RE)
    return out.filter(ok).select("doc_id", "word_no", "candidate", "before", "after", "path")


def scan(docs: DataFrame, *, forest: list | None = None, path_col: str | None = "source", threshold: float = 0.5) -> DataFrame:
    """Every candidate with score (0 to 1) and is_secret (score >= threshold).

    Null, empty and blank texts have no findings, and an empty table has none; very long texts
    are read whole; repeated rows repeat theirs; equal findings get equal scores; further columns
    are ignored, whatever their names.  The path is the column ``path_col`` if the table has it.
    """
    forest = forest or train_forest(docs.sparkSession)
    found = candidates(docs, path_col=path_col)
    made = features(F.col("candidate"), F.col("before"), F.col("after"), F.col("path"))
    rows = found.select("*", F.struct(*[c.cast("double").alias(k) for k, c in made.items()]).alias("_f"))
    score = F.expr(forest_sql(forest, tuple(f"_f.{k}" for k in FEATURES)))
    return rows.select(*found.columns, score.alias("score")).withColumn("is_secret", F.col("score") >= threshold)
