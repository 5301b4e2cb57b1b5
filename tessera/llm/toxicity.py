"""Toxicity by weak supervision.

Words and beginnings of words that labelled rows tie to toxicity are gathered into lexicons
of terms that occur together; each lexicon is a voter.  Patterns of use (how many terms, how
many different ones, how dense, how close together, how strong, none at all) are voters too.
Every document of the corpus is reduced to its votes and a few numbers.  The counts of vote
patterns over all documents, a table bounded by the number of patterns, fit a generative label
model without any given label: the accuracy of every voter and the correlations between
voters, which lower the weight of those that repeat each other.  Its posterior labels of all
documents, never the given labels, train a linear classifier.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import bounded_batches, materialize
from .labelled import fit_logistic, fold, sigmoid, training_rows

#: Bound on the labelled rows that terms are mined from.
MAX_LABELLED = 20_000
#: A term must be in so many toxic documents and this unlikely by chance (z score), at these log odds.
LEAST_DOCS, LEAST_Z, LEAST_ODDS = 6, 7.0, 1.5
#: Lengths of beginnings of words that may be terms; these end in a mark.
STEMS = (4, 5, 6, 7, 8)
MARK = "*"
#: Lexicon voters, and pattern voters beside them.
LEXICONS, PATTERNS = 12, 7
#: Log odds from which a term is strong.
STRONG = 3.0
#: Total weight of all documents in the classifier's fit, against its ridge.
WEIGHT, RIDGE = 10_000.0, 2.0
FAR = 4.0
#: Standard deviation of the log odds that expectation maximisation starts from.
START = 3.0

_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def terms_of(text: str | None) -> list[str]:
    """Lower-cased words without signs at their ends."""
    return [w if w.isalnum() else _EDGE.sub("", w) for w in (text or "").lower().split()]


def candidates(words: set[str]) -> set[str]:
    """The words and the beginnings of longer ones."""
    return {w for w in words if w} | {w[:k] + MARK for k in STEMS for w in words if len(w) > k}


def mine_terms(rows: DataFrame, *, text: str = "text", label: str = "_y") -> tuple[dict[str, float], DataFrame]:
    """Terms that are more frequent in toxic documents, with their log odds; and the terms of each toxic document.

    A term counts once per document; it must be far likelier in toxic documents than length
    alone explains.  Of a term and the longer ones that begin with it, the one with the
    highest z score is taken.
    """

    def split(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [set(terms_of(t if isinstance(t, str) else None)) - {""} for t in part["text"]]
            yield pd.DataFrame({"y": part["y"], "n": [len(u) for u in found], "terms": [sorted(candidates(u)) for u in found]})

    pairs = rows.select(F.col(text).alias("text"), F.col(label).cast("int").alias("y"))
    found = materialize(pairs.mapInPandas(split, "y int, n long, terms array<string>"), "terms")
    sums = {r.y: r for r in found.groupBy("y").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs")).collect()}
    toxic = found.filter("y = 1").select("terms")
    if not {0, 1} <= set(sums):
        return {}, toxic
    size = [float(sums[0].n or 0), float(sums[1].n or 0)]
    share = size[1] / max(1.0, sum(size))
    per = found.select("y", F.explode("terms").alias("term")).groupBy("term").agg(F.count_if(F.col("y") == 1).alias("a"), F.count_if(F.col("y") == 0).alias("b"))
    n = F.col("a") + F.col("b")
    z = (F.col("a") - n * share) / F.sqrt(n * (share * (1 - share)) + F.lit(1e-12))
    odds = F.log((F.col("a") + 0.5) / (size[1] + 1)) - F.log((F.col("b") + 0.5) / (size[0] + 1))
    good = per.filter(F.col("a") >= LEAST_DOCS).select("term", z.alias("z"), odds.alias("odds")).filter((F.col("z") >= LEAST_Z) & (F.col("odds") >= LEAST_ODDS))
    chosen: dict[str, float] = {}
    stems: set[str] = set()
    begun: set[str] = set()
    for r in sorted(good.collect(), key=lambda r: (-round(r.z, 6), r.term)):  # words tied to toxicity, of the bounded rows above
        word = r.term.rstrip(MARK) if r.term.endswith(MARK) else r.term
        if any(word[:k] in stems for k in STEMS) or (r.term.endswith(MARK) and word in begun):
            continue
        chosen[r.term] = round(r.odds, 4)
        if r.term.endswith(MARK):
            stems.add(word)
        begun.update(word[:k] for k in STEMS if len(word) > k)
    return chosen, toxic


def lexicons(terms: dict[str, float], toxic: DataFrame, k: int = LEXICONS) -> dict[str, int]:
    """The lexicon of each term: terms that occur in the same toxic documents stand together.

    Terms are vectors over those documents; the first centre is the term of the highest odds,
    each further one the term least like the centres so far, and a few rounds of k-means follow.
    """
    names = sorted(terms)
    if not names:
        return {}
    wanted = F.array(*map(F.lit, names))
    at = {w: i for i, w in enumerate(names)}
    docs = sorted(tuple(sorted(r.t)) for r in toxic.select(F.array_intersect("terms", wanted).alias("t")).filter(F.size("t") > 0).collect())
    x = np.zeros((len(names), max(1, len(docs))))
    for j, ws in enumerate(docs):
        for w in ws:
            x[at[w], j] = 1.0
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    centres = [x[max(range(len(names)), key=lambda i: (terms[names[i]], names[i]))]]
    while len(centres) < min(k, len(names)):
        centres.append(x[int((x @ np.array(centres).T).max(axis=1).argmin())])
    c = np.array(centres)
    for _ in range(20):
        own = (x @ c.T).argmax(axis=1)
        c = np.array([x[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return dict(zip(names, (int(j) for j in own), strict=True))


@dataclass
class Lexicon:
    """Terms, their log odds and lexicons; finds the term of a word."""

    odds: dict[str, float]
    group: dict[str, int]
    seen: dict[str, str | None] = field(default_factory=dict, repr=False, compare=False)

    def term(self, word: str) -> str | None:
        got = self.seen.get(word, "")
        if got == "":
            got = word if word in self.odds else next((t for k in STEMS if len(word) > k and (t := word[:k] + MARK) in self.odds), None)
            if len(self.seen) > 500_000:
                self.seen.clear()
            self.seen[word] = got
        return got

    def __getstate__(self) -> dict:
        return {"odds": self.odds, "group": self.group, "seen": {}}


def measures(text: str | None, lex: Lexicon) -> list[float]:
    """Numbers of one document that both the voters and the classifier use."""
    ws = terms_of(text)
    n = len(ws)
    hits = [(i, t) for i, t in enumerate(map(lex.term, ws)) if t is not None]
    per = [0.0] * LEXICONS
    kinds = {t for _, t in hits}
    odds = 0.0
    for t in kinds:
        odds += lex.odds[t]
        per[lex.group[t]] += 1.0
    strong = sum(lex.odds[t] >= STRONG for _, t in hits)
    gap = min((b - a for (a, _), (b, _) in zip(hits, hits[1:], strict=False)), default=0)
    return [
        *per,
        float(len(kinds)),
        math.log1p(len(hits)),
        math.log1p(1000.0 * len(hits) / max(1, n)),
        math.log1p(sum(lex.odds[t] for _, t in hits) / math.sqrt(max(1.0, n))),
        math.log1p(odds),
        math.log1p(strong),
        1.0 / gap if gap else 0.0,
        math.log1p(n),
        float(not hits),
    ]


def votes(m: list[float]) -> list[int]:
    """1 (toxic), -1 (not) or 0 (abstain) of each voter for the measures of a document."""
    kinds, hits, density, per_root, _, strong, near, _, none = m[LEXICONS:]
    return [
        *[1 if x >= 1 else 0 for x in m[:LEXICONS]],
        1 if kinds >= 2 else -1 if kinds == 0 else 0,
        1 if hits >= math.log1p(3) else -1 if hits < math.log1p(1) else 0,
        1 if density >= math.log1p(8) else -1 if density < math.log1p(1) else 0,
        1 if per_root >= math.log1p(0.5) else -1 if per_root < math.log1p(0.1) else 0,
        1 if strong >= math.log1p(2) else -1 if strong == 0 else 0,
        1 if near >= 1 / 40 else -1 if near < 1 / 400 else 0,
        -1 if none else 0,
    ]


def _correlations(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Correlations of the columns of ``x``, rows weighed by ``w``; 0 on the diagonal."""
    x = x - (x * w[:, None]).sum(axis=0) / max(1e-9, w.sum())
    cov = (x * w[:, None]).T @ x / max(1e-9, w.sum())
    d = np.sqrt(np.maximum(np.diag(cov), 1e-9))
    out = cov / np.outer(d, d)
    np.fill_diagonal(out, 0.0)
    return out


def _balanced(z: np.ndarray, counts: np.ndarray, prior: float) -> np.ndarray:
    """Posteriors for log odds that lack a constant: the one with which the class balance holds."""
    low, high = -100.0, 100.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (sigmoid(z + mid) * counts).sum() < prior * counts.sum() else (low, mid)
    return sigmoid(z + (low + high) / 2)


def label_model(patterns: np.ndarray, counts: np.ndarray, prior: float, steps: int = 100) -> tuple[np.ndarray, dict]:
    """Posterior of label 1 for each vote pattern, and what the model learned; no labels are given.

    ``counts`` holds how many documents of the corpus have a pattern; ``prior`` is the share of
    label 1.  Expectation maximisation starts from the majority of the votes, in which voters
    that repeat each other count as one; correlation of two voters within a class goes on to
    lower the weight of both.
    """
    k = patterns.shape[1]
    one = (patterns[:, :, None] == np.array([-1, 0, 1])[None, None, :]).astype(float)
    total = max(1.0, counts.sum())
    whole = _correlations(patterns, counts / total)
    z = patterns @ (1.0 / (1.0 + np.maximum(whole, 0).sum(axis=1)))
    mean = (z * counts).sum() / total
    spread = math.sqrt(max(1e-12, float(((z - mean) ** 2 * counts).sum() / total)))
    post = _balanced((z - mean) / spread * START, counts, prior)
    corr, damp = np.zeros((k, k)), np.ones(k)
    p1 = p0 = np.full((k, 3), 1 / 3)
    for _ in range(steps):
        w1, w0 = counts * post / total, counts * (1 - post) / total
        p1 = ((one * w1[:, None, None]).sum(axis=0) + 1e-3) / (w1.sum() + 3e-3)
        p0 = ((one * w0[:, None, None]).sum(axis=0) + 1e-3) / (w0.sum() + 3e-3)
        corr = (_correlations(patterns, w1) + _correlations(patterns, w0)) / 2
        damp = 1.0 / (1.0 + np.maximum(corr, 0).sum(axis=1))
        z = ((one * (np.log(p1) - np.log(p0))[None]).sum(axis=2) * damp[None]).sum(axis=1)
        new = _balanced(z, counts, prior)
        done = np.abs(new - post).max() < 1e-6
        post = new
        if done:
            break
    return post, {"accuracies": np.stack([p0, p1]), "correlations": corr, "damping": damp}


@dataclass(frozen=True)
class Model:
    """The lexicons and the linear classifier over ``measures``."""

    lexicon: Lexicon
    weights: list[float]
    bias: float
    means: list[float]
    scales: list[float]


def train(cells: list[tuple[tuple[int, ...], float, np.ndarray]], prior: float, lex: Lexicon, *, posterior=label_model) -> Model:
    """The classifier from cells (votes, number of documents, their mean measures) of the whole corpus."""
    count: dict[tuple[int, ...], float] = {}
    for v, n, _ in cells:
        count[v] = count.get(v, 0.0) + n
    keys = sorted(count)
    post, _ = posterior(np.array(keys, dtype=float), np.array([count[k] for k in keys]), prior)
    of = dict(zip(keys, post, strict=True))
    x, n = np.array([m for _, _, m in cells]), np.array([c for _, c, _ in cells])
    means = (x * n[:, None]).sum(axis=0) / n.sum()
    scales = np.sqrt(((x - means) ** 2 * n[:, None]).sum(axis=0) / n.sum()) + 1e-9
    w, b = fit_logistic(_scaled(x, means, scales), np.array([of[v] for v, _, _ in cells]), weight=n * (WEIGHT / n.sum()), l2=RIDGE)
    return Model(lex, w.tolist(), b, means.tolist(), scales.tolist())


def _scaled(x: np.ndarray, means: np.ndarray, scales: np.ndarray) -> np.ndarray:
    """Measures in standard deviations from their means, held to FAR of them: none outweighs all others."""
    return np.clip((x - means) / scales, -FAR, FAR)


def score_measures(x: np.ndarray, model: Model) -> np.ndarray:
    return sigmoid(_scaled(x, np.array(model.means), np.array(model.scales)) @ np.array(model.weights) + model.bias)


def measured(docs: DataFrame, lex: Lexicon) -> DataFrame:
    """doc_id, x (measures) and v (votes, joined) of every document, written once."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            x = [measures(t if isinstance(t, str) else None, lex) for t in part.pop("text")]
            part["x"], part["v"] = x, [",".join(map(str, votes(m))) for m in x]
            yield part

    rows = docs.select(F.col("doc_id").cast("string").alias("id"), "text")
    # Ids go through Python as text, so that nulls and large numbers stay what they are.
    out = rows.mapInPandas(run, "id string, x array<double>, v string")
    return materialize(out.select(F.col("id").cast(dict(docs.dtypes)["doc_id"]).alias("doc_id"), "x", "v"), "measured")


def corpus_cells(rows: DataFrame) -> list[tuple[tuple[int, ...], float, np.ndarray]]:
    """Votes, number of documents and mean measures of the cells of the corpus.

    A cell is a vote pattern and a size class of the documents, so there are as many as
    patterns and classes allow, however large the corpus is.
    """
    d = LEXICONS + 9
    means = [F.avg(F.col("x")[i]).alias(f"x{i}") for i in range(d)]
    cells = rows.groupBy("v", F.floor(F.col("x")[LEXICONS + 7]).alias("size")).agg(F.count(F.lit(1)).alias("n"), *means)
    got = sorted(cells.collect(), key=lambda r: (r.v, r["size"]))
    return [(tuple(map(int, r.v.split(","))), float(r.n), np.array([r[f"x{i}"] for i in range(d)])) for r in got]


def fit(docs: DataFrame, labels: DataFrame, *, max_labelled: int = MAX_LABELLED) -> tuple[Model | None, DataFrame | None, float]:
    """The model, the measured documents and the share of label 1; nothing without labels of both kinds."""
    bounded_batches(docs.sparkSession)
    known = materialize(training_rows(docs, labels, "toxic", max_labelled), "known")
    odds, toxic = mine_terms(known)
    balance = known.agg(F.avg(F.col("_y").cast("double")).alias("p")).first().p
    if balance is None or not 0 < balance < 1:
        return None, None, 0.0
    lex = Lexicon(odds, lexicons(odds, toxic))
    rows = measured(docs.select("doc_id", "text"), lex)
    cells = corpus_cells(rows)
    return (train(cells, balance, lex) if cells else None), rows, balance


def score_toxicity(docs: DataFrame, labels: DataFrame, *, max_labelled: int = MAX_LABELLED, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``.

    Terms and the class balance are learned from at most ``max_labelled`` rows outside the
    held-out fold; votes are counted, and the classifier is trained, over all documents.  Null
    and empty texts get a score as any other, very long ones are read whole; an empty table
    gives an empty one.  Without labels of both kinds every score is 0.  Repeated rows repeat,
    equal texts get equal scores; further columns are ignored, whatever their names.
    """
    docs = docs.select("doc_id", "text")
    model, rows, _ = fit(docs, labels, max_labelled=max_labelled)

    @F.pandas_udf("double")
    def score(col: pd.Series) -> pd.Series:
        return pd.Series(score_measures(np.stack(col.to_numpy()), model) if len(col) else np.zeros(0))

    out = docs.withColumn("score", F.lit(0.0)) if model is None or rows is None else rows.withColumn("score", score("x"))
    out = out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
