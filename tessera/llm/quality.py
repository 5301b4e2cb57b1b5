"""Quality by positive-unlabelled learning.

Trusted positives are labelled rows of good quality; the other sample is unlabelled web
text, good and bad mixed.  A small network minimises the non-negative unbiased risk:
with the class prior pi, the loss of positives taken as positive, plus the loss of
unlabelled rows taken as negative less pi times that of positives, where that difference
is never let below zero.  All documents are the unlabelled sample: their features are
measured once and written, and means, prior and risk are taken over all of them.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import bounded_batches, materialize, quoted, unused
from .labelled import fit_logistic, fold, least_by_hash, sigmoid

#: Bound on the labelled rows that are fitted on, and on the unlabelled rows of the first steps.
MAX_LABELLED = 12_000
MAX_FIRST = 12_000
#: Rates of the passes over all rows that follow.
PASSES = (1e-3, 5e-4, 2e-4)
_SIGNS = "#$%&*!|@<>{}[]=_~^\\/"
_SIGN_TABLE = str.maketrans("", "", _SIGNS)
_ENDS = re.compile(r"[.!?…\"')»]\s*$")


def features(text: str | None) -> list[float]:
    """Numbers that describe a whole text: length, characters, words, lines, repeats."""
    t = text or ""
    n = max(1, len(t))
    ws = t.split()
    k = max(1, len(ws))
    lines = t.split("\n")
    m = max(1, len(lines))
    low = [w.lower() for w in ws]
    counts = Counter(low)
    top = counts.most_common(3)
    run = sum(a == b for a, b in zip(low, low[1:], strict=False))
    pairs = len(set(zip(low, low[1:], strict=False)))
    signs = n - len(t.translate(_SIGN_TABLE))
    upper = sum(w.isupper() and len(w) > 1 for w in ws)
    caps = sum(w[0].isupper() for w in ws)
    marked = sum(w[-1] in _SIGNS for w in ws)
    alone = sum(len(w) == 1 and not w.isalnum() for w in ws)
    short = sum(len(w) <= 3 for w in ws)
    stops = t.count(". ") + t.count(".\n") + t.endswith(".")
    raw = t.encode("utf-8", "surrogatepass")
    packed = len(zlib.compress(raw, 1)) / max(1, len(raw))
    lengths = [len(w) for w in ws] or [0]
    dup = 1 - len(set(lines)) / m
    return [
        np.log1p(n), np.log1p(k), np.log1p(m), sum(lengths) / k, max(lengths) ** 0.5, signs / n, upper / k, caps / k, marked / k, alone / k,
        short / k, stops / k, t.count(",") / k, len(counts) / k, len(counts) / k**0.8, run / k, pairs / k,
        (top[0][1] if top else 0) / k, sum(c for _, c in top) / k, packed, packed * np.log1p(n), dup,
        sum(1 for x in lines if _ENDS.search(x)) / m, np.log1p(n / m), sum(c.isdigit() for c in t[:1] + t[-1:]) / 2,
        len(re.findall(r"[0-9]", t)) / n, t.count("!") / k, t.count("|") / k, t.count("http") / k, float(not ws),
    ]


@dataclass(frozen=True)
class Model:
    means: np.ndarray
    scales: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    bias: float
    prior: float
    slope: float
    shift: float


def estimate_prior(positive: np.ndarray, edges: np.ndarray, counts: np.ndarray) -> float:
    """Share of positives among all rows, from scores of a classifier that tells the two samples apart.

    ``positive`` holds scores of positives that the classifier hasn't seen, ``counts`` how many
    of all rows score between ``edges`` (one count more than edges: below the first, above the
    last).  Where bad texts don't reach, the share of all rows over that of positives is the
    prior; the lower quartile of that ratio, over up to 8 ranges of 50 positives or so, less
    one standard deviation of their number, stands for it: too high a prior finds nothing bad,
    too low a one costs little.  Held to 0.05 .. 0.98.
    """
    own = np.bincount(np.searchsorted(edges, positive, side="right"), minlength=len(edges) + 1)
    k = int(np.clip(len(positive) // 50, 2, 8))
    part = np.minimum((np.cumsum(own) - own) * k // max(1, own.sum()), k - 1)
    n, m = np.bincount(part, weights=own, minlength=k), np.bincount(part, weights=counts, minlength=k)
    ratio = np.where(n > 0, (m / max(1, counts.sum())) / np.maximum(n / max(1, own.sum()), 1e-9), np.inf)
    if not np.isfinite(ratio).any():
        return 0.5
    return float(np.clip(np.quantile(ratio[np.isfinite(ratio)], 0.25) * (1 - max(2, len(positive)) ** -0.5), 0.05, 0.98))


def _forward(x: np.ndarray, h: np.ndarray, hb: np.ndarray, o: np.ndarray, b: float) -> tuple[np.ndarray, np.ndarray]:
    a = np.maximum(x @ h + hb, 0)
    return a, a @ o + b


class PuSteps:
    """Mini-batches of the non-negative risk with the logistic loss (Adam) for a network of one hidden layer."""

    def __init__(self, p: list[np.ndarray], positive: np.ndarray, prior: float, *, seed: int = 3, rate: float = 3e-3, size: int = 256):
        self.p, self.positive, self.prior, self.rate, self.size = [q.copy() for q in p], positive, prior, rate, size
        self.r = np.random.default_rng(seed)
        self.m, self.v, self.t = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0

    @staticmethod
    def new(d: int, units: int = 24, seed: int = 3) -> list[np.ndarray]:
        r = np.random.default_rng(seed)
        return [r.normal(0, (2 / d) ** 0.5, (d, units)), np.zeros(units), r.normal(0, units**-0.5, units), np.zeros(1)]

    def _grad(self, x: np.ndarray, a: np.ndarray, dz: np.ndarray) -> list[np.ndarray]:
        da = np.outer(dz, self.p[2]) * (a > 0)
        return [x.T @ da, da.sum(axis=0), a.T @ dz, np.array([dz.sum()])]

    def over(self, unlabelled: np.ndarray) -> None:
        """One pass over these unlabelled rows, in random order, beside random positives."""
        order = self.r.permutation(len(unlabelled))
        for i in range(0, len(order), self.size):
            xu, xp = unlabelled[order[i : i + self.size]], self.positive[self.r.integers(0, len(self.positive), self.size)]
            (au, zu), (ap, zp) = _forward(xu, *self.p[:3], self.p[3][0]), _forward(xp, *self.p[:3], self.p[3][0])
            negative = np.logaddexp(0, zu).mean() - self.prior * np.logaddexp(0, zp).mean()
            if negative >= 0:
                gu = self._grad(xu, au, sigmoid(zu) / len(xu))
                gp = self._grad(xp, ap, self.prior * (-sigmoid(-zp) - sigmoid(zp)) / len(xp))
                g = [a + b for a, b in zip(gu, gp, strict=True)]
            else:  # the estimate fell below zero: climb back
                gu, gp = self._grad(xu, au, sigmoid(zu) / len(xu)), self._grad(xp, ap, self.prior * sigmoid(zp) / len(xp))
                g = [b - a for a, b in zip(gu, gp, strict=True)]
            self.t += 1
            for q in range(4):
                gq = g[q] + (1e-4 * self.p[q] if q in (0, 2) else 0)
                self.m[q] = 0.9 * self.m[q] + 0.1 * gq
                self.v[q] = 0.999 * self.v[q] + 0.001 * gq * gq
                self.p[q] = self.p[q] - self.rate * (self.m[q] / (1 - 0.9**self.t)) / (np.sqrt(self.v[q] / (1 - 0.999**self.t)) + 1e-8)


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, *, epochs: int = 40, seed: int = 3) -> list[np.ndarray]:
    """The network after passes over a list of unlabelled rows."""
    steps = PuSteps(PuSteps.new(positive.shape[1], seed=seed), positive, prior, seed=seed)
    for _ in range(epochs):
        steps.over(unlabelled)
    return steps.p


def fit_pu_on(measured: DataFrame, x: str, p: list[np.ndarray], positive: np.ndarray, prior: float, means: np.ndarray, scales: np.ndarray, rate: float) -> list[np.ndarray]:
    """The network after a pass over all rows: every task goes over its own from the same start, and the results are averaged by rows."""
    given = measured.sparkSession.sparkContext.broadcast((p, positive))

    def fit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        start, trusted = given.value
        steps, n = PuSteps(start, trusted, prior, seed=17, rate=rate), 0
        for part in parts:
            rows = np.stack(part["x"].to_numpy()) if len(part) else np.zeros((0, len(means)))
            steps.over(_squash(rows, means, scales))
            n += len(rows)
        if n:
            flat = np.concatenate([q.ravel() for q in steps.p])
            yield pd.DataFrame({"i": np.arange(len(flat)), "w": flat * n, "n": n})

    got = measured.select(F.col(x).alias("x")).mapInPandas(fit, "i int, w double, n long").groupBy("i").agg((F.sum("w") / F.sum("n")).alias("w")).collect()
    if not got:
        return p
    flat = np.array([r.w for r in sorted(got, key=lambda r: r.i)])
    return [c.reshape(q.shape) for c, q in zip(np.split(flat, np.cumsum([q.size for q in p])[:-1]), p, strict=True)]


def _squash(x: np.ndarray, means: np.ndarray, scales: np.ndarray) -> np.ndarray:
    return np.clip((x - means) / scales, -6, 6)


def raw_scores(x: np.ndarray, model: Model) -> np.ndarray:
    return _forward(_squash(x, model.means, model.scales), model.hidden, model.hidden_bias, model.out, model.bias)[1]


def measured(docs: DataFrame, name: str, *, text: bool = True) -> DataFrame:
    """``docs`` with the features of each whole text in the column ``name``, written once; without ``text`` it isn't kept."""

    @F.pandas_udf("array<double>")
    def measure(col: pd.Series) -> pd.Series:
        return pd.Series([features(t if isinstance(t, str) else None) for t in col], dtype=object)

    bounded_batches(docs.sparkSession)
    out = docs.withColumn(name, measure("text"))
    return materialize(out if text else out.drop("text"), "measured")


def _collected(rows: DataFrame, x: str) -> list:
    """doc_id, x and _y, if there is one, of bounded rows; only numbers come to the driver, in an order that doesn't change."""
    got = rows.select("doc_id", F.col(x).alias("x"), *[c for c in rows.columns if c == "_y"]).collect()
    return sorted(got, key=lambda r: (r.doc_id, *r.x))


def quality_model(rows: DataFrame, labels: DataFrame, x: str, *, max_labelled: int = MAX_LABELLED, first: int = MAX_FIRST) -> Model | None:
    """The model from measured rows (``x`` names their features); None without positives or without text.

    Means, scales, the prior and the risk are over all rows.  The first steps are on ``first``
    unlabelled rows, then PASSES go over all of them.  The risk sees positives and unlabelled
    rows only; the labels of all of the at most ``max_labelled`` known rows set the scale of
    the scores.
    """
    usable = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
    one = usable.groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("_y"))
    chosen = least_by_hash(one, max_labelled)
    # A doc_id counts once, with the least of its rows.
    known = _collected(rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(x).alias(x), F.first("_y").alias("_y")), x)
    y = np.array([r["_y"] for r in known])
    if (y == 1).sum() < 4:
        return None
    d = len(known[0].x)
    col = lambda i: F.col(x)[i]
    sums = rows.agg(*[F.avg(col(i)).alias(f"m{i}") for i in range(d)], *[F.stddev_pop(col(i)).alias(f"s{i}") for i in range(d)]).first()
    means, scales = np.array([sums[f"m{i}"] for i in range(d)]), np.array([sums[f"s{i}"] for i in range(d)]) + 1e-6
    given = _squash(np.array([r.x for r in known]), means, scales)
    positive = given[y == 1]
    some = least_by_hash(rows.select("doc_id", x), first, F.lit(3))
    other = _squash(np.array([r[x] for r in some.collect()]), means, scales)
    # Half of the positives against rows of all kinds; how all rows score tells the prior.
    half = len(positive) // 2
    w, b = fit_logistic(np.vstack([positive[:half], other]), np.r_[np.ones(half), np.zeros(len(other))], l2=5.0)
    scores = positive[half:] @ w + b
    edges = np.unique(np.quantile(scores, np.linspace(0, 1, 65)))
    parts = [F.lit(float(k)) * F.greatest(F.lit(-6.0), F.least(F.lit(6.0), (col(i) - float(m)) / float(s))) for i, (k, m, s) in enumerate(zip(w, means, scales, strict=True))]
    total = F.lit(float(b))
    for q in parts:
        total = total + q
    bins = rows.select(total.alias("_s")).select(F.size(F.filter(F.array(*map(F.lit, map(float, edges))), lambda e: e <= F.col("_s"))).alias("_k")).groupBy("_k").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(len(edges) + 1)
    for r in bins.collect():
        counts[r["_k"]] = r.n
    prior = estimate_prior(scores, edges, counts)
    p = fit_pu(positive, other, prior)
    for rate in PASSES:
        p = fit_pu_on(rows, x, p, positive, prior, means, scales, rate)
    slope, shift = 1.0, 0.0
    if 0 < y.sum() < len(y):
        w, shift = fit_logistic(_forward(given, *p[:3], p[3][0])[1][:, None], y.astype(float), l2=1e-3)
        slope = float(max(w[0], 1e-3))
    return Model(means, scales, p[0], p[1], p[2], float(p[3][0]), prior, slope, shift)


def score_quality(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, text: bool = True, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``docs`` with held_out, score and predicted; all other columns stay but those called so, and text without ``text``.

    Null and empty texts are scored as any other, very long ones whole; an empty table gives an
    empty one.  Without a model (fewer than four positives) every score is 1, so that nothing is
    rejected unlearned.  Repeated rows repeat, equal texts get equal scores.
    """
    kept = docs.select(*[quoted(c) for c in docs.columns if c.lower() not in ("held_out", "score", "predicted")])
    x = unused("x", docs)
    rows = measured(kept, x, text=text)
    model = quality_model(rows, labels, x, max_labelled=max_labelled)

    @F.pandas_udf("double")
    def score(col: pd.Series) -> pd.Series:
        if model is None or not len(col):
            return pd.Series(np.ones(len(col)))
        return pd.Series(sigmoid(raw_scores(np.stack(col.to_numpy()), model) * model.slope + model.shift))

    out = rows.withColumn("held_out", fold(F.col("doc_id")) == 0).withColumn("score", score(x)).drop(x)
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
