"""Language-model scores from a causal self-attention model on subword ids.

A text is its words and an end.  A word is its subword ids: the first, then the inner
ones and an end of word.  An attention model predicts all of them, with weights of its
own for first and for inner ids.  Its first steps are on a bounded sample of texts in one
task; then it passes over all training rows on the executors.  The mask lets a
first id see the first ids of the words before it in the window, and an inner id see the
ids of its own word; so what an inner id gets depends on its word alone, and is computed
once per distinct word and not per occurrence.  Windows overlap: each holds some ids as
context only, and every id is scored once, in the window where it isn't context.

The corpus gives exact counts of all words.  The class of a first id also says whether
the word is in a bounded table of frequent words.  Those words have, given their class,
their share of the class's occurrences.  Other words are spelled by inner ids, mixed with
their share among all words outside the table.  Each token's probability is interpolated
with that of the base, so that no spelling, however odd, is ruled out.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .base import bounded_batches, materialize
from .labelled import fold, least_by_hash

FOLDS, HELD_OUT = 7, 2
#: Classes of first ids of frequent words (the last is the end of a text, the one before takes all rarer ids), then of
#: first ids of other words (the last takes all rarer ids); classes of inner ids (rarer ids, end of word).
FREQUENT, OTHER, INNER = 96, 64, 512
FIRST = FREQUENT + OTHER
DIM = 16
#: Length of a window of first ids, and how many of these are context; the same for inner ids.
WINDOW, CONTEXT = 48, 16
INNER_WINDOW, INNER_CONTEXT = 8, 4
#: Bound on the table of frequent words that every worker holds.
MAX_FREQUENT = 300_000
#: One in so many distinct words, at least, isn't in the table: the rarest, from which the spelling of others is learned.
SPELLED = 10
#: Bound on the texts of the first steps, which one task does; after these the model passes over all training rows.
MAX_TRAINING = 5_000
#: Rate of each pass's steps on the executors; every training row is in one of these passes.
RATES = (2e-3, 7e-4)
#: Windows that each pass sees at least, rows counted again, where the first steps haven't been on all texts.
LEAST_WINDOWS = 32_000
#: Bound on the bytes of these texts, and on the sets of weights that the driver collects of a pass.
FIRST_BYTES, PARTS = 64 << 20, 256
#: Places whose logits are held at once, of first and of inner ids.
BLOCK, INNER_BLOCK = 4096, 1024
#: Characters of a word that are encoded at once; longer words are encoded in pieces.
PIECE = 64
DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Weight of the plain shares of inner classes beside the model's, and of counts beside the spelling of other words.
FLAT, COUNTED = 0.05, 0.5
#: Weight of the base's probability of a token beside the model's.
BASE = 0.05


def words_of(text: str | None) -> list[bytes]:
    """Words as bytes: A-Z lower-cased, parted by ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def joined_words(texts: list[str | None] | pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of texts as by ``words_of``, joined in one array of bytes, and how many each text has."""
    if isinstance(texts, pa.Array):
        a = pc.fill_null(texts.cast(pa.large_string()), "")
    else:
        a = pa.array([(t or "").encode("utf-8", "surrogatepass") for t in texts], pa.large_binary()).view(pa.large_string())
    split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(a)))
    values, n = split.flatten().cast(pa.large_binary()), np.diff(split.offsets.to_numpy())
    some = pc.greater(pc.binary_length(values), 0)  # a text without words gives one empty piece
    n[pc.equal(pc.binary_length(pc.ascii_trim_whitespace(a)), 0).to_numpy(zero_copy_only=False)] = 0
    return values.filter(some), n.astype(np.int64)


def gathered(parts: Iterator[pa.RecordBatch], rows: int = 1 << 30, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches joined until they have ``rows`` rows or ``size`` bytes."""
    held, n, b = [], 0, 0
    for part in parts:
        if not part.num_rows:
            continue
        held.append(part)
        n, b = n + part.num_rows, b + part.nbytes
        if n >= rows or b >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n, b = [], 0, 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def packed_ids(ids: list[list[int]]) -> pa.Array:
    """One value of bytes per list: its numbers of 32 bits."""
    ends = np.cumsum([0, *map(len, ids)])
    flat = np.fromiter(chain.from_iterable(ids), dtype="<i4", count=int(ends[-1]))
    return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer((ends * 4).astype(np.int32)), pa.py_buffer(flat)])


def unpacked_ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers that ``packed_ids`` packed, joined, and how many each value has."""
    if not len(column):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].view("<i4")
    return flat.astype(np.int64), np.diff(at).astype(np.int64) // 4


class Subwords:
    """Ids of words under a public byte-level vocabulary in a file of ranks."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.n_ids = max(ranks.values()) + 1
        self._encoding = tiktoken.Encoding("subwords", pat_str=r" ?[^\s]+|\s+", mergeable_ranks=ranks, special_tokens={})

    def __call__(self, word: bytes) -> list[int]:
        t = word.decode("utf-8", "replace")
        if len(t) <= PIECE:
            return self._encoding.encode_ordinary(" " + t)
        out = []
        for i in range(0, len(t), PIECE):
            out += self._encoding.encode_ordinary(t[i : i + PIECE] if i else " " + t[:PIECE])
        return out


@cache
def _subwords(tokenizer: str) -> Subwords:
    """The vocabulary, read once in a worker."""
    return Subwords(tokenizer)


@dataclass
class Attention:
    """Causal self-attention with a residual path: one layer and head for first ids, one (names end in 1) for inner ids."""

    p: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def new(seed: int = 11) -> Attention:
        r = np.random.default_rng(seed)
        n = lambda *s, k=0.1: r.normal(0, k, s).astype(np.float32)
        d = DIM
        layer = lambda m: {f"e{m}": n(FIRST + INNER + 1, d, k=0.3), f"pos{m}": n(WINDOW, d, k=0.02), f"q{m}": n(d, d, k=0.2), f"k{m}": n(d, d, k=0.2), f"v{m}": n(d, d, k=0.25), f"o{m}": n(d, d, k=0.25)}
        return Attention(layer("") | layer("1") | {"u0": n(d, FIRST), "b0": np.zeros(FIRST, np.float32), "u1": n(d, INNER), "b1": np.zeros(INNER, np.float32)})

    def states(self, ids: np.ndarray, valid: np.ndarray, scored: int, inner: bool, keep: bool = False):
        """States (windows, scored, DIM) at the last ``scored`` places of each window.

        ``ids`` (windows, length) are inputs, ``valid`` marks those within their text.
        """
        p, n, m, d = self.p, ids.shape[1], "1" if inner else "", DIM
        x = np.take(p["e" + m], ids, axis=0)
        x += p["pos" + m][:n]
        # One product for queries, keys and values; a column of ones beside the values sums the weights with them.
        qkv = x.reshape(-1, d) @ np.concatenate([p["q" + m] * np.float32(d**-0.5), p["k" + m], p["v" + m], np.zeros((d, 1), x.dtype)], axis=1)
        qkv[:, 3 * d] = 1
        qkv = qkv.reshape(len(ids), n, 3 * d + 1)
        q, k, v = qkv[:, n - scored :, :d], qkv[:, :, d : 2 * d], qkv[:, :, 2 * d :]
        s = np.matmul(q, k.transpose(0, 2, 1))
        np.exp(np.minimum(s, np.float32(40), out=s), out=s)
        if scored > 1:
            s *= _seen(scored, n, s.dtype)  # no id sees those ahead of it
        part = np.flatnonzero(~valid.all(axis=1))
        s[part] *= valid[part][:, None, :]
        c = np.matmul(s, v)
        total = c[:, :, d:] + np.float32(1e-30)
        c = c[:, :, :d] / total
        h = (c.reshape(-1, d) @ p["o" + m]).reshape(c.shape)
        h += x[:, n - scored :]
        return (h, (x, q, k, v, s, c, total)) if keep else h

    def head(self, inner: bool) -> tuple[np.ndarray, float, float]:
        """Weights of the logits with their biases as a last row, and what bounds the logits."""
        u, b = (self.p["u1"], self.p["b1"]) if inner else (self.p["u0"], self.p["b0"])
        return np.concatenate([u, b[None]]), float((u * u).sum(axis=0).max()), float(np.abs(b).max())

    @staticmethod
    def odds(h: np.ndarray, head: tuple[np.ndarray, float, float]) -> np.ndarray:
        """Logits of the classes for states (places, DIM and a one); they may be changed in place."""
        z = h @ head[0]
        # Exponentials stay finite; the bound on all logits is cheaper than a look at each.
        if len(h) and math.sqrt(float(np.einsum("ij,ij->i", h, h).max()) * head[1]) + head[2] > 60:
            np.minimum(z, 60, out=z)
        return z

    def gradient(self, ids: np.ndarray, valid: np.ndarray, target: np.ndarray, weight: np.ndarray, inner: bool) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over the weighted targets and its gradient."""
        p, scored, n, m, d = self.p, target.shape[1], ids.shape[1], "1" if inner else "", DIM
        h, (x, q, k, v, s, c, total) = self.states(ids, valid, scored, inner, keep=True)
        flat = lambda a: a.reshape(-1, a.shape[-1])
        used = np.flatnonzero(weight.ravel() > 0)
        y, w = target.ravel()[used], (weight.ravel()[used] / max(1.0, float(weight.sum()))).astype(h.dtype)
        hs = np.ones((len(used), d + 1), h.dtype)
        hs[:, :d] = flat(h)[used]
        head = self.head(inner)
        back = np.concatenate([head[0][:d].T, np.ones((head[0].shape[1], 1), h.dtype)], axis=1)
        z, at = self.odds(hs, head), np.arange(len(hs))
        hit = z[at, y]
        np.exp(z, out=z)
        # Sums come with the product, and rows are scaled on the side of the states, which is short.
        dhs = z @ back
        sums = dhs[:, d].copy()
        loss = float((np.log(sums) - hit) @ w)
        scale = (w / sums)[:, None]
        z[at, y] -= sums
        gu = z.T @ (hs * scale)
        g = {"u1" if inner else "u0": gu[:, :d].T, "b1" if inner else "b0": gu[:, d]}
        dhs *= scale
        dhs -= w[:, None] * np.take(back, y, axis=0)
        dh = np.zeros((h.shape[0] * scored, d), h.dtype)
        dh[used] = dhs[:, :d]
        g["o" + m] = flat(c).T @ dh
        dc = np.empty((len(ids), scored, d + 1), h.dtype)
        dc[:, :, :d] = (dh @ p["o" + m].T).reshape(c.shape)
        dc[:, :, :d] /= total
        dc[:, :, d] = -np.einsum("ijk,ijk->ij", dc[:, :, :d], c)
        ds = np.matmul(dc, v.transpose(0, 2, 1))
        ds *= s
        # Gradients of queries, keys and values side by side, as they were made.
        dqkv = np.zeros((len(ids), n, 3 * d), h.dtype)
        dqkv[:, n - scored :, :d] = np.matmul(ds, k)
        dqkv[:, :, d : 2 * d] = np.matmul(ds.transpose(0, 2, 1), q)
        dqkv[:, :, 2 * d :] = np.matmul(s.transpose(0, 2, 1), dc[:, :, :d])
        dqkv[:, n - scored :, :d] *= np.float32(d**-0.5)
        g["q" + m], g["k" + m], g["v" + m] = np.split(flat(x).T @ flat(dqkv), 3, axis=1)
        dx = (flat(dqkv) @ np.concatenate([p["q" + m], p["k" + m], p["v" + m]], axis=1).T).reshape(x.shape)
        dx[:, n - scored :] += dh.reshape(h.shape)
        # Rows of one input are summed next to each other; ids of 16 bits are sorted by radix.
        short = ids.ravel().astype(np.int16)
        order = np.argsort(short, kind="stable")
        sorted_ids = short[order]
        heads = np.flatnonzero(np.r_[True, sorted_ids[1:] != sorted_ids[:-1]])
        g["e" + m] = np.zeros_like(p["e" + m])
        g["e" + m][sorted_ids[heads]] = np.add.reduceat(flat(dx)[order], heads, axis=0)
        g["pos" + m] = np.zeros_like(p["pos" + m])
        g["pos" + m][:n] = dx.sum(axis=0)
        return loss, g


@cache
def _seen(scored: int, n: int, dtype: np.dtype) -> np.ndarray:
    """Which of ``n`` places the last ``scored`` of them see."""
    return np.tri(scored, n, n - scored, dtype=dtype)


class Adam:
    """Steps of Adam, with gradients held to a norm of 1, on all parameters of ``p`` (or those of ``names``), which become parts of one array."""

    def __init__(self, p: dict[str, np.ndarray], names: Iterable[str] | None = None):
        self.names = list(p if names is None else names)
        self.flat = np.concatenate([p[k].ravel() for k in self.names])
        at = np.cumsum([0, *[p[k].size for k in self.names]])
        for k, a, b in zip(self.names, at[:-1], at[1:], strict=True):
            p[k] = self.flat[a:b].reshape(p[k].shape)
        self.mom, self.var, self.t = np.zeros_like(self.flat), np.zeros_like(self.flat), 0

    def step(self, g: dict[str, np.ndarray], rate: float) -> None:
        gk = np.concatenate([g[k].ravel() for k in self.names])
        gk *= np.float32(min(1.0, 1.0 / max(math.sqrt(float(gk @ gk)), 1e-9)))
        self.t += 1
        self.mom *= np.float32(0.9)
        self.mom += np.float32(0.1) * gk
        gk *= gk
        self.var *= np.float32(0.99)
        self.var += np.float32(0.01) * gk
        down = np.sqrt(self.var / np.float32(1 - 0.99**self.t))
        down += np.float32(1e-8)
        self.flat -= np.float32(rate / (1 - 0.9**self.t)) * self.mom / down


def windows(lengths: np.ndarray, window: int, context: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in the joined inputs of sequences of these lengths: (windows, window), which are valid, which targets count.

    Each window scores its last ``window - context`` places; the others are context.
    """
    new = window - context
    ends = np.cumsum(lengths)
    begins = ends - lengths
    per = -(-lengths // new)
    owner = np.repeat(np.arange(len(lengths)), per)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    at = (begins[owner] + nth * new)[:, None] + np.arange(-context, new)[None, :]
    valid = (at >= begins[owner][:, None]) & (at < ends[owner][:, None])
    return np.where(valid, at, 0), valid, valid[:, context:]


@dataclass
class Model:
    """The attention model, the classes of ids, and the frequent words with what is known of them."""

    net: Attention
    first_class: np.ndarray
    other_class: np.ndarray
    other_log: np.ndarray
    inner_class: np.ndarray
    inner_log: np.ndarray
    tokenizer: str
    #: Shares of the inner classes, mixed to the model's so that no class is all but ruled out.
    inner_share: np.ndarray = field(default_factory=lambda: np.full(INNER, 1.0))
    #: Of frequent words, in order: joined by line ends, class, log10 of the share of the class, base log10.
    words: bytes = b""
    word_class: np.ndarray | None = None
    word_log: np.ndarray | None = None
    word_base: np.ndarray | None = None
    end_base: float = 0.0
    end_known: bool = True
    #: Occurrences of words that the table doesn't hold.
    n_other: int = 0

    BOS = FIRST + INNER

    def spelled(self, flat: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inputs (first class, inner classes) and targets (inner classes, end of word) of words with ``n`` ids each, joined in ``flat``."""
        begins = np.cumsum(n) - n
        inputs = self.inner_class[flat] + FIRST
        inputs[begins] = self.other_class[flat[begins]]
        target = np.empty(len(flat), dtype=np.int64)
        target[:-1] = self.inner_class[flat[1:]]
        target[begins + n - 1] = INNER - 1
        return inputs, target

    def rest(self, flat: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Natural log of the rest of each word outside the table, given the class of its first id."""
        if not len(n):
            return np.zeros(0)
        inputs, target = self.spelled(flat, n)
        begins = np.cumsum(n) - n
        within = np.zeros(len(flat))
        within[:-1] = self.inner_log[flat[1:]]
        within[begins + n - 1] = 0.0
        lp = score_inner(self.net, inputs, target, n)
        lp = np.log((1 - FLAT) * np.exp(lp) + FLAT * self.inner_share[target])
        return self.other_log[flat[begins]] + np.add.reduceat(lp + within, begins)

    def encode(self, words: list[bytes], subwords: Subwords) -> np.ndarray:
        """``rest`` of these words."""
        return self.rest(*unpacked_ids(packed_ids([subwords(w) for w in words])))


def score_places(net: Attention, inputs: np.ndarray, target: np.ndarray, lengths: np.ndarray, window: int, context: int) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of every target of first ids, each once, over batches of windows; and of any word outside the table."""
    at, valid, counts = windows(lengths, window, context)
    out, outside = np.zeros(len(inputs)), np.zeros(len(inputs))
    kinds = np.repeat(np.eye(2, dtype=net.p["u0"].dtype), (FREQUENT, OTHER), axis=0)
    head, step = net.head(False), max(1, BLOCK // (window - context))
    for i in range(0, len(at), step):
        a, c = at[i : i + step], np.flatnonzero(counts[i : i + step])
        h = _with_one(net.states(inputs[a], valid[i : i + step], window - context, False), c)
        places = a[:, context:].ravel()[c]
        z = net.odds(h, head)
        hit = z[np.arange(len(z)), target[places]]
        np.exp(z, out=z)
        frequent, other = (z @ kinds).T  # a product is faster than sums of short rows
        total = np.log(frequent + other)
        out[places], outside[places] = hit - total, np.log(other) - total
    return out, outside


def _with_one(h: np.ndarray, used: np.ndarray) -> np.ndarray:
    """The ``used`` ones of these states, each with a one for the bias."""
    out = np.ones((len(used), h.shape[-1] + 1), h.dtype)
    out[:, :-1] = h.reshape(-1, h.shape[-1])[used]
    return out


def score_inner(net: Attention, inputs: np.ndarray, target: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Log probability of every target of inner ids, each once; places of the first windows that see the same ids share their logits."""
    at, valid, counts = windows(lengths, INNER_WINDOW, INNER_CONTEXT)
    out, head = np.zeros(len(inputs)), net.head(True)

    def put(h: np.ndarray, places: np.ndarray, which: np.ndarray) -> None:
        """Targets at ``places`` under the states h[which]."""
        z = net.odds(h, head)
        hit = z[which, target[places]]
        np.exp(z, out=z)
        out[places] = hit - np.log(z @ np.ones(z.shape[1], z.dtype))[which]

    first = ~valid[:, 0]  # begins its word
    for j in range(INNER_WINDOW - INNER_CONTEXT):
        rows = np.flatnonzero(first & counts[:, j])
        n = INNER_CONTEXT + j + 1
        key = np.zeros(len(rows), np.int64)
        for i in range(INNER_CONTEXT, n):
            key = key * (FIRST + INNER) + inputs[at[rows, i]]
        order = np.argsort(key, kind="stable")
        new = np.r_[True, key[order[1:]] != key[order[:-1]]] if len(rows) else np.zeros(0, bool)
        group, heads = np.cumsum(new) - 1, np.flatnonzero(new)
        for b in range(0, len(heads), INNER_BLOCK):
            one = rows[order[heads[b : b + INNER_BLOCK]]]
            h = net.states(inputs[at[one, :n]], valid[one, :n], 1, True)
            some = slice(heads[b], heads[b + INNER_BLOCK] if b + INNER_BLOCK < len(heads) else None)
            put(_with_one(h, np.arange(len(one))), at[rows[order[some]], n - 1], group[some] - b)
    later = np.flatnonzero(~first)
    step = INNER_BLOCK // (INNER_WINDOW - INNER_CONTEXT)
    for i in range(0, len(later), step):
        one = later[i : i + step]
        c = np.flatnonzero(counts[one])
        h = _with_one(net.states(inputs[at[one]], valid[one], INNER_WINDOW - INNER_CONTEXT, True), c)
        put(h, at[one][:, INNER_CONTEXT:].ravel()[c], np.arange(len(c)))
    return out


def _classes(counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Class of each id, below ``n``, and natural log of its share in the class; the last class takes all rarer ids."""
    top = np.argsort(-counts, kind="stable")[: n - 1]
    cls = np.full(len(counts), n - 1)
    cls[top] = np.arange(len(top))
    rare = np.where(cls == n - 1, counts + 0.5, 0.0)
    return cls, np.where(cls == n - 1, np.log(np.maximum(rare, 1e-9) / max(1e-9, rare.sum())), 0.0)


def train(batches: Iterable[list[str | None]], m: Model, net: Attention, *, steps: int = 2000, seed: int = 11) -> Attention:
    """``net`` after the first steps, on a bounded number of texts (both kinds of ids in turn); ``m`` has classes and words."""
    net, sub = Attention({k: v.copy() for k, v in net.p.items()}), _ready(m)[1]
    placed, others = [], set()
    for texts in batches:
        _, cls, n, ends, ws, _ = place_words(texts, m)
        placed.append((shifted(cls, ends, n).astype(np.int16), cls.astype(np.int16), n))
        others.update(ws)
    if not placed:
        return net
    inputs, target, lengths = map(np.concatenate, zip(*placed, strict=True))
    r, some = np.random.default_rng(seed), sorted(others)
    some = [some[i] for i in r.permutation(len(some))[:200_000]]
    sets = [(inputs, target, *windows(lengths, WINDOW, CONTEXT), False, 16)]
    if some:
        flat, lengths = unpacked_ids(packed_ids([sub(w) for w in some]))
        sets.append((*m.spelled(flat, lengths), *windows(lengths, INNER_WINDOW, INNER_CONTEXT), True, 384))
    adams = [Adam(net.p, [k for k in net.p if k.endswith("1") == s[-2]]) for s in sets]
    for step in range(steps):
        rate = 6e-3 * min(1.0, (steps - step) / (0.6 * steps))
        for (x, y, at, valid, counts, inner, size), adam in zip(sets, adams, strict=True):
            i = r.integers(0, len(at), size)
            adam.step(net.gradient(x[at[i]], valid[i], y[at[i][:, at.shape[1] - counts.shape[1] :]], counts[i].astype(np.float32), inner)[1], rate)
    return net


def first_steps(rows: DataFrame, model: Broadcast, net: Attention) -> Attention:
    """``net`` after the first steps on ``rows`` (doc_id, text; bounded), which one task takes in the order of doc_id: the
    driver gets the weights alone, and holds neither texts nor what is made of them."""

    def fit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batches = ([t if isinstance(t, str) else None for t in part["text"]] for part in parts)
        yield pd.DataFrame({"p": [_packed(train(batches, model.value, net).p)]})

    got = rows.repartition(1).sortWithinPartitions("doc_id").mapInPandas(fit, "p binary").first()
    return Attention(_unpacked(np.frombuffer(got.p, "<f4"), net.p))


def _packed(p: dict[str, np.ndarray]) -> bytes:
    return np.concatenate([v.ravel() for v in p.values()]).astype("<f4").tobytes()


def _unpacked(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Arrays of the names and shapes of ``like`` from their joined numbers."""
    cuts = np.split(flat.astype(np.float32), np.cumsum([v.size for v in like.values()])[:-1])
    return {k: c.reshape(v.shape) for (k, v), c in zip(like.items(), cuts, strict=True)}


def _first_class(m: Model, sub: Subwords, words: list[bytes]) -> np.ndarray:
    """Class of the first id of each of these words outside the table."""
    if len(_CLASSES) > 500_000:
        _CLASSES.clear()
    out = []
    for w in words:
        c = _CLASSES.get(w)
        if c is None:
            c = _CLASSES[w] = int(m.other_class[sub(w)[0]])
        out.append(c)
    return np.array(out, dtype=np.int64)


def place_words(texts: list[str | None] | pa.Array, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """``placed``, with the other words as a list."""
    index, cls, n, ends, ws, other = placed(texts, m)
    return index, cls, n, ends, ws.to_pylist(), other


def placed(texts: list[str | None] | pa.Array, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """For words and ends of texts, joined: number in the table (-1: not in it, -2: an end), class; lengths, places of ends, other words and their places."""
    table, sub = _ready(m)
    words, n = joined_words(texts)
    n += 1
    ends = np.cumsum(n) - 1
    if 8 * len(words) < len(table):  # Arrow hashes all of the table on each call
        found = np.fromiter((table.get(w, -1) for w in words.to_pylist()), dtype=np.int64, count=len(words))
    else:
        found = pc.fill_null(pc.index_in(words, value_set=_READY[id(m)][3]), -1).to_numpy().astype(np.int64)
    index = np.full(int(n.sum()), -2, dtype=np.int64)
    is_word = np.ones(len(index), bool)
    is_word[ends] = False
    index[is_word] = found
    cls = np.full(len(index), FREQUENT - 1, dtype=np.int64)
    known = index >= 0
    if m.word_class is not None and len(m.word_class):
        cls[known] = m.word_class[index[known]]
    other = np.flatnonzero(index == -1)
    ws = words.filter(pa.array(found == -1))
    if len(ws):
        each = ws.dictionary_encode()
        cls[other] = _first_class(m, sub, each.dictionary.to_pylist())[each.indices.to_numpy()]
    return index, cls, n, ends, ws, other


def first_places(texts: list[str | None] | pa.Array, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, targets and lengths of the first classes of texts, each with its end."""
    _, target, lengths, ends, _, _ = placed(texts, m)
    return shifted(target, ends, lengths), target, lengths


def shifted(cls: np.ndarray, ends: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Classes one place later, each text begun by the mark of a beginning."""
    inputs = np.empty_like(cls)
    inputs[1:] = cls[:-1]
    inputs[ends - lengths + 1] = Model.BOS
    return inputs


def train_on(rows: DataFrame, model: Broadcast, net: Attention, rate: float, passes: int, *, inner: bool) -> Attention:
    """``net`` after steps on all ``rows`` (one column: texts, or for inner ids the packed ids of words).

    Every task goes over its rows from the same start; the results are averaged by windows.
    """
    start = {k: v for k, v in net.p.items() if (k.endswith("1")) == inner}

    def fit(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, here = model.value, Attention({k: v.copy() for k, v in start.items()})
        adam, r, seen, step = Adam(here.p), np.random.default_rng(13), 0, 0
        size = 384 if inner else 64
        for part in gathered(parts, 4096) if inner else gathered(parts):
            if inner:
                flat, lengths = unpacked_ids(part.column(0))
                x, y = m.spelled(flat, lengths)
                at, valid, counts = windows(lengths, INNER_WINDOW, INNER_CONTEXT)
            else:
                x, y, lengths = first_places(part.column(0), m)
                at, valid, counts = windows(lengths, WINDOW, CONTEXT)
            seen += len(at)
            for _ in range(passes):
                order = r.permutation(len(at))
                for i in range(0, len(order), size):
                    j = order[i : i + size]
                    step += 1
                    g = here.gradient(x[at[j]], valid[j], y[at[j][:, at.shape[1] - counts.shape[1] :]], counts[j].astype(np.float32), inner)[1]
                    adam.step(g, rate * min(1.0, step / 20))
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([_task() % PARTS], pa.int32()), pa.array([seen], pa.int64()), pa.array([_packed({k: here.p[k] for k in start})])], ["k", "n", "p"])

    def add(part: pd.DataFrame) -> pd.DataFrame:
        n = int(part["n"].sum())
        total = sum(np.frombuffer(p, "<f4").astype(float) * w for p, w in zip(part["p"], part["n"], strict=True))
        return pd.DataFrame({"n": [n], "p": [(total / n).astype("<f8").tobytes()]})

    # Sums in two levels: the driver gets PARTS sets of weights at most, however many tasks there are.
    got = rows.mapInArrow(fit, "k int, n long, p binary").groupBy("k").applyInPandas(add, "n long, p binary").collect()
    if not got:
        return net
    total = sum(r.n for r in got)
    mean = sum(np.frombuffer(r.p, "<f8") * (r.n / total) for r in got)
    return Attention({**net.p, **_unpacked(mean, start)})


def _task() -> int:
    return TaskContext.get().partitionId()


def id_counts(vocabulary: DataFrame, least: int | None, tokenizer: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Over all words of the corpus: occurrences of first ids of frequent words (``least`` times or more) and of other
    words, in how many other words each inner id is found (with repeats), and the number of other words."""
    n_ids = Subwords(tokenizer).n_ids

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((3, n_ids), dtype=np.int64)
        for part in gathered(parts, 16384):
            c, (flat, lengths) = part.column(0).to_numpy(), unpacked_ids(part.column(1))
            other = np.ones(len(c), bool) if least is None else c < least
            begins = np.cumsum(lengths) - lengths
            for i in (0, 1):
                n[i] += np.bincount(flat[begins[other == i]], weights=c[other == i], minlength=n_ids).astype(np.int64)
            inner = np.repeat(other, lengths)
            inner[begins] = False
            n[2] += np.bincount(flat[inner], minlength=n_ids)
        k, i = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(i.astype(np.int32)), pa.array(n[k, i])], ["kind", "id", "n"])

    out = np.zeros((3, n_ids))
    for r in vocabulary.select("c", "ids").mapInArrow(count, "kind int, id int, n long").groupBy("kind", "id").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.kind, r.id] = r.n
    others = vocabulary.filter(F.col("c") < least).count() if least else vocabulary.count()
    return out[0], out[1], out[2], others


def new_model(first: np.ndarray, other: np.ndarray, inner: np.ndarray, n_other_words: int, tokenizer: str, seed: int = 11) -> Model:
    """An untrained model whose classes and shares come from the counts of the whole corpus."""
    fc, _ = _classes(first, FREQUENT - 1)
    oc, ol = _classes(other, OTHER)
    ic, il = _classes(inner, INNER - 1)
    m = Model(Attention.new(seed), fc, oc + FREQUENT, ol, ic, il, tokenizer)
    m.inner_share += np.bincount(ic, weights=inner, minlength=INNER)
    m.inner_share[INNER - 1] += n_other_words
    m.inner_share /= m.inner_share.sum()
    return m


def add_counts(m: Model, frequent: list[tuple[str, int]], total: int, distinct: int, n_texts: int) -> Model:
    """Give the model the frequent words of the corpus, with their counts, and the totals of the corpus."""
    ws = [w.encode("utf-8", "surrogatepass") for w, _ in frequent]
    c = np.array([n for _, n in frequent], dtype=float)
    denominator = math.log10(total + distinct + 1)
    m.end_base, m.end_known = math.log10(n_texts + 1) - denominator, n_texts > 0
    m.n_other = max(0, total - n_texts - int(c.sum()))
    m.words = b"\n".join(ws)
    sub = Subwords(m.tokenizer)
    cls = np.array([m.first_class[sub(w)[0]] for w in ws], dtype=np.int64)
    m.word_class = cls.astype(np.int16)
    m.word_log = np.log10(c / np.maximum(np.bincount(cls, weights=c, minlength=FIRST)[cls], 1)) if len(ws) else c
    m.word_base = np.log10(c + 1) - denominator
    return m


_READY: dict[int, tuple] = {}
#: Classes of first ids of words outside the table, kept in a process while their number is small.
_CLASSES: dict[bytes, int] = {}


def _ready(m: Model) -> tuple[dict[bytes, int], Subwords]:
    """The frequent words as a dictionary and the tokenizer, made once in a process."""
    key = id(m)
    if key not in _READY:
        _READY.clear()
        _CLASSES.clear()
        ws = m.words.split(b"\n") if m.words else []
        _READY[key] = ({w: i for i, w in enumerate(ws)}, _subwords(m.tokenizer), m, pa.array(ws, pa.large_binary()))
    return _READY[key][:2]


def score_batch(texts: pa.Array, m: Model) -> list[pa.Array]:
    """Per text: n_tokens; n_known, base_score and score of what the table of frequent words covers; the other words,
    and for each the log10 of its class and of any word outside the table."""
    index, cls, n, ends, ws, other = placed(texts, m)
    begins = ends - n + 1
    rest, base = np.zeros(len(index)), np.zeros(len(index))
    known = index >= 0
    if m.word_log is not None and len(m.word_log):
        i = index[known]
        rest[known], base[known] = m.word_log[i], m.word_base[i]
    base[ends], known[ends] = m.end_base, m.end_known
    lp, outside = score_places(m.net, shifted(cls, ends, n), cls, n, WINDOW, CONTEXT)
    first, any_other = lp[other] / math.log(10), outside[other] / math.log(10)
    lp = np.log10((1 - BASE) * 10.0 ** (lp / math.log(10) + rest) + BASE * 10.0**base)
    lp[other] = 0.0  # these are added where the counts of all words are
    total, based, knew = np.add.reduceat(lp, begins), np.add.reduceat(base, begins), np.add.reduceat(known.astype(np.int64), begins)
    cuts = pa.array(np.searchsorted(other, np.r_[begins, len(index)]).astype(np.int32))
    lists = [pa.ListArray.from_arrays(cuts, v) for v in (_strings(ws), pa.array(first), pa.array(any_other))]
    return [pa.array(n), pa.array(knew), pa.array(based), pa.array(total), *lists]


def _strings(words: pa.Array) -> pa.Array:
    return words.view(pa.large_string()).cast(pa.string())


def word_counts(docs: DataFrame) -> DataFrame:
    """word, c (occurrences in the rows to learn from) for every word of ``docs``; words are counted in each task and then summed."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned: list[pa.Array] = []
        others: list[pa.Array] = []

        def out() -> Iterator[pa.RecordBatch]:
            c = pc.value_counts(pa.chunked_array(learned, pa.large_binary()))
            held = pc.unique(pa.chunked_array(others, pa.large_binary()))
            words = pa.concat_arrays([c.field(0), held])
            counts = np.r_[c.field(1).to_numpy(), np.zeros(len(held), np.int64)]
            learned.clear()
            others.clear()
            for i in range(0, len(words), 1 << 16):
                yield pa.RecordBatch.from_arrays([_strings(words[i : i + (1 << 16)]), pa.array(counts[i : i + (1 << 16)])], ["word", "c"])

        n = size = 0
        for part in parts:
            learn = part.column("learn")
            for found, which in ((learned, learn), (others, pc.invert(learn))):
                found.append(joined_words(part.column("text").filter(which))[0])
                n, size = n + len(found[-1]), size + found[-1].nbytes
            if n > 4_000_000 or size > 128 << 20:
                yield from out()
                n = size = 0
        if n:
            yield from out()

    rows = docs.select("text", (fold(F.col("doc_id"), FOLDS) != HELD_OUT).alias("learn"))
    return rows.mapInArrow(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def with_ids(counted: DataFrame, tokenizer: str) -> DataFrame:
    """``word_counts`` with the subword ids of each word, packed; so each word is parted once."""

    def part_words(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sub = _subwords(tokenizer)
        for part in parts:
            words = part.column(0).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([*part.columns, packed_ids([sub(w) for w in words])], ["word", "c", "ids"])

    return counted.select("word", "c").mapInArrow(part_words, "word string, c long, ids binary")


def least_count(vocabulary: DataFrame, most: int) -> int | None:
    """The least count for which the words that reach it are ``most`` at most; None if there is none."""
    per = vocabulary.groupBy("c").agg(F.count(F.lit(1)).alias("k"))
    # One row per distinct count, of which a corpus has few.
    upto = per.select("c", F.sum("k").over(Window.orderBy(F.desc("c"))).alias("upto"))
    return upto.filter(F.col("upto") <= most).agg(F.min("c")).first()[0]


def frequent_words(vocabulary: DataFrame, least: int | None) -> list[tuple[str, int]]:
    """Words found ``least`` times or more, which are a bounded number, and how often; in order."""
    return sorted((r.word, r.c) for r in vocabulary.filter(F.col("c") >= least).toLocalIterator()) if least else []


def first_texts(learned: DataFrame, most: int, size: int = FIRST_BYTES) -> DataFrame | None:
    """doc_id, text for the first steps, chosen by hash of the id: at most ``most`` and, but for the first, at most ``size`` bytes in all; None if there are none."""
    one = learned.filter("doc_id IS NOT NULL").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sizes = least_by_hash(one.select("doc_id", F.octet_length("text").alias("n")), most, F.lit(7)).collect()
    chosen, total = set(), 0
    for r in sizes:
        total += r.n
        if chosen and total > size:
            break
        chosen.add(r.doc_id)
    if not chosen:
        return None
    ids = learned.sparkSession.createDataFrame([(i,) for i in sorted(chosen)], "doc_id long")
    return one.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))  # of repeated ids the least text


def fit_model(docs: DataFrame, *, tokenizer: str = DEFAULT_TOKENIZER, max_frequent: int = MAX_FREQUENT, max_training: int = MAX_TRAINING) -> tuple[Model, Broadcast, DataFrame, int, int, int | None]:
    """The model of the rows that aren't held out, its broadcast tables, the vocabulary, the numbers of tokens and of distinct ones, and the least count of the table's words."""
    spark = docs.sparkSession
    bounded_batches(spark)
    learned = docs.filter(fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    everything = materialize(with_ids(word_counts(docs), tokenizer), "vocabulary")
    vocabulary = everything.filter("c > 0")
    n_texts = learned.count()
    sums = vocabulary.agg(F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    total, distinct = int(sums.n) + n_texts, int(sums.v) + (n_texts > 0)
    # The rarest tenth of the words stays outside the table at any size, so that spellings are learned from it.
    least = least_count(vocabulary, min(max_frequent, int(sums.v) * (SPELLED - 1) // SPELLED))
    fitted = add_counts(new_model(*id_counts(vocabulary, least, tokenizer), tokenizer), frequent_words(vocabulary, least), total, distinct, n_texts)
    model = spark.sparkContext.broadcast(fitted)
    first = first_texts(learned, max_training)
    if first is not None:
        fitted.net = first_steps(first, model, fitted.net)
    # All training rows and all other words, each in one of the passes.
    others = vocabulary.filter(F.col("c") < least) if least else vocabulary
    passes = 1 if n_texts <= max_training else max(1, -(-LEAST_WINDOWS * (WINDOW - CONTEXT) // max(1, total)))
    for i, rate in enumerate(RATES if n_texts else ()):
        turn = lambda c: F.pmod(F.xxhash64(c, F.lit(5)), F.lit(len(RATES))) == i  # noqa: B023, E731
        fitted.net = train_on(learned.filter(turn("doc_id")).select("text"), model, fitted.net, rate, passes, inner=False)
        fitted.net = train_on(others.filter(turn("word")).select("ids"), model, fitted.net, rate, 1, inner=True)
    return fitted, model, everything, total, distinct, least


def score_texts(docs: DataFrame, *, tokenizer: str = DEFAULT_TOKENIZER, max_frequent: int = MAX_FREQUENT, max_training: int = MAX_TRAINING) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    Learns from all rows whose crc32(doc_id as text) mod 7 is not 2: counts, and the
    attention model, whose first steps are on at most ``max_training`` of them.  Null and
    empty texts are an end alone.  Without rows to learn from, train_tokens is 0 and only the
    untrained model scores; an empty table gives an empty one.  Very long texts are scored
    whole, window by window.  Repeated rows repeat, and count as often; equal texts get equal
    scores.  Further columns are ignored, whatever their names.
    """
    docs = docs.select("doc_id", "text")
    fitted, model, vocabulary, total, distinct, least = fit_model(docs, tokenizer=tokenizer, max_frequent=max_frequent, max_training=max_training)
    net = fitted.net

    def score(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        m.net = net
        for part in gathered(parts):
            ids = [part.column(k) for k in ("_row", "doc_id", "named")]
            yield pa.RecordBatch.from_arrays([*ids, *score_batch(part.column("text"), m)], ["_row", "doc_id", "named", "n_tokens", "n_known", "base_score", "score", "word", "first", "any"])

    def spell(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        m.net = net
        for part in gathered(parts, 16384):
            rest = m.rest(*unpacked_ids(part.column("ids"))) / math.log(10)
            yield pa.RecordBatch.from_arrays([part.column("word"), part.column("c"), pa.array(rest)], ["word", "c", "rest"])

    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNotNull().alias("named"), "text")
    schema = "_row long, doc_id long, named boolean, n_tokens long, n_known long, base_score double, score double, word array<string>, first array<double>, any array<double>"
    scored = materialize(rows.mapInArrow(score, schema), "scored")
    # What the table doesn't cover meets its count and its spelling here, both made once per distinct word.
    others = vocabulary.filter(F.col("c") < least) if least else vocabulary
    spelled = others.mapInArrow(spell, "word string, c long, rest double")
    other = scored.select("_row", F.explode(F.arrays_zip("word", "first", "any")).alias("r")).select("_row", "r.word", "r.first", "r.any")
    ten = lambda x: F.pow(F.lit(10.0), x)
    c = F.col("c")
    mixed = F.log10(F.lit((1 - BASE) * (1 - COUNTED)) * ten(F.col("first") + F.col("rest")) + F.lit((1 - BASE) * COUNTED / max(1, fitted.n_other)) * c * ten(F.col("any")) + F.lit(BASE / (total + distinct + 1.0)) * (c + 1.0))
    more = other.join(spelled, "word").groupBy("_row").agg(
        F.sum(F.log10(c + 1.0) + F.lit(-math.log10(total + distinct + 1))).alias("_base"),
        F.count_if(c > 0).alias("_known"),
        F.sum(mixed).alias("_score"),
    )
    ids = scored.withColumn("doc_id", F.when(F.col("named"), F.col("doc_id"))).drop("word", "first", "any", "named")
    return ids.join(more, "_row", "left").select(
        "doc_id",
        (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("_score", F.lit(0.0))).alias("score"),
    )
