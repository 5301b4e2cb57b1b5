"""Word and shingle hashes of many texts at once, in numpy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_RNG = np.random.default_rng(20260101)
_TABLE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULTIPLIERS = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_SPACES = np.zeros(256, dtype=bool)
_SPACES[[32, 9, 10, 11, 12, 13]] = True


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse modulo 2**64."""
    both = []
    for b in (_BASE, pow(_BASE, -1, 2**64)):
        x = np.full(n, b, dtype=np.uint64)
        x[0] = 1
        both.append(np.multiply.accumulate(x))
    return both[0], both[1]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finish)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lower-cased, parted by ASCII white space) and, per text, where its words begin."""
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    buf = np.frombuffer(b" " + b" ".join(raw) + b" ", dtype=np.uint8)
    begins = np.cumsum([1] + [len(r) + 1 for r in raw])
    space = _SPACES[buf]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    up, down = _powers(1 << max(16, int(len(buf)).bit_length()))
    sums = np.empty(len(buf) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(_TABLE[buf] * up[: len(buf)], out=sums[1:])
    h = mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return h, np.searchsorted(starts, begins)


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Per text its sorted distinct shingle hashes; fewer words than ``width`` make one shingle, none make none."""
    h, at = word_hashes(texts)
    m = _MULTIPLIERS
    if len(h) >= width:
        s = np.zeros(len(h) - width + 1, dtype=np.uint64)
        for j in range(width):
            s += h[j : len(h) - width + 1 + j] * m[j]
        s = mix64(s)
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        n = b - a
        if n >= width:
            out.append(np.unique(s[a : b - width + 1]))
        elif n:
            out.append(mix64(np.add.reduce(h[a:b] * m[8 : 8 + n], keepdims=True) + m[16 + n : 17 + n]))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def in_chunks(texts: list[str | None], most: int = 1 << 21):
    """(begin, end) of runs of texts of about ``most`` characters; a longer text stands alone."""
    a, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if size and size + n > most:
            yield a, i
            a, size = i, 0
        size += n
    if a < len(texts):
        yield a, len(texts)
