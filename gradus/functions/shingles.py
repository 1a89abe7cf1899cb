"""Sets of five-word shingles as 64-bit numbers, counted for many texts at a time."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORDS = 5
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LETTER = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8))
#: Texts whose shingles are made at a time.
TEXTS = 256


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _distinct(x: np.ndarray) -> np.ndarray:
    return x[np.concatenate(([True], x[1:] != x[:-1]))[: len(x)]]


def _some(texts: pa.Array) -> list[np.ndarray]:
    low = pc.utf8_lower(texts).to_pylist()
    data = [t.encode() + b" " for t in low]
    c = np.frombuffer(b" " + b"".join(data), np.uint8)
    word = _LETTER[c]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    begin, end = edge[::2], edge[1::2]  # blanks stand first and last
    # a word is a polynomial of its letters, wherever it stands
    powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(c) - 1, _BASE))))
    back = np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(c) - 1, _INVERSE))))
    total = np.concatenate(([np.uint64(0)], np.cumsum((c.astype(np.uint64) + np.uint64(1)) * powers)))
    w = _mixed((total[end] - total[begin]) * back[begin] + (end - begin).astype(np.uint64))
    g = np.zeros(max(len(w) - WORDS + 1, 0), dtype=np.uint64)
    for k in range(WORDS):
        g = g * _BASE + w[k : k + len(g)]
    g = _mixed(g).view(np.int64)
    last = np.searchsorted(begin, np.cumsum([len(d) for d in data]) + 1)
    first = np.concatenate(([0], last[:-1]))
    return [_distinct(np.sort(g[i : max(j - WORDS + 1, i)])) for i, j in zip(first, last, strict=True)]


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The set of each text, sorted, of runs of five words of lower-case letters and digits; none of a text with fewer words."""
    return [s for i in range(0, len(texts), TEXTS) for s in _some(texts.slice(i, TEXTS))]


def set_key(s: np.ndarray) -> str:
    return hashlib.md5(s.tobytes()).hexdigest()


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)
