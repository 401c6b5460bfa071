"""Words and word n-grams of many texts at once, as numpy arrays over their UTF-8 bytes.

A word is a run of bytes other than U+0020 and U+0009 to U+000D, lower-cased first. Its 64-bit value is a polynomial in its
bytes, taken as a difference of running sums, so that all words of a batch come out of a few array operations.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[0x20, *range(0x09, 0x0E)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _spans(starts: np.ndarray, ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of words that span at most so many bytes, or of one word."""
    k = 0
    while k < len(starts):
        to = max(k + 1, int(np.searchsorted(ends, starts[k] + most, side="right")))
        yield k, to
        k = to


def word_hashes(texts: list[str], most: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text and at the end their number). Sums run over `most` bytes at a time."""
    data = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    joined = np.frombuffer(b" ".join(data) + b" ", dtype=np.uint8)
    ends_of_text = np.cumsum(np.fromiter((len(d) + 1 for d in data), dtype=np.int64, count=len(data)))
    gap = _BREAK[joined]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if not gap[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    value = np.zeros(len(starts), dtype=np.uint64)
    for a, b in _spans(starts, ends, most):
        lo, hi = starts[a], ends[b - 1]
        n = 1 << max(19, int(hi - lo).bit_length())
        sums = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum((joined[lo:hi].astype(np.uint64) + np.uint64(1)) * _powers(int(_P), n)[: hi - lo], dtype=np.uint64, out=sums[1:])
        value[a:b] = (sums[ends[a:b] - lo] - sums[starts[a:b] - lo]) * _powers(int(_P_INV), n)[starts[a:b] - lo]
    bounds = np.concatenate([[0], np.searchsorted(starts, ends_of_text, side="left")])
    return mixed(value ^ (ends - starts).astype(np.uint64)), bounds.astype(np.int64)


def ngram_hashes(words: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of n words within a text, bounds as above). A text of fewer words, but not none, has one run: all of it."""
    counts = np.diff(bounds)
    short = (counts > 0) & (counts < n)
    out_counts = np.where(short, 1, np.maximum(counts - n + 1, 0))
    out_bounds = np.concatenate([[0], np.cumsum(out_counts)]).astype(np.int64)
    if not out_bounds[-1]:
        return np.zeros(0, dtype=np.uint64), out_bounds
    text = np.repeat(np.arange(len(counts)), out_counts)
    first = bounds[:-1][text] + (np.arange(out_bounds[-1]) - out_bounds[:-1][text])
    last = bounds[1:][text]
    acc = np.zeros(len(first), dtype=np.uint64)
    for k in range(n):
        at = first + k
        inside = at < last
        acc = mixed(acc * np.uint64(3) + np.uint64(k)) ^ np.where(inside, words[np.where(inside, at, 0)], np.uint64(0))
    return mixed(acc), out_bounds


def distinct_sets(grams: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct n-grams, sorted within the text, and their bounds."""
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((grams, text))
    g, t = grams[order], text[order]
    new = np.ones(len(g), dtype=bool)
    new[1:] = (g[1:] != g[:-1]) | (t[1:] != t[:-1])
    g, t = g[new], t[new]
    return g, np.searchsorted(t, np.arange(len(bounds)), side="left").astype(np.int64)
