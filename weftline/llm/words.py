"""Words of the visible text as arrays: hashes, places and shingles, without per-word Python calls."""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from weftline.llm import visible

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=1)
def word_chars() -> np.ndarray:
    """Which code points are letters or decimal digits."""
    out = np.zeros(0x110000, bool)
    for cp in range(0x33480):
        cat = unicodedata.category(chr(cp))
        out[cp] = cat[0] == "L" or cat == "Nd"
    return out


@lru_cache(maxsize=1)
def _scrambled() -> np.ndarray:
    return mix(np.arange(1, 0x110001, dtype=np.uint64))


class Words(NamedTuple):
    """Row ``i`` has the words ``off[i]:off[i + 1]``; ``begin``/``end`` are code-point places in ``points``."""

    hash: np.ndarray
    off: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    points: visible.Points


def span_hash(cp: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of code points, by prefix sums of a polynomial with an invertible base."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    power = np.ones(len(cp), np.uint64)
    power[1:] = _ODD
    np.multiply.accumulate(power, out=power)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_scrambled()[cp] * power, dtype=np.uint64)])
    # base ** -begin for every begin: an inverse power table of the same length
    inverse = np.ones(len(cp), np.uint64)
    inverse[1:] = _INV
    np.multiply.accumulate(inverse, out=inverse)
    return mix((total[end] - total[begin]) * inverse[begin] + (end - begin).astype(np.uint64))


def words_of(arr: pa.Array, source: bool = False) -> Words:
    """Words (maximal runs of letters or digits) of the lower-cased consistent form of each text."""
    p = visible.normalise_points(visible.to_points(arr), source=source, lower=True)
    return words_in(p)


def words_in(p: visible.Points) -> Words:
    """Words of rows of code points that are in their consistent form already."""
    inside = word_chars()[p.cp]
    edge = np.zeros(len(p.cp) + 1, bool)
    edge[p.off] = True  # words never cross a row
    begin = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])))
    end = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    return Words(span_hash(p.cp, begin, end), np.searchsorted(begin, p.off), begin, end, p)


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of runs of ``n`` successive words, sorted inside each row, and the rows' offsets."""
    rows = len(w.off) - 1
    count = np.maximum(np.diff(w.off) - n + 1, 0)
    row = np.repeat(np.arange(rows), count)
    first = np.repeat(w.off[:-1] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    h = np.zeros(len(first), np.uint64)
    for k in range(n):
        h = mix(h * _ODD + w.hash[first + k]) if k else w.hash[first]
    by = np.lexsort((h, row))
    h, row = h[by], row[by]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(rows + 1))
