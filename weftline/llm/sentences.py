"""Sentences of the visible text as arrays.

A sentence ends after ``.``, ``!``, ``?`` or an ideographic stop that is followed by a space or the end.  Links,
handles, hashtags and character entities are blanked first: they belong to no language and no subject.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

from weftline.llm import visible, words

_STOPS = np.array([ord(c) for c in ".!?…。！？"], np.int32)


class Sentences(NamedTuple):
    """Sentence ``k`` is ``cp[begin[k]:end[k]]``; row ``i`` has the sentences ``off[i]:off[i + 1]``."""

    cp: np.ndarray  # lower-cased consistent text, blanked tokens as spaces
    begin: np.ndarray
    end: np.ndarray
    off: np.ndarray
    row_off: np.ndarray  # code-point offsets of the rows
    word_hash: np.ndarray
    word_off: np.ndarray  # words of sentence k
    row_words: np.ndarray  # words of each row, blanked tokens included


def _blank_tokens(p: visible.Points) -> np.ndarray:
    """Code points with links, handles, hashtags and entities replaced by spaces."""
    cp = p.cp
    if not len(cp):
        return cp
    edge = np.zeros(len(cp), bool)
    edge[p.off[:-1][p.off[:-1] < p.off[1:]]] = True
    sp = cp == 32
    begin = np.flatnonzero(~sp & (edge | np.concatenate([[True], sp[:-1]])))
    token = np.cumsum(np.isin(np.arange(len(cp)), begin, assume_unique=True)) - 1
    n = len(begin)
    first = cp[begin]
    nxt = cp[np.minimum(begin + 1, len(cp) - 1)]
    bad = ((first == ord("@")) | (first == ord("#"))) & (nxt != 32)
    at = np.flatnonzero((cp[:-2] == ord(":")) & (cp[1:-1] == ord("/")) & (cp[2:] == ord("/"))) if len(cp) > 2 else np.zeros(0, int)
    bad |= np.bincount(token[at], minlength=n)[:n] > 0
    dot = np.minimum(begin + 3, len(cp) - 1)
    bad |= (first == ord("w")) & (nxt == ord("w")) & (cp[dot] == ord("."))
    ends = np.concatenate([begin[1:], [len(cp)]])
    amp = np.flatnonzero(first == ord("&"))
    bad[amp] |= np.array([59 in cp[begin[k] : min(ends[k], begin[k] + 10)] for k in amp], bool) if len(amp) else False
    return np.where(bad[token] & ~sp, 32, cp)


def sentences_of(arr: pa.Array) -> Sentences:
    """Sentences of every text of an Arrow array; those without any word are left out."""
    p = visible.normalise_points(visible.to_points(arr), lower=True)
    row_words = np.diff(words.words_in(p).off)
    cp = _blank_tokens(p)
    p = p._replace(cp=cp)
    n = len(cp)
    last = np.zeros(n, bool)
    last[p.off[1:][p.off[:-1] < p.off[1:]] - 1] = True
    stop = np.isin(cp, _STOPS)
    brk = last | (stop & np.concatenate([cp[1:] == 32, [True]]))
    end = np.flatnonzero(brk) + 1
    begin = np.concatenate([[0], end[:-1]]).astype(end.dtype) if len(end) else end
    w = words.words_in(p)
    at = np.searchsorted(w.begin, np.concatenate([begin, end[-1:]])) if len(end) else np.zeros(1, int)
    keep = np.flatnonzero(np.diff(at) > 0) if len(end) else np.zeros(0, int)
    begin, end = begin[keep], end[keep]
    word_off = np.concatenate([at[keep], at[keep[-1:] + 1]]) if len(keep) else np.zeros(1, int)
    return Sentences(cp, begin, end, np.searchsorted(begin, p.off), p.off, w.hash, word_off, row_words)
