"""Evaluation texts leaking into training text, found by one Aho-Corasick automaton (problem 8).

Item texts and documents are brought to their consistent form and cut into words.  The automaton's alphabet is the
items' vocabulary.  Its patterns are the anchors of each item: the blocks of ``(run + 1) // 2`` successive words that
begin at the multiples of that number.  Every passage of ``run`` words, wherever it begins and ends in its item, holds
a whole anchor, so none is missed, and the automaton has about one state for every word of the items.  An anchor found
in a document is extended in both directions as far as item and document agree; passages of ``run`` words or more
count.  A document is scanned once, whatever the number of items; places are mapped back to the original text.

Items are a stated set of held-out texts, not the corpus: they are read to the driver, once their number of characters
is known to be at most ``most_chars``, and broadcast.  More is an error.  Defined results: null texts hold nothing,
items under ``run`` words are in no document, equal items are all reported, a passage that occurs several times gives
one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import visible, words
from weftline.session import spread

_SCHEMA = "doc_id long, item_id long, n_words int, begin_char int, end_char int"
_CACHE: dict[int, tuple] = {}


def _automaton(key: int, texts: list[str], run: int) -> tuple:
    """(automaton, sorted vocabulary hashes, symbols of each item), kept per worker process."""
    if key not in _CACHE:
        w = words.words_of(pa.array(texts, pa.string()))
        vocab = np.unique(w.hash)
        ids = (np.searchsorted(vocab, w.hash) + 1).tolist()
        size = (run + 1) // 2
        items = [ids[a:b] for a, b in zip(w.off[:-1].tolist(), w.off[1:].tolist(), strict=True)]
        anchors: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for i, s in enumerate(items):
            if len(s) >= run:
                for j in range(0, len(s) - size + 1, size):
                    anchors.setdefault(tuple(s[j : j + size]), []).append((i, j))
        a = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for pattern, places in anchors.items():
            a.add_word(pattern, places)
        a.make_automaton()
        _CACHE.clear()
        _CACHE[key] = a, vocab, items, len(anchors)
    return _CACHE[key]


def _passages(a: ahocorasick.Automaton, items: list[list[int]], sym: list[int], run: int) -> dict[int, list[tuple[int, int]]]:
    """(first word, word after the last) of every maximal passage of at least ``run`` words, by item."""
    size, out = (run + 1) // 2, {}
    reached: dict[tuple[int, int], int] = {}  # by item and alignment: how far the document has been compared
    for end, places in a.iter(tuple(sym)):
        for it, j in places:
            lo = end - size + 1
            line = it, lo - j
            if reached.get(line, 0) > lo:
                continue
            s, hi, k = items[it], end + 1, j + size
            while hi < len(sym) and k < len(s) and sym[hi] == s[k]:
                hi, k = hi + 1, k + 1
            k = j
            while lo > 0 and k > 0 and sym[lo - 1] == s[k - 1]:
                lo, k = lo - 1, k - 1
            reached[line] = hi
            if hi - lo >= run:
                out.setdefault(it, []).append((lo, hi))
    return out


def leaked_items(docs: DataFrame, items: DataFrame, run: int = 13, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", most_chars: int = 20_000_000) -> DataFrame:
    """(doc_id, item_id, n_words, begin_char, end_char): documents that hold ``run`` or more successive words of an item.

    ``n_words`` is the longest passage; the character places in the original text reach from the first to the last
    passage.
    """
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(doc_text).alias("text")).where("doc_id is not null and text is not null")
    it = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("item_id is not null and text is not null")
    chars = it.agg(F.sum(F.length("text"))).first()[0] or 0
    if chars > most_chars:
        raise ValueError(f"items of {chars} characters; at most {most_chars} are held by one automaton")
    got = sorted((r.item_id, r.text) for r in it.collect())
    ids, texts = [i for i, _ in got], [t for _, t in got]
    shared = docs.sparkSession.sparkContext.broadcast((hash((tuple(ids), tuple(texts), run)), ids, texts))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, item_ids, item_texts = shared.value
        a, vocab, symbols, n = _automaton(key, item_texts, run)
        for batch in batches:
            out: list[tuple[int, int, int, int, int]] = []
            for at in range(0, batch.num_rows if n else 0, 4000):
                b = batch.slice(at, 4000)
                w = words.words_of(b.column(1), source=True)
                pos = np.minimum(np.searchsorted(vocab, w.hash), len(vocab) - 1)
                sym = np.where(vocab[pos] == w.hash, pos + 1, 0)
                # a document matters only if some run of known words is long enough
                known = np.concatenate([[0], np.cumsum(sym == 0)])
                doc_ids = b.column(0).to_pylist()
                src_begin = visible.to_points(b.column(1)).off
                for i in np.flatnonzero(np.diff(w.off) >= run):
                    lo, hi = w.off[i], w.off[i + 1]
                    if (known[lo + run : hi + 1] != known[lo : hi - run + 1]).all():
                        continue
                    for k, spans in _passages(a, symbols, sym[lo:hi].tolist(), run).items():
                        first, last = min(s for s, _ in spans), max(e for _, e in spans) - 1
                        begin = int(w.points.src[w.begin[lo + first]] - src_begin[i])
                        finish = int(w.points.src[w.end[lo + last] - 1] - src_begin[i]) + 1
                        out.append((doc_ids[i], item_ids[k], max(e - s for s, e in spans), begin, finish))
            cols = list(zip(*out, strict=True)) if out else [[], [], [], [], []]
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "item_id", "n_words", "begin_char", "end_char"])

    return spread(d).mapInArrow(scan, _SCHEMA)
