"""Visually identical text in one consistent form (problem 2).

The kernel copies an Arrow string array once into a numpy array of code points and works on that array alone:
lookup-table gathers replace and expand characters, offsets are recomputed by cumulative sums, marks are ordered and
composed with vector operations.  No Python call is made per row.

Two forms are produced from the same steps:

* the *visible key* folds look-alike letters of other scripts to one prototype, so that two texts have equal keys
  exactly if they show the same characters in the same order;
* the *consistent form* is a function of the key (hence equal for equal keys) in which words that hold letters found
  only in Cyrillic or Greek are written wholly in that script, so that it stays readable and usable for language work.

Defined results: null stays null; a text without visible characters becomes the empty string; any run of space-like
characters (line breaks too) becomes one space and is removed at the ends; lone combining marks are kept.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.session import cut, spread

# Letters of other scripts that look like a Latin letter, by prototype.
LOOKALIKE_CYRILLIC = {
    "a": "а", "c": "с", "d": "ԁ", "e": "е", "h": "һ", "i": "і", "j": "ј", "l": "ӏ", "o": "о", "p": "р", "q": "ԛ",
    "s": "ѕ", "w": "ԝ", "x": "х", "y": "у",
    "A": "А", "B": "В", "C": "С", "E": "Е", "G": "Ԍ", "H": "Н", "I": "І", "J": "Ј", "K": "К", "M": "М", "O": "О",
    "P": "Р", "S": "Ѕ", "T": "Т", "W": "Ԝ", "X": "Х", "Y": "У",
}
LOOKALIKE_GREEK = {
    "o": "ο", "v": "ν",
    "A": "Α", "B": "Β", "E": "Ε", "H": "Η", "I": "Ι", "K": "Κ", "M": "Μ", "N": "Ν", "O": "Ο", "P": "Ρ", "T": "Τ",
    "X": "Χ", "Y": "Υ", "Z": "Ζ",
}
# Further characters drawn like an ordinary one.
LOOKALIKE_OTHER = {
    "ɑ": "a", "ɡ": "g", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "Ү": "Y", "Ӏ": "I", "օ": "o", "ց": "g", "ѵ": "v", "ⅼ": "l", "ⅰ": "i", "ⅽ": "c", "ⅾ": "d", "ⅿ": "m",
    "‐": "-", "‑": "-",
}
# Characters outside category Cf/Cc that show nothing, and blank glyphs that act as a space.
INVISIBLE = [0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0]
BLANK = [0x2800]
# Compatibility tags whose two sides are drawn alike.
SAME_LOOK_TAGS = ("<wide>", "<narrow>", "<noBreak>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>")

_SPACE = 32
_LIMIT = 0x110000
_LATIN, _CYRILLIC, _GREEK = 1, 2, 3


class _Tables(NamedTuple):
    start: np.ndarray  # where a code point's expansion begins in ``pool``
    length: np.ndarray  # 0 removes it
    pool: np.ndarray
    ccc: np.ndarray  # canonical combining class
    letter: np.ndarray  # letters, digits and marks: what may be inside a word
    script: np.ndarray  # script of letters that are in no look-alike pair
    proto: np.ndarray  # prototypes that have a form in Cyrillic (bit 1) or Greek (bit 2)
    to_cyrillic: np.ndarray
    to_greek: np.ndarray
    pair_key: np.ndarray  # sorted (base << 21 | mark)
    pair_value: np.ndarray
    lower: np.ndarray


def _decompose(cp: int, seen: dict[int, tuple[int, ...]]) -> tuple[int, ...]:
    """Full decomposition of ``cp`` by canonical mappings and those whose two sides look alike."""
    if cp in seen:
        return seen[cp]
    raw = unicodedata.decomposition(chr(cp)).split()
    out: tuple[int, ...] = (cp,)
    if raw:
        tag = raw.pop(0) if raw[0][0] == "<" else ""
        parts = [int(x, 16) for x in raw]
        spacing_mark = tag == "<compat>" and parts[0] == _SPACE and len(parts) > 1
        if not tag or (tag in SAME_LOOK_TAGS and not spacing_mark):
            out = tuple(y for x in parts for y in _decompose(x, seen))
    seen[cp] = out
    return out


@lru_cache(maxsize=1)
def tables() -> _Tables:
    """Lookup tables, built once per process from the interpreter's Unicode data."""
    start = np.arange(_LIMIT, dtype=np.int32)
    length = np.ones(_LIMIT, np.uint8)
    ccc = np.zeros(_LIMIT, np.uint8)
    letter = np.zeros(_LIMIT, bool)
    script = np.zeros(_LIMIT, np.uint8)
    pool: list[int] = []
    expand: dict[int, tuple[int, ...]] = {}
    seen: dict[int, tuple[int, ...]] = {}
    fold = {ord(v): ord(k) for t in (LOOKALIKE_CYRILLIC, LOOKALIKE_GREEK) for k, v in t.items()}
    fold |= {ord(k): ord(v) for k, v in LOOKALIKE_OTHER.items()}
    pairs: dict[int, int] = {}
    for cp in [*range(0x33480), *range(0xE0000, 0xE01F0)]:
        ch = chr(cp)
        cat = unicodedata.category(ch)
        if cat in ("Cn", "Cs", "Co") and not 0xE0000 <= cp:
            continue
        ccc[cp] = unicodedata.combining(ch)
        if cat[0] in "LN" and cat != "No" or cat[0] == "M":
            letter[cp] = True
        if cat == "Zs" or cat in ("Zl", "Zp") or cp in (9, 10, 11, 12, 13, 0x1C, 0x1D, 0x1E, 0x1F, 0x85) or cp in BLANK:
            expand[cp] = (_SPACE,)
        elif cat in ("Cf", "Cc") or cp in INVISIBLE or 0xFE00 <= cp <= 0xFE0F or 0xE0000 <= cp:
            expand[cp] = ()
        elif not 0xAC00 <= cp <= 0xD7A3:
            out = tuple(fold.get(x, x) for x in _decompose(cp, seen))
            if out != (cp,):
                expand[cp] = out
            canonical = unicodedata.decomposition(ch)
            if canonical and canonical[0] != "<" and " " in canonical and unicodedata.normalize("NFC", ch) == ch:
                a, b = (int(x, 16) for x in canonical.split())
                pairs[a << 21 | b] = cp
        if cat[0] == "L":
            if cp < 0x250:
                script[cp] = _LATIN
            elif 0x400 <= cp < 0x530:
                script[cp] = _CYRILLIC
            elif 0x370 <= cp < 0x400:
                script[cp] = _GREEK
    base = len(start)
    for cp, out in expand.items():
        start[cp], length[cp] = base + len(pool), len(out)
        pool.extend(out)
    everything = np.concatenate([np.arange(_LIMIT, dtype=np.int32), np.array(pool, np.int32)])
    proto = np.zeros(_LIMIT, np.uint8)
    to_cyrillic, to_greek = np.arange(_LIMIT, dtype=np.int32), np.arange(_LIMIT, dtype=np.int32)
    for bit, back, t in ((1, to_cyrillic, LOOKALIKE_CYRILLIC), (2, to_greek, LOOKALIKE_GREEK)):
        for k, v in t.items():
            proto[ord(k)] |= bit
            back[ord(k)] = ord(v)
            script[[ord(k), ord(v)]] = 0
    # A composed letter whose base is folded composes from the folded base too, e.g. the Cyrillic io from Latin e.
    keys = np.array(sorted(pairs), np.int64)
    lower = np.arange(_LIMIT, dtype=np.int32)
    for cp in range(0x1E944):
        low = chr(cp).lower()
        if len(low) == 1:
            lower[cp] = ord(low)
    return _Tables(start, length, everything, ccc, letter, script, proto, to_cyrillic, to_greek, keys, np.array([pairs[k] for k in keys], np.int32), lower)


class Points(NamedTuple):
    """Rows of code points: row ``i`` is ``cp[off[i]:off[i + 1]]``; ``src`` gives each one's place in the input row."""

    cp: np.ndarray
    off: np.ndarray
    src: np.ndarray | None = None


def to_points(arr: pa.Array) -> Points:
    """Code points of an Arrow string array, one decoding call for the whole batch; nulls become empty rows."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = pc.fill_null(arr.cast(pa.large_string()), "")
    n = len(arr)
    off = np.frombuffer(arr.buffers()[1], np.int64, n + 1, arr.offset * 8) if n else np.zeros(1, np.int64)
    data = arr.buffers()[2]
    raw = memoryview(data)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else b""
    b = np.frombuffer(raw, np.uint8)
    lead = np.concatenate([[0], np.cumsum((b & 0xC0) != 0x80)])
    cp = np.frombuffer(str(raw, "utf-8").encode("utf-32-le"), np.int32) if len(b) else np.zeros(0, np.int32)
    return Points(cp, lead[off - off[0]])


def to_arrow(p: Points, valid: pa.Array | None = None) -> pa.Array:
    """The rows as an Arrow string array, null where ``valid`` is false."""
    width = 1 + (p.cp >= 0x80).astype(np.int64) + (p.cp >= 0x800) + (p.cp >= 0x10000)
    off = np.concatenate([[0], np.cumsum(width)])[p.off].astype(np.int64)
    data = p.cp.astype(np.int32).tobytes().decode("utf-32-le").encode("utf-8")
    out = pa.Array.from_buffers(pa.large_string(), len(p.off) - 1, [None, pa.py_buffer(off.tobytes()), pa.py_buffer(data)])
    if valid is not None:
        out = pc.if_else(valid, out, pa.scalar(None, pa.large_string()))
    return out.cast(pa.string())


def _keep(p: Points, mask: np.ndarray) -> Points:
    off = np.concatenate([[0], np.cumsum(mask)])[p.off]
    return Points(p.cp[mask], off, None if p.src is None else p.src[mask])


def _row_starts(p: Points) -> np.ndarray:
    first = np.zeros(len(p.cp), bool)
    first[p.off[:-1][p.off[:-1] < p.off[1:]]] = True
    return first


def _expand(p: Points, t: _Tables, source: bool) -> Points:
    n = t.length[p.cp].astype(np.int64)
    if (n == 1).all():
        return Points(t.pool[t.start[p.cp]], p.off, np.arange(len(p.cp)) if source else None)
    end = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat(t.start[p.cp].astype(np.int64) - end[:-1], n) + np.arange(end[-1])
    return Points(t.pool[at], end[p.off], np.repeat(np.arange(len(p.cp)), n) if source else None)


def _lookup(t: _Tables, base: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """The composed code point of each pair, or -1."""
    key = base.astype(np.int64) << 21 | mark
    at = np.minimum(np.searchsorted(t.pair_key, key), len(t.pair_key) - 1)
    return np.where(t.pair_key[at] == key, t.pair_value[at], -1)


def _compose(p: Points, t: _Tables) -> Points:
    """Canonical ordering and composition, in rounds over the marks' ranks inside their runs."""
    cp = p.cp
    ccc = t.ccc[cp]
    keep = np.ones(len(cp), bool)
    marks = np.flatnonzero(ccc)
    if len(marks):
        cp = cp.copy()
        first = _row_starts(p)
        run = np.cumsum((ccc == 0) | first)
        order = run[marks].astype(np.int64) * 256 + ccc[marks]
        if (np.diff(order) < 0).any():
            by = np.argsort(order, kind="stable")
            cp[marks] = cp[marks[by]]
            ccc = t.ccc[cp]
        head = np.maximum.accumulate(np.where((ccc == 0) | first, np.arange(len(cp)), 0))[marks]
        base_ok = (ccc[head] == 0) & (head != marks)
        rank = marks - head
        last = np.zeros(len(cp), np.int16)  # class of the last mark left standing after a starter
        for r in range(1, int(rank.max(initial=0)) + 1):
            m, h = marks[(rank == r) & base_ok], head[(rank == r) & base_ok]
            if not len(m):
                continue
            got = _lookup(t, cp[h], cp[m])
            yes = (got >= 0) & ((last[h] == 0) | (last[h] < ccc[m]))
            cp[h[yes]] = got[yes]
            keep[m[yes]] = False
            last[h[~yes]] = ccc[m[~yes]]
    p = p._replace(cp=cp)
    if not keep.all():
        p = _keep(p, keep)
    wide = p.cp >= 0x900  # starters that compose with a following starter lie above
    if wide.any():
        for _ in range(2):
            at = np.flatnonzero(wide[:-1] & wide[1:] & ~_row_starts(p)[1:])
            if not len(at):
                break
            a, b = p.cp[at], p.cp[at + 1]
            lv = (a >= 0x1100) & (a < 0x1113) & (b >= 0x1161) & (b < 0x1176)
            lvt = (a >= 0xAC00) & (a <= 0xD7A3) & ((a - 0xAC00) % 28 == 0) & (b > 0x11A7) & (b < 0x11C3)
            got = np.where(lv, 0xAC00 + ((a - 0x1100) * 21 + b - 0x1161) * 28, np.where(lvt, a + b - 0x11A7, _lookup(t, a, b)))
            yes = np.flatnonzero(got >= 0)
            yes = yes[np.concatenate([[True], np.diff(at[yes]) > 1])] if len(yes) else yes
            if not len(yes):
                break
            cp = p.cp.copy()
            cp[at[yes]] = got[yes]
            mask = np.ones(len(cp), bool)
            mask[at[yes] + 1] = False
            p = _keep(p._replace(cp=cp), mask)
            wide = p.cp >= 0x900
    return p


def _rescript(p: Points, t: _Tables) -> Points:
    """Write each word in the script its unmistakable letters show; where it has none, in that of most words."""
    letter = t.letter[p.cp]
    script = t.script[p.cp]
    if not ((script == _CYRILLIC) | (script == _GREEK)).any():
        return p
    first = _row_starts(p)
    begins = letter & (first | ~np.concatenate([[False], letter[:-1]]))
    word = np.cumsum(begins)  # 0: before any word
    n = int(word[-1]) + 1
    row = np.repeat(np.arange(len(p.off) - 1), np.diff(p.off))
    count = lambda s, by, size: np.bincount(by[letter & (script == s)], minlength=size)
    lat, cyr, gre = (count(s, word, n) for s in (_LATIN, _CYRILLIC, _GREEK))
    rows = len(p.off) - 1
    rl, rc, rg = (count(s, row, rows) for s in (_LATIN, _CYRILLIC, _GREEK))
    whole = np.where((rc > rl) & (rc >= rg), _CYRILLIC, np.where((rg > rl) & (rg > rc), _GREEK, _LATIN))
    own = np.where((cyr > 0) & (lat == 0) & (gre == 0), _CYRILLIC, np.where((gre > 0) & (lat == 0) & (cyr == 0), _GREEK, 0))
    undecided = (lat == 0) & (cyr == 0) & (gre == 0)
    # A word without unmistakable letters follows its text, if every letter of it is an everyday one in that script.
    want = np.where(undecided[word], whole[row], own[word])
    ascii_letter = letter & (((p.cp | 32) >= 97) & ((p.cp | 32) <= 122))
    for s, bit in ((_CYRILLIC, 1), (_GREEK, 2)):
        there = ((t.proto[p.cp] & bit) > 0) & ((s == _GREEK) | (t.to_cyrillic[p.cp] >= 0x410) & (t.to_cyrillic[p.cp] < 0x450))
        missing = np.bincount(word[ascii_letter & ~there], minlength=n) > 0
        want = np.where((want == s) & missing[word] & undecided[word], 0, want)
    cp = np.where(letter & (want == _CYRILLIC), t.to_cyrillic[p.cp], np.where(letter & (want == _GREEK), t.to_greek[p.cp], p.cp))
    return p._replace(cp=cp)


def _spaces(p: Points) -> Points:
    sp = p.cp == _SPACE
    before = np.concatenate([[True], sp[:-1]]) | _row_starts(p)
    q = _keep(p, ~(sp & before))
    # what is left may end with one space
    ends = q.off[1:][q.off[1:] > q.off[:-1]] - 1
    mask = np.ones(len(q.cp), bool)
    mask[ends[q.cp[ends] == _SPACE]] = False
    return q if mask.all() else _keep(q, mask)


def normalise_points(p: Points, key: bool = False, source: bool = False, lower: bool = False) -> Points:
    """All steps on rows of code points.  ``key``: the visible key; ``source``: keep the places in the input."""
    t = tables()
    q = _expand(p, t, source)
    if not key:
        q = _rescript(q, t)
    q = _spaces(_compose(q, t))
    return q._replace(cp=t.lower[q.cp]) if lower else q


def normalise_array(arr: pa.Array, key: bool = False, lower: bool = False) -> pa.Array:
    """The consistent form (or visible key) of every text of an Arrow array."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    return to_arrow(normalise_points(to_points(arr), key, False, lower), arr.is_valid())


@F.arrow_udf(T.StringType())
def _consistent(arr: pa.Array) -> pa.Array:
    return normalise_array(arr)


@F.arrow_udf(T.StringType())
def _visible_key(arr: pa.Array) -> pa.Array:
    return normalise_array(arr, key=True)


def consistent_form(col: Column) -> Column:
    """Column with every text in its one consistent form."""
    return _consistent(col.cast("string"))


def visible_key(col: Column) -> Column:
    """Column that is equal for two texts exactly if they look the same."""
    return _visible_key(col.cast("string"))


def look_alike_pairs(df: DataFrame, id_col: str, text_col: str, a: str, b: str) -> DataFrame:
    """Pairs of rows whose texts look the same but are not equal as strings, ``a`` < ``b``.

    Rows are shuffled as (16-byte digest of the key, 8-byte hash of the text, id); texts never are.  Rows of one
    spelling are counted as one with the map-side combine, and only keys with several spellings go on: first the
    spellings of a key are paired, then the rows of either spelling are joined to the pair.  Rows of one spelling never
    meet, so the work is that of the spellings and of the rows returned, however many copies there are.  Texts without
    visible characters and nulls take no part.
    """
    src = spread(df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t")))
    key = visible_key(F.col("__t"))
    # No filter on the key before the cut: the optimiser would move it below and normalise every text twice.
    keyed = cut(src.select("__id", F.unhex(F.md5(key)).alias("__k"), F.xxhash64("__t").alias("__v"), (F.length(key) > 0).alias("__shown")))
    keyed = keyed.where("__shown and __id is not null").drop("__shown")  # used below; the texts are read and normalised once
    several = keyed.groupBy("__k").agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi")).where("__lo <> __hi").select("__k")
    rows = cut(keyed.join(several, "__k", "left_semi"))
    spellings = rows.select("__k", "__v").distinct()
    one, two = (spellings.select("__k", F.col("__v").alias(v)) for v in ("__va", "__vb"))
    met = one.join(two, "__k").where("__va < __vb")
    side = lambda i, v: rows.select("__k", F.col("__v").alias(v), F.col("__id").alias(i))
    both = met.join(side("__x", "__va"), ["__k", "__va"]).join(side("__y", "__vb"), ["__k", "__vb"])
    return both.select(F.least("__x", "__y").alias(a), F.greatest("__x", "__y").alias(b)).where(F.col(a) < F.col(b))
