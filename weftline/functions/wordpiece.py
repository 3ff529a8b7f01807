"""Word pieces: normalisation, splitting and greedy longest match, on the distinct words of a collection."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import has_cjk

LONGEST_WORD = 100


#: Entries a vocabulary may have.
MOST_PIECES = 1_000_000


@lru_cache(maxsize=1)
def _bare() -> tuple[str, str]:
    """Characters that decompose into one character and marks, and those characters."""
    pairs = []
    for cp in range(0xC0, 0x10000):
        whole = unicodedata.normalize("NFD", chr(cp))
        base = "".join(c for c in whole if unicodedata.category(c) != "Mn")
        if len(base) == 1 and base != chr(cp) and not 0xD800 <= cp < 0xE000:
            pairs.append((chr(cp), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def _jamo(c: Column) -> Column:
    """A Hangul syllable as its two or three letters, by the arithmetic of their code points; others unchanged."""
    letters = [F.array(*[F.lit(chr(first + i)) for i in range(n)]) for first, n in ((0x1100, 19), (0x1161, 21), (0x11A7, 28))]
    n = F.conv(F.hex(F.encode(c, "UTF-16BE")), 16, 10).cast("int") - 0xAC00
    last = F.when(n % 28 > 0, F.element_at(letters[2], n % 28 + 1)).otherwise("")
    whole = F.concat(F.element_at(letters[0], F.floor(n / 588).cast("int") + 1), F.element_at(letters[1], F.floor(n % 588 / 28).cast("int") + 1), last)
    return F.when((c >= "\uac00") & (c <= "\ud7a3"), whole).otherwise(c)


def normalise(c: Column) -> Column:
    """Controls dropped, white space to blanks, accents removed, lower case, in built-in expressions only.

    Vowel signs that decompose into two spacing ones stay composed."""
    t = F.regexp_replace(c, r"[\t\n\r\p{Z}\x1c-\x1f\x85]", " ")
    t = F.regexp_replace(F.regexp_replace(t, "\ufffd", ""), r"[\p{C}]", "")
    spelt = F.array_join(F.transform(F.split(t, ""), _jamo), "")
    t = F.when(t.rlike("[\uac00-\ud7a3]"), spelt).otherwise(t)
    return F.lower(F.regexp_replace(F.translate(t, *_bare()), r"\p{Mn}", ""))


def split_words(df: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """(keys..., pos, word): white-space words, every punctuation or CJK character a word of its own."""
    n = F.regexp_replace(normalise(F.col(text_col)), r"([\p{P}$+<=>^`|~\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}])", " $1 ")
    words = F.filter(F.split(F.regexp_replace(n, r"[\p{Cc}\s]+", " "), r"\s+"), lambda w: w != "")
    return df.select(*keys, F.posexplode(words).alias("pos", "word"))


def match(word: str, vocab: dict[str, int], unk: int) -> list[int]:
    """Greedy longest match; a word that cannot be covered is one unknown piece."""
    if len(word) > LONGEST_WORD:
        return [unk]
    out, at = [], 0
    while at < len(word):
        for end in range(len(word), at, -1):
            piece = vocab.get(word[at:end] if at == 0 else "##" + word[at:end])
            if piece is not None:
                out.append(piece)
                at = end
                break
        else:
            return [unk]
    return out


def encode(df: DataFrame, keys: list[str], text_col: str, pieces: DataFrame, most: int = 128) -> DataFrame:
    """(keys..., ids): piece ids framed by [CLS] and [SEP], at most ``most``.  Each distinct word is matched once."""
    n = pieces.count()
    if n > MOST_PIECES:
        raise ValueError(f"{n} pieces; a vocabulary has at most {MOST_PIECES}")
    vocab = {r.piece: r.piece_id for r in pieces.select("piece", "piece_id").collect()}
    unk, cls, sep = (vocab[x] for x in ("[UNK]", "[CLS]", "[SEP]"))
    shared = df.sparkSession.sparkContext.broadcast(vocab)  # a vocabulary file of fixed size

    def ids(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = shared.value
        for pdf in frames:
            yield pd.DataFrame({"word": pdf.word, "ids": [match(w, v, unk) for w in pdf.word]})

    words = split_words(df, keys, text_col)
    known = words.select("word").distinct().mapInPandas(ids, "word string, ids array<int>")
    rows = words.join(known, "word").groupBy(*keys).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ids"))), lambda s: s.ids)).alias("w"))
    out = df.select(*keys).join(rows, keys, "left")
    return out.select(*keys, F.concat(F.array(F.lit(cls)), F.slice(F.coalesce("w", F.array().cast("array<int>")), 1, most - 2), F.array(F.lit(sep))).alias("ids"))


__all__ = ["encode", "has_cjk", "match", "normalise", "split_words"]
