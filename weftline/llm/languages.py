"""Language of documents and of segments in mixed documents (problem 5).

One interpolated Kneser-Ney character model per language, all kept in sorted key arrays: for every n-gram seen in any
language the interpolated log probability in each language, and for every context its back-off weight in each.  A
position is scored by the longest stored n-gram, backing off otherwise; a sentence gets the language with the lowest
cross-entropy per character, or none where that exceeds what held-out sentences of the language show.  Sentences too
short to be told by themselves are told together, as one text, where their document has no other.

Rejection and confidence are calibrated on the tenth of the sentences that no model has seen.  A sentence is rejected
above a limit half way between two levels: mean + z deviations of its language and length class, z being the least that
rejects at most ``REJECTED`` of the held-out ones, and what the nearest hundredth of other languages' sentences show.  The confidence is the posterior of the languages at the temperature that makes short held-out
fragments, on which errors occur, most likely; ``Model.reliability`` is what is left of its calibration error.

The models are fitted on a bounded sample of labelled rows: ``FIT_DOCS`` documents per language, of those of at most
``FIT_CHARS`` characters.  Labels may be wrong and texts mixed, so sentences whose n-grams mostly carry another
label are left out before fitting.  Everything else covers all rows and whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm import words
from weftline.llm.sentences import Sentences, sentences_of
from weftline.session import spread

#: Bounds of the sample that the models are fitted on.
FIT_DOCS, FIT_CHARS = 500, 4000
ORDER, BITS = 5, 12
#: Shortest sentence, in words, that is told a language by itself.
MIN_WORDS = 4
#: Share of held-out sentences that calibration may reject; length classes, in symbols; length of fragments.
REJECTED, CLASSES, FRAGMENT = 0.002, (20, 40, 80), 12

# Names and codes of the languages told apart.
NAMES = {
    "en": ["eng", "english", "englisch", "anglais", "inglés", "ingles", "inglese", "английский"],
    "de": ["deu", "ger", "german", "deutsch", "allemand", "alemán", "aleman", "tedesco", "немецкий"],
    "fr": ["fra", "fre", "french", "français", "francais", "französisch", "francés", "francese", "французский"],
    "es": ["spa", "spanish", "español", "espanol", "castellano", "castilian", "espagnol", "spanisch", "испанский"],
    "pt": ["por", "portuguese", "português", "portugues", "portugais", "portugiesisch"],
    "it": ["ita", "italian", "italiano", "italien", "italienisch"],
    "nl": ["nld", "dut", "dutch", "nederlands", "flemish", "vlaams", "niederländisch"],
    "ru": ["rus", "russian", "русский", "russe", "russisch"],
}
LANGS = list(NAMES)


def label_language(col: Column) -> Column:
    """The two-letter code that a label in any spelling names, null if it names none of the languages."""
    head = F.regexp_extract(F.lower(F.trim(col)), r"^([\p{L}]+)", 1)
    pairs = [F.lit(x) for code, names in NAMES.items() for n in [code, *names] for x in (n, code)]
    return F.element_at(F.create_map(*pairs), head)


class Model(NamedTuple):
    alphabet: np.ndarray  # code point -> symbol, 1 for any other, 0 for spaces
    keys: list[np.ndarray]  # of order 1..ORDER, sorted
    logp: list[np.ndarray]  # [n-gram, language]
    gamma: list[np.ndarray]  # log back-off weight of the n-gram as a context
    floor: np.ndarray  # for a symbol never seen
    limit: np.ndarray  # [language, length class]: highest cross-entropy accepted
    scale: float  # of log-likelihood differences, for the confidence
    reliability: float  # mean difference of confidence and accuracy on held-out fragments


def _symbols(s: Sentences, alphabet: np.ndarray, lo: int = 0, hi: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the sentences ``lo:hi``, runs of other characters as one space, none leading; and their offsets."""
    begin = s.begin[lo:hi]
    n = s.end[lo:hi] - begin
    at = np.repeat(begin - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, int)
    sent = np.repeat(np.arange(len(n)), n)
    x = alphabet[s.cp[at]]
    first = np.ones(len(x), bool)
    first[1:] = sent[1:] != sent[:-1]
    keep = (x != 0) | ~(first | np.concatenate([[True], x[:-1] == 0]))
    x, sent = x[keep], sent[keep]
    return x, np.searchsorted(sent, np.arange(len(n) + 1))


def _grams(x: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """Packed n-grams of order 1..ORDER that end at each symbol; before a sentence stand spaces (symbol 0)."""
    pos = np.arange(len(x)) - np.repeat(off[:-1], np.diff(off))
    out, key = [], x.astype(np.int64)
    for k in range(ORDER):
        if k:
            prev = np.zeros(len(x), np.int64)
            prev[k:] = x[:-k] if k < len(x) else 0
            key = key | np.where(pos >= k, prev, 0) << (BITS * k)
        out.append(key)
    return out


def fit(texts: list[str], labels: list[int], n_langs: int) -> Model:
    """Fit the models on labelled texts."""
    s = sentences_of(pa.array(texts, pa.string()))
    seen, count = np.unique(s.cp, return_counts=True)
    letters = words.word_chars()
    ok = letters[seen] & ~((seen >= 48) & (seen < 58))
    seen = seen[ok][np.argsort(-count[ok], kind="stable")][: (1 << BITS) - 3]
    alphabet = np.where(letters, 1, 0).astype(np.int64)
    alphabet[48:58] = 0
    alphabet[seen] = np.arange(len(seen)) + 2
    x, off = _symbols(s, alphabet)
    grams = _grams(x, off)
    lang = np.repeat(np.asarray(labels), np.diff(s.off))
    held = np.arange(len(lang)) % 10 == 7
    for _ in range(2):
        lang = np.where(_vote(grams[-1], off, lang, n_langs) == lang, lang, -1)
    model = _train(grams, np.repeat(np.where(held, -1, lang), np.diff(off)), n_langs, alphabet)
    mine = np.flatnonzero(held & (lang >= 0))
    return _calibrate(model, x, off, lang, mine)


def _length_class(size: np.ndarray) -> np.ndarray:
    return np.searchsorted(np.array(CLASSES), size, side="right")


def _cut_out(x: np.ndarray, off: np.ndarray, which: np.ndarray, most: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the sentences ``which``, or of the first ``most`` of each, and their offsets."""
    n = np.diff(off)[which]
    n = n if most is None else np.minimum(n, most)
    end = np.concatenate([[0], np.cumsum(n)])
    return x[np.repeat(off[which] - end[:-1], n) + np.arange(end[-1])], end


def _calibrate(m: Model, x: np.ndarray, off: np.ndarray, lang: np.ndarray, held: np.ndarray) -> Model:
    """Rejection limits and confidence temperature from held-out sentences."""
    n_langs, kinds = len(m.floor), len(CLASSES) + 1
    limit = np.full((n_langs, kinds), np.inf)
    if not len(held):
        return m._replace(limit=limit)
    hx, h_off = _cut_out(x, off, held, None)
    all_ce = _entropy(m, _grams(hx, h_off), h_off)
    ce = all_ce[np.arange(len(held)), lang[held]]
    kind = _length_class(np.diff(h_off))
    mean, dev = np.full((n_langs, kinds), np.nan), np.full((n_langs, kinds), np.nan)
    for k in range(n_langs):
        for c in range(kinds):
            one = ce[(lang[held] == k) & (kind == c)]
            if len(one) >= 20:
                mean[k, c], dev[k, c] = one.mean(), max(one.std(), 0.02)
    z = (ce - mean[lang[held], kind]) / dev[lang[held], kind]
    z = z[np.isfinite(z)]
    if len(z):
        # the order statistic that leaves at most REJECTED above it, and no less than the largest of a small sample
        limit = mean + max(np.sort(z)[min(len(z) - 1, int(np.ceil(len(z) * (1 - REJECTED))))], 3.0) * dev
        # half way to what the other languages' sentences show, so that slips and single foreign words do not reject
        for k in range(n_langs):
            other = all_ce[(lang[held] != k) & (kind > 0), k]
            if len(other):
                limit[k] = np.maximum(limit[k], (limit[k] + np.quantile(other, 0.01)) / 2)
        # a class of few sentences takes the limit of the nearest one that has enough, the wider one of two
        for k in range(n_langs):
            have = np.flatnonzero(~np.isnan(limit[k]))
            for c in np.flatnonzero(np.isnan(limit[k])):
                limit[k, c] = max((limit[k, h] for h in have if abs(h - c) == abs(have - c).min()), default=np.inf)
    fx, f_off = _cut_out(x, off, held, FRAGMENT)
    size = np.diff(f_off)
    cost = (_entropy(m, _grams(fx, f_off), f_off) * size[:, None])[size > 0]
    true = lang[held][size > 0]
    scales = np.geomspace(0.05, 2, 40)

    def posterior(t: float) -> np.ndarray:
        p = np.exp(-(cost - cost.min(1, keepdims=True)) * t)
        return p / p.sum(1, keepdims=True)

    loss = [-np.log(np.maximum(posterior(t)[np.arange(len(true)), true], 1e-12)).mean() for t in scales]
    scale = float(scales[int(np.argmin(loss))])
    p = posterior(scale)
    conf, right = p.max(1), p.argmax(1) == true
    bins = np.minimum((conf * 10).astype(int), 9)
    gap = sum(abs(conf[bins == k].mean() - right[bins == k].mean()) * (bins == k).mean() for k in np.unique(bins))
    return m._replace(limit=limit, scale=scale, reliability=float(gap))


def _vote(gram: np.ndarray, off: np.ndarray, lang: np.ndarray, n_langs: int) -> np.ndarray:
    """The language whose label most of a sentence's n-grams carry.

    Wrong labels teach a conditional model whole sentences of another language; shares of the pooled counts do not
    have that weakness, since the n-grams of a sentence stand under its true language far more often.
    """
    table, at = np.unique(gram, return_inverse=True)
    by = np.repeat(lang, np.diff(off))
    count = np.zeros((len(table), n_langs), np.float32)
    np.add.at(count, (at[by >= 0], by[by >= 0]), 1)
    size = np.maximum(np.bincount(by[by >= 0], minlength=n_langs), 1)
    count = count / (size / size.mean()) + 0.5
    share = np.log(count / count.sum(1, keepdims=True))
    total = np.zeros((len(off) - 1, n_langs))
    full = np.flatnonzero(np.diff(off))
    if len(full):
        total[full] = np.add.reduceat(share[at], off[full], axis=0)
    return total.argmax(1)


def _train(grams: list[np.ndarray], lang: np.ndarray, n_langs: int, alphabet: np.ndarray) -> Model:
    keys, logp, gamma = [], [], []
    use = lang >= 0
    tables = [np.unique(g[use]) for g in grams]
    raw = np.zeros((len(tables[-1]), n_langs))
    np.add.at(raw, (np.searchsorted(tables[-1], grams[-1][use]), lang[use]), 1)
    counts = [np.zeros(0)] * ORDER
    counts[-1] = raw
    for n in range(ORDER - 1, 0, -1):  # continuation counts: how many different symbols precede
        suffix = np.searchsorted(tables[n - 1], tables[n] & ((1 << BITS * n) - 1))
        cont = np.zeros((len(tables[n - 1]), n_langs))
        np.add.at(cont, suffix, (counts[n] > 0).astype(float))
        counts[n - 1] = cont
    v = len(tables[0]) + 1
    below: np.ndarray = np.zeros(0)
    for n in range(1, ORDER + 1):
        t, c = tables[n - 1], counts[n - 1]
        n1, n2 = (c == 1).sum(0), (c == 2).sum(0)
        disc = np.where(n1 > 0, n1 / np.maximum(n1 + 2 * n2, 1), 0.5)
        if n == 1:
            ctx, n_ctx, lower = np.zeros(len(t), int), 1, np.full((len(t), n_langs), 1 / v)
        else:
            ctx = np.searchsorted(tables[n - 2], t >> BITS)
            ctx = np.where(tables[n - 2][np.minimum(ctx, len(tables[n - 2]) - 1)] == t >> BITS, ctx, len(tables[n - 2]))
            n_ctx = len(tables[n - 2]) + 1
            lower = below[np.searchsorted(tables[n - 2], t & ((1 << BITS * (n - 1)) - 1))]
        total, kinds = np.zeros((n_ctx, n_langs)), np.zeros((n_ctx, n_langs))
        np.add.at(total, ctx, c)
        np.add.at(kinds, ctx, (c > 0).astype(float))
        g = np.where(total > 0, disc * kinds / np.maximum(total, 1), 1.0)
        p = np.maximum(c - disc, 0) / np.maximum(total[ctx], 1) + g[ctx] * lower
        if n == 1:
            floor = np.log(g[0] / v)
        else:
            gamma.append(np.log(g[:-1]).astype(np.float32))
        below = p
        keys.append(t)
        logp.append(np.log(p).astype(np.float32))
    gamma.append(np.zeros((0, n_langs), np.float32))
    return Model(alphabet, keys, logp, gamma, floor.astype(np.float32), np.full((n_langs, len(CLASSES) + 1), np.inf), 0.25, np.nan)


def _find(table: np.ndarray, key: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(table, key), len(table) - 1)
    return np.where(table[at] == key, at, -1)


def _entropy(m: Model, grams: list[np.ndarray], off: np.ndarray) -> np.ndarray:
    """[sentence, language]: cross-entropy per character, in nats."""
    n_langs = len(m.floor)
    out = np.zeros((len(off) - 1, n_langs), np.float32)
    size = np.diff(off)
    total = int(off[-1])
    if not total:
        return out
    ends = np.flatnonzero(size)
    for lo in range(0, len(ends), 4000):
        block = ends[lo : lo + 4000]
        a, b = off[block[0]], off[block[-1] + 1]
        score = np.zeros((b - a, n_langs), np.float32)
        left = np.arange(b - a)
        for n in range(ORDER, 0, -1):
            at = _find(m.keys[n - 1], grams[n - 1][a:b][left])
            hit = at >= 0
            score[left[hit]] += m.logp[n - 1][at[hit]]
            left = left[~hit]
            if not len(left):
                break
            if n == 1:
                score[left] += m.floor
            else:
                ctx = _find(m.keys[n - 2], grams[n - 1][a:b][left] >> BITS)
                known = ctx >= 0
                score[left[known]] += m.gamma[n - 2][ctx[known]]
        out[block] = -np.add.reduceat(score, off[block] - a, axis=0) / size[block][:, None]
    return out


def tell(m: Model, s: Sentences) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every sentence the language's index (-1: none), the confidence in 0..1 and the number of symbols."""
    parts, sizes = [], []
    for lo in range(0, len(s.begin), 10_000):
        x, off = _symbols(s, m.alphabet, lo, lo + 10_000)
        parts.append(_entropy(m, _grams(x, off), off))
        sizes.append(np.diff(off))
    ce = np.concatenate(parts) if parts else np.zeros((0, len(m.floor)), np.float32)
    size = np.concatenate(sizes) if sizes else np.zeros(0, int)
    short = np.diff(s.word_off) < MIN_WORDS
    best, conf = _decide(m, ce, size)
    best, conf = np.where(short, -1, best), np.where(short, 0.0, conf)
    # documents that have short sentences only: told as one text
    row = np.repeat(np.arange(len(s.off) - 1), np.diff(s.off))
    words_of_row = np.bincount(row, np.diff(s.word_off), len(s.off) - 1)
    only = (np.bincount(row[~short], minlength=len(s.off) - 1) == 0) & (words_of_row >= MIN_WORDS)
    at = np.flatnonzero(only[row] & (size > 0))
    if len(at):
        docs, of = np.unique(row[at], return_inverse=True)
        cost = np.zeros((len(docs), len(m.floor)))
        np.add.at(cost, of, ce[at] * size[at][:, None])
        total = np.bincount(of, size[at])
        told, sure = _decide(m, (cost / total[:, None]).astype(np.float32), total.astype(int))
        best[at], conf[at] = told[of], sure[of]
    return best, conf, size


def _decide(m: Model, ce: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Language (-1: rejected or empty) and confidence from cross-entropies over ``size`` symbols."""
    if not len(ce):
        return np.zeros(0, int), np.zeros(0)
    best = ce.argmin(1)
    lead = ce[np.arange(len(best)), best]
    conf = 1 / np.exp(-(ce - lead[:, None]) * (size * m.scale)[:, None]).sum(1)
    none = (size == 0) | (lead > m.limit[best, _length_class(size)])
    return np.where(none, -1, best), np.where(none, 0.0, conf)


def labelled_sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], list[int]]:
    """At most ``FIT_DOCS`` texts of at most ``FIT_CHARS`` characters for each language, by the labels given."""
    d = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), label_language(F.col(lang_col)).alias("l"))
    d = d.where(F.col("l").isNotNull() & F.length("t").between(40, FIT_CHARS))
    w = Window.partitionBy("l").orderBy(F.xxhash64("i"), "i")
    rows = d.withColumn("r", F.row_number().over(w)).where(F.col("r") <= FIT_DOCS).select("t", "l").collect()
    return [r.t for r in rows], [LANGS.index(r.l) for r in rows]


def fit_languages(docs: DataFrame, **cols: str) -> Model | None:
    """Models from the labels of ``docs``; None where no row is labelled."""
    texts, labels = labelled_sample(docs, **cols)
    return fit(texts, labels, len(LANGS)) if texts else None


_OUT = "doc_id long, label string, n_words int, n_told int, segments array<struct<begin:int,end:int,lang:string,confidence:double,n_sentences:int>>"
_SEG = pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("n_sentences", pa.int32())])


def language_segments(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: (doc_id, label, n_words, n_told, segments); ``label`` is the language the label names.

    A segment is a maximal run of sentences in one language; its places count code points of the consistent form, and
    its confidence is the mean of its sentences' weighted by length.  Sentences that are too short, where others are
    not, or that no model explains belong to no language and to the segment they stand in.  A null or blank text has no segment.
    """
    model = model or fit_languages(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(model)  # at most FIT_DOCS * FIT_CHARS n-grams for each language and order

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                b = batch.slice(at, 2000)
                s = sentences_of(b.column(1))
                n = b.num_rows
                lang, conf, size = tell(m, s) if m is not None else (np.full(len(s.begin), -1), np.zeros(len(s.begin)), np.ones(len(s.begin)))
                row = np.repeat(np.arange(n), np.diff(s.off))
                told = np.flatnonzero(lang >= 0)
                r, g, c, z = row[told], lang[told], conf[told], size[told].astype(float)
                new = np.ones(len(told), bool)
                new[1:] = (r[1:] != r[:-1]) | (g[1:] != g[:-1])
                start = np.flatnonzero(new)
                stop = np.concatenate([start[1:], [len(told)]]) if len(start) else start
                weight = np.add.reduceat(z, start) if len(start) else np.zeros(0)
                mean = np.add.reduceat(c * z, start) / np.maximum(weight, 1) if len(start) else np.zeros(0)
                shift = s.row_off[:-1][r[start]] if len(start) else np.zeros(0, int)
                seg = pa.StructArray.from_arrays(
                    [
                        pa.array((s.begin[told[start]] - shift).astype(np.int32)),
                        pa.array((s.end[told[stop - 1]] - shift).astype(np.int32)),
                        pa.array([LANGS[k] for k in g[start]], pa.string()),
                        pa.array(mean),
                        pa.array((stop - start).astype(np.int32)),
                    ],
                    fields=list(_SEG),
                )
                off = np.searchsorted(r[start], np.arange(n + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(2), pa.array(s.row_words.astype(np.int32)), pa.array(np.bincount(r, minlength=n).astype(np.int32)), pa.ListArray.from_arrays(pa.array(off), seg)],
                    names=["doc_id", "label", "n_words", "n_told", "segments"],
                )

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"), label_language(F.col(lang_col)).alias("label")).where("doc_id is not null")
    return spread(src).mapInArrow(run, _OUT)


def language_shares(segments: DataFrame) -> DataFrame:
    """(doc_id, label, n_words, langs): the languages of a document as an array of (lang, share of its told sentences, confidence), largest first."""
    one = lambda x: F.aggregate(
        F.filter("segments", lambda s: s.lang == x),
        F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("c")),
        lambda a, s: F.struct((a.n + s.n_sentences).alias("n"), (a.c + s.confidence * s.n_sentences).alias("c")),
    )
    langs = F.transform(
        F.array_distinct(F.transform("segments", lambda s: s.lang)),
        lambda x: F.struct((one(x).n / F.col("n_told")).alias("share"), x.alias("lang"), (one(x).c / one(x).n).alias("confidence")),
    )
    return segments.select("doc_id", "label", "n_words", F.sort_array(langs, asc=False).alias("langs"))


def wrong_languages(shares: DataFrame, min_words: int = 5, min_share: float = 0.2) -> DataFrame:
    """(doc_id, lang): the languages, each of at least ``min_share`` of the sentences, of documents of at least
    ``min_words`` words whose label is missing or other than the one language the text is in."""
    langs = F.transform(F.filter("langs", lambda x: x.share >= min_share), lambda x: x.lang)
    d = shares.where(F.col("n_words") >= min_words).select("doc_id", "label", langs.alias("langs"))
    right = (F.size("langs") == 1) & F.array_contains("langs", F.coalesce("label", F.lit("")))
    return d.where(~right).select("doc_id", F.explode("langs").alias("lang"))
