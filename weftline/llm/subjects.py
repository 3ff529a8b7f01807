"""Subject areas of documents by subject-specific n-gram language models (problem 9).

Every subject, and small talk, has an interpolated bigram model of each language, and so has the background:

    P(w | h) = l(h) * Q(w | h) + (1 - l(h)) * P(w)        l(h) = C(h) / (C(h) + BACK * followers of h)

P and Q of the background are relative frequencies over all documents, with a share for unseen words.  Those of a class
are the background's times what the class is known to add or lack, normalised to one: an n-gram's ratio of class and
background frequency, shrunk towards 1, and exactly 1 where the difference is within chance or no subject owns the
n-gram.  The gain of a sentence is the background's cross-entropy per token less the subject's.  A sentence goes to the
subject that explains it best if the gain passes the subject's calibrated bound; a document has every subject that
makes up a sufficient share of its sentences.

Labels are per document, partly wrong and may be several.  The class weights of a document are re-estimated in a few
rounds from its sentences, and unlabelled documents join after the first.  Frequencies count documents, not sentences:
phrases that occur with every subject stay neutral however often they occur.  Classes, background, bounds and scores
cover all documents and whole texts: texts are cut into words once, every round counts in the tasks what its model makes
of them, and the driver has the table of n-grams, never the documents.  Class weights are multiples of ``UNIT``, so that
sums, and hence models, do not depend on the partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import languages, words
from weftline.llm.sentences import Sentences, sentences_of
from weftline.session import cut, spread

#: Subjects that models are made of, and n-grams times classes that the driver computes with, at most; more are an error.
MOST_SUBJECTS, MOST_CELLS = 1000, 100_000_000
#: Strength of the prior of an n-gram's ratio, in documents; standard errors it must differ by; rounds with all documents.
ALPHA, SIGMAS, ROUNDS = 1.0, 2.5, 6
#: Share of an n-gram's documents, classes weighed equally, that must be of one subject for the n-gram to tell it.
OWN = 0.45
#: Weight of a subject that the labels of a document do not name; gain per token asked for before calibration.
STRAY, BOUND = 0.1, 0.05
#: How strongly contexts of many followers back off to single words.
BACK = 300.0
#: Least words of a sentence that counts; share of the sentences that makes a document have a subject.
LEAST_WORDS, SHARE = 3, 0.25
#: Documents that must hold a unigram, and a bigram, for it to tell a subject; steps of the bounds tried; unit of weights.
LEAST_UNI, LEAST_BI = 2, 8
STEPS, UNIT = np.arange(0.01, 0.2, 0.01), 2.0**-20

_ODD = np.uint64(0x9E3779B97F4A7C15)


class Model(NamedTuple):
    language: languages.Model | None  # None while words are given, not texts
    subjects: list[str]
    # Log probability less the background's, [n-gram, class], of n-grams where it is not that of any other word: by
    # bigram where stored, else by unigram, else ``other``.  The terms of the two cross-entropies that cancel are not kept.
    uni: np.ndarray  # sorted keys
    uni_gain: np.ndarray
    bi: np.ndarray
    bi_gain: np.ndarray
    other: np.ndarray  # [language, class]
    bound: np.ndarray  # least gain per token of each subject


def _tokens(m: languages.Model, s: Sentences) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sentence, unigram key, bigram key, language of each sentence): keys differ between languages."""
    lang, _, _ = languages.tell(m, s)
    n = np.diff(s.word_off)
    sent = np.repeat(np.arange(len(n)), n)
    at = np.repeat(s.word_off[:-1] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    uni = words.mix(s.word_hash[at] * np.uint64(31) + (lang[sent] + 1).astype(np.uint64))
    return sent, uni, _bigrams(uni, sent, lang)[0], lang


def _bigrams(uni: np.ndarray, sent: np.ndarray, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the bigrams that end at each word, the words before, and which of them stand first in a sentence."""
    prev = np.concatenate([np.zeros(1, np.uint64), uni[:-1]]) if len(uni) else uni
    first = np.ones(len(uni), bool)
    first[1:] = sent[1:] != sent[:-1]
    return words.mix(np.where(first, (lang[sent] + 1).astype(np.uint64), prev) * _ODD + uni), prev, first


def _at(table: np.ndarray, key: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.full(len(key), -1)
    at = np.minimum(np.searchsorted(table, key), len(table) - 1)
    return np.where(table[at] == key, at, -1)


def _gains(m: Model, u: np.ndarray, b: np.ndarray, sent: np.ndarray, lang: np.ndarray) -> np.ndarray:
    """[sentence, class]: the background's negative log likelihood less the class's."""
    n = len(lang)
    r = m.other[lang[sent] + 1]
    r[u >= 0] = m.uni_gain[u[u >= 0]]
    r[b >= 0] = m.bi_gain[b[b >= 0]]
    out = np.zeros((n, r.shape[1]), np.float32)
    full, start = np.unique(sent, return_index=True)
    if len(full):
        out[full] = np.add.reduceat(r, start, axis=0)
    return out


class Background(NamedTuple):
    uni: np.ndarray  # documents that hold each unigram
    bi: np.ndarray  # and each bigram
    total: np.ndarray  # of all unigrams of a language


class Grams(NamedTuple):
    """The n-grams of the documents: languages, and of a bigram its context (after the unigrams: sentence starts by
    language) and second word."""

    lang: np.ndarray
    first: np.ndarray
    second: np.ndarray


def interpolated(g: Grams, bg: Background, ur: np.ndarray, br: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Background log probabilities of unigrams and bigrams, and the gains of the classes: of unigrams, of bigrams, and
    of unknown words by language.  ``ur``, ``br``: log ratios before normalising."""
    n_langs, k = len(bg.total), ur.shape[1]
    kinds = np.bincount(g.lang, minlength=n_langs)
    whole = bg.total + kinds + 1.0
    p0 = bg.uni / whole[g.lang]
    unknown = np.maximum(1 - np.bincount(g.lang, p0, n_langs), 1e-9)
    z = np.stack([np.bincount(g.lang, p0 * np.exp(ur[:, c]), n_langs) for c in range(k)], 1) + unknown[:, None]
    other = -np.log(z)
    g1 = ur + other[g.lang]
    n_ctx = len(g.lang) + n_langs
    seen = np.bincount(g.first, bg.bi, n_ctx)
    weight = (seen / np.maximum(seen + BACK * np.bincount(g.first, minlength=n_ctx), 1))[g.first]
    q0 = bg.bi / np.maximum(seen, 1e-9)[g.first]
    zh = np.stack([np.bincount(g.first, q0 * np.exp(br[:, c]), n_ctx) for c in range(k)], 1)[g.first]
    low = (1 - weight) * p0[g.second]
    both = weight * q0 + low
    # a unigram or bigram that no document holds has no probability of its own
    ok = both > 0
    mixed = np.where(ok[:, None], (weight * q0)[:, None] * np.exp(br) / np.maximum(zh, 1e-12) + low[:, None] * np.exp(g1[g.second]), 1)
    g2 = np.log(np.maximum(mixed, 1e-300) / np.where(ok, both, 1)[:, None])
    return np.log(np.maximum(p0, 1e-12)), np.log(np.maximum(both, 1e-12)), g1, np.where(ok[:, None], g2, g1[g.second]), other


def _model(language: languages.Model | None, subjects: list[str], uni: np.ndarray, bi: np.ndarray, g: Grams, bg: Background, ur: np.ndarray, br: np.ndarray) -> Model:
    _, _, g1, g2, other = interpolated(g, bg, ur, br)
    return Model(language, subjects, uni, g1.astype(np.float32), bi, g2.astype(np.float32), other.astype(np.float32), np.full(len(subjects), BOUND))


def _shrunk(df: np.ndarray, by_class: np.ndarray, share: np.ndarray, least: float) -> np.ndarray:
    """Log of P(n-gram | class) / P(n-gram), 0 where the difference is within chance or no subject owns the n-gram.

    With classes weighed equally, most of an n-gram's documents must be of one subject: phrases of a style that some
    subject's documents happen to be written in stay neutral.
    """
    expected = df[:, None] * share
    per = by_class / np.maximum(share, 1e-9)
    ratio = np.log((per + ALPHA) / (df[:, None] + ALPHA))
    sure = np.abs(by_class - expected) >= SIGMAS * np.sqrt(expected + 0.2)
    own = (per + ALPHA) / (per + ALPHA).sum(1, keepdims=True) >= OWN
    owned = (sure & own)[:, :-1].any(1) & (df >= least)
    return np.where(sure & owned[:, None], ratio, 0.0)


class _Chunk(NamedTuple):
    """Words of some documents."""

    n: int
    row: np.ndarray  # document of each sentence
    lang: np.ndarray  # of each sentence
    size: np.ndarray  # words of each sentence
    sent: np.ndarray  # sentence of each word
    uni: np.ndarray
    bi: np.ndarray
    prev: np.ndarray
    first: np.ndarray
    told: np.ndarray  # documents with labels
    label: tuple[np.ndarray, np.ndarray]  # (document, subject) of the labels


def _chunks(batches: Iterator[pa.RecordBatch], rows: int = 4000) -> Iterator[_Chunk]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            sets, langs, sizes, unis = batch.slice(at, rows).columns
            n = len(sets)
            row = np.repeat(np.arange(n), langs.value_lengths().to_numpy(zero_copy_only=False))
            lang, size = (x.flatten().to_numpy().astype(np.int64) for x in (langs, sizes))
            sent = np.repeat(np.arange(len(size)), size)
            uni = unis.flatten().to_numpy().view(np.uint64)
            told = np.asarray(sets.is_valid())
            many = sets.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            yield _Chunk(n, row, lang, size, sent, uni, *_bigrams(uni, sent, lang), told, (np.repeat(np.arange(n), many), sets.flatten().to_numpy()))


def tokens(docs: DataFrame, labels: DataFrame, subjects: list[str], language: languages.Model) -> DataFrame:
    """One row per document with a text: its subjects' indexes (empty for small talk, null without a label that says
    something), the languages and sizes of its sentences, and its words.  Labels differ in case and spaces only."""
    index = {x.lower(): i for i, x in enumerate(subjects)}
    shared = docs.sparkSession.sparkContext.broadcast(language)  # bounded by the sample that languages are told by

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                b = batch.slice(at, 2000)
                s = sentences_of(b.column(0))
                sent, uni, _, lang = _tokens(shared.value, s)
                off = np.concatenate([[0], np.cumsum(np.diff(s.word_off))])[s.off].astype(np.int32)
                known = [None if x is None or (x and not any(y in index for y in x)) else sorted({index[y] for y in x if y in index}) for x in b.column(1).to_pylist()]
                lists = lambda x, o=s.off: pa.ListArray.from_arrays(pa.array(o.astype(np.int32)), pa.array(x))
                cols = [pa.array(known, pa.list_(pa.int32())), lists(lang.astype(np.int32)), lists(np.diff(s.word_off).astype(np.int32)), lists(uni.view(np.int64), off)]
                yield pa.RecordBatch.from_arrays(cols, names=["subjects", "lang", "size", "uni"])

    d = spread(docs.select("doc_id", F.col("text").alias("t")).where("t is not null"))
    l = labels.select("doc_id", F.lower(F.trim("subject")).alias("s")).groupBy("doc_id").agg(F.collect_set("s").alias("s"))  # noqa: E741
    return cut(d.join(l, "doc_id", "left").select("t", "s").mapInArrow(run, "subjects array<int>, lang array<int>, size array<int>, uni array<long>"))


def _distinct(doc: np.ndarray, gram: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, n-gram), of n-grams numbered below ``n``: repeats inside a document, however long, count once."""
    both = np.unique(doc.astype(np.int64) * max(n, 1) + gram)
    return both // max(n, 1), both % max(n, 1)


def vocabulary(tok: DataFrame, classes: int) -> tuple[np.ndarray, np.ndarray, Grams, Background]:
    """Keys of the unigrams and bigrams of all documents, sorted, what they consist of, and how many documents hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _chunks(batches):
            doc, tl = c.row[c.sent], c.lang[c.sent] + 1
            for kind, gram in ((0, c.uni), (1, c.bi)):
                key, one, at = np.unique(gram, return_index=True, return_inverse=True)
                n = np.bincount(_distinct(doc, at, len(key))[1], minlength=len(key))
                # a bigram's context is a word, or below 0 the start of a sentence of a language
                cols = [np.full(len(key), kind), key.view(np.int64), tl[one], c.first[one], c.prev[one].view(np.int64), c.uni[one].view(np.int64), n]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["kind", "key", "lang", "head", "prev", "word", "n"])

    t = tok.mapInArrow(run, "kind long, key long, lang long, head boolean, prev long, word long, n long").groupBy("kind", "key")
    t = cut(t.agg(F.sum("n").alias("n"), *(F.max(x).alias(x) for x in ("lang", "head", "prev", "word"))))
    n = t.count()
    if n * classes > MOST_CELLS:
        raise ValueError(f"{n} n-grams of {classes} classes; at most {MOST_CELLS} gains are computed")
    a = t.toArrow()
    kind, key, lang, head, prev, word, n = (a.column(x).to_numpy() for x in ("kind", "key", "lang", "head", "prev", "word", "n"))
    key, prev, word = (np.ascontiguousarray(x).view(np.uint64) for x in (key, prev, word))
    by = np.lexsort((key, kind))
    u, b = by[kind[by] == 0], by[kind[by] == 1]
    uni = key[u]
    first = np.where(head[b].astype(bool), len(uni) + lang[b], np.searchsorted(uni, prev[b]))
    total = np.bincount(lang[u], n[u], len(languages.LANGS) + 1)
    return uni, key[b], Grams(lang[u], first, np.searchsorted(uni, word[b])), Background(n[u].astype(float), n[b].astype(float), total)


def _sums(tok: DataFrame, n: int, shared: Broadcast, of: Callable[[object, _Chunk], np.ndarray]) -> np.ndarray:
    """Sum of the ``n`` figures that ``of`` makes of documents; partial sums are made in the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n)
        for c in _chunks(batches):
            total += of(shared.value, c)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    t = tok.mapInArrow(run, "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    shared.destroy()
    out = np.zeros(n)
    out[t.column("at").to_numpy()] = t.column("n").to_numpy()
    return out


class _Round(NamedTuple):
    model: Model | None  # None: the labels alone tell
    k: int
    uni: np.ndarray  # keys of the n-grams that are counted by class
    bi: np.ndarray


def _weights(r: _Round, c: _Chunk) -> np.ndarray:
    """Class weights [document, class]."""
    doc, sub = c.label
    many = np.bincount(doc, minlength=c.n)
    start = np.zeros((c.n, r.k))
    start[doc, sub] = 1 / many[doc]
    start[c.told & (many == 0), r.k - 1] = 1
    z = start
    if r.model is not None:
        m = r.model
        best, _ = _choose(m, _gains(m, _at(m.uni, c.uni), _at(m.bi, c.bi), c.sent, c.lang), c.size)
        counts = c.size >= LEAST_WORDS
        allow = np.where(c.told[:, None], STRAY, np.ones((c.n, r.k)))
        allow[doc, sub] = 1
        allow[:, r.k - 1] = 1
        z = np.bincount(c.row[counts] * r.k + best[counts], minlength=c.n * r.k).reshape(c.n, r.k) * allow + np.where(c.told, 0.5, 0.0)[:, None] * start
        z /= np.maximum(z.sum(1, keepdims=True), 1e-9)
    return np.rint(z / UNIT) * UNIT


def _count(r: _Round, c: _Chunk) -> np.ndarray:
    """Documents by n-gram and class, words by language and class, words by language."""
    n_langs = len(languages.LANGS) + 1
    z = _weights(r, c)
    use = c.told if r.model is None else np.ones(c.n, bool)
    word_doc = c.row[c.sent]
    out = []
    for keys, gram in ((r.uni, c.uni), (r.bi, c.bi)):
        at = _at(keys, gram)
        ok = (at >= 0) & use[word_doc]
        doc, at = _distinct(word_doc[ok], at[ok], len(keys))
        out.append(np.stack([np.bincount(at, z[doc, k], len(keys)) for k in range(r.k)], 1).ravel())
    lang, doc, size = c.lang + 1, c.row, c.size * use[c.row]
    out.append(np.stack([np.bincount(lang, size * z[doc, k], n_langs) for k in range(r.k)], 1).ravel())
    return np.concatenate([*out, np.bincount(lang, size, n_langs)])


def fit(language: languages.Model, subjects: list[str], tok: DataFrame) -> Model:
    """Fit on the documents' words and subjects, see ``tokens``."""
    k, n_langs, sc = len(subjects) + 1, len(languages.LANGS) + 1, tok.sparkSession.sparkContext
    uni, bi, g, here = vocabulary(tok, k)
    cu, cb = np.flatnonzero(here.uni >= LEAST_UNI), np.flatnonzero(here.bi >= LEAST_BI)
    second = np.searchsorted(cu, g.second[cb])
    model = None
    for r in range(ROUNDS + 1):
        shared = sc.broadcast(_Round(model, k, uni[cu], bi[cb]))
        total = _sums(tok, (len(cu) + len(cb) + n_langs) * k + n_langs, shared, _count)
        by, by2, size, whole = np.split(total, np.cumsum([len(cu) * k, len(cb) * k, n_langs * k]))
        by, by2 = by.reshape(-1, k), by2.reshape(-1, k)
        share = (size.reshape(-1, k) + 0.5 / k) / (whole[:, None] + 0.5)  # [language, class]
        # the weights of a labelled document add up to one
        df, df2 = (np.rint(by.sum(1)), np.rint(by2.sum(1))) if r == 0 else (here.uni[cu], here.bi[cb])
        ur = np.zeros((len(uni), k), np.float32)
        ur[cu] = _shrunk(df, by, share[g.lang[cu]], LEAST_UNI)
        # what a bigram tells beyond its second word: its share of that word's documents of the class
        base = np.clip(by[second] / np.maximum(df[second], 1)[:, None], 1e-6, None)
        br = ur[g.second]
        br[cb] += _shrunk(df2, by2, base, LEAST_BI).astype(np.float32)
        model = _model(language, subjects, uni, bi, g, here, ur, br)._replace(language=None)
    # n-grams that say what the next shorter ones do not
    own_u = np.abs(model.uni_gain - model.other[g.lang]).max(1, initial=0) > 0.01
    own_b = np.abs(model.bi_gain - model.uni_gain[g.second]).max(1, initial=0) > 0.01
    model = model._replace(language=language, uni=uni[own_u], uni_gain=model.uni_gain[own_u], bi=bi[own_b], bi_gain=model.bi_gain[own_b])
    return model._replace(bound=_calibrate(model, tok))


def _choose(m: Model, g: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best subject of every sentence, or the number of subjects where none gains enough; and the gain per token."""
    none = len(m.subjects)
    if not len(g):
        return np.zeros(0, int), np.zeros(0)
    best = g[:, :none].argmax(1)
    gain = g[np.arange(len(g)), best] / np.maximum(size, 1)
    return np.where((gain >= m.bound[best]) & (gain > 0), best, none), gain


def classify(m: Model, s: Sentences) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every sentence the subject's index (the last: none), its gain per token and whether it counts."""
    sent, u, b, lang = _tokens(m.language, s)
    size = np.diff(s.word_off)
    best, gain = _choose(m, _gains(m, _at(m.uni, u), _at(m.bi, b), sent, lang), size)
    return best, gain, size >= LEAST_WORDS


def _agreement(m: Model, c: _Chunk) -> np.ndarray:
    """For every subject and step, labelled documents found rightly, and found; and documents labelled with the subject."""
    k, width = len(m.subjects), len(STEPS) + 1
    best, gain = _choose(m, _gains(m, _at(m.uni, c.uni), _at(m.bi, c.bi), c.sent, c.lang), c.size)
    counts = (c.size >= LEAST_WORDS) & c.told[c.row]
    total = np.maximum(np.bincount(c.row[counts], minlength=c.n), 1)
    truth = np.zeros((c.n, k), bool)
    truth[c.label] = True
    mine = counts & (best < k)
    # sentences by document, subject and the highest step they reach, summed from above
    reach = np.searchsorted(STEPS, gain[mine], side="right")
    cell, n = np.unique(c.row[mine] * k + best[mine], return_inverse=True)
    got = np.bincount(n * width + reach, minlength=len(cell) * width).reshape(-1, width)[:, ::-1].cumsum(1)[:, ::-1][:, 1:]
    doc, sub = cell // max(k, 1), cell % max(k, 1)
    got = got / total[doc][:, None] >= SHARE
    right, found = np.zeros((k, len(STEPS))), np.zeros((k, len(STEPS)))
    np.add.at(right, sub, got & truth[doc, sub][:, None])
    np.add.at(found, sub, got)
    return np.concatenate([right.ravel(), found.ravel(), truth.sum(0)])


def _calibrate(m: Model, tok: DataFrame) -> np.ndarray:
    """For each subject the gain per token above which its documents' sentences best agree with their labels."""
    k = len(m.subjects)
    shared = tok.sparkSession.sparkContext.broadcast(m._replace(language=None, bound=np.zeros(k)))
    right, found, truth = np.split(_sums(tok, k * (2 * len(STEPS) + 1), shared, _agreement), [k * len(STEPS), 2 * k * len(STEPS)])
    f = 2 * right.reshape(k, len(STEPS)) / np.maximum(found.reshape(k, len(STEPS)) + truth[:, None], 1)
    bound = np.zeros(k)
    for i in range(k):
        good = STEPS[f[i] >= f[i].max() - 0.005]
        bound[i] = good[len(good) // 2]
    return bound


def fit_subjects(docs: DataFrame, labels: DataFrame, subjects: DataFrame) -> Model:
    stated = subjects.select("subject").where("subject is not null").distinct()
    n = stated.count()
    if n > MOST_SUBJECTS:
        raise ValueError(f"{n} subjects; at most {MOST_SUBJECTS} models are made")
    names = sorted(r.subject for r in stated.collect())
    language = languages.fit_languages(docs)
    if language is None:  # no label names a language: one nameless language
        language = languages.fit(["a"], [0], len(languages.LANGS))
    return fit(language, names, tokens(docs, labels, names, language))


def subject_shares(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (doc_id, n_sentences, subjects): for each subject found the number and share of its
    sentences and their mean gain per token.  Texts without sentences, and nulls, have none."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MOST_CELLS gains
    kind = pa.struct([("subject", pa.string()), ("n", pa.int32()), ("share", pa.float64()), ("gain", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        k = len(m.subjects)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                b = batch.slice(at, 2000)
                s = sentences_of(b.column(1))
                rows = b.num_rows
                best, gain, counts = classify(m, s)
                row = np.repeat(np.arange(rows), np.diff(s.off))
                total = np.bincount(row[counts], minlength=rows)
                yes = counts & (best < k)
                cell = row[yes] * k + best[yes]
                n = np.bincount(cell, minlength=rows * k)
                mean = np.bincount(cell, gain[yes], minlength=rows * k) / np.maximum(n, 1)
                at_cell = np.flatnonzero(n)
                r = at_cell // k
                items = pa.StructArray.from_arrays(
                    [pa.array([m.subjects[x] for x in at_cell % k], pa.string()), pa.array(n[at_cell].astype(np.int32)), pa.array(n[at_cell] / np.maximum(total[r], 1)), pa.array(mean[at_cell])],
                    fields=list(kind),
                )
                off = np.searchsorted(r, np.arange(rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total.astype(np.int32)), pa.ListArray.from_arrays(pa.array(off), items)], names=["doc_id", "n_sentences", "subjects"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).where("doc_id is not null")
    return spread(src).mapInArrow(run, "doc_id long, n_sentences int, subjects array<struct<subject:string,n:int,share:double,gain:double>>")


def accepted(shares: DataFrame, min_share: float = SHARE) -> DataFrame:
    """(doc_id, subject, share, gain) of subjects with at least ``min_share`` of a document's sentences."""
    return shares.select("doc_id", F.inline("subjects")).where(F.col("share") >= min_share).select("doc_id", "subject", "share", "gain")
