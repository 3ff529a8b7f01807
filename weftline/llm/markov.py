"""Groups of mutually similar records by Markov clustering (problem 1).

Records are compared by their content words.  A word is a content word if neither neighbour predicts it: the mean
surprisal of the word after its predecessor and before its successor, measured over the distinct texts of the request,
is at least ``SURPRISAL`` times the entropy of the request's words.  Phrases that everybody uses are predictable and
drop out; names and matters remain.  Content words are weighted by their rarity inside the request, vectors have unit
length.  Nothing of one request depends on another.

Texts with the same words are one representative with a weight, before anything is counted or compared; they are told
apart again at the end.  So copies fill no neighbour lists, and a text counts once however often it is repeated.

The similarity graph links each representative to its ``KNN`` most similar ones of at least ``LEAST_COS``.  Candidates
come from an index of rare words: words are ordered by rarity, and a record is listed under the shortest head of its
words such that the rest has a norm below ``LEAST_COS``; two records of that cosine share a word of both heads.  The
lists are packed into cells of about ``CELL`` entries, and a cell computes exact cosines of its members.  A list above
``CELL`` entries is cut into parts of half a cell, and every two parts are a cell: no neighbour is missed.  Work and
shuffle grow with the number of entries, those of such a list with its square.

Markov clustering then alternates squaring of the column-stochastic matrix, inflation, and pruning of the entries below
``SMALL``, however many others a column has, until it stops changing.  The row with the largest entry of a column is its attractor;
columns with one attractor are a cluster.  Members far from the centre of the others are strays, and clusters below
``LEAST_SIZE`` texts are dissolved.  Typical members are those that received the most flow after two expansions.

Squaring is distributed by blocks of columns: in a round every block meets the columns it refers to, which bounds a
task by ``COLUMN_BLOCK * KEEP`` columns of ``KEEP`` entries, and by the request's columns.  After the first two rounds a block that refers to nothing
outside itself goes on where it is, since nothing would be sent to it; the arithmetic and the stop rule are the same, so
the result does not depend on the blocks.  A request takes part until all its columns are still; one that is not after
``MAX_ROUNDS`` rounds is reported by a warning and used as it is.

Defined results: null and blank texts, texts under ``LEAST_WORDS`` words and texts without content words are in no
group (-1); equal texts are separate records of one group.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm import words as wd
from weftline.llm.sentences import sentences_of
from weftline.session import cut, spread

KNN, LEAST_COS, SHARPEN = 20, 0.3, 3
INFLATION, SMALL, MAX_ROUNDS = 1.6, 1e-3, 80
#: As many entries of at least ``SMALL`` as a column of sum 1 can have: none is dropped for being one of many.
KEEP = round(1 / SMALL)
SURPRISAL, LEAST_WORDS, LEAST_SIZE, LEAST_CENTRE = 0.58, 5, 8, 0.27
CELL, COLUMN_BLOCK = 16_384, 8192
_KEY = ["request_id"]


# ---- words ---------------------------------------------------------------------------------------------------------


def _lists(off: np.ndarray, x: np.ndarray | pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(x))


def _word_rows(texts: DataFrame) -> DataFrame:
    """(request_id, pos, n_words, h1, h2, seq) of every text: its words in order with a 0 after every sentence, and two
    hashes of that sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                b = batch.slice(at, 4000)
                s = sentences_of(b.column(2))
                n = np.diff(s.word_off)
                h = s.word_hash[s.word_off[0] : s.word_off[-1]]
                seq = np.insert(h, np.cumsum(n), np.uint64(0)) if len(n) else np.zeros(0, np.uint64)
                ends = np.concatenate([[0], np.cumsum(n + 1)])[s.off]  # of the rows, in seq
                place = np.arange(len(seq)) - np.repeat(ends[:-1], np.diff(ends))
                total = lambda k: np.diff(np.concatenate([np.zeros(1, np.uint64), np.cumsum(wd.mix(seq + wd.mix(np.uint64(k) + place.astype(np.uint64))), dtype=np.uint64)])[ends])  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(s.row_words.astype(np.int32)), pa.array(total(1 << 20).view(np.int64)), pa.array(total(1 << 40).view(np.int64)), _lists(ends, seq.view(np.int64))],
                    names=["request_id", "pos", "n_words", "h1", "h2", "seq"],
                )

    return spread(texts.select("request_id", "pos", "text")).mapInArrow(run, "request_id long, pos int, n_words int, h1 long, h2 long, seq array<long>")


def _word_pairs(reps: DataFrame) -> DataFrame:
    """(request_id, w1, w2, n): how often a word follows another in distinct texts, 0 for an edge of a sentence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seq = b.column(1)
            w = seq.flatten().to_numpy()
            row = np.repeat(b.column(0).to_numpy(), seq.value_lengths().to_numpy(zero_copy_only=False))
            prev = np.concatenate([np.zeros(1, np.int64), w[:-1]]) if len(w) else w
            cells, n = np.unique(np.stack([row, prev, w], 1), axis=0, return_counts=True) if len(w) else (np.zeros((0, 3), np.int64), np.zeros(0, int))
            yield pa.RecordBatch.from_arrays([pa.array(cells[:, 0]), pa.array(cells[:, 1]), pa.array(cells[:, 2]), pa.array(n)], names=["request_id", "w1", "w2", "n"])

    out = reps.select("request_id", "seq").mapInArrow(run, "request_id long, w1 long, w2 long, n long")
    return out.where("w1 <> 0 or w2 <> 0").groupBy("request_id", "w1", "w2").agg(F.sum("n").alias("n"))


def content_words(pairs: DataFrame, least: float = SURPRISAL) -> DataFrame:
    """(request_id, word): words whose mean surprisal given either neighbour is at least ``least`` times the entropy of
    the request's words."""
    p = cut(pairs)
    left = p.groupBy(*_KEY, "w1").agg(F.sum("n").alias("t1"))
    right = p.groupBy(*_KEY, "w2").agg(F.sum("n").alias("t2"))
    q = p.join(left, [*_KEY, "w1"]).join(right, [*_KEY, "w2"])
    mean = lambda total: F.sum(-F.col("n") * F.log(F.col("n") / F.col(total))) / F.sum("n")
    after = q.groupBy(*_KEY, F.col("w2").alias("word")).agg(mean("t1").alias("a"))
    before = q.groupBy(*_KEY, F.col("w1").alias("word")).agg(mean("t2").alias("b"))
    counts = right.where("w2 <> 0")
    # entropy: log N - sum(n log n) / N
    entropy = counts.groupBy(*_KEY).agg((F.log(F.sum("t2")) - F.sum(F.col("t2") * F.log("t2")) / F.sum("t2")).alias("h"))
    told = after.join(before, [*_KEY, "word"]).join(entropy, _KEY)
    return told.where(f"least(a, b) >= {least} * h and word <> 0").select(*_KEY, "word")


def representatives(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Membership (request_id, pos, rep) of all texts, and (request_id, pos, n_words, weight, seq) of those that stand
    for the texts of the same words, by the smallest position."""
    rows = cut(_word_rows(texts))
    same = [*_KEY, "h1", "h2"]
    first = rows.groupBy(*same).agg(F.min("pos").alias("rep"), F.count(F.lit(1)).alias("weight"))
    member = cut(rows.select(*same, "pos").join(first, same).select(*_KEY, "pos", "rep", "weight"))
    mine = member.where("pos = rep").select(*_KEY, "pos", "weight")
    return member.select(*_KEY, "pos", "rep"), rows.drop("h1", "h2").join(mine, [*_KEY, "pos"])


def vectors(reps: DataFrame) -> DataFrame:
    """(request_id, pos, word, val, df): unit vectors of content words; ``df`` counts representatives."""
    words = content_words(_word_pairs(reps))
    told = reps.where(f"n_words >= {LEAST_WORDS}").select(*_KEY, "pos", F.explode("seq").alias("word")).where("word <> 0").groupBy(*_KEY, "pos", "word").agg(F.count(F.lit(1)).alias("tf"))
    told = cut(told.join(words, [*_KEY, "word"], "left_semi"))
    size = reps.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("size"))
    df = told.groupBy(*_KEY, "word").agg(F.count(F.lit(1)).alias("df")).join(size, _KEY).select(*_KEY, "word", "df", F.log((F.col("size") + 1) / F.col("df")).alias("idf"))
    # a word of one representative links nothing but is all that a text without neighbours, but with copies, may have
    val = told.join(df, [*_KEY, "word"]).select(*_KEY, "pos", "word", ((1 + F.log("tf")) * F.col("idf")).alias("val"), "df")
    several = Window.partitionBy(*_KEY, "pos")
    val = val.withColumn("shared", F.max("df").over(several) > 1).where("df > 1 or not shared").drop("shared")
    return val.withColumn("val", (F.col("val") / F.sqrt(F.sum(F.col("val") * F.col("val")).over(several))).cast("float"))


# ---- graph ---------------------------------------------------------------------------------------------------------


def _heads(rows: DataFrame, least: float) -> DataFrame:
    """Adds ``keys``: the rarest words of each vector up to where the rest has a norm below ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            n = lists.value_lengths().to_numpy(zero_copy_only=False)
            word, df = lists.flatten().to_numpy(), b.column(4).flatten().to_numpy()
            val = b.column(3).flatten().to_numpy().astype(np.float64)
            row = np.repeat(np.arange(len(n)), n)
            by = np.lexsort((word, -df, row))  # commonest first: the norm of the rest grows along it
            off = np.concatenate([[0], np.cumsum(n)])
            run_ = np.cumsum(val[by] ** 2)
            rest = run_ - np.repeat(np.concatenate([[0], run_])[off[:-1]], n)
            head = rest >= least * least * (1 - 1e-6)
            keys = word[by][head]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], _lists(np.searchsorted(row[by][head], np.arange(len(n) + 1)), keys)], names=["request_id", "pos", "words", "vals", "keys"])

    return rows.select("request_id", "pos", "words", "vals", "dfs").mapInArrow(run, "request_id long, pos int, words array<long>, vals array<float>, keys array<long>")


def _cells(rows: DataFrame, cell: int) -> DataFrame:
    """(request_id, list, cell, pos): the cells in which each record is compared; ``list`` is 0 where a cell holds whole
    lists, else the word of the long list that it holds two parts of."""
    post = rows.select(*_KEY, "pos", F.explode("keys").alias("key"))
    count = cut(post.groupBy(*_KEY, "key").agg(F.count(F.lit(1)).alias("n")))
    # at least three parts, so that two records of one part meet in the cell of that part and another
    hot = count.where(F.col("n") > cell).select(*_KEY, "key", F.ceil(2 * F.col("n") / cell).cast("int").alias("parts"))
    number = count.where(F.col("n") <= cell).groupBy(*_KEY).agg(F.ceil(F.sum("n") / cell).alias("cells"))
    plain = post.join(hot, [*_KEY, "key"], "left_anti").join(number, _KEY)
    plain = plain.select(*_KEY, F.lit(0).cast("long").alias("list"), F.pmod(F.xxhash64("key"), "cells").alias("cell"), "pos").distinct()
    part = post.join(hot, [*_KEY, "key"]).withColumn("part", F.pmod(F.xxhash64("pos", "key"), "parts"))
    part = part.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("part <> other")
    pair = F.least("part", "other") * F.col("parts") + F.greatest("part", "other")
    return plain.unionByName(part.select(*_KEY, F.col("key").alias("list"), pair.alias("cell"), "pos"))


def _similar(key: tuple, t: pa.Table) -> pa.Table:
    """The ``KNN`` best of each member of a cell among the others, from its posting lists."""
    t = t.sort_by("pos")
    pos, lists = t.column("pos").to_numpy(), t.column("words").combine_chunks()
    n = len(pos)
    off = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
    word, val = lists.flatten().to_numpy(), t.column("vals").combine_chunks().flatten().to_numpy().astype(np.float64)
    row = np.repeat(np.arange(n), np.diff(off))
    by = np.lexsort((word, row))
    word, val = word[by], val[by]
    _, w = np.unique(word, return_inverse=True)
    by = np.argsort(w, kind="stable")
    start = np.searchsorted(w[by], np.arange(w.max(initial=-1) + 2))
    p_row, p_val = row[by], val[by]
    size = np.diff(start)[w]  # entries of the posting list of each entry's word
    work = np.concatenate([[0], np.cumsum(size)])[off]
    out, lo = [], 0
    while lo < n:
        # as many rows as keep the products and the table of sums small
        hi = min(n, lo + max(1, 4_000_000 // n), max(lo + 1, int(np.searchsorted(work, work[lo] + 8_000_000, "right")) - 1))
        a, b = off[lo], off[hi]
        many = size[a:b]
        src = np.repeat(start[w[a:b]] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        flat = np.repeat((row[a:b] - lo) * n, many) + p_row[src]
        c = np.bincount(flat, np.repeat(val[a:b], many) * p_val[src], (hi - lo) * n)
        at = np.flatnonzero(c >= LEAST_COS)
        r, k = at // n, at % n
        keep = r + lo != k
        r, k, s = r[keep], k[keep], np.rint(c[at[keep]] * 1e5)
        best = np.lexsort((k, -s, r))
        r, k, s = r[best], k[best], s[best]
        top = np.arange(len(r)) - np.searchsorted(r, r) < KNN
        out.append((pos[lo + r[top]], pos[k[top]], s[top] / 1e5))
        lo = hi
    i, j, s = (np.concatenate(z) for z in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    return pa.table([pa.array(np.full(len(i), key[0].as_py(), np.int64)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(s.astype(np.float32))], names=["request_id", "pos", "other", "sim"])


def similarity_graph(vec: DataFrame, cell: int = CELL) -> DataFrame:
    """(request_id, pos, other, sim): each record's ``KNN`` most similar ones, in both directions."""
    rows = vec.groupBy(*_KEY, "pos").agg(F.collect_list(F.struct("word", "val", "df")).alias("w"))
    rows = rows.select(*_KEY, "pos", F.col("w.word").alias("words"), F.col("w.val").alias("vals"), F.col("w.df").alias("dfs"))
    rows = cut(_heads(rows, LEAST_COS))
    placed = _cells(rows, cell).join(rows.drop("keys"), [*_KEY, "pos"])
    near = placed.groupBy(*_KEY, "list", "cell").applyInArrow(_similar, "request_id long, pos int, other int, sim float")
    # a pair that meets in several cells has the same similarity in each, hence one rank
    best = Window.partitionBy(*_KEY, "pos").orderBy(F.desc("sim"), "other")
    near = near.withColumn("r", F.dense_rank().over(best)).where(F.col("r") <= KNN).drop("r")
    back = near.select(*_KEY, F.col("other").alias("pos"), F.col("pos").alias("other"), "sim")
    return near.unionByName(back).distinct()


# ---- Markov clustering ---------------------------------------------------------------------------------------------

_COLS = "request_id long, col int, blk int, rows array<int>, vals array<float>"


def _start(edges: DataFrame, block: int) -> DataFrame:
    """Column-stochastic start matrix: sharpened similarities, and self-loops as strong as the strongest link."""
    e = edges.select(*_KEY, F.col("pos").alias("col"), F.col("other").alias("row"), F.pow(F.col("sim").cast("double"), F.lit(SHARPEN)).alias("v"))
    loops = e.groupBy(*_KEY, "col").agg(F.max("v").alias("v")).select(*_KEY, "col", F.col("col").alias("row"), "v")
    cols = e.unionByName(loops).groupBy(*_KEY, "col").agg(F.array_sort(F.collect_list(F.struct("row", "v"))).alias("e"), F.sum("v").alias("t"))
    return cols.select(*_KEY, "col", F.floor(F.col("col") / block).cast("int").alias("blk"), F.col("e.row").alias("rows"), F.transform("e.v", lambda v: (v / F.col("t")).cast("float")).alias("vals"))


def expand(k_off: np.ndarray, k_row: np.ndarray, k_val: np.ndarray, ids: np.ndarray, off: np.ndarray, row: np.ndarray, val: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One round for a block of columns: square, inflate, prune.

    ``k_*``: the block's columns; ``ids, off, row, val``: the columns they refer to.  Returns the new columns.
    """
    n_k = len(k_off) - 1
    names, row_at = np.unique(row, return_inverse=True)
    at = np.searchsorted(ids, k_row)
    size = np.diff(off)[at]
    width = max(len(names), 1)
    step = max(1, 3_000_000 // width)
    out_n, out_r, out_v = [], [], []
    for lo in range(0, n_k, step):
        hi = min(lo + step, n_k)
        a, b = k_off[lo], k_off[hi]
        n = size[a:b]
        src = np.repeat(off[at[a:b]] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        col = np.repeat(np.arange(hi - lo), np.diff(k_off[lo : hi + 1]))
        acc = np.bincount(np.repeat(col, n) * width + row_at[src], np.repeat(k_val[a:b], n) * val[src], (hi - lo) * width)
        cell = np.flatnonzero(acc)
        v = acc[cell] ** INFLATION
        c = cell // width
        v /= np.bincount(c, v, hi - lo)[c]
        keep = v >= SMALL
        cell, v, c = cell[keep], v[keep], c[keep]
        v = v / np.bincount(c, v, hi - lo)[c]
        out_n.append(np.bincount(c, minlength=hi - lo))
        out_r.append(names[cell % width])
        out_v.append(v)
    off_new = np.concatenate([[0], np.cumsum(np.concatenate(out_n))]) if out_n else np.zeros(1, int)
    return off_new, np.concatenate(out_r) if out_r else np.zeros(0, int), np.concatenate(out_v) if out_v else np.zeros(0)


def _unpack(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    t = t.sort_by("col").combine_chunks()
    rows = t.column("rows").combine_chunks()
    return t.column("col").to_numpy(), rows.offsets.to_numpy() - rows.offsets[0].as_py(), rows.flatten().to_numpy(), t.column("vals").combine_chunks().flatten().to_numpy().astype(np.float64)


def _pack(request: int, col: np.ndarray, blk: np.ndarray, off: np.ndarray, row: np.ndarray, val: np.ndarray, more: dict[str, np.ndarray] | None = None) -> pa.Table:
    lists = lambda x: pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(x))
    cols = [pa.array(np.full(len(col), request, np.int64)), pa.array(col.astype(np.int32)), pa.array(blk.astype(np.int32)), lists(row.astype(np.int32)), lists(val.astype(np.float32))]
    return pa.table([*cols, *(pa.array(v) for v in (more or {}).values())], names=["request_id", "col", "blk", "rows", "vals", *(more or {})])


def _changed(off: np.ndarray, row: np.ndarray, val: np.ndarray, off2: np.ndarray, row2: np.ndarray, val2: np.ndarray) -> bool:
    return len(row) != len(row2) or not np.array_equal(off, off2) or not np.array_equal(row, row2) or bool(len(val) and np.abs(val - val2).max() > 1e-3)


def _block_rounds(key: tuple, mine: pa.Table, refs: pa.Table, most: int) -> pa.Table:
    """Up to ``most`` rounds of a block: one with the columns it was sent, more as long as it refers to nothing else."""
    col, off, row, val = _unpack(mine)
    ids, r_off, r_row, r_val = _unpack(refs)
    closed = bool(np.isin(row, col).all())
    for _ in range(most if closed else 1):
        off2, row2, val2 = expand(off, row, val, ids, r_off, r_row, r_val)
        val2 = val2.astype(np.float32).astype(np.float64)
        same = not _changed(off, row, val, off2, row2, val2)
        off, row, val = off2, row2, val2
        ids, r_off, r_row, r_val = col, off, row, val
        if same:
            break
    return _pack(key[0].as_py(), col, np.full(len(col), key[1].as_py()), off, row, val, {"still": np.full(len(col), same)})


def _step(m: DataFrame, most: int) -> DataFrame:
    """One distributed round: every block of columns meets the columns it refers to."""
    need = m.select(*_KEY, F.col("blk").alias("to"), F.explode("rows").alias("col")).distinct()
    refs = need.join(m, [*_KEY, "col"]).select(*_KEY, F.col("to").alias("blk"), "col", "rows", "vals")
    run = lambda key, mine, other: _block_rounds(key, mine, other, most)
    return m.groupBy(*_KEY, "blk").cogroup(refs.toDF(*refs.columns).groupBy(*_KEY, "blk")).applyInArrow(run, _COLS + ", still boolean")


def markov(edges: DataFrame, block: int = COLUMN_BLOCK) -> DataFrame:
    """(request_id, pos, cluster, flow): ``cluster`` is the position of the record's attractor."""
    m = cut(_start(edges, block)).withColumn("still", F.lit(False))
    for r in range(MAX_ROUNDS):
        if r == 2:
            flow = cut(m.select(*_KEY, F.explode(F.arrays_zip("rows", "vals")).alias("e")).groupBy(*_KEY, F.col("e.rows").alias("col")).agg(F.sum(F.col("e.vals").cast("double")).alias("flow")))
        if r < 2:
            m = cut(_step(m.drop("still"), 1))
            continue
        moving = m.groupBy(*_KEY).agg(F.min("still").alias("all_still")).where("not all_still").select(*_KEY)
        live, rest = m.join(moving, _KEY, "left_semi"), m.join(moving, _KEY, "left_anti")
        m = cut(_step(live.drop("still"), MAX_ROUNDS).unionByName(rest))
        if m.where("not still").isEmpty():
            break
    else:
        warnings.warn(f"some requests still change after {MAX_ROUNDS} rounds", RuntimeWarning, stacklevel=2)
    best = F.element_at(F.array_sort(F.transform(F.arrays_zip("rows", "vals"), lambda e: F.struct((-e.vals).alias("v"), e.rows.alias("row")))), 1)
    m = m.join(flow, [*_KEY, "col"], "left")
    out = m.where("size(rows) > 0").select(*_KEY, F.col("col").alias("pos"), best["row"].alias("attractor"), F.coalesce("flow", F.lit(0.0)).alias("flow"))
    # an attractor may itself flow to a stronger one of its system
    up = out.select(*_KEY, F.col("pos").alias("attractor"), F.col("attractor").alias("upper"))
    return out.join(up, [*_KEY, "attractor"], "left").select(*_KEY, "pos", F.coalesce("upper", "attractor").alias("cluster"), "flow")


def group_texts(texts: DataFrame, cell: int = CELL, column_block: int = COLUMN_BLOCK) -> DataFrame:
    """(request_id, pos, cluster, flow, closeness) of the records that belong to a group."""
    member, reps = representatives(texts)
    weight = reps.select(*_KEY, "pos", "weight")
    vec = cut(vectors(reps))
    found = markov(similarity_graph(vec, cell), column_block)
    # a representative without neighbours is a cluster of its copies
    alone = vec.select(*_KEY, "pos").distinct().join(found.select(*_KEY, "pos"), [*_KEY, "pos"], "left_anti")
    found = found.unionByName(alone.select(*_KEY, "pos", F.col("pos").alias("cluster"), F.lit(0.0).alias("flow"))).join(weight, [*_KEY, "pos"])
    found = cut(found)
    x = vec.join(found.select(*_KEY, "pos", "cluster", "weight"), [*_KEY, "pos"])
    centre = x.groupBy(*_KEY, "cluster", "word").agg(F.sum(F.col("val") * F.col("weight")).alias("g"))
    norm = centre.groupBy(*_KEY, "cluster").agg(F.sum(F.col("g") * F.col("g")).alias("gg"))
    dot = x.join(centre, [*_KEY, "cluster", "word"]).groupBy(*_KEY, "cluster", "pos", "weight").agg(F.sum(F.col("val") * F.col("g")).alias("gx"))
    # the centre of the others, copies among them: g - x, with |x| = 1
    others = F.sqrt(F.greatest(F.col("gg") - 2 * F.col("gx") + 1, F.lit(1e-12)))
    close = dot.join(norm, [*_KEY, "cluster"]).select(*_KEY, "cluster", "pos", "weight", ((F.col("gx") - 1) / others).alias("closeness")).where(F.col("closeness") >= LEAST_CENTRE)
    enough = close.groupBy(*_KEY, "cluster").agg(F.sum("weight").alias("size")).where(F.col("size") >= LEAST_SIZE).select(*_KEY, "cluster")
    kept = close.join(enough, [*_KEY, "cluster"], "left_semi").drop("weight").join(found.select(*_KEY, "pos", "flow"), [*_KEY, "pos"])
    kept = kept.select(*_KEY, F.col("pos").alias("rep"), "cluster", "flow", "closeness")
    return cut(member.join(kept, [*_KEY, "rep"]).select(*_KEY, "pos", "cluster", "flow", "closeness"))


def request_texts(requests: DataFrame) -> DataFrame:
    """(request_id, pos, text) of every element of every request."""
    return requests.select(F.col("request_id").cast("long").alias("request_id"), F.posexplode("texts").alias("pos", "text")).where("request_id is not null")


def describe(groups: DataFrame, texts: DataFrame, typical: int = 3) -> DataFrame:
    """(request_id, cluster, size, typical): groups with their most typical texts, strongest flow first."""
    w = Window.partitionBy(*_KEY, "cluster").orderBy(F.desc("flow"), F.desc("closeness"), "pos")
    top = groups.withColumn("r", F.row_number().over(w)).where(F.col("r") <= typical).join(texts, [*_KEY, "pos"])
    top = top.groupBy(*_KEY, "cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "text"))), lambda s: s.text).alias("typical"))
    return groups.groupBy(*_KEY, "cluster").agg(F.count(F.lit(1)).cast("int").alias("size")).join(top, [*_KEY, "cluster"])


def responses(groups: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, cluster_ids): one label per text in the request's order, dense from 0, -1 for no group."""
    dense = Window.partitionBy(*_KEY).orderBy("cluster")
    ids = groups.select(*_KEY, "cluster").distinct().withColumn("label", (F.dense_rank().over(dense) - 1).cast("int"))
    labels = groups.join(ids, [*_KEY, "cluster"]).groupBy(*_KEY).agg(F.map_from_entries(F.collect_list(F.struct("pos", "label"))).alias("m"))
    src = requests.select(F.col("request_id").cast("long").alias("request_id"), F.size("texts").alias("n")).where("request_id is not null and n >= 0")
    spots = F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.array().cast("array<int>"))
    return src.join(labels, _KEY, "left").select(*_KEY, F.transform(spots, lambda i: F.coalesce(F.try_element_at("m", i), F.lit(-1))).alias("cluster_ids"))
