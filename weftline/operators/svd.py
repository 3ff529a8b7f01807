"""Truncated singular value decomposition of sparse features in long form, distributed by rows.

The range of the matrix is found by subspace iteration from random vectors: every pass multiplies by A and its transpose
inside the tasks, each with its own rows, and adds up matrices of vocabulary x rank in two levels.  The vocabulary is a
stated bound (features are limited before); rows are not bounded and never gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import cut

#: Terms a matrix may have; extra vectors carried along; passes over the data; rows of a partial result sent at once.
MOST_TERMS, EXTRA, PASSES, STRIP = 50_000, 10, 4, 1024
_CHUNK = 1000


def _chunks(b: pa.RecordBatch, n_keys: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, offsets, term numbers, values) of slices of a batch."""
    lists = b.column(n_keys)
    off = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
    flat = lists.flatten()
    at, val = flat.field("at").to_numpy(), flat.field("value").to_numpy().astype(np.float64)
    for lo in range(0, b.num_rows, _CHUNK):
        hi = min(lo + _CHUNK, b.num_rows)
        yield slice(lo, hi), off[lo : hi + 1] - off[lo], at[off[lo] : off[hi]], val[off[lo] : off[hi]]


def _times(off: np.ndarray, at: np.ndarray, val: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Sparse rows times a dense matrix."""
    y = np.zeros((len(off) - 1, q.shape[1]))
    full = np.flatnonzero(np.diff(off))
    if len(full):
        y[full] = np.add.reduceat(q[at] * val[:, None], off[full], axis=0)
    return y


def _summed(parts: DataFrame, m: int, width: int) -> np.ndarray:
    """Sum of the partial matrices (strip, part, x), in two levels."""

    def add(key: tuple, t: pa.Table) -> pa.Table:
        x = t.column("x").combine_chunks()
        total = x.flatten().to_numpy().reshape(len(x), -1).sum(0)
        return pa.table({"strip": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([0], pa.int32()), "x": pa.array([total], pa.list_(pa.float64()))})

    schema = "strip int, part int, x array<double>"
    once = parts.withColumn("part", F.col("part") % 16).groupBy("strip", "part").applyInArrow(add, schema)
    out = np.zeros((m, width))
    for r in once.groupBy("strip").applyInArrow(add, schema).toLocalIterator():
        strip = np.array(r.x).reshape(-1, width)
        out[r.strip * STRIP : r.strip * STRIP + len(strip)] = strip
    return out


def multiply(rows: DataFrame, keys: list[str], matrix: np.ndarray, name: str = "v") -> DataFrame:
    """(keys..., v): rows (keys..., e array<struct<at, value>>) times a dense matrix of bounded vocabulary x width."""
    n_keys, shared = len(keys), rows.sparkSession.sparkContext.broadcast(matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at_, off, at, val in _chunks(b, n_keys):
                y = _times(off, at, val, shared.value)
                part = b.slice(at_.start, at_.stop - at_.start)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1]), pa.array(y.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns[:n_keys], flat], names=[*keys, name])

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in keys), f"{name} array<double>"])
    return rows.select(*keys, "e").mapInArrow(run, schema)


class Decomposition:
    """Right singular vectors of a term matrix, with the rows' coordinates."""

    def __init__(self, rows: DataFrame, keys: list[str], vocab: DataFrame, sigma: np.ndarray, v: np.ndarray) -> None:
        self.rows, self.keys, self.vocab, self.sigma, self.v = rows, keys, vocab, sigma, v

    def coordinates(self, name: str = "v") -> DataFrame:
        """(keys..., v): each row times the right singular vectors, that is U times sigma."""
        return multiply(self.rows, self.keys, self.v, name)

    def weighted_means(self, tf: DataFrame, keys: list[str], weight: str, name: str = "v") -> DataFrame:
        """(keys..., v): means of the terms' vectors, right singular vectors times sigma, by ``weight``; rows without a
        known term are missing."""
        known = tf.select(*keys, "term", F.col(weight).cast("double").alias("__w")).join(self.vocab, "term")
        total = F.sum("__w").over(Window.partitionBy(*keys))
        rows = known.select(*keys, "at", (F.col("__w") / total).alias("value")).groupBy(*keys).agg(F.collect_list(F.struct("at", "value")).alias("e"))
        return multiply(rows, keys, self.v * self.sigma, name)

    def term_vectors(self) -> DataFrame:
        """(term, v) of the right singular vectors, from the bounded vocabulary."""
        spark = self.rows.sparkSession
        table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(self.v)], "at int, v array<double>")
        return self.vocab.join(table, "at").select("term", "v")


def truncated_svd(tf: DataFrame, keys: list[str], k: int, term: str = "term", value: str = "value", seed: int = 42) -> Decomposition:
    """The ``k`` leading right singular vectors of the matrix of rows ``keys`` and columns ``term``.

    Fewer are returned where the matrix has fewer columns; an empty table gives none.  Signs are such that the entry of
    largest size is positive.  More than ``MOST_TERMS`` terms are an error: limit the features first.
    """
    terms = cut(tf.select(F.col(term).alias("term")).distinct())
    m = terms.count()
    if m > MOST_TERMS:
        raise ValueError(f"{m} terms; at most {MOST_TERMS} are decomposed")
    vocab = cut(terms.select("term", (F.row_number().over(Window.orderBy("term")) - 1).alias("at")))  # a bounded vocabulary
    long = tf.select(*keys, F.col(term).alias("term"), F.col(value).cast("double").alias("value")).join(vocab, "term")
    rows = cut(long.groupBy(*keys).agg(F.collect_list(F.struct("at", "value")).alias("e")))
    width, n_keys, sc = min(k + EXTRA, m), len(keys), tf.sparkSession.sparkContext
    if not m:
        return Decomposition(rows, keys, vocab, np.zeros(0), np.zeros((0, 0)))
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(m, width)))[0]
    for _ in range(PASSES):
        shared = sc.broadcast(q)

        def back(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            from pyspark import TaskContext

            z = np.zeros((m, width))
            for b in batches:
                for _, off, at, val in _chunks(b, n_keys):
                    y = _times(off, at, val, shared.value)
                    by = np.argsort(at, kind="stable")
                    row = np.repeat(np.arange(len(y)), np.diff(off))[by]
                    cols, start = np.unique(at[by], return_index=True)
                    if len(cols):
                        z[cols] += np.add.reduceat(y[row] * val[by, None], start, axis=0)
            part = TaskContext.get().partitionId()
            for strip in range(-(-m // STRIP)):
                x = z[strip * STRIP : (strip + 1) * STRIP]
                if x.any():
                    yield pa.RecordBatch.from_arrays([pa.array([strip], pa.int32()), pa.array([part], pa.int32()), pa.array([x.ravel()], pa.list_(pa.float64()))], names=["strip", "part", "x"])

        q = np.linalg.qr(_summed(rows.mapInArrow(back, "strip int, part int, x array<double>"), m, width))[0]
        shared.unpersist()
    basis = sc.broadcast(q)

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        g = np.zeros((width, width))
        for b in batches:
            for _, off, at, val in _chunks(b, n_keys):
                y = _times(off, at, val, basis.value)
                g += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([g.ravel()], pa.list_(pa.float64()))], names=["strip", "part", "x"])

    gram = _summed(rows.mapInArrow(small, "strip int, part int, x array<double>"), width, width) if width <= STRIP else None
    if gram is None:
        raise ValueError(f"rank {width}; at most {STRIP} singular vectors are found")
    val, rot = np.linalg.eigh((gram + gram.T) / 2)
    order = np.argsort(-val)[: min(k, m)]
    v = q @ rot[:, order]
    v = v * np.where(v[np.abs(v).argmax(0), np.arange(v.shape[1])] < 0, -1, 1)
    return Decomposition(rows, keys, vocab, np.sqrt(np.maximum(val[order], 0)), v)


# ---- one matrix for each group -------------------------------------------------------------------------------------

#: Rows that a group may have: a group, as a request is one, is decomposed by one task.
MOST_ROWS = 200_000


def _subspace(off: np.ndarray, at: np.ndarray, val: np.ndarray, m: int, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(coordinates, singular values) of sparse rows, by the passes of the distributed form."""
    n, width = len(off) - 1, min(k + EXTRA, m, len(off) - 1)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(m, width)))[0]
    by = np.argsort(at, kind="stable")
    row = np.repeat(np.arange(n), np.diff(off))[by]
    back = np.searchsorted(at[by], np.arange(m + 1))

    def times(off_: np.ndarray, at_: np.ndarray, val_: np.ndarray, x: np.ndarray) -> np.ndarray:
        parts = [_times(off_[lo : lo + _CHUNK + 1] - off_[lo], at_[off_[lo] : off_[min(lo + _CHUNK, len(off_) - 1)]], val_[off_[lo] : off_[min(lo + _CHUNK, len(off_) - 1)]], x) for lo in range(0, len(off_) - 1, _CHUNK)]
        return np.concatenate(parts)

    for _ in range(PASSES):
        q = np.linalg.qr(times(back, row, val[by], times(off, at, val, q)))[0]
    y = times(off, at, val, q)
    val2, rot = np.linalg.eigh(y.T @ y)
    order = np.argsort(-val2)[:k]
    return y @ rot[:, order], np.sqrt(np.maximum(val2[order], 0))


def grouped_svd(long: DataFrame, group: str, id_col: str, k: int, term: str = "term", value: str = "value", seed: int = 42) -> DataFrame:
    """(group, id, v): each group's rows in the ``k`` leading singular dimensions of the group's own matrix, fewer where
    it has fewer rows or terms.  A group above ``MOST_ROWS`` rows is an error."""
    rows = long.groupBy(group, id_col).agg(F.collect_list(F.struct(F.xxhash64(term).alias("t"), F.col(value).cast("double").alias("x"))).alias("e"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(key: tuple, t: pa.Table) -> pa.Table:
        if t.num_rows > MOST_ROWS:
            raise ValueError(f"a group of {t.num_rows} rows; at most {MOST_ROWS} are decomposed together")
        t = t.sort_by(id_col)
        lists = t.column("e").combine_chunks()
        flat = lists.flatten()
        off = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
        terms, at = np.unique(flat.field("t").to_numpy(), return_inverse=True)
        y, _ = _subspace(off, at, flat.field("x").to_numpy(), len(terms), k, seed)
        v = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1]), pa.array(y.ravel()))
        return pa.table([t.column(group), t.column(id_col), v], names=[group, id_col, "v"])

    return rows.groupBy(group).applyInArrow(run, f"{group} {kinds[group]}, {id_col} {kinds[id_col]}, v array<double>")


def grouped_means(weights: DataFrame, vectors: DataFrame, group: str, id_col: str, weight: str) -> DataFrame:
    """(group, id, v): means of the vectors (group, term, v) of each row's terms (group, id, term, weight), inside groups."""
    rows = weights.groupBy(group, id_col).agg(F.collect_list(F.struct(F.xxhash64("term").alias("t"), F.col(weight).cast("double").alias("x"))).alias("e"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    known = vectors.select(group, F.xxhash64("term").alias("t"), "v")

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], left.schema.field(group).type), pa.array([], left.schema.field(id_col).type), pa.array([], pa.list_(pa.float64()))], names=[group, id_col, "v"])
        right = right.sort_by("t")
        names, m = right.column("t").to_numpy(), right.column("v").combine_chunks()
        m = m.flatten().to_numpy().reshape(len(names), -1)
        lists = left.column("e").combine_chunks()
        flat = lists.flatten()
        row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
        t, x = flat.field("t").to_numpy(), flat.field("x").to_numpy()
        at = np.minimum(np.searchsorted(names, t), len(names) - 1)
        yes = names[at] == t
        row, at, x = row[yes], at[yes], x[yes]
        total = np.bincount(row, x, len(lists))
        y = np.concatenate([_times(np.searchsorted(row[(row >= lo) & (row < lo + _CHUNK)], np.arange(lo, min(lo + _CHUNK, len(lists)) + 1)), at[(row >= lo) & (row < lo + _CHUNK)], x[(row >= lo) & (row < lo + _CHUNK)], m) for lo in range(0, len(lists), _CHUNK)])
        y = y / np.where(total > 0, total, 1)[:, None]
        v = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1]), pa.array(y.ravel()))
        return pa.table([left.column(group), left.column(id_col), v], names=[group, id_col, "v"])

    return rows.groupBy(group).cogroup(known.groupBy(group)).applyInArrow(run, f"{group} {kinds[group]}, {id_col} {kinds[id_col]}, v array<double>")
