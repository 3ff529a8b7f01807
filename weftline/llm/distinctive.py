"""How distinctive a term is for a record: parsimonious language models (problem 3).

A record's words are taken as drawn from a mixture of the record's own model and the background, the collection's
relative frequencies.  Expectation-maximisation separates the two: terms that the background explains lose their mass,
the converged own probability ranks the terms.

    E: e_t = tf_t * a * p_t / (a * p_t + (1 - a) * b_t)      M: p_t = e_t / sum(e)

Terms are counted inside each record by one vector pass per Arrow batch, so a record's words are never shuffled one by
one; frequencies are combined on the map side; the background, which grows with the vocabulary, is joined by an
equi-join (no estimate survives the cut before it, so only the adaptive planner may broadcast it, by measured size).
The EM runs on the flattened lists of many records at once.

Defined results: null and termless texts have no rows; equal texts are separate records; no score is cut off, so
every term of every record is returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.session import cut, spread

#: Weight of the record's own model; rounds of EM and the change at which they end.
OWN_WEIGHT, MAX_ROUNDS, TOLERANCE = 0.1, 60, 1e-7


def term_counts(df: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """(keys..., term, tf): terms are maximal runs of three or more letters of the lower-cased text."""
    src = df.select(*keys, F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(r"(\p{L}{3,})"), 1).alias("terms")).where("size(terms) > 0")
    n_keys = len(keys)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(n_keys)
            flat = pc.dictionary_encode(lists.flatten())
            row = pc.list_parent_indices(lists).to_numpy()
            v = max(len(flat.dictionary), 1)
            cell, tf = np.unique(row.astype(np.int64) * v + flat.indices.to_numpy(zero_copy_only=False), return_counts=True)
            at = pa.array(cell // v)
            cols = [b.column(i).take(at) for i in range(n_keys)] + [flat.dictionary.take(pa.array(cell % v)), pa.array(tf.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=[*keys, "term", "tf"])

    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField("term", T.StringType()), T.StructField("tf", T.IntegerType())])
    return spread(src).mapInArrow(count, schema)


def em(tf: np.ndarray, background: np.ndarray, off: np.ndarray, own: float = OWN_WEIGHT) -> np.ndarray:
    """Converged own probabilities of the terms of many records; record ``i`` has the places ``off[i]:off[i + 1]``."""
    if not len(tf):
        return np.zeros(0)
    start = off[:-1][off[:-1] < off[1:]]
    size = np.diff(np.concatenate([start, [len(tf)]]))
    per = lambda x: np.repeat(np.add.reduceat(x, start), size)
    p = tf / per(tf)
    for _ in range(MAX_ROUNDS):
        e = tf * (own * p) / (own * p + (1 - own) * background)
        new = e / per(e)
        done = np.abs(new - p).max() < TOLERANCE
        p = new
        if done:
            break
    return p


def distinctive_terms(df: DataFrame, keys: list[str], text_col: str = "text", own: float = OWN_WEIGHT) -> DataFrame:
    """(keys..., term, tf, df, score, background) for every term of every record; ``df`` counts records, ``score`` is
    the own probability after convergence and ``background`` the collection's.  A term is told apart from the
    collection where its score is the higher one: the others lost their mass.  ``keys`` must identify a record."""
    tf = cut(term_counts(df, keys, text_col))
    total = tf.agg(F.sum("tf")).first()[0] or 1
    background = tf.groupBy("term").agg(F.sum("tf").alias("__cf"), F.count(F.lit(1)).alias("df"))
    joined = tf.join(background, "term")
    records = joined.groupBy(*keys).agg(F.collect_list(F.struct("term", "tf", "df", "__cf")).alias("t"))
    n_keys = len(keys)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(n_keys)
            flat = lists.flatten()
            field = lambda n: flat.field(n)
            off = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            background = field("__cf").to_numpy() / total
            score = em(field("tf").to_numpy().astype(float), background, off, own)
            at = pc.list_parent_indices(lists)
            cols = [b.column(i).take(at) for i in range(n_keys)] + [field("term"), field("tf"), field("df"), pa.array(score), pa.array(background)]
            yield pa.RecordBatch.from_arrays(cols, names=[*keys, "term", "tf", "df", "score", "background"])

    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField("term", T.StringType()), T.StructField("tf", T.IntegerType()), T.StructField("df", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("background", T.DoubleType())])
    return records.mapInArrow(solve, schema)
