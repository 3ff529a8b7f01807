"""Near-duplicate records with small edits by covering locality-sensitive hashing (problem 6).

A record is the set of its distinct runs of ``shingle`` successive words; one of fewer words is the set of the one run
of all its words.  ``parts * width`` minimum hashes sketch the
set.  The sketch is cut into parts of ``width = 2 ** (radius + 1) - 1`` coordinates; inside a part, coordinate ``i``
carries the non-zero vector ``i + 1`` of GF(2)^(radius+1), and table ``v`` reads the coordinates whose inner product
with ``v`` is odd.  For any ``radius`` coordinates there is a ``v`` orthogonal to all of their vectors, so two sketches
that differ in at most ``radius`` coordinates of some part are certain to agree on all that some table reads: this is
the covering property.  With the default radius 2 a part is a Fano plane: 7 coordinates, 7 tables, 4 read by each.

Sketches differ in a coordinate with probability 1 - J, so a pair of Jaccard similarity 0.5 is covered by one part
with probability 0.28 and by 16 parts with 0.995; at 0.55 it is 0.9995.  At 0.8 one part covers with 0.875 and four with
0.9998.  ``parts_for`` gives the least number of parts that keeps the chance to miss a pair at the threshold below a
bound, so a record is listed under no more keys than that takes.  Every candidate is verified exactly on the sets of
hashes.

Defined results: null ids and texts, and texts of fewer than ``min_words`` words, take no part.  Records with equal
sets form one class before any pairing, represented by the smallest id, so copies cost one representative however
many there are.  There is no cap on buckets: a bucket is an equi-join key, split by the adaptive skew join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import words
from weftline.operators.graph import connected_components
from weftline.session import cut, spread


def parts_for(similarity: float, radius: int, miss: float) -> int:
    """Least number of parts that leaves a pair of this similarity uncovered with at most the chance ``miss``."""
    width = 2 ** (radius + 1) - 1
    agree = [sum(1 << i for i in range(width) if not bin((v + 1) & (i + 1)).count("1") & 1) for v in range(width)]
    # a pattern of differing coordinates is covered if some table reads none of them
    hit = [bin(d).count("1") for d in range(1 << width) if any(d & a == d for a in agree)]
    covered = sum(similarity ** (width - k) * (1 - similarity) ** k for k in hit)
    return max(1, int(np.ceil(np.log(miss) / np.log(max(1 - covered, 1e-12)))))


def _whole(w: words.Words, rows: np.ndarray) -> np.ndarray:
    """A hash of all words of each of the rows, in order; it depends on their number."""
    count = np.diff(w.off)[rows]
    h = words.mix(count.astype(np.uint64))
    for k in range(count.max()):
        more = np.flatnonzero(count > k)
        h[more] = words.mix(h[more] * np.uint64(0x9E3779B97F4A7C15) + w.hash[w.off[rows[more]] + k])
    return h


def _sets(df: DataFrame, id_col: str, text_col: str, shingle: int, min_words: int, parts: int, radius: int) -> DataFrame:
    """(id, h, sh, bands): class digest, sorted shingle hashes, and covering keys of every record that takes part."""
    width = 2 ** (radius + 1) - 1
    odd = np.array([[bin((v + 1) & (i + 1)).count("1") & 1 for i in range(width)] for v in range(width)], bool)
    mult = words.mix(np.arange(1, parts * width + 1, dtype=np.uint64)) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                b = batch.slice(at, 2000)
                w = words.words_of(b.column(1))
                h, off = words.shingles(w, shingle)
                n = np.diff(off)
                few = np.flatnonzero((n == 0) & (np.diff(w.off) > 0))
                if len(few):
                    # one shingle of all words, in the place of the runs that the row does not have
                    h = np.insert(h, off[few], _whole(w, few))
                    n[few] = 1
                pick = np.flatnonzero((np.diff(w.off) >= min_words) & (n > 0))
                if not len(pick):
                    continue
                mine = np.repeat(np.isin(np.arange(len(n)), pick), n)
                h, n = h[mine], n[pick]
                start = np.concatenate([[0], np.cumsum(n)])
                sketch = np.empty((len(pick), parts * width), np.uint64)
                for k, m in enumerate(mult):
                    sketch[:, k] = np.minimum.reduceat(h * m, start[:-1])
                keys = np.empty((len(pick), parts * width), np.uint64)
                for p in range(parts):
                    part = words.mix(sketch[:, p * width : (p + 1) * width])
                    for v in range(width):
                        k = np.full(len(pick), p * width + v + 1, np.uint64)
                        for i in np.flatnonzero(odd[v]):
                            k = words.mix(k * np.uint64(0x9E3779B97F4A7C15) + part[:, i])
                        keys[:, p * width + v] = k
                digest = np.add.reduceat(words.mix(h + np.uint64(1)), start[:-1])
                digest2 = np.bitwise_xor.reduceat(words.mix(h + np.uint64(2)), start[:-1])
                lists = lambda off, x: pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(x.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(pa.array(pick)),
                        pa.array(digest.view(np.int64)),
                        pa.array(digest2.view(np.int64)),
                        lists(start, np.ascontiguousarray(h)),
                        lists(np.arange(len(pick) + 1) * parts * width, keys.ravel()),
                    ],
                    names=["id", "h1", "h2", "sh", "bands"],
                )

    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).where("id is not null and t is not null")
    return spread(src).mapInArrow(run, "id long, h1 long, h2 long, sh array<long>, bands array<long>")


def similar_sets(
    df: DataFrame,
    id_col: str,
    text_col: str,
    shingle: int = 5,
    num: int = 4,
    den: int = 5,
    min_words: int = 1,
    miss: float = 0.0005,
    radius: int = 2,
) -> tuple[DataFrame, DataFrame]:
    """Membership (id, rep) of every record that takes part, and links (a, b, inter, size_a, size_b) with a < b
    between representatives whose sets have a Jaccard similarity of at least ``num / den``; one at the threshold is
    missed with the chance ``miss``."""
    parts = parts_for(num / den, radius, miss)
    sets = cut(_sets(df, id_col, text_col, shingle, min_words, parts, radius))
    first = sets.groupBy("h1", "h2").agg(F.min("id").alias("rep"))
    member = cut(sets.select("id", "h1", "h2").join(first, ["h1", "h2"]).select("id", "rep"))
    reps = sets.join(member.where("id = rep").select("id"), "id", "left_semi")
    keys = reps.select("id", F.size("sh").alias("n"), F.explode("bands").alias("key"))
    x, y = (keys.select("key", F.col("id").alias(i), F.col("n").alias(m)) for i, m in (("a", "na"), ("b", "nb")))
    fits = (F.col("a") < F.col("b")) & (F.col("na") * den >= F.col("nb") * num) & (F.col("nb") * den >= F.col("na") * num)
    pairs = cut(x.join(y.hint("merge"), "key").where(fits).select("a", "b").distinct())
    sh = reps.select("id", "sh")
    both = pairs.join(sh.select(F.col("id").alias("a"), F.col("sh").alias("sa")), "a").join(sh.select(F.col("id").alias("b"), F.col("sh").alias("sb")), "b")
    both = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("inter"), F.size("sa").alias("size_a"), F.size("sb").alias("size_b"))
    links = both.where(F.col("inter") * den >= (F.col("size_a") + F.col("size_b") - F.col("inter")) * num)
    return member, links


def similar_pairs(member: DataFrame, links: DataFrame, a: str, b: str) -> DataFrame:
    """All pairs of records, a < b, that are in one class or in linked classes."""
    l = links.select("a", "b")  # noqa: E741
    mem = lambda rep, i: member.select(F.col("rep").alias(rep), F.col("id").alias(i))
    across = l.join(mem("a", "x"), "a").join(mem("b", "y"), "b").select("x", "y")
    several = member.groupBy("rep").count().where("count > 1").select("rep")
    inside = member.join(several, "rep", "left_semi")
    within = inside.select("rep", F.col("id").alias("x")).join(inside.select("rep", F.col("id").alias("y")), "rep").where("x < y").select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias(a), F.greatest("x", "y").alias(b))


def similar_groups(df: DataFrame, id_col: str, text_col: str, **how) -> DataFrame:
    """One row per record of ``df`` with a non-null id: (id, group_id, n_links, n_copies).

    Groups are the connected components of the links; a record without links is its own group.  ``n_links`` counts
    linked classes of other texts, ``n_copies`` the records with the same set.  Columns other than the two named are
    ignored.
    """
    member, links = similar_sets(df, id_col, text_col, **how)
    links = cut(links.select("a", "b"))
    comp = connected_components(links, "a", "b")
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    copies = member.groupBy("rep").agg(F.count(F.lit(1)).alias("n_copies"))
    rows = df.select(F.col(id_col).cast("long").alias("id")).where("id is not null").join(member, "id", "left")
    rows = rows.join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left").join(degree, "rep", "left").join(copies, "rep", "left")
    return rows.select(
        F.col("id").alias(id_col),
        F.coalesce("component", "rep", "id").alias("group_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("n_copies", F.lit(1)).alias("n_copies"),
    )
