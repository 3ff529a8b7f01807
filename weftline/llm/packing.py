"""Filling containers of fixed capacity with items (problem 7).

The plan is made on the histogram of lengths, which has at most ``capacity`` bars however many items there are:

1. combinations of up to ``DEPTH`` lengths that fill a window exactly are enumerated on a grid of ``GRID`` steps;
2. non-negative least squares finds how often each is to be repeated so that the histogram is met;
3. the counts are rounded and reserved from the real lengths, longest first inside a step;
4. what is left is packed greedily: the longest remaining length opens a container and the longest that still fits is
   added until none does; the pattern is repeated as often as the remaining counts allow, so every step uses up a
   length.  Containers of step 3 take fillers into their unused room in the same manner.

Items get their place by rank inside their length: ranks are computed from counts of (length, salt) cells, so a length
that a third of all items share is never in one task.  An item longer than the capacity is cut into full containers
and a rest.

Defined results: null texts are no items; a text without tokens is an item of length 0 in a container of its own kind,
shared with others; equal texts are separate items.
"""

from __future__ import annotations

import base64
import bisect
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import cut, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Steps of the grid on which windows are filled; lengths in a combination; salts that split a hot length.
GRID, DEPTH, SALTS = 32, 3, 64
#: Budgets that one call packs; every budget is a plan of its own.
MOST_BUDGETS = 1000


@lru_cache(maxsize=2)
def _encoding(vocabulary: bytes, pattern: str):  # noqa: ANN202
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


#: How the byte-level vocabulary splits a text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def token_lengths(df: DataFrame, id_col: str, text_col: str, tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """(id, n_tokens) of every row with an id and a text, in tokens of a public tokenizer's vocabulary file.

    The file is read by the driver and travels with the job."""
    with open(tokenizer, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(shared.value, pattern)
        for b in batches:
            n = [len(x) for x in enc.encode_ordinary_batch(b.column(1).to_pylist(), num_threads=1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32())], names=["id", "n_tokens"])

    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).where("id is not null and t is not null")
    return spread(src).mapInArrow(run, "id long, n_tokens int")


# ---- the plan ------------------------------------------------------------------------------------------------------


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Least squares with non-negative unknowns, by the active-set method of Lawson and Hanson."""
    m, n = a.shape
    x, passive = np.zeros(n), np.zeros(n, bool)
    w = a.T @ b
    for _ in range(rounds):
        free = ~passive & (w > 1e-9 * max(1.0, np.abs(b).max()))
        if not free.any() or passive.sum() >= m:
            break
        passive[np.where(free, w, -np.inf).argmax()] = True
        while True:
            s = np.zeros(n)
            s[passive] = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            if (s[passive] > 0).all():
                break
            bad = passive & (s <= 0)
            step = (x[bad] / np.maximum(x[bad] - s[bad], 1e-300)).min()
            x = x + step * (s - x)
            passive &= x > 1e-12
            x[~passive] = 0
        x = s
        w = a.T @ (b - a @ x)
    return x


def combinations(grid: int, depth: int) -> list[tuple[int, ...]]:
    """Ascending tuples of at most ``depth`` steps that sum to ``grid``."""
    out: list[tuple[int, ...]] = []

    def grow(head: tuple[int, ...], left: int) -> None:
        if left == 0:
            out.append(head)
        elif len(head) + 1 == depth:
            if not head or left >= head[-1]:
                out.append((*head, left))
        else:
            for s in range(head[-1] if head else 1, left + 1):
                grow((*head, s), left - s)

    grow((), grid)
    return out


class _Left:
    """Remaining counts of lengths, with the lengths that still have some in ascending order."""

    def __init__(self, hist: dict[int, int]) -> None:
        self.count = {k: v for k, v in hist.items() if v > 0}
        self.lengths = sorted(self.count)

    def longest(self, room: int, used: dict[int, int]) -> int | None:
        at = bisect.bisect_right(self.lengths, room) - 1
        while at >= 0 and self.count[self.lengths[at]] <= used.get(self.lengths[at], 0):
            at -= 1
        return self.lengths[at] if at >= 0 else None

    def take(self, used: dict[int, int], times: int) -> None:
        for k, n in used.items():
            self.count[k] -= n * times
            if self.count[k] <= 0:
                del self.count[k]
                self.lengths.pop(bisect.bisect_left(self.lengths, k))


def _fill(left: _Left, capacity: int, start: list[int], most: int | None) -> tuple[list[int], int]:
    """A pattern that begins with ``start`` and is filled greedily, and how often it can be repeated."""
    pattern, used = list(start), {}
    for k in start:
        used[k] = used.get(k, 0) + 1
    room = capacity - sum(start)
    while room > 0:
        k = left.longest(room, used)
        if k is None:
            break
        n = min(room // k if k else 0, left.count[k] - used.get(k, 0))
        if n <= 0:
            break
        pattern.extend([k] * n)
        used[k] = used.get(k, 0) + n
        room -= k * n
    times = min(left.count[k] // n for k, n in used.items())
    times = times if most is None else min(times, most)
    left.take(used, times)
    return pattern, times


def plan(hist: dict[int, int], capacity: int, grid: int = GRID, depth: int = DEPTH) -> list[tuple[list[int], int]]:
    """(lengths of a container, repeats) that pack a histogram of lengths 1..capacity."""
    hist = {k: v for k, v in hist.items() if v > 0}
    if not hist:
        return []
    step = capacity / grid
    slot = lambda k: max(1, int(-(-k // step)))
    bars = np.zeros(grid)
    for k, v in hist.items():
        bars[min(slot(k), grid) - 1] += v
    shapes = combinations(grid, depth)
    a = np.zeros((grid, len(shapes)))
    for j, shape in enumerate(shapes):
        for s in shape:
            a[s - 1, j] += 1
    # short lengths are fillers: an error there costs little room
    weight = (np.arange(1, grid + 1) / grid)[:, None]
    times = np.floor(nnls(a * weight, bars * weight[:, 0]) + 1e-6).astype(int)
    left = _Left(hist)
    out: list[tuple[list[int], int]] = []
    by_slot: dict[int, list[int]] = {}
    for k in sorted(hist, reverse=True):
        by_slot.setdefault(min(slot(k), grid), []).append(k)
    for j in np.argsort(-times, kind="stable"):
        more = int(times[j])
        while more > 0:
            start: list[int] = []
            for s in shapes[j]:
                k = next((k for k in by_slot.get(s, []) if left.count.get(k, 0) > start.count(k)), None)
                if k is None:
                    break
                start.append(k)
            if len(start) < len(shapes[j]):
                break
            pattern, done = _fill(left, capacity, start, more)
            out.append((pattern, done))
            more -= done
    while left.lengths:
        out.append(_fill(left, capacity, [left.lengths[-1]], None))
    return out


# ---- placing -------------------------------------------------------------------------------------------------------


def pack(items: DataFrame, capacity: int) -> DataFrame:
    """(id, piece, container, place, offset, n_tokens) for items (id, n_tokens).

    ``piece`` counts the parts of a cut item from 0; ``place`` and ``offset`` are the item's place and first token in
    its container.  Counts of at most ``capacity`` lengths reach the driver and make the plan;
    the places of (length, salt) cells are joined.
    """
    spark = items.sparkSession
    full = F.floor(F.col("n_tokens") / capacity).cast("int")
    rest = (F.col("n_tokens") % capacity).cast("int")
    whole = items.where(F.col("n_tokens") >= capacity).select("id", F.explode(F.sequence(F.lit(0), full - 1)).alias("piece"), F.lit(capacity).alias("n_tokens"))
    parts = items.select("id", F.when(F.col("n_tokens") >= capacity, full).otherwise(0).alias("piece"), rest.alias("n_tokens"), F.col("n_tokens").alias("all"))
    parts = parts.where("n_tokens > 0 or all = 0").drop("all")
    pieces = cut(parts.unionByName(whole).withColumn("salt", F.pmod(F.xxhash64("id", "piece"), F.lit(SALTS)).cast("int")))
    cells = pieces.groupBy("n_tokens", "salt").agg(F.count(F.lit(1)).alias("n"))
    hist = {r.n_tokens: r.n for r in cells.groupBy("n_tokens").agg(F.sum("n").alias("n")).collect()}
    empty = hist.pop(0, 0)
    patterns = plan(hist, capacity)
    if empty:
        patterns.append(([0], 1))
    # the ranks lo..hi of a length take a slot of consecutive containers, ``per`` to a container
    spans: list[tuple[int, int, int, int, int, int, int]] = []
    used: dict[int, int] = {}
    container = 0
    for pattern, times in patterns:
        offset = 0
        for place, (k, per) in _runs(pattern):
            lo = used.get(k, 0)
            n = per * times if k else empty
            spans.append((k, lo, lo + n, container, per if k else empty, place, offset))
            used[k] = lo + n
            offset += k * per
        container += times
    if not spans:
        return spark.createDataFrame([], "id long, piece int, container long, place int, offset int, n_tokens int")
    before = Window.partitionBy("n_tokens").orderBy("salt")  # SALTS rows at most
    first = cells.select("n_tokens", "salt", (F.sum("n").over(before) - F.col("n")).alias("base"))
    rank = Window.partitionBy("n_tokens", "salt").orderBy("id", "piece")
    ranked = pieces.withColumn("r", F.row_number().over(rank) - 1).join(first, ["n_tokens", "salt"]).select("id", "piece", "n_tokens", (F.col("r") + F.col("base")).alias("rank"))
    spans.sort()
    table_ = [np.array(c, np.int64) for c in zip(*spans, strict=True)]
    key = table_[0] << 44 | table_[1]
    shared = spark.sparkContext.broadcast((key, table_))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k_, (length, lo, _, con, per, plc, off) = shared.value
        for b in batches:
            n, rank_ = b.column(2).to_numpy().astype(np.int64), b.column(3).to_numpy()
            at = np.searchsorted(k_, n << 44 | rank_, side="right") - 1
            q = rank_ - lo[at]
            inside = q % per[at]
            cols = [b.column(0), b.column(1), pa.array(con[at] + q // per[at]), pa.array((plc[at] + inside).astype(np.int32)), pa.array((off[at] + inside * length[at]).astype(np.int32)), b.column(2)]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "piece", "container", "place", "offset", "n_tokens"])

    return ranked.mapInArrow(place, "id long, piece int, container long, place int, offset int, n_tokens int")


def _runs(pattern: list[int]) -> Iterator[tuple[int, tuple[int, int]]]:
    """(first place, (length, how many)) of the runs of equal lengths of a pattern."""
    at = 0
    while at < len(pattern):
        end = at
        while end < len(pattern) and pattern[end] == pattern[at]:
            end += 1
        yield at, (pattern[at], end - at)
        at = end


def pack_budgets(docs: DataFrame, budgets: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(budget_id, id, piece, container, place, offset, n_tokens) for every capacity of a stated small set of budgets."""
    items = cut(token_lengths(docs, id_col, text_col, tokenizer))
    out = None
    stated = budgets.select("budget_id", "capacity_tokens").where("capacity_tokens > 0").distinct()
    n = stated.count()
    if n > MOST_BUDGETS:
        raise ValueError(f"{n} budgets; at most {MOST_BUDGETS} are packed by one query")
    for r in sorted(stated.collect(), key=lambda r: r.budget_id):
        one = pack(items, r.capacity_tokens).select(F.lit(r.budget_id).alias("budget_id"), F.col("id").alias(id_col), "piece", "container", "place", "offset", "n_tokens")
        out = one if out is None else out.unionByName(one)
    if out is None:
        return docs.sparkSession.createDataFrame([], f"budget_id int, {id_col} long, piece int, container long, place int, offset int, n_tokens int")
    return out
