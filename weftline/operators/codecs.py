"""Quantised weights: packing, unpacking, pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unpack_nibbles(b: Column) -> Column:
    """The two four-bit codes of a byte, the low one first."""
    return F.array(b.bitwiseAND(F.lit(15)), F.shiftright(b, 4).bitwiseAND(F.lit(15)))


def pack_nibbles(lo: Column, hi: Column) -> Column:
    return F.shiftleft(hi, 4).bitwiseOR(lo)


def dequantise(codes: Column, book: list[float]) -> Column:
    table = F.array(*[F.lit(x) for x in book])
    return F.transform(codes, lambda c: F.element_at(table, c + 1))


def nearest_code(x: Column, book: list[float]) -> Column:
    """Index of the nearest entry of a codebook, the lower one on a tie."""
    pairs = F.array(*[F.struct(F.round(F.abs(x - v), 9).alias("d"), F.lit(i).alias("i")) for i, v in enumerate(book)])
    return F.array_min(pairs)["i"]


def prune_small(df: DataFrame, col: str, keep: float) -> DataFrame:
    """Rows whose magnitude is at least the quantile that leaves a share ``keep``."""
    edge = df.agg(F.percentile(F.abs(F.col(col)), F.lit(1 - keep)).alias("__e"))
    return df.join(F.broadcast(edge)).where(F.abs(F.col(col)) >= F.col("__e")).drop("__e")


def codebook(df: DataFrame, col: str, levels: int, rounds: int = 12, pin_zero: bool = False) -> list[float]:
    """Levels of a one-dimensional k-means over all values, begun at quantiles; one level may be pinned at 0.

    Only the levels reach the driver: every round is one aggregate of sums and counts by nearest level.
    """
    vals = df.select(F.col(col).cast("double").alias("x")).where("x is not null")
    first = vals.agg(F.percentile_approx("x", [(i + 0.5) / levels for i in range(levels)], 10_000).alias("q")).first().q or []
    book = sorted({round(float(q), 9) for q in first})
    for _ in range(rounds):
        if pin_zero and book:
            book[min(range(len(book)), key=lambda i: abs(book[i]))] = 0.0
        got = {r.c: r.m for r in vals.groupBy(nearest_code(F.col("x"), book).alias("c")).agg(F.avg("x").alias("m")).collect()} if book else {}
        new = sorted({round(got.get(i, v), 9) for i, v in enumerate(book)})
        if new == book:
            break
        book = new
    if pin_zero and book:
        book[min(range(len(book)), key=lambda i: abs(book[i]))] = 0.0
    return book
