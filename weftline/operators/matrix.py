"""Matrix operators over vector columns: only matrices of the vectors' dimension reach the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _dense(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1).astype(np.float64)


def moments(df: DataFrame, cols: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, sums, cross products) of the vectors made of the columns ``cols`` side by side; null vectors are left out.

    Every task sends on one partial matrix, added up by a tree of at most two levels.
    """
    src = df.select(F.concat(*[F.transform(c, lambda x: x.cast("double")) for c in cols]).alias("v")).where("v is not null")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, g = 0, None, None
        for b in batches:
            if b.num_rows:
                x = _dense(b.column(0))
                n, s, g = n + len(x), x.sum(0) + (0 if s is None else s), x.T @ x + (0 if g is None else g)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s.tolist()]), pa.array([g.ravel().tolist()])], names=["n", "s", "g"])

    parts = src.mapInArrow(partial, "n long, s array<double>, g array<double>").select("n", F.posexplode(F.concat("s", "g")).alias("pos", "x"), F.size("s").alias("dim"))
    total = parts.groupBy("pos", "dim").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).orderBy("pos").collect()
    if not total:
        return 0, np.zeros(0), np.zeros((0, 0))
    dim = total[0].dim
    x = np.array([r.x for r in total])
    return total[0].n, x[:dim], x[dim:].reshape(dim, dim)


def components(df: DataFrame, col: str, k: int, centre: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(variances, directions) of the first ``k`` principal components (singular directions without centring)."""
    n, s, g = moments(df, [col])
    if not n:
        return np.zeros(0), np.zeros((0, 0))
    cov = (g - np.outer(s, s) / n) / max(n - 1, 1) if centre else g
    w, v = np.linalg.eigh(cov)
    order = np.argsort(-w)[:k]
    v = v[:, order]
    v = v * np.sign(v[np.abs(v).argmax(0), np.arange(v.shape[1])])  # a sign that does not depend on the solver
    return np.maximum(w[order], 0), v


def spectrum(df: DataFrame, col: str, k: int) -> DataFrame:
    """(component, variance, share) of the first ``k`` principal components."""
    n, s, g = moments(df, [col])
    w, _ = components(df, col, k)
    total = float(np.trace((g - np.outer(s, s) / n) / max(n - 1, 1))) if n else 1.0
    return df.sparkSession.createDataFrame([(i, float(x), float(x / total)) for i, x in enumerate(w)], "component int, variance double, share double")


def project(df: DataFrame, id_cols: list[str], col: str, basis: np.ndarray, remove: bool = False) -> DataFrame:
    """Coordinates in ``basis``, or the vectors without their part in it."""
    shared = df.sparkSession.sparkContext.broadcast(basis)  # dimension x k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _dense(b.column(len(id_cols)))
                y = x @ shared.value
                y = x - y @ shared.value.T if remove else y
                yield pa.RecordBatch.from_arrays([*b.columns[: len(id_cols)], pa.array(list(y), pa.list_(pa.float64()))], names=[*id_cols, col])

    src = df.select(*id_cols, col).where(F.col(col).isNotNull())
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in src.schema if f.name != col), f"{col} array<double>"])
    return src.mapInArrow(run, schema)


def ridge(df: DataFrame, x: str, y: str, penalty: float) -> DataFrame:
    """(input, output, weight) of the ridge regression of the vectors ``y`` on ``x``, by the normal equations."""
    n, _, g = moments(df, [x, y])
    dim = df.select(F.max(F.size(x))).first()[0] or 0
    w = np.linalg.solve(g[:dim, :dim] + penalty * np.eye(dim), g[:dim, dim:]) if n else np.zeros((0, 0))
    rows = [(i, j, float(w[i, j])) for i in range(w.shape[0]) for j in range(w.shape[1])]
    return df.sparkSession.createDataFrame(rows, "input int, output int, weight double")


def distil(cells: DataFrame, target: DataFrame, keys: list[str], vec_col: str, buckets: int, dim: int, penalty: float) -> DataFrame:
    """(keys..., v): sparse rows (keys..., bucket, value) mapped to the ``dim`` leading principal coordinates of the
    vectors ``target``, by ridge regression fitted on the rows that have both.

    Only matrices of ``buckets`` + ``dim`` reach the driver.
    """
    from weftline.operators.svd import multiply

    basis = components(target, vec_col, dim)[1]
    coords = project(target, keys, vec_col, basis)
    sparse = cells.select(*keys, F.col("bucket").alias("at"), F.col("value").cast("double").alias("value"))
    rows = sparse.groupBy(*keys).agg(F.collect_list(F.struct("at", "value")).alias("e"))
    dense = multiply(rows, keys, np.eye(buckets), "x").join(coords.select(*keys, F.col(vec_col).alias("y")), keys)
    _, _, g = moments(dense, ["x", "y"])
    if not g.size:
        return multiply(rows, keys, np.zeros((buckets, dim)))
    w = np.linalg.solve(g[:buckets, :buckets] + penalty * np.eye(buckets), g[:buckets, buckets:])
    return multiply(rows, keys, w)
