"""Most similar vectors for every vector by an inverted multi-index (problem 4).

A unit vector is cut into two halves, each quantised by its own codebook; a cell is a pair of centroids.  For a query
the cells are visited by the summed distance of its halves to the two centroids, the multi-sequence order: the frontier
holds for every first-half centroid the next second-half centroid, and its least sum is taken out until the cells taken
hold ``budget`` vectors.  The frontier is the heap of the published algorithm, kept as one row of an array per query so
that many queries pop in step.  All vectors of the cells taken are reranked by the exact cosine.

How many must be taken grows with the group and depends on the vectors, so ``budget`` is measured: of every field and
size class of groups (powers of two), ``PROBES`` vectors chosen by hash are compared with all rows of their groups, the
place of each true neighbour in the query's own traversal is counted, and the budget is the one that reaches the share
``recall`` of them, or ``LEAST_BUDGET``.  With ``recall`` of 1 every cell is visited and the result is exact.

Layout for large groups: cells are packed into blocks of about ``BLOCK`` vectors, cells above that size are split; a
task holds one block of queries and one block of candidates, never a whole group.  Equal vectors are searched once and
only the ``k + 1`` smallest ids of each are kept as candidates, which is all that ranks need.

Similarity is the cosine in double precision rounded to six decimals; among equals the smaller id comes first.  Null,
all-zero and non-finite vectors, and those of another length than the field's, take no part and have no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import cut

#: Vectors that a codebook is fitted on, at most, and rounds of k-means.
FIT_ROWS, FIT_ROUNDS = 20_000, 12
#: Vectors of each field and size class that the budget is measured on, and the share of neighbours to be found.
PROBES, RECALL = 200, 0.99
#: Candidates that are reranked at least: so few cost less than the search for them.
LEAST_BUDGET = 2000
BLOCK = 4096


def _matrix(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Unit rows, in double precision, of a list column whose lists are of one length."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not len(col):
        return np.zeros((0, 0))
    x = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _kmeans(x: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]]
    for _ in range(FIT_ROUNDS):
        at = _nearest(x, c)
        n = np.bincount(at, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def _distance(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0)


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([_distance(x[i : i + 8192], c).argmin(1) for i in range(0, len(x), 8192)]) if len(x) else np.zeros(0, int)


def traverse(d1: np.ndarray, d2: np.ndarray, count: np.ndarray, budget: int) -> np.ndarray:
    """[query, c1, c2] flags of the cells visited in multi-sequence order until ``budget`` vectors are taken.

    ``d1``, ``d2``: distances of each query's halves to the centroids; ``count``: vectors in each cell.
    """
    q, k1 = d1.shape
    k2 = d2.shape[1]
    o1, o2 = d1.argsort(1, kind="stable"), d2.argsort(1, kind="stable")
    s1, s2 = np.take_along_axis(d1, o1, 1), np.take_along_axis(d2, o2, 1)
    taken = np.zeros((q, k1, k2), bool)
    nxt = np.zeros((q, k1), int)
    front = s1 + s2[:, :1]
    front[:, 1:] = np.inf  # row i of the frontier opens once row i - 1 has been popped
    got = np.zeros(q, np.int64)
    live = np.arange(q)
    want = min(budget, int(count.sum()))
    while len(live):
        i = front[live].argmin(1)
        j = nxt[live, i]
        a, b = o1[live, i], o2[live, j]
        taken[live, a, b] = True
        got[live] += count[a, b]
        nxt[live, i] += 1
        more = j + 1 < k2
        front[live, i] = np.where(more, s1[live, i] + s2[live, np.minimum(j + 1, k2 - 1)], np.inf)
        opens = (j == 0) & (i + 1 < k1)
        r, ii = live[opens], i[opens] + 1
        front[r, ii] = s1[r, ii] + s2[r, 0]
        live = live[got[live] < want]
    return taken


def rank_rows(sim: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` best of every row by (rounded similarity descending, id ascending)."""
    if not sim.size:
        return np.zeros(0, int), np.zeros(0, int)
    r = np.rint(sim * 1e6).astype(np.int32)
    k = min(k, r.shape[1])
    edge = -np.partition(-r, k - 1, axis=1)[:, k - 1]
    row, col = np.nonzero(r >= edge[:, None])
    by = np.lexsort((ids[col], -r[row, col], row))
    row, col = row[by], col[by]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], col[place < k]


def size_class(n: int) -> int:
    return int(n).bit_length()


def measured_budgets(celled: DataFrame, cells: DataFrame, books: dict, k: int, recall: float) -> dict[tuple[str, int], int]:
    """Budget of each (field, size class of the group), from exact neighbours of a bounded sample of queries."""
    spark = celled.sparkSession
    klass = F.length(F.bin("total"))
    sizes = cells.groupBy("field", "grp").agg(F.sum("n").alias("total")).select("field", "grp", klass.alias("class"))
    chosen = Window.partitionBy("field", "class").orderBy(F.xxhash64("rep", "grp"), "rep")
    picked = celled.join(sizes, ["field", "grp"]).withColumn("r", F.row_number().over(chosen)).where(F.col("r") <= PROBES)
    probes = picked.select("field", "grp", "class", "rep", "v").toArrow()  # PROBES for each field and power of two
    shared = spark.sparkContext.broadcast(probes)

    def search(batches):  # noqa: ANN001, ANN202
        t, by = shared.value, {}
        for f, g in set(zip(t.column("field").to_pylist(), t.column("grp").to_pylist(), strict=True)):
            p = t.filter(pc.and_(pc.equal(t.column("field"), f), pc.equal(t.column("grp"), g)))
            by[f, g] = p.column("rep").to_numpy(), _matrix(p.column("v"))
        for b in batches:
            rows = pa.Table.from_batches([b])
            for f, g in {*zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)} & by.keys():
                part = rows.filter(pc.and_(pc.equal(rows.column("field"), f), pc.equal(rows.column("grp"), g)))
                reps, q = by[f, g]
                ids = part.column("rep").to_numpy()
                sim = q @ _matrix(part.column("v")).T
                sim[reps[:, None] == ids[None]] = -2
                row, col = rank_rows(sim, ids, k)
                keep = sim[row, col] > -1.5
                row, col = row[keep], col[keep]
                at = pa.array(col)
                cols = [pa.array([f] * len(row), pa.string()), pa.array(np.full(len(row), g, np.int64)), pa.array(reps[row]), part.column("rep").take(at).combine_chunks(), pa.array(sim[row, col]), part.column("c1").take(at).combine_chunks(), part.column("c2").take(at).combine_chunks()]
                yield pa.RecordBatch.from_arrays(cols, names=["field", "grp", "probe", "rep", "sim", "c1", "c2"])

    best = Window.partitionBy("field", "grp", "probe").orderBy(F.desc("sim"), "rep")
    true = celled.select("field", "grp", "rep", "v", "c1", "c2").mapInArrow(search, "field string, grp long, probe long, rep long, sim double, c1 int, c2 int")
    true = true.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).select("field", "grp", "probe", "c1", "c2")
    groups = cells.select("field", "grp", "c1", "c2", "n")
    groups = groups.toDF(*groups.columns)
    halves = spark.sparkContext.broadcast(books)

    def count(key: tuple, near: pa.Table, right: pa.Table) -> pa.Table:
        """Of each true neighbour, how many vectors the query's traversal takes up to its cell."""
        f, g = key[0].as_py(), key[1].as_py()
        t = shared.value
        t = t.filter(pc.and_(pc.equal(t.column("field"), f), pc.equal(t.column("grp"), g)))
        need = np.zeros(0, np.int64)
        if near.num_rows:
            reps, x = t.column("rep").to_numpy(), _matrix(t.column("v"))
            h = x.shape[1] // 2
            b1, b2 = halves.value[f]
            d1, d2 = _distance(x[:, :h], b1), _distance(x[:, h:], b2)
            a, b, n = (right.column(c).to_numpy() for c in ("c1", "c2", "n"))
            order = np.argsort(reps)
            q = order[np.searchsorted(reps[order], near.column("probe").to_numpy())]
            mine = d1[q, near.column("c1").to_numpy()] + d2[q, near.column("c2").to_numpy()]
            need = np.zeros(len(q), np.int64)
            for i in np.unique(q):
                d = d1[i, a] + d2[i, b]
                by = np.argsort(d)
                total = np.concatenate([[0], np.cumsum(n[by])])
                need[q == i] = total[np.searchsorted(d[by], mine[q == i] - 1e-12)] + 1
        return pa.table({"field": pa.array([f] * len(need), pa.string()), "class": pa.array(np.full(len(need), size_class(right.column("n").to_numpy().sum()), np.int32)), "need": need})

    needs = true.groupBy("field", "grp").cogroup(groups.groupBy("field", "grp")).applyInArrow(count, "field string, class int, need long")
    rows = needs.groupBy("field", "class").agg(F.percentile("need", F.lit(recall)).alias("b")).collect()
    return {(r["field"], r["class"]): max(int(np.ceil(r["b"])), LEAST_BUDGET) for r in rows}


def nearest(df: DataFrame, id_col: str, group_col: str, fields: list[str], k: int = 10, budget: int | None = None, recall: float = RECALL, cells_for: int = 16) -> DataFrame:
    """(field, group, id, neighbour, similarity, place): the ``k`` most similar other vectors of the same group.

    ``budget``: least number of candidates reranked exactly, measured for ``recall`` where none is given;
    ``cells_for``: vectors wanted in a cell, which sets the size of the codebooks (8 to 256 centroids per half).
    """
    spark = df.sparkSession
    one = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("array<float>").alias("v")) for f in fields]))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(group_col).cast("long").alias("grp"), one.alias("s")).select("id", "grp", "s.field", "s.v")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 3e38))
    rows = rows.where(F.col("id").isNotNull() & F.col("grp").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 1) & finite & F.exists("v", lambda x: x != 0))
    dims = {}
    for r in rows.groupBy("field", F.size("v").alias("n")).count().orderBy("count", "n").collect():
        dims[r.field] = r.n
    schema = "field string, grp long, id long, neighbour long, similarity double, place int"
    if not dims:
        return spark.createDataFrame([], schema)
    rows = rows.where(" or ".join(f"(field = '{f}' and size(v) = {n})" for f, n in dims.items()))
    rows = rows.withColumns({"h1": F.xxhash64("v"), "h2": F.hash("v")})
    same = ["field", "grp", "h1", "h2"]
    points = cut(rows.groupBy(*same).agg(F.min("id").alias("rep"), F.first("v").alias("v"), F.count(F.lit(1)).alias("copies")))
    largest = points.groupBy("field", "grp").count().agg(F.max("count")).first()[0]
    size = int(np.clip(2 ** np.round(np.log2(max(np.sqrt(largest / cells_for), 1))), 8, 256))
    books = {}
    for f in dims:
        sample = points.where(F.col("field") == f).orderBy(F.xxhash64("rep", "grp")).limit(FIT_ROWS).select("v").toArrow()
        x = _matrix(sample.column(0))
        h = x.shape[1] // 2
        books[f] = _kmeans(x[:, :h], size), _kmeans(x[:, h:], size, 8)
    shared = spark.sparkContext.broadcast(books)  # at most 256 centroids per half and field

    def assign(batches):  # noqa: ANN001, ANN202
        for b in batches:
            t = pa.Table.from_batches([b])
            for f in books:
                part = t.filter(pc.equal(t.column("field"), f))
                if not part.num_rows:
                    continue
                x = _matrix(part.column("v"))
                h = x.shape[1] // 2
                c1, c2 = shared.value[f]
                a = pa.array(_nearest(x[:, :h], c1[:, :]).astype(np.int32))
                part = part.append_column("c1", a).append_column("c2", pa.array(_nearest(x[:, h:], c2).astype(np.int32)))
                yield from part.combine_chunks().to_batches()

    celled = cut(points.select("field", "grp", "rep", "v").mapInArrow(assign, "field string, grp long, rep long, v array<float>, c1 int, c2 int"))
    own = Window.partitionBy("field", "grp").orderBy("c1", "c2")
    cells = celled.groupBy("field", "grp", "c1", "c2").agg(F.count(F.lit(1)).alias("n"))
    cells = cells.withColumn("block", F.floor((F.sum("n").over(own) - F.col("n")) / BLOCK).cast("int")).withColumn("subs", F.ceil(F.col("n") / BLOCK).cast("int"))
    cells = cut(cells)
    if recall >= 1:
        budgets = {}
    elif budget is None:
        budgets = measured_budgets(celled, cells, books, k, recall)
    else:
        budgets = {(f, c): budget for f in dims for c in range(64)}
    placed = celled.join(cells.select("field", "grp", "c1", "c2", "block", "subs"), ["field", "grp", "c1", "c2"])
    placed = cut(placed.withColumn("sub", F.when(F.col("subs") > 1, F.pmod(F.xxhash64("rep"), F.col("subs"))).otherwise(0).cast("int")).drop("subs"))
    blocks = cells.select("field", "grp", "block", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub")).distinct()
    directory = blocks.join(cells.select("field", "grp", "c1", "c2", "n", F.col("block").alias("to_block"), "subs"), ["field", "grp"])
    directory = directory.toDF(*directory.columns)  # its own column identities, for the cogroup below
    key = ["field", "grp", "block", "sub"]

    def route(k_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        f, g, blk, sub = (x.as_py() for x in k_)
        out_names = ["field", "grp", "block", "sub", "to_block", "to_sub", "query", "q", "home", "cells"]
        types = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float32()), pa.int32(), pa.list_(pa.int32())]
        c1, c2 = shared.value[f]
        count = np.zeros((len(c1), len(c2)), np.int64)
        a, b = right.column("c1").to_numpy(), right.column("c2").to_numpy()
        count[a, b] = right.column("n").to_numpy()
        target = np.full((len(c1), len(c2)), -1)
        target[a, b] = right.column("to_block").to_numpy()
        subs = np.ones((len(c1), len(c2)), int)
        subs[a, b] = right.column("subs").to_numpy()
        home = left.column("c1").to_numpy() * len(c2) + left.column("c2").to_numpy()
        # queries of one cell are routed together: the union of what each would visit
        order = np.argsort(home, kind="stable")
        x = _matrix(left.column("v"))
        h = x.shape[1] // 2
        rows_at, to_b, to_s, cell_lists = [], [], [], []
        step = max(1, 4_000_000 // count.size)
        n_all = int(count.sum())
        enough = budgets.get((f, size_class(n_all)), n_all)  # a class without a budget has no more than one vector
        visited = {}
        for lo in range(0, len(order), step):
            at = order[lo : lo + step]
            taken = traverse(_distance(x[at, :h], c1), _distance(x[at, h:], c2), count, enough)
            for c in np.unique(home[at]):
                visited[c] = visited.get(c, False) | taken[home[at] == c].any(0)
        for c, seen in visited.items():
            mine = np.flatnonzero(home == c)
            seen &= count > 0
            for t in np.unique(target[seen]):
                there = np.flatnonzero((seen & (target == t)).ravel()).astype(np.int32)
                for s in range(int(subs.ravel()[there].max())):
                    rows_at.append(mine)
                    to_b.append(np.full(len(mine), t))
                    to_s.append(np.full(len(mine), s))
                    cell_lists.extend([there] * len(mine))
        n = sum(map(len, rows_at))
        at = np.concatenate(rows_at) if n else np.zeros(0, int)
        off = np.concatenate([[0], np.cumsum([len(c) for c in cell_lists])]).astype(np.int32)
        flat = np.concatenate(cell_lists) if n else np.zeros(0, np.int32)
        cols = [
            pa.array([f] * n, types[0]), pa.array(np.full(n, g)), pa.array(np.full(n, blk, np.int32)), pa.array(np.full(n, sub, np.int32)),
            pa.array((np.concatenate(to_b) if n else at).astype(np.int32)), pa.array((np.concatenate(to_s) if n else at).astype(np.int32)),
            left.column("rep").take(pa.array(at)).combine_chunks(), left.column("v").take(pa.array(at)).combine_chunks(),
            pa.array(home[at].astype(np.int32)), pa.ListArray.from_arrays(pa.array(off), pa.array(flat)),
        ]
        return pa.table([c.cast(t) for c, t in zip(cols, types, strict=True)], names=out_names)

    route_schema = "field string, grp long, block int, sub int, to_block int, to_sub int, query long, q array<float>, home int, cells array<int>"
    routed = placed.groupBy(*key).cogroup(directory.groupBy(*key)).applyInArrow(route, route_schema)
    routed = cut(routed)
    pair = [*key, "to_block", "to_sub"]
    pairs = routed.select(*pair).distinct()
    to = placed.select("field", "grp", F.col("block").alias("to_block"), F.col("sub").alias("to_sub"), "rep", "v", "c1", "c2")
    candidates = pairs.join(to, ["field", "grp", "to_block", "to_sub"]).select(*pair, "rep", "v", "c1", "c2")
    candidates = candidates.toDF(*candidates.columns)

    def search(k_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        f, g = k_[0].as_py(), k_[1].as_py()
        width = len(shared.value[f][1])
        ids = right.column("rep").to_numpy()
        cell = right.column("c1").to_numpy() * width + right.column("c2").to_numpy()
        c, q = _matrix(right.column("v")), _matrix(left.column("q"))
        query, home = left.column("query").to_numpy(), left.column("home").to_numpy()
        lists = left.column("cells").combine_chunks()
        flat, off = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        out_q, out_n, out_s = [], [], []
        for hm in np.unique(home) if len(ids) else []:
            mine = np.flatnonzero(home == hm)
            want = flat[off[mine[0]] : off[mine[0] + 1]]
            cand = np.flatnonzero(np.isin(cell, want))
            for lo in range(0, len(mine), 512):
                m = mine[lo : lo + 512]
                sim = q[m] @ c[cand].T
                row, col = rank_rows(sim, ids[cand], k + 1)
                out_q.append(query[m][row])
                out_n.append(ids[cand][col])
                out_s.append(np.rint(sim[row, col] * 1e6) / 1e6)
        cat = lambda x, t: pa.array(np.concatenate(x).astype(t) if x else np.zeros(0, t))
        qs = cat(out_q, np.int64)
        return pa.table([pa.array([f] * len(qs), pa.string()), pa.array(np.full(len(qs), g)), qs, cat(out_n, np.int64), cat(out_s, np.float64)], names=["field", "grp", "query", "cand", "sim"])

    found = routed.groupBy(*pair).cogroup(candidates.groupBy(*pair)).applyInArrow(search, "field string, grp long, query long, cand long, sim double")
    best = Window.partitionBy("field", "grp", "query").orderBy(F.desc("sim"), "cand")
    found = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")
    # Copies: every member of a group of equal vectors stands for itself again.
    many = points.where("copies > 1").select(*same, "rep")
    members = rows.join(many, same).select("field", "grp", "rep", "id")
    first = Window.partitionBy("field", "grp", "rep").orderBy("id")
    kept = members.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).drop("r")
    at = ["field", "grp"]
    wide = found.join(kept.select(*at, F.col("rep").alias("cand"), F.col("id").alias("copy")), [*at, "cand"], "left")
    wide = wide.select(*at, "query", "sim", F.coalesce("copy", "cand").alias("cand"))
    wide = wide.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")
    wide = wide.join(members.select(*at, F.col("rep").alias("query"), F.col("id").alias("member")), [*at, "query"], "left")
    wide = wide.select(*at, F.coalesce("member", "query").alias("id"), "cand", "sim").where("id <> cand")
    last = Window.partitionBy(*at, "id").orderBy(F.desc("sim"), "cand")
    return wide.withColumn("place", F.row_number().over(last)).where(F.col("place") <= k).select(*at, "id", F.col("cand").alias("neighbour"), F.col("sim").alias("similarity"), "place")


def neighbour_pairs(found: DataFrame, a: str, b: str) -> DataFrame:
    """(field_name, a, b), a < b: pairs of which at least one is among the other's neighbours."""
    return found.select(F.col("field").alias("field_name"), F.least("id", "neighbour").alias(a), F.greatest("id", "neighbour").alias(b)).distinct()
