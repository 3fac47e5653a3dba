"""Approximate nearest neighbours: stable projections in a kd-tree, with a chi-square stopping test.

Vectors are projected to ``DIMS`` Gaussian directions. For a pair at distance d the squared projected
distance over d * d is chi-square distributed with ``DIMS`` degrees of freedom, so a true neighbour closer
than d_k lies within projected distance sqrt(q) * d_k with probability ``prob`` or more (q: the
quantile). Neighbours are verified in order of projected distance until the next one lies beyond that.

A kd-tree over the projected space deals all rows to cells: as many as the rows ask for, up to ``MAX_CELLS``, fitted on
``PER_CELL`` projected rows a cell. A cell with more than ``GROUP`` rows (of one very common vector, or where cells have
reached their number) is split further by a hash of the id into groups, so a task holds a bounded number of
rows; its visiting queries come in chunks of at most ``GROUP``. Each query
first searches its own cell, which bounds d_k, then visits the cells that the stopping test doesn't
exclude; inside a group a local kd-tree serves leaves in order of projected distance. Distances are exact:
original vectors, double precision.

Vectors null, zero, of another than the most common length, or with null or non-finite components take
no part; with few candidates all are returned; repeated ids are candidates of their own, while rows that share a
query's id are one query (its least vector) and no candidates of it; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, slices, small

DIMS, PROB, ROWS_PER_CELL, MAX_CELLS, LEAF = 20, 0.95, 1024, 1 << 14, 16
#: Projected rows that a cell's bounds are fitted on, and most rows of a group.
PER_CELL, GROUP = 16, 1 << 14


def chi2_quantile(prob: float, dims: int) -> float:
    """Quantile of the chi-square distribution with an even number of degrees of freedom."""
    if dims % 2:
        raise ValueError("an even number of projections is asked for")

    def cdf(x: float) -> float:
        term, total = 1.0, 0.0
        for i in range(dims // 2):
            total += term
            term *= x / 2 / (i + 1)
        return 1 - math.exp(-x / 2) * total

    lo, hi = 0.0, 10.0 * dims + 100
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < prob else (lo, mid)
    return hi


class Cells:
    """Top of the kd-tree: ``depth`` levels of median splits of a sample; boxes of the cells."""

    def __init__(self, sample: np.ndarray, depth: int) -> None:
        dims = sample.shape[1]
        self.depth = depth
        self.axis, self.at = np.zeros(max(1, 2**depth - 1), np.int64), np.zeros(max(1, 2**depth - 1))
        self.lo, self.hi = np.full((2**depth, dims), -np.inf), np.full((2**depth, dims), np.inf)
        self._split(sample, 0, np.full(dims, -np.inf), np.full(dims, np.inf), 0)

    def _split(self, x: np.ndarray, node: int, lo: np.ndarray, hi: np.ndarray, level: int) -> None:
        if level == self.depth:
            self.lo[node - (2**self.depth - 1)], self.hi[node - (2**self.depth - 1)] = lo, hi
            return
        spread = np.ptp(x, axis=0) if len(x) else np.zeros(len(lo))
        a = int(np.argmax(spread))
        cut = float(np.median(x[:, a])) if len(x) else 0.0
        self.axis[node], self.at[node] = a, cut
        left_hi, right_lo = hi.copy(), lo.copy()
        left_hi[a], right_lo[a] = min(hi[a], cut), max(lo[a], cut)
        self._split(x[x[:, a] < cut], 2 * node + 1, lo, left_hi, level + 1)
        self._split(x[x[:, a] >= cut], 2 * node + 2, right_lo, hi, level + 1)

    def of(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[np.arange(len(x)), self.axis[node]] >= self.at[node])
        return node - (2**self.depth - 1)

    def gaps(self, q: np.ndarray) -> np.ndarray:
        """Squared projected distance from ``q`` to each cell."""
        return (np.maximum(np.maximum(self.lo - q, q - self.hi), 0.0) ** 2).sum(axis=1)


class LocalTree:
    """kd-tree of one group of rows, searched leaf by leaf in order of projected distance."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projected: np.ndarray) -> None:
        order, self.bounds = [], [0]
        stack = [np.arange(len(ids))]
        while stack:
            part = stack.pop()
            spread = np.ptp(projected[part], axis=0)
            if len(part) <= LEAF:
                order.append(part)
                self.bounds.append(self.bounds[-1] + len(part))
                continue
            by = part[np.argsort(projected[part, int(np.argmax(spread))], kind="stable")]
            stack += [by[len(by) // 2 :], by[: len(by) // 2]]
        o = np.concatenate(order)
        self.ids, self.vectors, self.projected = ids[o], vectors[o], projected[o]
        self.looked_at = 0  # rows verified so far
        self.lo = np.minimum.reduceat(self.projected, self.bounds[:-1], axis=0)
        self.hi = np.maximum.reduceat(self.projected, self.bounds[:-1], axis=0)

    def search(self, query_id: int, q: np.ndarray, p: np.ndarray, k: int, quantile: float, limit: float) -> tuple[np.ndarray, np.ndarray]:
        """ids and distances of the best found; ``limit``: a distance that the k-th neighbour doesn't exceed."""
        gaps = (np.maximum(np.maximum(self.lo - p, p - self.hi), 0.0) ** 2).sum(axis=1)
        leaves, done, width = np.argsort(gaps, kind="stable"), 0, 1
        ids, dist = np.empty(0, np.int64), np.empty(0)
        while done < len(leaves):
            now = leaves[done : done + width]
            now = now[gaps[now] <= quantile * limit * limit]
            if not len(now):
                break  # all that is left is farther in projection than the test allows
            done, width = done + width, width * 2
            rows = np.concatenate([np.arange(self.bounds[i], self.bounds[i + 1]) for i in now])
            rows = rows[((self.projected[rows] - p) ** 2).sum(axis=1) <= quantile * limit * limit]
            rows = rows[self.ids[rows] != query_id]
            d = np.sqrt(((self.vectors[rows] - q) ** 2).sum(axis=1))
            ids, dist = np.concatenate([ids, self.ids[rows]]), np.concatenate([dist, d])
            best = np.lexsort((ids, dist))[:k]
            ids, dist, self.looked_at = ids[best], dist[best], self.looked_at + len(rows)
            if len(dist) == k:
                limit = min(limit, float(dist[-1]))
        return ids, dist


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, v (doubles) of the vectors that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("v") == (common["n"] if common else 0))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width) if len(column) else np.empty((0, width))


def nearest(vectors: DataFrame, query: Column | None = None, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = DIMS, prob: float = PROB, rows_per_cell: int = ROWS_PER_CELL, seed: int = 17) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (Euclidean distance): the k nearest found of each query row.

    ``query`` picks the query rows by vec_id (default: vec_id divisible by 100); candidates are all other rows.
    """
    query = F.col("vec_id") % 100 == 0 if query is None else query
    rows = usable(vectors, id_col, vec_col)
    out = "query_id long, rank int, vec_id long, score double"
    total = rows.count()
    if not total:
        return vectors.sparkSession.createDataFrame([], out)
    width = len(rows.first()["v"])
    directions = np.random.default_rng(seed).standard_normal((width, dims))
    depth = max(0, min(int(math.log2(MAX_CELLS)), math.ceil(math.log2(total / rows_per_cell))))
    # a hash of the id picks the rows that the cells are fitted on: all of few rows, and never more than the limit
    asked = PER_CELL << depth
    picked = rows.where(F.xxhash64("vec_id", F.lit(seed)) % max(1, total // (2 * asked)) == 0).limit(2 * asked).select("v")

    def projected(batches):  # noqa: ANN001, ANN202
        for b in slices(batches, 4096):
            yield pa.record_batch([pa.array((_matrix(b.column(0), width) @ directions).astype(np.float32).ravel())], names=["p"])

    sample = picked.mapInArrow(projected, "p float").toArrow()["p"].to_numpy().reshape(-1, dims).astype(float)
    cells, quantile = Cells(sample, depth), chi2_quantile(prob, dims)

    def placed(batches):  # noqa: ANN001, ANN202
        for b in slices(batches, 4096):
            x = _matrix(b.column(1), width)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(cells.of(x @ directions), pa.int32()), b.column(2)], names=["vec_id", "v", "cell", "is_query"])

    data = rows.withColumn("is_query", query).mapInArrow(placed, "vec_id long, v array<double>, cell int, is_query boolean")
    counts = {r[0]: r[1] for r in data.groupBy("cell").count().collect()}
    parts = {c: math.ceil(n / GROUP) for c, n in counts.items()}
    first, run = {}, 0
    for c in sorted(parts):
        first[c], run = run, run + parts[c]
    groups = vectors.sparkSession.createDataFrame([(c, first[c], parts[c]) for c in parts], "cell int, first int, parts int")
    data = data.join(small(groups, len(parts)), "cell").withColumn("grp", F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    data = materialise(data.select("grp", "vec_id", "v", "cell", "is_query"), "ann-rows")
    base = data.select("grp", "vec_id", "v")
    queries = data.where("is_query").groupBy(F.col("vec_id").alias("query_id")).agg(F.min(F.struct("v", "cell")).alias("x")).select("query_id", F.col("x.v").alias("q"), F.col("x.cell").alias("cell"))
    found_schema = "query_id long, vec_id long, score double"

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        got: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            x = _matrix(left["v"].combine_chunks(), width)
            tree = LocalTree(left["vec_id"].to_numpy(), x, x @ directions)
            qs = _matrix(right["q"].combine_chunks(), width)
            ps = qs @ directions
            for i, (qid, limit) in enumerate(zip(right["query_id"].to_pylist(), right["bound"].to_pylist())):
                ids, dist = tree.search(qid, qs[i], ps[i], k, quantile, limit)
                for a, v in zip(got, (np.full(len(ids), qid), ids, dist)):
                    a.append(v)
        cols = [np.concatenate(a) if a else np.empty(0, t) for a, t in zip(got, (np.int64, np.int64, np.float64))]
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    def visit(asked: DataFrame, name: str) -> DataFrame:
        """``asked``: query_id, q, bound, cell; one search for each group of the cell and chunk of its queries."""
        sent = asked.join(small(groups, len(parts)), "cell").withColumn("grp", F.explode(F.sequence("first", F.col("first") + F.col("parts") - 1)))
        sent = materialise(sent.select("grp", "query_id", "q", "bound"), name)
        chunks = sent.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("chunks"))
        chunks = small(materialise(chunks, f"{name}-chunks"), run)
        sent = sent.join(chunks, "grp").withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.col("chunks")).cast("int"))
        held = base.join(chunks, "grp").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        held = held.select("grp", "chunk", "vec_id", "v").groupBy("grp", "chunk")
        return held.cogroup(sent.select("grp", "chunk", "query_id", "q", "bound").groupBy("grp", "chunk")).applyInArrow(search, found_schema)

    home = materialise(visit(queries.withColumn("bound", F.lit(1e300)), "ann-asked-home"), "ann-home")
    bounds = home.groupBy("query_id").agg(F.when(F.count("*") >= k, F.element_at(F.slice(F.array_sort(F.collect_list("score")), 1, k), -1)).alias("bound"))

    def others(batches):  # noqa: ANN001, ANN202
        present = np.array(sorted(parts))
        for b in slices(batches, 1024):
            qs = _matrix(b.column(1), width)
            take, cell = [], []
            for i, (p, limit, own) in enumerate(zip(qs @ directions, b.column(2).to_pylist(), b.column(3).to_pylist())):
                go = present[(cells.gaps(p)[present] <= quantile * limit * limit) & (present != own)]
                take.append(np.full(len(go), i))
                cell.append(go)
            at = pa.array(np.concatenate(take))
            yield pa.record_batch([b.column(0).take(at), b.column(1).take(at), b.column(2).take(at), pa.array(np.concatenate(cell), pa.int32())], names=["query_id", "q", "bound", "cell"])

    known = queries.join(bounds, "query_id", "left").select("query_id", "q", F.coalesce("bound", F.lit(1e300)).alias("bound"), "cell")
    away = visit(known.mapInArrow(others, "query_id long, q array<double>, bound double, cell int"), "ann-asked")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return home.unionByName(away).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
