"""Exact top-k inner products by best-first search of an M-tree (op 1).

A vector x gets one component more, sqrt(M - |x|^2), M being the largest squared norm; a query gets zero
there. Then |q - x|^2 = |q|^2 + M - 2 q.x, so the largest inner products are the nearest neighbours and
the metric bounds of an M-tree hold. The tree has three levels of nodes: pivots, subtrees of SUBTREE rows
or so, and pages of PAGE rows. Each node stores its covering radius and each entry the distance to its
parent's routing object, so |d(q, parent) - d(entry, parent)| - radius rules entries out without computing a
distance.

The top level, PIVOTS nodes at most, is with every task. A query first visits the pivot of the smallest bound, and
only then, with the k-th score found there, those others whose bound that score does not beat. Within a task the
subtrees, pages and rows wait in one queue for each query, in order of their bounds, until no bound can beat the k-th
score. The subtrees are rows of a written table, a few thousand vectors each: one repeated vector does not make
one big group. Queries reach them in blocks of QUERY_BLOCK, a bound that does not grow.

Scores are exact: floats where all of them are below 2^53, whole numbers of 64 bits beyond, floats then only bound.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knotwork.llm.common import Scratch, batches

PIVOTS, SUBTREE, PAGE, QUERY_BLOCK = 1024, 2048, 64, 2048
#: Subtrees that wait in one queue; a task with more goes through them in groups.
QUEUED = 64
SCHEMA = "pivot int, cover double, to_pivot double, root binary, radius double, ids binary, rows binary, up binary, starts binary, pivots binary, reach binary, far binary"


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(vec_id, q array<long>) of the rows that take part: an id, and finite components only."""
    x = F.col(vector_col)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    q = F.transform(x, lambda v: F.floor(v.cast("double") * F.lit(float(scale))).cast("long"))
    return vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & ~F.coalesce(bad, F.lit(True))).select(F.col(id_col).cast("long").alias("vec_id"), q.alias("q"))


def matrix(lists, dim: int) -> np.ndarray:
    """Rows of whole numbers, shorter vectors filled up with zeros."""
    out = np.zeros((len(lists), dim), dtype=np.int64)
    for i, v in enumerate(lists):
        out[i, : len(v)] = v
    return out


class Space:
    """Distances in the space with the added component. largest: the largest squared norm of all, queries too."""

    def __init__(self, dim: int, top: float, largest: float):
        self.dim, self.top, self.slack, self.exact = dim, top, 1e-6 * (1 + np.sqrt(max(top, largest))), max(top, largest) < 2**53

    def added(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, self.top - np.einsum("ij,ij->i", x, x)))

    def between(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Distances of data rows x to data rows y."""
        dot = x @ y.T + np.outer(self.added(x), self.added(y))
        return np.sqrt(np.maximum(0.0, 2 * (self.top - dot)))


def build_subtree(space: Space, ids: np.ndarray, whole: np.ndarray, pivot: np.ndarray | None = None) -> dict:
    """Bulk loading: page pivots spread over the rows, each row in the page of the nearest, long pages cut. pivot: the parent's routing object."""
    order = np.lexsort((ids,))
    ids, whole = ids[order], whole[order]
    x, n = whole.astype(float), len(ids)
    chosen = np.unique(x[np.linspace(0, n - 1, max(1, n // PAGE)).astype(int)], axis=0)
    page = np.argmin(space.between(x, chosen), axis=1)
    order = np.argsort(page, kind="stable")
    ids, x, whole, page = ids[order], x[order], whole[order], page[order]
    starts = [0]
    for p in np.unique(page):
        size = int((page == p).sum())
        starts += [starts[-1] + min(size, s + 2 * PAGE) for s in range(0, size, 2 * PAGE)] if size > 2 * PAGE else [starts[-1] + size]
    starts = np.array(sorted(set(starts)))
    pivots = x[starts[:-1]]
    root = x[n // 2 : n // 2 + 1]
    up = np.concatenate([space.between(x[a:b], pivots[i : i + 1])[:, 0] for i, (a, b) in enumerate(zip(starts, starts[1:], strict=False))])
    reach = np.maximum.reduceat(up, starts[:-1])
    far = space.between(pivots, root)[:, 0]
    as_bytes = lambda a, t: np.ascontiguousarray(a, dtype=t).tobytes()
    pivot = root if pivot is None else pivot[None, :]
    above = {"cover": float(space.between(x, pivot).max()), "to_pivot": float(space.between(root, pivot)[0, 0])}
    return above | {"root": as_bytes(root, "<f8"), "radius": float(space.between(x, root).max()), "ids": as_bytes(ids, "<i8"), "rows": as_bytes(whole, "<i8"), "up": as_bytes(up, "<f8"), "starts": as_bytes(starts, "<i8"), "pivots": as_bytes(pivots, "<f8"), "reach": as_bytes(reach, "<f8"), "far": as_bytes(far, "<f8")}


class Subtree:
    """A row of the tree table."""

    def __init__(self, row: dict, dim: int):
        of = lambda name, t="<f8": np.frombuffer(row[name], dtype=t)
        self.pivot, self.cover, self.to_pivot, self.root, self.radius = row["pivot"], row["cover"], row["to_pivot"], of("root"), row["radius"]
        self.ids, self.starts, self.up, self.reach, self.far = of("ids", "<i8"), of("starts", "<i8"), of("up"), of("reach"), of("far")
        self.whole, self.pivots = of("rows", "<i8").reshape(len(self.ids), dim), of("pivots").reshape(len(self.starts) - 1, dim)


class Search:
    """The best k of each query so far. floor: a score that k candidates are known to reach."""

    def __init__(self, space: Space, qids: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray):
        self.space, self.qids, self.whole, self.q, self.k = space, qids, q, q.astype(float), k
        self.norm = np.einsum("ij,ij->i", self.q, self.q)
        self.floor = floor.copy()
        kind = float if space.exact else np.int64
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, dtype=kind), np.empty(0, dtype=np.int64)) for _ in qids]
        self.computed = 0

    def distance(self, scores: np.ndarray, i) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, self.norm[i] + self.space.top - 2 * scores))

    def limit(self, i: int) -> float:
        return float(self.distance(self.floor[i], i)) + self.space.slack if np.isfinite(self.floor[i]) else np.inf

    def scores(self, i: int, rows: np.ndarray) -> np.ndarray:
        return rows.astype(float) @ self.q[i] if self.space.exact else rows @ self.whole[i]

    def feed(self, trees: list[Subtree], to_pivot: np.ndarray, asked: np.ndarray) -> None:
        """Best first through some subtrees. to_pivot: distances of queries and pivots; asked: which pivots a query may visit."""
        pivot, above, radius = (np.array([getattr(t, a) for t in trees]) for a in ("pivot", "to_pivot", "radius"))
        roots = np.array([t.root for t in trees])
        for i in range(len(self.qids)):
            limit = self.limit(i)
            low = np.abs(to_pivot[i, pivot] - above) - radius  # without a distance
            open_ = np.flatnonzero(asked[i, pivot] & (low <= limit))
            if not len(open_):
                continue
            d = self.distance(roots[open_] @ self.q[i], i)
            self.computed += len(open_)
            # Entries (bound, number of subtree, page or -1, distance to the routing object)
            queue = [(b, t, -1, x) for b, t, x in zip((d - radius[open_]).tolist(), open_.tolist(), d.tolist(), strict=True) if b <= limit]
            heapq.heapify(queue)
            while queue and queue[0][0] <= limit:
                _, t, page, x = heapq.heappop(queue)
                limit = self._page(i, trees[t], page, x, limit) if page >= 0 else self._pages(i, trees[t], t, x, limit, queue)

    def _pages(self, i: int, tree: Subtree, t: int, x: float, limit: float, queue: list) -> float:
        near = np.flatnonzero(np.abs(x - tree.far) - tree.reach <= limit)  # without a distance
        d = self.distance(tree.pivots[near] @ self.q[i], i)
        self.computed += len(near)
        for b, page, y in zip((d - tree.reach[near]).tolist(), near.tolist(), d.tolist(), strict=True):
            if b <= limit:
                heapq.heappush(queue, (b, t, page, y))
        return limit

    def _page(self, i: int, tree: Subtree, page: int, x: float, limit: float) -> float:
        a, b = tree.starts[page], tree.starts[page + 1]
        near = np.flatnonzero(np.abs(x - tree.up[a:b]) <= limit) + a  # without a distance
        near = near[tree.ids[near] != self.qids[i]]
        if not len(near):
            return limit
        self.computed += len(near)
        self.take(i, self.scores(i, tree.whole[near]), tree.ids[near])
        return self.limit(i)

    def take(self, i: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.best[i][0], scores]), np.concatenate([self.best[i][1], ids])
        order = np.lexsort((ids, -scores))[: self.k]
        self.best[i] = (scores[order], ids[order])
        if len(order) == self.k:
            self.floor[i] = max(self.floor[i], scores[order[-1]])


def mtree_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k largest integer inner products of each query.

    vectors and queries hold an id and a vector; components become floor(scale * x). Vectors that are null,
    hold null or non-finite components or have a null id take no part. Missing components of shorter vectors
    count as zero. A query's candidates are all rows with another id, repeated rows each for themselves; ties
    go to the smaller id. Queries that share an id count once, as the smallest vector. Fewer candidates than
    k give fewer rows; empty tables give none. Other columns are ignored. Scores and components must fit a long.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "mtree")
    rows = scratch.write(quantised(vectors, id_col, vector_col, scale), "vectors")
    asked = scratch.write(quantised(queries, id_col, vector_col, scale).groupBy("vec_id").agg(F.min("q").alias("q")), "queries")
    norm = F.aggregate("q", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    n, dim, top = rows.select(F.count("*"), F.max(F.size("q")), F.max(norm)).first()
    nq, qdim, qtop = asked.select(F.count("*"), F.max(F.size("q")), F.max(norm)).first()
    if not n or not nq:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    space = Space(max(dim, qdim), float(top), float(qtop))
    # The sample that routes: a bounded number of rows, the same each time. All rows are indexed.
    count = min(PIVOTS, max(16, n // SUBTREE))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "q").limit(max(count, 256)).collect()
    sample_ids, sample = np.array([r["vec_id"] for r in sample]), matrix([r["q"] for r in sample], space.dim)
    pivots = np.unique(sample[:count], axis=0).astype(float)

    def assign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            x = matrix(b.column(1).to_pylist(), space.dim)
            near = np.argmin(space.between(x.astype(float), pivots), axis=1) if len(x) else np.empty(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v.tobytes() for v in x], type=pa.binary()), pa.array(near.astype(np.int32))], names=["vec_id", "x", "pivot"])

    with batches(spark, 1024):
        placed = scratch.write(rows.mapInArrow(assign, "vec_id long, x binary, pivot int"), "placed")
    sizes = {r["pivot"]: r["count"] for r in placed.groupBy("pivot").count().collect()}  # PIVOTS rows at most
    pieces = F.create_map(*[F.lit(v) for p, c in sizes.items() for v in (p, -(-c // SUBTREE))])

    def subtree(rows: pd.DataFrame) -> pd.DataFrame:
        x, pivot = np.frombuffer(b"".join(rows["x"]), dtype="<i8").reshape(len(rows), space.dim), int(rows["pivot"].iloc[0])
        return pd.DataFrame([{"pivot": pivot, **build_subtree(space, rows["vec_id"].to_numpy(), x, pivots[pivot])}])

    # Rows of a large pivot are dealt out by number, so that one vector repeated very often is cut as well.
    dealt = placed.withColumn("piece", F.pmod(F.monotonically_increasing_id(), pieces[F.col("pivot")]))
    tree = scratch.write(dealt.groupBy("pivot", "piece").applyInPandas(subtree, SCHEMA), "tree")
    scratch.drop("placed")
    covers = {r["pivot"]: r["c"] for r in tree.groupBy("pivot").agg(F.max("cover").alias("c")).collect()}  # PIVOTS rows at most
    cover = np.array([covers.get(p, -np.inf) for p in range(len(pivots))])
    out, blocks = [], -(-nq // QUERY_BLOCK)
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).orderBy("vec_id").collect()  # QUERY_BLOCK rows or so
        if not part:
            continue
        qids, q = np.array([r["vec_id"] for r in part]), matrix([r["q"] for r in part], space.dim)
        scores = np.where(qids[:, None] == sample_ids[None, :], -np.inf, q.astype(float) @ sample.T.astype(float))
        floor = np.sort(scores, axis=1)[:, -k] if scores.shape[1] >= k else np.full(len(qids), -np.inf)
        if not space.exact:
            floor -= np.abs(floor) * 1e-9 + 1
        state = Search(space, qids, q, k, floor)
        to_pivot = state.distance(state.q @ pivots.T, np.arange(len(qids))[:, None])
        bound = np.where(np.isfinite(cover)[None, :], to_pivot - cover[None, :], np.inf)
        first = np.arange(len(pivots))[None, :] == np.argmin(bound, axis=1)[:, None]
        found = scratch.write(_searched(tree, space, qids, q, k, floor, to_pivot, first), f"first-{b}")
        # The k-th score of the first visits bounds the others.
        kth = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("s")).where(F.col("n") >= k).collect()  # a row for each of the block's queries
        at = {int(x): i for i, x in enumerate(qids)}
        for r in kth:
            state.floor[at[r["query_id"]]] = max(state.floor[at[r["query_id"]]], r["s"])
        limit = np.array([state.limit(i) for i in range(len(qids))])
        others = ~first & (bound <= limit[:, None])
        out += [found, scratch.write(_searched(tree, space, qids, q, k, state.floor, to_pivot, others), f"others-{b}")]
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = reduce(DataFrame.union, out).withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _searched(tree: DataFrame, space: Space, qids: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray, to_pivot: np.ndarray, asked: np.ndarray) -> DataFrame:
    """(query_id, vec_id, score): each task's best k of each query under the pivots that it may visit."""

    def search(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, waiting = Search(space, qids, q, k, floor), []
        for batch in it:
            waiting += [Subtree(row, space.dim) for row in batch.to_pylist()]
            if len(waiting) >= QUEUED:
                state.feed(waiting, to_pivot, asked)
                waiting = []
        if waiting:
            state.feed(waiting, to_pivot, asked)
        n = [len(s) for s, _ in state.best]
        cols = [np.repeat(qids, n), np.concatenate([i for _, i in state.best]), np.concatenate([s for s, _ in state.best])]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=["query_id", "vec_id", "score"])

    with batches(tree.sparkSession, 8):
        some = tree.where(F.col("pivot").isin([int(p) for p in np.flatnonzero(asked.any(axis=0))]))
        return some.mapInArrow(search, "query_id long, vec_id long, score long")
