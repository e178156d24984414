"""Hard-negative mining by vantage-point trees over norm-augmented vectors.

Inner products become distances: with M the largest norm of a tree, a row v gets one more component sqrt(M² - |v|²) and a query one of 0, so that
|q - v|² = M² + |q|² - 2 q·v. A window of scores is then an annulus around the query. A tree's inner nodes keep a vantage point
and the interval of distances from it that either half has; by the triangle inequality a leaf gets a highest and a lowest
score for each query. A query visits only leaves that meet its annulus, those with the highest possible score (capped by the window) first,
and stops when its k-th best score is above what the next leaf can have. Scores are whole numbers; what the
bounds leave is scored exactly, so nothing is missed.

Every partition of the rows is a forest, one tree for each ``tree_rows`` rows, and a query's best of one tree bound the search of the
next. The queries (a stated share of all rows, one for each different vector and label among the anchors) come in blocks of bounded
size; the best of all partitions meet by query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import written

LEAF = 64
_NONE = -(1 << 62)  # a score below all others
_NO_ID = (1 << 63) - 1


class Tree:
    """A vantage-point tree over integer vectors (rows), with their ids and labels."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, labels: np.ndarray, leaf: int = LEAF):
        self.squares = (vectors.astype(np.float64) ** 2).sum(axis=1)
        self.most = float(self.squares.max())
        points = np.concatenate((vectors, np.sqrt(self.most - self.squares)[:, None]), axis=1)
        order = np.arange(len(ids))
        self.vantage: list[np.ndarray] = []
        self.paths: list[list[tuple[int, float, float]]] = []  # of each leaf: (node, nearest, farthest) from the root on
        self.spans: list[tuple[int, int]] = []
        todo = [(0, len(ids), [])]
        while todo:
            a, b, path = todo.pop()
            if b - a <= leaf:
                self.spans.append((a, b))
                self.paths.append(path)
                continue
            own = points[order[a:b]]
            far = own[np.argmax(((own - own[0]) ** 2).sum(axis=1))]
            away = np.sqrt(((own - far) ** 2).sum(axis=1))
            by = np.argsort(away, kind="stable")
            order[a:b], away, mid = order[a:b][by], away[by], (b - a) // 2
            node = len(self.vantage)
            self.vantage.append(far)
            todo.append((a + mid, b, [*path, (node, away[mid], away[-1])]))
            todo.append((a, a + mid, [*path, (node, away[0], away[mid - 1])]))
        self.vectors, self.ids, self.labels = vectors[order], ids[order], labels[order]

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The highest and the lowest score that a row of each leaf (column) can have with each query (row)."""
        own = (queries.astype(np.float64) ** 2).sum(axis=1)
        slack = 1e-9 * (self.most + own) + 1e-3
        near, far = np.zeros((len(queries), len(self.spans))), np.full((len(queries), len(self.spans)), np.inf)
        if self.vantage:
            points = np.stack(self.vantage)
            away = own[:, None] + (points**2).sum(axis=1)[None, :] - 2 * queries.astype(np.float64) @ points[:, :-1].T
            away = np.sqrt(np.maximum(away, 0))
            for i, path in enumerate(self.paths):
                for node, least, most in path:
                    d = away[:, node]
                    np.maximum(near[:, i], np.maximum(d - most, least - d), out=near[:, i])
                    np.minimum(far[:, i], d + most, out=far[:, i])
        both = (self.most + own)[:, None]
        # A distance of two nearly equal points is exact to the square root of the sums' rounding only.
        near, far = np.maximum(near - np.sqrt(slack)[:, None] * 1e-2, 0), far + np.sqrt(slack)[:, None] * 1e-2
        return (both - near**2) / 2 + slack[:, None], (both - far**2) / 2 - slack[:, None]

    def scores(self, queries: np.ndarray, leaf: int) -> np.ndarray:
        a, b = self.spans[leaf]
        return queries @ self.vectors[a:b].T


class Search:
    """The best ``k`` rows of each query so far: by score, then by smaller id, of the same label or of others, inside [low, high]."""

    def __init__(self, queries: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int):
        self.queries, self.labels, self.low, self.high, self.same, self.k = queries, labels, low, high, same, k
        self.best = np.full((len(queries), k), _NONE, dtype=np.int64)
        self.ids = np.full((len(queries), k), _NO_ID, dtype=np.int64)

    def visit(self, tree: Tree, block: int = 1024) -> None:
        width = max(self.queries.shape[1], tree.vectors.shape[1])
        tree.vectors = _wide(tree.vectors, width)
        # Doubles hold the sums while they stay below 2**53.
        exact = tree.most * float((self.queries.astype(np.float64) ** 2).sum(axis=1).max(initial=0)) < 2.0**105
        tree.vectors = tree.vectors.astype(np.float64 if exact else np.int64)
        for a in range(0, len(self.queries), block):
            own = slice(a, a + block)
            queries = _wide(self.queries[own], width).astype(tree.vectors.dtype)
            upper, lower = tree.bounds(queries)
            key = np.where((upper >= self.low[own, None]) & (lower <= self.high[own, None]), np.minimum(upper, self.high[own, None]), -np.inf)
            order = np.argsort(-key, axis=1, kind="stable")
            at = np.arange(len(queries))
            for step in range(order.shape[1]):  # every query's next leaf, until none has one
                leaf = order[at, step]
                bound = key[at, leaf]
                go = (bound > -np.inf) & (bound >= self.best[own][at, -1])
                at, leaf = at[go], leaf[go]
                if not len(at):
                    break
                by = np.argsort(leaf, kind="stable")
                cuts = np.flatnonzero(np.diff(leaf[by])) + 1
                for group in np.split(by, cuts):
                    self._take(tree, int(leaf[group[0]]), at[group] + a, queries[at[group]])

    def _take(self, tree: Tree, leaf: int, rows: np.ndarray, queries: np.ndarray) -> None:
        a, b = tree.spans[leaf]
        scores = tree.scores(queries, leaf).astype(np.int64)
        ok = (tree.labels[None, a:b] == self.labels[rows, None]) == self.same
        ok &= (scores >= self.best[rows, -1:]) & (scores >= self.low[rows, None]) & (scores <= self.high[rows, None])
        have = ok.any(axis=1)
        if not have.any():
            return
        rows, scores, ok = rows[have], scores[have], ok[have]
        scores = np.concatenate((self.best[rows], np.where(ok, scores, _NONE)), axis=1)
        ids = np.concatenate((self.ids[rows], np.where(ok, tree.ids[None, a:b], _NO_ID)), axis=1)
        order = np.lexsort((ids, -scores), axis=1)[:, : self.k]
        self.best[rows], self.ids[rows] = np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def _wide(vectors: np.ndarray, width: int) -> np.ndarray:
    """Zeros behind shorter vectors: a component that is not there adds nothing to a score."""
    return vectors if vectors.shape[1] >= width else np.pad(vectors, ((0, 0), (0, width - vectors.shape[1])))


def _vectors(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat, width = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), max(int(size.max(initial=0)), 1)
    out = np.zeros((len(size), width), dtype=np.int64)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _best_of(index: DataFrame, queries: pa.Table, same: bool, k: int, tree_rows: int) -> DataFrame:
    """(q, h, low, high, score, vec_id): the best rows of each query in each partition of ``index``."""
    vectors = _vectors(queries.column("vector")).astype(np.int32)
    label, low, high, q, h = (queries.column(c).to_numpy() for c in ("label", "low", "high", "q", "h"))

    def run(batches):
        search = Search(vectors.astype(np.int64), label, low, high, same, k)
        held, size = [], 0

        def plant() -> None:
            table = pa.Table.from_batches(held)
            search.visit(Tree(_vectors(table.column("vector")), table.column("vec_id").to_numpy(), table.column("label").to_numpy()))

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= tree_rows:
                plant()
                held, size = [], 0
        if size:
            plant()
        row, place = np.nonzero(search.ids != _NO_ID)
        columns = [q[row], h[row], low[row], high[row], search.best[row, place], search.ids[row, place]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["q", "h", "low", "high", "score", "vec_id"])

    return index.mapInArrow(run, "q long, h long, low long, high long, score long, vec_id long")


def _search(index: DataFrame, queries: DataFrame, same: bool, k: int, tree_rows: int, query_rows: int) -> DataFrame:
    """The best ``k`` rows for each query, with their ``place`` from 1, block of queries by block."""
    blocks = max(1, -(-queries.count() // query_rows))
    found = None
    for n in range(blocks):
        one = queries.where(F.pmod(F.xxhash64("q", "h", "low", "high"), F.lit(blocks)) == n).toArrow()
        if one.num_rows:
            best = _best_of(index, one, same, k, tree_rows)
            found = best if found is None else found.unionByName(best)
    if found is None:
        found = index.sparkSession.createDataFrame([], "q long, h long, low long, high long, score long, vec_id long")
    first = Window.partitionBy("q", "h", "low", "high").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k)


def whole_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, vector of whole numbers) of the rows that can be scored.

    Rows with a null id, label, vector or component or a component that is not finite are left out, and rows that repeat all three count once. A vector whose
    inner products may not fit 64 bits is an error.
    """
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    known = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    known = known.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~odd)
    scaled = F.transform("embedding", lambda x: F.floor(x * scale))
    large = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x) * float(scale) ** 2 >= 2.0**60
    checked = F.when(large, F.raise_error(F.concat(F.lit("vector too large to be scored in 64 bits: "), F.col("vec_id").cast("string"))).cast("array<int>")).otherwise(scaled.cast("array<int>"))
    return known.select("vec_id", "label", checked.alias("vector")).distinct()


def hard_negatives(
    vectors: DataFrame, anchor: Column, n_positive: int = 5, n_negative: int = 3, low_percent: int = 50, high_percent: int = 95, scale: int = 256, tree_rows: int = 8192, query_rows: int = 8192
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): rows of another label that score nearly as high as a positive.

    ``anchor`` is a condition on vec_id. An anchor's positives are its ``n_positive`` other rows of the same label with the highest scores, ties to the smaller
    vec_id; its negatives for each the first ``n_negative`` rows of other labels whose score is between ``low_percent`` and ``high_percent`` per cent of
    the positive's, both included. A positive with a score below 0 has no such rows. Shorter vectors count as filled with zeros. A row
    with the anchor's own id is never its positive. See ``whole_vectors`` for odd rows; without rows the result is empty.

    Of rows with equal vectors and labels only the ``n_positive`` + 1 with the smallest ids can be among the best, and they alone are searched;
    the window's limit is applied before the shuffle, so a vector that a third of all rows share moves no more than that from each task.
    """
    rows = written(whole_vectors(vectors, scale))
    among = Window.partitionBy("vector", "label").orderBy("vec_id")
    index = written(rows.withColumn("copy", F.row_number().over(among)).where(F.col("copy") <= n_positive + 1).drop("copy"))
    anchors = rows.where(anchor)
    classes = anchors.groupBy("vector", "label").agg(F.min("vec_id").alias("q")).withColumn("h", F.xxhash64("vector", "label"))
    classes = written(classes)
    anchors = anchors.join(classes, ["vector", "label"]).select(F.col("vec_id").alias("anchor_id"), "q", "h")

    every = classes.select("*", F.lit(_NONE + 1).alias("low"), F.lit(1 << 62).alias("high"))
    near = written(_search(index, every, True, n_positive + 1, tree_rows, query_rows).select("q", "h", F.col("score").alias("positive_score"), F.col("vec_id").alias("positive_id")))
    ordered = Window.partitionBy("anchor_id", "q", "h").orderBy(F.desc("positive_score"), "positive_id")
    positives = anchors.join(near, ["q", "h"]).where("positive_id <> anchor_id").withColumn("n", F.row_number().over(ordered)).where(F.col("n") <= n_positive).drop("n")

    # Hundreds apart, so that no product leaves 64 bits.
    low, high = (F.expr(f"positive_score div 100 * {p} + (positive_score % 100 * {p} + {up}) div 100") for p, up in ((low_percent, 99), (high_percent, 0)))
    windows = near.where("positive_score >= 0").select("q", "h", low.alias("low"), high.alias("high"), "positive_score")
    asked = written(windows.select("q", "h", "low", "high").distinct().join(classes, ["q", "h"]))
    found = _search(index, asked, False, n_negative, tree_rows, query_rows).select("q", "h", "low", "high", F.col("score").alias("negative_score"), F.col("vec_id").alias("negative_id"), F.col("place").alias("rank"))
    negatives = windows.distinct().join(found, ["q", "h", "low", "high"])
    return positives.join(negatives, ["q", "h", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

