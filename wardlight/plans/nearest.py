"""The nearest rows of queries by cosine, block against block, within one task.

A block's similarities come from one matrix product. Only those that may be among a query's best are rounded and kept, so memory is that of a block
however many rows are alike. Where a sum of another order could round to another sixth digit, the similarity is added up again component by component,
and rounded as a decimal: the result is that of Spark's ``round(sum of products / (norm * norm), 6)``.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa

DIGITS = 6
_SCALE = 10.0**DIGITS
_QUERIES, _ROWS = 256, 8192  # of a block


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows; one of another length becomes all zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), width))
    good = np.flatnonzero(size == width)
    if len(good):
        out[good] = column.take(pa.array(good)).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return out


def norms(vectors: np.ndarray) -> np.ndarray:
    """Lengths, the squares added from the first component on."""
    total = np.zeros(len(vectors))
    for j in range(vectors.shape[1]):
        total = total + vectors[:, j] * vectors[:, j]
    return np.sqrt(total)


def numbered(ids: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in the order of the ids, equal for equal ids of both."""
    number = np.unique(np.concatenate((ids, who)), return_inverse=True)[1].reshape(-1)
    return number[: len(ids)], number[len(ids) :]


class Nearest:
    """The best ``k`` of ``rows`` for each query so far, by similarity, NaN first, then by place among the rows, which are in the order of their ids.

    ``own`` and ``asking`` number the ids of rows and queries; no row is near a query with its own id. Without ``odd`` a vector of length 0 has similarity 0, else NaN.
    """

    def __init__(self, rows: np.ndarray, own: np.ndarray, queries: np.ndarray, asking: np.ndarray, k: int, odd: bool = True):
        self.raw, self.asks, self.k = (rows, norms(rows)), (queries, norms(queries)), k
        with np.errstate(invalid="ignore", divide="ignore"):
            self.rows, self.queries = (v / np.where((n == 0) & (not odd), 1, n)[:, None] for v, n in (self.raw, self.asks))
        self.nan = [np.isnan(v).any(axis=1) for v in (self.rows, self.queries)]
        self.self = np.searchsorted(own, asking, side="left"), np.searchsorted(own, asking, side="right")
        self.best = np.full((len(queries), k), -np.inf)  # inf stands for NaN
        self.place = np.full((len(queries), k), len(rows), dtype=np.int64)

    def visit(self, at: np.ndarray | None = None, places: np.ndarray | None = None) -> None:
        """Compare the queries ``at`` with the rows at ``places``, ascending; all by default."""
        at = np.arange(len(self.queries)) if at is None else at
        places = np.arange(len(self.rows)) if places is None else places
        for b in range(0, len(places), _ROWS):
            part = places[b : b + _ROWS]
            rows, nan = self.rows[part].T, self.nan[0][part].any()
            for a in range(0, len(at), _QUERIES):
                self._block(at[a : a + _QUERIES], part, rows, nan)

    def _block(self, at: np.ndarray, part: np.ndarray, rows: np.ndarray, nan: bool) -> None:
        with np.errstate(invalid="ignore"):
            near = self.queries[at] @ rows
        if nan or self.nan[1][at].any():
            near[np.isnan(near)] = np.inf
        lo, hi = (np.searchsorted(part, s[at]) for s in self.self)
        for i in np.flatnonzero(lo < hi):
            near[i, lo[i] : hi[i]] = -np.inf
        worst, last = self.best[at, -1], self.place[at, -1]
        # Of equal similarity only a row with a smaller place is better than the last one kept.
        least = worst + np.where(last < part[0], 0.49, -0.51) / _SCALE
        new = worst == -np.inf
        if new.any() and len(part) > self.k:
            least[new] = np.partition(near[new], len(part) - self.k, axis=1)[:, -self.k] - 1.01 / _SCALE
        q, r = np.nonzero(near >= least[:, None])
        value = near[q, r]
        q, r, value = (x[value > -np.inf] for x in (q, r, value))
        if not len(q):
            return
        value = self._rounded(value, at[q], part[r])
        changed, q = np.unique(q, return_inverse=True)
        own = at[changed]
        q = np.concatenate((np.repeat(np.arange(len(own)), self.k), q.reshape(-1)))
        value, place = np.concatenate((self.best[own].ravel(), value)), np.concatenate((self.place[own].ravel(), part[r]))
        order = np.lexsort((place, -value, q))
        order = order[np.searchsorted(q[order], np.arange(len(own)))[:, None] + np.arange(self.k)[None, :]]
        self.best[own], self.place[own] = value[order], place[order]

    def _rounded(self, value: np.ndarray, q: np.ndarray, r: np.ndarray) -> np.ndarray:
        scaled = value * _SCALE
        out = np.rint(scaled) / _SCALE + 0.0
        with np.errstate(invalid="ignore"):
            close = np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-4)
        for a in range(0, len(close), 1 << 16):
            some = close[a : a + (1 << 16)]
            left, right, total = self.asks[0][q[some]], self.raw[0][r[some]], np.zeros(len(some))
            for j in range(left.shape[1]):
                total = total + left[:, j] * right[:, j]
            exact, back = np.unique(total / (self.asks[1][q[some]] * self.raw[1][r[some]]), return_inverse=True)
            exact = [float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-DIGITS), ROUND_HALF_UP)) for x in exact.tolist()]
            out[some] = np.array(exact)[back.reshape(-1)] + 0.0
        return out

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the query, place of the row and similarity of all that were found."""
        q, n = np.nonzero(self.best > -np.inf)
        value = self.best[q, n]
        return q, self.place[q, n], np.where(value == np.inf, np.nan, value)
