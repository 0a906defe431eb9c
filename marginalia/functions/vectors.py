"""Dense-vector helpers used inside Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def matrix(column: pa.Array) -> np.ndarray:
    """List column -> (rows, dim) float64 matrix with unit rows; all-zero rows stay zero. Rows must
    be complete vectors of one size (see ``complete``)."""
    if len(column) == 0:
        return np.zeros((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1)
    norms = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def complete(vector: str, dim: int) -> Column:
    """Whether a row holds a vector of ``dim`` numbers, none of them null."""
    v = F.col(vector)
    return F.coalesce((F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull()), F.lit(False))


def tiles(n_queries: int, n_rows: int, most_bytes: int = 64 << 20) -> Iterator[slice]:
    """Row slices whose table of scores stays within ``most_bytes``."""
    step = max(1, most_bytes // (8 * max(n_queries, 1)))
    for a in range(0, n_rows, step):
        yield slice(a, min(a + step, n_rows))


def nearest(wanted: np.ndarray, rows: np.ndarray, k: int, n_wanted: int = 512, n_rows: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, similarity) of the k most similar rows of every query, in order; of equal rounded
    similarities the earlier rows. Scores are made in tiles, of which only cells above the k-th best so
    far are kept. Rows with a NaN are no hits."""
    whole = np.flatnonzero(~np.isnan(rows).any(axis=1))
    rows = rows if len(whole) == len(rows) else rows[whole]
    found = []
    for a in range(0, len(wanted), n_wanted):
        asked = wanted[a : a + n_wanted]
        floor = np.full(len(asked), -np.inf)
        best = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))
        new, waiting = [], 0
        for b in range(0, len(rows), n_rows):
            scores = asked @ rows[b : b + n_rows].T
            width = scores.shape[1]
            # a rounded score is above the floor, or in the first tile not below the k-th best
            least = floor + 4e-7 if b else np.partition(scores, width - k, axis=1)[:, width - k] - 2e-6 if width > k else floor
            q, r = np.nonzero(scores >= least[:, None])
            rounded = np.round(scores[q, r], 6)
            above = rounded > floor[q]
            new.append((q[above], r[above] + b, rounded[above]))
            waiting += int(above.sum())
            if b and waiting < len(asked) * k and b + n_rows < len(rows):
                continue
            best, new, waiting = _first_k([best, *new], k), [], 0
            last = np.flatnonzero(best[3] == k - 1)
            floor[best[0][last]] = best[2][last]
            best = best[:3]
        found.append((best[0] + a, whole[best[1]], best[2]))
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*found))


def _first_k(parts: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    """(query, row, similarity, place) of the first k rows of every query."""
    query, row, score = (np.concatenate(c) for c in zip(*parts))
    order = np.lexsort((row, -score, query))
    query, row, score = query[order], row[order], score[order]
    place = np.arange(len(query)) - np.searchsorted(query, query)
    keep = place < k
    return query[keep], row[keep], score[keep], place[keep]


class TopK:
    """Running best-k list per query, ordered by rounded similarity, then id."""

    def __init__(self, n_queries: int, k: int):
        self.k = k
        self.scores = [np.zeros(0) for _ in range(n_queries)]
        self.ids = [np.zeros(0, dtype=object) for _ in range(n_queries)]

    def add(self, scores: np.ndarray, ids: np.ndarray, queries: np.ndarray | None = None) -> None:
        """Fold in a block of similarities, whose rows are all queries or the numbers given. Cells of
        minus infinity are no hits."""
        width = scores.shape[1]
        if not width:
            return
        queries = np.arange(len(self.scores)) if queries is None else queries
        last = np.array([self.scores[q][-1] if len(self.scores[q]) == self.k else -np.inf for q in queries])
        by_id = None
        for at in np.flatnonzero(scores.max(axis=1) >= last):
            q, row = queries[at], scores[at]
            floor = last[at]
            if width > self.k:
                floor = max(floor, np.partition(row, width - self.k)[width - self.k])
            keep = np.flatnonzero((row >= floor) & (row > -np.inf))
            if len(keep) > self.k:  # of equal scores the least ids are enough
                if by_id is None:
                    by_id = np.empty(width, dtype=np.int64)
                    by_id[sorted(range(width), key=ids.__getitem__)] = np.arange(width)
                keep = keep[np.lexsort((by_id[keep], -row[keep]))[: self.k]]
            all_scores = np.concatenate([self.scores[q], row[keep]])
            all_ids = np.concatenate([self.ids[q], ids[keep]])
            order = sorted(range(len(all_ids)), key=lambda i: (-all_scores[i], all_ids[i]))[: self.k]
            self.scores[q] = all_scores[order]
            self.ids[q] = all_ids[order]
