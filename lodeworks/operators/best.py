"""The best of many scores within a task: what searches with many queries share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Digits by which scores are compared; what agrees in them ties.
DIGITS = 9
#: Queries and rows that are scored together: a block of scores and its like stay in a core's cache.
QUERIES, ROWS = 256, 512


class Best:
    """Of each of ``n`` queries the ``k`` best keys, by score to ``DIGITS`` digits (NaN first, as SQL has it), then by key.

    Scores come in blocks. One comparison with what a query's k-th best so far has passes over nearly all of them; the
    others wait until there are as many as are kept, and are then sorted in among these. ``least`` bars lower scores.
    """

    def __init__(self, n: int, k: int, least: float = -np.inf) -> None:
        self.n, self.k = n, k
        self.low = np.full(n, least)
        # Place and key of the k-th best so far, of queries that have as many.
        self.full, self.last, self.last_key = np.zeros(n, bool), np.full(n, -np.inf), None
        self.kept: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def add(self, first: int, score: np.ndarray, keys: np.ndarray) -> None:
        """``score``: a row for each query from ``first`` on, a column for each of ``keys``."""
        if not score.size:
            return
        low = self.low[first : first + len(score)]
        able = ~(score < low[:, None])
        if score.shape[1] > self.k and np.count_nonzero(able) > 2 * self.k * len(score):
            # The k-th best of this block alone bars what is lower, but for what ties with it.
            kth = np.partition(score, score.shape[1] - self.k, axis=1)[:, score.shape[1] - self.k]
            low[:] = np.where(kth > low, np.maximum(low, _under(kth)), low)
            able = ~(score < low[:, None])
        at = np.flatnonzero(able)
        if not len(at):
            return
        row, col = np.divmod(at, score.shape[1])
        value, key = score.ravel()[at], keys[col]
        row += first
        place = np.round(value, DIGITS)
        if self.last_key is not None:
            ahead = ~self.full[row] | ~(place <= self.last[row]) | ((place == self.last[row]) & (key < self.last_key[row]))
            row, key, value, place = row[ahead], key[ahead], value[ahead], place[ahead]
        self.kept.append((row, key, value, place))
        self.waiting += len(row)
        if self.waiting > max(self.n * self.k, 1 << 16):
            self._settle()

    def _settle(self) -> None:
        row, key, value, place = (np.concatenate(c) for c in zip(*self.kept))
        by_key = np.unique(key, return_inverse=True)[1] if key.dtype == object else key
        odd = np.isnan(place)
        order = np.lexsort((by_key, -np.where(odd, 0.0, place), ~odd, row) if odd.any() else (by_key, -place, row))
        row = row[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        order, row, rank = order[rank < self.k], row[rank < self.k], rank[rank < self.k]
        key, value, place = key[order], value[order], place[order]
        self.kept, self.waiting = [(row, key, value, place)], 0
        if self.last_key is None and len(key):
            self.last_key = np.full(self.n, key[0], key.dtype)
        at = np.flatnonzero(rank == self.k - 1)
        full = row[at]
        self.full[full], self.last[full], self.last_key[full] = True, place[at], key[at]
        # All that is lower than a NaN is barred; another NaN is not lower.
        under = np.where(np.isnan(place[at]), np.inf, _under(place[at]))
        self.low[full] = np.maximum(self.low[full], under)

    def batches(self, ids: pa.Array, names: list[str]) -> Iterator[pa.RecordBatch]:
        """Query, key, score and the rounded score of what is kept."""
        if not self.kept:
            return
        self._settle()
        row, key, value, place = self.kept[0]
        for at in range(0, len(row), 1 << 18):
            part = slice(at, at + (1 << 18))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row[part])), pa.array(key[part]), pa.array(value[part]), pa.array(place[part])], names=names)


def _under(score: np.ndarray) -> np.ndarray:
    """A little less than what could tie with ``score`` when rounded."""
    return np.where(np.isinf(score), score, score - 2 * 10.0**-DIGITS - 4e-16 * np.abs(np.where(np.isinf(score), 0.0, score)))
