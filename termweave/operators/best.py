"""The k best items of each query, kept while blocks of scores pass by."""

from __future__ import annotations

import numpy as np

#: Rounded scores that tie lie within this much of each other before rounding to 6 digits.
SLACK = 1.5e-6


class Best:
    """Keeps rows (query, item, score rounded to 6 digits), best first, ties to the smaller item number.

    Scores come as tiles.  Only those that can reach a query's k best are rounded and ranked, so what
    is held beside a tile has the size of the result.
    """

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.floor = np.full(queries, -np.inf)
        self.query = self.item = np.zeros(0, np.int64)
        self.score = np.zeros(0)

    def add(self, query0: int, item0: int, scores: np.ndarray) -> None:
        """A tile of scores of successive queries and items; those that don't count are -inf."""
        if not scores.size:
            return
        rows, k = scores.shape[0], self.k
        floor = self.floor[query0 : query0 + rows]
        fits = scores >= (floor - SLACK)[:, None]
        if scores.shape[1] > k and np.count_nonzero(fits) > 4 * k * rows:
            at = scores.shape[1] - k
            floor = np.maximum(floor, np.partition(np.fmax(scores, -np.inf), at, axis=1)[:, at])
            fits = scores >= (floor - SLACK)[:, None]
        fits &= scores > -np.inf
        row, col = np.nonzero(fits)
        self._merge(row + query0, col + item0, np.round(scores[row, col], 6))

    def _merge(self, query: np.ndarray, item: np.ndarray, score: np.ndarray) -> None:
        if not len(query):
            return
        old = (self.query >= query[0]) & (self.query <= query[-1])
        rest = [x[~old] for x in (self.query, self.item, self.score)]
        query, item, score = (np.concatenate([x[old], y]) for x, y in zip((self.query, self.item, self.score), (query, item, score)))
        order = np.lexsort((item, -score, query))
        query, item, score = query[order], item[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        self.floor[query[place == self.k - 1]] = score[place == self.k - 1]
        keep = place < self.k
        self.query, self.item, self.score = (np.concatenate([x, y[keep]]) for x, y in zip(rest, (query, item, score)))
