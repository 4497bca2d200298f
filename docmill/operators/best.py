"""The k best of many scores for each query, kept over batches: what does not reach a query's k-th best is not sorted."""

from __future__ import annotations

import numpy as np

#: Scores of a batch that a task holds at once.
CELLS = 4_000_000


class Best:
    """The k best ids of every query so far; lower ids first among equal scores. Scores that are NaN or not above `above` are none."""

    def __init__(self, queries: int, k: int, digits: int | None = None, above: float = -np.inf):
        self.k, self.digits, self.above = k, digits, above
        self.score, self.ids = np.full((queries, k), -np.inf), None

    def take(self, score: np.ndarray, ids: np.ndarray) -> None:
        """score (queries, ids), in either memory order, rounded here where it may count."""
        if not score.size:
            return
        least = self.score[:, -1]
        if score.shape[1] > 4 * self.k and (few := np.isneginf(least)).any():  # the first batch, or a query that few ids answer: its own k-th best
            least = least.copy()
            least[few] = np.partition(np.nan_to_num(score[few], nan=-np.inf), -self.k, axis=1)[:, -self.k]
        slack = 0.0 if self.digits is None else 10.0**-self.digits
        # One comparison a score: what reaches the least that counts, or the next number above `above`.
        reached = score >= np.maximum(least - slack, np.nextafter(self.above, np.inf))[:, None]
        query, at = np.nonzero(reached) if reached.flags.c_contiguous else np.nonzero(reached.T)[::-1]
        self.offer(query, score[query, at], ids[at])

    def offer(self, query: np.ndarray, new: np.ndarray, ids: np.ndarray) -> None:
        """Scores above `above` of some queries and ids, one row each."""
        if not len(query):
            return
        self.ids = np.zeros(self.score.shape, ids.dtype) if self.ids is None else self.ids.astype(np.promote_types(self.ids.dtype, ids.dtype), copy=False)
        who = np.unique(query)
        query = np.concatenate([np.repeat(who, self.k), query])
        all_ = np.concatenate([self.score[who].ravel(), new if self.digits is None else np.round(new, self.digits)])
        ids = np.concatenate([self.ids[who].ravel(), ids])
        order = np.lexsort((ids, -all_, query))
        query = query[order]
        order = order[np.arange(len(query)) - np.searchsorted(query, query) < self.k]  # k rows or more of each query are there
        self.score[who], self.ids[who] = all_[order].reshape(-1, self.k), ids[order].reshape(-1, self.k)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of all that was found."""
        if self.ids is None:
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        query, at = np.nonzero(self.score > -np.inf)
        return query, self.ids[query, at], self.score[query, at]
