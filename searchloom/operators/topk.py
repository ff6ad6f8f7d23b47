"""Selection of each query's best rows inside a task, in bounded memory."""

from __future__ import annotations

import numpy as np


class Running:
    """The `limit` best rows of each of some queries so far: lower scores (to nine
    places), then smaller ids. Batches of rows are added one after another; what
    is held is at most twice queries x limit rows and one batch's hits, and what
    leaves is at most queries x limit rows, however many batches there were."""

    def __init__(self, queries: int, limit: int):
        self.limit, self.worst = limit, np.full(queries, np.inf)
        self.parts, self.size = [], 0

    def add(self, scores, ids, queries=None) -> None:
        """scores (rows x queries) with inf where a row takes no part; ids gives the
        ids of an array of row numbers. queries names the columns if they are some
        of the queries only."""
        if not scores.size or self.limit <= 0:
            return
        names = np.arange(len(self.worst)) if queries is None else queries
        near, cut = np.round(scores, 9), self.worst[names]
        if len(scores) > self.limit:
            cut = np.minimum(cut, np.partition(near, self.limit - 1, axis=0)[self.limit - 1])
        row, at = np.nonzero(np.isfinite(scores) & (near <= cut))
        if len(row):
            self.parts.append((names[at], scores[row, at], ids(row)))
            self.size += len(row)
            if self.size > 2 * self.limit * len(self.worst) + (1 << 16):
                self._cut()

    def _cut(self) -> None:
        query, score, ids = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        _, order = np.unique(ids, return_inverse=True)
        o = np.lexsort((order, np.round(score, 9), query))
        query = query[o]
        starts = np.flatnonzero(np.append(True, query[1:] != query[:-1]))
        nth = np.arange(len(query)) - np.repeat(starts, np.diff(np.append(starts, len(query))))
        keep = nth < self.limit
        last = nth == self.limit - 1
        self.worst[query[last]] = np.round(score[o][last], 9)
        self.parts, self.size = [(query[keep], score[o][keep], ids[o][keep])], int(keep.sum())

    def rows(self):
        """(query numbers, scores, ids) of what is best, or None."""
        if not self.parts:
            return None
        self._cut()
        return self.parts[0]
