"""Nearest points by a k-d tree, for the points of one structure inside a task."""

from __future__ import annotations

import numpy as np

#: Points of a leaf, and queries that are looked at together.
LEAF, QUERIES = 32, 2048


class Tree:
    """A k-d tree as its leaves: each holds a few points, and a box around them."""

    def __init__(self, points: np.ndarray):
        parts, leaves = [np.arange(len(points))], []
        while parts:
            at = parts.pop()
            if len(at) <= LEAF:
                leaves.append(at)
                continue
            spread = points[at].max(axis=0) - points[at].min(axis=0)
            order = at[np.argsort(points[at, int(spread.argmax())], kind="stable")]
            parts += [order[: len(at) // 2], order[len(at) // 2 :]]
        self.points = np.full((len(leaves), LEAF, 3), np.inf)
        for i, at in enumerate(leaves):
            self.points[i, : len(at)] = points[at]
        self.low = np.array([points[at].min(axis=0) for at in leaves])
        self.high = np.array([points[at].max(axis=0) for at in leaves])

    def nearest(self, queries: np.ndarray, k: int, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """Distances to the k nearest points (infinite beyond their number), and how many lie within the radius."""
        best, within = [np.zeros((0, k))], [np.zeros(0, np.int64)]
        for start in range(0, len(queries), QUERIES):
            q = queries[start : start + QUERIES]
            gap = np.maximum(self.low - q[:, None], 0) + np.maximum(q[:, None] - self.high, 0)
            bound = np.sqrt((gap**2).sum(axis=2))
            order = np.argsort(bound, axis=1)
            found, count, rows = np.full((len(q), k), np.inf), np.zeros(len(q), np.int64), np.arange(len(q))
            for step in range(bound.shape[1]):  # leaves by rising distance of their boxes
                leaf = order[rows, step]
                useful = bound[rows, leaf] <= np.maximum(found[rows, -1], radius)
                rows, leaf = rows[useful], leaf[useful]
                if not len(rows):
                    break
                d = np.sqrt(((self.points[leaf] - q[rows, None]) ** 2).sum(axis=2))
                count[rows] += (d <= radius).sum(axis=1)
                found[rows] = np.sort(np.concatenate([found[rows], d], axis=1), axis=1)[:, :k]
            best.append(found)
            within.append(count)
        return np.concatenate(best), np.concatenate(within)
