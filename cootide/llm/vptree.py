"""Vantage-point trees over unit vectors, searched by blocks of queries.

Distances are chords of the unit sphere, sqrt(2 - 2 cos), a metric. A node keeps a vantage point and, for its inner and
outer child, the least and greatest distance of their points from it. A query at distance d of the vantage point skips a
child if the triangle inequality puts all of its points farther than the query's k-th best: the gap between d and the
child's interval, times ``factor``, exceeds that distance. Factor 1 is exact; larger factors skip more.
"""

from __future__ import annotations

import numpy as np

LEAF = 512
BLOCK = 2048  # queries compared at once
SAMPLE = 2048  # points that settle how a node is parted
DENSE = 0.05  # share of pairs above which products in double precision of all of them cost less
_ROUND = 1e-9
_SINGLE = 1e-5  # more than single precision loses
NO_ID = np.iinfo(np.int64).max


def chord(cos: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cos))


class Tree:
    """Tree over rows of ``points``; nodes hold positions into them."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF, seed: int = 5):
        self.points, self.leaf = points, leaf
        self.rng = np.random.default_rng(seed)
        self.vantages: list[int] = []
        self.root = self._build(np.arange(len(points)))

    def _build(self, at: np.ndarray):
        if len(at) <= self.leaf:
            return np.sort(at)
        some = at if len(at) <= SAMPLE else self.rng.choice(at, SAMPLE, replace=False)
        tried = self.rng.choice(some, 12, replace=False)
        dist = chord(self.points[some] @ self.points[tried].T)
        ordered = np.sort(dist, axis=0)
        low = max(1, len(some) // 50)
        gaps = np.diff(ordered[low:-low], axis=0)
        where, best = gaps.argmax(axis=0), gaps.max(axis=0)
        j = int(best.argmax())
        if best[j] > 0.1:  # an empty shell parts the points cleanly
            cut = ordered[low + where[j], j]
        else:
            j = int(dist.std(axis=0).argmax())
            cut = np.median(dist[:, j])
        d = chord(self.points[at] @ self.points[tried[j]])
        inner = d <= cut
        if inner.all() or not inner.any():  # all at one distance: split evenly, the bounds stay right
            inner = np.arange(len(at)) < len(at) // 2
        sides = [(at[m], float(d[m].min()), float(d[m].max())) for m in (inner, ~inner)]
        self.vantages.append(int(tried[j]))
        return (len(self.vantages) - 1, [(self._build(a), lo, hi) for a, lo, hi in sides])

    def leaves(self, queries: np.ndarray, reach, factor: float, evaluate, closest_first: bool = True) -> None:
        """Call ``evaluate(query positions, point positions)`` for leaves that ``reach(positions)`` does not rule out.

        With ``closest_first`` each query meets the closer of two children first, so queries part; without, they stay together.
        """

        far = chord(self.points[self.vantages] @ queries.T)  # a row per node

        def visit(node, qs: np.ndarray) -> None:
            if not len(qs):
                return
            if isinstance(node, np.ndarray):
                evaluate(qs, node)
                return
            vantage, (inner, outer) = node
            d = far[vantage, qs]
            closer_in = np.ones(len(qs), bool) if not closest_first else np.abs(d - np.clip(d, inner[1], inner[2])) <= np.abs(d - np.clip(d, outer[1], outer[2]))
            for first, second, mine in ((inner, outer, closer_in), (outer, inner, ~closer_in)):
                for child, lo, hi in (first, second):
                    group = np.flatnonzero(mine)
                    gap = np.maximum(0.0, np.maximum(lo - d[group], d[group] - hi))
                    visit(child, qs[group[gap * factor <= reach(qs[group]) + 1e-9]])

        visit(self.root, np.arange(len(queries)))


class Sieve:
    """Single precision bounds of cosines from above, from half of the dimensions: x.y is at most the product of the first
    halves plus that of the lengths of the others. Of directions the points spread most in, the first are taken."""

    def __init__(self, queries: np.ndarray, points: np.ndarray):
        self.half = max(1, points.shape[1] // 2)
        axes = np.linalg.eigh(points.T @ points)[1][:, ::-1]
        self.whole = [x.astype(np.float32) for x in (queries, points)]
        self.parts = [self._part(x @ axes) for x in (queries, points)]

    def _part(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt((x[:, self.half :] ** 2).sum(axis=1))
        return np.column_stack([x[:, : self.half], rest]).astype(np.float32)

    def pairs(self, qs: np.ndarray, at: np.ndarray, floor: np.ndarray) -> np.ndarray | None:
        """Numbers query * len(at) + point of all pairs that may reach their query's floor, ascending; None if they are many."""
        q, p = self.parts if np.count_nonzero(floor > 0.7) * 2 > len(floor) else self.whole
        hit = (q[qs] @ p[at].T >= (floor - _SINGLE).astype(np.float32)[:, None]).ravel()
        eights = len(hit) // 8 * 8
        some = np.flatnonzero(hit[:eights].view(np.uint64))
        if len(some) > DENSE * len(hit):
            return None
        n = np.concatenate([(some[:, None] * 8 + np.arange(8)).ravel(), np.arange(eights, len(hit))])
        return n[hit[n]]


def nearest(queries: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int, *, min_cos: float = -1.0, factor: float = 1.0, floor: np.ndarray | None = None, tree: Tree | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(cosines rounded to 9 decimals, positions), both (queries, k), best first, ties by smaller id; position -1: none.

    ``tree``, if there is one already, is that of the points. Nothing below ``min_cos``, or below a query's own ``floor``, is given.
    """
    n = len(queries)
    best, best_id, best_at = np.full((n, k), -np.inf), np.full((n, k), NO_ID), np.full((n, k), -1)

    least = np.full(n, min_cos) if floor is None else np.maximum(floor, min_cos)

    def worst(qs: np.ndarray) -> np.ndarray:
        return np.maximum(best[qs, -1], least[qs])

    sieve = Sieve(queries, points)

    def evaluate(qs: np.ndarray, at: np.ndarray) -> None:
        there = points[at]
        for a in range(0, len(qs), BLOCK):
            block = qs[a : a + BLOCK]
            floor = worst(block) - _ROUND
            pairs = sieve.pairs(block, at, floor)
            if pairs is not None:
                r, c = np.divmod(pairs, len(at))
                cos = np.einsum("ij,ij->i", queries[block[r]], there[c])
                hit = cos >= floor[r]
                r, c, cos = r[hit], c[hit], cos[hit]
            else:
                cos = queries[block] @ there.T
                hit = cos >= floor[:, None]
                many = np.flatnonzero(hit.sum(axis=1) > 4 * k)
                if len(many):
                    top = np.partition(cos[many], -k, axis=1)[:, -k] - _ROUND
                    hit[many] &= cos[many] >= top[:, None]
                r, c = np.nonzero(hit)
                cos = cos[r, c]
            if not len(r):
                continue
            value = np.round(cos, 9)
            keep = value >= least[block[r]]
            r, c, value = r[keep], c[keep], value[keep]
            rows = np.unique(r)
            if not len(rows):
                continue
            q = np.concatenate([np.repeat(rows, k), r])
            v = np.concatenate([best[block[rows]].ravel(), value])
            i = np.concatenate([best_id[block[rows]].ravel(), ids[at[c]]])
            p = np.concatenate([best_at[block[rows]].ravel(), at[c]])
            order = np.lexsort((i, -v, q))
            starts = np.searchsorted(q[order], rows)
            pick = order[(starts[:, None] + np.arange(k)).ravel()]
            best[block[rows]], best_id[block[rows]], best_at[block[rows]] = (x[pick].reshape(-1, k) for x in (v, i, p))

    (tree or Tree(points)).leaves(queries, lambda qs: chord(worst(qs) - _ROUND), factor, evaluate, floor is None)
    return best, best_at


def spanning_links(left: np.ndarray, right: np.ndarray, min_cos: float, *, same: bool, factor: float = 1.0, names: np.ndarray | None = None, tree: Tree | None = None) -> list[tuple[int, int, float]]:
    """Links (left position, right position, cosine) that connect whatever cosines of at least ``min_cos`` connect.

    Nodes are the rows of both blocks (of one block if ``same``). At most one link less than nodes comes back, though all
    pairs are considered: a pair whose ends are connected already adds nothing. Nodes of equal ``names`` (of the left, then
    of the right) count as connected from the start.
    """
    n = len(left)
    label = np.arange(n if same else n + len(right))
    if names is not None:
        _, first, inverse = np.unique(names, return_index=True, return_inverse=True)
        label = first[inverse]
    parent = label.tolist()
    shift = 0 if same else n
    out: list[tuple[int, int, float]] = []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def evaluate(qs: np.ndarray, at: np.ndarray) -> None:
        nonlocal label
        for a in range(0, len(qs), 4096):
            block = qs[a : a + 4096]
            cos = left[block] @ right[at].T
            linked = cos >= min_cos - 5e-10  # as the cosine rounded to 9 decimals
            while True:
                linked &= label[block][:, None] != label[at + shift][None, :]
                rows = np.flatnonzero(linked.any(axis=1))
                if not len(rows):
                    break
                cols = np.flatnonzero(linked.any(axis=0))
                pairs = [*zip(rows.tolist(), linked[rows].argmax(axis=1).tolist()), *zip(linked[:, cols].argmax(axis=0).tolist(), cols.tolist())]
                for r, c in pairs:
                    x, y = find(int(block[r])), find(int(at[c]) + shift)
                    if x != y:
                        parent[max(x, y)] = min(x, y)
                        out.append((int(block[r]), int(at[c]), round(float(cos[r, c]), 9)))
                label = np.array(parent)
                while (label != label[label]).any():
                    label = label[label]

    radius = float(chord(np.array(min_cos - _ROUND)))
    (tree or Tree(right)).leaves(left, lambda qs: radius, factor, evaluate)
    return out
