"""Balls over integer points, built by the anchors hierarchy, which settle many points at once."""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np

from labelspark.llm import arrays

LEAF = 128  # points of a ball that is not divided
#: What floating-point tests may be off by, relative to the size of their terms.
SLACK = 1e-9


@dataclass
class Tree:
    """Balls in such an order that every ball follows the one it lies in. Points are in the order in
    which the balls hold them: ball b holds points first[b] to upto[b]; children child[b] and on,
    n_child[b] of them (0: a leaf)."""

    order: np.ndarray  # original place of each point
    first: np.ndarray
    upto: np.ndarray
    child: np.ndarray
    n_child: np.ndarray
    total: np.ndarray  # exact sums of the points
    radius: np.ndarray

    def parts(self) -> dict[str, np.ndarray]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


def anchors(points: np.ndarray, n: int) -> list[np.ndarray]:
    """Points dealt to n anchors (fewer if fewer differ): each new anchor is the point farthest from its
    own and takes, of each other anchor's points, those nearer to it. Points less than half way to the
    new anchor stay where they are without a distance being computed."""
    x = points.astype(np.float64)
    owner, far = np.zeros(len(x), np.int64), np.sqrt(((x - x[0]) ** 2).sum(axis=1))
    pivots = [0]
    while len(pivots) < n:
        new = int(far.argmax())
        if far[new] == 0:
            break
        gap = np.sqrt(((x[pivots] - x[new]) ** 2).sum(axis=1))
        asked = np.flatnonzero(2 * far >= gap[owner])
        d = np.sqrt(((x[asked] - x[new]) ** 2).sum(axis=1))
        nearer = d < far[asked]
        owner[asked[nearer]], far[asked[nearer]] = len(pivots), d[nearer]
        pivots.append(new)
    by = np.argsort(owner, kind="stable")
    return np.split(by, np.flatnonzero(np.diff(owner[by])) + 1)


class _Node:
    __slots__ = ("points", "children", "total", "count", "centre", "radius")

    def __init__(self, points, children, total, count, centre, radius):
        self.points, self.children, self.total, self.count, self.centre, self.radius = points, children, total, count, centre, radius


def _ball(points: np.ndarray, places: np.ndarray) -> _Node:
    own = points[places]
    total = own.sum(axis=0)
    centre = total / len(places)
    return _Node(places, [], total, len(places), centre, float(np.sqrt(((own - centre) ** 2).sum(axis=1).max())))


def _joined(nodes: list[_Node]) -> _Node:
    """Middle out: of all balls the two whose common ball is smallest are joined, until one is left."""
    nodes = list(nodes)
    centre = np.array([x.centre for x in nodes])
    radius = np.array([x.radius for x in nodes])

    def sizes(k: int) -> np.ndarray:
        gap = np.sqrt(((centre - centre[k]) ** 2).sum(axis=1))
        return np.maximum((gap + radius + radius[k]) / 2, np.maximum(radius, radius[k]))

    cost = np.array([sizes(k) for k in range(len(nodes))])
    np.fill_diagonal(cost, np.inf)
    a = 0
    for _ in range(len(nodes) - 1):
        a, b = divmod(int(np.argmin(cost)), len(nodes))
        x, y = nodes[a], nodes[b]
        total, count = x.total + y.total, x.count + y.count
        middle = total / count
        reach = max(float(np.sqrt(((z.centre - middle) ** 2).sum())) + z.radius for z in (x, y))
        nodes[a] = _Node(None, [x, y], total, count, middle, reach)
        centre[a], radius[a] = middle, reach
        cost[b], cost[:, b] = np.inf, np.inf
        alive = np.isfinite(cost[a])
        alive[a] = False
        own = sizes(a)
        cost[a] = np.where(alive, own, np.inf)
        cost[:, a] = cost[a]
    return nodes[a]


def _grown(points: np.ndarray, places: np.ndarray) -> _Node:
    if len(places) > LEAF:
        groups = anchors(points[places], int(np.sqrt(len(places))))
        if len(groups) > 1:
            return _joined([_grown(points, places[g]) for g in groups])
    return _ball(points, places)


def build(points: np.ndarray) -> Tree:
    """Tree of integer points, one a row; no rows give a tree without balls."""
    nodes = [_grown(points, np.arange(len(points)))] if len(points) else []
    n_child, child, k = [], [], 0
    while k < len(nodes):  # breadth first: the children of a ball are neighbours and follow it
        child.append(len(nodes))
        n_child.append(len(nodes[k].children))
        nodes += nodes[k].children
        k += 1
    order, first = [], np.zeros(len(nodes), np.int32)
    # Points in the order of a walk that goes down before it goes on.
    place, stack = 0, [0] if nodes else []
    while stack:
        k = stack.pop()
        if n_child[k]:
            stack.extend(range(child[k] + n_child[k] - 1, child[k] - 1, -1))
        else:
            order.append(nodes[k].points)
        first[k] = place
        place += 0 if n_child[k] else nodes[k].count
    shape = (len(nodes), points.shape[1])
    return Tree(
        np.concatenate(order).astype(np.int32) if order else np.zeros(0, np.int32), first, first + np.array([x.count for x in nodes], np.int32),
        np.array(child, np.int32), np.array(n_child, np.int32), np.array([x.total for x in nodes], np.int64).reshape(shape),
        np.array([x.radius for x in nodes], np.float64),
    )


def _nearest(points: np.ndarray, entries: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """Nearest allowed entry of each point, ties to the lower index: in floating point, and in whole
    numbers where rounding could have hidden a tie or another order."""
    x, e = points.astype(np.float64), entries.astype(np.float64)
    square = (e**2).sum(axis=1)
    gap = np.where(allowed, square - 2 * x @ e.T, np.inf)
    best = gap.argmin(axis=1)
    scale = (x**2).sum(axis=1) + square.max()
    near = gap <= (gap[np.arange(len(x)), best] + SLACK * scale)[:, None]
    close = np.flatnonzero(near.sum(axis=1) > 1)
    exact = ((points[close][:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
    best[close] = np.where(near[close], exact, np.iinfo(np.int64).max).argmin(axis=1)
    return best


def assign(tree: Tree, points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest entry of each point, sums, counts by entry): squared Euclidean distance, ties to the
    lower index, exact. `points` in the order of the tree.

    A ball inherits the entries that may still own one of its points and drops those that lie farther
    than another for every point of the ball; with one entry left the ball is wholly owned, and its
    cached sum and count are all that is added. Leaves compare their points with the entries left.
    """
    n, k = len(points), len(entries)
    code = np.zeros(n, np.uint8)
    sums, counts = np.zeros((k, points.shape[1]), np.int64), np.zeros(k, np.int64)
    if not n:
        return code, sums, counts
    e = entries.astype(np.float64)
    square = (e**2).sum(axis=1)
    apart = np.sqrt(np.maximum(square[:, None] + square[None, :] - 2 * e @ e.T, 0))
    balls, left = np.array([0]), np.ones((1, k), bool)
    while len(balls):
        size = (tree.upto[balls] - tree.first[balls])[:, None]
        centre, radius = tree.total[balls] / size, tree.radius[balls]
        gap = square[None, :] - 2 * centre @ e.T  # distance to each entry, less what all share
        best = np.where(left, gap, np.inf).argmin(axis=1)
        # Entry j lies farther than the best one for all points of the ball. What is dropped is farther
        # by more than rounding can hide, so that no tie is lost.
        scale = square[best][:, None] + square[None, :] + (centre**2).sum(axis=1)[:, None] + radius[:, None] ** 2
        margin = gap - gap[np.arange(len(balls)), best][:, None] - 2 * radius[:, None] * apart[best]
        left &= ~(margin > SLACK * scale)
        settled = left.sum(axis=1) == 1
        for b, owner in zip(balls[settled], best[settled], strict=True):
            code[tree.first[b] : tree.upto[b]] = owner
        np.add.at(sums, best[settled], tree.total[balls[settled]])
        np.add.at(counts, best[settled], tree.upto[balls[settled]] - tree.first[balls[settled]])
        leaf = ~settled & (tree.n_child[balls] == 0)
        if leaf.any():
            size = tree.upto[balls[leaf]] - tree.first[balls[leaf]]
            at = arrays.ranges(tree.first[balls[leaf]].astype(np.int64), size)
            own = points[at]
            owner = _nearest(own, entries, np.repeat(left[leaf], size, axis=0))
            code[at] = owner
            by = np.argsort(owner, kind="stable")
            head = np.flatnonzero(np.diff(owner[by], prepend=-1))
            sums[owner[by[head]]] += np.add.reduceat(own[by], head, axis=0)
            counts += np.bincount(owner, minlength=k)
        inner = ~settled & ~leaf
        times = tree.n_child[balls[inner]]
        balls, left = arrays.ranges(tree.child[balls[inner]].astype(np.int64), times), np.repeat(left[inner], times, axis=0)
    return code, sums, counts
