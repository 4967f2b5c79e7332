"""Tree layouts planned on a bounded sample.

A tree of blocks is small against the data, so its splits are chosen on the driver from at most SAMPLE points (all of
them, if there are no more) and every point is then routed in one pass over the data, in Arrow batches, by vectorised descent. Splits are
half-open: below the value goes left. Leaves that are larger than promised in the full data are cut by Layout.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 1_000_000


def bounded(points: DataFrame, limit: int = SAMPLE, seed: int = 1) -> tuple[np.ndarray, float]:
    """(x, y) of at most about `limit` points, and their share of all points."""
    n = points.count()
    share = min(1.0, limit / max(n, 1))
    picked = points if share == 1 else points.where(F.pmod(F.xxhash64("pid", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)))
    # Arrow columns: rows as Python objects would take the driver ten times the memory
    found = picked.select("x", "y").toArrow()
    xy = np.stack([found[c].to_numpy().astype(np.float64) for c in ("x", "y")], axis=1)
    return xy[np.lexsort((xy[:, 1], xy[:, 0]))], share


def collected(windows: DataFrame | None, limit: int = 20_000) -> np.ndarray:
    """A training workload (lx, ly, hx, hy): at most `limit` windows, by hash of qid."""
    if windows is None:
        return np.zeros((0, 4))
    w = windows.select("qid", "lx", "ly", "hx", "hy").orderBy(F.xxhash64("qid"), "qid").limit(limit).toPandas()
    return w.sort_values("qid")[["lx", "ly", "hx", "hy"]].to_numpy(np.float64).reshape(-1, 4)


@dataclass
class Tree:
    """Binary splits; leaves are negative: child -1 - k is leaf k, and leaves are numbered in order from left to right."""

    dim: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    leaves: int = 0

    def add(self, dim: int, value: float) -> int:
        self.dim.append(dim)
        self.value.append(value)
        self.left.append(0)
        self.right.append(0)
        return len(self.dim) - 1

    def leaf(self) -> int:
        self.leaves += 1
        return -self.leaves

    def route(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        if not self.dim:
            return np.zeros(len(x), np.int64)
        dim, value, left, right = (np.asarray(a) for a in (self.dim, self.value, self.left, self.right))
        node = np.zeros(len(x), np.int64)
        open_ = np.arange(len(x))
        while len(open_):
            at = node[open_]
            below = np.where(dim[at] == 0, x[open_], y[open_]) < value[at]
            node[open_] = np.where(below, left[at], right[at])
            open_ = open_[node[open_] >= 0]
        return -1 - node

    def nodes(self, spark) -> DataFrame:
        """node_id (children 2i + 1 and 2i + 2), dim, value: the file form of a skeleton; deep trees need long ids."""
        rows, todo = [], [(0, 0)] if self.dim else []
        while todo:
            node, name = todo.pop()
            rows.append((name, self.dim[node], float(self.value[node])))
            todo += [(c, n) for c, n in ((self.left[node], 2 * name + 1), (self.right[node], 2 * name + 2)) if c >= 0]
        return spark.createDataFrame(sorted(rows), "node_id bigint, dim int, value double")

    @staticmethod
    def of_nodes(nodes: DataFrame) -> Tree:
        known = {r["node_id"]: (r["dim"], r["value"]) for r in nodes.collect()}
        tree = Tree()

        def build(name: int) -> int:
            if name not in known:
                return tree.leaf()
            node = tree.add(*known[name])
            tree.left[node] = build(2 * name + 1)
            tree.right[node] = build(2 * name + 2)
            return node

        build(0)
        return tree


def routed(points: DataFrame, tree: Tree) -> DataFrame:
    """points with leaf."""

    @F.pandas_udf("bigint")
    def leaf(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(tree.route(x.to_numpy(np.float64), y.to_numpy(np.float64)))

    return points.withColumn("leaf", leaf("x", "y"))


def grow(xy: np.ndarray, limit: float, choose) -> Tree:
    """Splits nodes of more than `limit` points. choose(points, box, depth) gives (dim, value), or None for a leaf.

    A split that leaves one side empty is tried in the other dimension's middle; equal points are a leaf.
    """
    tree = Tree()
    whole = np.array([-np.inf, -np.inf, np.inf, np.inf])

    def split_of(part: np.ndarray, box: np.ndarray, depth: int):
        if len(part) <= limit or (part == part[0]).all():
            return None
        split = choose(part, box, depth)
        if split is None:
            return None
        for dim, value in (split, (split[0], middle(part, split[0])), (1 - split[0], middle(part, 1 - split[0]))):
            below = part[:, dim] < value
            if 0 < below.sum() < len(part):
                return dim, value, below
        return None

    # open nodes instead of recursion: unbalanced trees may be as deep as they have leaves, and the parts held are those of
    # disjoint nodes, never a node's and its descendants'
    todo = [(xy, whole, 0, None, False)]
    while todo:
        part, box, depth, parent, up = todo.pop()
        split = split_of(part, box, depth)
        node = tree.leaf() if split is None else tree.add(split[0], float(split[1]))
        if parent is not None:
            setattr_side(tree, parent, up, node)
        if split is not None:
            dim, value, below = split
            low, high = box.copy(), box.copy()
            low[dim + 2] = high[dim] = value
            todo += [(part[~below], high, depth + 1, node, True), (part[below], low, depth + 1, node, False)]
    return tree


def middle(part: np.ndarray, dim: int) -> float:
    low, high = part[:, dim].min(), part[:, dim].max()
    value = low + (high - low) / 2
    return value if value > low else high


def kd_split(part, box, depth):
    return depth % 2, middle(part, depth % 2)


def random_split(seed: int):
    """The dimension by a hash of the node's box, so that a seed gives one tree."""

    def choose(part, box, depth):
        dim = int(np.random.default_rng([seed, depth, *np.frombuffer(box.tobytes(), np.uint32)]).integers(2))
        return dim, middle(part, dim)

    return choose


def overlapping(windows: np.ndarray, box: np.ndarray) -> np.ndarray:
    """Which windows may hold points of a region or box."""
    return (box[0] < windows[:, 2]) & (box[2] >= windows[:, 0]) & (box[1] < windows[:, 3]) & (box[3] >= windows[:, 1])


def scan_cost(xy: np.ndarray, windows: np.ndarray, tree: Tree) -> int:
    """Points in the leaves that the windows meet, summed over the windows."""
    if not len(xy) or not len(windows):
        return 0
    leaf = tree.route(xy[:, 0], xy[:, 1])
    n = np.bincount(leaf, minlength=tree.leaves)
    boxes = np.full((tree.leaves, 4), [np.inf, np.inf, -np.inf, -np.inf])
    np.minimum.at(boxes[:, 0], leaf, xy[:, 0])
    np.minimum.at(boxes[:, 1], leaf, xy[:, 1])
    np.maximum.at(boxes[:, 2], leaf, xy[:, 0])
    np.maximum.at(boxes[:, 3], leaf, xy[:, 1])
    return int(sum(n[(boxes[:, 0] < w[2]) & (boxes[:, 2] >= w[0]) & (boxes[:, 1] < w[3]) & (boxes[:, 3] >= w[1])].sum() for w in windows))


def search_random(xy: np.ndarray, windows: np.ndarray, limit: float, tries: int = 500, patience: int = 25, share: float = 0.1) -> tuple[int, Tree]:
    """The seed of the cheapest of `tries` random trees over a share of the points; ends after `patience` tries without gain."""
    part = xy[:: max(1, round(1 / share))]
    best, found, since = None, (0, grow(part, limit * share, random_split(0))), 0
    for seed in range(tries):
        tree = grow(part, max(1, limit * share), random_split(seed))
        cost = scan_cost(part, windows, tree)
        if best is None or cost < best:
            best, found, since = cost, (seed, tree), 0
        else:
            since += 1
            if since >= patience:
                break
    return found


def greedy_split(windows: np.ndarray, limit: float = 0.0, cuts: int = 512):
    """The cut with the most window-point pairs skipped, of `cuts` quantiles in each dimension that leave more than half a block
    (of `limit` points) on both sides. Where none does or none skips anything, the median."""

    def choose(part, box, depth):
        inside = windows[overlapping(windows, box)]
        best = None
        for dim in (0, 1):
            values = np.unique(np.quantile(part[:, dim], np.linspace(0, 1, min(cuts, len(part)) + 1)[1:-1])) if len(part) > 2 else part[:, dim]
            values = values[(values > part[:, dim].min()) & (values <= part[:, dim].max())]
            if not len(values):
                continue
            order = np.sort(part[:, dim])
            below = np.searchsorted(order, values, "left")
            filled = (below > limit / 2) & (len(part) - below > limit / 2)
            values, below = values[filled], below[filled]
            if not len(values):
                continue
            misses_low = (inside[:, dim][None, :] >= values[:, None]).sum(axis=1)
            misses_high = (inside[:, dim + 2][None, :] <= values[:, None]).sum(axis=1)
            gain = misses_low * below + misses_high * (len(part) - below)
            k = int(gain.argmax())
            if best is None or gain[k] > best[0]:
                best = (int(gain[k]), dim, float(values[k]))
        return (best[1], best[2]) if best and best[0] > 0 else (depth % 2, float(np.median(part[:, depth % 2])))

    return choose


def perimeter_split(limit: float, windows: np.ndarray | None = None, top: int = 16):
    """The legal position (a quarter of the node from either end at least, as for the reference's blocks and nodes) of the smallest sum
    of perimeters; with windows, the cheapest for the workload (points times windows met) of the `top` positions by perimeter.
    Where ties leave no legal position, the most even one. So a tree's depth grows with the logarithm of its leaves."""

    def options(part: np.ndarray, dim: int, even: bool = False) -> np.ndarray:
        """cost, dim, value, position and both boxes of the legal positions, or of the most even one."""
        place = np.argsort(part[:, dim], kind="stable")
        own, other = part[place, dim], part[place, 1 - dim]
        n, step = len(part), max(1, int(limit))
        cuts = 1 + np.flatnonzero(own[1:] > own[:-1])
        at = cuts[(4 * cuts >= n) & (4 * cuts <= 3 * n)]
        if n > 4 * limit and (at % step == 0).any():  # whole blocks on both sides
            at = at[at % step == 0]
        if even:
            at = cuts[np.argsort(np.abs(2 * cuts - n), kind="stable")[:1]]
        found = np.empty((len(at), 12))
        found[:, 1], found[:, 2], found[:, 3] = dim, own[at], at
        a, b = found[:, 4:8], found[:, 8:]
        a[:, dim], a[:, dim + 2], b[:, dim], b[:, dim + 2] = own[0], own[at - 1], own[at], own[-1]
        a[:, 1 - dim], a[:, 3 - dim] = np.minimum.accumulate(other)[at - 1], np.maximum.accumulate(other)[at - 1]
        b[:, 1 - dim], b[:, 3 - dim] = np.minimum.accumulate(other[::-1])[::-1][at], np.maximum.accumulate(other[::-1])[::-1][at]
        found[:, 0] = 2 * ((a[:, 2] - a[:, 0]) + (a[:, 3] - a[:, 1]) + (b[:, 2] - b[:, 0]) + (b[:, 3] - b[:, 1]))
        return found

    def choose(part, box, depth):
        found = np.concatenate([options(part, 0), options(part, 1)])
        if not len(found):
            found = np.concatenate([options(part, 0, True), options(part, 1, True)])
            if not len(found):
                return None
            found = found[np.abs(2 * found[:, 3] - len(part)) == np.abs(2 * found[:, 3] - len(part)).min()]
        best = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))[:top]]
        if windows is not None and len(windows):
            # windows that miss the node miss both of its sides
            inside = windows[overlapping(windows, np.concatenate([part.min(axis=0), part.max(axis=0)]))]
            scan = lambda o: int(overlapping(inside, o[4:8]).sum()) * int(o[3]) + int(overlapping(inside, o[8:]).sum()) * (len(part) - int(o[3]))
            best = [min(best, key=lambda o: (scan(o), o[0]))]
        return int(best[0][1]), float(best[0][2])

    return choose


# --- four-way trees: a node splits at (px, py); children A (low x, low y), B (high x, low y), C (low x, high y), D, or A, C, B, D


def median_point(part: np.ndarray) -> tuple[float, float]:
    n = len(part)
    return float(np.sort(part[:, 0])[n // 2]), float(np.sort(part[:, 1])[n // 2])


def blocks_read(n: int, limit: float) -> float:
    """Points that a quadrant of n points is taken to cost: one block, or blocks of a four-way tree over it."""
    return limit if n <= limit else (3 * np.ceil((n - limit) / (3 * limit)) + 1) * limit


def objective(counts, starts, ends, limit: float) -> tuple[float, bool]:
    """Cost of a four-way split and whether the order A, C, B, D is the cheaper one.

    counts, starts, ends: points, window low corners and window high corners in A, B, C, D. A quadrant under a quarter of a block
    rules the split out. Starts and ends count one more than there are.
    """
    if min(counts) < 0.25 * limit:
        return float("inf"), False
    na, nb, nc, nd = (blocks_read(n, limit) for n in counts)
    sa, sb, sc, sd = (s + 1 for s in starts)
    ea, eb, ec, ed = (e + 1 for e in ends)
    low = na * (sa + ea) + nb * (sb + eb) + nc * (sc + ec) + nd * (sd + ed)
    common = na * (eb + ec + ed) + nb * (sa + ed) + nc * (sa + ed) + nd * (sa + sb + sc)
    yx, xy = common + ec + sb, common + eb + sc
    return low + min(yx, xy), yx > xy


def quadrant_counts(xy: np.ndarray, px: float, py: float) -> list[int]:
    right, top = xy[:, 0] >= px, xy[:, 1] >= py
    return [int((~right & ~top).sum()), int((right & ~top).sum()), int((~right & top).sum()), int((right & top).sum())]


def grow_quad(xy: np.ndarray, limit: float, windows: np.ndarray | None = None, seed: int = 7) -> tuple[Tree, list[tuple[int, float, float, bool]]]:
    """A four-way tree as binary splits, leaves in curve order, and its nodes (id with children 4i + 1 to 4i + 4, px, py, ordering).

    Without windows the split is the median point. With windows, the cheapest by objective() of the median and of random candidate points,
    where more than one window corner is in the node.
    """
    tree, nodes = Tree(), []
    rng = np.random.default_rng(seed)

    def choose(part, low, high):
        best = (*median_point(part), False)
        if windows is None or len(low) + len(high) <= 1:
            return best
        cost = objective(quadrant_counts(part, *best[:2]), quadrant_counts(low, *best[:2]), quadrant_counts(high, *best[:2]), limit)
        best, least = (*best[:2], cost[1]), cost[0]
        tries = max(100, int(len(part) ** 0.5))
        for px, py in zip(part[rng.integers(len(part), size=tries), 0], part[rng.integers(len(part), size=tries), 1], strict=True):
            cost = objective(quadrant_counts(part, px, py), quadrant_counts(low, px, py), quadrant_counts(high, px, py), limit)
            if cost[0] < least:
                best, least = (float(px), float(py), cost[1]), cost[0]
        return best

    def build(part, low, high, name) -> int:
        if len(part) <= limit or (part == part[0]).all():
            return tree.leaf()
        px, py, flipped = choose(part, low, high)
        if max(quadrant_counts(part, px, py)) == len(part):
            dim = 0 if part[:, 0].min() < part[:, 0].max() else 1
            px, py = (middle(part, 0) if dim == 0 else -np.inf), (middle(part, 1) if dim == 1 else -np.inf)
        nodes.append((name, float(px), float(py), flipped))
        first, second = (0, 1) if flipped else (1, 0)
        value = (px, py)
        root = tree.add(first, value[first])
        cut = lambda a, dim, up: a[(a[:, dim] >= value[dim]) == up] if len(a) else a
        child = 4 * name + 1
        for up in (False, True):
            inner = tree.add(second, value[second])
            setattr_side(tree, root, up, inner)
            for up2 in (False, True):
                take = lambda a: cut(cut(a, first, up), second, up2)  # noqa: B023, E731
                setattr_side(tree, inner, up2, build(take(part), take(low), take(high), child))
                child += 1
        return root

    if len(xy):
        low = windows[:, :2] if windows is not None else np.zeros((0, 2))
        high = windows[:, 2:] if windows is not None else np.zeros((0, 2))
        build(xy, low, high, 0)
    else:
        tree.leaf()
    return tree, nodes


def setattr_side(tree: Tree, node: int, up: bool, child: int) -> None:
    (tree.right if up else tree.left)[node] = child
