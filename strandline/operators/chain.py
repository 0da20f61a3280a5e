"""Clustering and chaining of anchors and blocks.

What is an ordered sum, a rank or a neighbour is a window; optimal chains are
sequential and run as folds over their group's rows.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from heapq import heapify, heappop
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.expr import block_gap_cost
from strandline.operators.grouped import map_groups
from strandline.operators.intervals import islands
from strandline.session import dealt


def cluster_diagonals(anchors: DataFrame, partition: list[str], max_dist: int = 30, min_cluster: int = 50, by_span: bool = False) -> DataFrame:
    """Blocks of anchors (s1, s2, length, orient) on one diagonal whose gaps stay below ``max_dist``.

    Reverse anchors share an antidiagonal. A block's score is the sum of its
    lengths, and blocks below ``min_cluster`` go; ``by_span`` it is the length
    from end to end, and blocks of ``min_cluster`` go too.
    """
    e1, e2 = F.col("s1") + F.col("length"), F.col("s2") + F.col("length")
    diag = F.when(F.col("orient") == 0, F.col("s1") - F.col("s2")).otherwise(F.col("s1") + e2)
    keys = [*partition, "orient", "diag"]
    rows = dealt(anchors.withColumn("e1", e1).withColumn("e2", e2).withColumn("diag", diag), *keys)
    w = Window.partitionBy(*keys).orderBy("s1", "length")
    runs = islands(rows, keys, ["s1", "length"], F.col("s1") - F.lag("e1").over(w) >= max_dist)
    out = runs.groupBy(*keys, "island").agg(F.min("s1").alias("s1"), F.max("e1").alias("e1"), F.min("s2").alias("s2"), F.max("e2").alias("e2"), F.sum("length").alias("score"))
    if by_span:
        out = out.withColumn("score", F.col("e1") - F.col("s1"))
    return out.where(F.col("score") > min_cluster if by_span else F.col("score") >= min_cluster).select(*partition, "s1", "e1", "s2", "e2", "orient", "score")


def merge_consecutive(blocks: DataFrame, partition: list[str], same: list[str] | None = None) -> DataFrame:
    """Blocks that are neighbours on both axes, with one orientation and equal in the columns ``same``, become one."""
    rank2 = F.row_number().over(Window.partitionBy(*partition).orderBy("s2", "e2", "s1"))
    ranked = dealt(blocks, *partition).withColumn("r2", rank2)
    w = Window.partitionBy(*partition).orderBy("s1", "e1", "s2")
    step = F.when(F.col("orient") == 0, F.lit(1)).otherwise(F.lit(-1))
    new = (F.col("orient") != F.lag("orient").over(w)) | (F.col("r2") - F.lag("r2").over(w) != step)
    for c in same or []:
        new = new | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    runs = islands(ranked, partition, ["s1", "e1", "s2"], new)
    return runs.groupBy(*partition, "island", *(same or [])).agg(F.min("s1").alias("s1"), F.max("e1").alias("e1"), F.min("s2").alias("s2"), F.max("e2").alias("e2"), F.first("orient").alias("orient"), F.sum("score").alias("score"), F.count(F.lit(1)).alias("blocks")).drop("island")


def extend_blocks(blocks: DataFrame, partition: list[str], axis: str, low: int, high: str) -> DataFrame:
    """Stretch blocks along an axis to its ends and to the middle (floor) of the gaps between neighbours."""
    s, e = f"s{axis}", f"e{axis}"
    w = Window.partitionBy(*partition).orderBy(s, e)
    prev, nxt = F.lag(e).over(w), F.lead(s).over(w)
    left = F.when(prev.isNull(), F.lit(low)).when(prev < F.col(s), prev + F.floor((F.col(s) - prev) / 2)).otherwise(F.col(s))
    right = F.when(nxt.isNull(), F.col(high)).when(nxt > F.col(e), F.col(e) + F.floor((nxt - F.col(e)) / 2)).otherwise(F.col(e))
    return blocks.withColumn("__s", left.cast("bigint")).withColumn("__e", right.cast("bigint")).drop(s, e).withColumnsRenamed({"__s": s, "__e": e})


def chain_score(blocks: DataFrame, partition: list[str], alpha: float = 2, **costs: float) -> DataFrame:
    """Weight and cost of each partition's blocks in order of the first axis: ``weight, cost, score``."""
    w = Window.partitionBy(*partition).orderBy("s1", "e1", "s2")
    names = ("s1", "e1", "s2", "e2", "orient")
    prev = {n: F.lag(n).over(w) for n in names}
    rows = blocks.withColumn("__cost", F.when(prev["s1"].isNull(), F.lit(0.0)).otherwise(block_gap_cost(prev, {n: F.col(n) for n in names}, **costs)))
    out = rows.groupBy(*partition).agg((F.sum("score") * F.lit(float(alpha))).alias("weight"), F.sum("__cost").alias("cost"))
    return out.withColumn("score", F.col("weight") - F.col("cost"))


class _Steps:
    """Best (value, -index) of points that lie at or below ``x`` in one order and at or below ``y`` in another.

    A Fenwick tree over the ranks of the first; every node keeps its points as
    a staircase, ascending in ``y`` and in value, of which others are no better.
    """

    def __init__(self, xs: list):
        self.xs = sorted(set(xs))
        self.ys: list[list] = [[] for _ in range(len(self.xs) + 1)]
        self.best: list[list] = [[] for _ in range(len(self.xs) + 1)]

    def add(self, x, y, value: tuple) -> None:
        i = bisect_left(self.xs, x) + 1
        while i < len(self.ys):
            ys, best = self.ys[i], self.best[i]
            at = bisect_right(ys, y)
            if not at or best[at - 1] < value:
                to = at
                while to < len(ys) and best[to] <= value:
                    to += 1
                if at and ys[at - 1] == y:
                    at -= 1
                ys[at:to], best[at:to] = [y], [value]
            i += i & -i

    def top(self, x, y) -> tuple | None:
        i, out = bisect_right(self.xs, x), None
        while i:
            at = bisect_right(self.ys[i], y)
            if at and (out is None or self.best[i][at - 1] > out):
                out = self.best[i][at - 1]
            i -= i & -i
        return out


class _Box:
    """A k-d tree over points; nodes know their bounds and the best score that was put into them."""

    LEAF = 8

    def __init__(self, points: list[tuple]):
        self.points, self.dims = points, len(points[0])
        self.order = list(range(len(points)))
        self.nodes: list[tuple] = []  # first, end, least and most of each axis, children or None
        self.best: list[float] = []
        self.home = [0] * len(points)  # the leaf of each point
        self.up: list[int] = []
        self.score: list[float | None] = [None] * len(points)
        stack = [(0, len(points), 0, -1)]
        while stack:
            a, b, axis, parent = stack.pop()
            own = [points[i] for i in self.order[a:b]]
            low, high = (tuple(f(p[d] for p in own) for d in range(self.dims)) for f in (min, max))
            n = len(self.nodes)
            self.nodes.append((a, b, low, high, []))
            self.best.append(-math.inf)
            self.up.append(parent)
            if parent >= 0:
                self.nodes[parent][4].append(n)
            if b - a > self.LEAF and low != high:
                axis = max(range(self.dims), key=lambda d: high[d] - low[d])
                self.order[a:b] = sorted(self.order[a:b], key=lambda i: points[i][axis])
                m = (a + b) // 2
                stack += [(a, m, axis, n), (m, b, axis, n)]
            else:
                for i in self.order[a:b]:
                    self.home[i] = n

    def add(self, i: int, score: float) -> None:
        self.score[i] = score
        n = self.home[i]
        while n >= 0 and self.best[n] < score:
            self.best[n] = score
            n = self.up[n]

    def top(self, at: tuple, least: float, bound, exact, floor: tuple | None = None) -> tuple[float, int] | None:
        """The best ``score - exact(point)``, at least ``least``, and of equal ones the smallest index, of points that do not exceed ``at`` nor fall short of ``floor``; ``bound(low, high)`` is what a box costs at least."""
        out = None
        outside = lambda low, high: any(x > y for x, y in zip(low, at, strict=True)) or (floor is not None and any(x < y for x, y in zip(high, floor, strict=True)))
        stack = [0]
        while stack:
            n = stack.pop()
            a, b, low, high, below = self.nodes[n]
            if self.best[n] < least or outside(low, high) or self.best[n] - bound(low, high) < least:
                continue
            if below:
                stack += sorted(below, key=self.best.__getitem__)
                continue
            for i in self.order[a:b]:
                if self.score[i] is None or outside(self.points[i], self.points[i]):
                    continue
                total = self.score[i] - exact(self.points[i])
                if total > least or (total == least and (out is None or i < out[1])):
                    out, least = (total, i), total
        return out


def _pair_costs(at: tuple, penalty: float):
    """Sum-of-pairs gap cost from a point to ``at``, and a lower bound of it from a box."""
    pairs = list(combinations(range(len(at)), 2))

    def exact(p: tuple) -> float:
        d = [x - y for x, y in zip(at, p, strict=True)]
        return penalty * sum(abs(d[a] - d[b]) for a, b in pairs)

    def bound(low: tuple, high: tuple) -> float:
        cost = 0
        for a, b in pairs:
            own = at[a] - at[b]
            cost += max(0, low[a] - high[b] - own, own - high[a] + low[b])
        return penalty * cost

    return exact, bound


def best_chain(anchors: list[tuple], n: int = 2, match: float = 1.0, penalty: float = 1.0) -> tuple[list[int], float]:
    """Best colinear chain of anchors (start in each dimension ..., length): each begins at or after the end of the one before in all dimensions.

    An anchor gains ``match * length * n * (n - 1) / 2``; a link costs
    ``penalty`` times the sum-of-pairs gap cost. Ties go to the smaller start.
    Anchors are swept along the first axis and become predecessors at their
    ends. On two axes the cost is by the diagonals' distance: those on one side
    are searched by diagonal and second axis, those on the other by diagonal
    alone, since what they precede on the first axis they precede on the second;
    both in logarithmic time. On more axes a k-d tree over the ends is searched,
    boxes that cannot pay left out.
    """
    if not anchors:
        return [], 0.0
    order = sorted(range(len(anchors)), key=lambda i: anchors[i])
    starts = [anchors[i][:-1] for i in order]
    ends = [tuple(x + anchors[i][-1] for x in anchors[i][:-1]) for i in order]
    gain = [match * anchors[i][-1] * n * (n - 1) / 2.0 for i in order]
    score, back = list(map(float, gain)), [-1] * len(order)
    coming = [(ends[i][0], i) for i in range(len(order))]
    heapify(coming)
    flat = len(starts[0]) == 2
    if flat:
        diagonals = [e[0] - e[1] for e in ends]
        below, above = _Steps(diagonals), _Steps([-d for d in diagonals])
    else:
        tree = _Box(ends)
    for i, at in enumerate(starts):
        while coming and coming[0][0] <= at[0] and coming[0][1] < i:
            j = heappop(coming)[1]
            if flat:
                below.add(diagonals[j], ends[j][1], (score[j] + penalty * diagonals[j], -j))
                above.add(-diagonals[j], 0, (score[j] - penalty * diagonals[j], -j))
            else:
                tree.add(j, score[j])
        if flat:
            d = at[0] - at[1]
            found = [(v[0] + sign * penalty * d, -v[1]) for v, sign in ((below.top(d, at[1]), -1), (above.top(-d, 0), 1)) if v]
            top = min(found, key=lambda x: (-x[0], x[1])) if found else None
        else:
            exact, bound = _pair_costs(at, penalty)
            top = tree.top(at, 0.0, bound, exact)
        if top and top[0] > 0:
            score[i], back[i] = gain[i] + top[0], top[1]
    at = max(range(len(order)), key=lambda i: (score[i], -i))
    top, path = score[at], []
    while at >= 0:
        path.append(order[at])
        at = back[at]
    return path[::-1], top


def convex_cost(gap: float, penalty: float) -> float:
    """What a difference of two distances costs: its logarithm, as the convex model of :func:`strandline.functions.expr.gap_cost`."""
    return penalty * math.log1p(gap)


def _follow(rows: list[tuple], ends: list[tuple], score: list[float], back: list[int], first: int, last: int, window: int, penalty: float) -> None:
    """Best predecessors of the anchors ``first`` to ``last`` among themselves, in order."""
    coming = [(ends[i][0], i) for i in range(first, last)]
    heapify(coming)
    tree = _Box(ends[first:last])
    for i in range(first, last):
        s1, s2, n = rows[i]
        while coming and coming[0][0] <= s1 and coming[0][1] < i:
            j = heappop(coming)[1]
            tree.add(j - first, score[j])
        exact = lambda p: convex_cost(abs((s1 - p[0]) - (s2 - p[1])), penalty)  # noqa: E731, B023
        bound = lambda low, high: convex_cost(max(0, low[0] - high[1] - s1 + s2, s1 - s2 - high[0] + low[1]), penalty)  # noqa: E731, B023
        found = tree.top((s1, s2), 0.0, bound, exact, (s1 - window, s2 - window))
        if found and found[0] > 0:
            score[i], back[i] = n + found[0], found[1] + first


def peeled(anchors: list[tuple], least: int, window: int, penalty: float = 1.0) -> list[list[int]]:
    """Local chains of anchors (s1, s2, length), best first: each anchor is in one at most.

    An anchor follows one that ends before it on both axes, ``window`` letters
    at most, or begins a chain anew; links cost :func:`convex_cost`. The best
    end's chain is taken back to its beginning or to an anchor that is taken
    already; what is left of a chain counts by its letters alone and stays if it
    has ``least``.
    """
    if not anchors:
        return []
    order = sorted(range(len(anchors)), key=lambda i: anchors[i])
    rows = [anchors[i] for i in order]
    ends = [(r[0] + r[2], r[1] + r[2]) for r in rows]
    score, back = [float(r[2]) for r in rows], [-1] * len(rows)
    stretch, far = [0], -math.inf  # where each stretch that no window reaches into begins
    for i, (s1, _, _) in enumerate(rows):
        if i and s1 - window > far:
            stretch.append(i)
        far = max(far, ends[i][0])
    for first, last in zip(stretch, [*stretch[1:], len(rows)], strict=True):
        if last - first > 1:
            _follow(rows, ends, score, back, first, last, window, penalty)
    taken, out = [False] * len(rows), []
    for end in sorted(range(len(rows)), key=lambda i: (-score[i], i)):
        at, own = end, []
        while at >= 0 and not taken[at]:
            own.append(at)
            at = back[at]
        if own and sum(rows[i][2] for i in own) >= least:
            for i in own:
                taken[i] = True
            out.append([order[i] for i in reversed(own)])
    return out


def local_chains(anchors: DataFrame, keys: list[str], least: int, window: int, penalty: float = 1.0) -> DataFrame:
    """``keys, orient, chain, step, s1, s2, length, chain_length``: chains of each group and strand of ``anchors(s1, s2, length, orient)``, as :func:`peeled` says.

    On the reverse strand a chain descends on the second axis. A strand of a
    group is folded as one, in the order of the first axis.
    """
    kinds = ", ".join(f"`{k}` {anchors.schema[k].dataType.simpleString()}" for k in keys)
    n = len(keys)

    def fold(cols: list[list]) -> list[tuple]:
        sign = -1 if cols[n][0] else 1
        rows = list(zip(*cols[n + 1 :], strict=True))
        turned = [(s1, s2 if sign > 0 else -s2 - m, m) for s1, s2, m in rows]
        head = tuple(c[0] for c in cols[: n + 1])
        out = []
        for chain, own in enumerate(peeled(turned, least, window, penalty)):
            total = sum(rows[i][2] for i in own)
            out += [(*head, chain, step, *rows[i], total) for step, i in enumerate(own)]
        return out

    own = anchors.select(*keys, F.col("orient").cast("int").alias("orient"), *[F.col(c).cast("bigint").alias(c) for c in ("s1", "s2", "length")])
    return map_groups(own, [*keys, "orient"], ["s1", "s2", "length"], fold, f"{kinds}, orient int, chain int, step int, s1 bigint, s2 bigint, length bigint, chain_length bigint")


def colinear_chains(anchors: DataFrame, key: str, match: float = 1.0, penalty: float = 1.0) -> DataFrame:
    """Best chain of each group of anchors (r_start, q_start, length): the group's anchors on it with ``step`` and ``chain_score``."""
    schema = f"{key} {anchors.schema[key].dataType.simpleString()}, step int, r_start bigint, q_start bigint, length bigint, chain_score double"

    def fold(cols: list[list]) -> list[tuple]:
        rows = list(zip(*cols[1:], strict=True))
        path, top = best_chain(rows, 2, match, penalty)
        return [(cols[0][0], step, *rows[i], top) for step, i in enumerate(path)]

    return map_groups(anchors.select(key, "r_start", "q_start", "length"), [key], ["r_start", "q_start", "length"], fold, schema)


def link_cost(p: tuple, c: tuple, gap_open: float = 1, rearrangement: float = 10_000, inversion: float = 5, lam: float = 3, eps: float = 2) -> float:
    """:func:`strandline.functions.expr.block_gap_cost` of two blocks (s1, e1, s2, e2, orient, ...)."""
    d1 = c[0] - p[1]
    if p[4] != c[4]:
        a, b = max(d1, 0), max(c[2] - p[3], p[2] - c[3], 0)
        return gap_open + inversion + min(rearrangement, lam * abs(a - b)) + eps * min(a, b)
    d2 = c[2] - p[3] if c[4] == 0 else p[2] - c[3]
    if d2 < 0:
        return gap_open + rearrangement + eps * max(d1, 0)
    return gap_open + min(rearrangement, lam * abs(d1 - d2)) + eps * max(min(d1, d2), 0)


class _Diagonals:
    """Scores of blocks in the order of their diagonals, as a binary tree of maxima."""

    def __init__(self, keys: list):
        self.order = sorted(range(len(keys)), key=lambda i: keys[i])
        self.keys = [keys[i] for i in self.order]
        self.place = [0] * len(keys)
        for r, i in enumerate(self.order):
            self.place[i] = r
        self.size = 1 << max(0, len(keys) - 1).bit_length()
        self.best = [-math.inf] * (2 * self.size)

    def add(self, i: int, score: float) -> None:
        n = self.size + self.place[i]
        while n and self.best[n] < score:
            self.best[n] = score
            n //= 2

    def near(self, key, most: float, slope: float, fixed: float, slack: int, held: list[float]):
        """Indices of blocks whose score less ``fixed + min(most, slope * distance of the keys, less slack)`` reaches ``held[0]``, which the caller raises."""
        stack = [(1, 0, self.size)]
        while stack:
            n, a, w = stack.pop()
            if self.best[n] == -math.inf:
                continue
            low, high = self.keys[a], self.keys[min(a + w, len(self.keys)) - 1]
            if self.best[n] - fixed - min(most, slope * max(0, low - key - slack, key - high - slack)) < held[0]:
                continue
            if w == 1:
                yield self.order[a]
                continue
            half = w // 2
            pair = [(2 * n, a, half), (2 * n + 1, a + half, half)]
            stack += sorted(pair, key=lambda x: self.best[x[0]])


def best_blocks(rows: list[tuple], look_back: int | None = None, alpha: float = 2, gap_open: float = 1, rearrangement: float = 10_000, inversion: float = 5, lam: float = 3, eps: float = 2) -> tuple[list[int], float]:
    """Best chain of blocks (s1, e1, s2, e2, orient, score) that come in order of the first axis, as :func:`glocal_chains` says.

    A link costs its opening and, up to the cost of a rearrangement, ``lam`` for
    each letter between the diagonals, on the reverse strand the antidiagonals,
    and across strands one of both, but for the length of blocks that overlap.
    So predecessors are searched in trees over diagonals and antidiagonals, of
    which subtrees that are too far off or score too little are left out.
    """
    if not rows:
        return [], 0.0
    best, back = [float(alpha * r[5]) for r in rows], [-1] * len(rows)
    own = {o: [i for i, r in enumerate(rows) if r[4] == o] for o in {r[4] for r in rows}}
    place = {o: {i: n for n, i in enumerate(at)} for o, at in own.items()}
    straight = {o: _Diagonals([rows[i][1] - rows[i][3] for i in at]) for o, at in own.items()}
    reverse = {o: _Diagonals([rows[i][1] + rows[i][2] for i in at]) for o, at in own.items()}
    slack = max(r[1] - r[0] for r in rows) + 2 * max(r[3] - r[2] for r in rows)
    for i, c in enumerate(rows):
        held = [best[i] - alpha * c[5]]
        searched = [(straight, c[0] - c[2]), (reverse, c[0] + c[3])]
        for o in own:
            fixed, wide = (gap_open, 0) if o == c[4] else (gap_open + inversion, slack)
            for trees, key in searched if o != c[4] else searched[:1] if o == 0 else searched[1:]:
                for n in trees[o].near(key, rearrangement, lam, fixed, wide, held):
                    j = own[o][n]
                    p = rows[j]
                    if (look_back is not None and j < i - look_back) or p[0] == c[0] or p[1] >= c[1] or (p[2] <= c[2] and p[3] >= c[3]):
                        continue
                    total = best[j] + alpha * c[5] - link_cost(p, c, gap_open, rearrangement, inversion, lam, eps)
                    if total > best[i] or (total == best[i] and -1 < back[i] < j):
                        best[i], back[i] = total, j
                        held[0] = total - alpha * c[5]
        for trees in (straight, reverse):
            trees[c[4]].add(place[c[4]][i], best[i])
    at = max(range(len(rows)), key=lambda i: (best[i], -i))
    top, path = best[at], []
    while at >= 0:
        path.append(at)
        at = back[at]
    return path[::-1], top


def glocal_chains(blocks: DataFrame, key: str, look_back: int | None = None, gap_open: float = 1, rearrangement: float = 10_000, inversion: float = 5, alpha: float = 2, lam: float = 3, eps: float = 2) -> DataFrame:
    """Best chain of blocks along the first axis where order and strand on the second may change at a cost.

    A block follows one that starts and ends before it; blocks that the other
    contains on the second axis are no predecessors; ties go to the nearest. ``look_back`` bounds them to the blocks just before (None: all).
    """
    schema = f"{key} {blocks.schema[key].dataType.simpleString()}, step int, s1 bigint, e1 bigint, s2 bigint, e2 bigint, orient int, score bigint, chain_score double"
    costs = {"rearrangement": rearrangement, "inversion": inversion, "lam": lam, "eps": eps}

    def fold(cols: list[list]) -> list[tuple]:
        rows = list(zip(*cols[1:], strict=True))  # s1, e1, s2, e2, orient, score
        path, top = best_blocks(rows, look_back, alpha, gap_open, **costs)
        return [(cols[0][0], step, *rows[i], top) for step, i in enumerate(path)]

    rows = blocks.select(key, "s1", "e1", "s2", "e2", F.col("orient").cast("int").alias("orient"), F.col("score").cast("bigint").alias("score"))
    return map_groups(rows, [key], ["s1", "e1", "s2", "e2"], fold, schema)
