"""Multiple alignment of the alleles of a bubble, and alignments as graphs.

The kernel is a pair hidden Markov model: posteriors of all pairs, a
consistency pass over third sequences, progressive maximum-expected-accuracy
alignment along a guide tree, and a confidence for each column. It is a grouped
function; a bubble is a group.
"""

from __future__ import annotations

import random
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.grouped import map_groups

#: Gap opening and extension, and match emission, of the pair model.
OPEN, EXTEND, SAME = 0.03, 0.5, 0.85
#: Letters of alleles whose alignment is kept for bubbles of the same alleles, at most, and such alignments of a worker.
SHORT, HELD = 1024, 1024


def posterior(a: str, b: str) -> np.ndarray:
    """Probability that each pair of positions is aligned.

    An alignment begins and ends as if a pair came before and after it, so that
    both passes weigh it alike. Sums are kept as logarithms, so that gaps of any
    length count; a row is one vector operation, along the row too.
    """
    x, y = np.frombuffer(a.upper().encode(), np.uint8), np.frombuffer(b.upper().encode(), np.uint8)
    n, m = len(x), len(y)
    emit = np.log(np.where(x[:, None] == y[None, :], SAME / 4, (1 - SAME) / 12))
    begin, stay, go_on, close = np.log([0.25 * OPEN, 0.25 * EXTEND, 1 - 2 * OPEN, 1 - EXTEND])
    slope = stay * np.arange(m + 1)

    def forward(e: np.ndarray) -> tuple[np.ndarray, float]:
        """Sums over alignments that end with a pair in each cell, and over all alignments."""
        pairs = np.full((n + 1, m + 1), -np.inf)
        pairs[0, 0] = 0
        down = np.full(m + 1, -np.inf)
        for i in range(n + 1):
            if i:
                pairs[i, 1:] = e[i - 1] + np.logaddexp(go_on + pairs[i - 1, :-1], close + np.logaddexp(down, right)[:-1])
                down = np.logaddexp(begin + pairs[i - 1], stay + down)
            right = np.full(m + 1, -np.inf)
            right[1:] = np.logaddexp.accumulate(begin + pairs[i, :-1] - slope[:-1]) + slope[:-1]
        return pairs, float(np.logaddexp(go_on + pairs[n, m], close + np.logaddexp(down[m], right[m])))

    front, total = forward(emit)
    back, _ = forward(emit[::-1, ::-1])
    p = np.exp(np.minimum(front[1:, 1:] + back[::-1, ::-1][:-1, :-1] - emit - total, 0))
    return np.where(p < 0.01, 0, p)


def _align(score: np.ndarray) -> list[tuple[int, int]]:
    """Maximum-expected-accuracy path: pairs of columns, -1 for a gap."""
    n, m = score.shape
    best = np.zeros((n + 1, m + 1))
    for i in range(1, n + 1):
        diag = best[i - 1, :-1] + score[i - 1]
        best[i, 1:] = np.maximum.accumulate(np.maximum(diag, best[i - 1, 1:]))
    path, i, j = [], n, m
    while i or j:
        if i and j and best[i, j] == best[i - 1, j - 1] + score[i - 1, j - 1] and score[i - 1, j - 1] > 0:
            i, j = i - 1, j - 1
            path.append((i, j))
        elif j and best[i, j] == best[i, j - 1]:
            j -= 1
            path.append((-1, j))
        else:
            i -= 1
            path.append((i, -1))
    return path[::-1]


#: Rows of an alignment: members, and for each the position in every column (-1 for a gap).
Block = tuple[list[int], list[np.ndarray]]


def _join(one: Block, two: Block, get: Callable[[int, int], np.ndarray]) -> Block:
    """Two blocks of rows aligned by the summed posteriors of their columns."""
    (ia, ca), (ib, cb) = one, two
    score = np.zeros((len(ca[0]), len(cb[0])))
    for x, cx in zip(ia, ca, strict=True):
        for y, cy in zip(ib, cb, strict=True):
            score += np.pad(get(x, y), ((0, 1), (0, 1)))[np.ix_(cx, cy)]
    ways = np.array(_align(score), dtype=int).reshape(-1, 2)
    taken = [[np.where(w >= 0, np.append(c, -1)[w], -1) for c in cols] for w, cols in ((ways[:, 0], ca), (ways[:, 1], cb))]
    return ia + ib, taken[0] + taken[1]


def _consistent(p: dict[tuple[int, int], np.ndarray], k: int, gaps: bool) -> dict[tuple[int, int], np.ndarray]:
    """Posteriors averaged over the ways through third sequences; with ``gaps`` two letters that both lack a partner there agree too."""
    get = lambda i, j: p[i, j] if i < j else p[j, i].T
    out = {}
    for (i, j), v in p.items():
        total = 2 * v
        for z in range(k):
            if z not in (i, j):
                x, y = get(i, z), get(z, j)
                total = total + x @ y
                if gaps:
                    total += np.outer(np.maximum(1 - x.sum(1), 0), np.maximum(1 - y.sum(0), 0))
        out[i, j] = np.where(v > 0, total / k, 0)
    return out


def _refined(block: Block, get: Callable[[int, int], np.ndarray], rounds: int) -> Block:
    """Rows split at random into two blocks, freed of empty columns and aligned again, ``rounds`` times (seeded, so that reruns agree)."""
    rng = random.Random(0)
    ids, cols = block
    for _ in range(rounds if len(ids) > 2 else 0):
        side = [rng.random() < 0.5 for _ in ids]
        if all(side) or not any(side):
            continue
        halves = []
        for s in (False, True):
            own = [c for c, t in zip(cols, side, strict=True) if t == s]
            used = np.max(own, axis=0) >= 0
            halves.append(([i for i, t in zip(ids, side, strict=True) if t == s], [c[used] for c in own]))
        ids, cols = _join(*halves, get)
    return ids, cols


def align(seqs: list[str], consistency: int = 2, refinements: int = 100, gaps: bool = True) -> tuple[list[str], list[int]]:
    """Aligned strings of equal length and a confidence of 0 to 100 for each column.

    ``consistency`` passes over third sequences (``gaps``: gaps in them count),
    progressive alignment along a guide tree, then ``refinements`` realignments
    of random halves.
    """
    k = len(seqs)
    if not k:
        return [], []
    p = {(i, j): posterior(seqs[i], seqs[j]) for i in range(k) for j in range(i + 1, k)}
    for _ in range(consistency if k > 2 else 0):
        p = _consistent(p, k, gaps)
    get = lambda i, j: p[i, j] if i < j else p[j, i].T
    near = {(i, j): _accuracy(v, seqs[i], seqs[j]) for (i, j), v in p.items()}
    groups: dict[int, Block] = {i: ([i], [np.arange(len(s))]) for i, s in enumerate(seqs)}
    while len(groups) > 1:
        a, b = max(near, key=lambda x: (near[x], -x[0], -x[1]))
        groups[a] = _join(groups[a], groups.pop(b), get)
        best = near[a, b]
        for z in groups:
            if z != a:
                one, two = near[min(a, z), max(a, z)], near[min(b, z), max(b, z)]
                near[min(a, z), max(a, z)] = (one + two) * best / 2
        near = {x: v for x, v in near.items() if b not in x}
    ids, cols = _refined(next(iter(groups.values())), get, refinements)
    place = dict(zip(ids, cols, strict=True))
    rows = ["".join(s[x] if x >= 0 else "-" for x in place[i]) for i, s in enumerate(seqs)]
    total, pairs = np.zeros(len(cols[0])), np.zeros(len(cols[0]))
    for (i, j), v in p.items():
        both = (place[i] >= 0) & (place[j] >= 0)
        total[both] += v[place[i][both], place[j][both]]
        pairs += both
    conf = np.where(pairs > 0, np.minimum(100, 100 * total / np.maximum(pairs, 1)), 0)
    return rows, [int(c) for c in conf]


def _accuracy(v: np.ndarray, a: str, b: str) -> float:
    hit = sum(v[i, j] for i, j in _align(v) if i >= 0 and j >= 0) if v.size else 0.0
    return float(hit / max(1, min(len(a), len(b))))


def align_alleles(alleles: DataFrame, bubble: str, aligner: Callable[[list[str]], tuple[list[str], list[int]]] = align) -> DataFrame:
    """``bubble, path, aligned, conf`` for every bubble of ``alleles(bubble, path, seq)``; equal sequences are aligned once.

    ``aligner`` turns different sequences into rows of equal length and a
    confidence for each column: :func:`align`, one with other settings, or a
    function that runs an outside program on the worker.
    """
    kind = alleles.schema[bubble].dataType.simpleString()

    def fold(cols: list[list]) -> list[tuple]:
        distinct = tuple(sorted(set(cols[2])))
        held = getattr(fold, "held", None)  # short alleles that this worker has aligned; the same ones come again and again
        if held is None:
            held = fold.held = {}
        found = held.get(distinct)
        if found is None:
            found = aligner(list(distinct))
            if sum(map(len, distinct)) <= SHORT and len(held) < HELD:
                held[distinct] = found
        at = dict(zip(distinct, found[0], strict=True))
        return [(b, p, at[s], found[1]) for b, p, s in zip(*cols, strict=True)]

    return map_groups(alleles.select(bubble, "path", "seq"), [bubble], ["path", "seq"], fold, f"{bubble} {kind}, path string, aligned string, conf array<int>")


def columns_to_nodes(aligned: DataFrame, key: str, path: str, text: str, conf: str | None = None, min_conf: float = 0) -> DataFrame:
    """Nodes of an alignment: runs of columns where a base's set of paths stays the same.

    ``key, start, length, paths, seq``; gaps make no node. In columns whose
    confidence (array column ``conf``) is below ``min_conf`` every path keeps a
    node of its own.
    """
    n = F.length(text)
    alone = F.when(F.get(conf, F.col("col") - 1) < min_conf, F.col(path)) if conf else F.lit(None).cast("string")
    rows = aligned.select(key, path, F.explode(F.sequence(F.lit(1), n)).alias("col"), text, *([conf] if conf else []))
    cells = rows.select(key, path, "col", F.substring(F.col(text), F.col("col"), F.lit(1)).alias("base"), alone.alias("alone")).where("base <> '-'")
    parts = cells.groupBy(key, "col", "base", "alone").agg(F.array_join(F.array_sort(F.collect_list(path)), ",").alias("paths"))
    w = Window.partitionBy(key, "paths").orderBy("col")
    runs = parts.withColumn("run", F.col("col") - F.row_number().over(w))
    return runs.groupBy(key, "paths", "run").agg((F.min("col") - 1).cast("bigint").alias("start"), F.count(F.lit(1)).alias("length"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "base"))), lambda x: x["base"]), "").alias("seq")).drop("run")
