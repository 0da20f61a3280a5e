"""Choosing and trimming blocks and chains: one place for every stretch of two axes.

A block is ``s1, e1, s2, e2, orient, score`` on a reference (axis 1) and a
contig (axis 2). What depends on the choices made before is a fold over a
group's sorted rows; what depends on neighbours only is a window.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.expr import reverse_complement
from strandline.operators.chain import link_cost
from strandline.operators.grouped import map_groups
from strandline.operators.intervals import complement, islands
from strandline.operators.match import kmers, mems, mums

BLOCK = ["s1", "e1", "s2", "e2", "orient", "score"]
_BLOCK = "s1 bigint, e1 bigint, s2 bigint, e2 bigint, orient int, score bigint"


def _typed(blocks: DataFrame, keys: list[str]) -> tuple[DataFrame, str]:
    """Blocks with fixed types, and the schema of rows of keys and block."""
    named = ", ".join(f"`{k}` {blocks.schema[k].dataType.simpleString()}" for k in keys)
    own = [F.col(c).cast("int" if c == "orient" else "bigint").alias(c) for c in BLOCK]
    return blocks.select(*keys, *own), f"{named}, {_BLOCK}"


def shortened(block: tuple, axis: int, by: int, at_start: bool) -> tuple:
    """A block without ``by`` letters at one end of an axis, and at the end of the other axis that its orientation says."""
    x = list(block)
    other = 2 - axis
    start = at_start if x[4] == 0 else not at_start
    for at, first in ((axis, at_start), (other, start)):
        if first:
            x[at] += by
        else:
            x[at + 1] -= by
    x[5] -= by
    return tuple(x)


def without_overlaps(blocks: list[tuple], greedy: bool) -> list[tuple]:
    """Blocks that meet on neither axis.

    On one axis after the other, blocks inside another one go. Of two that
    overlap both lose the overlap, or if ``greedy`` the one of the lower score
    (the earlier one of equals). A block whose score or length the overlap takes
    up goes.
    """
    for axis in (0, 2):
        out: list[tuple] = []
        reach = None
        for b in sorted(blocks, key=lambda x: (x[axis], x[axis] - x[axis + 1], x)):
            if reach is not None and b[axis + 1] <= reach:
                continue
            reach = b[axis + 1]
            while b and out and out[-1][axis + 1] > b[axis]:
                last, over = out[-1], out[-1][axis + 1] - b[axis]
                loses = not greedy or last[5] > b[5]
                if loses:
                    b = shortened(b, axis, over, True) if b[5] > over else None
                if b and (not greedy or not loses):
                    out.pop()
                    if min(last[axis + 1] - last[axis], last[5]) > over:
                        out.append(shortened(last, axis, over, False))
            if b:
                out.append(b)
        blocks = out
    return sorted(blocks)


def remove_overlaps(blocks: DataFrame, keys: list[str], greedy: bool = False) -> DataFrame:
    """Blocks of each group after :func:`without_overlaps`."""
    rows, schema = _typed(blocks, keys)
    n = len(keys)

    def fold(cols: list[list]) -> list[tuple]:
        own = tuple(c[0] for c in cols[:n])
        return [(*own, *b) for b in without_overlaps(list(zip(*cols[n:], strict=True)), greedy)]

    return map_groups(rows, keys, BLOCK, fold, schema)


def best_subchain(blocks: list[tuple], alpha: float, **costs: float) -> list[tuple]:
    """Blocks in order of the first axis after dropping, from the lowest score up, each one without which the chain scores no less."""
    order = sorted(blocks)
    before, after = list(range(-1, len(order) - 1)), [*range(1, len(order)), -1]
    link = lambda i, j: link_cost(order[i], order[j], **costs) if i >= 0 and j >= 0 else 0.0
    left = set(range(len(order)))
    for i in sorted(left, key=lambda i: (order[i][5], i)):
        p, n = before[i], after[i]
        if len(left) > 1 and link(p, i) + link(i, n) - link(p, n) >= alpha * order[i][5]:
            left.discard(i)
            if p >= 0:
                after[p] = n
            if n >= 0:
                before[n] = p
    return [order[i] for i in sorted(left)]


def optimise(blocks: DataFrame, keys: list[str], alpha: float = 1, gap_open: float = 10, rearrangement: float = 1000, inversion: float = 1, lam: float = 5, eps: float = 1) -> DataFrame:
    """Blocks of each group after :func:`best_subchain`: a block stays only if the chain pays for its links."""
    rows, schema = _typed(blocks, keys)
    n = len(keys)

    def fold(cols: list[list]) -> list[tuple]:
        own = tuple(c[0] for c in cols[:n])
        kept = best_subchain(list(zip(*cols[n:], strict=True)), alpha, gap_open=gap_open, rearrangement=rearrangement, inversion=inversion, lam=lam, eps=eps)
        return [(*own, *b) for b in kept]

    return map_groups(rows, keys, BLOCK, fold, schema)


class _Cover:
    """Disjoint intervals, and what they leave of another one."""

    def __init__(self):
        self.at: list[tuple[int, int]] = []

    def touching(self, start: int, end: int) -> list[tuple[int, int]]:
        i = bisect_left(self.at, (start, start))
        i -= i > 0 and self.at[i - 1][1] > start
        out = []
        while i < len(self.at) and self.at[i][0] < end:
            out.append(self.at[i])
            i += 1
        return out

    def add(self, start: int, end: int) -> None:
        insort(self.at, (start, end))


def selected_chains(chains: list[tuple], least: int) -> list[tuple]:
    """Of chains (ref, s1, e1, s2, e2, orient, score) of a contig those that fit beside better ones, trimmed to do so.

    From the best score down: a chain inside a better one on either axis, or
    around one, goes; what overlaps a better one's end is cut off on both axes.
    A cut chain of ``least`` letters or fewer on an axis goes.
    """
    contig, references, out = _Cover(), {}, []
    for ref, *block in sorted(chains, key=lambda c: (-c[6], *c[:6])):
        b = tuple(block)
        own = references.setdefault(ref, _Cover())
        cut = False
        for axis, cover in ((2, contig), (0, own)):
            for start, end in cover.touching(b[axis], b[axis + 1]):
                first, last = b[axis] < start, b[axis + 1] > end
                if first == last:  # inside the better one, or around it
                    b = None
                    break
                b = shortened(b, axis, b[axis + 1] - start if first else end - b[axis], not first)
                cut = True
                if min(b[1] - b[0], b[3] - b[2]) <= least:
                    b = None
                    break
            if b is None:
                break
        if b is None or (cut and (contig.touching(b[2], b[3]) or own.touching(b[0], b[1]))):
            continue
        contig.add(b[2], b[3])
        own.add(b[0], b[1])
        out.append((ref, *b))
    return sorted(out, key=lambda c: (c[3], c[4]))


def chains_to_reference(chains: DataFrame, lengths: DataFrame, least: int = 1500) -> tuple[DataFrame, DataFrame]:
    """Chains ``(ctg, ref, s1, e1, s2, e2, orient, score)`` that share no stretch, with their ``number`` along the contig, and what is left.

    The second table is ``(ctg, gap_start, gap_end)`` of all contigs of
    ``lengths(ctg, length)``: what no chain covers, whole contigs without any
    chain included.
    """
    rows, schema = _typed(chains, ["ctg", "ref"])

    def fold(cols: list[list]) -> list[tuple]:
        return [(cols[0][0], *c, i) for i, c in enumerate(selected_chains(list(zip(*cols[1:], strict=True)), least))]

    kept = map_groups(rows, ["ctg"], ["ref", *BLOCK], fold, schema + ", number int")
    whole = kept.join(lengths, "ctg")
    rest = complement(whole, ["ctg"], "s2", "e2", F.lit(0).cast("bigint"), F.col("length"))
    bare = lengths.join(kept.select("ctg").distinct(), "ctg", "left_anti").where("length > 0")
    return kept, rest.unionByName(bare.select("ctg", F.lit(0).cast("bigint").alias("gap_start"), F.col("length").cast("bigint").alias("gap_end")))


def best_path(chains: list[tuple]) -> list[int]:
    """Numbers of the chains (s1, e1, score) of the best path along a reference: each ends after the one before, overlaps cost their length."""
    order = sorted(range(len(chains)), key=lambda i: (*chains[i][:2], i))
    score, back, ends = {}, {}, []
    for i in order:
        s, e, own = chains[i]
        score[i], back[i] = float(max(own, 0)), -1
        for neg, j in ends:  # best scores first
            if -neg + own <= score[i]:
                break
            if chains[j][1] < e:
                total = -neg + own - max(chains[j][1] - s, 0)
                if total > score[i]:
                    score[i], back[i] = total, j
        insort(ends, (-score[i], i))
    at = max(order, key=lambda i: (score[i], -i), default=-1)
    path = []
    while at >= 0 and score[at] > 0:
        path.append(at)
        at = back[at]
    return path[::-1]


def best_contig_path(chains: DataFrame) -> DataFrame:
    """The chains ``(ref, ctg, s1, e1, s2, e2, orient, score)`` on each reference's best path, with their ``place``."""
    rows, schema = _typed(chains, ["ref", "ctg"])

    def fold(cols: list[list]) -> list[tuple]:
        own = list(zip(*cols[1:], strict=True))
        return [(cols[0][0], *own[i], place) for place, i in enumerate(best_path([(c[1], c[2], c[6]) for c in own]))]

    return map_groups(rows, ["ref"], ["s1", "e1", "ctg", "s2"], fold, schema + ", place int")


def join_chains(chains: DataFrame) -> DataFrame:
    """Chains ``(ref, ctg, ..., number)`` that follow each other on reference and contig, on one strand, become one."""
    w = Window.partitionBy("ref").orderBy("e1", "s1", "ctg")
    step = F.when(F.col("orient") == 0, 1).otherwise(-1)
    new = (F.col("ctg") != F.lag("ctg").over(w)) | (F.col("orient") != F.lag("orient").over(w)) | (F.col("number") - F.lag("number").over(w) != step)
    runs = islands(chains, ["ref"], ["e1", "s1", "ctg"], new)
    out = runs.groupBy("ref", "island").agg(F.first("ctg").alias("ctg"), F.min("s1").alias("s1"), F.max("e1").alias("e1"), F.min("s2").alias("s2"), F.max("e2").alias("e2"), F.first("orient").alias("orient"), F.sum("score").alias("score"), F.count(F.lit(1)).alias("chains"))
    return out.drop("island")


def extend_chains(chains: DataFrame, ref: DataFrame, contigs: DataFrame, reach: int = 1000, k: int = 15, rounds: int = 1) -> DataFrame:
    """Chains ``(ref, ctg, ...)`` stretched at both ends over the longest unique match of the flanks, ``rounds`` times.

    A flank has ``reach`` letters at most on either axis; ``ref`` and
    ``contigs`` are tables of (name, seq).
    """
    a = ref.select(F.col("name").alias("ref"), F.col("seq").alias("__r"))
    b = contigs.select(F.col("name").alias("ctg"), F.col("seq").alias("__q"))
    cut = lambda s, lo, hi: F.substring(s, (lo + 1).cast("int"), (hi - lo).cast("int"))
    for _ in range(rounds):
        for right in (True, False):
            rows = chains.join(a, "ref").join(b, "ctg").withColumn("pair", F.xxhash64("ref", "ctg", "s1", "e1", "s2", "e2"))
            forward = (F.col("orient") == 0) == F.lit(right)
            r_lo, r_hi = (F.col("e1"), F.least(F.col("e1") + reach, F.length("__r"))) if right else (F.greatest(F.col("s1") - reach, F.lit(0)), F.col("s1"))
            q_lo = F.when(forward, F.col("e2")).otherwise(F.greatest(F.col("s2") - reach, F.lit(0)))
            q_hi = F.when(forward, F.least(F.col("e2") + reach, F.length("__q"))).otherwise(F.col("s2"))
            piece = cut(F.col("__q"), q_lo, q_hi)
            flanks = rows.select("pair", cut(F.col("__r"), r_lo, r_hi).alias("t1"), F.when(F.col("orient") == 1, reverse_complement(piece)).otherwise(piece).alias("t2"), r_lo.alias("r_lo"), r_hi.alias("r_hi"), q_lo.alias("q_lo"), q_hi.alias("q_hi"))
            x = kmers(flanks.select("pair", "t1"), ["pair"], "t1", k).withColumnRenamed("pos", "r_pos")
            y = kmers(flanks.select("pair", "t2"), ["pair"], "t2", k).withColumnRenamed("pos", "q_pos")
            found = x.join(y, ["pair", "kmer"]).select("pair", F.col("pair").alias("same"), "r_pos", "q_pos")
            best = mums(mems(found, "pair", "same", k), "pair", "same").groupBy("pair").agg(F.max(F.struct("length", (-F.col("r_start")).alias("r"), (-F.col("q_start")).alias("q"))).alias("m"))
            ends = best.select("pair", F.col("m.length").alias("n"), (-F.col("m.r")).alias("r"), (-F.col("m.q")).alias("q"))
            own = rows.join(flanks.select("pair", "r_lo", "q_lo", "q_hi"), "pair").join(ends, "pair", "left").drop("__r", "__q", "pair")
            met = F.col("n").isNotNull()
            e1 = F.when(met & F.lit(right), F.col("r_lo") + F.col("r") + F.col("n")).otherwise(F.col("e1"))
            s1 = F.when(met & F.lit(not right), F.col("r_lo") + F.col("r")).otherwise(F.col("s1"))
            grows = met & forward
            far = F.when(F.col("orient") == 0, F.col("q_lo") + F.col("q") + F.col("n")).otherwise(F.col("q_hi") - F.col("q"))
            near = F.when(F.col("orient") == 0, F.col("q_lo") + F.col("q")).otherwise(F.col("q_hi") - F.col("q") - F.col("n"))
            e2, s2 = F.when(grows, far).otherwise(F.col("e2")), F.when(met & ~forward, near).otherwise(F.col("s2"))
            moved = {"s1": s1, "e1": e1, "s2": s2, "e2": e2, "score": F.col("score") + F.coalesce("n", F.lit(0))}
            chains = own.select(*[moved[c].cast("bigint").alias(c) if c in moved else F.col(c) for c in chains.columns])
    return chains


def breakpoint_graph(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, src, dst, axis``: neighbouring blocks along each axis, named by their start on the first."""
    out = None
    for axis, (s, e) in enumerate((("s1", "e1"), ("s2", "e2")), 1):
        w = Window.partitionBy(*keys).orderBy(s, e, "s1")
        own = blocks.select(*keys, F.col("s1").alias("src"), F.lead("s1").over(w).alias("dst"), F.lit(axis).alias("axis")).where("dst is not null")
        out = own if out is None else out.unionByName(own)
    return out


def unplaced(contigs: DataFrame, placed: DataFrame) -> DataFrame:
    """Contigs (name, ...) that no row of ``placed(ctg, ...)`` holds."""
    return contigs.join(placed.select(F.col("ctg").alias("name")).distinct(), "name", "left_anti")
