"""SimHash near-dedup by the generalised pigeonhole principle.

A fingerprint has 64 bits, each the majority of that bit among the XXH64 hashes
of a text's word shingles. Two fingerprints within ``distance`` bits of each
other are linked. Bits are dealt to parts, and part ``i`` gets a threshold
``t[i]`` of -1 (not looked at), 0, 1, ...: if the thresholds plus one sum to
``distance + 1``, then any linked pair differs in at most ``t[i]`` bits of some
part ``i``. Which bits go together is decided by their correlation, which
thresholds the parts get by a dynamic program over the numbers of rows and
candidate pairs that each would cost, both from counts of bit pairs over all
fingerprints.

Every distinct fingerprint is a row under its own value of a part, and probes
the values within the part's threshold. Rows that meet are held against each
other in full. Groups of more than ``BUCKET_ROWS`` rows are not: each of their
members is put beside every fingerprint within one bit of it instead. Two
fingerprints at most two bits apart have one such neighbour in common, and all
that share one are at most two bits apart, so this finds the same links with 65
rows for a member, however large the group.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import wordhash as W
from strandline.llm.near_dedup import _meet as meet
from strandline.llm.near_dedup import repeated
from strandline.operators.components import connected_components
from strandline.session import materialise

#: Bits of a fingerprint, bits that linked ones may differ in, words of a shingle, seed of the hash.
BITS, DISTANCE, SHINGLE, SEED = 64, 2, 3, 42
#: Parts that are considered at most, and pairs that cost as much to compare as one row to shuffle.
PARTS, ROW_COST = 4, 100
#: Rows of a group that are compared directly.
BUCKET_ROWS = 1024

_U = np.uint64
_ONE = _U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_hashes(column: pa.Array, k: int = SHINGLE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By chunks of texts, the XXH64 of every shingle and where each text's begin.

    Words of a chunk are written one after the other with a space behind each,
    so that a shingle is a slice of that.
    """
    raw, bounds = W.text_bytes(column)
    for a, b in W.chunks(bounds):
        part = raw[bounds[a] : bounds[b]]
        starts, ends, at = W.spans(part, bounds[a : b + 1], W.NOT_SPACE)
        size = ends - starts
        own = np.cumsum(size + 1) - size - 1
        line = np.full(int(size.sum()) + len(size), 0x20, np.uint8)
        solid = part[W.NOT_SPACE[part]]
        line[np.arange(len(solid)) + np.repeat(np.arange(len(size)), size)] = _LOWER[solid]
        words = np.diff(at)
        many = np.where(words > 0, np.maximum(words - k + 1, 1), 0)
        edge = np.concatenate(([0], np.cumsum(many)))
        first = np.repeat(at[:-1] - edge[:-1], many) + np.arange(edge[-1])
        last = np.minimum(first + k, np.repeat(at[1:], many)) - 1
        held = line.tobytes()
        spans = zip(own[first].tolist(), (own[last] + size[last]).tolist(), strict=True)
        yield np.fromiter((xxhash.xxh64_intdigest(held[i:j], SEED) for i, j in spans), _U, len(first)), edge


def majorities(hashes: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """For each text the bits that more than half of its hashes have; 0 without any."""
    out = np.zeros(len(edge) - 1, _U)
    some = np.flatnonzero(np.diff(edge))
    if len(some):
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, edge[some], axis=0, dtype=np.int64)
        out[some] = np.packbits(2 * ones > np.diff(edge)[some, None], axis=1).view(">u8").ravel()
    return out


def _prints(k: int):
    def run(batches):
        for rb in batches:
            found = [majorities(*x) for x in shingle_hashes(rb.column(1), k)] or [np.zeros(0, _U)]
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(np.concatenate(found).view(np.int64))], ["doc_id", "rep"])

    return run


# ---------------------------------------------------------------- parts and thresholds

def _bit_counts(batches):
    """How many fingerprints of a task have both of two bits, the lowest bit first."""
    total = np.zeros((BITS, BITS), np.int64)
    for rb in batches:
        reps = rb.column(0).to_numpy().view(_U)
        for a in range(0, len(reps), 1 << 16):
            bits = (reps[a : a + (1 << 16), None] >> np.arange(BITS, dtype=_U) & _ONE).astype(np.float32)
            total += (bits.T @ bits).astype(np.int64)
    at = np.flatnonzero(total.ravel())
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total.ravel()[at])], ["cell", "n"])


def joint_counts(classes: DataFrame) -> np.ndarray:
    """Fingerprints of ``classes(rep)`` that have both bits, for every pair of bits."""
    cells = classes.select("rep").mapInArrow(_bit_counts, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    joint = np.zeros(BITS * BITS)
    for r in cells.collect():  # BITS * BITS cells at most
        joint[r.cell] = r.n
    return joint.reshape(BITS, BITS)


@dataclass(frozen=True)
class Part:
    """Bits, lowest is 0, and in how many of them a probe differs at most."""

    bits: tuple[int, ...]
    threshold: int

    @property
    def mask(self) -> int:
        return sum(1 << b for b in self.bits)

    def flips(self) -> np.ndarray:
        """What to flip for every probe; the first flips nothing."""
        return np.array([sum(1 << b for b in c) for r in range(self.threshold + 1) for c in combinations(self.bits, r)], _U)


class Costs:
    """Estimates from counts of bit pairs over ``n`` fingerprints."""

    def __init__(self, n: int, joint: np.ndarray):
        self.n = n
        p = joint.diagonal() / max(n, 1)
        both = joint / max(n, 1)
        one, other = p[:, None] - both, p[None, :] - both
        self.agree = p**2 + (1 - p) ** 2
        self.agree_both = both**2 + one**2 + other**2 + (1 - both - one - other) ** 2
        spread = np.sqrt(p * (1 - p))
        scale = np.outer(spread, spread)
        self.correlation = np.divide(np.abs(both - np.outer(p, p)), scale, out=np.zeros_like(both), where=scale > 0)

    def groups(self, m: int) -> list[tuple[int, ...]]:
        """All bits in ``m`` parts of about equal width: each begins with the free bit that is most correlated with all free ones and takes the bits most correlated with its own."""
        free, out = list(range(BITS)), []
        for i in range(m):
            width = len(free) // (m - i)
            own = [max(free, key=lambda b: self.correlation[b, free].sum())]
            free.remove(own[0])
            while len(own) < width:
                own.append(max(free, key=lambda b: self.correlation[b, own].sum()))
                free.remove(own[-1])
            out.append(tuple(own))
        return out

    def pairs(self, bits: tuple[int, ...], threshold: int) -> float:
        """Pairs that differ in at most ``threshold`` of the bits.

        The chance that all agree is a product along a tree that joins each bit
        to the one most correlated among those before it; differing bits come
        by the odds that one differs.
        """
        chance = self.agree[bits[0]]
        for i, b in enumerate(bits[1:], 1):
            near = max(bits[:i], key=lambda x: self.correlation[b, x])
            chance *= self.agree_both[b, near] / self.agree[near]
        ways = np.zeros(threshold + 1)
        ways[0] = 1
        for b in bits:
            ways[1:] += ways[:-1] * (1 - self.agree[b]) / self.agree[b]
        return self.n**2 / 2 * min(1.0, chance * ways.sum())

    def cost(self, bits: tuple[int, ...], threshold: int) -> float:
        rows = self.n * sum(comb(len(bits), i) for i in range(threshold + 1))
        return ROW_COST * rows + self.pairs(bits, threshold)


def allocate(costs: list[list[float]], units: int) -> tuple[float, list[int]]:
    """The cheapest way to deal ``units`` to rows of costs: ``costs[i][t]`` is that of ``t + 1`` units for ``i``, none cost nothing."""
    best = {0: (0.0, [])}
    for own in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, dealt) in best.items():
            for u in range(min(len(own), units - used) + 1):
                new = (cost + (own[u - 1] if u else 0.0), [*dealt, u])
                if used + u not in step or new < step[used + u]:
                    step[used + u] = new
        best = step
    return best[units]


def plan(n: int, joint: np.ndarray, distance: int = DISTANCE) -> list[Part]:
    """Parts and thresholds of least estimated cost for ``n`` fingerprints; parts that are not looked at are left out."""
    costs, found = Costs(n, joint), []
    for m in range(1, PARTS + 1):
        groups = costs.groups(m)
        cost, units = allocate([[costs.cost(bits, t) for t in range(distance + 1)] for bits in groups], distance + 1)
        found.append((cost, [Part(tuple(sorted(bits)), u - 1) for bits, u in zip(groups, units, strict=True) if u]))
    return min(found, key=lambda x: x[0])[1]


# ---------------------------------------------------------------- probing and verification

def _probes(parts: list[Part]):
    """``(key, rep, own)``: every fingerprint under its value of each part, and under those that it probes."""
    flips = [(i, _U(p.mask), p.flips()) for i, p in enumerate(parts)]

    def run(batches):
        for rb in batches:
            reps = rb.column(0).to_numpy().view(_U)
            for i, mask, flip in flips:
                step = max(1, (1 << 16) // len(flip))
                for a in range(0, len(reps), step):
                    own = reps[a : a + step]
                    value = ((own & mask)[:, None] ^ flip[None, :]).ravel()
                    key = W.combine([np.full(len(value), i, _U), value])
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.repeat(own, len(flip)).view(np.int64)), pa.array(np.tile(flip == 0, len(own)))], ["key", "rep", "own"])

    return run


def nearby(reps: np.ndarray, distance: int) -> Iterator[tuple[int, int]]:
    """Links that connect what is within ``distance`` bits, one fewer than each connected set has members."""
    rest = np.unique(reps)
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= distance
            if near.any():
                found = rest[near]
                rest = rest[~near]
                queue.extend(found)
                for y in found:
                    yield int(x), int(y)


def _verified(distance: int):
    """Links among the rows of each key, of batches sorted by (key, rep)."""

    def links(keys: np.ndarray, reps: np.ndarray) -> pa.RecordBatch:
        edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
        size = np.diff(edge)
        two = edge[:-1][size == 2]
        two = two[np.bitwise_count(reps[two] ^ reps[two + 1]) <= distance]  # most groups
        found = [x for a, b in zip(edge[:-1][size > 2], edge[1:][size > 2], strict=True) for x in nearby(reps[a:b], distance)]
        more = np.array(found, _U).reshape(-1, 2)
        ends = [np.concatenate((reps[two + i], more[:, i])).view(np.int64) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in ends], ["src", "dst"])

    def run(batches):
        keys, reps = np.zeros(0, np.int64), np.zeros(0, _U)
        for rb in batches:
            keys = np.concatenate((keys, rb.column(0).to_numpy()))
            reps = np.concatenate((reps, rb.column(1).to_numpy().view(_U)))
            whole = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last group can go on in the next batch
            if whole:
                yield links(keys[:whole], reps[:whole])
                keys, reps = keys[whole:], reps[whole:]
        if len(keys):
            yield links(keys, reps)

    return run


def _around(batches):
    """``(key, rep)``: each fingerprint beside itself and all that differ from it in one bit."""
    flip = np.concatenate(([_U(0)], _ONE << np.arange(BITS, dtype=_U)))
    for rb in batches:
        reps = rb.column(0).to_numpy().view(_U)
        for a in range(0, len(reps), 1024):
            own = reps[a : a + 1024]
            yield pa.RecordBatch.from_arrays([pa.array((own[:, None] ^ flip).ravel().view(np.int64)), pa.array(np.repeat(own, len(flip)).view(np.int64))], ["key", "rep"])


def links(classes: DataFrame, parts: list[Part], distance: int = DISTANCE, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``(src, dst)``: links that connect all fingerprints of ``classes(rep)`` within ``distance`` bits, 2 at most, of each other."""
    if distance > 2:
        raise ValueError("large groups are resolved for distances up to 2")
    tasks = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = classes.select("rep").mapInArrow(_probes(parts), "key bigint, rep bigint, own boolean")
    found = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("held")).where("n > 1 and held")
    met = materialise(meet(rows.drop("own"), found.select("key", "n", (F.col("n") > bucket_rows).alias("large")), "key"), "met")
    near = met.where("not large").select("key", "rep").repartition(tasks, "key").sortWithinPartitions("key", "rep")
    out = near.mapInArrow(_verified(distance), "src bigint, dst bigint")
    if met.where("large").head(1):
        many = met.where("large").select("rep").distinct().mapInArrow(_around, "key bigint, rep bigint")
        beside = many.repartition(tasks, "key").sortWithinPartitions("key", "rep")
        out = out.unionByName(beside.mapInArrow(_verified(distance), "src bigint, dst bigint"))
    return materialise(out, "links")


def simhash_groups(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs(doc_id, text)``.

    ``fingerprint`` has 16 hex digits; ``component_id`` is the smallest doc_id
    reachable over fingerprints that differ in at most ``distance`` bits. Null
    and empty texts and texts of white space have fingerprint zero, and are
    linked like any other; repeated shingles count each time, and a bit that
    exactly half of the hashes have is 0. Rows that repeat a doc_id each get a
    row and count as one document: what is linked with one of its texts is
    linked with it. A null doc_id keeps its row, has no component and links
    nothing. Very long texts are read in chunks of whole texts; the longest
    one's shingle hashes bound a task's memory. An empty table gives an empty
    result; other columns, whatever their names, are not read.
    """
    given = docs.schema["doc_id"].dataType.simpleString()
    prints = materialise(docs.select("doc_id", "text").mapInArrow(_prints(shingle), f"doc_id {given}, rep bigint"), "prints")
    known = prints.where("doc_id is not null")
    classes = materialise(known.groupBy("rep").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")), "classes")
    total = classes.count()
    joined = links(classes, plan(total, joint_counts(classes), distance), distance)
    again = repeated(prints)
    if again.head(1):  # rows of a doc_id are one document
        own = known.join(again.hint("shuffle_hash"), "doc_id", "left_semi").distinct()
        joined = joined.unionByName(own.join(own.groupBy("doc_id").agg(F.min("rep").alias("dst")), "doc_id").where("rep <> dst").select(F.col("rep").alias("src"), "dst").distinct())
    comp = connected_components(joined)
    placed = classes.join(comp, classes.rep == comp.node, "left").select("rep", "doc_id", "n", F.coalesce("component", "rep").alias("component"))
    placed = materialise(placed, "placed", rows=total)
    least = placed.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("component_id"))
    label = meet(placed, least, "component").select(F.col("rep").alias("print"), "n", "component_id")
    rows = known.select("doc_id", F.col("rep").alias("print"), F.col("doc_id").alias("rep"))
    out = meet(rows, label, "print").select("doc_id", "print", "component_id")
    out = out.unionByName(prints.where("doc_id is null").select("doc_id", F.col("rep").alias("print"), F.col("doc_id").alias("component_id")))
    return out.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
