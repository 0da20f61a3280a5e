"""Column expressions over sequences, coordinates and blocks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: IUPAC complements (fixed values).
COMPLEMENT_FROM, COMPLEMENT_TO = "ACGTUNRYKMSWBVDHXacgtunrykmswbvdhx-", "TGCAANYRMKSWVBHDXtgcaanyrmkswvbhdx-"


def reverse_complement(seq: Column) -> Column:
    """Reverse complement of a nucleotide string, keeping case."""
    return F.reverse(F.translate(seq, COMPLEMENT_FROM, COMPLEMENT_TO))


def base_count(seq: Column, base: str) -> Column:
    """How often a single letter occurs."""
    return F.coalesce(F.length(seq) - F.length(F.replace(seq, F.lit(base), F.lit(""))), F.lit(0)).cast("bigint")


def cigar_length(cigar: Column) -> Column:
    """Sum of the M, I, S and P lengths of a CIGAR string."""
    runs = F.regexp_extract_all(cigar, F.lit(r"(\d+)[MISP]"), F.lit(1))
    return F.aggregate(runs, F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint"))


def _distances(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.abs(x - y))


def gap_cost(a: Column, b: Column, model: str = "sumofpairs", weight: float = 1.0, epsilon: float = 0.0) -> Column:
    """Cost of the gap between two points in several genomes.

    ``sumofpairs`` adds the differences of the distances over all pairs of
    coordinates, ``convex`` their logarithms; ``star-avg`` and ``star-med`` take
    a mean (floor) or the middle distance. Integer division is floor division.
    """
    if model == "star-avg":
        total = F.aggregate(F.zip_with(a, b, lambda x, y: x - y), F.lit(0).cast("bigint"), lambda acc, x: acc + x)
        return F.floor(F.abs(total) / F.size(a)).cast("double")
    d = _distances(a, b)
    if model == "star-med":
        return F.get(F.array_sort(d), F.floor(F.size(d) / 2).cast("int")).cast("double")
    pair = (lambda x: F.log(x + F.lit(1.0))) if model == "convex" else (lambda x: x.cast("double"))

    def later(x: Column, i: Column) -> Column:
        return F.aggregate(F.slice(d, i + 2, F.size(d)), F.lit(0.0), lambda acc, y: acc + pair(F.abs(x - y)))

    cost = F.aggregate(F.transform(d, later), F.lit(0.0), lambda acc, x: acc + x) * F.lit(float(weight))
    return cost + F.lit(float(epsilon)) * F.array_min(d) if epsilon else cost


def match_pvalue(length: Column, samples: Column, spaces: list[Column]) -> Column:
    """Chance of a match of this length in gaps of the given sizes: 1 - exp(log(1 - p) * product), p = 0.25 ** ((n - 1) * length)."""
    p = F.pow(F.lit(0.25), (samples - 1) * length)
    room = reduce(lambda x, y: x * y, (s.cast("double") for s in spaces))
    return 1 - F.exp(F.log1p(-p) * room)


def block_gap_cost(prev: dict[str, Column], cur: dict[str, Column], gap_open: float = 1, rearrangement: float = 10_000, inversion: float = 5, lam: float = 3, eps: float = 2) -> Column:
    """Cost of two neighbouring blocks (s1, e1, s2, e2, orient), in order of the first axis.

    Same orientation: a block that lies backward on the second axis pays a
    rearrangement, otherwise the difference of the gaps up to that cost.
    Different orientation pays the inversion on top, gaps clamped at 0.
    """
    d1 = cur["s1"] - prev["e1"]
    forward = cur["s2"] - prev["e2"]
    backward = prev["s2"] - cur["e2"]

    def colinear(d2: Column) -> Column:
        both = F.least(F.lit(float(rearrangement)), F.lit(float(lam)) * F.abs(d1 - d2)) + F.lit(float(eps)) * F.greatest(F.least(d1, d2), F.lit(0))
        return F.when(d2 < 0, F.lit(float(gap_open + rearrangement)) + F.lit(float(eps)) * F.greatest(d1, F.lit(0))).otherwise(F.lit(float(gap_open)) + both)

    c1, c2 = F.greatest(d1, F.lit(0)), F.greatest(F.greatest(forward, backward), F.lit(0))
    mixed = F.lit(float(gap_open + inversion)) + F.least(F.lit(float(rearrangement)), F.lit(float(lam)) * F.abs(c1 - c2)) + F.lit(float(eps)) * F.least(c1, c2)
    return F.when(prev["orient"] != cur["orient"], mixed).when(cur["orient"] == 0, colinear(forward)).otherwise(colinear(backward))


def cross_cost(gap: Column, tail: Column, head: Column, same: Column, gap_open: float = 1, rearrangement: float = 10_000, eps: float = 2) -> Column:
    """Cost of two neighbouring blocks on different contigs: what both leave over at the border of one reference, else a rearrangement."""
    over = F.lit(float(gap_open)) + F.least(F.lit(float(rearrangement)), F.lit(float(eps)) * (tail + head))
    return F.when(same, over).otherwise(F.lit(float(gap_open + rearrangement)) + F.lit(float(eps)) * F.abs(gap))


def allele_type(n_alleles: Column, max_len: Column, has_direct: Column, simple: Column) -> Column:
    """Variant type of a bubble from its alleles."""
    return (
        F.when(~simple, "complex").when(has_direct, "indel").when((n_alleles == 2) & (max_len == 1), "snp").when(n_alleles == 2, "region").otherwise("multi-allelic")
    )


def repeat_class(rep_ref: Column, rep_query: Column, family: Column, tandem: Column, period: Column) -> Column:
    """Class of an inserted allele from its repeat coverage (fixed limits)."""
    satellite = (
        F.when(period == 1, "homopolymer").when(period <= 6, "microsatellite").when(period < 100, "minisatellite").when(period < 1000, "macrosatellite").otherwise("megasatellite")
    )
    return F.when((rep_ref > 0.8) & (rep_query > 0.8) & (family != "Satellite"), "mei").when(tandem > 0.5, satellite).otherwise("other")
