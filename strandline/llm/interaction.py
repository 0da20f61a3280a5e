"""How filters of a corpus interact: survivors of every order of them, and exact Shapley values.

A document's mask says which filters it fails. What a set of filters removes
from a part of the corpus is a polynomial in one variable a filter,

    f(x) = sum over masks S of count[S] * (1 - product over i in S of (1 - x[i])),

the multilinear extension of the removal game. Its value at a corner is the
number of documents that this set of filters removes, so that differences of
corners give what every step of every order removes; the Shapley value of a
filter is the integral of its partial derivative along the diagonal, a sum of
exact rationals. Orders of filters never meet documents: only mask counts do,
of which a part has at most ``2 ** k``.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.session import materialise

#: The filter that fails what an earlier document's text repeats.
COPIES = "E"


def filters(text: Column) -> dict[str, Column]:
    """What a text alone fails, by filter: few words, repeated words, capitals, symbols."""
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * capitals.cast("bigint") > 5 * F.char_length(text).cast("bigint"),
        "D": text.rlike("[#$%&*|]"),
    }


def superset_sums(counts: Sequence[int]) -> list[int]:
    """For every subset, the sum of the counts of its supersets."""
    a = list(counts)
    for i in range(len(a).bit_length() - 1):
        for u in range(len(a)):
            if not u >> i & 1:
                a[u] += a[u | 1 << i]
    return a


def removal_polynomial(counts: Sequence[int]) -> list[int]:
    """Coefficients, by subset of variables, of the multilinear extension of what filters remove."""
    return [0] + [n if u.bit_count() % 2 else -n for u, n in enumerate(superset_sums(counts)) if u]


def corners(polynomial: Sequence[int]) -> list[int]:
    """The polynomial's values where the variables of a subset are 1 and all others 0, for every subset."""
    v = list(polynomial)
    for i in range(len(v).bit_length() - 1):
        for u in range(len(v)):
            if u >> i & 1:
                v[u] += v[u ^ 1 << i]
    return v


def shapley(polynomial: Sequence[int], i: int) -> Fraction:
    """The integral over t from 0 to 1 of the partial derivative by variable ``i`` at (t, ..., t)."""
    slope = [0] * (len(polynomial).bit_length() - 1)
    for u, a in enumerate(polynomial):
        if u >> i & 1:
            slope[u.bit_count() - 1] += a
    return sum((Fraction(a, j + 1) for j, a in enumerate(slope)), Fraction(0))


def steps(letters: str, n: Sequence[int], good: Sequence[int], toxic: Sequence[int]) -> list[tuple]:
    """``(filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)`` of every step of every order, from counts by mask."""
    k = len(letters)
    polynomial = removal_polynomial(n)
    gone, good_gone, toxic_gone = corners(polynomial), corners(removal_polynomial(good)), corners(removal_polynomial(toxic))
    share = [shapley(polynomial, i) * factorial(k) for i in range(k)]
    full, total = (1 << k) - 1, sum(n)
    out = []
    for order in permutations(range(k)):
        before = 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            removed = gone[after] - gone[before]
            own = (total - gone[after], removed, gone[1 << i] - removed, gone[full] - gone[full ^ 1 << i], good_gone[after] - good_gone[before], toxic_gone[after] - toxic_gone[before], int(share[i]))
            out.append(("".join(letters[j] for j in order), step, *own))
            before = after
    return out


_STEPS = ["filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
_KINDS = [pa.string(), pa.int32(), *[pa.int64()] * 7]


def _parts(letters: str):
    def run(batches):
        for rb in batches:
            for part, cells in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), strict=True):
                by = [[0] * (1 << len(letters)) for _ in range(3)]
                for c in cells:
                    for own, name in zip(by, ("n", "good", "toxic"), strict=True):
                        own[c["mask"]] = c[name]
                rows = steps(letters, *by)
                cols = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(_KINDS)]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(rows)), *cols], ["part", *_STEPS])

    return run


def masked(docs: DataFrame) -> tuple[DataFrame, str]:
    """``(doc_id, part, mask, n)``: how many equal rows of ``docs(doc_id, text, source)`` fail the filters of ``mask``, whose bits follow the letters returned.

    Repeated texts are found by a digest: the smallest doc_id of each text
    alone passes. That id and digest are the join key, so that a text with many
    copies is no hot key; equal rows are counted before they meet anything.
    """
    text = F.coalesce("text", F.lit(""))
    own = filters(text)
    bits = sum((flag.cast("int") * (1 << i) for i, flag in enumerate(own.values())), F.lit(0))
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), bits.alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest"))
    rows = materialise(rows, "masks")
    first = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    cells = rows.groupBy("doc_id", "digest", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    first = first.select("first_id", F.col("digest").alias("first_digest"))
    both = cells.join(first, (cells.doc_id == first.first_id) & (cells.digest == first.first_digest), "left")
    copy = (F.col("doc_id").isNotNull() & F.col("first_id").isNull()).cast("int") * (1 << len(own))
    return both.select("doc_id", "part", (F.col("mask") + copy).alias("mask"), "n"), "".join(own) + COPIES


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)``: a row for each source, order of the filters and step.

    Counts are of rows of ``docs(doc_id, text, source)``, ``good`` and ``toxic``
    ones by ``labels(doc_id, quality, toxic)``; where labels repeat a doc_id,
    one that says 1 is enough, and null labels say nothing. A null text counts
    as empty, a null source as an empty name. A null doc_id repeats nothing and
    is repeated by nothing, and has no label; rows that repeat a doc_id with
    the same text tie and repeat one another in neither way. A very long text
    is one row's words. An empty table gives an empty result; other columns,
    whatever their names, are not read.
    """
    rows, letters = masked(docs)
    says = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")).alias(f"is_{c}")
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("label_id")).agg(says("quality"), says("toxic"))
    both = rows.join(known, rows.doc_id == known.label_id, "left")
    total = lambda c, name: F.coalesce(F.sum(F.col("n") * F.col(c)), F.lit(0)).alias(name)
    counts = both.groupBy("part", "mask").agg(F.sum("n").alias("n"), total("is_quality", "good"), total("is_toxic", "toxic"))
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 at most
    kinds = "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"
    return parts.mapInArrow(_parts(letters), kinds)
