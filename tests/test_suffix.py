"""Suffix order, common prefixes and shared strings against brute force."""

import os
import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import match as M
from strandline.operators import suffix as S


def stretches(text, stop):
    """For each position the end of its stretch without stop letters."""
    return [next((q for q in range(p, len(text)) if text[q] in stop), len(text)) for p in range(len(text))]


def brute(rows, k, least, repeats, stop):
    places = {}
    for s, key, t in rows:
        ends = stretches(t or "", stop)
        for p, e in enumerate(ends):
            for q in range(p + k, e + 1):
                left = t[p - 1] if p and t[p - 1] not in stop else None
                right = t[q] if q < e else None
                places.setdefault(t[p:q], []).append((s, key, p, left, right))
    out = {}
    for string, own in places.items():
        samples = {x[0] for x in own}
        mixed = lambda i: len({x[i] for x in own} - {None}) + sum(x[i] is None for x in own) > 1  # noqa: E731, B023
        if len(samples) >= least and (repeats or len(own) == len(samples)) and mixed(3) and mixed(4):
            out[string] = sorted(x[:3] for x in own)
    return out


@pytest.mark.parametrize(("seed", "k", "stop", "least"), [(1, 3, "", 2), (2, 2, "N", 2), (3, 4, "$", 3)])
def test_shared_strings(spark, seed, k, stop, least):
    rng = random.Random(seed)
    texts = ["".join(rng.choices("ab" + stop, weights=[5, 5] + [1] * len(stop), k=rng.randint(0, 30))) for _ in range(5)]
    long_ = "".join(rng.choices("ab", k=45))
    texts += [long_, "b" + long_[:40] + "ab", "a" * 20, long_, ""]
    rows = [(f"s{i % 4}", i, t) for i, t in enumerate(texts)] + [("s9", 99, None)]
    df = spark.createDataFrame(rows, "s string, k int, t string")
    for repeats in (False, True):
        got = M.multi_matches(df, "s", "k", "t", k, least, repeats, stop).collect()
        want = brute(rows, k, least, repeats, stop)
        assert len(got) == len({r.string for r in got})
        assert {r.string: [(o.s, o.k, o.pos) for o in r.occurrences] for r in got} == want
        assert all(r.length == len(r.string) and r.samples == len({o.s for o in r.occurrences}) for r in got)


def test_order_and_common_prefixes(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choices("ab", k=40)) for _ in range(3)]
    texts.append(texts[0][5:] + "b")
    df = spark.createDataFrame(list(enumerate(texts)), "key int, t string")
    found, rounds = S.ranks(df, "key", "t", 2)
    rows = found.collect()
    whole = {(r.key, r.pos): texts[r.key][r.pos :] for r in rows}
    assert rounds >= 4 and all(r.left == (texts[r.key][r.pos - 1] if r.pos else None) for r in rows)
    for r in rows:
        for j, rank in enumerate(r.ranks):  # how many begin with less
            assert rank == sum(w[: 2 << j] < whole[r.key, r.pos][: 2 << j] for w in whole.values())
    line = S.ordered(found, rounds, 2).orderBy("idx").collect()
    assert [whole[r.key, r.pos] for r in line] == sorted(whole[r.key, r.pos] for r in line)
    for a, b in zip(line, line[1:]):
        x, y = whole[a.key, a.pos], whole[b.key, b.pos]
        same = len(os.path.commonprefix([x, y]))
        assert b.lcp == (same if a.block == b.block else 0) and (a.block == b.block) == (same >= 2)


def test_running_sums_over_ranges(spark):
    rng = random.Random(5)
    rows = [(rng.randint(0, 9), i, rng.randint(0, 5)) for i in range(300)]
    got = {r.i: r.before for r in S.running(spark.createDataFrame(rows, "a int, i int, n int"), ["a", "i"], F.col("n"), "before").collect()}
    assert got == {i: sum(m for b, j, m in rows if (b, j) < (a, i)) for a, i, _ in rows}
    assert S.running(spark.createDataFrame([], "a int, n int"), ["a"], F.col("n"), "before").collect() == []


def test_sweep_of_a_block():
    rng = random.Random(6)
    for _ in range(300):
        texts = ["x" + "".join(rng.choices("ab", k=rng.randint(0, 5))) for _ in range(rng.randint(1, 8))]
        own = sorted(((t, rng.randrange(3), rng.choice(["p", "q", None])) for t in texts), key=lambda x: (x[0], x[1]))
        rows = [(i, len(os.path.commonprefix([own[i - 1][0], t])) if i else 0, s, left) for i, (t, s, left) in enumerate(own)]
        for repeats in (False, True):
            want = set()
            for n in range(1, 7):
                for p in {t[:n] for t, _, _ in own if len(t) >= n}:
                    at = [i for i, x in enumerate(own) if x[0].startswith(p)]
                    longer = {own[i][0][n : n + 1] for i in at}
                    lefts = [own[i][2] for i in at]
                    samples = [own[i][1] for i in at]
                    if len(at) > 1 and (len(longer) > 1 or longer == {""}) and len(set(lefts) - {None}) + lefts.count(None) > 1 and (len(set(samples)) > 1 if repeats else len(set(samples)) == len(samples)):
                        want.add((at[0], at[-1], n))
            assert set(S.sweep(rows, repeats)) == want
