"""Chains by search trees against all predecessors, ties included, and at size."""

import random
import time

import pytest

from strandline.operators import chain as C


def quadratic(n, gain, link, later):
    """Best chain where every earlier row is tried as predecessor; ``later``: ties go to later ones."""
    score, back = [gain(i) for i in range(n)], [-1] * n
    for i in range(n):
        for j in reversed(range(i)) if later else range(i):
            cost = link(j, i)
            if cost is not None and score[j] + gain(i) - cost > score[i]:
                score[i], back[i] = score[j] + gain(i) - cost, j
    if not n:
        return [], 0.0
    at = max(range(n), key=lambda i: (score[i], -i))
    top, path = score[at], []
    while at >= 0:
        path.append(at)
        at = back[at]
    return path[::-1], top


@pytest.mark.parametrize("dims", [2, 3, 4])
@pytest.mark.parametrize("penalty", [0, 1, 0.5])
def test_colinear_chains(dims, penalty):
    rng = random.Random(dims)
    for _ in range(60):
        rows = sorted({(*(rng.randint(0, 30) for _ in range(dims)), rng.randint(1, 6)) for _ in range(rng.randint(0, 40))})

        def link(j, i):
            p, c = rows[j], rows[i]
            d = [c[k] - p[k] - p[-1] for k in range(dims)]
            return None if min(d) < 0 else penalty * sum(abs(d[a] - d[b]) for a in range(dims) for b in range(a + 1, dims))

        want = quadratic(len(rows), lambda i: rows[i][-1] * dims * (dims - 1) / 2.0, link, False)
        assert C.best_chain(rows, dims, penalty=penalty) == want
        order = list(range(len(rows)))
        rng.shuffle(order)  # any order of the input
        path, top = C.best_chain([rows[i] for i in order], dims, penalty=penalty)
        assert ([order[i] for i in path], top) == want


@pytest.mark.parametrize("costs", [{}, {"rearrangement": 10}, {"rearrangement": 3, "inversion": 1, "lam": 1, "eps": 0}])
def test_block_chains(costs):
    rng = random.Random(9)
    for _ in range(150):
        rows = set()
        for _ in range(rng.randint(0, 40)):
            s1, s2, n = rng.randint(0, 60), rng.randint(0, 60), rng.randint(1, 9)
            rows.add((s1, s1 + n, s2, s2 + n + rng.randint(0, 2), rng.randint(0, 1), rng.randint(1, 9)))
        rows = sorted(rows)

        def link(j, i):
            p, c = rows[j], rows[i]
            follows = p[0] != c[0] and p[1] < c[1] and not (p[2] <= c[2] and p[3] >= c[3])
            return C.link_cost(p, c, **costs) if follows else None

        assert C.best_blocks(rows, **costs) == quadratic(len(rows), lambda i: 2.0 * rows[i][5], link, True)


def test_chains_at_size():
    rng = random.Random(2)
    n = 20_000
    rows = [(rng.randrange(10 * n), rng.randrange(10 * n), rng.randint(20, 60)) for _ in range(n)]
    began = time.time()
    path, _ = C.best_chain(rows)
    assert time.time() - began < 20 and len(path) > 5
    blocks = sorted((a, a + m, b, b + m, rng.randint(0, 1), m) for a, b, m in rows[:4000])
    assert time.time() - began < 40 and C.best_blocks(blocks)[0]


def brute_peeled(rows, least, window, penalty):
    """Chains by trying all predecessors, then taking the best ends in turn."""
    order = sorted(range(len(rows)), key=lambda i: rows[i])
    score, back = {}, {}
    for at, i in enumerate(order):
        s1, s2, n = rows[i]
        most, back[i] = 0.0, None
        for j in order[:at]:
            d1, d2 = s1 - rows[j][0] - rows[j][2], s2 - rows[j][1] - rows[j][2]
            if 0 <= d1 <= window and 0 <= d2 <= window:
                total = score[j] - C.convex_cost(abs(d1 - d2), penalty)
                if total > most:
                    most, back[i] = total, j
        score[i] = n + most
    taken, out = set(), []
    for end in sorted(order, key=lambda i: (-score[i], order.index(i))):
        own, at = [], end
        while at is not None and at not in taken:
            own.append(at)
            at = back[at]
        if own and sum(rows[i][2] for i in own) >= least:
            taken |= set(own)
            out.append(own[::-1])
    return out


@pytest.mark.parametrize(("least", "window", "penalty"), [(1, 1000, 1), (8, 15, 1), (5, 8, 0)])
def test_peeled_chains(least, window, penalty):
    rng = random.Random(least)
    for _ in range(150):
        rows = sorted({(rng.randint(0, 60), rng.randint(0, 60), rng.randint(1, 5)) for _ in range(rng.randint(0, 35))})
        rng.shuffle(rows)
        got = C.peeled(rows, least, window, penalty)
        assert got == brute_peeled(rows, least, window, penalty)
        assert len({i for own in got for i in own}) == sum(map(len, got))


def test_local_chains_of_both_strands(spark):
    rng = random.Random(12)
    forward = [("g", 10 * i, 10 * i + 3, 6, 0) for i in range(5)]
    backward = [("g", 10 * i, 200 - 10 * i, 6, 1) for i in range(5)]
    noise = [("h", rng.randrange(900), rng.randrange(900), 2, rng.randrange(2)) for _ in range(20)]
    df = spark.createDataFrame(forward + backward + noise, "k string, s1 int, s2 int, length int, orient int")
    got = C.local_chains(df, ["k"], 20, 50).orderBy("orient", "chain", "step").collect()
    assert [(r.k, r.orient, r.chain, r.step, r.s1, r.s2, r.length, r.chain_length) for r in got] == [("g", o, 0, i, 10 * i, 10 * i + 3 if not o else 200 - 10 * i, 6, 30) for o in (0, 1) for i in range(5)]
    assert C.local_chains(df.limit(0), ["k"], 1, 5).collect() == []
