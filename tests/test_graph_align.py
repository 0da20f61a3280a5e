"""Graphs aligned with graphs and sequences, segments around anchors, and the interval joins that they use."""

import itertools
import random

import pytest

from strandline.operators import graph as G
from strandline.operators import graph_align as A
from strandline.operators import intervals as I
from strandline.operators import transforms as X


def mutated(rng, text, rate):
    out = []
    for c in text:
        u = rng.random()
        out.append(rng.choice("ACGT") if u < rate else "" if u < 1.2 * rate else c + rng.choice("ACGT") if u < 1.4 * rate else c)
    return "".join(out)


def sequences(spark, texts):
    return spark.createDataFrame(list(texts.items()), "path string, seq string")


def spelled(g):
    return {r.path: r.seq for r in G.extract(g).collect()}


def letters(g):
    """Of every path, the (node, offset) of each letter."""
    size = {r.node_id: len(r.seq) for r in g.nodes.collect()}
    out = {}
    for r in g.steps.orderBy("path", "step").collect():
        out.setdefault(r.path, []).extend((r.node_id, i) for i in (range(size[r.node_id]) if r.orient == "+" else reversed(range(size[r.node_id]))))
    return out


def acyclic(g):
    edges = {(r.src, r.dst) for r in g.edges().collect()}
    nodes = {r.node_id for r in g.nodes.collect()}
    while True:
        into = {d for _, d in edges}
        free = nodes - into
        if not free:
            return not nodes
        nodes -= free
        edges = {(s, d) for s, d in edges if s not in free}


@pytest.fixture(scope="module")
def family():
    rng = random.Random(3)
    root = "".join(rng.choices("ACGT", k=500))
    return {n: mutated(rng, root, 0.02) for n in "abcd"}


@pytest.fixture(scope="module")
def pair(spark, family):
    return X.recursive_align(sequences(spark, {n: family[n] for n in "ab"}), k=12)


def test_graph_with_graph(spark, family, pair):
    other = X.recursive_align(sequences(spark, {n: family[n] for n in "cd"}), k=12)
    g = A.align_graphs(pair, other, 12)
    assert spelled(g) == family and acyclic(g)
    at = letters(g)
    for x, y, own in (("a", "b", pair), ("c", "d", other)):  # what a graph shares stays shared
        before = letters(own)
        same = {(i, j) for i, u in enumerate(before[x]) for j, v in enumerate(before[y]) if u == v}
        assert all(at[x][i] == at[y][j] for i, j in same)
    common = [len(set(at[x]) & set(at[y])) / len(at[x]) for x, y in itertools.combinations("abcd", 2)]
    assert min(common) > 0.8
    r = A.identity(g).first()
    assert r.letters == sum(map(len, family.values())) and r.aligned / r.letters > 0.85 and abs(r.share - 100 * r.aligned / r.letters) < 1e-9


def test_sequence_with_graph(spark, family, pair):
    g = A.align_graphs(pair, A.linear(sequences(spark, {"c": family["c"]})), 12)
    assert spelled(g) == {n: family[n] for n in "abc"} and acyclic(g)
    at = letters(g)
    assert len(set(at["c"]) & (set(at["a"]) | set(at["b"]))) > 0.9 * len(at["c"])


def test_matches_run_through_branches_and_groups_stay_apart(spark):
    """A SNP node between equal flanks: the third sequence follows one branch letter by letter; other groups do not meet it."""
    left, right = "ACGGTCATTGCA", "TTGACCGATAAC"
    base = G.Graph(spark.createDataFrame([(1, left), (2, "G"), (3, "T"), (4, right), (5, left + "C" + right)], "node_id bigint, seq string"), spark.createDataFrame([("x", 0, 1, "+"), ("x", 1, 2, "+"), ("x", 2, 4, "+"), ("y", 0, 1, "+"), ("y", 1, 3, "+"), ("y", 2, 4, "+"), ("z", 0, 5, "+")], "path string, step int, node_id bigint, orient string"))
    third = A.linear(sequences(spark, {"w": "CC" + left[2:] + "T" + right[:-1] + "G"}))
    groups = spark.createDataFrame([("x", "1"), ("y", "1"), ("w", "1"), ("z", "2")], "path string, group string")
    g = A.align_graphs(base, third, 8, groups)
    at = letters(g)
    assert spelled(g) == {"x": left + "G" + right, "y": left + "T" + right, "z": left + "C" + right, "w": "CC" + left[2:] + "T" + right[:-1] + "G"}
    assert at["w"][2:24] == at["y"][2:24] and not set(at["z"]) & set(at["w"]) and acyclic(g)


def test_nothing_in_common_and_backward_paths(spark):
    base = G.Graph(spark.createDataFrame([(1, "ACGTACCA")], "node_id bigint, seq string"), spark.createDataFrame([("x", 0, 1, "-")], "path string, step int, node_id bigint, orient string"))
    g = A.align_graphs(base, A.linear(sequences(spark, {"y": "ACGTACCA", "z": "A"})), 4)
    assert spelled(g) == {"x": "TGGTACGT", "y": "ACGTACCA", "z": "A"} and g.nodes.count() == 3
    assert A.identity(g).first().aligned == 0


def brute_segments(edges, aligned, source):
    def reach(there, starts, through=()):
        passed, met, front, seen = set(), set(), list(starts), set(starts)
        while front:
            for m in there.get(front.pop(), ()):
                if m not in seen:
                    seen.add(m)
                    (met if m in aligned else passed).add(m)
                    if m not in aligned or m in through:
                        front.append(m)
        return passed, met

    out = set()
    ways = [{}, {}]
    for s, d in edges:
        ways[0].setdefault(s, set()).add(d)
        ways[1].setdefault(d, set()).add(s)
    for part, (there, home) in (("trailing", ways), ("leading", ways[::-1])):
        passed, met = reach(there, [source])
        if len(met) > 1:
            passed &= reach(home, met, met)[0]
        out |= {(source, n, part) for n in passed}
    return out


def test_segments(spark):
    rng = random.Random(5)
    for _ in range(2):
        edges = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(60)}
        aligned = set(rng.sample(range(40), 12))
        sources = set(rng.sample(sorted(aligned), 6))
        frame = lambda rows: spark.createDataFrame([(n,) for n in rows], "node_id int")
        got = A.segments(spark.createDataFrame(sorted(edges), "src int, dst int"), frame(aligned), frame(sources)).collect()
        assert sorted(map(tuple, got)) == sorted(x for s in sources for x in brute_segments(edges, aligned, s))


def test_asof_join_over_range_borders_and_ties(spark):
    rng = random.Random(6)
    points = [(i, rng.choice(["a", "b", "c", None]), rng.choice([None, *range(60)])) for i in range(300)] + [(i, "hot", 7) for i in range(300, 500)]
    marks = [(rng.choice(["a", "b", None, "hot"]), rng.choice([None, *range(0, 60, 3)]), i) for i in range(25)] + [("hot", 5, 99), ("hot", 5, 98)]
    p, m = spark.createDataFrame(points, "id int, k string, at int"), spark.createDataFrame(marks, "k string, place int, value int")
    best = {}
    for i, k, at in points:
        held = [(x, v) for q, x, v in marks if q == k and x is not None and at is not None and k is not None and x <= at]
        best[i] = max(held, default=None)
    inner = {r.id: (r.place, r.value) for r in I.asof_join(p, m, "at", "place", ["k"]).collect()}
    assert inner == {i: v for i, v in best.items() if v}
    left = I.asof_join(p, m, "at", "place", ["k"], "left").collect()
    assert len(left) == len(points) and {r.id: (r.place, r.value) if r.place is not None else None for r in left} == best
    assert I.asof_join(p, m.limit(0), "at", "place", ["k"]).count() == 0 and I.asof_join(p.limit(0), m, "at", "place", ["k"]).count() == 0
    with pytest.raises(ValueError):
        I.asof_join(p, m, "at", "place", ["k"], "outer")


def test_subtract_and_masks(spark):
    rng = random.Random(7)
    span = lambda: (lambda s: (s, s + rng.randint(0, 12)))(rng.randint(0, 60))
    left = [(i, rng.choice("ab"), *span()) for i in range(60)] * 2  # repeated rows too
    right = [(rng.choice("abc"), *span()) for _ in range(20)]
    a, b = spark.createDataFrame(left, "i int, k string, s int, e int"), spark.createDataFrame(right, "k string, s2 int, e2 int")
    parts, whole, gone = [], [], []
    for i, k, s, e in left:
        free = [x for x in range(s, e) if not any(q == k and u <= x < v for q, u, v in right)]
        cuts = [x for x in free if x - 1 not in free]
        parts += [(i, x, next(y for y in itertools.count(x) if y not in free)) for x in cuts]
        whole += [(i, s, e)] if len(free) == e - s > 0 else []
        gone += [(i, None, None)] if s < e and not free else []
    run = lambda how: sorted(((r.i, r.s, r.e) for r in I.subtract(a, b, "s", "e", "s2", "e2", 5, ["k"], how).collect()), key=repr)
    assert run("parts") == sorted(parts, key=repr) and run("anti") == sorted(whole, key=repr) and run("outer") == sorted(parts + gone, key=repr)

    texts = [("a", "abcdefghij" * 6), ("b", "é漢😀xyz"), ("z", "untouched"), ("n", None)]
    spans = [(q, u, v) for q, u, v in right] + [("b", -3, 2), ("b", 4, 99), ("n", 0, 3)]
    got = {r.k: r.t for r in I.mask(spark.createDataFrame(texts, "k string, t string"), spark.createDataFrame(spans, "k string, s int, e int"), "k", "t", "s", "e").collect()}
    for k, t in texts:
        assert got[k] == (None if t is None else "".join("N" if any(q == k and u <= i < v for q, u, v in spans) else c for i, c in enumerate(t)))


def test_points_in_no_range(spark):
    p = spark.createDataFrame([(1,), (1,), (5,), (9,)], "at int")
    r = spark.createDataFrame([(0, 3, "x"), (1, 2, "y"), (6, 6, "z")], "s int, e int, n string")
    assert sorted(x.at for x in I.stab_join(p, r, "at", "s", "e", 4, how="anti").collect()) == [5, 9]
    assert sorted((x.at, x.n or "") for x in I.stab_join(p, r, "at", "s", "e", 4, how="left").collect()) == [(1, "x"), (1, "x"), (1, "y"), (1, "y"), (5, ""), (9, "")]
