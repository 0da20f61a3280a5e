"""Folds over pieces between common nodes against folds over whole components."""

import random

import pytest

from strandline.operators import bubbles as B
from strandline.operators import graph as G
from strandline.operators import separators as S


def graphs(rng, n):
    """Paths over ascending nodes, each component with nodes of its own, some of which all of its paths visit."""
    paths, seqs = {}, {}
    for c in range(n):
        low, k = 1000 * c, rng.randint(3, 25)
        common = set(rng.sample(range(k), rng.randint(0, min(4, k))))
        for p in range(rng.randint(1, 4)):
            own = [low + i for i in range(k) if i in common or rng.random() < 0.5]
            if own:
                paths[f"p{c}_{p}"] = own
        seqs |= {i: "ACGTN"[rng.randrange(5)] * rng.randint(1, 4) for own in paths.values() for i in own if i not in seqs}
    return seqs, paths


def tables(spark, seqs, paths):
    steps = [(p, i, n, "+") for p, own in paths.items() for i, n in enumerate(own)]
    return G.Graph(spark.createDataFrame(list(seqs.items()), "node_id bigint, seq string"), spark.createDataFrame(steps, "path string, step int, node_id bigint, orient string"))


def ways(seqs, paths):
    nexts = {n: set() for n in seqs}
    for own in paths.values():
        for a, b in zip(own, own[1:]):
            nexts[a].add(b)
    return nexts


def test_folds_over_pieces(spark):
    seqs, paths = graphs(random.Random(1), 40)
    g, nexts = tables(spark, seqs, paths), ways(seqs, paths)
    nodes, _ = S.pieces(g)
    assert nodes.agg({"piece": "max"}).first()[0] >= 3

    far, count, best = {}, {}, {}
    letters = {n: sum(c != "N" for c in s) for n, s in seqs.items()}
    for n in sorted(seqs):  # ids ascend along all paths
        before = [m for m in seqs if n in nexts[m]]
        far[n] = max((far[m] + len(seqs[m]) for m in before), default=0)
        count[n] = max((count[m] + 1 for m in before), default=0)
        best[n] = letters[n] + max((best[m] for m in before), default=0)
    assert {r.node_id: r.distance for r in S.distances(g).collect()} == far
    assert {r.node_id: r.distance for r in S.distances(g, letters=False).collect()} == count

    where = {r.node_id: r.component for r in G.components(g).collect()}
    for r in S.longest_paths(g).collect():
        own = [n for n in seqs if where[n] == r.component]
        assert r.length == max(best[n] for n in own) == sum(letters[n] for n in r.path)
        assert all(b in nexts[a] for a, b in zip(r.path, r.path[1:])) and set(r.path) <= set(own)

    visits = {n: frozenset(p for p, own in paths.items() if n in own) for n in seqs}
    whole = set()
    for c in set(where.values()):
        for s, t, inner in B.find_superbubbles({n: sorted(nexts[n]) for n in seqs if where[n] == c}):
            if visits[s] == visits[t]:
                whole.add((c, s, t, tuple(inner)))
    got = {(r.component, r.source, r.sink, tuple(r.inner)) for r in B.superbubbles(g).collect()}
    assert got == whole and len(got) > 5


def test_paths_that_disagree_and_nodes_without_paths(spark):
    """Common nodes in two orders, and repeated visits: the component stays one piece; a cycle has no distances."""
    seqs = {i: "A" for i in range(1, 9)}
    g = tables(spark, seqs, {"x": [1, 2, 3], "y": [1, 3, 2], "z": [5, 6, 5, 7]})
    nodes, edges = S.pieces(g)
    assert {r.piece for r in nodes.collect() if r.component == 1} == {0} and {(r.src, r.dst) for r in edges.collect() if r.component == 1} == {(1, 2), (2, 3), (1, 3), (3, 2)}
    assert sorted((r.piece, r.role or "") for r in nodes.collect() if r.node_id == 7) == [(0, "")]  # 5 is before and after 6
    assert {r.node_id for r in nodes.collect()} == set(seqs)
    with pytest.raises(Exception, match="cycle"):
        S.distances(g).collect()
    lone = tables(spark, {1: "AN", 2: "C"}, {"x": [1]})
    assert sorted(map(tuple, S.distances(lone).collect())) == [(1, 0), (2, 0)]
    assert sorted((r.path, r.length) for r in S.longest_paths(lone).collect()) == [([1], 1), ([2], 1)]
