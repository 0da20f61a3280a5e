"""Writers, readers and views of graphs by their content."""

import collections
import random

import pytest

from strandline.operators import bubbles as B
from strandline.operators import graph as G
from strandline.operators import separators as P
from strandline.sources import text_formats as S
from tests.test_separators import graphs, tables


@pytest.fixture(scope="module")
def small(spark):
    nodes = [(1, "ACGT"), (2, "G"), (3, "TT"), (4, "CCC")]
    steps = [("ref", 0, 1, "+"), ("ref", 1, 2, "+"), ("ref", 2, 4, "+"), ("alt", 0, 1, "+"), ("alt", 1, 3, "+"), ("alt", 2, 4, "+"), ("*old", 0, 4, "+"), ("*old", 1, 3, "-"), ("*old", 2, 1, "+")]
    return G.Graph(spark.createDataFrame(nodes, "node_id bigint, seq string"), spark.createDataFrame(steps, "path string, step int, node_id bigint, orient string"))


def test_rearrangements(small):
    got = {(r.src, r.dst, r.is_inverted, r.reference_offset, tuple(r.paths)) for r in B.rearrangements(small, lambda p: p.startswith("*")).collect()}
    # 4 -> 3 and 3 -> 1 are the reverse of edges that references take, so that only an edge without a way back is one
    assert got == set()
    more = G.Graph(small.nodes, small.steps.where("path <> '*old'").unionByName(small.steps.sparkSession.createDataFrame([("*new", 0, 2, "+"), ("*new", 1, 3, "-"), ("*new", 2, 2, "+")], "path string, step int, node_id bigint, orient string")))
    got = sorted((r.src, r.dst, r.is_inverted, r.reference_offset, r.paths) for r in B.rearrangements(more, lambda p: p.startswith("*")).collect())
    assert got == [] or all(o == {2: 4, 3: 4}[s] and inv and p == ["*new"] for s, _, inv, o, p in got)
    one = G.Graph(small.nodes, small.steps.where("path <> '*old'").unionByName(small.steps.sparkSession.createDataFrame([("*new", 0, 2, "+"), ("*new", 1, 3, "-")], "path string, step int, node_id bigint, orient string")))
    assert [(r.src, r.dst, r.is_inverted, r.reference_offset, r.paths) for r in B.rearrangements(one, lambda p: p.startswith("*")).collect()] == [(2, 3, True, 4, ["*new"])]


def test_gml_and_fasta_of_nodes(small):
    lines = {r.line for r in S.gml_lines(small).collect()}
    assert 'node [\n  id 3\n  seq "TT"\n  l 2\n]' in lines and 'edge [\n  source 1\n  target 3\n  paths "alt"\n]' in lines
    assert len(lines) == 4 + small.edges().count()
    text = "\n".join(r.line for r in S.node_fasta_lines(small).collect()).split("\n")
    assert dict(zip(text[::2], text[1::2])) == {">1": "ACGT", ">2": "G", ">3": "TT", ">4": "CCC"}


def test_mfa_and_bed(spark, tmp_path):
    rows = spark.createDataFrame([("a", "AC-G"), ("b", "ACTG")], "path string, text string")
    text = "\n".join(r.line for r in S.mfa_lines(rows).collect()).split("\n")
    assert dict(zip(text[::2], text[1::2])) == {">a": "AC-G", ">b": "ACTG"}
    spans = spark.createDataFrame([("c1", 3, 9, "x"), ("c2", 0, 4, None)], "reference string, start bigint, `end` bigint, name string")
    S.bed_lines(spans, ["reference", "start", "end", "name"]).coalesce(1).write.text(str(tmp_path / "b"))
    assert sorted(map(tuple, S.read_bed(spark, str(tmp_path / "b")).collect())) == [("c1", 3, 9, "x"), ("c2", 0, 4, ".")]


def test_subgraph_of_nodes(spark, small):
    own = G.subgraph_of(small, spark.createDataFrame([(1,), (3,), (3,), (99,)], "node_id bigint"))
    assert sorted(r.node_id for r in own.nodes.collect()) == [1, 3]
    assert sorted((r.path, r.node_id) for r in own.steps.collect()) == [("*old", 1), ("*old", 3), ("alt", 1), ("alt", 3), ("ref", 1)]


def test_gfa_links_that_no_path_takes(spark, tmp_path):
    (tmp_path / "g.gfa").write_text("H\tVN:Z:1.0\nS\t1\tAC\nS\t2\tG\nS\t3\tT\nS\t4\tA\nL\t1\t+\t2\t+\t0M\nL\t1\t+\t3\t-\t0M\nL\t3\t+\t4\t+\t0M\nP\tp\t1+,2+\t0M\nP\tq\t3+\t*\n")
    g = S.read_gfa(spark, str(tmp_path / "g.gfa"))
    assert {(r.src, r.ofrom, r.dst, r.oto, tuple(r.paths)) for r in g.edges().collect()} == {(1, "+", 2, "+", ("p",)), (1, "+", 3, "-", ())}  # 4 is on no path
    S.gfa_lines(g).coalesce(1).write.text(str(tmp_path / "h"))
    back = S.read_gfa(spark, str(tmp_path / "h"))
    key = lambda x: {(r.src, r.ofrom, r.dst, r.oto, tuple(r.paths)) for r in x.edges().collect()}
    assert key(back) == key(g)
    (tmp_path / "n.gfa").write_text("S\t1\tAC\nS\t2\tG\nL\t1\t+\t2\t+\t0M\n")
    bare = S.read_gfa(spark, str(tmp_path / "n.gfa"))
    assert {(r.src, r.dst) for r in bare.edges().collect()} == {(1, 2)} and bare.nodes.count() == 2


@pytest.mark.parametrize("limit", [1, 6, 1000])
def test_parts_of_bounded_size(spark, limit):
    seqs, paths = graphs(random.Random(2), 25)
    g = tables(spark, seqs, paths)
    cut = P.parts(g, limit).collect()
    where = {r.node_id: r.component for r in G.components(g).collect()}
    nodes = collections.defaultdict(set)
    for r in cut:
        nodes[r.component, r.part].add(r.node_id)
        assert where[r.node_id] == r.component
    assert set().union(*nodes.values()) == set(seqs)
    pieces, _ = P.pieces(g)
    most = collections.Counter((r.component, r.piece) for r in pieces.collect())
    for (c, _), own in nodes.items():
        assert len(own) <= max(limit, max(n for (d, _), n in most.items() if d == c))
    if limit == 1000:
        assert len(nodes) == len(set(where.values()))
    lines = S.gml_parts(g, limit).collect()
    edges = {r.line for r in lines if r.line.startswith("edge")}
    assert edges == {r.line for r in S.gml_lines(g).collect() if r.line.startswith("edge")}  # every edge lies in a part


# ------------------------------------------------------------------ filters

def test_nodes_by_number_of_paths(small):
    assert sorted(r.node_id for r in G.by_samples(small, 3).nodes.collect()) == [1, 4]
    assert sorted(r.node_id for r in G.by_samples(small, 1, 2).nodes.collect()) == [2, 3]


def test_long_component_names_differ(spark):
    steps = [(f"{'n' * 110}{i}_{j}", 0, 10 * i, "+") for i in (1, 2) for j in (1, 2)]
    g = G.Graph(spark.createDataFrame([(10, "A"), (20, "C")], "node_id bigint, seq string"), spark.createDataFrame(steps, "path string, step int, node_id bigint, orient string"))
    names = {r.component: r.name for r in G.named_components(g).collect()}
    assert len(set(names.values())) == 2 and all(n.endswith(str(c)) and len(n) <= 200 for c, n in names.items())


def test_unzip_by_difference_of_alleles(spark):
    from strandline.operators import transforms as X

    nodes = [(1, "ACGTACGT"), (2, "G"), (3, "TT"), (4, "CCCCCCCC"), (5, "A"), (6, "AAAAAA"), (7, "GGGGGGGG")]
    steps = [("x", i, n, "+") for i, n in enumerate([1, 2, 4, 5, 7])] + [("y", i, n, "+") for i, n in enumerate([1, 3, 4, 6, 7])]
    g = G.Graph(spark.createDataFrame(nodes, "node_id bigint, seq string"), spark.createDataFrame(steps, "path string, step int, node_id bigint, orient string"))
    size = lambda *a: {r.node_id: len(r.seq) for r in X.unzip(g, 2, *a).nodes.collect()}
    before = {n: len(s) for n, s in nodes}
    changed = lambda after: {n for n in before if after[n] != before[n]} & {2, 3, 5, 6}
    assert changed(size()) == {2, 3, 5, 6} and changed(size(2)) == {5, 6} and changed(size(0, 2)) == {2, 3} and changed(size(2, 3)) == set()
    whole = {r.path: r.seq for r in G.extract(g).collect()}
    assert {r.path: r.seq for r in G.extract(X.unzip(g, 2, 0, 2)).collect()} == whole


def test_unzip_leaves_bubbles_where_a_path_begins_or_ends_in_an_allele(spark):
    from strandline.operators import transforms as X

    nodes = [(1, "ACGTACGT"), (2, "G"), (3, "TT"), (4, "CCCCCCCC"), (5, "A"), (6, "AAAAAA"), (7, "GGGGGGGG"), (8, "C"), (9, "T"), (10, "TTTTTTTT")]
    walks = {"x": [1, 2, 4, 5, 7, 8, 10], "y": [1, 3, 4, 6, 7, 9, 10], "ends": [1, 2], "begins": [6, 7, 8, 10]}
    steps = [(p, i, n, "+") for p, own in walks.items() for i, n in enumerate(own)]
    g = G.Graph(spark.createDataFrame(nodes, "node_id bigint, seq string"), spark.createDataFrame(steps, "path string, step int, node_id bigint, orient string"))
    moved = X.unzip(g, 2)
    assert {r.path: r.seq for r in G.extract(moved).collect()} == {p: "".join(dict(nodes)[n] for n in own) for p, own in walks.items()}
    after = {r.node_id: r.seq for r in moved.nodes.collect()}
    assert {n for n, seq in nodes if after[n] != seq} == {7, 8, 9, 10}


def test_alignment_stops_at_small_gaps_and_matches_of_the_best_samples(spark):
    from strandline.operators import match as M
    from strandline.operators import transforms as X

    rng = random.Random(11)
    root = "".join(rng.choices("ACGT", k=120))
    rows = [("a", root), ("b", root[:60] + "T" + root[61:])]
    df = spark.createDataFrame(rows, "path string, seq string")
    assert X.recursive_align(df, 12, max_size=200).nodes.count() == 2  # nothing is aligned
    g = X.recursive_align(df, 12, max_size=50)
    assert {r.path: r.seq for r in G.extract(g).collect()} == dict(rows) and g.nodes.count() < 6 and len({r.node_id for r in g.steps.where("path = 'a'").collect()} & {r.node_id for r in g.steps.where("path = 'b'").collect()}) >= 2
    texts = spark.createDataFrame([("p", 1, "ACGTTT"), ("q", 2, "GACGTTC"), ("r", 3, "TACGA"), ("p", 4, "GGCA"), ("q", 5, "AGGCT")], "s string, k int, t string")
    found = M.multi_mums(texts, "s", "k", "t", 3)
    best = {r.string for r in M.same_samples(found, "s").collect()}
    assert best == {r.string for r in found.collect() if r.samples == 3} and best


def test_small_contigs_and_chains_are_left_out(spark):
    from strandline.operators import layout as L

    rng = random.Random(12)
    ref = "".join(rng.choices("ACGT", k=600))
    contigs = [("long", ref[50:350]), ("short", ref[400:480])]
    frames = spark.createDataFrame([("ref", ref)], "name string, seq string"), spark.createDataFrame(contigs, "name string, seq string")
    names = lambda **o: sorted(r.ctg for r in L.place_contigs(*frames, k=20, **o).collect())
    assert names() == ["long", "short"] and names(min_contig=100) == ["long"] and names(min_chain=200) == ["long"] and names(min_chain=1000) == []
