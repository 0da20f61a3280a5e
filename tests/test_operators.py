"""Operators against brute force, round trips and small worked cases."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.functions import expr as E
from strandline.operators import arrange as A
from strandline.operators import bubbles as B
from strandline.operators import chain as C
from strandline.operators import graph as G
from strandline.operators import intervals as I
from strandline.operators import layout as L
from strandline.operators import match as M
from strandline.operators import msa
from strandline.operators.components import connected_components
from strandline.sources import text_formats as S


@pytest.fixture()
def tiny(spark):
    nodes = spark.createDataFrame([(1, "ACGT"), (2, "A"), (3, "C"), (4, "GGTT")], "node_id bigint, seq string")
    steps = spark.createDataFrame([("ref", 0, 1, "+"), ("ref", 1, 2, "+"), ("ref", 2, 4, "+"), ("alt", 0, 1, "+"), ("alt", 1, 3, "+"), ("alt", 2, 4, "+")], "path string, step int, node_id bigint, orient string")
    return G.Graph(nodes, steps)


def brute_mems(a, b, k):
    out = set()
    for i in range(len(a)):
        for j in range(len(b)):
            if i and j and a[i - 1] == b[j - 1]:
                continue
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if n >= k:
                out.add((i, j, n))
    return out


def brute_mums(a, b, k):
    count = lambda s, t: sum(t.startswith(s, i) for i in range(len(t)))
    return {(i, j, n) for i, j, n in brute_mems(a, b, k) if count(a[i : i + n], a) == 1 and count(a[i : i + n], b) == 1}


@pytest.mark.parametrize("chunk", [3, 256])
def test_mems_and_mums_match_their_definitions(spark, chunk, monkeypatch):
    monkeypatch.setattr(M, "CHUNK", chunk)
    rng = random.Random(chunk)
    pairs = [("".join(rng.choices("ACG", k=rng.randint(1, 40))), "".join(rng.choices("ACG", k=rng.randint(1, 40)))) for _ in range(25)]
    for k in (2, 4):
        ref = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(pairs)], "r int, a string")
        qry = spark.createDataFrame([(i, b) for i, (_, b) in enumerate(pairs)], "q int, b string")
        found = M.mems(M.seeds(ref, qry, "r", "q", "a", "b", k), "r", "q", k).where("r = q")
        mems, mums = {}, {}
        for r in found.collect():
            mems.setdefault(r.r, set()).add((r.r_start, r.q_start, r.length))
        for r in M.mums(found, "r", "q").collect():
            mums.setdefault(r.r, set()).add((r.r_start, r.q_start, r.length))
        for i, (a, b) in enumerate(pairs):
            assert mems.get(i, set()) == brute_mems(a, b, k)
            assert mums.get(i, set()) == brute_mums(a, b, k)


def test_multi_mums_match_their_definition(spark):
    rng = random.Random(4)
    base = "".join(rng.choices("ACGT", k=60))
    texts = [base[:30] + "".join(rng.choices("ACGT", k=10)) + base[30:], base, base[10:50] + "".join(rng.choices("AC", k=12))]
    df = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "s int, k int, t string")
    got = {r.string: [(o.s, o.pos) for o in r.occurrences] for r in M.multi_mums(df, "s", "k", "t", 5, 2).collect()}
    want = {}
    for t in texts:
        for i in range(len(t)):
            for j in range(i + 5, len(t) + 1):
                w = t[i:j]
                occ = [(s, p) for s, x in enumerate(texts) for p in range(len(x)) if x.startswith(w, p)]
                if len(occ) < 2 or len(occ) != len({s for s, _ in occ}):
                    continue
                lefts = [texts[s][p - 1] if p else None for s, p in occ]
                rights = [texts[s][p + len(w)] if p + len(w) < len(texts[s]) else None for s, p in occ]
                if (None in lefts or len(set(lefts)) > 1) and (None in rights or len(set(rights)) > 1):
                    want[w] = occ
    assert got == want


def test_fixture_counts_of_the_small_pair(spark):
    a, b = "ACTTGCTAGCTAGTCAG", "ACTAGCTAGCTAGTGAG"
    ref, qry = spark.createDataFrame([(0, a)], "r int, a string"), spark.createDataFrame([(0, b)], "q int, b string")
    for k, mems, mums in ((1, 38, 3), (3, 5, 2)):
        found = M.mems(M.seeds(ref, qry, "r", "q", "a", "b", k), "r", "q", k)
        assert found.count() == mems
        assert M.mums(found, "r", "q").count() == mums


def test_tiny_graph(spark, tiny):
    assert {r.path: r.seq for r in G.extract(tiny).collect()} == {"ref": "ACGTAGGTT", "alt": "ACGTCGGTT"}
    assert {(r.path, r.offset) for r in G.offsets(tiny).where("node_id = 4").collect()} == {("ref", 5), ("alt", 5)}
    assert [(r.source, r.sink, r.inner) for r in B.simple_bubbles(tiny.edges()).collect()] == [(1, 4, [2, 3])]
    assert [(r.source, r.sink, r.inner) for r in B.superbubbles(tiny).collect()] == [(1, 4, [2, 3])]
    v = {r.allele: (r.type, r.allele_index, r.paths) for r in B.variants(tiny).collect()}
    assert v == {"C": ("snp", 0, ["alt"]), "A": ("snp", 1, ["ref"])}
    report = B.variant_report(tiny, "ref")
    assert [r.line for r in B.vcf_lines(report, ["ref", "alt"]).collect()] == ["ref\t5\t.\tA\tC\t.\tPASS\tdiffsize=0;source=1;sink=4;bubbletype=snp;start=5;end=5\tGT:SZ\t0:1\t1:1"]
    assert [r.line for r in B.variant_tsv(report, ["ref", "alt", "no"]).collect()] == ["ref\t4\t5\t4\t4\t1\t1\t0\t1\t4\tACGT\tGGTT\tsnp\tC,A\t1\t0\t-"]
    assert B.variant_tsv_header(["x"]).endswith("genotypes\tx") and B.vcf_header([("ref", 9)], ["x"])[-1].endswith("FORMAT\tx")
    assert [r.line for r in B.variant_bed(report).collect()] == ["ref\t4\t5\tsnp"]
    assert sorted(r.line for r in B.variant_fasta(report).collect()) == [">ref:4-5_0\nC", ">ref:4-5_1\nA"]
    assert G.longest_path(tiny).first().length == 9
    assert {r.component for r in G.components(tiny).collect()} == {1}


def test_gfa_round_trip(spark, tiny, tmp_path):
    S.gfa_lines(tiny).coalesce(1).write.text(str(tmp_path / "g"))
    back = S.read_gfa(spark, str(tmp_path / "g"))
    assert {r.path: r.seq for r in G.extract(back).collect()} == {"ref": "ACGTAGGTT", "alt": "ACGTCGGTT"}


def test_fasta_reader(spark, tmp_path):
    (tmp_path / "b.fa").write_text("\n>x>y z\nAC>G\n>\tw\nA\n")
    assert {r.name: r.seq for r in S.read_fasta(spark, str(tmp_path / "b.fa")).collect()} == {"xy z": "AC>G", "w": "A"}
    (tmp_path / "a.fa").write_text(">one x\nacg-t\nNN\n>empty\n>two\nNNACNNNNGT\n")
    got = {r.name: r.seq for r in S.read_fasta(spark, str(tmp_path / "a.fa")).collect()}
    assert got == {"one x": "ACGTNN", "two": "NNACNNNNGT"}
    assert {r.name: r.seq for r in S.read_fasta(spark, str(tmp_path / "a.fa"), cut_n=3).collect()} == {"one x_0": "ACGTNN", "two_0": "NNAC", "two_1": "GT"}
    assert {r.name: r.seq for r in S.read_fasta(spark, str(tmp_path / "a.fa"), truncate_n=True).collect()} == {"one x": "ACGTN", "two": "ACNGT"}


def test_maf_vcf_bed_reports(spark, tmp_path):
    rows = [(0, "a", 0, 3, "+", 9, "AC-G"), (0, "b", 2, 4, "+", 8, "ACTG")]
    df = spark.createDataFrame(rows, "block bigint, sample string, start bigint, size bigint, strand string, src_size bigint, text string")
    S.maf_lines(df).coalesce(1).write.text(str(tmp_path / "m"))
    got = S.read_maf(spark, str(tmp_path / "m")).drop("block").collect()
    assert sorted(map(tuple, got)) == [r[1:] for r in rows]
    (tmp_path / "v.vcf").write_text("##x\n#CHROM\nc\t5\ti\tA\tC,G\t.\tPASS\tA=1;B=2\n")
    v = S.read_vcf(spark, str(tmp_path / "v.vcf")).first()
    assert (v.pos, v.alts, v.info["B"]) == (5, ["C", "G"], "2")
    (tmp_path / "t").write_text("start end\n1 5 2 2.5\n")
    t = S.read_columns(spark, str(tmp_path / "t"), ["start", "end", "period_size", "copynumber"]).collect()[0]
    assert (t["end"], t.copynumber) == (5, 2.5)
    g = S.aligned_graph(df.select(F.col("sample").alias("path"), "text"))
    assert {r.path: r.seq for r in G.extract(g).collect()} == {"a": "ACG", "b": "ACTG"}
    with pytest.raises(ValueError):
        S.fasta_graph(spark.createDataFrame([("a", "A"), ("a", "C")], "name string, seq string"))


def test_reverse_complement_is_its_own_inverse(spark):
    text = "ACGTNRYKMSWBVDHXacgtnx-"
    df = spark.createDataFrame([(text,)], "s string")
    r = df.select(E.reverse_complement(E.reverse_complement(F.col("s"))).alias("t"), E.reverse_complement(F.lit("AACgt")).alias("u")).first()
    assert (r.t, r.u) == (text, "acGTT")


def test_prune_and_contract_keep_all_paths(spark):
    nodes = spark.createDataFrame([(1, "AC"), (2, "G"), (3, "G"), (4, "TT"), (5, "A"), (6, "CC")], "node_id bigint, seq string")
    steps = spark.createDataFrame([("p", i, n, "+") for i, n in enumerate([1, 2, 4, 5, 6])] + [("q", i, n, "+") for i, n in enumerate([1, 3, 4, 5, 6])], "path string, step int, node_id bigint, orient string")
    g = G.Graph(nodes, steps)
    want = {r.path: r.seq for r in G.extract(g).collect()}
    p = G.prune(g)
    assert p.nodes.count() == 5 and {r.path: r.seq for r in G.extract(p).collect()} == want
    c = G.contract(p)
    assert c.nodes.count() == 1 and {r.path: r.seq for r in G.extract(c).collect()} == want
    half = G.contract(g)
    assert half.nodes.count() == 4 and {r.path: r.seq for r in G.extract(half).collect()} == want
    m = G.merge([g, g])
    assert m.nodes.count() == 12
    inverse = {r.path: r.seq for r in G.extract(G.complement(g)).collect()}
    assert inverse["p"] == want["p"][::-1].translate(str.maketrans("ACGT", "TGCA"))


def test_components_match_a_plain_search(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(300, i) for i in range(301, 500)] + [(i, i + 1) for i in range(600, 660)] + [(7, 7), (None, 3)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src int, dst int")).collect()}
    assert got == {x: root(x) for x in up}
    assert connected_components(spark.createDataFrame([], "src int, dst int")).count() == 0


def test_trim_overlap_leaves_disjoint_intervals(spark):
    rng = random.Random(2)
    rows = [(g, s, s + rng.randint(1, 30)) for g in range(20) for s in (rng.randrange(100) for _ in range(8))]
    out = I.trim_overlap(spark.createDataFrame(rows, "g int, s bigint, e bigint"), ["g"], "s", "e").collect()
    by = {}
    for r in out:
        assert r.s < r.e and any(x[0] == r.g and x[1] <= r.s and r.e <= x[2] for x in rows)
        by.setdefault(r.g, []).append((r.s, r.e))
    for v in by.values():
        v.sort()
        assert all(a[1] <= b[0] for a, b in zip(v, v[1:]))
    two = I.trim_overlap(spark.createDataFrame([(0, 0, 10), (0, 6, 20)], "g int, s bigint, e bigint"), ["g"], "s", "e").collect()
    assert sorted((r.s, r.e) for r in two) == [(0, 6), (10, 20)]


def test_glocal_chain_follows_an_inversion(spark):
    rows = [("x", 0, 100, 0, 100, 0, 100), ("x", 100, 200, 100, 200, 1, 100), ("x", 200, 300, 200, 300, 0, 100), ("x", 150, 160, 500, 510, 0, 10)]
    got = C.glocal_chains(spark.createDataFrame(rows, "k string, s1 bigint, e1 bigint, s2 bigint, e2 bigint, orient int, score bigint"), "k").orderBy("step").collect()
    assert [r.s1 for r in got] == [0, 100, 200] and got[0].chain_score == 600 - 2 * 6


def test_alignment_of_alleles():
    rows, conf = msa.align(["ACGTACGT", "ACGACGT", "ACGTACGT"])
    assert {len(r) for r in rows} == {8} and [r.replace("-", "") for r in rows] == ["ACGTACGT", "ACGACGT", "ACGTACGT"]
    assert rows[1].count("-") == 1 and rows[1][3] == "-" and len(conf) == 8 and min(conf) >= 0 and max(conf) <= 100
    assert msa.align(["A"]) == (["A"], [0])


def test_best_blocks_are_those_of_all_chains():
    rng = random.Random(5)
    for _ in range(300):
        rows = sorted(random_blocks(rng, rng.randint(0, 8)))
        costs = {"gap_open": rng.choice([0, 1, 7]), "rearrangement": rng.choice([5, 10_000])}
        follows = lambda p, c: p[0] != c[0] and p[1] < c[1] and not (p[2] <= c[2] and p[3] >= c[3])
        best = 0.0
        for m in range(1, 1 << len(rows)):
            own = [r for i, r in enumerate(rows) if m >> i & 1]
            if all(follows(a, b) for a, b in zip(own, own[1:])):
                best = max(best, sum(2 * r[5] for r in own) - sum(C.link_cost(a, b, **costs) for a, b in zip(own, own[1:])))
        path, top = C.best_blocks(rows, **costs)
        own = [rows[i] for i in path]
        assert top == best == sum(2 * r[5] for r in own) - sum(C.link_cost(a, b, **costs) for a, b in zip(own, own[1:]))
        assert all(follows(a, b) for a, b in zip(own, own[1:]))


def region(nexts, source, sink):
    """Nodes between source and sink if they are all that is between them, from either side, else None."""
    into = {n: [m for m in nexts if n in nexts[m]] for n in nexts}

    def reach(start, stop, ways):
        seen, todo = set(), [start]
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo.extend([] if n == stop else ways[n])
        return seen

    there, back = reach(source, sink, nexts), reach(sink, source, into)
    inside = there - {source, sink}
    acyclic = all(n not in reach_many(nexts, n, there) for n in there)
    return inside if there == back and sink in there and acyclic else None


def reach_many(nexts, start, inside):
    seen, todo = set(), [m for m in nexts[start] if m in inside]
    while todo:
        n = todo.pop()
        if n not in seen:
            seen.add(n)
            todo.extend(m for m in nexts[n] if m in inside)
    return seen


@pytest.mark.parametrize("cycles", [False, True])
def test_superbubbles_are_all_minimal_regions(cycles):
    rng, total = random.Random(6), 0
    for _ in range(1500):
        n = rng.randint(2, 8)
        ids = rng.sample(range(100), n)
        nexts = {i: [] for i in ids}
        share = rng.choice([0.15, 0.3, 0.5])
        for a in range(n):
            nexts[ids[a]] = [ids[b] for b in range(a + 1, min(n, a + 4)) if rng.random() < share]
        if cycles:
            a, b = sorted(rng.sample(range(n), 2))
            nexts[ids[b]].append(ids[a])
        every = {(s, t): region(nexts, s, t) for s in ids for t in ids if s != t}
        every = {k: v for k, v in every.items() if v is not None}
        least = [(s, t, sorted(v)) for (s, t), v in every.items() if v and not any((s, x) in every for x in v)]
        assert B.find_superbubbles(nexts) == sorted(least)
        total += len(least)
    assert total > 50  # not void


def test_superbubbles_of_a_long_component():
    n = 60_000
    nexts = {i: [i + 1, i + 2] if i % 3 == 0 else [i - i % 3 + 3] for i in range(n)} | {n: []}
    assert len(B.find_superbubbles(nexts)) == n // 3


def brute_posterior(a, b):
    """Every alignment with its probability: pairs and gaps, where a gap follows a pair or goes on, no two gaps meet, and a pair stands at either end."""
    n, m = len(a), len(b)
    sums, total = {}, 0.0

    def walk(i, j, state, p, pairs):
        nonlocal total
        if i == n and j == m:
            p *= 1 - 2 * msa.OPEN if state == 0 else 1 - msa.EXTEND
            total += p
            for x in pairs:
                sums[x] = sums.get(x, 0.0) + p
            return
        if i < n and j < m:
            move = 1 - 2 * msa.OPEN if state == 0 else 1 - msa.EXTEND
            emit = msa.SAME / 4 if a[i] == b[j] else (1 - msa.SAME) / 12
            walk(i + 1, j + 1, 0, p * move * emit, [*pairs, (i, j)])
        for s, (x, y) in ((1, (1, 0)), (2, (0, 1))):
            if i + x <= n and j + y <= m and state in (0, s):
                walk(i + x, j + y, s, p * (msa.OPEN if state == 0 else msa.EXTEND) / 4, pairs)

    walk(0, 0, 0, 1.0, [])
    return {x: p / total for x, p in sums.items()}


def test_posteriors_match_all_alignments():
    rng = random.Random(7)
    for _ in range(30):
        a, b = ("".join(rng.choices("ACGT", k=rng.randint(1, 5))) for _ in range(2))
        want, got = brute_posterior(a, b), msa.posterior(a, b)
        for i in range(len(a)):
            for j in range(len(b)):
                p = want.get((i, j), 0.0)
                assert got[i, j] == pytest.approx(p if p >= 0.01 else 0.0, abs=1e-9) or abs(p - 0.01) < 1e-9


def test_posteriors_pass_long_gaps():
    rng = random.Random(8)
    a = "".join(rng.choices("ACGT", k=1500))
    p = msa.posterior(a, a[:200] + a[1300:])
    # cheap extension leaves the gap's borders open for some 50 letters; further out pairs are certain
    assert p[:100, :100].diagonal().min() > 0.9 and p[1400:, 300:].diagonal().min() > 0.9
    assert msa.posterior("", "ACGT").shape == (0, 4)


@pytest.mark.parametrize("settings", [{}, {"refinements": 0}, {"gaps": False}, {"consistency": 0}])
def test_alignments_keep_their_sequences(settings):
    rng = random.Random(9)
    base = "".join(rng.choices("ACGT", k=60))
    seqs = ["".join(c for c in base if rng.random() > 0.1) for _ in range(5)] + [""]
    rows, conf = msa.align(seqs, **settings)
    assert [r.replace("-", "") for r in rows] == seqs and {len(r) for r in rows} == {len(conf)}
    assert all(set(c) != {"-"} for c in zip(*rows)) and msa.align(seqs, **settings) == (rows, conf)
    assert sum(len(set(c) - {"-"}) == 1 for c in zip(*rows)) > 45  # of 59 or 60 columns
    assert msa.align([]) == ([], [])


def test_columns_of_low_confidence_share_no_node(spark):
    rows = spark.createDataFrame([("b", "x", "AC-T", [90, 20, 90, 90]), ("b", "y", "ACGT", [90, 20, 90, 90])], "bubble string, path string, text string, conf array<int>")
    got = {(r.paths, r.start, r.seq) for r in msa.columns_to_nodes(rows, "bubble", "path", "text", "conf", 50).collect()}
    assert got == {("x,y", 0, "A"), ("x", 1, "C"), ("y", 1, "CG"), ("x,y", 3, "T")}
    plain = {(r.paths, r.start, r.seq) for r in msa.columns_to_nodes(rows, "bubble", "path", "text").collect()}
    assert plain == {("x,y", 0, "AC"), ("y", 2, "G"), ("x,y", 3, "T")}


def test_refine_takes_limits_and_an_aligner(spark):
    from strandline.operators import transforms as X

    nodes = spark.createDataFrame([(1, "ACGT"), (2, "AAC"), (3, "AAGC"), (4, "GGTT")], "node_id bigint, seq string")
    steps = spark.createDataFrame([(p, i, n, "+") for p, own in (("p", (1, 2, 4)), ("q", (1, 3, 4))) for i, n in enumerate(own)], "path string, step int, node_id bigint, orient string")
    g = G.Graph(nodes, steps)
    size = lambda h: h.nodes.agg(F.sum(F.length("seq"))).first()[0]
    assert size(X.refine(g)) == 8 + 4
    for limits in ({"min_length": 4}, {"max_length": 3}, {"min_difference": 2}, {"max_difference": 0}, {"min_total": 8}, {"max_total": 6}):
        assert size(X.refine(g, **limits)) == 8 + 7
    assert size(X.refine(g, max_length=None, min_conf=101)) == 8 + 7

    def right(seqs):
        n = max(map(len, seqs))
        return [s.rjust(n, "-") for s in seqs], [100] * n

    h = X.refine(g, aligner=right)
    assert size(h) == 8 + 5 and {r.path: r.seq for r in G.extract(h).collect()} == {"p": "ACGTAACGGTT", "q": "ACGTAAGCGGTT"}


def test_layout_finds_order_strand_and_gaps(spark):
    rng = random.Random(3)
    ref = "".join(rng.choices("ACGT", k=600))
    rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    contigs = [("b", rc(ref[220:400])), ("a", ref[10:200]), ("c", ref[400:590])]
    r, c = (spark.createDataFrame(x, "name string, seq string") for x in ([("ref", ref)], contigs))
    got = L.place_contigs(r, c, k=20).orderBy("s1").collect()
    assert [(x.ctg, x.orient, x.s1, x.e1) for x in got] == [("a", 0, 10, 200), ("b", 1, 220, 400), ("c", 0, 400, 590)]
    assert L.finish(r, c, k=20).first().seq == ref[10:200] + "N" * 20 + ref[220:400] + "N" + ref[400:590]


def layered_graph(spark, seed, paths=4, layers=9):
    rng = random.Random(seed)
    seqs, steps = {}, []
    for p in range(paths):
        step = 0
        for layer in range(layers):
            if layer % 2 == 0:
                node = layer * 10
            else:
                node = layer * 10 + rng.randrange(4)
                if node % 10 == 3:
                    continue
            seqs.setdefault(node, "".join(rng.choices("ACGT", k=rng.randint(5, 9) if layer % 2 == 0 else rng.randint(1, 6))))
            steps.append((f"p{p}", step, node, "+"))
            step += 1
    return G.Graph(spark.createDataFrame(list(seqs.items()), "node_id bigint, seq string"), spark.createDataFrame(steps, "path string, step int, node_id bigint, orient string"))


@pytest.mark.parametrize("seed", [1, 2])
def test_rewrites_keep_every_path(spark, seed):
    from strandline.operators import transforms as X

    g = layered_graph(spark, seed)
    want = {r.path: r.seq for r in G.extract(g).collect()}
    for h in (X.unzip(g, 2), X.refine(g), G.contract(g), G.prune(g)):
        assert {r.path: r.seq for r in G.extract(h).collect()} == want
    moved = X.unzip(g, 2)
    assert moved.nodes.agg(F.sum(F.length("seq"))).first()[0] != g.nodes.agg(F.sum(F.length("seq"))).first()[0]
    k = 4
    nodes, edges = X.chop(g, k)
    held = [r.seq[i : i + k] for r in nodes.collect() for i in range(len(r.seq) - k + 1)]
    assert len(held) == len(set(held)) and set(held) == {s[i : i + k] for s in want.values() for i in range(len(s) - k + 1)}
    seq = {r.node_id: r.seq for r in nodes.collect()}
    assert all(seq[e.src][-(k - 1) :] == seq[e.dst][: k - 1] and e.cigar == "3M" for e in edges.collect())
    at = {r.node_id: r.layer_offset for r in X.layers(g).collect()}
    size = {r.node_id: len(r.seq) for r in g.nodes.collect()}
    for e in g.edges().collect():
        assert at[e.dst] >= at[e.src] + size[e.src]


def test_recursive_alignment_of_simulated_genomes(spark):
    from strandline.operators import simulate, transforms as X

    seqs, truth = simulate.genomes(spark, 3, 600, 0.03, seed=2)
    g = X.recursive_align(seqs, k=12)
    assert {r.path: r.seq for r in G.extract(g).collect()} == {r.path: r.seq for r in seqs.collect()}
    r = simulate.accuracy(simulate.aligned_columns(g), truth).first()
    assert r.precision > 0.98 and r.sensitivity > 0.6
    assert g.nodes.count() > 3


def test_runs_and_dots(spark):
    from strandline.operators import transforms as X

    df = spark.createDataFrame([("a", "NNACNNNGN")], "k string, t string")
    assert sorted((r.start, r.end) for r in X.letter_runs(df, "k", "t", "N", 2).collect()) == [(0, 2), (4, 7)]
    dots = X.dotplot_points(spark.createDataFrame([(1, 5, 3, 0), (1, 5, 3, 1)], "s1 int, s2 int, length int, orient int")).collect()
    assert [tuple(r) for r in dots] == [(1, 5, 4, 8), (1, 8, 4, 5)]


def test_conversions(spark, tiny, tmp_path):
    from strandline.sources import convert as V

    S.gfa_lines(tiny).coalesce(1).write.text(str(tmp_path / "g"))
    maf = V.convert(spark, str(tmp_path / "g"), "gfa", "maf")
    maf.coalesce(1).write.text(str(tmp_path / "m"))
    back = V.READERS["maf"](spark, str(tmp_path / "m"))
    assert {r.path: r.seq for r in G.extract(back).collect()} == {"ref": "ACGTNGGTT", "alt": "ACGTNGGTT"}
    assert any("node [" in r.line for r in V.convert(spark, str(tmp_path / "g"), "gfa", "gml").collect())
    (tmp_path / "a.fa").write_text(">x\nAC-G\n>y\nACTG\n")
    lines = [r.line for r in V.convert(spark, str(tmp_path / "a.fa"), "aligned", "gfa").collect()]
    assert sum(x.startswith("S") for x in lines) == 3 and sum(x.startswith("P") for x in lines) == 2
    assert sum(x.line.startswith("S") for x in V.convert(spark, str(tmp_path / "a.fa"), "fasta", "gfa").collect()) == 2
    plan = V.alignment_plan("r", ["a", "b", "c"], 2, True)
    assert [s for s, _ in plan] == ["place_contigs"] * 3 + ["recursive_align"] * 2 + ["unzip", "refine", "variants"]


def graph_of(spark, nodes, paths):
    steps = [(p, i, n, o) for p, own in paths.items() for i, (n, o) in enumerate(own)]
    return G.Graph(spark.createDataFrame(list(nodes.items()), "node_id bigint, seq string"), spark.createDataFrame(steps, "path string, step int, node_id bigint, orient string"))


def texts(g):
    return {r.path: r.seq for r in G.extract(g).collect()}


@pytest.mark.parametrize("seed", range(4))
def test_contract_keeps_repeats_reverse_steps_and_ids_below_zero(spark, seed):
    rng = random.Random(seed)
    n = rng.randint(3, 7)
    chain = [i - 5 * (seed % 2) for i in range(n)]
    nodes = {i: "".join(rng.choices("ACGT", k=rng.randint(1, 4))) for i in [*chain, 100, 101]}
    paths = {}
    for p in "abc":
        own = []
        for _ in range(rng.randint(1, 4)):
            part = [(x, "+") for x in (chain if seed < 3 else chain[rng.randrange(n - 1) :])]
            own += ([(x, "-") for x, _ in part[::-1]] if rng.random() < 0.4 else part) + ([(rng.choice([100, 101]), "+")] if rng.random() < 0.5 else [])
        paths[p] = own
    g = graph_of(spark, nodes, paths)
    c = G.contract(g)
    assert texts(c) == texts(g)
    if seed < 3:
        assert c.nodes.where(f"node_id = {min(chain)}").first().seq == "".join(nodes[i] for i in chain) and c.nodes.count() == 3
    assert G.unary_links(c.steps).count() == 0
    tandem = graph_of(spark, {1: "AC", 2: "GT"}, {"p": [(1, "+"), (2, "+")] * 3})
    assert texts(G.contract(tandem)) == {"p": "ACGTACGTACGT"} and G.contract(tandem).nodes.count() == 1


def test_prune_merges_siblings_whatever_follows(spark):
    nodes = {1: "A", 2: "C", 3: "C", 4: "G", 5: "T", 6: "C", 7: "C", 8: "A"}
    g = graph_of(spark, nodes, {"p": [(1, "+"), (2, "+"), (4, "+")], "q": [(1, "+"), (3, "+"), (5, "+")], "r": [(5, "+"), (6, "+"), (8, "+")], "s": [(4, "+"), (7, "+"), (8, "+")]})
    p = G.prune(g)
    assert texts(p) == texts(g) and {r.node_id for r in p.nodes.collect()} == {1, 2, 4, 5, 6, 8}
    shared = graph_of(spark, {1: "A", 2: "C", 3: "C", 4: "G"}, {"p": [(1, "+"), (2, "+")], "q": [(1, "+"), (3, "+")], "r": [(4, "+"), (3, "+")]})
    assert G.prune(shared).nodes.count() == 4  # something else leads to one of them


def test_chop_keeps_edges_of_runs_and_repeats(spark):
    from strandline.operators import transforms as X

    for text in ("GAAAAAAT", "ACACACAC", "ACGTACGTTT"):
        nodes, edges = X.chop(graph_of(spark, {1: text}, {"p": [(1, "+")]}), 3)
        seq = {r.node_id: r.seq for r in nodes.collect()}
        pairs = {(seq[e.src][-3:], seq[e.dst][:3]) for e in edges.collect()}
        inner = {(s[i : i + 3], s[i + 1 : i + 4]) for s in seq.values() for i in range(len(s) - 3)}
        assert pairs | inner == {(text[i : i + 3], text[i + 1 : i + 4]) for i in range(len(text) - 3)}


def test_matches_stop_at_given_letters(spark):
    a, b = "ACGTNNNNACGTAC", "TTACGTNNNNACGTACGG"
    ref, qry = spark.createDataFrame([(0, a)], "r int, a string"), spark.createDataFrame([(0, b)], "q int, b string")
    found = lambda stop: {(m.r_start, m.q_start, m.length) for m in M.mems(M.seeds(ref, qry, "r", "q", "a", "b", 4, stop), "r", "q", 4).collect()}
    assert (0, 2, 14) in found("") and all("N" not in a[i : i + n] for i, _, n in found("N")) and (8, 10, 6) in found("N")


@pytest.mark.parametrize("sent", [0, 10**6])
def test_seeds_by_hash_equal_plain_ones(spark, sent, monkeypatch):
    monkeypatch.setattr(M, "SENT_KMERS", sent)
    monkeypatch.setattr(M, "POSITIONS", 16)
    rng = random.Random(sent)
    docs = ["".join(rng.choices("abé漢", k=rng.randint(0, 60))) for _ in range(12)] + [None]
    df = spark.createDataFrame(list(enumerate(docs)), "d int, t string")
    got = sorted(map(tuple, M.seeds(df.where("d < 4").withColumnRenamed("d", "r"), df, "r", "d", "t", "t", 3).collect()))
    want = sorted((r, i, d, j) for r in range(4) for d, t in enumerate(docs) if t for i in range(len(docs[r]) - 2) for j in range(len(t) - 2) if docs[r][i : i + 3] == t[j : j + 3])
    assert got == want
    counts = sorted(r.n for r in M.kmer_counts(df, "t", 3).collect())
    plain = {}
    for t in docs:
        for i in range(len(t or "") - 2):
            plain[t[i : i + 3]] = plain.get(t[i : i + 3], 0) + 1
    assert counts == sorted(plain.values())


def test_multi_mems_and_their_combinations(spark):
    df = spark.createDataFrame([(0, 0, "ACGTTACGA"), (1, 1, "GACGT"), (2, 2, "CCACGC")], "s int, k int, t string")
    got = {r.string: [(o.s, o.pos) for o in r.occurrences] for r in M.multi_mems(df, "s", "k", "t", 3).collect()}
    assert got["ACG"] == [(0, 0), (0, 5), (1, 1), (2, 2)] and "ACGT" in got
    sets = M.combinations(M.multi_mems(df, "s", "k", "t", 3).where("string = 'ACG'"), "s").collect()
    assert sorted([[p.pos for p in r.places] for r in sets]) == [[0, 1, 2], [5, 1, 2]]


def random_blocks(rng, n):
    out = []
    for _ in range(n):
        size, s1, s2 = rng.randint(1, 30), rng.randint(0, 60), rng.randint(0, 60)
        out.append((s1, s1 + size, s2, s2 + size, rng.randint(0, 1), size))
    return out


def test_blocks_without_overlaps():
    rng = random.Random(1)
    for _ in range(300):
        own = random_blocks(rng, rng.randint(1, 9))
        for greedy in (False, True):
            out = A.without_overlaps(own, greedy)
            x = sorted((b[2], b[3]) for b in out)
            assert out and all(a[1] <= b[0] for a, b in zip(x, x[1:])) and all(b[1] - b[0] == b[3] - b[2] == b[5] > 0 for b in out)
            assert all(any(c[0] <= b[0] and b[1] <= c[1] and c[2] <= b[2] and b[3] <= c[3] for c in own) for b in out)
    two = [(0, 10, 0, 10, 0, 10), (6, 30, 16, 40, 0, 24)]
    assert A.without_overlaps(two, False) == [(0, 6, 0, 6, 0, 6), (10, 30, 20, 40, 0, 20)]
    assert A.without_overlaps(two, True) == [(0, 6, 0, 6, 0, 6), (6, 30, 16, 40, 0, 24)]
    assert A.without_overlaps([(0, 10, 0, 10, 1, 10), (6, 30, 16, 40, 1, 24)], False) == [(0, 6, 4, 10, 1, 6), (10, 30, 16, 36, 1, 20)]


def test_selected_chains_and_best_paths_match_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        own = random_blocks(rng, rng.randint(1, 7))
        picked = A.selected_chains([(rng.choice("xy"), *b) for b in own], 0)
        x = sorted((c[3], c[4]) for c in picked)
        assert picked and all(a[1] <= b[0] for a, b in zip(x, x[1:]))
        chains = [(b[0], b[1], rng.randint(1, 20)) for b in own]
        best = 0
        for m in range(1, 1 << len(chains)):
            s = sorted((*chains[i][:2], i) for i in range(len(chains)) if m >> i & 1)
            if all(a[1] < b[1] for a, b in zip(s, s[1:])):
                best = max(best, sum(chains[i][2] for *_, i in s) - sum(max(a[1] - b[0], 0) for a, b in zip(s, s[1:])))
        path = A.best_path(chains)
        assert sum(chains[i][2] for i in path) - sum(max(chains[a][1] - chains[b][0], 0) for a, b in zip(path, path[1:])) == best
        total = lambda r: sum(2 * b[5] for b in r) - sum(C.link_cost(a, b) for a, b in zip(r, r[1:]))
        assert total(A.best_subchain(own, 2.0)) >= total(sorted(own))
    anchors = [(rng.randint(0, 40), rng.randint(0, 40), rng.randint(1, 9)) for _ in range(8)]
    best = 0
    for m in range(1, 1 << 8):
        s = sorted(anchors[i] for i in range(8) if m >> i & 1)
        if all(a[0] + a[2] <= b[0] and a[1] + a[2] <= b[1] for a, b in zip(s, s[1:])):
            best = max(best, sum(x[2] for x in s) - sum(abs((b[0] - a[0]) - (b[1] - a[1])) for a, b in zip(s, s[1:])))
    assert C.best_chain(anchors)[1] == best


def test_chains_on_a_reference(spark):
    kinds = "ctg string, ref string, s1 bigint, e1 bigint, s2 bigint, e2 bigint, orient int, score bigint"
    rows = [("a", "x", 0, 100, 0, 100, 0, 100), ("a", "x", 90, 200, 90, 200, 0, 80), ("a", "y", 0, 50, 20, 70, 0, 50), ("b", "x", 300, 340, 10, 50, 1, 40)]
    lengths = spark.createDataFrame([("a", 260), ("b", 50), ("c", 9)], "ctg string, length bigint")
    kept, rest = A.chains_to_reference(spark.createDataFrame(rows, kinds), lengths, least=5)
    assert sorted((r.ctg, r.s1, r.e1, r.s2, r.e2, r.number) for r in kept.collect()) == [("a", 0, 100, 0, 100, 0), ("a", 100, 200, 100, 200, 1), ("b", 300, 340, 10, 50, 0)]
    assert sorted(map(tuple, rest.collect())) == [("a", 200, 260), ("b", 0, 10), ("c", 0, 9)]
    joined = A.join_chains(kept).collect()
    assert sorted((r.ctg, r.s1, r.e1, r.score, r.chains) for r in joined) == [("a", 0, 200, 170, 2), ("b", 300, 340, 40, 1)]
    assert [r.place for r in A.best_contig_path(kept).orderBy("s1").collect()] == [0, 1, 2]
    assert {r.name for r in A.unplaced(lengths.withColumnRenamed("ctg", "name"), kept).collect()} == {"c"}


def test_chains_grow_over_matching_flanks(spark):
    rng = random.Random(7)
    ref = "".join(rng.choices("ACGT", k=300))
    rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    contigs = [("f", ref[50:250]), ("r", rc(ref[50:250]))]
    kinds = "ref string, ctg string, s1 bigint, e1 bigint, s2 bigint, e2 bigint, orient int, score bigint"
    chains = spark.createDataFrame([("x", "f", 120, 180, 70, 130, 0, 60), ("x", "r", 120, 180, 70, 130, 1, 60)], kinds)
    out = A.extend_chains(chains, spark.createDataFrame([("x", ref)], "name string, seq string"), spark.createDataFrame(contigs, "name string, seq string"), reach=200, k=12).collect()
    assert [(r.s1, r.e1, r.s2, r.e2) for r in out] == [(50, 250, 0, 200)] * 2


def test_wiggle_of_indels_matches_brute_force(spark):
    nodes = {1: "GGCAC", 2: "AC", 3: "ACACT", 4: "ACAC"}
    g = graph_of(spark, nodes, {"p": [(1, "+"), (2, "+"), (3, "+")], "q": [(1, "+"), (3, "+")], "r": [(1, "+"), (4, "+"), (3, "+")]})
    got = B.indel_wiggle(g).first()

    def common(x, y):
        n = 0
        while n < min(len(x), len(y)) and x[n] == y[n]:
            n += 1
        return n

    assert got.right == min(common("ACACT", v + "ACACT") for v in ("AC", "ACAC")) and got.left == min(common("GGCAC"[::-1], ("GGCAC" + v)[::-1]) for v in ("AC", "ACAC"))


def test_statistics_splitting_and_complex_bubbles(spark):
    nodes = {1: "ACGT", 2: "A", 3: "C", 4: "GGTT", 5: "GTA", 6: "GGNGG", 7: "TTT", 20: "AC"}
    g = graph_of(spark, nodes, {"ref": [(n, "+") for n in (1, 2, 4, 5, 6)], "alt": [(n, "+") for n in (1, 3, 4, 6)], "c": [(n, "+") for n in (1, 3, 4, 5, 6)], "lone": [(20, "+")]})
    one = {r.component: r for r in B.component_stats(g).collect()}
    r = one[1]
    assert (r.paths, r.nodes, r.bubbles, r.simple_bubbles, r.snp_variants, r.indel_variants, r.simple_gaps) == ("alt,c,ref", 6, 2, 2, 1, 1, 1)
    assert (r.chain_nodes, r.chain_letters, r.chain_weight, r.chain_penalty, r.chain_score) == (3, 13, 39, 6.0, 33.0)
    assert one[20].bubbles == 0 and one[20].chain_nodes == 1
    counts = G.graph_counts(g, lambda p: p == "lone").first()
    assert (counts.nodes, counts.edges, counts.samples, counts.components) == (8, 7, 3, 3)  # node 7 is on no path
    names = {r.node_id: r.name for r in G.named_components(g).collect()}
    assert names[1] == "alt_c_ref" and names[20] == "lone"
    lines = S.split_lines(g, G.named_components(g)).collect()
    assert {x.line for x in lines if x.name == "lone"} == {"S\t20\tAC", "P\tlone\t20+\t*"}
    order = {r.node_id: r.layer for r in G.layers_by_rounds(g.edges(), g.nodes).collect()}
    assert order[1] == 0 and order[4] == 2 and order[5] == 3 and order[6] == 4
    assert texts(S.renumbered(g)) == texts(g) and {r.node_id for r in S.renumbered(g).nodes.collect()} == set(range(1, 9))
    with pytest.raises(ValueError):
        G.layers_by_rounds(spark.createDataFrame([(1, 2), (2, 1)], "src bigint, dst bigint"), spark.createDataFrame([(1,), (2,)], "node_id bigint"))
    assert sorted(map(tuple, G.nodes_of_path(g, [4, 5, 6]).collect())) == [("c", 2), ("ref", 2)]
    deep = graph_of(spark, {1: "A", 2: "C", 3: "G", 4: "T", 5: "AA"}, {"x": [(1, "+"), (2, "+"), (3, "+"), (5, "+")], "y": [(1, "+"), (2, "+"), (4, "+"), (3, "+"), (5, "+")], "z": [(1, "+"), (5, "+")]})
    found = {(r.source, r.sink): r.simple for r in B.complex_bubbles(deep).collect()}
    assert found.get((2, 3)) is True and found.get((1, 5)) is False
    rows = {r.source: (r.type, sorted(r.genotypes)) for r in B.variant_report(deep, bubbles=B.complex_bubbles(deep)).collect()}
    assert rows[1] == ("complex", ["-", "CG", "CTG"])


def test_gfa_records_with_names_links_and_overlaps(spark, tmp_path):
    (tmp_path / "n.gfa").write_text("H\tVN:Z:1.0\nS\ts1\tACGT\tLN:i:4\nS\ts2\tGTCC\nS\ts3\t*\nL\ts1\t+\ts2\t+\t2M\tRC:i:3\nP\tp\ts1+,s2+\t2M\n")
    t = S.gfa_tables(spark, str(tmp_path / "n.gfa"))
    assert {(r.src, r.dst, r.cigar, r.tags["RC"]) for r in t["links"].collect()} == {("s1", "s2", "2M", "3")}
    assert {r.name: r.tags.get("LN") for r in t["segments"].collect()} == {"s1": "4", "s2": None, "s3": None}
    g = S.read_gfa(spark, str(tmp_path / "n.gfa"))
    assert texts(g) == {"p": "ACGTCC"} and g.nodes.count() == 2
    (tmp_path / "m.gfa").write_text("S\t1\tAC\nS\t2\tG\nL\t1\t+\t2\t-\t*\n")
    assert S.read_gfa(spark, str(tmp_path / "m.gfa")).nodes.count() == 2
    assert sorted(r.line for r in S.node_fasta_lines(S.read_gfa(spark, str(tmp_path / "m.gfa"))).collect()) == [">1\nAC", ">2\nG"]
    assert [r.name for r in S.renamed_reads(spark.createDataFrame([("b", "AC"), ("a", "G")], "name string, seq string"), "m").collect()] == ["m/1/0_1", "m/2/0_2"]


def test_annotation_takes_the_best_row(spark):
    from strandline.operators import annotate

    variants = spark.createDataFrame([("v", 100), ("w", 100), ("u", 5000)], "name string, size bigint")
    repeats = spark.createDataFrame([("v", 9, 1, 95, 1, 300, 10, "Alu"), ("v", 2, 1, 10, 1, 5, 300, "L1")], "name string, score bigint, qbegin bigint, qend bigint, rbegin bigint, rend bigint, rleft bigint, rfamily string")
    tandems = spark.createDataFrame([("w", 5, 1, 80, 3)], "name string, score bigint, start bigint, end bigint, period_size bigint")
    got = {r.name: r["class"] for r in annotate.annotate(variants, repeats, tandems, 50, 1000).collect()}
    assert got == {"v": "mei", "w": "microsatellite"}


def test_column_score(spark):
    from strandline.operators import simulate

    truth = spark.createDataFrame([("a", 0, 1), ("b", 0, 1), ("a", 1, 2), ("b", 1, 2), ("a", 2, 3)], "path string, pos bigint, base_id bigint")
    found = spark.createDataFrame([("a", 0, 10), ("b", 0, 10), ("a", 1, 11), ("b", 1, 12), ("a", 2, 13)], "path string, pos bigint, column bigint")
    assert tuple(simulate.column_score(found, truth).first()) == (2, 1, 0.5)


def test_groups_are_aligned_apart(spark):
    from strandline.operators import transforms as X

    rows = [("1", "a", "ACGTACGGTTCA"), ("1", "b", "ACGTACGGTTCA"), ("2", "c", "ACGTACGGTTCA")]
    g = X.recursive_align(spark.createDataFrame(rows, "group string, path string, seq string"), k=6)
    nodes = {p: {r.node_id for r in g.steps.where(f"path = '{p}'").collect()} for p in "abc"}
    assert nodes["a"] == nodes["b"] and not nodes["a"] & nodes["c"] and set(texts(g).values()) == {"ACGTACGGTTCA"}


def test_a_cluster_needs_a_shared_folder(spark):
    from strandline import session

    class Elsewhere:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "yarn", "getConf": lambda self: type("D", (), {"get": staticmethod(lambda *a: None)}), "getCheckpointDir": lambda self: None})()

    with pytest.raises(RuntimeError):
        session.scratch_dir(Elsewhere())


def test_sessions_and_streams(spark, tmp_path):
    import datetime

    from strandline.streaming import events as E2

    at = lambda m: datetime.datetime(2024, 1, 1, 0, 0) + datetime.timedelta(minutes=m)
    rows = [(1, at(0), 1.0, "a"), (1, at(20), 2.0, "a"), (1, at(80), 4.0, "b"), (2, at(5), 1.0, "a")]
    df = spark.createDataFrame(rows, "user_id int, ts timestamp, value double, event_type string")
    got = sorted((r.user_id, r.n, r.total) for r in E2.sessions(df).collect())
    assert got == [(1, 1, 4.0), (1, 2, 3.0), (2, 1, 1.0)]
    df.coalesce(1).write.parquet(str(tmp_path / "ev.parquet"))
    live = spark.readStream.schema(df.schema).parquet(str(tmp_path / "ev.parquet"))
    q = E2.sessions(live).writeStream.outputMode("complete").format("memory").queryName("sess").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.user_id, r.n, r.total) for r in spark.table("sess").collect()) == got
