"""Work that grows no faster than the tables: what a step reads, passes on and repeats."""

import collections
import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandline.operators import bubbles as B
from strandline.operators import chain as C
from strandline.operators import graph as G
from strandline.operators import graph_align as GA
from strandline.operators import match as M
from strandline.operators import msa
from strandline.operators import transforms as X
from strandline.session import materialise


def _steps(spark, walks):
    return spark.createDataFrame([(p, i, n, "+") for p, own in walks.items() for i, n in enumerate(own)], "path string, step int, node_id bigint, orient string")


def test_components_are_found_among_paths(spark, monkeypatch):
    walks = {"a": list(range(10, 40)), "b": [39, 50, 51], "c": [60, 61], "d": [5, 61], "e": [70]}
    g = G.Graph(spark.createDataFrame([(n, "A") for own in walks.values() for n in set(own)] + [(99, "C"), (1, "G")], "node_id bigint, seq string").distinct(), _steps(spark, walks))
    seen, whole = [], G.connected_components
    monkeypatch.setattr(G, "connected_components", lambda e: (seen.append(e.count()), whole(e))[1])
    found = {r.node_id: r.component for r in G.components(g).collect()}
    assert found == {**{n: 10 for n in [*range(10, 40), 50, 51]}, 60: 5, 61: 5, 5: 5, 70: 70, 99: 99, 1: 1}
    assert seen == [2]  # of 36 edges
    linked = G.Graph(g.nodes, g.steps, spark.createDataFrame([(99, "+", 51, "+"), (1, "+", 99, "+")], "src bigint, ofrom string, dst bigint, oto string"))
    found = {r.node_id: r.component for r in G.components(linked).collect()}
    assert found[51] == found[99] == found[10] == found[1] == 1 and found[61] == 5 and found[70] == 70


def test_segments_take_no_round_for_each_node_of_a_stretch(spark, monkeypatch):
    walks = {"a": list(range(1, 30)), "b": [1, 29]}
    edges = G.path_edges(_steps(spark, walks))
    rounds, reach = [], GA._reach
    monkeypatch.setattr(GA, "_reach", lambda e, *a: (rounds.append(e.count()), reach(e, *a))[1])
    ends = spark.createDataFrame([(1,), (29,)], "node_id bigint")
    got = {(r.source, r.node_id, r.part) for r in GA.segments(edges, ends, ends).collect()}
    assert got == {(1, n, "trailing") for n in range(2, 29)} | {(29, n, "leading") for n in range(2, 29)}
    assert max(rounds) == 3  # of 29 edges


def test_letter_runs_are_found_without_a_shuffle(spark):
    rows = [(1, "eexeee e"), (2, None), (3, ""), (4, "xyz"), (5, "\U0001f600ee"), (6, "e" * 5)]
    df = spark.createDataFrame(rows, "id int, t string")
    found = X.letter_runs(df, "id", "t", "e", 2)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [(1, 0, 2), (1, 3, 6), (5, 1, 3), (6, 0, 5)]


def test_local_chains_search_within_reach_only(monkeypatch):
    sizes, box = [], C._Box
    monkeypatch.setattr(C, "_Box", lambda points: (sizes.append(len(points)), box(points))[1])
    rng = random.Random(3)
    rows = [(1000 * i + d, 1000 * i + d, 40) for i in range(200) for d in sorted(rng.sample(range(0, 300, 50), 2))]
    chains = C.peeled(rows, 50, 200)
    assert max(sizes, default=0) <= 2 and all(len({rows[i][0] // 1000 for i in own}) == 1 for own in chains)


def test_equal_alleles_are_aligned_once(spark):
    rows = [(b, f"{b}{i}", s) for b in range(50) for i, s in enumerate(("ACGT", "AGT"))]
    calls = spark.sparkContext.accumulator(0)

    def counted(seqs):
        calls.add(1)
        return msa.align(seqs)

    found = msa.align_alleles(spark.createDataFrame(rows, "b int, path string, seq string").coalesce(1), "b", counted).collect()
    assert len(found) == 100 and len({r.aligned for r in found}) == 2 and calls.value < 50


def test_kmer_counts_pass_on_few_bytes(spark, monkeypatch):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(300)]
    texts = [" ".join(rng.choices(words, k=400)) for _ in range(40)] + ["", None, "short", "é" * 9, "a漢字b" * 5, "\0" * 12, "\0" * 8 + "漢", "abcdefgh", "abcdefg", "h"]
    plain = lambda k, stop="": sorted(collections.Counter(t[i : i + k] for t in texts if t for i in range(len(t) - k + 1) if not set(stop) & set(t[i : i + k])).values())
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    packed = sum(len(x) for rb in M._counted(8, "")([df.toArrow().to_batches()[0]]) for x in rb.column("data").to_pylist())
    assert packed < 8 * len(plain(8))  # in rows of two hashes and a count 24 bytes each
    monkeypatch.setattr(M, "PARTS", 16)
    assert sorted(r.n for r in M.kmer_counts(df, "t", 8).collect()) == plain(8)
    for name, n in (("POSITIONS", 50), ("HELD_KMERS", 600), ("WAITING", 300)):
        monkeypatch.setattr(M, name, n)
    for k, stop in ((1, ""), (2, "a"), (8, ""), (8, "漢c"), (40, ""), (70, "j")):
        got = [rb for rb in M._counted(k, stop)([df.toArrow().to_batches()[0]])]
        rows = sorted((r["part"], r["wide"], r["n"], r["data"]) for rb in got for r in rb.to_pylist())
        merged = M._together([pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["part", "wide", "n", "data"])]) if rows else []
        assert sorted(n for rb in merged for n in rb.column("n").to_pylist()) == plain(k, stop), (k, stop)


@pytest.fixture(scope="module")
def ladder(spark):
    """Three paths through 3,000 bubbles, the third by a direct way, from files that are much smaller than their rows; the bytes of the files."""
    rows = spark.range(6001).select(F.explode(F.array(*map(F.lit, "abc"))).alias("path"), F.col("id").cast("int").alias("step"))
    rows = rows.where("path <> 'c' or step % 2 = 0").select("path", "step", F.expr("2 * step + int(path = 'b' and step % 2 = 1)").cast("bigint").alias("node_id"), F.lit("+").alias("orient"))
    own = materialise(rows.withColumn("seq", F.when(F.col("node_id") % 2 == 1, "G").otherwise("A")).coalesce(1), "ladder")
    at = own._strandline_path.removeprefix("file://")
    size = sum(os.path.getsize(f"{at}/{f}") for f in os.listdir(at) if f.endswith(".parquet"))
    assert size < 8 * own.count()
    return G.Graph(own.groupBy("node_id").agg(F.first("seq").alias("seq")), own.select("path", "step", "node_id", "orient")), size


READS = {
    "variants": (B.variants, 9000),
    "component_stats": (lambda g: B.component_stats(g, B.marked_bubbles(g)).where("simple_bubbles = 3000 and chain_nodes = 3001"), 1),
    "filtered_variants": (lambda g: B.variant_report(g, min_diff=1, kind="indel").where("calls['a'] = 0 and calls['c'] = 1"), 3000),
    "indel_wiggles": (lambda g: B.indel_wiggle(g).where("left = 0 and right = 0"), 3000),
    "variant_table": (lambda g: B.variant_report(g).where("pos_end - pos_start in (0, 1) and type = 'indel'"), 3000),
    "vcf_records": (lambda g: B.vcf_lines(B.variant_report(g), ["a", "b", "c"]).where("line like '%\\tAA\\tA,AG\\t%\\t0:2\\t2:2\\t1:1'"), 3000),
    "variant_calls": (lambda g: B.calls(B.variants(g), ["a", "b", "c"]), 3000),
}


@pytest.mark.parametrize("name", READS)
def test_no_table_of_a_graph_is_broadcast_for_its_small_files(spark, ladder, name):
    graph, size = ladder
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
    try:
        found = READS[name][0](graph)
        assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()
        assert found.count() == READS[name][1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
