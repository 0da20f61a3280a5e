"""Graph rewrites that keep every path's sequence: recursive alignment, chop, unzip, refine."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators import match, msa
from strandline.operators.bubbles import simple_bubbles
from strandline.operators.chain import best_chain
from strandline.operators.graph import Graph, contract, extract, offsets
from strandline.operators.grouped import map_groups
from strandline.operators.intervals import islands
from strandline.operators.separators import distances
from strandline.session import materialise

#: Runs of a letter in a batch, about.
RUNS = 1 << 16


def common_anchors(parts: DataFrame, k: int) -> DataFrame:
    """``gap, anchor, places``: strings of k letters or more that occur exactly once in every part of a gap.

    ``parts(gap, path, begin, text)``. Unique common k-mers whose positions
    advance together on all paths make one anchor; ``places`` holds its
    (path, begin, length) on each path.
    """
    paths = parts.groupBy("gap").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    found = match.kmers(parts.join(paths.select("gap"), "gap", "left_semi").select("gap", "path", "begin", "text"), ["gap", "path", "begin"], "text", k)
    unique = found.groupBy("gap", "kmer").agg(F.count(F.lit(1)).alias("c"), F.array_sort(F.collect_list(F.struct("path", (F.col("begin") + F.col("pos")).alias("at")))).alias("at"))
    unique = unique.join(paths, "gap").where("c = n and size(array_distinct(transform(at, x -> x.path))) = n")
    first = F.get("at", F.lit(0))["at"]
    rows = unique.select("gap", first.alias("first"), F.transform("at", lambda x: x["at"] - first).alias("shape"), "at")
    w = Window.partitionBy("gap", "shape").orderBy("first")
    runs = islands(rows, ["gap", "shape"], ["first"], F.col("first") != F.lag("first").over(w) + 1)
    return runs.groupBy("gap", "shape", "island").agg(F.min(F.struct("first", "at")).alias("m"), (F.count(F.lit(1)) + (k - 1)).alias("length")).select("gap", F.col("m.first").alias("anchor"), F.transform("m.at", lambda x: F.struct(x["path"].alias("path"), x["at"].alias("begin"))).alias("places"), "length")


def _chained(anchors: DataFrame) -> DataFrame:
    """The anchors of each gap that are on its best colinear chain."""
    kind = anchors.schema["gap"].dataType.simpleString()
    path = anchors.schema["places"].dataType.elementType["path"].dataType.simpleString()

    def fold(cols: list[list]) -> list[tuple]:
        places, lengths = cols[2], cols[3]
        rows = [(*(p["begin"] for p in own), n) for own, n in zip(places, lengths, strict=True)]
        chain, _ = best_chain(rows, len(rows[0]) - 1, penalty=0.0)
        return [(cols[0][i], cols[1][i], places[i], lengths[i]) for i in chain]

    return map_groups(anchors, ["gap"], ["anchor", "length"], fold, f"gap {kind}, anchor bigint, places array<struct<path: {path}, begin: bigint>>, length bigint")


def recursive_align(seqs: DataFrame, k: int = 20, max_size: int | None = None) -> Graph:
    """Align ``seqs(path, seq)`` into a graph by rounds of exact anchors.

    Each round takes, in all open gaps at once, the best colinear chain of
    strings that every sequence holds exactly once; what lies between becomes
    the gaps of the next round, until none has an anchor, or in no sequence more
    than ``max_size`` letters. Gaps carry their texts, so that no round reads
    whole sequences again. Anchors are shared nodes; what is left between them
    is shared where it is equal. The
    sequences of the paths come out as they went in. With a column ``group``
    only sequences of one group are aligned with each other.
    """
    group = F.col("group").cast("string") if "group" in seqs.columns else F.lit("g")
    base = materialise(seqs.select("path", F.col("seq").alias("whole"), group.alias("group")), "sequences")
    gaps = base.select(F.col("group").alias("gap"), "path", F.lit(0).cast("bigint").alias("begin"), F.length("whole").cast("bigint").alias("end"), F.col("whole").alias("text"))
    base = base.drop("group")
    nodes, closed = None, None
    while True:  # every round closes gaps or cuts them, so that it ends
        text = gaps.select("gap", "path", "begin", "text")
        if max_size is not None:
            text = text.join(gaps.groupBy("gap").agg(F.max(F.col("end") - F.col("begin")).alias("n")).where(F.col("n") > max_size).select("gap"), "gap", "left_semi")
        anchors = materialise(_chained(common_anchors(text, k)), "anchors")
        if not anchors.take(1):
            break
        placed = anchors.select("gap", "anchor", F.explode("places").alias("p"), "length").select("gap", "anchor", F.col("p.path").alias("path"), F.col("p.begin").alias("begin"), (F.col("p.begin") + F.col("length")).alias("end"))
        own = placed.select(F.concat_ws("/", "gap", F.col("anchor").cast("string")).alias("name"), "path", "begin", "end")
        nodes = own if nodes is None else nodes.unionByName(own)
        w = Window.partitionBy("gap", "path").orderBy("begin")
        edge = gaps.join(placed.select("gap").distinct(), "gap", "left_semi")
        stops = placed.select("gap", "path", "begin", "end").unionByName(edge.select("gap", "path", F.col("end").alias("begin"), F.col("end")))
        start = edge.select("gap", "path", F.col("begin").alias("__b"), F.col("text").alias("__t"))
        ranked = stops.withColumn("i", F.row_number().over(w.orderBy("begin", "end"))).withColumn("prev", F.lag("end").over(w.orderBy("begin", "end")))
        inner = ranked.join(start, ["gap", "path"]).select(F.concat_ws(".", "gap", F.col("i").cast("string")).alias("gap"), "path", F.coalesce("prev", "__b").alias("from"), F.col("begin").alias("to"), "__b", "__t")
        inner = inner.withColumn("text", F.expr("substring(__t, int(`from` - __b) + 1, int(`to` - `from`))"))
        still = gaps.join(placed.select("gap").distinct(), "gap", "left_anti")
        closed = still if closed is None else closed.unionByName(still)
        gaps = materialise(inner.where("from < to").select("gap", "path", F.col("from").alias("begin"), F.col("to").alias("end"), "text"), "gaps")
    rest = gaps if closed is None else closed.unionByName(gaps)
    rest = rest.where("begin < end").select("gap", "path", "begin", "end", F.col("text").alias("seq"))
    parts = rest.select(F.concat_ws("=", "gap", F.md5("seq")).alias("name"), "path", "begin", "seq")
    if nodes is not None:
        cut = nodes.join(base, "path").select("name", "path", "begin", F.expr("substring(whole, int(begin) + 1, int(end - begin))").alias("seq"))
        parts = parts.unionByName(cut)
    parts = materialise(parts.withColumn("node_id", F.xxhash64("name")), "parts")
    steps = parts.select("path", (F.row_number().over(Window.partitionBy("path").orderBy("begin")) - 1).alias("step"), "node_id", F.lit("+").alias("orient"))
    return Graph(parts.groupBy("node_id").agg(F.min("seq").alias("seq")), steps)


def chop(graph: Graph, k: int) -> tuple[DataFrame, DataFrame]:
    """The graph with overlaps of k - 1: nodes ``(node_id, seq)`` and edges ``(src, dst, cigar)``.

    Its nodes hold every k-mer of every path exactly once: runs of k-mers with
    one way in and one way out are one node. Paths shorter than k have none.
    """
    paths = materialise(extract(graph), "paths")
    found = match.kmers(paths, ["path"], "seq", k)
    steps = found.select("path", F.col("pos").cast("int").alias("step"), F.xxhash64("kmer").alias("node_id"), F.lit("+").alias("orient"), F.substring("kmer", -1, 1).alias("seq"))
    small = Graph(steps.groupBy("node_id").agg(F.first("seq").alias("seq")), steps.select("path", "step", "node_id", "orient"))
    merged = contract(small)
    at = offsets(merged).groupBy("node_id").agg(F.min(F.struct("path", "offset")).alias("m")).select("node_id", F.col("m.path").alias("path"), F.col("m.offset").alias("offset"))
    head = at.join(paths.withColumnRenamed("seq", "whole"), "path").select("node_id", F.expr(f"substring(whole, int(offset) + 1, {k - 1})").alias("head"))
    nodes = merged.nodes.join(head, "node_id").select("node_id", F.concat("head", "seq").alias("seq"))
    return nodes, merged.edges().select("src", "dst", F.lit(f"{k - 1}M").alias("cigar"))


def unzip(graph: Graph, least: int, min_difference: int = 0, max_difference: int | None = None) -> Graph:
    """Move up to ``least`` letters of both flanks of every simple bubble into its alleles.

    A flank keeps half of its letters at least (less two), so that bubbles
    that share a node do not meet. Bubbles where a path begins or ends at a
    flank or in an allele stay, since its sequence would change, and so do those
    whose largest and smallest allele differ by less than ``min_difference`` or
    more than ``max_difference`` letters. A direct way
    from source to sink, an allele of no letters, becomes a node of the moved
    letters.
    """
    edges = graph.edges()
    b = simple_bubbles(edges)
    if min_difference or max_difference is not None:
        direct = edges.select(F.col("src").alias("source"), F.col("dst").alias("sink")).distinct().join(b.select("source", "sink"), ["source", "sink"], "left_semi").withColumn("n", F.lit(0))
        inner = b.select("source", "sink", F.explode("inner").alias("node_id")).join(graph.nodes, "node_id").select("source", "sink", F.length("seq").alias("n"))
        size = inner.unionByName(direct).groupBy("source", "sink").agg((F.max("n") - F.min("n")).alias("difference"))
        fits = F.col("difference") >= min_difference
        fits = fits if max_difference is None else fits & (F.col("difference") <= max_difference)
        b = b.join(size.where(fits).select("source", "sink"), ["source", "sink"], "left_semi")
    ends = graph.steps.groupBy("path").agg(F.min("step").alias("lo"), F.max("step").alias("hi"))
    outer = graph.steps.join(ends, "path")
    first = outer.where("step = lo").select(F.col("node_id").alias("sink")).distinct()
    last = outer.where("step = hi").select(F.col("node_id").alias("source")).distinct()
    b = b.join(first, "sink", "left_anti").join(last, "source", "left_anti")
    halves = first.select(F.col("sink").alias("node_id")).unionByName(last.select(F.col("source").alias("node_id")))
    half = b.select("source", "sink", F.explode("inner").alias("node_id")).join(halves, "node_id", "left_semi").select("source", "sink")
    b = b.join(half, ["source", "sink"], "left_anti")
    room = lambda c: F.least(F.lit(least), F.floor(F.greatest(F.length(c) - 2, F.lit(0)) / 2)).cast("int")
    seq = graph.nodes
    b = b.join(seq.select(F.col("node_id").alias("source"), F.col("seq").alias("a")), "source").join(seq.select(F.col("node_id").alias("sink"), F.col("seq").alias("z")), "sink")
    b = materialise(b.select("source", "sink", "inner", room(F.col("a")).alias("l"), room(F.col("z")).alias("r"), F.expr("substring(a, length(a) - least(%d, int(floor(greatest(length(a) - 2, 0) / 2))) + 1)" % least).alias("ls"), F.expr("substring(z, 1, least(%d, int(floor(greatest(length(z) - 2, 0) / 2))))" % least).alias("rs")), "bubbles")
    inner = b.select(F.explode("inner").alias("node_id"), "ls", "rs")
    cut_r = b.select(F.col("source").alias("node_id"), "l")
    cut_l = b.select(F.col("sink").alias("node_id"), "r")
    nodes = seq.join(inner, "node_id", "left").join(cut_r, "node_id", "left").join(cut_l, "node_id", "left")
    text = F.concat(F.coalesce("ls", F.lit("")), "seq", F.coalesce("rs", F.lit("")))
    nodes = nodes.withColumn("seq", text).select("node_id", F.expr("substring(seq, coalesce(r, 0) + 1, length(seq) - coalesce(r, 0) - coalesce(l, 0))").alias("seq"))
    direct = b.select("source", "sink", F.shiftrightunsigned(F.xxhash64("source", "sink"), 1).alias("new"), F.concat("ls", "rs").alias("seq")).where("seq <> ''")
    w = Window.partitionBy("path").orderBy("step")
    ways = graph.steps.withColumn("next", F.lead("node_id").over(w)).join(direct.select(F.col("source").alias("node_id"), F.col("sink").alias("next"), "new"), ["node_id", "next"]).select("path", (F.col("step") + F.lit(0.5)).alias("at"), F.col("new").alias("node_id"), F.lit("+").alias("orient"))
    steps = graph.steps.select("path", F.col("step").cast("double").alias("at"), "node_id", "orient").unionByName(ways)
    used = ways.select("node_id").distinct()
    fresh = direct.select(F.col("new").alias("node_id"), "seq").join(used, "node_id", "left_semi")
    return Graph(nodes.unionByName(fresh), steps.select("path", (F.row_number().over(Window.partitionBy("path").orderBy("at")) - 1).alias("step"), "node_id", "orient"))


def refine(graph: Graph, min_alleles: int = 2, max_length: int | None = 10_000, min_length: int = 0, min_difference: int = 0, max_difference: int | None = None, min_total: int = 0, max_total: int | None = None, no_gaps: bool = False, min_conf: float = 0, aligner=msa.align) -> Graph:
    """Replace the alleles of simple bubbles by the nodes of their multiple alignment.

    Bubbles with ``min_alleles`` or more inner alleles are aligned, each as one
    group, whose smallest and largest allele, difference of the two and sum of
    lengths are within the limits (None: no limit); with ``no_gaps`` none that
    holds an N. Columns below a confidence of ``min_conf`` share no node.
    Alleles are visited by the same paths afterwards, letter by letter.
    """
    b = simple_bubbles(graph.edges()).where(F.size("inner") >= min_alleles)
    sized = b.select("source", "sink", F.explode("inner").alias("node_id")).join(graph.nodes, "node_id")
    n = F.length("seq")
    good = sized.groupBy("source", "sink").agg(F.max(n).alias("most"), F.min(n).alias("least"), F.sum(n).alias("total"), F.max(F.upper("seq").contains("N")).alias("gap"))
    good = good.withColumn("difference", F.col("most") - F.col("least"))
    for c, low, high in (("least", min_length, None), ("most", 0, max_length), ("difference", min_difference, max_difference), ("total", min_total, max_total)):
        good = good.where(F.col(c) >= low) if high is None else good.where(F.col(c).between(low, high))
    good = good.where(~F.col("gap")) if no_gaps else good
    good = good.select("source", "sink")
    alleles = materialise(sized.join(good, ["source", "sink"]).select(F.shiftrightunsigned(F.xxhash64("source", "sink"), 1).alias("bubble"), F.col("node_id").cast("string").alias("path"), "seq"), "alleles")
    aligned = materialise(msa.align_alleles(alleles, "bubble", aligner), "aligned")
    runs = msa.columns_to_nodes(aligned, "bubble", "path", "aligned", "conf", min_conf)
    runs = materialise(runs.withColumn("new", F.shiftrightunsigned(F.xxhash64("bubble", "paths", "start"), 1)), "runs")
    visits = runs.select("new", "start", F.explode(F.split("paths", ",").cast("array<bigint>")).alias("node_id"))
    gone = alleles.select(F.col("path").cast("bigint").alias("node_id")).distinct()
    old = graph.steps.join(gone, "node_id", "left_anti").select("path", "step", F.lit(0).cast("bigint").alias("start"), "node_id", "orient")
    fresh = graph.steps.join(visits, "node_id").select("path", "step", "start", F.col("new").alias("node_id"), "orient")
    steps = old.unionByName(fresh)
    nodes = graph.nodes.join(gone, "node_id", "left_anti").unionByName(runs.select(F.col("new").alias("node_id"), "seq"))
    return Graph(nodes, steps.select("path", (F.row_number().over(Window.partitionBy("path").orderBy("step", "start")) - 1).alias("step"), "node_id", "orient"))


def layers(graph: Graph) -> DataFrame:
    """``node_id, layer_offset``: the longest distance in letters from any start of an acyclic graph, as alignment columns need it."""
    return distances(graph).withColumnRenamed("distance", "layer_offset")


def dotplot_points(anchors: DataFrame) -> DataFrame:
    """Line segments of a dot plot: ``x1, y1, x2, y2`` of each anchor (s1, s2, length, orient)."""
    e1, e2 = F.col("s1") + F.col("length"), F.col("s2") + F.col("length")
    forward = F.col("orient") == 0
    return anchors.select(F.col("s1").alias("x1"), F.when(forward, F.col("s2")).otherwise(e2).alias("y1"), e1.alias("x2"), F.when(forward, e2).otherwise(F.col("s2")).alias("y2"))


def letter_runs(seqs: DataFrame, key: str, text: str, letter: str, least: int = 1) -> DataFrame:
    """``key, start, end``: runs of a letter, ``least`` times or more; found where the text lies, so that nothing is shuffled."""
    pattern = re.compile(f"{re.escape(letter)}{{{least},}}")

    def run(batches):
        for rb in batches:
            at, starts, ends = [], [], []
            for i, whole in enumerate(rb.column(1).to_pylist()):
                for m in pattern.finditer(whole or ""):
                    at.append(i)
                    starts.append(m.start())
                    ends.append(m.end())
                if len(at) >= RUNS or i + 1 == len(rb):
                    yield pa.RecordBatch.from_arrays([rb.column(0).take(pa.array(at, pa.int64())), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["key", "start", "end"])
                    at, starts, ends = [], [], []

    kind = seqs.schema[key].dataType.simpleString()
    return seqs.select(key, text).mapInArrow(run, f"key {kind}, start bigint, end bigint").withColumnRenamed("key", key)
