"""Alignment of graphs with graphs and with sequences, and what lies around anchors of a graph.

A graph is matched along its paths: every node is read on into what follows it
there, once for each different continuation, however many paths share it. A
k-mer is a place (node, offset) and the walk from it, so that matches run
through branching nodes and are mapped back to pieces of single nodes.

Places have a coordinate that grows along every path: the longest distance in
letters from any start. Anchors that follow one another in the coordinates of
both graphs can be merged without making a cycle, since a walk in either graph
only ever leads to later anchors. So aligning is chaining in two dimensions,
and the stretches between chained anchors are the next round's.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators import match
from strandline.operators.chain import best_chain
from strandline.operators.components import connected_components
from strandline.operators.graph import Graph
from strandline.operators.grouped import map_groups
from strandline.operators.intervals import asof_join, islands
from strandline.operators.transforms import layers
from strandline.session import materialise, scratch_dir

#: Beyond all coordinates.
FAR = 1 << 62


def linear(seqs: DataFrame) -> Graph:
    """``seqs(path, seq)`` as a graph of one node for each path."""
    rows = materialise(seqs.select("path", "seq").withColumn("node_id", F.monotonically_increasing_id()), "linear")
    return Graph(rows.select("node_id", "seq"), rows.select("path", F.lit(0).alias("step"), "node_id", F.lit("+").alias("orient")))


def contexts(graph: Graph, k: int) -> DataFrame:
    """``node_id, tail, n, text, follow``: every node with each different string of up to k - 1 letters that follows it on a path.

    ``follow`` has the nodes that spell the tail, and their lengths. Paths that
    walk a node backward are not read.
    """
    back = graph.steps.where("orient = '-'").select("path").distinct()
    rows = graph.steps.join(back, "path", "left_anti").join(graph.nodes, "node_id")
    w = Window.partitionBy("path").orderBy("step").rowsBetween(1, max(k - 1, 1))
    tail = F.substring(F.array_join(F.collect_list(F.substring("seq", 1, k - 1)).over(w), ""), 1, k - 1)
    follow = F.collect_list(F.struct("node_id", F.char_length("seq").alias("n"))).over(w)
    seen = rows.select("node_id", "seq", "path", "step", tail.alias("tail"), follow.alias("follow"))
    one = seen.groupBy("node_id", "tail").agg(F.min("seq").alias("seq"), F.min_by("follow", F.struct("path", "step")).alias("follow"))
    return one.select("node_id", "tail", F.char_length("seq").alias("n"), F.concat("seq", "tail").alias("text"), "follow")


def _pieces(k: int):
    """Letters that two walks have in common, node by node: (gap, a node, its offset, b node, its offset, length)."""

    def run(batches):
        for rb in batches:
            out = []
            for gap, a_pos, a_walk, b_pos, b_walk in zip(*(c.to_pylist() for c in rb.columns), strict=True):
                left, i, j, x, y = k, 0, 0, a_pos, b_pos
                while left and i < len(a_walk) and j < len(b_walk):
                    n = min(left, a_walk[i]["n"] - x, b_walk[j]["n"] - y)
                    if n:
                        out.append((gap, a_walk[i]["node_id"], x, b_walk[j]["node_id"], y, n))
                    left, x, y = left - n, x + n, y + n
                    if x == a_walk[i]["n"]:
                        i, x = i + 1, 0
                    if y == b_walk[j]["n"]:
                        j, y = j + 1, 0
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(kinds)], ["gap", "a", "a_at", "b", "b_at", "length"])

    return run


def _anchors(occ: DataFrame, ctx: DataFrame, where: DataFrame, gaps: DataFrame, k: int) -> DataFrame:
    """Runs of letters on one node of each graph that k-mers found once in both graphs' part of a gap cover: with coordinates, cut to the gap."""
    own = F.struct("node_id", "pos", "n", "tail")
    side = lambda x: F.when(F.col("side") == x, own)
    once = occ.groupBy("gap", "h1", "h2").agg(F.count(side(0)).alias("na"), F.count(side(1)).alias("nb"), F.max(side(0)).alias("x"), F.max(side(1)).alias("y")).where("na = 1 and nb = 1")
    once = materialise(once.select("gap", "x", "y"), "once")
    inside = (F.col("x.pos") + k <= F.col("x.n")) & (F.col("y.pos") + k <= F.col("y.n"))
    plain = once.where(inside).select("gap", F.col("x.node_id").alias("a"), F.col("x.pos").alias("a_at"), F.col("y.node_id").alias("b"), F.col("y.pos").alias("b_at"), F.lit(k).cast("bigint").alias("length"))
    walk = ctx.select("node_id", "tail", F.concat(F.array(F.struct("node_id", "n")), "follow").alias("walk"))
    named = lambda c: walk.select(F.col("node_id").alias(f"{c}_node"), F.col("tail").alias(f"{c}_tail"), F.col("walk").alias(f"{c}_walk"))
    over = once.where(~inside).select("gap", *[F.col(f"{c}.{f}").alias(f"{c}_{g}") for c in "xy" for f, g in (("node_id", "node"), ("tail", "tail"), ("pos", "pos"))])
    over = over.join(named("x"), ["x_node", "x_tail"]).join(named("y"), ["y_node", "y_tail"]).select("gap", "x_pos", "x_walk", "y_pos", "y_walk")
    crossing = over.mapInArrow(_pieces(k), "gap string, a bigint, a_at bigint, b bigint, b_at bigint, length bigint")
    rows = plain.unionByName(crossing).withColumn("diag", F.col("a_at") - F.col("b_at")).withColumn("end", F.col("a_at") + F.col("length"))
    keys = ["gap", "a", "b", "diag"]
    before = Window.partitionBy(*keys).orderBy("a_at", "end").rowsBetween(Window.unboundedPreceding, -1)
    runs = islands(rows, keys, ["a_at", "end"], F.col("a_at") > F.max("end").over(before))
    one = runs.groupBy(*keys, "island").agg(F.min("a_at").alias("a_at"), F.max("end").alias("end")).select("gap", "a", "a_at", "b", (F.col("a_at") - F.col("diag")).alias("b_at"), (F.col("end") - F.col("a_at")).alias("length"))
    at = lambda c: where.select(F.col("node_id").alias(c), F.col("layer_offset").alias(f"{c}_layer"))
    placed = one.join(at("a"), "a").join(at("b"), "b").join(gaps, "gap").withColumn("x", F.col("a_layer") + F.col("a_at")).withColumn("y", F.col("b_layer") + F.col("b_at"))
    first = F.greatest(F.lit(0), F.col("a_lo") - F.col("x"), F.col("b_lo") - F.col("y"))
    last = F.least("length", F.col("a_hi") - F.col("x"), F.col("b_hi") - F.col("y"))
    cut = placed.withColumn("first", first).withColumn("last", last).where("first < last")
    return cut.select("gap", "a", (F.col("a_at") + F.col("first")).alias("a_at"), "b", (F.col("b_at") + F.col("first")).alias("b_at"), (F.col("x") + F.col("first")).alias("x"), (F.col("y") + F.col("first")).alias("y"), (F.col("last") - F.col("first")).alias("length"))


def _chained(anchors: DataFrame) -> DataFrame:
    """The anchors on the heaviest chain of each gap, in both coordinates."""

    def fold(cols: list[list]) -> list[tuple]:
        rows = list(zip(*cols, strict=True))
        path, _ = best_chain([(r[5], r[6], r[7]) for r in rows], penalty=0.0)
        return [rows[i] for i in path]

    return map_groups(anchors, ["gap"], ["x", "y", "a", "b"], fold, "gap string, a bigint, a_at bigint, b bigint, b_at bigint, x bigint, y bigint, length bigint")


def _between(chained: DataFrame, gaps: DataFrame, k: int) -> DataFrame:
    """``old, gap, a_lo, a_hi, b_lo, b_hi``: stretches between chained anchors that can hold a k-mer on both sides."""
    ends = gaps.join(chained.select("gap").distinct(), "gap", "left_semi").select("gap", F.col("a_hi").alias("x"), F.col("b_hi").alias("y"), F.lit(0).cast("bigint").alias("length"), F.lit(1).alias("final"))
    stops = chained.select("gap", "x", "y", "length", F.lit(0).alias("final")).unionByName(ends)
    w = Window.partitionBy("gap").orderBy("final", "x")
    prev = F.lag(F.struct((F.col("x") + F.col("length")).alias("x"), (F.col("y") + F.col("length")).alias("y"))).over(w)
    rows = stops.withColumn("i", F.row_number().over(w)).withColumn("prev", prev).join(gaps, "gap")
    out = rows.select(F.col("gap").alias("old"), F.concat_ws(".", "gap", F.col("i").cast("string")).alias("gap"), F.coalesce("prev.x", "a_lo").alias("a_lo"), F.col("x").alias("a_hi"), F.coalesce("prev.y", "b_lo").alias("b_lo"), F.col("y").alias("b_hi"))
    return out.where((F.col("a_hi") - F.col("a_lo") >= k) & (F.col("b_hi") - F.col("b_lo") >= k))


def align_graphs(a: Graph, b: Graph, k: int = 20, groups: DataFrame | None = None) -> Graph:
    """Two acyclic graphs as one, in which letters of ``a`` and ``b`` that are anchored to each other are one node.

    Rounds of anchors: strings of k letters on walks of both graphs, found once
    in each graph's part of a gap, chained in the coordinates of both. Every
    path of both graphs keeps its sequence, nodes that a graph shares stay
    shared, and the result has no cycle. A sequence is the graph of one node
    that :func:`linear` makes. With ``groups(path, group)`` only nodes of one
    group are aligned, all groups at once. Paths that walk a node backward are
    carried along and not matched. Path names of the two must differ. The
    anchors of a gap are one chain, so that a component's first round is one
    task's; everything else is joins and windows.
    """
    sided = lambda df, s, *cols: df.select(*cols, F.col("node_id").alias("was"), F.lit(s).alias("side"))
    nodes = sided(a.nodes, 0, "seq").unionByName(sided(b.nodes, 1, "seq"))
    steps = sided(a.steps, 0, "path", "step", "orient").unionByName(sided(b.steps, 1, "path", "step", "orient"))
    nodes = materialise(nodes.withColumn("node_id", F.monotonically_increasing_id()), "nodes")  # ids of both may be the same, or hashes
    steps = steps.join(nodes.drop("seq"), ["side", "was"]).select("path", "step", "node_id", "orient")
    nodes, steps = nodes.drop("was"), materialise(steps, "steps")
    both = Graph(nodes.select("node_id", "seq"), steps)
    where = materialise(layers(both), "layers")
    ctx = materialise(contexts(both, k), "contexts")
    found = match.hashed_kmers(ctx.select(F.struct("node_id", "tail", "n").alias("key"), "text"), "key", "text", k)
    occ = found.select("key.node_id", "pos", "h1", "h2", "key.tail", "key.n").groupBy("node_id", "pos", "h1", "h2", "n").agg(F.min("tail").alias("tail"))
    if groups is None:
        label = nodes.select("node_id", "side", F.lit("g").alias("gap"))
    else:
        of = steps.join(groups, "path").select("node_id", F.col("group").cast("string").alias("gap")).distinct()
        label = nodes.select("node_id", "side").join(of, "node_id")
    occ = materialise(occ.join(label, "node_id").join(where, "node_id").withColumn("at", F.col("layer_offset") + F.col("pos")).drop("layer_offset"), "kmers")
    gaps = materialise(occ.select("gap").distinct().select("gap", F.lit(-1).cast("bigint").alias("a_lo"), F.lit(FAR).cast("bigint").alias("a_hi"), F.lit(-1).cast("bigint").alias("b_lo"), F.lit(FAR).cast("bigint").alias("b_hi")), "gaps")
    kept = None
    while True:  # every round shortens the gaps that it cuts, and leaves others out
        chained = materialise(_chained(_anchors(occ, ctx, where, gaps, k)), "chained")
        if not chained.take(1):
            break
        kept = chained if kept is None else kept.unionByName(chained)
        inner = materialise(_between(chained, gaps, k), "gaps")
        bounds = [inner.select(F.col("old").alias("gap"), F.lit(s).alias("side"), F.col(f"{c}_lo").alias("lo"), F.col(f"{c}_hi").alias("hi"), F.col("gap").alias("inner")) for s, c in ((0, "a"), (1, "b"))]
        occ = materialise(asof_join(occ, bounds[0].unionByName(bounds[1]), "at", "lo", ["gap", "side"]).where("at < hi").drop("gap", "lo", "hi").withColumnRenamed("inner", "gap"), "kmers")
        gaps = inner.drop("old")
    return merged(Graph(nodes.select("node_id", "seq"), steps), kept)


def merged(graph: Graph, anchors: DataFrame | None) -> Graph:
    """Nodes cut at the ends of anchors ``(a, a_at, b, b_at, length)``, of which both sides become one node."""
    if anchors is None:
        return graph
    anchors = materialise(anchors.select("a", "a_at", "b", "b_at", "length"), "anchors")
    size = graph.nodes.select("node_id", F.char_length("seq").cast("bigint").alias("n"))
    cuts = graph.nodes.select("node_id", F.lit(0).cast("bigint").alias("from"))
    for c in "ab":
        for at in (F.col(f"{c}_at"), F.col(f"{c}_at") + F.col("length")):
            cuts = cuts.unionByName(anchors.select(F.col(c).alias("node_id"), at.alias("from")))
    cuts = cuts.distinct().join(size, "node_id").where("`from` < n or n = 0")
    w = Window.partitionBy("node_id").orderBy("from")
    parts = cuts.withColumn("to", F.coalesce(F.lead("from").over(w), "n"))
    onto = anchors.select(F.col("b").alias("node_id"), F.col("b_at").alias("from"), F.col("a").alias("top"), F.col("a_at").alias("top_from"))
    parts = parts.join(onto, ["node_id", "from"], "left").withColumn("top", F.coalesce("top", "node_id")).withColumn("top_from", F.coalesce("top_from", "from"))
    parts = materialise(parts.select("node_id", "from", "to", "top", "top_from"), "parts")
    own = parts.where("top = node_id and top_from = `from`").select(F.col("top"), F.col("top_from"), F.col("to"))
    named = materialise(own.withColumn("new", F.monotonically_increasing_id()), "named")
    text = F.expr("substring(seq, int(top_from) + 1, int(`to` - top_from))")
    nodes = named.join(graph.nodes.withColumnRenamed("node_id", "top"), "top").select(F.col("new").alias("node_id"), text.alias("seq"))
    ids = materialise(parts.join(named.drop("to"), ["top", "top_from"]).select("node_id", "from", "new"), "ids")
    walked = graph.steps.join(ids, "node_id").withColumn("inner", F.when(F.col("orient") == "-", -F.col("from")).otherwise(F.col("from")))
    order = Window.partitionBy("path").orderBy("step", "inner")
    return Graph(nodes, walked.select("path", (F.row_number().over(order) - 1).alias("step"), F.col("new").alias("node_id"), "orient"))


def identity(graph: Graph) -> DataFrame:
    """One row: ``letters`` of all paths, those ``aligned`` (on a node of two paths or more), and their ``share`` in a hundred."""
    shared = graph.steps.groupBy("node_id").agg(F.count(F.lit(1)).alias("visits"), F.count_distinct("path").alias("paths"))
    rows = shared.join(graph.nodes.select("node_id", F.char_length("seq").cast("bigint").alias("n")), "node_id").withColumn("all", F.col("n") * F.col("visits"))
    total = rows.agg(F.coalesce(F.sum("all"), F.lit(0)).alias("letters"), F.coalesce(F.sum(F.when(F.col("paths") > 1, F.col("all"))), F.lit(0)).alias("aligned"))
    return total.withColumn("share", F.when(F.col("letters") > 0, 100 * F.col("aligned") / F.col("letters")))


# ---------------------------------------------------------------- around anchors

def _reach(edges: DataFrame, stops: DataFrame, start: DataFrame, through: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """From ``start(source, node)`` along ``edges(src, dst)``: nodes passed, and ``stops(node)`` met, which end the walk unless ``through(source, node)`` holds them."""
    spark, kinds = edges.sparkSession, start.schema
    at = f"{scratch_dir(spark).rstrip('/')}/strandline/reach-{uuid.uuid4().hex}"
    rows = lambda path: spark.read.schema(kinds).parquet(path)
    start.write.parquet(f"{at}/round=0")
    front, i = rows(f"{at}/round=0"), 0
    while front.take(1):  # every round is a folder of its own, so that no plan grows with the rounds
        i += 1
        ways = front.join(edges.hint("merge"), F.col("node") == F.col("src")).select("source", F.col("dst").alias("node")).distinct()
        ways.join(rows(at).hint("merge"), ["source", "node"], "left_anti").write.parquet(f"{at}/round={i}")
        step = rows(f"{at}/round={i}")
        front = step.join(stops.hint("merge"), "node", "left_anti")
        if through is not None:
            front = front.unionByName(step.join(through.hint("merge"), ["source", "node"], "left_semi"))
    found = rows(at).join(start.hint("merge"), ["source", "node"], "left_anti")
    return found.join(stops.hint("merge"), "node", "left_anti"), found.join(stops.hint("merge"), "node", "left_semi")


def segments(edges: DataFrame, aligned: DataFrame, sources: DataFrame) -> DataFrame:
    """``source, node_id, part``: the nodes that lead to an anchor and that trail it, up to the next anchors.

    From each of ``sources(node_id)``, itself one of ``aligned(node_id)``, all
    walks along ``edges(src, dst)`` go on to the nearest aligned nodes; where
    they meet more than one, only nodes between the source and these count,
    since others belong to ways that do not come from it. ``part`` is "leading"
    or "trailing"; what is neither is parallel to the source. Stretches of
    nodes that are not aligned and only follow each other are one node first. All
    sources walk at once, a round for each such node that the longest walk
    passes; the joins of the walks are shuffled, not broadcast.
    """
    e = materialise(edges.select("src", "dst").distinct(), "edges")
    anchors = aligned.select(F.col("node_id").alias("__anchor")).distinct()
    free = e
    for c in ("src", "dst"):
        free = free.join(anchors.hint("merge"), F.col(c) == F.col("__anchor"), "left_anti")
    outs = e.groupBy("src").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("src")
    ins = e.groupBy("dst").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("dst")
    unary = free.join(outs.hint("merge"), "src", "left_semi").join(ins.hint("merge"), "dst", "left_semi")
    stretch = materialise(connected_components(unary), "stretches")
    for c in ("src", "dst"):
        e = e.join(stretch.hint("merge"), F.col(c) == F.col("node"), "left").withColumn(c, F.coalesce("component", c)).drop("node", "component")
    e = materialise(e.where("src <> dst").select("src", "dst").distinct(), "edges")
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    stops = materialise(aligned.select(F.col("node_id").alias("node")).distinct(), "stops")
    start = materialise(sources.select(F.col("node_id").alias("source"), F.col("node_id").alias("node")).distinct(), "sources")
    out = None
    for part, there, home in (("trailing", e, back), ("leading", back, e)):
        passed, met = (materialise(x, part) for x in _reach(there, stops, start))
        many = met.groupBy("source").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("source")
        ends = materialise(met.join(many.hint("merge"), "source", "left_semi"), "ends")
        returned, _ = _reach(home, stops, ends, ends)
        own = passed.join(many.hint("merge"), "source", "left_anti").unionByName(passed.join(many.hint("merge"), "source", "left_semi").join(returned.hint("merge"), ["source", "node"], "left_semi"))
        own = own.select("source", F.col("node").alias("node_id"), F.lit(part).alias("part"))
        out = own if out is None else out.unionByName(own)
    return out.join(stretch.hint("merge"), F.col("node_id") == F.col("component"), "left").select("source", F.coalesce("node", "node_id").alias("node_id"), "part")
