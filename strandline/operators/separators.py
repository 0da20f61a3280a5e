"""Components of a graph cut at the nodes that all of their paths visit, and folds over the pieces.

A node that every path of a component visits once splits every walk into what
comes before and what comes after it, as long as no node is before it on one
path and after it on another. So whatever is sequential in a component is
sequential in its pieces only: regions between two nodes lie within a piece, and
distances and longest paths of pieces add up. A component of any size is then as
many small groups as it has such nodes. Components where paths disagree about
the order stay whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.expr import base_count
from strandline.operators.graph import Graph, components
from strandline.operators.grouped import map_groups
from strandline.operators.suffix import running
from strandline.session import materialise


def pieces(graph: Graph) -> tuple[DataFrame, DataFrame]:
    """``(component, piece, node_id, role)`` and ``(component, piece, src, dst)``: nodes and edges of the pieces of all components, which are numbered along the paths.

    A separator is in two pieces, the "sink" of one and the "source" of the
    next; other nodes have no role. Nodes that no path visits are a component
    each.
    """
    where = materialise(components(graph), "components")
    steps = materialise(graph.steps.select("path", "step", "node_id").join(where, "node_id"), "placed")
    paths = steps.groupBy("component").agg(F.count_distinct("path").alias("paths"))
    seen = steps.groupBy("component", "node_id").agg(F.count(F.lit(1)).alias("visits"), F.count_distinct("path").alias("by"))
    common = seen.join(paths, "component").where("visits = paths and `by` = paths").select("node_id", F.lit(1).alias("mark"))
    w = Window.partitionBy("path").orderBy("step")
    before = F.coalesce(F.sum("sep").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    walk = steps.join(common, "node_id", "left").withColumn("sep", F.coalesce("mark", F.lit(0)))
    walk = materialise(walk.select("component", "node_id", "sep", before.cast("int").alias("before"), F.lead("node_id").over(w).alias("next")), "walk")
    twisted = walk.groupBy("component", "node_id").agg(F.min("before").alias("lo"), F.max("before").alias("hi")).where("lo <> hi").select("component", F.lit(True).alias("whole")).distinct()
    walk = walk.join(twisted, "component", "left")
    walk = walk.select("component", "node_id", "next", *[F.when(F.col("whole"), 0).otherwise(F.col(c)).alias(c) for c in ("sep", "before")])
    once = walk.select("component", "node_id", "sep", "before").distinct()
    roles = F.when(F.col("sep") == 1, F.array(F.struct(F.col("before").alias("piece"), F.lit("sink").alias("role")), F.struct((F.col("before") + 1).alias("piece"), F.lit("source").alias("role"))))
    roles = F.coalesce(roles, F.array(F.struct(F.col("before").alias("piece"), F.lit(None).cast("string").alias("role"))))
    nodes = once.select("component", "node_id", F.explode(roles).alias("r")).select("component", F.col("r.piece").alias("piece"), "node_id", F.col("r.role").alias("role"))
    lone = where.join(graph.steps.select("node_id").distinct(), "node_id", "left_anti").select("component", F.lit(0).alias("piece"), "node_id", F.lit(None).cast("string").alias("role"))
    edges = walk.where("next is not null").select("component", (F.col("before") + F.col("sep")).alias("piece"), F.col("node_id").alias("src"), F.col("next").alias("dst")).distinct()
    return materialise(nodes.unionByName(lone), "nodes"), materialise(edges, "edges")


def _rows(nodes: DataFrame, edges: DataFrame, weight: DataFrame | None) -> DataFrame:
    """Nodes of a piece (without ``dst``) with their weights, and its edges, as rows of one table."""
    own = nodes.withColumn("w", F.lit(1).cast("bigint")) if weight is None else nodes.join(weight, "node_id")
    return own.select("component", "piece", F.col("node_id").alias("src"), F.lit(None).cast("bigint").alias("dst"), "role", "w").unionByName(edges.select("component", "piece", "src", "dst", F.lit(None).cast("string").alias("role"), F.lit(0).cast("bigint").alias("w")))


def _parsed(cols: list[list]) -> tuple[dict[int, int], dict[int, list[int]], dict[int, str]]:
    """Weights, ways on and roles of a piece's nodes."""
    weight, nexts, role = {}, {}, {}
    for s, d, r, w in zip(*cols[2:], strict=True):
        if d is None:
            weight[s], role[s] = w, r
            nexts.setdefault(s, [])
        else:
            nexts.setdefault(s, []).append(d)
    return weight, nexts, role


def _far(weight: dict[int, int], nexts: dict[int, list[int]], source: int | None = None) -> tuple[dict[int, int], dict[int, int | None]]:
    """The heaviest way to each node, itself included, from ``source`` or else from anywhere, and the node before it there; raises on a cycle."""
    into = dict.fromkeys(weight, 0)
    for own in nexts.values():
        for m in own:
            into[m] += 1
    best = {n: w if source in (None, n) else -1 for n, w in weight.items()}
    back = dict.fromkeys(weight, None)
    ready, done = sorted(n for n, k in into.items() if not k), 0
    while ready:
        n = ready.pop()
        done += 1
        for m in sorted(nexts[n]):
            if best[n] + weight[m] > best[m]:
                best[m], back[m] = best[n] + weight[m], n
            into[m] -= 1
            if not into[m]:
                ready.append(m)
    if done < len(weight):
        raise ValueError("the graph has a cycle")
    return best, back


def distances(graph: Graph, letters: bool = True) -> DataFrame:
    """``node_id, distance``: the longest way from any start to each node of an acyclic graph, in letters, or in nodes passed; raises on a cycle."""
    nodes, edges = pieces(graph)
    weight = graph.nodes.select("node_id", F.length("seq").cast("bigint").alias("w")) if letters else None

    def fold(cols: list[list]) -> list[tuple]:
        weight, nexts, role = _parsed(cols)
        best, _ = _far(weight, nexts)
        return [(cols[0][0], cols[1][0], n, role[n], d - weight[n]) for n, d in best.items()]

    local = materialise(map_groups(_rows(nodes, edges, weight), ["component", "piece"], ["src", "dst"], fold, "component bigint, piece int, node_id bigint, role string, d bigint"), "local")
    length = local.groupBy("component", "piece").agg(F.coalesce(F.max(F.when(F.col("role") == "sink", F.col("d"))), F.lit(0)).alias("length"))
    sums = materialise(running(length, ["component", "piece"], F.col("length"), "before"), "sums")
    first = sums.where("piece = 0").select("component", F.col("before").alias("first"))
    base = sums.join(first, "component").select("component", "piece", (F.col("before") - F.col("first")).alias("base"))
    return local.where("role is null or role = 'sink'").join(base, ["component", "piece"]).select("node_id", (F.col("base") + F.col("d")).alias("distance"))


def longest_paths(graph: Graph) -> DataFrame:
    """``component, path array, length``: the longest path of each component of an acyclic graph by letters other than N; raises on a cycle."""
    nodes, edges = pieces(graph)
    weight = graph.nodes.select("node_id", (F.length("seq") - base_count(F.upper("seq"), "N")).cast("bigint").alias("w"))

    def fold(cols: list[list]) -> list[tuple]:
        weight, nexts, role = _parsed(cols)
        source = next((n for n, r in role.items() if r == "source"), None)
        if source is not None:
            weight[source] = 0  # counted as the sink of the piece before
        best, back = _far(weight, nexts, source)
        sink = next((n for n, r in role.items() if r == "sink"), None)
        at = sink if sink is not None else min(weight, key=lambda n: (-best[n], n))
        length, path = best[at], []
        while at is not None:
            path.append(at)
            at = back[at]
        if path[-1] == source:
            path.pop()
        return [(cols[0][0], cols[1][0], path[::-1], length)]

    own = map_groups(_rows(nodes, edges, weight), ["component", "piece"], ["src", "dst"], fold, "component bigint, piece int, own array<bigint>, n bigint")
    every = F.array_sort(F.collect_list(F.struct("piece", "own")))
    return own.groupBy("component").agg(F.flatten(F.transform(every, lambda x: x["own"])).alias("path"), F.sum("n").alias("length"))


def parts(graph: Graph, limit: int) -> DataFrame:
    """``component, part, node_id``: pieces of each component put together, in order, to parts of up to ``limit`` nodes.

    A piece that has more is a part by itself. Separators at the border of two
    parts are in both. Only the sizes of pieces are walked in order.
    """
    nodes, _ = pieces(graph)
    size = nodes.where("role is null or role = 'sink'").groupBy("component", "piece").agg(F.count(F.lit(1)).alias("n"))

    def fold(cols: list[list]) -> list[tuple]:
        out, part, held = [], 0, 0
        for component, piece, n in zip(*cols, strict=True):
            entry = 1 if piece else 0  # the separator that it begins with
            if held and held + n > limit:
                part, held = part + 1, entry
            held += n
            out.append((component, piece, part))
        return out

    dealt = map_groups(size, ["component"], ["piece"], fold, "component bigint, piece int, part int")
    return nodes.join(dealt, ["component", "piece"]).select("component", "part", "node_id").distinct()
