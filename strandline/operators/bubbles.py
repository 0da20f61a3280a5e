"""Bubbles, variants and calls of path-labelled graphs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.expr import allele_type, gap_cost, reverse_complement
from strandline.operators.graph import Graph, components, offsets
from strandline.operators.grouped import map_groups
from strandline.operators.separators import pieces
from strandline.session import by_keys, materialise


def simple_bubbles(edges: DataFrame) -> DataFrame:
    """``source, sink, inner``: every way out of the source is the sink itself or a node whose only neighbours are source and sink.

    Degrees and two equi-joins, no traversal. A bubble has two ways at least.
    The edges are found once for all of these.
    """
    e = by_keys(materialise(edges.select("src", "dst").distinct(), "edges"))
    outs = e.groupBy("src").agg(F.count(F.lit(1)).alias("out"))
    ins = e.groupBy("dst").agg(F.count(F.lit(1)).alias("in"))
    inner = ins.where("`in` = 1").select(F.col("dst").alias("mid")).join(outs.where("out = 1").select(F.col("src").alias("mid")), "mid")
    first = e.join(inner, F.col("dst") == F.col("mid")).select(F.col("src").alias("source"), "mid")
    through = first.join(e, F.col("mid") == F.col("src")).select("source", F.col("dst").alias("sink"), "mid")
    ways = through.unionByName(e.select(F.col("src").alias("source"), F.col("dst").alias("sink"), F.lit(None).cast(edges.schema["src"].dataType).alias("mid")))
    found = ways.groupBy("source", "sink").agg(F.count(F.lit(1)).alias("ways"), F.array_sort(F.collect_set("mid")).alias("inner"))
    found = found.join(outs, F.col("source") == F.col("src")).join(ins, F.col("sink") == F.col("dst"))
    return found.where("ways >= 2 and ways = out and ways = `in`").select("source", "sink", "inner")


def _finished(nexts: dict[int, list[int]], starts: list[int]) -> list[int] | None:
    """Nodes in the order in which a depth-first walk leaves them, each after all that follow it; None where the walk meets a cycle or a part that no start reaches."""
    state, order = dict.fromkeys(nexts, 0), []
    for root in starts:
        stack = [(root, iter(nexts[root]))]
        state[root] = 1
        while stack:
            at, rest = stack[-1]
            for n in rest:
                if state[n] == 1:
                    return None
                if not state[n]:
                    state[n] = 1
                    stack.append((n, iter(nexts[n])))
                    break
            else:
                state[at] = 2
                order.append(at)
                stack.pop()
    return order if len(order) == len(nexts) else None


def find_superbubbles(nexts: dict[int, list[int]]) -> list[tuple[int, int, list[int]]]:
    """(source, sink, inner) of all minimal single-entry single-exit regions with an inner node, in linear time.

    In the order in which a walk from all starts leaves the nodes, a region is a
    stretch: its sink comes first and its source last. Sinks that are open wait
    on a stack, each with the latest node that leads into the stretch above it.
    A sink closes at the node that nothing inside reaches past. A graph with
    cycles is searched from every node.
    """
    into: dict[int, list[int]] = {n: [] for n in nexts}
    for n, own in nexts.items():
        for m in own:
            into[m].append(n)
    order = _finished(nexts, sorted(n for n, own in into.items() if not own))
    if order is None:
        return _scanned_superbubbles(nexts, into)
    at = {n: i for i, n in enumerate(order)}
    never = len(order)  # past the last node: no region holds what a start or an end leads to
    found, open_sinks = [], []  # sink's place, latest predecessor of the nodes from there on
    for i, n in enumerate(order):
        lowest = min((at[m] for m in nexts[n]), default=-1)
        if lowest == i - 1 and i:
            open_sinks.append([i - 1, -1])
        while open_sinks and open_sinks[-1][0] > lowest:
            _, late = open_sinks.pop()
            if open_sinks:
                open_sinks[-1][1] = max(open_sinks[-1][1], late)
        # what leads into the nodes since the sink, the sink included and this one not
        if i and open_sinks:
            before = order[i - 1]
            open_sinks[-1][1] = max(open_sinks[-1][1], max((at[m] for m in into[before]), default=never))
            if open_sinks[-1][1] == i:
                sink, late = open_sinks.pop()
                if open_sinks:
                    open_sinks[-1][1] = max(open_sinks[-1][1], late)
                if i - sink > 1:
                    found.append((n, order[sink], sorted(order[sink + 1 : i])))
    return sorted(found)


def _scanned_superbubbles(nexts: dict[int, list[int]], into: dict[int, list[int]]) -> list[tuple[int, int, list[int]]]:
    """The same by a frontier from every node, advanced over nodes all of whose ways in are done, until it holds one node and nothing leads out."""
    out, found = {n: set(own) for n, own in nexts.items()}, []
    for s in sorted(out):
        seen, done, ready, sink = set(), {s}, [s], None
        while ready:
            v = ready.pop()
            if s in out[v] or not out[v]:
                break
            seen |= out[v]
            done.add(v)
            seen.discard(v)
            ready.extend(u for u in out[v] if set(into[u]) <= done)
            if len(ready) == 1 and seen == {ready[0]}:
                sink = ready[0]
                break
        if sink is not None and len(done) > 1 and not out[sink] & (done | {sink}):
            found.append((s, sink, sorted(done - {s})))
    return found


def superbubbles(graph: Graph) -> DataFrame:
    """``component, source, sink, inner``: minimal single-entry single-exit regions.

    Only pairs that the same paths visit and that have an inner node count. No
    region reaches past a node that all paths visit, so that components are
    folded in the pieces between these, in linear time where there is no cycle;
    which paths visit a region's ends is joined afterwards.
    """
    nodes, links = pieces(graph)
    lone = nodes.select("component", "piece", F.col("node_id").alias("src"), F.lit(None).cast("bigint").alias("dst"))

    def fold(cols: list[list]) -> list[tuple]:
        nexts: dict[int, list[int]] = {}
        for s, d in zip(cols[2], cols[3], strict=True):
            own = nexts.setdefault(s, [])
            if d is not None:
                own.append(d)
        return [(cols[0][0], *r) for r in find_superbubbles(nexts)]

    found = map_groups(lone.unionByName(links), ["component", "piece"], ["src", "dst"], fold, "component bigint, source bigint, sink bigint, inner array<bigint>")
    found = by_keys(materialise(found, "superbubbles"))
    visits = graph.steps.select("node_id", "path").distinct()
    ends = found.select("source", "sink", F.explode(F.array("source", "sink")).alias("node_id"))
    seen = ends.join(visits, "node_id").groupBy("source", "sink", "path").agg(F.count(F.lit(1)).alias("ends")).where("ends = 1").select("source", "sink").distinct()
    return found.join(seen, ["source", "sink"], "left_anti").select("component", "source", "sink", "inner")


def complex_bubbles(graph: Graph) -> DataFrame:
    """``source, sink, inner, simple``: superbubbles, with those that :func:`simple_bubbles` finds marked."""
    every = superbubbles(graph).select("source", "sink", "inner")
    simple = simple_bubbles(graph.edges()).select("source", "sink", F.lit(True).alias("simple"))
    return by_keys(every.join(simple, ["source", "sink"], "left").withColumn("simple", F.coalesce("simple", F.lit(False))))


def marked_bubbles(graph: Graph) -> DataFrame:
    """``source, sink, inner, simple``: simple bubbles, found once for all that reads them."""
    found = by_keys(materialise(simple_bubbles(graph.edges()), "bubbles"))
    return found.withColumn("simple", F.lit(True))


def _visits(graph: Graph, bubbles: DataFrame) -> DataFrame:
    """``source, sink, path, from, to``: where each path enters and leaves a bubble: at a visit of the source and the next one of the sink, before the source comes again."""
    at = graph.steps.select("path", "step", "node_id")
    ends = bubbles.select("source", "sink", F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("source").alias("node_id")), F.struct(F.lit(1).alias("end"), F.col("sink").alias("node_id")))).alias("x")).select("source", "sink", "x.end", "x.node_id")
    w = Window.partitionBy("source", "sink", "path").orderBy("step")
    rows = ends.join(at, "node_id").withColumn("next", F.lead("end").over(w)).withColumn("to", F.lead("step").over(w))
    return rows.where("end = 0 and next = 1").select("source", "sink", "path", F.col("step").alias("from"), "to")


def alleles(graph: Graph, bubbles: DataFrame | None = None) -> DataFrame:
    """``source, sink, path, allele, simple``: the sequence of each path inside each bubble, ``-`` if none; simple bubbles unless others are given."""
    found = bubbles if bubbles is not None else marked_bubbles(graph)
    on = _visits(graph, found)
    seqs = graph.steps.join(graph.nodes, "node_id").select("path", "step", F.when(F.col("orient") == "-", reverse_complement(F.col("seq"))).otherwise(F.col("seq")).alias("s"))
    inner = on.where("to - from > 1").withColumn("step", F.explode(F.sequence(F.col("from") + 1, F.col("to") - 1))).join(by_keys(seqs), ["path", "step"])
    keys = ["source", "sink", "path", "from"]
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", "s"))), lambda x: x["s"]), "")
    whole = on.join(inner.groupBy(*keys).agg(text.alias("allele")), keys, "left").withColumn("allele", F.when(F.coalesce("allele", F.lit("")) == "", F.lit("-")).otherwise(F.col("allele")))
    return whole.join(found.select("source", "sink", "simple"), ["source", "sink"]).select("source", "sink", "path", "allele", "simple")


def variants(graph: Graph, bubbles: DataFrame | None = None) -> DataFrame:
    """One row for each bubble and allele: ``source, sink, allele, n_alleles, type, allele_index, paths``.

    An allele is the sequence between source and sink on a path, ``-`` if none.
    The allele of the first path by name has index 0, others follow by string.
    Simple bubbles unless others are given, as :func:`complex_bubbles` finds.
    """
    per = alleles(graph, bubbles).groupBy("source", "sink", "simple", "allele").agg(F.array_sort(F.collect_set("path")).alias("paths"))
    both = Window.partitionBy("source", "sink")
    lead = F.get("paths", F.lit(0)) == F.min(F.get("paths", F.lit(0))).over(both)
    rows = per.withColumn("reference", lead).withColumn("n_alleles", F.count(F.lit(1)).over(both)).withColumn("direct", F.max((F.col("allele") == "-").cast("int")).over(both) == 1).withColumn("longest", F.max(F.length("allele")).over(both))
    rank = F.row_number().over(both.orderBy(F.col("reference").desc(), "allele")) - 1
    return rows.select("source", "sink", "allele", "n_alleles", allele_type(F.col("n_alleles"), F.col("longest"), F.col("direct"), F.col("simple")).alias("type"), rank.alias("allele_index"), "paths")


def calls(found: DataFrame, paths: list[str]) -> DataFrame:
    """Variants by path: one row for each bubble, one column with the allele's index for each path."""
    long = found.select("source", "sink", "type", F.explode("paths").alias("path"), "allele_index")
    return long.groupBy("source", "sink", "type").pivot("path", paths).agg(F.min("allele_index"))


def variant_report(graph: Graph, reference: object = None, bubbles: DataFrame | None = None, is_original=None, min_size: int = 0, min_diff: int = 0, max_diff: int | None = None, kind: str = "all", no_gaps: bool = False, min_flank: int = 0, reference_only: bool = False) -> DataFrame:
    """One row for each variant that passes the filters: ``reference, pos_start, pos_end, source_size, sink_size, max_size, min_size, diff_size, source, sink, source_seq, sink_seq, type, spans_gap, genotypes, calls``.

    Positions are on ``reference`` where it passes the bubble, else (unless
    ``reference_only``) on the first path by name that does, original layouts
    (``is_original``) last. ``calls`` maps a path to the index of its allele
    among ``genotypes``; the allele of the first path has index 0. Sizes count
    ``-`` as 0; the 20 letters next to the bubble show its flanks.
    """
    found = bubbles if bubbles is not None else marked_bubbles(graph)
    rows = variants(graph, found)
    size = F.when(F.col("allele") == "-", 0).otherwise(F.length("allele"))
    per = rows.groupBy("source", "sink", "type").agg(
        F.max(size).alias("max_size"), F.min(size).alias("min_size"), F.array_sort(F.collect_list(F.struct("allele_index", "allele"))).alias("a"),
        F.map_from_entries(F.array_sort(F.flatten(F.collect_list(F.transform("paths", lambda p: F.struct(p.alias("key"), F.col("allele_index").alias("value"))))))).alias("calls"),
    )
    nodes = graph.nodes.select("node_id", "seq", F.length("seq").alias("n"))
    inside = found.select("source", "sink", F.explode(F.concat(F.array("source", "sink"), F.coalesce("inner", F.array().cast(found.schema["inner"].dataType)))).alias("node_id")).join(nodes, "node_id")
    gaps = by_keys(inside.groupBy("source", "sink").agg(F.max(F.contains("seq", F.lit("N")).cast("int")).alias("gap")))
    where = offsets(graph).select("path", "step", "offset", "length")
    on = _visits(graph, found)
    a = where.select("path", F.col("step").alias("from"), (F.col("offset") + F.col("length")).alias("pos_start"))
    z = where.select("path", F.col("step").alias("to"), F.col("offset").alias("pos_end"))
    placed = on.join(a, ["path", "from"]).join(z, ["path", "to"])
    wanted = F.col("path") == F.lit(reference) if reference is not None else F.lit(False)
    original = is_original(F.col("path")) if is_original else F.lit(False)
    best = placed.groupBy("source", "sink").agg(F.min(F.struct((~wanted).alias("other"), original.alias("original"), "path", "pos_start", "pos_end")).alias("b"))
    out = per.join(gaps, ["source", "sink"]).join(best, ["source", "sink"])
    out = out.join(nodes.select(F.col("node_id").alias("source"), F.substring("seq", -20, 20).alias("source_seq"), F.col("n").alias("source_size")), "source")
    out = out.join(nodes.select(F.col("node_id").alias("sink"), F.substring("seq", 1, 20).alias("sink_seq"), F.col("n").alias("sink_size")), "sink")
    diff = F.col("max_size") - F.col("min_size")
    keep = (F.col("max_size") >= min_size) & (diff >= min_diff) & (F.least("source_size", "sink_size") >= min_flank)
    keep = keep & (diff <= max_diff) if max_diff is not None else keep
    keep = keep & (F.col("type") == kind) if kind != "all" else keep
    keep = keep & (F.col("gap") == 0) if no_gaps else keep
    keep = keep & ~F.col("b.other") if reference_only and reference is not None else keep
    return out.where(keep).select(
        F.col("b.path").alias("reference"), F.col("b.pos_start").alias("pos_start"), F.col("b.pos_end").alias("pos_end"), "source_size", "sink_size", "max_size", "min_size", diff.alias("diff_size"),
        "source", "sink", "source_seq", "sink_seq", "type", (F.col("gap") == 1).alias("spans_gap"), F.transform("a", lambda x: x["allele"]).alias("genotypes"), "calls",
    )


#: Columns of a variant table before those of the paths (fixed format).
TSV = "reference pos_start pos_end source_size sink_size max_allele_size min_allele_size diff_allele_size source sink source_seq sink_seq type genotypes".split()


def variant_tsv(report: DataFrame, paths: list) -> DataFrame:
    """``line``: variants as tab-separated columns, then each path's allele, ``-`` if it passes by."""
    given = "reference pos_start pos_end source_size sink_size max_size min_size diff_size source sink source_seq sink_seq type".split()
    own = [F.coalesce(F.element_at("calls", F.lit(p)).cast("string"), F.lit("-")) for p in paths]
    return report.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in given], F.array_join("genotypes", ","), *own).alias("line"))


def variant_tsv_header(paths: list) -> str:
    return "#" + "\t".join([*TSV, *map(str, paths)])


def variant_fasta(report: DataFrame) -> DataFrame:
    """``file, line``: each allele but ``-`` as a FASTA record, and the name of the variant's own file."""
    name = F.concat(F.lit(">"), F.col("reference").cast("string"), F.lit(":"), F.col("pos_start").cast("string"), F.lit("-"), F.col("pos_end").cast("string"), F.lit("_"), F.col("i").cast("string"))
    rows = report.select("reference", "pos_start", "pos_end", F.concat_ws("_", "source", "sink").alias("file"), F.posexplode("genotypes").alias("i", "seq"))
    return rows.where("seq <> '-'").select("file", F.concat(name, F.lit("\n"), "seq").alias("line"))


def variant_bed(report: DataFrame) -> DataFrame:
    """``line``: place and type of each variant."""
    return report.select(F.concat_ws("\t", F.col("reference").cast("string"), F.col("pos_start").cast("string"), F.col("pos_end").cast("string"), "type").alias("line"))


def indel_wiggle(graph: Graph, least: int = 0) -> DataFrame:
    """``source, sink, left, right``: how far every allele of a simple indel can move along its flanks, and ``least`` on top.

    To the right as far as the sink goes on like each allele followed by the
    sink; to the left likewise with the source.
    """
    rows = alleles(graph)
    own = rows.groupBy("source", "sink").agg(F.collect_set("allele").alias("a")).where(F.array_contains("a", "-"))
    seq = graph.nodes
    own = own.join(seq.select(F.col("node_id").alias("source"), F.col("seq").alias("before")), "source").join(seq.select(F.col("node_id").alias("sink"), F.col("seq").alias("after")), "sink")
    texts = F.filter("a", lambda x: x != "-")

    def common(x: Column, y: Column) -> Column:
        """Letters that two strings begin with together."""
        n = F.least(F.length(x), F.length(y))
        same = F.filter(F.sequence(F.lit(1), n + 1), lambda i: (i > n) | (F.substring(x, i, F.lit(1)) != F.substring(y, i, F.lit(1))))
        return F.array_min(same) - 1

    right = F.array_min(F.transform(texts, lambda x: common(F.col("after"), F.concat(x, "after"))))
    left = F.array_min(F.transform(texts, lambda x: common(F.reverse("before"), F.reverse(F.concat("before", x)))))
    return own.select("source", "sink", (left + least).alias("left"), (right + least).alias("right"))


def rearrangements(graph: Graph, is_original) -> DataFrame:
    """Edges of original layouts only, with the reference offset of their source."""
    from strandline.operators.graph import structural_edges

    at = offsets(graph).where(~is_original(F.col("path"))).groupBy("node_id").agg(F.min("offset").alias("reference_offset"))
    return structural_edges(graph.edges(), is_original).join(at, F.col("src") == F.col("node_id"), "left").drop("node_id")


def vcf_header(lengths: list[tuple[str, int]], paths: list) -> list[str]:
    """Header lines of a VCF file for contigs of the given lengths (fixed format)."""
    info = [
        ("diffsize", "Integer", "Difference between the shortest and longest allele."), ("source", "String", "Source of the node pair."), ("sink", "String", "Sink of the node pair."),
        ("bubbletype", "String", "Type of the variant."), ("start", "Integer", "Start position on the reference."), ("end", "Integer", "End position on the reference."),
    ]
    lines = ["##fileformat=VCFv4.0", *(f"##contig=<ID={name},LENGTH={n}>" for name, n in lengths)]
    lines += ['##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">', '##FORMAT=<ID=SZ,Number=1,Type=Integer,Description="Allele size">']
    lines += [f'##INFO=<ID={name},Number=1,Type={kind},Description="{text}">' for name, kind, text in info]
    return [*lines, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *map(str, paths)])]


def vcf_lines(report: DataFrame, paths: list) -> DataFrame:
    """``line``: VCF 4.0 records of :func:`variant_report`, with genotype and allele size of each path.

    POS is 1-based. Where sizes differ, all alleles carry the base before them.
    The allele of the variant's reference path comes first and is called 0.
    """
    differ = F.col("diff_size") > 0
    text = F.transform("genotypes", lambda g: F.when(differ, F.concat(F.substring("source_seq", -1, 1), F.when(g == "-", F.lit("")).otherwise(g))).otherwise(g))
    own = F.coalesce(F.element_at("calls", F.col("reference")), F.lit(0))
    rows = report.withColumn("text", text).withColumn("own", own).withColumn("pos", F.when(differ, F.col("pos_start")).otherwise(F.col("pos_start") + 1))
    swap = lambda i: F.when(i == F.col("own"), F.lit(0)).when(i == 0, F.col("own")).otherwise(i)
    rows = rows.withColumn("ordered", F.transform("text", lambda t, i: F.get("text", swap(i))))
    info = F.concat_ws(";", *[F.concat(F.lit(f"{k}="), F.col(c).cast("string")) for k, c in (("diffsize", "diff_size"), ("source", "source"), ("sink", "sink"), ("bubbletype", "type"), ("start", "pos"), ("end", "pos_end"))])

    def call(path) -> Column:
        i = swap(F.element_at("calls", F.lit(path)))
        return F.coalesce(F.concat_ws(":", F.nullif(i, F.lit(None)).cast("string"), F.length(F.get("ordered", i)).cast("string")), F.lit("."))

    sample = [F.when(F.array_contains(F.map_keys("calls"), F.lit(p)), call(p)).otherwise(F.lit(".")) for p in paths]
    return rows.select(F.concat_ws("\t", F.col("reference").cast("string"), F.col("pos").cast("string"), F.lit("."), F.get("ordered", F.lit(0)), F.array_join(F.slice("ordered", 2, F.size("ordered")), ","), F.lit("."), F.lit("PASS"), info, F.lit("GT:SZ"), *sample).alias("line"))


def component_stats(graph: Graph, bubbles: DataFrame | None = None) -> DataFrame:
    """One row for each component: its ``paths`` (joined by commas), ``nodes``, counts of bubbles and variants by kind, and its chain.

    The chain are the nodes that all of the component's paths visit, each once:
    their number, letters, weight (letters times pairs of paths), penalty (sum
    of pairs over the gaps between neighbours) and score.
    """
    where = by_keys(materialise(components(graph), "components"))
    found = bubbles if bubbles is not None else complex_bubbles(graph)
    at = offsets(graph).join(where, "node_id")
    who = at.groupBy("component").agg(F.array_sort(F.collect_set("path")).alias("p"), F.count_distinct("node_id").alias("nodes"))
    report = variant_report(graph, bubbles=found).join(found.select("source", "sink", "simple"), ["source", "sink"]).join(where.withColumnRenamed("node_id", "source"), "source")
    kind = lambda k: F.count_if(F.col("type") == k).alias({"multi-allelic": "multi"}.get(k, k) + "_variants")
    gap = lambda simple: F.count_if(F.col("spans_gap") & (F.col("simple") == simple)).alias("simple_gaps" if simple else "complex_gaps")
    counts = report.groupBy("component").agg(F.count(F.lit(1)).alias("bubbles"), F.count_if("simple").alias("simple_bubbles"), F.count_if(~F.col("simple")).alias("complex_bubbles"), *map(kind, ("snp", "indel", "multi-allelic", "region", "complex")), gap(True), gap(False))
    per = at.groupBy("component", "node_id").agg(F.count(F.lit(1)).alias("visits"), F.array_sort(F.collect_list(F.struct("path", "offset"))).alias("v"), F.first("length").alias("length")).join(who.select("component", F.size("p").alias("k")), "component")
    full = per.where("visits = k and size(array_distinct(transform(v, x -> x.path))) = k").select("component", "k", "length", F.transform("v", lambda x: x["offset"]).alias("point"))
    w = Window.partitionBy("component").orderBy("point")
    chain = full.withColumn("end", F.lag(F.transform("point", lambda x: x + F.col("length"))).over(w))
    chain = chain.groupBy("component").agg(F.count(F.lit(1)).alias("chain_nodes"), F.sum("length").alias("chain_letters"), F.sum(F.expr("length * k * (k - 1) div 2")).alias("chain_weight"), F.sum(F.coalesce(gap_cost(F.col("end"), F.col("point")), F.lit(0.0))).alias("chain_penalty"))
    out = who.join(counts, "component", "left").join(chain, "component", "left")
    zeros = [c for c in counts.columns + chain.columns if c != "component"]
    out = out.select("component", F.array_join(F.col("p").cast("array<string>"), ",").alias("paths"), "nodes", *[F.coalesce(c, F.lit(0).cast(out.schema[c].dataType)).alias(c) for c in zeros])
    return out.withColumn("chain_score", F.col("chain_weight") - F.col("chain_penalty"))
