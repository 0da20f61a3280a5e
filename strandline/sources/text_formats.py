"""Readers and writers of sequence, graph and feature files as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.operators.graph import Graph
from strandline.operators.separators import distances, parts
from strandline.operators.suffix import running
from strandline.session import materialise

#: Letters in a line of a written FASTA record.
WIDTH = 100


def _records(spark: SparkSession, path: str) -> tuple[DataFrame, Column, Column]:
    """Records that begin with ``>`` at a line's start, with their first line and the rest."""
    raw = spark.read.text(path, lineSep="\n>").where(F.trim("value") != "")
    value = F.regexp_replace(F.regexp_replace("value", "\r", ""), r"\A\s*>", "")
    return raw, F.substring_index(value, "\n", 1), F.regexp_replace(value, r"\A[^\n]*\n?", "")


def read_fasta(spark: SparkSession, path: str, cut_n: int = 0, truncate_n: bool = False) -> DataFrame:
    """``name, seq`` of FASTA records, gzip by file name.

    Sequences are upper-cased and lose ``-``; names lose ``>`` and tabs; empty
    records go. ``truncate_n`` turns runs of N into one N and drops a leading
    one; ``cut_n`` cuts at runs of that many N and numbers the pieces.
    """
    raw, head, body = _records(spark, path)
    sequence = F.upper(F.regexp_replace(body, r"[\s-]", ""))
    out = raw.select(F.regexp_replace(head, "[>\t]", "").alias("name"), sequence.alias("seq")).where("seq <> ''")
    if truncate_n:
        out = out.withColumn("seq", F.regexp_replace(F.regexp_replace("seq", "N+", "N"), "^N", ""))
    if cut_n:
        out = split_runs(out, "name", "seq", f"N{{{cut_n},}}").select(F.concat_ws("_", "name", F.col("piece").cast("string")).alias("name"), "seq")
    return out


def split_runs(df: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """``key, piece, text``: non-empty pieces between matches of a pattern, numbered from 0."""
    parts = F.filter(F.split(text, pattern), lambda x: x != "")
    return df.select(key, F.posexplode(parts).alias("piece", text))


def fasta_lines(seqs: DataFrame) -> DataFrame:
    """``line``: FASTA records with lines of ``WIDTH`` letters."""
    return seqs.select(F.concat(F.lit(">"), F.col("name"), F.lit("\n"), F.regexp_replace("seq", rf"(.{{{WIDTH}}})(?=.)", "$1\n")).alias("line"))


def gfa_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The records of a GFA file: ``segments(name, seq, tags)``, ``links(src, ofrom, dst, oto, cigar, tags)``, ``paths(path, step, name, orient, overlap)``.

    A ``*`` sequence is empty; ``overlap`` is the CIGAR with the step before,
    null where there is none. Tags map a name to its value.
    """
    c = F.split("value", "\t")
    rows = spark.read.text(path).select(F.substring("value", 1, 1).alias("kind"), c.alias("c"))
    at = lambda i: F.get("c", F.lit(i))

    def tags(first: int) -> Column:
        own = F.filter(F.slice("c", first + 1, F.greatest(F.size("c") - first, F.lit(0))), lambda x: x.rlike("^[A-Za-z][A-Za-z0-9]:[A-Za-z]:"))
        return F.map_from_entries(F.array_distinct(F.transform(own, lambda x: F.struct(F.substring(x, 1, 2).alias("key"), F.substring(x, 6, 1 << 30).alias("value"))))).alias("tags")

    segments = rows.where("kind = 'S'").select(at(1).alias("name"), F.when(at(2) == "*", "").otherwise(F.coalesce(at(2), F.lit(""))).alias("seq"), tags(3))
    links = rows.where("kind = 'L'").select(at(1).alias("src"), at(2).alias("ofrom"), at(3).alias("dst"), at(4).alias("oto"), F.coalesce(at(5), F.lit("0M")).alias("cigar"), tags(6))
    paths = rows.where("kind = 'P'").select(at(1).alias("path"), F.split(at(3), ",").alias("o"), F.posexplode(F.split(at(2), ",")).alias("step", "s"))
    overlap = F.when(F.col("step") > 0, F.get("o", F.col("step") - 1))
    paths = paths.select("path", "step", F.expr("substring(s, 1, length(s) - 1)").alias("name"), F.substring("s", -1, 1).alias("orient"), F.when(overlap.rlike("[0-9]"), overlap).alias("overlap"))
    return {"segments": segments, "links": links, "paths": paths}


def node_ids(names: Column) -> Column:
    """Names that are whole numbers as such, others by a hash."""
    return F.coalesce(F.when(names.rlike("^(0|[1-9][0-9]{0,17})$"), names.cast("bigint")), F.xxhash64(names))


def read_gfa(spark: SparkSession, path: str, keep_original: bool = True) -> Graph:
    """A graph from the segments and paths of a GFA file.

    Nodes that no path visits are dropped, unless the file has no paths at all;
    so are ``*`` paths unless asked for. Links between nodes that stay are edges
    of the graph, taken by a path or not. A step's ``overlap`` with the one
    before is a column of the steps if the file has any but ``0M``.
    """
    t = gfa_tables(spark, path)
    nodes = t["segments"].select(node_ids(F.col("name")).alias("node_id"), "seq")
    paths = t["paths"] if keep_original else t["paths"].where("path not like '*%'")
    steps = paths.select("path", "step", node_ids(F.col("name")).alias("node_id"), "orient", "overlap")
    links = t["links"].select(node_ids(F.col("src")).alias("src"), "ofrom", node_ids(F.col("dst")).alias("dst"), "oto")
    if not steps.where("overlap rlike '[1-9]'").take(1):
        steps = steps.drop("overlap")
    if not steps.take(1):
        return Graph(nodes, steps, links)
    used = steps.select("node_id").distinct()
    for end in ("src", "dst"):
        links = links.join(used.withColumnRenamed("node_id", end), end, "left_semi")
    return Graph(nodes.join(used, "node_id", "left_semi"), steps, links)


def gfa_lines(graph: Graph, links: DataFrame | None = None) -> DataFrame:
    """``line``: header, segments, links and paths; ``links(src, dst, cigar)`` gives overlaps other than ``0M``."""
    spark = graph.nodes.sparkSession
    head = spark.range(1).select(F.lit("H\tVN:Z:1.0").alias("line"))
    s = graph.nodes.select(F.concat_ws("\t", F.lit("S"), F.col("node_id").cast("string"), "seq").alias("line"))
    edges = graph.edges().withColumn("cigar", F.lit("0M"))
    if links is not None:
        edges = edges.drop("cigar").join(links.select("src", "dst", "cigar").distinct(), ["src", "dst"], "left").withColumn("cigar", F.coalesce("cigar", F.lit("0M")))
    e = edges.select(F.concat_ws("\t", F.lit("L"), F.col("src").cast("string"), "ofrom", F.col("dst").cast("string"), "oto", "cigar").alias("line"))
    p = graph.steps.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("step", F.concat(F.col("node_id").cast("string"), "orient").alias("s")))).alias("a"))
    p = p.select(F.concat_ws("\t", F.lit("P"), F.col("path").cast("string"), F.array_join(F.transform("a", lambda x: x["s"]), ","), F.array_join(F.array_repeat(F.lit("0M"), F.size("a") - 1), ",")).alias("line"))
    return head.unionByName(s).unionByName(e).unionByName(p)


def renumbered(graph: Graph) -> Graph:
    """The graph with node ids 1 .. n in topological order, ties by id; a cycle is an error."""
    ranked = running(distances(graph, letters=False), ["distance", "node_id"], F.lit(1).cast("bigint"), "before")
    ids = materialise(ranked.select("node_id", (F.col("before") + 1).alias("new")), "ids")
    return Graph(graph.nodes.join(ids, "node_id").select(F.col("new").alias("node_id"), "seq"), graph.steps.join(ids, "node_id").select("path", "step", F.col("new").alias("node_id"), "orient"))


def node_fasta_lines(graph: Graph) -> DataFrame:
    """``line``: each node as a FASTA record."""
    return fasta_lines(graph.nodes.select(F.col("node_id").cast("string").alias("name"), "seq"))


def split_lines(graph: Graph, named: DataFrame) -> DataFrame:
    """``name, line``: segments and paths of each part that ``named(node_id, name)`` puts nodes into, for one file each."""
    s = graph.nodes.join(named, "node_id").select("name", F.concat_ws("\t", F.lit("S"), F.col("node_id").cast("string"), "seq").alias("line"))
    steps = graph.steps.join(named, "node_id")
    e = graph.edges().join(named.select(F.col("node_id").alias("src"), "name"), "src").select("name", F.concat_ws("\t", F.lit("L"), F.col("src").cast("string"), "ofrom", F.col("dst").cast("string"), "oto", F.lit("0M")).alias("line"))
    p = steps.groupBy("name", "path").agg(F.array_sort(F.collect_list(F.struct("step", F.concat(F.col("node_id").cast("string"), "orient").alias("s")))).alias("a"))
    p = p.select("name", F.concat_ws("\t", F.lit("P"), F.col("path").cast("string"), F.array_join(F.transform("a", lambda x: x["s"]), ","), F.lit("*")).alias("line"))
    return s.unionByName(e).unionByName(p)


def gml_lines(graph: Graph) -> DataFrame:
    """``line``: GML nodes and edges, attributes as strings."""
    n = graph.nodes.select(F.format_string('node [\n  id %d\n  seq "%s"\n  l %d\n]', "node_id", "seq", F.length("seq")).alias("line"))
    e = graph.edges().select(F.format_string('edge [\n  source %d\n  target %d\n  paths "%s"\n]', "src", "dst", F.array_join("paths", ",")).alias("line"))
    return n.unionByName(e)


def gml_parts(graph: Graph, limit: int) -> DataFrame:
    """``component, part, line``: GML nodes and edges in parts of up to ``limit`` nodes, for one file each; a part begins where all paths of a component meet, and that node is in both."""
    cut = materialise(parts(graph, limit), "parts")
    n = graph.nodes.join(cut, "node_id").select("component", "part", F.format_string('node [\n  id %d\n  seq "%s"\n  l %d\n]', "node_id", "seq", F.length("seq")).alias("line"))
    ends = [cut.select("component", "part", F.col("node_id").alias(c)) for c in ("src", "dst")]
    e = graph.edges().join(ends[0], "src").join(ends[1], ["component", "part", "dst"])
    return n.unionByName(e.select("component", "part", F.format_string('edge [\n  source %d\n  target %d\n  paths "%s"\n]', "src", "dst", F.array_join("paths", ",")).alias("line")))


def read_maf(spark: SparkSession, path: str) -> DataFrame:
    """``block, sample, start, size, strand, src_size, text`` of MAF alignment blocks with more than one row."""
    raw = spark.read.text(path, lineSep="\na").where(F.col("value").contains("\ns"))
    blocks = raw.withColumn("block", F.monotonically_increasing_id())  # before the rows of a block are exploded
    lines = blocks.select("block", F.explode(F.split("value", "\n")).alias("l")).where("l like 's%'")
    c = F.split("l", r"\s+")
    rows = lines.select("block", F.get(c, F.lit(1)).alias("sample"), F.get(c, F.lit(2)).cast("bigint").alias("start"), F.get(c, F.lit(3)).cast("bigint").alias("size"), F.get(c, F.lit(4)).alias("strand"), F.get(c, F.lit(5)).cast("bigint").alias("src_size"), F.get(c, F.lit(6)).alias("text"))
    return rows.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("block"))).where("__n > 1").drop("__n")


def maf_lines(aligned: DataFrame) -> DataFrame:
    """``line``: one MAF block for each ``block`` of ``aligned(block, sample, start, size, strand, src_size, text)``."""
    s = F.format_string("s %s %d %d %s %d %s", "sample", "start", "size", "strand", "src_size", "text")
    return aligned.groupBy("block").agg(F.concat(F.lit("a\n"), F.array_join(F.array_sort(F.collect_list(s)), "\n"), F.lit("\n")).alias("line")).select("line")


def bed_lines(df: DataFrame, columns: list[str]) -> DataFrame:
    """``line``: tab-separated columns; nulls as ``.``."""
    return df.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in columns]).alias("line"))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """``reference, start, end, name`` of a BED file."""
    return spark.read.csv(path, sep="\t", comment="#", schema="reference string, start bigint, `end` bigint, name string")


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """``chrom, pos, id, ref, alts, info`` of VCF records; INFO as a map."""
    c = F.split("value", "\t")
    rows = spark.read.text(path).where("value not like '#%'")
    info = F.str_to_map(F.get(c, F.lit(7)), F.lit(";"), F.lit("="))
    return rows.select(F.get(c, F.lit(0)).alias("chrom"), F.get(c, F.lit(1)).cast("bigint").alias("pos"), F.get(c, F.lit(2)).alias("id"), F.get(c, F.lit(3)).alias("ref"), F.split(F.get(c, F.lit(4)), ",").alias("alts"), info.alias("info"))


#: Columns of repeat reports (fixed formats).
TRF = "start end period_size copynumber cons_size percent_match percent_indel score A C G T entropy pattern masked".split()
REPEATMASKER = "score div del ins qsequence qbegin qend qleft C_ rtype rfamily rbegin rend rleft vid".split()


_NAMES = {"entropy", "pattern", "masked", "qsequence", "C_", "rtype", "rfamily", "vid", "qleft", "rbegin", "rleft"}
_REALS = {"copynumber", "div", "del", "ins"}


def read_columns(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Rows of a report with white-space separated columns, numbers by type; lines that begin with no digit are headers."""
    c = F.split(F.trim("value"), r"\s+")
    kind = lambda n: "string" if n in _NAMES - {"entropy"} else "double" if n in _REALS | {"entropy"} else "bigint"
    rows = spark.read.text(path).where(F.trim("value").rlike(r"^\d"))
    return rows.select(*[F.get(c, F.lit(i)).try_cast(kind(n)).alias(n) for i, n in enumerate(names)])


def mfa_lines(aligned: DataFrame) -> DataFrame:
    """``line``: rows of an alignment ``(path, text)`` as FASTA records with gaps."""
    return fasta_lines(aligned.select(F.col("path").alias("name"), F.col("text").alias("seq")))


def renamed_reads(seqs: DataFrame, template: str) -> DataFrame:
    """Records named ``template/number/0_length`` in order of their names, as long-read tools ask for."""
    ranked = running(seqs.select("name", "seq").withColumn("tie", F.monotonically_increasing_id()), ["name", "seq", "tie"], F.lit(1).cast("bigint"), "before")
    number = (F.col("before") + 1).cast("string")
    return ranked.select(F.concat_ws("/", F.lit(template), number, F.concat(F.lit("0_"), F.length("seq").cast("string"))).alias("name"), "seq")


def aligned_graph(aligned: DataFrame) -> Graph:
    """A graph from an alignment ``aligned(path, text)``: one node for each maximal run of columns and base sets."""
    from strandline.operators.msa import columns_to_nodes

    runs = columns_to_nodes(aligned.withColumn("__k", F.lit(0)), "__k", "path", "text")
    ids = runs.withColumn("node_id", F.shiftrightunsigned(F.xxhash64("paths", "start"), 1))
    steps = ids.select("node_id", "start", F.explode(F.split("paths", ",")).alias("path"))
    w = Window.partitionBy("path").orderBy("start")
    return Graph(ids.select("node_id", "seq"), steps.select("path", (F.row_number().over(w) - 1).alias("step"), "node_id", F.lit("+").alias("orient")))


def fasta_graph(seqs: DataFrame) -> Graph:
    """One node and one path for each record; a name that repeats is an error."""
    if seqs.groupBy("name").count().where("count > 1").take(1):
        raise ValueError("record names repeat")
    ids = seqs.select("name", "seq", F.shiftrightunsigned(F.xxhash64("name"), 1).alias("node_id"))
    return Graph(ids.select("node_id", "seq"), ids.select(F.col("name").alias("path"), F.lit(0).alias("step"), "node_id", F.lit("+").alias("orient")))
