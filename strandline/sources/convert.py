"""Conversion between graph and alignment formats: any reader with any writer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.operators import msa
from strandline.operators.graph import Graph, offsets
from strandline.sources import text_formats as S


def maf_graph(aligned: DataFrame) -> Graph:
    """A graph from alignment blocks ``(block, sample, start, size, text)``: runs of columns become nodes, stretches of a sample between blocks nodes of N."""
    runs = msa.columns_to_nodes(aligned, "block", "sample", "text").withColumn("node_id", F.shiftrightunsigned(F.xxhash64("block", "paths", "start"), 1))
    visits = runs.select("block", "node_id", F.col("start").alias("at"), F.explode(F.split("paths", ",")).alias("path"))
    begin = aligned.select("block", F.col("sample").alias("path"), F.col("start").alias("begin"))
    placed = visits.join(begin, ["block", "path"]).select("path", "begin", "at", "node_id")
    w = Window.partitionBy("sample").orderBy("start")
    upto = F.coalesce(F.lag(F.col("start") + F.col("size")).over(w), F.lit(0))
    gaps = aligned.select("sample", "start", upto.alias("upto")).where("upto < start")
    gaps = gaps.select(F.col("sample").alias("path"), F.col("upto").alias("begin"), F.lit(0).cast("bigint").alias("at"), F.shiftrightunsigned(F.xxhash64("sample", "upto"), 1).alias("node_id"), F.expr("repeat('N', int(start - upto))").alias("seq"))
    steps = placed.unionByName(gaps.drop("seq"))
    order = Window.partitionBy("path").orderBy("begin", "at")
    nodes = runs.select("node_id", "seq").unionByName(gaps.select("node_id", "seq"))
    return Graph(nodes, steps.select("path", (F.row_number().over(order) - 1).alias("step"), "node_id", F.lit("+").alias("orient")))


def graph_blocks(graph: Graph) -> DataFrame:
    """Alignment blocks of a graph, one for each node that two or more paths visit."""
    on = offsets(graph)
    size = on.groupBy("path").agg(F.sum("length").alias("src_size"))
    shared = on.groupBy("node_id").agg(F.count_distinct("path").alias("n")).where("n > 1")
    rows = on.join(shared, "node_id").join(size, "path").join(graph.nodes, "node_id")
    return rows.select(F.col("node_id").alias("block"), F.col("path").alias("sample"), F.col("offset").alias("start"), F.col("length").alias("size"), F.col("orient").alias("strand"), "src_size", F.col("seq").alias("text"))


READERS = {
    "gfa": S.read_gfa,
    "maf": lambda spark, path: maf_graph(S.read_maf(spark, path)),
    "fasta": lambda spark, path: S.fasta_graph(S.read_fasta(spark, path)),
    "aligned": lambda spark, path: S.aligned_graph(_aligned(spark, path)),
}
WRITERS = {"gfa": S.gfa_lines, "gml": S.gml_lines, "maf": lambda g: S.maf_lines(graph_blocks(g))}


def _aligned(spark: SparkSession, path: str) -> DataFrame:
    """Records of an aligned multi-FASTA, gaps kept."""
    raw, head, body = S._records(spark, path)
    return raw.select(F.trim(F.regexp_replace(head, ">", "")).alias("path"), F.upper(F.regexp_replace(body, r"\s", "")).alias("text"))


def convert(spark: SparkSession, path: str, source: str, target: str) -> DataFrame:
    """``line``: a file of one format as text of another."""
    return WRITERS[target](READERS[source](spark, path))


def alignment_plan(reference: str, drafts: list[str], batch: int = 2, sequential: bool = False) -> list[tuple[str, list[str]]]:
    """Steps of a whole alignment: place each draft, align all at once or in batches, unzip, refine, call variants."""
    steps = [("place_contigs", [reference, d]) for d in drafts]
    groups = [drafts[i : i + batch] for i in range(0, len(drafts), batch)] if sequential else [drafts]
    done = [reference]
    for g in groups:
        steps.append(("recursive_align", [*done, *g]))
        done = ["graph"] if sequential else done
    return [*steps, ("unzip", ["graph"]), ("refine", ["graph"]), ("variants", ["graph"])]
