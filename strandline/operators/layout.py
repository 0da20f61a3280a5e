"""Layout of draft contigs against a reference: blocks, chains, order and gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.expr import reverse_complement
from strandline.operators.chain import cluster_diagonals, glocal_chains, merge_consecutive
from strandline.operators.match import mems, mums, seeds


def anchors(ref: DataFrame, contigs: DataFrame, k: int, stop: str = "N") -> DataFrame:
    """Unique matches of contigs (name, seq) with a reference (name, seq) on both strands: ``ref, ctg, s1, s2, length, orient``.

    On the reverse strand ``s2`` is a position of the contig as given. No match holds a letter of ``stop``.
    """
    out = None
    for orient in (0, 1):
        own = contigs.select(F.col("name").alias("ctg"), (reverse_complement(F.col("seq")) if orient else F.col("seq")).alias("t2"))
        found = mums(mems(seeds(ref.select(F.col("name").alias("ref"), F.col("seq").alias("t1")), own, "ref", "ctg", "t1", "t2", k, stop), "ref", "ctg", k), "ref", "ctg")
        size = contigs.select(F.col("name").alias("ctg"), F.length("seq").cast("bigint").alias("n"))
        found = found.join(size, "ctg").select("ref", "ctg", F.col("r_start").alias("s1"), (F.col("n") - F.col("q_start") - F.col("length") if orient else F.col("q_start")).alias("s2"), "length", F.lit(orient).alias("orient"))
        out = found if out is None else out.unionByName(found)
    return out


def place_contigs(ref: DataFrame, contigs: DataFrame, k: int = 20, max_dist: int = 30, min_cluster: int = 50, stop: str = "N", min_chain: int = 0, min_contig: int = 0) -> DataFrame:
    """Order and strand of contigs along their best reference: ``ref, ctg, orient, s1, e1, score, gap_before``.

    Blocks of each contig and reference are chained; the reference with the
    best chain wins, ties by name. ``gap_before`` is the distance from the end
    of the contig placed before. Contigs below ``min_contig`` letters and chains
    whose blocks have less than ``min_chain`` matched letters are left out. What
    no chain places, :func:`arrange.unplaced` names.
    """
    contigs = contigs.where(F.length("seq") >= min_contig) if min_contig else contigs
    blocks = cluster_diagonals(anchors(ref, contigs, k, stop), ["ref", "ctg"], max_dist, min_cluster)
    chains = glocal_chains(blocks.withColumn("pair", F.concat_ws("\x1f", "ref", "ctg")), "pair")
    if min_chain:
        chains = chains.join(chains.groupBy("pair").agg(F.sum("score").alias("letters")).where(F.col("letters") >= min_chain).select("pair"), "pair", "left_semi")
    best = chains.groupBy("pair").agg(F.min("s1").alias("s1"), F.max("e1").alias("e1"), F.max("chain_score").alias("score"), F.max_by("orient", "score").alias("orient"))
    best = best.select(F.get(F.split("pair", "\x1f"), F.lit(0)).alias("ref"), F.get(F.split("pair", "\x1f"), F.lit(1)).alias("ctg"), "orient", "s1", "e1", "score")
    top = best.withColumn("rank", F.row_number().over(Window.partitionBy("ctg").orderBy(F.col("score").desc(), "ref"))).where("rank = 1").drop("rank")
    line = Window.partitionBy("ref").orderBy("s1", "e1", "ctg")
    return top.withColumn("gap_before", F.col("s1") - F.lag("e1").over(line))


def finish(ref: DataFrame, contigs: DataFrame, gap_size: int = 100, **options) -> DataFrame:
    """``ref, seq``: contigs in order and on the strand of the reference, joined by N; negative gaps become ``gap_size``."""
    placed = place_contigs(ref, contigs, **options).join(contigs.select(F.col("name").alias("ctg"), "seq"), "ctg")
    gap = F.when(F.col("gap_before").isNull(), F.lit(0)).when(F.col("gap_before") < 0, F.lit(gap_size)).when(F.col("gap_before") == 0, F.lit(1)).otherwise(F.col("gap_before"))
    text = F.concat(F.expr("repeat('N', int(gap))"), F.when(F.col("orient") == 1, reverse_complement(F.col("seq"))).otherwise(F.col("seq")))
    rows = placed.withColumn("gap", gap).withColumn("text", text)
    return rows.groupBy("ref").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s1", "e1", "ctg", "text"))), lambda x: x["text"]), "").alias("seq"))


def breakpoints(blocks: DataFrame, partition: list[str]) -> DataFrame:
    """Merged blocks with the borders of the gaps between them and their place on the second axis, as in a BED record."""
    merged = merge_consecutive(blocks, partition)
    w = Window.partitionBy(*partition).orderBy("s1", "e1", "s2")
    rank2 = F.row_number().over(Window.partitionBy(*partition).orderBy("s2", "e2", "s1"))
    return merged.withColumn("segment", rank2).withColumn("last", F.count(F.lit(1)).over(Window.partitionBy(*partition))).withColumn("gap_from", F.lag("e1").over(w)).withColumn("gap_to", F.col("s1"))
