"""Simulated genomes with known homology, and the accuracy of an alignment against it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.operators.graph import Graph


def genomes(spark: SparkSession, n: int, length: int, rate: float, indel: float = 0.1, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """``(path, seq)`` of ``n`` mutated copies of an ancestor, and ``(path, pos, base_id)``, the ancestor position of each letter.

    Inserted letters have ids of their own. Small by purpose: made on the driver.
    """
    rng = np.random.default_rng(seed)
    letters = np.array(list("ACGT"))
    ancestor = rng.integers(0, 4, length)
    seqs, truth, fresh = [], [], length
    for g in range(n):
        out, ids = [], []
        for i, b in enumerate(ancestor):
            if rng.random() >= rate:
                out.append(b)
                ids.append(i)
            elif rng.random() >= indel:
                out.append((b + rng.integers(1, 4)) % 4)
                ids.append(i)
            elif rng.random() < 0.5:
                more = int(min(rng.zipf(1.7), 50))
                out.extend([b, *rng.integers(0, 4, more)])
                ids.extend([i, *range(fresh, fresh + more)])
                fresh += more
        seqs.append((f"g{g}", "".join(letters[out])))
        truth.extend((f"g{g}", p, int(x)) for p, x in enumerate(ids))
    return spark.createDataFrame(seqs, "path string, seq string"), spark.createDataFrame(truth, "path string, pos bigint, base_id bigint")


def aligned_columns(graph: Graph) -> DataFrame:
    """``path, pos, column``: letters of two paths are aligned when they share a node and a place in it."""
    w = Window.partitionBy("path").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    rows = graph.steps.join(graph.nodes.select("node_id", F.length("seq").alias("n")), "node_id")
    rows = rows.withColumn("at", F.coalesce(F.sum("n").over(w), F.lit(0)))
    return rows.where("n > 0").select("path", "node_id", "at", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i")).select("path", (F.col("at") + F.col("i")).alias("pos"), F.xxhash64("node_id", "i").alias("column"))


def accuracy(found: DataFrame, truth: DataFrame) -> DataFrame:
    """``tp, fp, fn, sensitivity, precision, f1`` over pairs of letters of different paths that share a column or a base id."""
    both = found.join(truth, ["path", "pos"])

    def pairs(key: str) -> DataFrame:
        return both.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("n"))

    same = both.groupBy("column", "base_id").agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("tp"))
    rows = same.crossJoin(pairs("column").withColumnRenamed("n", "called")).crossJoin(pairs("base_id").withColumnRenamed("n", "real"))  # three single rows
    out = rows.select("tp", (F.col("called") - F.col("tp")).alias("fp"), (F.col("real") - F.col("tp")).alias("fn"))
    return out.select("*", F.expr("try_divide(tp, tp + fn)").alias("sensitivity"), F.expr("try_divide(tp, tp + fp)").alias("precision"), F.expr("try_divide(2 * tp, 2 * tp + fp + fn)").alias("f1"))


def column_score(found: DataFrame, truth: DataFrame) -> DataFrame:
    """``columns, right, score``: the share of true columns of two letters or more whose letters all lie in one column of ``found``, and no others do."""
    both = truth.join(found, ["path", "pos"])
    size = found.groupBy("column").agg(F.count(F.lit(1)).alias("n"))
    real = truth.groupBy("base_id").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    met = both.groupBy("base_id").agg(F.min("column").alias("column"), F.max("column").alias("other"), F.count(F.lit(1)).alias("k"))
    own = real.join(met, "base_id", "left").join(size, "column", "left")
    good = F.count_if((F.col("column") == F.col("other")) & (F.col("k") == F.col("m")) & (F.col("n") == F.col("m")))
    return own.agg(F.count(F.lit(1)).alias("columns"), good.alias("right")).select("*", F.expr("try_divide(right, columns)").alias("score"))
