"""Connected components: forests of blocks of edges, then alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.session import discard, materialise

#: Edges of a block, whose components are found in memory.
BLOCK_EDGES = 1 << 18


def lowest(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """For each of the nodes 0 .. n - 1 the smallest one that the edges connect it with: roots are hung on smaller ones, then paths halved."""
    up = np.arange(n)
    while True:
        a, b = up[u], up[v]
        apart = a != b
        if not apart.any():
            return up
        np.minimum.at(up, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while not np.array_equal(up, up[up]):
            up = up[up]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges in blocks of bounded size, each block's replaced by an edge from every node to the smallest of its component there."""

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        ends = pa.concat_arrays([c for i in (0, 1) for c in table.column(i).chunks])
        names = pc.unique(ends)
        names = names.take(pc.array_sort_indices(names))
        at = pc.index_in(ends, names).to_numpy(zero_copy_only=False)
        low = lowest(at[: len(table)], at[len(table) :], len(names))
        own = np.flatnonzero(low != np.arange(len(low)))
        return pa.RecordBatch.from_arrays([names.take(pa.array(own)), names.take(pa.array(low[own]))], ["u", "v"])

    held, rows = [], 0
    for rb in batches:
        held.append(rb)
        rows += len(rb)
        if rows >= BLOCK_EDGES:
            yield block(held)
            held, rows = [], 0
    if rows:
        yield block(held)


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r.n, r.h


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of an undirected edge list.

    ``component`` is the smallest node reachable. Blocks of edges become stars
    first, where they lie, so that what a block connects takes no round. Every
    round only keeps edges that point to smaller nodes, so the table never grows
    beyond the edge count; minima are combined on the map side and a hot node's
    edges are an ordinary skewed join. Self loops and null ends are ignored,
    repeated edges count once, an empty edge list gives an empty result.
    """
    a, b = F.col(src), F.col(dst)
    e = edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    e = materialise(e.mapInArrow(_stars, e.schema).distinct(), "cc")
    state = _state(e)
    for _ in range(max_rounds):
        if not state[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, e = e, materialise(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "cc", rows=2 * state[0])
        discard(old)
        was, state = state, _state(e)
        if was == state:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
