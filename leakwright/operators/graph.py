"""Connected components over an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakwright.sources.shared_tables import discard, stash


def contract(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars of the graph with edges (u, v): every node but the least of its component, and that least one."""
    nodes, code = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = code[: len(u)], code[len(u) :]
    label = np.arange(len(nodes))
    while len(a):
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        apart = low < high
        a, b = a[apart], b[apart]
        np.minimum.at(label, high[apart], low[apart])
        while ((up := label[label]) != label).any():
            label = up
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


#: Edges that one task reduces to stars at once.
EDGES_A_TASK = 1_000_000


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges as stars within each share of EDGES_A_TASK, as a written table.  What fits one share is settled by this alone."""
    whole = stash(edges, "edges")
    fields = whole.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[b.column(c).to_numpy(zero_copy_only=False) for c in ("u", "v")] for b in batches]
        if held:
            kind = [pa.string() if x.dtype == object else pa.from_numpy_dtype(x.dtype) for x in held[0]]
            stars = contract(*(np.concatenate(side) for side in zip(*held)))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(stars, kind)], names=["u", "v"])

    stars = stash(whole.coalesce(max(1, -(-whole.count() // EDGES_A_TASK))).mapInArrow(run, fields), "stars")
    discard(whole)
    return stars


def _star_round(edges: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """One large-star and one small-star step, and the tables made for it; edges run from the larger node u to the smaller v.

    Each step is a minimum per node, which aggregates before its shuffle and is
    written, and a join back.  That join has plain exchanges on both sides, whose
    skewed partitions adaptive execution splits, so a hub does not stay in one task.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = stash(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    large = stash(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), "large-star")
    small = stash(large.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = large.join(small, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(small.select("u", F.col("m").alias("v"))).distinct(), [least, large, small]


def _settled(edges: DataFrame) -> bool:
    """Whether every edge leads straight to a smallest node: no node leads to two, or leads on from another."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("leads")), F.struct(F.col("v").alias("node"), F.lit(0).alias("leads")))).alias("e"))
    nodes = ends.groupBy("e.node").agg(F.sum("e.leads").alias("out"), F.min("e.leads").alias("low"))
    return nodes.where("out > 1 OR (out = 1 AND low = 0)").isEmpty()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges``; the component is its smallest node.

    Shares of the edges are first reduced to stars, each by one task; then large-star and
    small-star steps alternate until only stars are left, in a number of rounds that
    grows with the logarithm of the longest chain.  Each round is written to the
    shared folder, which cuts the lineage.  Edges with a null end and loops link
    nothing: null nodes are left out, loops give a node of its own.  Names of nodes
    are integers or any type with an order.
    """
    a, b = F.col(src), F.col(dst)
    known = edges.select(a.alias("a"), b.alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    loops = known.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("component"))
    now = _contracted(known.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(max_rounds):
        if _settled(now):
            break
        stepped, made = _star_round(now)
        after = _contracted(stepped)
        for table in (now, *made):
            discard(table)
        now = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    linked = now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
    return linked.unionByName(loops).groupBy("node").agg(F.min("component").alias("component"))
