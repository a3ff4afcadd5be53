"""Approximate nearest neighbours by cosine: a random-projection forest over all rows.

Each tree splits the vectors at the median of their projections on a direction between
two of them, level after level, until a leaf holds about ``leaf`` vectors.  Medians are
taken over a bounded sample of each node, ``SAMPLE`` rows that are first by a hash;
every row is then placed.  A round lays out ``ROUND`` levels; nodes that are still too large go
through another round with a sample of their own, so trees grow as deep as the table
asks, and a dense region is halved like any other.  Vectors of one leaf are compared with
each other by one matrix product: a row meets about ``trees * leaf`` others, however
many there are.

Two vectors at an angle a are parted by a split with a chance of about a / pi, so they share
a leaf of one of t trees of depth d with ``1 - (1 - (1 - a / pi)^d)^t``; ``trees_for``
takes the least t that reaches the recall asked for.

``indexed_pairs`` grows its trees in two parts, so that few copies of a vector are sent.  Trees
over all rows end in ``CELLS`` cells, or in as many as keep a cell near ``CELL`` rows; a cell
goes to one task, which splits it further by several trees of its own.  Up to ``CELLS * CELL`` distinct
vectors the trees over all rows have one depth, hence one number for a threshold and a
recall: what is sent is in proportion to the rows.  Equal vectors are one class first
and enter the trees once; so copies fill no leaf.

Defined cases: null ids and vectors are left out; rows with equal ids are one if their
vectors are equal, and are never paired with each other; vectors of zeros are near nothing; an empty table gives an empty result;
vectors must have one length.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leakwright.sources.shared_tables import stash

#: Rows that the splits of a node are fitted on, levels of a round, and rounds at most.
SAMPLE, ROUND, MAX_ROUNDS = 4096, 6, 8
#: Fitted nodes of up to so many bytes are broadcast, more are joined.
BROADCAST_BYTES = 64 << 20
#: Rows of a leaf that are compared with it at once.
CHUNK = 1024
#: Cells that the trees over all rows end in, at least, and rows of a cell beyond which there are more of them.
CELLS, CELL = 32, 1 << 16
#: The chance, at least, that the trees inside a cell find a pair that lies in it.
CELL_RECALL = 0.9


def trees_for(n: int, threshold: float, recall: float, leaf: int) -> int:
    """Trees that find pairs at ``threshold`` with a chance of ``recall``."""
    return _times(_together(n, threshold, leaf), recall)


def _together(n: int, threshold: float, leaf: int) -> float:
    """The chance that a tree over n rows leaves a pair at ``threshold`` in one leaf."""
    depth = max(0, math.ceil(math.log2(max(1, n) / leaf)))
    return (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** depth


def _times(chance: float, recall: float) -> int:
    return 1 if chance > 1 - 1e-9 else max(1, math.ceil(math.log(1 - recall) / math.log(1 - chance)))


def layout(n: int, threshold: float, recall: float, leaf: int) -> tuple[int, int, int]:
    """``(trees, cell, inner)``: trees over all rows, rows of their cells, and trees inside a cell, which together reach ``recall``."""
    cell = max(leaf, min(CELL, math.ceil(n / CELLS)))
    if cell == leaf:
        return trees_for(n, threshold, recall, leaf), leaf, 1
    # A cell has up to twice its rows.
    inner = trees_for(2 * cell, threshold, CELL_RECALL, leaf)
    found = 1 - (1 - _together(2 * cell, threshold, leaf)) ** inner
    return _times(_together(n, threshold, cell) * found, recall), cell, inner


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def fit_splits(points: np.ndarray, levels: int, seed: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Directions and medians of a full tree of ``levels``; node i has children 2i + 1 and 2i + 2."""
    rng = np.random.default_rng(seed)
    n_nodes = (1 << levels) - 1
    directions, cuts = np.zeros((n_nodes, points.shape[1])), np.zeros(n_nodes)
    members = {0: np.arange(len(points))}
    for node in range(n_nodes):
        own = members.pop(node, np.zeros(0, dtype=np.int64))
        if len(own) >= 2:
            one, two = points[rng.choice(own, 2, replace=False)]
            directions[node] = one - two
        if not directions[node].any():
            directions[node] = rng.normal(size=points.shape[1])
        along = points[own] @ directions[node]
        cuts[node] = np.median(along) if len(own) else 0.0
        right = along > cuts[node]
        members[2 * node + 1], members[2 * node + 2] = own[~right], own[right]
    return directions, cuts


def place(points: np.ndarray, directions: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The leaf, from 0, of each point."""
    node = np.zeros(len(points), dtype=np.int64)
    while len(points) and node[0] < len(cuts):
        node = 2 * node + 1 + (np.einsum("ij,ij->i", points, directions[node]) > cuts[node])
    return node - len(cuts)


def vector_classes(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame]:
    """``(rep, v)``, a row for each distinct vector with its least id, and ``(rep, id)`` of the other ids, as written tables."""
    known = vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    classes = stash(known.groupBy("v").agg(F.min("id").alias("rep")).select("rep", "v"), "classes")
    members = known.join(classes, "v").where("id > rep").select("rep", "id").distinct()
    return classes, stash(members, "members")


def forest(classes: DataFrame, trees: int, leaf: int = 512, seed: int = 42) -> DataFrame:
    """``(tree, node, rep, v)``: every vector in its leaf of every tree, as a written table."""
    numbers = F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")
    open_nodes = classes.select(numbers, F.lit("").alias("node"), "rep", "v")
    out, done = None, False
    for step in range(MAX_ROUNDS + 1):
        sizes = open_nodes.groupBy("tree", "node").agg(F.count("*").alias("size"))
        sizes = stash(sizes, "sizes")
        large = sizes.where(F.col("size") > 2 * leaf)
        n_large = large.count() if step < MAX_ROUNDS else 0
        done = n_large == 0
        small = open_nodes if done else open_nodes.join(_sized(sizes.where(F.col("size") <= 2 * leaf).select("tree", "node"), 1 << 20), ["tree", "node"], "left_semi")
        out = small if out is None else out.unionByName(small)
        if done:
            break
        open_nodes = stash(_split(open_nodes, large, n_large, leaf, [seed, step]), "nodes")
    return out


def _sized(small: DataFrame, most: int) -> DataFrame:
    return F.broadcast(small) if small.count() <= most else small


def _split(rows: DataFrame, large: DataFrame, n_large: int, leaf: int, seed: list[int]) -> DataFrame:
    """The rows of large nodes, in their children."""
    order = F.pmod(F.xxhash64(F.lit(seed[0]), F.lit(seed[1]), "tree", "rep"), F.lit(1 << 30))
    few = _sized(large, 1 << 20)
    met = rows.join(few, ["tree", "node"])
    sample = met.where(order * F.col("size") < F.lit((1 << 30) * SAMPLE)).select("tree", "node", "size", order.alias("order"), "v")

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("order", kind="stable")
        levels = min(ROUND, max(1, math.ceil(math.log2(part["size"].iloc[0] / leaf))))
        model = fit_splits(_unit(np.stack(part["v"].map(np.asarray).to_list()).astype(np.float64)), levels, [*seed, int(part["tree"].iloc[0])])
        return pd.DataFrame({"tree": part["tree"].iloc[:1], "node": part["node"].iloc[:1], "model": [pickle.dumps(model)]})

    models = stash(sample.groupBy("tree", "node").applyInPandas(fit, "tree int, node string, model binary"), "models")
    size = models.agg(F.sum(F.length("model"))).first()[0] or 0
    names = [f.name for f in rows.schema]
    schema = rows.schema
    if size <= BROADCAST_BYTES:
        known = {(r["tree"], r["node"]): pickle.loads(bytes(r["model"])) for r in models.collect()}
        shared = rows.sparkSession.sparkContext.broadcast(known)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                tree, node = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                yield _placed(batch, tree, node, lambda key: shared.value[key], names)

        return met.select(*names).mapInArrow(run, schema)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tree, node, raw = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(len(names))
            first = {}
            for i, key in enumerate(zip(tree, node)):
                first.setdefault(key, i)
            yield _placed(batch, tree, node, lambda key: pickle.loads(raw[first[key]].as_py()), names)

    return rows.join(models, ["tree", "node"]).select(*names, "model").mapInArrow(joined, schema)


def _placed(batch: pa.RecordBatch, tree: list, node: list, model_of, names: list[str]) -> pa.RecordBatch:
    """A batch of (tree, node, rep, v, ...) with the nodes of the children."""
    points = _unit(_matrix(batch.column(3)))
    groups: dict[tuple, list[int]] = {}
    for i, key in enumerate(zip(tree, node)):
        groups.setdefault(key, []).append(i)
    new = list(node)
    for key, own in groups.items():
        for i, child in zip(own, place(points[own], *model_of(key)).tolist()):
            new[i] = f"{key[1]}.{child}"
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.string()), batch.column(2), batch.column(3)], names=names)


def leaves(points: np.ndarray, leaf: int, rng: np.random.Generator) -> Iterator[np.ndarray]:
    """Ascending places of the points of each leaf of one tree over points that fit a task; leaves have ``2 * leaf`` points at most, or points that no split parts."""
    levels = math.ceil(math.log2(len(points) / leaf)) if len(points) > 2 * leaf else 0
    open_nodes = [(np.arange(len(points)), levels)]
    while open_nodes:
        own, left = open_nodes.pop()
        right = None
        if len(own) > (leaf if left > 0 else 2 * leaf):
            for attempt in range(4):
                one, two = points[rng.choice(own, 2, replace=False)]
                direction = one - two if attempt < 2 and (one != two).any() else rng.normal(size=points.shape[1])
                along = points[own] @ direction
                right = along > np.median(along)
                if right.any():
                    break
        if right is None or not right.any():
            yield own
        else:
            open_nodes += [(own[right], left - 1), (own[~right], left - 1)]


def _near(points: np.ndarray, own: np.ndarray, threshold: float, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(i, j, sim)`` of the k nearest of each point of a leaf among the others, at ``threshold`` or above; ties by place."""
    inside = points[own]
    for low in range(0, len(own), CHUNK):
        sim = inside[low : low + CHUNK] @ inside.T
        hit = sim >= threshold
        each = np.arange(len(sim))
        hit[each, low + each] = False
        many = np.flatnonzero(hit.sum(1) > k)
        if len(many):
            best = np.argsort(np.where(hit[many], -sim[many], np.inf), axis=1, kind="stable")[:, :k]
            hit[many] = False
            hit[many[:, None], best] = True
        i, j = np.nonzero(hit)
        yield own[low + i], own[j], sim[i, j]


def cell_neighbours(points: np.ndarray, k: int, threshold: float, inner: int, leaf: int, seed: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(i, j, sim)`` of the k nearest of each point that ``inner`` trees over the points of a cell find."""
    found = [part for t in range(inner) for own in leaves(points, leaf, np.random.default_rng([*seed, t])) for part in _near(points, own, threshold, k)]
    i, j, sim = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((-sim, j, i))
    i, j, sim = i[order], j[order], sim[order]
    new = np.ones(len(i), dtype=bool)
    new[1:] = (i[1:] != i[:-1]) | (j[1:] != j[:-1])
    i, j, sim = i[new], j[new], sim[new]
    order = np.lexsort((j, -sim, i))
    i, j, sim = i[order], j[order], sim[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[keep], j[keep], sim[keep]


def indexed_neighbours(classes: DataFrame, k: int, threshold: float, trees: int, leaf: int = 512, seed: int = 42, cell: int | None = None, inner: int = 1) -> DataFrame:
    """``(src, dst, sim, place)``: of each distinct vector its k nearest that the forest finds, at ``threshold`` or above; ties by id.

    The trees end in cells of about ``cell`` rows, each of which is split to ``leaf`` by ``inner`` trees in its task.
    """
    placed = forest(classes, trees, cell or leaf, seed)
    kind = classes.schema["rep"].dataType.simpleString()

    def nearest(part: pa.Table) -> pa.Table:
        order = pc.sort_indices(part["rep"])
        ids = part["rep"].take(order)
        points = _unit(_matrix(part["v"])[order.to_numpy()])
        own = [seed, part["tree"][0].as_py(), zlib.crc32(part["node"][0].as_py().encode())]
        i, j, sim = cell_neighbours(points, k, threshold, inner, leaf, own)
        return pa.table({"src": ids.take(pa.array(i)), "dst": ids.take(pa.array(j)), "sim": sim})

    met = placed.groupBy("tree", "node").applyInArrow(nearest, f"src {kind}, dst {kind}, sim double")
    pairs = met.groupBy("src", "dst").agg(F.max("sim").alias("sim"))
    order = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("sim"), "dst"))
    return pairs.withColumn("place", order).where(F.col("place") <= k)


def indexed_pairs(vectors: DataFrame, id_col: str, vec_col: str, threshold: float, k: int = 5, recall: float = 0.99, leaf: int = 512, trees: int | None = None, seed: int = 42) -> DataFrame:
    """``(id_a, id_b, cosine, copy)`` of distinct vectors at ``threshold`` or above where either is among the other's k nearest, and of each copy with the least id of its vector.

    The approximate form of ``pairs.cosine_pairs``: of such pairs of distinct vectors a
    share of about ``recall`` or more is found, copies all are.
    """
    classes, members = vector_classes(vectors, id_col, vec_col)
    n = classes.count()
    least, cell, inner = layout(n, threshold, recall, leaf)
    near = indexed_neighbours(classes, k, threshold, trees or least, leaf, seed, cell, inner)
    found = near.groupBy(F.least("src", "dst").alias("id_a"), F.greatest("src", "dst").alias("id_b")).agg(F.round(F.max("sim"), 5).alias("cosine"))
    return found.withColumn("copy", F.lit(False)).unionByName(members.select(F.col("rep").alias("id_a"), F.col("id").alias("id_b"), F.lit(1.0).alias("cosine"), F.lit(True).alias("copy")))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: ``exact`` pairs, how many of them were ``found``, and the share."""
    hit = exact.select("id_a", "id_b").distinct().join(found.select("id_a", "id_b").distinct().withColumn("hit", F.lit(1)), ["id_a", "id_b"], "left")
    return hit.agg(F.count("*").alias("pairs"), F.count("hit").alias("found")).withColumn("recall", F.col("found") / F.nullif("pairs", F.lit(0)))
