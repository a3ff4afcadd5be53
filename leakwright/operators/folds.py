"""Folds of whole groups with even label shares, from the groups' label counts.

Groups whose label counts are equal are interchangeable: in seeded order they are dealt out
to the folds in turn, as far as they go round, in parallel and exactly.  Fewer than k
groups of each kind are left.  They go one by one, those of the most uneven counts first, to the
fold that is shortest of just their labels.  If they are more than ``BUCKET``, the largest
wait, half a bucket of them, and the others are dealt to buckets that are balanced side by
side; what a bucket gave to a fold is then a group itself, and those and the largest
are balanced in the next round, until one bucket holds them all.

The cost of a fold for a group is the sum over labels of (fold's rows) * (group's rows) *
(10^9 DIV all rows of the label), in whole numbers: the least cost keeps the sum of squares of
the label shares least.  Of equal costs the fold with fewer rows goes first, then the first one.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakwright.functions.naming import unused
from leakwright.functions.ordering import order_key, running_before
from leakwright.sources.shared_tables import stash

#: Groups that one task balances.
BUCKET = 4096
_KIND = "array<struct<label:string,n:bigint>>"


def _greedy(units: list[tuple[str, list[tuple[str, int, int]]]], k: int, n_labels: int) -> list[int]:
    """The fold of each unit, ``(order, [(label, rows, weight)])``, in the order given."""

    def spread(u):
        return n_labels * sum(n * n for _, n, _ in u[1]) - sum(n for _, n, _ in u[1]) ** 2

    held, rows, fold = [{} for _ in range(k)], [0] * k, [0] * len(units)
    for i in sorted(range(len(units)), key=lambda i: (-spread(units[i]), units[i][0])):
        parts = units[i][1]
        best = min(range(k), key=lambda f: (sum(w * n * held[f].get(label, 0) for label, n, w in parts), rows[f], f))
        for label, n, _ in parts:
            held[best][label] = held[best].get(label, 0) + n
            rows[best] += n
        fold[i] = best
    return fold


def _deal(units: DataFrame, k: int, n_labels: int, seed: int, bucket: int) -> DataFrame:
    """``(unit, fold)`` of ``(unit, order, parts)``, parts having label, n and weight."""
    n, bucket = units.count(), max(bucket, 4 * k)
    buckets = max(1, math.ceil(n / bucket))
    large = None
    if buckets > 1:
        size = F.aggregate("parts", F.lit(0).cast("long"), lambda s, x: s + x["n"])
        large = stash(units.orderBy(size.desc(), "unit").limit(bucket // 2), "large-units")
        units = stash(units.join(F.broadcast(large.select("unit")), "unit", "left_anti"), "units")

    def balance(part: pd.DataFrame) -> pd.DataFrame:
        own = [(o, [(x["label"], int(x["n"]), int(x["weight"])) for x in parts]) for o, parts in zip(part["order"], part["parts"])]
        return pd.DataFrame({"unit": part["unit"], "bucket": part["bucket"], "fold": _greedy(own, k, n_labels)})

    placed = units.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "unit"), F.lit(buckets)))
    local = placed.groupBy("bucket").applyInPandas(balance, "unit string, bucket long, fold int")
    if buckets == 1:
        return local.select("unit", "fold")
    local = stash(local, "dealt").withColumn("whole", F.concat_ws("/", F.lit(str(seed)), "bucket", "fold"))
    cells = units.join(local.select("unit", "whole"), "unit").select("whole", F.inline("parts")).groupBy("whole", "label").agg(F.sum("n").alias("n"), F.max("weight").alias("weight"))
    wholes = cells.groupBy("whole").agg(F.array_sort(F.collect_list(F.struct("label", "n", "weight"))).alias("parts"))
    wholes = wholes.select(F.col("whole").alias("unit"), order_key(seed, "whole").alias("order"), "parts")
    above = stash(_deal(stash(wholes.unionByName(large), "units"), k, n_labels, seed + 1, bucket), "above")
    small = local.join(above.select(F.col("unit").alias("whole"), F.col("fold").alias("final")), "whole").select("unit", F.col("final").alias("fold"))
    return small.unionByName(large.select("unit").join(above, "unit"))


def stratified_group_folds(meta: DataFrame, id_col: str, group: str, label: str, k: int = 5, seed: int = 42, bucket: int = BUCKET) -> DataFrame:
    """Adds ``fold``, 0 to k - 1: whole groups, each label spread evenly.

    A row without a group is a group of its own, and null is a label of its own.  Of each
    label, two folds differ by no more than the rows of the largest groups that are dealt
    one by one.  An empty table gives an empty result; a column ``fold`` is replaced.
    """
    name = F.coalesce(F.concat(F.lit("g:"), F.col(group).cast("string")), F.concat(F.lit("row:"), F.col(id_col).cast("string")))
    named = meta.select(name.alias("unit"), F.coalesce(F.concat(F.lit("l:"), F.col(label).cast("string")), F.lit("")).alias("label"))
    cells = stash(named.groupBy("unit", "label").agg(F.count("*").alias("n")), "cells")
    totals = stash(cells.groupBy("label").agg(F.sum("n").alias("total")), "totals")
    n_labels = totals.count()
    weights = totals.select("label", F.expr("1000000000 DIV total").alias("weight"))
    vectors = cells.groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("label", "n"))).alias("vector"))
    vectors = vectors.select("unit", order_key(seed, "unit").alias("order"), F.to_json("vector").alias("vector"))
    sizes = stash(vectors.groupBy("vector").agg(F.count("*").alias("m")), "kinds")
    ranked = running_before(vectors, ["vector"], "order", "unit").join(sizes, "vector")
    ranked = stash(ranked.withColumn("even", F.col("before") < F.col("m") - F.col("m") % k), "ranked")
    left = ranked.where("NOT even").select("unit", "order", F.inline(F.from_json("vector", _KIND))).join(weights, "label")
    left = left.groupBy("unit", "order").agg(F.array_sort(F.collect_list(F.struct("label", "n", "weight"))).alias("parts"))
    rest = _deal(stash(left, "left"), k, n_labels, seed, bucket)
    folds = stash(ranked.where("even").select("unit", (F.col("before") % k).cast("int").alias("fold")).unionByName(rest), "folds")
    unit = unused(meta.columns, "unit")[0]
    return meta.drop("fold").withColumn(unit, name).join(folds.withColumnRenamed("unit", unit), unit).drop(unit)


def splits_from_folds(folds: DataFrame, test: tuple[int, ...] = (0,), val: tuple[int, ...] = (1,)) -> DataFrame:
    """Adds ``split``: the folds named are test and validation, the others train."""
    return folds.withColumn("split", F.when(F.col("fold").isin(*test), "test").when(F.col("fold").isin(*val), "val").otherwise("train"))
