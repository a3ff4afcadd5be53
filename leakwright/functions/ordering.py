"""Seeded orders that do not depend on partitioning, and exact ranks in them.

A seeded order is that of ``md5(seed:id)``, which Spark and other engines compute
alike.  Ranks and running sums within a class are built from 4,096 buckets, the first
three hex digits: a class that holds most rows is never sorted in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakwright.functions.naming import unused
from leakwright.sources.shared_tables import stash


def order_key(seed: int | str | Column, *ids: Column | str) -> Column:
    parts = [seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed)), *(i if isinstance(i, Column) else F.col(i) for i in ids)]
    return F.md5(F.concat_ws(":", *(p.cast("string") for p in parts)))


def hash_number(text: Column, digits: int = 8) -> Column:
    """The first hex digits of a text's md5 as a number."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def running_before(rows: DataFrame, by: list[str], key: str, tie: str, value: Column | None = None, name: str = "before") -> DataFrame:
    """Adds the sum of ``value`` (default 1) over the rows of the same ``by`` that come earlier in the order of ``key``, ``tie``."""
    value = F.lit(1) if value is None else value
    keyed = rows.withColumn("__v__", value).withColumn("__bucket__", F.substring(key, 1, 3))
    earlier = Window.partitionBy(*by).orderBy("__bucket__").rowsBetween(Window.unboundedPreceding, -1)
    names = [f"__by{i}__" for i in range(len(by))]
    sums = keyed.groupBy(*by, "__bucket__").agg(F.sum("__v__").alias("__sum__")).withColumn("__base__", F.coalesce(F.sum("__sum__").over(earlier), F.lit(0)))
    sums = sums.select(*(F.col(b).alias(n) for b, n in zip(by, names)), F.col("__bucket__").alias("__b2__"), "__base__")
    inside = Window.partitionBy(*by, "__bucket__").orderBy(key, tie).rowsBetween(Window.unboundedPreceding, -1)
    local = keyed.withColumn("__local__", F.coalesce(F.sum("__v__").over(inside), F.lit(0)))
    match = F.col("__bucket__") == F.col("__b2__")
    for b, n in zip(by, names):
        match &= F.col(b).eqNullSafe(F.col(n))
    return local.join(sums, match).withColumn(name, F.col("__base__") + F.col("__local__")).select(*rows.columns, name)


def largest_remainder(share: Column, total: Column, over: list[str], tie: str) -> Column:
    """Whole numbers near ``share`` that add up to ``total`` within ``over``; the largest remainders are rounded up."""
    part = Window.partitionBy(*over)
    low = F.floor(share)
    rank = F.row_number().over(part.orderBy((share - low).desc(), F.col(tie)))
    return (low + (rank <= total - F.sum(low).over(part)).cast("long")).cast("long")


def in_blocks(rows: DataFrame, by: list[str], order: str, block: str) -> DataFrame:
    """``rows`` as a written table, dealt out by ranges of ``by`` and ``order``, with the number of the range in ``block``.

    What runs along ``order`` within ``by`` is computed in two passes: each block by itself,
    and the blocks' summaries, few rows, in the order of their numbers.  So no task holds
    all rows of one ``by``, however many they are.
    """
    return stash(rows.repartitionByRange(*by, order).withColumn(block, F.spark_partition_id()), "blocks")


def beside(rows: DataFrame, summaries: DataFrame, keys: list[str], keep: list[str]) -> DataFrame:
    """``rows`` with the columns ``keep`` of the summary of their keys, where null is a key of its own."""
    names = unused([*rows.columns, *keep], *(f"of_{k}" for k in keys))
    side = summaries.select(*(F.col(k).alias(n) for k, n in zip(keys, names)), *keep)
    return rows.join(side, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)])).drop(*names)
