"""Training histories: weighted losses, the best epoch, and early stopping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakwright.functions.naming import unused
from leakwright.functions.ordering import beside, in_blocks
from leakwright.sources.shared_tables import stash


def epoch_loss(batches: DataFrame, keys: list[str], loss: str, size: str) -> DataFrame:
    """The mean loss of each key, weighted by batch size."""
    return batches.groupBy(*keys).agg((F.sum(F.col(loss) * F.col(size)) / F.nullif(F.sum(size), F.lit(0))).alias("loss"))


def early_stop_scan(history: DataFrame, run: list[str], epoch: str, value: str, patience: int) -> DataFrame:
    """Adds ``improved`` (strictly above all before), ``best_so_far``, ``epochs_since_best`` and ``ran``.

    The patience counter runs on across stages.  ``ran`` is false for epochs after the
    first at which the counter reached ``patience``.

    A segmented prefix scan: histories are dealt out in ranges of run and epoch; each
    range is scanned by itself, starting from what the ranges before it in the run
    sum up to, first their greatest value and length, then their last improvement, then
    the first stop.  A run of any length is spread over as many tasks as it has ranges.
    A null value improves nothing but counts as an epoch that does, as the first one does.
    """
    block, n, first, ever, last, upto, stop = unused([*history.columns, "improved", "best_so_far", "epochs_since_best", "ran"], "block", "n", "first", "ever", "last", "upto", "stop")
    keys = [*run, block]
    rows = in_blocks(history, run, epoch, block)
    earlier = Window.partitionBy(*run).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys).agg(F.max(value).alias(upto), F.count("*").alias(n))
    starts = sums.select(*keys, F.max(upto).over(earlier).alias(ever), F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(first))
    order = Window.partitionBy(*keys).orderBy(epoch)
    before, now = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    scanned = beside(rows, starts, keys, [ever, first])
    known = F.greatest(F.col(ever), F.max(value).over(before))
    scanned = scanned.withColumn("improved", F.coalesce(F.col(value) > known, F.lit(True))).withColumn("best_so_far", F.greatest(F.col(ever), F.max(value).over(now)))
    scanned = scanned.withColumn(n, F.col(first) + F.row_number().over(order))
    scanned = stash(scanned.withColumn(last, F.max(F.when(F.col("improved"), F.col(n))).over(now)).drop(ever, first), "scanned")
    ends = scanned.groupBy(*keys).agg(F.max(last).alias(upto))
    ends = stash(ends.select(*keys, F.max(upto).over(earlier).alias(ever)), "ends")
    since = (F.col(n) - F.coalesce(F.col(last), F.col(ever))).cast("long")
    stops = beside(scanned, ends, keys, [ever]).where(since >= patience).groupBy(*run).agg(F.min(n).alias(stop))
    full = ends.join(stops.select(*(F.col(r).alias(f"{stop}{i}") for i, r in enumerate(run)), stop), reduce(Column.__and__, [F.col(r).eqNullSafe(F.col(f"{stop}{i}")) for i, r in enumerate(run)], F.lit(True)), "left")
    found = beside(scanned, full, keys, [ever, stop]).withColumn("epochs_since_best", since).withColumn("ran", F.coalesce(F.col(n) <= F.col(stop), F.lit(True)))
    return found.select(*history.columns, "improved", "best_so_far", "epochs_since_best", "ran")


def best_epoch(history: DataFrame, run: list[str], epoch: str, value: str, patience: int) -> DataFrame:
    """For each run: the best epoch and value of those that ran, and the last that ran."""
    ran = early_stop_scan(history, run, epoch, value, patience).where("ran")
    best = F.max(F.struct(F.col(value).alias("v"), (-F.col(epoch)).alias("e")))
    return ran.groupBy(*run).agg(best.alias("b"), F.max(epoch).alias("stop_epoch")).select(*run, (-F.col("b.e")).alias("best_epoch"), F.col("b.v").alias("best_value"), "stop_epoch")
