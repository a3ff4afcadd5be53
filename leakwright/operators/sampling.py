"""Seeded samples: contaminated test sets, weighted draws, heads of classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakwright.functions.naming import unused
from leakwright.functions.ordering import in_blocks, order_key, running_before
from leakwright.sources.shared_tables import small_side


def contaminate_sweep(test: DataFrame, donors: DataFrame, id_col: str, label: str, rates: list[float], draws: int = 1, seed: int = 42) -> DataFrame:
    """The test set of every rate and draw: rows swapped for donors of the same label, its size and mix unchanged.

    Of each label min(round_half_even(n * rate), donors) rows go, and as many donors
    come, both in the seeded order of the draw.  Rate 0 is drawn once.  All rates and
    draws are one plan, with (rate, draw) as keys; adds rate, draw, from_donors and
    ``achieved``, the share that was swapped.
    """
    spark = test.sparkSession
    grid = spark.createDataFrame([(float(r), d) for r in rates for d in range(draws if r > 0 else 1)], "rate double, draw int")
    n_test = test.groupBy(F.col(label).alias("__of__")).agg(F.count("*").alias("n"))
    n_donor = donors.groupBy(F.col(label).alias("__from__")).agg(F.count("*").alias("m"))
    swap = F.least(F.bround(F.col("n") * F.greatest("rate", F.lit(0.0)), 0).cast("long"), F.coalesce("m", F.lit(0)))
    quotas = n_test.join(n_donor, F.col("__of__").eqNullSafe(F.col("__from__")), "left").join(F.broadcast(grid)).select("rate", "draw", "__of__", "n", swap.alias("swap"))
    every = Window.partitionBy("rate", "draw")
    quotas = small_side(quotas.withColumn("achieved", F.sum("swap").over(every) / F.sum("n").over(every)), "quotas")
    ids = F.broadcast(grid.select("draw").distinct())

    def ranked(rows: DataFrame) -> DataFrame:
        keyed = rows.join(ids).withColumn("__key__", order_key(seed, "draw", id_col))
        return running_before(keyed, ["draw", label], "__key__", id_col).withColumnRenamed("draw", "__draw__")

    def dealt(rows: DataFrame, come: bool) -> DataFrame:
        match = (F.col("__draw__") == F.col("draw")) & F.col(label).eqNullSafe(F.col("__of__"))
        chosen = F.col("before") < F.col("swap") if come else F.col("before") >= F.col("swap")
        return ranked(rows).join(quotas, match).where(chosen).select(*rows.columns, "rate", "draw", "achieved", F.lit(come).alias("from_donors"))

    shared = [c for c in test.columns if c in donors.columns]
    return dealt(test.select(*shared), False).unionByName(dealt(donors.select(*shared), True))


def contaminate(test: DataFrame, donors: DataFrame, id_col: str, label: str, rate: float, seed: int = 42) -> DataFrame:
    """One contaminated test set."""
    return contaminate_sweep(test, donors, id_col, label, [rate], 1, seed)


def head_per_class(rows: DataFrame, label: str, id_col: str, n: int) -> DataFrame:
    """The first n rows of each class by id."""
    place = F.row_number().over(Window.partitionBy(label).orderBy(id_col))
    return rows.withColumn("__place__", place).where(F.col("__place__") <= n).drop("__place__")


def weighted_draws(rows: DataFrame, id_col: str, label: str, weights: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` draws with replacement, a row's chance in proportion to its class's weight: ``(draw, id, label)``.

    ``weights`` is ``(label, weight)``.  A draw picks a class from the running shares of
    a table with one row a class, then a rank in it; rows are found by class and rank.
    """
    ranked = running_before(rows.withColumn("__key__", order_key(seed, id_col)), [label], "__key__", id_col).select(F.col(label).alias("__of__"), F.col("before").alias("__rank__"), F.col(id_col).alias("id"))
    mass = rows.groupBy(label).agg(F.count("*").alias("n")).join(weights, label).withColumn("mass", F.col("n") * F.col("weight"))
    order, every = Window.orderBy(label), Window.partitionBy()
    high = F.sum("mass").over(order) / F.sum("mass").over(every)
    shares = small_side(mass.withColumn("high", high).withColumn("low", F.coalesce(F.lag(high).over(order), F.lit(0.0))), "shares")
    uniform = lambda salt: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(salt), F.col("id").cast("string"))), 1, 12), 16, 10).cast("double") / float(16**12)
    draws = rows.sparkSession.range(n).select(F.col("id").alias("draw"), uniform("class").alias("u"), uniform("row").alias("v"))
    picked = draws.join(shares, (F.col("u") >= F.col("low")) & (F.col("u") < F.col("high"))).select("draw", F.col(label).alias("__of__"), F.floor(F.col("v") * F.col("n")).alias("__rank__"))
    return picked.join(ranked, ["__of__", "__rank__"]).select("draw", "id", F.col("__of__").alias(label))


def weighted_sample(rows: DataFrame, id_col: str, weight: Column | str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, each drawn in proportion to its weight among those not drawn yet.

    Efraimidis and Spirakis: of -ln(u) / weight, u from the md5 of seed and id, the n least
    are the sample.  Rows are dealt out by ranges of that number; whole ranges are taken up
    to the one in which the n-th lies, and there the rows are ranked.  So neither the driver
    nor one task holds the sample, and what was drawn for parts of a table can be drawn
    from again.  Rows without a weight above 0 are never drawn; adds nothing to the columns.
    """
    weight = F.col(weight) if isinstance(weight, str) else weight
    key, part = unused(rows.columns, "key", "part")
    u = (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"))), 1, 12), 16, 10).cast("double") + 1) / float(16**12 + 1)
    dealt = in_blocks(rows.where(weight > 0).withColumn(key, -F.log(u) / weight), [], key, part)
    sizes = dealt.groupBy(part).agg(F.count("*").alias("size"))
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    rest = sizes.select(F.col(part).alias("of"), (n - F.coalesce(F.sum("size").over(earlier), F.lit(0))).alias("rest"), "size").where("rest > 0")
    met = dealt.join(F.broadcast(rest), F.col(part) == F.col("of"))
    whole = met.where("size <= rest").select(*rows.columns)
    place = F.row_number().over(Window.partitionBy(part).orderBy(key, id_col))
    edge = met.where("size > rest").withColumn("of", place).where(F.col("of") <= F.col("rest")).select(*rows.columns)
    return whole.unionByName(edge)
