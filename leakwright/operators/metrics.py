"""Classification metrics, all from one table of confusion counts.

A prediction table shuffles once, to ``(y_true, y_pred, n)``: classes squared rows at
most.  What follows works on those rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("accuracy", "balanced_accuracy", "macro_f1", "weighted_f1")


def confusion_counts(preds: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    return preds.groupBy(F.col(y_true).alias("y_true"), F.col(y_pred).alias("y_pred")).agg(F.count("*").alias("n"))


def _per_label(counts: DataFrame) -> DataFrame:
    """``(label, tp, fp, fn)`` of every label that is true or predicted somewhere."""
    sides = counts.select(F.explode(F.array(F.struct(F.col("y_true").alias("label"), F.lit(True).alias("true")), F.struct(F.col("y_pred").alias("label"), F.lit(False).alias("true")))).alias("s"), "n", (F.col("y_true") == F.col("y_pred")).alias("hit"))
    on = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    true = F.col("s.true")
    return sides.groupBy(F.col("s.label").alias("label")).agg(on(true & F.col("hit")).alias("tp"), on(~true & ~F.col("hit")).alias("fp"), on(true & ~F.col("hit")).alias("fn"))


def _rate(part: Column, whole: Column) -> Column:
    return F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0))


def _f1() -> Column:
    return _rate(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))


def overall_metrics(preds: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """One row: accuracy, balanced accuracy (labels that are true somewhere), macro F1 (true or predicted) and weighted F1."""
    per = _per_label(confusion_counts(preds, y_true, y_pred)).withColumn("support", F.col("tp") + F.col("fn"))
    total = F.nullif(F.sum("support"), F.lit(0))
    recall = F.when(F.col("support") > 0, F.col("tp") / F.nullif("support", F.lit(0)))
    return per.agg(
        F.coalesce(F.sum("support"), F.lit(0)).cast("long").alias("n"),
        F.coalesce(F.sum("tp") / total, F.lit(0.0)).alias("accuracy"),
        F.coalesce(F.avg(recall), F.lit(0.0)).alias("balanced_accuracy"),
        F.coalesce(F.avg(_f1()), F.lit(0.0)).alias("macro_f1"),
        F.coalesce(F.sum(_f1() * F.col("support")) / total, F.lit(0.0)).alias("weighted_f1"),
    )


def _class_table(preds: DataFrame, classes: list) -> DataFrame:
    kind = preds.sparkSession.createDataFrame([(k, c) for k, c in enumerate(classes)], ["position", "label"])
    return F.broadcast(kind.withColumn("position", F.col("position").cast("int")))


def per_class_report(preds: DataFrame, classes: list, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Precision, recall, F1 and support of every class given, whether it occurs or not."""
    per = _per_label(confusion_counts(preds, y_true, y_pred))
    full = _class_table(preds, classes).join(per, "label", "left").select("label", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("tp", "fp", "fn")))
    return full.select(F.col("label").alias("class"), F.round(_rate(F.col("tp"), F.col("tp") + F.col("fp")), 4).alias("precision"), F.round(_rate(F.col("tp"), F.col("tp") + F.col("fn")), 4).alias("recall"), F.round(_f1(), 4).alias("f1"), (F.col("tp") + F.col("fn")).alias("support"))


def confusion_matrix(preds: DataFrame, classes: list, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """``(y_true, y_pred, n, share)`` for all classes squared; shares are of the row, at least 1."""
    grid = _class_table(preds, classes).select(F.col("label").alias("y_true")).join(_class_table(preds, classes).select(F.col("label").alias("y_pred")))
    full = grid.join(confusion_counts(preds, y_true, y_pred), ["y_true", "y_pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.withColumn("share", F.round(F.col("n") / F.greatest(F.sum("n").over(Window.partitionBy("y_true")), F.lit(1)), 4))


def class_recall(preds: DataFrame, label, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """One row: the recall of one class; null where it has no rows."""
    hit = F.when(F.col(y_true) == label, (F.col(y_pred) == F.col(y_true)).cast("double"))
    return preds.agg(F.avg(hit).alias("recall"), F.count(hit).alias("support"))


def class_weights(rows: DataFrame, label: str, classes: list) -> DataFrame:
    """``(label, weight)``: inverse to frequency, 1 for an absent class, then scaled to a mean of 1."""
    counts = rows.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    full = _class_table(rows, classes).join(counts, "label", "left")
    raw = F.coalesce(F.sum("n").over(Window.partitionBy()) / (len(classes) * F.col("n")), F.lit(1.0))
    return full.withColumn("raw", raw).select("label", (F.col("raw") / F.avg("raw").over(Window.partitionBy())).alias("weight"))


def row_weights(rows: DataFrame, label: str, classes: list) -> DataFrame:
    """``rows`` with the weight of their class."""
    weights = class_weights(rows, label, classes).select(F.col("label").alias("__label__"), "weight")
    return rows.join(F.broadcast(weights), F.col(label) == F.col("__label__"), "left").drop("__label__")


#: Ways to meet imbalance: weigh the loss by class, draw rows by weight, or neither.
STRATEGIES = ("class_weights", "weighted_sampler", "none")


def imbalance_weights(rows: DataFrame, label: str, classes: list, strategy: str) -> DataFrame:
    """``(label, weight)`` for ``class_weights``, ``rows`` with ``weight`` for ``weighted_sampler``, and for ``none`` classes of weight 1."""
    if strategy not in STRATEGIES:
        raise ValueError(f"{strategy} is none of {STRATEGIES}")
    if strategy == "weighted_sampler":
        return row_weights(rows, label, classes)
    weights = class_weights(rows, label, classes)
    return weights if strategy == "class_weights" else weights.withColumn("weight", F.lit(1.0))


def _log_factorial(k: Column) -> Column:
    """ln k! by Stirling's series at k + 16; alike in any engine to about 1e-15 of its size."""
    x = k + 16.0
    series = (x + 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3.0))) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    return series - sum((F.log(k + float(i)) for i in range(2, 17)), F.log(k + 1.0))


#: Pairs of uniform numbers that a binomial number may take; the chance that none will do is below 10^-15.
ATTEMPTS, EARLY = 32, 4


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def binomial_draw(n: Column, p: Column, uniform) -> Column:
    """A binomial number of ``n`` trials at ``p``, from ``uniform(attempt, 0 or 1)``, numbers in [0, 1).

    Where fewer than 10 successes are expected (of the rarer outcome), by adding up the chances
    of 0, 1, 2, ... until the first number is reached.  Else by transformed rejection
    (Hormann, 1993): pairs of numbers are tried until one falls under the curve of the
    chances.  So a draw takes a bounded number of steps, whatever ``n`` is.
    """

    def rare(c: Column) -> Column:
        start = F.struct(F.exp(c["n"] * F.log(1 - c["r"])).alias("next"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("below"))
        first = uniform(F.lit(0), 0)

        def add(state: Column, k: Column) -> Column:
            total = state["sum"] + state["next"]
            return F.struct((state["next"] * (c["n"] - k) / (k + 1) * c["r"] / (1 - c["r"])).alias("next"), total.alias("sum"), (state["below"] + F.when(total < first, 1.0).otherwise(0.0)).alias("below"))

        return F.least(c["n"], F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: k.cast("double")), start, add, lambda state: state["below"]))

    def usual(c: Column) -> Column:
        spread = F.sqrt(c["n"] * c["r"] * (1 - c["r"]))
        shape = lambda s: F.struct(*(c[x].alias(x) for x in ("n", "r")), s.alias("s"), (1.15 + 2.53 * s).alias("b"), F.floor((c["n"] + 1) * c["r"]).cast("double").alias("m"))

        def tried(g: Column) -> Column:
            b = g["b"]
            a, right, scale = -0.0873 + 0.0248 * b + 0.01 * g["r"], 0.92 - 4.2 / b, (2.83 + 5.1 / b) * g["s"]
            level = _log_factorial(g["m"]) + _log_factorial(g["n"] - g["m"])

            def attempt(i: Column) -> Column:
                u, v = uniform(i, 0) - 0.5, uniform(i, 1)
                edge = 0.5 - F.abs(u)
                k = F.floor((2 * a / edge + b) * u + g["n"] * g["r"] + 0.5).cast("double")
                under = lambda k: F.log(v * scale / (a / (edge * edge) + b)) <= level - _log_factorial(k) - _log_factorial(g["n"] - k) + (k - g["m"]) * F.log(g["r"] / (1 - g["r"]))
                return _let(k, lambda k: F.when((edge >= 0.07) & (v <= right) | (k >= 0) & (k <= g["n"]) & under(k), k))

            # Later attempts are made only if none of the earlier ones will do.
            first = lambda low, high: F.get(F.filter(F.transform(F.sequence(F.lit(low), F.lit(high - 1)), attempt), lambda k: k.isNotNull()), F.lit(0))
            return F.coalesce(first(0, EARLY), first(EARLY, ATTEMPTS), g["m"])

        return _let(_let(spread, shape), tried)

    least = F.when(p > 0.5, 1 - p).otherwise(p)
    rarer = _let(F.struct(n.cast("double").alias("n"), least.alias("r")), lambda c: F.when(c["r"] <= 0, F.lit(0.0)).when(c["n"] * c["r"] < 10, rare(c)).otherwise(usual(c)))
    return F.when(p > 0.5, n - rarer).otherwise(rarer).cast("long")


def resamples(counts: DataFrame, iterations: int, seed: int = 42) -> DataFrame:
    """``(draw, y_true, y_pred, n)``: confusion counts of resamples of the rows with replacement.

    A resample of n rows is a multinomial draw over the cells, which is drawn cell by cell in
    order: of the rows that are left, a binomial number by the cell's share of the
    cells that are left, from numbers in [0, 1) that are the md5 of seed, draw, cell and attempt.
    """
    known = counts.where("y_true IS NOT NULL AND y_pred IS NOT NULL")
    cells = known.agg(F.array_sort(F.collect_list(F.struct("y_true", "y_pred", "n"))).alias("cells"), F.sum("n").alias("rows"))
    draws = counts.sparkSession.range(iterations).select(F.col("id").alias("draw")).join(F.broadcast(cells)).where("rows > 0")

    def uniform(cell: Column):
        named = lambda i: F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("draw").cast("string"), cell.cast("string"), i.cast("string")))
        return lambda i, half: F.conv(F.substring(named(i), 12 * half + 1, 12), 16, 10).cast("double") / float(16**12)

    start = F.struct(F.col("rows").alias("left"), F.col("rows").alias("mass"), F.array().cast("array<bigint>").alias("out"))

    def take(state: Column, cell: Column) -> Column:
        n = binomial_draw(state["left"], cell["n"].cast("double") / state["mass"], uniform(F.size(state["out"])))
        return F.struct((state["left"] - n).alias("left"), (state["mass"] - cell["n"]).alias("mass"), F.concat(state["out"], F.array(n)).alias("out"))

    drawn = draws.withColumn("out", F.aggregate("cells", start, take, lambda state: state["out"]))
    return drawn.select("draw", F.inline(F.arrays_zip("cells", "out"))).select("draw", "cells.y_true", "cells.y_pred", F.col("out").alias("n"))


def bootstrap_ci(preds: DataFrame, iterations: int = 1000, confidence: float = 0.95, seed: int = 42, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """``(metric, low, high, iterations)``: percentile intervals over resamples of the rows.

    The metrics depend on the confusion counts alone, so ``resamples`` draws those: a
    replicate costs classes squared draws, not n rows, and nothing passes the driver.
    Replicates with fewer than two true classes are left out; percentiles interpolate linearly.
    """
    runs = resamples(confusion_counts(preds, y_true, y_pred), iterations, seed)
    sides = runs.select("draw", "n", (F.col("y_true") == F.col("y_pred")).alias("hit"), F.inline(F.array(F.struct(F.col("y_true").alias("label"), F.lit(True).alias("true")), F.struct(F.col("y_pred").alias("label"), F.lit(False).alias("true")))))
    on = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    per = sides.groupBy("draw", "label").agg(on(F.col("true") & F.col("hit")).alias("tp"), on(~F.col("true") & ~F.col("hit")).alias("fp"), on(F.col("true") & ~F.col("hit")).alias("fn"))
    support, used = F.col("tp") + F.col("fn"), F.col("tp") + F.col("fn") + F.col("fp")
    each = per.groupBy("draw").agg(
        (F.sum("tp") / F.sum(support)).alias("accuracy"),
        F.avg(F.when(support > 0, F.col("tp") / F.nullif(support, F.lit(0)))).alias("balanced_accuracy"),
        F.avg(F.when(used > 0, _f1())).alias("macro_f1"),
        F.count_if(support > 0).alias("classes"),
    )
    long = each.where("classes >= 2").select(F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in METRICS[:3]))))
    tail = (1 - confidence) / 2
    bounds = F.percentile("v", F.array(F.lit(tail), F.lit(1 - tail)))
    return long.groupBy("metric").agg(bounds.alias("b"), F.count("*").alias("iterations")).select("metric", F.col("b")[0].alias("low"), F.col("b")[1].alias("high"), "iterations")


def intervals_overlap(one: DataFrame, two: DataFrame) -> DataFrame:
    """``(metric, overlap)`` of two interval tables."""
    other = two.select("metric", F.col("low").alias("l2"), F.col("high").alias("h2"))
    return one.join(other, "metric").select("metric", ((F.col("low") <= F.col("h2")) & (F.col("l2") <= F.col("high"))).alias("overlap"))


def compare(naive: DataFrame, grouped: DataFrame, metrics: tuple[str, ...] = METRICS[:3]) -> DataFrame:
    """``(metric, naive, grouped, delta)`` of two rows of overall metrics; the delta is of the unrounded values."""
    long = lambda one, name: one.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias(name)) for m in metrics))).alias("x")).select("x.*")
    met = long(naive, "a").join(long(grouped, "b"), "metric")
    return met.select("metric", F.round("a", 4).alias("naive"), F.round("b", 4).alias("grouped"), F.round(F.col("a") - F.col("b"), 4).alias("delta"))
