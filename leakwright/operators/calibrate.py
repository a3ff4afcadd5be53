"""Calibration of confidences, and examples to look at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def softmax(logits: Column) -> Column:
    peak = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp(x - peak))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b))


def argmax(values: Column) -> Column:
    """Place of the first largest value, from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def _bin_counts(preds: DataFrame, confidence: str, correct: str, n_bins: int) -> DataFrame:
    """Bin k is (k/n, (k+1)/n]: the edges are the doubles k * (1/n), and 0 is in no bin."""
    c = F.col(confidence).cast("double")
    near = F.ceil(c * n_bins).cast("long") - 1
    edge = lambda k: k.cast("double") * F.lit(1.0 / n_bins)
    k = F.when(c <= edge(near), near - 1).when(c > edge(near + 1), near + 1).otherwise(near)
    inside = preds.where((c > 0) & (c <= edge(F.lit(n_bins)))).withColumn("bin", k)
    return inside.groupBy("bin").agg(F.count("*").alias("n"), F.avg(c).alias("mean_confidence"), F.avg(F.col(correct).cast("double")).alias("accuracy"))


def reliability_bins(preds: DataFrame, confidence: str = "confidence", correct: str = "correct", n_bins: int = 10) -> DataFrame:
    """``(bin_low, bin_high, n, mean_confidence, accuracy)``, empty bins too."""
    bins = preds.sparkSession.range(n_bins).select(F.col("id").alias("bin"))
    full = bins.join(F.broadcast(_bin_counts(preds, confidence, correct, n_bins)), "bin", "left")  # n_bins rows at most
    edge = lambda k: F.round(k.cast("double") * F.lit(1.0 / n_bins), 3)
    return full.select(edge(F.col("bin")).alias("bin_low"), edge(F.col("bin") + 1).alias("bin_high"), F.coalesce("n", F.lit(0)).alias("n"), "mean_confidence", "accuracy")


def expected_calibration_error(preds: DataFrame, confidence: str = "confidence", correct: str = "correct", n_bins: int = 10, margin: float = 0.05) -> DataFrame:
    """One row: ece, mean_confidence, accuracy, n and a verdict; null where there are no rows.

    Bins weigh by their share of all rows, also of those at confidence 0, which no bin holds.
    """
    bins = _bin_counts(preds, confidence, correct, n_bins).agg(F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("mean_confidence"))).alias("gap"))
    whole = preds.agg(F.count("*").alias("n"), F.avg(F.col(confidence).cast("double")).alias("mean_confidence"), F.avg(F.col(correct).cast("double")).alias("accuracy"))
    off = F.col("mean_confidence") - F.col("accuracy")
    verdict = F.when(off > margin, "overconfident").when(off < -margin, "underconfident").when(off.isNotNull(), "calibrated")
    return whole.join(F.broadcast(bins)).select((F.coalesce("gap", F.lit(0.0)) / F.nullif("n", F.lit(0))).alias("ece"), "mean_confidence", "accuracy", "n", verdict.alias("verdict"))


def round_robin_examples(preds: DataFrame, id_col: str, y_true: str, correct: str, per_class: int, wanted: int) -> DataFrame:
    """Of right and of wrong rows ``wanted`` examples: the first of every class, then the second, and so on."""
    depth = F.row_number().over(Window.partitionBy(correct, y_true).orderBy(id_col))
    pool = preds.withColumn("depth", depth.cast("long")).where(F.col("depth") <= per_class)
    place = F.row_number().over(Window.partitionBy(correct).orderBy("depth", y_true))
    return pool.withColumn("place", place.cast("long")).where(F.col("place") <= wanted)
