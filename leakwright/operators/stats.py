"""Dose-response curves and paired comparisons of replicated runs."""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakwright.sources.shared_tables import stash


def curve_rollup(points: DataFrame, rate: str, value: str) -> DataFrame:
    """``(rate, mean, std, count)`` by ascending rate; the sample deviation of one value is null."""
    return points.groupBy(rate).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("count")).orderBy(rate)


def fit_slope(points: DataFrame, rate: str, value: str) -> DataFrame:
    """One row: slope per 10 points of rate, intercept and R^2; null below two points, R^2 also for a constant value."""
    enough = F.count_if(F.col(rate).isNotNull() & F.col(value).isNotNull()) >= 2
    return points.agg(
        F.when(enough, F.regr_slope(value, rate) * 0.1).alias("slope_per_10pp"),
        F.when(enough, F.regr_intercept(value, rate)).alias("intercept"),
        F.when(enough & (F.var_pop(value) > 0), F.regr_r2(value, rate)).alias("r2"),
    )


def inflation(curve: DataFrame, rate: str, mean: str = "mean") -> DataFrame:
    """One row: the value at rate 0 (null without one), at the largest rate, and the difference."""
    ends = curve.agg(F.max(F.when(F.col(rate) == 0, F.col(mean))).alias("baseline"), F.max_by(mean, rate).alias("at_max"))
    return ends.withColumn("inflation", F.col("at_max") - F.col("baseline"))


def paired_gaps(runs: DataFrame, keys: list[str], arm: str, metric: str, first: str = "naive", second: str = "grouped", order: str | None = None) -> DataFrame:
    """``(keys, first, second, gap)`` of keys that have both arms; of several runs of an arm the first by ``order``."""
    pick = lambda name: F.min_by(metric, F.when((F.col(arm) == name) & F.col(metric).isNotNull(), F.col(order or metric)))
    both = runs.groupBy(*keys).agg(pick(first).alias(first), pick(second).alias(second)).dropna(subset=[first, second])
    return both.withColumn("gap", F.col(first) - F.col(second))


def gap_moments(gaps: DataFrame, by: list[str] | None = None, gap: str = "gap") -> DataFrame:
    """n, mean, sample deviation, mean -/+ 1.96 standard errors, Cohen's d and t; with ``by`` for each group and, as null, overall."""
    keys = by or []
    grouped = gaps.rollup(*keys) if keys else gaps.groupBy()
    rows = grouped.agg(F.count(gap).alias("n"), F.avg(gap).alias("mean"), F.stddev_samp(gap).alias("std"))
    error = F.col("std") / F.sqrt("n")
    whole = F.nullif("std", F.lit(0.0))
    return rows.withColumn("ci_low", F.col("mean") - 1.96 * error).withColumn("ci_high", F.col("mean") + 1.96 * error).withColumn("cohens_d", F.col("mean") / whole).withColumn("t", F.col("mean") / F.nullif(error, F.lit(0.0)))


def signed_ranks(gaps: DataFrame, gap: str = "gap", by: list[str] | None = None) -> DataFrame:
    """One row, or one for each group of ``by``: n of gaps that are not zero, W+, W-, their minimum, and the tie term of the rank variance.

    Sizes are range-partitioned; a rank is what lies in earlier partitions and before it in its own.
    """
    keys = by or []
    rows = gaps.where((F.col(gap) != 0) & F.col(gap).isNotNull()).withColumn("size", F.abs(F.col(gap)))
    sizes = rows.groupBy(*keys, "size").agg(F.count("*").alias("ties"), F.count_if(F.col(gap) > 0).alias("up"), F.count_if(F.col(gap) < 0).alias("down"))
    dealt = stash(sizes.repartitionByRange(*keys, "size").withColumn("part", F.spark_partition_id()), "sizes")
    before = lambda keys, order: F.coalesce(F.sum("ties").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = dealt.groupBy(*keys, "part").agg(F.sum("ties").alias("ties")).withColumn("base", before(keys, "part"))  # a row a partition and group
    own = [F.col(c).eqNullSafe(F.col(f"__{c}__")) for c in (*keys, "part")]
    met = dealt.join(bases.select(*(F.col(c).alias(f"__{c}__") for c in (*keys, "part")), "base"), reduce(Column.__and__, own))
    ranked = met.withColumn("rank", F.col("base") + before([*keys, "part"], "size") + (F.col("ties") + 1) / 2)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    sums = ranked.groupBy(*keys).agg(F.coalesce(F.sum("ties"), F.lit(0)).cast("long").alias("n"), zero(F.sum(F.col("rank") * F.col("up"))).alias("w_plus"), zero(F.sum(F.col("rank") * F.col("down"))).alias("w_minus"), zero(F.sum((F.pow("ties", F.lit(3)) - F.col("ties")).cast("double"))).alias("tie_term"))
    return sums.withColumn("w", F.least("w_plus", "w_minus"))


def student_p(t: float, df: float) -> float:
    """Two-sided p-value of Student's t, by the continued fraction of the incomplete beta function."""
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if x > 0 else 0.0

    def fraction(p: float, q: float, z: float) -> float:
        tiny = 1e-300
        c, d = 1.0, 1 / (1 - (p + q) * z / (p + 1) or tiny)
        h = d
        for m in range(1, 400):
            even = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
            odd = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
            for term in (even, odd):
                d = 1 / (1 + term * d or tiny)
                c = 1 + term / c or tiny
                h *= c * d
            if abs(c * d - 1) < 1e-15:
                break
        return h

    if x < (a + 1) / (a + b + 2):
        return front * fraction(a, b, x) / a
    return 1 - front * fraction(b, a, 1 - x) / b


def wilcoxon_p(n: int, w: float, tie_term: float) -> float:
    """Two-sided p-value of the signed-rank statistic: exact up to 50 gaps without ties, else normal."""
    if n == 0:
        return float("nan")
    if n <= 50 and tie_term == 0:
        ways = [1] + [0] * (n * (n + 1) // 2)
        for rank in range(1, n + 1):
            for s in range(len(ways) - 1, rank - 1, -1):
                ways[s] += ways[s - rank]
        return min(1.0, 2 * sum(ways[: int(w) + 1]) / 2**n)
    mean, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - tie_term / 48
    return math.erfc(abs(w - mean) / math.sqrt(var) / math.sqrt(2)) if var > 0 else float("nan")


def paired_test(gaps: DataFrame, gap: str = "gap", by: list[str] | None = None) -> DataFrame:
    """One row: moments, t and p, signed ranks and p.  With one gap only n and mean; p of gaps without spread is null.

    With ``by`` a row for each group and, as null, one overall.
    """
    keys = by or []
    ranks = signed_ranks(gaps, gap)
    if keys:
        ranks = signed_ranks(gaps.dropna(subset=keys), gap, keys).unionByName(ranks, allowMissingColumns=True)
    ranks = ranks.select(*(F.col(c).alias(f"__{c}__") for c in keys), F.col("n").alias("n_ranked"), "w", "tie_term")
    on = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__{c}__")) for c in keys], F.lit(True))
    both = gap_moments(gaps.dropna(subset=keys) if keys else gaps, keys, gap).join(ranks, on, "left").withColumns({"n_ranked": F.coalesce("n_ranked", F.lit(0)), "w": F.coalesce("w", F.lit(0.0)), "tie_term": F.coalesce("tie_term", F.lit(0.0))})

    @F.pandas_udf("p_t double, p_wilcoxon double")
    def p_values(n: pd.Series, t: pd.Series, m: pd.Series, w: pd.Series, ties: pd.Series) -> pd.DataFrame:
        rows = [(student_p(b, a - 1) if a > 1 and not pd.isna(b) else None, wilcoxon_p(int(c), d, e) if a > 1 and c > 0 else None) for a, b, c, d, e in zip(n, t, m, w, ties)]
        return pd.DataFrame(rows, columns=["p_t", "p_wilcoxon"]).astype("float64")

    return both.withColumn("p", p_values("n", "t", "n_ranked", "w", "tie_term")).select(*keys, "n", "mean", "std", "ci_low", "ci_high", "cohens_d", "t", "w", F.col("p.p_t").alias("p_t"), F.col("p.p_wilcoxon").alias("p_wilcoxon"))


def replication_summary(runs: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Mean, sample deviation and count of each metric for each key, rounded."""
    return runs.groupBy(*keys).agg(*(x for m in metrics for x in (F.round(F.avg(m), 4).alias(f"{m}_mean"), F.round(F.stddev_samp(m), 4).alias(f"{m}_std"), F.count(m).alias(f"{m}_count"))))


def pending_runs(grid: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """Configurations of the grid that no run has yet."""
    return grid.join(runs.select(*keys).distinct(), keys, "left_anti")


def run_name(split: str = "split", backbone: str = "backbone", seed: str = "seed", default_backbone: str = "efficientnet_b0", default_seed: int = 42):
    """The file name of a run's checkpoint, which is also the key of its row."""
    usual = (F.col(backbone) == default_backbone) & (F.col(seed) == default_seed)
    return F.when(usual, F.concat(F.col(split), F.lit("_best.pt"))).otherwise(F.concat(F.concat_ws("__", split, backbone, F.concat(F.lit("s"), F.col(seed).cast("string"))), F.lit("_best.pt")))
