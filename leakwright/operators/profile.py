"""Profiles of a labelled, grouped dataset, and checks of its integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def class_distribution(meta: DataFrame, label: str) -> DataFrame:
    """``(label, count, share)`` of labels that are not null; the share is of all rows."""
    every = Window.partitionBy()
    counts = meta.groupBy(label).agg(F.count("*").alias("count"))
    return counts.withColumn("share", F.round(F.col("count") / F.sum("count").over(every), 4)).where(F.col(label).isNotNull())


def group_sizes(meta: DataFrame, group: str, id_col: str) -> DataFrame:
    return meta.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(id_col).alias("size"))


def group_redundancy(meta: DataFrame, group: str, id_col: str) -> DataFrame:
    """One row: items (null groups too), groups, groups of several, the largest, and what is redundant."""
    sizes = meta.groupBy(group).agg(F.count("*").alias("rows"), F.count(id_col).alias("size"))
    real = F.col(group).isNotNull()
    one = sizes.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).cast("long").alias("n_items"),
        F.count_if(real).alias("n_groups"),
        F.count_if(real & (F.col("size") > 1)).alias("groups_of_several"),
        F.coalesce(F.max(F.when(real, F.col("size"))), F.lit(0)).cast("long").alias("largest_group"),
    )
    redundant = F.col("n_items") - F.col("n_groups")
    return one.withColumn("redundant", redundant).withColumn("redundant_share", F.when(F.col("n_items") > 0, F.round(redundant / F.greatest("n_items", F.lit(1)), 4)).otherwise(0.0))


def expected_contamination(meta: DataFrame, group: str, id_col: str, test_size: float) -> DataFrame:
    """The share of a random test set whose group also has items outside it, by the sizes of groups alone."""
    sizes = group_sizes(meta, group, id_col).where("size > 0")
    weight = F.sum(F.col("size") * (1 - F.pow(F.lit(test_size), F.col("size") - 1)))
    return sizes.agg(F.coalesce(F.round(weight / F.nullif(F.sum("size"), F.lit(0)), 4), F.lit(0.0)).alias("expected_contamination"))


def group_size_histogram(meta: DataFrame, group: str, id_col: str) -> DataFrame:
    """``(size, n_groups)``, smallest size first."""
    return group_sizes(meta, group, id_col).groupBy("size").agg(F.count("*").alias("n_groups")).orderBy("size")


def missing_from(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of ``left`` that ``right`` lacks."""
    return left.select(key).where(F.col(key).isNotNull()).distinct().join(right.select(key).distinct(), key, "left_anti")


def integrity(meta: DataFrame, index: DataFrame, key: str, required: list[str], expected: int | None = None) -> DataFrame:
    """``(check, level, n, ok, examples)``: columns, row count, and keys that either side lacks."""
    spark = meta.sparkSession
    absent = sorted(set(required) - set(meta.columns))
    rows = [("required_columns", "error", len(absent), not absent, absent)]
    out = spark.createDataFrame(rows, "check string, level string, n long, ok boolean, examples array<string>")
    if absent:
        return out
    if expected is not None:
        count = meta.agg(F.count("*").alias("n"))
        out = out.unionByName(count.select(F.lit("row_count").alias("check"), F.lit("warning").alias("level"), "n", (F.col("n") == expected).alias("ok"), F.array().cast("array<string>").alias("examples")))
    for name, level, left, right in (("not_on_disk", "error", meta, index), ("not_in_metadata", "warning", index, meta)):
        gone = missing_from(left, right, key)
        first = gone.orderBy(key).limit(5).agg(F.sort_array(F.collect_list(F.col(key).cast("string"))).alias("examples"))
        n = gone.agg(F.count("*").alias("n")).join(F.broadcast(first))
        out = out.unionByName(n.select(F.lit(name).alias("check"), F.lit(level).alias("level"), "n", (F.col("n") == 0).alias("ok"), "examples"))
    return out
