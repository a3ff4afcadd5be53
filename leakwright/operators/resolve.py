"""From candidate pairs to groups: annotation, totals, merging and effective groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakwright.operators.graph import connected_components
from leakwright.sources.shared_tables import stash


def annotate_pairs(pairs: DataFrame, meta: DataFrame, id_col: str, group: str, label: str) -> DataFrame:
    """Adds the group and label of both items, and whether they agree; what is missing on a side never agrees."""
    of = lambda side: meta.select(F.col(id_col).alias(f"id_{side}"), F.col(group).alias(f"group_{side}"), F.col(label).alias(f"label_{side}"))
    met = pairs.join(of("a"), "id_a", "left").join(of("b"), "id_b", "left")
    agree = lambda x: F.coalesce(F.col(f"{x}_a") == F.col(f"{x}_b"), F.lit(False))
    return met.withColumn("same_group", agree("group")).withColumn("same_label", agree("label")).select(*pairs.columns, "group_a", "label_a", "group_b", "label_b", "same_group", "same_label")


def method_crosstab(annotated: DataFrame) -> DataFrame:
    """Declared and undeclared pairs of each method."""
    return annotated.groupBy("method").agg(F.count_if("same_group").alias("declared"), F.count_if(~F.col("same_group")).alias("undeclared"))


def undeclared(annotated: DataFrame) -> DataFrame:
    """Pairs whose groups differ; a flag that is missing counts as declared."""
    return annotated.where(~F.coalesce("same_group", F.lit(True)))


def audit_totals(annotated: DataFrame) -> DataFrame:
    """One row: pairs, declared, undeclared, undeclared with different labels, and items in undeclared pairs."""
    pairs = annotated.agg(F.count("*").alias("pairs"), F.count_if("same_group").alias("declared"), F.count_if(~F.col("same_group")).alias("undeclared"), F.count_if(~F.col("same_group") & ~F.col("same_label")).alias("undeclared_label_mismatch"))
    open_pairs = undeclared(annotated)
    items = open_pairs.select(F.col("id_a").alias("id")).union(open_pairs.select("id_b")).agg(F.countDistinct("id").alias("items_in_undeclared"))
    return pairs.join(F.broadcast(items))


def cross_group_links(rows: DataFrame, key: str, id_col: str, group: str) -> DataFrame:
    """``(id_a, id_b)``: what links of each row to the first of its ``key`` leave out between groups.

    Of a key with several groups, every row of the first one's group is linked to the
    least row of another.  With the links to the first, each row that has a row of
    another group under its key is in an undeclared link, and all of them hang together.
    A row without a group agrees with none and needs no link here.
    """
    known = rows.where(F.col(id_col).isNotNull()).select(F.col(key).alias("k"), F.col(id_col).alias("id"), F.col(group).alias("g"))
    firsts = known.groupBy("k").agg(F.min(F.struct("id", "g")).alias("first")).select(F.col("k").alias("fk"), F.col("first.id").alias("first"), F.col("first.g").alias("fg")).where("fg IS NOT NULL")
    firsts = stash(firsts, "firsts")
    least = known.groupBy("k", "g").agg(F.min("id").alias("least"))
    others = least.join(firsts, F.col("k").eqNullSafe(F.col("fk"))).where(~F.col("g").eqNullSafe(F.col("fg"))).groupBy("fk", "first", "fg").agg(F.min("least").alias("other"))
    others = stash(others, "others")  # so that a hot key's rows can be split in the join
    met = known.join(others, F.col("k").eqNullSafe(F.col("fk")) & (F.col("g") == F.col("fg"))).where("id <> first")
    return met.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b"))


def key_pair_counts(rows: DataFrame, key: str, group: str, label: str) -> DataFrame:
    """One row: all pairs of rows with one key, counted from sizes: pairs, declared, undeclared, undeclared_label_mismatch."""
    cells = rows.groupBy(F.col(key).alias("k"), F.col(group).alias("g"), F.col(label).alias("l")).agg(F.count("*").alias("n"))
    n = F.sum("n")
    two = F.coalesce(F.sum(F.expr("n * (n - 1) DIV 2")), F.lit(0))
    pairs = cells.groupBy("k").agg(n.alias("n")).agg(two.alias("pairs"))
    declared = cells.where("g IS NOT NULL").groupBy("k", "g").agg(n.alias("n")).agg(two.alias("declared"))
    alike = cells.where("l IS NOT NULL").groupBy("k", "l").agg(n.alias("n")).agg(two.alias("alike"))
    both = cells.where("g IS NOT NULL AND l IS NOT NULL").agg(two.alias("both"))
    sums = pairs.join(F.broadcast(declared)).join(F.broadcast(alike)).join(F.broadcast(both)).withColumn("undeclared", F.col("pairs") - F.col("declared"))
    return sums.select("pairs", "declared", "undeclared", (F.col("undeclared") - F.col("alike") + F.col("both")).alias("undeclared_label_mismatch"))


def duplicate_groups(pairs: DataFrame) -> DataFrame:
    """``(node, component)`` of the undeclared pairs, which are found once and written."""
    open_pairs = undeclared(pairs) if "same_group" in pairs.columns else pairs
    return connected_components(stash(open_pairs.select("id_a", "id_b"), "undeclared"), "id_a", "id_b")


def effective_groups(meta: DataFrame, clusters: DataFrame, id_col: str, group: str, null_group: str = "single") -> DataFrame:
    """Adds ``effective_group``: groups that share a cluster of duplicates are one, named by the least of them.

    ``clusters`` is ``(node, component)``; its items that ``meta`` lacks are ignored.  A
    row without a group is a group of its own, or with ``null_group="merge"`` they are one.
    """
    own = F.coalesce(F.col(group).cast("string"), F.lit("null") if null_group == "merge" else F.concat(F.lit("row:"), F.col(id_col).cast("string")))
    rows = meta.withColumn("__own__", own)
    placed = rows.join(clusters, rows[id_col] == clusters["node"]).select("__own__", "component").distinct()
    least = placed.groupBy("component").agg(F.min("__own__").alias("least"))
    edges = placed.join(least, "component").select(F.col("__own__").alias("src"), F.col("least").alias("dst")).where("src <> dst")
    roots = connected_components(edges)
    return rows.join(roots, rows["__own__"] == roots["node"], "left").select(*meta.columns, F.coalesce("component", "__own__").alias("effective_group"))


def group_counts(grouped: DataFrame, group: str, merged: str = "effective_group") -> DataFrame:
    """One row: groups before and after those that share duplicates became one; rows without a group count after only."""
    return grouped.agg(F.countDistinct(group).alias("groups_before"), F.countDistinct(merged).alias("groups_after"))


def merge_findings(existing: DataFrame, new: DataFrame, methods_run: list[str] | None = None) -> DataFrame:
    """Findings of methods that were not run again, and the new ones; of repeats the new one, each pair and method once.

    Pass ``methods_run``, so that a method that now finds nothing clears its old rows.
    """
    ran = new.select("method").distinct() if methods_run is None else new.sparkSession.createDataFrame([(m,) for m in methods_run], "method string")
    kept = existing.join(F.broadcast(ran), "method", "left_anti").withColumn("__rank__", F.lit(1))
    both = kept.unionByName(new.withColumn("__rank__", F.lit(0)), allowMissingColumns=True)
    others = [c for c in both.columns if c not in ("id_a", "id_b", "method", "__rank__")]
    first = both.groupBy("id_a", "id_b", "method").agg(F.min(F.struct("__rank__", *others)).alias("x"))
    return first.select("id_a", "id_b", "method", *(F.col(f"x.{c}").alias(c) for c in others))
