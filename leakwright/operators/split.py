"""Train, validation and test partitions, and what leaks between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakwright.functions.ordering import largest_remainder, order_key, running_before
from leakwright.sources.shared_tables import small_side, stash

PARTITIONS = ("train", "val", "test")


def naive_split(meta: DataFrame, id_col: str, label: str, test_size: float = 0.15, val_size: float = 0.15, seed: int = 42) -> DataFrame:
    """Adds ``split``: rows at random within each label, whatever their groups.

    The sizes are exact: round(n * share) rows overall, dealt to labels by largest
    remainder, and to rows by the seeded order of their ids.
    """
    every = Window.partitionBy()
    counts = meta.groupBy(F.col(label).alias("__label__")).agg(F.count("*").alias("n")).withColumn("__all__", F.lit(0)).withColumn("name", F.coalesce(F.col("__label__").cast("string"), F.lit("")))
    total = F.sum("n").over(every)
    held = largest_remainder(F.col("n") * (test_size + val_size), F.round(total * (test_size + val_size)), ["__all__"], "name")
    counts = counts.withColumn("held", held)
    test = largest_remainder(F.col("held") * (test_size / (test_size + val_size)), F.round(F.sum("held").over(every) * (test_size / (test_size + val_size))), ["__all__"], "name")
    quotas = small_side(counts.withColumn("test", test).select("__label__", "held", "test"), "quotas")
    ranked = running_before(meta.withColumn("__key__", order_key(seed, id_col)), [label], "__key__", id_col)
    split = F.when(F.col("before") < F.col("test"), "test").when(F.col("before") < F.col("held"), "val").otherwise("train")
    return ranked.join(quotas, F.col(label).eqNullSafe(F.col("__label__"))).select(*meta.columns, split.alias("split"))


def grouped_split(meta: DataFrame, id_col: str, group: str, label: str, test_size: float = 0.15, val_size: float = 0.15, seed: int = 42, legacy_thirds: bool = False, label_of: str = "frequent") -> DataFrame:
    """Adds ``split``: whole groups at random within their most frequent label, or with ``label_of="least"`` within the first of their labels by name.

    Groups of a label go, in seeded order, to test until its share of rows is reached,
    then to validation, then to train; no group is ever in two.  A row without a group
    is a group of its own.  ``legacy_thirds`` holds out one fold of round(1 / share),
    which is a third where 30 % were asked for.
    """
    held = test_size + val_size
    if legacy_thirds:
        fold, inner = max(2, round(1 / held)), max(2, round(1 / (test_size / held)))
        held, test_size = 1 / fold, 1 / fold / inner
    name = F.coalesce(F.concat(F.lit("g:"), F.col(group).cast("string")), F.concat(F.lit("row:"), F.col(id_col).cast("string")))
    rows = meta.withColumn("__group__", name)
    per = rows.groupBy("__group__", F.col(label).alias("__label__")).agg(F.count("*").alias("n"))
    # Of labels that are equally frequent the first by name, null last.
    if label_of not in ("frequent", "least"):
        raise ValueError(f"label_of is frequent or least, not {label_of}")
    chosen = F.min("__label__") if label_of == "least" else F.min_by("__label__", F.struct(-F.col("n"), F.col("__label__").isNull(), F.col("__label__")))
    groups = per.groupBy("__group__").agg(chosen.alias("__label__"), F.sum("n").alias("n"))
    groups = groups.withColumn("__key__", order_key(seed, "__group__"))
    placed = running_before(groups, ["__label__"], "__key__", "__group__", F.col("n"))
    totals = small_side(groups.groupBy(F.col("__label__").alias("__of__")).agg(F.sum("n").alias("total")), "totals")
    share = (F.col("before") + F.col("n") / 2) / F.col("total")
    split = F.when(share <= test_size, "test").when(share <= held, "val").otherwise("train")
    dealt = placed.join(totals, F.col("__label__").eqNullSafe(F.col("__of__"))).select("__group__", split.alias("split"))
    return rows.join(dealt, "__group__").select(*meta.columns, "split")


def contamination(frame: DataFrame, group: str) -> DataFrame:
    """One row: test rows, those whose group is also in train or val, and their share."""
    held_in = frame.where(F.col("split").isin("train", "val") & F.col(group).isNotNull()).select(F.col(group).alias("__in__")).distinct().withColumn("__hit__", F.lit(1))
    held_in = stash(held_in, "held-in")  # a hot group's rows can be split in the join with a written table
    test = frame.where("split = 'test'").join(held_in, F.col(group) == F.col("__in__"), "left")
    one = test.agg(F.count("*").alias("test_rows"), F.count("__hit__").alias("contaminated_rows"))
    return one.withColumn("share", F.when(F.col("test_rows") > 0, F.round(F.col("contaminated_rows") / F.greatest("test_rows", F.lit(1)), 4)).otherwise(0.0))


def split_summary(frame: DataFrame, label: str) -> DataFrame:
    """``(split, label, rows, split_rows, share)``, with a row for every split and label that occur at all."""
    counts = stash(frame.groupBy("split", label).agg(F.count("*").alias("rows")), "counts")
    grid = counts.select("split").distinct().join(small_side(counts.select(label).distinct(), "labels"))
    full = grid.join(counts, ["split", label], "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    whole = F.sum("rows").over(Window.partitionBy("split"))
    return full.select("split", label, "rows", whole.alias("split_rows"), F.round(F.col("rows") / whole, 3).alias("share"))


def leaking_groups(frame: DataFrame, group: str) -> DataFrame:
    """Groups that occur in more than one partition, and in how many."""
    return frame.where(F.col(group).isNotNull()).groupBy(group).agg(F.countDistinct("split").alias("n_splits")).where("n_splits > 1")


def assert_no_leak(frame: DataFrame, group: str) -> None:
    found = leaking_groups(frame, group).orderBy(group).limit(3).collect()
    if found:
        raise AssertionError(f"groups in more than one partition, for example {[r[group] for r in found]}")


def select_partition(frame: DataFrame, required: list[str], partition: str | None = None) -> DataFrame:
    """``frame``, or one of its partitions, after a check of its columns and that it has rows."""
    absent = sorted(set(required) - set(frame.columns))
    if absent:
        raise ValueError(f"missing columns: {absent}")
    rows = frame if partition is None else frame.where(F.col("split") == partition)
    if rows.isEmpty():
        raise ValueError(f"no rows in partition {partition}")
    return rows


def encode_label(label: Column | str, classes: list[str]) -> Column:
    """The place of a label in ``classes`` from 0; an unknown one is an error."""
    label = F.col(label) if isinstance(label, str) else label
    place = F.array_position(F.array(*map(F.lit, classes)), label)
    return F.when(F.coalesce(place, F.lit(0)) == 0, F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(label.cast("string"), F.lit("null"))))).otherwise(place - 1).cast("int")
