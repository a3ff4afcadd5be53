"""Exact dedup by content sort, in DataFrame operations only.

Texts are normalised by lower-casing A-Z and range-partitioned by their bytes with
sampled splitters; the external sort inside each partition puts equal texts next to
each other, and the window over the sorted rows compares each whole text with its
neighbour.  The range partitioning already clusters equal texts, so the window adds
no exchange and every text crosses the network once.

Large groups are split: a first pass counts texts by a 64-bit hash, and documents of
a count above ``group_rows`` get a second sort key, so that no sorted run holds more
than about that many copies.  The first document of each such run, with its text, then goes
through the same content sort once more.  The order is by first characters, then a
64-bit hash, then the whole text: hashes decide where texts lie, never what is equal.

Defined cases: null text counts as empty; null ids come last in a group, and one row
of them stays only where the group has no other; of equal rows one stays; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakwright.sources.shared_tables import stash

#: So many hashes of large groups are broadcast at most (16 bytes each); more are joined.
BROADCAST_ROWS = 100_000
#: Characters of a text that splitters hold; texts that begin alike are told apart by a hash.
PREFIX = 32


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only.  On ASCII text the built-in does just that, and faster."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def _sized(small: DataFrame) -> DataFrame:
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small


def _content_sort(rows: DataFrame, *more: str) -> DataFrame:
    """Rows in the order of their texts; the splitters are sampled from the first bytes and a hash, not from whole texts."""
    rows = rows.withColumn("prefix", F.substring("norm", 1, PREFIX))
    return rows.repartitionByRange("prefix", "h", *more).sortWithinPartitions("prefix", "h", "norm", *more)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", group_rows: int = 1000) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept and text_sha256 of the normalised text.

    ``keep`` names the id of a group that stays: ``smallest`` or ``largest``.
    """
    best, order = (F.min, F.col("doc_id").asc_nulls_last()) if keep == "smallest" else (F.max, F.col("doc_id").desc_nulls_last())
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(F.lower(text)).alias("h"))
    large = stash(rows.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > group_rows), "large-groups")
    runs = F.ceil(F.col("n") / group_rows)
    split = F.when(F.col("n").isNotNull(), F.pmod(F.xxhash64("doc_id"), runs)).otherwise(F.lit(0))
    salted = rows.join(_sized(large), "h", "left").select("doc_id", "h", ascii_lower(F.col("text")).alias("norm"), split.alias("run"), F.col("n").isNotNull().alias("large"))

    run = Window.partitionBy("prefix", "h", "norm", "run")
    sorted_rows = _content_sort(salted, "run")
    judged = sorted_rows.select(
        "doc_id",
        "h",
        "run",
        "large",
        "norm",
        best("doc_id").over(run).alias("keep_id"),
        F.count("*").over(run).alias("group_size"),
        F.row_number().over(run.orderBy(order)).alias("place"),
    ).select("doc_id", "h", "run", "large", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size", "place", F.when(F.col("large") & (F.col("place") == 1), F.col("norm")).alias("norm"))
    judged = stash(judged, "sorted")

    # The runs of each large text, by a second content sort over one row a run.
    same = Window.partitionBy("prefix", "h", "norm")
    heads = _content_sort(judged.where("norm IS NOT NULL"))
    heads = stash(heads.select("text_sha256", "run", best("keep_id").over(same).alias("all_keep"), F.sum("group_size").over(same).alias("all_size"), F.row_number().over(same.orderBy(F.col("keep_id").asc_nulls_last() if keep == "smallest" else F.col("keep_id").desc_nulls_last(), "run")).alias("run_place")), "runs")
    joined = judged.join(_sized(heads), ["text_sha256", "run"], "left")
    first = (F.col("place") == 1) & (F.coalesce("run_place", F.lit(1)) == 1)
    return joined.select("doc_id", F.when(F.col("large"), F.col("all_keep")).otherwise(F.col("keep_id")).alias("keep_id"), F.when(F.col("large"), F.col("all_size")).otherwise(F.col("group_size")).alias("group_size"), first.alias("kept"), "text_sha256")
