"""Mixing sources to target weights by subset-sum budget fitting.

The size of a document is its number of words.  Sources in code-point order, null
last, have the weights given, repeating, and share the words of all documents by
weight, but none gets more than ``max_repeats`` times its own words: the excess is
shared by weight again.  With m(x) = min(x * weight, cap) that end state is the x at
which the m(x) sum to all words.

Within a source every document is taken as often as all its documents fit, and the
rest of the target is fitted to document lengths: the documents of each exact length
are counted, each length gets its share of the rest, what rounding leaves is carried
to the next shorter length, and a bounded-knapsack dynamic program over reachable
sums closes the last budget, ``DP_WORDS`` and what was carried, with documents not yet
taken.  Which documents of a length are taken once more is decided by a seeded hash of
the row: those up to a threshold.  Rows of one hash, which have one id and text, are told
apart by a second hash, of their other columns first and then of a number given when the
sizes are written, and a second threshold.  So a decision needs only the row and its
length's entry in the plan, and a rerun takes the same rows.

Defined cases: null and blank texts have size 0 and no words taken; null is a source
of its own; a source without words has target 0; of equal rows as many are taken once
more as the plan says, and which is all the same; an empty table gives an empty
result; further columns are kept by ``mix``, whatever their names, and ignored by the report.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leakwright.sources.shared_tables import stash

WORD = r"[^\x20\x09-\x0D]+"
#: Words of a source's rest that are left to the dynamic program, and rows of a length that are ranked rather than told apart by one more byte.
DP_WORDS = 1 << 16
RANKED_ROWS = 256
#: A plan of up to this many (source, length) rows is broadcast, a larger one is joined.
BROADCAST_ROWS = 200_000


def sized(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``row``, all of a row of ``docs``, and ``doc_id``, ``source``, ``__source__`` (never null), ``__size__``, ``__h__``, the row's seeded hash, and ``__r__``, another for each of equal rows."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = F.col(source_col).cast("string")
    others = F.to_json(F.struct(source.alias("source"), *(F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col, source_col))))
    told, dealt = F.xxhash64(F.lit(seed), others), F.xxhash64(F.lit(seed), F.monotonically_increasing_id())
    return docs.select(
        F.struct("*").alias("row"),
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source)).alias("__source__"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("__size__"),
        F.xxhash64(F.lit(seed), F.col(id_col), text).alias("__h__"),
        F.shiftleft(told, 40).bitwiseOR(F.shiftrightunsigned(dealt, 24)).alias("__r__"),
    )


def source_targets(totals: DataFrame, weights: tuple[float, ...], max_repeats: float) -> DataFrame:
    """From ``(__source__, total)``, a row for each source, the targets."""
    order = Window.orderBy("__source__")
    named = totals.withColumn("w", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.row_number().over(order) - 1) % len(weights) + 1))
    named = named.withColumn("cap", F.col("total") * float(max_repeats))
    rising = Window.orderBy(F.col("cap") / F.col("w"), "__source__")
    before, every = rising.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.sum("total").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    levels = named.withColumn("level", level).withColumn("open", F.col("cap") / F.col("w") >= F.col("level"))
    # The first source in rising order whose cap is not below its level sets the level of all that follow.
    levels = levels.withColumn("level", F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(rising.rowsBetween(Window.unboundedPreceding, 0)))
    return levels.select("__source__", "total", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("w"))).alias("target"))


def close_budget(sizes: list[int], counts: list[int], budget: int) -> list[int]:
    """Of each size so many, at most ``counts``, that their sum comes as near below ``budget`` as can be.

    Bounded knapsack over reachable sums, kept as the bits of one integer; counts are
    split into powers of two.
    """
    mask, reach = (1 << (budget + 1)) - 1, 1
    steps = []
    for k, (size, count) in enumerate(zip(sizes, counts)):
        left, part = min(count, budget // size), 1
        while left > 0 and not reach >> budget & 1:
            n = min(part, left)
            steps.append((k, n, reach))
            reach |= reach << (n * size) & mask
            left, part = left - n, part * 2
    at, taken = reach.bit_length() - 1, [0] * len(sizes)
    for k, n, before in reversed(steps):
        if not before >> at & 1:
            taken[k] += n
            at -= n * sizes[k]
    return taken


def fit_lengths(sizes: np.ndarray, counts: np.ndarray, target: float, max_repeats: int) -> tuple[int, np.ndarray]:
    """How often every document is taken, and how many of each size once more."""
    extra = np.zeros(len(sizes), dtype=np.int64)
    total = int((sizes * counts).sum())
    if not total or target <= 0:
        return 0, extra
    repeats = min(max_repeats, int(target // total))
    rest = target - repeats * total
    if repeats == max_repeats or rest < 1:
        return repeats, extra
    late = min(rest, DP_WORDS)
    share, carry = (rest - late) / total, 0.0
    for k in np.argsort(-sizes, kind="stable"):
        if sizes[k] <= 0:
            continue
        want = share * counts[k] * sizes[k] + carry
        extra[k] = min(counts[k], max(0, math.floor(want / sizes[k] + 1e-9)))
        carry = want - extra[k] * sizes[k]
    budget = int(round(carry + late))
    fits = np.flatnonzero((sizes > 0) & (sizes <= budget) & (counts > extra))
    for k, n in zip(fits, close_budget(sizes[fits].tolist(), (counts - extra)[fits].tolist(), budget)):
        extra[k] += n
    return repeats, extra


def _edges(cells: DataFrame, wanted: DataFrame, key: list[str], order: str) -> DataFrame:
    """``(key, edge, rest, weight)``: where the ``extra`` first of a key's rows end, in the order of a hash.

    ``cells`` has the key, the hash and how many rows have it; ``wanted`` has the key and
    extra.  ``rest`` of the ``weight`` rows at the edge belong to the first.  The edge is
    approached by the hash's bytes, highest first: sums by byte, at most 256 a key, tell
    in which the edge lies, and only the rows of that byte go on, until they are few
    enough to be ranked.  So no task holds the rows of a key, however many they are.
    """
    dealt = cells.join(wanted.select(*key, "extra"), key)
    earlier = Window.partitionBy(*key).orderBy("byte").rowsBetween(Window.unboundedPreceding, -1)
    for low in range(56, -1, -8):
        byte = F.shiftright(order, low) + 128 if low == 56 else F.shiftrightunsigned(order, low).bitwiseAND(F.lit(255))
        dealt = dealt.withColumn("byte", byte.cast("int"))
        sums = dealt.groupBy(*key, "byte", "extra").agg(F.sum("weight").alias("here"), F.count("*").alias("held"))
        sums = sums.withColumn("quota", F.col("extra") - F.coalesce(F.sum("here").over(earlier), F.lit(0)))
        found = stash(sums.where("quota > 0 AND quota <= here").select(*key, "byte", "quota", "held"), "quota")
        dealt = dealt.drop("extra").join(found.select(*key, "byte", F.col("quota").alias("extra")), [*key, "byte"]).drop("byte")
        if (found.agg(F.max("held")).first()[0] or 0) <= RANKED_ROWS:
            break
    upto = F.sum("weight").over(Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    ranked = dealt.withColumn("upto", upto)
    return ranked.where("upto >= extra AND upto - weight < extra").select(*key, F.col(order).alias("edge"), (F.col("extra") - F.col("upto") + F.col("weight")).alias("rest"), "weight")


def mixing_plan(rows: DataFrame, weights: tuple[float, ...], max_repeats: int) -> DataFrame:
    """``(__source__, __size__, source_size, target, repeats, up_to, within)``: which rows are taken once more.

    They are those with a hash below ``up_to``, and of those at it the ones whose second hash is no more than ``within``.
    """
    key = ["__source__", "__size__"]
    lengths = stash(rows.groupBy(*key).agg(F.count("*").alias("n")), "lengths")
    totals = lengths.groupBy("__source__").agg(F.sum(F.col("__size__") * F.col("n")).alias("total"))
    targets = source_targets(totals, weights, max_repeats)

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("__size__")
        part["repeats"], part["extra"] = fit_lengths(part["__size__"].to_numpy(), part["n"].to_numpy(), float(part["target"].iloc[0]), max_repeats)
        return part.rename(columns={"total": "source_size"})[["__source__", "__size__", "n", "source_size", "target", "repeats", "extra"]]

    fitted = lengths.join(targets, "__source__").groupBy("__source__").applyInPandas(fit, "__source__ string, __size__ long, n long, source_size long, target double, repeats long, extra long")
    plan = stash(fitted, "plan")
    cells = rows.groupBy(*key, "__h__").agg(F.count("*").alias("weight"))
    edges = stash(_edges(cells, plan.where("extra > 0 AND extra < n"), key, "__h__"), "edges")
    # Repeated rows at the edge: as many of them as the plan still wants, in the order of the second hash.
    ties = edges.where("rest < weight").select(*key, F.col("edge").alias("__h__"), F.col("rest").alias("extra"), F.col("weight").alias("n"))
    tied = rows.join(ties.select(*key, "__h__"), [*key, "__h__"]).select(*key, "__r__", F.lit(1).alias("weight"))
    within = _edges(tied, ties.drop("__h__"), key, "__r__").select(*key, F.col("edge").alias("within"))
    up_to = F.when(F.col("extra") <= 0, F.lit(None)).when(F.col("extra") >= F.col("n"), F.lit(2**63 - 1)).otherwise(F.col("edge"))
    full = plan.join(edges.select(*key, "edge"), key, "left").join(within, key, "left")
    return full.select(*key, "source_size", "target", "repeats", up_to.cast("long").alias("up_to"), "within")


def _planned(docs: DataFrame, weights, max_repeats, seed, id_col, text_col, source_col, whole: bool) -> DataFrame:
    """Rows with their copies; whole rows are written with their sizes, so that repeated ones keep their numbers."""
    rows = sized(docs, seed, id_col, text_col, source_col)
    rows = stash(rows if whole else rows.drop("row"), "sizes")
    plan = stash(mixing_plan(rows.select("__source__", "__size__", "__h__", "__r__"), weights, max_repeats), "mix")
    if plan.count() <= BROADCAST_ROWS:
        plan = F.broadcast(plan)
    below = (F.col("__h__") < F.col("up_to")) | ((F.col("__h__") == F.col("up_to")) & F.coalesce(F.col("__r__") <= F.col("within"), F.lit(True)))
    copies = F.col("repeats") + F.coalesce(below.cast("int"), F.lit(0))
    return rows.join(plan, ["__source__", "__size__"]).withColumn("__copies__", copies)


def mix_report(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_repeats: int = 3, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, and source and copies."""
    planned = _planned(docs, weights, max_repeats, seed, id_col, text_col, source_col, whole=False)
    return planned.select("doc_id", F.col("__size__").alias("size"), "source_size", "target", (F.col("__size__") * F.col("__copies__")).alias("taken"), "source", F.col("__copies__").alias("copies"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_repeats: int = 3, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each row of ``docs``, all its columns, as often as the mix takes it."""
    planned = _planned(docs, weights, max_repeats, seed, id_col, text_col, source_col, whole=True)
    taken = planned.where("__copies__ > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("__copies__").cast("int"))).alias("copy"))
    return taken.select("row.*")
