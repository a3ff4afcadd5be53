"""Candidate pairs of near-duplicate items: by fingerprints and by embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakwright.sources.shared_tables import small_side, stash


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of 64-bit words."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)


def _known(prints: DataFrame, id_col: str, words_col: str) -> DataFrame:
    return prints.where(F.col(id_col).isNotNull() & F.col(words_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(words_col).alias("words"))


#: Distinct prints from which on bands are wider and one of their bits is flipped.
MANY_PRINTS = 1 << 24


#: Members of a class in one list, and pairs of members that one task gives, both about.
MEMBERS, PAIRS_A_TASK = 256, 2_000_000


#: Prints with one value of a band from which on they are dealt to several tasks, of so many on one side.
HOT = 1000


def _bits(words: Column, places: list[int]) -> Column:
    """The bits at ``places``, ascending and at most 63 of them, of an array of 64-bit words as a number."""
    out, at = None, 0
    while at < len(places):
        w, low = divmod(places[at], 64)
        n = next(k for k in range(1, len(places) - at + 1) if at + k == len(places) or places[at + k] != places[at] + k or places[at + k] // 64 != w)
        part = F.shiftrightunsigned(F.element_at(words, w + 1), low).bitwiseAND(F.lit((1 << n) - 1))
        out = part if out is None else out.bitwiseOR(F.shiftleft(part, at))
        at += n
    return F.lit(0).cast("long") if out is None else out


def _varying(classes: DataFrame, words: int) -> list[int]:
    """The places of the bits that not all prints have alike; the others tell no two apart."""
    each = [f(F.element_at("words", w + 1)) for w in range(words) for f in (F.bit_or, F.bit_and)]
    seen = classes.agg(*(x.alias(str(i)) for i, x in enumerate(each))).first()
    differ = [((seen[2 * w] or 0) ^ (seen[2 * w + 1] or 0)) & ((1 << 64) - 1) for w in range(words)]
    return [64 * w + b for w in range(words) for b in range(64) if differ[w] >> b & 1]


def _close_classes(classes: DataFrame, words: int, max_distance: int, flips: int | None = None) -> DataFrame:
    """``(wa, wb, hamming)`` of distinct prints at most ``max_distance`` bits apart, wa < wb.

    Bits that all prints have alike are left out, so no band is of those alone.
    With ``flips`` 0 the others are dealt to max_distance + 1 bands, one of which is equal in
    two such prints.  With 1 there are half as many, twice as wide: one of them differs in
    one bit at most, so one side is laid out as it is and the other also with each bit
    flipped.  Wide bands meet by chance much less often, which pays from
    ``MANY_PRINTS`` on, and where one band is left, as all that meets in it then is a pair; the pairs are the same.  A pair is kept in the first band it meets in.
    """
    places = _varying(classes, words)
    if flips is None:
        flips = int(classes.count() >= MANY_PRINTS or (max_distance == 1 and len(places) <= 63))
    bits = len(places)
    bands = max(max_distance // (flips + 1) + 1, -(-bits // 63))
    edges = [bits * b // bands for b in range(bands + 1)]
    of = lambda side: [_bits(F.col(side), places[a:b]) for a, b in zip(edges, edges[1:])]
    flipped = lambda value, n: F.transform(F.sequence(F.lit(-1), F.lit(n - 1)), lambda k: F.when(k < 0, value).otherwise(value.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k))))
    one = classes.select(F.col("words").alias("wa")).select("wa", F.posexplode(F.array(*of("wa"))).alias("band", "value"))
    two = classes.select(F.col("words").alias("wb"))
    if flips:
        wide = max(b - a for a, b in zip(edges, edges[1:]))  # one bit more of a narrower band flips to what no band holds
        two = two.select("wb", F.posexplode(F.array(*of("wb"))).alias("band", "value")).select("wb", "band", F.explode(flipped(F.col("value"), wide)).alias("value"))
    else:
        two = two.select("wb", F.posexplode(F.array(*of("wb"))).alias("band", "value"))
    # Spark does not count on what explode adds and would broadcast these rows: they are to be shuffled and sorted.
    one, two = _spread(one, two)
    met = one.hint("merge").join(two, ["band", "value", "share"]).where("wa < wb").withColumn("hamming", hamming(F.col("wa"), F.col("wb"))).where(F.col("hamming") <= max_distance)
    first = F.coalesce(*(F.when(F.bit_count(x.bitwiseXOR(y)) <= flips, F.lit(k)) for k, (x, y) in enumerate(zip(of("wa"), of("wb")))))
    return met.where(F.col("band") == first).select("wa", "wb", "hamming")


def _spread(one: DataFrame, two: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with a ``share``: rows of a value that many prints have are dealt to shares on one side and repeated for each on the other."""
    many = one.groupBy("band", "value").agg(F.count("*").alias("n")).where(F.col("n") > HOT)
    many = small_side(many.select(F.col("band").alias("b"), F.col("value").alias("v"), F.ceil(F.col("n") / HOT).alias("shares")), "hot-values")
    same = (F.col("band") == F.col("b")) & (F.col("value") == F.col("v"))
    shares = F.coalesce("shares", F.lit(1).cast("long"))
    left = one.join(many, same, "left").select("wa", "band", "value", F.pmod(F.xxhash64("wa"), shares).alias("share"))
    return left, two.join(many, same, "left").select("wb", "band", "value", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1)).alias("share"))


def hamming_pairs(prints: DataFrame, id_col: str, words_col: str, words: int = 4, max_distance: int = 12, flips: int | None = None) -> DataFrame:
    """``(id_a, id_b, hamming)`` of all pairs at most ``max_distance`` bits apart, id_a < id_b.

    Lossless banding, as ``_close_classes`` says: pairs meet by band, in an equi-join.
    Equal prints are one class first, so copies do not meet in every band.  The members
    of a class are lists of about ``MEMBERS`` ids; lists of two classes, or of one, meet as
    rows, which are dealt out evenly and only then become pairs: no pair is shuffled,
    and a large class is spread over many tasks.
    """
    known = _known(prints, id_col, words_col)
    classes = stash(known.groupBy("words").agg(F.count("*").alias("n")), "classes")
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / MEMBERS)).alias("part")
    lists = stash(known.join(classes, "words").groupBy("words", part).agg(F.collect_list("id").alias("ids")), "lists")
    of = lambda w, p, ids: lists.select(F.col("words").alias(w), F.col("part").alias(p), F.col("ids").alias(ids))
    same = classes.select(F.col("words").alias("wa"), F.col("words").alias("wb"), F.lit(0).alias("hamming"))
    close = _close_classes(classes.select("words"), words, max_distance, flips).unionByName(same)
    met = close.join(of("wa", "i", "xs"), "wa").join(of("wb", "j", "ys"), "wb").where("wa <> wb OR i <= j")
    met = stash(met.select("xs", "ys", F.col("hamming").cast("long").alias("hamming"), (F.col("wa").eqNullSafe(F.col("wb")) & (F.col("i") == F.col("j"))).alias("itself")), "lists-met")
    total = met.agg(F.sum(F.size("xs").cast("long") * F.size("ys"))).first()[0] or 0
    dealt = met.repartition(max(1, -(-total // PAIRS_A_TASK)))
    both = dealt.select("ys", "hamming", "itself", F.explode("xs").alias("x")).select("x", "hamming", "itself", F.explode("ys").alias("y")).where("NOT itself OR x < y")
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "hamming")


def hamming_classes(prints: DataFrame, id_col: str, words_col: str, words: int = 4, max_distance: int = 12, flips: int | None = None) -> DataFrame:
    """The pairs of ``hamming_pairs`` by classes of equal prints, each named by its least id: ``(id_a, id_b, hamming)``.

    Rows with hamming 0 are membership: class id_a holds item id_b.  The others are two
    classes; each item of one is so far from each of the other.  No pair is lost, and
    the rows do not grow with the square of the copies.
    """
    known = _known(prints, id_col, words_col)
    classes = stash(known.groupBy("words").agg(F.min("id").alias("id")), "prints")
    close = _close_classes(classes.select("words"), words, max_distance, flips)
    of = lambda side, name: classes.select(F.col("words").alias(side), F.col("id").alias(name))
    met = close.join(of("wa", "x"), "wa").join(of("wb", "y"), "wb").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), F.col("hamming").cast("long").alias("hamming"))
    members = known.join(of("words", "id_a"), "words").where("id > id_a").select("id_a", F.col("id").alias("id_b"), F.lit(0).cast("long").alias("hamming"))
    return met.unionByName(members)


#: Vectors of a block at most; two blocks are compared by one matrix product.
BLOCK_ROWS = 4096
#: Blocks that are wanted of a small table, so that tasks have work, and blocks of a slab, by which partial results are kept.
LEAST_BLOCKS, SLAB_BLOCKS = 24, 32
#: Rows of a block that are compared at once, and pairs whose products are computed in double at once.
CHUNK, EXACT = 512, 1 << 16


def _blocks(vectors: DataFrame, id_col: str, vec_col: str, n: int) -> DataFrame:
    """``(ids, v)``: vectors of length 1 in blocks, ids in a list and numbers in bytes, as a written table."""
    size = max(1, min(BLOCK_ROWS, -(-n // LEAST_BLOCKS)))
    n_blocks = max(1, -(-n // size))
    kind = vectors.schema[id_col].dataType
    known = vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, count = [], 0
        for frame in frames:
            held, count = [*held, frame], count + len(frame)
            if count >= size:
                whole = pd.concat(held)
                for low in range(0, count - count % size, size):
                    yield packed(whole.iloc[low : low + size])
                held, count = [whole.iloc[count - count % size :]], count % size
        if count:
            yield packed(pd.concat(held))

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(rows["v"].map(np.asarray).to_list()).astype(np.float64)
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
        return pd.DataFrame({"ids": [rows["id"].to_list()], "v": [v.tobytes()]})

    dealt = known.repartition(min(n_blocks, 4 * known.sparkSession.sparkContext.defaultParallelism))
    return stash(dealt.mapInPandas(pack, f"ids array<{kind.simpleString()}>, v binary"), "blocks", compression="none")


def _best(mine: np.ndarray, ids: np.ndarray, others: np.ndarray, names: np.ndarray, k: int, least: np.ndarray, rank: bool) -> tuple[np.ndarray, ...]:
    """``(row, name, sim)`` of the k best of ``others`` for each row, from the row's ``least`` up, ties by name.

    Products in single precision, less their error, tell which few can be among them; those are
    computed in double.  ``rank`` looks for the k best of each row first, which pays where ``least`` lets many through.
    """
    slack = 4e-7 * (others.shape[1] + 8)
    a, b = mine.astype(np.float32), others.astype(np.float32)
    found = []
    for low in range(0, len(a), CHUNK):
        sim = a[low : low + CHUNK] @ b.T
        cut = least[low : low + CHUNK]
        if rank and sim.shape[1] > k + 1:  # one of them may be the row itself
            cut = np.maximum(cut, np.partition(sim, sim.shape[1] - k - 1, axis=1)[:, -k - 1])
        i, j = np.nonzero(sim >= (cut - slack)[:, None])
        i = i + low
        i, j = (x[ids[i] != names[j]] for x in (i, j))
        for at in range(0, len(i), EXACT):
            p, q = i[at : at + EXACT], j[at : at + EXACT]
            exact = np.einsum("ij,ij->i", mine[p], others[q])
            good = exact >= least[p]
            found.append(_firsts(p[good], names[q[good]], exact[good], k))
    if not found:
        return np.zeros(0, np.int64), names[:0], np.zeros(0)
    return _firsts(*(np.concatenate(x) for x in zip(*found)), k)


def _firsts(row: np.ndarray, name: np.ndarray, sim: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    order = np.lexsort((name, -sim, row))
    row, name, sim = row[order], name[order], sim[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], name[place < k], sim[place < k]


def cosine_neighbours(vectors: DataFrame, id_col: str, vec_col: str, k: int, least: float = -2.0) -> DataFrame:
    """``(src, dst, sim, place)``: of each vector its k nearest others by cosine, ties by id; those from ``least`` up.

    Exact search: every block of vectors meets every other in a cross join of two reads of
    one written table, so that vectors are shuffled once and not for each block.  A task
    goes through a slab of blocks for each of its own and gives the k best of each
    vector; the best of the slabs are ranked again.  Products grow with the square of the table.
    """
    n = vectors.count()
    blocks = _blocks(vectors, id_col, vec_col, n)
    slabs = max(1, -(-n // (BLOCK_ROWS * SLAB_BLOCKS)))
    mine = blocks.select(F.col("ids").alias("a_ids"), F.col("v").alias("a"))
    met = mine.hint("shuffle_replicate_nl").crossJoin(blocks.coalesce(slabs))
    kind = vectors.schema[id_col].dataType.simpleString()

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = None, None

        def told() -> pa.RecordBatch:
            row, name, sim = held
            return pa.RecordBatch.from_arrays([pa.array(own[1][row], types[0]), pa.array(name, types[0]), pa.array(sim)], names=["src", "dst", "sim"])

        types = [None]
        for batch in batches:
            types[0] = batch.schema.field("a_ids").type.value_type
            lists = [batch.column(c) for c in ("a_ids", "ids")]
            raw = [batch.column(c) for c in ("a", "v")]
            for i in range(batch.num_rows):
                key = raw[0][i].as_py()
                ids = lists[0][i].values.to_numpy(zero_copy_only=False)
                if own is None or own[0] != key or not np.array_equal(own[1], ids):
                    if own is not None:
                        yield told()
                    own, held = (key, ids, np.frombuffer(key).reshape(len(ids), -1)), None
                names = lists[1][i].values.to_numpy(zero_copy_only=False)
                floor = np.full(len(own[1]), float(least))
                if held is not None:  # the k-th best so far
                    last = np.flatnonzero(np.diff(held[0], append=-1) != 0)
                    last = last[last - np.searchsorted(held[0], held[0][last]) == k - 1]
                    floor[held[0][last]] = held[2][last]
                more = _best(own[2], own[1], np.frombuffer(raw[1][i].as_py()).reshape(len(names), -1), names, k, floor, held is None)
                held = more if held is None else _firsts(*(np.concatenate(x) for x in zip(held, more)), k)
        if own is not None:
            yield told()

    found = met.mapInArrow(nearest, f"src {kind}, dst {kind}, sim double")
    place = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("sim"), "dst"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def cosine_pairs(vectors: DataFrame, id_col: str, vec_col: str, threshold: float, k: int = 5) -> DataFrame:
    """``(id_a, id_b, cosine)`` at or above ``threshold`` where either is among the other's k nearest; rounded after the test."""
    near = cosine_neighbours(vectors, id_col, vec_col, k, threshold)
    pairs = near.select(F.least("src", "dst").alias("id_a"), F.greatest("src", "dst").alias("id_b"), "sim")
    return pairs.groupBy("id_a", "id_b").agg(F.round(F.max("sim"), 5).alias("cosine"))


def threshold_sweep(vectors: DataFrame, id_col: str, vec_col: str, groups: DataFrame, group: str, thresholds: list[float], k: int = 5, near: DataFrame | None = None) -> DataFrame:
    """For each threshold its pairs, how many are declared (of one group) and not, and the declared rate.

    ``near`` is the neighbours ``(src, dst, sim)`` if they are known, as from an index.
    """
    spark = vectors.sparkSession
    near = (cosine_neighbours(vectors, id_col, vec_col, k, min(thresholds)) if near is None else near).where(F.col("sim") >= min(thresholds))
    pairs = near.select(F.least("src", "dst").alias("id_a"), F.greatest("src", "dst").alias("id_b"), "sim").groupBy("id_a", "id_b").agg(F.max("sim").alias("sim"))
    of = lambda side: groups.select(F.col(id_col).alias(f"id_{side}"), F.col(group).alias(f"g_{side}"))
    flagged = pairs.join(of("a"), "id_a", "left").join(of("b"), "id_b", "left").withColumn("declared", F.coalesce(F.col("g_a") == F.col("g_b"), F.lit(False)))
    levels = spark.createDataFrame([(t,) for t in thresholds], "threshold double")
    met = F.broadcast(levels).join(flagged, F.col("sim") >= F.col("threshold"), "right").where("threshold IS NOT NULL")
    counts = met.groupBy("threshold").agg(F.count("*").alias("pairs"), F.count_if("declared").alias("declared"))
    all_levels = levels.join(counts, "threshold", "left").select("threshold", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("pairs", "declared")))
    return all_levels.select("threshold", "pairs", "declared", (F.col("pairs") - F.col("declared")).alias("undeclared"), F.round(F.col("declared") / F.nullif("pairs", F.lit(0)), 3).alias("declared_rate"))
