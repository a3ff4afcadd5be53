"""Source divergence audit by sketch-prefiltered counting.

Terms are runs of ASCII letters and other characters above ASCII, A-Z lower-cased.  A
language keeps the terms that stand in ``min_df`` of its documents at least; its sources
are compared by what share of the kept terms each gives to a term, in whole billionths.

First pass: every task adds the document frequencies of its (language, term) pairs to a
count-min sketch, and the tasks' sketches are merged block by block.  A cell stops
counting at ``min_df``, so it fits a byte; a sketch never says less than the true
frequency or ``min_df``.  Second pass: a term whose cells do not all reach ``min_df`` cannot
be kept and is never shuffled.  The survivors are counted exactly, by strings, in the task
first, and those that the sketch let through in vain are dropped by their exact
frequency.  The sketch has ``DEPTH`` rows of eight cells a document up to ``MAX_WIDTH``
cells; beyond that it lets more through, and the result is the same.

Distances of sources are summed over the terms that both have, in a join on the term.
What terms that one source has add is summed against the other's floor, the share of a
term that it lacks, by running sums over the source's distinct shares; terms that
neither has add the distance of the floors.

Defined cases: null text, language and source are empty strings; a text without terms
counts as a document of its group, and a group without kept terms is listed with its
pairs; where a language keeps no term all distances are 0; repeated rows are documents
of their own; an empty table gives an empty result; further columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakwright.llm.textcore import FIRST, Words, mix, text_slices
from leakwright.sources.shared_tables import discard, stash

#: Rows of the sketch, cells of a row at least and at most, and cells that are sent as one value.
DEPTH, MIN_WIDTH, MAX_WIDTH, BLOCK = 4, 1 << 16, 1 << 24, 1 << 16
#: A task's counts are added up whenever it has gathered so many rows.
GATHERED_ROWS = 500_000
#: A table of groups of up to so many rows is broadcast, a larger one is joined.
BROADCAST_GROUPS = 100_000

_BREAKS = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])
_GOLD = np.uint64(0x9E3779B97F4A7C15)


class Tally:
    """Terms of a slice of texts: how often each group of rows has them, and in how many rows."""

    def __init__(self, words: Words, group: np.ndarray):
        codes, self.terms = words.distinct()
        self.n_terms = max(1, len(self.terms))
        row = np.repeat(np.arange(len(group)), words.counts)
        cells, times = np.unique(row * self.n_terms + codes, return_counts=True)
        self.row, self.term, self.times = cells // self.n_terms, cells % self.n_terms, times
        self.group = group[self.row]

    def hashes(self) -> np.ndarray:
        _, edges, body = self.terms.buffers()
        edges = np.frombuffer(edges, dtype=np.int64)[: len(self.terms) + 1]
        data = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
        return FIRST.words(data, edges[:-1], edges[1:])

    def cells(self, key: np.ndarray, lang: np.ndarray, names: list[str], width: int) -> Iterator[np.ndarray]:
        """For each row of the sketch the cells of keys, which are language * n_terms + term."""
        raw = [n.encode() for n in names]
        edges = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        salt = FIRST.words(np.frombuffer(b"".join(raw), dtype=np.uint8), edges[:-1], edges[1:])
        with np.errstate(over="ignore"):
            x = self.hashes()[key % self.n_terms] ^ mix(salt * _GOLD)[key // self.n_terms]
            for r in range(DEPTH):
                yield (mix(x + np.uint64(r + 1) * _GOLD) & np.uint64(width - 1)).astype(np.int64)


def _cell_type(min_df: int) -> np.dtype:
    return np.dtype(np.uint8 if min_df < 256 else np.uint32)


def _coded(column: pa.Array, known: dict[str, int]) -> np.ndarray:
    """Numbers of the values of a column, the same throughout a task."""
    coded = column.dictionary_encode()
    numbers = np.array([known.setdefault(v, len(known)) for v in coded.dictionary.to_pylist()], dtype=np.int64)
    return numbers[coded.indices.to_numpy(zero_copy_only=False)] if len(column) else np.zeros(0, dtype=np.int64)


def _slices(batches: Iterator[pa.RecordBatch], langs: dict[str, int], groups: dict[tuple[int, str], int]) -> Iterator[tuple[Tally, np.ndarray]]:
    """The tally of each slice by (language, source), and the language of each group so far."""
    for batch in batches:
        sources: dict[str, int] = {}
        lang, source = _coded(batch.column("lang"), langs), _coded(batch.column("source"), sources)
        names = list(sources)
        pairs, inverse = np.unique(lang * max(1, len(names)) + source, return_inverse=True)
        number = np.array([groups.setdefault((int(p) // len(names), names[int(p) % len(names)]), len(groups)) for p in pairs], dtype=np.int64)
        group = number[inverse] if len(pairs) else np.zeros(0, dtype=np.int64)
        of = np.array([k[0] for k in groups], dtype=np.int64)
        for at, end, data, offsets in text_slices(batch.column("text")):
            yield Tally(Words(data, offsets, lower=True, breaks=_BREAKS), group[at:end]), of


def _sketch(width: int, min_df: int):
    """Document frequencies of a task's (language, term) pairs as blocks of cells."""
    kind = _cell_type(min_df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs: dict[str, int] = {}
        cells = np.zeros((DEPTH, width), dtype=kind)
        for tally, lang_of in _slices(batches, langs, {}):
            keys, docs = np.unique(lang_of[tally.group] * tally.n_terms + tally.term, return_counts=True)
            for r, at in enumerate(tally.cells(keys, lang_of, list(langs), width)):
                at, inverse = np.unique(at, return_inverse=True)
                more = np.bincount(inverse, weights=docs, minlength=len(at))
                cells[r, at] = np.minimum(cells[r, at] + more, min_df).astype(kind)
        yield from _as_blocks({k: b for k, b in enumerate(cells.reshape(-1, BLOCK)) if b.any()})

    return run


def _as_blocks(blocks: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for k, block in blocks.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([block.tobytes()], pa.binary())], names=["block", "cells"])


def _merged(min_df: int):
    """Blocks of one number added up, a batch at a time; a task holds one copy of its blocks."""
    kind = _cell_type(min_df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column("block").to_pylist(), batch.column("cells")):
                part = np.frombuffer(raw.as_buffer(), dtype=kind).astype(np.int64)
                sums[k] = np.minimum(part + sums[k], min_df).astype(kind) if k in sums else part.astype(kind)
        yield from _as_blocks(sums)

    return run


def document_frequency_sketch(rows: DataFrame, min_df: int, width: int) -> np.ndarray:
    """The merged sketch of ``(lang, source, text)``, ``DEPTH`` rows of ``width`` cells."""
    blocks = rows.mapInArrow(_sketch(width, min_df), "block long, cells binary")
    merged = blocks.repartition("block").mapInArrow(_merged(min_df), "block long, cells binary")
    cells = np.zeros((DEPTH * width // BLOCK, BLOCK), dtype=_cell_type(min_df))
    for row in merged.collect():  # the sketch, DEPTH * MAX_WIDTH cells at most
        cells[row["block"]] = np.frombuffer(bytes(row["cells"]), dtype=cells.dtype)
    return cells.reshape(DEPTH, width)


def _survivors(shared, min_df: int):
    """``(lang, source, term, n, docs)`` of terms that the sketch does not rule out, added up in the task."""

    def added(gathered: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(gathered).group_by(["group", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")]).rename_columns(["group", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch: np.ndarray = shared.value
        langs: dict[str, int] = {}
        groups: dict[tuple[int, str], int] = {}
        gathered, waiting = [], 0

        def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
            names = list(langs)
            lang, source = pa.array([names[k[0]] for k in groups], pa.string()), pa.array([k[1] for k in groups], pa.string())
            for part in table.to_batches(max_chunksize=50_000):
                group = part.column("group")
                yield pa.RecordBatch.from_arrays([lang.take(group), source.take(group), part.column("term").cast(pa.string()), part.column("n"), part.column("docs")], names=["lang", "source", "term", "n", "docs"])

        for tally, lang_of in _slices(batches, langs, groups):
            keys, inverse = np.unique(lang_of[tally.group] * tally.n_terms + tally.term, return_inverse=True)
            may = np.ones(len(keys), dtype=bool)
            for r, at in enumerate(tally.cells(keys, lang_of, list(langs), sketch.shape[1])):
                may &= sketch[r, at] >= min_df
            stay = may[inverse]
            cells, inverse = np.unique(tally.group[stay] * tally.n_terms + tally.term[stay], return_inverse=True)
            n = np.bincount(inverse, weights=tally.times[stay], minlength=len(cells)).astype(np.int64)
            docs = np.bincount(inverse, minlength=len(cells)).astype(np.int64)
            gathered.append(pa.table({"group": cells // tally.n_terms, "term": tally.terms.take(pa.array(cells % tally.n_terms)), "n": n, "docs": docs}))
            waiting += len(cells)
            if waiting > GATHERED_ROWS:
                whole = added(gathered)
                gathered, waiting = [whole], len(whole)
                if waiting > GATHERED_ROWS // 2:
                    yield from out(whole)
                    gathered, waiting = [], 0
        if gathered:
            yield from out(added(gathered))

    return run


def term_counts(docs: DataFrame, min_df: int = 30, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(lang, source, term, n, total)`` of kept terms, total being the language's, and ``(lang, source, mass, terms, lang_mass)`` of all groups, as written tables."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(empty(lang_col).alias("lang"), empty(source_col).alias("source"), empty(text_col).alias("text"))
    named = rows.groupBy("lang", "source").agg(F.count("*").alias("rows"))
    named = stash(named, "groups")
    n_docs = named.agg(F.sum("rows")).first()[0] or 0
    width = min(MAX_WIDTH, max(MIN_WIDTH, 1 << (8 * n_docs).bit_length()))
    sketch = document_frequency_sketch(rows, min_df, width)
    found = rows.mapInArrow(_survivors(docs.sparkSession.sparkContext.broadcast(sketch), min_df), "lang string, source string, term string, n long, docs long")
    counts = stash(found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    kept = stash(counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total")).where(F.col("docs") >= min_df).select("lang", "term", "total"), "kept")
    scored = stash(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "total"), "scored")
    own = scored.groupBy("lang", "source").agg(F.sum("n").alias("mass"))
    whole = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_mass"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    groups = stash(named.join(own, ["lang", "source"], "left").join(_sized(whole), "lang", "left").select("lang", "source", zero("mass"), zero("terms"), zero("lang_mass")), "groups")
    for table in (counts, kept, named):
        discard(table)
    return scored, groups


def _sized(small: DataFrame) -> DataFrame:
    return F.broadcast(small) if small.count() <= BROADCAST_GROUPS else small


def share(n: Column, mass: Column, terms: Column) -> Column:
    """A term's share in whole billionths, exact for counts of any size: 1 + 1000000000 * (n + 5) DIV (mass + 5 * terms)."""
    whole = (mass + 5 * terms).cast("decimal(20,0)")
    part = F.lit(1_000_000_000).cast("decimal(10,0)") * (n + 5).cast("decimal(20,0)")
    return F.when(whole > 0, 1 + F.call_function("div", part, whole))


def pair_distances(scored: DataFrame, groups: DataFrame) -> DataFrame:
    """``(lang, source, item, value)`` of every two sources of a language, both ways."""
    floors = groups.select("lang", "source", "terms", share(F.lit(0), F.col("mass"), F.col("terms")).alias("floor"))
    shares = scored.join(_sized(groups), ["lang", "source"]).select("lang", "source", "term", share(F.col("n"), F.col("mass"), F.col("terms")).alias("p"), share(F.lit(0), F.col("mass"), F.col("terms")).alias("floor"))
    # Both have the term: their distance, in place of what each would add alone.
    one = shares.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("floor").alias("fa"))
    two = shares.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("floor").alias("fb"))
    gap = lambda x, y: F.abs(F.col(x) - F.col(y))
    shared = one.join(two, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b").agg(F.sum(gap("pa", "pb") - gap("pa", "fb") - gap("fa", "pb") + gap("fa", "fb")).alias("more"))
    # A source's terms against another's floor: running sums over the source's distinct shares.
    levels = shares.groupBy("lang", "source", F.col("p").alias("level")).agg(F.count("*").alias("k"))
    asked = floors.select("lang", "source", F.col("terms"), F.col("floor").alias("own")).join(floors.select("lang", F.col("source").alias("item"), F.col("floor").alias("level")), "lang").where("source <> item")
    both = levels.unionByName(asked, allowMissingColumns=True)
    group = Window.partitionBy("lang", "source")
    below = group.orderBy("level", F.col("item").isNull(), "item").rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda c: F.coalesce(F.sum(c).over(below), F.lit(0))
    whole = lambda c: F.coalesce(F.sum(c).over(group), F.lit(0))
    mass = F.coalesce(F.col("k") * F.col("level"), F.lit(0))
    summed = both.withColumn("m", mass).withColumns({"k0": upto("k"), "m0": upto("m"), "k1": whole("k"), "m1": whole("m")}).where("item IS NOT NULL")
    alone = F.col("m1") - 2 * F.col("m0") + (2 * F.col("k0") - F.col("k1")) * F.col("level") - F.col("k1") * gap("own", "level")
    sides = summed.select("lang", F.least("source", "item").alias("a"), F.greatest("source", "item").alias("b"), alone.alias("alone"), (F.col("terms") * gap("own", "level")).alias("neither"))
    sums = sides.groupBy("lang", "a", "b").agg(F.sum("alone").alias("alone"), F.max("neither").alias("neither"))
    value = F.coalesce(F.col("neither") + F.col("alone") + F.coalesce("more", F.lit(0)), F.lit(0)).cast("long")
    met = sums.join(shared, ["lang", "a", "b"], "left").select("lang", "a", "b", value.alias("value"))
    return met.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"), "value").select("lang", "x.source", "x.item", "value")


def term_excess(scored: DataFrame, groups: DataFrame, top: int = 50) -> DataFrame:
    """``(lang, source, item, value, rank)``: terms of a source with a greater share than in its language, the ``top`` first."""
    met = scored.join(_sized(groups), ["lang", "source"])
    over = share(F.col("n"), F.col("mass"), F.col("terms")) - share(F.col("total"), F.col("lang_mass"), F.col("terms"))
    rows = met.select("lang", "source", F.col("term").alias("item"), over.alias("value")).where("value > 0")
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return rows.withColumn("rank", place).where(F.col("rank") <= top)


def source_divergence(docs: DataFrame, min_df: int = 30, top: int = 50, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``(lang, source, part, item, value, rank)``: how far each source is from the others of its language (``pair``), and by which terms from the language (``term``)."""
    scored, groups = term_counts(docs, min_df, lang_col, source_col, text_col)
    pairs = pair_distances(scored, groups)
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    parts = [(pairs, "pair"), (term_excess(scored, groups, top), "term")]
    one, two = (p.select("lang", "source", F.lit(name).alias("part"), "item", F.col("value").cast("long"), F.col("rank").cast("int")) for p, name in parts)
    return one.unionByName(two)
