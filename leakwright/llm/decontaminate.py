"""Benchmark decontamination by greedy string tiling.

Words are what stands between white space, punctuation and symbols of the lower-cased
text, in Unicode's sense, so
punctuation, typographic too, and case do not hide a passage.  Every run of ``min_match`` words of a
document whose Karp-Rabin hash is also a run of a benchmark item is a seed.  Seeds are
joined by distinct hash, and name the documents and items that can have enough in
common: an item of which seeds cover too little is left out.  For the others tiles
are laid greedily: running Karp-Rabin hashes find the longest match whose words are all
unmarked in both texts, it is marked, and so on down to ``min_match`` words.  Of equally
long ones the first in the document goes first, then the first in the item; all tiles of
a length are laid in one walk.  The share
of an item's words under tiles is its coverage, which does not care in which order its
passages stand in the document.  Time for a document and an item is that of a walk
for each length of a tile that occurs, memory grows with their lengths.

Documents are judged one by one, where they lie; no text is shuffled.  The
benchmark is a query set: it is sent to the executors in blocks of a checked size,
``block_bytes``, with one pass over the documents a block; of several blocks each one's
result is written, and the block leaves the executors and the driver.

Defined cases: null text has no words; an item with fewer than ``min_match`` words is
covered where it stands whole; one without words matches nothing; equal items and
equal rows are each reported; an empty benchmark matches nothing; an empty table gives
an empty result; columns of any name are kept by ``drop_leaks`` and ignored otherwise.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakwright.functions.naming import unused
from leakwright.llm.textcore import FIRST, Words, text_slices
from leakwright.sources.shared_tables import stash

_BREAKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: Unicode's categories of what separates words: punctuation, separators, symbols and controls.
BREAK_CATEGORIES = ("P", "Z", "S", "Cc")


def plain_breaks(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with spaces in place of the punctuation, spaces and symbols above ASCII."""
    lead = np.flatnonzero(data >= 0xC2)
    if not len(lead):
        return data
    first = data[lead].astype(np.int64)
    size = 2 + (first >= 0xE0) + (first >= 0xF0)
    point = first & np.where(size == 2, 0x1F, np.where(size == 3, 0x0F, 0x07))
    end = len(data) - 1  # text that is cut off inside a character must not break the walk
    for k in range(1, 4):
        more = size > k
        point[more] = point[more] << 6 | data[np.minimum(lead[more] + k, end)] & 0x3F
    known, inverse = np.unique(np.minimum(point, 0x10FFFF), return_inverse=True)
    breaks = np.array([unicodedata.category(chr(p)).startswith(BREAK_CATEGORIES) for p in known.tolist()])[inverse]
    out = data.copy()
    for k in range(4):
        out[np.minimum(lead[breaks & (size > k)] + k, end)] = 32
    return out


#: Document seeds and items that are paired at once.
PAIRS_AT_ONCE = 1 << 20


def _words(data: np.ndarray, offsets: np.ndarray) -> Words:
    return Words(plain_breaks(data), offsets, breaks=_BREAKS)


def _runs_of(free: np.ndarray, k: int) -> np.ndarray:
    """Where k free words in a row begin."""
    if len(free) < k:
        return np.zeros(0, dtype=np.int64)
    taken = np.concatenate([[0], np.cumsum(~free)])
    return np.flatnonzero(taken[k:] == taken[:-k])


class Tiling:
    """Two sequences of word hashes and which of their words are free of tiles."""

    def __init__(self, item: np.ndarray, text: np.ndarray, k: int):
        self.item, self.text = item, text
        self.sums = [FIRST.prefixes(x) for x in (item, text)]
        self.free = [np.ones(len(x), dtype=bool) for x in (item, text)]
        # Only words under a common run of k words can come under a tile.
        own, there = (FIRST.at(s, np.arange(max(0, len(x) - k + 1)), k) for s, x in zip(self.sums, (item, text)))
        for side, (mine, other) in enumerate(((own, there), (there, own))):
            seeds = np.isin(mine, other)
            mark = np.zeros(len(self.free[side]) + 1, dtype=np.int64)
            mark[: len(seeds)] += seeds
            mark[k : k + len(seeds)] -= seeds
            self.free[side] &= np.cumsum(mark)[:-1] > 0

    def common(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places and running Karp-Rabin hashes of runs of n free words that item and text have in common."""
        i, j = (_runs_of(f, n) for f in self.free)
        own, there = FIRST.at(self.sums[0], i, n), FIRST.at(self.sums[1], j, n)
        mine, others = np.isin(own, there), np.isin(there, own)
        return i[mine], own[mine], j[others], there[others]

    def lay(self, n: int) -> int:
        """Lay all tiles of n words, which no longer match passes: first in the text, then in the item."""
        i, own, j, there = self.common(n)
        order = np.argsort(own, kind="stable")
        i, own = i[order], own[order]
        at, upto = np.searchsorted(own, there), np.searchsorted(own, there, side="right")
        next_of: dict[int, int] = {}
        free_item, free_text = self.free
        laid, after = 0, 0
        for place, first, last in zip(j.tolist(), at.tolist(), upto.tolist()):
            if place < after:
                continue
            k = next_of.get(first, first)
            # Marked words stay marked: a place of the item that is passed over is never looked at again.
            while k < last and not (free_item[i[k]] and free_item[i[k] + n - 1]):
                k += 1
            next_of[first] = k
            same = k
            while same < last and not (free_item[i[same]] and free_item[i[same] + n - 1] and (self.item[i[same] : i[same] + n] == self.text[place : place + n]).all()):
                same += 1
            if same < last:
                free_item[i[same] : i[same] + n] = free_text[place : place + n] = False
                laid, after = laid + 1, place + n
        return laid


def tile(item: np.ndarray, text: np.ndarray, k: int) -> list[int]:
    """Lengths of the tiles laid on two sequences of word hashes, longest first.

    A common run of n words holds one of n - 1, so the longest is found by halving; then
    all tiles of that length are laid in one walk.  Lengths that differ add up to no more
    than the item, so there are few walks, each linear in both sequences.
    """
    board, tiles, most = Tiling(item, text, k), [], min(len(item), len(text))
    while most >= k:
        low, high = k - 1, most
        while low < high:
            n = (low + high + 1) // 2
            if len(board.common(n)[0]):
                low = n
            else:
                high = n - 1
        if low < k:
            break
        tiles += [low] * board.lay(low)
        most = low - 1
    return tiles


class Benchmark:
    """The items of a block and, for every distinct seed, the items that have it and how often."""

    def __init__(self, items: list[tuple[int | None, str | None]], min_match: int):
        self.min_match = min_match
        self.names = [i for i, _ in items]
        self.words: list[np.ndarray] = []
        seeds, owners, self.short = [], [], {}
        for at, _, data, offsets in text_slices(pa.array([(t or "").lower() for _, t in items], pa.large_string())):
            words = _words(data, offsets)
            own = words.hashes()
            starts, text = words.runs(min_match)
            seeds.append(FIRST.windows(own, starts, min_match))
            owners.append(at + text)
            self.words += [own[f : f + n] for f, n in zip(words.first, words.counts)]
        for item, own in enumerate(self.words):
            if 0 < len(own) < min_match:
                key = int(FIRST.windows(own, np.zeros(1, dtype=np.int64), len(own))[0])
                self.short.setdefault(len(own), {}).setdefault(key, []).append(item)
        both = np.zeros(sum(map(len, seeds)), dtype=[("seed", np.uint64), ("item", np.int64)])
        if len(both):
            both["seed"], both["item"] = np.concatenate(seeds), np.concatenate(owners)
        both, self.often = np.unique(both, return_counts=True)
        self.seeds, self.owners = both["seed"], both["item"]
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[self.seeds >> np.uint64(44)] = True

    def candidates(self, words: Words, own: np.ndarray, coverage: float) -> Iterator[tuple[int, int]]:
        """``(text, item)`` whose common seeds can cover the share asked for."""
        k = self.min_match
        starts, text = words.runs(k)
        found = FIRST.windows(own, starts, k)
        near = self.maybe[found >> np.uint64(44)]
        seen = np.zeros(int(near.sum()), dtype=[("text", np.int64), ("seed", np.uint64)])
        seen["text"], seen["seed"] = text[near], found[near]
        seen = np.unique(seen)
        low, high = np.searchsorted(self.seeds, seen["seed"]), np.searchsorted(self.seeds, seen["seed"], side="right")
        some = high > low
        seen, low, n = seen[some], low[some], (high - low)[some]
        upto = np.cumsum(n)
        lengths = np.array([len(x) for x in self.words])
        held: dict[tuple[int, int], int] = {}
        at = 0
        while at < len(n):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS_AT_ONCE, side="right")))
            each = np.repeat(np.arange(at, end), n[at:end])
            entry = low[each] + np.arange(len(each)) - np.repeat(np.cumsum(n[at:end]) - n[at:end], n[at:end])
            pairs, code = np.unique(np.stack([seen["text"][each], self.owners[entry]]), axis=1, return_inverse=True)
            for (t, item), c in zip(pairs.T.tolist(), np.bincount(code.ravel(), weights=self.often[entry]).tolist()):
                held[t, item] = held.get((t, item), 0) + int(c)
            at = end
        for (t, item), c in sorted(held.items()):
            if min(c * k, lengths[item]) >= coverage * lengths[item]:
                yield t, item

    def matches(self, words: Words, coverage: float = 0.0) -> Iterator[tuple[int, int, float, int, int]]:
        """``(text, item, coverage, tiles, longest tile)`` of each text and item with a tile and a coverage of so much."""
        own = words.hashes()
        for t, item in self.candidates(words, own, coverage):
            there = own[words.first[t] : words.first[t] + words.counts[t]]
            tiles = tile(self.words[item], there, self.min_match)
            share = sum(tiles) / len(self.words[item])
            if tiles and share >= coverage:
                yield t, item, share, len(tiles), max(tiles)
        for n, known in self.short.items():
            starts, text = words.runs(n)
            found = FIRST.windows(own, starts, n)
            hits = np.flatnonzero(np.isin(found, np.array(list(known), dtype=np.uint64)))
            for t, key in sorted(set(zip(text[hits].tolist(), found[hits].tolist()))):
                for item in known[key]:
                    yield t, item, 1.0, 1, n


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, min_match: int, block_bytes: int) -> Iterator[tuple[Benchmark, bool]]:
    """The benchmark in blocks, and whether there is only one."""
    items = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.lower(F.col(text_col).cast("string")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // block_bytes) or 1
    if n > 1:  # dealt out by row: equal items are spread over the blocks
        items = stash(items.withColumn("deal", F.xxhash64(F.monotonically_increasing_id())), "items")
    else:
        items = items.withColumn("deal", F.lit(0))
    for b in range(n):
        rows = items.where(F.pmod("deal", F.lit(n)) == b).collect()
        yield Benchmark([(r["item_id"], r["text"]) for r in rows], min_match), n == 1


def _settled(found: DataFrame, shared, alone: bool) -> DataFrame:
    """The result of one of several blocks is written, so that the block can go."""
    if alone:
        return found
    found = stash(found, "block")
    shared.destroy()
    return found


_FOUND = "doc_id long, item_id long, coverage double, n_tiles long, longest_tile long"


def _find(shared, coverage: float):
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("n_tiles", pa.int64()), ("longest_tile", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Benchmark = shared.value
        for batch in batches:
            ids = batch.column("doc_id")
            for at, _, data, offsets in text_slices(batch.column("text")):
                hits = [(ids[at + t].as_py(), block.names[i], c, n, m) for t, i, c, n, m in block.matches(_words(data, offsets), coverage)]
                if hits:
                    yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*hits), schema)], schema=schema)

    return run


def _drop(shared, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Benchmark = shared.value
        for batch in batches:
            keep = np.ones(batch.num_rows, dtype=bool)
            for at, _, data, offsets in text_slices(batch.column(batch.num_columns - 1)):
                for t, *_ in block.matches(_words(data, offsets), coverage):
                    keep[at + t] = False
            yield batch.select(list(range(batch.num_columns - 1))).filter(pa.array(keep))

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_match: int = 5, coverage: float = 0.5, block_bytes: int = 16 << 20) -> DataFrame:
    """One row for each document and item of which at least ``coverage`` is tiled: doc_id, item_id, coverage, n_tiles, longest_tile."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lower(F.col(text_col).cast("string")).alias("text"))
    out = None
    for block, alone in _blocks(benchmark, item_col, item_text_col, min_match, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        found = _settled(rows.mapInArrow(_find(shared, coverage), _FOUND), shared, alone)
        out = found if out is None else out.unionByName(found)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_match: int = 5, coverage: float = 0.5, block_bytes: int = 16 << 20) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark item.

    Null and empty texts, repeated rows and ids are judged by their text alone.
    """
    out, lowered = docs, unused(docs.columns, "lowered")[0]
    for block, alone in _blocks(benchmark, item_col, item_text_col, min_match, block_bytes):
        judged = out.select("*", F.lower(F.col(text_col).cast("string")).alias(lowered))
        shared = docs.sparkSession.sparkContext.broadcast(block)
        out = _settled(judged.mapInArrow(_drop(shared, coverage), docs.schema), shared, alone)
    return out
