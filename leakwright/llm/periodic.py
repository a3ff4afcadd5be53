"""Periodic runs of words, by a suffix automaton with end-position sets merged small to large.

A run is a stretch of words with a smallest period q that no neighbouring word extends,
of ``min_exponent`` periods and ``min_length`` words at least.  The suffix automaton of
a stretch has a state for each class of its substrings that end at the same positions.
Going up its suffix links, from long states to short, the ordered position sets of a
state's children are merged, the smaller into the larger.  A position that is put in
meets its neighbours there: a distance d between them which the longest string of
the state holds ``min_exponent - 1`` times is a repetition with period d; it begins where
that string first begins.  The seed is then extended to both sides.  Two positions of
one period are neighbours in the state where they first meet, so no run is missed; a
multiple of a period, met by the way, is dropped where the run of the period is.  A set
is kept in blocks, so that putting a position in costs no more in a large one.

Before that, words are cut away which can be in no run: in a run of ``min_exponent``
periods each word occurs that often, so a word that is rarer in its stretch cuts
the stretch, and again in what is left, until nothing changes.  Ordinary prose falls
apart so; the automaton is built of the stretches that stay, and loses no run by it.

Defined cases: null, empty and blank texts have no words and no runs; each row is judged
by itself, so repeated rows and ids get equal results; words are compared as bytes, exactly;
an empty table gives an empty result; further columns are kept by ``collapse_runs``
whatever their names and ignored by ``run_report``.  A text, and the automaton of its
longest stretch, must fit one task: some 400 bytes a word of that stretch.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakwright.llm.textcore import Words, text_slices

#: Positions of a block of a set.
BLOCK = 512

#: Start word, length and period.
Run = tuple[int, int, int]


class Positions:
    """An ordered set of positions in blocks."""

    __slots__ = ("blocks", "tops", "size")

    def __init__(self, first: int):
        self.blocks, self.tops, self.size = [[first]], [first], 1

    def put(self, x: int) -> tuple[int | None, int | None]:
        """Put ``x`` in and return its neighbours before and after."""
        self.size += 1
        k = bisect_left(self.tops, x)
        if k == len(self.tops):
            k -= 1
        block = self.blocks[k]
        at = bisect_left(block, x)
        block.insert(at, x)
        before = block[at - 1] if at else self.blocks[k - 1][-1] if k else None
        after = block[at + 1] if at + 1 < len(block) else self.blocks[k + 1][0] if k + 1 < len(self.blocks) else None
        if len(block) > BLOCK:
            half = len(block) // 2
            self.blocks[k : k + 1] = [block[:half], block[half:]]
            self.tops[k : k + 1] = [block[half - 1], block[-1]]
        else:
            self.tops[k] = block[-1]
        return before, after

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block


def suffix_automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Suffix link and longest length of each state, and the position that each state adds itself, -1 for none."""
    link, length, own = [-1], [0], [-1]
    step: list[dict[int, int]] = [{}]
    last = 0
    for i, c in enumerate(words):
        now = len(length)
        length.append(i + 1)
        own.append(i)
        step.append({})
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = now
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                split = len(length)
                length.append(length[p] + 1)
                own.append(-1)
                step.append(dict(step[q]))
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = split
                    p = link[p]
                link[q] = link[now] = split
        last = now
    return link, length, own


def periodic_runs(words: list[int], min_exponent: int = 4, min_length: int = 6) -> list[Run]:
    """All runs of a sequence, by start and period."""
    link, length, own = suffix_automaton(words)
    sets: list[Positions | None] = [None if x < 0 else Positions(x) for x in own]
    found: dict[tuple[int, int], int] = {}
    times = min_exponent - 1
    for v in np.argsort(-np.array(length), kind="stable").tolist():
        up = link[v]
        if up <= 0:  # the empty string has no repetition
            sets[v] = None
            continue
        here, there = sets[v], sets[up]
        sets[v] = None
        if there is None:
            sets[up] = here
            continue
        if here.size > there.size:
            here, there = there, here
        size, low = length[up], max(1, min_length - length[up])
        for x in here:
            before, after = there.put(x)
            for one, two in ((before, x), (x, after)):
                if one is not None and two is not None:
                    d = two - one
                    if low <= d and times * d <= size:
                        key = (one - size + 1, d)
                        if found.get(key, -1) < two:
                            found[key] = two
        sets[up] = there
    runs: dict[tuple[int, int], int] = {}
    for (start, d), end in found.items():
        while start > 0 and words[start - 1] == words[start - 1 + d]:
            start -= 1
        while end + 1 < len(words) and words[end + 1] == words[end + 1 - d]:
            end += 1
        runs[start, d] = end
    by_start: dict[int, list[int]] = {}
    for start, d in runs:
        by_start.setdefault(start, []).append(d)
    out = []
    for (start, d), end in runs.items():
        smaller = any(q < d and d % q == 0 and runs[start, q] >= end for q in by_start[start])
        if not smaller and end - start + 1 >= max(min_length, min_exponent * d):
            out.append((start, end - start + 1, d))
    return sorted(out, key=lambda r: (r[0], r[2]))


def stretches(codes: np.ndarray, owner: np.ndarray, min_exponent: int, min_length: int) -> Iterator[tuple[int, int]]:
    """Edges of the stretches that can hold a run: in each, every word occurs ``min_exponent`` times."""
    at, part = np.arange(len(codes)), owner.astype(np.int64)
    base = int(codes.max()) + 1 if len(codes) else 1
    while len(at):
        _, inverse, often = np.unique(part * base + codes[at], return_inverse=True, return_counts=True)
        stay = often[inverse] >= min_exponent
        if stay.all():
            break
        at, part = at[stay], part[stay]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (part[1:] != part[:-1])
        part = np.cumsum(new) - 1
        long = np.bincount(part)[part] >= min_length if len(part) else new
        at, part = at[long], part[long]
    if len(at):
        cuts = np.flatnonzero((np.diff(at) != 1) | (np.diff(part) != 0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)]):
            yield int(at[a]), int(at[b - 1]) + 1


def planted_tail(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """First word and period of the tail that the audit makes periodic: of ids whose crc32 is divisible by 10."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


Plant = Callable[[int | None, int], tuple[int, int] | None]


class Text:
    """The runs of one text and its words, as bytes."""

    def __init__(self, words: list[bytes], runs: list[Run]):
        self.words, self.runs = words, runs

    def collapsed(self) -> bytes:
        """The words left when every run keeps its first period only, joined by one space."""
        if not self.runs:
            return b" ".join(self.words)
        mark = np.zeros(len(self.words) + 1, dtype=np.int64)
        for start, length, q in self.runs:
            mark[start + q] += 1
            mark[start + length] -= 1
        gone = np.cumsum(mark)[:-1] > 0
        return b" ".join(w for w, g in zip(self.words, gone.tolist()) if not g)

    def strongest(self) -> Run | None:
        """The run of the greatest exponent, then the smallest start, then period."""
        best = None
        for start, length, q in self.runs:
            if best is None or length * best[2] > best[1] * q:
                best = (start, length, q)
        return best


def texts_with_runs(column: pa.Array, ids: list[int | None] | None, min_exponent: int, min_length: int, plant: Plant | None) -> Iterator[Text]:
    """Each text of a column, in order; with ``plant`` its tail is made periodic first."""
    for at, end, data, offsets in text_slices(column):
        words = Words(data, offsets)
        codes, _ = words.distinct()
        first, counts = words.first, words.counts
        source = np.arange(len(codes))
        if plant:
            for i in range(end - at):
                if tail := plant(ids[at + i], int(counts[i])):
                    a, p = tail
                    source[first[i] + a : first[i] + counts[i]] = first[i] + a + np.arange(counts[i] - a) % p
            codes = codes[source]
        owner = np.repeat(np.arange(end - at), counts)
        found: dict[int, list[Run]] = {}
        for a, b in stretches(codes, owner, min_exponent, min_length):
            i = int(owner[a])
            for start, length, q in periodic_runs(codes[a:b].tolist(), min_exponent, min_length):
                found.setdefault(i, []).append((a - int(first[i]) + start, length, q))
        raw = data.tobytes()
        for i in range(end - at):
            own = raw[offsets[i] : offsets[i + 1]].split()
            if plant:
                moved = source[first[i] : first[i] + counts[i]] - first[i]
                own = [own[k] for k in moved.tolist()] if plant(ids[at + i], int(counts[i])) else own
            yield Text(own, sorted(found.get(i, []), key=lambda r: (r[0], r[2])))


_REPORT = pa.schema([("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])


def run_report(docs: DataFrame, min_exponent: int = 4, min_length: int = 6, id_col: str = "doc_id", text_col: str = "text", plant: Plant | None = None) -> DataFrame:
    """Per document: doc_id, n_runs, start, length, period and exponent_milli of the strongest run, runs_sha256 and collapsed_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column("doc_id").to_pylist(), []
            for text in texts_with_runs(batch.column("text"), ids, min_exponent, min_length, plant):
                start, length, q = text.strongest() or (None, None, None)
                listed = "".join(f"{s},{n},{p}\n" for s, n, p in text.runs)
                rows.append((len(text.runs), start, length, q, 1000 * length // q if q else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text.collapsed()).hexdigest()))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, f.type) for x, f in zip(zip(*rows), list(_REPORT)[1:]))], schema=_REPORT)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")


def list_runs(docs: DataFrame, min_exponent: int = 4, min_length: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each run: doc_id, start word, length, period and ``unit``, the words of its first period."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("unit", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, text in zip(batch.column("doc_id").to_pylist(), texts_with_runs(batch.column("text"), None, min_exponent, min_length, None)):
                rows += [(i, s, n, q, b" ".join(text.words[s : s + q]).decode()) for s, n, q in text.runs]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, start long, length long, period long, unit string")


def collapse_runs(docs: DataFrame, min_exponent: int = 4, min_length: int = 6, text_col: str = "text") -> DataFrame:
    """``docs``, all columns, where a text with a run keeps the first period of each; other texts stay as they are."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place)
            new = [t if not x.runs else x.collapsed().decode() for t, x in zip(texts.to_pylist(), texts_with_runs(texts, None, min_exponent, min_length, None))]
            columns = list(batch.columns)
            columns[place] = pa.array(new, texts.type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
