"""Substring dedup by difference-cover anchors.

A window is ``window`` consecutive words of one text.  A word goes if some window
that covers it has a word sequence which also starts in a document of smaller id.

Only windows at *cover positions* are hashed first.  D is a perfect difference set
modulo a period v, so for any two positions i and j there is a shift below v after
which both stand on D.  Two equal windows therefore share an anchor of
``window - v + 1`` words that stands at a cover position in both texts.  Anchors
found in two documents mark the places where long matches can lie; only there
every whole window is hashed, by two independent families of 61 bits, and matched to
the smallest document that has it.  That second step is the extension of anchors to
long matches; it neither samples nor pairs the members of a group.  Windows are matched
in ``PASSES`` passes by their hash, so that only a share of them is shuffled at a time.

Defined cases: null text has no words; empty and short texts keep all words; null
ids neither remove words nor lose them; rows with equal ids never remove each
other's words; equal rows get equal results; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakwright.llm.textcore import FIRST, SECOND, Words, signed, text_slices
from leakwright.sources.shared_tables import discard, release, stash

#: Passes in which windows are matched.
PASSES = 2

#: Perfect difference sets, period to members.
DIFFERENCE_SETS = {
    3: (0, 1),
    7: (0, 1, 3),
    13: (0, 1, 3, 9),
    21: (0, 1, 4, 14, 16),
    31: (0, 1, 3, 8, 12, 18),
}


def cover_for(window: int) -> tuple[int, tuple[int, ...], int]:
    """Period, members and anchor length for a window: anchors keep two fifths of it at least."""
    period = max((p for p in DIFFERENCE_SETS if window - p + 1 >= max(1, 2 * window // 5)), default=0)
    return (period, DIFFERENCE_SETS[period], window - period + 1) if period else (1, (0,), window)


def _anchors(words: Words, hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start word and text number of each anchor of texts that hold a whole window."""
    period, members, length = cover_for(window)
    starts, text = words.runs(length)
    keep = np.isin((starts - words.first[text]) % period, members) & (words.counts[text] >= window)
    starts, text = starts[keep], text[keep]
    return FIRST.windows(hashes, starts, length), starts, text


def _batch(rows: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], type=f.type) for f in schema], schema=schema)


_ANCHOR = pa.schema([("anchor", pa.int64()), ("doc_id", pa.int64())])
_WINDOW = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int64())])
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
_KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.large_string())])


def _emit_anchors(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for at, _, data, offsets in text_slices(batch.column("text")):
                words = Words(data, offsets)
                anchors, _, text = _anchors(words, words.hashes(), window)
                if not len(anchors):
                    continue
                order = np.lexsort((anchors, text))
                anchors, text = anchors[order], text[order]
                new = np.ones(len(anchors), dtype=bool)
                new[1:] = (anchors[1:] != anchors[:-1]) | (text[1:] != text[:-1])
                yield _batch({"anchor": signed(anchors[new]), "doc_id": ids[at + text[new]]}, _ANCHOR)

    return run


def _place(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text 31 bits of its digest, shifted left: tells apart the positions of rows with equal ids."""
    raw = data.tobytes()
    return np.array([int.from_bytes(hashlib.blake2b(raw[a:b], digest_size=4).digest(), "big") >> 1 for a, b in zip(offsets[:-1], offsets[1:])], dtype=np.int64) << 32


def _flat_lists(column: pa.Array, at: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of the lists of rows at..end, and the row (from 0) of each value."""
    part = column.slice(at, end - at)
    sizes = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return part.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(end - at), sizes)


def _emit_windows(window: int):
    length = cover_for(window)[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for at, end, data, offsets in text_slices(batch.column("text")):
                words = Words(data, offsets)
                hashes = words.hashes()
                anchors, starts, text = _anchors(words, hashes, window)
                shared, owner = _flat_lists(batch.column("shared"), at, end)
                pair = np.dtype([("t", np.int64), ("h", np.int64)])
                have = np.empty(len(anchors), dtype=pair)
                have["t"], have["h"] = text, signed(anchors)
                want = np.empty(len(shared), dtype=pair)
                want["t"], want["h"] = owner, shared
                # One key of both parts: a wrong hit only adds a candidate window.
                hit = np.isin(have["h"] * 31 + have["t"], want["h"] * 31 + want["t"])
                starts, text = starts[hit], text[hit]
                low = np.maximum(starts - (window - length), words.first[text])
                high = np.minimum(starts, words.first[text] + words.counts[text] - window)
                ok = high >= low
                mark = np.zeros(len(hashes) + 2, dtype=np.int64)
                np.add.at(mark, low[ok], 1)
                np.add.at(mark, high[ok] + 1, -1)
                begins = np.flatnonzero(np.cumsum(mark)[: len(hashes)] > 0)
                if not len(begins):
                    continue
                of = np.searchsorted(words.first, begins, side="right") - 1
                while (empty := words.counts[of] == 0).any():
                    of[empty] -= 1
                other = words.hashes(SECOND)
                yield _batch(
                    {
                        "h1": signed(FIRST.windows(hashes, begins, window)),
                        "h2": signed(SECOND.windows(other, begins, window)),
                        "doc_id": ids[at + of],
                        "place": _place(data, offsets)[of] + begins - words.first[of],
                    },
                    _WINDOW,
                )

    return run


def _emit_kept(window: int, digest: bool):
    schema = _RESULT if digest else _KEPT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in schema}
            for at, end, data, offsets in text_slices(batch.column("text")):
                raw = data.tobytes()
                places, owner = _flat_lists(batch.column("places"), at, end)
                cuts = np.searchsorted(owner, np.arange(end - at + 1))
                for i in range(end - at):
                    text = raw[offsets[i] : offsets[i + 1]]
                    kept = text.split()
                    n = len(kept)
                    if cuts[i] < cuts[i + 1]:
                        own = places[cuts[i] : cuts[i + 1]]
                        own = own[own >> 32 == _place(data[offsets[i] : offsets[i + 1]], np.array([0, len(text)]))[0] >> 32] & 0xFFFFFFFF
                        cover = np.zeros(n + 1, dtype=np.int64)
                        np.add.at(cover, own, 1)
                        np.add.at(cover, own + window, -1)
                        gone = np.cumsum(cover)[:n] > 0
                        kept = [w for w, g in zip(kept, gone.tolist()) if not g]
                    rest = b" ".join(kept)
                    out["n_words"].append(n)
                    out["n_removed"].append(n - len(kept))
                    out[schema.names[-1]].append(hashlib.sha256(rest).hexdigest() if digest else rest.decode())
            out["doc_id"] = batch.column("doc_id")
            yield _batch(out, schema)

    return run


def _shared_anchors(docs: DataFrame, window: int) -> DataFrame:
    """``(doc_id, anchor)`` of anchors that stand in two documents or more.

    The shared anchors are written first: the join back then has plain exchanges on
    both sides, whose skewed partitions adaptive execution splits.
    """
    anchors = docs.where("doc_id IS NOT NULL").mapInArrow(_emit_anchors(window), "anchor long, doc_id long")
    shared = anchors.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("anchor")
    shared = stash(shared, "anchors")
    found = stash(anchors.join(shared, "anchor").select("doc_id", "anchor"), "shared-anchors")
    discard(shared)
    return found


def _candidate_windows(docs: DataFrame, shared: DataFrame, window: int) -> DataFrame:
    per_doc = shared.groupBy("doc_id").agg(F.collect_set("anchor").alias("shared"))
    near = docs.join(per_doc, "doc_id").select("doc_id", "text", "shared")
    return stash(near.mapInArrow(_emit_windows(window), "h1 long, h2 long, doc_id long, place long"), "windows")


def _repeated_places(windows: DataFrame) -> DataFrame:
    """``(doc_id, place)`` of windows that a document of smaller id has too."""
    found = []
    for k in range(PASSES):
        own = windows.where(F.pmod("h2", F.lit(PASSES)) == k)
        first = own.groupBy("h1", "h2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("h1", "h2", "low")
        first = stash(first, "first")
        release(windows.sparkSession)
        found.append(stash(own.join(first, ["h1", "h2"]).where("doc_id > low").select("doc_id", "place"), "repeated"))
        discard(first)
        release(windows.sparkSession)
    return reduce(DataFrame.unionByName, found)


def drop_repeated_passages(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """One row per document with the words left after removing repeated passages.

    Returns doc_id, n_words, n_removed and ``kept_text`` (kept words joined by one
    space), or with ``digest`` its SHA-256 as ``kept_sha256`` in place of the text.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shared = _shared_anchors(docs, window)
    release(docs.sparkSession)
    windows = _candidate_windows(docs, shared, window)
    discard(shared)
    release(docs.sparkSession)
    repeated = _repeated_places(windows)
    discard(windows)
    per_doc = repeated.groupBy("doc_id").agg(F.collect_list("place").alias("places"))
    out = "doc_id long, n_words long, n_removed long, " + ("kept_sha256 string" if digest else "kept_text string")
    return docs.join(per_doc, "doc_id", "left").select("doc_id", "text", "places").mapInArrow(_emit_kept(window, digest), out)
