"""Fingerprints of texts that keep similarity: edited copies differ in few bits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakwright.sources.shared_tables import small_side

#: Words whose votes a task remembers, and words of a text that are looked up and added up at once; no more than 255.
KNOWN_WORDS, ADDED = 1 << 16, 255
_EIGHT = np.arange(8, dtype=np.uint64)


class _Votes:
    """The votes of words, remembered: eight bits are one number whose bytes are 0 or 1, so that 255 words are added without a carry."""

    #: The eight bits of a byte, the lowest first, in eight bytes of a number.
    SPREAD = (((np.arange(256, dtype=np.uint64)[:, None] >> _EIGHT) & np.uint64(1)) << (np.uint64(8) * _EIGHT)).sum(axis=1, dtype=np.uint64)

    def __init__(self) -> None:
        self.places: dict[bytes, int] = {}
        self.table = np.zeros((1024, 32), dtype=np.uint64)

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self.places) + len(words) > KNOWN_WORDS:
            self.places.clear()
        new = [w for w in dict.fromkeys(words) if w not in self.places]
        if new:
            at = len(self.places)
            self.places.update(zip(new, range(at, at + len(new))))
            while len(self.places) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            digests = b"".join(x for w in new for x in (hashlib.md5(w).digest(), hashlib.md5(b"1:" + w).digest()))
            # Eight hex digits are a number of 32 bits, two of them a word, the first above the second.
            self.table[at : at + len(new)] = self.SPREAD[np.frombuffer(digests, dtype=np.uint8).reshape(-1, 4, 8)[:, :, ::-1].reshape(-1, 32)]
        return self.table[[self.places[w] for w in words]]

    def print_of(self, text: bytes) -> list[int]:
        """The four words of a text: a bit is set if more than half of the votes are for it."""
        words = text.split()  # at the six bytes that part words, as all of bytes.split are
        counts = np.zeros(256, dtype=np.int64)
        for low in range(0, len(words), ADDED):
            counts += self.of(words[low : low + ADDED]).sum(axis=0, dtype=np.uint64).astype("<u8").view(np.uint8)
        return np.packbits(2 * counts > len(words), bitorder="little").view("<i8").tolist()


def simhash(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, words)``: 256 bits of each text as four 64-bit words, by the votes of its words (SimHash).

    A word is a run of bytes other than space, tab, LF, VT, FF and CR.  Each votes on
    every bit by its own hash, md5 of the word and of ``1:`` and the word, as often as it
    occurs; a bit is set if more than half of the votes are for it.  Votes are counted
    where the text lies, so texts and words are not shuffled.  Null and blank texts have
    no votes and the print 0; rows with one id are one text, whose words are those of all of
    them; a null id is kept as one.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    again = rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("twice"))
    again = small_side(again, "repeated-ids")
    same = F.col("id").eqNullSafe(F.col("twice"))
    once = rows.join(again, same, "left_anti")
    joined = rows.join(again, same, "left_semi").groupBy("id").agg(F.concat_ws(" ", F.collect_list("text")).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        votes = _Votes()
        for batch in batches:
            prints = [votes.print_of(t.as_buffer().to_pybytes()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(prints, pa.list_(pa.int64()))], names=["id", "words"])

    return once.unionByName(joined).mapInArrow(run, f"id {kind}, words array<long>")


def hex_print(words: Column, n: int = 4) -> Column:
    """A print as hex digits."""
    return F.concat(*(F.lpad(F.lower(F.hex(F.get(words, F.lit(w)))), 16, "0") for w in range(n)))
