"""Vectorised word arithmetic over Arrow text columns.

A batch of texts is one byte buffer with offsets.  Everything here works on that
buffer with NumPy: words are found by a byte table, hashed eight bytes at a time,
and runs of words by a polynomial modulo a prime over word hashes.  No Python object
is made per word.

A word is a maximal run of bytes outside space, tab, LF, VT, FF and CR, which is
the character class ``[^\\x20\\x09-\\x0D]+`` because all six are single bytes in
UTF-8.  Hashes are fixed functions of the bytes: equal on every executor.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: A slice of this many text bytes is hashed at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20

#: Text bytes that a Python worker is sent at once: a worker and its executor each hold a few batches.
BATCH_BYTES = 16 << 20

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit (splitmix64's finaliser)."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit integers."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 20)) * np.uint64(0x9E3779B97F4A7C15))


#: The Mersenne prime of the polynomial over words; residues of 61 bits.
PRIME = (1 << 61) - 1
_P, _S61, _S32, _S29 = np.uint64(PRIME), np.uint64(61), np.uint64(32), np.uint64(29)
_LOW31, _LOW30, _LOW32, _LOW29 = (np.uint64((1 << n) - 1) for n in (31, 30, 32, 29))
_S31W, _S30W, _ONE = np.uint64(31), np.uint64(30), np.uint64(1)


def reduce61(x: np.ndarray) -> np.ndarray:
    """Any 64-bit values modulo 2**61 - 1."""
    x = (x & _P) + (x >> _S61)
    return np.where(x >= _P, x - _P, x)


def mul61(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of residues modulo 2**61 - 1, from halves that fit 64 bits."""
    ah, al, bh, bl = a >> _S31W, a & _LOW31, b >> _S31W, b & _LOW31
    mid = ah * bl + al * bh
    return reduce61(((ah * bh) << _ONE) + (mid >> _S30W) + ((mid & _LOW30) << _S31W) + al * bl)


def _sums61(terms: np.ndarray) -> np.ndarray:
    """Sums of the first 0, 1, 2, ... residues, modulo 2**61 - 1."""
    out = np.zeros(len(terms) + 1, dtype=np.uint64)
    high, low = np.cumsum(terms >> _S32), np.cumsum(terms & _LOW32)
    out[1:] = reduce61((high >> _S29) + ((high & _LOW29) << _S32) + reduce61(low))
    return out


class Powers:
    """Powers of a base and of its inverse modulo 2**61 - 1, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, PRIME)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, SLICE_BYTES // 4)
            self.up, self.down = (self._run(b, size) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]

    @staticmethod
    def _run(b: int, n: int) -> np.ndarray:
        out = np.ones(n, dtype=np.uint64)
        done = 1
        while done < n:
            more = min(done, n - done)
            out[done : done + more] = mul61(out[:more], np.uint64(pow(b, done, PRIME)))
            done += more
        return out


#: Words of more bytes are hashed by BLAKE2b, shorter ones by mixing eight bytes at a time.
LONG_WORD = 64


class Family:
    """One hash of words and of runs of words; two families are independent of each other.

    A word is mixed in eight bytes at a time by a function that is not linear, or is
    digested if it is long; a run of words is a polynomial modulo a prime over their
    hashes.  So texts of a regular make do not collide, as they would modulo 2**64.
    """

    def __init__(self, seed: int):
        self.seed = int(stream(seed, 1)[0])
        self.key = self.seed.to_bytes(8, "little")
        self.words_base = Powers(int(stream(seed + 2, 1)[0]) % PRIME)

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        sizes = ends - starts
        eight = np.ndarray(len(data) + 1, dtype="<u8", buffer=np.concatenate([data, np.zeros(16, np.uint8)]), strides=(1,))
        out = mix(sizes.astype(np.uint64) + np.uint64(self.seed))
        long = np.flatnonzero(sizes > LONG_WORD)
        left = np.where(sizes > LONG_WORD, 0, sizes)
        here, at = np.arange(len(sizes)), starts
        for k in range(LONG_WORD // 8):
            if k:
                here = np.flatnonzero(left > 8 * k)
                at = starts[here] + 8 * k
            if not len(here):
                break
            n = np.minimum(left[here] - 8 * k, 8).astype(np.uint64)
            cut = (np.uint64(8) - n) * np.uint64(8)
            chunk = np.where(n > 0, eight[at] << (cut & np.uint64(63)), np.uint64(0))
            out[here] = mix((out[here] ^ chunk) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k + 1))
        raw = memoryview(np.ascontiguousarray(data))
        for i in long.tolist():
            out[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]], digest_size=8, key=self.key).digest(), "little")
        return out

    def prefixes(self, words: np.ndarray) -> np.ndarray:
        """Sums from which ``at`` gives the hash of any run of the words."""
        return _sums61(mul61(reduce61(words), self.words_base.to(len(words) + 1)[0][:-1]))

    def at(self, prefix: np.ndarray, starts: np.ndarray, sizes: np.ndarray | int) -> np.ndarray:
        value = mul61(reduce61(prefix[starts + sizes] + (_P - prefix[starts])), self.words_base.to(len(prefix))[1][starts])
        return mix(value + np.asarray(sizes).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def spans(self, words: np.ndarray, starts: np.ndarray, sizes: np.ndarray | int) -> np.ndarray:
        """Hashes of ``words[s : s + n]`` for every s in ``starts`` and n in ``sizes``."""
        return self.at(self.prefixes(words), starts, sizes)

    windows = spans


FIRST, SECOND = Family(11), Family(23)


class Words:
    """The words of consecutive texts: where each lies, and how many each text has."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, breaks: np.ndarray = _SEPARATOR):
        self.data = _LOWER[data] if lower else data
        self.offsets, self.breaks = offsets, breaks
        solid = np.ones(len(data) + 1, dtype=bool)
        solid[:-1] = ~breaks[data]
        solid[-1] = False
        inner = offsets[1:-1]
        first = solid[:-1].copy()
        first[1:] &= ~solid[:-2]
        edge = inner[inner < len(data)]
        first[edge] = solid[edge]
        last = solid[:-1] & ~solid[1:]
        before = inner[(inner > 0)] - 1
        last[before] = solid[before]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        bounds = np.searchsorted(self.starts, offsets)
        self.first, self.counts = bounds[:-1], np.diff(bounds)

    def hashes(self, family: Family = FIRST) -> np.ndarray:
        return family.words(self.data, self.starts, self.ends)

    def distinct(self) -> tuple[np.ndarray, pa.LargeBinaryArray]:
        """A number for each word, and the distinct words by number: exact, without hashes."""
        body = np.ascontiguousarray(self.data[~self.breaks[self.data]])
        edges = np.concatenate([[0], np.cumsum(self.ends - self.starts)]).astype(np.int64)
        coded = pa.Array.from_buffers(pa.large_binary(), len(self.starts), [None, pa.py_buffer(edges), pa.py_buffer(body)]).dictionary_encode()
        return coded.indices.to_numpy().astype(np.int64), coded.dictionary

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Start word and text number of every run of ``k`` words inside one text."""
        n = np.maximum(self.counts - k + 1, 0)
        text = np.repeat(np.arange(len(n)), n)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return self.first[text] + within, text


def text_slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, bytes, offsets)`` of consecutive slices of a text column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, off, body = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], (offsets[at : end + 1] - offsets[at])
        at = end


def bound_batches(spark) -> None:
    """Keep Arrow batches to BATCH_BYTES, if the session would have larger ones."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)([kmg]?)b?", spark.conf.get(key).lower())
    if now is None or not 0 < int(now[1]) << {"": 0, "k": 10, "m": 20, "g": 30}[now[2]] <= BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
