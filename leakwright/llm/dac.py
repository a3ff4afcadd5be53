"""Token ids in directly addressable codes.

``TokenEncoder`` turns texts into ids with the ``tokenizers`` library.  A *segment*
holds the ids of consecutive documents.  Each id is cut into chunks of bits; level
one has the lowest chunk of every id, level two the next chunk of those ids that
need it, and so on.  A continuation bitmap for each level but the last says which
ids go on, and a rank directory counts the ones before each block of that bitmap,
so any token is read by following one chunk a level: no block is decoded.  The
chunk widths of a segment are those that need the fewest bits for its ids.

Segment layout, little endian (fixed values)::

    magic  8 bytes  b"LWDAC\\x00\\x01\\n"
    header          u64 documents, u64 tokens, u8 levels, then u8 width and u64 codes a level
    documents       u64 token offsets, one more than documents; i64 ids; u8 id-present flags
    each level      codes packed to its width; then, but for the last, bitmap and u32 rank directory

Segments are the binary column of a table that Spark itself writes and reads, with
a row for each: its partition ``part`` and place ``seq`` in it, both ascending with
doc_id.  A lost executor costs a retried task and leaves no half-written file, and
any store that Spark can reach will do.  The table is not compressed, as a segment
is addressed in place.

Defined cases: null text is empty, so it has the end id alone; null ids sort first;
equal ids are ordered by the first 32 characters, a hash and the text, and are dealt to
several tasks if they are many; equal rows are written once each; an empty table
gives an empty file; further columns are ignored.
"""

from __future__ import annotations

import itertools
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC = b"LWDAC\x00\x01\n"
RANK_BLOCK = 512
MAX_LEVELS = 3


# ---------------------------------------------------------------- encoding

#: Letters below U+0250, then ASCII marks other than the apostrophe: one or two pre-tokens of a byte-level tokenizer.
_PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-&(-/:-@\[-`{-~]*)")


def _byte_letters() -> dict[int, str]:
    """How a byte-level tokenizer spells bytes: printable ones as themselves, others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + k) for k, b in enumerate(hidden)}


_SPACE = _byte_letters()[0x20]
_SPELL = {c: "".join(map(_byte_letters().__getitem__, chr(c).encode())) for c in range(0x250)}


class _Known(dict):
    """What was worked out so far; letters are kept while there is room, other things while half of it is free."""

    def __init__(self, work, room: int):
        super().__init__()
        self.work, self.room = work, room

    def __missing__(self, key: str):
        found = self.work(key)
        if len(self) < (self.room if key.isalpha() else self.room // 2) and len(key) <= 64:
            self[key] = found
        return found


class TokenEncoder:
    """Whole texts to the ids that the tokenizer file gives them, as little-endian u32 bytes.

    For a byte-level tokenizer a single space that has no white space on both sides
    always begins a new pre-token, so texts are cut there and the ids of recurring
    pieces are remembered.  Any text with other spacing is encoded in one go.  Plain
    words are remembered for themselves; those with marks after them are put together
    from word and marks, and are remembered as long as half of the room is free.
    """

    def __init__(self, path: str, room: int = 800_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        before = self.whole.pre_tokenizer
        self.by_piece = self.whole.normalizer is None and isinstance(before, pre_tokenizers.ByteLevel) and not before.add_prefix_space and before.use_regex
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.model, self.before = self.whole.model, before
        self.units = _Known(self._unit, room // 8)
        self.pieces = _Known(self._piece, room)
        self.heads = _Known(self._head, room // 8)

    def _unit(self, unit: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(unit)]).tobytes()

    def _text(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _run(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self._text(text)
        return b"".join([self.units[u] for u, _ in self.before.pre_tokenize_str(text)])

    def _piece(self, piece: str) -> bytes | None:
        """Ids of a piece and the space before it; none where that space may belong to a longer run."""
        if plain := _PLAIN.fullmatch(piece):
            word, marks = plain.groups()
            if not marks:
                return self._unit(_SPACE + word if word.isascii() else (" " + word).translate(_SPELL))
            return self.pieces[word] + self.units[marks]
        if not piece or piece[0].isspace():
            return None
        first, *lines = piece.split("\n")
        if lines and all(lines) and not any(x[0].isspace() or x[-1].isspace() for x in (first, *lines)):
            return b"".join([self.pieces[first], *(self.units["\u010a"] + self.heads[x] for x in lines)])
        return self._run(" " + piece)

    def _head(self, piece: str) -> bytes:
        """Ids of a piece at the begin of a line: a line feed alone between other characters is a pre-token of its own."""
        if plain := _PLAIN.fullmatch(piece):
            word, marks = plain.groups()
            return self.units[word if word.isascii() else word.translate(_SPELL)] + (self.units[marks] if marks else b"")
        return self._run(piece)

    def encode(self, text: str) -> bytes:
        if not self.by_piece:
            return self._text(text)
        head, *rest = text.split(" ")
        try:
            return self._run(head) + b"".join(map(self.pieces.__getitem__, rest)) if head else b"".join(map(self.pieces.__getitem__, rest))
        except TypeError:
            return self._text(text)


_encoders: dict[str, TokenEncoder] = {}


def encoder(path: str) -> TokenEncoder:
    """The encoder of this process for a tokenizer file: what it remembers serves later tasks too."""
    if path not in _encoders:
        _encoders[path] = TokenEncoder(path)
    return _encoders[path]


# ---------------------------------------------------------------- segments


def _spread(n: int, width: int) -> list[tuple[int, int, int]]:
    """Of eight codes of a width, which byte each overlaps and how far its bits are shifted there."""
    return [(code, byte, 8 * (byte + 1) - width * (code + 1)) for code in range(n) for byte in range(code * width // 8, ((code + 1) * width - 1) // 8 + 1)]


def pack(values: np.ndarray, width: int) -> bytes:
    """Codes of ``width`` bits one after another, high bits first; eight of them fill ``width`` bytes."""
    n = len(values)
    codes = np.zeros(-(-n // 8) * 8, dtype=np.uint64)
    codes[:n] = values
    codes = np.ascontiguousarray(codes.reshape(-1, 8).T)
    out = np.zeros((width, codes.shape[1]), dtype=np.uint8)
    for code, byte, shift in _spread(8, width):
        out[byte] |= (codes[code] << np.uint64(shift) if shift >= 0 else codes[code] >> np.uint64(-shift)).astype(np.uint8)
    return out.T.tobytes()[: -(-n * width // 8)]


def unpack(raw: bytes | memoryview, n: int, width: int) -> np.ndarray:
    whole = np.zeros(-(-n // 8) * width, dtype=np.uint8)
    whole[: -(-n * width // 8)] = np.frombuffer(raw, np.uint8, -(-n * width // 8))
    data = np.ascontiguousarray(whole.reshape(-1, width).T).astype(np.uint64)
    codes = np.zeros((8, data.shape[1]), dtype=np.uint64)
    for code, byte, shift in _spread(8, width):
        codes[code] |= data[byte] >> np.uint64(shift) if shift >= 0 else data[byte] << np.uint64(-shift)
    return (codes.T.ravel()[:n] & np.uint64((1 << width) - 1)).astype(np.uint32)


def best_widths(ids: np.ndarray) -> tuple[int, ...]:
    """Chunk widths, lowest chunk first, that need the fewest bits for these ids."""
    if not len(ids):
        return (1,)
    of_bits = np.bincount(np.frexp(ids.astype(np.float64))[1], minlength=34)
    longer = len(ids) - np.cumsum(of_bits)  # ids of more than b bits
    most = max(1, int(ids.max()).bit_length())
    best, found = None, (most,)
    for levels in range(1, MAX_LEVELS + 1):
        for cuts in itertools.combinations(range(1, most), levels - 1):
            ends = (*cuts, most)
            codes = [len(ids), *(int(longer[c]) for c in cuts)]
            widths = tuple(b - a for a, b in zip((0, *cuts), ends))
            bits = sum(n * (w + (k < levels - 1)) for k, (n, w) in enumerate(zip(codes, widths)))
            if best is None or bits < best:
                best, found = bits, widths
    return found


def build_segment(doc_ids: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    widths = best_widths(ids)
    head, body = [], []
    rest = ids.astype(np.uint32)
    for k, width in enumerate(widths):
        head.append(struct.pack("<BQ", width, len(rest)))
        body.append(pack(rest & np.uint32((1 << width) - 1), width))
        if k < len(widths) - 1:
            rest = rest >> np.uint32(width)
            more = rest > 0
            ones = np.concatenate([[0], np.cumsum(np.add.reduceat(more.astype(np.int64), np.arange(0, max(1, len(more)), RANK_BLOCK)))]) if len(more) else np.zeros(1)
            body += [np.packbits(more).tobytes(), ones[:-1].astype("<u4").tobytes() if len(more) else b""]
            rest = rest[more]
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype("<u8")
    present = np.array([i is not None for i in doc_ids], dtype=np.uint8)
    names = np.array([i if i is not None else 0 for i in doc_ids], dtype="<i8")
    return b"".join([MAGIC, struct.pack("<QQB", len(doc_ids), len(ids), len(widths)), *head, offsets.tobytes(), names.tobytes(), present.tobytes(), *body])


class Segment:
    """Reads one segment: any token by its place, a document's ids, or all ids."""

    def __init__(self, raw: bytes):
        if raw[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token segment")
        at = len(MAGIC)
        self.n_docs, self.n_tokens, levels = struct.unpack_from("<QQB", raw, at)
        at += 17
        shape = [struct.unpack_from("<BQ", raw, at + 9 * k) for k in range(levels)]
        at += 9 * levels
        self.offsets = np.frombuffer(raw, "<u8", self.n_docs + 1, at).astype(np.int64)
        at += 8 * (self.n_docs + 1)
        names = np.frombuffer(raw, "<i8", self.n_docs, at)
        at += 8 * self.n_docs
        present = np.frombuffer(raw, np.uint8, self.n_docs, at)
        at += self.n_docs
        self.doc_ids = [n if p else None for n, p in zip(names.tolist(), present.tolist())]
        self.levels = []
        for k, (width, n) in enumerate(shape):
            size, flags, blocks = -(-n * width // 8), 0, 0
            codes = raw[at : at + size]
            at += size
            more = ranks = None
            if k < levels - 1:
                flags, blocks = -(-n // 8), -(-n // RANK_BLOCK)
                more = raw[at : at + flags]
                ranks = np.frombuffer(raw, "<u4", blocks, at + flags)
                at += flags + 4 * blocks
            self.levels.append((width, n, codes, more, ranks))

    def token(self, place: int) -> int:
        """The id at one place, by one chunk a level."""
        if not 0 <= place < self.n_tokens:
            raise IndexError(place)
        value = shift = 0
        for width, _, codes, more, ranks in self.levels:
            first, end = place * width // 8, -(-(place + 1) * width // 8)
            chunk = int.from_bytes(codes[first:end], "big") >> (8 * end - (place + 1) * width)
            value |= (chunk & ((1 << width) - 1)) << shift
            shift += width
            if more is None or not more[place // 8] >> (7 - place % 8) & 1:
                break
            block = place // RANK_BLOCK
            bits = int.from_bytes(more[block * RANK_BLOCK // 8 : place // 8 + 1], "big") >> (8 - place % 8)
            place = int(ranks[block]) + bits.bit_count()
        return value

    def ids(self) -> np.ndarray:
        """All ids, from the last level to the first."""
        above = None
        for width, n, codes, more, _ in reversed(self.levels):
            here = unpack(codes, n, width)
            if more is not None:
                here[np.unpackbits(np.frombuffer(more, np.uint8), count=n).astype(bool)] |= above << np.uint32(width)
            above = here
        return above

    def document(self, k: int) -> list[int]:
        return [self.token(i) for i in range(int(self.offsets[k]), int(self.offsets[k + 1]))]


# ---------------------------------------------------------------- tables

_SEGMENTS = "part int, seq int, start_in_part long, n_docs long, n_tokens long, segment binary"
_SCHEMA = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("start_in_part", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("segment", pa.binary())])
_ROWS = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _write(tokenizer: str, end_id: int | None, segment_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part = encoder(tokenizer).encode, TaskContext.get().partitionId()
        end = b"" if end_id is None else end_id.to_bytes(4, "little")
        names, counts, parts, held, seq, start = [], [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts), dtype="<u4")
            row = [part, seq, start, len(names), len(ids), build_segment(names, counts, ids)]
            return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(row, _SCHEMA)], schema=_SCHEMA)

        for batch in batches:
            texts = batch.column("text")
            for k, name in enumerate(batch.column("doc_id").to_pylist()):
                raw = encode(texts[k].as_py() or "") + end
                names.append(name)
                counts.append(len(raw) // 4)
                parts.append(raw)
                held += len(raw) // 4
                if held >= segment_tokens:
                    yield flush()
                    seq, start = seq + 1, start + held
                    names, counts, parts, held = [], [], [], 0
        if names:
            yield flush()

    return run


def write_token_table(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", segment_tokens: int = 1 << 16) -> None:
    """Encode every whole text and write the segments in ascending id order to ``path``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    order = [F.col("doc_id"), F.substring("text", 1, 32), F.xxhash64("text")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    segments = ordered.mapInArrow(_write(tokenizer, end_id, segment_tokens), _SEGMENTS)
    segments.write.option("compression", "none").option("parquet.block.size", 16 << 20).option("parquet.enable.dictionary", "false").parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, start, raw in zip(batch.column("part").to_pylist(), batch.column("start_in_part").to_pylist(), batch.column("segment")):
            segment = Segment(raw.as_py())
            ids = segment.ids().astype("<u4").tobytes()
            cuts = segment.offsets
            crcs = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(segment.doc_ids, pa.int64()), pa.array([part] * segment.n_docs, pa.int32()), pa.array(start + cuts[:-1], pa.int64()), pa.array(np.diff(cuts), pa.int64()), pa.array(crcs, pa.int64())],
                schema=_ROWS,
            )


def read_token_table(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files alone: doc_id, start, n_tokens and ids_crc32.

    The tokens before each partition are a running sum over one row a partition of
    the file, a number that the writing job's partition count bounds.
    """
    segments = spark.read.schema(_SEGMENTS).parquet(path)
    sizes = sorted((r["part"], r["n"]) for r in segments.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    before = list(itertools.accumulate([0, *(n for _, n in sizes)]))
    bases = spark.createDataFrame([(p, b) for (p, _), b in zip(sizes, before)], "part int, base long")
    rows = segments.select("part", "start_in_part", "segment").mapInArrow(_read, "doc_id long, part int, local_start long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
