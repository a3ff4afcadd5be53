"""Secret scan: fixed patterns, and a linear-chain conditional random field that adds to them.

Patterns find the plain cases (``base_spans``).  The field reads the text as tokens, runs
of letters, digits, ``+ / _ -`` and characters above ASCII, and tags each as the beginning or inside
of a secret or as outside.  Its features are the token's shape (kinds of characters, length,
how often the kind changes, share of digits and vowels, first characters), the words and
separators before and after it, and the file (share of digits, of symbols, and length of words).  Tags
are decoded by Viterbi over whole texts: blocks of tokens are reduced to 3 by 3 tables
side by side, the tables are chained, and the blocks are read back, which gives the one
best path and not an approximation.  A decoded span is added if it touches no
base span and has ``MIN_CHARS`` characters.

Training: labels are the base spans of a bounded sample of texts, ``max_train`` ids that
are first by a hash of the id, of texts up to ``max_train_chars`` characters.  So that the
field learns more than the patterns, windows of those texts are repeated with other
values, triggers and separators in place of the secret, and secrets are put into
windows that had none; words are hidden at random meanwhile.  One executor task fits
it by Adam on the likelihood, computed by the forward-backward algorithm.

Defined cases: null text is empty and has no spans; a match whose value is too short is
dropped and its characters are not searched again; the span of an assignment is its
value, or its match from the trigger on with ``whole``; places are code points, ends exclusive; repeated rows are scanned alike; with no
text to learn from nothing is added; an empty table gives an empty result; further columns
are kept by ``redact`` whatever their names and ignored by ``scan_report``.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakwright.llm.textcore import FIRST, Words, text_slices

# The base patterns, the least lengths, and their order.
KINDS = ("assign", "access", "hex", "field")
_TRIGGER = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
_ASSIGN = re.compile(rf"""{_TRIGGER}\x20*["']?([A-Za-z0-9+/_.=-]+)""".encode(), re.IGNORECASE)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS, MIN_CHARS = 6, 20, 24, 12

#: (kind, first byte, end byte)
Span = tuple[str, int, int]
OUT, BEGIN, INSIDE = 0, 1, 2

_BYTES = np.arange(256)
_LOWER_LETTER, _UPPER, _DIGIT = ((_BYTES >= a) & (_BYTES <= b) for a, b in ((97, 122), (65, 90), (48, 57)))
_HEX = _DIGIT | ((_BYTES >= 97) & (_BYTES <= 102))
_SYMBOL = np.isin(_BYTES, [ord(c) for c in "+/_-"])
_HIGH = _BYTES >= 128
_VOWEL = np.isin(_BYTES, [ord(c) for c in "aeiouyAEIOUY"])
_SPLIT = ~(_LOWER_LETTER | _UPPER | _DIGIT | _SYMBOL | _HIGH)
_KIND = np.select([_DIGIT, _LOWER_LETTER, _UPPER, _SYMBOL], [1, 2, 3, 4], 5)
#: Kinds of the bytes between tokens: space, =, :, quote, line end, dot, other; 0 is none.
_GAP = np.select([np.isin(_BYTES, [ord(c) for c in x]) for x in (" \t", "=", ":", "\"'`", "\n\r", ".")], [1, 2, 3, 4, 5, 6], 7)
_FOLD = np.where(_UPPER, _BYTES + 32, _BYTES).astype(np.uint8)

#: Features of a token and how many values each has.
WORDS = 4096
SIZES = (512, 256, 64, WORDS, WORDS, WORDS, WORDS, 4096, WORDS, 64, 2 * WORDS, 64, 1024)
_BASE = np.concatenate([[0], np.cumsum(SIZES)])
N_FEATURES = int(_BASE[-1])
#: Features of words, which training hides at random.
_HIDDEN = (3, 4, 5, 6, 8, 10)


def base_spans(raw: bytes, maybe_assigned: bool = True, whole: bool = False) -> list[Span]:
    """Spans of the patterns in one text, by start and then kind; of an assignment its value, or its match if ``whole``."""
    found: list[Span] = []
    if maybe_assigned:
        found += [("assign", *m.span(0 if whole else 2)) for m in _ASSIGN.finditer(raw) if len(m[2]) >= ASSIGN_CHARS]
    found += [("access", *m.span()) for m in _ACCESS.finditer(raw) if len(m[0]) >= ACCESS_CHARS]
    data = np.frombuffer(raw, dtype=np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], _HEX[data], [False]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    found += [("hex", a, b) for a, b in zip(starts.tolist(), ends.tolist()) if b - a >= HEX_CHARS]
    return sorted(found, key=_order)


def _order(span: Span) -> tuple[int, int, int]:
    return span[1], KINDS.index(span[0]), span[2]


# ------------------------------------------------------------------ features


def _bucket(x: np.ndarray, edges: tuple[float, ...]) -> np.ndarray:
    return np.searchsorted(np.array(edges), x, side="right")


def file_features(data: np.ndarray, words: Words) -> np.ndarray:
    """One number for each text: its share of digits, of other signs, and its mean token length."""
    sums = [np.concatenate([[0], np.cumsum(t[data])])[words.offsets] for t in (_DIGIT, ~(_DIGIT | _LOWER_LETTER | _UPPER | _HIGH) & (_BYTES > 32))]
    size = np.maximum(1, np.diff(words.offsets))
    digits, signs = (np.diff(s) / size for s in sums)
    return _bucket(digits, (0.01, 0.05, 0.2)) * 16 + _bucket(signs, (0.02, 0.06, 0.15)) * 4 + _bucket(size / np.maximum(1, words.counts), (5, 7, 10))


def features(data: np.ndarray, words: Words, files: np.ndarray) -> np.ndarray:
    """A row for each token: the places of its features in the table of weights."""
    starts, ends = words.starts, words.ends
    n = len(starts)
    text = np.repeat(np.arange(len(words.counts)), words.counts)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])

    def count(table: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, dtype=np.int32)
        np.cumsum(table[data], out=sums[1:], dtype=np.int32)
        return sums[ends] - sums[starts]

    size = ends - starts
    digits, upper, lower, symbols, high, hexes, vowels = (count(t) for t in (_DIGIT, _UPPER, _LOWER_LETTER, _SYMBOL, _HIGH, _HEX, _VOWEL))
    kind = _KIND[data]
    change = np.zeros(len(data) + 1, dtype=np.int32)
    if len(data) > 1:
        np.cumsum(kind[1:] != kind[:-1], out=change[1 : len(data)], dtype=np.int32)
    turns = change[ends - 1] - change[starts] if n else size
    length = _bucket(size, (3, 6, 9, 13, 17, 23, 31))
    shape = (digits > 0) + 2 * (upper > 0) + 4 * (lower > 0) + 8 * (symbols > 0) + 16 * (high > 0) + 32 * (hexes == size)
    hashes = FIRST.words(_FOLD[data], starts, ends) if n else np.zeros(0, np.uint64)
    word = np.where(size <= 24, (hashes & np.uint64(WORDS - 1)).astype(np.int64), 0)
    first = np.zeros(n, dtype=bool)
    first[words.first[words.counts > 0]] = True
    last = np.roll(first, -1)

    def shifted(x: np.ndarray, by: int) -> np.ndarray:
        """x of the token before (by 1, 2) or after (by -1) in the same text; 0 where there is none."""
        out = np.zeros_like(x)
        if by > 0:
            out[by:] = np.where(text[by:] == text[:-by], x[:-by], 0) if n > by else out[by:]
        elif n > 1:
            out[:-1] = np.where(text[1:] == text[:-1], x[1:], 0)
        return out

    gap_from = np.where(first, words.offsets[:-1][text], np.concatenate([[0], ends[:-1]])) if n else starts
    gap = np.zeros(n, dtype=np.int64)
    for k in range(3):
        gap = gap * 8 + np.where(gap_from + k < starts, _GAP[padded[gap_from + k]], 0)
    before = np.where(gap_from < starts, _GAP[padded[np.maximum(starts - 1, 0)]], 0)
    gap_to = np.where(last, words.offsets[1:][text], np.concatenate([starts[1:], [0]])) if n else ends
    after = np.where(ends < gap_to, _GAP[padded[ends]], 0)
    assigned = np.zeros(n, dtype=bool)
    for k in range(3):
        assigned |= (gap_from + k < starts) & np.isin(padded[gap_from + k], (ord("="), ord(":")))
    head = sum(padded[starts + k].astype(np.uint64) << np.uint64(8 * k) for k in range(4)) if n else hashes
    with np.errstate(over="ignore"):
        head = np.where(size >= 16, ((head * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)).astype(np.int64), 0)
    columns = (
        shape * 8 + length,
        length * 32 + _bucket(digits / np.maximum(1, size), (0.01, 0.3, 0.6)) * 8 + _bucket(turns / np.maximum(1, size), (0.05, 0.1, 0.2, 0.3, 0.45)),
        length * 8 + _bucket(vowels / np.maximum(1, size - digits), (0.01, 0.15, 0.25, 0.35, 0.5)),
        word, shifted(word, 1), shifted(word, 2), shifted(word, -1),
        gap * 8 + before, head, files[text], shifted(word, 1) * 2 + assigned, after * 8 + before, (shape * 8 + length) * 2 + assigned,
    )
    return np.stack([c.astype(np.int32) + np.int32(b) for c, b in zip(columns, _BASE)], axis=1) if n else np.zeros((0, len(SIZES)), np.int32)


# ------------------------------------------------------------------ the field


def viterbi(emit: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray, block: int = 64) -> np.ndarray:
    """The best tags of consecutive sequences, which begin where ``first`` is true; exact, block by block."""
    n = len(emit)
    if not n:
        return np.zeros(0, dtype=np.int8)
    rows = -(-n // block)
    score = np.zeros((rows * block, 3))
    score[:n] = emit
    inner = np.zeros(rows * block)
    inner[:n] = ~first
    inner[0] = 0
    score[inner == 0] += start
    # By place in the block, then tags, then blocks: each step works on whole rows of blocks.
    score = np.ascontiguousarray(score.reshape(rows, block, 3).transpose(1, 2, 0))
    inner = np.ascontiguousarray(inner.reshape(rows, block).T)
    step = lambda t: trans[:, :, None] * inner[t] + score[t]
    table = step(0)
    for t in range(1, block):
        now = step(t)
        table = np.maximum(np.maximum(table[:, 0, None] + now[0], table[:, 1, None] + now[1]), table[:, 2, None] + now[2])
    best, chain = [[0.0, 0.0, 0.0]], table.transpose(2, 0, 1).tolist()
    for a in chain:
        v = best[-1]
        now = [max(v[0] + a[0][j], v[1] + a[1][j], v[2] + a[2][j]) for j in range(3)]
        top = max(now)
        best.append([x - top for x in now])
    tag = int(np.argmax(best[-1]))
    entry, leave = np.zeros(rows, dtype=np.int64), np.zeros(rows, dtype=np.int64)
    for b in range(rows - 1, -1, -1):
        leave[b] = tag
        came = [best[b][i] + chain[b][i][tag] for i in range(3)]
        tag = came.index(max(came))
        entry[b] = tag
    each = np.arange(rows)
    value = step(0)[entry, :, each].T
    back = np.zeros((block, 3, rows), dtype=np.int8)
    for t in range(1, block):
        now = step(t)
        one, two, three = value[0] + now[0], value[1] + now[1], value[2] + now[2]
        value = np.maximum(one, two)
        back[t] = two > one
        back[t][three > value] = 2
        value = np.maximum(value, three)
    tags = np.zeros((block, rows), dtype=np.int8)
    tags[-1] = leave
    for t in range(block - 1, 0, -1):
        tags[t - 1] = back[t][tags[t], each]
    return np.ascontiguousarray(tags.T).reshape(-1)[:n]


_NEVER = -1e4


class Field:
    """Weights of features for each tag, of transitions and of first tags."""

    def __init__(self, weights: np.ndarray, trans: np.ndarray, start: np.ndarray):
        self.weights, self.trans, self.start = weights.astype(np.float32), trans, start

    def tags(self, data: np.ndarray, words: Words) -> np.ndarray:
        places = features(data, words, file_features(data, words))
        emit = np.zeros((len(places), 3), dtype=np.float32)
        for k in range(places.shape[1]):
            emit += np.take(self.weights, places[:, k], axis=0)
        first = np.zeros(len(places), dtype=bool)
        first[words.first[words.counts > 0]] = True
        return viterbi(emit, first, self.trans, self.start)

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """``(text, first byte, end byte)`` of the decoded secrets of consecutive texts."""
        words = Words(data, offsets, breaks=_SPLIT)
        tags = self.tags(data, words)
        begins = np.flatnonzero(tags == BEGIN)
        inside = tags == INSIDE
        for i in begins.tolist():
            j = i + 1
            while j < len(tags) and inside[j]:
                j += 1
            yield int(np.searchsorted(words.first + words.counts, i, side="right")), int(words.starts[i]), int(words.ends[j - 1])


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def marginals(emit: np.ndarray, live: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of padded sequences the chance of each tag at each token, and the expected transitions, by forward and backward sums."""
    size, steps, _ = emit.shape
    ahead, behind = np.zeros_like(emit), np.zeros_like(emit)
    ahead[:, 0] = start + emit[:, 0]
    for t in range(1, steps):
        ahead[:, t] = np.where(live[:, t, None], _log_sum(ahead[:, t - 1, :, None] + trans, 1) + emit[:, t], ahead[:, t - 1])
    for t in range(steps - 2, -1, -1):
        behind[:, t] = np.where(live[:, t + 1, None], _log_sum(trans + (emit[:, t + 1] + behind[:, t + 1])[:, None, :], 2), behind[:, t + 1])
    whole = _log_sum(ahead[:, -1], 1)
    each = np.exp(ahead + behind - whole[:, None, None]) * live[:, :, None]
    pairs = np.exp(ahead[:, :-1, :, None] + trans + (emit[:, 1:] + behind[:, 1:])[:, :, None, :] - whole[:, None, None, None])
    return each, (pairs * live[:, 1:, None, None]).sum((0, 1))


def fit(windows: list[tuple[np.ndarray, np.ndarray]], epochs: int = 10, batch: int = 128, rate: float = 0.05, decay: float = 1e-4, hidden: float = 0.3, seed: int = 5) -> Field:
    """Learn from ``(features, tags)`` of token windows."""
    rng = np.random.default_rng(seed)
    allowed = np.zeros((3, 3))
    allowed[OUT, INSIDE] = _NEVER
    parts = {"w": np.zeros((N_FEATURES, 3)), "t": np.zeros((3, 3)), "s": np.zeros(3)}
    mean, var, step = {k: 0.0 for k in parts}, {k: 0.0 for k in parts}, 0
    first = np.array([0.0, 0.0, _NEVER])
    for epoch in range(epochs):
        order = rng.permutation(len(windows))
        for i in range(0, len(order), batch):
            own = [windows[k] for k in order[i : i + batch]]
            sizes = np.array([len(y) for _, y in own])
            live = np.arange(sizes.max()) < sizes[:, None]
            places = np.concatenate([x for x, _ in own])
            for k in _HIDDEN:
                hide = rng.random(len(places)) < hidden
                places = np.where(hide[:, None] & (np.arange(len(SIZES)) == k), _BASE[k], places)
            tags = np.concatenate([y for _, y in own])
            emit = np.zeros((*live.shape, 3))
            emit[live] = parts["w"][places].sum(1)
            each, pairs = marginals(emit, live, parts["t"] + allowed, parts["s"] + first)
            diff = each[live] - np.eye(3)[tags]
            true = np.zeros((3, 3))
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            inner = np.ones(len(tags), dtype=bool)
            inner[starts] = False
            at = np.flatnonzero(inner)
            np.add.at(true, (tags[at - 1], tags[at]), 1)
            grads = {
                "w": np.stack([np.bincount(places.ravel(), weights=np.repeat(diff[:, j], places.shape[1]), minlength=N_FEATURES) for j in range(3)], axis=1) / len(own) + decay * parts["w"],
                "t": (pairs - true) / len(own),
                "s": diff[starts].sum(0) / len(own),
            }
            step += 1
            pace = rate * (1 - epoch / epochs)
            for k, g in grads.items():
                mean[k], var[k] = 0.9 * mean[k] + 0.1 * g, 0.999 * var[k] + 0.001 * g * g
                parts[k] -= pace * (mean[k] / (1 - 0.9**step)) / (np.sqrt(var[k] / (1 - 0.999**step)) + 1e-8)
    return Field(parts["w"], parts["t"] + allowed, parts["s"] + first)


# ------------------------------------------------------------------ training windows

# Words before a secret, what stands between, what surrounds it, and forms of values.
TRIGGERS = ("password", "passwd", "secret", "token", "api_key", "apikey", "access key", "client_secret", "auth", "bearer", "credential", "private key", "pwd", "key", "pass")
SEPARATORS = ("=", ": ", " = ", ":", " is ", " ", " := ", "=> ")
QUOTES = ("", '"', "'", "`")
_HEXES, _ALNUM = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
FORMS = ("hex", "HEX", "alnum", "base64", "parts", "prefixed")
PREFIXES = ("ghp_", "sk-", "xoxb-", "glpat-", "AKIA", "AIza")


def random_value(rng: np.random.Generator) -> str:
    """A made-up credential of one of the forms."""
    of = lambda chars, n: "".join(chars[k] for k in rng.integers(0, len(chars), n))
    form = FORMS[rng.integers(len(FORMS))]
    if form in ("hex", "HEX"):
        value = of(_HEXES, int(rng.choice([16, 18, 20, 32, 40, 64])))
        return value.upper() if form == "HEX" else value
    if form == "parts":
        return ".".join(of(_ALNUM + "_-", int(rng.integers(12, 40))) for _ in range(3))
    if form == "prefixed":
        return PREFIXES[rng.integers(len(PREFIXES))] + of(_ALNUM, int(rng.integers(16, 40)))
    return of(_ALNUM + ("+/" if form == "base64" else ""), int(rng.integers(16, 44)))


def _window(raw: bytes, low: int, high: int) -> tuple[int, int]:
    """Edges widened to where tokens end."""
    data = np.frombuffer(raw, dtype=np.uint8)
    low, high = max(0, low), min(len(raw), high)
    while low > 0 and not _SPLIT[data[low - 1]]:
        low -= 1
    while high < len(raw) and not _SPLIT[data[high]]:
        high += 1
    return low, high


def windows_of(raw: bytes, rng: np.random.Generator, around: int = 160, quiet: int = 2, variants: int = 3) -> Iterator[tuple[bytes, list[tuple[int, int]]]]:
    """``(bytes, secrets)`` of windows of a text: as they are, with other secrets in their place, and with secrets put in."""
    spans = [(a, b) for _, a, b in base_spans(raw)]
    merged: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if merged and a < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    inside = lambda low, high: [(a - low, b - low) for a, b in merged if a >= low and b <= high]

    def put(piece: bytes, at: int, end: int, others: list[tuple[int, int]]) -> tuple[bytes, list[tuple[int, int]]]:
        value, quote = random_value(rng), QUOTES[rng.integers(len(QUOTES))]
        bare = rng.random() < 0.2
        lead = "" if bare else TRIGGERS[rng.integers(len(TRIGGERS))] + SEPARATORS[rng.integers(len(SEPARATORS))] + quote
        said = f" {lead}{value}{'' if bare else quote} ".encode()
        begin = at + 1 + len(lead.encode())
        moved = [(a, b) if b <= at else (a + len(said) - (end - at), b + len(said) - (end - at)) for a, b in others if b <= at or a >= end]
        return piece[:at] + said + piece[end:], [*moved, (begin, begin + len(value))]

    for a, b in merged:
        low, high = _window(raw, a - around, b + around)
        own = inside(low, high)
        yield raw[low:high], own
        for _ in range(variants):
            yield put(raw[low:high], a - low, b - low, own)
    for k in range(quiet):
        at = int(rng.integers(0, max(1, len(raw))))
        low, high = _window(raw, at - around, at + around)
        piece, own = raw[low:high], inside(low, high)
        gaps = np.flatnonzero(np.frombuffer(piece, dtype=np.uint8) == 32)
        if k == 0 and len(gaps):
            at = int(gaps[rng.integers(len(gaps))])
            if all(b <= at or a > at for a, b in own):
                piece, own = put(piece, at, at + 1, own)
        yield piece, own


def learn(texts: Iterator[bytes], seed: int = 5) -> Field | None:
    """A field fitted on windows of the texts; none without texts."""
    rng = np.random.default_rng(seed)
    windows = []
    for raw in texts:
        if not raw:
            continue
        data = np.frombuffer(raw, dtype=np.uint8)
        file = file_features(data, Words(data, np.array([0, len(raw)]), breaks=_SPLIT))
        for piece, secrets in windows_of(raw, rng):
            data = np.frombuffer(piece, dtype=np.uint8)
            words = Words(data, np.array([0, len(piece)]), breaks=_SPLIT)
            if not words.counts[0]:
                continue
            tags = np.zeros(words.counts[0], dtype=np.int64)
            for a, b in secrets:
                hit = np.flatnonzero((words.ends > a) & (words.starts < b))
                tags[hit] = INSIDE
                tags[hit[:1]] = BEGIN
            windows.append((features(data, words, file), tags))
    return fit(windows, seed=seed) if windows else None


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_train: int = 2000, max_train_chars: int = 20_000) -> Field | None:
    """Fit on a bounded sample of the texts, in one executor task."""
    ids = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.xxhash64(F.lit(12), F.col(id_col)).alias("place")).distinct()
    picked = ids.orderBy("place", "doc_id").limit(max_train)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where(F.length("text") <= max_train_chars)
    sample = texts.join(F.broadcast(picked), "doc_id").groupBy("place", "doc_id").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = learn(t.encode() for batch in batches for t in batch.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(found)], pa.binary())], names=["field"])

    row = sample.repartition(1).sortWithinPartitions("place", "doc_id").select("text").mapInArrow(run, "field binary").first()
    return pickle.loads(bytes(row["field"])) if row else None


# ------------------------------------------------------------------ scans


def scan_texts(column: pa.Array, field: Field | None, whole: bool = False) -> Iterator[tuple[list[Span], bytes, np.ndarray]]:
    """Of each text, in order, its spans in code points by start and kind, its bytes, and the byte of each code point."""
    for at, end, data, offsets in text_slices(column):
        raw = data.tobytes()
        texts = pa.LargeStringArray.from_buffers(end - at, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
        maybe = pc.match_substring_regex(texts, _TRIGGER, ignore_case=True).to_numpy(zero_copy_only=False)
        added: dict[int, list[Span]] = {}
        for i, a, b in field.spans(data, offsets) if field else ():
            if b - a >= MIN_CHARS:
                added.setdefault(i, []).append(("field", a - int(offsets[i]), b - int(offsets[i])))
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        for i in range(end - at):
            low = int(offsets[i])
            own = raw[low : int(offsets[i + 1])]
            base = base_spans(own, bool(maybe[i]), whole)
            more = [s for s in added.get(i, ()) if all(s[2] <= a or s[1] >= b for _, a, b in base)]
            point = lambda p: int(points[low + p] - points[low])
            spans = [(kind, point(a), point(b)) for kind, a, b in sorted([*base, *more], key=_order)]
            yield spans, own, points


def _told(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


_REPORT = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])


def scan_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = False, **bounds: int) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256 and spans, all as ``kind:start:end``.

    With ``whole`` the span of an assignment is its match, trigger included, in place of its value.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, id_col, text_col, **bounds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for spans, _, _ in scan_texts(batch.column("text"), shared.value, whole):
                base = [s for s in spans if s[0] != "field"]
                rows.append((*(sum(k == s[0] for s in base) for k in KINDS[:3]), hashlib.sha256(_told(base).encode()).hexdigest(), _told(spans)))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, f.type) for x, f in zip(zip(*rows), list(_REPORT)[1:]))], schema=_REPORT)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]", **bounds: int) -> DataFrame:
    """``docs``, all columns, with ``mark`` in place of each secret; spans that overlap are one."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, id_col, text_col, **bounds))
    place = docs.columns.index(text_col)

    def cut(text: str | None, spans: list[Span]) -> str | None:
        if not spans:
            return text
        out, at = [], 0
        for _, a, b in spans:
            if a >= at:
                out += [text[at:a], mark]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place)
            columns = list(batch.columns)
            columns[place] = pa.array([cut(t, spans) for t, (spans, _, _) in zip(texts.to_pylist(), scan_texts(texts, shared.value))], texts.type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
