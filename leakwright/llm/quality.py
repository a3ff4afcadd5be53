"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE_WORDS`` words.  Each passage is encoded
by a learned layer over its byte bigrams; a gated attention layer, learned from
document labels alone, weighs the passages; the weighted sum of their codes gives the
score (Ilse, Tomczak and Welling, 2018).  So a document is judged by the passages
that tell most, however long it is, and the attention weights name them.

The model is fitted on a bounded sample of labelled rows: the ``max_train`` ids that
are first by a hash of the id, of texts up to ``max_train_chars`` characters, in that
order as long as they have no more than ``max_passages`` passages together.  One
executor task fits it, so no text comes to the driver; the model is a hundred
kilobytes, is sent to the executors, and scores every whole text where it lies.

Defined cases: null, empty and blank texts are one passage without bigrams and get a
score; labels that are null, not 0 or 1, or that contradict each other for an id are
left out; with no labels of one kind the score is that share of the other; an id that
occurs in several rows is scored for each and is learned from once, by the least of
its texts; an empty table gives an empty result; columns with clashing names are kept
apart.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leakwright.functions.naming import unused
from leakwright.llm.textcore import Words, text_slices

PASSAGE_WORDS = 64
#: Buckets that byte bigrams are hashed to, size of a passage's code, size of the attention layer.
BUCKETS, CODE, ATTENTION = 1024, 24, 12
#: Passages encoded at once.
CHUNK = 1024

_BUCKET = ((np.arange(1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(54)).astype(np.int32)


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte edges of consecutive passages, the share of words in each that repeat the word before, and the passage edges of each text; every text has one passage at least."""
    words = Words(data, offsets)
    n = np.maximum(1, -(-words.counts // PASSAGE_WORDS))
    cuts = np.concatenate([[0], np.cumsum(n)])
    text = np.repeat(np.arange(len(n)), n)
    within = np.arange(cuts[-1]) - cuts[:-1][text]
    edges = offsets[:-1][text].copy()
    later = within > 0
    edges[later] = words.starts[words.first[text[later]] + within[later] * PASSAGE_WORDS]
    hashes = words.hashes()
    owner = np.repeat(cuts[:-1], words.counts) + (np.arange(len(hashes)) - np.repeat(words.first, words.counts)) // PASSAGE_WORDS
    again = np.bincount(owner[1:][(hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])], minlength=cuts[-1])
    return np.append(edges, offsets[-1]), again / np.maximum(1, np.bincount(owner, minlength=cuts[-1])), cuts


def features(data: np.ndarray, edges: np.ndarray, again: np.ndarray) -> np.ndarray:
    """A row for each passage: the root of each bucket's share of its byte bigrams, then its share of repeated words."""
    n, first, last = len(edges) - 1, edges[0], edges[-1]
    part = data[first:last].astype(np.int32)
    if len(part) < 2:
        return np.zeros((n, BUCKETS + 1), dtype=np.float32)
    owner = np.repeat(np.arange(n), np.diff(edges))
    same = owner[1:] == owner[:-1]
    cell = owner[:-1] * BUCKETS + _BUCKET[part[:-1] << 8 | part[1:]]
    counts = np.bincount(cell[same], minlength=n * BUCKETS).reshape(n, BUCKETS).astype(np.float32)
    shares = np.sqrt(counts / np.maximum(1, counts.sum(1, keepdims=True)))
    return np.hstack([shares, again[:, None].astype(np.float32)])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class AttentionModel:
    """Parameters by name; ``prior`` alone is used where there was nothing to learn from."""

    weights: dict[str, np.ndarray] | None
    prior: float = 0.5

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of passages and their attention logits."""
        w = self.weights
        h = np.tanh(x @ w["W"] + w["b"])
        return h, (np.tanh(h @ w["V"]) * _sigmoid(h @ w["U"])) @ w["a"]

    def pool(self, h: np.ndarray, logits: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of bags and the attention weight of each passage."""
        at = cuts[:-1]
        sizes = np.diff(cuts)
        e = np.exp(logits - np.repeat(np.maximum.reduceat(logits, at), sizes))
        alpha = e / np.repeat(np.add.reduceat(e, at), sizes)
        z = np.add.reduceat(alpha[:, None] * h, at, axis=0)
        return _sigmoid(z @ self.weights["c"] + self.weights["d"]), alpha

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(offsets) - 1, self.prior)
        edges, again, cuts = passages(data, offsets)
        parts = [self.encode(features(data, edges[i : i + CHUNK + 1], again[i : i + CHUNK])) for i in range(0, len(edges) - 1, CHUNK)]
        return self.pool(np.concatenate([h for h, _ in parts]), np.concatenate([a for _, a in parts]), cuts)[0].astype(np.float64)


def _gradients(model: AttentionModel, x: np.ndarray, cuts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    w, sizes = model.weights, np.diff(cuts)
    h = np.tanh(x @ w["W"] + w["b"])
    tv, su = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
    p, alpha = model.pool(h, (tv * su) @ w["a"], cuts)
    z = np.add.reduceat(alpha[:, None] * h, cuts[:-1], axis=0)
    err = (p - y) / len(y)
    dz = np.repeat(err[:, None] * w["c"], sizes, axis=0)
    dalpha = (dz * h).sum(1)
    dlogit = alpha * (dalpha - np.repeat(np.add.reduceat(alpha * dalpha, cuts[:-1]), sizes))
    dgate = dlogit[:, None] * w["a"]
    dv, du = dgate * su * (1 - tv**2), dgate * tv * su * (1 - su)
    dh = (alpha[:, None] * dz + dv @ w["V"].T + du @ w["U"].T) * (1 - h**2)
    return {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dv, "U": h.T @ du, "a": (tv * su).T @ dlogit, "c": z.T @ err, "d": err.sum(keepdims=True)}


def as_bags(texts: pa.Array) -> Iterator[np.ndarray]:
    """The passages of each text, a row of features for each."""
    for _, _, data, offsets in text_slices(texts):
        edges, again, cuts = passages(data, offsets)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            parts = [features(data, edges[i : min(i + CHUNK, b) + 1], again[i : min(i + CHUNK, b)]).astype(np.float16) for i in range(a, b, CHUNK)]
            yield parts[0] if len(parts) == 1 else np.concatenate(parts)


def fit(bags: list[np.ndarray], labels: list[int], steps: int = 1500, batch: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> AttentionModel:
    """Learn from labelled bags of passages by Adam on the cross entropy of document labels."""
    y = np.array(labels, dtype=np.float32)
    if not len(y) or y.min() == y.max():
        return AttentionModel(None, float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(seed)
    shape = {"W": (BUCKETS + 1, CODE), "b": (CODE,), "V": (CODE, ATTENTION), "U": (CODE, ATTENTION), "a": (ATTENTION,), "c": (CODE,), "d": (1,)}
    w = {k: (rng.normal(0, 1 / np.sqrt(s[0]), s) if k not in "bd" else np.zeros(s)).astype(np.float32) for k, s in shape.items()}
    w["W"] *= 4
    epochs = max(12, math.ceil(steps * batch / len(bags)))
    model, m, v, t = AttentionModel(w), {k: 0.0 for k in w}, {k: 0.0 for k in w}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        for i in range(0, len(order), batch):
            own = order[i : i + batch]
            grads = _gradients(model, np.concatenate([bags[k] for k in own]).astype(np.float32), np.concatenate([[0], np.cumsum([len(bags[k]) for k in own])]), y[own])
            t += 1
            step = rate * (1 - epoch / epochs)
            for k, g in grads.items():
                g = g + decay * w[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                w[k] -= step * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return model


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = 3000, max_train_chars: int = 100_000, max_passages: int = 50_000) -> AttentionModel:
    """Fit on a bounded sample of the labelled rows that are not held out, in one executor task."""
    known = labels.where(~held_out(F.col(id_col)) & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
    known = known.groupBy(F.col(id_col).alias("doc_id")).agg(F.min(label_col).alias("y"), F.max(label_col).alias("other")).where("y = other")
    place = F.xxhash64(F.lit(3), "doc_id").alias("place")
    picked = known.select("doc_id", F.col("y").cast("int").alias("y"), place).orderBy("place", "doc_id").limit(max_train)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where(F.length("text") <= max_train_chars)
    sample = texts.join(F.broadcast(picked), "doc_id").groupBy("place", "doc_id", "y").agg(F.min("text").alias("text"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bags, labels, room = [], [], max_passages
        for batch in batches:
            for bag, y in zip(as_bags(batch.column("text")), batch.column("y").to_pylist()) if room > 0 else ():
                room -= len(bag)
                if room < 0:
                    break
                bags.append(bag)
                labels.append(y)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(bags, labels))], pa.binary())], names=["model"])

    found = sample.repartition(1).sortWithinPartitions("place", "doc_id").select("text", "y").mapInArrow(learn, "model binary").first()
    return pickle.loads(bytes(found["model"])) if found else AttentionModel(None)


def add_score(docs: DataFrame, model: AttentionModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the model's score of every whole text in a new last column, whose name ``docs`` must not have."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.num_columns - 1
            found = [shared.value.score(data, offsets) for _, _, data, offsets in text_slices(batch.column(last))]
            score = pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], score], names=[*batch.schema.names[:last], score_col])

    judged = docs.select("*", F.col(text_col).cast("string").alias(unused(docs.columns, "judged")[0]))
    return judged.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3, **bounds: int) -> DataFrame:
    """Per document: doc_id, held_out, score and predicted."""
    model = train(docs, labels, id_col, text_col, label_col, **bounds)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = add_score(rows, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3, **bounds: int) -> DataFrame:
    """The rows of ``docs``, all columns, that score ``threshold`` or more.

    Nulls in any column, empty and very long texts, repeated rows and ids are judged like
    all others, by the text alone; an empty table stays empty; columns of any name keep their values.
    """
    model = train(docs, labels, id_col, text_col, label_col, **bounds)
    score = unused(docs.columns, "score")[0]
    return add_score(docs, model, text_col, score).where(F.col(score) >= threshold).drop(score)
