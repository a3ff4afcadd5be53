"""The classifier's scores, the length plan and the whole pipeline against plain Python."""

import itertools
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from leakwright.llm import mixing, quality
from leakwright.llm.registry import END_ID, tokenizer_path

D = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_score(model, text):
    """The model's score of one text, passage by passage and byte by byte."""
    raw, w = (text or "").encode(), model.weights
    words = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    parts = [words[i : i + quality.PASSAGE_WORDS] for i in range(0, len(words), quality.PASSAGE_WORDS)] or [[]]
    edges = [0, *(p[0][0] for p in parts[1:]), len(raw)]
    codes, logits = [], []
    for part, low, high in zip(parts, edges, edges[1:]):
        cells = Counter((((raw[i] << 8 | raw[i + 1]) * 0x9E3779B97F4A7C15) & (2**64 - 1)) >> 54 for i in range(low, high - 1))
        x = np.zeros(quality.BUCKETS + 1)
        for cell, n in cells.items():
            x[cell] = np.sqrt(n / sum(cells.values()))
        said = [raw[a:b] for a, b in part]
        x[-1] = sum(a == b for a, b in zip(said, said[1:])) / max(1, len(said))
        h = np.tanh(x @ w["W"] + w["b"])
        codes.append(h)
        logits.append((np.tanh(h @ w["V"]) / (1 + np.exp(-(h @ w["U"])))) @ w["a"])
    alpha = np.exp(np.array(logits) - max(logits))
    z = (alpha / alpha.sum()) @ np.array(codes)
    return float(1 / (1 + np.exp(-(z @ w["c"] + w["d"][0]))))


def random_model(seed=3):
    rng = np.random.default_rng(seed)
    shape = {"W": (quality.BUCKETS + 1, quality.CODE), "b": (quality.CODE,), "V": (quality.CODE, quality.ATTENTION), "U": (quality.CODE, quality.ATTENTION), "a": (quality.ATTENTION,), "c": (quality.CODE,), "d": (1,)}
    return quality.AttentionModel({k: rng.normal(size=s).astype(np.float32) for k, s in shape.items()})


def test_scores_equal_plain_ones(spark):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcéß!", k=rng.randint(1, 6))) for _ in range(60)]
    texts = [None, "", " \n ", "x", "x x", *(rng.choice([" ", "\n", "  "]).join(rng.choices(words, k=rng.choice([1, 63, 64, 65, 300]))) for _ in range(40))]
    model = random_model()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["score"] for r in quality.add_score(docs, model).collect()}
    assert all(abs(got[i] - plain_score(model, t)) < 1e-4 for i, t in enumerate(texts)) and len(got) == len(texts)


def test_length_plan_is_the_best_sum_and_never_too_much():
    rng = random.Random(4)
    for _ in range(80):
        sizes = np.array(sorted(rng.sample(range(1, 12), 4)), dtype=np.int64)
        counts = np.array([rng.randint(0, 3) for _ in sizes], dtype=np.int64)
        total, most = int((sizes * counts).sum()), rng.choice([1, 3])
        target = rng.uniform(0, 1.1 * most * total)
        repeats, extra = mixing.fit_lengths(sizes, counts, target, most)
        taken = repeats * total + int((extra * sizes).sum())
        assert 0 <= repeats <= most and (extra >= 0).all() and (extra <= counts).all() and (repeats < most or not extra.any())
        rest = min(target, most * total) - repeats * total
        sums = {sum(n * s for n, s in zip(take, sizes.tolist())) for take in itertools.product(*(range(c + 1) for c in counts.tolist()))} if repeats < most else {0}
        budget = int(round(rest)) if rest >= 1 else 0
        assert taken == repeats * total + max(x for x in sums if x <= budget), (sizes, counts, target)


def test_length_plan_of_large_rests_stays_near(monkeypatch):
    monkeypatch.setattr(mixing, "DP_WORDS", 50)
    rng = np.random.default_rng(2)
    for _ in range(50):
        sizes = np.unique(rng.integers(1, 400, 30))
        counts = rng.integers(1, 60, len(sizes))
        total = int((sizes * counts).sum())
        target = float(rng.uniform(0, 3 * total))
        repeats, extra = mixing.fit_lengths(sizes, counts, target, 3)
        taken = repeats * total + int((extra * sizes).sum())
        assert target - sizes.max() <= taken <= target + 1 and (extra <= counts).all()


# ------------------------------------------------------------------ the pipeline


def near_groups(texts):
    """The first of each component of texts whose 5-word shingles have a similarity of 0.8 or more."""
    sets = []
    for t in texts:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return [find(i) == i for i in range(len(texts))]


def benchmark_words(text):
    return "".join(" " if (c < "\x80" and not c.isalnum()) or (c >= "\x80" and unicodedata.category(c).startswith(("P", "Z", "S", "Cc"))) else c for c in (text or "").lower()).split()


def tiled(item, text, k=5):
    """Words of the item under greedily laid tiles."""
    at = defaultdict(list)
    for j in range(len(text) - k + 1):
        at[tuple(text[j : j + k])].append(j)
    seeds = [(i, j) for i in range(len(item) - k + 1) for j in at.get(tuple(item[i : i + k]), ())]
    used_i, used_t, covered = [False] * len(item), [False] * len(text), 0
    while True:
        best = (k - 1, 0, 0)
        for i, j in seeds:
            n = 0
            while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n] and not used_i[i + n] and not used_t[j + n]:
                n += 1
            if n > best[0] or n == best[0] and n >= k and (j, i) < (best[2], best[1]):
                best = (n, i, j)
        n, i, j = best
        if n < k:
            return covered
        used_i[i : i + n] = used_t[j : j + n] = [True] * n
        covered += n


def leaks(text, items):
    words = benchmark_words(text)
    for item in items:
        if len(item) < 5:
            if item and any(words[i : i + len(item)] == item for i in range(len(words))):
                return True
        elif tiled(item, words) >= 0.5 * len(item):
            return True
    return False


@pytest.mark.skipif(not __import__("os").path.isdir(D), reason="no tables here")
def test_pipeline_equals_plain_python(spark, tmp_path):
    from tokenizers import Tokenizer

    docs, out = spark.read.parquet(f"{D}/documents.parquet"), []
    model = quality.train(docs, spark.read.parquet(f"{D}/labels.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, spark.read.parquet(str(tmp_path / f"out{k - 1}")) if k else docs, D).write.parquet(str(tmp_path / f"out{k}"))
        out.append([r.asDict() for r in spark.read.parquet(str(tmp_path / f"out{k}")).collect()])
    rows = sorted((r.asDict() for r in docs.collect()), key=lambda r: r["doc_id"])
    whole = {r["doc_id"]: r for r in rows}
    scores = {r["doc_id"]: plain_score(model, r["text"]) for r in rows}
    assert all(abs(s - 0.3) > 1e-3 for s in scores.values())
    kept = [r for r in rows if scores[r["doc_id"]] >= 0.3]
    assert sorted(r["doc_id"] for r in out[0]) == [r["doc_id"] for r in kept] and 0 < len(kept) < len(rows)
    kept = [r for r, stays in zip(kept, near_groups([r["text"] for r in kept])) if stays]
    assert sorted(r["doc_id"] for r in out[1]) == [r["doc_id"] for r in kept] and len(kept) < len(out[0])
    items = [benchmark_words(r["text"]) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    kept = [r for r in kept if not leaks(r["text"], items)]
    assert sorted(r["doc_id"] for r in out[2]) == [r["doc_id"] for r in kept] and len(kept) < len(out[1])
    # The mix: sources in code-point order weigh 5, 2 and 1; each gets its share, up to three times its words.
    sizes = defaultdict(int)
    for r in kept:
        sizes[r["source"]] += len(WORD.findall(r["text"]))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}
    target, open_, left = {}, set(sizes), sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 3 * sizes[s] < level * weight[s]}
        for s in full or open_:
            target[s] = 3 * sizes[s] if full else level * weight[s]
        left -= sum(3 * sizes[s] for s in full)
        open_ = open_ - full if full else set()
    copies, taken = Counter(r["doc_id"] for r in out[3]), defaultdict(int)
    assert set(copies) <= {r["doc_id"] for r in kept} and max(copies.values()) <= 3
    for r in out[3]:
        assert r == whole[r["doc_id"]]
        taken[r["source"]] += len(WORD.findall(r["text"]))
    for s in sizes:
        own = [len(WORD.findall(r["text"])) for r in kept if r["source"] == s]
        repeats = min(3, int((target[s] + 1e-6) // sizes[s])) if sizes[s] else 0
        rest = target[s] - repeats * sizes[s]
        reach = 1
        for n in own:
            reach |= reach << n
        budget = int(round(rest)) if repeats < 3 and rest >= 1 else 0
        assert taken[s] == repeats * sizes[s] + max(x for x in range(budget + 1) if reach >> x & 1), (s, taken[s], target[s])
    # The token file: ids in the order of doc_id, the end id after each.
    tokenizer, start, want = Tokenizer.from_file(tokenizer_path()), 0, []
    for r in sorted(out[3], key=lambda r: r["doc_id"]):
        ids = [*tokenizer.encode(r["text"], add_special_tokens=False).ids, END_ID]
        want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in out[4]) == want
