"""Vector index, fingerprints, folds, prefix scans and draws against brute force."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from leakwright.functions.naming import unused
from leakwright.operators import fingerprint, folds, history, metrics, pairs, sampling, vector_index


def test_unused_names():
    assert unused(["a", "B", "b_"], "a", "b", "c", "C") == ["a_", "b__", "c", "C_"]


# ------------------------------------------------------------------ vector index


def near_vectors(n=1500, copies=400, dims=16, seed=3):
    """Vectors, near copies of some, a dense cluster that holds a third of all, and exact copies."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dims))
    twins = base[:copies] + rng.normal(scale=0.04, size=(copies, dims))
    dense = base[:1] + rng.normal(scale=0.3, size=((n + copies) // 2, dims))
    return np.concatenate([base, twins, dense, base[10:40], base[10:11], np.zeros((2, dims))])


def exact_pairs(v, threshold, k):
    classes = {}
    for i, x in enumerate(v.tolist()):
        classes.setdefault(tuple(x), []).append(i)
    reps = np.array(sorted(c[0] for c in classes.values()))
    u = v[reps] / np.maximum(np.linalg.norm(v[reps], axis=1, keepdims=True), 1e-300)
    sim = u @ u.T
    np.fill_diagonal(sim, -9)
    found = set()
    for i in range(len(reps)):
        for j in np.lexsort((reps, -sim[i]))[:k]:
            if sim[i, j] >= threshold:
                found.add((min(reps[i], reps[j]), max(reps[i], reps[j])))
    return found, {(c[0], x) for c in classes.values() for x in c[1:]}


@pytest.mark.parametrize("broadcast", [1 << 26, 0])
def test_index_finds_near_vectors_and_all_copies(spark, monkeypatch, broadcast):
    monkeypatch.setattr(vector_index, "BROADCAST_BYTES", broadcast)
    monkeypatch.setattr(vector_index, "SAMPLE", 128)
    monkeypatch.setattr(vector_index, "ROUND", 2)
    v = near_vectors()
    rows = [(i, x) for i, x in enumerate(v.tolist())] + [(None, v[0].tolist()), (99_999, None)]
    frame = spark.createDataFrame(rows, "rep long, v array<double>").repartition(3)
    got = vector_index.indexed_pairs(frame, "rep", "v", threshold=0.95, k=5, leaf=64, trees=14)
    assert got.columns == ["id_a", "id_b", "cosine", "copy"]
    found = [tuple(r) for r in got.collect()]
    want, copies = exact_pairs(v, 0.95, 5)
    near = {(a, b) for a, b, _, copy in found if not copy}
    assert {(a, b) for a, b, _, copy in found if copy} == copies
    assert len(near) == sum(not f[3] for f in found)
    assert len(near & want) >= 0.95 * len(want) and len(want) > 400
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    assert all(abs(u[a] @ u[b] - c) < 1e-4 and c >= 0.94999 for a, b, c, copy in found if not copy)
    again = vector_index.indexed_pairs(frame.repartition(2), "rep", "v", threshold=0.95, k=5, leaf=64, trees=14)
    assert Counter(map(tuple, again.collect())) == Counter(found)


def test_index_leaves_stay_small_and_rows_are_all_placed(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "SAMPLE", 256)
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(near_vectors(3000, 0, 8).tolist())], "id long, v array<double>")
    classes, _ = vector_index.vector_classes(frame, "id", "v")
    placed = vector_index.forest(classes, trees=3, leaf=64)
    sizes = placed.groupBy("tree", "node").count()
    assert sizes.agg(F.max("count")).first()[0] <= 128
    assert {r["count"] for r in placed.groupBy("tree").count().collect()} == {classes.count()}
    work = sizes.selectExpr("sum(count * count)").first()[0]
    assert work <= 3 * 128 * classes.count()  # not the square of the rows


def test_index_of_nothing_and_trees_for(spark):
    empty = spark.createDataFrame([], "id long, v array<double>")
    assert vector_index.indexed_pairs(empty, "id", "v", 0.9).collect() == []
    one = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0])], "id long, v array<double>")
    assert [tuple(r) for r in vector_index.indexed_pairs(one, "id", "v", 0.9).collect()] == [(1, 2, 1.0, True)]
    assert vector_index.trees_for(100, 0.9, 0.99, 512) == 1
    assert vector_index.trees_for(10**9, 0.98, 0.99, 512) > vector_index.trees_for(10**6, 0.98, 0.99, 512) > 1


def test_recall_is_measured_and_the_sweep_takes_indexed_neighbours(spark):
    v = near_vectors(300, 100)
    frame = spark.createDataFrame([(i, x, i % 3) for i, x in enumerate(v[:-2].tolist())], "id long, v array<double>, g int")
    exact = pairs.cosine_pairs(frame, "id", "v", 0.97)
    found = vector_index.recall(exact.limit(10), exact).first()
    assert found["pairs"] == exact.count() and found["found"] == 10 and found["recall"] == 10 / exact.count()
    near = pairs.cosine_neighbours(frame, "id", "v", 5)
    levels = [0.9, 0.99, 0.9999]
    plain = pairs.threshold_sweep(frame, "id", "v", frame, "g", levels)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, pairs.threshold_sweep(frame, "id", "v", frame, "g", levels, near=near).collect()))


# ------------------------------------------------------------------ fingerprints


def brute_simhash(text):
    votes, words = [0] * 256, (text or "").split()
    for w in words:
        bits = hashlib.md5(w.encode()).hexdigest() + hashlib.md5(b"1:" + w.encode()).hexdigest()
        for i, c in enumerate(format(int(bits, 16), "0256b")):
            votes[i] += c == "1"
    return format(int("".join("1" if 2 * x > len(words) else "0" for x in votes), 2), "064x")


def test_simhash_equals_brute_force_and_keeps_edits_near(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefghijklmnopé", k=rng.randint(2, 8))) for _ in range(3000)]
    texts = ["", None, " \t ", "one", "one two two"]
    for _ in range(40):
        w = rng.choices(vocabulary, k=400)
        edited = list(w)
        edited[rng.randrange(400)] = rng.choice(vocabulary)
        texts += [" ".join(w), "  ".join(edited), " ".join([*w[1:], w[0]]), "x" + " ".join(w)]
    frame = spark.createDataFrame([(i, t, 1, [2]) for i, t in enumerate(texts)], "id long, text string, n int, words array<int>").repartition(3)
    prints = fingerprint.simhash(frame, "id", "text")
    got = {r["id"]: r["p"] for r in prints.select("id", fingerprint.hex_print(F.col("words")).alias("p")).collect()}
    assert got == {i: brute_simhash(t) for i, t in enumerate(texts)}
    apart = lambda a, b: (int(got[a], 16) ^ int(got[b], 16)).bit_count()
    starts = range(5, len(texts), 4)
    assert all(apart(i, i + 2) == 0 for i in starts)  # the order of words does not count
    assert sum(apart(i, i + 1) <= 12 for i in starts) >= 38 and all(apart(i, i + 4) > 60 for i in list(starts)[:-1])
    assert fingerprint.simhash(frame.where("false"), "id", "text").collect() == []


@pytest.mark.parametrize("flips", [0, 1, None])
def test_bands_with_flipped_bits_find_the_same_pairs(spark, flips):
    rng = random.Random(1)
    prints = []
    for _ in range(15):
        words = [rng.getrandbits(64) for _ in range(4)]
        for _ in range(5):
            copy = list(words)
            for bit in rng.sample(range(256), rng.randint(0, 9)):
                copy[bit // 64] ^= 1 << bit % 64
            prints.append(copy)
    # Skew: many prints share all bands but one.
    prints += [[*prints[0][:3], prints[0][3] ^ x] for x in range(64)] + [prints[0], prints[1]]
    rows = [(i, [w - (1 << 64) if w >> 63 else w for w in words]) for i, words in enumerate(prints)]
    frame = spark.createDataFrame(rows, "id long, words array<long>")
    want = {}
    for i in range(len(prints)):
        for j in range(i + 1, len(prints)):
            d = sum((a ^ b).bit_count() for a, b in zip(prints[i], prints[j]))
            if d <= 12:
                want[i, j] = d
    got = [tuple(r) for r in pairs.hamming_pairs(frame, "id", "words", flips=flips).collect()]
    assert len(got) == len(set(got)) and {(a, b): d for a, b, d in got} == want and len(want) > 2000
    for d in (0, 1, 3, 5):
        got = [tuple(r) for r in pairs.hamming_pairs(frame, "id", "words", max_distance=d, flips=flips).collect()]
        assert Counter(got) == Counter((a, b, n) for (a, b), n in want.items() if n <= d)


# ------------------------------------------------------------------ folds


def brute_folds(rows, k, seed=42):
    groups, totals = defaultdict(Counter), Counter()
    for i, g, label in rows:
        unit = f"g:{g}" if g is not None else f"row:{i}"
        name = f"l:{label}" if label is not None else ""
        groups[unit][name] += 1
        totals[name] += 1
    key = lambda u: hashlib.md5(f"{seed}:{u}".encode()).hexdigest()
    kinds = defaultdict(list)
    for u in sorted(groups, key=lambda u: (key(u), u)):
        kinds[tuple(sorted(groups[u].items()))].append(u)
    fold, left = {}, []
    for kind in kinds.values():
        even = len(kind) - len(kind) % k
        fold |= {u: i % k for i, u in enumerate(kind[:even])}
        left += kind[even:]
    labels = sorted(totals)
    spread = lambda u: len(labels) * sum(n * n for n in groups[u].values()) - sum(groups[u].values()) ** 2
    held, sizes = [Counter() for _ in range(k)], [0] * k
    for u in sorted(left, key=lambda u: (-spread(u), key(u))):
        cost = lambda f: (sum(10**9 // totals[x] * n * held[f][x] for x, n in groups[u].items()), sizes[f], f)
        best = min(range(k), key=cost)
        held[best].update(groups[u])
        sizes[best] += sum(groups[u].values())
        fold[u] = best
    return {i: fold[f"g:{g}" if g is not None else f"row:{i}"] for i, g, _ in rows}


def mixed_groups(n_groups=300, seed=4):
    rng, rows = random.Random(seed), []
    for g in range(n_groups):
        for _ in range(rng.choice([1, 1, 1, 2, 3, 8])):
            rows.append((len(rows), g, rng.choices(["a", "b", "c", "rare", None], weights=[60, 20, 15, 4, 1])[0]))
    rows += [(len(rows) + i, 10_000, "a") for i in range(150)]  # a hot group
    return rows + [(len(rows) + i, None, rng.choice("ab")) for i in range(40)]


FOLD_SCHEMA = "unit long, label long, fold string, part string"


@pytest.mark.parametrize("k", [2, 5])
def test_folds_equal_brute_force(spark, k):
    rows = mixed_groups()
    frame = spark.createDataFrame([(i, g, "old", x) for i, g, x in rows], FOLD_SCHEMA).repartition(3)
    got = folds.stratified_group_folds(frame, "unit", "label", "part", k=k)
    assert got.columns == ["unit", "label", "part", "fold"]
    assert {r["unit"]: r["fold"] for r in got.collect()} == brute_folds(rows, k)


@pytest.mark.parametrize("bucket", [folds.BUCKET, 40])
def test_folds_are_atomic_and_even(spark, bucket):
    rows = mixed_groups(1200, 9)
    frame = spark.createDataFrame(rows, "id long, g long, x string")
    got = folds.stratified_group_folds(frame, "id", "g", "x", k=5, bucket=bucket).collect()
    assert len(got) == len(rows)
    in_folds, cells, totals = defaultdict(set), Counter(), Counter()
    for r in got:
        in_folds[r["g"]].add(r["fold"])
        if r["g"] != 10_000:
            cells[r["x"], r["fold"]] += 1
            totals[r["x"]] += 1
    assert all(len(f) == 1 for g, f in in_folds.items() if g is not None)
    for x, n in totals.items():
        if x != "a":  # whose hot group fills one fold
            assert max(cells[x, f] for f in range(5)) - min(cells[x, f] for f in range(5)) <= 8 + n // 50
    assert folds.stratified_group_folds(frame.where("false"), "id", "g", "x").collect() == []
    split = folds.splits_from_folds(folds.stratified_group_folds(frame, "id", "g", "x"), test=(0,), val=(1, 2))
    assert {r["split"] for r in split.where("fold IN (1, 2)").collect()} == {"val"} and set(split.columns) == {"id", "g", "x", "fold", "split"}


# ------------------------------------------------------------------ prefix scans


def brute_scan(rows, patience):
    out = []
    for run in {r[0] for r in rows}:
        best, since, stopped = None, 0, False
        for _, epoch, v in sorted((r for r in rows if r[0] == run), key=lambda r: r[1]):
            improved = v is None or best is None or v > best
            best = v if best is None else best if v is None else max(best, v)
            since = 0 if improved else since + 1
            out.append((run, epoch, v, improved, best, since, not stopped))
            stopped |= since >= patience
    return out


@pytest.mark.parametrize("runs", [1, 40])
def test_early_stop_scan_over_blocks(spark, runs):
    rng = random.Random(runs)
    rows = [(rng.randrange(runs) if runs > 1 else 7, e, rng.choice([None, *(round(rng.random() + e / 9000, 2) for _ in range(12))])) for e in range(3000)]
    rows += [(None, e, float(e % 5)) for e in range(10)]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "run long, epoch long, v double, block int, n int").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = history.early_stop_scan(frame, ["run"], "epoch", "v", 6)
        assert got.columns == [*frame.columns, "improved", "best_so_far", "epochs_since_best", "ran"]
        found = [tuple(r) for r in got.drop("block", "n").collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert Counter(map(repr, found)) == Counter(map(repr, brute_scan(rows, 6)))
    assert history.early_stop_scan(frame.where("false"), ["run"], "epoch", "v", 6).collect() == []


def test_one_run_is_spread_over_tasks(spark):
    from leakwright.functions.ordering import in_blocks

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = in_blocks(spark.range(4000).selectExpr("1 AS run", "id AS epoch"), ["run"], "epoch", "block")
        sizes = [r["count"] for r in rows.groupBy("block").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 4 and max(sizes) < 2000


# ------------------------------------------------------------------ draws


def test_binomial_numbers_have_their_chances(spark):
    cases = [(n, p) for n in (0, 1, 30, 400) for p in (0.0, 0.02, 0.3, 0.5, 0.97, 1.0)]
    number = lambda i, half: (F.xxhash64("draw", "n", "p", i, F.lit(half)) % 2**52 / float(2**53)) + 0.5
    frame = spark.createDataFrame(cases, "n long, p double").join(spark.range(4000).withColumnRenamed("id", "draw"))
    got = defaultdict(Counter)
    for r in frame.groupBy("n", "p", metrics.binomial_draw(F.col("n"), F.col("p"), number).alias("x")).count().collect():
        got[r["n"], r["p"]][r["x"]] += r["count"]
    for n, p in cases:
        chance = [math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)]
        seen = [got[n, p][k] / 4000 for k in range(n + 1)]
        assert sum(got[n, p].values()) == 4000 and set(got[n, p]) <= set(range(n + 1))
        steps = np.abs(np.cumsum(chance) - np.cumsum(seen)).max()
        assert steps < 0.035, (n, p, steps)  # Kolmogorov and Smirnov, one in ten thousand


def test_binomial_numbers_of_many_trials(spark):
    number = lambda i, half: (F.xxhash64("id", i, F.lit(half)) % 2**52 / float(2**53)) + 0.5
    n, p = 10**13, 0.4
    x = [r["x"] for r in spark.range(2000).select(metrics.binomial_draw(F.lit(n), F.lit(p), number).alias("x")).collect()]
    z = (np.array(x) - n * p) / math.sqrt(n * p * (1 - p))
    assert abs(z.mean()) < 0.09 and abs(z.std() - 1) < 0.07


def test_resamples_are_multinomial(spark):
    counts = spark.createDataFrame([("a", "a", 500), ("a", "b", 100), ("b", "a", 3), ("b", "b", 397), (None, "a", 9), ("a", None, 9)], "y_true string, y_pred string, n long")
    drawn = metrics.resamples(counts, 400).collect()
    totals, cells = Counter(), defaultdict(list)
    for r in drawn:
        totals[r["draw"]] += r["n"]
        cells[r["y_true"], r["y_pred"]].append(r["n"])
    assert set(totals.values()) == {1000} and len(totals) == 400 and len(cells) == 4
    for (t, p), n in {("a", "a"): 500, ("a", "b"): 100, ("b", "b"): 397}.items():
        assert abs(np.mean(cells[t, p]) - n) < 4 and abs(np.var(cells[t, p]) / (n * (1 - n / 1000)) - 1) < 0.35
    assert metrics.resamples(counts.where("false"), 5).collect() == []


def test_weighted_sample_takes_the_least_keys(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([0.0, -1.0, None, 1.0, 5.0, 50.0]), "x", i) for i in range(2000)]
    frame = spark.createDataFrame(rows, "id long, w double, key string, part long").repartition(5)

    def key(i, w):
        return -math.log((int(hashlib.md5(f"42:{i}".encode()).hexdigest()[:12], 16) + 1) / (16**12 + 1)) / w

    order = [i for _, i in sorted((key(i, w), i) for i, w, *_ in rows if w and w > 0)]
    for n in (0, 1, 250, 10**6):
        got = sampling.weighted_sample(frame, "id", "w", n)
        assert got.columns == frame.columns and Counter(r["id"] for r in got.collect()) == Counter(order[:n])
    assert sampling.weighted_sample(frame.where("false"), "id", "w", 5).collect() == []
