"""Brute force against the operators on texts: words, near-duplicates, passages, exact copies, lines."""

import collections
import hashlib
import random
import re
import string

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leakwright.llm import chosen_path, line_dedup
from leakwright.llm.chosen_path import drop_near_duplicates, forest_for, near_duplicates, near_pairs, set_links
from leakwright.llm.exact_dedup import exact_duplicates
from leakwright.llm.line_dedup import drop_boilerplate, host_of, html_lines
from leakwright.llm.substring import DIFFERENCE_SETS, cover_for, drop_repeated_passages
from leakwright.llm.textcore import FIRST, Words, text_slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SCHEMA = "doc_id long, text string, rep int, cluster string, text_sha256 string"  # names that operators use inside


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, 1, "x", "y") for i, t in zip(ids or range(len(texts)), texts)], SCHEMA)


def corpus(n=120, seed=4):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randint(1, 5))) for _ in range(300)]
    out = []
    for _ in range(n):
        kind = rng.random()
        if out and kind < 0.35:
            words = WORD.findall(rng.choice(out))
            for _ in range(rng.randint(0, 4)):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(vocabulary)
            out.append(rng.choice([" ", "\n"]).join(words))
        elif out and kind < 0.45:
            out.append(rng.choice(out).upper())
        else:
            out.append(" ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 2, 3, 30, 80, 150]))))
    return [*out, "", " \t ", "one", "One", "two words", None]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t\x0b\x0c\r\xa0")), max_size=12))
def test_words_are_those_of_the_pattern(texts):
    got, hashes = [], []
    for at, end, data, offsets in text_slices(pa.array(texts, pa.string()), 5):
        words = Words(data, offsets)
        found = [bytes(data[a:b]).decode() for a, b in zip(words.starts, words.ends)]
        got += [found[f : f + n] for f, n in zip(words.first, words.counts)]
        hashes += zip(found, words.hashes(FIRST).tolist())
    assert got == [WORD.findall(t or "") for t in texts]
    assert len(set(hashes)) == len({w for w, _ in hashes}) == len({h for _, h in hashes})


def test_difference_sets_cover_every_shift():
    for v, d in DIFFERENCE_SETS.items():
        assert {(a - b) % v for a in d for b in d} == set(range(v))
    assert cover_for(50) == (31, DIFFERENCE_SETS[31], 20) and cover_for(1)[2] == 1


def removed(texts, ids, window):
    words = [WORD.findall(t or "") for t in texts]
    low = {}
    for i, w in zip(ids, words):
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            low[key] = min(low.get(key, i), i)
    out = []
    for i, w in zip(ids, words):
        gone = set()
        for p in range(len(w) - window + 1):
            if low[tuple(w[p : p + window])] < i:
                gone.update(range(p, p + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


@pytest.mark.parametrize("window", [4, 50])
def test_passages_against_brute_force(spark, window):
    texts = corpus()
    ids = list(range(len(texts)))
    ids[5] = ids[4]  # one id twice
    got = drop_repeated_passages(docs(spark, texts, ids).repartition(5), window=window).collect()
    assert sorted(map(tuple, got)) == sorted(removed(texts, ids, window))
    digest = drop_repeated_passages(docs(spark, texts, ids), window=window, digest=True).collect()
    assert sorted((r.doc_id, r.kept_sha256) for r in digest) == sorted((i, hashlib.sha256(k.encode()).hexdigest()) for i, _, _, k in removed(texts, ids, window))
    assert drop_repeated_passages(docs(spark, []), window=window).count() == 0
    null = drop_repeated_passages(docs(spark, ["a b c d e"] * 3, [None, None, 2]), window=4).collect()
    assert [r.n_removed for r in null] == [0, 0, 0]


def shingles(text, k, lower=True):
    w = WORD.findall((text or "").translate(ASCII) if lower else text or "")
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(texts, k):
    sets = [shingles(t, k) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(i, len(sets[i]), find(i), find(i) == i) for i in range(len(texts))]


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_against_brute_force(spark, k):
    texts = corpus(150, seed=9)
    got = sorted(map(tuple, near_duplicates(docs(spark, texts).repartition(3), k=k).collect()))
    assert got == components(texts, k)


def test_near_duplicates_are_dropped(spark):
    texts, k = corpus(60, seed=10), 5
    kept = drop_near_duplicates(docs(spark, texts), k=k)
    assert kept.columns == ["doc_id", "text", "rep", "cluster", "text_sha256"]
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, _, _, stays in components(texts, k) if stays]


def test_a_large_group_of_near_copies(spark):
    """Copies whose edits differ: many are similar to the centre, few to each other."""
    rng = random.Random(0)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(160):
        words = list(base)
        for p in rng.sample(range(120), rng.randint(0, 12)):
            words[p] = f"x{rng.random()}"
        texts.append(" ".join(words))
    got = sorted(map(tuple, near_duplicates(docs(spark, texts), k=2).collect()))
    assert got == components(texts, 2)


def test_near_duplicates_edges(spark):
    none = near_duplicates(docs(spark, []), k=2)
    assert none.count() == 0
    got = near_duplicates(docs(spark, ["a b c", "a b c", "a b c", "z"], [None, 7, 7, 7]), k=2).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in got) == [(-1, -1, True), (7, 7, True), (7, 7, True), (7, 7, True)]


def test_recall_of_trees():
    for n in (0, 10, 10**5, 10**9):
        forest = forest_for(n, 0.8)
        assert 1 - (1 - 0.8**forest.last) ** forest.trees >= 0.99999
        assert all(len(set(forest.selected(t).tolist())) == forest.width for t in (0, forest.trees - 1))
        assert len({c for t in range(forest.trees) for c in forest.selected(t)[: forest.last].tolist()}) == forest.trees * forest.last


def test_pairs_and_links_across_components():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 40)) for _ in range(25)]
    comps = rng.integers(0, 6, 25)
    pairs = {(i, j) for i in range(25) for j in range(i) if comps[i] != comps[j] and 100 * len(np.intersect1d(sets[i], sets[j])) >= 50 * len(np.union1d(sets[i], sets[j]))}
    found = set_links(list(range(25)), comps.tolist(), sets, (50, 100))
    assert {(max(p), min(p)) for p in found} <= pairs and len(found) < 6

    def merged(links):
        label = {int(c): int(c) for c in comps}
        for i, j in links:
            a, b = label[int(comps[i])], label[int(comps[j])]
            label = {k: min(a, b) if v in (a, b) else v for k, v in label.items()}
        return label

    assert merged(found) == merged(pairs)
    sketches = rng.integers(0, 3, (25, 128)).astype(np.uint8)
    one, two = near_pairs(sketches, comps, 0.35)
    want = {(i, j) for i in range(25) for j in range(25) if comps[i] != comps[j] and (sketches[i] == sketches[j]).mean() >= 0.35}
    assert {frozenset(p) for p in zip(one.tolist(), two.tolist())} == {frozenset(p) for p in want}


@pytest.mark.parametrize("pairs", [1, 40])
def test_recursion_into_large_nodes(spark, monkeypatch, pairs):
    """With few pairs a node, groups are branched down to the last level, and nothing is lost there."""
    monkeypatch.setattr(chosen_path, "NODE_PAIRS", pairs)
    monkeypatch.setattr(chosen_path, "MAX_DEPTH", 8)
    monkeypatch.setattr(chosen_path, "BROADCAST_IDS", 0)
    texts = corpus(90, seed=11)
    assert sorted(map(tuple, near_duplicates(docs(spark, texts), k=2).collect())) == components(texts, 2)


def test_words_of_a_regular_make_are_told_apart(spark):
    """Two words of 4,096 letters that polynomials modulo 2**64 do not tell apart."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))
    other = one.translate(str.maketrans("ab", "ba"))
    words = [f"w{i}" for i in range(49)]
    got = near_duplicates(docs(spark, [one, other]), k=2).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(0, 0), (1, 1)]
    got = drop_repeated_passages(docs(spark, [" ".join([*words, one]), " ".join([*words, other]), " ".join([*words, one])]), window=50).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(0, 0), (1, 0), (2, 50)]


def test_rows_are_dropped_each_by_itself(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(7, text), (7, text), (7, "another text under the same id"), (None, text), (3, text + " x"), (None, "quite another one here"), (None, "quite another one here")]
    kept = drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), broadcast_ids=0).collect()
    assert sorted(((r.doc_id or -1), r.text) for r in kept) == sorted([(3, text + " x"), (7, "another text under the same id"), (-1, "quite another one here")])


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("rows", [1000, 2])
def test_exact_copies(spark, keep, rows):
    texts = [*corpus(), "É", "é", "A" * 50_000, "a" * 50_000, None]
    groups = collections.defaultdict(list)
    for i, t in enumerate(texts):
        groups[(t or "").translate(ASCII)].append(i)
    best = max if keep == "largest" else min
    want = []
    for i, t in enumerate(texts):
        own = groups[(t or "").translate(ASCII)]
        want.append((i, best(own), len(own), best(own) == i, hashlib.sha256((t or "").translate(ASCII).encode()).hexdigest()))
    got = exact_duplicates(docs(spark, texts).repartition(3), keep=keep, group_rows=rows).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted(map(tuple, got.collect())) == want


def test_exact_copies_with_repeated_and_null_ids(spark):
    for rows in (1000, 1):
        got = exact_duplicates(docs(spark, ["A", "a", "a", None, "", "q", "q"], [1, 1, None, 2, 3, None, None]), keep="largest", group_rows=rows)
        by = {r.text_sha256: r for r in got.groupBy("text_sha256").agg(F.count_if("kept").alias("kept"), F.max("keep_id").alias("id"), F.max("group_size").alias("n")).collect()}
        assert sorted((r.kept, r.id or -1, r.n) for r in by.values()) == [(1, -1, 2), (1, 1, 3), (1, 3, 2)]
    assert exact_duplicates(docs(spark, [])).count() == 0


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_lines_against_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", broadcast)
    monkeypatch.setattr(line_dedup, "BROADCAST_TEXTS", broadcast)
    rng = random.Random(3)
    rows = []
    for i in range(90):
        site = rng.choice(["a", "b", None])
        lines = [rng.choice(["menu", " menu\t", "footer", "", "  ", f"own {i}", f"x{rng.randrange(40)}"]) for _ in range(rng.randint(0, 6))]
        rows.append((i, rng.choice([None, "\n".join(lines)]) if i % 11 == 0 else "\n".join(lines), site, "x"))
    pages = spark.createDataFrame(rows, "doc_id long, text string, source string, marks string")
    strip = lambda line: line.strip(" \t\x0b\f\r")
    total, seen = collections.Counter(r[2] for r in rows), collections.Counter()
    for _, text, site, _ in rows:
        seen.update({(site, strip(x)) for x in (text or "").split("\n") if strip(x)})
    got = {r.doc_id: r for r in drop_boilerplate(pages, max_ratio=0.2).collect()}
    for i, text, site, _ in rows:
        if text is None:
            assert (got[i].text, got[i].n_lines, got[i].n_dropped) == (None, 0, 0)
            continue
        lines = text.split("\n")
        kept = [x for x in lines if not (strip(x) and seen[site, strip(x)] >= 3 and seen[site, strip(x)] > total[site] * 0.2)]
        assert (got[i].text, got[i].n_lines, got[i].n_dropped) == ("\n".join(kept), len(lines), len(lines) - len(kept))
    assert drop_boilerplate(pages.limit(0)).count() == 0


def test_hosts(spark):
    rows = spark.createDataFrame([("http://A.b/c",), ("nope",), ("x://h?q",), (None,)], "u string")
    assert [r[0] for r in rows.select(host_of(F.col("u"))).collect()] == ["a.b", "", "h", None]


def test_html_lines(spark):
    rows = spark.createDataFrame([("<P class='x'>a <b>b</b><br/>c</p><pre>d</pre><LI>e",), (None,), ("",)], "h string")
    assert [r[0] for r in rows.select(html_lines(F.col("h"))).collect()] == ["\na <b>b</b>\nc\n<pre>d</pre>\ne", None, ""]


def test_native_operators_have_no_python(spark):
    for plan in (exact_duplicates(docs(spark, ["a", "b"])), drop_boilerplate(docs(spark, ["a"]).withColumn("source", F.lit("s")))):
        assert not re.search("Python|Pandas|Arrow", plan._jdf.queryExecution().toString())
