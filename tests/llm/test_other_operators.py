"""Quality, urls, mixing, decontamination, preferences, token files and the pipeline."""

import itertools
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leakwright.llm import dac, decontaminate, mixing, preference, quality, url_rules
from leakwright.llm.registry import URL_RULES, tokenizer_path
from leakwright.llm.textcore import Words

D = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(D), reason="no tables here")


# ------------------------------------------------------------------ quality


def test_gradients_are_right():
    rng = np.random.default_rng(0)
    shape = {"W": (9, 4), "b": (4,), "V": (4, 3), "U": (4, 3), "a": (3,), "c": (4,), "d": (1,)}
    model = quality.AttentionModel({k: rng.normal(size=s) for k, s in shape.items()})
    x, cuts, y = rng.normal(size=(7, 9)), np.array([0, 3, 4, 7]), np.array([1.0, 0.0, 1.0])

    def loss():
        p, _ = model.pool(*model.encode(x), cuts)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for k, g in quality._gradients(model, x, cuts, y).items():
        for i in list(np.ndindex(g.shape))[:6]:
            old = model.weights[k][i]
            model.weights[k][i] = old + 1e-6
            up = loss()
            model.weights[k][i] = old - 1e-6
            down = loss()
            model.weights[k][i] = old
            assert abs((up - down) / 2e-6 - g[i]) < 1e-5


@tables
def test_quality_on_held_out_labels(spark):
    documents, labels = spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet")
    got = quality.quality_scores(documents, labels)
    assert got.count() == documents.count()
    rows = got.where("held_out").join(labels, "doc_id").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.9
    assert all(r.predicted == 1 for r in rows if r.quality == 1)


def test_quality_edges(spark):
    rows = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (None, "a b", 0.5), (3, "x" * 300_000, 0.5)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.quality_scores(rows, none).collect()} == {0.5}
    labels = spark.createDataFrame([(1, 1), (2, 1), (2, 0), (3, None)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in quality.quality_scores(rows, labels).collect())
    model = quality.fit(list(quality.as_bags(pa.array(["good words here", "!!! ### $$$"] * 20))), [1, 0] * 20)
    kept = quality.add_score(rows, model, score_col="s")
    assert kept.columns == ["doc_id", "text", "score", "s"] and all(0 <= r.s <= 1 for r in kept.collect())
    assert quality.quality_scores(rows.limit(0), labels).count() == 0


def test_quality_learns_alike_from_ids_with_several_texts(spark):
    rows = spark.createDataFrame([(i, t) for i in range(40) for t in ("good words here", "more of them", "!! ## $$")[i % 2 :]], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] * 2, "doc_id long, quality int")
    one, two = (sorted(map(tuple, quality.quality_scores(r, labels, max_passages=25).collect()), key=str) for r in (rows, rows.orderBy(F.rand(1)).repartition(5)))
    assert one == two
    assert {r.score for r in quality.quality_scores(rows, labels, max_passages=0).collect()} == {0.5}


# ------------------------------------------------------------------ urls


def verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group().translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_fixed_rules(spark):
    urls = ["http://a.com/x", "http://example.com/en/", "https://WWW.Example.com/en/1?x#y", "http://m.example.com/en", "x://b.net/es/", "net/es/", None, "http://net/fr/é", "http://a.com", "http://xcom/", "a://b://c.com/", "http://d.net/de/?a=1&a=2", ""]
    rows = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, tokens string")
    got = {r.page_id: r for r in url_rules.filter_urls(rows, URL_RULES).collect()}
    for i, u in enumerate(urls):
        host, path, rule, said = verdict(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == said if said else got[i].verdict in ("allow", "block")
    assert url_rules.filter_urls(rows.limit(0), URL_RULES).count() == 0


def test_mined_rules_against_brute_force(spark):
    rng = random.Random(6)
    baskets = [([t for t in "abcde" if rng.random() < 0.5], rng.choice(["allow", "block"])) for _ in range(80)]
    mined = url_rules.mine(spark.createDataFrame(baskets, "tokens array<string>, verdict string"), 0.05, 0.6, 100)
    assert mined
    for r in mined:
        have = [v for t, v in baskets if r["tokens"] <= set(t)]
        assert abs(r["confidence"] - have.count(r["verdict"]) / len(have)) < 1e-9 and r["confidence"] >= 0.6
    index = url_rules.inverted_index(mined)
    for tokens, _ in baskets:
        fits = [k for k, r in enumerate(mined) if r["tokens"] <= set(tokens)]
        assert url_rules.best_rule(tokens, index) == (min(fits) if fits else None)


def test_many_url_rules_are_joined_as_a_table(spark, monkeypatch):
    rng = random.Random(21)
    urls = [f"http{'s' * rng.randint(0, 1)}://{rng.choice(['a', 'b', 'www.example'])}.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'es', 'fr'])}/{rng.choice('xyz')}?{rng.choice('pq')}=1" for _ in range(400)]
    rows = spark.createDataFrame([*enumerate(urls), (1, urls[3]), (None, None), (7, "no scheme")], "page_id long, url string").repartition(3)
    plain = [tuple(r) for r in url_rules.filter_urls(rows, URL_RULES, min_support=0.01, min_confidence=0.55).collect()]
    monkeypatch.setattr(url_rules, "BROADCAST_RULES", 1)
    joined = [tuple(r) for r in url_rules.filter_urls(rows, URL_RULES, min_support=0.01, min_confidence=0.55).collect()]
    assert sorted(map(repr, plain)) == sorted(map(repr, joined)) and len({r[5] for r in plain}) > 3


def test_long_sure_url_rules_are_mined(spark):
    baskets = [(list(t), "block" if {*"abcd"} <= {*t} else "allow") for n in range(1, 6) for t in itertools.combinations("abcde", n)]
    mined = url_rules.mine(spark.createDataFrame(baskets, "tokens array<string>, verdict string"), 0.01, 0.3, 1)
    assert [(r["antecedent"], r["verdict"]) for r in mined] == [([*"abcd"], "block")]
    every = url_rules.mine(spark.createDataFrame(baskets, "tokens array<string>, verdict string"), 0.01, 0.3)
    sure = {}
    for n in range(1, 6):
        for t in itertools.combinations("abcde", n):
            fits = [v for b, v in baskets if {*t} <= {*b}]
            sure |= {(t, v): fits.count(v) / len(fits) for v in ("allow", "block") if fits.count(v) / len(fits) >= 0.3}
    kept = {(t, v) for (t, v), c in sure.items() if not any(w == v and {*s} < {*t} and x >= c for (s, w), x in sure.items())}
    assert {(tuple(r["antecedent"]), r["verdict"]) for r in every} == kept


def best_by_brute_force(tokens, labelled, support, confidence):
    """The surest rule of all combinations of the tokens."""
    best = None
    for n in range(1, len(tokens) + 1):
        for part in itertools.combinations(sorted(tokens), n):
            have = [v for t, v in labelled if set(part) <= set(t)]
            for v in ("allow", "block"):
                if have and have.count(v) >= support * len(labelled) and have.count(v) / len(have) >= confidence:
                    best = max(best or (0, ""), (have.count(v) / len(have), v))
    return best


def test_mining_misses_no_rule(spark):
    rng = random.Random(7)
    labelled = [([t for t in "abcd" if rng.random() < 0.5] + (["p", "q", "r"] if k % 5 == 0 else []), rng.choice(["allow", "block", "block"])) for k in range(90)]
    rows = spark.createDataFrame(labelled, "tokens array<string>, verdict string").coalesce(1)
    names = url_rules.token_classes(rows, 0.05)
    assert names == {t: "p" if t in "pqr" else t for t in "abcdpqr"}
    mined = url_rules.mine(spark.createDataFrame([(sorted({names[t] for t in ts}), v) for ts, v in labelled], "tokens array<string>, verdict string"), 0.05, 0.6)
    index = url_rules.inverted_index(mined)
    for tokens in ([t for t in "abcdq" if rng.random() < 0.6] for _ in range(60)):
        rank = url_rules.best_rule([names[t] for t in tokens], index)
        want = best_by_brute_force(tokens, labelled, 0.05, 0.6)
        assert (want is None) == (rank is None) and (want is None or abs(mined[rank]["confidence"] - want[0]) < 1e-9)


def test_long_repeated_urls(spark):
    long = "http://example.com/en/" + "/".join(f"part{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60))
    urls = [long] * 20 + [f"http://a{k % 7}.com/x{k % 5}/y" for k in range(1000)] + ["ftp://host/partaz"]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {r.page_id: r for r in url_rules.filter_urls(rows, URL_RULES).collect()}
    assert len(got) == len(urls) and got[0].verdict == "block" and got[1020].verdict == "block" and got[1020].because


# ------------------------------------------------------------------ mixing


def targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, free, out = sum(sizes.values()), set(names), {}
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
            free.discard(s)
    return out


def test_mix_meets_targets(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 3, 10, 40, 200])), rng.choice(["a", "B", "é", None, "c"] + ["hot"] * 3), "x") for i in range(400)]
    rows += [(500 + i, "w w w", "hot", "x") for i in range(200)] + [(900, None, "blank", "x"), (901, "w", "tiny", "x"), (None, "w w", "a", "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, n string")
    got = mixing.mix_report(table).collect()
    again = mixing.mix_report(table.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and r.taken in {k * r.size for k in range(4)}
        assert abs(r.target - want[r.source]) < 1e-6
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 3, (s, taken[s], want[s])
    mixed = mixing.mix(table)
    assert mixed.columns == table.columns and mixed.count() == sum(r.copies for r in got)
    assert mixing.mix_report(table.limit(0)).count() == 0 and mixing.mix(table.limit(0)).count() == 0


@pytest.mark.parametrize("ranked", [1000, 7, 1])
def test_mix_takes_some_of_repeated_rows(spark, monkeypatch, ranked):
    monkeypatch.setattr(mixing, "RANKED_ROWS", ranked)
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    rows = [(1, "one two three four", "a")] * 1000 + [(2, "five six", "b")] * 700 + [(k, "w " * (k % 5), "c") for k in range(900)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    sizes = {"a": 4000, "b": 1400, "c": 1800}
    got = mixing.mix_report(table).collect()
    for s, want in targets(sizes).items():
        assert abs(sum(r.taken for r in got if r.source == s) - want) <= 4
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_report(table.coalesce(1)).collect()))
    mixed = mixing.mix(table)
    assert sorted(map(tuple, mixed.groupBy("source").count().collect())) == sorted((s, sum(r.copies for r in got if r.source == s)) for s in sizes)


@pytest.mark.parametrize("ranked", [1000, 3, 0])
def test_edges_are_those_of_the_whole_order(spark, monkeypatch, ranked):
    monkeypatch.setattr(mixing, "RANKED_ROWS", ranked)
    rng = random.Random(5)
    hashes = {k: sorted(rng.choice([rng.randrange(-(2**63), 2**63), rng.randrange(-5, 5), 2**63 - 1, -(2**63)]) for _ in range(300)) for k in range(4)}
    extra = {0: 1, 1: 150, 2: 299, 3: 40}
    cells = [(k, h, hs.count(h)) for k, hs in hashes.items() for h in set(hs)]
    got = mixing._edges(spark.createDataFrame(cells, "k int, h long, weight long").repartition(5), spark.createDataFrame(list(extra.items()), "k int, extra long"), ["k"], "h")
    want = [(k, hs[extra[k] - 1], extra[k] - sum(x < hs[extra[k] - 1] for x in hs), hs.count(hs[extra[k] - 1])) for k, hs in hashes.items()]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_knapsack_is_optimal():
    rng = random.Random(1)
    for _ in range(60):
        sizes, counts = [rng.randint(1, 9) for _ in range(4)], [rng.randint(0, 3) for _ in range(4)]
        budget = rng.randint(0, 40)
        got = mixing.close_budget(sizes, counts, budget)
        assert all(0 <= g <= c for g, c in zip(got, counts))
        sums = {0}
        for s, c in zip(sizes, counts):
            sums = {x + k * s for x in sums for k in range(c + 1)}
        assert sum(g * s for g, s in zip(got, sizes)) == max(x for x in sums if x <= budget)


# ------------------------------------------------------------------ decontamination


def greedy_tiles(item, text, k):
    """Straight greedy tiling: find the longest unmarked common run, again and again."""
    used_i, used_t, tiles = [False] * len(item), [False] * len(text), []
    while True:
        best = (k - 1, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n] and not used_i[i + n] and not used_t[j + n]:
                    n += 1
                if n > best[0] or n == best[0] and n >= k and (j, i) < (best[2], best[1]):
                    best = (n, i, j)
        n, i, j = best
        if n < k:
            return tiles
        used_i[i : i + n] = used_t[j : j + n] = [True] * n
        tiles.append(n)


def test_tiling_against_brute_force():
    rng = random.Random(2)
    for _ in range(40):
        item = rng.choices("abc", k=rng.randint(3, 14))
        text = rng.choices("abc", k=rng.randint(3, 25))
        block = decontaminate.Benchmark([(1, " ".join(item))], 3)
        data = np.frombuffer(" ".join(text).encode(), np.uint8)
        got = list(block.matches(Words(data, np.array([0, len(data)]), breaks=decontaminate._BREAKS)))
        want = greedy_tiles(item, text, 3)
        assert [(g[2], g[3], g[4]) for g in got] == ([(sum(want) / len(item), len(want), max(want))] if want else [])


def test_tiling_of_repetitive_texts():
    for item, text in ((["x"] * 1000, ["x"] * 20_000), (["x", "y"] * 500, ["y", "x", "x"] * 7000)):
        block = decontaminate.Benchmark([(1, " ".join(item))] * 2, 5)
        data = np.frombuffer(" ".join(text).encode(), np.uint8)
        got = list(block.matches(Words(data, np.array([0, len(data)]), breaks=decontaminate._BREAKS), 0.5))
        assert [g[1:] for g in got] == ([(0, 1.0, 1, 1000), (1, 1.0, 1, 1000)] if item[1] == "x" else [])
    small = ["x"] * 60, ["x"] * 47 + ["y"] + ["x"] * 30
    assert decontaminate.tile(*(np.array([hash(w) % 97 for w in side], dtype=np.uint64) for side in small), 5) == greedy_tiles(*small, 5)


def test_leaks_reordered_and_in_blocks(spark):
    item = " ".join(f"word{i}" for i in range(20))
    halves = item.split()
    texts = ["Clean text only.", f"Before, {item.upper()}! after", "x ".join(["", " ".join(halves[10:]) + " y ", " ".join(halves[:10])]), None, "", " ".join(halves[:8]), "It is TOO, short."]
    rows = spark.createDataFrame([(i, t, 0.0) for i, t in enumerate(texts)], "doc_id long, text string, coverage double")
    bench = spark.createDataFrame([(7, item), (8, "too short"), (9, None), (10, "unrelated " * 9)], "item_id long, text string")
    for size in (1 << 20, 40):
        found = decontaminate.find_leaks(rows, bench, block_bytes=size).collect()
        assert sorted((r.doc_id, r.item_id, r.coverage) for r in found) == [(1, 7, 1.0), (2, 7, 1.0), (6, 8, 1.0)]
        kept = decontaminate.drop_leaks(rows, bench, block_bytes=size)
        assert kept.columns == rows.columns and sorted(r.doc_id for r in kept.collect()) == [0, 3, 4, 5]
    assert decontaminate.find_leaks(rows, bench.limit(0)).count() == 0
    assert decontaminate.drop_leaks(rows.limit(0), bench).count() == 0


# ------------------------------------------------------------------ preferences


def test_preferences(spark):
    turns = [
        (0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (0, 2, "user", "more"), (0, 3, "assistant", "ok"),
        (1, 0, "user", "hi"), (1, 1, "assistant", "no"),
        (2, 0, "user", "same"), (3, 0, "user", "same"), (4, 0, None, None), (None, 0, "user", "lost"),
        (6, 1, "assistant", "b"), (6, 0, "user", "a"), (7, 0, "user", "a"), (7, 1, "assistant", "b"), (7, 1, "assistant", "b"),
    ]
    rows = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, side string")
    got = {r.pair_id: r for r in preference.preference_records(rows, preference.paired_by_id(rows)).collect()}
    one = got[0]
    assert (one.prefix_turns, one.prompt) == (1, "<|im_start|>user\nhi<|im_end|>\n")
    assert [one.chosen[s.begin : s.end] for s in one.chosen_spans] == ["yes<|im_end|>\n", "ok<|im_end|>\n"]
    assert [one.rejected[s.begin : s.end] for s in one.rejected_spans] == ["no<|im_end|>\n"]
    assert (got[1].prefix_turns, got[1].chosen, got[1].rejected, got[1].chosen_spans) == (1, "", "", [])
    assert (got[2].rejected_id, got[2].prompt, got[2].rejected) == (None, "", None)
    assert (got[3].prefix_turns, got[3].chosen, got[3].rejected) == (2, "", "<|im_start|>assistant\nb<|im_end|>\n")
    assert preference.preference_records(rows.limit(0), preference.paired_by_id(rows.limit(0))).count() == 0


def test_preferences_of_repeated_pairs_and_last_turns(spark):
    turns = [(c, t, "user" if t % 2 == 0 else "assistant", f"{c if t == 3 else 'same'} {t}") for c in range(4) for t in range(4)] + [(5, 0, "user", "alone")]
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    pairs = spark.createDataFrame([(9, "chosen", 2), (9, "chosen", 0), (9, "rejected", 1), (9, "rejected", 1)], "pair_id long, side string, conv_id long")
    one = preference.preference_records(rows, pairs).collect()
    assert [(r.chosen_id, r.rejected_id, r.prefix_turns) for r in one] == [(0, 1, 3)]
    assert [one[0].chosen[s.begin : s.end] for s in one[0].chosen_spans] == ["0 3<|im_end|>\n"]
    partners = spark.createDataFrame([(0, 1), (2, 5), (5, 0)], "conv_id long, partner long")
    got = sorted(map(tuple, preference.last_turn_from(rows, partners).collect()))
    assert got == sorted((-1, t, r, "1 3" if t == 3 else x) for c, t, r, x in turns if c == 0)


# ------------------------------------------------------------------ token files


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_pieces_give_the_ids_of_whole_texts(whole):
    rng = random.Random(1)
    e = dac.TokenEncoder(tokenizer_path())
    odd = ["", " ", "   ", "a  b", " a", "a ", "x<|endoftext|> y <|endoftext|>", "it's    b  ", "a\n  b  ", "I'll 12 34é\x1c b", "\u2003 \u2003x", "naïve Ünder, ﬁn… 日本 ok"]
    odd += ["".join(rng.choice(" \n\tab.'1éß<|>") for _ in range(25)) for _ in range(1500)]
    for t in odd:
        assert np.frombuffer(e.encode(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("high", [1, 2, 300, 60_000, 2**32])
def test_segments_round_trip(high):
    rng = np.random.default_rng(high % 97)
    ids = np.minimum(rng.zipf(1.3, 5000), high - 1).astype(np.uint32)
    segment = dac.Segment(dac.build_segment([4, None, -3], [0, 4000, 1000], ids))
    assert (segment.ids() == ids).all() and segment.doc_ids == [4, None, -3] and segment.offsets.tolist() == [0, 0, 4000, 5000]
    for i in [0, 511, 512, 513, 4999, *rng.integers(0, 5000, 200).tolist()]:
        assert segment.token(i) == ids[i]
    assert segment.document(0) == [] and segment.document(2) == ids[4000:].tolist()
    with pytest.raises(IndexError):
        segment.token(5000)
    with pytest.raises(ValueError):
        dac.Segment(b"no segment at all")


def test_token_table(spark, tmp_path, whole):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab cd\n") for _ in range(rng.randint(0, 200))) for _ in range(150)] + [None, "", "long " * 30_000]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    ids[0] = ids[1]
    rows = spark.createDataFrame([(i, t, 1) for i, t in zip(ids, texts)] + [(None, "null id", 1)], "doc_id long, text string, part int").repartition(6)
    dac.write_token_table(rows, str(tmp_path / "t"), tokenizer_path(), 2, segment_tokens=500)
    got = sorted(dac.read_token_table(spark, str(tmp_path / "t")).collect(), key=lambda r: r.start)
    assert len(got) == rows.count() and got[0].doc_id is None
    start = 0
    want = sorted(rows.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
    for r, w in zip(got, want):
        own = [*whole.encode(w.text or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (w.doc_id, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        start += len(own)
    dac.write_token_table(rows.limit(0), str(tmp_path / "none"), tokenizer_path())
    assert dac.read_token_table(spark, str(tmp_path / "none")).count() == 0


# ------------------------------------------------------------------ pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefg", k=rng.randint(2, 7))) for _ in range(500)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    junk = lambda n: " ".join(w.upper() + "!!" for w in rng.choices(vocabulary, k=n))
    item = prose(30)
    good, bad = [prose(120) for _ in range(60)], [junk(80) for _ in range(20)]
    texts = [*good, *bad, good[0] + " extra", f"{prose(40)} {item} {prose(40)}"]
    names = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)], names).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 60), 0) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, rows, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        rows = spark.read.parquet(str(tmp_path / f"out{k}"))
        seen.append(sorted(r.doc_id for r in rows.select("doc_id").collect()))
        if k < 4:
            assert rows.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert seen[0] == [*range(60), 80, 81] and seen[1] == [*range(60), 81] and seen[2] == list(range(60))
    assert set(seen[3]) <= set(range(60)) and seen[4] == seen[3]
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r.doc_id for r in run.collect()) == seen[4]
