import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from leakwright.operators import fingerprint, pairs, vector_index
from leakwright.plans import catalog
from leakwright.sources import shared_tables


@pytest.mark.parametrize("spelling", ["{}", "file:{}", "file://{}"])
def test_what_a_scratch_keeps_is_found_however_the_folder_is_spelled(spark, tmp_path, monkeypatch, spelling):
    monkeypatch.setattr(shared_tables, "shared_folder", lambda spark: spelling.format(f"{tmp_path}/leakwright-app"))
    with shared_tables.scratch(spark) as kept:
        other = shared_tables.stash(spark.range(3), "other")
        result = shared_tables.stash(other.where("id > 0"), "result")
        kept += {f.rsplit("/", 1)[0] for f in result.inputFiles()}
    assert sorted(r["id"] for r in result.collect()) == [1, 2]
    folder = tmp_path / "leakwright-app"
    assert [p.name.split("-")[0] for p in folder.iterdir()] == ["result"]
    shared_tables.discard(result)
    assert list(folder.iterdir()) == []


def _as_its_sql(spark, folder, name, tables):
    """The query's rows and those of its SQL over parquet files in ``folder``."""
    with duckdb.connect() as db:
        for t in tables:
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
        found = db.execute(catalog.oracle_sql()[name])
        columns = [c[0] for c in found.description]
        want = found.fetchall()
    got = catalog.queries()[name](spark, str(folder)).select(*columns).collect()
    return sorted(map(tuple, got), key=repr), sorted(want, key=repr)


@pytest.mark.parametrize("name", ["grouped_split", "contamination_grouped"])
def test_groups_of_several_languages_split_as_the_sql_says(spark, tmp_path, name):
    with duckdb.connect() as db:
        db.execute(f"""COPY (SELECT i AS doc_id, 'text ' || g AS text, CASE WHEN g % 2 = 0 AND i = g * g THEN 'de' ELSE (['en', 'es', 'fr'])[g % 3 + 1] END AS lang, 'a' AS source
            FROM (SELECT i, floor(sqrt(i))::BIGINT AS g FROM range(2500) t(i))) TO '{tmp_path}/documents.parquet' (FORMAT parquet)""")
    got, want = _as_its_sql(spark, tmp_path, name, ["documents"])
    assert got == want


def test_bits_that_all_prints_share_are_in_no_band(spark, monkeypatch):
    """Prints of 32 bits in a word of 64: a band of the upper half would bring every print together."""
    monkeypatch.setattr(pairs, "MEMBERS", 2)
    prints = spark.createDataFrame([(i, [(i // 3 * 2654435761) % (1 << 32)]) for i in range(600)], "id long, words array<long>")
    words = {r["id"]: r["words"][0] for r in prints.collect()}
    places = pairs._varying(prints.select("words").distinct(), 1)
    assert places and max(places) < 32
    for distance in (1, 8):
        got = sorted(map(tuple, pairs.hamming_pairs(prints, "id", "words", words=1, max_distance=distance).collect()))
        assert got == [(a, b, d) for a in words for b in words if a < b and (d := (words[a] ^ words[b]).bit_count()) <= distance]


def test_vectors_are_not_shuffled_once_for_each_block(spark, monkeypatch):
    """Copies, ties and a least cosine, by blocks that meet in a cross join of written tables."""
    monkeypatch.setattr(pairs, "BLOCK_ROWS", 16)
    monkeypatch.setattr(pairs, "SLAB_BLOCKS", 2)
    monkeypatch.setattr(pairs, "EXACT", 7)
    v = np.random.default_rng(3).normal(size=(90, 6))
    v[60:] = v[:30]
    near = pairs.cosine_neighbours(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>"), "id", "v", 3, least=0.5)
    assert "CartesianProduct" in near._jdf.queryExecution().toString()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    sim = np.round(u @ u.T, 9)
    want = {(i, j, p + 1) for i in range(90) for p, j in enumerate(sorted((j for j in range(90) if j != i), key=lambda j: (-sim[i, j], j))[:3]) if sim[i, j] >= 0.5}
    assert {(r.src, r.dst, r.place) for r in near.collect()} == want


def test_prints_count_every_word_where_the_text_lies(spark):
    """Against the votes of each word by itself: long texts, repeated ids, null ids and texts, and words that fill the memory."""
    rng = random.Random(4)
    texts = ["", None, " \t\n", "one", "é\u00a0x \x0b y\x1fz", *(" ".join(rng.choices(["a", "bb", "cé", *map(str, range(n))], k=n)) for n in (2, 254, 255, 256, 700, 9000))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "two three"), (3, "one"), (None, "n"), (None, "m n")]
    got = fingerprint.simhash(spark.createDataFrame(rows, "id long, text string"), "id", "text")
    assert "Generate" not in got._jdf.queryExecution().toString()
    words = {}
    for i, t in rows:
        words.setdefault(i, []).extend(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = {}
    for i, found in words.items():
        digits = [hashlib.md5(w.encode()).hexdigest() + hashlib.md5(f"1:{w}".encode()).hexdigest() for w in found]
        halves = [sum((2 * sum(int(d[8 * k : 8 * k + 8], 16) >> s & 1 for d in digits) > len(found)) << s for s in range(32)) for k in range(8)]
        want[i] = "".join(f"{h:08x}" for h in halves)
    shown = got.select("id", fingerprint.hex_print(got["words"]).alias("print")).collect()
    assert len(shown) == len(want) and {r["id"]: r["print"] for r in shown} == want


def test_bands_that_many_prints_share_are_spread_and_never_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pairs, "HOT", 10)
    rng = random.Random(8)
    rows = [(i, [rng.getrandbits(20), 7 if i < 90 else rng.getrandbits(40), 0, 5]) for i in range(120)]
    path = f"{tmp_path}/prints"
    spark.createDataFrame(rows, "id long, words array<long>").write.parquet(path)
    prints = spark.read.parquet(path)
    close = pairs._close_classes(prints.select("words"), 4, 12, flips=1)
    assert "SortMergeJoin [band" in close._jdf.queryExecution().toString()
    apart = lambda a, b: sum((x ^ y).bit_count() for x, y in zip(a, b))
    want = sorted((i, j, d) for i, a in rows for j, b in rows if i < j and (d := apart(a, b)) <= 12)
    for flips in (0, 1):
        assert sorted(map(tuple, pairs.hamming_classes(prints, "id", "words", flips=flips).collect())) == want
    of = lambda name: prints.select(prints["words"].alias(name), F.lit(0).alias("band"), F.lit(3).cast("long").alias("value"))
    one, two = pairs._spread(of("wa"), of("wb"))
    assert one.groupBy("share").count().agg({"count": "max"}).first()[0] < 30 and two.count() == 120 * 12


def test_index_sends_as_many_copies_of_a_vector_whatever_the_rows(spark, monkeypatch):
    sent = []
    forest = vector_index.forest

    def watched(*args, **kwargs):
        placed = forest(*args, **kwargs)
        sent.append(placed.count() / args[0].count())
        return placed

    monkeypatch.setattr(vector_index, "forest", watched)
    rng = np.random.default_rng(8)
    for n in (400, 3200):
        base = rng.normal(size=(n, 16))
        v = np.concatenate([base, base[: n // 4] + rng.normal(scale=0.05, size=(n // 4, 16))])
        frame = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "id long, v array<double>")
        got = {(r["id_a"], r["id_b"]): r["cosine"] for r in vector_index.indexed_pairs(frame, "id", "v", 0.95, recall=0.999, leaf=8).collect()}
        u = v / np.linalg.norm(v, axis=1, keepdims=True)
        near = np.triu(u @ u.T, 1)
        want = {(int(i), int(j)): near[i, j] for i, j in zip(*np.nonzero(near >= 0.95))}
        assert len(want) >= n // 4 and len(want.keys() - got.keys()) <= 0.01 * len(want)
        assert all(abs(c - want[p]) < 1e-5 for p, c in got.items())
    assert sent[0] == sent[1]  # trees over all rows grew with the rows before


def test_trees_of_a_cell_place_every_point_and_keep_the_nearest():
    rng = np.random.default_rng(9)
    points = rng.normal(size=(700, 8))
    points[600:650] = points[0]  # no split parts these
    points[650:] = points[1] + rng.normal(scale=1e-3, size=(50, 8))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    own = list(vector_index.leaves(points, 16, np.random.default_rng(1)))
    assert sorted(np.concatenate(own).tolist()) == list(range(700))
    assert all(np.all(np.diff(x) > 0) for x in own)
    assert all(len(x) <= 32 or not np.ptp(points[x], axis=0).any() for x in own)
    assert [x.tolist() for x in vector_index.leaves(np.ones((100, 3)), 8, rng)] == [list(range(100))]
    sim = points @ points.T
    np.fill_diagonal(sim, -9)
    i, j, s = vector_index.cell_neighbours(points, 4, 0.9, 1, 700, [1])  # one leaf holds all
    want = [(a, int(b)) for a in range(700) for b in np.lexsort((np.arange(700), -sim[a]))[:4] if sim[a, b] >= 0.9]
    assert [(a, round(x, 9)) for a, x in zip(i.tolist(), s)] == [(a, round(sim[a, b], 9)) for a, b in want]
    i, j, s = vector_index.cell_neighbours(points, 4, 0.9, 12, 16, [1])
    assert np.bincount(i).max() <= 4 and np.allclose(s, sim[i, j]) and not (i == j).any()
    assert len(set(zip(i.tolist(), j.tolist()))) == len(i)
    assert sum(x.size == 0 for x in vector_index.cell_neighbours(np.zeros((5, 3)), 4, 0.9, 2, 16, [1])) == 3
