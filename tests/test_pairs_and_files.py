import random

import numpy as np
import pytest

from leakwright.operators import pairs, profile, resolve
from leakwright.operators.graph import connected_components
from leakwright.sources import files


def test_hamming_join_is_lossless(spark):
    rng = random.Random(1)
    base = [[rng.getrandbits(64) for _ in range(4)] for _ in range(12)]
    prints = []
    for words in base:
        for _ in range(4):
            copy = list(words)
            for bit in rng.sample(range(256), rng.randint(0, 16)):
                copy[bit // 64] ^= 1 << bit % 64
            prints.append(copy)
    prints.append(prints[0])
    rows = [(i, [w - (1 << 64) if w >> 63 else w for w in words]) for i, words in enumerate(prints)]
    got = {(r.id_a, r.id_b): r.hamming for r in pairs.hamming_pairs(spark.createDataFrame(rows, "id long, words array<long>"), "id", "words").collect()}
    want = {}
    for i in range(len(prints)):
        for j in range(i + 1, len(prints)):
            d = sum((a ^ b).bit_count() for a, b in zip(prints[i], prints[j]))
            if d <= 12:
                want[i, j] = d
    assert got == want and len(want) > 20
    assert pairs.hamming_pairs(spark.createDataFrame([], "id long, words array<long>"), "id", "words").count() == 0


def test_cosine_neighbours_against_numpy(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(0)
    v = rng.normal(size=(60, 8))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    got = {(r.src, r.dst) for r in pairs.cosine_neighbours(rows, "id", "v", 3).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    sim = u @ u.T
    np.fill_diagonal(sim, -9)
    assert got == {(i, int(j)) for i in range(60) for j in np.argsort(-sim[i])[:3]}


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame([*edges, (None, 3)], "src long, dst long")).collect()}
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in root}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_annotation_and_merge(spark):
    meta = spark.createDataFrame([("a", "g", "x"), ("b", "g", "y"), ("c", None, "x")], "id string, g string, y string")
    found = spark.createDataFrame([("a", "b", "m"), ("a", "c", "m"), ("c", "zz", "m"), ("zz", "yy", "m")], "id_a string, id_b string, method string")
    noted = {(r.id_a, r.id_b): (r.same_group, r.same_label) for r in resolve.annotate_pairs(found, meta, "id", "g", "y").collect()}
    assert noted == {("a", "b"): (True, False), ("a", "c"): (False, True), ("c", "zz"): (False, False), ("zz", "yy"): (False, False)}
    old = found.where("id_b = 'b'").unionByName(spark.createDataFrame([("p", "q", "old")], found.schema))
    kept = {(r.id_a, r.method) for r in resolve.merge_findings(old, found.limit(0), ["m"]).collect()}
    assert kept == {("p", "old")}
    again = resolve.merge_findings(old, found, None).collect()
    assert len(again) == 5


@pytest.mark.parametrize("sep", [",", "\t", ";", "|"])
def test_delimiters_are_found(spark, tmp_path, sep):
    path = tmp_path / "HAM10000_metadata.tab"
    path.write_text("\n".join([sep.join(files.REQUIRED), sep.join(["l1", "i1", "nv", "histo", "50", "male", "back"])]))
    assert files.find_metadata(spark, str(tmp_path)) == str(path)
    rows = files.read_delimited(spark, str(path))
    assert rows.first().dx == "nv"
    with pytest.raises(ValueError):
        files.read_delimited(spark, str(path), ("nope",))


def test_index_cache_and_integrity(spark, tmp_path):
    for folder, names in (("images", ["a.jpg", "b.jpg"]), ("more", ["b.jpg", "c.jpg", "d.txt"])):
        (tmp_path / folder).mkdir()
        for n in names:
            (tmp_path / folder / n).write_bytes(b"x")
    assert files.image_folders(spark, str(tmp_path)) == [f"{tmp_path}/images"]
    index = files.index_files(spark, [f"{tmp_path}/images", f"{tmp_path}/more"])
    assert {r.image_id: r.path.split("/")[-2] for r in index.collect()} == {"a": "images", "b": "more", "c": "more"}
    meta = spark.createDataFrame([("a",), ("x",)], "image_id string")
    found = {r["check"]: (r.n, r.ok, r.examples) for r in profile.integrity(meta, index, "image_id", ["image_id"], 2).collect()}
    assert found["not_on_disk"] == (1, False, ["x"]) and found["not_in_metadata"][0] == 2 and found["row_count"][1]
    assert not profile.integrity(meta, index, "image_id", ["dx"]).first().ok
    calls = []
    compute = lambda rows: calls.append(1) or rows.selectExpr("image_id", "1 AS v")
    for rows in (meta, meta, meta.limit(1)):
        assert files.cached(rows, str(tmp_path / "cache"), "image_id", compute).count() == rows.count()
    assert len(calls) == 2
