"""Stages keep columns of any name, and have a result for nulls, empty and long texts, ties, repeated rows and empty tables."""

import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from leakwright.llm import exact_dedup
from leakwright.llm.chosen_path import drop_near_duplicates
from leakwright.llm.decontaminate import drop_leaks, find_leaks
from leakwright.llm.exact_dedup import exact_duplicates
from leakwright.llm.line_dedup import drop_boilerplate, without_places
from leakwright.llm.mixing import mix, mix_report
from leakwright.llm.quality import keep_quality

#: Names that operators use inside, now or before.
INNER = (
    "row row_number __row__ judged __judged__ score __score__ lowered __lowered__ held_out predicted size __size__ __source__ __h__ __r__ copies __copies__ copy __copy__ up_to within extra repeats target "
    "k1 k2 __k1__ __k2__ gone __gone__ site place line a b n n_lines n_dropped pages rep component_id stays id y text_sha256 keep_id kept deal block item_id coverage weight edge byte quota unit Row SCORE_"
).split()
NAMES = ["doc_id", "text", "lang", "source", "n_chars", *(n for n in INNER if n.lower() != "row" or n == "row")]


def documents(spark, texts):
    """Rows with a value of its own in every column."""
    rng = random.Random(3)
    rows = []
    for i, t in enumerate(texts):
        rows.append((i if i % 11 else None, t, rng.choice(["en", None]), rng.choice(["s0", "s1", None]), len(t or ""), *(f"{n}-{i}" if i % 3 else None for n in NAMES[5:])))
    kinds = ["long", "string", "string", "string", "long", *["string"] * (len(NAMES) - 5)]
    return spark.createDataFrame(rows, ", ".join(f"`{n}` {k}" for n, k in zip(NAMES, kinds))), rows


def odd_texts():
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(500)]
    long = " ".join(rng.choices(words, k=20_000))
    own = [" ".join(rng.choices(words, k=60)) for _ in range(30)]
    return [None, "", "  \n ", *own, own[3], own[3], long, "one", "one"]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(1, 40)], "doc_id long, quality int, toxic int")


STAGES = {
    "quality": lambda docs, labels, bench: keep_quality(docs, labels, threshold=0.0),
    "near": lambda docs, labels, bench: drop_near_duplicates(docs),
    "leaks": lambda docs, labels, bench: drop_leaks(docs, bench),
    "leaks in blocks": lambda docs, labels, bench: drop_leaks(docs, bench, block_bytes=40),
    "mix": lambda docs, labels, bench: mix(docs),
}


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_columns_of_any_name(spark, labels, name):
    docs, rows = documents(spark, odd_texts())
    bench = spark.createDataFrame([(1, "nothing of this stands in any text at all"), (2, None), (3, ""), (4, "zz")], "item_id long, text string")
    got = STAGES[name](docs.repartition(3), labels, bench)
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    kept = Counter(tuple(r) for r in got.collect())
    assert set(kept) <= set(rows) and kept
    if name in ("quality", "leaks", "leaks in blocks"):
        assert kept == Counter(rows)
    if name == "near":
        assert len(kept) == len(rows) - 3  # two copies of one text, one of another
    empty = STAGES[name](docs.where("false"), labels, bench)
    assert empty.columns == docs.columns and empty.collect() == []


def test_mix_takes_the_same_rows_of_one_id_and_text(spark):
    rows = [(7, "same words here", "s0", f"row-{i}") for i in range(60)] + [(i, "many more words stand in this text " * 3, "s1", "x") for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars string")
    runs = [Counter(tuple(r) for r in mix(frame.repartition(n), weights=(1, 6)).collect()) for n in (1, 4, 7)]
    assert runs[0] == runs[1] == runs[2]
    taken = [n for r, n in runs[0].items() if r[0] == 7]
    assert 0 < sum(taken) < 60 * 3
    report = mix_report(frame, weights=(1, 6)).where("doc_id = 7").agg(F.sum("copies")).first()[0]
    assert report == sum(taken)


def test_line_dedup_keeps_columns_and_names_its_counts_apart(spark):
    docs, rows = documents(spark, [None, "", "only\nlines", *(f"menu\nline {i}\n menu \n\nend" for i in range(9))])
    got = drop_boilerplate(docs.withColumn("site", F.lit("one")), site="site", max_ratio=0.3)
    assert got.columns == [*docs.columns, "n_lines_", "n_dropped_"]
    found = [r.asDict() for r in got.collect()]
    assert Counter((r["n_lines"], r["gone"], r["__gone__"]) for r in found) == Counter((r[NAMES.index("n_lines")], r[NAMES.index("gone")], r[NAMES.index("__gone__")]) for r in rows)
    assert {r["text"] for r in found if r["n_dropped_"]} == {f"line {i}\n" for i in range(9)}


def test_places_are_left_out(spark):
    cases = [(["a", "b", "c", "d"], gone) for gone in ([0], [3], [1, 2], [0, 1, 2, 3], [0, 3])] + [([""], [0])]
    frame = spark.createDataFrame(cases, "x array<string>, gone array<int>")
    got = [r[0] for r in frame.select(without_places(F.col("x"), F.col("gone"))).collect()]
    assert got == [[y for i, y in enumerate(x) if i not in gone] for x, gone in cases]


def test_long_pages_take_time_in_proportion(spark):
    pages = spark.createDataFrame([(p, "\n".join(f"own {p} {i}" if i % 2 else f"shared {i}" for i in range(50_000))) for p in range(4)], "page_id long, text string").withColumn("site", F.lit("s"))
    began = time.time()
    got = drop_boilerplate(pages, site="site", max_ratio=0.5).select("n_lines", "n_dropped").collect()
    assert {tuple(r) for r in got} == {(50_000, 25_000)} and time.time() - began < 60


def test_reordered_passages_take_time_in_proportion(spark):
    rng = random.Random(1)
    parts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(6)) for _ in range(1200)]
    other = rng.sample(parts, len(parts))
    text = " ".join(f"{p} {' '.join(f'x{rng.randrange(5000)}' for _ in range(20))}" for p in other)
    docs, bench = spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(1, " ".join(parts))], "item_id long, text string")
    began = time.time()
    assert [tuple(r) for r in find_leaks(docs, bench).collect()] == [(1, 1, 1.0, 1200, 6)]
    assert time.time() - began < 20


def test_typographic_marks_do_not_hide_a_passage(spark):
    item = "the quick brown fox jumps over the lazy dog and runs far away"
    texts = ["he said “the quick—brown fox… jumps over” the lazy dog’ and runs far away»", "The Quick brown fox, jumps; over the (lazy) dog and «runs» far away", "thé quick brown fox", "le café «noir» est bon"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, "le café noir est bon")], "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"], r["coverage"]) for r in find_leaks(docs, bench).collect()) == [(0, 1, 1.0), (1, 1, 1.0), (3, 2, 1.0)]


def test_exact_dedup_beyond_the_broadcast_bound(spark, monkeypatch):
    rows = [(i, ["Same", "same", None, "", f"own {i}"][i % 5]) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    plain = Counter(map(tuple, exact_duplicates(frame, group_rows=5).collect()))
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", 0)
    assert Counter(map(tuple, exact_duplicates(frame, group_rows=5).collect())) == plain == Counter(map(tuple, exact_duplicates(frame).collect()))


def test_pipeline_leaves_one_stage_table(spark):
    from leakwright.sources.shared_tables import shared_folder

    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = lambda: {f.getPath().getName().rsplit("-", 1)[0] for f in fs.listStatus(path)} if fs.exists(path) else set()
    before = {f.getPath().getName() for f in fs.listStatus(path)} if fs.exists(path) else set()
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
    left = {f.getPath().getName().rsplit("-", 1)[0] for f in fs.listStatus(path) if f.getPath().getName() not in before}
    assert "mixing" in left and not left & {"quality-classifier", "near-duplicates", "decontamination", "rows", "near", "sizes"}, names()
