import math
import random

import pytest
from pyspark.sql import functions as F

from leakwright.operators import profile, resolve, sampling, split

CLASSES = ["akiec", "bcc", "bkl", "df", "mel", "nv", "vasc"]


@pytest.fixture(scope="module")
def meta(spark):
    rng = random.Random(42)
    rows = []
    for g in range(400):
        label = rng.choices(CLASSES, [0.03, 0.05, 0.11, 0.02, 0.11, 0.66, 0.02])[0]
        for _ in range(rng.choices([1, 2, 3, 4], [0.65, 0.2, 0.1, 0.05])[0]):
            rows.append((f"img_{len(rows):05d}", f"les_{g:04d}", label))
    return spark.createDataFrame(rows, "image_id string, lesion_id string, dx string").cache()


def test_naive_split_is_exact_and_does_not_depend_on_partitions(meta):
    one = {r.image_id: r.split for r in split.naive_split(meta, "image_id", "dx").collect()}
    two = {r.image_id: r.split for r in split.naive_split(meta.repartition(7), "image_id", "dx").collect()}
    n = meta.count()
    assert one == two and len(one) == n
    sizes = {p: sum(s == p for s in one.values()) for p in split.PARTITIONS}
    assert sizes["val"] + sizes["test"] == math.floor(n * 0.3 + 0.5) and abs(sizes["val"] - sizes["test"]) <= 1
    assert one != {r.image_id: r.split for r in split.naive_split(meta, "image_id", "dx", seed=1).collect()}


def test_naive_split_leaks_and_grouped_does_not(meta):
    naive, grouped = split.naive_split(meta, "image_id", "dx"), split.grouped_split(meta, "image_id", "lesion_id", "dx")
    assert split.contamination(naive, "lesion_id").first().contaminated_rows > 0
    found = split.contamination(grouped, "lesion_id").first()
    assert (found.contaminated_rows, found.share) == (0, 0.0) and found.test_rows > 0
    assert {r.split for r in grouped.select("split").distinct().collect()} == set(split.PARTITIONS)
    split.assert_no_leak(grouped, "lesion_id")
    with pytest.raises(AssertionError):
        split.assert_no_leak(naive, "lesion_id")
    thirds = split.grouped_split(meta, "image_id", "lesion_id", "dx", legacy_thirds=True)
    assert abs(1 / 3 - thirds.where("split <> 'train'").count() / meta.count()) < 0.05


def test_null_groups_are_their_own(spark):
    rows = spark.createDataFrame([(i, None, "a") for i in range(40)], "id long, g string, y string")
    assert split.contamination(split.grouped_split(rows, "id", "g", "y"), "g").first().contaminated_rows == 0
    assert split.grouped_split(rows, "id", "g", "y").select("split").distinct().count() == 3


def test_contamination_without_test_rows(spark):
    rows = spark.createDataFrame([("a", "train")], "g string, split string")
    assert tuple(split.contamination(rows, "g").first()) == (0, 0, 0.0)


def test_discovered_duplicates_hold_through_a_split(spark, meta):
    clusters = spark.createDataFrame([("img_00001", "c"), ("img_00300", "c"), ("gone", "c")], "node string, component string")
    merged = resolve.effective_groups(meta, clusters, "image_id", "lesion_id")
    pair = merged.where("image_id IN ('img_00001', 'img_00300')").select("effective_group").distinct().collect()
    assert len(pair) == 1
    assert merged.select("effective_group").distinct().count() == meta.select("lesion_id").distinct().count() - 1
    dealt = split.grouped_split(merged, "image_id", "effective_group", "dx")
    assert split.leaking_groups(dealt, "effective_group").isEmpty()


def test_contaminate_keeps_size_and_mix(spark):
    mix = {"nv": 60, "mel": 20, "bkl": 15, "bcc": 5}
    test = spark.createDataFrame([(f"t{c}{i}", c) for c, n in mix.items() for i in range(n)], "image_id string, dx string")
    pool = spark.createDataFrame([(f"d{c}{i}", c) for c, n in {"nv": 200, "mel": 60, "bkl": 50, "bcc": 20}.items() for i in range(n)], "image_id string, dx string")
    out = sampling.contaminate_sweep(test, pool, "image_id", "dx", [0.0, 0.1, 0.5, 1.0], draws=2).collect()
    for rate in (0.1, 0.5, 1.0):
        for draw in (0, 1):
            own = [r for r in out if r.rate == rate and r.draw == draw]
            assert {c: sum(r.dx == c for r in own) for c in mix} == mix
            assert len({r.image_id for r in own}) == 100
            assert sum(r.from_donors for r in own) == sum(round(n * rate) for n in mix.values())
    assert {r.draw for r in out if r.rate == 0} == {0} and not any(r.from_donors for r in out if r.rate == 0)
    a, b = ({r.image_id for r in out if r.rate == 0.5 and r.draw == k} for k in (0, 1))
    assert a != b
    tiny = sampling.contaminate(test, pool.where("image_id = 'dnv0'"), "image_id", "dx", 1.0).collect()
    assert len(tiny) == 100 and sum(r.from_donors for r in tiny) == 1


def test_profile_counts(spark, meta):
    sizes = [r["count"] for r in meta.groupBy("lesion_id").count().collect()]
    got = profile.group_redundancy(meta, "lesion_id", "image_id").first()
    assert (got.n_items, got.n_groups, got.groups_of_several, got.largest_group, got.redundant) == (sum(sizes), len(sizes), sum(s > 1 for s in sizes), max(sizes), sum(sizes) - len(sizes))
    want = sum(k * (1 - 0.15 ** (k - 1)) for k in sizes) / sum(sizes)
    assert profile.expected_contamination(meta, "lesion_id", "image_id", 0.15).first()[0] == round(want, 4)
    assert profile.group_redundancy(meta.limit(0), "lesion_id", "image_id").first().n_items == 0
    assert profile.expected_contamination(meta.limit(0), "lesion_id", "image_id", 0.15).first()[0] == 0
    shares = {r.dx: r.share for r in profile.class_distribution(meta.unionByName(meta.limit(1).withColumn("dx", F.lit(None).cast("string"))), "dx").collect()}
    assert set(shares) == set(CLASSES) and sum(shares.values()) < 1


def test_weighted_draws_follow_weights(spark):
    rows = spark.createDataFrame([(i, "a" if i < 90 else "b") for i in range(100)], "id long, y string")
    weights = spark.createDataFrame([("a", 1.0), ("b", 9.0)], "y string, weight double")
    drawn = sampling.weighted_draws(rows, "id", "y", weights, 2000).collect()
    assert len(drawn) == 2000 and abs(sum(r.y == "b" for r in drawn) / 2000 - 0.5) < 0.05


def test_partition_contract(spark):
    rows = spark.createDataFrame([(1, "train")], "id long, split string")
    assert split.select_partition(rows, ["id"], "train").count() == 1
    with pytest.raises(ValueError):
        split.select_partition(rows, ["dx"])
    with pytest.raises(ValueError):
        split.select_partition(rows, ["id"], "test")
    with pytest.raises(Exception, match="unknown label"):
        spark.createDataFrame([("zz",)], "y string").select(split.encode_label("y", ["a"])).collect()
