import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leakwright.operators import calibrate, history, metrics, stats


def frame(spark, true, said):
    return spark.createDataFrame([(int(a), int(b)) for a, b in zip(true, said)], "y_true int, y_pred int")


def test_metrics_against_numpy(spark):
    rng = np.random.default_rng(3)
    true = rng.choice(7, 1700, p=[0.033, 0.051, 0.11, 0.011, 0.111, 0.669, 0.015])
    said = np.where(rng.random(1700) < 0.7, true, rng.choice(7, 1700))
    got = metrics.overall_metrics(frame(spark, true, said)).first()
    recall = [(said[true == c] == c).mean() for c in np.unique(true)]
    f1 = {c: 2 * ((true == c) & (said == c)).sum() / ((true == c).sum() + (said == c).sum()) for c in np.union1d(true, said)}
    assert math.isclose(got.accuracy, (true == said).mean(), abs_tol=1e-12)
    assert math.isclose(got.balanced_accuracy, np.mean(recall), abs_tol=1e-12)
    assert math.isclose(got.macro_f1, np.mean(list(f1.values())), abs_tol=1e-12)
    assert math.isclose(got.weighted_f1, sum(f1[c] * (true == c).mean() for c in np.unique(true)), abs_tol=1e-12)


def test_majority_and_absent_classes(spark):
    rows = frame(spark, [0, 0, 0, 1], [0, 0, 0, 0])
    assert metrics.overall_metrics(rows).first().balanced_accuracy == 0.5
    report = {r["class"]: r for r in metrics.per_class_report(rows, [0, 1, 2]).collect()}
    assert (report[2].precision, report[2].recall, report[2].f1, report[2].support) == (0, 0, 0, 0)
    assert metrics.overall_metrics(rows.limit(0)).first().n == 0
    assert metrics.class_recall(rows, 5).first().recall is None


def test_class_weights_have_mean_one(spark):
    counts = {"nv": 670, "mel": 111, "df": 11}
    rows = spark.createDataFrame([(c,) for c, n in counts.items() for _ in range(n)], "dx string")
    got = {r.label: r.weight for r in metrics.class_weights(rows, "dx", [*counts, "vasc"]).collect()}
    assert math.isclose(np.mean(list(got.values())), 1) and got["df"] > got["mel"] > got["nv"]


def test_bootstrap_brackets_the_point_and_repeats(spark):
    rows = frame(spark, [i % 3 for i in range(300)], [i % 3 if i % 4 else 0 for i in range(300)])
    point = metrics.overall_metrics(rows).first()
    one, two = ({r.metric: (r.low, r.high) for r in metrics.bootstrap_ci(rows, 200).collect()} for _ in range(2))
    assert one == two
    for m, (low, high) in one.items():
        assert low <= point[m] <= high and low < high
    assert metrics.bootstrap_ci(frame(spark, [1, 1], [1, 1]), 20).count() == 0


# Fixed values of a published report: right, predicted and true rows of each class, and the metrics over them.
GROUPED = {"akiec": (27, 85, 46), "bcc": (79, 128, 106), "bkl": (124, 300, 199), "df": (11, 37, 20), "mel": (100, 247, 202), "nv": (831, 883, 1121), "vasc": (10, 26, 12)}
GROUPED_F1 = {"akiec": 0.4122, "bcc": 0.6752, "bkl": 0.497, "df": 0.386, "mel": 0.4454, "nv": 0.8293, "vasc": 0.5263}
GROUPED_OVERALL = {"accuracy": 0.6928487690504103, "balanced_accuracy": 0.653577195049159, "macro_f1": 0.5387825316011826, "weighted_f1": 0.7169640785532098}
# Rows, mean confidence (in single precision) and share that is right of the bins that are not empty, and the error over them.
GROUPED_BINS = [
    (3, 0.2720816433429718, 0.3333333333333333), (52, 0.36448001861572266, 0.3269230769230769), (126, 0.4568142592906952, 0.4126984126984127), (193, 0.54873126745224, 0.38341968911917096),
    (150, 0.6507733464241028, 0.4533333333333333), (168, 0.7460710406303406, 0.5476190476190477), (172, 0.8508327603340149, 0.6511627906976745), (842, 0.9817512035369873, 0.9097387173396675),
]
GROUPED_ECE = {"ece": 0.11578788527081185, "mean_confidence": 0.8084213137626648, "accuracy": 0.6928487690504103, "n": 1706}


def test_golden_grouped_report(spark):
    """Any table of predictions with these counts has the published metrics; wrong rows are dealt to classes that have room."""
    pairs = [(c, c, hit) for c, (hit, _, _) in GROUPED.items()]
    room = {c: said - hit for c, (hit, said, _) in GROUPED.items()}
    for c, (hit, _, true) in sorted(GROUPED.items(), key=lambda x: -x[1][2]):
        left = true - hit
        for other in sorted(room, key=lambda o: -room[o]):
            n = min(left, room[other]) if other != c else 0
            pairs.append((c, other, n))
            room[other], left = room[other] - n, left - n
        assert left == 0
    rows = spark.createDataFrame([(c, o) for c, o, n in pairs for _ in range(n)], "y_true string, y_pred string")
    overall = metrics.overall_metrics(rows).first()
    assert all(math.isclose(overall[m], v, abs_tol=1e-12) for m, v in GROUPED_OVERALL.items()) and overall.n == 1706
    report = {r["class"]: r for r in metrics.per_class_report(rows, list(GROUPED)).collect()}
    assert {c: (r.f1, r.support) for c, r in report.items()} == {c: (GROUPED_F1[c], GROUPED[c][2]) for c in GROUPED}
    assert metrics.class_recall(rows, "mel").first().support == 202


def test_golden_grouped_calibration(spark):
    rows = spark.createDataFrame([(c, i < round(n * share)) for n, c, share in GROUPED_BINS for i in range(n)], "confidence double, correct boolean")
    got = calibrate.expected_calibration_error(rows).first()
    assert all(math.isclose(got[k], v, abs_tol=1e-6) for k, v in GROUPED_ECE.items()) and got.verdict == "overconfident"


def test_imbalance_strategies(spark):
    rows = spark.createDataFrame([("a",)] * 3 + [("b",)], "dx string")
    assert {r.label: round(r.weight, 6) for r in metrics.imbalance_weights(rows, "dx", ["a", "b", "c"], "none").collect()} == {"a": 1.0, "b": 1.0, "c": 1.0}
    weights = {r.label: r.weight for r in metrics.imbalance_weights(rows, "dx", ["a", "b", "c"], "class_weights").collect()}
    assert sorted(r.weight for r in metrics.imbalance_weights(rows, "dx", ["a", "b", "c"], "weighted_sampler").collect()) == sorted([weights["a"]] * 3 + [weights["b"]])
    with pytest.raises(ValueError):
        metrics.imbalance_weights(rows, "dx", ["a"], "other")


def test_bins_and_ece(spark):
    rows = spark.createDataFrame([(0.95, i < 60) for i in range(100)], "confidence double, correct boolean")
    got = calibrate.expected_calibration_error(rows).first()
    assert math.isclose(got.ece, 0.35) and got.verdict == "overconfident"
    edges = [0.0, 0.1, 0.2, 0.3, 0.30000000000000004, 0.6, 0.7, 0.7000000000000001, 1.0, 0.05]
    rows = spark.createDataFrame([(c, True) for c in edges], "confidence double, correct boolean")
    bins = sorted(calibrate.reliability_bins(rows).collect())
    lin = [k * 0.1 for k in range(11)]
    lin[10] = 1.0
    assert [b.n for b in bins] == [sum(lin[k] < c <= lin[k + 1] for c in edges) for k in range(10)]
    assert sum(b.n for b in bins) == len(edges) - 1 and bins[4].mean_confidence is None
    assert calibrate.expected_calibration_error(rows.limit(0)).first().ece is None


def test_softmax_and_argmax(spark):
    row = spark.createDataFrame([([1.0, 3.0, 3.0],)], "x array<double>").select(calibrate.softmax(F.col("x")).alias("p"), calibrate.argmax(F.col("x")).alias("k")).first()
    assert math.isclose(sum(row.p), 1) and row.k == 1


def test_slope(spark):
    line = spark.createDataFrame([(r / 10, 0.65 + 0.025 * r) for r in range(11)], "rate double, v double")
    got = stats.fit_slope(line, "rate", "v").first()
    assert math.isclose(got.slope_per_10pp, 0.025) and math.isclose(got.r2, 1)
    flat = stats.fit_slope(line.withColumn("v", F.lit(0.7)), "rate", "v").first()
    assert flat.slope_per_10pp == 0 and flat.r2 is None
    assert stats.fit_slope(line.limit(1), "rate", "v").first().slope_per_10pp is None


def gaps(spark, values):
    return spark.createDataFrame([(v,) for v in values], "gap double")


def test_paired_tests(spark):
    strong = stats.paired_test(gaps(spark, [0.10, 0.09, 0.11, 0.10, 0.095])).first()
    assert strong.p_t < 0.001 and 0.04 < strong.p_wilcoxon < 0.07
    weak = stats.paired_test(gaps(spark, [0.01, -0.012, 0.004, -0.008, 0.002])).first()
    assert weak.p_t > 0.05
    one = stats.paired_test(gaps(spark, [0.1])).first()
    assert one.n == 1 and one["std"] is None and one.p_t is None
    same = stats.paired_test(gaps(spark, [0.1, 0.1])).first()
    assert same.cohens_d is None


@pytest.mark.parametrize(("t", "df", "p"), [(2.776445, 4, 0.05), (12.7062, 1, 0.05), (0.0, 9, 1.0), (1.959964, 1e7, 0.05)])
def test_student_p(t, df, p):
    assert abs(stats.student_p(t, df) - p) < 1e-5


def test_wilcoxon_exact_against_enumeration():
    n, w = 6, 3
    below = sum(sum(r for r in range(1, n + 1) if m >> r - 1 & 1) <= w for m in range(1 << n))
    assert math.isclose(stats.wilcoxon_p(n, w, 0), min(1, 2 * below / 2**n))


def test_gaps_need_both_arms(spark):
    runs = spark.createDataFrame([("naive", s, v) for s, v in ((1, 0.75), (2, 0.76), (99, 0.9))] + [("grouped", s, v) for s, v in ((1, 0.65), (2, 0.67))], "split string, seed int, acc double")
    got = sorted((r.seed, round(r.gap, 6)) for r in stats.paired_gaps(runs, ["seed"], "split", "acc").collect())
    assert got == [(1, 0.1), (2, 0.09)]


def test_run_names_are_distinct(spark):
    grid = spark.createDataFrame([(s, b, k) for s in ("naive", "grouped") for b in ("efficientnet_b0", "resnet50") for k in (42, 43, 44)], "split string, backbone string, seed int")
    names = [r[0] for r in grid.select(stats.run_name()).collect()]
    assert len(set(names)) == 12 and "naive_best.pt" in names and "grouped__resnet50__s43_best.pt" in names


def test_early_stop(spark):
    rng = random.Random(5)
    values = [round(rng.random(), 2) for _ in range(30)]
    rows = spark.createDataFrame([("r", k + 1, v) for k, v in enumerate(values)], "run string, epoch int, v double")
    best, since, stop, at = -1.0, 0, len(values), 0
    for k, v in enumerate(values, 1):
        best, since, at = (v, 0, k) if v > best else (best, since + 1, at)
        if since >= 4:
            stop = k
            break
    got = history.best_epoch(rows, ["run"], "epoch", "v", 4).first()
    assert (got.best_epoch, got.best_value, got.stop_epoch) == (at, best, stop)
