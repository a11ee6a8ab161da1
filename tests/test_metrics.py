import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.operators import metrics


def brute_auroc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))


def brute_ap(y, s):
    total, last = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        called = s >= t
        recall = y[called].sum() / y.sum()
        total += (recall - last) * y[called].mean()
        last = recall
    return total


@pytest.mark.parametrize("together", [7, 1_000_000])
def test_ranking_metrics_match_brute_force(spark, monkeypatch, together):
    monkeypatch.setattr(metrics, "RANKED_TOGETHER", together)
    rng = np.random.default_rng(5)
    n = 300
    y = rng.integers(0, 2, n)
    # A third of the rows share one score.
    s = np.where(np.arange(n) % 3 == 0, 0.5, np.round(rng.random(n) * 0.7 + 0.2 * y, 3))
    g = rng.integers(0, 2, n)
    df = spark.createDataFrame([(int(a), float(b), int(c)) for a, b, c in zip(y, s, g, strict=True)], "y int, s double, g int")
    row = metrics.ranking_metrics(df, "y", "s", 1).first()
    assert row["auroc"] == pytest.approx(brute_auroc(y, s))
    assert row["auprc"] == pytest.approx(brute_ap(y, s))
    for r in metrics.ranking_metrics(df, "y", "s", 1, ["g"]).collect():
        pick = g == r["g"]
        assert r["auroc"] == pytest.approx(brute_auroc(y[pick], s[pick]))
        assert r["auprc"] == pytest.approx(brute_ap(y[pick], s[pick]))


def test_auroc_is_undefined_without_two_classes(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.4)], "y int, s double")
    assert metrics.auroc(df, "y", "s").first()["auroc"] is None
    assert metrics.auroc(df, "y", "s", positive=1).first()["auroc"] is None
    three = df.union(spark.createDataFrame([(0, 0.1), (2, 0.9)], "y int, s double"))
    assert metrics.auroc(three, "y", "s").first()["auroc"] is None
    words = spark.createDataFrame([("MI", 0.1), ("sham", 0.9)], "y string, s double")
    assert metrics.auroc(words, "y", "s").first()["auroc"] == 1.0
    assert metrics.auroc(words, "y", "s", positive="MI").first()["auroc"] == 0.0


def test_classification_metrics(spark):
    pairs = [("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), ("c", "a"), ("c", "d")]
    row = metrics.classification_metrics(spark.createDataFrame(pairs, "y string, h string"), "y", "h").first()
    assert row["accuracy"] == pytest.approx(3 / 6)
    assert row["balanced_accuracy"] == pytest.approx((0.5 + 1 + 0) / 3)
    assert row["f1_macro"] == pytest.approx((2 * 1 / 4 + 2 * 2 / 5 + 0 + 0) / 4)


def test_sensitivity_and_specificity(spark):
    df = spark.createDataFrame([("MI", "MI"), ("MI", "sham"), ("sham", "sham")], "y string, h string")
    row = metrics.sensitivity_specificity(df, "y", "h", "MI").first()
    assert (row["sensitivity"], row["specificity"]) == (0.5, 1.0)


def test_regression_metrics(spark):
    rng = np.random.default_rng(2)
    y, p = rng.normal(size=50), rng.normal(size=50)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p, strict=True)], "y double, p double")
    row = metrics.regression_metrics(df, "y", "p").first()
    assert row["mae"] == pytest.approx(np.abs(y - p).mean())
    assert row["rmse"] == pytest.approx(np.sqrt(((y - p) ** 2).mean()))
    assert row["r2"] == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    flat = df.select(F.lit(2.0).alias("y"), "p")
    assert metrics.regression_metrics(flat, "y", "p").first()["r2"] == 0.0
    assert metrics.regression_metrics(flat, "y", "y").first()["r2"] == 1.0


def test_calibration_error(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2), (1, 0.8), (1, 0.9)], "y int, p double")
    assert metrics.ece(df, "y", "p", bins=2).first()["ece"] == pytest.approx(0.15)
    assert metrics.brier(df, "y", "p").first()["brier"] == pytest.approx(0.025)
    with pytest.raises(ValueError):
        metrics.ece(df, "y", "p", bins=1)
    # 0.3 lies below the third edge 0.30000000000000004, 1.0 in the last bin, 1.2 in none.
    edge = spark.createDataFrame([(1, 0.3), (1, 1.0), (1, 1.2)], "y int, p double")
    assert {r["bin"] for r in metrics.calibration_bins(edge, "y", "p").collect()} == {3, 10, 0}
    assert metrics.ece(edge, "y", "p").first()["ece"] == pytest.approx(0.7 / 3)


def test_fold_summary(spark):
    nan = float("nan")
    rows = [("m", "a", 1.0), ("m", "a", 3.0), ("m", "b", nan), ("m", "b", 2.0), ("n", "a", 5.0)]
    out = metrics.cv_aggregate(spark.createDataFrame(rows, "model string, metric string, value double"))
    got = {(r["model"], r["metric"]): (r["mean"], r["std"]) for r in out.collect()}
    assert got["m", "a"] == (2.0, pytest.approx(2**0.5))
    assert got["m", "b"] == (2.0, None)
    assert got["n", "a"] == (5.0, 0.0)
    assert not metrics.higher_is_better("rmse") and metrics.higher_is_better("auroc")


def test_missing_labels_and_scores_leave_metrics_undefined(spark):
    whole = [(i, i % 2, 0.1 + 0.2 * (i % 4), "full") for i in range(12)]
    gaps = [(1, 1, None, "score"), (2, 0, 0.5, "score"), (3, None, 0.9, "label"), (4, 1, 0.9, "label"), (5, 0, 0.1, "label"), (6, 1, float("nan"), "nan"), (7, 0, 0.2, "nan")]
    df = spark.createDataFrame(whole + gaps, "id int, y int, p double, part string")
    for table, name in (
        (metrics.ranking_metrics(df, "y", "p", 1, ["part"]), "auroc"),
        (metrics.ranking_metrics(df, "y", "p", 1, ["part"], edges=[0.25, 0.5]), "auprc"),
        (metrics.brier(df, "y", "p", 1, ["part"]), "brier"),
        (metrics.ece(df, "y", "p", by=["part"]), "ece"),
    ):
        found = {r["part"]: r[name] for r in table.collect()}
        assert found.pop("full") is not None and set(found.values()) == {None}, name
    bins = metrics.calibration_bins(df, "y", "p", by=["part"]).where("bin = -1").collect()
    assert sorted((r["part"], r["n"]) for r in bins) == [("label", 1), ("nan", 1), ("score", 1)]
