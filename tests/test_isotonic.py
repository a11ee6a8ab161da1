import numpy as np
import pytest
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F

from cohortspark.operators.isotonic import Isotonic, isotonic_blocks


def pooled(scores, labels):
    """The fit on one machine: max over starts of the min over ends of the mean between them."""
    xs = sorted(set(scores))
    pos = np.array([sum(y for x, y in zip(scores, labels, strict=True) if x == v) for v in xs], dtype=float)
    n = np.array([scores.count(v) for v in xs], dtype=float)
    means = lambda j, k: pos[j : k + 1].sum() / n[j : k + 1].sum()
    size = range(len(xs))
    return {xs[i]: max(min(means(j, k) for k in size if k >= i) for j in size if j <= i) for i in size}


def table(spark, scores, labels):
    return spark.createDataFrame(list(zip(scores, labels, strict=True)), "margin double, y int")


@pytest.mark.parametrize("piece", [15, 100_000])
@pytest.mark.parametrize("shape", ["noise", "falling", "rising", "peak first"])
def test_equals_the_single_machine_fit(spark, piece, shape):
    rng = np.random.default_rng(5)
    scores = [float(v) for v in rng.integers(0, 40, 120)]
    labels = {
        "noise": [int(rng.random() < v / 40) for v in scores],
        "falling": [int(v < 20) for v in scores],
        "rising": [int(v >= 20) for v in scores],
        "peak first": [int(v == min(scores) or rng.random() < (v / 80) ** 2) for v in scores],
    }[shape]
    df = table(spark, scores, labels)
    want = pooled(scores, labels)
    fit = Isotonic.fit(df, "y", 1, pooled_together=piece)
    got = {r["margin"]: r["p"] for r in fit.apply(df.select("margin").distinct(), "p").collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-12 for x in want)


def test_blocks_do_not_depend_on_partitions(spark):
    df = spark.range(3000).select(
        (F.pmod(F.xxhash64("id"), F.lit(900)) / 10).alias("margin"), (F.pmod(F.hash("id"), F.lit(3)) == 0).alias("y")
    )
    found = [
        sorted(map(tuple, isotonic_blocks(df.repartition(n), "y", "margin", True, pooled_together=p).collect()))
        for n, p in ((3, 400), (17, 400), (5, 100_000))
    ]
    assert found[0] == found[1]
    value = lambda blocks: [b[2] for b in blocks]
    assert sorted(set(value(found[0]))) == sorted(set(value(found[2])))
    assert value(found[0]) == sorted(value(found[0]))


def test_between_and_beyond_knots_as_the_library(spark):
    rng = np.random.default_rng(6)
    scores = rng.normal(size=4000)
    labels = (rng.random(4000) < 1 / (1 + np.exp(-scores))).astype(int)
    df = table(spark, scores.tolist(), labels.tolist())
    asked = spark.createDataFrame([(float(v),) for v in np.linspace(-6, 6, 501)], "margin double")
    library = IsotonicRegression(featuresCol="margin", labelCol="label").fit(df.withColumn("label", F.col("y").cast("double")))
    want = [r["prediction"] for r in library.transform(asked).orderBy("margin").collect()]
    got = [r["p"] for r in Isotonic.fit(df, "y", 1, pooled_together=900).apply(asked, "p").orderBy("margin").collect()]
    assert np.allclose(got, want, atol=1e-12)


def test_many_knots_are_looked_up_by_chunk(spark):
    # Rates of 1 in 400, 2 in 400, ... make a block of every score.
    df = spark.range(400 * 300).select((F.col("id") % 300).cast("double").alias("margin"), F.expr("id div 300 <= id % 300").alias("y"))
    fit = Isotonic.fit(df, "y", True, pooled_together=10_000)
    assert len(fit.heads) > 2
    asked = spark.range(-1, 302).select((F.col("id") - 0.5).alias("margin"))
    for r in fit.apply(asked, "p").collect():
        low, high = (min(max(np.floor(r["margin"]) + d, 0), 299) for d in (0, 1))
        assert abs(r["p"] - (low + high + 2) / 2 / 400) < 1e-12


def test_missing_scores_and_labels(spark):
    rows = [(0.1, 0), (0.2, 1), (None, 1), (float("nan"), 1), (0.3, None)]
    df = spark.createDataFrame(rows, "margin double, y int")
    fit = Isotonic.fit(df, "y", 1)
    assert [r["p"] for r in fit.apply(df, "p").collect()] == [0.0, 1.0, None, None, 1.0]
    with pytest.raises(ValueError, match="no row"):
        Isotonic.fit(df.where("y is null"), "y", 1)
