import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cohortspark.functions import accession, arrays, images, signals
from cohortspark.operators import omics


@pytest.fixture
def wave(spark):
    t = np.arange(200) / 200.0
    x = np.sin(2 * np.pi * 5 * t) + 0.3
    return spark.createDataFrame([("w", [float(v) for v in x])], "id string, v array<double>"), x


def test_signal_features_match_numpy(wave):
    df, x = wave
    row = signals.signal_summary(df, "id", "v", 200.0).first()
    dx, centred = np.diff(x), x - x.mean()
    want = {
        "n_samples": 200, "duration_s": 199 / 200, "mean": x.mean(), "std": x.std(), "min": x.min(), "max": x.max(),
        "range": np.ptp(x), "rms": np.sqrt((x**2).mean()), "mean_abs_derivative": np.abs(dx).mean(),
        "derivative_std": dx.std(), "zero_crossing_rate": (np.diff(np.signbit(centred)) != 0).mean(),
    }
    for name, value in want.items():
        assert row[name] == pytest.approx(value, abs=1e-12)


def test_signal_errors(spark, wave):
    df, _ = wave
    with pytest.raises(ValueError):
        signals.signal_summary(df, "id", "v", 0)
    short = spark.createDataFrame([("s", [1.0, 2.0])], "id string, v array<double>")
    with pytest.raises(PySparkException, match="samples"):
        signals.signal_summary(short, "id", "v", 1.0).collect()
    with pytest.raises(PySparkException, match="rate"):
        signals.signal_summary(df.withColumn("r", F.lit(-1.0)), "id", "v", "r").collect()


def test_duration_of_a_two_channel_waveform(spark):
    df = spark.range(2).select("id", F.sequence(F.lit(1), F.lit(1000)).alias("v"))
    assert {r["duration_s"] for r in signals.waveform_duration(df, "id", "v", 500).collect()} == {2.0}


def test_summary_ignores_nan_and_survives_empty(spark):
    nan = float("nan")
    df = spark.createDataFrame([("a", [1.0, nan, 2.0, 10.0, 3.0]), ("b", [nan]), ("c", [])], "id string, v array<double>")
    rows = {r["id"]: r for r in arrays.numeric_summary(df, "id", "v").collect()}
    x = np.array([1, 2, 10, 3.0])
    assert rows["a"]["x_mean"] == pytest.approx(x.mean()) and rows["a"]["x_std"] == pytest.approx(x.std())
    assert (rows["a"]["x_min"], rows["a"]["x_max"], rows["a"]["x_median"]) == (1.0, 10.0, 2.5)
    assert rows["b"]["x_mean"] is None and rows["c"]["x_median"] is None


def test_expression_variability_spreads_nan(spark):
    df = spark.createDataFrame([("a", [0.0, 2.0, 0.0, 4.0]), ("b", [0.0, float("nan")])], "id string, v array<double>")
    rows = {r["id"]: r for r in arrays.expression_variability(df, "id", "v").collect()}
    assert rows["a"]["expression_nonzero_fraction"] == 0.5 and rows["a"]["expression_mean"] == 1.5
    assert np.isnan(rows["b"]["expression_mean"]) and rows["b"]["expression_nonzero_fraction"] == 0.5


def test_images(spark):
    x = np.arange(24, dtype=float).reshape(2, 4, 3)
    df = spark.createDataFrame([(1, x.ravel().tolist())], "id int, v array<double>")
    rgb = df.select("id", images.image_column(F.col("v"), 2, 4, 3).alias("image"))
    row = images.image_statistics(rgb, "id", "image", channels=3).first()
    assert (row["height"], row["width"], row["channels"]) == (2.0, 4.0, 3.0)
    for c in range(3):
        assert row[f"channel_{c}_mean"] == pytest.approx(x[:, :, c].mean())
        assert row[f"channel_{c}_std"] == pytest.approx(x[:, :, c].std())
    scaled = df.select(images.image_normalize(F.col("v")).alias("w")).first()["w"]
    assert np.allclose(scaled, x.ravel() / 23)
    flat = df.select(images.image_normalize(F.array(F.lit(5.0), F.lit(5.0))).alias("w")).first()["w"]
    assert flat == [0.0, 0.0]
    with pytest.raises(PySparkException, match="pixel count"):
        df.select(images.image_column(F.col("v"), 3, 3).alias("i")).collect()


def test_row_transforms(spark):
    df = spark.createDataFrame([([1.0, -3.0, 5.0],), ([2.0, 2.0, 2.0],)], "v array<double>")
    logs = [r[0] for r in df.select(arrays.clamped_log1p(F.col("v"))).collect()]
    assert np.allclose(logs[0], [np.log(2), 0, np.log(6)])
    z = [r[0] for r in df.select(arrays.standardised(F.col("v"))).collect()]
    x = np.array([1, -3, 5.0])
    assert np.allclose(z[0], (x - x.mean()) / x.std()) and z[1] == [0.0, 0.0, 0.0]


def test_accessions(spark):
    df = spark.createDataFrame([("gse153480",), ("GSE99",)], "a string")
    rows = accession.accession_urls(df, "a").collect()
    assert [r["bucket"] for r in rows] == ["GSE153nnn", "GSE0nnn"]
    assert rows[0]["raw_tar"].endswith("/GSE153nnn/GSE153480/suppl/GSE153480_RAW.tar")
    bad = spark.createDataFrame([("GSM12",)], "a string")
    with pytest.raises(PySparkException, match="accession"):
        accession.accession_urls(bad, "a").collect()
    assert accession.accession_urls(bad, "a", strict=False).first()["raw_tar"] is None


def test_sparse_moments_and_variance_filter(spark):
    dense = np.array([[0, 1, 2.0], [0, 1, 0], [3, 1, 0], [0, 1, 5]])
    coo = [(i, j, float(v)) for i, row in enumerate(dense) for j, v in enumerate(row) if v]
    df = spark.createDataFrame(coo, "s int, feature int, value double")
    got = {r["feature"]: r for r in omics.feature_moments(df, n_samples=4).collect()}
    for j in range(3):
        assert got[j]["mean"] == pytest.approx(dense[:, j].mean())
        assert got[j]["variance"] == pytest.approx(dense[:, j].var(), abs=1e-12)
    kept = omics.variance_filter(df, 0.0, n_samples=4).select("feature").distinct().collect()
    assert {r["feature"] for r in kept} == {0, 2}


def test_expression_log1p_rejects_negatives(spark):
    df = spark.createDataFrame([("a", 1, 0.0), ("b", 3, float("nan"))], "sample_id string, x int, y double")
    assert omics.expression_log1p(df).first()["x"] == pytest.approx(np.log(2))
    with pytest.raises(ValueError, match="negative"):
        omics.expression_log1p(df.withColumn("x", F.lit(-1)))
    with pytest.raises(TypeError):
        omics.expression_log1p(df, exclude=())


def test_pseudobulk_and_qc(spark):
    counts = spark.createDataFrame(
        [("c1", "g1", 2), ("c1", "mt", 2), ("c2", "g1", 5), ("c2", "g1", 1), ("c3", "g2", 7), ("c3", "mt", 0)],
        "cell_id string, gene string, count int",
    )
    obs = spark.createDataFrame([("c1", "A"), ("c2", "A"), ("c3", None)], "cell_id string, group string")
    long = {(r["group"], r["gene"]): r["count"] for r in omics.pseudobulk(counts, obs).collect()}
    assert long == {("A", "g1"): 8, ("A", "mt"): 2}
    with pytest.raises(KeyError):
        omics.pseudobulk(counts, obs, group="donor")
    with pytest.raises(ValueError):
        omics.obs_table(obs.union(obs), "cell_id")
    assert omics.obs_table(obs, "cell_id").columns == ["sample_id", "group"]
    row = omics.qc_summary(
        counts.withColumn("s", F.lit("x")), sample="s", cell="cell_id", gene="gene", count="count",
        marker=F.col("gene") == "mt",
    ).first()
    assert (row["cells"], row["genes"], row["nnz"]) == (3, 3, 4)
    assert row["median_umi_per_cell"] == 6.0 and row["median_detected_genes"] == 1.0
    assert row["median_marker_fraction"] == 0.0 and row["p90_marker_fraction"] == pytest.approx(0.4)


def test_feature_scores_match_numpy(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(40, 3)), rng.integers(0, 3, size=40)
    x[:, 0] += y
    x[:, 2] = 4.0
    rows = [(i, j, float(x[i, j]), int(y[i])) for i in range(40) for j in range(3)]
    long = spark.createDataFrame(rows, "s int, feature int, value double, label int")
    got = {r["feature"]: r["score"] for r in omics.anova_scores(long).collect()}
    for j in range(2):
        groups = [x[y == c, j] for c in range(3)]
        between = sum(len(g) * (g.mean() - x[:, j].mean()) ** 2 for g in groups) / 2
        within = sum(((g - g.mean()) ** 2).sum() for g in groups) / 37
        assert got[j] == pytest.approx(between / within)
    assert got[2] is None
    r = np.corrcoef(x[:, 1], y)[0, 1]
    reg = {r_["feature"]: r_["score"] for r_ in omics.regression_scores(long, target="label").collect()}
    assert reg[1] == pytest.approx(r * r / (1 - r * r) * 38)
    assert [r_["feature"] for r_ in omics.top_features(omics.anova_scores(long), 2).collect()] == [0, 1]
    with pytest.raises(ValueError):
        omics.top_features(long, 0)


def test_entries_of_a_task_do_not_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(omics, "ENTRIES_A_TASK", 100)
    for n, tasks in ((350, 4), (3500, 35)):
        entries = spark.range(n).selectExpr("id % 90 as cell", "id as gene")
        cells = spark.range(90).selectExpr("id", "id % 3 as sample")
        dealt, other = omics.dealt_alike(entries, "cell", cells, "id")
        joined = dealt.join(other.hint("merge"), F.col("cell") == F.col("id"))
        summed = joined.groupBy("sample", "cell", "gene").count().groupBy("sample", "cell").count()
        assert summed.rdd.getNumPartitions() == tasks
        assert summed.count() == 90
    assert omics.dealt_alike(entries.limit(0), "cell", cells, "id")[0].rdd.getNumPartitions() == 1
