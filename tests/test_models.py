import time

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cohortspark.operators import calibration, importance, mlp, models, prep, reduce
from cohortspark.operators.models import available_models, build_model


@pytest.fixture(scope="module")
def cohort(spark):
    rng = np.random.default_rng(7)
    n = 240
    x = rng.normal(size=(n, 2))
    cls = np.array(["u", "v", "w"])[rng.integers(0, 3, n)]
    logit = 1.5 * x[:, 0] - x[:, 1] + (cls == "v")
    y = (rng.random(n) < 1 / (1 + np.exp(-logit))).astype(int)
    z = 3 * x[:, 0] + np.abs(x[:, 1]) + rng.normal(size=n) * 0.1
    rows = [
        (i, f"g{i % 20}", float(x[i, 0]) if i % 9 else None, float(x[i, 1]), cls[i] if i % 8 else None, int(y[i]), float(z[i]))
        for i in range(n)
    ]
    df = spark.createDataFrame(rows, "id int, grp string, a double, b double, c string, y int, z double").cache()
    df.count()
    return df


def design(df):
    """The expected design matrix, built with numpy."""
    pdf = df.orderBy("id").toPandas()
    cols = []
    for c in ("a", "b"):
        v = pdf[c].fillna(pdf[c].median()).to_numpy()
        cols.append((v - v.mean()) / v.std())
    c = pdf["c"].fillna(pdf["c"].mode().min())
    cols += [(c == k).to_numpy(float) for k in ("u", "v", "w")]
    return np.stack(cols, axis=1), pdf


def test_preprocessing_matches_numpy(cohort):
    fitted = prep.fit_preprocessor(cohort, ["a", "b", "c"])
    assert fitted.slots == ("a", "b", "c=u", "c=v", "c=w")
    out = prep.apply_prep(fitted, cohort).orderBy("id").select(vector_to_array("features").alias("x")).collect()
    want, _ = design(cohort)
    assert np.allclose([r["x"] for r in out], want)


def test_unseen_and_missing_values_after_fitting(spark, cohort):
    fitted = prep.fit_preprocessor(cohort, ["a", "c"])
    new = spark.createDataFrame([(float("nan"), "zzz"), (None, None)], "a double, c string")
    rows = [r["x"] for r in prep.apply_prep(fitted, new).select(vector_to_array("features").alias("x")).collect()]
    assert rows[0][1:] == [0.0, 0.0, 0.0] and sum(rows[1][1:]) == 1.0
    assert rows[0][0] == rows[1][0]


def test_empty_and_awkward_columns(spark):
    df = spark.createDataFrame([(None, 2.0, "it's \\ here"), (None, 2.0, "b")], "gone double, flat double, `odd name` string")
    fitted = prep.fit_preprocessor(df, ["gone", "flat", "odd name"])
    assert fitted.slots == ("flat", "odd name=b", "odd name=it's \\ here")
    rows = prep.apply_prep(fitted, df).select(vector_to_array("features").alias("x")).collect()
    assert [r["x"] for r in rows] == [[0.0, 0.0, 1.0], [0.0, 1.0, 0.0]]
    with pytest.raises(ValueError, match="usable"):
        prep.fit_preprocessor(df, ["gone"])
    with pytest.raises(ValueError, match="numeric features only"):
        prep.fit_preprocessor(df, ["odd name"], numeric_only=True)
    with pytest.raises(ValueError, match="no imputation"):
        prep.fit_preprocessor(df, ["gone"], numeric_only=True)


def test_logistic_solves_the_penalised_problem(cohort):
    model = build_model("classification", "logistic_regression").fit(cohort, ["a", "b", "c"], "y")
    x, pdf = design(cohort)
    w, b = np.array(model.core.coefficients.toArray()), model.core.intercept
    gap = 1 / (1 + np.exp(-(x @ w + b))) - pdf["y"].to_numpy()
    # Gradient of the loss summed over rows plus half the squared weights.
    assert np.abs(x.T @ gap + w).max() < 1e-3 and abs(gap.sum()) < 1e-3
    scored = model.transform(cohort).orderBy("id").toPandas()
    assert np.allclose(scored["score"], 1 / (1 + np.exp(-(x @ w + b))))
    assert ((scored["score"] > 0.5).astype(int) == scored["prediction"]).all()


def test_multinomial_logistic_gradient(cohort):
    rows = cohort.withColumn("k", F.when(F.col("z") > 2, "hi").when(F.col("z") > -1, "mid").otherwise("lo"))
    model = build_model("classification", "logistic_regression").fit(rows, ["a", "b"], "k")
    assert model.labels == ("hi", "lo", "mid") and model.positive is None
    x = design(cohort)[0][:, :2]
    w, b = model.core.coefficientMatrix.toArray(), model.core.interceptVector.toArray()
    s = np.exp(x @ w.T + b)
    p = s / s.sum(axis=1, keepdims=True)
    labels = rows.orderBy("id").toPandas()["k"]
    hot = np.stack([(labels == k).to_numpy(float) for k in model.labels], axis=1)
    assert np.abs((p - hot).T @ x + w).max() < 1e-3
    assert set(model.transform(rows).select("prediction").distinct().toPandas()["prediction"]) <= set(model.labels)


def test_ridge_matches_the_normal_equations(cohort):
    model = build_model("regression", "ridge", alpha=3.0).fit(cohort, ["a", "b", "c"], "z")
    x, pdf = design(cohort)
    z = pdf["z"].to_numpy()
    xc, zc = x - x.mean(axis=0), z - z.mean()
    w = np.linalg.solve(xc.T @ xc + 3.0 * np.eye(x.shape[1]), xc.T @ zc)
    want = z.mean() + xc @ w
    got = model.transform(cohort).orderBy("id").toPandas()["prediction"].to_numpy()
    assert np.abs(got - want).max() < 1e-6


def test_catalogue_errors(cohort):
    assert available_models("regression") == ("ridge", "hist_gradient_boosting", "mlp")
    with pytest.raises(KeyError):
        build_model("regression", "forest")
    with pytest.raises(ValueError):
        available_models("ranking")
    with pytest.raises(ValueError, match="numeric features only"):
        build_model("classification", "mlp").fit(cohort, ["c"], "y")
    with pytest.raises(ValueError, match="missing"):
        build_model("classification", "logistic_regression").fit(
            cohort.withColumn("y", F.when(F.col("id") > 3, F.col("y"))), ["b"], "y"
        )
    with pytest.raises(ValueError, match="two classes"):
        build_model("classification", "logistic_regression").fit(cohort.where("y = 1"), ["b"], "y")


def test_boosting_learns(cohort):
    spec = build_model("regression", "hist_gradient_boosting", max_iter=15, min_samples_leaf=5, learning_rate=0.3)
    scored = spec.fit(cohort, ["a", "b"], "z").transform(cohort).toPandas()
    assert np.corrcoef(scored["prediction"], scored["z"])[0, 1] > 0.85
    spec = build_model("classification", "hist_gradient_boosting", max_iter=5, min_samples_leaf=5)
    scored = spec.fit(cohort, ["a", "b", "c"], "y").transform(cohort).toPandas()
    assert (scored["prediction"] == scored["y"]).mean() > 0.7 and scored["score"].between(0, 1).all()


def test_mlp_gradient_matches_finite_differences():
    rng = np.random.default_rng(0)
    sizes, x, y = [3, 4, 2, 1], rng.normal(size=(11, 3)), rng.normal(size=11)
    flat = mlp.initial(sizes, 1)

    def loss(w):
        layers = mlp.unpack(w, sizes)
        out = mlp.forward(x, layers)[-1][:, 0]
        return 0.5 * ((out - y) ** 2).sum()

    g = mlp.gradient_sum(x, y, flat, sizes)
    assert np.isclose(g[-1], loss(flat))
    g = g[:-1]
    for i in range(0, len(flat), 3):
        step = np.zeros_like(flat)
        step[i] = 1e-6
        assert g[i] == pytest.approx((loss(flat + step) - loss(flat - step)) / 2e-6, abs=1e-5)


def test_class_gradient_matches_finite_differences():
    rng = np.random.default_rng(2)
    sizes, x, y = [3, 5, 4], rng.normal(size=(9, 3)), rng.integers(0, 4, 9)
    flat = mlp.initial(sizes, 1)

    def loss(w):
        p = mlp.probabilities(mlp.forward(x, mlp.unpack(w, sizes))[-1])
        return -np.log(p[np.arange(9), y]).sum()

    g = mlp.gradient_sum(x, y.astype(float), flat, sizes)
    assert np.isclose(g[-1], loss(flat))
    for i in range(0, len(flat), 3):
        step = np.zeros_like(flat)
        step[i] = 1e-6
        assert g[i] == pytest.approx((loss(flat + step) - loss(flat - step)) / 2e-6, abs=1e-5)


def three_classes(spark, n=600):
    """Class by the angle of a point: no straight line tells them apart."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(n, 2))
    kind = ((np.arctan2(x[:, 1], x[:, 0]) + np.pi) / (2 * np.pi) * 6).astype(int) % 3
    return spark.createDataFrame([(i, float(a), float(b), "xyz"[k]) for i, ((a, b), k) in enumerate(zip(x, kind, strict=True))], "id int, a double, b double, y string")


@pytest.mark.parametrize("rate", [None, 0.03])
def test_mlp_classifier_learns_whatever_the_partitions(spark, rate, scratch):
    rows = three_classes(spark)
    spec = build_model("classification", "mlp", hidden=(16,), max_iter=80, learning_rate=rate)
    models = [spec.fit(rows.repartition(n), ["a", "b"], "y") for n in (3, 17)]
    weights = [m.core.getOrDefault(m.core.weights) for m in models]
    assert max(abs(a - b) for a, b in zip(*weights, strict=True)) < 1e-9
    scored = models[0].transform(rows).toPandas()
    assert (scored["prediction"] == scored["y"]).mean() > 0.85
    models[0].core.write().save(f"{scratch}/net")
    again = mlp.MLPClassificationModel.load(f"{scratch}/net")
    vec = prep.apply_prep(prep.fit_preprocessor(rows, ["a", "b"], output="__features", numeric_only=True), rows)
    got = again.transform(vec).select("id", "prediction", "probability").toPandas().set_index("id")
    assert all("xyz"[int(got.loc[r.id, "prediction"])] == r.prediction for r in scored.itertuples())
    assert np.allclose([p.toArray().sum() for p in got["probability"]], 1.0)


def test_two_classes_have_scores_and_margins(cohort):
    rows = cohort.where("a is not null")
    model = build_model("classification", "mlp", hidden=(4,), max_iter=20).fit(rows, ["a", "b"], "y")
    scored = model.margins(model.transform(rows)).toPandas()
    assert np.allclose(scored["score"], 1 / (1 + np.exp(-scored["margin"])))
    assert ((scored["score"] > 0.5) == (scored["prediction"] == 1)).all()


def test_rate_and_early_stopping_act(spark):
    rows = three_classes(spark, 200).withColumn("noise", F.pmod(F.xxhash64("id"), F.lit(3)).cast("string"))
    def fit(target, **params):
        core = build_model("classification", "mlp", hidden=(32,), **params).fit(rows, ["a", "b"], target).core
        return core.getOrDefault(core.rounds), np.array(core.getOrDefault(core.weights))

    slow, fast = (fit("y", max_iter=5, learning_rate=r)[1] for r in (0.001, 0.1))
    start = mlp.initial([2, 32, 3], 42)
    assert np.abs(fast - start).max() > 20 * np.abs(slow - start).max() > 0
    stopped, going = (fit("noise", max_iter=60, early_stopping=e) for e in (True, False))
    assert stopped[0] < going[0]
    for wrong in ({"learning_rate": 0.0}, {"max_iter": 0}):
        with pytest.raises(ValueError):
            fit("y", **wrong)


def test_mlp_regressor_learns_and_persists(cohort, scratch):
    rows = cohort.where("a is not null")
    spec = build_model("regression", "mlp", hidden=(16, 8), max_iter=60)
    model = spec.fit(rows, ["a", "b"], "z")
    scored = model.transform(rows).toPandas()
    assert np.corrcoef(scored["prediction"], scored["z"])[0, 1] > 0.9
    model.core.write().save(scratch + "/mlp")
    again = mlp.MLPRegressionModel.load(scratch + "/mlp")
    vec = prep.apply_prep(prep.fit_preprocessor(rows, ["a", "b"], output="__features", numeric_only=True), rows)
    a = again.transform(vec).orderBy("id").toPandas()["prediction"]
    assert np.allclose(a, scored.sort_values("id")["prediction"])
    with pytest.raises(ValueError):
        build_model("regression", "mlp", max_iter=0).fit(rows, ["a"], "z")


def test_embedding_matches_svd(cohort):
    rows = cohort.where("a is not null").select("id", F.array("a", "b", "z").alias("v"))
    fitted = reduce.fit_embedder(rows, "id", "v", 2)
    got = np.array([r["e"] for r in fitted.transform(rows, "e").orderBy("id").collect()])
    x = np.array([r["v"] for r in rows.orderBy("id").collect()])
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    _, _, vt = np.linalg.svd(x, full_matrices=False)
    top = vt[:2]
    signs = np.sign(top[np.arange(2), np.abs(top).argmax(axis=1)])
    assert np.allclose(got, x @ (top * signs[:, None]).T, atol=1e-6)
    assert fitted.metadata() == {"type": "pca", "n_components": 2}


def test_supervised_reduction_selects_imputes_and_flags(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 80)
    x = rng.normal(size=(80, 5))
    x[:, 3] += 4 * y
    x[y == 1, 1] = np.nan  # its missing flag tells the class exactly
    rows = [(i, [float(v) for v in x[i]], int(y[i])) for i in range(80)]
    df = spark.createDataFrame(rows, "id int, v array<double>, y int")
    fitted = reduce.fit_supervised(df, "id", "v", "y", "classification", k=2, n_components=1)
    assert {(s.position, s.flag) for s in fitted.slots} == {(1, True), (3, False)}
    e = np.array([r["e"][0] for r in fitted.transform(df, "e").orderBy("id").collect()])
    assert abs(np.corrcoef(e, y)[0, 1]) > 0.95
    with pytest.raises(ValueError):
        reduce.fit_supervised(df, "id", "v", "y", "classification", k=0)
    with pytest.raises(ValueError):
        reduce.fit_supervised(df, "id", "v", "y", "ranking")


@pytest.mark.parametrize("method", calibration.METHODS)
def test_calibrated_probabilities(cohort, method):
    spec = build_model("classification", "logistic_regression")
    fitted = calibration.calibrate(spec, cohort, "id", ["a", "b"], "y", method=method, cv=3)
    scored = fitted.transform(cohort).toPandas()
    assert scored["score"].between(0, 1).all() and len(scored) == 240
    assert abs(scored["score"].mean() - scored["y"].mean()) < 0.05
    assert (scored["prediction"] == scored["y"]).mean() > 0.6


def test_sigmoid_solves_the_platt_problem(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=120)
    y = (rng.random(120) < 1 / (1 + np.exp(-2 * m + 0.5))).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(m, y, strict=True)], "margin double, y int")
    fit = calibration.Sigmoid.fit(df, "y", 1)
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (120 - y.sum() + 2))
    gap = 1 / (1 + np.exp(-(fit.slope * m + fit.intercept))) - target
    assert abs(gap.sum()) < 1e-3 and abs((gap * m).sum()) < 1e-3


def test_calibration_errors(cohort):
    spec = build_model("classification", "logistic_regression")
    with pytest.raises(ValueError):
        calibration.calibrate(spec, cohort, "id", ["a"], "y", method="beta")
    with pytest.raises(ValueError):
        calibration.calibrate(spec, cohort, "id", ["a"], "y", cv=1)


@pytest.mark.parametrize("bucket", [100, 100_000])
def test_every_row_donates_once(cohort, monkeypatch, bucket):
    monkeypatch.setattr(importance, "BUCKET_ROWS", bucket)
    mixed = importance.with_donors(cohort.select("id", "b"), "id", ["b", "id"], 3)
    for r in range(3):
        part = mixed.where(F.col("repeat") == r).select("id", F.col("donor.id").alias("d")).toPandas()
        assert sorted(part["id"]) == sorted(part["d"]) == list(range(240))
        assert (part["id"] == part["d"]).mean() < 0.2


def test_importance_finds_the_used_feature(cohort):
    rows = cohort.where("a is not null")
    model = build_model("regression", "ridge").fit(rows, ["a", "b"], "z")
    out = importance.model_importance(model, rows, "id", "z", n_repeats=4).collect()
    assert [r["feature"] for r in out] == ["a", "b"] and out[0]["importance_mean"] > 1
    assert abs(out[1]["importance_mean"]) < 0.1
    with pytest.raises(ValueError):
        importance.model_importance(model, rows, "id", "z", n_repeats=0)
    with pytest.raises(ValueError):
        importance.model_importance(model, rows, "id", "z", scoring="luck")
    clf = build_model("classification", "logistic_regression").fit(rows, ["a", "b"], "y")
    ranked = importance.model_importance(clf, rows, "id", "y", scoring="roc_auc", n_repeats=2).collect()
    assert ranked[0]["feature"] == "a"


def test_ring_of_donors_does_not_depend_on_the_buckets(cohort, monkeypatch):
    found = []
    for bucket in (10, 100_000):
        monkeypatch.setattr(importance, "BUCKET_ROWS", bucket)
        rows = importance.with_donors(cohort.select("id", "b"), "id", ["id"], 2).collect()
        found.append(sorted((r["repeat"], r["id"], r["donor"]["id"]) for r in rows))
    assert found[0] == found[1]


def test_mlp_regression_does_not_depend_on_the_partitions(cohort):
    rows = cohort.where("a is not null")
    weights = []
    for n in (3, 17):
        model = build_model("regression", "mlp", hidden=(8,), max_iter=25).fit(rows.repartition(n), ["a", "b"], "z")
        weights.append(model.core.getOrDefault(model.core.weights))
    assert max(abs(a - b) for a, b in zip(*weights, strict=True)) < 1e-9


def test_parameters_that_a_model_does_not_read_are_errors():
    with pytest.raises(ValueError, match="learning_rate"):
        build_model("classification", "logistic_regression", learning_rate=0.1)
    with pytest.raises(ValueError, match="alpah"):
        build_model("regression", "ridge", alpah=1.0)


def arrays(spark, n, width, seed=5):
    """Rows with missing positions, NULL arrays, one position without any value and one that is constant."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width)) * rng.integers(1, 9, width) + rng.integers(-3, 3, width)
    x[:, 1] = 7.0
    y = x[:, 2] - 2 * x[:, 3] + rng.normal(size=n)
    rows = []
    for i in range(n):
        v = [None if k == 0 or (i + k) % 11 == 0 else float(x[i, k]) for k in range(width)]
        v = None if i % 29 == 0 else [float("nan") if k == 5 and i % 3 == 0 else t for k, t in enumerate(v)]
        rows.append((i, v, float(y[i]), "ab"[int(y[i] > 0)]))
    return spark.createDataFrame(rows, "id int, v array<double>, z double, y string")


def test_models_on_an_array_equal_those_on_its_positions(spark, scratch):
    rows = arrays(spark, 300, 64)
    flat = rows.select("id", "z", "y", *[F.get("v", F.lit(k)).alias(f"x{k}") for k in range(64)])
    names = [f"x{k}" for k in range(64)]
    for task, name, target in (("regression", "ridge", "z"), ("classification", "logistic_regression", "y")):
        whole = build_model(task, name).fit(rows.where("id % 3 <> 0"), ["v"], target)
        single = build_model(task, name).fit(flat.where("id % 3 <> 0"), names, target)
        column = "prediction" if task == "regression" else "score"
        got, want = (m.transform(d).orderBy("id").toPandas()[column] for m, d in ((whole, rows), (single, flat)))
        assert np.allclose(got, want, atol=1e-5)
        assert whole.slots[:2] == ("v[0]", "v[1]") and len(whole.slots) == 64
    whole.pipeline.write().save(f"{scratch}/pipeline")
    again = PipelineModel.load(f"{scratch}/pipeline").transform(rows).select("id", "probability").orderBy("id").toPandas()
    assert np.allclose([p[1] for p in again["probability"]], got)


def test_every_model_takes_arrays(spark):
    rows = arrays(spark, 200, 8).withColumn("v", F.transform("v", lambda x: F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0)))).where("v is not null")
    rows = rows.withColumn("color", F.when(F.col("id") % 2 == 0, "red").otherwise("blue"))
    for task, target in (("regression", "z"), ("classification", "y")):
        for name in models.CATALOGUE[task]:
            small = {"hist_gradient_boosting": {"max_iter": 3}, "mlp": {"max_iter": 3, "hidden": (4,)}, "pca_then_mlp": {"max_iter": 3, "hidden": (4,)}}
            features = ["v"] if name == "mlp" else ["v", "color"]
            out = build_model(task, name, **small.get(name, {})).fit(rows, features, target).transform(rows)
            assert out.where("prediction is null").count() == 0 and out.columns[:5] == rows.columns


def test_plans_do_not_grow_with_the_positions(spark):
    sizes = []
    for width in (50, 5000):
        rows = arrays(spark, 40, width)
        model = build_model("regression", "ridge").fit(rows, ["v"], "z") if width == 50 else None
        fitted = prep.fit_preprocessor(rows, ["v"])
        started = time.monotonic()
        out = prep.apply_prep(fitted, rows)
        plan = out._jdf.queryExecution().optimizedPlan()
        sizes.append((plan.numberedTreeString().count("\n"), time.monotonic() - started))
        assert len(fitted.slots) == width and (model is None or len(model.slots) == 50)
    assert sizes[0][0] == sizes[1][0] and sizes[1][1] < 3.0


def test_arrays_of_unequal_length_or_with_gaps_are_errors(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0], 1.0), (2, [1.0], 2.0)], "id int, v array<double>, z double")
    with pytest.raises(ValueError, match="1 to 2 positions"):
        build_model("regression", "ridge").fit(rows, ["v"], "z")
    with pytest.raises(ValueError, match="missing values"):
        build_model("regression", "mlp").fit(arrays(spark, 40, 6), ["v"], "z")


@pytest.mark.parametrize("classes, side", [(2, 1), (3, 3), (9, 4)])
def test_solver_tasks_do_not_grow_with_the_table(spark, monkeypatch, classes, side):
    cores = spark.sparkContext.defaultParallelism
    seen = []

    def stop(fit):
        seen.append(fit.rows.rdd.getNumPartitions())
        raise InterruptedError

    monkeypatch.setitem(models.CATALOGUE["classification"], "hist_gradient_boosting", stop)
    rows = spark.range(0, 600, 1, 40).selectExpr("id", "id % 7 as x", f"id % {classes} as y")
    with pytest.raises(InterruptedError):
        build_model("classification", "hist_gradient_boosting").fit(rows, ["x"], "y")
    assert seen == [-(-cores // side)]


@pytest.mark.parametrize("task, target", [("classification", "hit"), ("regression", "y")])
def test_boosting_counts_equal_rows(spark, monkeypatch, task, target):
    sizes, plain = [], models._boosted

    def watched(fit, kind, params):
        fitted = plain(fit, lambda **p: Watched(kind(**p)), params)
        return fitted

    class Watched:
        def __init__(self, inner):
            self.inner = inner

        def fit(self, rows):
            sizes.append(rows.count())
            return self.inner.fit(rows)

    monkeypatch.setattr(models, "_boosted", watched)
    # The level a = 4 has 15 rows, fewer than a leaf needs.
    rows = spark.range(3000).selectExpr(
        "id", "cast(if(id < 15, 4, id % 4) as double) as a", "if(id % 50 = 0, null, cast(id % 3 as double)) as b",
        "cast(id * 7 % 11 < id % 4 * 3 as int) as hit", "id % 4 * 2.0 + id * 13 % 17 as y",
    )
    scored = {}
    for repeated in (10, 10**9):
        monkeypatch.setattr(models, "REPEATED", repeated)
        out = build_model(task, "hist_gradient_boosting", max_iter=5).fit(rows, ["a", "b"], target).transform(rows)
        value = "score" if task == "classification" else "prediction"
        scored[repeated] = np.array([r[0] for r in out.orderBy("id").select(value).collect()])
    assert sizes[0] <= 30 and sizes[1] == 3000
    np.testing.assert_allclose(scored[10], scored[10**9], atol=1e-9)
