import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.operators.models import build_model
from cohortspark.operators.splits import holdout_split
from cohortspark.plans import benchmark, crossval
from cohortspark.plans.train import evaluate_held_out_test, train
from cohortspark.roles import BenchmarkDefinition, Cohort, Roles, TrainingConfig


@pytest.fixture(scope="module")
def cohort(spark):
    """Twelve patients with three visits each."""
    rng = np.random.default_rng(42)
    rows = []
    for p in range(12):
        for v in range(3):
            x = rng.normal(size=2)
            rows.append((p * 3 + v, f"p{p}", float(x[0]), float(x[1]), int((p + v) % 2), float(2 * x[0] + 0.1 * x[1])))
    return spark.createDataFrame(rows, "sample_id int, group_id string, x1 double, x2 double, target int, y double")


ROLES = Roles("sample_id", "target", "group_id", exclude=("y",))


def test_training_reports_train_and_validation_only(cohort):
    config = TrainingConfig()
    result = train(Cohort(cohort, ROLES), config, check_gates=True)
    assert set(result.metrics) == {"train", "validation"}
    assert set(result.metrics["train"]) == {"accuracy", "balanced_accuracy", "f1_macro", "auroc"}
    assert sum(result.split_sizes.values()) == 36
    assert result.features == ("x1", "x2")
    test = evaluate_held_out_test(result, Cohort(cohort.repartition(5), ROLES))
    assert set(test) == set(result.metrics["train"])
    changed = cohort.withColumn("x1", F.when(F.col("sample_id") == 3, 9.0).otherwise(F.col("x1")))
    with pytest.raises(ValueError, match="fingerprint"):
        evaluate_held_out_test(result, Cohort(changed, ROLES))


def test_regression_training(cohort):
    roles = Roles("sample_id", "y", "group_id", exclude=("target",))
    result = train(Cohort(cohort, roles), TrainingConfig("regression", "ridge", "y"))
    assert set(result.metrics["validation"]) == {"mae", "rmse", "r2"}
    assert result.metrics["train"]["r2"] > 0.9


def test_config_errors():
    for bad in ({"task": "ranking"}, {"model": ""}, {"target": ""}):
        with pytest.raises(ValueError):
            TrainingConfig(**bad)


def test_cross_validation_by_group(cohort):
    result = crossval.cross_validate(build_model("classification", "logistic_regression"), cohort, ROLES, n_splits=4)
    folds = result.folds.select("fold", "train_size", "validation_size").distinct().collect()
    assert len(folds) == 4 and all(f["train_size"] + f["validation_size"] == 36 for f in folds)
    assert {f["validation_size"] for f in folds} == {9}
    assert set(result.aggregate()) == {"accuracy", "balanced_accuracy", "f1_macro", "auroc"}
    assert set(result.variability()) == {f"{m}_std" for m in result.aggregate()}
    with pytest.raises(ValueError):
        crossval.cross_validate(build_model("classification", "logistic_regression"), cohort, ROLES, n_splits=1)


def test_scores_selection_and_grid(cohort):
    roles = Roles("sample_id", "y", "group_id", exclude=("target",))
    scores = crossval.cross_validated_scores(
        build_model("regression", "ridge"), cohort, roles, cv=3, scoring="neg_root_mean_squared_error"
    )
    assert len(scores["scores"]) == 3 and scores["mean"] < 0
    assert scores["std"] == pytest.approx(np.std(scores["scores"], ddof=1))
    candidates = {"good": build_model("regression", "ridge"), "flat": build_model("regression", "ridge", alpha=1e6)}
    best, ranking, summary = crossval.select_model(candidates, cohort, roles, primary_metric="rmse", n_splits=3)
    assert best == "good" and [r["model"] for r in ranking.collect()] == ["good", "flat"]
    assert summary.count() == 6
    worst, _, _ = crossval.select_model(
        candidates, cohort, roles, primary_metric="rmse", n_splits=3, maximise=True
    )
    assert worst == "flat"
    with pytest.raises(KeyError):
        crossval.select_model(candidates, cohort, roles, primary_metric="auroc", n_splits=3)
    with pytest.raises(ValueError):
        crossval.select_model({}, cohort, roles, primary_metric="rmse")
    grid = crossval.grid_search(build_model("regression", "ridge"), cohort, roles, {"alpha": [1e6, 0.1]}, cv=3)
    assert grid.best_params == {"alpha": 0.1} and grid.best_score < 0
    assert grid.model.transform(cohort).count() == 36


@pytest.fixture(scope="module")
def prepared(spark):
    rows = [(f"s{i}", f"b{i}", "MI" if i % 2 else "sham", float(i), float(i % 3)) for i in range(24)]
    return spark.createDataFrame(
        rows, "sample_id string, biological_group_id string, injury_label string, x1 double, x2 double"
    )


DEFINITION = BenchmarkDefinition("mi", "1.0", "classification", "injury_label", "animal", "biological_group_id")


def test_matrix_leaves_test_untouched(prepared):
    out = benchmark.run_model_matrix(
        prepared, DEFINITION, id="sample_id", models=["logistic_regression", "mlp"], params={"mlp": {"max_iter": 5}}
    ).collect()
    assert {r["model"] for r in out} == {"logistic_regression", "mlp"}
    assert all(r["value"] is None for r in out if r["split"] == "test")
    assert {r["metric"] for r in out} == {"accuracy", "balanced_accuracy", "f1_macro", "auroc"}
    assert {(r["n_train"], r["n_validation"], r["n_test"]) for r in out} == {(14, 5, 5)}
    assert len({r["fingerprint"] for r in out}) == 1 and out[0]["benchmark_version"] == "1.0"


def test_policies_and_tasks(prepared):
    import dataclasses

    study = dataclasses.replace(DEFINITION, split_policy="study")
    with pytest.raises(ValueError, match="explicit split"):
        benchmark.run_benchmark(prepared, study, id="sample_id")
    with pytest.raises(ValueError, match="explicit split"):
        benchmark.run_model_matrix(prepared, study, id="sample_id", models=["logistic_regression"])
    held = prepared.withColumn("study", F.when(F.col("x1") < 6, "B").otherwise("A"))
    out = benchmark.run_model_matrix(
        held, study, id="sample_id", models=["logistic_regression"], holdout=("study", "B"), exclude=("study",)
    )
    assert out.first()["n_test"] == 6
    vague = dataclasses.replace(DEFINITION, task="generalization")
    with pytest.raises(ValueError, match="no trainer"):
        benchmark.run_model_matrix(prepared, vague, id="sample_id", models=["mlp"])
    run = benchmark.run_benchmark(prepared, DEFINITION, id="sample_id")
    assert set(run.result.metrics) == {"train", "validation"}


def test_holdout_run_keeps_the_gates_and_reports_declared_metrics(prepared):
    import dataclasses

    study = dataclasses.replace(DEFINITION, split_policy="study_held_out", metrics=("auprc", "ece", "sensitivity", "brier_score"))
    held = prepared.withColumn("study", F.when(F.col("x1") < 6, "B").otherwise("A"))
    run = benchmark.run_benchmark(held, study, id="sample_id", holdout=("study", "B"))
    assert run.result.split_sizes["test"] == 6 and "study" not in run.result.features
    assert {"auprc", "ece", "sensitivity", "brier_score", "auroc"} <= set(run.result.metrics["validation"])
    assert {r["sample_id"] for r in run.result.splits.where("split = 'test'").collect()} == {f"s{i}" for i in range(6)}
    table = Cohort(held, run.result.roles)
    assert set(evaluate_held_out_test(run.result, table)) == set(run.result.metrics["train"])
    crossing = held.withColumn("biological_group_id", F.expr("concat('b', cast(x1 as int) % 12)"))
    for call in (benchmark.run_benchmark, lambda *a, **k: benchmark.run_model_matrix(*a, models=["mlp"], **k)):
        with pytest.raises(AssertionError, match="group_in_one_partition"):
            call(crossing, study, id="sample_id", holdout=("study", "B"))
    dropped = holdout_split(crossing, "study", "B", "biological_group_id", crossing="drop")
    sides = dropped.groupBy("biological_group_id").agg(F.countDistinct("split").alias("n")).agg(F.max("n")).first()[0]
    assert sides == 1 and dropped.where("split = 'test'").count() == 6
    with pytest.raises(ValueError, match="cannot report"):
        benchmark.run_benchmark(held, dataclasses.replace(study, metrics=("luck",)), id="sample_id", holdout=("study", "B"))


def test_matrix_job_loads_its_definition_and_writes_its_table(spark, prepared, scratch):
    prepared.write.parquet(f"{scratch}/one.parquet")
    fields = {k: getattr(DEFINITION, k) for k in ("benchmark_id", "version", "task", "target", "split_policy", "group_key")}
    Path(f"{scratch}/definition.json").write_text(json.dumps({**fields, "metrics": ["specificity"]}))
    out = benchmark.run_matrix_job(
        spark, {"one": f"{scratch}/one.parquet"}, f"{scratch}/definition.json", id="sample_id", models=["logistic_regression"], output=f"{scratch}/results"
    )
    again = spark.read.json(f"{scratch}/results")
    assert again.count() == out.count() and {r["metric"] for r in again.collect()} >= {"specificity", "auroc"}


def test_matrix_job_over_datasets(spark, prepared, scratch):
    paths = {}
    for name in ("one", "two"):
        paths[name] = f"{scratch}/{name}.parquet"
        prepared.write.parquet(paths[name])
    kwargs = {"id": "sample_id", "models": ["logistic_regression"]}
    out = benchmark.run_matrix_job(spark, paths, DEFINITION, required=["x1"], **kwargs)
    assert {r["dataset"] for r in out.select("dataset").distinct().collect()} == {"one", "two"}
    with pytest.raises(ValueError, match="required columns"):
        benchmark.run_matrix_job(spark, paths, DEFINITION, required=["study_id"], **kwargs)
    with pytest.raises(FileNotFoundError):
        benchmark.run_matrix_job(spark, {"gone": scratch + "/gone.parquet"}, DEFINITION, **kwargs)
    top = benchmark.best_run(out, "auroc").first()
    assert top["dataset"] == "one"
    with pytest.raises(ValueError):
        benchmark.best_run(out, "auroc", split="test")
    with pytest.raises(ValueError):
        benchmark.matrix_union([])


def test_candidates_of_a_fold_share_their_preparation(spark, monkeypatch):
    from cohortspark.operators import models
    from cohortspark.plans import crossval

    prepared, tasks = [], []
    plain, make = models.fit_preprocessor, models.CATALOGUE["regression"]["ridge"]

    def counted(train, *args, **kwargs):
        prepared.append(train.count())
        return plain(train, *args, **kwargs)

    def watched(fit):
        tasks.append(fit.rows.rdd.getNumPartitions())
        return make(fit)

    monkeypatch.setattr(models, "fit_preprocessor", counted)
    monkeypatch.setitem(models.CATALOGUE["regression"], "ridge", watched)
    rows = spark.range(0, 200, 1, 30).selectExpr("id", "cast(id % 10 as double) as x", "cast(id % 10 * 2 + id % 3 as double) as y")
    found = crossval.grid_search(
        models.build_model("regression", "ridge"), rows, Roles("id", "y"), {"alpha": [1000.0, 1.0, 10.0]}, cv=3
    )
    assert len(prepared) == 4  # once a fold and once for the best model of all rows
    assert sorted(prepared)[-1] == 200
    assert found.best_params == {"alpha": 1.0} and len(tasks) == 10
    cores = spark.sparkContext.defaultParallelism
    assert max(tasks[:9]) <= -(-cores // 3)


def test_cohort_of_a_run_is_computed_once(spark, monkeypatch):
    from cohortspark.plans import train as train_plan

    kind = type(spark.range(1))
    kept, plain = [], kind.persist

    def persist(df, *args):
        kept.append(set(df.columns))
        return plain(df, *args)

    monkeypatch.setattr(kind, "persist", persist)
    rows = spark.range(400).selectExpr(
        "id", "concat('g', id % 40) as grp", "cast(id % 7 as double) as x", "cast(id % 7 * 2 + id % 3 as double) as y", "id as unused"
    )
    cohort = Cohort(rows, Roles("id", "y", "grp", exclude=("unused",)))
    result = train_plan.train(cohort, TrainingConfig("regression", "ridge", "y", "grp"), check_gates=True)
    assert kept[0] == {"id", "grp", "y", "x", "split"}
    assert sum(result.split_sizes.values()) == 400 and result.splits.count() == 400
    definition = BenchmarkDefinition("b", "1", "regression", "y", "subject", "grp")
    kept.clear()
    benchmark.run_model_matrix(rows, definition, id="id", models=["ridge"], exclude=("unused",))
    assert kept[0] == {"id", "grp", "y", "x", "split"}
