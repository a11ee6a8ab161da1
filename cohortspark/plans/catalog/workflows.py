"""Model training, selection, calibration and benchmark runs on stand-in cohorts."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark.operators.calibration import calibrate
from cohortspark.operators.importance import model_importance
from cohortspark.operators.metrics import brier, ece, melt_metrics
from cohortspark.operators.models import build_model
from cohortspark.operators.splits import group_split
from cohortspark.plans.benchmark import matrix_union, run_benchmark, run_model_matrix
from cohortspark.plans.catalog.registry import query, r6, rounded, table
from cohortspark.plans.crossval import (
    cross_validate,
    cross_validated_scores,
    grid_search,
    select_model,
)
from cohortspark.plans.train import evaluate_held_out_test, train
from cohortspark.roles import BenchmarkDefinition, Cohort, Roles, TrainingConfig
from cohortspark.session import scratch_path
from cohortspark.sources.runs import load_run, save_run

EVENT_ROLES = Roles("event_id", "is_error", "user_id", "ts")
QUALITY_ROLES = Roles("doc_id", "quality", "source")


def event_cohort(spark, sf_dir):
    """Longitudinal events: group = user, target = the event is an error."""
    events = table(spark, sf_dir, "events")
    hour = F.hour("ts").cast("double")
    return events.select(
        "event_id",
        "user_id",
        "ts",
        (F.col("event_type") == "error").cast("int").alias("is_error"),
        F.when(F.col("event_id") % 10 == 0, None).otherwise(F.col("value")).alias("value"),
        F.get_json_object("props", "$.k").cast("double").alias("k"),
        hour.alias("hour"),
        (F.col("event_id") % 2 == 0).alias("even"),
    )


def event_values(spark, sf_dir):
    """The same events with a numeric target."""
    k = F.get_json_object("props", "$.k").cast("double")
    return table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        F.col("value").alias("y"),
        k.alias("k"),
        F.hour("ts").cast("double").alias("hour"),
        (F.col("value") * 0.5 + k).alias("mix"),
    )


def quality_cohort(spark, sf_dir):
    """Documents with a quality label: group = source, categorical language."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    words = F.size(F.split("text", r"\s+"))
    return documents.join(labels, "doc_id").select(
        "doc_id",
        "source",
        "quality",
        "lang",
        F.log1p("n_chars").alias("log_chars"),
        (F.col("n_chars") / words).alias("chars_per_word"),
        (F.regexp_count("text", F.lit("[0-9]")) / F.greatest("n_chars", F.lit(1))).alias("digit_share"),
    )


def metric_table(spark, metrics: dict):
    rows = [(s, m, v) for s, values in sorted(metrics.items()) for m, v in sorted(values.items())]
    out = spark.createDataFrame(rows, "split string, metric string, value double")
    return rounded(out, "split", "metric")


@query("logit_scores")
def logit_scores(spark, sf_dir):
    rows = quality_cohort(spark, sf_dir)
    model = build_model("classification", "logistic_regression").fit(
        rows.where("doc_id % 5 <> 0"), QUALITY_ROLES.features(rows), "quality"
    )
    return model.transform(rows).select("doc_id", "prediction", r6("score", "score"))


@query("train_metrics")
def train_metrics(spark, sf_dir):
    cohort = Cohort(event_cohort(spark, sf_dir), EVENT_ROLES)
    config = TrainingConfig(target="is_error", group="user_id")
    return metric_table(spark, train(cohort, config).metrics)


@query("train_metrics_multiclass")
def train_metrics_multiclass(spark, sf_dir):
    rows = event_cohort(spark, sf_dir).drop("is_error").join(
        table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id"
    )
    cohort = Cohort(rows, Roles("event_id", "event_type", "user_id", "ts"))
    return metric_table(spark, train(cohort, TrainingConfig(target="event_type", group="user_id")).metrics)


@query("held_out_test")
def held_out_test(spark, sf_dir):
    cohort = Cohort(event_values(spark, sf_dir), Roles("event_id", "y", "user_id"))
    result = train(cohort, TrainingConfig("regression", "ridge", "y", "user_id"))
    return metric_table(spark, {"test": evaluate_held_out_test(result, cohort)})


@query("saved_run_scores")
def saved_run_scores(spark, sf_dir):
    cohort = Cohort(quality_cohort(spark, sf_dir), QUALITY_ROLES)
    result = train(cohort, TrainingConfig(target="quality", group="source"))
    path = save_run(result, scratch_path(spark, "run"))
    model, splits, _ = load_run(spark, path)
    scored = model.transform(cohort.df).join(splits, "doc_id")
    return scored.select("doc_id", "split", "prediction", r6("score", "score"))


def _fitted_scores(task: str, name: str, **params):
    def run(spark, sf_dir):
        if task == "classification":
            rows, roles = quality_cohort(spark, sf_dir), QUALITY_ROLES
            if name == "mlp":
                rows = rows.drop("lang")
        else:
            rows, roles = event_values(spark, sf_dir), Roles("event_id", "y", "user_id")
        fit = group_split(rows, roles.group).where("split = 'train'")
        model = build_model(task, name, **params).fit(fit, roles.features(rows), roles.target)
        out = model.transform(rows)
        kept = [r6("score", "score")] if "score" in out.columns else []
        prediction = "prediction" if task == "classification" else r6("prediction", "prediction")
        return out.select(roles.id, prediction, *kept)

    return run


query("gbt_classifier")(_fitted_scores("classification", "hist_gradient_boosting"))
query("gbt_regressor")(_fitted_scores("regression", "hist_gradient_boosting"))
query("mlp_classifier")(_fitted_scores("classification", "mlp"))
query("mlp_regressor")(_fitted_scores("regression", "mlp"))
query("pca_logistic")(_fitted_scores("classification", "pca_then_logistic_regression"))
query("pca_mlp")(_fitted_scores("classification", "pca_then_mlp"))
query("ridge_scores")(_fitted_scores("regression", "ridge"))


@query("gbt_multiclass")
def gbt_multiclass(spark, sf_dir):
    """All rows, labels and positions; ten classes make ten boosters of the default 100 rounds each."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    model = build_model("classification", "hist_gradient_boosting").fit(rows, ["embedding"], "label")
    return model.transform(rows).select("vec_id", "label", "prediction")


@query("cv_metrics")
def cv_metrics(spark, sf_dir):
    spec = build_model("classification", "logistic_regression")
    result = cross_validate(spec, event_cohort(spark, sf_dir), EVENT_ROLES, n_splits=5)
    return rounded(result.summary(), "model", "metric", "folds")


@query("cv_folds_regression")
def cv_folds_regression(spark, sf_dir):
    result = cross_validate(
        build_model("regression", "ridge"), event_values(spark, sf_dir), Roles("event_id", "y", exclude=("user_id",))
    )
    return rounded(result.folds, "model", "fold", "train_size", "validation_size", "metric")


@query("cv_scores")
def cv_scores(spark, sf_dir):
    spec = build_model("classification", "logistic_regression")
    out = cross_validated_scores(spec, quality_cohort(spark, sf_dir), QUALITY_ROLES, cv=5, scoring="roc_auc")
    frame = spark.createDataFrame([(out["mean"], out["std"], len(out["scores"]))], "mean double, std double, folds int")
    return rounded(frame, "folds")


@query("select_model")
def select_model_query(spark, sf_dir):
    candidates = {
        "strong": build_model("regression", "ridge", alpha=1.0),
        "shrunk": build_model("regression", "ridge", alpha=5000.0),
    }
    roles = Roles("event_id", "y", "user_id")
    _, ranking, _ = select_model(candidates, event_values(spark, sf_dir), roles, primary_metric="rmse", n_splits=5)
    return rounded(ranking, "model", "metric", "folds")


@query("grid_search")
def grid_search_query(spark, sf_dir):
    spec = build_model("classification", "logistic_regression")
    result = grid_search(spec, quality_cohort(spark, sf_dir), QUALITY_ROLES, {"C": [0.01, 1.0]}, cv=5)
    return rounded(result.results, "model", "metric", "folds")


def _calibrated(method: str):
    def run(spark, sf_dir):
        rows = group_split(quality_cohort(spark, sf_dir), "source")
        spec = build_model("classification", "logistic_regression")
        features = QUALITY_ROLES.features(rows.drop("split"))
        fitted = calibrate(spec, rows.where("split = 'train'"), "doc_id", features, "quality", method=method, cv=5)
        return fitted.transform(rows).select("doc_id", "quality", "split", "prediction", "score")

    return run


query("calibrated_sigmoid")(lambda spark, d: rounded(_calibrated("sigmoid")(spark, d), "doc_id", "quality", "split", "prediction"))
query("calibrated_isotonic")(lambda spark, d: rounded(_calibrated("isotonic")(spark, d), "doc_id", "quality", "split", "prediction"))


@query("calibrated_quality")
def calibrated_quality(spark, sf_dir):
    scored = _calibrated("sigmoid")(spark, sf_dir)
    both = brier(scored, "quality", "score", by=["split"]).join(ece(scored, "quality", "score", by=["split"]), "split")
    return rounded(melt_metrics(both, ["split"]), "split", "metric")


@query("permutation_importance")
def permutation_importance_query(spark, sf_dir):
    rows = group_split(event_values(spark, sf_dir), "user_id")
    roles = Roles("event_id", "y", "user_id", exclude=("split",))
    model = build_model("regression", "ridge").fit(rows.where("split = 'train'"), roles.features(rows), "y")
    held = rows.where("split = 'validation'")
    return rounded(model_importance(model, held, "event_id", "y"), "feature")


ERROR_BENCHMARK = BenchmarkDefinition(
    "event-errors", "1.0", "classification", "is_error", "subject", "user_id", metrics=("balanced_accuracy", "auroc")
)


@query("benchmark_run")
def benchmark_run(spark, sf_dir):
    run = run_benchmark(event_cohort(spark, sf_dir), ERROR_BENCHMARK, id="event_id", exclude=("ts",))
    return metric_table(spark, run.result.metrics)


@query("model_matrix")
def model_matrix(spark, sf_dir):
    events = event_cohort(spark, sf_dir).withColumn("value", F.coalesce("value", F.lit(0.0)))
    out = run_model_matrix(
        events,
        ERROR_BENCHMARK,
        id="event_id",
        models=["logistic_regression", "hist_gradient_boosting", "mlp"],
        exclude=("ts",),
    )
    return rounded(out, *[c for c in out.columns if c != "value"])


@query("model_matrix_datasets")
def model_matrix_datasets(spark, sf_dir):
    events = event_cohort(spark, sf_dir)
    tables = {"mornings": events.where("hour < 12"), "evenings": events.where("hour >= 12")}
    return matrix_union(
        [
            rounded(
                run_model_matrix(
                    df, ERROR_BENCHMARK, id="event_id", models=["logistic_regression"], dataset=name, exclude=("ts",)
                ),
                "dataset",
                "benchmark_id",
                "benchmark_version",
                "model",
                "split",
                "metric",
                "n_train",
                "n_validation",
                "n_test",
                "fingerprint",
            )
            for name, df in tables.items()
        ]
    )
