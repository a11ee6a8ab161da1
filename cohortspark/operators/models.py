"""Baseline models per task: preprocessing plus a Spark ML estimator."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    OneVsRest,
)
from pyspark.ml.feature import PCA, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.operators import mlp
from cohortspark.operators.prep import FittedPrep, fit_preprocessor
from cohortspark.roles import TRAINING_TASKS

LABEL = "__label"
VECTOR = "__features"
WEIGHT = "__weight"

# The default settings of every baseline.
LOGISTIC = {"C": 1.0, "max_iter": 2000}
RIDGE = {"alpha": 1.0}
BOOSTING = {"max_iter": 100, "learning_rate": 0.1, "max_bins": 255, "min_samples_leaf": 20, "max_depth": 5}
NEURAL = {"hidden": (128, 64), "max_iter": 300, "learning_rate": None, "early_stopping": True, "tol": 1e-4}


@dataclass(frozen=True)
class FittedModel:
    """A pipeline whose ``transform`` adds ``prediction`` and, for two classes, ``score``."""

    name: str
    task: str
    features: tuple[str, ...]
    slots: tuple[str, ...]
    pipeline: PipelineModel
    labels: tuple = ()

    @property
    def positive(self):
        return self.labels[1] if len(self.labels) == 2 else None

    @property
    def core(self):
        return self.pipeline.stages[-1]

    def margins(self, df: DataFrame) -> DataFrame:
        """Adds ``margin``: the raw score of the positive class of two."""
        raw = self.pipeline.transform(df)
        return raw.select(
            *[F.col(f"`{c}`") for c in df.columns], vector_to_array("rawPrediction")[1].alias("margin")
        )

    def transform(self, df: DataFrame) -> DataFrame:
        raw = self.pipeline.transform(df)
        kept = [F.col(f"`{c}`") for c in df.columns if c not in ("prediction", "score")]
        if self.task == "regression":
            return raw.select(*kept, F.col("prediction"))
        at = (F.col("prediction") + 1).cast("int")
        label = F.element_at(F.array(*[F.lit(v) for v in self.labels]), at)
        out = [label.alias("prediction")]
        if len(self.labels) == 2 and "probability" in raw.columns:
            out.append(vector_to_array("probability")[1].alias("score"))
        return raw.select(*kept, *out)


@dataclass(frozen=True)
class ModelSpec:
    """An unfitted candidate: a name in the catalogue plus its parameters."""

    name: str
    task: str
    params: Mapping[str, Any] = field(default_factory=dict)
    seed: int = 42

    def with_params(self, **params) -> ModelSpec:
        return ModelSpec(self.name, self.task, {**self.params, **params}, self.seed)

    def fit(self, train: DataFrame, features: Sequence[str], target: str) -> FittedModel:
        return fit_model(self, train, features, target)


@dataclass(frozen=True)
class _Fit:
    """What a factory sees: encoded training rows and their size."""

    rows: DataFrame
    n: int
    width: int
    classes: int
    label_std: float
    seed: int
    params: dict
    repeats: bool = False


def _logistic(fit: _Fit):
    p = {**LOGISTIC, **fit.params}
    return LogisticRegression(
        featuresCol=VECTOR,
        labelCol=LABEL,
        regParam=1.0 / (p["C"] * fit.n),
        elasticNetParam=0.0,
        standardization=False,
        maxIter=p["max_iter"],
        tol=1e-8,
    ).fit(fit.rows)


def _ridge(fit: _Fit):
    # The solver works on labels divided by their standard deviation.
    alpha = {**RIDGE, **fit.params}["alpha"]
    return LinearRegression(
        featuresCol=VECTOR,
        labelCol=LABEL,
        regParam=alpha * fit.label_std / fit.n,
        elasticNetParam=0.0,
        standardization=False,
        solver="normal" if fit.width <= 4096 else "l-bfgs",
        tol=1e-10,
        maxIter=1000,
    ).fit(fit.rows)


def _boosting_params(fit: _Fit) -> dict:
    p = {**BOOSTING, **fit.params}
    return {
        "featuresCol": VECTOR,
        "labelCol": LABEL,
        "maxIter": p["max_iter"],
        "stepSize": p["learning_rate"],
        "maxBins": p["max_bins"],
        "maxDepth": p["max_depth"],
        "minInstancesPerNode": p["min_samples_leaf"],
        "seed": fit.seed,
    }


def _boosted(fit: _Fit, kind, params: dict):
    if not fit.repeats:
        return kind(**params).fit(fit.rows)
    # Equal inputs stand as one row with their number as weight. Squared loss sees only the mean of their values: the spread
    # around it lies in no split. A leaf's least number of rows becomes its least weight.
    if fit.classes:
        rows = fit.rows.groupBy(VECTOR, LABEL).agg(F.count(F.lit(1)).cast("double").alias(WEIGHT))
    else:
        rows = fit.rows.groupBy(VECTOR).agg(F.avg(LABEL).alias(LABEL), F.count(F.lit(1)).cast("double").alias(WEIGHT))
    least = max(0.0, (params["minInstancesPerNode"] - 0.5) / fit.n)
    params = {**params, "minInstancesPerNode": 1, "minWeightFractionPerNode": least, "weightCol": WEIGHT}
    rows = bounded(rows).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return kind(**params).fit(rows)
    finally:
        rows.unpersist()


def _boosted_classes(fit: _Fit):
    if fit.classes == 2:
        return _boosted(fit, GBTClassifier, _boosting_params(fit))
    booster = GBTClassifier(**_boosting_params(fit))
    return OneVsRest(classifier=booster, featuresCol=VECTOR, labelCol=LABEL, parallelism=min(fit.classes, SIDE_BY_SIDE)).fit(fit.rows)


def _boosted_values(fit: _Fit):
    return _boosted(fit, GBTRegressor, _boosting_params(fit))


def _neural(fit: _Fit, classes: int | None):
    p = {**NEURAL, **fit.params}
    return mlp.fit_mlp(fit.rows, VECTOR, LABEL, classes=classes, seed=fit.seed, **{**p, "hidden": tuple(p["hidden"])})


def _neural_classes(fit: _Fit):
    return _neural(fit, fit.classes)


def _neural_values(fit: _Fit):
    return _neural(fit, None)


CATALOGUE: dict[str, dict[str, Callable[[_Fit], Any]]] = {
    "classification": {
        "logistic_regression": _logistic,
        "hist_gradient_boosting": _boosted_classes,
        "mlp": _neural_classes,
        "pca_then_logistic_regression": _logistic,
        "pca_then_mlp": _neural_classes,
    },
    "regression": {
        "ridge": _ridge,
        "hist_gradient_boosting": _boosted_values,
        "mlp": _neural_values,
    },
}


#: The parameters that each model reads.
PARAMETERS: dict[tuple[str, str], tuple[str, ...]] = {
    ("classification", "logistic_regression"): tuple(LOGISTIC),
    ("classification", "hist_gradient_boosting"): tuple(BOOSTING),
    ("classification", "mlp"): tuple(NEURAL),
    ("classification", "pca_then_logistic_regression"): (*LOGISTIC, "n_components"),
    ("classification", "pca_then_mlp"): (*NEURAL, "n_components"),
    ("regression", "ridge"): tuple(RIDGE),
    ("regression", "hist_gradient_boosting"): tuple(BOOSTING),
    ("regression", "mlp"): tuple(NEURAL),
}


def available_models(task: str) -> tuple[str, ...]:
    if task not in CATALOGUE:
        raise ValueError(f"task must be one of {TRAINING_TASKS}, got {task!r}")
    return tuple(CATALOGUE[task])


def build_model(task: str, name: str, *, seed: int = 42, **params) -> ModelSpec:
    if name not in available_models(task):
        raise KeyError(f"no {task} model {name!r}; there are {available_models(task)}")
    read = PARAMETERS[task, name]
    if unread := sorted(set(params) - set(read)):
        raise ValueError(f"{name} ({task}) does not read {unread}; it reads {list(read)}")
    return ModelSpec(name, task, params, seed)


def class_labels(train: DataFrame, target: str) -> tuple:
    """Sorted classes; a missing target is an error."""
    found = [r["y"] for r in train.select(F.col(f"`{target}`").alias("y")).distinct().collect()]
    if any(v is None or v != v for v in found):
        raise ValueError("the target has missing values")
    if len(found) < 2:
        raise ValueError("a classifier needs at least two classes among the training rows")
    return tuple(sorted(found))


#: One-against-rest boosters that are trained side by side.
SIDE_BY_SIDE = 4


def bounded(rows: DataFrame, fits: int = 1) -> DataFrame:
    """As many tasks as there are cores for one of ``fits`` fits that run side by side.

    An iterative solver shuffles and returns something per task and step, so tasks that grow with the table would multiply it.
    """
    return rows.coalesce(max(1, -(-rows.sparkSession.sparkContext.defaultParallelism // fits)))


@dataclass(frozen=True)
class Prepared:
    """Encoded training rows, which stay cached until ``release``; they serve every model of the same encoding."""

    prep: FittedPrep
    rows: DataFrame
    task: str
    numeric_only: bool
    features: tuple[str, ...]
    labels: tuple
    inputs: float  # (approximate) bound of the different encoded rows
    fits: int

    def release(self) -> None:
        self.rows.unpersist()


#: Boosting counts equal rows first where there are at least so many rows to a possible input.
REPEATED = 20


def _repeats(ready: Prepared) -> bool:
    """Whether rows repeat: a bound of the different inputs, from the values of every feature, against the rows."""
    return ready.inputs * max(1, len(ready.labels)) * REPEATED <= ready.prep.totals["n_rows"]


def numeric_only(spec: ModelSpec) -> bool:
    return spec.name == "mlp"


def _side_by_side(spec: ModelSpec, labels: tuple) -> int:
    """Boosters of a model that are trained at the same time."""
    return min(len(labels), SIDE_BY_SIDE) if spec.name == "hist_gradient_boosting" and len(labels) > 2 else 1


def prepare(spec: ModelSpec, train: DataFrame, features: Sequence[str], target: str, *, fits: int = 1) -> Prepared:
    """Fit the preprocessing and encode ``train``; ``fits`` of them are used side by side."""
    extra = []
    if spec.task == "regression":
        y = F.col(f"`{target}`").cast("double")
        extra = [F.stddev_pop(y).alias("pop"), F.stddev_samp(y).alias("samp")]
    prep = fit_preprocessor(train, features, output=VECTOR, numeric_only=numeric_only(spec), extra=extra)
    labels: tuple = ()
    if spec.task == "classification":
        labels = class_labels(train, target)
        place = F.array_position(F.array(*[F.lit(v) for v in labels]), F.col(f"`{target}`"))
        encoded = train.withColumn(LABEL, (place - 1).cast("double"))
    else:
        encoded = train.withColumn(LABEL, F.col(f"`{target}`").cast("double"))
    rows = bounded(prep.model.transform(encoded).select(VECTOR, LABEL), fits * _side_by_side(spec, labels))
    # Iterative solvers read the rows many times; lost blocks are rebuilt from the source.
    rows.persist(StorageLevel.MEMORY_AND_DISK)
    return Prepared(prep, rows, spec.task, numeric_only(spec), tuple(features), labels, prep.inputs, fits)


def fit_model(spec: ModelSpec, train: DataFrame, features: Sequence[str], target: str) -> FittedModel:
    ready = prepare(spec, train, features, target)
    try:
        return fit_prepared(spec, ready)
    finally:
        ready.release()


def fit_prepared(spec: ModelSpec, ready: Prepared) -> FittedModel:
    if (ready.task, ready.numeric_only) != (spec.task, numeric_only(spec)):
        raise ValueError(f"the rows were not prepared for {spec.name} ({spec.task})")
    make = CATALOGUE[spec.task][spec.name]
    params = dict(spec.params)
    components = params.pop("n_components", 32)
    prep, labels, rows = ready.prep, ready.labels, ready.rows
    stages = list(prep.model.stages)
    width = len(prep.slots)
    data = rows
    if spec.name.startswith("pca_then_"):
        width = min(components, width)
        raw = "__raw"
        stages.append(SQLTransformer(statement=f"select *, {VECTOR} as {raw} from __THIS__"))
        stages.append(SQLTransformer(statement="select * except(" + VECTOR + ") from __THIS__"))
        pca = PCA(k=width, inputCol=raw, outputCol=VECTOR).fit(rows.withColumnRenamed(VECTOR, raw))
        stages.append(pca)
        data = pca.transform(rows.withColumnRenamed(VECTOR, raw)).select(VECTOR, LABEL)
    std = 0.0
    if spec.task == "regression":
        std = (prep.totals["pop"] if width <= 4096 else prep.totals["samp"]) or 0.0
    core = make(_Fit(data, prep.totals["n_rows"], width, len(labels), std, spec.seed, params, _repeats(ready)))
    return FittedModel(
        spec.name, spec.task, ready.features, prep.slots, PipelineModel([*stages, core]), labels
    )
