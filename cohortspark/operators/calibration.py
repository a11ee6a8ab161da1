"""Cross-fitted probability calibration of binary classifiers."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.operators.folds import stratified_kfold
from cohortspark.operators.isotonic import Isotonic
from cohortspark.operators.models import FittedModel, ModelSpec

METHODS = ("sigmoid", "isotonic")


def platt_rows(scored: DataFrame, target: str, positive: Any) -> DataFrame:
    """Each row twice: once per class, weighted by its softened target."""
    is_pos = F.col(target) == F.lit(positive)
    counts = scored.agg(F.count_if(is_pos).alias("p"), F.count_if(~is_pos).alias("q")).first()
    high, low = (counts["p"] + 1.0) / (counts["p"] + 2.0), 1.0 / (counts["q"] + 2.0)
    soft = F.when(is_pos, F.lit(high)).otherwise(F.lit(low))
    pair = F.array(
        F.struct(F.lit(1.0).alias("label"), soft.alias("weight")),
        F.struct(F.lit(0.0).alias("label"), (1 - soft).alias("weight")),
    )
    return scored.select("margin", F.explode(pair).alias("s")).select("margin", "s.label", "s.weight")


@dataclass(frozen=True)
class Sigmoid:
    slope: float
    intercept: float

    @classmethod
    def fit(cls, scored: DataFrame, target: str, positive: Any) -> Sigmoid:
        rows = VectorAssembler(inputCols=["margin"], outputCol="x").transform(platt_rows(scored, target, positive))
        fitted = LogisticRegression(
            featuresCol="x", labelCol="label", weightCol="weight", regParam=0.0, tol=1e-9, maxIter=500
        ).fit(rows)
        return cls(float(fitted.coefficients[0]), float(fitted.intercept))

    def apply(self, df: DataFrame, output: str) -> DataFrame:
        z = F.col("margin") * F.lit(self.slope) + F.lit(self.intercept)
        return df.withColumn(output, 1 / (1 + F.exp(-z)))


@dataclass(frozen=True)
class CalibratedModel:
    """The mean of the calibrated probabilities of the fold models."""

    members: tuple[tuple[FittedModel, Sigmoid | Isotonic], ...]
    labels: tuple

    @property
    def positive(self):
        return self.labels[1]

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        parts: list[Column] = []
        for i, (base, calibrator) in enumerate(self.members):
            name = f"__p{i}"
            out = calibrator.apply(base.margins(out), name).drop("margin")
            parts.append(F.col(name))
        score = sum(parts[1:], parts[0]) / len(parts)
        return out.select(*df.columns, score.alias("score")).withColumn(
            "prediction", F.when(F.col("score") > 0.5, F.lit(self.labels[1])).otherwise(F.lit(self.labels[0]))
        )


def calibrate(
    spec: ModelSpec,
    train: DataFrame,
    id: str,
    features: Sequence[str],
    target: str,
    *,
    method: str = "sigmoid",
    cv: int = 5,
    seed: int = 42,
) -> CalibratedModel:
    """Per fold: fit on the others, calibrate on the fold; only training rows are used."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}, got {method!r}")
    if cv < 2:
        raise ValueError("cv must be at least 2")
    kind = Sigmoid if method == "sigmoid" else Isotonic
    folded = stratified_kfold(train, id, target, cv, seed=seed).persist()

    def one(fold: int):
        base = spec.fit(folded.where(F.col("fold") != fold).drop("fold"), features, target)
        if len(base.labels) != 2:
            raise ValueError("calibration needs exactly two classes")
        scored = base.margins(folded.where(F.col("fold") == fold).drop("fold"))
        return base, kind.fit(scored, target, base.positive)

    try:
        with ThreadPoolExecutor(max_workers=min(cv, 4)) as pool:
            members = tuple(pool.map(one, range(1, cv + 1)))
    finally:
        folded.unpersist()
    return CalibratedModel(members, members[0][0].labels)
