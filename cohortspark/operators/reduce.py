"""Dimension reduction fitted on training rows: supervised selection and PCA embeddings.

Samples carry their features in one ``ARRAY<DOUBLE>`` column.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.ml.feature import PCA, PCAModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.operators.omics import anova_scores, regression_scores, to_long, top_features
from cohortspark.operators.quantiles import exact_quantiles
from cohortspark.roles import TRAINING_TASKS


def pack(columns: Sequence[str]) -> Column:
    """Numeric columns as one feature array."""
    return F.array(*[F.col(f"`{c}`").cast("double") for c in columns])


def _clean(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


@dataclass(frozen=True)
class Slot:
    """One kept feature: a value (imputed by ``median``) or the missing flag of a position."""

    position: int
    flag: bool
    median: float
    mean: float
    std: float


def _slot_values(v: Column, slots: Sequence[Slot]) -> Column:
    # One constant instead of thousands of literals keeps the plan small for wide matrices.
    packed = json.dumps([asdict(s) for s in slots])
    table = F.from_json(
        F.lit(packed), "array<struct<position:int,flag:boolean,median:double,mean:double,std:double>>"
    )

    def one(s: Column) -> Column:
        raw = _clean(F.get(v, s["position"]))
        value = F.when(s["flag"], raw.isNull().cast("double")).otherwise(F.coalesce(raw, s["median"]))
        return (value - s["mean"]) / s["std"]

    return F.transform(table, one)


@dataclass(frozen=True)
class Reduction:
    slots: tuple[Slot, ...]
    pca: PCAModel
    signs: tuple[float, ...]
    input: str

    @property
    def n_components(self) -> int:
        return len(self.signs)

    def transform(self, df: DataFrame, output: str = "embedding_") -> DataFrame:
        scaled = array_to_vector(_slot_values(F.col(self.input).cast("array<double>"), self.slots))
        out = self.pca.transform(df.withColumn("__scaled", scaled))
        signs = F.array(*[F.lit(s) for s in self.signs])
        return out.withColumn(
            output, F.zip_with(vector_to_array("__components"), signs, lambda a, b: a * b)
        ).select(*df.columns, output)

    def metadata(self) -> dict:
        return {"type": "pca", "n_components": self.n_components}


def _fit_pca(df: DataFrame, values: str, slots: Sequence[Slot], k: int) -> Reduction:
    scaled = df.select(array_to_vector(_slot_values(F.col(values).cast("array<double>"), slots)).alias("__scaled"))
    pca = PCA(k=k, inputCol="__scaled", outputCol="__components").fit(scaled)
    loadings = pca.pc.toArray()
    biggest = loadings[np.abs(loadings).argmax(axis=0), np.arange(loadings.shape[1])]
    return Reduction(tuple(slots), pca, tuple(float(s) for s in np.where(biggest < 0, -1.0, 1.0)), values)


def fit_embedder(train: DataFrame, id: str, values: str, n_components: int = 32) -> Reduction:
    """Standardise every position and project on the leading principal components."""
    if n_components < 1:
        raise ValueError("n_components must be positive")
    long = to_long(train, id, values)
    stats = long.groupBy("feature").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s")).collect()
    slots = [Slot(r["feature"], False, 0.0, r["m"], r["s"] or 1.0) for r in sorted(stats, key=lambda r: r["feature"])]
    return _fit_pca(train, values, slots, n_components)


def fit_supervised(
    train: DataFrame,
    id: str,
    values: str,
    target: str,
    task: str,
    *,
    k: int = 1000,
    n_components: int = 32,
) -> Reduction:
    """Median impute with missing flags, keep the ``k`` best features by F score, standardise, PCA."""
    for name, size in (("k", k), ("n_components", n_components)):
        if size < 1:
            raise ValueError(f"{name}={size}: at least one column has to be kept")
    if task not in TRAINING_TASKS:
        raise ValueError(f"task must be one of {TRAINING_TASKS}, got {task!r}")
    long = to_long(train, id, values, keep=[target]).withColumn("value", _clean(F.col("value")))
    stats = (
        long.groupBy("feature")
        .agg(F.max(F.col("value").isNull()).alias("gap"), F.approx_count_distinct("value").alias("d"))
        .collect()
    )
    most = max((r["d"] for r in stats), default=0)
    medians = exact_quantiles(long, ["feature"], "value", {"median": 0.5}, most_distinct=most).collect()
    usable = {r["feature"]: r["median"] for r in medians}
    gaps = {r["feature"] for r in stats if r["gap"]}
    # Slot numbers: values first, then the flags of the positions that had a gap.
    value_slots = sorted(usable)
    flag_slots = sorted(gaps)
    base = [(p, False, usable[p]) for p in value_slots] + [(p, True, 0.0) for p in flag_slots]
    raw = [Slot(p, f, m, 0.0, 1.0) for p, f, m in base]
    slotted = train.select(
        id, target, F.posexplode(_slot_values(F.col(values).cast("array<double>"), raw)).alias("feature", "value")
    )
    if task == "classification":
        scores = anova_scores(slotted, label=target)
    else:
        scores = regression_scores(slotted, target=target)
    best = sorted(top_features(scores, k).collect(), key=lambda r: r["feature"])
    picked = [(raw[r["feature"]], r["mean"], r["std"]) for r in best]
    slots = [Slot(s.position, s.flag, s.median, mean, std or 1.0) for s, mean, std in picked]
    return _fit_pca(train, values, slots, n_components)
