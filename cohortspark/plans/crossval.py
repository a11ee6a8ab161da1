"""Cross-validation, model selection and grid search on development rows."""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.operators.folds import fold_table
from cohortspark.operators.importance import SCORINGS
from cohortspark.operators.metrics import (
    cv_aggregate,
    evaluate,
    higher_is_better,
    melt_metrics,
)
from cohortspark.operators.models import FittedModel, ModelSpec, bounded, fit_prepared, numeric_only, prepare
from cohortspark.roles import Roles

PARALLEL_FITS = 4
FOLD_SCHEMA = (
    "model string, fold int, train_size bigint, validation_size bigint, metric string, value double"
)


@dataclass(frozen=True)
class CVResult:
    """Long fold metrics ``(model, fold, train_size, validation_size, metric, value)``."""

    name: str
    task: str
    folds: DataFrame

    def summary(self) -> DataFrame:
        return cv_aggregate(self.folds)

    def aggregate(self) -> dict[str, float | None]:
        return {r["metric"]: r["mean"] for r in self.summary().collect()}

    def variability(self) -> dict[str, float | None]:
        return {f"{r['metric']}_std": r["std"] for r in self.summary().collect()}


def assign_folds(df: DataFrame, roles: Roles, task: str, k: int, seed: int = 42) -> DataFrame:
    return fold_table(df, roles.id, target=roles.target, group=roles.group, task=task, k=k, seed=seed)


def _cached_folds(df: DataFrame, roles: Roles, task: str, k: int, seed: int) -> DataFrame:
    """Every pass of every fit returns something per task, so their number is bounded here."""
    return bounded(assign_folds(df, roles, task, k, seed)).persist(StorageLevel.MEMORY_AND_DISK)


def _score_folds(candidates: Mapping[str, ModelSpec], folded: DataFrame, features, target, k) -> DataFrame:
    """Fit every candidate on the k folds, folds side by side, then score all held-out rows of a candidate in one job.

    The candidates of a fold share its preprocessing and encoded rows, as far as they read the same encoding.
    """
    # This also fills the cache, which side by side the fits would each do.
    sizes = {r["fold"]: r["count"] for r in folded.groupBy("fold").count().collect()}
    side = min(PARALLEL_FITS, k)

    def fit(fold: int) -> dict[str, FittedModel]:
        train = folded.where(F.col("fold") != fold).drop("fold")
        out = {}
        for _, names in itertools.groupby(sorted(candidates, key=_encoding(candidates)), key=_encoding(candidates)):
            names = list(names)
            ready = prepare(candidates[names[0]], train, features, target, fits=side)
            try:
                out.update({name: fit_prepared(candidates[name], ready) for name in names})
            finally:
                ready.release()
        return out

    with ThreadPoolExecutor(max_workers=side) as pool:
        models = list(pool.map(fit, range(1, k + 1)))
    table = None
    for name, spec in candidates.items():
        part = _score_candidate(spec, name, [m[name] for m in models], folded, features, target, sizes)
        table = part if table is None else table.unionByName(part)
    return table


def _encoding(candidates: Mapping[str, ModelSpec]):
    """Sort key of candidate names: those that read the same encoded rows stand together."""
    return lambda name: numeric_only(candidates[name])


def _score_candidate(spec, name, models, folded, features, target, sizes) -> DataFrame:
    scored = None
    for fold, model in enumerate(models, start=1):
        held = folded.where(F.col("fold") == fold).select(target, "fold", *features)
        part = model.transform(held)
        scored = part if scored is None else scored.unionByName(part, allowMissingColumns=True)
    n = sum(sizes.values())
    model = models[0]
    scored = scored.drop(*features).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        wide = evaluate(
            scored,
            task=spec.task,
            y=target,
            positive=model.positive,
            binary=len(model.labels) == 2,
            by=["fold"],
            n_rows=n,
        )
        rows = [
            (name, r["fold"], n - sizes[r["fold"]], sizes[r["fold"]], r["metric"], r["value"])
            for r in melt_metrics(wide, ["fold"]).collect()
        ]
    finally:
        scored.unpersist()
    return folded.sparkSession.createDataFrame(rows, FOLD_SCHEMA)


def cross_validate(
    spec: ModelSpec,
    df: DataFrame,
    roles: Roles,
    *,
    n_splits: int = 5,
    seed: int = 42,
    name: str | None = None,
) -> CVResult:
    folded = _cached_folds(df, roles, spec.task, n_splits, seed)
    try:
        table = _score_folds({name or spec.name: spec}, folded, roles.features(df), roles.target, n_splits)
    finally:
        folded.unpersist()
    return CVResult(name or spec.name, spec.task, table)


def cross_validated_scores(
    spec: ModelSpec, df: DataFrame, roles: Roles, *, cv: int = 5, scoring: str = "auroc", seed: int = 42
) -> dict[str, Any]:
    """Mean, sample std and the list of one score over the folds."""
    metric = SCORINGS.get(scoring, scoring)
    sign = -1.0 if metric.startswith("-") else 1.0
    result = cross_validate(spec, df, roles, n_splits=cv, seed=seed)
    row = (
        result.folds.where(F.col("metric") == metric.lstrip("-"))
        .agg(
            F.avg(F.col("value") * sign).alias("mean"),
            F.stddev_samp(F.col("value") * sign).alias("std"),
            F.array_sort(F.collect_list(F.struct("fold", (F.col("value") * sign).alias("value")))).alias("s"),
        )
        .first()
    )
    if not row["s"]:
        raise KeyError(f"the score {scoring!r} is not available")
    return {"mean": row["mean"], "std": row["std"], "scores": [s["value"] for s in row["s"]]}


def rank_candidates(summary: DataFrame, metric: str, *, maximise: bool | None = None) -> DataFrame:
    """Candidates by their mean of one metric, best first, ties by name."""
    up = higher_is_better(metric) if maximise is None else maximise
    mean = F.col("mean")
    order = F.desc_nulls_last(mean) if up else F.asc_nulls_last(mean)
    return summary.where(F.col("metric") == metric).orderBy(order, "model")


def select_model(
    candidates: Mapping[str, ModelSpec],
    df: DataFrame,
    roles: Roles,
    *,
    primary_metric: str,
    n_splits: int = 5,
    maximise: bool | None = None,
    seed: int = 42,
) -> tuple[str, DataFrame, DataFrame]:
    """Best candidate name, the ranking and the full metric summary; all share one fold table."""
    folded = _candidate_folds(candidates, df, roles, n_splits, seed)
    try:
        return _select(candidates, folded, roles.features(df), roles, primary_metric, n_splits, maximise)
    finally:
        folded.unpersist()


def _candidate_folds(candidates, df, roles, n_splits, seed) -> DataFrame:
    if not candidates:
        raise ValueError("no candidates to select from")
    tasks = {spec.task for spec in candidates.values()}
    if len(tasks) != 1:
        raise ValueError("the candidates solve different tasks")
    return _cached_folds(df, roles, tasks.pop(), n_splits, seed)


def _select(candidates, folded, features, roles, metric, n_splits, maximise) -> tuple[str, DataFrame, DataFrame]:
    table = _score_folds(candidates, folded, features, roles.target, n_splits)
    summary = cv_aggregate(table)
    ranking = rank_candidates(summary, metric, maximise=maximise)
    rows = ranking.collect()
    absent = sorted(set(candidates) - {r["model"] for r in rows if r["mean"] is not None})
    if absent:
        raise KeyError(f"metric {metric!r} is not available for {absent}")
    return rows[0]["model"], ranking, summary


@dataclass(frozen=True)
class GridResult:
    best_params: dict[str, Any]
    best_score: float
    results: DataFrame
    model: FittedModel


def param_combinations(grid: Mapping[str, Sequence]) -> list[dict[str, Any]]:
    names = sorted(grid)
    return [dict(zip(names, values, strict=True)) for values in itertools.product(*[grid[n] for n in names])]


def grid_search(
    spec: ModelSpec,
    df: DataFrame,
    roles: Roles,
    grid: Mapping[str, Sequence],
    *,
    cv: int = 5,
    scoring: str | None = None,
    seed: int = 42,
) -> GridResult:
    """Cross-validate every combination on shared folds and refit the best on all rows."""
    default = "roc_auc" if spec.task == "classification" else "neg_root_mean_squared_error"
    metric = SCORINGS[scoring or default]
    combinations = param_combinations(grid)
    candidates = {str(i): spec.with_params(**p) for i, p in enumerate(combinations)}
    features = roles.features(df)
    folded = _candidate_folds(candidates, df, roles, cv, seed)
    try:
        best, ranking, _ = _select(
            candidates, folded, features, roles, metric.lstrip("-"), cv, not metric.startswith("-")
        )
        top = ranking.first()
        # The folds hold every row, and they are cached.
        fitted = candidates[best].fit(folded.drop("fold"), features, roles.target)
    finally:
        folded.unpersist()
    sign = -1.0 if metric.startswith("-") else 1.0
    return GridResult(combinations[int(best)], sign * top["mean"], ranking, fitted)
