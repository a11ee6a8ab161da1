"""Benchmark runs and model matrices driven by a definition."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.operators.audit import missing_required_columns, require_definition_fits, require_gates
from cohortspark.operators.fingerprint import fingerprint
from cohortspark.operators.metrics import higher_is_better, undefined_metrics
from cohortspark.operators.models import build_model
from cohortspark.operators.splits import group_split, holdout_split
from cohortspark.plans.train import TrainingResult, metric_dicts, train
from cohortspark.roles import (
    INTERNAL_SPLIT_POLICIES,
    TRAINING_TASKS,
    BenchmarkDefinition,
    Cohort,
    SplitConfig,
    TrainingConfig,
)
from cohortspark.sources.manifests import load_definition
from cohortspark.sources.runs import save_results
from cohortspark.sources.tables import load_table

RESULT_SCHEMA = (
    "dataset string, benchmark_id string, benchmark_version string, model string, split string, metric string, "
    "value double, n_train bigint, n_validation bigint, n_test bigint, fingerprint string"
)


def _require_runnable(definition: BenchmarkDefinition, holdout: tuple[str, Any] | None = None) -> None:
    if definition.task not in TRAINING_TASKS:
        raise ValueError(f"a {definition.task!r} benchmark has no trainer")
    if unknown := undefined_metrics(definition.metrics, definition.task):
        raise ValueError(f"a {definition.task} benchmark cannot report {unknown}")
    if holdout is None and definition.split_policy not in INTERNAL_SPLIT_POLICIES:
        raise ValueError(f"split policy {definition.split_policy!r} needs an explicit split")


@dataclass(frozen=True)
class BenchmarkRun:
    definition: BenchmarkDefinition
    result: TrainingResult
    source: str


def run_benchmark(
    df: DataFrame,
    definition: BenchmarkDefinition,
    *,
    id: str,
    model: str = "logistic_regression",
    seed: int = 42,
    exclude: Sequence[str] = (),
    source: str = "",
    holdout: tuple[str, Any] | None = None,
    **model_params: Any,
) -> BenchmarkRun:
    """Train one model under a definition's target, group and split policy; its declared metrics are reported.

    ``holdout=(column, level)`` makes the rows of one level the test set, which any split policy accepts. The gates hold then
    too: a group on both sides of the level is an error (``holdout_split`` can leave such rows out beforehand).
    """
    require_definition_fits(df, definition)
    _require_runnable(definition, holdout)
    config = TrainingConfig(
        definition.task,
        model,
        definition.target,
        definition.group_key,
        seed,
        SplitConfig(seed=seed),
        model_params,
        holdout,
        definition.metrics,
    )
    cohort = Cohort(df, definition.roles(id, (*exclude, *_held_column(holdout))))
    return BenchmarkRun(definition, train(cohort, config, check_gates=True), source)


def _held_column(holdout: tuple[str, Any] | None) -> tuple[str, ...]:
    """What names the held-out level is no feature."""
    return () if holdout is None else (holdout[0],)


def matrix_split(df: DataFrame, definition: BenchmarkDefinition, seed: int = 42) -> DataFrame:
    return group_split(df, definition.group_key, SplitConfig(seed=seed, stratify=False))


def matrix_sizes(rows: DataFrame) -> DataFrame:
    return rows.agg(
        *[F.count_if(F.col("split") == s).alias(f"n_{s}") for s in ("train", "validation", "test")]
    )


def _matrix_rows(df, rows, definition, id, features, models, dataset, seed, params) -> list[tuple]:
    require_gates(rows, id=id, group=definition.group_key)
    sizes = matrix_sizes(rows).first()
    digest = fingerprint(df, id)
    out = []
    for name in models:
        spec = build_model(definition.task, name, seed=seed, **(params or {}).get(name, {}))
        model = spec.fit(rows.where("split = 'train'"), features, definition.target)
        held = rows.where("split = 'validation'")
        n = sizes["n_validation"]
        metrics = metric_dicts(model, held, definition.target, "split", n, definition.metrics)["validation"]
        head = (dataset or definition.benchmark_id, definition.benchmark_id, definition.version, name)
        tail = (sizes["n_train"], sizes["n_validation"], sizes["n_test"], digest)
        for metric, value in metrics.items():
            out.append((*head, "validation", metric, value, *tail))
            out.append((*head, "test", metric, None, *tail))
    return out


def run_model_matrix(
    df: DataFrame,
    definition: BenchmarkDefinition,
    *,
    id: str,
    models: Sequence[str],
    dataset: str | None = None,
    seed: int = 42,
    exclude: Sequence[str] = (),
    holdout: tuple[str, Any] | None = None,
    params: Mapping[str, Mapping[str, Any]] | None = None,
) -> DataFrame:
    """Validation metrics of several models on one shared split; test values stay NULL.

    ``holdout=(column, level)`` replaces the internal group split by an explicit
    level holdout, which any split policy accepts. Every gate holds in both cases.
    """
    require_definition_fits(df, definition)
    _require_runnable(definition, holdout)
    if holdout is None:
        rows = matrix_split(df, definition, seed)
    else:
        rows = holdout_split(df, *holdout, definition.group_key, seed=seed)
    roles = definition.roles(id, (*exclude, *_held_column(holdout)))
    features = roles.features(df)
    # Every model and gate reads the split rows: they are computed once.
    used = dict.fromkeys((id, definition.group_key, definition.target, *features))
    rows = rows.select(*[F.col(f"`{c}`") for c in used if c is not None], "split").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        out = _matrix_rows(df, rows, definition, id, features, models, dataset, seed, params)
    finally:
        rows.unpersist()
    return df.sparkSession.createDataFrame(out, RESULT_SCHEMA)


def best_run(results: DataFrame, metric: str, *, split: str = "validation", maximise: bool | None = None) -> DataFrame:
    """The one best row of a metric; runs without it are skipped, none left is an error."""
    up = higher_is_better(metric) if maximise is None else maximise
    scored = results.where(
        (F.col("metric") == metric) & (F.col("split") == split) & F.col("value").isNotNull() & ~F.isnan("value")
    )
    top = scored.orderBy(F.desc("value") if up else F.asc("value"), "dataset", "model").limit(1)
    if top.isEmpty():
        raise ValueError(f"no run has a {split} value of {metric!r}")
    return top


def matrix_union(tables: Sequence[DataFrame]) -> DataFrame:
    if not tables:
        raise ValueError("no result tables")
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out


def run_matrix_job(
    spark: SparkSession,
    paths: Mapping[str, str],
    definition: BenchmarkDefinition | str,
    *,
    id: str,
    models: Sequence[str],
    required: Sequence[str] = (),
    exclude: Sequence[str] = (),
    output: str | None = None,
    **kwargs: Any,
) -> DataFrame:
    """The matrix of every dataset; a missing table or required column stops the job.

    ``definition`` may be the path of one; ``output`` is where the result table is written.
    """
    if isinstance(definition, str):
        definition = load_definition(spark, definition)
    tables = {name: load_table(spark, path) for name, path in paths.items()}
    for name, df in tables.items():
        absent = missing_required_columns(df, required)
        if absent:
            raise ValueError(f"{name}: required columns are missing: {absent}")
    results = matrix_union(
        [
            run_model_matrix(df, definition, id=id, models=models, dataset=name, exclude=exclude, **kwargs)
            for name, df in tables.items()
        ]
    )
    if output is not None:
        save_results(results, output)
    return results


__all__ = [
    "BenchmarkRun",
    "best_run",
    "matrix_sizes",
    "matrix_split",
    "matrix_union",
    "run_benchmark",
    "run_matrix_job",
    "run_model_matrix",
]
