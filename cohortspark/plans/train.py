"""Training with an explicit held-out boundary."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from time import monotonic

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.operators.audit import require_gates
from cohortspark.operators.fingerprint import fingerprint
from cohortspark.operators.metrics import declared_metrics, evaluate, undefined_metrics
from cohortspark.operators.models import FittedModel, build_model
from cohortspark.operators.splits import holdout_split, split_table
from cohortspark.roles import Cohort, Roles, TrainingConfig


@dataclass(frozen=True)
class TrainingResult:
    model: FittedModel
    splits: DataFrame  # (id, split)
    metrics: dict[str, dict[str, float | None]]
    split_sizes: dict[str, int]
    roles: Roles
    features: tuple[str, ...]
    elapsed_seconds: float
    fingerprint: str
    config: TrainingConfig = field(default_factory=TrainingConfig)


def split_cohort(cohort: Cohort, config: TrainingConfig) -> DataFrame:
    roles = cohort.roles
    if config.holdout is not None:
        share = config.split.test_size  # of the development groups
        return holdout_split(
            cohort.df, *config.holdout, roles.group, validation_fraction=share, seed=config.split.seed
        )
    return split_table(
        cohort.df, roles.id, target=roles.target, group=roles.group, config=config.split, task=config.task
    )


def metric_dicts(
    model: FittedModel,
    rows: DataFrame,
    target: str,
    by: str,
    n_rows: int | None = None,
    declared: Sequence[str] = (),
) -> dict[str, dict[str, float | None]]:
    """Score ``rows`` once and return the metrics, with the declared ones, per value of ``by``."""
    if unknown := undefined_metrics(declared, model.task):
        raise ValueError(f"a {model.task} run cannot report {unknown}")
    scored = model.transform(rows.select(by, target, *model.features)).drop(*model.features)
    scored.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        table = evaluate(
            scored,
            task=model.task,
            y=target,
            positive=model.positive,
            binary=len(model.labels) == 2,
            by=[by],
            n_rows=n_rows,
        )
        more = declared_metrics(scored, declared, y=target, positive=model.positive, by=[by], n_rows=n_rows)
        if more is not None:
            table = table.join(more, by)
        return {r[by]: {c: r[c] for c in table.columns if c != by} for r in table.collect()}
    finally:
        scored.unpersist()


def train(cohort: Cohort, config: TrainingConfig, *, check_gates: bool = False) -> TrainingResult:
    """Fit on train, report train and validation; the test rows are not scored."""
    started = monotonic()
    roles = cohort.roles
    features = roles.features(cohort.df)
    rows = split_cohort(cohort, config)
    # Gates, preprocessing, encoding and scores each read the cohort: its joins and cuts are computed once.
    used = [c for c in dict.fromkeys((roles.id, roles.group, roles.target, *features)) if c is not None]
    kept = rows.select(*[F.col(f"`{c}`") for c in used], "split").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if check_gates:
            require_gates(kept, id=roles.id, group=roles.group)
        spec = build_model(config.task, config.model, seed=config.seed, **config.model_params)
        sizes = {r["split"]: r["count"] for r in kept.groupBy("split").count().collect()}
        model = spec.fit(kept.where("split = 'train'"), features, roles.target)
        seen = kept.where(F.col("split").isin("train", "validation"))
        metrics = metric_dicts(model, seen, roles.target, "split", sum(sizes.values()), config.metrics)
    finally:
        kept.unpersist()
    return TrainingResult(
        model=model,
        splits=rows.select(roles.id, "split"),
        metrics=metrics,
        split_sizes={s: sizes.get(s, 0) for s in ("train", "validation", "test")},
        roles=roles,
        features=tuple(features),
        elapsed_seconds=monotonic() - started,
        fingerprint=fingerprint(cohort.df, roles.id),
        config=config,
    )


def evaluate_held_out_test(result: TrainingResult, cohort: Cohort) -> dict[str, float | None]:
    """Score the test rows on demand, refusing a table other than the one trained on."""
    roles = result.roles
    if fingerprint(cohort.df, roles.id) != result.fingerprint:
        raise ValueError("the table's fingerprint differs from the one used for training")
    # The split is a function of the row's own keys, so it is assigned anew instead of joined.
    rows = split_cohort(Cohort(cohort.df, roles), result.config).where("split = 'test'")
    n = sum(result.split_sizes.values())
    return metric_dicts(result.model, rows, roles.target, "split", n, result.config.metrics)["test"]
