"""Permutation importance: how much a score drops when one feature is shuffled."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.functions.keys import hash_bucket, shuffle_key
from cohortspark.operators.metrics import (
    classification_metrics,
    ranking_metrics,
    regression_metrics,
    score_edges,
)

BUCKET_ROWS = 100_000

# Scoring names and the metric each maps to; a leading minus flips the sign.
SCORINGS = {
    "accuracy": "accuracy",
    "balanced_accuracy": "balanced_accuracy",
    "f1_macro": "f1_macro",
    "roc_auc": "auroc",
    "auroc": "auroc",
    "r2": "r2",
    "neg_root_mean_squared_error": "-rmse",
    "neg_mean_absolute_error": "-mae",
}


def with_donors(
    df: DataFrame, id: str, columns: Sequence[str], repeats: int, *, seed: int = 42, n_rows: int | None = None
) -> DataFrame:
    """Every row once per repeat, with a ``donor`` row of a random permutation.

    Within a repeat all rows are put in a seeded random order and each takes the
    values of its successor (the last those of the first), so every row donates
    exactly once.  The order is cut into hash buckets to keep the window distributed;
    the last row of a bucket takes the first of the next bucket, so the ring is one
    at any size and does not depend on the buckets.  All features share it: one
    shuffle per repeat.
    """
    if repeats < 1:
        raise ValueError("at least one repeat is needed")
    rows = df.count() if n_rows is None else n_rows
    each = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"))
    keyed = each.withColumn(
        "__key", shuffle_key(seed, F.concat(F.col("repeat").cast("string"), F.lit(":"), F.col(id).cast("string")))
    ).withColumn("__bucket", hash_bucket(F.col("__key"), rows, BUCKET_ROWS))
    values = F.struct(*[F.col(f"`{c}`") for c in columns])
    # The head of every bucket, seen from the bucket before it: one row per bucket and repeat.
    heads = keyed.groupBy("repeat", "__bucket").agg(F.min_by(values, F.struct("__key", id)).alias("__head"))
    after = Window.partitionBy("repeat").orderBy("__bucket")
    whole = after.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = F.coalesce(F.lead("__head").over(after), F.first("__head").over(whole))
    heads = heads.select("repeat", "__bucket", following.alias("__following"))
    ring = Window.partitionBy("repeat", "__bucket").orderBy("__key", id)
    ringed = keyed.withColumns({"__next": F.lead(values).over(ring), "__last": F.lead("__key").over(ring).isNull()})
    joined = ringed.join(heads, ["repeat", "__bucket"])
    donor = F.when(F.col("__last"), F.col("__following")).otherwise(F.col("__next"))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], "repeat", donor.alias("donor"))


def _scores(
    df: DataFrame, scoring: str, target: str, positive, by: Sequence[str], edges: list[float] | None = None
) -> DataFrame:
    if scoring not in SCORINGS:
        raise ValueError(f"scoring must be one of {sorted(SCORINGS)}, got {scoring!r}")
    metric = SCORINGS[scoring]
    name = metric.lstrip("-")
    if name == "auroc":
        table = ranking_metrics(df, target, "score", positive, by, edges=edges)
    elif name in ("r2", "rmse", "mae"):
        table = regression_metrics(df, target, "prediction", by)
    else:
        table = classification_metrics(df, target, "prediction", by)
    value: Column = -F.col(name) if metric.startswith("-") else F.col(name)
    return table.select(*by, value.alias("value"))


def permutation_importance(
    scorer: Callable[[DataFrame], DataFrame],
    df: DataFrame,
    id: str,
    features: Sequence[str],
    target: str,
    *,
    scoring: str,
    positive=None,
    n_repeats: int = 10,
    seed: int = 42,
) -> DataFrame:
    """``(feature, importance_mean, importance_std)``, most important first.

    ``scorer`` adds ``prediction`` (and ``score``) to rows and is never fitted here.
    """
    features = list(features)
    rows = df.select(id, target, *features)
    n_rows = rows.count()
    scored = scorer(rows)
    edges = None
    if SCORINGS.get(scoring) == "auroc":
        # Shuffled rows are scored once: their ranking bins come from the unshuffled scores.
        edges = score_edges(scored, "score", n_rows * len(features) * n_repeats)
    base = _scores(scored, scoring, target, positive, [], edges).first()["value"]
    mixed = with_donors(rows, id, features, n_repeats, seed=seed, n_rows=n_rows)
    which = F.explode(F.array(*[F.lit(f) for f in features])).alias("feature")
    spread = mixed.select("*", which)
    shuffled = spread.select(
        "repeat",
        "feature",
        id,
        target,
        *[F.when(F.col("feature") == f, F.col(f"donor.`{f}`")).otherwise(F.col(f"`{f}`")).alias(f) for f in features],
    )
    scores = _scores(scorer(shuffled), scoring, target, positive, ["feature", "repeat"], edges)
    drop = F.lit(base) - F.col("value")
    return (
        scores.groupBy("feature")
        .agg(F.avg(drop).alias("importance_mean"), F.stddev_pop(drop).alias("importance_std"))
        .orderBy(F.desc("importance_mean"), "feature")
    )


def model_importance(
    model, df: DataFrame, id: str, target: str, *, scoring: str | None = None, n_repeats: int = 10, seed: int = 42
) -> DataFrame:
    """Importance of a fitted model's features; accuracy or R2 unless another score is named."""
    default = "accuracy" if model.task == "classification" else "r2"
    return permutation_importance(
        model.transform,
        df,
        id,
        model.features,
        target,
        scoring=scoring or default,
        positive=model.positive,
        n_repeats=n_repeats,
        seed=seed,
    )
