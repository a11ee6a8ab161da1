"""Metrics of prediction tables, computed from small count tables.

Every function takes ``by`` columns (split, fold, model ...) and returns one row
per combination.  Undefined values are NULL; a metric of labels and scores is
undefined where any of them is missing.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANKED_TOGETHER = 100_000
MOST_BINS = 4096


def confusion(df: DataFrame, y: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, F.col(y).alias("y"), F.col(prediction).alias("h")).agg(
        F.count(F.lit(1)).alias("n")
    )


def classification_metrics(df: DataFrame, y: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, balanced accuracy (classes of ``y``) and macro F1 (classes of either column)."""
    by = list(by)
    table = confusion(df, y, prediction, by)
    hit = F.col("y").eqNullSafe(F.col("h"))
    sides = F.explode(
        F.array(
            F.struct(F.col("y").alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"), F.when(hit, F.col("n")).otherwise(0).alias("tp")),
            F.struct(F.col("h").alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("tp")),
        )
    ).alias("s")
    per_label = (
        table.select(*by, sides)
        .groupBy(*by, "s.label")
        .agg(F.sum("s.support").alias("support"), F.sum("s.predicted").alias("predicted"), F.sum("s.tp").alias("tp"))
    )
    recall = F.when(F.col("support") > 0, F.col("tp") / F.col("support"))
    f1 = 2 * F.col("tp") / (F.col("support") + F.col("predicted"))
    return per_label.groupBy(*by).agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg(recall).alias("balanced_accuracy"),
        F.avg(f1).alias("f1_macro"),
    )


def sensitivity_specificity(df: DataFrame, y: str, prediction: str, positive, by: Sequence[str] = ()) -> DataFrame:
    table = confusion(df, y, prediction, by)
    pos, called = F.col("y") == F.lit(positive), F.col("h") == F.lit(positive)

    def cells(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))

    return table.groupBy(*by).agg(
        F.try_divide(cells(pos & called).cast("double"), cells(pos)).alias("sensitivity"),
        F.try_divide(cells(~pos & ~called).cast("double"), cells(~pos)).alias("specificity"),
    )


def score_edges(df: DataFrame, score: str, n_rows: int | None = None) -> list[float]:
    """Inner edges that cut ``n_rows`` scores into bins small enough to be sorted in one task.

    Edges are quantiles of the rows (a mergeable sketch); since equal scores are
    merged before ranking, a bin never holds much more than its share of distinct ones.
    """
    if n_rows is None:
        n_rows = df.count()
    bins = min(MOST_BINS, -(-n_rows // RANKED_TOGETHER))
    if bins < 2:
        return []
    marks = [i / bins for i in range(1, bins)]
    known = df.where(~F.isnan(score))
    return sorted(set(known.agg(F.percentile_approx(score, marks, 10_000).alias("e")).first()["e"] or ()))


def score_ladder(
    df: DataFrame,
    y: str,
    score: str,
    positive,
    by: Sequence[str] = (),
    *,
    n_rows: int | None = None,
    edges: list[float] | None = None,
) -> DataFrame:
    """Distinct scores with their positives and negatives and the totals at lower scores.

    Rows with a missing score or label count in ``missing`` of a row of their own (score NaN).

    ``n_rows`` is an upper bound of the rows, if known, and spares a count; ``edges``
    are bin edges known from a similar table.
    """
    by = list(by)
    rows = df.select(*by, (F.col(y) == F.lit(positive)).alias("pos"), F.col(score).cast("double").alias("score"))
    gone = F.col("score").isNull() | F.isnan("score") | F.col("pos").isNull()
    rows = rows.withColumn("gone", gone).withColumn("score", F.when(gone, float("nan")).otherwise(F.col("score")))
    if edges is None:
        edges = score_edges(rows, "score", n_rows)
    kept = ~F.col("gone")
    counts = [
        F.count_if(kept & F.col("pos")).alias("pos"),
        F.count_if(kept & ~F.col("pos")).alias("neg"),
        F.count_if("gone").alias("missing"),
    ]

    def below(column: str, window) -> Column:
        return F.coalesce(F.sum(column).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    if not edges:
        counted = rows.groupBy(*by, "score").agg(*counts)
        group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
        climb = group.orderBy("score")
        return counted.select(
            *by,
            "score",
            "pos",
            "neg",
            "missing",
            below("pos", climb).alias("pos_below"),
            below("neg", climb).alias("neg_below"),
            F.sum("pos").over(group).alias("all_pos"),
            F.sum("neg").over(group).alias("all_neg"),
        )

    splits = [-float("inf"), *edges, float("inf")]
    binned = Bucketizer(splits=splits, inputCol="score", outputCol="bin", handleInvalid="keep").transform(rows)
    counted = binned.groupBy(*by, "bin", "score").agg(*counts)
    climb = Window.partitionBy(*by, "bin").orderBy("score")
    ladder = counted.withColumns({"pos_in": below("pos", climb), "neg_in": below("neg", climb)})
    totals = counted.groupBy(*by, "bin").agg(F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # at most MOST_BINS rows each
    offsets = totals.select(
        *by,
        "bin",
        below("p", group.orderBy("bin")).alias("p_off"),
        below("q", group.orderBy("bin")).alias("q_off"),
        F.sum("p").over(group).alias("all_pos"),
        F.sum("q").over(group).alias("all_neg"),
    )
    # The ladder is already partitioned by (by, bin) for its window, so this join moves only the offsets.
    return ladder.join(offsets, [*by, "bin"]).select(
        *by,
        "score",
        "pos",
        "neg",
        "missing",
        (F.col("pos_in") + F.col("p_off")).alias("pos_below"),
        (F.col("neg_in") + F.col("q_off")).alias("neg_below"),
        "all_pos",
        "all_neg",
    )


def ranking_metrics(
    df: DataFrame,
    y: str,
    score: str,
    positive,
    by: Sequence[str] = (),
    *,
    n_rows: int | None = None,
    edges: list[float] | None = None,
) -> DataFrame:
    """AUROC (ties count one half) and average precision of a binary score."""
    ladder = score_ladder(df, y, score, positive, by, n_rows=n_rows, edges=edges)
    wins = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0))
    reached_pos = F.col("all_pos") - F.col("pos_below")
    reached = reached_pos + F.col("all_neg") - F.col("neg_below")
    precision = F.sum(F.try_divide(F.col("pos") * reached_pos, reached))
    pairs = F.when(F.sum("missing") == 0, F.max("all_pos").cast("double") * F.max("all_neg"))
    return ladder.groupBy(*by).agg(
        F.try_divide(wins, pairs).alias("auroc"),
        F.when(pairs > 0, F.try_divide(precision, F.max("all_pos"))).alias("auprc"),
    )


def auroc(df: DataFrame, y: str, score: str, positive=None, by: Sequence[str] = ()) -> DataFrame:
    """AUROC with the larger label as positive by default; NULL unless there are two classes."""
    if positive is None:
        known = df.select(F.col(y).alias("y")).where("y is not null")
        labels = sorted(r["y"] for r in known.distinct().limit(3).collect())
        if len(labels) != 2:
            return df.groupBy(*by).agg(F.lit(None).cast("double").alias("auroc"))
        positive = labels[1]
    return ranking_metrics(df, y, score, positive, by).select(*by, "auroc")


def auprc(df: DataFrame, y: str, score: str, positive, by: Sequence[str] = ()) -> DataFrame:
    return ranking_metrics(df, y, score, positive, by).select(*by, "auprc")


def regression_metrics(df: DataFrame, y: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE and R2; a constant target scores 1 if predicted perfectly, else 0."""
    t, p = F.col(y).cast("double"), F.col(prediction).cast("double")
    err = t - p
    n, sse, var = F.count(t), F.sum(err * err), F.var_pop(t)
    sst = n * var
    r2 = F.when(sst > 0, 1 - sse / F.when(sst > 0, sst)).when(sse == 0, 1.0).otherwise(0.0)
    return df.groupBy(*by).agg(
        F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"), r2.alias("r2")
    )


def brier(df: DataFrame, y: str, probability: str, positive=1, by: Sequence[str] = ()) -> DataFrame:
    p = F.col(probability).cast("double")
    gap = p - _hit(y, positive)
    return df.groupBy(*by).agg(F.when(F.count_if(_missing(y, p)) == 0, F.avg(gap * gap)).alias("brier"))


def _hit(y: str, positive) -> Column:
    return F.when(F.col(y) == F.lit(positive), 1.0).when(F.col(y).isNotNull(), 0.0)


def _missing(y: str, p: Column) -> Column:
    return F.col(y).isNull() | p.isNull() | F.isnan(p)


def bin_edges(bins: int) -> list[float]:
    if bins < 2:
        raise ValueError("at least 2 bins are needed")
    return [float(e) for e in np.linspace(0.0, 1.0, bins + 1)]


def calibration_bins(
    df: DataFrame, y: str, probability: str, *, bins: int = 10, positive=1, by: Sequence[str] = ()
) -> DataFrame:
    """Reliability table over equal-width bins ``[low, high)``, the last one closed.

    Bin 0 collects probabilities outside [0, 1], bin -1 rows without a label or probability.
    """
    edges = bin_edges(bins)
    p = F.col(probability).cast("double")
    hit = _hit(y, positive)
    place = sum((F.when(p >= e, 1).otherwise(0) for e in edges[1:-1]), F.lit(1))
    placed = df.withColumn("bin", F.when(_missing(y, p), -1).when(p.between(0.0, 1.0), place).otherwise(0))
    return placed.groupBy(*by, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_probability"), F.avg(hit).alias("observed_rate")
    )


def ece(df: DataFrame, y: str, probability: str, *, bins: int = 10, positive=1, by: Sequence[str] = ()) -> DataFrame:
    """Expected calibration error; rows outside [0, 1] count in the denominator only."""
    table = calibration_bins(df, y, probability, bins=bins, positive=positive, by=by)
    gap = F.abs(F.col("mean_probability") - F.col("observed_rate"))
    weighted = F.sum(F.when(F.col("bin") > 0, F.col("n") * gap).otherwise(0.0))
    return table.groupBy(*by).agg(F.when(F.min("bin") >= 0, weighted / F.sum("n")).alias("ece"))


def cv_aggregate(long: DataFrame, by: Sequence[str] = ("model", "metric"), value: str = "value") -> DataFrame:
    """Mean and sample std over the folds, undefined folds skipped; one fold has std 0."""
    v = F.when(~F.isnan(value), F.col(value))
    return long.groupBy(*by).agg(
        F.avg(v).alias("mean"),
        F.when(F.count(F.lit(1)) == 1, 0.0).otherwise(F.stddev_samp(v)).alias("std"),
        F.count(F.lit(1)).alias("folds"),
    )


def melt_metrics(wide: DataFrame, by: Sequence[str]) -> DataFrame:
    """Wide metric rows as the long ``(by..., metric, value)`` table."""
    metrics = [c for c in wide.columns if c not in set(by)]
    return wide.unpivot(list(by), [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value")


# Which way each metric improves.
LOWER_IS_BETTER = ("mae", "rmse", "brier", "brier_score", "ece")


def higher_is_better(metric: str) -> bool:
    return metric not in LOWER_IS_BETTER


def evaluate(
    predictions: DataFrame,
    *,
    task: str,
    y: str,
    positive=None,
    binary: bool = False,
    by: Sequence[str] = (),
    n_rows: int | None = None,
) -> DataFrame:
    """Metrics of a scored table with ``prediction`` (and ``score``) columns, one row per ``by``."""
    by = list(by)
    if task == "regression":
        return regression_metrics(predictions, y, "prediction", by)
    if task != "classification":
        raise ValueError(f"task must be classification or regression, got {task!r}")
    plain = classification_metrics(predictions, y, "prediction", by)
    if "score" not in predictions.columns:
        return plain
    if not binary:
        return plain.withColumn("auroc", F.lit(None).cast("double"))
    ranked = ranking_metrics(predictions, y, "score", positive, by, n_rows=n_rows).select(*by, "auroc")
    if not by:
        # Both sides are one aggregate row each.
        value = ranked.first()
        return plain.withColumn("auroc", F.lit(value["auroc"] if value else None).cast("double"))
    return plain.join(ranked, by, "left")


# The metrics that every evaluation has, and those that a definition may declare on top.
STANDARD = {"classification": ("accuracy", "balanced_accuracy", "f1_macro", "auroc"), "regression": ("mae", "rmse", "r2")}
DECLARABLE = ("auprc", "sensitivity", "specificity", "brier_score", "ece")


def undefined_metrics(names: Sequence[str], task: str) -> list[str]:
    """The names that no evaluation of the task can report."""
    known = STANDARD[task] + (DECLARABLE if task == "classification" else ())
    return sorted(set(names) - set(known))


def declared_metrics(
    predictions: DataFrame, names: Sequence[str], *, y: str, positive, by: Sequence[str], n_rows: int | None = None
) -> DataFrame | None:
    """The declared metrics beyond the standard ones, one row per ``by``; NULL where the model has no scores."""
    by, wanted = list(by), [n for n in DECLARABLE if n in names]
    if not wanted:
        return None
    out = predictions.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).drop("__n")
    scored = "score" in predictions.columns and positive is not None
    parts = []
    if positive is not None and {"sensitivity", "specificity"} & set(wanted):
        parts.append(sensitivity_specificity(predictions, y, "prediction", positive, by))
    if scored and "auprc" in wanted:
        parts.append(ranking_metrics(predictions, y, "score", positive, by, n_rows=n_rows).select(*by, "auprc"))
    if scored and "brier_score" in wanted:
        parts.append(brier(predictions, y, "score", positive, by).withColumnRenamed("brier", "brier_score"))
    if scored and "ece" in wanted:
        parts.append(ece(predictions, y, "score", positive=positive, by=by))
    for part in parts:
        out = out.join(part, by, "left")
    return out.select(*by, *[F.col(n) if n in out.columns else F.lit(None).cast("double").alias(n) for n in wanted])
