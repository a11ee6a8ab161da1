"""Sparse sample-by-feature matrices as long ``(sample, feature, value)`` tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.missing import present_double
from cohortspark.operators.quantiles import exact_quantiles
from cohortspark.roles import is_numeric_type
from cohortspark.session import materialize

ENTRIES_A_TASK = 500_000


def to_long(df: DataFrame, id: str, values: str, *, keep: Sequence[str] = ()) -> DataFrame:
    """One row per (sample, feature position)."""
    return df.select(id, *keep, F.posexplode(F.col(values).cast("array<double>")).alias("feature", "value"))


def feature_moments(long: DataFrame, *, feature: str = "feature", value: str = "value", n_samples: int | None = None) -> DataFrame:
    """Mean and population variance per feature, missing values ignored.

    With ``n_samples`` the table is sparse: a (sample, feature) pair without a row is a zero.
    """
    v = present_double(long, value)
    stats = long.groupBy(feature).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_pop(v).alias("variance")
    )
    if n_samples is None:
        return stats
    share = F.col("n") / F.lit(float(n_samples))
    spread = F.col("variance") + (1 - share) * F.col("mean") * F.col("mean")
    return stats.select(
        feature,
        F.lit(n_samples).cast("bigint").alias("n"),
        (share * F.col("mean")).alias("mean"),
        (share * spread).alias("variance"),
    )


def variance_filter(
    long: DataFrame,
    min_variance: float = 0.0,
    *,
    feature: str = "feature",
    value: str = "value",
    n_samples: int | None = None,
) -> DataFrame:
    """Entries of the features whose variance is strictly above the threshold."""
    kept = feature_moments(long, feature=feature, value=value, n_samples=n_samples).where(
        F.col("variance") > min_variance
    )
    return long.join(kept.select(feature), feature, "left_semi").select(*long.columns)


def zscore_features(long: DataFrame, *, feature: str = "feature", value: str = "value") -> DataFrame:
    """Standardise every feature over its samples; a constant feature becomes zeros.

    Meant for fully observed features, so nothing is skipped: a NaN spreads to its feature.
    """
    v = F.col(value).cast("double")
    stats = long.groupBy(feature).agg(F.avg(v).alias("mean_"), F.stddev_pop(v).alias("std_"))
    unit = F.when(F.col("std_") == 0.0, 1.0).otherwise(F.col("std_"))
    scaled = long.join(stats, feature).withColumn(value, (v - F.col("mean_")) / unit)
    return scaled.select(*long.columns)


def expression_log1p(df: DataFrame, exclude: Iterable[str] = ("sample_id",)) -> DataFrame:
    """``log(1 + x)`` of every column not excluded; negative values are an error."""
    skip = set(exclude)
    columns = [c for c in df.columns if c not in skip]
    text = [c for c in columns if not is_numeric_type(df.schema[c].dataType)]
    if text:
        raise TypeError(f"not numeric: {text}")
    checks = [F.count_if(present_double(df, c) < 0).alias(c) for c in columns]
    if checks:
        row = df.agg(*checks).first()
        negative = [c for c in columns if row[c]]
        if negative:
            raise ValueError(f"negative values in {negative}")
    return df.select(
        *[F.col(f"`{c}`") if c in skip else F.log1p(F.col(f"`{c}`").cast("double")).alias(c) for c in df.columns]
    )


def pseudobulk(
    counts: DataFrame,
    obs: DataFrame,
    *,
    cell: str = "cell_id",
    group: str = "group",
    gene: str = "gene",
    count: str = "count",
) -> DataFrame:
    """Summed counts per (group, gene); cells without a group are dropped.

    ``count`` names the layer to sum, so several layers are several columns.
    """
    if group not in obs.columns:
        raise KeyError(f"column {group!r} is not in the observation table")
    cells = obs.where(F.col(group).isNotNull()).select(cell, group)
    joined = counts.select(cell, gene, count).join(cells, cell)
    return joined.groupBy(group, gene).agg(F.sum(count).alias(count))


def pseudobulk_wide(long: DataFrame, genes: Sequence, *, group: str = "group", gene: str = "gene", count: str = "count") -> DataFrame:
    """One column per gene of a list known beforehand."""
    wide = long.groupBy(group).pivot(gene, list(genes)).agg(F.sum(count))
    return wide.na.fill(0)


def obs_table(obs: DataFrame, cell: str, id: str = "sample_id") -> DataFrame:
    """Observation metadata with its index as a unique id column."""
    repeated = obs.groupBy(cell).count().where("count > 1")
    if not repeated.isEmpty():
        raise ValueError("observation ids are not unique")
    return obs.withColumnRenamed(cell, id)


def dealt_alike(entries: DataFrame, cell: str, cells: DataFrame, id: str) -> tuple[DataFrame, DataFrame]:
    """Entries and their cells in tasks of about ``ENTRIES_A_TASK`` entries, so that a join and sums by cell need no other shuffle.

    The number of tasks follows the rows, not the session: what one task holds does not grow with the table.
    """
    tasks = max(1, -(-entries.count() // ENTRIES_A_TASK))
    return entries.repartition(tasks, cell), cells.repartition(tasks, id)


def qc_summary(
    counts: DataFrame,
    *,
    sample: str,
    cell: str,
    gene: str,
    count: str,
    marker: Column,
) -> DataFrame:
    """Per sample: cells, genes, non-zero entries and the spread of per-cell totals.

    Entries of the same (cell, gene) are summed first; counts are non-negative and
    explicit zeros do not count as detected.  The per-cell table is written once and
    read by both summaries; genes are counted from distinct (sample, gene) pairs,
    which collapse before they are shuffled.
    """
    seen = counts.where(F.col(count) != 0)
    entries = seen.groupBy(sample, cell, gene).agg(
        F.sum(count).cast("double").alias("umi"), F.max(marker.cast("int")).alias("is_marker")
    )
    cells = entries.groupBy(sample, cell).agg(
        F.count(F.lit(1)).alias("detected"),
        F.sum("umi").alias("umi"),
        F.sum(F.when(F.col("is_marker") == 1, F.col("umi")).otherwise(0.0)).alias("marker_umi"),
    )
    cells = materialize(cells.withColumn("marker_fraction", F.col("marker_umi") / F.col("umi")), "cells")
    sizes = cells.groupBy(sample).agg(
        F.count(F.lit(1)).alias("cells"), F.sum("detected").alias("nnz")
    )
    genes = seen.select(sample, gene).distinct().groupBy(sample).agg(F.count(F.lit(1)).alias("genes"))
    long = cells.select(
        sample,
        F.expr(
            "stack(3, 'umi', umi, 'detected', cast(detected as double), 'marker', marker_fraction) as (measure, x)"
        ),
    )
    spread = exact_quantiles(long, [sample, "measure"], "x", {"median": 0.5, "p90": 0.9})

    def pick(measure: str, column: str, name: str) -> Column:
        return F.max(F.when(F.col("measure") == measure, F.col(column))).alias(name)

    wide = spread.groupBy(sample).agg(
        pick("umi", "median", "median_umi_per_cell"),
        pick("detected", "median", "median_detected_genes"),
        pick("marker", "median", "median_marker_fraction"),
        pick("marker", "p90", "p90_marker_fraction"),
    )
    return sizes.join(genes, sample).join(wide, sample).select(
        sample,
        "cells",
        "genes",
        "nnz",
        "median_umi_per_cell",
        "median_detected_genes",
        "median_marker_fraction",
        "p90_marker_fraction",
    )


def anova_scores(long: DataFrame, *, feature: str = "feature", value: str = "value", label: str = "label") -> DataFrame:
    """``(feature, score, mean, std)``: one-way ANOVA F per feature of a long table with a label."""
    v = F.col(value).cast("double")
    cells = long.groupBy(feature, label).agg(
        F.count(v).alias("n"), F.avg(v).alias("m"), F.var_pop(v).alias("s")
    )
    grand = cells.groupBy(feature).agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("k"),
        (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("gm"),
        F.sum(F.col("n") * F.col("s")).alias("within"),
        F.collect_list(F.struct("n", "m")).alias("cells"),  # one entry per class
    )
    between = F.aggregate(
        "cells", F.lit(0.0), lambda acc, c: acc + c["n"] * (c["m"] - F.col("gm")) * (c["m"] - F.col("gm"))
    )
    msb = between / (F.col("k") - 1)
    msw = F.col("within") / (F.col("n") - F.col("k"))
    return grand.select(
        feature,
        _ratio(msb, msw).alias("score"),
        F.col("gm").alias("mean"),
        F.sqrt((F.col("within") + between) / F.col("n")).alias("std"),
    )


def regression_scores(long: DataFrame, *, feature: str = "feature", value: str = "value", target: str = "target") -> DataFrame:
    """``(feature, score, mean, std)``: F of the simple regression of the target on each feature."""
    v, y = F.col(value).cast("double"), F.col(target).cast("double")
    stats = long.groupBy(feature).agg(
        F.count(v).alias("n"),
        F.avg(v).alias("mean"),
        F.covar_pop(v, y).alias("c"),
        F.var_pop(v).alias("vx"),
        F.var_pop(y).alias("vy"),
    )
    r2 = F.try_divide(F.col("c") * F.col("c"), F.col("vx") * F.col("vy"))
    return stats.select(
        feature, _ratio(r2 * (F.col("n") - 2), 1 - r2).alias("score"), "mean", F.sqrt("vx").alias("std")
    )


def _ratio(top: Column, bottom: Column) -> Column:
    """NULL when undefined (a constant feature), infinite for perfect separation."""
    undefined = top.isNull() | F.isnan(top) | F.isnan(bottom) | ((bottom <= 0) & (top <= 0))
    return F.when(undefined, F.lit(None).cast("double")).when(
        bottom <= 0, F.lit(float("inf"))
    ).otherwise(F.try_divide(top, bottom))


def top_features(scores: DataFrame, k: int, *, feature: str = "feature") -> DataFrame:
    """The ``k`` best features; undefined scores come last, ties by feature."""
    if k < 1:
        raise ValueError("k must be positive")
    return scores.orderBy(F.desc_nulls_last("score"), F.asc(feature)).limit(k)
