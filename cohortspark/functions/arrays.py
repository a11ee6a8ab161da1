"""Row-wise summaries of ``ARRAY<DOUBLE>`` columns, as built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, even if ``body`` loops over an array."""
    return F.transform(F.array(value), body)[0]


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def mean_of(v: Column) -> Column:
    return F.try_divide(total(v), F.size(v))


def spread_of(v: Column) -> Column:
    """Population standard deviation, from squared distances to the mean."""
    return let(
        mean_of(v),
        lambda m: F.sqrt(
            F.try_divide(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + (x - m) * (x - m)), F.size(v))
        ),
    )


def median_of(v: Column) -> Column:
    def middle(s: Column) -> Column:
        low = F.floor((F.size(s) - 1) / 2).cast("int")
        high = F.floor(F.size(s) / 2).cast("int")
        return F.when(F.size(s) > 0, (F.get(s, low) + F.get(s, high)) / 2)

    return let(F.array_sort(v), middle)


def numeric_summary(df: DataFrame, id: str, values: str, prefix: str = "x") -> DataFrame:
    """Mean, population std, min, max and median per row; missing entries are ignored."""
    seen = F.filter(doubles(F.col(values)), lambda x: x.isNotNull() & ~F.isnan(x))
    kept = df.select(id, seen.alias("v"))
    v = F.col("v")
    return kept.select(
        id,
        mean_of(v).alias(f"{prefix}_mean"),
        spread_of(v).alias(f"{prefix}_std"),
        F.array_min(v).alias(f"{prefix}_min"),
        F.array_max(v).alias(f"{prefix}_max"),
        median_of(v).alias(f"{prefix}_median"),
    )


def waveform_summary(df: DataFrame, id: str, values: str) -> DataFrame:
    return numeric_summary(df, id, values, prefix="waveform")


def expression_variability(df: DataFrame, id: str, values: str) -> DataFrame:
    """Mean, population std and non-zero share; a NaN makes the first two NaN and is non-zero."""
    v = F.col("v")
    return df.select(id, doubles(F.col(values)).alias("v")).select(
        id,
        mean_of(v).alias("expression_mean"),
        spread_of(v).alias("expression_std"),
        F.try_divide(F.size(F.filter(v, lambda x: x != 0.0)).cast("double"), F.size(v)).alias(
            "expression_nonzero_fraction"
        ),
    )


def clamped_log1p(v: Column) -> Column:
    """``log(1 + x)`` with negative entries taken as zero."""
    return F.transform(doubles(v), lambda x: F.log1p(F.greatest(x, F.lit(0.0))))


def standardised(v: Column) -> Column:
    """Z-score within one row; a constant row becomes zeros."""
    v = doubles(v)
    moments = F.struct(mean_of(v).alias("m"), spread_of(v).alias("s"))

    def scaled(p: Column) -> Column:
        unit = F.when(p["s"] == 0.0, F.lit(1.0)).otherwise(p["s"])
        return F.transform(v, lambda x: (x - p["m"]) / unit)

    return let(moments, scaled)
