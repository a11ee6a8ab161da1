"""Features of sampled signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.arrays import doubles, let, mean_of, spread_of

SHORTEST = 3


def _positive_rate(rate: Column) -> Column:
    return F.when(rate > 0, rate.cast("double")).otherwise(
        F.raise_error(F.lit("the sampling rate must be positive")).cast("double")
    )


def _long_enough(v: Column) -> Column:
    return F.when(F.size(v) >= SHORTEST, v).otherwise(
        F.raise_error(F.lit(f"a signal needs at least {SHORTEST} samples")).cast("array<double>")
    )


def as_rate(rate: float | str | Column) -> Column:
    """A constant rate is checked at once, a column row by row."""
    if isinstance(rate, (int, float)):
        if rate <= 0:
            raise ValueError("the sampling rate must be positive")
        return F.lit(float(rate))
    return _positive_rate(F.col(rate) if isinstance(rate, str) else rate)


def signal_summary(df: DataFrame, id: str, values: str, rate: float | str | Column) -> DataFrame:
    """Eleven morphology-free features per signal, without leaving the row."""
    v = _long_enough(doubles(F.col(values)))
    base = df.select(F.col(id), v.alias("v"), as_rate(rate).alias("rate"))
    v, n = F.col("v"), F.size("v")
    step = F.zip_with(F.slice(v, 2, n - 1), F.slice(v, 1, n - 1), lambda after, before: after - before)
    below = let(mean_of(v), lambda m: F.transform(v, lambda x: (x - m) < 0))
    with_steps = base.select(id, "v", "rate", step.alias("dx"), below.alias("below"))
    dx, below = F.col("dx"), F.col("below")
    flips = F.zip_with(
        F.slice(below, 2, n - 1), F.slice(below, 1, n - 1), lambda a, b: (a != b).cast("double")
    )
    square = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x)
    return with_steps.select(
        id,
        n.cast("double").alias("n_samples"),
        ((n - 1) / F.col("rate")).alias("duration_s"),
        mean_of(v).alias("mean"),
        spread_of(v).alias("std"),
        F.array_min(v).alias("min"),
        F.array_max(v).alias("max"),
        (F.array_max(v) - F.array_min(v)).alias("range"),
        F.sqrt(square / n).alias("rms"),
        mean_of(F.transform(dx, lambda d: F.abs(d))).alias("mean_abs_derivative"),
        spread_of(dx).alias("derivative_std"),
        mean_of(flips).alias("zero_crossing_rate"),
    )


def waveform_duration(df: DataFrame, id: str, values: str, rate: float | str | Column) -> DataFrame:
    """Samples divided by rate (one sampling interval longer than ``duration_s`` above)."""
    return df.select(id, (F.size(values) / as_rate(rate)).alias("duration_s"))
