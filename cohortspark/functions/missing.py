"""One definition of "missing" for every operator: NULL, or NaN in a float column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_missing(col: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def null_out(col: Column, dtype: T.DataType) -> Column:
    """NaN becomes NULL, so that aggregates skip it."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(col), col)
    return col


def missing(df: DataFrame, name: str) -> Column:
    return is_missing(F.col(f"`{name}`"), df.schema[name].dataType)


def present_double(df: DataFrame, name: str) -> Column:
    """The column as DOUBLE with NaN turned into NULL."""
    dtype = df.schema[name].dataType
    return null_out(F.col(f"`{name}`"), dtype).cast("double")
