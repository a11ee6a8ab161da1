"""Deterministic pseudo-random keys.

A row's place in a shuffled order depends on its id and the seed only, never
on the physical layout, so every split is the same under any partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def seeded_md5(seed: int | str, key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


HEX_DIGITS = 15


def shuffle_key(seed: int | str, key: Column) -> Column:
    """First 15 hex digits of the seeded md5 (NULL for a NULL key).

    Fixed-length hex text sorts like the number it spells, without converting it.
    """
    return F.substring(seeded_md5(seed, key), 1, HEX_DIGITS)


def hex_number(key: Column) -> Column:
    return F.conv(key, 16, 10).cast("bigint")


def hash_bucket(key: Column, rows: int, per_bucket: int) -> Column:
    """A prefix of the key long enough that ``rows`` spread to about ``per_bucket`` a bucket."""
    digits = 0
    while per_bucket * 16**digits < rows:
        digits += 1
    return F.substring(key, 1, min(digits, HEX_DIGITS)) if digits else F.lit("")


def hash32(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def hash60(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def time_order(col: Column, dtype: T.DataType) -> Column:
    """A time-like column as something that sorts in time, missing values as NULL.

    Dates and timestamps become BIGINT microseconds (zone-free ones are read in the
    session zone, which this package keeps at UTC); numbers and text keep their order.
    """
    if isinstance(dtype, (T.DateType, T.TimestampNTZType)):
        return F.unix_micros(col.cast("timestamp"))
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(col)
    if isinstance(dtype, T.IntegralType):
        return col.cast("bigint")
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(col), col.cast("double"))
    if isinstance(dtype, (T.DecimalType, T.StringType)):
        return col
    raise TypeError(f"cannot order rows in time by a {dtype.simpleString()} column")
