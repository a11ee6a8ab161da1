"""Image statistics on ``(height, width, channels, data)`` columns, channel-last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.arrays import doubles, let, mean_of, spread_of


def image_column(data: Column, height: int, width: int, channels: int | None = None) -> Column:
    """Pack a flat array as an image; ``channels=None`` means a two-dimensional one."""
    depth = 1 if channels is None else channels
    ok = F.size(data) == height * width * depth
    checked = F.when(ok, data).otherwise(
        F.raise_error(F.lit("pixel count does not match the image shape")).cast("array<double>")
    )
    return F.struct(
        F.lit(height).alias("height"),
        F.lit(width).alias("width"),
        F.lit(channels).cast("int").alias("channels"),
        checked.alias("data"),
    )


def _channel(v: Column, c: int, channels: int) -> Column:
    return F.filter(v, lambda _, i: F.pmod(i, F.lit(channels)) == c)


def image_statistics(df: DataFrame, id: str, image: str, channels: int | None = None) -> DataFrame:
    """Shape plus global mean and std; per-channel ones for images with a channel axis.

    ``channels`` is how many channel columns to emit: a schema needs a fixed number.
    """
    data = doubles(F.col(f"{image}.data"))
    base = df.select(
        F.col(id),
        F.col(f"{image}.height").cast("double").alias("height"),
        F.col(f"{image}.width").cast("double").alias("width"),
        F.coalesce(F.col(f"{image}.channels"), F.lit(1)).cast("double").alias("channels"),
        data.alias("v"),
    )
    v = F.col("v")
    out = [mean_of(v).alias("global_mean"), spread_of(v).alias("global_std")]
    for c in range(channels or 0):
        part = _channel(v, c, channels)
        out += [mean_of(part).alias(f"channel_{c}_mean"), spread_of(part).alias(f"channel_{c}_std")]
    return base.select(id, "height", "width", "channels", *out)


def image_normalize(data: Column) -> Column:
    """Min-max scaling to [0, 1]; a constant image becomes zeros."""
    data = doubles(data)
    ends = F.struct(F.array_min(data).alias("lo"), F.array_max(data).alias("hi"))

    def scaled(e: Column) -> Column:
        flat = e["hi"] == e["lo"]
        return F.transform(
            data, lambda x: F.when(flat, F.lit(0.0)).otherwise((x - e["lo"]) / (e["hi"] - e["lo"]))
        )

    return let(ends, scaled)


def rgb_pixels(df: DataFrame, image: str = "image") -> DataFrame:
    """Rows of Spark's image source as channel-last RGB floats.

    The source stores bytes in blue-green-red(-alpha) order, or one grey byte.
    """
    raw = F.col(f"{image}.data")
    depth = F.col(f"{image}.nChannels")
    count = F.col(f"{image}.height") * F.col(f"{image}.width")

    def byte_at(position: Column) -> Column:
        return F.conv(F.hex(F.substring(raw, position + 1, F.lit(1))), 16, 10).cast("float")

    def pixel(i: Column) -> Column:
        start = i * depth
        grey = F.array(byte_at(start), byte_at(start), byte_at(start))
        colour = F.array(byte_at(start + 2), byte_at(start + 1), byte_at(start))
        return F.when(depth == 1, grey).otherwise(colour)

    data = F.flatten(F.transform(F.sequence(F.lit(0), count - 1), pixel))
    return df.select(
        F.col(f"{image}.origin").alias("origin"),
        F.struct(
            F.col(f"{image}.height").alias("height"),
            F.col(f"{image}.width").alias("width"),
            F.lit(3).alias("channels"),
            data.alias("data"),
        ).alias("image"),
    )
