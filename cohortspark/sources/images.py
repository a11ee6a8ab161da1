"""Image files as channel-last RGB columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.functions.images import rgb_pixels
from cohortspark.sources.paths import require_path


def load_images(spark: SparkSession, path: str) -> DataFrame:
    """``(origin, image)`` of every image, decoded inside the JVM; a file that is no image is an error."""
    require_path(spark, path)
    found = spark.read.format("image").option("dropInvalid", False).load(path)
    broken = F.raise_error(F.concat(F.lit("not a readable image: "), F.col("image.origin")))
    checked = found.withColumn("image", F.when(F.col("image.height") > 0, F.col("image")).otherwise(broken))
    return rgb_pixels(checked)
