"""Connected components of a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.session import materialize


def _star(links: DataFrame) -> DataFrame:
    """(node, other) pairs with the smallest of the node and its others beside them; minima are taken map-side first."""
    least = links.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("least"))
    return links.join(least.withColumnRenamed("node", "at"), F.col("node") == F.col("at")).drop("at")


def _all_stars(pairs: DataFrame) -> bool:
    """Whether every node has one smaller node beside it at most, and that one has none."""
    if not pairs.groupBy("a").count().filter("count > 1").isEmpty():
        return False
    return pairs.join(pairs.select(F.col("b").alias("center")), F.col("a") == F.col("center"), "left_semi").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """node, label of every node that has a link; the label is the smallest node reachable.

    ``links`` has bigint columns a and b; direction, loops and repeats do not matter. Each round is written to the
    shared folder, so a lost executor never sets the rounds back.
    """
    pairs = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = materialize(pairs, "links")
    while not _all_stars(pairs):
        both = pairs.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
            pairs.select(F.col("b").alias("node"), F.col("a").alias("other"))
        )
        large = _star(both).filter("other > node").select(F.col("other").alias("node"), F.col("least").alias("other"))
        large = large.distinct()
        stars = _star(large)
        small = stars.select(F.col("other").alias("a"), F.col("least").alias("b")).unionByName(
            stars.select(F.col("node").alias("a"), F.col("least").alias("b"))
        )
        pairs = materialize(small.filter("a <> b").distinct(), "links")
    roots = pairs.select(F.col("b").alias("node")).distinct()
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        roots.select("node", F.col("node").alias("label"))
    )
