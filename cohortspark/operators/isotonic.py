"""Isotonic calibration whose blocks are found and kept as tables.

The fit is the slope of the lower hull of cumulated positives over cumulated rows. For any rate m, the point where
``positives - m * rows`` is least lies on that hull, so it cuts a range of scores into two that never pool with each
other. Ranges are cut at the rate of their own rows, all of them at once by one aggregate a round, until a range is one
block (no point lies below its chord) or holds few enough rows to be pooled in one task. Counts are whole numbers, so
the result is exact and does not depend on how the rows are partitioned.

Rows without a score or label take no part in the fit; rows without a score get NULL.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.operators.metrics import score_ladder
from cohortspark.session import materialize

#: A range of at most so many rows is pooled in one task.
POOLED_TOGETHER = 100_000
#: Knots that a row is compared with, as long as there are at most ``MOST_CHUNKS`` times as many.
CHUNK_KNOTS = 64
MOST_CHUNKS = 1024
BLOCK = "first double, last double, value double"


def _pooled(points: pd.DataFrame) -> pd.DataFrame:
    """Adjacent violators of one range, by rising score."""
    points = points.sort_values("score")
    blocks: list[list] = []
    for score, pos, n in zip(points["score"].tolist(), points["pos"].tolist(), points["n"].tolist(), strict=True):
        last = [score, score, pos, n]
        while blocks and blocks[-1][2] * last[3] >= last[2] * blocks[-1][3]:
            before = blocks.pop()
            last = [before[0], last[1], before[2] + last[2], before[3] + last[3]]
        blocks.append(last)
    return pd.DataFrame(
        {
            "first": [b[0] for b in blocks],
            "last": [b[1] for b in blocks],
            "value": [b[2] / b[3] for b in blocks],
        }
    )


def isotonic_blocks(
    df: DataFrame, target: str, score: str, positive: Any, *, pooled_together: int = POOLED_TOGETHER
) -> DataFrame:
    """(first, last, value): maximal ranges of scores with one fitted rate, which rises from block to block."""
    ladder = score_ladder(df, target, score, positive).where("pos + neg > 0")
    s, w = F.col("pos_below") + F.col("pos"), F.col("pos_below") + F.col("neg_below") + F.col("pos") + F.col("neg")
    zero = F.lit(0).cast("long")
    state = ladder.select(
        "score",
        "pos",
        (F.col("pos") + F.col("neg")).alias("n"),
        s.alias("s"),
        w.alias("w"),
        zero.alias("lo_s"),
        zero.alias("lo_w"),
        F.col("all_pos").alias("hi_s"),
        (F.col("all_pos") + F.col("all_neg")).alias("hi_w"),
        F.lit(False).alias("flat"),
    )
    state = materialize(state, "isotonic")
    whole = lambda c: c.cast("decimal(19, 0)")
    height = whole(F.col("s") - F.col("lo_s")) * whole(F.col("hi_w") - F.col("lo_w")) - whole(
        F.col("hi_s") - F.col("lo_s")
    ) * whole(F.col("w") - F.col("lo_w"))
    large = F.col("hi_w") - F.col("lo_w") > pooled_together
    found = []
    while True:
        found.append(state.where(F.col("flat") | ~large))
        if (still := state.where(~F.col("flat") & large)).isEmpty():
            break
        # Written, so that its size is known when the next plan decides how to join it.
        cuts = still.groupBy("lo_w").agg(F.min(F.struct(height.alias("h"), "w", "s")).alias("c"))
        cuts = materialize(cuts.select(F.col("lo_w").alias("of"), "c.*").toDF("of", "h", "cut_w", "cut_s"), "hull")
        one = F.col("h") >= 0
        left = F.col("w") <= F.col("cut_w")
        met = still.join(cuts, F.col("lo_w") == F.col("of"))

        def moved(end: str, side: Column) -> list[Column]:
            return [
                F.when(~one & side, F.col(f"cut_{c}")).otherwise(F.col(f"{end}_{c}")).alias(f"{end}_{c}") for c in "sw"
            ]

        state = materialize(
            met.select("score", "pos", "n", "s", "w", *moved("lo", ~left), *moved("hi", left), one.alias("flat")),
            "isotonic",
        )
    done = reduce(DataFrame.unionByName, found)
    rate = (F.col("hi_s") - F.col("lo_s")) / (F.col("hi_w") - F.col("lo_w"))
    ends = F.min("score").alias("first"), F.max("score").alias("last"), F.first(rate).alias("value")
    flat = done.where("flat").groupBy("lo_w").agg(*ends).drop("lo_w")
    return flat.unionByName(done.where("not flat").groupBy("lo_w").applyInPandas(_pooled, BLOCK))


@dataclass(frozen=True)
class Isotonic:
    """A rising step curve, linear between its blocks and constant beyond them.

    ``chunks`` has neighbouring knots (score, value) as arrays, each with the knot that follows; ``heads`` are the first
    scores of all chunks but the first, at most ``MOST_CHUNKS``.
    """

    heads: Sequence[float]
    chunks: DataFrame

    @classmethod
    def fit(
        cls, scored: DataFrame, target: str, positive: Any, *, pooled_together: int = POOLED_TOGETHER
    ) -> Isotonic:
        blocks = isotonic_blocks(scored, target, "margin", positive, pooled_together=pooled_together)
        ends = F.explode(F.array_distinct(F.array("first", "last")))
        knots = materialize(blocks.select(ends.alias("score"), "value"), "knots")
        if not (size := knots.count()):
            raise ValueError("no row has a score and a label")
        n = min(MOST_CHUNKS, -(-size // CHUNK_KNOTS))
        heads: list[float] = []
        if n > 1:
            marks = [i / n for i in range(1, n)]
            heads = sorted(set(knots.agg(F.percentile_approx("score", marks, 10_000).alias("e")).first()["e"]))
        placed = _placed(knots, "score", heads)
        grouped = placed.groupBy("__chunk").agg(F.array_sort(F.collect_list(F.struct("score", "value"))).alias("at"))
        follower = F.lead(F.array(F.element_at("at", 1))).over(Window.orderBy("__chunk"))  # a row per chunk
        full = F.concat("at", F.coalesce(follower, F.slice("at", 1, 0)))
        return cls(heads, materialize(grouped.select(F.col("__chunk").alias("__of"), full.alias("__at")), "isotonic"))

    def apply(self, df: DataFrame, output: str) -> DataFrame:
        m = F.col("margin").cast("double")
        met = _placed(df, "margin", self.heads).join(self.chunks, F.col("__chunk") == F.col("__of"), "left")
        met = met.withColumn("__low", F.try_element_at(F.filter("__at", lambda k: k["score"] <= m), F.lit(-1)))
        met = met.withColumn("__high", F.try_element_at(F.filter("__at", lambda k: k["score"] > m), F.lit(1)))
        low, high = F.col("__low"), F.col("__high")
        share = (m - low["score"]) / (high["score"] - low["score"])
        between = low["value"] + (high["value"] - low["value"]) * share
        value = F.when(m.isNull() | F.isnan(m), F.lit(None)).otherwise(F.coalesce(between, low["value"], high["value"]))
        return met.withColumn(output, value.cast("double")).drop("__chunk", "__of", "__at", "__low", "__high")


def _placed(df: DataFrame, score: str, heads: Sequence[float]) -> DataFrame:
    """``df`` with ``__chunk``, the number of heads that are not above ``score``."""
    if not heads:
        return df.withColumn("__chunk", F.lit(0.0))
    splits = [-float("inf"), *heads, float("inf")]
    return Bucketizer(splits=splits, inputCol=score, outputCol="__chunk", handleInvalid="keep").transform(df)
