"""Gapless positions inside groups that may hold a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts that each group is split into; a part is ranked in one task.
PARTS = 1024


def with_positions(
    rows: DataFrame, group: Sequence[str], order: Sequence[Column], name: str, parts: int = PARTS
) -> DataFrame:
    """``rows`` with a bigint column ``name`` that counts from 0 in each group.

    Rows are ordered by a hash of ``order`` and then by ``order`` itself. Each group is cut into ``parts`` by that
    hash, the parts are counted (at most ``parts`` rows per group), and rows are ranked only within their part, so no
    task ever ranks a whole group. Rows equal in all of ``order`` take their places in any order.
    """
    key = F.xxhash64(*order)
    cut = rows.withColumns({"__key": key, "__part": F.pmod(F.shiftright(key, 20), F.lit(parts))})
    on = [*group, "__part"]
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        cut.groupBy(*on)
        .count()
        .select(*on, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    )
    starts = starts.select(*[F.col(c).alias(f"__at_{c}") for c in on], "__start")
    ranked = cut.withColumn(
        "__rank", F.row_number().over(Window.partitionBy(*on).orderBy("__key", *order)) - F.lit(1)
    )
    same = None
    # Columns that hold no NULL meet by plain equality, which keeps the ranking's partitioning: rows move once.
    full = {f.name for f in cut.schema if not f.nullable} | {"__part"}
    for c in on:
        one = F.col(c) == F.col(f"__at_{c}") if c in full else F.col(c).eqNullSafe(F.col(f"__at_{c}"))
        same = one if same is None else same & one
    return (
        ranked.join(starts, same)
        .withColumn(name, (F.col("__start") + F.col("__rank")).cast("long"))
        .select(*rows.columns, name)
    )
