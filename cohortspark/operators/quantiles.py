"""Exact quantiles per group at any group size and any number of groups.

``percentile`` keeps every distinct value of a group in one task, which is fine until a group has many of them. Larger groups are
narrowed first: every wanted rank of every such group is a row of a table with the bracket of values that holds it. A round joins the values
with that table, counts what lies before, in and after a candidate bracket that a mergeable sketch proposed, and keeps the part that holds
the rank, whichever it is, so a sketch's error costs a round and never the result. Only values of brackets with few distinct ones are
ranked. The driver sees neither groups nor ranks, only whether some are left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.session import materialize

DISTINCT_LIMIT = 500_000
#: Points of the sketch that proposes brackets, its accuracy, and points left and right of the rank that a bracket takes in.
GRID, ACCURACY, SLACK = 1000, 10_000, 2


def exact_quantiles(
    long: DataFrame,
    by: list[str],
    value: str,
    quantiles: dict[str, float],
    *,
    distinct_limit: int | None = None,
    most_distinct: int | None = None,
) -> DataFrame:
    """One row per group of ``by`` with the interpolated quantiles; missing values are skipped.

    ``most_distinct`` is the caller's (approximate) largest number of distinct values
    in a group, if known.
    """
    limit = DISTINCT_LIMIT if distinct_limit is None else distinct_limit
    v = F.col(value).cast("double")
    rows = long.where(v.isNotNull() & ~F.isnan(v)).select(*by, v.alias("__v"))
    if most_distinct is not None and most_distinct <= limit:
        return _small(rows, by, quantiles)
    keys = by or ["__all"]
    if not by:
        rows = rows.withColumn("__all", F.lit(0))
    sizes = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"),
        F.approx_count_distinct("__v").alias("__d"),
        F.min("__v").alias("__lo"),
        F.max("__v").alias("__hi"),
    )
    large = materialize(sizes.where(F.col("__d") > limit).withColumn("__g", F.monotonically_increasing_id()), "large")
    if large.isEmpty():
        return _small(rows, keys, quantiles).select(*by, *quantiles)
    match = None
    for k in keys:
        one = F.col(f"r.`{k}`").eqNullSafe(F.col(f"k.`{k}`"))
        match = one if match is None else match & one
    tagged = rows.alias("r").join(large.alias("k"), match).select(F.col("k.__g").alias("g"), F.col("r.__v").alias("v"))
    solved = _solve(materialize(tagged, "values"), large, quantiles, limit).withColumnRenamed("g", "__of")
    names = [solved[f"`{n}`"] for n in quantiles]
    done = large.join(solved, F.col("__g") == F.col("__of")).select(*by, *names)
    if not by:
        return done
    others = rows.alias("r").join(large.alias("k"), match, "left_anti")
    return _small(others, by, quantiles).unionByName(done)


def _small(rows: DataFrame, by: list[str], quantiles: dict[str, float]) -> DataFrame:
    # Counting equal values first keeps a value that fills a third of the rows out of the shuffle.
    counted = rows.groupBy(*by, "__v").agg(F.count(F.lit(1)).alias("__c"))
    aggs = [F.percentile("__v", q, F.col("__c")).alias(name) for name, q in quantiles.items()]
    return counted.groupBy(*by).agg(*aggs)


def _wanted(large: DataFrame, quantiles: dict[str, float]) -> DataFrame:
    """g, name, low, high, share: the quantile lies at ``share`` between the values of ranks ``low`` and ``high`` (from 0)."""
    asked = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(q)).alias("q")) for n, q in quantiles.items()])
    each = large.select(F.col("__g").alias("g"), F.col("__n").alias("n"), F.explode(asked).alias("a"))
    position = F.col("a.q") * (F.col("n") - 1)
    low = F.floor(position)
    return each.select("g", "a.name", low.alias("low"), F.least(low + 1, F.col("n") - 1).alias("high"), (position - low).alias("share"))


def _solve(tagged: DataFrame, large: DataFrame, quantiles: dict[str, float], limit: int) -> DataFrame:
    """g and a column per quantile, from all values (g, v) of the large groups."""
    wanted = _wanted(large, quantiles)
    ranks = wanted.select("g", F.explode(F.array("low", "high")).alias("k")).distinct()
    ends = large.select(F.col("__g").alias("g"), F.col("__lo").alias("lo"), F.col("__hi").alias("hi"))
    open_ = ranks.join(ends, "g").select("g", "k", "lo", "hi", F.col("lo").alias("from"), F.col("hi").alias("to"))
    found = None
    while True:
        looked = materialize(_look(tagged, open_, limit), "brackets")
        ready = looked.where("ready").select("g", "k", "lo", "hi", "below")
        found = ready if found is None else found.unionByName(ready)
        open_ = looked.where("not ready").select("g", "k", "lo", "hi", "from", "to")
        if open_.isEmpty():
            break
    inside = tagged.join(found, "g").where("v >= lo and v <= hi")
    counted = inside.groupBy("g", "k", "below", "v").agg(F.count(F.lit(1)).alias("c"))
    upto = Window.partitionBy("g", "k").orderBy("v")  # few distinct values
    counted = counted.withColumn("reach", F.col("below") + F.sum("c").over(upto)).where("reach > k")
    values = materialize(counted.groupBy("g", "k").agg(F.min("v").alias("v")), "ranked")
    low, high = (values.select(F.col("g").alias(f"g_{e}"), F.col("k").alias(f"k_{e}"), F.col("v").alias(e)) for e in ("left", "right"))
    met = wanted.join(low, (F.col("g") == F.col("g_left")) & (F.col("low") == F.col("k_left")))
    met = met.join(high, (F.col("g") == F.col("g_right")) & (F.col("high") == F.col("k_right")))
    value = F.col("left") + F.col("share") * (F.col("right") - F.col("left"))
    return met.groupBy("g").agg(*[F.max(F.when(F.col("name") == n, value)).alias(n) for n in quantiles])


def _look(tagged: DataFrame, open_: DataFrame, limit: int) -> DataFrame:
    """One round for the brackets ``open_``: g, k, the bracket lo to hi that is left, the candidate inside it, ready, below.

    A bracket is ready if it has few distinct values (or one); ``below`` then counts the values before it.
    """
    v = F.col("v")
    before, after = v < F.col("from"), v > F.col("to")
    inside = F.when(~before & ~after, v)
    seen = tagged.join(open_, "g").where("v <= hi").groupBy("g", "k", "lo", "hi", "from", "to").agg(
        F.count_if(before).alias("below"),
        F.count(inside).alias("n"),
        F.approx_count_distinct(inside).alias("d"),
        F.max(F.when(before & (v >= F.col("lo")), v)).alias("left"),
        F.min(F.when(after, v)).alias("right"),
        F.percentile_approx(inside, [i / GRID for i in range(GRID + 1)], ACCURACY).alias("grid"),
    )
    k, below, n = F.col("k"), F.col("below"), F.col("n")
    hit = (below <= k) & (k < below + n)
    lo = F.when(hit, F.col("from")).when(k < below, F.col("lo")).otherwise(F.col("right"))
    hi = F.when(hit, F.col("to")).when(k < below, F.col("left")).otherwise(F.col("hi"))
    kept = seen.select("g", "k", lo.alias("lo"), hi.alias("hi"), hit.alias("hit"), "below", "n", "d", "grid")
    at = F.try_divide(k - below, n) * GRID  # nothing in the candidate: no proposal

    def point(i: Column) -> Column:
        return F.get("grid", F.greatest(F.lit(0), F.least(F.lit(GRID), i)).cast("int"))

    first, last = point(F.floor(at) - SLACK), point(F.ceil(at) + SLACK)
    # A candidate as wide as the bracket would not narrow it.
    same = (first == F.col("lo")) & (last == F.col("hi"))
    ready = F.col("hit") & ((F.col("lo") == F.col("hi")) | (F.col("d") <= limit) | same)
    proposed = F.col("hit") & ~ready
    return kept.select(
        "g",
        "k",
        "lo",
        "hi",
        F.when(proposed, first).otherwise(F.col("lo")).alias("from"),
        F.when(proposed, last).otherwise(F.col("hi")).alias("to"),
        ready.alias("ready"),
        "below",
    )
