"""Train / validation / test assignment as a ``split`` column."""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.functions.keys import shuffle_key, time_order
from cohortspark.operators.cuts import cut_points, label_rows, label_strata, strata
from cohortspark.roles import SplitConfig
from cohortspark.session import materialize

TRAIN, VALIDATION, TEST, DEVELOPMENT = "train", "validation", "test", "development"
MOST_NAMED = 10  # labels in an error's text


def _require(df: DataFrame, *columns: str) -> None:
    for name in columns:
        if name not in df.columns:
            raise KeyError(f"column {name!r} is not in the table")


def _shuffled(seed: int, name: str) -> dict:
    return {"key": shuffle_key(seed, F.col(name)), "tie": F.col(name)}


def holdout_sizes(n: int, config: SplitConfig) -> tuple[int, int]:
    """Test and validation counts out of ``n`` rows or groups, both rounded up."""
    test = math.ceil(config.test_size * n)
    validation = math.ceil(config.relative_validation * (n - test))
    if n - test - validation < 1:
        raise ValueError(f"{n} rows or groups cannot fill three partitions")
    return test, validation


def group_split(df: DataFrame, group: str, config: SplitConfig | None = None) -> DataFrame:
    """Whole groups go to one partition; sizes are fractions of the groups.

    The split of a row is a function of its own group's key, so the cut found on
    the distinct groups is applied without joining anything back.
    """
    config = config or SplitConfig()
    _require(df, group)
    groups = df.select(group).distinct()
    order = _shuffled(config.seed, group)

    def ranks(sizes):
        n = sizes[None]
        if n < 3:
            raise ValueError(f"a group split needs at least 3 groups, found {n}")
        test, validation = holdout_sizes(n, config)
        return {None: [test, test + validation]}

    cuts = cut_points(groups, order, ranks, null_key="group labels contain missing values")
    return label_rows(df, "split", order, cuts, (TEST, VALIDATION, TRAIN))


def random_split(df: DataFrame, id: str, config: SplitConfig | None = None) -> DataFrame:
    config = config or SplitConfig()
    _require(df, id)
    order = _shuffled(config.seed, id)

    def ranks(sizes):
        if sizes[None] == 0:
            raise ValueError("cannot split a table without rows")
        test, validation = holdout_sizes(sizes[None], config)
        return {None: [test, test + validation]}

    cuts = cut_points(df, order, ranks, null_key="row ids contain missing values")
    return label_rows(df, "split", order, cuts, (TEST, VALIDATION, TRAIN))


def proportional_quotas(counts: DataFrame, total: int, name: str) -> DataFrame:
    """``counts`` (stratum, n, ...) with the stratum's part of ``total``, by largest remainder (ties: smaller label).

    The strata that get one more are those up to a cut in the order of their remainders, found like any other cut.
    """
    n = counts.agg(F.sum("n")).first()[0] or 0
    share = F.col("n") * F.lit(total) / F.lit(n)
    shared = materialize(counts.withColumn("__share", share).withColumn(name, F.floor("__share").cast("bigint")), "shares")
    spare = total - shared.agg(F.sum(name)).first()[0]
    order = {"gap": F.col(name) - F.col("__share"), "tie": F.col("stratum")}
    cuts = cut_points(shared, order, lambda _: {None: [spare]})
    more = label_rows(shared, "__more", order, cuts, (1, 0))
    return materialize(more.select(*counts.columns, (F.col(name) + F.col("__more")).cast("bigint").alias(name)), "quotas")


def stratified_split(
    df: DataFrame, id: str, target: str, config: SplitConfig | None = None
) -> DataFrame:
    """Each class is spread over the partitions in proportion to its size."""
    config = config or SplitConfig()
    _require(df, id, target)
    order = _shuffled(config.seed, id)

    classes = strata(df, target, order["key"], null_key="row ids contain missing values")
    if not classes.where("stratum is null").isEmpty():
        raise ValueError("cannot stratify on a missing target")
    small = sorted(r["stratum"] for r in classes.where("n < 2").limit(MOST_NAMED).collect())
    if small:
        raise ValueError(f"classes with fewer than 2 rows: {small}")
    total, many = classes.agg(F.sum("n"), F.count("n")).first()
    test, validation = holdout_sizes(total or 0, config)
    if min(test, validation) < many:
        raise ValueError("a partition would be smaller than the number of classes")
    first = proportional_quotas(classes, test, "test")
    rest = proportional_quotas(first.select("stratum", (F.col("n") - F.col("test")).alias("n"), "test"), validation, "validation")
    whole = F.col("n") + F.col("test")
    ranks = rest.select("stratum", whole.alias("n"), F.array("test", F.col("test") + F.col("validation")).alias("ranks"))
    return label_strata(df, "split", order, ranks, (TEST, VALIDATION, TRAIN), target)


def holdout_split(
    df: DataFrame,
    column: str,
    level: Any,
    group: str,
    *,
    validation_fraction: float = 0.2,
    seed: int = 42,
    crossing: str = "keep",
) -> DataFrame:
    """All rows of one metadata level are the test set; the rest is split by group.

    Rows whose level is missing stay in development. ``crossing="drop"`` leaves out the development rows of groups
    that have rows of the level too, so that no group is on both sides.
    """
    _require(df, column, group)
    if crossing not in ("keep", "drop"):
        raise ValueError(f"crossing must be 'keep' or 'drop', got {crossing!r}")
    if not 0 < validation_fraction < 1:
        raise ValueError("validation_fraction must lie strictly between 0 and 1")
    held_out = F.col(column).eqNullSafe(F.lit(level))
    if df.where(held_out).isEmpty():
        raise ValueError(f"no rows have {column} = {level!r}")
    if crossing == "drop":
        out = df.where(held_out).select(F.col(group).alias("__held")).distinct()
        inside = df.where(~held_out).join(out, F.col(group) == F.col("__held"), "left_anti")
        df = inside.unionByName(df.where(held_out))
    groups = df.where(~held_out).select(group).distinct()
    order = _shuffled(seed, group)

    def ranks(sizes):
        if sizes[None] < 3:
            raise ValueError("the development rows hold fewer than three groups")
        return {None: [math.ceil(validation_fraction * sizes[None])]}

    cuts = cut_points(groups, order, ranks, null_key="group labels contain missing values")
    inner = label_rows(df, "split", order, cuts, (VALIDATION, TRAIN))
    return inner.withColumn("split", F.when(held_out, F.lit(TEST)).otherwise(F.col("split")))


def leave_one_level_out(
    df: DataFrame,
    id: str,
    column: str,
    group: str,
    *,
    validation_fraction: float = 0.2,
    seed: int = 42,
) -> DataFrame:
    """The holdout split for every level of ``column``, as ``(level, id, split)`` rows.

    All levels share two jobs: a group belongs to the development part of level L
    when it has a row outside L, and the cuts of all levels are searched together.
    """
    _require(df, id, column, group)
    pairs = df.select(F.col(group).alias("g"), F.col(column).alias("own")).distinct()
    levels = [r["own"] for r in pairs.where("own is not null").select("own").distinct().collect()]
    if not levels:
        raise ValueError(f"{column} has no levels")
    held = F.explode(F.array(*[F.lit(v) for v in sorted(levels)])).alias("level")
    development = (
        pairs.select("g", "own", held).where(~F.col("own").eqNullSafe(F.col("level"))).select("level", "g").distinct()
    )
    development = materialize(development, "development")
    order = {"key": shuffle_key(seed, F.col("g")), "tie": F.col("g")}
    sizes = strata(development, "level", order["key"], null_key="group labels contain missing values")
    every = pairs.where("own is not null").select(F.col("own").alias("__level")).distinct()
    sized = every.join(sizes, F.col("__level") == F.col("stratum"), "left").select("__level", F.coalesce("n", F.lit(0)).alias("n"))
    short = sorted(str(r["__level"]) for r in sized.where("n < 3").limit(MOST_NAMED).collect())
    if short:
        raise ValueError(f"fewer than three development groups without {short}")
    quota = F.ceil(F.lit(validation_fraction) * F.col("n")).cast("bigint")
    ranks = sizes.select("stratum", "n", F.array(quota).alias("ranks"))
    rows = df.select(F.col(id), F.col(group).alias("g"), F.col(column).alias("own"), held)
    inner = label_strata(rows, "split", order, ranks, (VALIDATION, TRAIN), "level", ranked=development)
    label = F.when(F.col("own").eqNullSafe(F.col("level")), F.lit(TEST)).otherwise(F.col("split"))
    return inner.select("level", id, label.alias("split"))


def _half_even(x: float) -> int:
    return int(round(x))


def forward_split(
    df: DataFrame,
    id: str,
    time: str,
    *,
    validation_fraction: float = 0.2,
    test_fraction: float = 0.2,
) -> DataFrame:
    """The newest rows are test, the block before them validation; missing times are newest."""
    _require(df, id, time)
    if min(validation_fraction, test_fraction) <= 0 or validation_fraction + test_fraction >= 1:
        raise ValueError("split fractions must be positive and sum to less than 1")
    when = time_order(F.col(time), df.schema[time].dataType)
    kind = df.select(when.alias("t")).schema["t"].dataType.simpleString()
    order = {
        "late": F.when(when.isNull(), 1).otherwise(0).cast("bigint"),
        "time": F.coalesce(when, F.lit("" if kind == "string" else 0).cast(kind)),
        "tie": F.col(id),
    }

    def ranks(sizes):
        n = sizes[None]
        test = max(1, _half_even(n * test_fraction))
        validation = max(1, _half_even(n * validation_fraction))
        return {None: [max(0, n - validation - test), max(0, n - test)]}

    cuts = cut_points(df, order, ranks)
    return label_rows(df, "split", order, cuts, (TRAIN, VALIDATION, TEST))


def _parsed_time(df: DataFrame, time: str):
    """Time in its order; text is parsed leniently, so NULL means missing or unparseable."""
    dtype = df.schema[time].dataType
    if isinstance(dtype, T.StringType):
        return F.unix_micros(F.try_to_timestamp(F.col(time)))
    return time_order(F.col(time), dtype)


def temporal_split(
    df: DataFrame, id: str, time: str, *, test_fraction: float = 0.2, group: str | None = None
) -> DataFrame:
    """Development rows come before test rows, by row or by whole groups.

    With ``group``, the groups observed last form the test set; rows without a
    group stay in development.
    """
    _require(df, id, time, *([group] if group else []))
    if not 0 < test_fraction < 1:
        raise ValueError("test_fraction must lie strictly between 0 and 1")
    micros = _parsed_time(df, time)

    def ranks(sizes):
        n = sizes[None]
        return {None: [max(0, n - max(1, math.ceil(n * test_fraction)))]}

    unparseable = "the time column has missing or unparseable values"
    if group is None:
        order = {"time": micros, "tie": F.col(id)}
        cuts = cut_points(df, order, ranks, null_key=unparseable)
        return label_rows(df, "split", order, cuts, (DEVELOPMENT, TEST))

    if not df.where(micros.isNull()).isEmpty():
        raise ValueError(unparseable)
    last = (
        df.where(F.col(group).isNotNull()).groupBy(group).agg(F.max(micros).alias("last_seen"))
    )
    order = {"time": F.col("last_seen"), "tie": F.col(group)}
    cuts = cut_points(last, order, ranks)
    labelled = label_rows(last, "split", order, cuts, (DEVELOPMENT, TEST)).select(group, "split")
    # AQE picks the join by the measured size and splits a hot group.
    newest = labelled.where(F.col("split") == TEST)
    joined = df.join(newest, group, "left")
    return joined.withColumn("split", F.coalesce("split", F.lit(DEVELOPMENT))).select(*df.columns, "split")


def split_table(df: DataFrame, id: str, *, target: str | None, group: str | None, config: SplitConfig, task: str) -> DataFrame:
    """The default policy: by group if there is one, else stratified for classification, else random."""
    if group is not None:
        return group_split(df, group, config)
    if config.stratify and target is not None and task == "classification":
        return stratified_split(df, id, target, config)
    return random_split(df, id, config)
