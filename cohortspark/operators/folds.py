"""Cross-validation folds as an INT ``fold`` column starting at 1."""

from __future__ import annotations

from functools import reduce
from itertools import accumulate
from operator import add

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.functions.keys import hash_bucket, shuffle_key
from cohortspark.operators.cuts import cut_points, label_rows, label_strata, running_total, strata
from cohortspark.operators.splits import _require, _shuffled
from cohortspark.session import materialize

RANKED_TOGETHER = 200_000


def _check_k(k: int) -> None:
    if k < 2:
        raise ValueError("at least 2 folds are needed")


def _labels(k: int) -> tuple[int, ...]:
    return tuple(range(1, k + 1))


def kfold(df: DataFrame, id: str, k: int = 5, *, seed: int = 42) -> DataFrame:
    """Shuffled folds whose sizes differ by at most one, the larger ones first."""
    _check_k(k)
    _require(df, id)
    order = _shuffled(seed, id)

    def ranks(sizes):
        n = sizes[None]
        if n < k:
            raise ValueError(f"{n} rows cannot fill {k} folds")
        per_fold = [n // k + (1 if i < n % k else 0) for i in range(k)]
        return {None: list(accumulate(per_fold))[:-1]}

    cuts = cut_points(df, order, ranks, null_key="row ids contain missing values")
    return label_rows(df, "fold", order, cuts, _labels(k))


def stratified_ranks(classes: DataFrame, k: int) -> DataFrame:
    """``(stratum, n, ranks)``: the class-sorted rows are dealt round-robin over the folds; ranks end the folds 1 to k - 1."""
    dealt = running_total(classes, "stratum", "n", "start")
    turn = F.pmod(F.col("start"), F.lit(k))
    per_fold = [
        F.floor(F.col("n") / k) + F.when(F.pmod(F.lit(f) - turn, F.lit(k)) < F.pmod(F.col("n"), F.lit(k)), 1).otherwise(0)
        for f in range(k)
    ]
    ends = [reduce(add, per_fold[: f + 1]).cast("bigint") for f in range(k - 1)]
    return dealt.select("stratum", "n", F.array(*ends).alias("ranks"))


def stratified_kfold(df: DataFrame, id: str, target: str, k: int = 5, *, seed: int = 42) -> DataFrame:
    """Every class is spread evenly over the folds, in shuffled order."""
    _check_k(k)
    _require(df, id, target)
    order = _shuffled(seed, id)
    classes = strata(df, target, order["key"], null_key="row ids contain missing values")
    if not classes.where("stratum is null").isEmpty():
        raise ValueError("cannot stratify on a missing target")
    if classes.where(F.col("n") >= k).isEmpty():
        raise ValueError(f"every class has fewer than {k} rows")
    ranks = materialize(stratified_ranks(classes, k), "ranks")
    return label_strata(df, "fold", order, ranks, _labels(k), target)


def pack_size_classes(class_counts: dict[int, int], k: int) -> list[tuple[int, int, list[int]]]:
    """Largest-first packing of groups into ``k`` folds, on the histogram of group sizes.

    Groups of equal size are interchangeable, so a run of them visits the folds in
    a repeating cycle until a further fold becomes light enough to join.  Returns
    ``(size, groups placed before this run, cycle of folds)``; a size class has at
    most ``k`` runs, however many groups it holds.
    """
    load = [0] * k
    runs = []
    for size in sorted(class_counts, reverse=True):
        total, placed = class_counts[size], 0
        while placed < total:
            ranked = sorted(range(k), key=lambda f: (load[f], f))
            floor = load[ranked[0]]
            cycle = [f for f in ranked if load[f] < floor + size]
            take = total - placed
            if len(cycle) < k:
                rounds = (load[ranked[len(cycle)]] - floor) // size
                take = min(take, rounds * len(cycle))
            runs.append((size, placed, [f + 1 for f in cycle]))
            full, part = divmod(take, len(cycle))
            for i, f in enumerate(cycle):
                load[f] += size * (full + (1 if i < part else 0))
            placed += take
    return runs


def group_folds(df: DataFrame, group: str, k: int = 5, *, seed: int = 42) -> DataFrame:
    """``(group, n_rows, fold)``: balanced folds of whole groups, biggest groups placed first.

    Only the histogram of group sizes reaches the driver (at most sqrt(2 * rows)
    distinct sizes); the groups themselves are numbered inside their size class by
    a window over hash buckets plus bucket offsets.
    """
    _check_k(k)
    _require(df, group)
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n_rows"))
    histogram = (
        sizes.groupBy("n_rows")
        .agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col(group).isNull()).alias("nulls"))
        .collect()
    )
    if any(r["nulls"] for r in histogram):
        raise ValueError("group labels contain missing values")
    n_groups = sum(r["groups"] for r in histogram)
    if n_groups < k:
        raise ValueError(f"{n_groups} groups cannot fill {k} folds")
    runs = pack_size_classes({r["n_rows"]: r["groups"] for r in histogram}, k)

    keyed = sizes.withColumn("key", shuffle_key(seed, F.col(group)))
    keyed = keyed.withColumn("bucket", hash_bucket(F.col("key"), n_groups, RANKED_TOGETHER))
    within = Window.partitionBy("n_rows", "bucket").orderBy("key", group)
    ranked = keyed.withColumn("rank", F.row_number().over(within) - 1)
    if n_groups > RANKED_TOGETHER:
        earlier = Window.partitionBy("n_rows").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        offsets = (
            keyed.groupBy("n_rows", "bucket")
            .agg(F.count(F.lit(1)).alias("m"))
            .withColumn("before", F.coalesce(F.sum("m").over(earlier), F.lit(0)))
            .drop("m")
        )
        ranked = ranked.join(offsets, ["n_rows", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
    spark = df.sparkSession
    table = spark.createDataFrame(runs, "n_rows bigint, start bigint, cycle array<int>")
    table = table.groupBy("n_rows").agg(
        F.reverse(F.array_sort(F.collect_list(F.struct("start", "cycle")))).alias("runs")
    )
    placed = ranked.join(table, "n_rows").withColumn(
        "run", F.filter("runs", lambda r: r["start"] <= F.col("rank"))[0]
    )
    step = F.expr("cast((rank - run.start) % size(run.cycle) as int)")
    return placed.select(group, "n_rows", F.get("run.cycle", step).alias("fold"))


def group_kfold(df: DataFrame, group: str, k: int = 5, *, seed: int = 42) -> DataFrame:
    folds = group_folds(df, group, k, seed=seed).drop("n_rows")
    return df.join(folds, group).select(*df.columns, "fold")


def fold_table(df: DataFrame, id: str, *, target: str, group: str | None, task: str, k: int, seed: int = 42) -> DataFrame:
    """Default policy: groups first, then classes, then plain rows."""
    if group is not None:
        return group_kfold(df, group, k, seed=seed)
    if task == "classification":
        return stratified_kfold(df, id, target, k, seed=seed)
    return kfold(df, id, k, seed=seed)
