import random

import pytest
from pyspark.sql import functions as F

from cohortspark.operators import folds


def greedy(sizes, k):
    load = [0] * k
    for n in sorted(sizes, reverse=True):
        load[load.index(min(load))] += n
    return load


@pytest.mark.parametrize("seed", range(30))
def test_packing_size_classes_equals_one_by_one(seed):
    rng = random.Random(seed)
    k = rng.randint(2, 6)
    sizes = [rng.choice([1, 1, 2, 3, 7, 50, 400]) for _ in range(rng.randint(k, 300))]
    classes = {s: sizes.count(s) for s in set(sizes)}
    runs = folds.pack_size_classes(classes, k)
    load = [0] * k
    for size, m in classes.items():
        mine = sorted((start, cycle) for n, start, cycle in runs if n == size)
        assert len(mine) <= k
        for rank in range(m):
            start, cycle = [r for r in mine if r[0] <= rank][-1]
            load[cycle[(rank - start) % len(cycle)] - 1] += size
    assert load == greedy(sizes, k)


@pytest.fixture
def cohort(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"g{i % 23}", "ab"[i % 5 == 0]) for i in range(500)]
    return spark.createDataFrame(rows, "id bigint, grp string, cls string")


def test_group_folds_keep_groups_whole_and_balanced(cohort, monkeypatch):
    out = folds.group_kfold(cohort, "grp", 4)
    assert out.count() == 500
    assert out.groupBy("grp").agg(F.countDistinct("fold").alias("n")).where("n > 1").isEmpty()
    per_fold = {r["fold"]: r["count"] for r in out.groupBy("fold").count().collect()}
    sizes = [r["count"] for r in cohort.groupBy("grp").count().collect()]
    assert sorted(per_fold.values()) == sorted(greedy(sizes, 4))
    want = {r["id"]: r["fold"] for r in out.collect()}
    monkeypatch.setattr(folds, "RANKED_TOGETHER", 2)
    again = folds.group_kfold(cohort.repartition(7), "grp", 4)
    assert {r["id"]: r["fold"] for r in again.collect()} == want


def test_group_fold_errors(spark, cohort):
    with pytest.raises(ValueError, match="cannot fill"):
        folds.group_folds(cohort, "cls", 3)
    with pytest.raises(ValueError):
        folds.group_folds(cohort, "grp", 1)
    gap = spark.createDataFrame([(1, None), (2, "a"), (3, "b")], "id int, grp string")
    with pytest.raises(ValueError, match="missing"):
        folds.group_folds(gap, "grp", 2)


def test_five_folds_of_ten_groups(spark):
    df = spark.createDataFrame([(i, f"g{i // 4}") for i in range(40)], "id int, grp string")
    out = folds.group_kfold(df, "grp", 5)
    assert [r["count"] for r in out.groupBy("fold").count().collect()] == [8] * 5


def test_kfold_sizes(spark):
    out = folds.kfold(spark.range(13), "id", 5)
    counts = {r["fold"]: r["count"] for r in out.groupBy("fold").count().collect()}
    assert counts == {1: 3, 2: 3, 3: 3, 4: 2, 5: 2}
    with pytest.raises(ValueError):
        folds.kfold(spark.range(3), "id", 5)


def test_stratified_kfold_spreads_every_class(cohort):
    out = folds.stratified_kfold(cohort, "id", "cls", 4)
    for row in out.groupBy("cls", "fold").count().collect():
        assert row["count"] in ((100, 100) if row["cls"] == "a" else (25, 25))
    classes = cohort.sparkSession.createDataFrame([("a", 7), ("b", 5)], "stratum string, n bigint")
    ends = {r["stratum"]: r["ranks"] for r in folds.stratified_ranks(classes, 3).collect()}
    # a a a a a a a b b b b b dealt to folds 1 2 3 1 2 3 1 | 2 3 1 2 3
    assert ends == {"a": [3, 5], "b": [1, 3]}
