import datetime as dt
import hashlib
import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.operators import cuts, folds, splits
from cohortspark.roles import SplitConfig


def sizes(df, column="split"):
    return {r[column]: r["count"] for r in df.groupBy(column).count().collect()}


def assignment(df, id="id", column="split"):
    return {r[id]: r[column] for r in df.select(id, column).collect()}


@pytest.fixture
def cohort(spark):
    rows = [(i, f"g{i % 40}" if i % 3 else "hot", "xyz"[i % 7 % 3], i % 11) for i in range(600)]
    return spark.createDataFrame(rows, "id bigint, grp string, cls string, x bigint")


def test_groups_never_cross_and_sizes_are_rounded_up(cohort):
    out = splits.group_split(cohort, "grp", SplitConfig(seed=3))
    per_group = out.groupBy("grp").agg(F.countDistinct("split").alias("n"), F.first("split").alias("s")).collect()
    assert all(r["n"] == 1 for r in per_group)
    groups = len(per_group)
    test = math.ceil(0.2 * groups)
    counts = {s: sum(r["s"] == s for r in per_group) for s in ("train", "validation", "test")}
    assert counts["test"] == test
    assert counts["validation"] == math.ceil(0.25 * (groups - test))


def test_thirty_rows_of_ten_groups(spark):
    df = spark.createDataFrame([(i, f"g{i // 3}", i % 2) for i in range(30)], "id int, grp string, target int")
    assert sizes(splits.group_split(df, "grp")) == {"test": 6, "validation": 6, "train": 18}


def test_group_errors(spark):
    two = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, grp string")
    with pytest.raises(ValueError, match="at least 3 groups"):
        splits.group_split(two, "grp")
    gap = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "c")], "id int, grp string")
    with pytest.raises(ValueError, match="missing"):
        splits.group_split(gap, "grp")
    with pytest.raises(KeyError):
        splits.group_split(two, "absent")


@pytest.mark.parametrize("bad", [(0.0, 0.2), (0.2, 1.0), (0.6, 0.4)])
def test_config_bounds(bad):
    with pytest.raises(ValueError):
        SplitConfig(*bad)


def test_random_split_sizes_and_errors(spark, cohort):
    assert sizes(splits.random_split(cohort, "id")) == {"test": 120, "validation": 120, "train": 360}
    with pytest.raises(ValueError):
        splits.random_split(cohort.limit(0), "id")


def test_stratified_split_keeps_class_shares(spark, cohort):
    out = splits.stratified_split(cohort, "id", "cls")
    assert sizes(out) == {"test": 120, "validation": 120, "train": 360}
    whole = sizes(cohort, "cls")
    for cls, n in sizes(out.where("split = 'test'"), "cls").items():
        assert abs(n - 0.2 * whole[cls]) <= 1
    rare = spark.createDataFrame([(i, "a" if i else "b") for i in range(20)], "id int, cls string")
    with pytest.raises(ValueError, match="fewer than 2"):
        splits.stratified_split(rare, "id", "cls")


def test_quotas_are_largest_remainder(spark):
    def quotas(counts, total):
        table = splits.proportional_quotas(spark.createDataFrame(list(counts.items()), "stratum string, n bigint"), total, "q")
        return {r["stratum"]: r["q"] for r in table.collect()}

    assert quotas({"a": 5, "b": 5, "c": 5}, 4) == {"a": 2, "b": 1, "c": 1}
    assert quotas({"a": 4, "b": 8}, 3) == {"a": 1, "b": 2}
    assert sum(quotas({"a": 7, "b": 2, "c": 91}, 33).values()) == 33


def test_level_holdout(spark):
    rows = [(i, "A" if i < 12 else "B", f"g{i}", i % 2) for i in range(18)] + [(18, None, "g18", 0)]
    df = spark.createDataFrame(rows, "id int, study string, grp string, target int")
    got = assignment(splits.holdout_split(df, "study", "B", "grp"))
    assert {i for i, s in got.items() if s == "test"} == set(range(12, 18))
    assert sum(s == "validation" for s in got.values()) == math.ceil(0.2 * 13)
    assert got[18] != "test" and len(got) == 19
    with pytest.raises(ValueError, match="no rows"):
        splits.holdout_split(df, "study", "C", "grp")
    with pytest.raises(KeyError):
        splits.holdout_split(df, "nothing", "B", "grp")
    with pytest.raises(ValueError, match="three groups"):
        splits.holdout_split(df.where("id < 2 or study = 'B'"), "study", "B", "grp").collect()


def test_every_level_in_turn_equals_single_holdouts(spark):
    rows = [(i, "ABC"[i % 3], f"g{i % 10}") for i in range(60)]
    df = spark.createDataFrame(rows, "id int, study string, grp string")
    long = splits.leave_one_level_out(df, "id", "study", "grp")
    for level in "ABC":
        one = assignment(splits.holdout_split(df, "study", level, "grp"))
        assert assignment(long.where(F.col("level") == level)) == one


def test_forward_split_orders_time(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate((3, 1, 4, 2, 5))], "id int, time int")
    out = splits.forward_split(df, "id", "time", validation_fraction=0.2, test_fraction=0.2)
    assert {r["time"]: r["split"] for r in out.collect()} == {
        1: "train", 2: "train", 3: "train", 4: "validation", 5: "test"
    }
    with pytest.raises(ValueError):
        splits.forward_split(df, "id", "time", validation_fraction=0.5, test_fraction=0.5)


def test_forward_split_rounds_half_to_even_and_puts_missing_last(spark):
    # 0.5 of 5 rows is 2.5, which rounds to 2; 0.1 of 5 rounds to 0 and is raised to 1.
    df = spark.createDataFrame([(i, i if i else None) for i in range(5)], "id int, time int")
    got = assignment(splits.forward_split(df, "id", "time", validation_fraction=0.1, test_fraction=0.5))
    assert got == {1: "train", 2: "train", 3: "validation", 4: "test", 0: "test"}


def test_temporal_split_by_row_and_group(spark):
    day = dt.date(2024, 1, 1)
    rows = [(i, f"g{i % 5}", str(day + dt.timedelta(days=i))) for i in range(10)]
    df = spark.createDataFrame(rows, "id int, grp string, seen string")
    got = assignment(splits.temporal_split(df, "id", "seen", test_fraction=0.25))
    assert {i for i, s in got.items() if s == "test"} == {7, 8, 9}
    by_group = assignment(splits.temporal_split(df, "id", "seen", test_fraction=0.3, group="grp"))
    assert {i for i, s in by_group.items() if s == "test"} == {3, 8, 4, 9}
    broken = df.withColumn("seen", F.when(F.col("id") == 2, "soon").otherwise(F.col("seen")))
    for group in (None, "grp"):
        with pytest.raises(ValueError, match="unparseable"):
            splits.temporal_split(broken, "id", "seen", group=group)


def test_rows_without_group_stay_in_development(spark):
    rows = [(1, "a", 1), (2, "b", 2), (3, None, 99)]
    df = spark.createDataFrame(rows, "id int, grp string, t bigint")
    got = assignment(splits.temporal_split(df, "id", "t", group="grp"))
    assert got == {1: "development", 2: "test", 3: "development"}


SPLITTERS = {
    "group": lambda df: splits.group_split(df, "grp"),
    "random": lambda df: splits.random_split(df, "id"),
    "stratified": lambda df: splits.stratified_split(df, "id", "cls"),
    "holdout": lambda df: splits.holdout_split(df, "cls", "x", "grp"),
    "forward": lambda df: splits.forward_split(df, "id", "x"),
    "temporal": lambda df: splits.temporal_split(df, "id", "x"),
    "temporal_group": lambda df: splits.temporal_split(df, "id", "x", group="grp"),
}


@pytest.mark.parametrize("name", SPLITTERS)
def test_layout_and_search_depth_do_not_matter(cohort, monkeypatch, name):
    split = SPLITTERS[name]
    want = assignment(split(cohort.repartition(1)))
    assert assignment(split(cohort.repartition(17, "x"))) == want
    monkeypatch.setattr(cuts, "RANKABLE", 5)
    monkeypatch.setattr(cuts, "BINS", 8)
    assert assignment(split(cohort)) == want


def test_assigning_rows_needs_no_shuffle(cohort):
    for name in ("group", "random", "forward"):
        plan = SPLITTERS[name](cohort)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan
    plan = SPLITTERS["stratified"](cohort)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan  # rows meet a small table of cuts


def reference_shares(rows, seed=42):
    """Split of every (id, class) by largest remainders and the hash order, in memory."""
    counts = Counter(c for _, c in rows)

    def quotas(n, total):
        share = {c: m * total / sum(n.values()) for c, m in n.items()}
        out = {c: math.floor(x) for c, x in share.items()}
        for c in sorted(n, key=lambda c: (out[c] - share[c], c))[: total - sum(out.values())]:
            out[c] += 1
        return out

    test, validation = splits.holdout_sizes(len(rows), SplitConfig())
    first = quotas(counts, test)
    second = quotas({c: n - first[c] for c, n in counts.items()}, validation)
    by_class, got = defaultdict(list), {}
    for i, c in rows:
        by_class[c].append((hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:15], i))
    for c, own in by_class.items():
        for r, (_, i) in enumerate(sorted(own)):
            got[i] = "test" if r < first[c] else "validation" if r < first[c] + second[c] else "train"
    return got


def reference_folds(rows, k, seed=42):
    order = sorted(rows, key=lambda x: (x[1], hashlib.md5(f"{seed}:{x[0]}".encode()).hexdigest()[:15], x[0]))
    start, got, counts = 0, {}, Counter(c for _, c in rows)
    at = 0
    for c in sorted(counts):
        n, per_fold = counts[c], [0] * k
        for i in range(k):
            per_fold[(start + i) % k] = n // k + (1 if i < n % k else 0)
        for f, m in enumerate(per_fold):
            for i, _ in order[at : at + m]:
                got[i] = f + 1
            at += m
        start += n
    return got


@pytest.mark.parametrize(("classes", "together"), [(3, 2000), (7, 3), (10_000, 2000)])
def test_any_number_of_strata(spark, monkeypatch, classes, together):
    """One class holds a third of the rows, the others few each."""
    monkeypatch.setattr(cuts, "ROWS_TOGETHER", together)
    n = 6 * max(classes, 100)
    rows = [(i, f"c{0 if i % 3 == 0 else i % classes:05d}") for i in range(n)]
    df = spark.createDataFrame(rows, "id bigint, cls string").repartition(5)
    assert assignment(splits.stratified_split(df, "id", "cls")) == reference_shares(rows)
    assert assignment(folds.stratified_kfold(df, "id", "cls", 4), column="fold") == reference_folds(rows, 4)


def test_strata_stay_off_the_driver(spark, monkeypatch):
    """Neither classes nor cuts are collected: whatever comes to the driver is a total or one cut of the order of remainders."""
    seen = []
    collect = DataFrame.collect

    def watched(self):
        out = collect(self)
        seen.append(len(out))
        return out

    monkeypatch.setattr(DataFrame, "collect", watched)
    df = spark.range(30_000).select("id", (F.col("id") % 5000).alias("cls"))
    out = splits.stratified_split(df, "id", "cls")
    kept = folds.stratified_kfold(df, "id", "cls", 5)
    assert max(seen, default=0) <= 2
    assert sizes(out) == {"test": 6000, "validation": 6000, "train": 18_000}
    assert sizes(kept, "fold") == dict.fromkeys(range(1, 6), 6000)


@pytest.mark.parametrize("kind", ["double", "decimal(12,3)", "string", "date", "timestamp", "smallint"])
@pytest.mark.parametrize("rankable", [3, 200_000])
def test_any_sortable_time_column(spark, monkeypatch, kind, rankable):
    monkeypatch.setattr(cuts, "RANKABLE", rankable)
    monkeypatch.setattr(cuts, "BINS", 16)
    step = F.col("id") * 7919 % 97
    times = {
        "double": F.when(F.col("id") % 10 == 0, float("nan")).otherwise((step - 40) / 16.0),
        "decimal(12,3)": (step - 40) / 8,
        "string": F.concat(F.lit("t"), F.lpad(step.cast("string"), 3, "0")),
        "date": F.date_add(F.lit("2020-01-01").cast("date"), step.cast("int")),
        "timestamp": F.timestamp_seconds(step * 3600),
        "smallint": step,
    }
    df = spark.range(90).withColumn("t", times[kind].cast(kind))
    got = assignment(splits.forward_split(df, "id", "t"))
    pdf = df.toPandas()
    order = list(pdf.sort_values(["t", "id"], na_position="last")["id"])
    assert [got[i] for i in order] == ["train"] * 54 + ["validation"] * 18 + ["test"] * 18


def test_unsortable_time_is_an_error(spark):
    with pytest.raises(TypeError, match="order rows"):
        splits.forward_split(spark.range(5).withColumn("t", F.array("id")), "id", "t")
