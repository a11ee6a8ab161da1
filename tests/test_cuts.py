import pytest
from pyspark.sql import functions as F

from cohortspark.operators import cuts as cuts_module
from cohortspark.operators.cuts import cut_points, label_rows


def located(df, order, rank_map, stratum=None, **kw):
    return cut_points(df, order, lambda sizes: rank_map, stratum=stratum, **kw)


@pytest.mark.parametrize("bins", [3, 4096])
@pytest.mark.parametrize("rankable", [2, 10, 1_000_000])
def test_ranks_with_heavy_ties_match_a_full_sort(spark, monkeypatch, bins, rankable):
    monkeypatch.setattr(cuts_module, "BINS", bins)
    # A third of the rows share one time; ids are negative, zero and large.
    rows = [((7 if i % 3 == 0 else (i * 37) % 101), (i - 100) * 10**15) for i in range(300)]
    df = spark.createDataFrame(rows, "t bigint, id bigint").repartition(5)
    want = sorted(rows)
    ranks = [1, 2, 50, 99, 100, 101, 150, 299, 300]
    found = located(df, {"t": F.col("t"), "id": F.col("id")}, {None: ranks}, rankable=rankable)
    assert found.keys[None] == [want[r - 1] for r in ranks]
    assert found.sizes == {None: 300}


def test_text_ties_and_strata(spark):
    rows = [(s, 1, f"id-{s}-{i:04d}-é") for s in ("a", "b") for i in range(90)]
    df = spark.createDataFrame(rows, "s string, t bigint, id string")
    found = located(
        df, {"t": F.col("t"), "id": F.col("id")}, {"a": [10, 80], "b": [1]}, F.col("s"), rankable=3
    )
    assert [k[1] for k in found.keys["a"]] == ["id-a-0009-é", "id-a-0079-é"]
    assert found.keys["b"] == [(1, "id-b-0000-é")]


def test_identical_keys_still_terminate(spark):
    df = spark.createDataFrame([(5, "same")] * 50, "t bigint, id string")
    found = located(df, {"t": F.col("t"), "id": F.col("id")}, {None: [25]}, rankable=3)
    assert found.keys[None] == [(5, "same")]


def test_hex_key_is_narrowed_like_a_number(spark):
    rows = [(f"{(i * 2654435761) % (1 << 60):015x}", i) for i in range(400)]
    df = spark.createDataFrame(rows, "key string, tie bigint")
    found = located(df, {"key": F.col("key"), "tie": F.col("tie")}, {None: [1, 137, 400]}, rankable=2)
    want = sorted(rows)
    assert found.keys[None] == [want[0], want[136], want[399]]


def test_rank_zero_has_no_key_and_labels_follow_the_cuts(spark):
    df = spark.range(10).withColumnRenamed("id", "x")
    order = {"x": F.col("x")}
    found = located(df, order, {None: [0, 4]})
    assert found.keys[None] == [None, (3,)]
    out = label_rows(df, "band", order, found, ("a", "b", "c")).collect()
    assert [r["band"] for r in sorted(out)] == ["b"] * 4 + ["c"] * 6


def test_null_key_is_reported(spark):
    df = spark.createDataFrame([(1,), (None,)], "x bigint")
    with pytest.raises(ValueError, match="gap"):
        located(df, {"x": F.col("x")}, {None: [1]}, null_key="gap")


def test_labels_with_quotes_and_backslashes(spark):
    rows = [("o'b\\x", i) for i in range(4)] + [("plain", i) for i in range(4)]
    df = spark.createDataFrame(rows, "s string, x bigint")
    order = {"x": F.col("x")}
    found = located(df, order, {"o'b\\x": [1], "plain": [3]}, F.col("s"))
    out = label_rows(df, "band", order, found, (1, 2), stratum="s")
    counts = {(r["s"], r["band"]): r["count"] for r in out.groupBy("s", "band").count().collect()}
    assert counts == {("o'b\\x", 1): 1, ("o'b\\x", 2): 3, ("plain", 1): 3, ("plain", 2): 1}


def test_long_common_prefixes_are_narrowed_to_the_end(spark):
    rows = [("x" * 60 + f"{i:05d}",) for i in range(3000)]
    df = spark.createDataFrame(rows, "id string")
    seen = []
    rank_rest = cuts_module._rank_rest
    try:
        cuts_module._rank_rest = lambda keyed, d, n, searches, s: seen.extend(x.size for x in searches.values()) or rank_rest(keyed, d, n, searches, s)
        found = located(df, {"id": F.col("id")}, {None: [1500]}, rankable=100)
    finally:
        cuts_module._rank_rest = rank_rest
    assert found.keys[None] == [rows[1499]] and max(seen) <= 100
