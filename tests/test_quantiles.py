import numpy as np
import pytest

from cohortspark.operators.quantiles import exact_quantiles

QS = {"q0": 0.0, "q1": 0.1, "q5": 0.5, "q9": 0.9, "q10": 1.0}


@pytest.mark.parametrize("limit", [4, 40, 1_000_000])
def test_grouped_quantiles_match_numpy(spark, limit):
    rng = np.random.default_rng(1)
    data = {
        "ties": [3.5] * 200 + list(rng.normal(size=401)),
        "wide": list(np.exp(rng.normal(size=500) * 8)),
        "few": [1.0, 2.0, 10.0, 3.0],
    }
    rows = [(g, float(v)) for g, vs in data.items() for v in vs]
    rows += [("few", None), ("few", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    got = {r["g"]: r for r in exact_quantiles(df, ["g"], "v", QS, distinct_limit=limit).collect()}
    assert set(got) == set(data)
    for g, vs in data.items():
        for name, q in QS.items():
            assert got[g][name] == pytest.approx(np.quantile(vs, q), rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("limit", [10, 1_000_000])
def test_whole_table_quantiles(spark, limit):
    df = spark.range(1, 1002).selectExpr("cast(id * id as double) as v")
    row = exact_quantiles(df, [], "v", QS, distinct_limit=limit).first()
    assert row["q5"] == 501.0**2
    assert row["q1"] == pytest.approx(np.quantile(np.arange(1, 1002.0) ** 2, 0.1))


def test_many_large_groups_without_the_driver(spark, monkeypatch):
    """5,000 groups beyond the limit: no group, rank or value is collected or broadcast by name."""
    from pyspark.sql import DataFrame
    from pyspark.sql import functions as F

    rows = spark.range(60_000).select((F.col("id") % 5000).alias("g"), F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double").alias("v"))

    def refused(*_, **__):
        raise AssertionError("the driver must not see the groups")

    with monkeypatch.context() as m:
        for name in ("collect", "toPandas", "toLocalIterator"):
            m.setattr(DataFrame, name, refused)
        m.setattr(F, "broadcast", refused)
        found = exact_quantiles(rows, ["g"], "v", {"a": 0.5, "b": 0.25}, distinct_limit=6)
    pdf = rows.toPandas().groupby("g")["v"]
    got = found.toPandas().set_index("g").sort_index()
    assert len(got) == 5000
    assert np.allclose(got["a"], pdf.quantile(0.5).sort_index()) and np.allclose(got["b"], pdf.quantile(0.25).sort_index())


def test_a_sketch_that_misses_costs_a_round_only(spark, monkeypatch):
    """Brackets of the sketch that lie beside the rank: the part that holds it is searched instead."""
    from cohortspark.operators import quantiles

    monkeypatch.setattr(quantiles, "SLACK", -40)
    values = np.random.default_rng(3).normal(size=400)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    row = exact_quantiles(df, [], "v", {"q": 0.3}, distinct_limit=150).first()
    assert row["q"] == pytest.approx(np.quantile(values, 0.3), abs=1e-12)
