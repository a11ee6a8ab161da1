import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cohortspark.operators import align, audit
from cohortspark.roles import BenchmarkDefinition, Cohort, Roles
from cohortspark.sources.manifests import load_definition


def test_report_of_a_table_with_several_faults(spark):
    """Five visits of three animals: one id three times, two unknown doses, one of them as NaN."""
    visits = spark.sql(
        "select * from values ('v7', 'rat', 2.5D, null), ('v7', 'rat', null, 1), ('v7', 'mouse', double('NaN'), 2), "
        "('v8', 'mouse', 0.5D, 3), ('v9', 'hen', 4.0D, 4) as t(visit, animal, dose, weight)"
    )
    row = audit.integrity_report(visits, target="dose", id="visit", group="animal").first()
    assert row["duplicate_ids"] == 2 and row["target_missing"] == 2 and row["n_groups"] == 3
    assert (row["n_rows"], row["n_features"]) == (5, 3) and row["missing_fraction"] == pytest.approx(3 / 20)
    assert row["warnings"] == ["WARNING duplicate_ids=2", "ERROR target_missing=2"] and not row["ok"]
    assert audit.integrity_report(visits.where("visit > 'v7'"), target="dose", id="visit", group="animal").first()["ok"]


def test_report_of_absent_columns_and_missing_ids(spark):
    df = spark.createDataFrame([(None, 1.0), (None, float("nan")), ("a", 2.0)], "k string, v double")
    row = audit.integrity_report(df, target="y", id="k", group="g").first()
    assert row["duplicate_ids"] == 1  # two missing ids equal each other
    assert row["target_missing"] == 3 and row["n_groups"] == 3
    assert row["missing_fraction"] == pytest.approx(0.5)
    assert row["warnings"] == [
        "ERROR target_column_absent",
        "WARNING duplicate_ids=1",
        "ERROR target_missing=3",
        "WARNING missing_fraction_high",
        "ERROR group_column_absent",
    ]
    clean = spark.createDataFrame([("a", 1), ("b", 2)], "k string, y int")
    report = audit.integrity_report(clean, target="y", id="k").first()
    assert report["ok"] and report["warnings"] == ["WARNING no_group_column"]


def test_report_of_an_empty_table(spark):
    df = spark.createDataFrame([], "k string, y int")
    row = audit.integrity_report(df, target="y", id="k").first()
    assert (row["n_rows"], row["duplicate_ids"], row["target_missing"]) == (0, 0, 0)


def test_cages_on_both_sides_of_a_boundary(spark):
    """Unknown cages are no overlap, and a table without the column has none."""
    cages = spark.range(40).select((F.col("id") % 12).alias("cage"), F.when(F.col("id") % 5 != 0, F.col("id") % 12).alias("seen"))
    early, late = cages.where("cage < 7"), cages.where("cage >= 5")
    for column, shared in (("cage", 2), ("seen", 2)):
        with pytest.raises(AssertionError, match=f"{shared} groups"):
            audit.require_no_group_overlap(early, late, column)
        assert audit.group_intersect(early, late, column).count() == shared
        audit.require_no_group_overlap(early, late.where("cage > 6"), column)
    for name in (None, "rack"):
        audit.require_no_group_overlap(early, late, name)


def test_definition_needs_its_columns_filled(spark):
    definition = BenchmarkDefinition("mi", "1", "classification", "target", "animal", "animal_id")
    df = spark.createDataFrame([(0, "a"), (1, "b")], "target int, animal_id string")
    audit.require_definition_fits(df, definition)
    with pytest.raises(ValueError, match="missing columns"):
        audit.require_definition_fits(df.drop("target"), definition)
    holes = df.withColumn("target", F.when(F.col("target") == 1, 1))
    with pytest.raises(ValueError, match="target"):
        audit.require_definition_fits(holes, definition)
    with pytest.raises(ValueError, match="2 in animal_id"):
        audit.require_definition_fits(df.withColumn("animal_id", F.lit(None).cast("string")), definition)


def test_definition_files(spark, scratch):
    def loaded(name, text):
        Path(f"{scratch}/{name}.json").write_text(text)
        return load_definition(spark, f"{scratch}/{name}.json")

    whole = {k: f"<{k}>" for k in ("benchmark_id", "target", "split_policy", "group_key")} | {"version": 3, "task": "detection"}
    found = loaded("whole", json.dumps({**whole, "metrics": ["ece"], "unknown": 1}))
    assert (found.version, found.metrics, found.modalities, found.test_labels_private) == ("3", ("ece",), (), False)
    with pytest.raises(ValueError, match="missing target, missing group_key"):
        loaded("holes", json.dumps({k: v for k, v in whole.items() if k not in ("target", "group_key")}))
    with pytest.raises(ValueError, match="unknown task"):
        loaded("task", json.dumps({**whole, "task": "guessing"}))
    with pytest.raises(ValueError, match="exactly one"):
        loaded("two", json.dumps([whole, whole]))


def test_gates(spark):
    df = spark.createDataFrame([(1, "a", "train"), (2, "a", "test"), (2, "b", None), (3, "b", "test")], "id int, g string, split string")
    got = {r["gate"]: r["violations"] for r in audit.protocol_gates(df, id="id", group="g").collect()}
    assert got == {"row_in_one_partition": 1, "every_row_assigned": 1, "group_in_one_partition": 1}
    with pytest.raises(AssertionError):
        audit.require_gates(df, id="id", group="g")


def test_required_columns_and_conditions(spark):
    df = spark.createDataFrame([("MI",), ("sham",), ("MI-E",), (None,)], "c string")
    assert audit.missing_required_columns(df, ["c", "study_id"]) == ["study_id"]
    assert [r["c"] for r in audit.condition_filter(df, "c", ["MI", "sham"], ["MI-E"]).collect()] == ["MI", "sham"]
    with pytest.raises(ValueError):
        audit.condition_filter(df, "c", ["MI"], ["MI"])


def test_roles(spark):
    df = spark.createDataFrame([(1, "g", 0.5, True, "t", 1)], "sample_id int, group_id string, x double, b boolean, c string, y int")
    roles = Roles("sample_id", "y", "group_id")
    assert Cohort(df, roles).view("feature").columns == ["x", "b", "c"]
    assert Cohort(df, roles).view("group", "time", "target").columns == ["group_id", "y"]
    with pytest.raises(KeyError):
        Cohort(df, Roles("sample_id", "absent"))
    with pytest.raises(ValueError):
        Cohort(df.limit(0), roles)
    noted = roles.annotate(df).schema
    assert noted["y"].metadata == {"role": "target", "modality": "tabular"} and noted["x"].metadata["role"] == "feature"
    with pytest.raises(ValueError, match="audio"):
        Roles("sample_id", "y", modality="audio")


def test_alignment(spark):
    a = spark.createDataFrame([("s1", 50), ("s2", 60)], "sample_id string, age int")
    b = spark.createDataFrame([("s2", 70), ("s3", 80)], "sample_id string, age int")
    rows = align.align_modalities({"clinical": a, "ecg": b}).collect()
    assert [r.asDict() for r in rows] == [{"sample_id": "s2", "age": 60, "ecg__age": 70}]
    with pytest.raises(ValueError, match="share no"):
        align.align_modalities({"a": a, "b": b.where("sample_id = 's3'")})
    with pytest.raises(ValueError, match="not unique"):
        align.align_modalities({"a": a.union(a), "b": b})
    with pytest.raises(ValueError, match="id column"):
        align.align_modalities({"a": a, "b": b.drop("sample_id")})
    with pytest.raises(ValueError):
        align.align_modalities({})


def test_modality_tables(spark):
    df = spark.createDataFrame([("s1", 1, 2), ("s2", 3, 4)], "sample_id string, x int, y int")
    table = align.modality_table(df, "omics", drop=["y", "absent"])
    assert table.features == ["x"]
    with pytest.raises(ValueError, match="no feature"):
        align.modality_table(df, "omics", drop=["x", "y"])
    with pytest.raises(ValueError, match="missing values"):
        align.modality_table(df.withColumn("sample_id", F.lit(None).cast("string")), "omics")
    other = align.modality_table(df.where("sample_id = 's1'"), "ecg")
    merged = align.merge_modalities([table, other], "left").orderBy("sample_id").collect()
    assert [r["ecg__y"] for r in merged] == [2, None]
    with pytest.raises(ValueError):
        align.merge_modalities([table], "cross")


def test_embeddings_are_matched_by_id(spark):
    a = spark.createDataFrame([("s1", [1.0, 2.0]), ("s2", [3.0, 4.0])], "sample_id string, v array<double>")
    b = spark.createDataFrame([("s2", [7.0]), ("s1", [6.0])], "sample_id string, v array<double>")
    got = {r["sample_id"]: r["v"] for r in align.concat_embeddings({"a": a, "b": b}).collect()}
    assert got == {"s1": [1.0, 2.0, 6.0], "s2": [3.0, 4.0, 7.0]}
    with pytest.raises(ValueError, match="same sample ids"):
        align.concat_embeddings({"a": a, "b": b.where("sample_id = 's1'")})
    uneven = spark.createDataFrame([("s1", [1.0]), ("s2", [1.0, 2.0])], "sample_id string, v array<double>")
    with pytest.raises(ValueError, match="length"):
        align.concat_embeddings({"a": a, "b": uneven})
