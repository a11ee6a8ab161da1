import hashlib
import json
import struct
import zlib
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.feather as feather
import pytest
from pyspark.sql import functions as F

from cohortspark.functions.images import image_statistics
from cohortspark.operators.fingerprint import config_fingerprint, fingerprint, runtime_metadata
from cohortspark.operators.metrics import cv_aggregate
from cohortspark.plans.train import train
from cohortspark.roles import Cohort, Roles, TrainingConfig
from cohortspark.sources import files, images, manifests, predictions, runs, tables


def test_csv_types_and_missing_texts(spark, scratch):
    path = f"{scratch}/t.csv"
    Path(path).write_text(
        "id,x,x,flag,mixed,empty,txt,big\n"
        '1,1.5,NA,True,1,,"a, ""b""",9223372036854775807\n'
        "2,nan,2,false,x,,NULL,1\n"
        "3,inf,3,TRUE,2.0,,1d,2\n"
    )
    df = tables.load_csv(spark, path)
    assert {f.name: f.dataType.simpleString() for f in df.schema} == {
        "id": "bigint", "x": "double", "x.1": "bigint", "flag": "boolean", "mixed": "string", "empty": "double",
        "txt": "string", "big": "bigint",
    }
    rows = [tuple(r) for r in df.orderBy("id").collect()]
    assert rows[0] == (1, 1.5, None, True, "1", None, 'a, "b"', 9223372036854775807)
    assert rows[1][1] is None and rows[1][6] is None
    assert rows[2][1] == float("inf") and rows[2][6] == "1d"
    # The same table as the public CSV reader sees it.
    pdf = pd.read_csv(path)
    assert list(pdf.columns) == df.columns
    assert pdf["x.1"].isna().tolist() == [r[2] is None for r in rows]


def test_dispatch_by_suffix(spark, scratch):
    Path(f"{scratch}/t.tsv").write_text("a\tb\n1\tx\n")
    Path(f"{scratch}/p.tsv").write_text("a|b\n1|x\n")
    assert tables.load_table(spark, f"{scratch}/t.tsv").first().asDict() == {"a": 1, "b": "x"}
    assert tables.load_table(spark, f"{scratch}/p.tsv", sep="|").first().asDict() == {"a": 1, "b": "x"}
    Path(f"{scratch}/t.xml").write_text("<a/>")
    with pytest.raises(ValueError, match="format"):
        tables.load_table(spark, f"{scratch}/t.xml")
    with pytest.raises(FileNotFoundError):
        tables.load_table(spark, f"{scratch}/none.csv")
    feather.write_feather(pa.table({"a": [1, 2], "v": [[1.0], [2.0, 3.0]]}), f"{scratch}/t.feather")
    assert [r["v"] for r in tables.load_table(spark, f"{scratch}/t.feather").orderBy("a").collect()] == [[1.0], [2.0, 3.0]]
    features, target = tables.load_feature_matrix(spark, f"{scratch}/t.tsv", "b", ["a"])
    assert features.columns == [] and target.columns == ["a", "b"]
    with pytest.raises(ValueError, match="missing"):
        tables.load_feature_matrix(spark, f"{scratch}/t.tsv", "c")


def test_canonical_columns_keep_the_first(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["a b", " a b ", "c"])
    assert tables.canonicalize_columns(df).first().asDict() == {"a_b": 1, "c": 3}


def test_checksums_small_and_streamed(spark, scratch):
    bodies = {"a.bin": b"x" * 10, "b.bin": bytes(range(256)) * 400}
    for name, body in bodies.items():
        (Path(scratch) / name).write_bytes(body)
    out = files.file_checksums(spark, scratch, "*.bin", in_memory=100)
    got = {r["file"]: (r["size_bytes"], r["sha256"]) for r in out.collect()}
    assert got == {n: (len(b), hashlib.sha256(b).hexdigest()) for n, b in bodies.items()}
    expected = spark.createDataFrame(
        [("a.bin", got["a.bin"][1].upper()), ("b.bin", "00"), ("c.bin", "00")], "file string, sha256 string"
    )
    status = {r["file"]: r["status"] for r in files.verify_files(out, expected).collect()}
    assert status == {"a.bin": "match", "b.bin": "mismatch", "c.bin": "missing"}


def test_files_of_one_name_in_two_folders(spark, scratch):
    for folder, body in (("a", b"1"), ("b", b"22"), (".", b"333")):
        (Path(scratch) / folder).mkdir(exist_ok=True)
        (Path(scratch) / folder / "x.bin").write_bytes(body)
    out = files.file_checksums(spark, scratch, "*.bin", recursive=True)
    assert {(r["file"], r["size_bytes"]) for r in out.collect()} == {("a/x.bin", 1), ("b/x.bin", 2), ("x.bin", 3)}
    checked = files.verify_files(out, out.select("file", "sha256"))
    assert checked.count() == 3 and {r["status"] for r in checked.collect()} == {"match"}
    assert [r["file"] for r in files.file_checksums(spark, scratch + "/a/x.bin").collect()] == ["x.bin"]


def test_acquisition_manifest_round_trip(spark, scratch):
    (Path(scratch) / "raw").mkdir()
    (Path(scratch) / "raw" / "GSE1234_RAW.tar").write_bytes(b"tar")
    (Path(scratch) / "raw" / "notes.txt").write_bytes(b"other")
    series = spark.createDataFrame([("gse1234",), ("GSE9",), ("gse1234",)], "accession string")
    found = files.file_checksums(spark, scratch, recursive=True)
    table = files.acquisition_manifest(found, series)
    path = files.save_acquisitions(table, scratch + "/manifest")
    rows = {(r["accession"], r["kind"]): r for r in files.load_acquisitions(spark, path).collect()}
    assert set(rows) == {(a, k) for a in ("GSE1234", "GSE9") for k in ("family_soft", "raw_tar")}
    got = rows["GSE1234", "raw_tar"]
    assert (got["path"], got["size_bytes"], got["sha256"]) == ("raw/GSE1234_RAW.tar", 3, hashlib.sha256(b"tar").hexdigest())
    assert got["url"].endswith("/GSE1nnn/GSE1234/suppl/GSE1234_RAW.tar") and rows["GSE9", "raw_tar"]["sha256"] is None
    with pytest.raises(Exception, match="already exists"):
        files.save_acquisitions(table, path)


def test_a_csv_becomes_a_checked_cohort(spark, scratch):
    from cohortspark.roles import Roles

    Path(scratch + "/c.csv").write_text("id,y,g,x\n1,a,p,0.5\n2,b,q,\n")
    cohort = tables.load_cohort(spark, scratch + "/c.csv", Roles("id", "y", "g"))
    assert cohort.roles.features(cohort.df) == ["x"] and cohort.df.count() == 2
    assert cohort.df.schema["y"].metadata["role"] == "target"
    for wrong in (Roles("id", "z"), Roles("key", "y"), Roles("id", "y", "h")):
        with pytest.raises(KeyError):
            tables.load_cohort(spark, scratch + "/c.csv", wrong)


def png(pixels: np.ndarray) -> bytes:
    height, width, _ = pixels.shape

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    raw = b"".join(b"\0" + row.astype(np.uint8).tobytes() for row in pixels)
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_images_come_out_as_rgb(spark, scratch):
    pixels = np.random.default_rng(0).integers(0, 256, size=(3, 5, 3))
    Path(f"{scratch}/i.png").write_bytes(png(pixels))
    df = images.load_images(spark, f"{scratch}/i.png")
    row = df.first()["image"]
    assert (row["height"], row["width"], row["channels"]) == (3, 5, 3)
    assert np.array_equal(np.array(row["data"]).reshape(3, 5, 3), pixels)
    stats = image_statistics(df, "origin", "image", channels=3).first()
    assert stats["channel_0_mean"] == pytest.approx(pixels[:, :, 0].mean())


def test_sample_manifest(spark, scratch):
    body = {"accession": "S1", "notes": ["n"], "samples": [{"sample_id": "a", "cells": 2}, {"sample_id": "b", "cells": 3}]}
    Path(f"{scratch}/m.json").write_text(json.dumps(body, indent=2))
    rows = manifests.load_sample_manifest(spark, f"{scratch}/m.json").orderBy("sample_id").collect()
    assert [(r["accession"], r["sample_id"], r["cells"]) for r in rows] == [("S1", "a", 2), ("S1", "b", 3)]


def test_definitions(spark, scratch):
    good = {
        "benchmark_id": "x", "version": "1", "task": "classification", "target": "t", "split_policy": "donor",
        "group_key": "g", "metrics": ["auroc"],
    }
    Path(f"{scratch}/good.json").write_text(json.dumps(good, indent=1))
    Path(f"{scratch}/bad.json").write_text(json.dumps({"benchmark_id": "y", "task": "guess"}))
    assert manifests.load_definition(spark, f"{scratch}/good.json").metrics == ("auroc",)
    with pytest.raises(ValueError, match="missing version, missing target"):
        manifests.load_definition(spark, f"{scratch}/bad.json")
    table = {r["file"]: r["problems"] for r in manifests.load_definitions(spark, scratch).collect()}
    assert table["good.json"] == []
    assert table["bad.json"] == ["missing version", "missing target", "missing split_policy", "missing group_key", "unknown task"]


def test_dataset_card(spark, scratch):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, study string")
    fields = manifests.CardFields("d", "s", "c", "mouse", "heart", "omics", "classification", limitations=("few",))
    card = manifests.dataset_card(df, fields, study_group="study")
    assert len(card.columns) == 13
    manifests.save_card(card, f"{scratch}/card")
    row = spark.read.json(f"{scratch}/card").first()
    assert (row["n_samples"], row["study_groups"], row["limitations"]) == (3, 2, ["few"])


def test_prediction_round_trip(spark, scratch):
    df = spark.createDataFrame([("a", 1, [0.2, 0.8]), ("b", 0, [0.9, 0.1])], "id string, prediction int, p array<double>")
    table = predictions.prediction_table(df, id="id", probability="p", split="validation", model_name="m")
    path = predictions.export_predictions(table, f"{scratch}/p.csv", fingerprint="f")
    back = predictions.load_predictions(spark, path)
    assert {r["sample_id"]: r["probability"] for r in back.collect()} == {"a": 0.8, "b": 0.1}
    side = json.loads(Path(path + ".json").read_text())
    assert side["n_predictions"] == 2 and side["split"] == "validation" and side["dataset_fingerprint"] == "f"
    predictions.export_predictions(table.union(table), f"{scratch}/twice.csv")
    with pytest.raises(ValueError, match="repeats"):
        predictions.load_predictions(spark, f"{scratch}/twice.csv")
    Path(f"{scratch}/bare.csv").write_text("sample_id,prediction\na,1\n")
    with pytest.raises(ValueError, match="lacks"):
        predictions.load_predictions(spark, f"{scratch}/bare.csv")


def test_evaluation_export(spark, scratch):
    df = spark.createDataFrame([(1, 1, 0.5)], "id int, prediction int, s double")
    table = predictions.evaluation_table(df, id="id", score="s")
    predictions.export_evaluation(table, f"{scratch}/e.json")
    text = "".join(f.read_text() for f in Path(f"{scratch}/e.json").glob("part-*"))
    assert json.loads(text) == {"sample_id": "1", "y_true": None, "y_pred": 1, "score": 0.5}
    predictions.export_evaluation(table, f"{scratch}/e.csv")
    assert spark.read.option("header", True).csv(f"{scratch}/e.csv").columns == ["sample_id", "y_true", "y_pred", "score"]


def test_saved_run_scores_the_same(spark, scratch):
    rows = [(i, f"g{i % 10}", float(i % 7), "ab"[i % 2], i % 3 % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "sample_id int, group_id string, x double, c string, target int")
    result = train(Cohort(df, Roles("sample_id", "target", "group_id")), TrainingConfig())
    path = runs.save_run(result, f"{scratch}/run")
    model, splits, manifest = runs.load_run(spark, path)
    assert sorted(model.transform(df).collect()) == sorted(result.model.transform(df).collect())
    assert sorted(splits.collect()) == sorted(result.splits.collect())
    assert manifest["test_status"] == "held_out_not_evaluated"
    assert manifest["dataset"]["fingerprint"] == fingerprint(df, "sample_id")
    assert manifest["config_fingerprint"] == config_fingerprint(result.config.to_dict())
    with pytest.raises(Exception, match="exists"):
        runs.save_run(result, path)


def test_registry(spark, scratch):
    registry = runs.RunRegistry(spark, scratch + "/runs")
    assert registry.list_runs() == []
    registry.save("run-b", {"metric": 1})
    registry.save("run-a", {"created_at": "2020", "metric": 2})
    (Path(scratch) / "runs" / "empty").mkdir()
    assert registry.list_runs() == ["run-a", "run-b"]
    assert registry.load("run-a")["created_at"] == "2020" and registry.load("run-b")["run_id"] == "run-b"
    with pytest.raises(FileExistsError):
        registry.save("run-a", {})
    assert registry.new_run_id() != registry.new_run_id()
    assert set(runtime_metadata()) >= {"created_at_utc", "python", "platform"}


def test_result_table(spark, scratch):
    out = cv_aggregate(spark.createDataFrame([("m", "a", 1.0)], "model string, metric string, value double"))
    runs.save_results(out, f"{scratch}/r")
    assert len(list(Path(f"{scratch}/r").glob("part-*.json"))) == 1


def test_fingerprints(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "id int, v string")
    base = fingerprint(a, "id")
    assert fingerprint(a.repartition(7).orderBy(F.desc("id")), "id") == base
    assert fingerprint(spark.createDataFrame([(1, "x"), (3, None)], "id int, v string"), "id") != base
    assert fingerprint(a.select("v", "id"), "id") != base
    assert fingerprint(a.select("v", "id")) == fingerprint(a)
    assert fingerprint(a.union(a)) != fingerprint(a)
    assert fingerprint(a.withColumn("id", F.col("id").cast("long"))) != fingerprint(a)
    joined = spark.createDataFrame([("a|1:b", "c")], "p string, q string")
    apart = spark.createDataFrame([("a", "1:b|c")], "p string, q string")
    assert fingerprint(joined) != fingerprint(apart)
    with pytest.raises(KeyError):
        fingerprint(a, "absent")


def test_cells_and_headers_that_do_not_fit_are_errors(spark, scratch):
    Path(scratch, "a.csv").write_text("a,b\n1,x\noops,y\n")
    assert [r["a"] for r in tables.load_csv(spark, f"{scratch}/a.csv").collect()] == ["1", "oops"]
    with pytest.raises(Exception, match="column a is no bigint: oops"):
        tables.load_csv(spark, f"{scratch}/a.csv", schema="a bigint, b string").collect()
    both = Path(scratch, "both")
    both.mkdir()
    (both / "1.csv").write_text("a,b\n1,2\n")
    (both / "2.csv").write_text("b,a\n3,4\n")
    with pytest.raises(Exception, match="(?i)header"):
        tables.load_csv(spark, f"{both}/*.csv", schema="a bigint, b bigint").collect()


def test_a_file_that_is_no_image_is_an_error(spark, scratch):
    Path(scratch, "x.png").write_bytes(b"no image")
    with pytest.raises(Exception, match="not a readable image"):
        images.load_images(spark, scratch).collect()


def test_scratch_folder_on_a_cluster_must_be_named():
    from types import SimpleNamespace

    from cohortspark.session import shared_dir

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d: d)))


def test_one_feather_file_is_read_by_several_tasks(spark, scratch):
    folder = f"{scratch}/with space"
    Path(folder).mkdir()
    names = pa.array([f"n{i % 7}" if i % 5 else None for i in range(10_000)]).dictionary_encode()
    whole = pa.table({"i": list(range(10_000)), "name": names.cast(pa.string())})
    feather.write_feather(whole, f"{folder}/big.feather", chunksize=500, compression="lz4")
    feather.write_feather(whole.slice(0, 0), f"{folder}/none.feather")
    df = tables.load_feather(spark, f"{folder}/*.feather", range_bytes=8_000)
    rows = df.withColumn("task", F.spark_partition_id()).orderBy("i").collect()
    assert [(r["i"], r["name"]) for r in rows] == list(zip(*whole.to_pydict().values(), strict=True))
    assert len({r["task"] for r in rows}) > 3
    assert tables.load_feather(spark, f"{folder}/none.feather", "i long, name string").collect() == []
    assert df.agg(F.sum("i")).first()[0] == sum(range(10_000))
