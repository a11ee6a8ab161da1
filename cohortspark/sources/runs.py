"""Run artifacts and the run registry."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from datetime import UTC, datetime
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark import __version__
from cohortspark.operators.fingerprint import config_fingerprint, runtime_metadata
from cohortspark.operators.models import FittedModel
from cohortspark.plans.train import TrainingResult
from cohortspark.sources.paths import _handle, write_text

UNTOUCHED_TEST = "held_out_not_evaluated"


def run_manifest(result: TrainingResult) -> dict[str, Any]:
    config = result.config.to_dict()
    return {
        "engine_version": __version__,
        "runtime": runtime_metadata(),
        "config": config,
        "config_fingerprint": config_fingerprint(config),
        "dataset": {
            "id_column": result.roles.id,
            "target_column": result.roles.target,
            "group_column": result.roles.group,
            "feature_columns": list(result.features),
            "fingerprint": result.fingerprint,
        },
        "model": {
            "name": result.model.name,
            "task": result.model.task,
            "slots": list(result.model.slots),
            "labels": list(result.model.labels),
        },
        "metrics": result.metrics,
        "split_sizes": result.split_sizes,
        "elapsed_seconds": result.elapsed_seconds,
        "test_status": UNTOUCHED_TEST,
    }


def save_run(result: TrainingResult, path: str) -> str:
    """``model/`` (ML persistence), ``splits/`` (parquet) and ``manifest.json``."""
    path = path.rstrip("/")
    result.model.pipeline.write().save(f"{path}/model")
    result.splits.write.mode("errorifexists").parquet(f"{path}/splits")
    text = json.dumps(run_manifest(result), indent=2, sort_keys=True, default=str)
    write_text(result.splits.sparkSession, f"{path}/manifest.json", text)
    return path


def load_manifest(spark: SparkSession, path: str) -> dict[str, Any]:
    lines = spark.read.text(path, wholetext=True).limit(1).collect()
    return json.loads(lines[0]["value"])


def load_run(spark: SparkSession, path: str) -> tuple[FittedModel, DataFrame, dict[str, Any]]:
    path = path.rstrip("/")
    manifest = load_manifest(spark, f"{path}/manifest.json")
    head, data = manifest["model"], manifest["dataset"]
    model = FittedModel(
        head["name"],
        head["task"],
        tuple(data["feature_columns"]),
        tuple(head["slots"]),
        PipelineModel.load(f"{path}/model"),
        tuple(head["labels"]),
    )
    return model, spark.read.parquet(f"{path}/splits"), manifest


class RunRegistry:
    """Immutable run manifests under ``root/<run id>/manifest.json``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def new_run_id(self, prefix: str = "run") -> str:
        stamp = datetime.now(UTC).strftime("%Y%m%dT%H%M%SZ")
        return f"{prefix}-{stamp}-{uuid.uuid4().hex[:8]}"

    def _path(self, run_id: str) -> str:
        return f"{self.root}/{run_id}/manifest.json"

    def save(self, run_id: str, manifest: Mapping[str, Any]) -> str:
        payload = {"run_id": run_id, "created_at": datetime.now(UTC).isoformat(), **manifest}
        write_text(self.spark, self._path(run_id), json.dumps(payload, indent=2, sort_keys=True, default=str))
        return self._path(run_id)

    def load(self, run_id: str) -> dict[str, Any]:
        return load_manifest(self.spark, self._path(run_id))

    def runs(self) -> DataFrame:
        """``(run_id, created_at, manifest)`` of every run that has a manifest, sorted."""
        fs, pattern = _handle(self.spark, f"{self.root}/*/manifest.json")
        found = fs.globStatus(pattern)
        if found is None or len(found) == 0:
            return self.spark.createDataFrame([], "run_id string, created_at string, manifest string")
        text = self.spark.read.text(f"{self.root}/*/manifest.json", wholetext=True)
        return text.select(
            F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("run_id"),
            F.get_json_object("value", "$.created_at").alias("created_at"),
            F.col("value").alias("manifest"),
        ).orderBy("run_id")

    def list_runs(self) -> list[str]:
        return [r["run_id"] for r in self.runs().select("run_id").collect()]


def save_results(results: DataFrame, path: str) -> str:
    """A benchmark or matrix result table as one JSON-lines file."""
    results.coalesce(1).write.mode("errorifexists").option("ignoreNullFields", False).json(path)
    return path
