"""Sample manifests, benchmark definitions and dataset cards."""

from __future__ import annotations


from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.roles import BENCHMARK_TASKS, DEFINITION_REQUIRED, BenchmarkDefinition
from cohortspark.sources.paths import require_path


def load_sample_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per sample of nested JSON manifests, with the series fields in front."""
    require_path(spark, path)
    raw = spark.read.option("multiLine", True).json(path)
    if "samples" not in raw.columns:
        raise ValueError("the manifest has no samples")
    series = [c for c in raw.columns if c not in ("samples", "notes")]
    return raw.select(*series, F.explode("samples").alias("s")).select(*series, "s.*")


DEFINITION_SCHEMA = (
    "benchmark_id string, version string, task string, target string, split_policy string, group_key string, "
    "modalities array<string>, phenotype_ontology string, test_labels_private boolean, "
    "source_datasets array<string>, metrics array<string>"
)


def load_definitions(spark: SparkSession, path: str) -> DataFrame:
    """Definition files as a table, with what is wrong with each (empty array when valid)."""
    require_path(spark, path)
    table = (
        spark.read.option("multiLine", True).schema(DEFINITION_SCHEMA).json(path)
        .withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    )
    problems = [
        F.when(F.col(name).isNull(), F.lit(f"missing {name}")) for name in DEFINITION_REQUIRED
    ] + [F.when(~F.col("task").isin(*BENCHMARK_TASKS), F.lit("unknown task"))]
    return table.withColumn("problems", F.array_compact(F.array(*problems)))


def load_definition(spark: SparkSession, path: str) -> BenchmarkDefinition:
    """The one definition of a file; what ``load_definitions`` finds wrong with it is an error."""
    rows = load_definitions(spark, path).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{path} must hold exactly one JSON object")
    found = rows[0].asDict()
    found.pop("file")
    if problems := found.pop("problems"):
        raise ValueError(f"{path}: {', '.join(problems)}")
    lists = {name: tuple(found[name] or ()) for name in ("modalities", "source_datasets", "metrics")}
    return BenchmarkDefinition(**{**found, **lists, "test_labels_private": bool(found["test_labels_private"])})


@dataclass(frozen=True)
class CardFields:
    """What a person writes on a dataset card; the counts are computed."""

    dataset_id: str
    source: str
    citation: str
    species: str
    tissue: str
    modality: str
    task: str
    collection_window: str = ""
    preprocessing: tuple[str, ...] = ()
    limitations: tuple[str, ...] = ()
    license: str = "unknown"


def dataset_card(df: DataFrame, fields: CardFields, *, study_group: str) -> DataFrame:
    """One row: the written fields plus sample and study-group counts."""

    def constant(name: str):
        value: Any = getattr(fields, name)
        if isinstance(value, tuple):
            return F.array(*[F.lit(v) for v in value]).cast("array<string>").alias(name)
        return F.lit(value).alias(name)

    counts = df.agg(F.count(F.lit(1)).alias("n_samples"), F.countDistinct(study_group).alias("study_groups"))
    before = ("dataset_id", "source", "citation", "species", "tissue", "modality", "task")
    after = ("collection_window", "preprocessing", "limitations", "license")
    return counts.select(*[constant(n) for n in before], "n_samples", "study_groups", *[constant(n) for n in after])


def save_card(card: DataFrame, path: str) -> None:
    card.coalesce(1).write.mode("errorifexists").json(path)


