"""Prediction interchange tables."""

from __future__ import annotations

import json

from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.sources.paths import suffix_of, write_text
from cohortspark.sources.tables import load_csv

# The format tag and columns of a prediction table.
FORMAT_TAG = "cohort.predictions.v1"
REQUIRED = ("sample_id", "prediction", "split", "model_name")


def positive_probability(df: DataFrame, probability: str) -> Column:
    """Class 1 of a two-class probability vector or array; a plain number is kept."""
    dtype = df.schema[probability].dataType
    value = F.col(f"`{probability}`")
    if isinstance(dtype, VectorUDT):
        value = vector_to_array(value)
    elif not isinstance(dtype, T.ArrayType):
        return value
    return F.when(F.size(value) == 2, F.get(value, F.lit(1)))


def prediction_table(
    df: DataFrame,
    *,
    id: str,
    prediction: str = "prediction",
    probability: str | None = None,
    split: str = "test",
    model_name: str = "unknown",
) -> DataFrame:
    out = [
        F.col(id).alias("sample_id"),
        F.col(prediction).alias("prediction"),
        F.lit(split).alias("split"),
        F.lit(model_name).alias("model_name"),
    ]
    if probability is not None:
        out.append(positive_probability(df, probability).alias("probability"))
    return df.select(*out)


def export_predictions(table: DataFrame, path: str, *, fingerprint: str | None = None) -> str:
    """Headed CSV plus a ``<path>.json`` sidecar describing it."""
    spark = table.sparkSession
    table.write.mode("errorifexists").option("header", True).csv(path)
    # Counted from what was written; the plan that made the predictions runs once.
    written = spark.read.option("header", True).csv(path)
    head = written.agg(
        F.count(F.lit(1)).alias("n"), F.min("split").alias("split"), F.min("model_name").alias("model")
    ).first()
    sidecar = {
        "format": FORMAT_TAG,
        "model_name": head["model"],
        "split": head["split"],
        "dataset_fingerprint": fingerprint,
        "n_predictions": head["n"],
    }
    write_text(spark, path.rstrip("/") + ".json", json.dumps(sidecar, indent=2, sort_keys=True))
    return path


def duplicate_predictions(table: DataFrame) -> DataFrame:
    return table.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def load_predictions(spark: SparkSession, path: str, *, schema=None) -> DataFrame:
    """A prediction table with every required column and unique sample ids."""
    table = load_csv(spark, path, schema=schema)
    absent = [c for c in REQUIRED if c not in table.columns]
    if absent:
        raise ValueError(f"the prediction table lacks {absent}")
    if not duplicate_predictions(table).isEmpty():
        raise ValueError("the prediction table repeats sample ids")
    return table


def evaluation_table(
    df: DataFrame, *, id: str, prediction: str = "prediction", y: str | None = None, score: str | None = None
) -> DataFrame:
    """The evaluator's layout: ``sample_id, y_true, y_pred[, score]``."""
    truth = F.col(y) if y is not None else F.lit(None).cast("string")
    out = [F.col(id).cast("string").alias("sample_id"), truth.alias("y_true"), F.col(prediction).alias("y_pred")]
    if score is not None:
        out.append(F.col(score).alias("score"))
    return df.select(*out)


def export_evaluation(table: DataFrame, path: str) -> str:
    """CSV for a ``.csv`` path, JSON lines otherwise; missing values are written, not left out."""
    writer = table.write.mode("errorifexists")
    if suffix_of(path) == ".csv":
        writer.option("header", True).csv(path)
    else:
        writer.option("ignoreNullFields", False).json(path)
    return path
