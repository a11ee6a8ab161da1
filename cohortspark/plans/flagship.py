"""The end-to-end path: audit, split by group, train, report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortspark.operators.audit import integrity_report
from cohortspark.plans.catalog.workflows import EVENT_ROLES, event_cohort, metric_table
from cohortspark.plans.train import train
from cohortspark.roles import Cohort, TrainingConfig


def train_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_cohort(spark, sf_dir)
    report = integrity_report(rows, target="is_error", id="event_id", group="user_id").first()
    if not report["ok"]:
        raise ValueError(f"the cohort is not usable: {report['warnings']}")
    result = train(Cohort(rows, EVENT_ROLES), TrainingConfig(target="is_error", group="user_id"), check_gates=True)
    return metric_table(spark, result.metrics)
