"""Registered queries train with the default settings of their models."""

import pytest

from cohortspark.operators.models import BOOSTING, build_model
from cohortspark.plans.catalog import workflows

SF = "/root/testdata/sf0.001"


class Stop(Exception):
    pass


def test_gbt_multiclass_trains_the_default_rounds(spark, monkeypatch):
    asked = {}

    def watched(*args, **params):
        spec = build_model(*args, **params)
        asked.update(params)
        raise Stop(spec)

    monkeypatch.setattr(workflows, "build_model", watched)
    with pytest.raises(Stop):
        workflows.gbt_multiclass(spark, SF)
    assert {**BOOSTING, **asked}["max_iter"] == BOOSTING["max_iter"] == 100


def test_permutation_importance_takes_the_default_repeats(spark, monkeypatch):
    asked = {}

    def watched(*args, **options):
        asked.update(options)
        raise Stop

    monkeypatch.setattr(workflows, "model_importance", watched)
    with pytest.raises(Stop):
        workflows.permutation_importance_query(spark, SF)
    assert asked.get("n_repeats", 10) == 10
