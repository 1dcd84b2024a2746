"""Forests at the operators' own size, in the queries."""

import pytest

from kilnflow.operators import models
from kilnflow.plans.registry import QUERIES


@pytest.mark.parametrize("query, forest, cheap", [("ml_forest_regressor", "forest_regressor", "linear"), ("model_screening", "forest_regressor", "linear"), ("ml_forest_classifier", "forest_classifier", "logistic")])
def test_queries_fit_the_default_forest(spark, sf_dir, monkeypatch, query, forest, cheap):
    seen = []

    def record(df, features, target, **reduced):
        seen.append(reduced)
        return getattr(models, cheap)(df, features, target)

    monkeypatch.setattr(models, forest, record)
    assert QUERIES[query](spark, sf_dir).count() and seen == [{}]
