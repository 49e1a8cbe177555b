"""Walk-forward queries score every fold that has training days."""

import os

import pytest

from tidemark.operators import models
from tidemark.plans import model_queries, research_queries

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_every_fold_is_scored_on_300_rows_a_day(spark, monkeypatch):
    want = {r.fold for r in research_queries._folds(spark, FOLDER)[0].where("train_end is not null").collect()}
    most = []
    monkeypatch.setattr(models, "daily_sample", lambda df, n, seed: most.append(n) or df)
    monkeypatch.setattr(models, "boosted", lambda train, label, **k: lambda df: df.withColumnRenamed("y", "pred"))
    monkeypatch.setattr(models, "logistic", lambda train, label: lambda df: df.withColumnRenamed("y", "pred"))
    for query in (model_queries.gbt_regression, model_queries.m3_logistic):
        got = {r.fold for r in query(spark, FOLDER).select("fold").distinct().collect()}
        assert got == want and len(want) > 2
    assert set(most) == {300}
