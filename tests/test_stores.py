"""Scans, sinks and selection."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import selection
from tidemark.sources import stores

DAY = dt.date(2020, 1, 1)


def test_conform_adds_drops_and_cleans(spark):
    df = spark.createDataFrame([("2020-01-01", "285A", float("nan"), None, 1)], "dt string, code string, open double, dividend double, extra int")
    r = stores.conform(df).first()
    assert r.dt == DAY and r.code == "285A" and r.open is None and r.dividend == 0.0 and r.split == 0.0 and r.volume is None and "extra" not in r


def test_formats_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(DAY, "A", 1.5)], "dt date, code string, open double")
    for fmt in ("csv", "json", "orc", "parquet"):
        df.write.format(fmt).option("header", True).save(str(tmp_path / fmt))
        assert stores.scan(spark, str(tmp_path / fmt), fmt, "dt date, code string, open double").collect() == df.collect()
    with pytest.raises(ValueError):
        stores.scan(spark, "x", "csv")


def test_wide_to_long_and_dense(spark):
    wide = spark.createDataFrame([(DAY, 1.0, 2.0, None), (DAY + dt.timedelta(1), None, None, 5.0)], "dt date, `open|A` double, `close|A` double, `close|B` double")
    rows = stores.long_from_wide(wide, "dt", ["open", "close"])
    assert sorted((r.code, r.open, r.close) for r in rows.collect()) == [("A", 1.0, 2.0), ("B", None, 5.0)]
    assert [(r.A, r.B) for r in stores.dense(rows, "close", ["A", "B"]).orderBy("dt").collect()] == [(2.0, None), (None, 5.0)]


def test_log_ids_go_on_and_lock_holds(spark, tmp_path):
    rows = spark.createDataFrame([("b",), ("a",)], "name string")
    for _ in range(2):
        stores.append_log(rows, str(tmp_path / "log"), ["name"])
    assert [(r.trial_id, r.name) for r in spark.read.parquet(str(tmp_path / "log")).orderBy("trial_id").collect()] == [(1, "a"), (2, "b"), (3, "a"), (4, "b")]
    stores.write_once(rows, str(tmp_path / "lock"))
    with pytest.raises(Exception, match="(?i)exist"):
        stores.write_once(rows, str(tmp_path / "lock"))


def test_choice_prefers_simpler_families(spark):
    grid = lambda rows: spark.createDataFrame(rows, "id string, family string, sharpe double, passed boolean")
    rng = np.random.default_rng(0)
    noise = rng.normal(0, 0.01, (2, 200))
    returns = spark.createDataFrame([(i, DAY + dt.timedelta(days=k), float(noise[j, k] + (0.02 if i == "top" else 0.0))) for j, i in enumerate(("top", "low")) for k in range(200)], "id string, dt date, ret double")
    assert selection.choose(grid([("top", "M4r", 1.0, True), ("low", "M1", 0.9, True)]), returns)["id"] == "low"
    assert selection.choose(grid([("top", "M4r", 2.0, True), ("low", "M1", 0.9, True)]), returns)["id"] == "top"
    assert selection.choose(grid([("top", "M4r", 2.0, False)]), returns) is None


def test_holdout_and_ranking_edges(spark):
    m = spark.createDataFrame([(0.1, 0.5), (None, 0.5), (0.1, 0.1)], "cagr double, sharpe double")
    assert [r.passed for r in selection.holdout_verdict(m, 1.0).collect()] == [True, False, False]
    today = spark.createDataFrame([("A", "x", None, 10.0, 1e9, 0.1)], "code string, sector string, score double, close_u double, adv20 double, atr14p double")
    assert selection.ranking(today, 3, 0.5, 5, None).count() == 0
    r = selection.ranking(today.withColumn("score", F.lit(1.0)), 3, 0.1, 5, None).first()
    assert (r["rank"], r.shares, r.limit_price, r.share) == (1, 66600, None, 1.0) and r.risks == ["high volatility"]
