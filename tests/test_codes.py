"""Scans of a set of codes read fewer files and keep windows by code without an exchange."""

import datetime as dt
import re
import uuid

import pytest
from pyspark.sql import functions as F

from tidemark.functions.exprs import lag
from tidemark.sources import codes

DAY = dt.date(2020, 1, 1)


@pytest.fixture(scope="module")
def bars(spark):
    rows = [(DAY + dt.timedelta(days=i), f"c{k}", float(10 * k + i)) for k in range(40) for i in range(6)] + [(DAY, None, 1.0)]
    return spark.createDataFrame(rows, "dt date, code string, close double").repartition(3)


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def scanned(df):
    """Files that a scan read, from its metrics."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if "AdaptiveSparkPlan" in plan.getClass().getName() else plan
    leaves = plan.collectLeaves()
    node = leaves.apply(0)
    while "QueryStage" in node.getClass().getName():
        node = node.plan().collectLeaves().apply(0)
    return node.metrics().apply("numFiles").value()


def test_listed_codes_read_their_buckets_without_an_exchange(spark, bars, tmp_path):
    name = f"bars_{uuid.uuid4().hex}"
    codes.store_buckets(bars, name, 8, str(tmp_path / "t"))
    try:
        df = codes.scan_listed(spark, name, ["c3", "c3", "c7", None, "none"])
        out = df.withColumn("before", lag("close"))
        plan = plan_of(out)
        assert "Exchange" not in plan and int(re.search(r"SelectedBucketsCount: (\d+) out of 8", plan)[1]) <= 3
        assert scanned(out) < scanned(spark.table(name))
        got = sorted((r.code, r.dt, r.close, r.before) for r in out.collect())
        assert [g[:3] for g in got] == sorted((r.code, r.dt, r.close) for r in bars.where("code in ('c3', 'c7')").collect()) and got[0][3] is None and got[1][3] == got[0][2]
        assert codes.scan_listed(spark, name, []).count() == 0 and spark.table(name).where("code is null").count() == 1
        with pytest.raises(ValueError):
            codes.scan_listed(spark, name, [str(i) for i in range(codes.LISTED + 1)])
    finally:
        spark.sql(f"drop table {name}")


@pytest.mark.parametrize("limit", ["10MB", "-1"])
def test_joined_codes_prune_folders_when_the_scan_runs(spark, bars, tmp_path, limit):
    path = str(tmp_path / "f")
    codes.store_folders(bars, path, 16)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        wanted = spark.createDataFrame([("c5", 1), ("c5", 2), (None, 1), ("zz", 1)], "code string, flag int").where("flag < 3")
        df = codes.scan_joined(spark.read.parquet(path), wanted.select("code"), 16)
        got = sorted((r.code, r.dt, r.close) for r in df.collect())
        assert got == sorted((r.code, r.dt, r.close) for r in bars.where("code = 'c5'").collect())
        assert scanned(df) <= 2 < scanned(spark.read.parquet(path)) and re.search(r"PartitionFilters: \[.*part#\d+ (IN|INSET|=)", plan_of(df))
        assert codes.scan_joined(spark.read.parquet(path), wanted.where(F.lit(False)).select("code"), 16).count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
