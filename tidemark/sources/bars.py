"""Bars (dt, code, sector, open, high, low, close, volume) from the star schema's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ohlc(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    key = F.struct(*order)
    return df.groupBy(*by).agg(
        F.min_by("px", key).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", key).alias("close"), F.sum("q").alias("volume")
    )


def nation_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of unit prices by the supplier's nation; sector is its region."""
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_shipdate").cast("date").alias("dt"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"), F.col("l_quantity").alias("q"))
    supplier = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = read(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("code"), "n_regionkey")
    region = read(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("sector"))
    df = line.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return _ohlc(df, ["dt", "code", "sector"], [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])


def supplier_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars of unit prices by supplier; sector is its nation."""
    ship = F.col("l_shipdate")
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", ship.alias("ts"), F.date_trunc("week", ship).cast("date").alias("dt"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"), F.col("l_quantity").alias("q"))
    supplier = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = read(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("sector"))
    df = line.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey")).withColumn("code", F.col("l_suppkey").cast("string"))
    return _ohlc(df, ["dt", "code", "sector"], [F.col(c) for c in ("ts", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])


def event_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of event values by type; volume counts events."""
    df = read(spark, sf_dir, "events").select(F.date_trunc("hour", "ts").alias("dt"), F.col("event_type").alias("code"), F.col("value").alias("px"), F.lit(1.0).alias("q"), "ts", "event_id")
    return _ohlc(df, ["dt", "code"], [F.col("ts"), F.col("event_id")])


def index_series(bars: DataFrame) -> DataFrame:
    """dt, ix: the volume-weighted close of all codes of a day."""
    return bars.groupBy("dt").agg((F.sum(F.col("close") * F.col("volume")) / F.sum("volume")).alias("ix"))


NATION_SQL = """
px as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_shipdate as date) as dt, n_name as code, r_name as sector,
              l_extendedprice / l_quantity as px, l_quantity as q
       from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
bars as (select dt, code, sector, arg_min(px, (l_orderkey, l_linenumber, l_partkey, l_suppkey)) as open, max(px) as high, min(px) as low,
                arg_max(px, (l_orderkey, l_linenumber, l_partkey, l_suppkey)) as close, sum(q) as volume from px group by dt, code, sector)"""
WEEKLY_SQL = """
px as (select l_shipdate as ts, l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(date_trunc('week', l_shipdate) as date) as dt,
              cast(l_suppkey as varchar) as code, n_name as sector, l_extendedprice / l_quantity as px, l_quantity as q
       from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey),
bars as (select dt, code, sector, arg_min(px, (ts, l_orderkey, l_linenumber, l_partkey, l_suppkey)) as open, max(px) as high, min(px) as low,
                arg_max(px, (ts, l_orderkey, l_linenumber, l_partkey, l_suppkey)) as close, sum(q) as volume from px group by dt, code, sector)"""
HOURLY_SQL = """
bars as (select date_trunc('hour', ts) as dt, event_type as code, arg_min(value, (ts, event_id)) as open, max(value) as high, min(value) as low,
                arg_max(value, (ts, event_id)) as close, count(*)::double as volume from events group by 1, 2)"""
INDEX_SQL = "ix as (select dt, sum(close * volume) / sum(volume) as ix from bars group by dt)"
