"""Labels of streamed signals, given once the prices that they need have come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import div

PRICES = "code string, pos long, ts timestamp, open double"


def read_prices(spark: SparkSession, folder: str, per_trigger: int | None = None) -> DataFrame:
    """A stream of price files (code, pos, ts, open): pos is the day's place in the calendar, ts its date."""
    reader = spark.readStream.schema(PRICES)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).parquet(folder)


def mature_labels(signals: DataFrame, prices: DataFrame, horizon: int, late: str = "10 days", span: str = "60 days") -> DataFrame:
    """code, pos, ts, buy_ts, sell_ts, label for signals (code, pos, ts) whose sale has a price: from the open a place after the signal
    to the open `horizon` places later.

    Two stream-stream interval joins on code and place. A signal waits at most `span`, within which its sale must fall, and rows that
    come more than `late` behind the newest of their stream are dropped; what can't match any more leaves the state. A signal
    without both prices gives no row. A null or zero price gives a null label. Repeated rows give repeated labels.
    """
    inside = lambda ts: (F.col(ts) > F.col("ts")) & (F.col(ts) <= F.col("ts") + F.expr(f"interval {span}"))
    side = lambda name, after: prices.select(
        F.col("code").alias(f"{name}_code"), (F.col("pos") - after).alias(f"{name}_of"), F.col("ts").alias(f"{name}_ts"), F.col("open").alias(f"{name}_open")
    ).withWatermark(f"{name}_ts", late)
    same = lambda name: (F.col("code") == F.col(f"{name}_code")) & (F.col("pos") == F.col(f"{name}_of"))
    waiting = signals.select("code", "pos", "ts").withWatermark("ts", late)
    bought = waiting.join(side("buy", 1), same("buy") & inside("buy_ts"))
    at = lambda ts: F.timestamp_micros(F.unix_micros(ts))  # noqa: E731  no event time: a join takes one of each side
    bought = bought.select("code", "pos", "ts", at("buy_ts").alias("bought"), "buy_open")
    sold = bought.join(side("sell", 1 + horizon), same("sell") & inside("sell_ts"))
    return sold.select("code", "pos", "ts", F.col("bought").alias("buy_ts"), at("sell_ts").alias("sell_ts"), (div(F.col("sell_open"), F.col("buy_open")) - 1).alias("label"))
