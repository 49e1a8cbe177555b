"""Bars and streaks over streams of events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, per_trigger: int = 1) -> DataFrame:
    """A stream of the event files put in a folder."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def windowed_bars(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """dt, code and bars of each closed window; events later than the watermark are left out."""
    key = F.struct("ts", "event_id")
    bars = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), F.col("event_type").alias("code")).agg(
        F.min_by("value", key).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", key).alias("close"), F.count("*").alias("volume")
    )
    return bars.select(F.col("w.start").alias("dt"), "code", "open", "high", "low", "close", "volume")


def running_means(events: DataFrame, alpha: float = 0.1) -> DataFrame:
    """code, n, mean after each batch: the recursive mean of each type's values in order of time, kept as state."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, mean = state.get if state.exists else (0, 0.0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for x in rows["value"].dropna():
            mean = x if n == 0 else (1 - alpha) * mean + alpha * x
            n += 1
        state.update((n, mean))
        yield pd.DataFrame({"code": [key[0]], "n": [n], "mean": [mean]})

    keyed = events.select(F.col("event_type").alias("code"), "ts", "event_id", "value").groupBy("code")
    return keyed.applyInPandasWithState(update, "code string, n long, mean double", "n long, mean double", "update", GroupStateTimeout.NoTimeout)


def available_now(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """What a stream gives for the files that are there now, with the number of its batch: Parquet in a shared folder, written by the tasks.

    A batch that runs again after a failure overwrites its own folder. In update mode a key's last row has its largest batch.
    """

    def save(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    save(stream.sparkSession.createDataFrame([], stream.schema), -1)  # so that the folder can be read when there are no files
    q = stream.writeStream.foreachBatch(save).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(path)


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The row of each key's largest batch."""
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("s")).select(*keys, "s.*")
