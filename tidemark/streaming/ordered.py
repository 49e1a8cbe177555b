"""Recursions along a key's rows in order of time, over streams whose rows come in any order."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Recursion(StatefulProcessor):
    """Rows wait in a list until the watermark has passed them and a timer fires; then they are taken in order of (ts, id).

    State of a key: its waiting rows, which the watermark bounds, and one row of the recursion: n, mean, weight, streak, last value.
    """

    def __init__(self, alpha: float):
        self.alpha = alpha

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, id long, x double")
        self.reached = handle.getValueState("reached", "n long, mean double, weight double, streak long, last double")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        found = [(r["us"], r["id"], r["x"]) for r in rows]
        self.waiting.appendList(found)
        self.handle.registerTimer(min(us for us, _, _ in found) // 1000)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = [tuple(r) for r in self.waiting.get()]
        rest = [r for r in rows if r[0] >= passed]
        if len(rest) == len(rows):
            return
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(min(us for us, _, _ in rest) // 1000)
        else:
            self.waiting.clear()
        n, mean, weight, streak, last = tuple(self.reached.get()) if self.reached.exists() else (0, None, 1.0, 0, None)
        for us, i, x in sorted(r for r in rows if r[0] < passed):
            streak = streak + 1 if x is not None and last is not None and x > last else 0
            last, weight = x, weight * (1 - self.alpha)
            if x is not None:
                mean = x if mean is None else (weight * mean + self.alpha * x) / (weight + self.alpha)
                n, weight = n + 1, 1.0
            yield Row(code=key[0], id=i, us=us, n=n, mean=mean, streak=streak)
        self.reached.update((n, mean, weight, streak, last))

    def close(self) -> None:
        pass


@contextlib.contextmanager
def rocksdb(spark: SparkSession):
    """State in RocksDB, which timers and several states of a key need, for streams started inside."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def recursions(rows: DataFrame, alpha: float, late: str) -> DataFrame:
    """code, id, ts, n, mean, streak for each row (code, id, ts, x) of a stream that the watermark has passed.

    mean is the recursive mean of the code's values so far and n their number; a null value keeps the mean and weighs the next one
    more, as in functions.exprs.ewm. streak counts the rows up to this one of which each is above the one before; a null breaks it.
    Rows may come in any order within `late` of the newest; later ones are dropped, those not yet passed are withheld. Rows of equal
    time go by id. Use inside `rocksdb`.
    """
    keyed = rows.select("code", "id", "ts", F.unix_micros("ts").alias("us"), "x").withWatermark("ts", late).groupBy("code")
    found = keyed.transformWithState(Recursion(alpha), "code string, id long, us long, n long, mean double, streak long", "Append", "EventTime")
    return found.select("code", "id", F.timestamp_micros("us").alias("ts"), "n", "mean", "streak")
