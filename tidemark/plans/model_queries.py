"""Fitted scores, simulations and streams: checked by tests, not by SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import r6
from ..operators import metrics, models, panel, research, simulate
from ..sources import bars as src
from ..sources import stores
from ..streaming import stream_bars
from .panel_queries import universe_rows
from .research_queries import CAPITAL, RANKS, _folds, week

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _training(spark, sf_dir) -> tuple[DataFrame, list]:
    """The rows of all weeks, and every walk-forward fold that has training days."""
    df = stores.staged(models.prepared(week(spark, sf_dir), RANKS).withColumn("up", (F.col("y") > 0.008).cast("double")).select("dt", "code", "x", "y", "up"))
    folds = [r.asDict() for r in _folds(spark, sf_dir)[0].where("train_end is not null").orderBy("fold").collect()]
    return df, folds


@query
def m3_logistic(spark, sf_dir):
    df, folds = _training(spark, sf_dir)
    return models.walk_forward(df, folds, "up", models.logistic)


@query
def gbt_regression(spark, sf_dir):
    """Five rounds of trees for each fold, fitted on at most 300 rows a day."""
    df, folds = _training(spark, sf_dir)
    return models.walk_forward(df, folds, "y", lambda t, y: models.boosted(models.daily_sample(t, 300, 42), y, rounds=5))


def _inputs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """A panel of daily bars, its traded values scaled so that whole lots can be bought, and each day's best codes by the fall of the day."""
    df = panel.stop_flags(universe_rows(spark, sf_dir)).withColumns({"dividend": F.lit(0.0), "adv20": F.col("adv20") * 1e4})
    fall = panel.lag("close")
    scores = df.where("tradable").withColumn("score", -(F.col("close") / fall - 1)).select("dt", "code", "score")
    return df, research.candidates(scores, 0.5, 8)


@query
def simulate_grid(spark, sf_dir):
    df, picks = _inputs(spark, sf_dir)
    nav = simulate.simulate_grid(df, picks, simulate.parameter_grid(spark, [1, 5], [2, 3], [None, 0.5], [1.0, 2.0]))
    r = metrics.daily_returns(nav, ["trial"], CAPITAL)
    return metrics.summary(r, ["trial"], CAPITAL)


@query
def simulate_trades(spark, sf_dir):
    df, picks = _inputs(spark, sf_dir)
    trades = simulate.simulate_trades(df, picks, simulate.parameter_grid(spark, [5], [3], [None]))
    return metrics.trade_stats(trades, ["trial"])


@query
def b1_distribution(spark, sf_dir):
    """Sharpe ratios of portfolios of random picks: 5th, 50th and 95th percentiles over seeds."""
    df, _ = _inputs(spark, sf_dir)
    out = simulate.simulate_grid(df, None, simulate.parameter_grid(spark, [5], [3], [None], seeds=tuple(range(42, 62))))
    s = metrics.summary(metrics.daily_returns(out, ["trial"], CAPITAL), ["trial"], CAPITAL)
    return s.agg(F.count("*").alias("trials"), *[F.percentile("sharpe", F.lit(p / 100)).alias(f"p{p}") for p in (5, 50, 95)])


@query
def b7_equal_weight(spark, sf_dir):
    df, _ = _inputs(spark, sf_dir)
    nav = simulate.simulate_grid(df, None, simulate.parameter_grid(spark, [5], [1], [None], equal_weight=True, seeds=(42,)))
    return metrics.summary(metrics.daily_returns(nav, ["trial"], CAPITAL), ["trial"], CAPITAL)


def _stream(spark, sf_dir, build, keys) -> DataFrame:
    """What a stream over the events' files gives, the last version of each key."""
    files = spark.read.parquet(f"{sf_dir}/events.parquet").inputFiles()
    folder = files[0].rsplit("/", 1)[0]
    events = spark.readStream.schema(stream_bars.EVENTS).option("pathGlobFilter", "events.parquet" if folder.rstrip("/").endswith(sf_dir.rstrip("/").rsplit("/", 1)[-1]) else "*.parquet").parquet(folder)
    path = f"{stores.work_dir(spark)}/{uuid.uuid4().hex}"
    return stream_bars.latest(stream_bars.available_now(build(events), f"{path}/rows", f"{path}/state", "update"), keys)


@query
def stream_bars_hourly(spark, sf_dir):
    """Hourly bars of the event stream, those of windows that are still open too."""
    return _stream(spark, sf_dir, stream_bars.windowed_bars, ["dt", "code"])


ORACLES["stream_bars_hourly"] = f"with {src.HOURLY_SQL} select dt, code, open, high, low, close, volume::bigint as volume from bars"


@query
def stream_running_means(spark, sf_dir):
    """The recursive mean of each type's values, kept as state."""
    return _stream(spark, sf_dir, stream_bars.running_means, ["code"]).withColumn("mean", r6("mean"))


ORACLES["stream_running_means"] = """select event_type as code, count(value) as n, round(list_reduce(list(value order by ts, event_id) filter (value is not null), lambda a, x: 0.9 * a + 0.1 * x), 6) + 0.0 as mean from events group by 1"""
