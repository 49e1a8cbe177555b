"""Forward labels over calendar-aligned rows, and walk-forward splits with purging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import div, lead, pct_rank

HORIZONS = (1, 2, 3, 5, 10, 20)


def forward_returns(df: DataFrame, horizons=HORIZONS) -> DataFrame:
    """L1_n: from the next row's open to the open n rows later, with buy_dt and sell_dt_n; null beyond the data."""
    out = {"buy_dt": lead("dt", 1)}
    for n in horizons:
        out |= {f"sell_dt_{n}": lead("dt", 1 + n), f"L1_{n}": div(lead("open", 1 + n), lead("open", 1)) - 1}
    return df.withColumns(out)


def excess(df: DataFrame, index: DataFrame, horizons=HORIZONS) -> DataFrame:
    """L2_n: L1_n less the index's growth between the same dates (columns dt, ix)."""
    first = index.select(F.col("dt").alias("buy_dt"), F.col("ix").alias("__a"))
    df = df.join(first, "buy_dt", "left")
    for n in horizons:
        last = index.select(F.col("dt").alias(f"sell_dt_{n}"), F.col("ix").alias("__b"))
        df = df.join(last, f"sell_dt_{n}", "left").withColumn(f"L2_{n}", F.col(f"L1_{n}") - (div(F.col("__b"), F.col("__a")) - 1)).drop("__b")
    return df.drop("__a")


def relative(df: DataFrame, horizons=HORIZONS, cost: float = 0.003, margin: float = 0.005, risk: str = "atr20p") -> DataFrame:
    """L3_n: L1_n less the day's median; L4_n: 1 if L1_n is above cost and margin; L5_n: L1_n over the row's risk."""
    day = Window.partitionBy("dt")
    out = {}
    for n in horizons:
        x = F.col(f"L1_{n}")
        out |= {f"L3_{n}": x - F.median(x).over(day), f"L4_{n}": F.when(x.isNotNull(), (x > cost + margin).cast("double")), f"L5_{n}": div(x, F.col(risk))}
    return df.withColumns(out)


def blended(df: DataFrame, horizons=(5, 10, 20)) -> DataFrame:
    """LM: the mean rank of L3 over horizons less a half; null if any is null."""
    return df.withColumn("LM", sum((pct_rank(f"L3_{n}", ["dt"]) for n in horizons[1:]), pct_rank(f"L3_{horizons[0]}", ["dt"])) / len(horizons) - 0.5)


def boundaries(rows: DataFrame, known: Column, calendar: DataFrame, holdout, horizon: int, least: int, cover: float = 0.99) -> DataFrame:
    """One row: analysis_start, the first day with at least `least` universe rows of which more than `cover` are known; holdout_start,
    the first calendar day from a date on; dev_end, the last signal day before it whose positions of up to `horizon` days end in time.
    Null where there is no such day."""
    per = rows.groupBy("dt").agg(F.count("*").alias("n"), F.avg(known.cast("double")).alias("share"))
    start = per.where((F.col("n") >= least) & (F.col("share") > cover)).agg(F.min("dt").alias("analysis_start"))
    held = calendar.where(F.col("dt") >= holdout).agg(F.min("dt").alias("holdout_start"), (F.min("pos") - horizon - 2).alias("pos"))
    dev = F.broadcast(held).join(calendar.withColumnRenamed("dt", "dev_end"), "pos", "left").drop("pos")
    return start.crossJoin(dev)  # one row each


def holdout_start(calendar: DataFrame, months: int) -> DataFrame:
    """One row, holdout_start: the first calendar day from so many months before the last one on; null for an empty calendar."""
    last = calendar.agg(F.add_months(F.max("dt"), -months).alias("__from"))
    return calendar.join(F.broadcast(last), F.col("dt") >= F.col("__from")).agg(F.min("dt").alias("holdout_start"))


def inner_split(df: DataFrame, horizon: int, share: float = 0.8) -> DataFrame:
    """df with part: valid from the day on before which the share of all days lies, train up to horizon + 2 days before it (at least
    the first day), null for the days between."""
    days = df.select("dt").distinct().withColumn("__i", F.row_number().over(Window.orderBy("dt")) - 1)  # a row for each day
    days = days.withColumn("__cut", F.floor(F.count("*").over(Window.partitionBy(F.lit(1))) * F.lit(share)))
    part = F.when(F.col("__i") >= F.col("__cut"), "valid").when(F.col("__i") <= F.greatest(F.lit(0), F.col("__cut") - horizon - 2), "train")
    return df.join(F.broadcast(days.select("dt", part.alias("part"))), "dt")


def folds(calendar: DataFrame, start, end, first_years: int, months: int) -> DataFrame:
    """fold, val_start, val_end: validation spans of so many months from start + first_years on, snapped to calendar days, up to end."""
    marks = calendar.agg(F.max("dt").alias("last")).select(F.explode(F.expr(f"sequence(add_months(date'{start}', {12 * first_years}), add_months(date'{end}', -0), interval {months} months)")).alias("mark"))
    w = Window.orderBy("mark")  # a row for each fold
    marks = marks.withColumn("next", F.coalesce(F.lead("mark").over(w), F.date_add(F.lit(end).cast("date"), 1))).withColumn("fold", F.row_number().over(w) - 1)
    inside = (calendar["dt"] >= marks["mark"]) & (calendar["dt"] < marks["next"]) & (calendar["dt"] <= F.lit(end).cast("date"))
    return marks.join(calendar, inside).groupBy("fold").agg(F.min("dt").alias("val_start"), F.max("dt").alias("val_end"), F.min("pos").alias("pos"))


def train_ends(fold_rows: DataFrame, calendar: DataFrame, horizon: int) -> DataFrame:
    """fold rows with train_end: the last day whose label is known before the fold starts, n + 2 days before it."""
    at = calendar.select(F.col("pos").alias("__p"), F.col("dt").alias("train_end"))
    return fold_rows.join(at, F.col("pos") - horizon - 2 == F.col("__p"), "left").drop("__p")


def purge_holds(rows: DataFrame, fold_rows: DataFrame, horizon: int) -> DataFrame:
    """fold, n, ok: whether every training row's sell day is before the fold's first day."""
    start = fold_rows.select("fold", "train_end", F.col("pos").alias("start_pos"))
    return rows.join(F.broadcast(start), rows["dt"] <= start["train_end"]).groupBy("fold").agg(F.count("*").alias("n"), F.bool_and(rows["pos"] + 1 + horizon < F.col("start_pos")).alias("ok"))
