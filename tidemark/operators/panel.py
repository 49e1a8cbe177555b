"""Calendar-aligned panels: adjustment factors, price bands, universe membership and data quality."""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import both_greatest, by_code, div, lag, lead, rolling

#: Daily price-limit bands of the exchange (base below the first number: the second is the limit).
LIMIT_BANDS = (
    (100, 30), (200, 50), (500, 80), (700, 100), (1000, 150), (1500, 300), (2000, 400), (3000, 500), (5000, 700), (7000, 1000), (10000, 1500), (15000, 3000),
    (20000, 4000), (30000, 5000), (50000, 7000), (70000, 10000), (100000, 15000), (150000, 30000), (200000, 40000), (300000, 50000), (500000, 70000),
    (700000, 100000), (1000000, 150000), (1500000, 300000), (2000000, 400000), (3000000, 500000), (5000000, 700000), (7000000, 1000000), (10000000, 1500000),
    (15000000, 3000000), (20000000, 4000000), (30000000, 5000000), (50000000, 7000000),
)
LIMIT_ABOVE = 10000000
#: One-way slippage by average traded value.
SLIPPAGE = ((1e9, 0.0010), (3e8, 0.0015), (1e8, 0.0025))
#: Split ratios that a price jump is matched against, within 5 %.
NICE_RATIOS = (1.1, 1.2, 1.25, 1.5, 2, 2.5, 3, 4, 5, 10, 20, 25, 50, 100, 200, 300, 500, 1000)


def limit_width(base: Column) -> Column:
    """The day's price limit; a base on a bound is in the next band, null for null."""
    out = F.when(base.isNull(), F.lit(None).cast("double"))
    for bound, width in LIMIT_BANDS:
        out = out.when(base < bound, float(width))
    return out.otherwise(float(LIMIT_ABOVE))


def slippage(adv: Column) -> Column:
    """The rate of the highest threshold reached; null and small values get the worst."""
    out = F.when(adv >= SLIPPAGE[0][0], SLIPPAGE[0][1])
    for least, rate in SLIPPAGE[1:]:
        out = out.when(adv >= least, rate)
    return out.otherwise(SLIPPAGE[-1][1])


def year_end(dt: Column) -> Column:
    """The exchange's closed days round the new year: 12/31 and 1/1 to 1/3."""
    return ((F.month(dt) == 12) & (F.day(dt) == 31)) | ((F.month(dt) == 1) & (F.day(dt) <= 3))


def business_days(bars: DataFrame, holidays: DataFrame, open_new_year: bool = True) -> DataFrame:
    """dt, pos: weekdays between the first and last date with volume, without holidays and, if so asked, the days round the new year."""
    ends = bars.where("volume > 0").agg(F.min("dt").alias("a"), F.max("dt").alias("b"))
    days = ends.select(F.explode(F.sequence("a", "b")).alias("dt")).where(F.weekday("dt") < 5).join(F.broadcast(holidays.select("dt").distinct()), "dt", "left_anti")
    days = days if open_new_year else days.where(~year_end(F.col("dt")))
    return days.withColumn("pos", F.row_number().over(Window.orderBy("dt")) - 1)  # a row for each day of the calendar


def calendar_mismatch(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """dt, side: dates that only the calendar (missing) or only the bars (extra) have."""
    seen = bars.where("volume > 0").select("dt").distinct()
    days = calendar.select("dt")
    return days.join(seen, "dt", "left_anti").withColumn("side", F.lit("missing")).union(seen.join(days, "dt", "left_anti").withColumn("side", F.lit("extra")))


def split_factor(df: DataFrame, ratio: str = "split", out: str = "factor") -> DataFrame:
    """df with the product of all splits after each row; ratios of 0 or null are none."""
    df = df.withColumn("__r", F.when(F.col(ratio) > 0, F.col(ratio)).otherwise(1.0))
    after = by_code().rowsBetween(1, Window.unboundedFollowing)
    return df.withColumn(out, F.coalesce(F.product("__r").over(after), F.lit(1.0))).drop("__r")


def undo_later_splits(bars: DataFrame, as_of) -> DataFrame:
    """Bars up to a date as they stood then: splits after it are taken back from prices, dividends and volumes."""
    later = bars.where(F.col("dt") > as_of).where("split > 0").groupBy("code").agg(F.product("split").alias("__f"))
    df = bars.where(F.col("dt") <= as_of).join(later, "code", "left").withColumn("__f", F.coalesce("__f", F.lit(1.0)))
    scaled = {c: F.col(c) * F.col("__f") for c in ("open", "high", "low", "close", "dividend")}
    return df.withColumns(scaled | {"volume": F.col("volume") / F.col("__f")}).drop("__f")


def splits_between(rows: DataFrame, actions: DataFrame) -> DataFrame:
    """rows (code, after, upto, ...) with ratio: the product of the code's splits with after < dt <= upto, 1 without any.

    Splits are few, so the join by code meets a handful of them for each row. Rows must be distinct.
    """
    s = actions.where("split > 0").select(F.col("code").alias("__c"), "dt", "split")
    hit = (F.col("code") == F.col("__c")) & (F.col("dt") > F.col("after")) & (F.col("dt") <= F.col("upto"))
    return rows.join(s, hit, "left").groupBy(*rows.columns).agg(F.coalesce(F.product("split"), F.lit(1.0)).alias("ratio"))


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, default) -> DataFrame:
    """df with the value of the table's one row for its key, or the default."""
    return df.join(table.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def clean_actions(bars: DataFrame, low: float = 0.00099, high: float = 1001.0, most: float = 0.3) -> DataFrame:
    """Splits out of range are set to 0 and their ratio given to earlier dividends; dividends above a share of the previous close are 0."""
    bad = F.when((F.col("split") != 0) & ((F.col("split") < low) | (F.col("split") > high)), F.col("split")).otherwise(1.0)
    df = bars.withColumn("__b", bad)
    df = df.withColumn("dividend", F.col("dividend") * F.coalesce(F.product("__b").over(by_code().rowsBetween(1, Window.unboundedFollowing)), F.lit(1.0)))
    df = df.withColumn("split", F.when(F.col("__b") != 1.0, 0.0).otherwise(F.col("split"))).drop("__b")
    return df.withColumn("dividend", F.when(F.col("dividend") > most * lag("close"), 0.0).otherwise(F.col("dividend")))


def align(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Every code on every calendar day between its first and last bar: tradable, listed_days, close carried forward, no other prices where not tradable."""
    days = F.broadcast(calendar.select("dt", "pos"))
    ends = bars.groupBy("code").agg(F.min("dt").alias("__a"), F.max("dt").alias("__b"))
    grid = ends.select("code", F.explode(F.sequence("__a", "__b")).alias("dt")).join(days, "dt").select("code", "dt", "pos")  # an equality join with the days
    df = grid.join(bars, ["code", "dt"], "left")
    prices = [F.col(c) for c in ("open", "high", "low", "close")]
    tradable = F.coalesce(F.col("volume") > 0, F.lit(False))
    for p in prices:
        tradable = tradable & p.isNotNull()
    df = df.withColumns({"tradable": tradable, "listed_days": F.row_number().over(by_code())})
    keep = {c: F.when(F.col("tradable"), F.col(c)) for c in ("open", "high", "low")}
    carried = F.last("close", ignorenulls=True).over(by_code().rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumns(keep | {"close": carried, "volume": F.when(F.col("tradable"), F.col("volume")).otherwise(0.0)})


def traded_value(df: DataFrame, factor: Column | None = None) -> DataFrame:
    """close_u, open_u (unadjusted), tv and its 20-row mean adv20."""
    factor = F.lit(1.0) if factor is None else factor
    df = df.withColumns({"close_u": F.col("close") * factor, "open_u": F.col("open") * factor, "tv": F.col("close") * F.col("volume")})
    return df.withColumn("adv20", rolling(F.avg, "tv", 20))


def stop_flags(df: DataFrame, factor: Column | None = None) -> DataFrame:
    """stop_high and stop_low: the open stands at the limit up or down from the previous unadjusted close."""
    base = lag("close") * (F.lit(1.0) if factor is None else factor)
    df = df.withColumn("__b", base).withColumn("__w", limit_width(F.col("__b")))
    high, low = F.col("open_u") >= (F.col("__b") + F.col("__w")) * 0.999, F.col("open_u") <= (F.col("__b") - F.col("__w")) * 1.001
    return df.withColumns({"stop_high": F.coalesce(high, F.lit(False)), "stop_low": F.coalesce(low, F.lit(False))}).drop("__b", "__w")


def universe(df: DataFrame, min_adv: float, min_close: float, min_days: int) -> DataFrame:
    """in_univ, and failed: the first of the conditions that a row misses."""
    tests = [("tradable", F.col("tradable")), ("adv", F.col("adv20") >= min_adv), ("close", F.col("close_u") >= min_close), ("listed", F.col("listed_days") >= min_days)]
    failed = F.lit(None).cast("string")
    for name, ok in reversed(tests):
        failed = F.when(~F.coalesce(ok, F.lit(False)), name).otherwise(failed)
    return df.withColumn("failed", failed).withColumn("in_univ", F.col("failed").isNull())


def index_universe(df: DataFrame, min_adv: float, min_close: float, min_days: int) -> DataFrame:
    """universe for rows with member: in_univ needs membership too; failed is `member` for others, else the first condition missed.
    young marks members listed for too few days, whatever else they miss."""
    df = universe(df, min_adv, min_close, min_days)
    member = F.coalesce("member", F.lit(False))
    failed = F.when(~member, "member").otherwise(F.col("failed"))
    young = member & ~F.coalesce(F.col("listed_days") >= min_days, F.lit(False))
    return df.withColumns({"failed": failed, "young": young}).withColumn("in_univ", F.col("failed").isNull())


def universe_counts(df: DataFrame) -> DataFrame:
    """member_rows, not_tradable, adv, close, listed, in_univ of index_universe's rows, each row counted at the first condition it
    misses, and young_codes, the codes that ever are members too young."""
    at = lambda name: F.count_if(F.col("failed") == name)
    return df.agg(
        F.count_if(F.coalesce(F.col("failed") != "member", F.lit(True))).alias("member_rows"), at("tradable").alias("not_tradable"), at("adv").alias("adv"), at("close").alias("close"), at("listed").alias("listed"),
        F.count_if("in_univ").alias("in_univ"), F.count_distinct(F.when(F.col("young"), F.col("code"))).alias("young_codes"),
    )


def index_tradable(df: DataFrame, prefix: str = "IDX_") -> DataFrame:
    """aligned rows with tradable set for index codes, which have closes only: on days with a close of their own (own_close)."""
    index = F.col("code").startswith(prefix)
    return df.withColumn("tradable", F.when(index, F.col("own_close").isNotNull()).otherwise(F.col("tradable")))


def filled(df: DataFrame, column: str, out: str) -> DataFrame:
    """df with out: the column's next value of the code where it is null, behind the last one the one before."""
    after = F.first(column, ignorenulls=True).over(by_code().rowsBetween(0, Window.unboundedFollowing))
    before = F.last(column, ignorenulls=True).over(by_code().rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(out, F.coalesce(after, before))


def add_business_days(df: DataFrame, calendar: DataFrame, n: int, column: str = "dt", out: str = "then") -> DataFrame:
    """df with out: the day n places behind the column's in the calendar (dt, pos), from a day off on counted from the one before it
    (n > 0) or behind it (n < 0); null beyond the calendar's ends. The calendar has a row for each day."""
    days = calendar.select(F.col("dt").alias("__d"), F.col("pos").cast("long").alias("__p"))
    spans = days.withColumn("__next", F.lead("__d").over(Window.orderBy("__d")))
    every = spans.select("__d", "__p", F.explode(F.when(F.col("__next").isNull(), F.array("__d")).otherwise(F.sequence("__d", F.date_sub("__next", 1)))).alias("__day"))
    back = F.lit(1 if n < 0 else 0) * (F.col("__day") != F.col("__d")).cast("long")
    place = F.broadcast(every.select("__day", (F.col("__p") + back + n).alias("__to")))
    target = F.broadcast(days.select(F.col("__d").alias(out), F.col("__p").alias("__to")))
    return df.join(place, df[column] == place["__day"], "left").join(target, "__to", "left").drop("__day", "__to")


def quality(bars: DataFrame, calendar: DataFrame, holdout=None) -> DataFrame:
    """check, rows: how many bars fail each of ten checks; with a holdout date also rows_before, those before it."""
    df = bars.join(F.broadcast(calendar.select("dt", F.lit(True).alias("__on"))), "dt", "left")
    same = F.row_number().over(Window.partitionBy("code", "dt").orderBy(*[F.col(c).asc_nulls_first() for c in ("open", "high", "low", "close", "volume", "split")]))
    df = df.withColumns({"__n": same, "__ret": div(F.col("close"), F.lag("close").over(Window.partitionBy("code").orderBy("dt", F.col("split").asc_nulls_first()))) - 1})
    o, h, low, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))
    jump = F.abs(F.col("__ret")) > 0.5
    missed = (F.col("split") > 0) & (F.col("split") != 1) & (F.abs((1 + F.col("__ret")) * F.col("split") - 1) < 0.15)
    checks = {
        "missing_ohlc": o.isNull() | h.isNull() | low.isNull() | c.isNull(), "duplicate_key": F.col("__n") > 1, "price_not_positive": (o <= 0) | (h <= 0) | (low <= 0) | (c <= 0),
        "high_too_low": h < F.greatest(o, c) * (1 - 1e-9), "low_too_high": low > F.least(o, c) * (1 + 1e-9), "no_volume": v == 0, "big_move": jump, "split_missed": missed,
        "weekend": F.weekday("dt") >= 5, "off_calendar": F.col("__on").isNull(),
    }
    past = F.lit(False) if holdout is None else F.col("dt") < holdout
    counts = df.agg(*[F.count_if(F.coalesce(x & y, F.lit(False))).alias(f"{p}{k}") for k, x in checks.items() for p, y in (("", F.lit(True)), ("b_", past))])
    out = counts.select(F.expr(f"stack({len(checks)}, {', '.join(f"'{k}', {k}, b_{k}" for k in checks)}) as (check, rows, rows_before)"))
    return out.drop("rows_before") if holdout is None else out


def big_moves(bars: DataFrame, least: float = 0.5) -> DataFrame:
    df = bars.withColumn("ret", div(F.col("close"), lag("close")) - 1)
    return df.where(F.abs("ret") > least).select("code", "dt", "ret")


def split_missed(bars: DataFrame, near: float = 0.15) -> DataFrame:
    """Split days on which the price still moved by about the split's ratio."""
    df = bars.withColumn("ret", div(F.col("close"), lag("close")) - 1)
    return df.where((F.col("split") > 0) & (F.col("split") != 1) & (F.abs((1 + F.col("ret")) * F.col("split") - 1) < near)).select("code", "dt", "ret", "split")


def data_holes(bars: DataFrame, share: float = 0.05, half: int = 10, least: int = 5) -> DataFrame:
    """dt, n, typical: days whose number of traded codes is below a share of the median of the 21 days around."""
    per = bars.where("volume > 0").groupBy("dt").agg(F.count("*").alias("n"))
    w = Window.orderBy("dt").rowsBetween(-half, half)  # a row for each day
    per = per.withColumn("typical", F.when(F.count("n").over(w) >= least, F.percentile("n", F.lit(0.5)).over(w)))
    return per.where(F.col("n") < share * F.col("typical"))


def nice_ratio(ratio: float) -> float:
    """The listed ratio nearest in proportion (or the inverse of one, below 1) if it is less than 5 % away, else the ratio itself."""
    up = ratio if ratio > 1 else 1 / ratio
    best = min(NICE_RATIOS, key=lambda k: abs(k / up - 1))
    up = float(best) if abs(best / up - 1) < 0.05 else up
    return up if ratio > 1 else 1 / up


def _too_far(price: Column, base: Column, factor: Column) -> Column:
    """Whether an adjusted price is further from an adjusted base than twice the limit of the base as it stood on the day."""
    return F.coalesce(F.abs(price - base) * factor > 2 * limit_width(base * factor) + 1e-9, F.lit(False))


def repair(bars: DataFrame, limit: int = 3, back: float = 0.3, index_prefix: str = "IDX_") -> DataFrame:
    """Bars with price jumps mended, in date order within each code.

    Moves are measured in prices as they stood: adjusted ones times the product of the splits after the day. A close that moves
    by more than twice the day's limit is a spike if one of the next `limit` closes is less than `back` away from the level
    before: the rows up to that one lose their prices. Otherwise it is a split that was missed: its nice_ratio is written to the
    row, unless a split within 5 % of it stands there, and all earlier prices, dividends and volumes are scaled. At the end
    opens more than twice the limit from the close before are lost. Index codes stay as they are.

    Factors, jumps and opens are window expressions. Only codes with a jump go to a Python group, because each repair changes
    what the next jump is measured against; a code's rows are bounded by the calendar. Null prices are never jumps.
    """
    prices, index = ["open", "high", "low", "close"], F.col("code").startswith(index_prefix)
    df = split_factor(bars, out="__f")
    df = df.withColumn("__jump", ~index & _too_far(F.col("close"), lag("close"), F.col("__f")))
    df = df.withColumn("__any", F.max("__jump").over(Window.partitionBy("code")))

    def mend(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("dt", kind="stable").reset_index(drop=True)
        close, factor, split = g["close"].to_numpy(float, copy=True), g["__f"].to_numpy(), g["split"].to_numpy(float, copy=True)
        scale, lost, resume = np.ones(len(g)), np.zeros(len(g), dtype=bool), 0
        for i in np.flatnonzero(g["__jump"]):
            before = close[i - 1]
            if i < resume or not (before > 0 and np.isfinite(close[i])):
                continue
            if abs(close[i] - before) * factor[i] <= 2 * width_of(before * factor[i]) + 1e-9:  # mended with an earlier jump
                continue
            home = np.flatnonzero(np.abs(close[i + 1 : i + 1 + limit] / before - 1) < back)
            if len(home):
                resume = i + 2 + home[0]
                lost[i : resume - 1], close[i : resume - 1] = True, np.nan
                continue
            ratio = nice_ratio(before / close[i])
            scale[:i] *= ratio
            close[:i] /= ratio
            if not (split[i] > 0 and abs(split[i] / ratio - 1) < 0.05):
                split[i] = ratio
        g[[*prices, "dividend"]] = g[[*prices, "dividend"]].div(scale, axis=0)
        g["volume"], g["split"] = g["volume"] * scale, split
        g.loc[lost, prices] = np.nan
        return g

    wild = df.where("__any").groupBy("code").applyInPandas(mend, df.schema)
    wild = wild.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in prices})
    df = df.where("not coalesce(__any, false)").unionByName(wild).select(*bars.columns)
    df = split_factor(df, out="__f")
    lost = ~index & _too_far(F.col("open"), lag("close"), F.col("__f"))
    return df.withColumn("__lost", lost).withColumn("open", F.when(~F.col("__lost"), F.col("open"))).select(*bars.columns)


def width_of(base: float) -> float:
    """limit_width of one number."""
    at = bisect.bisect_right([b for b, _ in LIMIT_BANDS], base)
    return float(LIMIT_BANDS[at][1] if at < len(LIMIT_BANDS) else LIMIT_ABOVE)


def conform(df: DataFrame) -> DataFrame:
    """High and low widened to hold open and close, where none of the three is missing."""
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    wide = F.when(low.isNotNull() & o.isNotNull() & c.isNotNull(), F.least(o, low, c))
    return df.withColumns({"high": both_greatest(o, h, c), "low": wide})


def next_bar(df: DataFrame, n: int = 1) -> DataFrame:
    return df.withColumns({"buy_dt": lead("dt", 1), "sell_dt": lead("dt", 1 + n)})
