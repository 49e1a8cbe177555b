"""Per-code indicators, cross-sectional ranks and market features. Every function adds columns to bars sorted by (code, dt)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import EPS, both_greatest, both_least, by_code, div, ema_alpha, ewm, lag, pct_rank, rolling, since_sign_change, sma, streak

YEAR = math.sqrt(252)


def _ohlcv() -> list[Column]:
    return [F.col(x) for x in ("open", "high", "low", "close", "volume")]


def moving_averages(df: DataFrame, spans=(5, 25, 75, 200)) -> DataFrame:
    """sma_dev, sma_slope (5 rows) and the signs of neighbouring averages' differences."""
    O, H, L, C, V = _ohlcv()
    df = df.withColumns({f"__s{n}": sma("close", n) for n in spans})
    out = {f"sma_dev_{n}": div(C, F.col(f"__s{n}")) - 1 for n in spans} | {f"sma_slope_{n}": div(F.col(f"__s{n}"), lag(f"__s{n}", 5)) - 1 for n in spans}
    out |= {f"ma_{a}_{b}": F.signum(F.col(f"__s{a}") - F.col(f"__s{b}")) for a, b in zip(spans, spans[1:])}
    return df.withColumns(out).drop(*[f"__s{n}" for n in spans])


def ema_deviation(df: DataFrame, spans=(5, 25, 75, 200)) -> DataFrame:
    O, H, L, C, V = _ohlcv()
    df = ewm(df, {f"__e{n}": ("close", ema_alpha(n), n) for n in spans})
    return df.withColumns({f"ema_dev_{n}": div(C, F.col(f"__e{n}")) - 1 for n in spans}).drop(*[f"__e{n}" for n in spans])


def cross_days(df: DataFrame, fast: int = 25, slow: int = 75) -> DataFrame:
    df = df.withColumn("__x", F.signum(sma("close", fast) - sma("close", slow)))
    return since_sign_change(df, "__x", "cross_days").drop("__x")


def rsi(df: DataFrame, n: int = 14) -> DataFrame:
    O, H, L, C, V = _ohlcv()
    d = C - lag("close")
    df = df.withColumns({"__u": F.when(d.isNotNull(), F.greatest(d, F.lit(0.0))), "__d": F.when(d.isNotNull(), F.greatest(-d, F.lit(0.0)))})
    df = ewm(df, {"__au": ("__u", 1 / n, n), "__ad": ("__d", 1 / n, n)})
    return df.withColumn(f"rsi{n}", 100 - 100 / (1 + F.col("__au") / (F.col("__ad") + EPS))).drop("__u", "__d", "__au", "__ad")


def macd(df: DataFrame) -> DataFrame:
    O, H, L, C, V = _ohlcv()
    df = ewm(df, {"__f": ("close", ema_alpha(12), 12), "__w": ("close", ema_alpha(26), 26)}).withColumn("__m", F.col("__f") - F.col("__w"))
    df = ewm(df, {"__g": ("__m", ema_alpha(9), 9)})
    m, g = F.col("__m"), F.col("__g")
    return df.withColumns({"macd": div(m, C), "macd_sig": div(g, C), "macd_hist": div(m - g, C)}).drop("__f", "__w", "__m", "__g")


def stochastic(df: DataFrame, n: int = 14) -> DataFrame:
    O, H, L, C, V = _ohlcv()
    df = df.withColumns({"__h": rolling(F.max, "high", n), "__l": rolling(F.min, "low", n)})
    span = F.col("__h") - F.col("__l") + EPS
    df = df.withColumns({f"stoch_k{n}": (C - F.col("__l")) / span * 100, f"willr{n}": (F.col("__h") - C) / span * -100})
    return df.withColumn("stoch_d3", sma(f"stoch_k{n}", 3)).drop("__h", "__l")


def average_range(df: DataFrame, spans=(14, 20)) -> DataFrame:
    """Wilder's average true range over the close; the true range skips a missing previous close."""
    O, H, L, C, V = _ohlcv()
    prev = lag("close")
    df = df.withColumn("__tr", F.greatest(H - L, F.abs(H - prev), F.abs(L - prev)))
    df = ewm(df, {f"__a{n}": ("__tr", 1 / n, n) for n in spans})
    return df.withColumns({f"atr{n}p": div(F.col(f"__a{n}"), C) for n in spans}).drop("__tr", *[f"__a{n}" for n in spans])


def bollinger(df: DataFrame, n: int = 20) -> DataFrame:
    O, H, L, C, V = _ohlcv()
    df = df.withColumns({"__m": sma("close", n), "__s": rolling(F.stddev_pop, "close", n)})
    m, s = F.col("__m"), F.col("__s")
    return df.withColumns({"bb_pb": (C - (m - 2 * s)) / (4 * s + EPS), "bb_bw": div(4 * s, m)}).drop("__m", "__s")


def volatility(df: DataFrame, spans=(20, 60)) -> DataFrame:
    O, H, L, C, V = _ohlcv()
    df = df.withColumn("__r", F.ln(div(C, lag("close"))))
    out = {f"hv{n}": rolling(F.stddev_samp, "__r", n) * YEAR for n in spans}
    return df.withColumns(out | {"range_p": div(H - L, C), "gap": div(O, lag("close")) - 1}).drop("__r")


def volume_ratios(df: DataFrame) -> DataFrame:
    O, H, L, C, V = _ohlcv()
    return df.withColumns({"vr5": V / (sma("volume", 5) + EPS), "vr20": V / (sma("volume", 20) + EPS), "adv20_log": F.log1p(sma(C * V, 20))})


def on_balance(df: DataFrame, n: int = 20) -> DataFrame:
    O, H, L, C, V = _ohlcv()
    step = F.coalesce(F.signum(C - lag("close")), F.lit(0.0)) * V
    df = df.withColumn("__s", step).withColumn("__o", F.sum("__s").over(by_code().rowsBetween(Window.unboundedPreceding, 0)))
    return df.withColumn(f"obv{n}", (F.col("__o") - lag("__o", n)) / (rolling(F.sum, "volume", n) + EPS)).drop("__s", "__o")


def money_flow(df: DataFrame, n: int = 14) -> DataFrame:
    O, H, L, C, V = _ohlcv()
    df = df.withColumn("__t", (H + L + C) / 3).withColumn("__p", lag("__t"))
    t, p = F.col("__t"), F.col("__p")
    df = df.withColumns({"__up": F.when(t > p, t * V).otherwise(0.0), "__dn": F.when(t < p, t * V).otherwise(0.0)})
    pos, neg = rolling(F.sum, "__up", n), rolling(F.sum, "__dn", n)
    return df.withColumn(f"mfi{n}", 100 - 100 / (1 + pos / (neg + EPS))).drop("__t", "__p", "__up", "__dn")


def momentum(df: DataFrame) -> DataFrame:
    O, H, L, C, V = _ohlcv()
    out = {f"ret{n}": div(C, lag("close", n)) - 1 for n in (1, 3, 5, 20)} | {f"roc_{n}": div(C, lag("close", n)) - 1 for n in (60, 120)}
    return df.withColumns(out)


def extremes(df: DataFrame, spans=(20, 60, 250)) -> DataFrame:
    O, H, L, C, V = _ohlcv()
    out = {f"dist_hi_{n}": div(C, rolling(F.max, "high", n)) - 1 for n in spans} | {f"dist_lo_{n}": div(C, rolling(F.min, "low", n)) - 1 for n in spans}
    return df.withColumns(out)


def new_extremes(df: DataFrame, n: int = 250) -> DataFrame:
    """1 or 0; null until n rows."""
    O, H, L, C, V = _ohlcv()
    return df.withColumns({f"new_hi{n}": (H >= rolling(F.max, "high", n)).cast("double"), f"new_lo{n}": (L <= rolling(F.min, "low", n)).cast("double")})


def streaks(df: DataFrame) -> DataFrame:
    O, H, L, C, V = _ohlcv()
    df = df.withColumn("__d", C - lag("close"))
    return streak(streak(df, F.col("__d") > 0, "up_streak"), F.col("__d") < 0, "dn_streak").drop("__d")


def pullback(df: DataFrame) -> DataFrame:
    """1 where the close is above its 75-row mean and below that of 3 rows ago while the 25-row mean rises; else 0, null until 75 rows."""
    O, H, L, C, V = _ohlcv()
    df = df.withColumns({"__25": sma("close", 25), "__75": sma("close", 75)})
    cond = (C > F.col("__75")) & (F.col("__25") > lag("__25", 5)) & (C < lag("close", 3))
    return df.withColumn("pullback", F.when(F.col("__75").isNotNull(), F.coalesce(cond, F.lit(False)).cast("double"))).drop("__25", "__75")


def candle_shape(df: DataFrame) -> DataFrame:
    O, H, L, C, V = _ohlcv()
    span = F.nullif(H - L, F.lit(0.0))
    doji = (F.abs(C - O) / span < 0.1).cast("double")
    return df.withColumns({"body": (C - O) / span, "upper_sh": (H - both_greatest(O, C)) / span, "lower_sh": (both_least(O, C) - L) / span, "doji": doji})


def candle_patterns(df: DataFrame) -> DataFrame:
    """Comparisons with a missing previous bar are false."""
    O, H, L, C, V = _ohlcv()
    df = df.withColumns({"__o": lag("open"), "__c": lag("close"), "__h": lag("high"), "__l": lag("low")})
    o, c = F.col("__o"), F.col("__c")
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    bull = (C > O) & (c < o) & (O <= c) & (C >= o)
    bear = (C < O) & (c > o) & (O >= c) & (C <= o)
    inside = (both_greatest(O, C) < both_greatest(o, c)) & (both_least(O, C) > both_least(o, c))
    out = {"engulf": flag(bull) - flag(bear), "harami": flag(inside) * F.signum(C - O), "gap_flag": flag(L > F.col("__h")) - flag(H < F.col("__l"))}
    return df.withColumns(out).drop("__o", "__c", "__h", "__l")


def relative_strength(df: DataFrame, index: DataFrame, spans=(20, 60)) -> DataFrame:
    """Growth against that of the index on the same dates."""
    O, H, L, C, V = _ohlcv()
    df = df.join(index, "dt", "left")
    out = {f"rs{n}": div(div(C, lag("close", n)), div(F.col("ix"), lag("ix", n))) - 1 for n in spans}
    return df.withColumns(out).drop("ix")


def market(index: DataFrame, other: DataFrame | None = None) -> DataFrame:
    """dt and market features of one index series; with another series also the 20-row change of their ratio."""
    df = index.withColumn("code", F.lit("index"))
    if other is not None:
        df = df.join(other.withColumnRenamed("ix", "ix2"), "dt", "left").withColumn("__q", div(F.col("ix"), F.col("ix2")))
    x = F.col("ix")
    df = df.withColumn("__r", F.ln(div(x, lag("ix")))).withColumn("__m", sma("ix", 200))
    out = {f"mk_ret{n}": div(x, lag("ix", n)) - 1 for n in (1, 5, 20)}
    out |= {"mk_above200": (x > F.col("__m")).cast("double"), "mk_vol20": rolling(F.stddev_samp, "__r", 20) * YEAR}
    if other is not None:
        out["mk_nt20"] = div(F.col("__q"), lag("__q", 20)) - 1
    return df.withColumns(out).drop("code", "__r", "__m", "__q", "ix2")


def breadth(df: DataFrame, ret: str = "ret1", n: int = 5) -> DataFrame:
    """dt, breadth5: the mean over n dates of rising over falling codes; null if one has no falling code."""
    per = df.groupBy("dt").agg(F.count_if(F.col(ret) > 0).alias("up"), F.count_if(F.col(ret) < 0).alias("dn"))
    w = Window.orderBy("dt")  # a row for each date
    per = per.withColumn("q", div(F.col("up").cast("double"), F.col("dn").cast("double")))
    return per.select("dt", (sum((F.lag("q", i).over(w) for i in range(1, n)), F.col("q")) / n).alias(f"breadth{n}"))


def sector_features(df: DataFrame, least: int = 1) -> DataFrame:
    """Mean 20-row return of the sector and the rank within it, where it has at least `least` values."""
    w = Window.partitionBy("dt", "sector")
    enough = F.count("ret20").over(w) >= least
    return df.withColumns({"sec_ret20": F.when(enough, F.avg("ret20").over(w)), "sec_rank20": F.when(enough, pct_rank("ret20", ["dt", "sector"]))})


def ranks(df: DataFrame, cols: list[str]) -> DataFrame:
    """r_<col> for each: the share of the day's values at or below, ties averaged, as 32-bit floats ranked as 32-bit floats."""
    df = df.withColumns({c: F.col(c).cast("float") for c in cols})
    return df.withColumns({f"r_{c}": pct_rank(c, ["dt"]).cast("float") for c in cols})
