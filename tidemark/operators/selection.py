"""Choosing among tried strategies, held-out verdicts and the final ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import pct_rank
from .metrics import resampled
from .panel import slippage

#: How simple the families of scores are, simplest first.
SIMPLICITY = {"M1": 1, "M2a": 2, "M2b": 2, "M3": 3, "M4r": 4, "M4c": 4, "M5": 4, "M6": 5, "M7": 5}


def spec_columns(df: DataFrame, spec: str = "spec") -> DataFrame:
    """family, n, k, theta, gmax, regime from text like M4r|N10|K3|th0.2|g0.05|none; gNone is null."""
    p = F.split(spec, r"\|")
    tail = lambda i, a, t: F.substring(F.get(p, F.lit(i)), a, 99).try_cast(t)
    return df.withColumns({"family": F.get(p, F.lit(0)), "n": tail(1, 2, "long"), "k": tail(2, 2, "long"), "theta": tail(3, 3, "double"), "gmax": tail(4, 2, "double"), "regime": F.get(p, F.lit(5))})


def difference_blocks(a: DataFrame, b: DataFrame, size: int = 20) -> DataFrame:
    """block, mean of the daily differences of two return series (dt, ret) on common dates; an incomplete last block is left out."""
    d = a.select("dt", F.col("ret").alias("x")).join(b.select("dt", F.col("ret").alias("y")), "dt").withColumn("d", F.col("x") - F.col("y")).where("d is not null")
    d = d.withColumn("block", F.floor((F.row_number().over(Window.orderBy("dt")) - 1) / size))  # two daily series
    return d.groupBy("block").agg(F.avg("d").alias("mean"), F.count("*").alias("n")).where(F.col("n") == size).drop("n")


def difference_ci(a: DataFrame, b: DataFrame, size: int = 20, draws: int = 1000, seed: int = 42) -> DataFrame:
    """low, high: the 95 % interval of the mean daily difference by block bootstrap, one row; nulls with fewer than two blocks."""
    blocks = difference_blocks(a, b, size).select(F.lit("d").alias("__one"), "block", F.col("mean").alias("total"), F.lit(1).alias("n"))
    means = resampled(blocks, ["__one"], draws, seed)
    few = F.count_if(F.col("__k") < 2) > 0
    means = means.join(F.broadcast(blocks.agg(F.count("*").alias("__k"))))  # one row
    return means.agg(*[F.when(~few, F.percentile("mean", F.lit(p))).alias(n) for n, p in (("low", 0.025), ("high", 0.975))])


def choose(grid: DataFrame, returns: DataFrame, margin: float = 0.2) -> dict | None:
    """The chosen row of grid (id, family, sharpe, passed): the best that passed, unless a simpler family's best is as good.

    Families are tried from the simplest; one is as good if its Sharpe ratio is less than margin below or the interval of the
    difference of daily returns (id, dt, ret) holds zero. None if nothing passed.
    """
    level = F.coalesce(*[F.when(F.col("family") == k, v) for k, v in SIMPLICITY.items()], F.lit(99))
    best = grid.where("passed").withColumn("level", level)
    firsts = best.withColumn("r", F.row_number().over(Window.partitionBy("level").orderBy(F.desc("sharpe"), "id"))).where("r = 1").drop("r")
    rows = sorted((r.asDict() for r in firsts.collect()), key=lambda r: r["level"])
    if not rows:
        return None
    top = max(rows, key=lambda r: r["sharpe"])
    for r in rows:
        if r["level"] >= top["level"]:
            break
        ci = difference_ci(returns.where(F.col("id") == top["id"]), returns.where(F.col("id") == r["id"])).first()
        if top["sharpe"] - r["sharpe"] < margin or (ci["low"] is not None and ci["low"] <= 0 <= ci["high"]):
            return r
    return top


def neighbours(grid: DataFrame, steps: dict[str, list]) -> DataFrame:
    """id, worst: the smallest ratio of a neighbour's Sharpe ratio to a strategy's own, where one parameter moves one step."""
    out = None
    for name, values in steps.items():
        place = F.array_position(F.array(*[F.lit(v) for v in values]), F.col(name))
        a = grid.select("id", "sharpe", *[F.col(c).alias(f"a_{c}") for c in steps if c != name], place.alias("at"))
        b = grid.select(F.col("sharpe").alias("other"), *[F.col(c).alias(f"b_{c}") for c in steps if c != name], place.alias("to"))
        on = F.abs(F.col("at") - F.col("to")) == 1
        for c in steps:
            if c != name:
                on = on & F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
        part = a.join(b, on).select("id", (F.col("other") / F.nullif(F.col("sharpe"), F.lit(0.0))).alias("ratio"))
        out = part if out is None else out.union(part)
    return out.groupBy("id").agg(F.min("ratio").alias("worst"))


def holdout_verdict(measures: DataFrame, wf_sharpe: float, min_cagr: float = 0.0, min_ratio: float = 0.4, beats: tuple[str, ...] = ()) -> DataFrame:
    """measures (cagr, sharpe) with pass_cagr, pass_sharpe and passed; nulls fail. Each column of beats holds a baseline's Sharpe ratio
    over the same days, which has to be exceeded: pass_<column>."""
    tests = {"pass_cagr": F.coalesce(F.col("cagr") > min_cagr, F.lit(False)), "pass_sharpe": F.coalesce(F.col("sharpe") >= min_ratio * wf_sharpe, F.lit(False))}
    tests |= {f"pass_{c}": F.coalesce(F.col("sharpe") > F.col(c), F.lit(False)) for c in beats}
    passed = F.lit(True)
    for ok in tests.values():
        passed = passed & ok
    return measures.withColumns(tests | {"passed": passed})


def ranking(today: DataFrame, slots: int, theta: float, hold: int, gmax: float | None, capital: float = 1e7, part: float = 0.01, lot: int = 100) -> DataFrame:
    """rank, code, score, share, limit_price, shares, risks for the best of one day's rows (code, sector, score, close_u, adv20, atr14p).

    Sizes are whole lots of the smaller of an equal allocation and a share of ADV at the limit price; risks list high volatility
    (the day's top tenth), the limit, thin trading and sectors that occur twice or more.
    """
    every = Window.partitionBy(F.lit(1))  # one day's rows
    df = today.withColumns({"one": F.lit(1), "n": F.count("*").over(every), "q90": F.percentile("atr14p", F.lit(0.9)).over(every)})
    df = df.withColumn("share", pct_rank("score", ["one"], descending=True)).withColumn("rank", F.row_number().over(every.orderBy(F.desc_nulls_last("score"), "code")))
    df = df.where(F.col("score").isNotNull() & (F.col("rank") <= F.least(F.lit(slots), F.greatest(F.lit(1), F.floor(theta * F.col("n"))))))
    limit = F.lit(None).cast("double") if gmax is None else F.col("close_u") * (1 + gmax)
    df = df.withColumns({"limit_price": limit, "same": F.count("*").over(Window.partitionBy("sector"))})
    price = F.coalesce("limit_price", "close_u")
    size = F.floor(F.least(F.lit(capital / hold / slots), part * F.col("adv20")) / (price * lot)) * lot
    risks = F.array_compact(F.array(
        F.when(F.col("atr14p") >= F.col("q90"), "high volatility"), F.when(F.col("limit_price").isNotNull(), "no fill above the limit"),
        F.when(slippage(F.col("adv20")) > 0.0015, "thin trading"), F.when(F.col("same") >= 2, "sector concentration"),
    ))
    return df.select(F.col("rank").cast("long").alias("rank"), "code", "score", "share", "limit_price", size.cast("long").alias("shares"), risks.alias("risks"))
