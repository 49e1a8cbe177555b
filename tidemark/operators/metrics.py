"""Performance of value series and trades, gates, and multiple-testing corrections."""

from __future__ import annotations

import math
from statistics import NormalDist, stdev

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import div
from ..functions.normal import cdf, ppf

YEAR = 252
EULER = 0.5772156649
GATES = {"min_trades": 300, "per_year": 30, "ci_low": 0.0, "pos_years": 0.6, "max_year": 0.5, "top5": 0.3, "ex_top": 0.0, "cost2": 0.0, "mdd": -0.35}


def daily_returns(nav: DataFrame, by: list[str], capital: float) -> DataFrame:
    """nav (by, dt, nav) with ret: against the row before, the first against the capital."""
    w = Window.partitionBy(*by).orderBy("dt")
    return nav.withColumn("ret", F.col("nav") / F.coalesce(F.lag("nav").over(w), F.lit(capital)) - 1)


def sharpe(x: str = "ret") -> Column:
    return div(F.avg(x), F.stddev_samp(x)) * YEAR**0.5


def summary(returns: DataFrame, by: list[str], capital: float) -> DataFrame:
    """days, total, cagr, vol, sharpe, sortino by series. Sortino's lower deviation is over all days; null without a loss."""
    down = F.least(F.col("ret"), F.lit(0.0))
    last = F.max_by("nav", "dt")
    df = returns.groupBy(*by).agg(
        F.count("*").alias("days"), (last / capital - 1).alias("total"), last.alias("__l"), (F.stddev_samp("ret") * YEAR**0.5).alias("vol"), sharpe().alias("sharpe"),
        F.when(F.min("ret") < 0, F.avg("ret") / F.sqrt(F.avg(down * down)) * YEAR**0.5).alias("sortino"),
    )
    return df.withColumn("cagr", F.when(F.col("__l") > 0, F.pow(F.col("__l") / capital, YEAR / F.col("days")) - 1).otherwise(-1.0)).drop("__l")


def drawdown(nav: DataFrame, by: list[str]) -> DataFrame:
    """mdd, peak_dt, trough_dt, recovered_dt by series: the deepest fall below a running maximum, when the value first stood at that maximum, and when it was first there again (else the last date)."""
    run = Window.partitionBy(*by).orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    df = nav.withColumn("top", F.max("nav").over(run)).withColumn("dd", F.col("nav") / F.col("top") - 1)
    low = df.groupBy(*by).agg(F.min_by(F.struct("dd", "dt", "top"), F.struct("dd", "dt")).alias("m"), F.max("dt").alias("last")).select(*by, F.col("m.dd").alias("mdd"), F.col("m.dt").alias("trough_dt"), F.col("m.top").alias("level"), "last")
    both = nav.join(low, by) if by else nav.crossJoin(F.broadcast(low))
    peak = F.min(F.when((F.col("nav") == F.col("level")) & (F.col("dt") <= F.col("trough_dt")), F.col("dt")))
    back = F.min(F.when((F.col("nav") >= F.col("level")) & (F.col("dt") >= F.col("trough_dt")), F.col("dt")))
    return both.groupBy(*by, "mdd", "trough_dt", "last").agg(peak.alias("peak_dt"), back.alias("__r")).withColumn("recovered_dt", F.coalesce("__r", "last")).drop("__r", "last")


def calmar(returns: DataFrame, by: list[str], capital: float) -> DataFrame:
    """calmar by series: yearly growth over the depth of the deepest fall; null for a series that never falls."""
    run = Window.partitionBy(*by).orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    df = returns.withColumn("__dd", F.col("nav") / F.max("nav").over(run) - 1)
    last = F.max_by("nav", "dt")
    growth = F.when(last > 0, F.pow(last / capital, YEAR / F.count("*")) - 1).otherwise(-1.0)
    return df.groupBy(*by).agg(F.when(F.min("__dd") < 0, growth / -F.min("__dd")).alias("calmar"))


def year_returns(nav: DataFrame, by: list[str], capital: float) -> DataFrame:
    """year, ret, pnl, days, share by series: from one year's last value to the next's; share of all years' profit, null unless that is positive."""
    per = nav.groupBy(*by, F.year("dt").alias("year")).agg(F.max_by("nav", "dt").alias("last"), F.count("*").alias("days"))
    w = Window.partitionBy(*by).orderBy("year")
    per = per.withColumn("before", F.coalesce(F.lag("last").over(w), F.lit(capital)))
    per = per.withColumns({"ret": F.col("last") / F.col("before") - 1, "pnl": F.col("last") - F.col("before")})
    total = F.sum("pnl").over(Window.partitionBy(*by))
    return per.withColumn("share", F.when(total > 0, F.col("pnl") / total)).drop("last", "before")


def compounded(returns: DataFrame, by: list[Column | str]) -> DataFrame:
    return returns.groupBy(*by).agg((F.product(1 + F.col("ret")) - 1).alias("ret"), F.count("*").alias("days"))


def trade_stats(trades: DataFrame, by: list[str]) -> DataFrame:
    """n, win_rate, avg_win, avg_loss, payoff, expectancy, profit_factor, top5_share, ex_top1 by series of trades (code, buy_dt, exit_dt, ret, pnl)."""
    win, loss = F.when(F.col("ret") > 0, F.col("ret")), F.when(F.col("ret") <= 0, F.col("ret"))
    lost = F.sum(F.when(F.col("pnl") <= 0, F.col("pnl")))
    base = trades.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg((F.col("ret") > 0).cast("double")).alias("win_rate"), F.avg(win).alias("avg_win"), F.avg(loss).alias("avg_loss"), F.avg("ret").alias("expectancy"),
        F.sum("pnl").alias("__p"), (F.coalesce(F.sum(F.when(F.col("pnl") > 0, F.col("pnl"))), F.lit(0.0)) / F.nullif(F.abs(lost), F.lit(0.0))).alias("profit_factor"),
    ).withColumn("payoff", F.when(F.col("avg_loss") < 0, F.col("avg_win") / F.abs("avg_loss")))
    stocks = trades.groupBy(*by, "code").agg(F.sum("pnl").alias("pnl")).withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("pnl"), "code")))
    top = stocks.where("r <= 5").groupBy(*by).agg(F.sum("pnl").alias("__t"))
    w = Window.partitionBy(*by)
    rest = trades.withColumns({"__r": F.row_number().over(w.orderBy(F.desc("pnl"), "code", "buy_dt")), "__n": F.count("*").over(w)})
    rest = rest.where(F.col("__r") > F.greatest(F.lit(1), F.ceil(F.col("__n") * 0.01))).groupBy(*by).agg(F.avg("ret").alias("ex_top1"))
    out = base.join(top, by, "left").join(rest, by, "left")
    return out.withColumn("top5_share", F.when(F.col("__p") > 0, F.col("__t") / F.col("__p"))).drop("__p", "__t")


def trades_by_year(trades: DataFrame, by: list[str]) -> DataFrame:
    """year, n: trades by the year of their buy."""
    return trades.groupBy(*by, F.year("buy_dt").alias("year")).agg(F.count("*").alias("n"))


def losing_streak(trades: DataFrame, by: list[str]) -> DataFrame:
    """longest: the longest run of trades without profit, in order of exit."""
    w = Window.partitionBy(*by).orderBy("exit_dt", "code", "buy_dt")
    df = trades.withColumn("lost", (F.col("ret") <= 0).cast("int")).withColumn("run", F.sum(1 - F.col("lost")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.groupBy(*by, "run").agg(F.sum("lost").alias("k")).groupBy(*by).agg(F.max("k").alias("longest"))


def sector_share(trades: DataFrame, by: list[str]) -> DataFrame:
    """sector, pnl, share of the whole profit; null unless that is positive."""
    per = trades.groupBy(*by, "sector").agg(F.sum("pnl").alias("pnl"))
    total = F.sum("pnl").over(Window.partitionBy(*by))
    return per.withColumn("share", F.when(total > 0, F.col("pnl") / total))


def gates(m: DataFrame, g: dict = GATES) -> DataFrame:
    """m with G1 to G7 and passed. A null measure fails its gate."""
    ok = lambda c: F.coalesce(c, F.lit(False))
    tests = {
        "G1": ok((F.col("n") >= g["min_trades"]) & F.col("per_year_ok")), "G2": ok(F.col("ci_low") > g["ci_low"]), "G3": ok((F.col("sharpe") > F.col("b1_p95")) & (F.col("sharpe") > F.col("b_best"))),
        "G4": ok((F.col("pos_years") >= g["pos_years"]) & (F.col("max_year") <= g["max_year"])), "G5": ok((F.col("top5_share") <= g["top5"]) & (F.col("ex_top1") > g["ex_top"])),
        "G6": ok(F.col("cost2_expectancy") > g["cost2"]), "G7": ok(F.col("mdd") >= g["mdd"]),
    }
    passed = F.lit(True)
    for name in tests:
        passed = passed & F.col(name)
    return m.withColumns(tests).withColumn("passed", passed)


def drawn(seed: int, draw: Column, place: Column, n: Column) -> Column:
    """A whole number below n for a place of a draw, by a hash that other engines have too."""
    text = F.concat_ws("|", F.lit(str(seed)), draw.cast("string"), place.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % n


def resampled(blocks: DataFrame, by: list[str], draws: int = 1000, seed: int = 42) -> DataFrame:
    """by, draw, mean: for each series of blocks (block, total, n) so many draws of as many blocks as it has, with replacement.

    A place of a draw names a block by a hash of (seed, draw, place), and a join brings the block's sums; nothing but sums by draw is
    shuffled on. Series are numbered blocks in order of block.
    """
    order = Window.partitionBy(*by).orderBy("block")
    own = blocks.select(*by, "total", "n", (F.row_number().over(order) - 1).alias("__i"), F.count("*").over(Window.partitionBy(*by)).alias("__k"))
    places = own.select(*by, F.col("__i").alias("__place"), "__k", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    places = places.select(*by, "draw", drawn(seed, F.col("draw"), F.col("__place"), F.col("__k")).alias("__i"))
    sums = places.join(own.drop("__k"), [*by, "__i"]).groupBy(*by, "draw").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    return sums.select(*by, "draw", (F.col("total") / F.greatest(F.col("n"), F.lit(1))).alias("mean"))


def bootstrap_ci(blocks: DataFrame, by: list[str], draws: int = 1000, seed: int = 42) -> DataFrame:
    """low, high by series: the 95 % interval of the mean over draws of blocks (block, total, n). Repeated blocks are blocks of their
    own, their order being arbitrary; no blocks give no rows."""
    means = resampled(blocks, by, draws, seed)
    return means.groupBy(*by).agg(F.percentile("mean", F.lit(0.025)).alias("low"), F.percentile("mean", F.lit(0.975)).alias("high"))


def trade_blocks(trades: DataFrame, by: list[str], size: int = 20) -> DataFrame:
    """by, block, total, n: returns summed by blocks of entry positions (buy_pos)."""
    return trades.groupBy(*by, F.floor(F.col("buy_pos") / size).alias("block")).agg(F.sum("ret").alias("total"), F.count("*").cast("double").alias("n"))


def deflated_sharpe(sharpe_daily: float, n: int, skew: float, kurt: float, trials: list[float]) -> float | None:
    """The probability that a daily Sharpe ratio beats the best expected of as many trials by chance; kurt is 3 for a normal."""
    xs = [x for x in trials if x is not None and math.isfinite(x)]
    if len(xs) < 2 or sharpe_daily is None:
        return None
    normal = NormalDist()
    best = stdev(xs) * ((1 - EULER) * normal.inv_cdf(1 - 1 / len(xs)) + EULER * normal.inv_cdf(1 - 1 / (len(xs) * math.e)))
    spread = (1 - skew * sharpe_daily + (kurt - 1) / 4 * sharpe_daily**2) ** 0.5
    return normal.cdf((sharpe_daily - best) * (n - 1) ** 0.5 / spread)


def deflated(returns: DataFrame, by: list[str]) -> DataFrame:
    """by, sharpe (daily), best, dsr: each series' deflated Sharpe ratio with all series as the trials.

    best is the ratio expected of the best of as many trials by chance. Series without a ratio (fewer than two days, no spread) are
    no trials and have none; with fewer than two trials dsr is null.
    """
    each = returns.groupBy(*by).agg(
        div(F.avg("ret"), F.stddev_samp("ret")).alias("sharpe"), F.count("ret").alias("n"), F.skewness("ret").alias("skew"), (F.kurtosis("ret") + 3).alias("kurt")
    ).where("sharpe is not null and not isnan(sharpe)")
    trials = each.agg(F.stddev_samp("sharpe").alias("sd"), (1 - 1 / F.count("*")).alias("p"), (1 - 1 / (F.count("*") * math.e)).alias("q"))
    best = (F.col("sd") * ((1 - EULER) * ppf("p") + EULER * ppf("q"))).alias("best")
    one = trials.select(F.when(~F.isnan("sd"), best).alias("best"))
    spread = F.sqrt(1 - F.col("skew") * F.col("sharpe") + (F.col("kurt") - 1) / 4 * F.col("sharpe") * F.col("sharpe"))
    df = each.join(F.broadcast(one)).withColumn("z", (F.col("sharpe") - F.col("best")) * F.sqrt(F.col("n") - 1) / spread)  # one row
    return df.select(*by, "sharpe", "best", cdf("z").alias("dsr"))


def overfit_probability(returns: DataFrame, blocks: int = 16) -> DataFrame:
    """pbo, splits: over all halves of the blocks, how often the trial that is best in one half ranks in the lower half in the other.

    returns: trial, pos, ret; a null return counts as 0. Block i holds the days from floor(days * i / blocks) on. Ranks of ties are
    means, the first of equally good trials is the best.

    A half of the blocks is a bitmask of two parts. Each trial's sums over all masks of either part are made once, and a half is a
    pair of parts whose bits add up; trials meet only in two aggregations by half, one for its best trial and one for that
    trial's rank. What is broadcast between them has a row for each half, whatever the trials.
    """
    width = returns.agg((F.max("pos") + 1).alias("days"))
    cut = F.expr(f"cast(((pos + 1) * {blocks} - 1) div days as int)")
    x = F.coalesce("ret", F.lit(0.0))
    per = returns.join(F.broadcast(width)).withColumn("b", cut)
    per = per.groupBy("trial", "b").agg(F.sum(x).alias("s"), F.sum(x * x).alias("q"))
    trials = per.groupBy("trial").agg(F.map_from_entries(F.collect_list(F.struct("b", F.struct("s", "q")))).alias("m"))
    days = F.expr(f"transform(sequence(0, {blocks} - 1), i -> cast(days * (i + 1) div {blocks} - days * i div {blocks} as double))")
    trials = trials.join(F.broadcast(width.select(days.alias("d"))))
    sums = lambda at: F.struct(*[F.coalesce(F.element_at("m", at)[c], F.lit(0.0)).alias(c) for c in ("s", "q")], F.element_at("d", at + 1).alias("n"))
    low = blocks // 2

    def parts(start: int, size: int) -> Column:
        """bits, s, q, n for each mask of so many blocks from start on."""
        zero = F.struct(*[F.lit(0.0).alias(c) for c in ("s", "q", "n")])
        add = lambda mask: lambda acc, i: F.when(F.call_function("shiftright", mask, i).bitwiseAND(1) == 1, F.struct(*[(acc[c] + F.get("own", i + start)[c]).alias(c) for c in ("s", "q", "n")])).otherwise(acc)
        one = lambda mask: F.struct(mask.alias("mask"), F.bit_count(mask).alias("bits"), F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), zero, add(mask)).alias("x"))
        return F.transform(F.sequence(F.lit(0), F.lit((1 << size) - 1)), one)

    trials = trials.withColumn("own", F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), sums))
    trials = trials.select("trial", F.aggregate("own", F.struct(*[F.lit(0.0).alias(c) for c in ("s", "q", "n")]), lambda a, o: F.struct(*[(a[c] + o[c]).alias(c) for c in ("s", "q", "n")])).alias("all"), parts(0, low).alias("low"), parts(low, blocks - low).alias("high"))
    trials = trials.select("trial", "all", "low", F.explode("high").alias("h"))
    fits = F.filter("low", lambda part: part["bits"] + F.col("h.bits") == blocks // 2)
    rows = trials.select("trial", "all", "h", F.explode(fits).alias("l"))

    def ratio(s: Column, q: Column, n: Column) -> Column:
        mean = s / n
        return mean / F.sqrt(F.greatest(q / n - mean * mean, F.lit(1e-18)))

    inside = [F.col(f"l.x.{c}") + F.col(f"h.x.{c}") for c in ("s", "q", "n")]
    outside = [F.col(f"all.{c}") - i for c, i in zip(("s", "q", "n"), inside)]
    rows = rows.select("trial", (F.col("h.mask") * (1 << low) + F.col("l.mask")).alias("half"), ratio(*inside).alias("inside"), ratio(*outside).alias("outside"))
    best = rows.groupBy("half").agg(F.min_by("outside", F.struct(-F.col("inside"), "trial")).alias("of"))
    ranks = rows.join(F.broadcast(best), "half").groupBy("half").agg(
        F.count_if(F.col("outside") < F.col("of")).alias("less"), F.count_if(F.col("outside") == F.col("of")).alias("same"), F.count("*").alias("m")
    )
    w = (F.col("less") + (F.col("same") + 1) / 2) / (F.col("m") + 1)
    return ranks.agg(F.avg((w <= 0.5).cast("double")).alias("pbo"), F.count("*").alias("splits"))


def plateau(grid: DataFrame, same: list[str], value: str = "sharpe") -> DataFrame:
    """grid with plateau: the mean of value over rows that share all of `same`."""
    return grid.withColumn("plateau", F.avg(value).over(Window.partitionBy(*same)))
