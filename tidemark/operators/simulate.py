"""Tranche portfolios over parameter grids: prices and exits by windows and joins, cash by a recursion over each trial's picks."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.stores import staged
from .panel import SLIPPAGE

FIELDS = ("open", "close", "open_u", "tradable", "stop_high", "stop_low", "dividend", "adv20")
BOOK = "trial string, code string, buy_pos int, exit_pos int, cost double, shares double, paid_at double, got double, failed string"


@dataclass(frozen=True)
class Rules:
    fee: float = 0.0005
    capital: float = 1e7
    part: float = 0.01
    lot: float = 100.0


def slip(adv: float) -> float:
    return next((rate for least, rate in SLIPPAGE if adv >= least), SLIPPAGE[-1][1])


def trading_days(panel: DataFrame) -> DataFrame:
    """dt, pos of the panel's days."""
    return panel.select("dt").distinct().withColumn("pos", F.row_number().over(Window.orderBy("dt")) - 1)  # a row for each day


def marks(panel: DataFrame, days: DataFrame) -> DataFrame:
    """A row for each code and position from its first to its last: last, the code's last tradable position; close carried forward;
    paid, the dividends up to the day; close_before and adv_before of the day before; sale, the first day from this on at which
    it can be sold at the open (pos, price, adv, paid)."""
    rows = panel.select("dt", "code", *FIELDS).join(F.broadcast(days), "dt").drop("dt")
    spans = rows.groupBy("code").agg(F.min("pos").alias("a"), F.max("pos").alias("b"), F.coalesce(F.max(F.when(F.col("tradable"), F.col("pos"))), F.lit(-1)).alias("last"))
    df = spans.select("code", "last", F.explode(F.sequence("a", "b")).alias("pos")).join(rows, ["code", "pos"], "left")
    w = Window.partitionBy("code").orderBy("pos")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({"close": F.last("close", True).over(upto), "paid": F.sum(F.coalesce("dividend", F.lit(0.0))).over(upto)} | {c: F.coalesce(c, F.lit(False)) for c in ("tradable", "stop_high", "stop_low")})
    df = df.withColumns({"close_before": F.lag("close").over(w), "adv_before": F.lag("adv20").over(w)})
    sale = F.when(F.col("tradable") & ~F.col("stop_low") & F.col("open").isNotNull(), F.struct("pos", F.col("open").alias("price"), F.col("adv_before").alias("adv"), "paid"))
    back = Window.partitionBy("code").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("sale", F.last(sale, True).over(back)).drop("dividend", "stop_low")


def _ends(table: DataFrame) -> DataFrame:
    """What a code is worth behind its last tradable day: its close and ADV there, dividends up to the day after and in all."""
    at_last = F.col("pos") == F.col("last")
    return table.groupBy("code", "last").agg(
        F.max(F.when(at_last, F.col("close"))).alias("last_close"), F.max(F.when(at_last, F.col("adv20"))).alias("last_adv"),
        F.max_by("paid", F.when(F.col("pos") <= F.col("last") + 1, F.col("pos"))).alias("next_paid"), F.max_by("paid", "pos").alias("end_paid"),
    )


def random_picks(panel: DataFrame, seeds: DataFrame, top: int = 50) -> DataFrame:
    """seed, dt, slot, code: for each seed `top` of a day's tradable codes in the order of a seeded hash. Rows are shuffled once, by day."""
    df = panel.where("tradable").select("dt", "code").repartition("dt")
    df = df.join(F.broadcast(seeds.select(F.collect_set("seed").alias("seeds"))), F.lit(True)).select("dt", "code", F.explode("seeds").alias("seed"))
    w = Window.partitionBy("dt", "seed").orderBy(F.xxhash64("seed", "dt", "code"), "code")
    return df.withColumn("slot", F.row_number().over(w) - 1).where(F.col("slot") < top).select("seed", "dt", "slot", "code")


def orders(table: DataFrame, days: DataFrame, n_days: int, picks: DataFrame, grid: DataFrame) -> DataFrame:
    """For each trial and pick the day of its buy with its prices, and when and at what price it would be sold again.

    picks (source, dt, slot, code) serve the trials of their source; codes that the panel lacks are passed over. A position is
    due `hold` days after its buy and is sold at the first open from then on at which that is possible; at the last close if the
    code has ended; not at all (exit_pos null) if the days end before.
    """
    df = picks.join(F.broadcast(days), "dt").drop("dt").join(F.broadcast(grid.select("source", "hold").distinct()), "source")
    df = df.withColumn("pos", F.col("pos") + 1).withColumn("due", F.col("pos") + F.col("hold")).where(F.col("pos") < n_days)
    entry = table.select("code", "pos", "open", "open_u", "tradable", "stop_high", "close_before", "adv_before", F.col("paid").alias("paid_at"))
    due = table.select("code", F.col("pos").alias("due"), "sale", F.col("paid").alias("due_paid"))
    df = df.join(_ends(table), "code").join(entry, ["code", "pos"], "left").join(due, ["code", "due"], "left")
    ended = lambda pos, paid: F.struct(pos.alias("pos"), F.col("last_close").alias("price"), F.col("last_adv").alias("adv"), paid.alias("paid"))
    sale = F.when(F.col("due") > F.col("last"), ended(F.col("due"), F.coalesce("due_paid", "end_paid"))).otherwise(F.coalesce("sale", ended(F.col("last") + 1, F.col("next_paid"))))
    df = df.withColumn("sale", sale).withColumn("sale", F.when(F.col("sale.pos") < n_days, F.col("sale")))
    df = df.withColumns({"exit_pos": F.col("sale.pos"), "exit_price": F.col("sale.price"), "exit_adv": F.col("sale.adv"), "exit_paid": F.col("sale.paid")})
    df = df.withColumns({"halt": ~F.coalesce("tradable", F.lit(False)) | F.col("open").isNull(), "stop_high": F.coalesce("stop_high", F.lit(False))})
    df = df.drop("sale", "tradable", "last", "last_close", "last_adv", "next_paid", "end_paid", "due_paid", "due")
    return df.join(F.broadcast(grid.drop("seed")), ["source", "hold"])


def book(order_rows: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """BOOK: each pick that used a slot, bought (exit_pos and got null while open) or failed (halt, stop_high, gap or lot).

    A trial's group are its picks: some names a day, over the calendar. Each day the sales come back to their tranche; then the
    day's tranche buys in order: held codes are passed over without using a slot, and a halt, a limit-up, a gap or less than a lot
    uses one. Sizes are whole lots of at most the tranche's cash over the slots and a share of ADV; with equal_weight any size.
    """
    return order_rows.groupBy("trial").applyInPandas(lambda g: _book(g, rules), BOOK)


def _book(g: pd.DataFrame, r: Rules) -> pd.DataFrame:
    t = g.iloc[0]
    hold, cost = int(t["hold"]), float(t["cost"])
    cash, waiting, held, out = np.full(hold, r.capital / hold), [], set(), []
    for d, names in g.sort_values(["pos", "slot"]).groupby("pos"):
        while waiting and waiting[0][0] <= d:
            _, code, j, got = heapq.heappop(waiting)
            cash[j] += got
            held.remove(code)
        j, slots = (d - 1) % hold, len(names) if t["equal_weight"] else int(t["slots"])
        budget, used = cash[j] / max(slots, 1), 0
        for x in names.itertuples():
            if used >= slots:
                break
            if x.code in held:
                continue
            used += 1
            failed = "halt" if x.halt else "stop_high" if x.stop_high else "gap" if x.open > x.close_before * (1 + t["gmax"]) else None
            if failed is None:
                each = x.open_u * (1 + slip(x.adv_before) * cost) * (1 + r.fee * cost) * r.lot
                lots = budget / each if t["equal_weight"] else np.floor(min(budget, r.part * np.nan_to_num(x.adv_before)) / each)
                failed = "lot" if lots < 1 and not t["equal_weight"] else None
            if failed:
                out.append((t["trial"], x.code, d, None, None, None, None, None, failed))
                continue
            shares, paid = lots * r.lot * x.open_u / x.open, lots * each
            cash[j] -= paid
            held.add(x.code)
            sold = not np.isnan(x.exit_pos)
            got = shares * (x.exit_price * (1 - (slip(x.exit_adv) + r.fee) * cost) + x.exit_paid - x.paid_at) if sold else None
            if sold:
                heapq.heappush(waiting, (x.exit_pos, x.code, j, got))
            out.append((t["trial"], x.code, d, x.exit_pos if sold else None, paid, shares, x.paid_at, got, None))
    rows = pd.DataFrame(out, columns=[c.split()[0] for c in BOOK.split(", ")])
    return rows.astype({"buy_pos": "Int32", "exit_pos": "Int32", "cost": float, "shares": float, "paid_at": float, "got": float})


def values(trades: DataFrame, table: DataFrame, days: DataFrame, n_days: int, grid: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """trial, dt, nav, invested for each day after the first: cash and what is held at the close, with its dividends."""
    trades = trades.where("failed is null")
    spans = F.sequence("buy_pos", F.coalesce(F.col("exit_pos") - 1, F.lit(n_days - 1)))
    held = trades.where("exit_pos is null or exit_pos > buy_pos").select("trial", "code", "shares", "paid_at", F.explode(spans).alias("pos"))
    held = held.join(_ends(table), "code").join(table.select("code", "pos", "close", "paid"), ["code", "pos"], "left")
    price = F.when(F.col("pos") <= F.col("last"), F.col("close")).otherwise(F.col("last_close"))
    worth = F.col("shares") * (price + F.coalesce("paid", "end_paid") - F.col("paid_at"))
    flow = trades.select("trial", F.col("buy_pos").alias("pos"), (-F.col("cost")).alias("flow"), F.lit(0.0).alias("worth"))
    flow = flow.union(trades.where("exit_pos is not null").select("trial", "exit_pos", "got", F.lit(0.0)))
    flow = flow.union(held.select("trial", "pos", F.lit(0.0), worth))
    flow = flow.union(grid.select("trial", F.explode(F.sequence(F.lit(1), F.lit(n_days - 1))), F.lit(0.0), F.lit(0.0)) if n_days > 1 else flow.limit(0))
    df = flow.groupBy("trial", "pos").agg(F.sum("flow").alias("flow"), F.sum("worth").alias("worth"))
    cash = rules.capital + F.sum("flow").over(Window.partitionBy("trial").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("nav", cash + F.col("worth")).join(F.broadcast(days), "pos")
    return df.select("trial", "dt", "nav", F.when(F.col("nav") > 0, F.col("worth") / F.col("nav")).otherwise(0.0).alias("invested"))


def _run(panel: DataFrame, candidates: DataFrame | None, grid: DataFrame, rules: Rules):
    panel, grid = staged(panel.select("dt", "code", *FIELDS)), grid.withColumn("source", F.coalesce(F.col("seed").cast("string"), F.lit("")))
    days = staged(trading_days(panel))
    n_days, table = days.count(), staged(marks(panel, days))
    picks = random_picks(panel, grid.where("seed is not null")).select(F.col("seed").cast("string").alias("source"), "dt", "slot", "code")
    if candidates is not None:
        picks = picks.union(candidates.select(F.lit("").alias("source"), "dt", "slot", "code"))
    return days, n_days, table, grid, staged(book(orders(table, days, n_days, picks, grid), rules))


def simulate_grid(panel: DataFrame, candidates: DataFrame | None, grid: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """trial, dt, nav, invested for each row of grid (trial, hold, slots, gmax, cost, equal_weight, seed) over candidates (dt, slot, code).

    A trial with a seed buys random picks instead; candidates may be None if all have one.
    """
    days, n_days, table, grid, trades = _run(panel, candidates, grid, rules)
    return values(trades, table, days, n_days, grid, rules)


def simulate_trades(panel: DataFrame, candidates: DataFrame, grid: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """trial, code, buy_dt, exit_dt, buy_pos, cost, ret, pnl of all finished trades."""
    days, _, _, _, trades = _run(panel, candidates, grid, rules)
    df = trades.where("exit_pos is not null")
    for name in ("buy", "exit"):
        df = df.join(F.broadcast(days.select(F.col("pos").alias(f"{name}_pos"), F.col("dt").alias(f"{name}_dt"))), f"{name}_pos")
    pnl = F.col("got") - F.col("cost")
    return df.select("trial", "code", "buy_dt", "exit_dt", F.col("buy_pos").cast("long").alias("buy_pos"), "cost", (pnl / F.col("cost")).alias("ret"), pnl.alias("pnl"))


def parameter_grid(spark, holds, slots, gmaxes, costs=(1.0,), equal_weight: bool = False, seeds=(None,)) -> DataFrame:
    """trial (its parameters as text) and the product of all parameters."""
    df = spark.range(1).drop("id")
    for name, kind, xs in (("hold", "int", holds), ("slots", "int", slots), ("gmax", "double", gmaxes), ("cost", "double", costs), ("seed", "int", seeds)):
        df = df.withColumn(name, F.explode(F.array(*[F.lit(x).cast(kind) for x in xs])))
    text = lambda letter, c: F.concat(F.lit(letter), F.coalesce(F.col(c).cast("string"), F.lit("None")))
    name = F.concat_ws("|", text("N", "hold"), text("K", "slots"), text("g", "gmax"), text("c", "cost"), text("s", "seed"))
    return df.withColumns({"equal_weight": F.lit(equal_weight), "trial": name})
