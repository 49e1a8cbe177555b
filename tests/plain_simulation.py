"""Tranche portfolios from stated rules, a position at a time over small matrices: what the Spark simulation is compared with."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd

from tidemark.operators.panel import SLIPPAGE

FIELDS = ("open", "close", "open_u", "tradable", "stop_high", "stop_low", "dividend", "adv20")


@dataclass
class Panel:
    """Matrices of days by codes; close is carried forward and last_valid is each code's last tradable day."""

    days: list
    codes: list
    m: dict = field(default_factory=dict)
    last_valid: np.ndarray | None = None


@dataclass(frozen=True)
class Trial:
    hold: int
    slots: int
    gmax: float | None = None
    fee: float = 0.0005
    cost: float = 1.0
    capital: float = 1e7
    part: float = 0.01
    lot: float = 100.0
    equal_weight: bool = False


def pack(panel) -> Panel:
    """A small panel (dt, code and FIELDS) as matrices."""
    pdf = panel.select("dt", "code", *FIELDS).toPandas()
    days, codes = sorted(pdf["dt"].unique()), sorted(pdf["code"].unique())
    out = Panel(days, codes)
    r, c = pd.Index(days).get_indexer(pdf["dt"]), pd.Index(codes).get_indexer(pdf["code"])
    for name in FIELDS:
        flag = name in ("tradable", "stop_high", "stop_low")
        m = np.zeros((len(days), len(codes)), dtype=bool) if flag else np.full((len(days), len(codes)), np.nan)
        m[r, c] = pdf[name].fillna(False).astype(bool) if flag else pdf[name].astype(float)
        out.m[name] = m
    out.m["dividend"] = np.nan_to_num(out.m["dividend"])
    out.m["close"] = pd.DataFrame(out.m["close"]).ffill().to_numpy()
    seen = out.m["tradable"]
    out.last_valid = np.where(seen.any(0), len(days) - 1 - seen[::-1].argmax(0), -1)
    return out


def slip(adv: float) -> float:
    return next((rate for least, rate in SLIPPAGE if adv >= least), SLIPPAGE[-1][1])


@dataclass(frozen=True)
class Position:
    """A purchase with all that follows from it: its sale, if any, and what it is worth at each close until then."""

    code: int
    tranche: int
    day: int
    paid: float
    shares: float
    exit: int | None
    got: float | None


class Rulebook:
    """The rules as questions about a code and a day; nothing in it changes while positions are taken."""

    def __init__(self, p: Panel, t: Trial) -> None:
        self.p, self.t, self.n = p, t, len(p.days)
        self.dividends = p.m["dividend"].cumsum(0)
        can_sell = p.m["tradable"] & ~p.m["stop_low"] & np.isfinite(p.m["open"])
        self.sale_days = [np.flatnonzero(can_sell[:, c]) for c in range(len(p.codes))]

    def refusal(self, code: int, d: int) -> str | None:
        """Why a code can't be bought at the open of day d whatever the size."""
        m, t = self.p.m, self.t
        limit = np.inf if t.gmax is None else m["close"][d - 1, code] * (1 + t.gmax)
        reasons = (("halt", not m["tradable"][d, code] or np.isnan(m["open"][d, code])), ("stop_high", m["stop_high"][d, code]), ("gap", m["open"][d, code] > limit))
        return next((name for name, holds in reasons if holds), None)

    def lots(self, code: int, d: int, budget: float) -> tuple[float, float]:
        """How many lots a budget buys, and what one costs with slippage and fee."""
        t, adv = self.t, self.p.m["adv20"][d - 1, code]
        one = t.lot * self.p.m["open_u"][d, code] * (1 + slip(adv) * t.cost) * (1 + t.fee * t.cost)
        if t.equal_weight:
            return budget / one, one
        return float(min(budget, t.part * np.nan_to_num(adv)) // one), one

    def sale(self, code: int, due: int) -> tuple[int, float, float] | None:
        """Day, price and ADV of the sale of a position due on a day: the first open that allows it, or the last close of an ended code."""
        p, last = self.p, int(self.p.last_valid[code])
        later = self.sale_days[code][np.searchsorted(self.sale_days[code], due) :]
        d = int(later[0]) if len(later) else max(due, last + 1)
        if d >= self.n:
            return None
        return (d, p.m["open"][d, code], p.m["adv20"][d - 1, code]) if len(later) else (d, p.m["close"][last, code], p.m["adv20"][last, code])

    def position(self, code: int, tranche: int, d: int, lots: float, one: float) -> Position:
        t, m = self.t, self.p.m
        shares = lots * t.lot * m["open_u"][d, code] / m["open"][d, code]
        sold = self.sale(code, d + t.hold)
        if sold is None:
            return Position(code, tranche, d, lots * one, shares, None, None)
        day, price, adv = sold
        got = shares * (price * (1 - (slip(adv) + t.fee) * t.cost) + self.dividends[day, code] - self.dividends[d, code])
        return Position(code, tranche, d, lots * one, shares, day, got)

    def worth(self, x: Position) -> tuple[np.ndarray, np.ndarray]:
        """The days at whose close a position is held, and what it is worth then with its dividends."""
        days = np.arange(x.day, self.n if x.exit is None else x.exit)
        close = self.p.m["close"][np.minimum(days, self.p.last_valid[x.code]), x.code]
        return days, x.shares * (close + self.dividends[days, x.code] - self.dividends[x.day, x.code])


def run(p: Panel, picks: dict[int, list[int]], t: Trial) -> tuple[np.ndarray, np.ndarray, list[dict], dict]:
    """nav and invested share for each day after the first, finished trades in order of exit, and counts of failed buys.

    An evening's picks are bought at the next open by one tranche in turn. Codes already held are passed over; of the others as many
    as there are slots are tried, each with an equal part of the tranche's cash. All money is summed up from the positions taken.
    """
    rules, taken = Rulebook(p, t), []
    fails = dict.fromkeys(("halt", "stop_high", "gap", "lot"), 0)
    for evening in sorted(e for e in picks if e + 1 < len(p.days)):
        d, names, tranche = evening + 1, picks[evening], evening % t.hold
        held = {x.code for x in taken if x.exit is None or x.exit > d}
        cash = t.capital / t.hold + sum((x.got if x.exit is not None and x.exit <= d else 0.0) - x.paid for x in taken if x.tranche == tranche)
        slots = len(names) if t.equal_weight else t.slots
        for code in [c for c in names if c not in held][:slots]:
            why = rules.refusal(code, d)
            lots, one = (0.0, 0.0) if why else rules.lots(code, d, cash / slots)
            if not why and lots < 1 and not t.equal_weight:
                why = "lot"
            if why:
                fails[why] += 1
            else:
                taken.append(rules.position(code, tranche, d, lots, one))
    flows, value = np.zeros(len(p.days)), np.zeros(len(p.days))
    for x in taken:
        flows[x.day] -= x.paid
        if x.exit is not None:
            flows[x.exit] += x.got
        days, worth = rules.worth(x)
        value[days] += worth
    nav = t.capital + flows.cumsum() + value
    invested = np.divide(value, nav, out=np.zeros_like(nav), where=nav > 0)
    nav[0] = invested[0] = np.nan
    closed = sorted((x for x in taken if x.exit is not None), key=lambda x: x.exit)
    done = [{"code": p.codes[x.code], "buy_dt": p.days[x.day], "exit_dt": p.days[x.exit], "buy_pos": x.day, "cost": x.paid, "ret": x.got / x.paid - 1, "pnl": x.got - x.paid} for x in closed]
    return nav, invested, done, fails
