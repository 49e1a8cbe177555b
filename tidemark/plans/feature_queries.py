"""Feature queries over daily nation bars, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import r6
from ..operators import features as ft
from ..sources import bars as src

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
ORDER = "partition by code order by dt"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) over ({ORDER})"


def roll(fn: str, x: str, n: int) -> str:
    w = f"({ORDER} rows between {n - 1} preceding and current row)"
    return f"(case when count({x}) over {w} = {n} then {fn}({x}) over {w} end)"


def q(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def feature(name: str, fn, columns: list[str], ctes: str, values: dict[str, str], source=src.nation_daily, base: str = src.NATION_SQL) -> None:
    """Registers fn over bars: dt, code and the columns, to six decimals."""

    def run(spark, sf_dir) -> DataFrame:
        return fn(source(spark, sf_dir)).select("dt", "code", *[r6(c).alias(c) for c in columns])

    QUERIES[name] = run
    picked = ", ".join(f"round({values[c]}, 6) + 0.0 as {c}" for c in columns)
    last = "z" if ctes else "bars"
    ORACLES[name] = f"with recursive {base}{',' if ctes else ''} {ctes} select dt, code, {picked} from {last}"


SPANS = (5, 25, 75, 200)
sma = {n: f"s{n}" for n in SPANS}
feature(
    "sma_dev", ft.moving_averages, [f"sma_dev_{n}" for n in SPANS] + [f"sma_slope_{n}" for n in SPANS] + ["ma_5_25", "ma_25_75", "ma_75_200"],
    f"a as (select *, {', '.join(f'{roll("avg", "close", n)} as s{n}' for n in SPANS)} from bars), z as (select *, {', '.join(f'{lag(f"s{n}", 5)} as p{n}' for n in SPANS)} from a)",
    {f"sma_dev_{n}": f"close / s{n} - 1" for n in SPANS} | {f"sma_slope_{n}": f"s{n} / p{n} - 1" for n in SPANS} | {f"ma_{a}_{b}": f"sign(s{a} - s{b})::double" for a, b in zip(SPANS, SPANS[1:])},
)


def rec(x: str, a: str, out: str, source: str, least: int, name: str) -> str:
    """CTEs for a recursive mean of a column that is null only in its first rows."""
    return f"""
{name}_n as (select code, dt, {x} as x, row_number() over ({ORDER}) as i from {source} where {x} is not null),
{name}_r as (select code, dt, i, x as y from {name}_n where i = 1 union all
             select n.code, n.dt, n.i, (1 - {a}) * r.y + {a} * n.x from {name}_r r join {name}_n n on n.code = r.code and n.i = r.i + 1),
{name} as (select code, dt, case when i >= {least} then y end as {out} from {name}_r)"""


def alpha(span: int) -> str:
    return f"(2.0::double / {span + 1})"


feature(
    "ema_dev", ft.ema_deviation, [f"ema_dev_{n}" for n in SPANS],
    ",".join(rec("close", alpha(n), f"y{n}", "bars", n, f"e{n}") for n in SPANS) + ", z as (select * from bars " + " ".join(f"left join e{n} using (code, dt)" for n in SPANS) + ")",
    {f"ema_dev_{n}": f"close / y{n} - 1" for n in SPANS},
)
feature(
    "rsi14", ft.rsi, ["rsi14"],
    f"d as (select *, close - {lag('close')} as d from bars), ud as (select *, case when d is not null then greatest(d, 0) end as u, case when d is not null then greatest(-d, 0) end as w from d),"
    + rec("u", "(1.0::double / 14)", "au", "ud", 14, "eu") + "," + rec("w", "(1.0::double / 14)", "ad", "ud", 14, "ed") + ", z as (select * from bars left join eu using (code, dt) left join ed using (code, dt))",
    {"rsi14": "100 - 100 / (1 + au / (ad + 1e-12))"},
)
feature(
    "macd", ft.macd, ["macd", "macd_sig", "macd_hist"],
    rec("close", alpha(12), "f", "bars", 12, "ef") + "," + rec("close", alpha(26), "w", "bars", 26, "ew") + ", m as (select *, f - w as m from bars left join ef using (code, dt) left join ew using (code, dt)),"
    + rec("m", alpha(9), "g", "m", 9, "eg") + ", z as (select * from m left join eg using (code, dt))",
    {"macd": "m / close", "macd_sig": "g / close", "macd_hist": "(m - g) / close"},
)
feature(
    "stoch_willr", ft.stochastic, ["stoch_k14", "stoch_d3", "willr14"],
    f"a as (select *, {roll('max', 'high', 14)} as hh, {roll('min', 'low', 14)} as ll from bars), b as (select *, (close - ll) / (hh - ll + 1e-12) * 100 as k from a), z as (select *, {roll('avg', 'k', 3)} as d from b)",
    {"stoch_k14": "k", "stoch_d3": "d", "willr14": "(hh - close) / (hh - ll + 1e-12) * -100"},
)
feature(
    "atr", ft.average_range, ["atr14p", "atr20p"],
    f"p as (select *, {lag('close')} as p from bars), t as (select *, greatest(high - low, abs(high - p), abs(low - p)) as tr from p)," + rec("tr", "(1.0::double / 14)", "a14", "t", 14, "e14") + "," + rec("tr", "(1.0::double / 20)", "a20", "t", 20, "e20")
    + ", z as (select * from bars left join e14 using (code, dt) left join e20 using (code, dt))",
    {"atr14p": "a14 / close", "atr20p": "a20 / close"},
)
feature(
    "bollinger", ft.bollinger, ["bb_pb", "bb_bw"], f"z as (select *, {roll('avg', 'close', 20)} as m, {roll('stddev_pop', 'close', 20)} as s from bars)",
    {"bb_pb": "(close - (m - 2 * s)) / (4 * s + 1e-12)", "bb_bw": "4 * s / m"},
)
feature(
    "hist_vol", ft.volatility, ["hv20", "hv60", "range_p", "gap"],
    f"a as (select *, {lag('close')} as p from bars), b as (select *, ln(close / p) as r from a), z as (select *, {roll('stddev_samp', 'r', 20)} as v20, {roll('stddev_samp', 'r', 60)} as v60 from b)",
    {"hv20": "v20 * sqrt(252)", "hv60": "v60 * sqrt(252)", "range_p": "(high - low) / close", "gap": "open / p - 1"},
)
feature(
    "volume_ratio", ft.volume_ratios, ["vr5", "vr20", "adv20_log"], f"a as (select *, close * volume as tv from bars), z as (select *, {roll('avg', 'volume', 5)} as v5, {roll('avg', 'volume', 20)} as v20, {roll('avg', 'tv', 20)} as adv from a)",
    {"vr5": "volume / (v5 + 1e-12)", "vr20": "volume / (v20 + 1e-12)", "adv20_log": "ln(1 + adv)"},
)
feature(
    "obv20", ft.on_balance, ["obv20"],
    f"a as (select *, coalesce(sign(close - {lag('close')}), 0) * volume as s from bars), b as (select *, sum(s) over ({ORDER} rows unbounded preceding) as obv from a), z as (select *, obv - {lag('obv', 20)} as d, {roll('sum', 'volume', 20)} as v20 from b)",
    {"obv20": "d / (v20 + 1e-12)"},
)
feature(
    "mfi14", ft.money_flow, ["mfi14"],
    f"a as (select *, (high + low + close) / 3 as tp from bars), b as (select *, {lag('tp')} as p from a), c as (select *, case when tp > p then tp * volume else 0 end as up, case when tp < p then tp * volume else 0 end as dn from b),"
    f" z as (select *, {roll('sum', 'up', 14)} as pos, {roll('sum', 'dn', 14)} as neg from c)",
    {"mfi14": "100 - 100 / (1 + pos / (neg + 1e-12))"},
)
feature("momentum", ft.momentum, ["ret1", "ret3", "ret5", "ret20", "roc_60", "roc_120"], "", {f"ret{n}": f"close / {lag('close', n)} - 1" for n in (1, 3, 5, 20)} | {f"roc_{n}": f"close / {lag('close', n)} - 1" for n in (60, 120)})
feature(
    "hi_lo_distance", ft.extremes, [f"dist_{s}_{n}" for s in ("hi", "lo") for n in (20, 60, 250)], "",
    {f"dist_hi_{n}": f"close / {roll('max', 'high', n)} - 1" for n in (20, 60, 250)} | {f"dist_lo_{n}": f"close / {roll('min', 'low', n)} - 1" for n in (20, 60, 250)},
)
feature("new_high_low", ft.new_extremes, ["new_hi250", "new_lo250"], "", {"new_hi250": f"(high >= {roll('max', 'high', 250)})::int::double", "new_lo250": f"(low <= {roll('min', 'low', 250)})::int::double"})
feature(
    "streaks", ft.streaks, ["up_streak", "dn_streak"],
    f"a as (select *, close - {lag('close')} as d from bars), b as (select *, coalesce(d > 0, false)::int as u, coalesce(d < 0, false)::int as w from a), c as (select *, sum(1 - u) over ({ORDER} rows unbounded preceding) as iu, sum(1 - w) over ({ORDER} rows unbounded preceding) as iw from b),"
    " z as (select *, sum(u) over (partition by code, iu order by dt rows unbounded preceding) as su, sum(w) over (partition by code, iw order by dt rows unbounded preceding) as sw from c)",
    {"up_streak": "su::double", "dn_streak": "sw::double"},
)
feature(
    "cross_days", ft.cross_days, ["cross_days"],
    f"a as (select *, nullif(sign({roll('avg', 'close', 25)} - {roll('avg', 'close', 75)}), 0)::double as s from bars), b as (select *, (s is null or {lag('s')} is null or s <> {lag('s')})::int as fresh from a),"
    f" c as (select *, sum(fresh) over ({ORDER} rows unbounded preceding) as i from b), z as (select *, s * least(row_number() over (partition by code, i order by dt) - 1, 250) as x from c)",
    {"cross_days": "x"},
)
feature(
    "pullback", ft.pullback, ["pullback"], f"a as (select *, {roll('avg', 'close', 25)} as s25, {roll('avg', 'close', 75)} as s75, {lag('close', 3)} as c3 from bars), z as (select *, {lag('s25', 5)} as p25 from a)",
    {"pullback": "case when s75 is not null then coalesce(close > s75 and s25 > p25 and close < c3, false)::int::double end"},
)
span = "nullif(high - low, 0)"
feature(
    "candle_shape", ft.candle_shape, ["body", "upper_sh", "lower_sh", "doji"], "",
    {"body": f"(close - open) / {span}", "upper_sh": f"(high - greatest(open, close)) / {span}", "lower_sh": f"(least(open, close) - low) / {span}", "doji": f"(abs(close - open) / {span} < 0.1)::int::double"},
)
feature(
    "candle_patterns", ft.candle_patterns, ["engulf", "harami", "gap_flag"], f"z as (select *, {lag('open')} as po, {lag('close')} as pc, {lag('high')} as ph, {lag('low')} as pl from bars)",
    {
        "engulf": "coalesce(close > open and pc < po and open <= pc and close >= po, false)::int::double - coalesce(close < open and pc > po and open >= pc and close <= po, false)::int::double",
        "harami": "coalesce(po is not null and greatest(open, close) < greatest(po, pc) and least(open, close) > least(po, pc), false)::int * sign(close - open)::double",
        "gap_flag": "coalesce(low > ph, false)::int::double - coalesce(high < pl, false)::int::double",
    },
)
feature(
    "rel_strength", lambda b: ft.relative_strength(b, src.index_series(b)), ["rs20", "rs60"],
    src.INDEX_SQL + f", a as (select * from bars left join ix using (dt)), z as (select *, {', '.join(f'(close / {lag("close", n)}) / (ix / {lag("ix", n)}) - 1 as r{n}' for n in (20, 60))} from a)",
    {"rs20": "r20", "rs60": "r60"},
)

MARKET = ["mk_ret1", "mk_ret5", "mk_ret20", "mk_above200", "mk_vol20"]
MARKET_SQL = "m as (select dt, ix, 'index' as code from ix), m1 as (select *, ln(ix / {p}) as r, {s} as s from m), m2 as (select *, {v} as v from m1)".format(p=lag("ix"), s=roll("avg", "ix", 200), v=roll("stddev_samp", "r", 20))
MARKET_VALUES = ", ".join(f"round(ix / {lag('ix', n)} - 1, 6) + 0.0 as mk_ret{n}" for n in (1, 5, 20)) + ", (ix > s)::int::double as mk_above200, round(v * sqrt(252), 6) + 0.0 as mk_vol20"


def market_features(spark, sf_dir) -> DataFrame:
    return ft.market(src.index_series(src.nation_daily(spark, sf_dir))).select("dt", *[r6(c).alias(c) for c in MARKET])


QUERIES["market_features"] = market_features
ORACLES["market_features"] = f"with {src.NATION_SQL}, {src.INDEX_SQL}, {MARKET_SQL} select dt, {MARKET_VALUES} from m2"


def nt_ratio(spark, sf_dir) -> DataFrame:
    """The 20-row change of the ratio of all codes' index to that of one region."""
    b = src.nation_daily(spark, sf_dir)
    return ft.market(src.index_series(b), src.index_series(b.where("sector = 'ASIA'"))).select("dt", r6("mk_nt20").alias("mk_nt20"))


QUERIES["nt_ratio"] = nt_ratio
ORACLES["nt_ratio"] = f"""with {src.NATION_SQL}, {src.INDEX_SQL}, iy as (select dt, sum(close * volume) / sum(volume) as iy from bars where sector = 'ASIA' group by dt),
a as (select dt, ix / iy as r from ix left join iy using (dt)) select dt, round(r / lag(r, 20) over (order by dt) - 1, 6) + 0.0 as mk_nt20 from a"""


def breadth5(spark, sf_dir) -> DataFrame:
    return ft.breadth(ft.momentum(src.supplier_weekly(spark, sf_dir))).select("dt", r6("breadth5").alias("breadth5"))


QUERIES["breadth5"] = breadth5
ORACLES["breadth5"] = f"""with {src.WEEKLY_SQL}, r as (select *, close / {lag('close')} - 1 as ret1 from bars),
a as (select dt, count(*) filter (ret1 > 0)::double / nullif(count(*) filter (ret1 < 0), 0) as q from r group by dt)
select dt, round((q + lag(q, 1) over (order by dt) + lag(q, 2) over (order by dt) + lag(q, 3) over (order by dt) + lag(q, 4) over (order by dt)) / 5, 6) + 0.0 as breadth5 from a"""


def sql_rank(x: str, by: str, desc: bool = False) -> str:
    order = f"{x} desc nulls last" if desc else f"{x} nulls last"
    return f"(case when {x} is not null then (rank() over (partition by {by} order by {order}) + (count(*) over (partition by {by}, {x}) - 1) / 2.0::double) / count({x}) over (partition by {by}) end)"


def sector_ret_rank(spark, sf_dir) -> DataFrame:
    df = ft.momentum(src.supplier_weekly(spark, sf_dir)).withColumn("ret20", F.col("ret20").cast("float"))
    return ft.sector_features(df, least=3).select("dt", "code", r6(F.col("sec_ret20").cast("double")).alias("sec_ret20"), r6("sec_rank20").alias("sec_rank20"))


QUERIES["sector_ret_rank"] = sector_ret_rank
ORACLES["sector_ret_rank"] = f"""with {src.WEEKLY_SQL}, r as (select *, (close / {lag('close', 20)} - 1)::float as ret20 from bars)
select dt, code, case when count(ret20) over (partition by dt, sector) >= 3 then round(avg(ret20::double) over (partition by dt, sector), 6) + 0.0 end as sec_ret20,
       case when count(ret20) over (partition by dt, sector) >= 3 then round({sql_rank('ret20', 'dt, sector')}, 6) + 0.0 end as sec_rank20 from r"""


def xs_pct_rank(spark, sf_dir) -> DataFrame:
    """The top fifth of each week's codes by 20-row return, with their ranks by two features."""
    df = ft.moving_averages(ft.momentum(src.supplier_weekly(spark, sf_dir)), (5, 25))
    df = ft.ranks(df, ["ret20", "sma_dev_25"])
    return df.where(F.col("r_ret20") > F.lit(0.8).cast("float")).select("dt", "code", *[r6(F.col(f"r_{c}").cast("double")).alias(f"r_{c}") for c in ("ret20", "sma_dev_25")])


QUERIES["xs_pct_rank"] = xs_pct_rank
ORACLES["xs_pct_rank"] = f"""with {src.WEEKLY_SQL}, r as (select dt, code, (close / {lag('close', 20)} - 1)::float as ret20, (close / {roll('avg', 'close', 25)} - 1)::float as dev from bars),
k as (select dt, code, {sql_rank('ret20', 'dt')}::float as a, {sql_rank('dev', 'dt')}::float as b from r)
select dt, code, round(a::double, 6) + 0.0 as r_ret20, round(b::double, 6) + 0.0 as r_sma_dev_25 from k where a > 0.8::float"""


def _bars(name: str, source, base: str) -> None:
    def run(spark, sf_dir) -> DataFrame:
        df = source(spark, sf_dir)
        return df.select("dt", "code", *[(F.col(c) + 0.0).alias(c) for c in ("open", "high", "low", "close", "volume")])

    QUERIES[name] = run
    ORACLES[name] = f"with {base} select dt, code, {', '.join(f'{c} + 0.0 as {c}' for c in ('open', 'high', 'low', 'close', 'volume'))} from bars"


_bars("bars_ohlcv", src.nation_daily, src.NATION_SQL)
_bars("bars_weekly", src.supplier_weekly, src.WEEKLY_SQL)
_bars("bars_event_hourly", src.event_hourly, src.HOURLY_SQL)
