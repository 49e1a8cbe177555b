"""Selection, ranking and storage queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import r6
from ..operators import features as ft
from ..operators import metrics, selection
from ..sources import bars as src
from ..sources import stores
from .feature_queries import lag, roll, sql_rank
from .research_queries import CAPITAL, NAV, nav_series, rounded

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


@query(f"""with {NAV}, d as (select a.dt, a.ret - b.ret as d, (row_number() over (order by a.dt) - 1) // 20 as block from ret a join ret b using (dt) where a.series = 'ASIA' and b.series = 'AFRICA')
select block, round(avg(d), 6) + 0.0 as mean from d group by block having count(*) = 20""")
def difference_blocks(spark, sf_dir):
    r = metrics.daily_returns(nav_series(spark, sf_dir), ["series"], CAPITAL)
    return rounded(selection.difference_blocks(r.where("series = 'ASIA'"), r.where("series = 'AFRICA'")), ["block"], ["mean"])


def _today(spark, sf_dir) -> DataFrame:
    """Each code's row on the last week that all regular codes share, scored by the fall over a row."""
    df = ft.volume_ratios(ft.momentum(src.supplier_weekly(spark, sf_dir)))
    df = df.withColumns({"score": -F.col("ret1"), "close_u": F.col("close"), "adv20": F.exp("adv20_log") * 1000, "atr14p": (F.col("high") - F.col("low")) / F.col("close")})
    return df.where("dt = date '2000-06-05'").select("code", "sector", "score", "close_u", "adv20", "atr14p")


@query(f"""with {src.WEEKLY_SQL}, a as (select *, close * volume as tv, close / {lag('close')} - 1 as ret1 from bars), b as (select *, {roll('avg', 'tv', 20)} as adv from a),
t as (select 1 as one, code, sector, -ret1 as score, close as close_u, (1 + adv) * 1000 as adv20, (high - low) / close as atr from b where dt = date '2000-06-05'),
r as (select *, count(*) over () as n, quantile_cont(atr, 0.9) over () as q90, {sql_rank('score', 'one', True)} as share, row_number() over (order by score desc nulls last, code) as rank from t),
k as (select *, count(*) over (partition by sector) as same, close_u * 1.05 as limit_price from r where score is not null and rank <= least(5, greatest(1, floor(0.2 * n))))
select rank, code, round(share, 6) + 0.0 as share, round(limit_price, 6) + 0.0 as limit_price, (floor(least(1e7 / 5 / 5, 0.01 * adv20) / (limit_price * 100)) * 100)::bigint as shares,
concat_ws('; ', case when atr >= q90 then 'high volatility' end, 'no fill above the limit', case when adv20 < 3e8 or adv20 is null then 'thin trading' end, case when same >= 2 then 'sector concentration' end) as risks from k""")
def rank_output(spark, sf_dir):
    out = selection.ranking(_today(spark, sf_dir), slots=5, theta=0.2, hold=5, gmax=0.05)
    return out.select("rank", "code", r6("share").alias("share"), r6("limit_price").alias("limit_price"), "shares", F.concat_ws("; ", "risks").alias("risks"))


@query("""with g as (select (s_suppkey % 4)::int * 3 + (s_nationkey % 3)::int as id, (s_suppkey % 4)::int as hold, (s_nationkey % 3)::int as slots, round(avg(s_acctbal), 4) as sharpe from supplier group by 1, 2, 3),
n as (select a.id, b.sharpe / nullif(a.sharpe, 0) as ratio from g a join g b on (abs(a.hold - b.hold) = 1 and a.slots = b.slots) or (abs(a.slots - b.slots) = 1 and a.hold = b.hold))
select id, round(min(ratio), 6) + 0.0 as worst from n group by id""")
def neighbour_sensitivity(spark, sf_dir):
    """Neighbours in a grid with one row for each pair of parameters, its value the mean over all its suppliers."""
    hold, slots = (F.col("s_suppkey") % 4).cast("int"), (F.col("s_nationkey") % 3).cast("int")
    g = src.read(spark, sf_dir, "supplier").groupBy((hold * 3 + slots).alias("id"), hold.alias("hold"), slots.alias("slots")).agg(F.round(F.avg("s_acctbal"), 4).alias("sharpe"))
    return rounded(selection.neighbours(g, {"hold": [0, 1, 2, 3], "slots": [0, 1, 2]}), ["id"], ["worst"])


@query("""select c_custkey as id, c_acctbal > 0 as pass_cagr, c_acctbal / 1000 >= 0.4 * 5 as pass_sharpe, c_acctbal > 0 and c_acctbal / 1000 >= 0.4 * 5 as passed from customer""")
def holdout_verdict(spark, sf_dir):
    m = src.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("cagr"), (F.col("c_acctbal") / 1000).alias("sharpe"))
    return selection.holdout_verdict(m, 5.0).select("id", "pass_cagr", "pass_sharpe", "passed")


CODES = [f"NATION_{i}" for i in range(25)]


@query(f"with {src.NATION_SQL} select dt, {', '.join(f'max(close) filter (code = {chr(39)}{c}{chr(39)}) as {chr(34)}{c}{chr(34)}' for c in CODES)} from bars group by dt")
def dense_pivot(spark, sf_dir):
    return stores.dense(src.nation_daily(spark, sf_dir), "close", CODES)


@query("select ts::date as dt, event_type as code, null::double as open, null::double as high, null::double as low, value as close, 1.0::double as volume, 0.0::double as dividend, 0.0::double as split from events")
def conform_scan(spark, sf_dir):
    events = stores.scan(spark, f"{sf_dir}/events.parquet").select(F.col("ts").alias("dt"), F.col("event_type").alias("code"), F.col("value").alias("close"), F.lit("1").alias("volume"), "props")
    return stores.conform(events)


@query()
def file_manifest(spark, sf_dir):
    """All Parquet files of the tables."""
    return stores.manifest(spark, sf_dir, "*.parquet")
