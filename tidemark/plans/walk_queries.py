"""Split boundaries, candidate rules and checks around a walk-forward, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import lead as col_lead
from ..functions.exprs import r6
from ..operators import features as ft
from ..operators import labels, membership, metrics, panel, research
from ..sources import bars as src
from ..sources import fixtures as fx
from .feature_queries import MARKET_SQL, lag, roll
from .panel_queries import ALIGN, CALENDAR, PIT, UNIVERSE, _calendar, _pit, universe_rows
from .research_queries import FOLDS, NW, TRADES, WEEK, _folds, _ic, lead, rounded, sql_rounded, trades, week

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
SPAN = "partition by code order by dt"
HOLDOUT, LEAST, HORIZON = "2001-01-01", 3, 20


def query(sql: str):
    def add(fn):
        QUERIES[fn.__name__] = fn
        ORACLES[fn.__name__] = sql
        return fn

    return add


BOUNDS = f"""{src.NATION_SQL}, {src.INDEX_SQL}, {CALENDAR}, {ALIGN}, {UNIVERSE}, {MARKET_SQL}, pd as (select un.dt, count(*) as n, avg((s is not null)::int) as share from un left join m2 on m2.dt = un.dt where failed is null group by un.dt),
sb as (select (select min(dt) from pd where n >= {LEAST} and share > 0.99) as analysis_start, h.dt as holdout_start, c.dt as dev_end from (select min(dt) as dt, min(pos) as p from cal where dt >= date '{HOLDOUT}') h left join cal c on c.pos = h.p - {HORIZON} - 2)"""


def _boundaries(spark, sf_dir) -> DataFrame:
    bars = src.nation_daily(spark, sf_dir)
    market = ft.market(src.index_series(bars)).select("dt", "mk_above200")
    rows = universe_rows(spark, sf_dir).where("in_univ").select("dt", "code").join(F.broadcast(market), "dt", "left")  # market: a row for each day
    return labels.boundaries(rows, F.col("mk_above200").isNotNull(), _calendar(spark, bars), F.lit(HOLDOUT).cast("date"), HORIZON, LEAST)


@query(f"with {BOUNDS} select analysis_start, holdout_start, dev_end from sb")
def split_boundaries(spark, sf_dir):
    return _boundaries(spark, sf_dir).select("analysis_start", "holdout_start", "dev_end")


@query(f"""with {BOUNDS}, mk as (select unnest(generate_series((select analysis_start from sb)::timestamp + interval 12 month, (select dev_end from sb)::timestamp, interval 6 month))::date as mark),
mw as (select mark, coalesce(lead(mark) over (order by mark), (select dev_end from sb) + 1) as nxt, row_number() over (order by mark) - 1 as fold from mk),
fo as (select fold, min(dt) as val_start, max(dt) as val_end, min(pos) as pos from mw join cal on dt >= mark and dt < nxt and dt <= (select dev_end from sb) group by fold)
select fold, val_start, val_end, c.dt as train_end from fo left join cal c on c.pos = fo.pos - {HORIZON} - 2""")
def split_folds(spark, sf_dir):
    """Folds from the analysis start to the end of development, the holdout left out."""
    b, calendar = _boundaries(spark, sf_dir).first(), _calendar(spark, src.nation_daily(spark, sf_dir))
    if b["analysis_start"] is None or b["dev_end"] is None:
        return spark.createDataFrame([], "fold long, val_start date, val_end date, train_end date")
    df = labels.train_ends(labels.folds(calendar, b["analysis_start"], b["dev_end"], 1, 6), calendar, HORIZON)
    return df.select(F.col("fold").cast("long").alias("fold"), "val_start", "val_end", "train_end")


@query(f"""with {WEEK}, d as (select dt, row_number() over (order by dt) - 1 as i, floor(count(*) over () * 0.8) as cut from (select distinct dt from wf)),
p as (select dt, case when i >= cut then 'valid' when i <= greatest(0, cut - 7) then 'train' end as part from d) select coalesce(part, 'purged') as part, count(*) as n, min(dt) as first, max(dt) as last from wf join p using (dt) group by 1""")
def inner_split(spark, sf_dir):
    df = labels.inner_split(week(spark, sf_dir).select("dt", "code"), 5)
    return df.groupBy(F.coalesce("part", F.lit("purged")).alias("part")).agg(F.count("*").alias("n"), F.min("dt").alias("first"), F.max("dt").alias("last"))


_COST = "2 * (0.0005::double + case when adv >= 1e9 then 0.001 when adv >= 3e8 then 0.0015 else 0.0025 end::double)"


@query(f"""with {WEEK}, c0 as (select dt, code, ret20, ret5::double as pred, close * volume * 1e4 as adv, count(*) over (partition by dt) as n, row_number() over (partition by dt order by ret20 asc nulls last, code) as r from wf join bars using (dt, code)),
c1 as (select dt, code, row_number() over (partition by dt order by ret20, code) - 1 as slot from c0 where ret20 is not null and r <= greatest(1, floor(0.2 * n)) and pred > {_COST}) select dt, slot, code from c1 where slot < 5""")
def candidates_pred_rule(spark, sf_dir):
    """The lowest scores of a day whose predicted return pays the round trip."""
    df = week(spark, sf_dir).withColumns({"score": F.col("ret20"), "pred": F.col("ret5").cast("double"), "adv": F.col("close") * F.col("volume") * 1e4})
    out = research.candidates(df, 0.2, 5, pred_above=research.round_trip_cost(F.col("adv")), ascending=True)
    return out.select("dt", F.col("slot").cast("long").alias("slot"), "code")


REGIMES = ("none", "idx_above_sma200", "idx_vol_below_p80", "excl_down_lowvol")


@query(f"""with {src.NATION_SQL}, {src.INDEX_SQL}, {FOLDS}, {MARKET_SQL}, mk2 as (select dt, coalesce(ix > s, false) as above, v * sqrt(252) as vol from m2),
li as (select fold, quantile_cont(vol, 0.8) as q from mk2 join fo on dt < val_start group by fold),
rg as (select dt, fo.fold, above, coalesce(vol <= q, false) as vol_ok from mk2 join fo on dt between val_start and val_end left join li on li.fold = fo.fold)
select fold, count(*) as none, count(*) filter (above) as idx_above_sma200, count(*) filter (vol_ok) as idx_vol_below_p80, count(*) filter (above or not vol_ok) as excl_down_lowvol from rg group by fold""")
def regime_days(spark, sf_dir):
    """How many days of each fold every regime rule leaves."""
    flags = research.regimes(ft.market(src.index_series(src.nation_daily(spark, sf_dir))), _folds(spark, sf_dir)[0])
    return flags.groupBy(F.col("fold").cast("long").alias("fold")).agg(*[F.count_if(research.regime_ok(r)).alias(r) for r in REGIMES])


@query(f"""with {src.WEEKLY_SQL}, a as (select *, {roll('avg', 'close', 25)} as s, close * volume as tv from bars), b as (select *, {lag('s', 5)} as p, {roll('avg', 'tv', 20)} as adv from a)
select dt, code, round(case when close > s and s > p then ln(1 + adv) end, 6) + 0.0 as score from b""")
def baseline_b4(spark, sf_dir):
    """Traded value of codes above a rising 25-row mean."""
    df = ft.volume_ratios(ft.moving_averages(src.supplier_weekly(spark, sf_dir), (25,)))
    return df.select("dt", "code", r6(F.when((F.col("sma_dev_25") > 0) & (F.col("sma_slope_25") > 0), F.col("adv20_log"))).alias("score"))


@query(f"with {TRADES} select series, year(buy_dt)::int as year, count(*) as n from tr group by 1, 2")
def trades_by_year(spark, sf_dir):
    return metrics.trades_by_year(trades(spark, sf_dir), ["series"])


@query(f"""with {WEEK}, z as (select r_ret20::double as p, (y > 0.008)::int::double as a from wr where y is not null), e as (select quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) as e from z),
b as (select len(list_filter(list_distinct(e), lambda x: p > x)) as bin, avg(p) as mp, avg(a) as ma from z, e where p is not null group by 1), w as (select max(abs(mp - ma)) as worst from b) select round(worst, 6) + 0.0 as worst, worst <= 0.05 as ok from w""")
def calibration_within(spark, sf_dir):
    df = week(spark, sf_dir).select(F.col("r_ret20").cast("double").alias("p"), (F.col("y") > 0.008).cast("double").alias("a"))
    return research.calibrated(df, "p", "a").select(r6("worst").alias("worst"), "ok")


@query(f"""with {src.WEEKLY_SQL}, a as (select code, dt, row_number() over ({SPAN}) as i, {lead('dt', 3)} as upto from bars), s as (select code, dt, case when i % 20 = 0 then 2.0 else 0.5 end::double as split from a where i % 10 = 0)
select a.code, a.dt as after, a.upto, coalesce(product(s.split), 1)::double as ratio from a left join s on s.code = a.code and s.dt > a.dt and s.dt <= a.upto where a.i % 4 = 0 and a.upto is not null group by all""")
def splits_signal_to_buy(spark, sf_dir):
    """Every fourth week's signal is bought three weeks later; every tenth week splits."""
    df = src.supplier_weekly(spark, sf_dir).select("code", "dt", F.row_number().over(Window.partitionBy("code").orderBy("dt")).alias("i"), col_lead("dt", 3).alias("upto"))
    actions = df.where("i % 10 = 0").select("code", "dt", F.when(F.col("i") % 20 == 0, 2.0).otherwise(0.5).alias("split"))
    return panel.splits_between(df.where("i % 4 = 0 and upto is not null").select("code", F.col("dt").alias("after"), "upto"), actions)


@query("""with o as (select o_custkey as c_custkey, min(o_orderpriority) as priority from orders group by 1) select c_custkey, coalesce(priority, 'NA') as priority from customer left join o using (c_custkey)""")
def lookup_default(spark, sf_dir):
    """Each customer's most urgent order priority, NA for those without orders."""
    first = src.read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderpriority").alias("priority"))
    return panel.lookup(src.read(spark, sf_dir, "customer").select("c_custkey"), first, "c_custkey", "priority", "NA")


@query(f"with {src.NATION_SQL}, {CALENDAR} select dt, row_number() over (order by dt) - 1 as pos from cal where not (month(dt) = 12 and day(dt) = 31) and not (month(dt) = 1 and day(dt) <= 3)")
def calendar_year_end(spark, sf_dir):
    df = panel.business_days(src.nation_daily(spark, sf_dir), fx.table(spark, "fx_holidays"), open_new_year=False)
    return df.select("dt", F.col("pos").cast("long").alias("pos"))


_CHECKS = {
    "missing_ohlc": "open is null or high is null or low is null or close is null", "duplicate_key": "n > 1", "price_not_positive": "open <= 0 or high <= 0 or low <= 0 or close <= 0",
    "high_too_low": "high < greatest(open, close) * (1 - 1e-9)", "low_too_high": "low > least(open, close) * (1 + 1e-9)", "no_volume": "volume = 0", "big_move": "abs(ret) > 0.5",
    "split_missed": "split > 0 and split <> 1 and abs((1 + ret) * split - 1) < 0.15", "weekend": "isodow(dt) > 5", "off_calendar": "off",
}


@query(f"""with {src.NATION_SQL}, {CALENDAR}, q as (select b.*, case when day(b.dt) = 1 then 2 else 0 end as split, c.dt is null as off, 1 as n, close / lag(close) over (partition by code order by b.dt) - 1 as ret from bars b left join cal c on c.dt = b.dt)
""" + " union all ".join(f"select '{k}' as \"check\", count(*) filter ({x}) as \"rows\", count(*) filter (({x}) and dt < date '{HOLDOUT}') as rows_before from q" for k, x in _CHECKS.items()))
def quality_before_holdout(spark, sf_dir):
    """Checks of the bars of all days and of those before the holdout; the first of a month counts as a split."""
    bars = src.nation_daily(spark, sf_dir).withColumn("split", F.when(F.day("dt") == 1, 2.0).otherwise(0.0))
    return panel.quality(bars, _calendar(spark, bars), F.lit(HOLDOUT).cast("date"))


@query(f"with {PIT}, {fx.cte('fx_bars')} select year(dt)::int as year, round(avg((code not in (select code from fx_bars))::int), 6) + 0.0 as share from pit where member group by 1")
def unpriced_members(spark, sf_dir):
    return membership.unpriced_share(_pit(spark), fx.table(spark, "fx_bars")).select("year", r6("share").alias("share"))


@query(f"with {NW} select feature, n, {sql_rounded(['mean', 't', 'agree'])}, coalesce(agree >= 0.6 and abs(t) > 2, false) as adopted from nw join ag using (feature) where n >= 50")
def feature_adoption(spark, sf_dir):
    df = research.ic_summary(_ic(spark, sf_dir)).withColumn("adopted", research.adoption())
    return rounded(df, ["feature", "n", "adopted"], ["mean", "t", "agree"])
