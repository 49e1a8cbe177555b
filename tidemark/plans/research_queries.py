"""Label, split, score, selection and performance queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import lead as col_lead
from ..functions.exprs import r6
from ..functions.normal import cdf, cdf_sql, ppf, ppf_sql
from ..operators import features as ft
from ..operators import labels, metrics, research, selection
from ..sources import bars as src
from .feature_queries import MARKET_SQL, lag, rec, roll, sql_rank
from .panel_queries import ALIGN, CALENDAR, aligned

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
SPAN = "partition by code order by dt"
CAPITAL = 1e7
FOLD_END = "2001-06-29"
FEATURES = ["ret1", "ret5", "ret20", "sma_dev_25"]
SIGNS = {"r_ret1": -1.0, "r_ret5": -1.0, "r_ret20": -1.0, "r_sma_dev_25": -1.0}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def rounded(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return df.select(*keys, *[r6(F.col(c).cast("double")).alias(c) for c in values])


def sql_rounded(values: list[str]) -> str:
    return ", ".join(f"round({v}::double, 6) + 0.0 as {v}" for v in values)


def lead(x: str, n: int) -> str:
    return f"lead({x}, {n}) over ({SPAN})"


# Labels and splits


@query(f"""with {src.NATION_SQL}, {src.INDEX_SQL}, {CALENDAR}, {ALIGN}, f as (select code, dt, {lead('dt', 1)} as buy_dt, {', '.join(f"{lead('dt', 1 + n)} as sell_dt_{n}, {lead('open', 1 + n)} / nullif({lead('open', 1)}, 0) - 1 as L1_{n}" for n in (1, 5))} from al),
g as (select f.*, {', '.join(f'L1_{n} - (b{n}.ix / a.ix - 1) as L2_{n}' for n in (1, 5))} from f left join ix a on a.dt = buy_dt {' '.join(f'left join ix b{n} on b{n}.dt = sell_dt_{n}' for n in (1, 5))})
select code, dt, buy_dt, sell_dt_1, sell_dt_5, {sql_rounded(['L1_1', 'L1_5', 'L2_1', 'L2_5'])} from g""")
def labels_l1_l2(spark, sf_dir):
    df = labels.forward_returns(aligned(spark, sf_dir), (1, 5))
    df = labels.excess(df, src.index_series(src.nation_daily(spark, sf_dir)), (1, 5))
    return rounded(df, ["code", "dt", "buy_dt", "sell_dt_1", "sell_dt_5"], ["L1_1", "L1_5", "L2_1", "L2_5"])


@query(f"""with recursive {src.WEEKLY_SQL}, p as (select *, {lag('close')} as p from bars), t as (select *, greatest(high - low, abs(high - p), abs(low - p)) as tr from p), {rec('tr', '(1.0::double / 20)', 'a20', 't', 20, 'e20')},
f as (select code, dt, close, a20 / close as risk, {lead('open', 6)} / {lead('open', 1)} - 1 as x from bars left join e20 using (code, dt)),
g as (select code, dt, x - median(x) over (partition by dt) as L3_5, case when x is not null then (x > 0.008)::int end as L4_5, x / nullif(risk, 0) as L5_5 from f) select code, dt, {sql_rounded(['L3_5', 'L4_5', 'L5_5'])} from g""")
def labels_l3_l5(spark, sf_dir):
    df = labels.forward_returns(ft.average_range(src.supplier_weekly(spark, sf_dir), (20,)), (5,))
    return rounded(labels.relative(df, (5,)), ["code", "dt"], ["L3_5", "L4_5", "L5_5"])


@query(f"""with {src.WEEKLY_SQL}, f as (select code, dt, {', '.join(f"{lead('open', 1 + n)} / {lead('open', 1)} - 1 as x{n}" for n in (5, 10, 20))} from bars),
g as (select code, dt, {', '.join(f'x{n} - median(x{n}) over (partition by dt) as y{n}' for n in (5, 10, 20))} from f), h as (select code, dt, ({' + '.join(sql_rank(f'y{n}', 'dt') for n in (5, 10, 20))}) / 3 - 0.5 as lm from g) select code, dt, round(lm, 6) + 0.0 as "LM" from h""")
def label_lm(spark, sf_dir):
    df = labels.forward_returns(src.supplier_weekly(spark, sf_dir), (5, 10, 20)).withColumn("one", F.lit(1.0))
    return rounded(labels.blended(labels.relative(df, (5, 10, 20), risk="one")), ["code", "dt"], ["LM"])


FOLDS = f"""{CALENDAR}, mk as (select unnest(generate_series((select min(dt) from cal)::timestamp + interval 24 month, timestamp '{FOLD_END}', interval 6 month))::date as mark),
mw as (select mark, coalesce(lead(mark) over (order by mark), date '{FOLD_END}' + 1) as nxt, row_number() over (order by mark) - 1 as fold from mk),
fo as (select fold, min(dt) as val_start, max(dt) as val_end, min(pos) as pos from mw join cal on dt >= mark and dt < nxt and dt <= date '{FOLD_END}' group by fold),
ft as (select fo.*, c.dt as train_end from fo left join cal c on c.pos = fo.pos - 5 - 2)"""


def _folds(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    from .panel_queries import _calendar

    calendar = _calendar(spark, src.nation_daily(spark, sf_dir))
    start = calendar.agg(F.min("dt")).first()[0]
    return labels.train_ends(labels.folds(calendar, start, FOLD_END, 2, 6), calendar, 5), calendar


@query(f"with {src.NATION_SQL}, {FOLDS} select fold, val_start, val_end, train_end from ft")
def walkforward_folds(spark, sf_dir):
    return _folds(spark, sf_dir)[0].select(F.col("fold").cast("long").alias("fold"), "val_start", "val_end", "train_end")


@query(f"with {src.NATION_SQL}, {FOLDS}, {ALIGN} select fold, count(*) as n, bool_and(al.pos + 6 < ft.pos) as ok from al join ft on al.dt <= ft.train_end group by fold")
def purged_train_rows(spark, sf_dir):
    return labels.purge_holds(aligned(spark, sf_dir), _folds(spark, sf_dir)[0], 5).withColumn("fold", F.col("fold").cast("long"))


# Information coefficients and scores over weekly bars

WEEK = f"""{src.WEEKLY_SQL}, wf as (select dt, code, sector, {', '.join(f"(close / {lag('close', n)} - 1)::float as ret{n}" for n in (1, 5, 20))}, (close / {roll('avg', 'close', 25)} - 1)::float as sma_dev_25, {lead('open', 6)} / {lead('open', 1)} - 1 as y from bars),
wr as (select *, {', '.join(f"{sql_rank(f, 'dt')}::float as r_{f}" for f in FEATURES)} from wf)"""


def week(spark, sf_dir) -> DataFrame:
    df = labels.forward_returns(ft.moving_averages(ft.momentum(src.supplier_weekly(spark, sf_dir)), (5, 25)), (5,))
    return ft.ranks(df, FEATURES).withColumnRenamed("L1_5", "y")


IC = f"""{WEEK}, lo as ({' union all '.join(f"select dt, '{f}' as feature, {f}::double as x, y from wf where {f} is not null and y is not null" for f in FEATURES)}),
lr as (select dt, feature, {sql_rank('x', 'dt, feature')} as rx, {sql_rank('y', 'dt, feature')} as ry from lo),
ic as (select dt, feature, count(*) as n, corr(rx, ry) as ic from lr group by dt, feature having count(*) >= 30)"""


def _ic(spark, sf_dir) -> DataFrame:
    df = week(spark, sf_dir).select("dt", "y", *[F.col(f).cast("double").alias(f) for f in FEATURES])
    return research.daily_ic(df, FEATURES, "y")


@query(f"with {IC} select dt, feature, n, round(ic, 6) + 0.0 as ic from ic")
def daily_rank_ic(spark, sf_dir):
    return rounded(_ic(spark, sf_dir), ["dt", "feature", "n"], ["ic"])


NW = f"""{IC}, e as (select dt, feature, ic, ic - avg(ic) over (partition by feature) as e from ic),
l as (select *, {', '.join(f'e * lag(e, {k}) over (partition by feature order by dt) as l{k}' for k in range(1, 6))} from e),
nw as (select feature, count(*) as n, avg(ic) as mean, stddev_samp(ic) as sd, avg(ic) / (sqrt(sum(e * e) + {' + '.join(f'2 * (1 - {k}::double / 6) * coalesce(sum(l{k}), 0)' for k in range(1, 6))}) / count(*)) as t from l group by feature),
yr as (select feature, year(dt) as yy, avg(ic) as m from ic group by 1, 2), ag as (select yr.feature, avg((sign(m) = sign(mean))::int) as agree from yr join nw using (feature) group by 1)"""


@query(f"with {NW} select feature, n, {sql_rounded(['mean', 'sd'])}, round(mean / sd, 6) + 0.0 as ir, {sql_rounded(['t', 'agree'])} from nw join ag using (feature) where n >= 50")
def ic_summary(spark, sf_dir):
    return rounded(research.ic_summary(_ic(spark, sf_dir)), ["feature", "n"], ["mean", "sd", "ir", "t", "agree"])


@query(f"with {NW} select feature, n, {sql_rounded(['mean', 't'])} from nw")
def newey_west_t(spark, sf_dir):
    return rounded(research.newey_west(_ic(spark, sf_dir), "ic", 5, ["feature"]), ["feature", "n"], ["mean", "t"])


@query(f"""with {WEEK}, d as (select dt, avg(y) filter (r_ret20::double > (1 - 0.1::double)) as hi, avg(y) filter (r_ret20::double <= 0.1::double) as lo from wr group by dt), s as (select avg(hi) as top, avg(lo) as bottom from d)
select {sql_rounded(['top', 'bottom'])}, round(top - bottom, 6) + 0.0 as spread from s""")
def quantile_spread(spark, sf_dir):
    return rounded(research.quantile_spread(week(spark, sf_dir).withColumn("r_ret20", F.col("r_ret20").cast("double")), "r_ret20", "y"), [], ["top", "bottom", "spread"])


PAIRS = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :]]


@query(f"with {WEEK} " + " union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a}::double, {b}::double), 6) + 0.0 as r from wf" for a, b in PAIRS))
def feature_corr(spark, sf_dir):
    df = week(spark, sf_dir).select(*[F.col(f).cast("double").alias(f) for f in FEATURES])
    return rounded(research.pairwise_corr(df, FEATURES), ["a", "b"], ["r"])


RULES = [([a], q) for a in FEATURES for q in (0.1, 0.3)] + [([a, b], q) for a, b in PAIRS for q in (0.1, 0.3)]


@query(f"with {WEEK}, ru as (" + " union all ".join(f"select '{'+'.join(f'r_{x}' for x in c)}' as rule, {q}::double as share, dt, avg(y) as m, count(*) as k from wr where y is not null and {' and '.join(f'r_{x}::double > {1 - q}' for x in c)} group by dt" for c, q in RULES)
       + ") select rule, share, sum(k)::bigint as n, round(avg(m), 6) + 0.0 as value from ru group by rule, share having sum(k) >= 100")
def score_m1_rules(spark, sf_dir):
    df = week(spark, sf_dir).select("dt", "y", *[F.col(f"r_{f}").cast("double").alias(f"r_{f}") for f in FEATURES])
    return rounded(research.rule_scores(df, [f"r_{f}" for f in FEATURES], "y", (0.1, 0.3), (1, 2), 100), ["rule", "share", "n"], ["value"])


RANKS = [f"r_{f}" for f in FEATURES]
MEAN = f"(({' + '.join(f'coalesce({r}::double, 0)' for r in RANKS)}) / nullif({' + '.join(f'({r} is not null)::int' for r in RANKS)}, 0))"


@query(f"with {WEEK} select dt, code, round({MEAN}, 6) + 0.0 as score from wr")
def score_m2a(spark, sf_dir):
    return rounded(week(spark, sf_dir).withColumn("score", research.score_mean(RANKS)), ["dt", "code"], ["score"])


def _signed(sign: dict[str, str]) -> str:
    return f"(({' + '.join(f'coalesce(({r}::double - 0.5) * {sign[r]}, 0)' for r in RANKS)}) / nullif({' + '.join(f'({r} is not null)::int' for r in RANKS)}, 0))"


@query(f"with {IC}, sg as (select {', '.join(f'sign(avg(ic) filter (feature = {chr(39)}{f}{chr(39)})) as s_{f}' for f in FEATURES)} from ic) select dt, code, round({_signed({f'r_{f}': f's_{f}' for f in FEATURES})}, 6) + 0.0 as score from wr, sg")
def score_m2b(spark, sf_dir):
    """Each rank has the sign of its feature's mean coefficient."""
    signs = {f"r_{r['feature']}": r["s"] for r in _ic(spark, sf_dir).groupBy("feature").agg(F.signum(F.avg("ic")).alias("s")).collect()}
    return rounded(week(spark, sf_dir).withColumn("score", research.score_mean(RANKS, signs)), ["dt", "code"], ["score"])


@query(f"with {WEEK} select dt, code, round({_signed({r: str(s) for r, s in SIGNS.items()})}, 6) + 0.0 as score from wr")
def score_m2r(spark, sf_dir):
    return rounded(week(spark, sf_dir).withColumn("score", research.score_mean(RANKS, SIGNS)), ["dt", "code"], ["score"])


@query(f"""with {WEEK}, fa as (select 'B3' as family, dt, code, ret20 as score from wf union all select 'B5', dt, code, ret1 from wf union all select 'B6', dt, code, -ret1 from wf),
rk as (select dt, code, {sql_rank('score', 'family, dt')} as rk from fa) select dt, code, round(avg(rk), 6) + 0.0 as score from rk where rk is not null group by dt, code having count(*) >= 3""")
def ensemble_m6(spark, sf_dir):
    return rounded(research.ensemble(_baselines(spark, sf_dir), 3), ["dt", "code"], ["score"])


def _baselines(spark, sf_dir) -> DataFrame:
    df = week(spark, sf_dir)
    parts = {"B3": F.col("ret20"), "B5": F.col("ret1"), "B6": -F.col("ret1")}
    return df.select("dt", "code", F.explode(F.array(*[F.struct(F.lit(k).alias("family"), x.alias("score")) for k, x in parts.items()])).alias("s")).select("s.family", "dt", "code", "s.score")


@query(f"""with {WEEK}, fa as (select 'B3' as family, dt, code, ret20 as score from wf union all select 'B5', dt, code, ret1 from wf union all select 'B6', dt, code, -ret1 from wf)
select family, dt, code, round(score::double, 6) + 0.0 as score from fa""")
def baseline_scores_b3_b6(spark, sf_dir):
    return rounded(_baselines(spark, sf_dir), ["family", "dt", "code"], ["score"])


TOP = f"""c0 as (select dt, code, {MEAN} as score, count(*) over (partition by dt) as n, row_number() over (partition by dt order by {MEAN} desc nulls last, code) as r from wr),
c1 as (select *, row_number() over (partition by dt order by score desc, code) - 1 as slot from c0 where score is not null and r <= greatest(1, floor(0.05 * n)))"""


@query(f"with {WEEK}, {TOP} select dt, slot, code from c1 where slot < 3")
def candidates_topk(spark, sf_dir):
    df = week(spark, sf_dir).withColumn("score", research.score_mean(RANKS))
    return research.candidates(df, 0.05, 3).withColumn("slot", F.col("slot").cast("long"))


@query(f"""with {src.NATION_SQL}, {src.INDEX_SQL}, {FOLDS}, {MARKET_SQL}, mk2 as (select dt, (ix > s) as above, v * sqrt(252) as vol from m2),
li as (select fold, quantile_cont(vol, 0.8) as q from mk2 join fo on dt < val_start group by fold)
select dt, fo.fold, coalesce(above, false) as above, coalesce(vol <= q, false) as vol_ok from mk2 join fo on dt between val_start and val_end left join li on li.fold = fo.fold""")
def regime_flags(spark, sf_dir):
    market = ft.market(src.index_series(src.nation_daily(spark, sf_dir)))
    return research.regimes(market, _folds(spark, sf_dir)[0]).withColumn("fold", F.col("fold").cast("long"))


@query(f"""with {WEEK}, e as (select quantile_cont(r_ret20::double, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) as e from wr),
b as (select len(list_filter(list_distinct(e), lambda x: r_ret20::double > x)) as bin, r_ret20::double as p, y from wr, e where r_ret20 is not null)
select bin, count(*) as n, round(avg(p), 6) + 0.0 as mean_pred, round(avg(y), 6) + 0.0 as mean_actual from b group by bin""")
def calibration_deciles(spark, sf_dir):
    df = week(spark, sf_dir).select(F.col("r_ret20").cast("double").alias("p"), "y")
    return rounded(research.calibration(df, "p", "y"), ["bin", "n"], ["mean_pred", "mean_actual"])


@query(f"""with {WEEK}, b as (select code, y - 0.005 as net from wr where r_ret20::double > 0.95 and y is not null) select count(*) as n, round(avg(net), 6) + 0.0 as mean_net, round(median(net), 6) + 0.0 as median_net, round(avg((net > 0)::int), 6) + 0.0 as wins from b""")
def band_stats(spark, sf_dir):
    """Net return of the rows in the top 5 % by rank."""
    df = week(spark, sf_dir).where((F.col("r_ret20").cast("double") > 0.95) & F.col("y").isNotNull()).withColumn("net", F.col("y") - 0.005)
    out = df.agg(F.count("*").alias("n"), F.avg("net").alias("mean_net"), F.median("net").alias("median_net"), F.avg((F.col("net") > 0).cast("double")).alias("wins"))
    return rounded(out, ["n"], ["mean_net", "median_net", "wins"])


# Value series and trades

NAV = f"""{src.NATION_SQL}, iv as (select sector as series, dt, sum(close * volume) / sum(volume) as ix from bars group by 1, 2), w0 as (select *, avg(ix) over (partition by series order by dt rows between 49 preceding and current row) as m from iv),
nav as (select series, dt, {CAPITAL} * m / first_value(m) over (partition by series order by dt) as nav from w0),
ret as (select *, nav / coalesce(lag(nav) over (partition by series order by dt), {CAPITAL}) - 1 as ret from nav)"""


def nav_series(spark, sf_dir) -> DataFrame:
    """A value series for each region: the 50-row mean of its index, from the capital on."""
    per = src.nation_daily(spark, sf_dir).groupBy(F.col("sector").alias("series"), "dt").agg((F.sum(F.col("close") * F.col("volume")) / F.sum("volume")).alias("ix"))
    w = Window.partitionBy("series").orderBy("dt")
    per = per.withColumn("m", F.avg("ix").over(w.rowsBetween(-49, 0)))
    return per.select("series", "dt", (CAPITAL * F.col("m") / F.first("m").over(w)).alias("nav"))


@query(f"""with {NAV}, s as (select series, count(*) as days, max_by(nav, dt) as l, stddev_samp(ret) as sd, avg(ret) as mu, case when min(ret) < 0 then sqrt(avg(least(ret, 0) * least(ret, 0))) end as dn from ret group by series)
select series, days, round(l / {CAPITAL} - 1, 6) + 0.0 as total, round(pow(l / {CAPITAL}, 252.0::double / days) - 1, 6) + 0.0 as cagr, round(sd * sqrt(252), 6) + 0.0 as vol, round(mu / sd * sqrt(252), 6) + 0.0 as sharpe, round(mu / dn * sqrt(252), 6) + 0.0 as sortino from s""")
def nav_metrics(spark, sf_dir):
    r = metrics.daily_returns(nav_series(spark, sf_dir), ["series"], CAPITAL)
    return rounded(metrics.summary(r, ["series"], CAPITAL), ["series", "days"], ["total", "cagr", "vol", "sharpe", "sortino"])


@query(f"""with {NAV}, t as (select *, max(nav) over (partition by series order by dt rows unbounded preceding) as top from nav), d as (select *, nav / top - 1 as dd from t),
lo as (select series, arg_min(dd, (dd, dt)) as mdd, arg_min(dt, (dd, dt)) as trough_dt, arg_min(top, (dd, dt)) as level, max(dt) as last from d group by series)
select lo.series, round(mdd, 6) + 0.0 as mdd, min(n.dt) filter (n.nav = level and n.dt <= trough_dt) as peak_dt, trough_dt, coalesce(min(n.dt) filter (n.nav >= level and n.dt >= trough_dt), last) as recovered_dt from lo join nav n using (series) group by lo.series, mdd, trough_dt, last""")
def drawdown(spark, sf_dir):
    return rounded(metrics.drawdown(nav_series(spark, sf_dir), ["series"]), ["series", "peak_dt", "trough_dt", "recovered_dt"], ["mdd"])


@query(f"""with {NAV}, d as (select *, nav / max(nav) over (partition by series order by dt rows unbounded preceding) - 1 as dd from nav)
select series, round(case when min(dd) < 0 then case when max_by(nav, dt) > 0 then pow(max_by(nav, dt) / {CAPITAL}, 252.0::double / count(*)) - 1 else -1 end / -min(dd) end, 6) + 0.0 as calmar from d group by series""")
def calmar(spark, sf_dir):
    return rounded(metrics.calmar(nav_series(spark, sf_dir), ["series"], CAPITAL), ["series"], ["calmar"])


@query(f"""with {NAV}, y as (select series, year(dt) as year, max_by(nav, dt) as last, count(*) as days from nav group by 1, 2), b as (select *, coalesce(lag(last) over (partition by series order by year), {CAPITAL}) as before from y)
select series, year::int as year, round(last / before - 1, 6) + 0.0 as ret, round((last - before) / {CAPITAL}, 6) + 0.0 as pnl, days, round(case when sum(last - before) over (partition by series) > 0 then (last - before) / sum(last - before) over (partition by series) end, 6) + 0.0 as share from b""")
def year_returns(spark, sf_dir):
    df = metrics.year_returns(nav_series(spark, sf_dir), ["series"], CAPITAL)
    return df.select("series", "year", r6("ret").alias("ret"), r6(F.col("pnl") / CAPITAL).alias("pnl"), "days", r6("share").alias("share"))


@query(f"""with {NAV}, m as (select series, year(dt)::int as year, month(dt) as month, product(1 + ret) - 1 as ret from ret group by 1, 2, 3) select series, year, {', '.join(f'round(max(ret) filter (month = {k}), 6) + 0.0 as m{k}' for k in range(1, 13))} from m group by series, year""")
def monthly_pivot(spark, sf_dir):
    r = metrics.daily_returns(nav_series(spark, sf_dir), ["series"], CAPITAL)
    m = metrics.compounded(r, ["series", F.year("dt").alias("year"), F.month("dt").alias("month")])
    wide = m.groupBy("series", "year").pivot("month", list(range(1, 13))).agg(F.max("ret"))
    return wide.select("series", "year", *[r6(F.col(f"`{k}`")).alias(f"m{k}") for k in range(1, 13)])


@query(f"""with {NAV}, {src.INDEX_SQL}, {MARKET_SQL}, g as (select dt, coalesce(ix > s, false) as above, coalesce(v * sqrt(252) <= 15, false) as calm from m2), j as (select series, above, calm, ret from ret join g using (dt))
select series, above, calm, count(*) as days, round(avg(ret) * 252, 6) + 0.0 as annual, round(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252), 6) + 0.0 as sharpe from j group by 1, 2, 3""")
def regime_table(spark, sf_dir):
    r = metrics.daily_returns(nav_series(spark, sf_dir), ["series"], CAPITAL)
    market = ft.market(src.index_series(src.nation_daily(spark, sf_dir)))
    flags = market.select("dt", F.coalesce(F.col("mk_above200") == 1, F.lit(False)).alias("above"), F.coalesce(F.col("mk_vol20") <= 15, F.lit(False)).alias("calm"))
    out = r.join(flags, "dt").groupBy("series", "above", "calm").agg(F.count("*").alias("days"), (F.avg("ret") * 252).alias("annual"), metrics.sharpe().alias("sharpe"))
    return rounded(out, ["series", "above", "calm", "days"], ["annual", "sharpe"])


TRADES = f"""{src.WEEKLY_SQL}, tp as (select code, sector, {lead('dt', 1)} as buy_dt, {lead('dt', 6)} as exit_dt, {lead('open', 6)} / {lead('open', 1)} - 1 as ret, row_number() over ({SPAN}) - 1 as pos from bars),
tr as (select 'even' as series, code, sector, buy_dt, exit_dt, ret, ret * 1000 * (1 + pos % 3) as pnl, pos + 1 as buy_pos from tp where pos % 10 = 0 and ret is not null union all
       select 'odd', code, sector, buy_dt, exit_dt, ret, -ret * 500, pos + 1 from tp where pos % 10 = 5 and ret is not null)"""


def trades(spark, sf_dir) -> DataFrame:
    """Two series of trades: every tenth week's buy of each code, held for five weeks."""
    df = src.supplier_weekly(spark, sf_dir)
    pos = F.row_number().over(Window.partitionBy("code").orderBy("dt")) - 1
    df = df.select("code", "sector", col_lead("dt", 1).alias("buy_dt"), col_lead("dt", 6).alias("exit_dt"), (col_lead("open", 6) / col_lead("open", 1) - 1).alias("ret"), pos.alias("pos")).where("ret is not null and pos % 5 = 0")
    even = F.col("pos") % 10 == 0
    return df.withColumns({"series": F.when(even, "even").otherwise("odd"), "pnl": F.when(even, F.col("ret") * 1000 * (1 + F.col("pos") % 3)).otherwise(-F.col("ret") * 500), "buy_pos": F.col("pos") + 1})


@query(f"""with {TRADES}, a as (select series, count(*) as n, avg((ret > 0)::int) as win_rate, avg(ret) filter (ret > 0) as avg_win, avg(ret) filter (ret <= 0) as avg_loss, avg(ret) as expectancy, sum(pnl) as p,
coalesce(sum(pnl) filter (pnl > 0), 0) / nullif(abs(sum(pnl) filter (pnl <= 0)), 0) as profit_factor from tr group by series),
s as (select series, sum(pnl) as x, row_number() over (partition by series order by sum(pnl) desc, code) as r from tr group by series, code), t as (select series, sum(x) as t5 from s where r <= 5 group by series),
k as (select series, ret, row_number() over (partition by series order by pnl desc, code, buy_dt) as r, count(*) over (partition by series) as n from tr), o as (select series, avg(ret) as ex_top1 from k where r > greatest(1, ceil(n * 0.01)) group by series)
select series, n, {sql_rounded(['win_rate', 'avg_win', 'avg_loss', 'expectancy', 'profit_factor'])}, round(case when avg_loss < 0 then avg_win / abs(avg_loss) end, 6) + 0.0 as payoff, round(case when p > 0 then t5 / p end, 6) + 0.0 as top5_share, round(ex_top1, 6) + 0.0 as ex_top1 from a join t using (series) join o using (series)""")
def trade_stats(spark, sf_dir):
    return rounded(metrics.trade_stats(trades(spark, sf_dir), ["series"]), ["series", "n"], ["win_rate", "avg_win", "avg_loss", "expectancy", "profit_factor", "payoff", "top5_share", "ex_top1"])


@query(f"""with {TRADES}, a as (select *, (ret <= 0)::int as lost from tr), b as (select *, sum(1 - lost) over (partition by series order by exit_dt, code, buy_dt rows unbounded preceding) as run from a), c as (select series, run, sum(lost) as k from b group by 1, 2) select series, max(k)::bigint as longest from c group by series""")
def consecutive_losses(spark, sf_dir):
    return metrics.losing_streak(trades(spark, sf_dir), ["series"])


@query(f"""with {TRADES}, a as (select series, sector, sum(pnl) as pnl from tr group by 1, 2) select series, sector, round(pnl, 6) + 0.0 as pnl, round(case when sum(pnl) over (partition by series) > 0 then pnl / sum(pnl) over (partition by series) end, 6) + 0.0 as share from a""")
def sector_pnl_share(spark, sf_dir):
    return rounded(metrics.sector_share(trades(spark, sf_dir), ["series"]), ["series", "sector"], ["pnl", "share"])


_GATE_COLS = "series, n, per_year_ok, ci_low, sharpe, b1_p95, b_best, pos_years, max_year, top5_share, ex_top1, cost2_expectancy, mdd"
_GATE_ROWS = "('a',400,true,0.1,1.2,0.9,1.1,0.7,0.4,0.2,0.01,0.02,-0.2),('b',299,true,0.1,1.2,0.9,1.1,0.6,0.5,0.3,0.01,0.02,-0.35),('c',400,false,NULL,NULL,0.9,1.1,0.7,NULL,0.31,0.01,-0.02,-0.36),('d',300,true,0.0,1.0,1.0,0.5,0.59,0.4,NULL,0.0,NULL,NULL)"
_GATE_TYPED = "series, n, per_year_ok, " + ", ".join(f"cast({c.strip()} as double) as {c.strip()}" for c in _GATE_COLS.split(",")[3:])


@query(f"""with m as (select {_GATE_TYPED} from (values {_GATE_ROWS}) v({_GATE_COLS})), g as (select series, coalesce(n >= 300 and per_year_ok, false) as "G1", coalesce(ci_low > 0, false) as "G2", coalesce(sharpe > b1_p95 and sharpe > b_best, false) as "G3",
coalesce(pos_years >= 0.6 and max_year <= 0.5, false) as "G4", coalesce(top5_share <= 0.3 and ex_top1 > 0, false) as "G5", coalesce(cost2_expectancy > 0, false) as "G6", coalesce(mdd >= -0.35, false) as "G7" from m) select *, "G1" and "G2" and "G3" and "G4" and "G5" and "G6" and "G7" as passed from g""")
def gates(spark, sf_dir):
    m = spark.sql(f"select {_GATE_TYPED} from (values {_GATE_ROWS}) as v({_GATE_COLS})")
    return metrics.gates(m).select("series", *[f"G{i}" for i in range(1, 8)], "passed")


@query("""with g as (select n_suppkey, k, x from (select s_suppkey % 5 as n_suppkey, s_nationkey % 3 as k, avg(s_acctbal) as x from supplier group by 1, 2)) select n_suppkey as n, k::bigint as k, round(x, 6) + 0.0 as value, round(avg(x) over (partition by k), 6) + 0.0 as plateau from g""")
def plateau(spark, sf_dir):
    g = src.read(spark, sf_dir, "supplier").groupBy((F.col("s_suppkey") % 5).alias("n"), (F.col("s_nationkey") % 3).cast("long").alias("k")).agg(F.avg("s_acctbal").alias("value"))
    return rounded(metrics.plateau(g, ["k"], "value"), ["n", "k"], ["value", "plateau"])


@query(f"""with {src.NATION_SQL}, {src.INDEX_SQL}, a as (select dt, ix, first_value(ix) over (order by dt) as p0, row_number() over (order by dt) as i from ix),
d as (select dt, ix, p0, sum(case when i > 1 and i % 250 = 0 then ix * 0.01 else 0 end) over (order by dt rows unbounded preceding) as dv from a) select dt, round((ix + dv) / (p0 * 1.0015), 6) + 0.0 as nav from d""")
def baseline_b2(spark, sf_dir):
    """Buying the index on its first day and holding it with its dividends, one hundredth every 250 rows, not reinvested; for each unit of capital."""
    w = Window.orderBy("dt")  # one index series
    df = src.index_series(src.nation_daily(spark, sf_dir)).withColumns({"p0": F.first("ix").over(w), "i": F.row_number().over(w)})
    paid = F.when((F.col("i") > 1) & (F.col("i") % 250 == 0), F.col("ix") * 0.01).otherwise(0.0)
    df = df.withColumn("paid", paid).withColumn("dv", F.sum("paid").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.select("dt", r6((F.col("ix") + F.col("dv")) / (F.col("p0") * 1.0015)).alias("nav"))


def sql_drawn(place: str, n: str) -> str:
    return f"('0x' || substr(md5('42|' || draw || '|' || {place}), 1, 15))::bigint % {n}"


@query(f"""with {TRADES}, bl as (select series, floor(buy_pos / 20) as block, sum(ret) as total, count(*) as n from tr group by 1, 2), ow as (select *, row_number() over (partition by series order by block) - 1 as i, count(*) over (partition by series) as k from bl),
pl as (select series, draw, {sql_drawn('i', 'k')} as i from ow, (select unnest(range(1000)) as draw)), me as (select series, draw, sum(total) / sum(n) as mean from pl join ow using (series, i) group by 1, 2)
select series, round(quantile_cont(mean, 0.025), 6) + 0.0 as low, round(quantile_cont(mean, 0.975), 6) + 0.0 as high from me group by series""")
def bootstrap_ci(spark, sf_dir):
    return rounded(metrics.bootstrap_ci(metrics.trade_blocks(trades(spark, sf_dir), ["series"]), ["series"]), ["series"], ["low", "high"])


HALVES = 16


@query(f"""with {NAV}, dp as (select dt, row_number() over (order by dt) - 1 as pos, count(*) over () as days from (select distinct dt from ret)),
bs as (select series, ((pos + 1) * {HALVES} - 1) // days as b, sum(ret) as s, sum(ret * ret) as q from ret join dp using (dt) group by 1, 2),
bn as (select b, (select max(days) from dp) * (b + 1) // {HALVES} - (select max(days) from dp) * b // {HALVES} as n from range({HALVES}) t(b)),
full_ as (select series, b, coalesce(s, 0) as s, coalesce(q, 0) as q, n from (select distinct series from ret) cross join bn left join bs using (series, b)),
hv as (select range as h from range(1 << {HALVES}) where bit_count(range) = {HALVES} // 2),
io as (select series, h, sum(s) filter ((h >> b) & 1 = 1) as s1, sum(q) filter ((h >> b) & 1 = 1) as q1, sum(n) filter ((h >> b) & 1 = 1) as n1, sum(s) filter ((h >> b) & 1 = 0) as s0, sum(q) filter ((h >> b) & 1 = 0) as q0, sum(n) filter ((h >> b) & 1 = 0) as n0 from full_ cross join hv group by 1, 2),
ra as (select series, h, s1 / n1 / sqrt(greatest(q1 / n1 - pow(s1 / n1, 2), 1e-18)) as i, s0 / n0 / sqrt(greatest(q0 / n0 - pow(s0 / n0, 2), 1e-18)) as o from io),
be as (select h, arg_min(o, (-i, series)) as best from ra group by h), rk as (select h, (count(*) filter (o < best) + (count(*) filter (o = best) + 1) / 2) / (count(*) + 1) as w from ra join be using (h) group by h)
select round(avg((w <= 0.5)::int), 6) + 0.0 as pbo, count(*) as splits from rk""")
def pbo_cscv(spark, sf_dir):
    """Regions as trials, all 12,870 halves of 16 blocks; places are those of the days of all series."""
    r = metrics.daily_returns(nav_series(spark, sf_dir), ["series"], CAPITAL)
    days = r.select("dt").distinct().withColumn("pos", F.row_number().over(Window.orderBy("dt")) - 1)  # a row for each day
    r = r.join(F.broadcast(days), "dt").select(F.col("series").alias("trial"), "pos", "ret")
    return rounded(metrics.overfit_probability(r, HALVES), ["splits"], ["pbo"])


@query(f"""with {NAV}, ea as (select series, avg(ret) / nullif(stddev_samp(ret), 0) as sharpe, count(*) as n, sum(pow(ret - m, 3)) / count(*) / pow(sum(pow(ret - m, 2)) / count(*), 1.5) as skew, sum(pow(ret - m, 4)) / count(*) / pow(sum(pow(ret - m, 2)) / count(*), 2) as kurt
from (select *, avg(ret) over (partition by series) as m from ret) group by series), tr as (select stddev_samp(sharpe) as sd, 1 - 1 / count(*)::double as p, 1 - 1 / (count(*) * exp(1)) as q from ea where sharpe is not null),
b as (select sd * ((1 - 0.5772156649::double) * {ppf_sql('p')} + 0.5772156649::double * {ppf_sql('q')}) as best from tr), z as (select series, sharpe, best, (sharpe - best) * sqrt(n - 1) / sqrt(1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe) as z from ea, b)
select series, round(sharpe, 6) + 0.0 as sharpe, round(best, 6) + 0.0 as best, round({cdf_sql('z')}, 6) + 0.0 as dsr from z""")
def dsr(spark, sf_dir):
    """The deflated Sharpe ratio of each series against all of them."""
    r = metrics.daily_returns(nav_series(spark, sf_dir), ["series"], CAPITAL)
    return rounded(metrics.deflated(r, ["series"]), ["series"], ["sharpe", "best", "dsr"])


@query(f"""with z as (select c_custkey, c_acctbal / 2500 - 1.5 as z, (c_acctbal + 1000) / 11000 as p from customer) select c_custkey, round({cdf_sql('z')}, 9) + 0.0 as cdf, round({ppf_sql('p')}, 9) + 0.0 as ppf from z""")
def normal_columns(spark, sf_dir):
    df = src.read(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") / 2500 - 1.5).alias("z"), ((F.col("c_acctbal") + 1000) / 11000).alias("p"))
    return df.select("c_custkey", *[(F.round(x, 9) + F.lit(0.0)).alias(n) for n, x in (("cdf", cdf("z")), ("ppf", ppf("p")))])


@query(f"""with {NAV}, d as (select a.dt, a.ret - b.ret as d, (row_number() over (order by a.dt) - 1) // 20 as block from ret a join ret b using (dt) where a.series = 'ASIA' and b.series = 'AFRICA'),
bl as (select block, avg(d) as total, 1 as n from d group by block having count(*) = 20), ow as (select *, row_number() over (order by block) - 1 as i, count(*) over () as k from bl),
pl as (select draw, {sql_drawn('i', 'k')} as i from ow, (select unnest(range(1000)) as draw)), me as (select draw, sum(total) / sum(n) as mean from pl join ow using (i) group by draw)
select case when (select count(*) from bl) >= 2 then round(quantile_cont(mean, 0.025), 6) + 0.0 end as low, case when (select count(*) from bl) >= 2 then round(quantile_cont(mean, 0.975), 6) + 0.0 end as high from me""")
def difference_ci(spark, sf_dir):
    r = metrics.daily_returns(nav_series(spark, sf_dir), ["series"], CAPITAL)
    return rounded(selection.difference_ci(r.where("series = 'ASIA'"), r.where("series = 'AFRICA'")), [], ["low", "high"])


@query()
def random_candidates(spark, sf_dir):
    return research.random_candidates(week(spark, sf_dir).where("ret20 is not null").select("dt", "code"), 5, 42)


@query()
def label_shuffle(spark, sf_dir):
    return research.shuffled_labels(week(spark, sf_dir).select("dt", "code", "y"), "y", 7)
