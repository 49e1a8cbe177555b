"""Panel queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import r6
from ..operators import membership, panel, selection
from ..sources import bars as src
from ..sources import fixtures as fx
from ..sources import stores
from .feature_queries import lag, roll

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
MIN_ADV, MIN_CLOSE, MIN_DAYS = 100_000.0, 100.0, 250
SPAN = "partition by code order by dt"


def query(sql: str):
    def add(fn):
        QUERIES[fn.__name__] = fn
        ORACLES[fn.__name__] = sql
        return fn

    return add


def _calendar(spark, bars: DataFrame) -> DataFrame:
    return panel.business_days(bars, fx.table(spark, "fx_holidays"))


CALENDAR = f"""{fx.cte('fx_holidays')}, ends as (select min(dt) as a, max(dt) as b from bars where volume > 0),
cal as (select dt, row_number() over (order by dt) - 1 as pos from (select unnest(generate_series(a, b, interval 1 day))::date as dt from ends) where isodow(dt) < 6 and dt not in (select dt from fx_holidays))"""
ALIGN = f"""spans as (select code, min(dt) as a, max(dt) as b from bars group by code),
grid as (select s.code, c.dt, c.pos from spans s join cal c on c.dt between s.a and s.b),
al0 as (select g.code, g.dt, g.pos, b.open, b.high, b.low, b.close as c0, b.volume as v0, coalesce(b.volume > 0 and b.open is not null and b.high is not null and b.low is not null and b.close is not null, false) as tradable,
               row_number() over (partition by g.code order by g.dt) as listed_days from grid g left join bars b on b.code = g.code and b.dt = g.dt),
al as (select code, dt, pos, tradable, listed_days, case when tradable then open end as open, case when tradable then high end as high, case when tradable then low end as low,
              last_value(c0 ignore nulls) over ({SPAN} rows unbounded preceding) as close, case when tradable then v0 else 0 end as volume from al0)"""
UNIVERSE = f"""tv as (select *, close as close_u, open as open_u, close * volume as tv from al), ad as (select *, {roll('avg', 'tv', 20)} as adv20 from tv),
un as (select *, case when not tradable then 'tradable' when not coalesce(adv20 >= {MIN_ADV}, false) then 'adv' when not coalesce(close_u >= {MIN_CLOSE}, false) then 'close' when listed_days < {MIN_DAYS} then 'listed' end as failed from ad)"""


def aligned(spark, sf_dir) -> DataFrame:
    bars = src.nation_daily(spark, sf_dir)
    return panel.align(bars, _calendar(spark, bars))


def universe_rows(spark, sf_dir) -> DataFrame:
    return panel.universe(panel.traded_value(aligned(spark, sf_dir)), MIN_ADV, MIN_CLOSE, MIN_DAYS)


@query(f"with {src.NATION_SQL}, {CALENDAR} select dt, pos from cal")
def calendar_build(spark, sf_dir):
    return _calendar(spark, src.nation_daily(spark, sf_dir)).select("dt", F.col("pos").cast("long").alias("pos"))


@query(f"""with {src.NATION_SQL}, {CALENDAR} (select dt, 'missing' as side from (select dt from cal except select dt from bars where volume > 0))
union all (select dt, 'extra' as side from (select dt from bars where volume > 0 except select dt from cal))""")
def calendar_mismatch(spark, sf_dir):
    bars = src.nation_daily(spark, sf_dir)
    return panel.calendar_mismatch(bars, _calendar(spark, bars))


@query(f"with {src.NATION_SQL}, {CALENDAR}, {ALIGN} select code, dt, pos, tradable, listed_days, open, high, low, close, volume from al")
def panel_align(spark, sf_dir):
    df = aligned(spark, sf_dir)
    return df.select("code", "dt", F.col("pos").cast("long").alias("pos"), "tradable", F.col("listed_days").cast("long").alias("listed_days"), "open", "high", "low", "close", "volume")


@query(f"""with {fx.cte('fx_splits')} select code, dt, round(coalesce(product(ratio) over ({SPAN} rows between 1 following and unbounded following), 1), 9) + 0.0 as factor from fx_splits""")
def split_factor(spark, sf_dir):
    return panel.split_factor(fx.table(spark, "fx_splits"), "ratio").select("code", "dt", (F.round("factor", 9) + 0.0).alias("factor"))


@query(f"""with {fx.cte('fx_bars')}, f as (select code, product(split) as f from fx_bars where dt > date '2020-01-07' and split > 0 group by code)
select b.code, b.dt, open * coalesce(f, 1) as open, high * coalesce(f, 1) as high, low * coalesce(f, 1) as low, close * coalesce(f, 1) as close, volume / coalesce(f, 1) as volume, dividend * coalesce(f, 1) as dividend
from fx_bars b left join f using (code) where dt <= date '2020-01-07'""")
def asof_undo_splits(spark, sf_dir):
    return panel.undo_later_splits(fx.table(spark, "fx_bars"), F.lit("2020-01-07").cast("date")).select("code", "dt", "open", "high", "low", "close", "volume", "dividend")


@query(f"""with {fx.cte('fx_bars')}, d as (select distinct on (code, dt) * from fx_bars order by code, dt, split),
b as (select *, case when split <> 0 and (split < 0.6 or split > 1001) then split else 1 end as bad, lag(close) over ({SPAN}) as p from d),
e as (select *, dividend * coalesce(product(bad) over ({SPAN} rows between 1 following and unbounded following), 1) as dv from b)
select code, dt, case when bad <> 1 then 0 else split end as split, case when dv > 0.3 * p then 0 else dv end as dividend from e""")
def clean_actions(spark, sf_dir):
    first = fx.table(spark, "fx_bars").groupBy("code", "dt").agg(F.min_by(F.struct("close", "dividend", "split"), "split").alias("s")).select("code", "dt", "s.*")
    return panel.clean_actions(first, low=0.6).select("code", "dt", "split", "dividend")


@query(f"with {src.NATION_SQL}, {CALENDAR}, {ALIGN}, {UNIVERSE} select code, dt, round(ln(1 + tv), 6) + 0.0 as tv_log, round(ln(1 + adv20), 6) + 0.0 as adv20_log from un")
def adv20(spark, sf_dir):
    df = universe_rows(spark, sf_dir)
    return df.select("code", "dt", *[r6(F.log1p(c)).alias(f"{c}_log") for c in ("tv", "adv20")])


_BANDS = ", ".join(f"({lo}::double, {hi}::double, {w}::double)" for (lo, hi, w) in zip(["'-inf'", *[b for b, _ in panel.LIMIT_BANDS]], [*[b for b, _ in panel.LIMIT_BANDS], "'inf'"], [*[w for _, w in panel.LIMIT_BANDS], panel.LIMIT_ABOVE]))


@query(f"with {fx.cte('fx_base')}, bands(lo, hi, w) as (values {_BANDS}) select base, w as width from fx_base left join bands on base >= lo and base < hi")
def price_limit_band(spark, sf_dir):
    return fx.table(spark, "fx_base").select("base", panel.limit_width(F.col("base")).alias("width"))


@query(f"""with {fx.cte('fx_adv')}, t(least, rate) as (values (1e9, 0.001), (3e8, 0.0015), (1e8, 0.0025))
select adv, coalesce((select arg_max(rate, least) from t where adv >= least), 0.0025)::double as rate from fx_adv""")
def slippage_step(spark, sf_dir):
    return fx.table(spark, "fx_adv").select("adv", panel.slippage(F.col("adv")).alias("rate"))


@query(f"""with {src.NATION_SQL}, {CALENDAR}, {ALIGN}, {UNIVERSE}, bands(lo, hi, w) as (values {_BANDS}), p as (select *, lag(close) over ({SPAN}) as base from un)
select code, dt, coalesce(open_u >= (base + w) * 0.999, false) as stop_high, coalesce(open_u <= (base - w) * 1.001, false) as stop_low from p left join bands on base >= lo and base < hi""")
def stop_flags(spark, sf_dir):
    return panel.stop_flags(universe_rows(spark, sf_dir)).select("code", "dt", "stop_high", "stop_low")


@query(f"with {src.NATION_SQL}, {CALENDAR}, {ALIGN}, {UNIVERSE} select code, dt, failed, failed is null as in_univ from un")
def universe_filter(spark, sf_dir):
    return universe_rows(spark, sf_dir).select("code", "dt", "failed", "in_univ")


@query(f"with {src.NATION_SQL}, {CALENDAR}, {ALIGN}, {UNIVERSE} select coalesce(failed, 'in_univ') as step, count(*) as n from un group by 1 union all select 'rows', count(*) from un")
def filter_accounting(spark, sf_dir):
    df = universe_rows(spark, sf_dir)
    return df.groupBy(F.coalesce("failed", F.lit("in_univ")).alias("step")).agg(F.count("*").alias("n")).union(df.agg(F.count("*").alias("n")).select(F.lit("rows").alias("step"), "n"))


@query(f"""with {fx.cte('fx_bars', 'fx_holidays')}, ends as (select min(dt) as a, max(dt) as b from fx_bars where volume > 0),
cal as (select unnest(generate_series(a, b, interval 1 day))::date as dt from ends), days as (select dt from cal where isodow(dt) < 6 and dt not in (select dt from fx_holidays)),
x as (select b.*, d.dt is null as off, row_number() over (partition by code, b.dt order by open nulls first, high nulls first, low nulls first, close nulls first, volume nulls first, split nulls first) as n,
      close / lag(close) over (partition by code order by b.dt, split nulls first) - 1 as ret from fx_bars b left join days d on d.dt = b.dt),
c as (select count(*) filter (open is null or high is null or low is null or close is null) as missing_ohlc, count(*) filter (n > 1) as duplicate_key, count(*) filter (open <= 0 or high <= 0 or low <= 0 or close <= 0) as price_not_positive,
      count(*) filter (high < greatest(open, close)) as high_too_low, count(*) filter (low > least(open, close)) as low_too_high, count(*) filter (volume = 0) as no_volume, count(*) filter (abs(ret) > 0.5) as big_move,
      count(*) filter (split > 0 and split <> 1 and abs((1 + ret) * split - 1) < 0.15) as split_missed, count(*) filter (isodow(dt) > 5) as weekend, count(*) filter (off) as off_calendar from x)
select "check", "rows" from c unpivot ("rows" for "check" in (missing_ohlc, duplicate_key, price_not_positive, high_too_low, low_too_high, no_volume, big_move, split_missed, weekend, off_calendar))""")
def quality_report(spark, sf_dir):
    bars = fx.table(spark, "fx_bars")
    return panel.quality(bars, _calendar(spark, bars))


@query(f"with {src.NATION_SQL}, r as (select code, dt, close / lag(close) over ({SPAN}) - 1 as ret from bars) select code, dt, round(ret, 6) + 0.0 as ret from r where abs(ret) > 0.5")
def big_moves(spark, sf_dir):
    return panel.big_moves(src.nation_daily(spark, sf_dir)).withColumn("ret", r6("ret"))


@query(f"""with {fx.cte('fx_bars')}, d as (select distinct on (code, dt) * from fx_bars order by code, dt, split), r as (select *, close / lag(close) over ({SPAN}) - 1 as ret from d)
select code, dt, round(ret, 6) + 0.0 as ret, split from r where split > 0 and split <> 1 and abs((1 + ret) * split - 1) < 0.15""")
def split_miss(spark, sf_dir):
    first = fx.table(spark, "fx_bars").groupBy("code", "dt").agg(F.min_by(F.struct("close", "split"), "split").alias("s")).select("code", "dt", "s.*")
    return panel.split_missed(first).withColumn("ret", r6("ret"))


@query(f"""with {src.NATION_SQL}, p as (select dt, count(*) as n from bars where volume > 0 group by dt),
m as (select *, case when count(*) over w >= 5 then quantile_cont(n, 0.5) over w end as typical from p window w as (order by dt rows between 10 preceding and 10 following))
select dt, n, typical::double as typical from m where n < 0.7 * typical""")
def data_holes(spark, sf_dir):
    return panel.data_holes(src.nation_daily(spark, sf_dir), share=0.7)


INTERVALS = f"""{fx.cte('fx_events', 'fx_members')}, st as (select out_code as code, dt, 0 as is_in from fx_events where out_code is not null union all select in_code, dt, 1 from fx_events where in_code is not null),
sw as (select *, lag(is_in) over (partition by code order by dt, is_in) as b, lead(dt) over (partition by code order by dt, is_in) as a from st),
iv as (select code, dt as in_dt, a as out_dt from sw where is_in = 1 union all select code, null, dt from sw where is_in = 0 and b is null union all select code, null, null from fx_members where code not in (select code from st))"""


def _intervals(spark) -> DataFrame:
    return membership.intervals(fx.table(spark, "fx_events"), fx.table(spark, "fx_members"))


@query(f"with {INTERVALS} select code, in_dt, out_dt from iv")
def member_intervals(spark, sf_dir):
    return _intervals(spark)


PIT = f"""{INTERVALS}, days as (select unnest(generate_series(date '2019-12-30', date '2020-12-31', interval 7 day))::date as dt), codes as (select distinct code from iv),
pit as (select c.code, d.dt, bool_or(iv.code is not null) as member from codes c cross join days d left join iv on iv.code = c.code and (in_dt is null or d.dt >= in_dt) and (out_dt is null or d.dt < out_dt) group by c.code, d.dt)"""


def _pit(spark) -> DataFrame:
    spans = _intervals(spark)
    days = spark.sql("select explode(sequence(date '2019-12-30', date '2020-12-31', interval 7 days)) as dt")
    return membership.members_at(spans.select("code").distinct().crossJoin(days), spans)


@query(f"with {PIT} select code, dt, member from pit")
def pit_membership(spark, sf_dir):
    return _pit(spark).select("code", "dt", "member")


@query(f"with {PIT} select dt, count(*) filter (member) as n from pit group by dt")
def member_counts(spark, sf_dir):
    return _pit(spark).groupBy("dt").agg(F.count_if("member").alias("n"))


@query(f"""with {INTERVALS}, sx as (select *, lead(is_in) over (partition by code order by dt, is_in) as nx from st), sy as (select *, lag(is_in) over (partition by code order by dt, is_in) as b from st)
select code, 'same event twice' as why from sy where is_in = b union select code, 'last event disagrees with members' from sx where nx is null and is_in <> (code in (select code from fx_members))::int""")
def member_conflicts(spark, sf_dir):
    return membership.inconsistent(fx.table(spark, "fx_events"), fx.table(spark, "fx_members"))


def repair_prices(spark, sf_dir):
    """Mended fixture bars, of equal keys the first by their values; tested against hand-made cases."""
    bars = fx.table(spark, "fx_bars")
    order = Window.partitionBy("code", "dt").orderBy(*[F.col(c).asc_nulls_last() for c in bars.columns if c not in ("code", "dt")])
    return panel.repair(bars.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n"))


QUERIES["repair_prices"] = repair_prices


@query("""select url, regexp_extract(url, '^https?://([^/]+)', 1) as host, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, len(regexp_extract_all(html, '<a href="([^"]*)">', 1)) as n_links,
len(list_distinct(regexp_extract_all(html, '<a href="([^"]*)">', 1))) as n_distinct from pages""")
def html_member_extract(spark, sf_dir):
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)">'), F.lit(1))
    return src.read(spark, sf_dir, "pages").select(
        "url", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.size(links).cast("long").alias("n_links"), F.size(F.array_distinct(links)).cast("long").alias("n_distinct"),
    )


@query("""with r as (select c_mktsegment as part, c_custkey as k, c_custkey || '|' || c_name as d from customer),
a as (select part, k // 1000 as k, sha256(string_agg(d, chr(10) order by k)) as d from r group by part, k // 1000), b as (select part, k // 1000 as k, sha256(string_agg(d, '' order by k)) as d from a group by part, k // 1000),
c as (select part, k // 1000 as k, sha256(string_agg(d, '' order by k)) as d from b group by part, k // 1000), h as (select part, sha256(string_agg(d, '' order by k)) as digest from c group by part)
select part, digest, sha256((select string_agg(digest, '' order by part) from h)) as combined from h""")
def sha256_manifest(spark, sf_dir):
    """Digest of each part's rows as a tree over ranges of keys, and of all digests in order of name."""
    customers = src.read(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey", "c_name")
    parts = stores.staged(stores.tree_digest(customers, "c_mktsegment", "c_custkey", F.concat_ws("|", "c_custkey", "c_name")))
    joined = parts.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "digest"))), lambda r: r["digest"]), ""), 256).alias("combined"))
    return parts.crossJoin(F.broadcast(joined))


_SPEC = "split_part(spec, '|', {})"


@query(f"""with {fx.cte('fx_spec')} select {_SPEC.format(1)} as family, substr({_SPEC.format(2)}, 2)::bigint as n, substr({_SPEC.format(3)}, 2)::bigint as k, substr({_SPEC.format(4)}, 3)::double as theta,
try_cast(substr({_SPEC.format(5)}, 2) as double) as gmax, {_SPEC.format(6)} as regime from fx_spec""")
def spec_parse(spark, sf_dir):
    return selection.spec_columns(fx.table(spark, "fx_spec")).drop("spec")
