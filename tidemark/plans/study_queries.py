"""Streams in order, code scans, membership views, pooled correlations, fitted models by fold and overfit measures, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import exprs
from ..functions.exprs import r6
from ..operators import features as ft
from ..operators import labels, membership, metrics, models, panel, ranking, research, selection
from ..sources import bars as src
from ..sources import codes, stores
from ..streaming import maturity, ordered, stream_bars
from .feature_queries import lag, roll
from .panel_queries import ALIGN, CALENDAR, _calendar, aligned
from .research_queries import CAPITAL, FEATURES, FOLDS, NAV, PAIRS, RANKS, WEEK, _folds, lead, nav_series, rounded, week

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
SPAN = "partition by code order by dt"


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


# Streams


def _new_folder(spark) -> str:
    return f"{stores.work_dir(spark)}/{uuid.uuid4().hex}"


@query(f"with {src.NATION_SQL}, {CALENDAR}, {ALIGN}, f as (select code, pos, dt, {lead('dt', 1)} as buy_dt, {lead('dt', 6)} as sell_dt, {lead('open', 6)} / nullif({lead('open', 1)}, 0) - 1 as x from al) select code, pos, dt, buy_dt, sell_dt, round(x, 6) + 0.0 as label from f where sell_dt is not null")
def stream_labels(spark, sf_dir):
    """Labels of five days of a stream of daily opens: those whose sale has come."""
    path = _new_folder(spark)
    df = aligned(spark, sf_dir).select("code", F.col("pos").cast("long").alias("pos"), F.col("dt").cast("timestamp").alias("ts"), "open")
    df.repartitionByRange("ts").sortWithinPartitions("ts").write.parquet(f"{path}/in")
    stream = lambda: maturity.read_prices(spark, f"{path}/in")
    found = stream_bars.available_now(maturity.mature_labels(stream(), stream(), 5), f"{path}/rows", f"{path}/state")
    return found.select("code", "pos", *[F.col(a).cast("date").alias(b) for a, b in (("ts", "dt"), ("buy_ts", "buy_dt"), ("sell_ts", "sell_dt"))], r6("label").alias("label"))


LATE_MS = 3_600_000


@query(f"""with r as (select user_id::varchar as code, event_id as id, ts, value as x, lag(value) over (partition by user_id order by ts, event_id) as before from events),
s as (select *, case when x > before then 0 else 1 end as brk from r), g as (select *, sum(brk) over (partition by code order by ts, id rows unbounded preceding) as run, list(x) over (partition by code order by ts, id rows unbounded preceding) as xs from s),
k as (select *, row_number() over (partition by code, run order by ts, id) - 1 as streak from g)
select code, id, ts, len(xs) as n, round(list_reduce(xs, lambda a, b: 0.9 * a + 0.1 * b), 6) + 0.0 as mean, streak from k where epoch_us(ts) < ((select epoch_us(max(ts)) from events) // 1000 - {LATE_MS}) * 1000""")
def stream_recursions(spark, sf_dir):
    """Recursive means and streaks of each user's values in order of time, for the events that the watermark has passed."""
    path = _new_folder(spark)
    events = src.read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("code"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("x"))
    events.repartition(8).write.parquet(f"{path}/in")  # in no order of time
    rows = spark.readStream.schema(spark.read.parquet(f"{path}/in").schema).parquet(f"{path}/in")
    with ordered.rocksdb(spark):
        found = stream_bars.available_now(ordered.recursions(rows, 0.1, "1 hour"), f"{path}/rows", f"{path}/state")
    return found.select("code", "id", F.col("ts").cast("timestamp_ntz").alias("ts"), "n", r6("mean").alias("mean"), "streak")


# Scans by code


def _grown(df: DataFrame) -> DataFrame:
    return df.select("code", "dt", r6(F.col("close") / exprs.lag("close") - 1).alias("ret"))


_RET = f"round(close / lag(close) over ({SPAN}) - 1, 6) + 0.0 as ret"


@query(f"with {src.WEEKLY_SQL} select code, dt, {_RET} from bars where code in ('1', '3', '8')")
def scan_code_list(spark, sf_dir):
    """Three codes' weekly returns from a table of 16 buckets, of which at most three are read."""
    table = f"bars_{uuid.uuid4().hex}"
    codes.store_buckets(src.supplier_weekly(spark, sf_dir), table, 16)
    rows = stores.staged(_grown(codes.scan_listed(spark, table, ["1", "3", "8"])))
    spark.sql(f"drop table {table}")
    return rows


@query(f"with {src.WEEKLY_SQL} select code, dt, {_RET} from bars where code in (select s_suppkey::varchar from supplier where s_acctbal > 8000)")
def scan_code_join(spark, sf_dir):
    """The weekly returns of the suppliers with a high balance, whose folders alone are read."""
    path = _new_folder(spark)
    codes.store_folders(src.supplier_weekly(spark, sf_dir), path, 64)
    wanted = src.read(spark, sf_dir, "supplier").where("s_acctbal > 8000").select(F.col("s_suppkey").cast("string").alias("code"))
    return _grown(codes.scan_joined(spark.read.parquet(path), wanted, 64))


# Membership: the half of the codes with the most volume of a year are members in the next

MEMBERS = f"""{src.WEEKLY_SQL}, yv as (select code, year(dt) as y, sum(volume) as v from bars group by 1, 2), yr as (select *, row_number() over (partition by y order by v desc, code) as r, count(*) over (partition by y) as n from yv),
mem as (select code, y + 1 as y from yr where 2 * r <= n and y < (select max(y) from yv)), today as (select code from mem where y = (select max(y) from mem)),
wk as (select b.*, volume > 0 as tradable, close * volume as tv, row_number() over ({SPAN}) as listed_days, {lead('open', 6)} / {lead('open', 1)} - 1 as y5, close / {lag('close', 5)} - 1 as ret5 from bars b), wa as (select *, {roll('avg', 'tv', 20)} as adv20, close as close_u from wk),
wm as (select wa.*, mem.code is not null as member from wa left join mem on mem.code = wa.code and mem.y = year(wa.dt))"""
ADV, CLOSE, DAYS = 25_000.0, 1_200.0, 50
_FAILED = f"case when not member then 'member' when not tradable then 'tradable' when not coalesce(adv20 >= {ADV}, false) then 'adv' when not coalesce(close_u >= {CLOSE}, false) then 'close' when listed_days < {DAYS} then 'listed' end"


def _rows(spark, sf_dir) -> DataFrame:
    df = labels.forward_returns(ft.momentum(src.supplier_weekly(spark, sf_dir)), (5,)).withColumnRenamed("L1_5", "y5")
    df = df.withColumns({"tradable": F.col("volume") > 0, "listed_days": F.row_number().over(exprs.by_code()), "tv": F.col("close") * F.col("volume"), "close_u": F.col("close")})
    return df.withColumn("adv20", exprs.rolling(F.avg, "tv", 20)).select("code", "dt", "tradable", "listed_days", "close_u", "adv20", "ret5", "y5")


def _membership(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Change events turned into spans, and today's members."""
    per = src.supplier_weekly(spark, sf_dir).groupBy("code", F.year("dt").alias("y")).agg(F.sum("volume").alias("v"))
    year = Window.partitionBy("y")
    per = per.withColumns({"r": F.row_number().over(year.orderBy(F.desc("v"), "code")), "n": F.count("*").over(year)})
    last = per.agg(F.max("y").alias("last"))
    mem = stores.staged(per.where("2 * r <= n").select("code", (F.col("y") + 1).alias("y")).join(F.broadcast(last), F.col("y") <= F.col("last")).drop("last"))
    w = Window.partitionBy("code").orderBy("y")
    steps = mem.withColumns({"a": F.lag("y").over(w), "b": F.lead("y").over(w)}).join(F.broadcast(mem.agg(F.max("y").alias("last"))))  # one row
    ins = steps.where("a is null or a < y - 1").select(F.make_date("y", F.lit(1), F.lit(1)).alias("dt"), F.lit(None).cast("string").alias("out_code"), F.col("code").alias("in_code"))
    outs = steps.where("y < last and (b is null or b > y + 1)").select(F.make_date(F.col("y") + 1, F.lit(1), F.lit(1)).alias("dt"), F.col("code").alias("out_code"), F.lit(None).cast("string").alias("in_code"))
    today = steps.where("y = last").select("code")
    return membership.intervals(ins.union(outs), today), today


def _universe(df: DataFrame) -> DataFrame:
    return panel.index_universe(df, ADV, CLOSE, DAYS)


@query(f"with {MEMBERS} select code, dt, {_FAILED} as failed, ({_FAILED}) is null as in_univ, member and listed_days < {DAYS} as young from wm")
def index_universe(spark, sf_dir):
    spans, _ = _membership(spark, sf_dir)
    return _universe(membership.members_at(_rows(spark, sf_dir), spans)).select("code", "dt", "failed", "in_univ", "young")


@query(f"""with {MEMBERS}, f as (select *, {_FAILED} as failed from wm) select count(*) filter (member) as member_rows, count(*) filter (failed = 'tradable') as not_tradable, count(*) filter (failed = 'adv') as adv, count(*) filter (failed = 'close') as close,
count(*) filter (failed = 'listed') as listed, count(*) filter (failed is null) as in_univ, count(distinct code) filter (member and listed_days < {DAYS}) as young_codes from f""")
def index_universe_counts(spark, sf_dir):
    spans, _ = _membership(spark, sf_dir)
    return panel.universe_counts(_universe(membership.members_at(_rows(spark, sf_dir), spans)))


def _picks(df: DataFrame) -> DataFrame:
    """The five lowest five-week returns of each week's universe."""
    return research.candidates(_universe(df).where("in_univ").withColumn("score", -F.col("ret5")), 1.0, 5).select("dt", "code")


VIEWS = f"""{MEMBERS}, wn as (select wa.*, wa.code in (select code from today) as member from wa),
cv as (select dt, code, ret5, 'then' as v from wm where {_FAILED} is null union all select dt, code, ret5, 'now' from wn where {_FAILED} is null), pk as (select v, dt, code from cv where ret5 is not null qualify row_number() over (partition by v, dt order by ret5, code) <= 5),
sd as (select dt, code, case when count(*) = 2 then 'both' else any_value(v) end as side from pk group by 1, 2)"""


def _sides(spark, sf_dir) -> DataFrame:
    spans, today = _membership(spark, sf_dir)
    return membership.two_views(_rows(spark, sf_dir), spans, today, _picks, ["dt", "code"])


@query(f"with {VIEWS} select dt, code, side from sd")
def leak_sides(spark, sf_dir):
    """What one plan picks from members as they stood and from today's members."""
    return _sides(spark, sf_dir)


@query(f"""with {VIEWS}, e as (select sd.*, unnest(case when side = 'both' then ['then', 'now'] else [side] end) as view from sd) select view, count(*) as n, count(*) filter (side <> 'both') as n_only, round(avg(y5), 6) + 0.0 as mean from e join wa using (dt, code) group by view""")
def leak_summary(spark, sf_dir):
    out = membership.leak_summary(_sides(spark, sf_dir), _rows(spark, sf_dir), ["dt", "code"], "y5")
    return out.withColumn("mean", r6("mean"))


@query(f"with {VIEWS} select pk.dt, pk.code from pk left join mem on mem.code = pk.code and mem.y = year(pk.dt) where v = 'now' and mem.code is null")
def leak_outsiders(spark, sf_dir):
    """Picks from today's members that were no members on their day."""
    spans, _ = _membership(spark, sf_dir)
    return membership.outsiders(_sides(spark, sf_dir).where("side <> 'then'").select("dt", "code"), spans)


# Pooled correlation and pruning

POOL = 20_000
_HASH = "('0x' || substr(md5('42|' || dt || '|' || code), 1, 15))::bigint"
SAMPLE = f"sa as (select * from wf where (select count(*) from wf) <= {POOL} or {_HASH} < floor({POOL} / (select count(*) from wf)::double * 1152921504606846976::double)::bigint)"


def _pooled(spark, sf_dir) -> DataFrame:
    df = week(spark, sf_dir).select("dt", "code", *[F.col(f).cast("double").alias(f) for f in FEATURES])
    return research.pairwise_corr(research.pooled_sample(df, ["dt", "code"], POOL), FEATURES)


@query(f"with {WEEK}, {SAMPLE} " + " union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a}::double, {b}::double), 6) + 0.0 as r from sa" for a, b in PAIRS))
def pooled_corr(spark, sf_dir):
    return rounded(_pooled(spark, sf_dir), ["a", "b"], ["r"])


_FEATURE_ROWS = " union all ".join(f"select '{f}' as feature, avg({f}::double) / stddev_samp({f}::double) as ir from wf" for f in FEATURES)
_MOST = 0.6


@query(f"with {WEEK}, {SAMPLE}, cr as (" + " union all ".join(f"select '{x}|{y}' as k, corr({a}::double, {b}::double) as r from sa" for a, b in PAIRS for x, y in ((a, b), (b, a))) + f"""),
ft as ({_FEATURE_ROWS}), od as (select *, row_number() over (order by abs(ir) desc, feature) as place from ft), hi as (select list(k) as ks from cr where abs(r) > {_MOST}),
kp as (select list_reduce(list([feature] order by place), lambda acc, x: case when len(list_filter(acc, lambda f: list_contains(ks, f || '|' || x[1]))) = 0 then list_concat(acc, x) else acc end) as kept from od, hi group by ks)
select feature, round(ir, 6) + 0.0 as ir, place, list_contains(kept, feature) as kept from od, kp""")
def feature_pruning(spark, sf_dir):
    """Features in order of their mean over their deviation, without those that correlate with one kept before."""
    df = week(spark, sf_dir)
    names = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in FEATURES])
    ir = df.select(F.explode(names).alias("r")).select("r.*").groupBy("feature").agg((F.avg("x") / F.stddev_samp("x")).alias("ir"))
    return research.pruned(ir, _pooled(spark, sf_dir), _MOST).withColumn("ir", r6("ir"))


# Models by fold


def _training(spark, sf_dir) -> tuple[DataFrame, list]:
    """The rows of all weeks with ranks, market columns and labels, and every fold that has training days."""
    market = ft.market(src.index_series(src.nation_daily(spark, sf_dir))).select("dt", "mk_above200", "mk_vol20")
    df = week(spark, sf_dir).join(F.broadcast(market), "dt", "left")  # market: a row for each day
    df = models.prepared(df, RANKS).withColumn("up", (F.col("y") > 0.008).cast("double"))
    df = stores.staged(df.select("dt", "code", "x", "y", "up", "mk_above200", "mk_vol20", *RANKS))
    return df, [r.asDict() for r in _folds(spark, sf_dir)[0].where("train_end is not null").orderBy("fold").collect()]


MOST_ROUNDS, DEPTH = 20, 2


def _stopped(spark, sf_dir, label: str, classify: bool) -> tuple[DataFrame, DataFrame]:
    df, folds = _training(spark, sf_dir)
    return models.fold_fits(df, folds, label, lambda t, y: models.stopped(models.daily_sample(t, 300, 42), y, RANKS, 5, classify, DEPTH, MOST_ROUNDS))


@query()
def m4_regression(spark, sf_dir):
    """Trees of every fold, stopped by the last fifth of its training days, with the rounds kept."""
    return _stopped(spark, sf_dir, "y", False)[0]


@query()
def m4_classification(spark, sf_dir):
    return _stopped(spark, sf_dir, "up", True)[0]


@query()
def m4_importance(spark, sf_dir):
    """Importances of each fold's trees, and how they rank against the fold before."""
    rows = _stopped(spark, sf_dir, "y", False)[1]
    return rows.join(models.top_stability(rows, 2), "fold", "left")


@query()
def m5_ranking(spark, sf_dir):
    """Scores of every fold by three rounds of ranking trees."""
    df, folds = _training(spark, sf_dir)
    return models.walk_forward(df, folds, "y", lambda t, y: ranking.fit(models.daily_sample(t, 300, 42), RANKS, y, rounds=3, depth=DEPTH, bins=16).score)


@query()
def m3_tuned(spark, sf_dir):
    """Logistic scores with scaled market columns; the penalty is chosen within the first fold's training days."""
    df, folds = _training(spark, sf_dir)
    if not folds:
        return spark.createDataFrame([], "dt date, code string, fold long, score double, c double")
    first = df.where((F.col("dt") <= F.lit(folds[0]["train_end"])) & F.col("y").isNotNull())
    scaled = df.withColumns(models.standardised(first, ["mk_above200", "mk_vol20"]))
    scaled = models.prepared(scaled.drop("x"), RANKS, ["mk_above200", "mk_vol20"]).select("dt", "code", "x", "y", "up")
    c, _ = models.choose_penalty(scaled.where(F.col("dt") <= F.lit(folds[0]["train_end"])).where("y is not null"), "up", "y", 5)
    out = models.walk_forward(scaled, folds, "up", lambda t, y: models.logistic(t, y, c))
    return out.withColumn("c", F.lit(c))


@query()
def m7_regimes(spark, sf_dir):
    """The last fold's scores by models of each market regime, the mean of two seeds; no rows where a regime is too rare."""
    df, folds = _training(spark, sf_dir)
    empty = spark.createDataFrame([], "dt date, code string, fold long, scheme string, score double")
    if not folds:
        return empty
    f = folds[-1]
    train = df.where((F.col("dt") <= F.lit(f["train_end"])) & F.col("y").isNotNull())
    seeds = models.seed_mean(lambda t, y, s: models.boosted(models.daily_sample(t, 300, s), y, depth=2, rounds=2, seed=s), [1, 2])
    found = models.regime_split(train, "y", seeds)
    if not found:
        return empty
    part = found[1](df.where(F.col("dt").between(F.lit(f["val_start"]), F.lit(f["val_end"]))))
    return part.select("dt", "code", F.lit(f["fold"]).cast("long").alias("fold"), F.lit(found[0]).alias("scheme"), F.col("pred").alias("score"))


_RULE = [([a], q) for a in RANKS for q in (0.1, 0.3)] + [([f"r_{a}", f"r_{b}"], q) for a, b in PAIRS for q in (0.1, 0.3)]


@query(f"with {WEEK}, {src.NATION_SQL.replace('px as', 'npx as').replace('bars as', 'nbars as').replace('from px', 'from npx')}, {FOLDS.replace('from bars', 'from nbars')}, ru as (" + " union all ".join(f"select ft.fold, '{'+'.join(c)}' as rule, {len(c)} as size, {q}::double as share, wr.dt, avg(y) as m, count(*) as k from wr join ft on wr.dt <= ft.train_end where y is not null and {' and '.join(f'{x}::double > {1 - q}' for x in c)} group by ft.fold, wr.dt" for c, q in _RULE)
       + ") select fold, rule, share, sum(k)::bigint as n, round(avg(m), 6) + 0.0 as value from ru group by fold, rule, size, share having sum(k) >= 100 qualify row_number() over (partition by fold order by round(avg(m), 12) desc, size, rule, share) = 1")
def m1_best_rules(spark, sf_dir):
    df = week(spark, sf_dir).select("dt", "y", *[F.col(r).cast("double").alias(r) for r in RANKS])
    best = research.best_rules(df, _folds(spark, sf_dir)[0].where("train_end is not null"), RANKS, "y", (0.1, 0.3), (1, 2), 100)
    return best.select(F.col("fold").cast("long").alias("fold"), "rule", "share", "n", r6("value").alias("value"))


# Overfit measures and dates


@query(f"""with {NAV}, {FOLDS}, s1 as (select fold, avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252) as s from ret join ft on dt <= train_end where series = 'ASIA' group by fold), s2 as (select avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252) as w from ret join ft on dt between val_start and val_end where series = 'ASIA'),
m as (select median(s) as median from s1) select round(median, 6) + 0.0 as median, round(w, 6) + 0.0 as walk, round(case when median > 0 then w / median end, 6) + 0.0 as ratio, coalesce(median <= 0 or (median > 0 and w / median >= 0.5), false) as ok from m, s2""")
def train_walk_ratio(spark, sf_dir):
    r = metrics.daily_returns(nav_series(spark, sf_dir), ["series"], CAPITAL).where("series = 'ASIA'").select("dt", "ret")
    folds = F.broadcast(_folds(spark, sf_dir)[0])  # a row for each fold
    own = r.join(folds, r["dt"] <= folds["train_end"]).groupBy("fold").agg(metrics.sharpe().alias("sharpe"))
    walk = r.join(folds, r["dt"].between(folds["val_start"], folds["val_end"])).agg(metrics.sharpe().alias("sharpe"))
    return rounded(research.train_against_walk(own, walk), ["ok"], ["median", "walk", "ratio"])


@query(f"with {NAV}, s as (select series, avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252) as x from ret group by series), c as (select stddev_samp(x) / nullif(abs(avg(x)), 0) as cv from s) select round(cv, 6) + 0.0 as cv, coalesce(cv <= 0.3, false) as ok from c")
def seed_spread(spark, sf_dir):
    r = metrics.daily_returns(nav_series(spark, sf_dir), ["series"], CAPITAL)
    return rounded(research.seed_spread(r.groupBy("series").agg(metrics.sharpe().alias("sharpe"))), ["ok"], ["cv"])


@query("""select s_suppkey, round((select 100.0::double * avg((c_acctbal < s_acctbal)::int) from customer where c_nationkey = s_nationkey), 6) + 0.0 as percentile from supplier""")
def percentile_rank(spark, sf_dir):
    """Where each supplier's balance stands among the customers' of its nation."""
    own = src.read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("k"), F.col("s_acctbal").alias("value"))
    others = src.read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("value"))
    return rounded(research.percentile_of(own, others, ["k"]), ["s_suppkey"], ["percentile"])


@query(f"with {src.NATION_SQL}, {CALENDAR} select min(dt) as holdout_start from cal where dt >= (select (max(dt) - interval 24 month)::date from cal)")
def holdout_boundary(spark, sf_dir):
    return labels.holdout_start(_calendar(spark, src.nation_daily(spark, sf_dir)), 24)


@query(f"""with {src.NATION_SQL}, {CALENDAR}, d as (select o_orderkey, o_orderdate::date as dt, (select max(pos) from cal where cal.dt <= o_orderdate::date) as p, o_orderdate::date in (select dt from cal) as open from orders)
select o_orderkey, d.dt, a.dt as after, b.dt as before from d left join cal a on a.pos = p + 3 left join cal b on b.pos = p - 2 + (not open)::int where d.dt is not null""")
def business_days_added(spark, sf_dir):
    """Three business days behind each order and two before it."""
    calendar = _calendar(spark, src.nation_daily(spark, sf_dir))
    df = src.read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("dt")).where("dt is not null")
    return panel.add_business_days(panel.add_business_days(df, calendar, 3, out="after"), calendar, -2, out="before")


@query(f"with {src.NATION_SQL}, {CALENDAR}, {ALIGN} select code, dt, round(coalesce(first_value(open ignore nulls) over ({SPAN} rows between current row and unbounded following), last_value(open ignore nulls) over ({SPAN} rows unbounded preceding)), 6) + 0.0 as open from al")
def back_fill(spark, sf_dir):
    return panel.filled(aligned(spark, sf_dir).select("code", "dt", "open"), "open", "full").select("code", "dt", r6("full").alias("open"))


_LINKS = '<li[^>]*><a href="/([^"]*)">([^§]*?)</li>'


@query(rf"""with p as (select page_id, unnest(regexp_extract_all(html, '{_LINKS}', 1)) as code, unnest(regexp_extract_all(html, '{_LINKS}', 2)) as name from pages) select page_id, code, trim(regexp_replace(name, '<[^>]*>', '', 'g')) as name from p""")
def cell_pairs(spark, sf_dir):
    """Pairs of a link's path and its text, tags taken out."""
    df = src.read(spark, sf_dir, "pages").select("page_id", F.explode(exprs.cell_pairs("html", _LINKS)).alias("p"))
    return df.select("page_id", "p.*")


@query(f"""with {NAV}, s as (select series, max_by(nav, dt) / {CAPITAL} as g, count(*) as n, avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252) as sharpe from ret group by series), m as (select series, pow(g, 252.0::double / n) - 1 as cagr, sharpe, avg(sharpe) over () as b7, max(sharpe) filter (series = 'AFRICA') over () as b2 from s)
select series, cagr > 0 as pass_cagr, sharpe >= 0.4 * 0.5 as pass_sharpe, sharpe > b2 as pass_b2, sharpe > b7 as pass_b7, cagr > 0 and sharpe >= 0.4 * 0.5 and sharpe > b2 and sharpe > b7 as passed from m""")
def holdout_against_baselines(spark, sf_dir):
    """Each region's series against one of them held and against their mean."""
    s = metrics.summary(metrics.daily_returns(nav_series(spark, sf_dir), ["series"], CAPITAL), ["series"], CAPITAL)
    base = s.agg(F.avg("sharpe").alias("b7"), F.max(F.when(F.col("series") == "AFRICA", F.col("sharpe"))).alias("b2"))
    return selection.holdout_verdict(s.join(F.broadcast(base)), 0.5, beats=("b2", "b7")).select("series", "pass_cagr", "pass_sharpe", "pass_b2", "pass_b7", "passed")  # one row of baselines
