"""Membership views, universes, dates, fills, rules and the normal distribution on small planted tables."""

import datetime as dt
import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions import exprs
from tidemark.functions.normal import cdf, ppf
from tidemark.operators import labels, membership, metrics, panel, research, selection

DAY = dt.date(2020, 1, 1)
day = lambda i: DAY + dt.timedelta(days=i)


def test_normal_columns_keep_their_error(spark):
    xs = [-40.0, -9.0, -7.5, -3.1, -1.0, -1e-9, 0.0, 0.3, 2.0, 7.0, 8.5, 38.0]
    ps = [1e-12, 1e-4, 0.02, 0.02425, 0.3, 0.5, 0.77, 0.97575, 0.98, 0.9999]
    n = NormalDist()
    for r in spark.createDataFrame([(x,) for x in xs], "x double").withColumn("p", cdf("x")).collect():
        assert math.isclose(r.p, n.cdf(r.x), rel_tol=1e-9, abs_tol=1e-14) if abs(r.x) < 8 else abs(r.p - n.cdf(r.x)) < 1e-14
    for r in spark.createDataFrame([(p,) for p in ps], "p double").withColumn("x", ppf("p")).collect():
        assert math.isclose(r.x, n.inv_cdf(r.p), rel_tol=1.2e-9, abs_tol=1.2e-9)
    odd = spark.createDataFrame([(None,), (0.0,), (1.0,), (2.0,)], "x double")
    assert [r.v for r in odd.withColumn("v", ppf("x")).collect()] == [None] * 4 and odd.select(cdf("x")).first()[0] is None


def test_deflated_ratios_equal_the_plain_formula(spark):
    rng = np.random.default_rng(1)
    rows = [(s, float(x)) for s in "abc" for x in rng.normal(0.01 * (ord(s) - 96), 1, 200)] + [("flat", 1.0), ("flat", 1.0), ("one", 2.0)]
    df = spark.createDataFrame(rows, "series string, ret double")
    got = {r.series: r for r in metrics.deflated(df, ["series"]).collect()}
    stats = {s: df.where(F.col("series") == s).agg(F.avg("ret") / F.stddev_samp("ret"), F.skewness("ret"), F.kurtosis("ret") + 3).first() for s in "abc"}
    for s in "abc":
        want = metrics.deflated_sharpe(stats[s][0], 200, stats[s][1], stats[s][2], [stats[x][0] for x in "abc"])
        assert math.isclose(got[s].dsr, want, rel_tol=1e-8)
    assert set(got) == set("abc") and metrics.deflated(df.where("series = 'a'"), ["series"]).first().dsr is None


def test_resampling_draws_blocks_with_replacement(spark):
    rows = [("s", b, float(b), 2.0) for b in range(9)] + [("t", 0, 5.0, 1.0)]
    df = spark.createDataFrame(rows, "series string, block int, total double, n double")
    means = [r["mean"] for r in metrics.resampled(df, ["series"], 400).where("series = 's'").collect()]
    assert len(means) == 400 and abs(np.mean(means) - 2.0) < 0.1 and len(set(means)) > 20
    got = {r.series: (r.low, r.high) for r in metrics.bootstrap_ci(df.repartition(5), ["series"], 400).collect()}
    assert got["t"] == (5.0, 5.0) and np.allclose(got["s"], np.percentile(means, [2.5, 97.5])) and metrics.bootstrap_ci(df.where("false"), ["series"]).count() == 0
    r = lambda x, n: spark.createDataFrame([(day(i), x) for i in range(n)], "dt date, ret double")
    assert tuple(round(v, 9) for v in selection.difference_ci(r(0.02, 60), r(0.01, 60)).first()) == (0.01, 0.01) and tuple(selection.difference_ci(r(0.02, 30), r(0.01, 30)).first()) == (None, None)


def test_two_views_show_a_planted_leak_and_none_for_members_of_the_day(spark):
    rows = spark.createDataFrame([(day(i), c, float(i)) for i in range(10) for c in ("old", "new", "always")], "dt date, code string, y double")
    events = spark.createDataFrame([(day(5), "old", "new")], "dt date, out_code string, in_code string")
    today = spark.createDataFrame([("new",), ("always",)], "code string")
    spans = membership.intervals(events, today)
    plan = lambda df: df.where("member").select("dt", "code")
    sides = membership.two_views(rows, spans, today, plan, ["dt", "code"])
    got = {(r.dt, r.code): r.side for r in sides.collect()}
    assert len(got) == 25 and all(got[day(i), "old"] == "then" and got[day(i), "new"] == "now" for i in range(5)) and all(got[day(i), "new"] == "both" for i in range(5, 10))
    leaked = membership.outsiders(sides.where("side <> 'then'").select("dt", "code"), spans).collect()
    assert {(r.dt, r.code) for r in leaked} == {(day(i), "new") for i in range(5)}
    assert membership.outsiders(plan(membership.members_at(rows, spans)), spans).count() == 0
    s = {r.view: (r.n, r.n_only, r["mean"]) for r in membership.leak_summary(sides, rows, ["dt", "code"], "y").collect()}
    assert s == {"then": (20, 5, 4.5), "now": (20, 5, 4.5)} and membership.two_views(rows.where("false"), spans, today, plan, ["dt", "code"]).count() == 0
    nothing = spark.createDataFrame([], events.schema)
    assert membership.intervals(nothing, today).count() == 2 and membership.intervals(nothing, today.where("false")).count() == 0


def test_membership_events_with_literal_sides(spark):
    """Events put together from a table of ins and one of outs, each with a null literal for the other side."""
    base = spark.createDataFrame([("a", 1996), ("a", 1998)], "code string, y int")
    ins = base.select(F.make_date("y", F.lit(1), F.lit(1)).alias("dt"), F.lit(None).cast("string").alias("out_code"), F.col("code").alias("in_code"))
    outs = base.select(F.make_date(F.col("y") + 1, F.lit(1), F.lit(1)).alias("dt"), F.col("code").alias("out_code"), F.lit(None).cast("string").alias("in_code"))
    got = sorted((r.in_dt.year, r.out_dt.year) for r in membership.intervals(ins.union(outs), base.select("code").where("false")).collect())
    assert got == [(1996, 1997), (1998, 1999)]


def test_index_universe_counts_in_order(spark):
    cols = "code string, member boolean, tradable boolean, adv20 double, close_u double, listed_days int"
    rows = [("a", True, True, 9.0, 9.0, 9), ("b", False, True, 9.0, 9.0, 9), ("c", True, False, None, 9.0, 1), ("d", True, True, 1.0, 1.0, 1), ("e", True, True, 9.0, 1.0, 9), ("f", True, True, 9.0, 9.0, 1), ("g", None, True, 9.0, 9.0, 9)]
    df = panel.index_universe(spark.createDataFrame(rows, cols), 5.0, 5.0, 5)
    assert {r.code: r.failed for r in df.collect()} == {"a": None, "b": "member", "c": "tradable", "d": "adv", "e": "close", "f": "listed", "g": "member"}
    assert tuple(panel.universe_counts(df).first()) == (5, 1, 1, 1, 1, 1, 3) and tuple(panel.universe_counts(df.where("false")).first()) == (0,) * 7


def test_dates_fills_and_index_rows(spark):
    weekdays = [day(i) for i in range(30) if day(i).weekday() < 5]
    calendar = spark.createDataFrame([(d, i) for i, d in enumerate(weekdays)], "dt date, pos int")
    probe = spark.createDataFrame([(day(i),) for i in range(-2, 32)], "dt date")
    for n in (2, -2, 0):
        for r in panel.add_business_days(probe, calendar, n).collect():
            at = [i for i, d in enumerate(weekdays) if d <= r.dt]
            want = None
            if at and r.dt <= weekdays[-1]:
                place = at[-1] + n + (n < 0 and weekdays[at[-1]] != r.dt)
                want = weekdays[place] if 0 <= place < len(weekdays) else None
            assert r.then == want, (n, r)
    assert labels.holdout_start(calendar, 0).first()[0] == weekdays[-1] and labels.holdout_start(calendar, 12).first()[0] == weekdays[0] and labels.holdout_start(calendar.where("false"), 1).first()[0] is None
    df = spark.createDataFrame([("a", day(i), x) for i, x in enumerate([None, 2.0, None, 4.0, None])] + [("b", day(0), None)], "code string, dt date, x double")
    assert [r.y for r in panel.filled(df, "x", "y").orderBy("code", "dt").collect()] == [2.0, 2.0, 4.0, 4.0, 4.0, None]
    rows = spark.createDataFrame([("IDX_A", 1.0, False), ("IDX_A", None, True), ("B", None, True)], "code string, own_close double, tradable boolean")
    assert [r.tradable for r in panel.index_tradable(rows).collect()] == [True, False, True]


def test_cells_of_code_and_name(spark):
    page = "<table><tr><td class=x> 285A </td>\n<td><a href='q'>Big <b>Corp</b></a> </td></tr><tr><td>7203</td><td>Car\nMaker</td></tr><tr><td>abc</td><td>no</td></tr></table>"
    df = spark.createDataFrame([(page,), ("",), (None,)], "html string")
    got = [r.p for r in df.select(exprs.cell_pairs("html").alias("p")).collect()]
    assert [(c.code, c.name) for c in got[0]] == [("285A", "Big Corp"), ("7203", "Car\nMaker")] and got[1] == [] and got[2] is None


def test_best_rules_by_fold(spark):
    rows = [(day(d), f"c{k}", (k + 1) / 20, ((k * 7 + d) % 20 + 1) / 20, float(k >= 18) if d < 20 else -float(k >= 18)) for d in range(40) for k in range(20)]
    df = spark.createDataFrame(rows, "dt date, code string, r_a double, r_b double, y double")
    folds = spark.createDataFrame([(0, day(19)), (1, day(39)), (2, day(-1))], "fold int, train_end date")
    got = {r.fold: (r.rule, r["share"], r.n) for r in research.best_rules(df, folds, ["r_a", "r_b"], "y", (0.1, 0.3), (1, 2), 20).collect()}
    assert got[0] == ("r_a", 0.1, 40) and set(got) == {0, 1}
    scored = research.apply_rules(df.withColumn("fold", F.lit(0)), research.best_rules(df, folds, ["r_a", "r_b"], "y", (0.1, 0.3), (1, 2), 20), ["r_a", "r_b"])
    assert {r.code for r in scored.where("score is not null").select("code").distinct().collect()} == {"c18", "c19"} and scored.where("score <> r_a").count() == 0
    assert research.apply_rules(df.withColumn("fold", F.lit(9)), research.best_rules(df, folds, ["r_a"], "y"), ["r_a"]).where("score is not null").count() == 0


def test_verdict_against_baselines(spark):
    df = spark.createDataFrame([(0.1, 1.0, 0.9), (0.1, 1.0, 1.0), (0.1, 1.0, None)], "cagr double, sharpe double, b7 double")
    assert [r.passed for r in selection.holdout_verdict(df, 1.0, beats=("b7",)).collect()] == [True, False, False] and selection.holdout_verdict(df, 1.0).where("passed").count() == 3
