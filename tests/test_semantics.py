"""Semantics against pandas, NumPy and hand-made cases."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import plain_simulation as plain
from tidemark.functions import exprs
from tidemark.operators import features, membership, metrics, models, panel, research, simulate
from tidemark.sources import fixtures
from tidemark.streaming import stream_bars

DAY = dt.date(2020, 1, 1)


def bars_frame(n=320, codes=("A", "B", "C"), seed=0):
    rng, out = np.random.default_rng(seed), []
    for code in codes:
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        open_ = close * (1 + rng.normal(0, 0.01, n))
        high, low = np.maximum(open_, close) * 1.01, np.minimum(open_, close) * 0.99
        flat = rng.random(n) < 0.05
        high[flat] = low[flat] = open_[flat] = close[flat]
        out += [(DAY + dt.timedelta(days=i), code, "s" + code, float(open_[i]), float(high[i]), float(low[i]), float(close[i]), float(rng.integers(0, 1000))) for i in range(n)]
    return pd.DataFrame(out, columns=["dt", "code", "sector", "open", "high", "low", "close", "volume"])


SCHEMA = "dt date, code string, sector string, open double, high double, low double, close double, volume double"


@pytest.fixture(scope="module")
def bars(spark):
    pdf = bars_frame()
    return pdf, spark.createDataFrame(pdf, SCHEMA).cache()


def all_features(df):
    for f in (features.moving_averages, features.ema_deviation, features.cross_days, features.rsi, features.macd, features.stochastic, features.average_range, features.bollinger, features.volatility,
              features.volume_ratios, features.on_balance, features.money_flow, features.momentum, features.extremes, features.new_extremes, features.streaks, features.pullback, features.candle_shape, features.candle_patterns):
        df = f(df)
    return df


def test_features_match_pandas(bars):
    pdf, df = bars
    got = all_features(df).toPandas().sort_values(["code", "dt"])
    for code, g in pdf.groupby("code"):
        mine = got[got.code == code].reset_index(drop=True)
        c, h, low, v = (g[x].reset_index(drop=True) for x in ("close", "high", "low", "volume"))
        d = c.diff()
        want = {
            "sma_dev_25": c / c.rolling(25).mean() - 1, "ema_dev_25": c / c.ewm(span=25, adjust=False, min_periods=25).mean() - 1, "ret20": c / c.shift(20) - 1, "dist_hi_60": c / h.rolling(60).max() - 1,
            "rsi14": 100 - 100 / (1 + d.clip(lower=0).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean() / ((-d).clip(lower=0).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean() + 1e-12)),
            "hv20": np.log(c / c.shift(1)).rolling(20).std() * np.sqrt(252), "bb_bw": 4 * c.rolling(20).std(ddof=0) / c.rolling(20).mean(), "vr5": v / (v.rolling(5).mean() + 1e-12),
            "atr14p": pd.concat([h - low, (h - c.shift(1)).abs(), (low - c.shift(1)).abs()], axis=1).max(axis=1).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean() / c,
        }
        for name, x in want.items():
            np.testing.assert_allclose(mine[name].astype(float), x, rtol=1e-9, atol=1e-12, err_msg=name)
        run, streak = 0, []
        for x in d:
            run = run + 1 if x > 0 else 0
            streak.append(run)
        assert mine["up_streak"].tolist() == streak


def test_no_feature_looks_ahead(bars):
    """On a series cut at a date every feature of that date is the same."""
    _, df = bars
    whole = {(r.code, r.dt): r.asDict() for r in all_features(df).collect()}
    for cut in (DAY + dt.timedelta(days=k) for k in (90, 260)):
        for r in all_features(df.where(F.col("dt") <= F.lit(cut))).where(F.col("dt") == F.lit(cut)).collect():
            assert r.asDict() == whole[r.code, r.dt]


def test_pct_rank_and_runs(spark):
    x = [3.0, 1.0, None, 3.0, 2.0, None, 3.0]
    df = spark.createDataFrame([(i, "d", v) for i, v in enumerate(x)], "i int, day string, x double")
    got = [r.p for r in df.withColumn("p", exprs.pct_rank("x", ["day"])).orderBy("i").collect()]
    want = pd.Series(x, dtype=float).rank(pct=True)
    assert got == [None if math.isnan(w) else w for w in want]
    sign = [None, 1.0, 1.0, 0.0, 1.0, -1.0, -1.0, -1.0, 1.0]
    df = spark.createDataFrame([(DAY + dt.timedelta(days=i), "A", s) for i, s in enumerate(sign)], "dt date, code string, s double")
    got = [r.o for r in exprs.since_sign_change(df, "s", "o", cap=1).orderBy("dt").collect()]
    assert got == [None, 0.0, 1.0, None, 0.0, 0.0, -1.0, -1.0, 0.0]


def test_repair_spikes_and_missed_splits(spark):
    cols = "code string, dt date, open double, high double, low double, close double, volume double, dividend double, split double"
    def series(code, closes):
        return [(code, DAY + dt.timedelta(days=i), c, c, c, c, 100.0, 0.0, 0.0) for i, c in enumerate(closes)]

    rows = series("spike", [1000.0, 1010.0, 9000.0, 1005.0]) + series("split", [1000.0, 1000.0, 100.0, 101.0, 99.0, 100.0]) + series("calm", [100.0, 101.0])
    got = panel.repair(spark.createDataFrame(rows, cols)).orderBy("code", "dt").collect()
    by = lambda c, f: [r[f] for r in got if r.code == c]
    assert by("spike", "close") == [1000.0, 1010.0, None, 1005.0] and by("calm", "close") == [100.0, 101.0]
    assert by("split", "close") == [100.0, 100.0, 100.0, 101.0, 99.0, 100.0] and by("split", "split")[2] == 10.0 and by("split", "volume")[:3] == [1000.0, 1000.0, 100.0]


def test_repair_measures_prices_as_they_stood(spark):
    """Limits hold for prices before later splits; ratios off the list are applied as they are; index codes stay."""
    cols = "code string, dt date, open double, high double, low double, close double, volume double, dividend double, split double"
    def series(code, closes, splits=None):
        return [(code, DAY + dt.timedelta(days=i), c, c, c, c, 100.0, 1.0, (splits or {}).get(i, 0.0)) for i, c in enumerate(closes)]

    rows = series("factor", [100.0, 190.0, 190.0, 190.0, 190.0, 190.0], {5: 10.0})  # 1000 to 1900 as they stood: more than twice 300
    rows += series("plain", [100.0, 150.0, 150.0]) + series("six", [6000.0, 1000.0, 1000.0, 1000.0, 1000.0]) + series("up", [100.0] + [1000.0] * 4)
    rows += series("listed", [4000.0, 1000.0, 1000.0, 1000.0, 1000.0], {1: 4.1}) + series("IDX_A", [100.0, 9000.0, 9000.0, 9000.0, 9000.0]) + [("open", DAY, *[1000.0] * 4, 1.0, 0.0, 0.0), ("open", DAY + dt.timedelta(days=1), 2000.0, *[1000.0] * 3, 1.0, 0.0, 0.0)]
    got = panel.repair(spark.createDataFrame(rows, cols)).orderBy("code", "dt").collect()
    by = lambda c, f: [r[f] for r in got if r.code == c]
    assert [round(x, 9) for x in by("factor", "close")] == [190.0] * 6 and abs(by("factor", "split")[1] - 100 / 190) < 1e-12
    assert by("plain", "close") == [100.0, 150.0, 150.0]
    assert by("six", "close") == [1000.0] * 5 and by("six", "split")[1] == 6.0 and by("six", "dividend")[0] == 1 / 6 and by("six", "volume")[0] == 600.0
    assert [round(x, 9) for x in by("up", "close")] == [1000.0] * 5 and by("up", "split")[1] == 0.1
    assert by("listed", "split")[1] == 4.1 and by("listed", "close")[0] == 1000.0
    assert by("IDX_A", "close") == [100.0] + [9000.0] * 4 and by("IDX_A", "open")[1] == 9000.0
    assert by("open", "open") == [1000.0, None]
    assert panel.nice_ratio(5.9) == 5.9 and panel.nice_ratio(4.9) == 5.0 and panel.nice_ratio(1 / 4.9) == 0.2


def test_recursive_means_over_nulls(spark):
    xs = [None, 1.0, 2.0, None, None, 5.0, float("nan"), 4.0, 4.0]
    df = spark.createDataFrame([("a", DAY + dt.timedelta(days=i), x, i) for i, x in enumerate(xs)] + [("b", DAY, None, 0)], "code string, dt date, x double, extra int").repartition(3)
    got = exprs.ewm(df, {"y": ("x", 0.3, 2)}).orderBy("code", "dt").collect()
    want = pd.Series(xs, dtype=float).ewm(alpha=0.3, adjust=False, min_periods=2).mean()
    assert all((pd.isna(w) and r.y is None) or math.isclose(r.y, w, rel_tol=1e-12) for r, w in zip(got, want)) and got[-1].y is None and len(got) == len(xs) + 1
    assert exprs.ewm(df.where("false"), {"y": ("x", 0.3, 2)}).count() == 0


def test_blocks_of_uneven_length(spark):
    """Ten days in four blocks begin at days 0, 2, 5 and 7."""
    days = spark.range(10).select(F.col("id").alias("pos"))
    got = [r.b for r in days.select(F.expr("((pos + 1) * 4 - 1) div 10").alias("b")).collect()]
    assert got == [0, 0, 1, 1, 1, 2, 2, 3, 3, 3]


def test_interval_replay_reaches_todays_members(spark):
    events, members = fixtures.table(spark, "fx_events"), fixtures.table(spark, "fx_members")
    spans = membership.intervals(events, members)
    later = spark.createDataFrame([(c, dt.date(2021, 1, 1)) for c in "ABCDEFGH"], "code string, dt date")
    assert {r.code for r in membership.members_at(later, spans).where("member").collect()} == {r.code for r in members.collect()}
    assert membership.inconsistent(events, members).count() == 0


def test_newey_west_and_spearman(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0.1, 1, 80)
    df = spark.createDataFrame([(DAY + dt.timedelta(days=i), "f", float(v)) for i, v in enumerate(x)], "dt date, feature string, ic double")
    e, n, lags = x - x.mean(), len(x), 4
    var = (e @ e + sum(2 * (1 - k / (lags + 1)) * (e[k:] @ e[:-k]) for k in range(1, lags + 1))) / n
    assert math.isclose(research.newey_west(df, "ic", lags, ["feature"]).first().t, x.mean() / math.sqrt(var / n), rel_tol=1e-9)
    y = rng.normal(size=60).round(1)
    z = (y + rng.normal(size=60)).round(1)
    df = spark.createDataFrame([(DAY, float(a), float(b)) for a, b in zip(y, z)], "dt date, a double, y double")
    want = np.corrcoef(pd.Series(y).rank(), pd.Series(z).rank())[0, 1]
    assert math.isclose(research.daily_ic(df, ["a"], "y").first().ic, want, rel_tol=1e-9)


def test_prune_and_theta():
    assert research.prune(["a", "b", "c"], {("a", "b"): 0.95, ("b", "c"): 0.99, ("a", "c"): 0.1}) == ["a", "c"]


def test_candidates_rules(spark):
    rows = [(DAY, c, s, p) for c, s, p in (("A", 1.0, 0.9), ("B", 1.0, 0.2), ("C", None, 0.9), ("D", 0.5, 0.9))]
    df = spark.createDataFrame(rows, "dt date, code string, score double, pred double")
    pick = lambda **k: [r.code for r in research.candidates(df, **k).orderBy("slot").collect()]
    assert pick(theta=0.5, top=9) == ["A", "B"] and pick(theta=0.01, top=9) == ["A"] and pick(theta=1.0, top=2) == ["A", "B"]
    assert pick(theta=1.0, top=9, pred_above=0.5) == ["A", "D"]
    off = spark.createDataFrame([(DAY, False)], "dt date, ok boolean")
    assert pick(theta=1.0, top=9, regime=off) == []


def hand_panel(spark, n=6):
    rows = []
    for i in range(n):
        d = DAY + dt.timedelta(days=i)
        rows += [(d, "A", 10.0 + i, 10.0 + i, 10.0 + i, True, False, i == 3, 0.1 if i == 2 else 0.0, 1e9), (d, "B", 20.0, 20.0, 20.0, i != 1, False, False, 0.0, 1e9), (d, "C", 5.0, 5.0, 5.0, i < 3, i == 1, False, 0.0, 1e9)]
    return spark.createDataFrame(rows, "dt date, code string, open double, close double, open_u double, tradable boolean, stop_high boolean, stop_low boolean, dividend double, adv20 double")


def test_simulator_branches(spark):
    p = plain.pack(hand_panel(spark))
    free = plain.Trial(hold=2, slots=2, fee=0.0, cost=0.0, capital=20_000.0)
    a, b, c = 0, 1, 2
    nav, invested, done, fails = plain.run(p, {0: [b, c, a], 1: [a]}, free)
    assert fails == {"halt": 1, "stop_high": 1, "gap": 0, "lot": 0} and nav[1] == 20_000 and invested[1] == 0  # both slots were lost
    # day 2 buys A at 12: 5,000 a slot gives 4 lots; limit-down on day 3; sold on day 4 at 14
    assert [(t["code"], t["buy_pos"], t["cost"], round(t["ret"], 9)) for t in done] == [("A", 2, 4800.0, round(14 / 12 - 1, 9))]
    assert nav[-1] == 20_000 + 400 * 2
    nav, _, done, _ = plain.run(p, {0: [a]}, free)  # bought on day 1 at 11, dividend 0.1 on day 2, due on day 3 but limit-down, sold at 14
    assert round(done[0]["pnl"], 6) == round(400 * (14 - 11 + 0.1), 6) and done[0]["exit_dt"] == DAY + dt.timedelta(days=4)
    assert plain.run(p, {0: [a]}, plain.Trial(2, 2, gmax=0.05, fee=0.0, cost=0.0, capital=20_000.0))[3]["gap"] == 1
    assert plain.run(p, {0: [a]}, plain.Trial(2, 2, capital=100.0))[3]["lot"] == 1
    _, _, done, _ = plain.run(p, {1: [c]}, free)  # C ends on day 2: sold at its last close
    assert done[0]["code"] == "C" and done[0]["pnl"] == 0


def test_spark_simulation_equals_the_plain_one(spark):
    """Halts, limits, gaps, lots, ended codes, dividends and delayed sales, on random panels with gaps and on the hand-made one."""
    rng, rows = np.random.default_rng(5), []
    for c in "ABCDEFGH":
        first, last = int(rng.integers(0, 8)), int(rng.integers(20, 40))
        for i in range(first, last):
            if rng.random() < 0.9 or i == 0:
                o, k = (float(x) for x in rng.uniform(80, 120, 2))
                bad = rng.random(4) < 0.12
                rows.append((DAY + dt.timedelta(days=i), c, None if bad[0] else o, k, o * 2, not bad[1], bool(bad[2]), bool(bad[3]), float(rng.choice([0.0, 0.5])), None if i == first else float(rng.uniform(1e7, 1e9))))
    schema = "dt date, code string, open double, close double, open_u double, tradable boolean, stop_high boolean, stop_low boolean, dividend double, adv20 double"
    picks = [(DAY + dt.timedelta(days=i), s, str(c)) for i in range(40) for s, c in enumerate(rng.permutation(list("ABCDEFGHZ"))[:5])]
    free = simulate.Rules(fee=0.001, capital=1e6)
    for panel_rows, chosen in ((spark.createDataFrame(rows, schema), picks), (hand_panel(spark), [(DAY, 0, "B"), (DAY, 1, "C"), (DAY, 2, "A"), (DAY + dt.timedelta(days=1), 0, "A")])):
        grid = simulate.parameter_grid(spark, [1, 2, 5], [2, 3], [None, 0.05], [0.0, 1.0]).unionByName(simulate.parameter_grid(spark, [3], [2], [None], [2.0], equal_weight=True))
        frame = spark.createDataFrame(chosen, "dt date, slot int, code string")
        nav = {(r.trial, r.dt): (r.nav, r.invested) for r in simulate.simulate_grid(panel_rows, frame, grid, free).collect()}
        done = sorted((r.trial, r.code, r.buy_pos, r.exit_dt, round(r.cost, 4), round(r.ret, 9)) for r in simulate.simulate_trades(panel_rows, frame, grid, free).collect())
        p, want = plain.pack(panel_rows), []
        at, ids = {d: i for i, d in enumerate(p.days)}, {c: i for i, c in enumerate(p.codes)}
        by_day = {}
        for d, _, c in chosen:
            if c in ids and d in at:
                by_day.setdefault(at[d], []).append(ids[c])
        for r in grid.collect():
            t = plain.Trial(r.hold, r.slots, r.gmax, fee=0.001, cost=r.cost, capital=1e6, equal_weight=r.equal_weight)
            value, invested, trades, _ = plain.run(p, by_day, t)
            for i, d in enumerate(p.days[1:], 1):
                assert nav.pop((r.trial, d)) == pytest.approx((value[i], invested[i]), rel=1e-9, abs=1e-9)
            want += [(r.trial, x["code"], x["buy_pos"], x["exit_dt"], round(x["cost"], 4), round(x["ret"], 9)) for x in trades]
        assert not nav and done == sorted(want)


def test_grid_of_trials(spark):
    picks = spark.createDataFrame([(DAY, 0, "A"), (DAY, 1, "B")], "dt date, slot int, code string")
    grid = simulate.parameter_grid(spark, [1, 2], [1], [None, 0.01], seeds=(None, 5))
    nav = simulate.simulate_grid(hand_panel(spark), picks, grid).toPandas()
    assert len(nav) == 8 * 5 and nav["trial"].nunique() == 8 and nav["nav"].notna().all()


def test_multiple_testing(spark):
    rng = np.random.default_rng(2)
    r = rng.normal(0, 0.01, (4, 200))
    r[0] += 0.01
    df = spark.createDataFrame([(f"t{i}", j, float(r[i, j])) for i in range(4) for j in range(200)], "trial string, pos int, ret double")
    got = metrics.overfit_probability(df, blocks=6).first()
    assert got.splits == 20 and got.pbo == 0.0
    assert metrics.deflated_sharpe(0.3, 500, 0.0, 3.0, [0.01, 0.02, -0.01]) > 0.99 > 0.5 > metrics.deflated_sharpe(0.0, 500, 0.0, 3.0, [0.05, -0.1, 0.1])
    blocks = spark.createDataFrame([("s", i, float(i), 2.0) for i in range(10)], "series string, block long, total double, n double")
    one = metrics.bootstrap_ci(blocks, ["series"]).first()
    assert one.low < 9 * 10 / 2 / 20 < one.high


def test_quality_of_empty_and_purge(spark):
    bars = fixtures.table(spark, "fx_bars")
    days = panel.business_days(bars, fixtures.table(spark, "fx_holidays"))
    rows = {r.check: r.rows for r in panel.quality(bars, days).collect()}
    assert rows["duplicate_key"] == 1 and rows["price_not_positive"] == 1 and rows["off_calendar"] == rows["weekend"] == 1


def test_fitted_scores_learn(spark):
    rng = np.random.default_rng(3)
    rows = [(DAY + dt.timedelta(days=i % 40), str(i), float(x), float(x > 0.5)) for i, x in enumerate(rng.random(800))]
    df = models.prepared(spark.createDataFrame(rows, "dt date, code string, r_a double, y double"), ["r_a"])
    fold = [{"fold": 0, "train_end": DAY + dt.timedelta(days=29), "val_start": DAY + dt.timedelta(days=31), "val_end": DAY + dt.timedelta(days=39)}]
    for fit in (models.logistic, lambda t, y: models.boosted(t, y, rounds=3), lambda t, y: models.boosted(t, y, classify=True, rounds=3)):
        s = models.walk_forward(df, fold, "y", fit).join(df, ["dt", "code"])
        assert s.count() == 9 * 20 and s.agg(F.corr("score", "r_a")).first()[0] > 0.7


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=7 * i), i, "ab"[i % 2], float(i), "") for i in range(300)]
    for k in range(3):
        spark.createDataFrame(rows[100 * k : 100 * k + 100], stream_bars.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = stream_bars.read_events(spark, str(tmp_path / "in"))
    got = stream_bars.available_now(stream_bars.windowed_bars(stream), str(tmp_path / "t_bars"), str(tmp_path / "c1")).toPandas()
    pdf = pd.DataFrame(rows, columns=["event_id", "ts", "u", "code", "value", "p"])
    want = pdf.groupby([pdf.ts.dt.floor("h"), "code"])["value"].agg(["first", "max", "min", "last", "count"])
    assert len(got) > 30
    for r in got.itertuples():
        assert (r.open, r.high, r.low, r.close, r.volume) == tuple(want.loc[(r.dt, r.code)])
    means = stream_bars.available_now(stream_bars.running_means(stream), str(tmp_path / "t_means"), str(tmp_path / "c2"), "update").toPandas()
    last = means.sort_values("n").groupby("code").last()
    for code, g in pdf.groupby("code"):
        assert math.isclose(last.loc[code, "mean"], g["value"].ewm(alpha=0.1, adjust=False).mean().iloc[-1])


def test_universe_does_not_look_ahead(spark, bars):
    """The universe of a date is the same when the bars end there."""
    _, df = bars
    holidays = spark.createDataFrame([(DAY,)], "dt date")

    def members(b, at):
        rows = panel.traded_value(panel.align(b, panel.business_days(b, holidays)))
        u = panel.universe(rows, 40_000.0, 90.0, 30).where((F.col("dt") == F.lit(at)) & F.col("in_univ"))
        return {r.code for r in u.collect()}

    for at in (DAY + dt.timedelta(days=k) for k in (120, 204)):
        assert members(df, at) == members(df.where(F.col("dt") <= F.lit(at)), at)


def test_alignment_carries_closes_and_counts_days(spark):
    df = fixtures.table(spark, "fx_bars").dropDuplicates(["code", "dt"])
    rows = panel.align(df, panel.business_days(df, fixtures.table(spark, "fx_holidays"))).where("code = 'A'").orderBy("dt").collect()
    assert [r.dt.day for r in rows] == [6, 7, 8, 9, 10, 13, 14] and [r.listed_days for r in rows] == list(range(1, 8))
    halted = [r for r in rows if not r.tradable]
    assert [(r.dt.day, r.close, r.open, r.volume) for r in halted] == [(9, 53.0, None, 0.0), (13, 59.0, None, 0.0)]


def test_calmar(spark):
    from tidemark.operators import metrics

    rows = [("a", i, v) for i, v in enumerate([100.0, 120.0, 90.0, 121.0])] + [("b", 0, 100.0), ("b", 1, 110.0)] + [("c", 0, 100.0), ("c", 1, 0.0)]
    got = {r.s: r.calmar for r in metrics.calmar(spark.createDataFrame(rows, "s string, dt int, nav double"), ["s"], 100.0).collect()}
    assert abs(got["a"] - (1.21 ** (252 / 4) - 1) / 0.25) < 1e-6 and got["b"] is None and got["c"] == -1.0
    assert metrics.calmar(spark.createDataFrame([], "s string, dt int, nav double"), ["s"], 100.0).count() == 0
