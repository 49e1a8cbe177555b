"""Early stopping, ranking, penalties, regimes and the stability of importances on planted data."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import models, ranking, research

DAY = dt.date(2020, 1, 1)
SCHEMA = "dt date, code string, a double, b double, c double, y double, up double"


def planted(spark, days=40, codes=40, seed=1):
    """y is high in the middle of a and falls with b; c is noise."""
    rng, out = random.Random(seed), []
    for d in range(days):
        for k in range(codes):
            a, b, c = rng.random(), rng.random(), rng.random()
            y = 1.5 * math.exp(-20 * (a - 0.5) ** 2) - 0.5 * b + rng.gauss(0, 0.1)
            out.append((DAY + dt.timedelta(days=d), f"k{k:02d}", None if rng.random() < 0.02 else a, b, c, y, float(y > 0.5)))
    return spark.createDataFrame(out, SCHEMA)


@pytest.fixture(scope="module")
def rows(spark):
    return models.prepared(planted(spark), ["a", "b", "c"]).cache()


@pytest.mark.parametrize("classify", [False, True])
def test_boosting_stops_on_the_later_days(spark, rows, classify):
    label = "up" if classify else "y"
    fit = models.stopped(rows, label, ["a", "b", "c"], 1, classify, depth=2, most=25, tolerance=0.02)
    assert 1 < fit.rounds < 25 and max(fit.importance, key=fit.importance.get) == "a" and fit.importance["c"] < 0.2
    got = fit.score(rows).select("pred", label).toPandas()
    assert np.corrcoef(got["pred"], got[label])[0, 1] > 0.7
    noise = rows.withColumn(label, (F.xxhash64("dt", "code") % 2 == 0).cast("double"))
    assert models.stopped(noise, label, ["a", "b", "c"], 1, classify, depth=2, most=25, tolerance=0.02).rounds <= 3
    one_day = rows.where(F.col("dt") == F.lit(DAY))
    assert models.stopped(one_day, label, ["a", "b", "c"], 1, classify, depth=1, most=2).rounds == 2


def brute_lambdas(day, reach):
    """g and h of one day's (code, grade, s) by all pairs whose distance is a power of two."""
    order = sorted(day, key=lambda r: (-r[2], r[0]))
    out = {r[0]: [0.0, 0.0] for r in day}
    for i, x in enumerate(order):
        for j, z in enumerate(order):
            if i != j and abs(i - j) <= reach and (abs(i - j) & (abs(i - j) - 1)) == 0 and x[1] != z[1]:
                sign = 1 if x[1] > z[1] else -1
                w = abs(2 ** x[1] - 2 ** z[1]) * abs(1 / math.log2(i + 2) - 1 / math.log2(j + 2))
                p = 1 / (1 + math.exp(sign * (x[2] - z[2])))
                out[x[0]][0] += sign * w * p
                out[x[0]][1] += w * p * (1 - p)
    return out


def test_lambda_gradients_equal_brute_force(spark):
    rng = random.Random(3)
    days = {d: [(f"c{k}", rng.randrange(4), round(rng.gauss(0, 1), 1)) for k in range(n)] for d, n in ((0, 1), (1, 13), (2, 6))}
    df = spark.createDataFrame([(d, *r) for d, day in days.items() for r in day], "dt int, code string, grade int, s double").repartition(3)
    got = {(r.dt, r.code): (r.g, r.h) for r in ranking.gradients(df, 8).collect()}
    for d, day in days.items():
        for code, (g, h) in brute_lambdas(day, 8).items():
            assert math.isclose(got[d, code][0], g, abs_tol=1e-9) and math.isclose(got[d, code][1], h, abs_tol=1e-9)
    assert abs(sum(g for g, _ in got.values())) < 1e-9


def test_ranking_beats_the_mean_of_ranks(spark, rows):
    early, late = rows.where(F.col("dt") < F.lit(DAY + dt.timedelta(days=28))), rows.where(F.col("dt") >= F.lit(DAY + dt.timedelta(days=28)))
    model = ranking.fit(early, ["a", "b", "c"], "y", rounds=5, depth=2, step=0.5, bins=16)
    scored = ranking.grades(model.score(late).withColumn("mean", research.score_mean(["a", "b", "c"])), "y")
    mean = lambda s: ranking.ndcg(scored, s, k=10).agg(F.avg("ndcg")).first()[0]
    assert len(model.trees) == 5 and mean("pred") > mean("mean") + 0.2 and mean("y") == pytest.approx(1.0)
    flat = ranking.fit(early.withColumn("y", F.lit(1.0)), ["a"], "y", rounds=3)
    assert flat.trees == [] and {r.pred for r in flat.score(late).select("pred").collect()} == {0.0}
    assert ranking.fit(early.where("false"), ["a"], "y", rounds=2).trees == []


def test_penalty_scaling_seeds_and_regimes(spark, rows):
    flip = rows.withColumn("up", (F.col("b") < 0.5).cast("double")).withColumn("target", -F.col("b"))
    best, table = models.choose_penalty(flip, "up", "target", 1)
    found = {r.c: r.ic for r in table.collect()}
    assert best == max(found, key=lambda c: (found[c], -[0.01, 0.1, 1.0].index(c))) and found[best] > 0.9
    z = models.standardised(rows, ["a", "one"] if "one" in rows.columns else ["a"])["a"]
    m = rows.select(F.avg(z), F.stddev_pop(z)).first()
    assert abs(m[0]) < 1e-9 and abs(m[1] - 1) < 1e-9
    seeds = models.seed_mean(lambda t, y, s: lambda df: df.withColumn("pred", F.lit(float(s))), [1, 2, 6])
    assert {r.pred for r in seeds(rows, "y")(rows).select("pred").collect()} == {3.0}
    day = F.datediff("dt", F.lit(DAY))
    market = rows.withColumns({"mk_above200": (day % 2).cast("double"), "mk_vol20": (day % 4 >= 2).cast("double")})
    fit = lambda t, y: (lambda v: lambda df: df.withColumn("pred", F.lit(v)))(t.agg(F.avg("mk_above200")).first()[0])
    scheme, score = models.regime_split(market, "y", fit)
    assert scheme == "4" and score(market).where("pred <> mk_above200").count() == 0 and score(market).count() == market.count()
    calm = market.withColumn("mk_vol20", F.lit(1.0))
    assert models.regime_split(calm, "y", fit)[0] == "2" and models.regime_split(calm.withColumn("mk_above200", F.lit(None).cast("double")), "y", fit) is None


def test_top_stability(spark):
    rows = [(0, "a", 3.0), (0, "b", 2.0), (0, "c", 1.0), (0, "d", 0.0), (2, "a", 3.0), (2, "b", 1.0), (2, "c", 2.0), (2, "d", 0.0), (5, "a", 0.0), (5, "b", 0.0), (5, "c", 0.0), (5, "d", 0.0)]
    df = spark.createDataFrame(rows, "fold long, feature string, importance double")
    got = {r.fold: (r.shared, r.corr) for r in models.top_stability(df, 2).collect()}
    assert got[2][0] == 1 and got[2][1] == pytest.approx(0.5) and got[5] == (1, None) and 0 not in got
    assert models.top_stability(df.where("false"), 2).count() == 0


def test_correlations_and_pruning(spark, rows):
    df = rows.select("dt", "code", "a", "b", "c", (F.col("a") * 1e6 + 1e9).alias("d"), F.lit(1.0).alias("e"), F.lit(None).cast("double").alias("f"))
    names = ["a", "b", "c", "d", "e", "f"]
    got = {(r.a, r.b): r.r for r in research.pairwise_corr(df, names).collect()}
    pdf = df.toPandas()[names].astype(float)
    assert len(got) == 15 and got["a", "d"] == pytest.approx(1.0) and got["a", "e"] is None and got["b", "f"] is None
    for x, y in (("a", "b"), ("a", "c"), ("b", "d")):
        assert got[x, y] == pytest.approx(pdf[x].corr(pdf[y]), abs=1e-9)
    summary = spark.createDataFrame([("a", -0.5), ("d", 0.4), ("b", 0.6), ("g", None), ("c", 0.4)], "feature string, ir double")
    kept = [(r.feature, r.kept) for r in research.pruned(summary, research.pairwise_corr(df, names)).orderBy("place").collect()]
    assert kept == [("b", True), ("a", True), ("c", True), ("d", False)]
    sample = research.pooled_sample(df, ["dt", "code"], 400)
    assert 300 < sample.count() < 500 and sample.count() == research.pooled_sample(df.repartition(7), ["dt", "code"], 400).count()
    assert research.pairwise_corr(df.where("false"), ["a", "b"]).count() == 0


def test_percentile_ratio_and_spread(spark):
    d = spark.createDataFrame([("s", float(v)) for v in (1, 2, 2, 5)] + [("s", None)], "k string, value double")
    v = spark.createDataFrame([("s", 2.0, 1), ("s", 9.0, 2), ("s", None, 3), ("t", 1.0, 4), ("s", 2.0, 1)], "k string, value double, i int")
    assert sorted((r.i, r.percentile) for r in research.percentile_of(v, d, ["k"]).collect() if r.i != 3 and r.i != 4) == [(1, 25.0), (1, 25.0), (2, 100.0)]
    assert {r.i: r.percentile for r in research.percentile_of(v, d, ["k"]).where("i > 2").collect()} == {3: None, 4: None}
    folds = spark.createDataFrame([(0, 1.0), (1, 3.0), (2, 2.0)], "fold int, sharpe double")
    one = lambda x: spark.createDataFrame([(x,)], "sharpe double")
    assert tuple(research.train_against_walk(folds, one(1.0)).first()) == (2.0, 1.0, 0.5, True) and not research.train_against_walk(folds, one(0.9)).first().ok
    assert research.seed_spread(folds.select("sharpe")).first().ok is False and research.seed_spread(one(1.0)).first().ok is False
