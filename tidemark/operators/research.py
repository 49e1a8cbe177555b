"""Rank information coefficients, scores, candidate selection and regimes."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import corr, div, pct_rank
from .panel import slippage


def daily_ic(df: DataFrame, features: list[str], label: str, least: int = 30) -> DataFrame:
    """dt, feature, n, ic: the day's Spearman correlation of each feature with the label, over rows with both."""
    long = df.select("dt", F.col(label).alias("y"), F.expr(f"stack({len(features)}, {', '.join(f"'{f}', {f}" for f in features)}) as (feature, x)")).where("x is not null and y is not null")
    by = ["dt", "feature"]
    ranked = long.select(*by, pct_rank("x", by).alias("rx"), pct_rank("y", by).alias("ry"))
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), corr("rx", "ry").alias("ic")).where(f"n >= {least}")


def newey_west(daily: DataFrame, value: str, lags: int, by: list[str]) -> DataFrame:
    """by, n, mean, t: the mean's t statistic with Bartlett-weighted autocovariances up to `lags`, in order of dt."""
    w = Window.partitionBy(*by).orderBy("dt")
    df = daily.where(F.col(value).isNotNull())
    df = df.withColumn("e", F.col(value) - F.avg(value).over(Window.partitionBy(*by)))
    df = df.withColumns({f"__l{k}": F.col("e") * F.lag("e", k).over(w) for k in range(1, lags + 1)})
    terms = F.sum(F.col("e") * F.col("e"))
    for k in range(1, lags + 1):
        terms = terms + 2 * (1 - k / (lags + 1)) * F.coalesce(F.sum(f"__l{k}"), F.lit(0.0))
    out = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), terms.alias("__v"))
    return out.withColumn("t", F.when(F.col("__v") > 0, F.col("mean") / (F.sqrt("__v") / F.col("n")))).drop("__v")


def ic_summary(daily: DataFrame, lags: int = 5, least: int = 50) -> DataFrame:
    """feature, n, mean, sd, ir, t, agree: agree is the share of years whose mean has the sign of the whole mean."""
    t = newey_west(daily, "ic", lags, ["feature"])
    sd = daily.groupBy("feature").agg(F.stddev_samp("ic").alias("sd"))
    years = daily.groupBy("feature", F.year("dt").alias("y")).agg(F.avg("ic").alias("m"))
    agree = years.join(t.select("feature", "mean"), "feature").groupBy("feature").agg(F.avg((F.signum("m") == F.signum("mean")).cast("double")).alias("agree"))
    return t.join(sd, "feature").join(agree, "feature").withColumn("ir", div(F.col("mean"), F.col("sd"))).where(f"n >= {least}")


def adoption(least_agree: float = 0.6, least_t: float = 2.0) -> Column:
    """Whether a row of ic_summary is adopted; a null measure isn't."""
    return F.coalesce((F.col("agree") >= least_agree) & (F.abs("t") > least_t), F.lit(False))


def adopted(summary: DataFrame, least_agree: float = 0.6, least_t: float = 2.0) -> DataFrame:
    return summary.where(adoption(least_agree, least_t)).orderBy(F.abs("ir").desc(), "feature")


def hashed(keys: list[str], seed: int = 42) -> Column:
    """A number below 2^60 for a row's keys, by a hash that other engines have too; nulls are empty."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def pooled_sample(df: DataFrame, keys: list[str], size: int = 200_000, seed: int = 42) -> DataFrame:
    """About `size` rows, all if there are no more: those whose hash is below a threshold, whatever the partitioning."""
    n = df.count()
    return df if n <= size else df.where(hashed(keys, seed) < int(size / n * (1 << 60)))


def pairwise_corr(df: DataFrame, cols: list[str]) -> DataFrame:
    """a, b, r for each pair of columns in order, over rows with both; null where one of them doesn't vary.

    One pass: a task multiplies its rows' values and marks of presence as matrices and hands on one row of sums a pair. Values are
    shifted by their column's mean first, so that sums of squares lose no digits.
    """
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    shifted = df.select(*[(F.col(c).cast("double") - (means[i] or 0.0)).alias(f"x{i}") for i, c in enumerate(cols)])
    upper = np.triu_indices(len(cols), 1)

    def products(batches):
        total = None
        for b in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns])
            there = np.isfinite(x).astype(float)
            x = np.where(there > 0, x, 0.0)
            part = np.stack([there.T @ there, x.T @ there, (x * x).T @ there, x.T @ x])
            total = part if total is None else total + part
        if total is not None:
            n, s, q, p = total
            parts = [n[upper], s[upper], s.T[upper], q[upper], q.T[upper], p[upper]]
            yield pa.RecordBatch.from_arrays([*(pa.array(i.astype(np.int32)) for i in upper), *map(pa.array, parts)], ["i", "j", "n", "sa", "sb", "qa", "qb", "p"])

    names = ["n", "sa", "sb", "qa", "qb", "p"]
    sums = shifted.mapInArrow(products, "i int, j int, " + ", ".join(f"{c} double" for c in names)).groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in names])
    n, sa, sb, qa, qb, p = (F.col(c) for c in names)
    va, vb = n * qa - sa * sa, n * qb - sb * sb
    name = F.array(*[F.lit(c) for c in cols])
    return sums.select(F.get(name, F.col("i")).alias("a"), F.get(name, F.col("j")).alias("b"), F.when((va > 0) & (vb > 0), (n * p - sa * sb) / F.sqrt(va) / F.sqrt(vb)).alias("r"))


def prune(names: list[str], corr: dict[tuple[str, str], float], most: float = 0.9) -> list[str]:
    """names in order, without those that correlate above `most` with one kept before; works on the collected small matrix."""
    kept: list[str] = []
    for x in names:
        if all(abs(corr.get((x, y), corr.get((y, x), 0.0)) or 0.0) <= most for y in kept):
            kept.append(x)
    return kept


def pruned(summary: DataFrame, pairs: DataFrame, most: float = 0.9) -> DataFrame:
    """feature, ir, place, kept of a summary (feature, ir) in order of |ir|, then of name; pairs as pairwise_corr gives them.

    Both tables grow with the features, not with the rows.
    """
    order = [(r["feature"], r["ir"]) for r in summary.where("ir is not null").orderBy(F.desc(F.abs("ir")), "feature").collect()]
    kept = set(prune([f for f, _ in order], {(r["a"], r["b"]): r["r"] for r in pairs.collect()}, most))
    return summary.sparkSession.createDataFrame([(f, ir, i, f in kept) for i, (f, ir) in enumerate(order, 1)], "feature string, ir double, place long, kept boolean")


def quantile_spread(df: DataFrame, rank: str, label: str, share: float = 0.1) -> DataFrame:
    """top, bottom, spread: means over days of the label's mean among the highest and lowest shares by rank."""
    per = df.groupBy("dt").agg(F.avg(F.when(F.col(rank) > 1 - share, F.col(label))).alias("hi"), F.avg(F.when(F.col(rank) <= share, F.col(label))).alias("lo"))
    return per.agg(F.avg("hi").alias("top"), F.avg("lo").alias("bottom")).withColumn("spread", F.col("top") - F.col("bottom"))


def score_mean(cols: list[str], signs: dict[str, float] | None = None) -> Column:
    """The mean of the ranks that are not null; with signs, of those centred at a half times their sign."""
    xs = [F.col(c) if signs is None else (F.col(c) - 0.5) * signs.get(c, 0.0) for c in cols]
    n = sum((x.isNotNull().cast("int") for x in xs), F.lit(0))
    return sum((F.coalesce(x.cast("double"), F.lit(0.0)) for x in xs), F.lit(0.0)) / F.nullif(n, F.lit(0))


def rule_scores(df: DataFrame, ranks: list[str], label: str, shares=(0.1, 0.2, 0.3), sizes=(1, 2, 3), least: int = 1000, by: tuple[str, ...] = ()) -> DataFrame:
    """rule, share, n, value for each set of features: rows where all are in the top share, and the mean of their daily mean label;
    with `by`, for each of its groups.

    A row is exploded once for each rule it meets, so that one aggregation serves all rules.
    """
    rules = [(list(c), q) for k in sizes for c in combinations(ranks, k) for q in shares]
    met = []
    for c, q in rules:
        cond = F.lit(True)
        for x in c:
            cond = cond & F.coalesce(F.col(x) > 1 - q, F.lit(False))
        met.append(F.when(cond, F.struct(F.lit("+".join(c)).alias("rule"), F.lit(q).alias("share"))))
    rows = df.where(F.col(label).isNotNull()).select(*by, "dt", F.col(label).alias("y"), F.explode(F.array_compact(F.array(*met))).alias("r")).select(*by, "dt", "y", "r.*")
    per = rows.groupBy(*by, "rule", "share", "dt").agg(F.avg("y").alias("m"), F.count("*").alias("k"))
    return per.groupBy(*by, "rule", "share").agg(F.sum("k").alias("n"), F.avg("m").alias("value")).where(f"n >= {least}")


def best_rules(df: DataFrame, folds: DataFrame, ranks: list[str], label: str, shares=(0.1, 0.2, 0.3), sizes=(1, 2, 3), least: int = 1000) -> DataFrame:
    """fold, rule, share, n, value: the rule that is best on the rows up to the fold's train_end, of equal ones the shortest, then the
    first by name and share. A fold on whose rows no rule has `least` rows has none."""
    known = F.broadcast(folds.select("fold", "train_end"))  # a row for each fold
    scored = rule_scores(df.join(known, df["dt"] <= known["train_end"]), ranks, label, shares, sizes, least, by=("fold",))
    size = F.size(F.split("rule", r"\+"))
    order = Window.partitionBy("fold").orderBy(F.desc(F.round("value", 12)), size, "rule", "share")
    return scored.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def apply_rules(df: DataFrame, rules: DataFrame, ranks: list[str]) -> DataFrame:
    """df (with fold) and score: the mean of the ranks that the fold's rule names where all are in its top share, else null."""
    named = F.split("rule", r"\+")
    inside = F.filter(F.array(*[F.when(F.array_contains(named, r), F.struct(F.lit(r).alias("name"), F.col(r).cast("double").alias("x"))) for r in ranks]), lambda s: s.isNotNull())
    df = df.join(F.broadcast(rules.select("fold", "rule", "share")), "fold", "left").withColumn("__in", inside)
    fits = F.forall("__in", lambda s: F.coalesce(s["x"] > 1 - F.col("share"), F.lit(False)))
    mean = F.aggregate("__in", F.lit(0.0), lambda a, s: a + s["x"]) / F.size("__in")
    return df.withColumn("score", F.when(F.col("rule").isNotNull() & fits, mean)).drop("__in", "rule", "share")


def ensemble(scores: DataFrame, least: int = 2) -> DataFrame:
    """dt, code, score: the mean of daily ranks over families, where at least so many have one (long input: family, dt, code, score)."""
    ranked = scores.withColumn("rk", pct_rank("score", ["family", "dt"])).where("rk is not null")
    return ranked.groupBy("dt", "code").agg(F.avg("rk").alias("score"), F.count("*").alias("n")).where(f"n >= {least}").drop("n")


def candidates(scores: DataFrame, theta: float, top: int, regime: DataFrame | None = None, pred_above: float | Column | None = None, ascending: bool = False) -> DataFrame:
    """dt, slot, code: of each day's rows the best by score within the share theta (at least one), then the first `top`.

    All rows of a day count for theta, those without a score too; ties go to the smaller code. With regime (dt, ok) only days
    that are ok, with pred_above only rows whose pred is above it. Ascending takes the lowest scores.
    """
    day = Window.partitionBy("dt")
    place = Window.partitionBy("dt").orderBy(F.col("score").asc_nulls_last() if ascending else F.col("score").desc_nulls_last(), "code")
    df = scores.withColumn("__n", F.count(F.lit(1)).over(day)).withColumn("__r", F.row_number().over(place))
    df = df.where(F.col("score").isNotNull() & (F.col("__r") <= F.greatest(F.lit(1), F.floor(theta * F.col("__n")))))
    if pred_above is not None:
        df = df.where(F.col("pred") > pred_above)
    if regime is not None:
        df = df.join(F.broadcast(regime.where("ok").select("dt")), "dt", "left_semi")
    return df.withColumn("slot", F.row_number().over(place) - 1).where(F.col("slot") < top).select("dt", "slot", "code")


def round_trip_cost(adv: Column, fee: float = 0.0005) -> Column:
    """What a predicted return has to be above: fee and slippage, both ways."""
    return 2 * (fee + slippage(adv))


def random_candidates(rows: DataFrame, top: int, seed: int) -> DataFrame:
    """dt, slot, code: the first `top` of each day in the order of a seeded hash; the same for every run."""
    w = Window.partitionBy("dt").orderBy(F.xxhash64(F.lit(seed), "dt", "code"), "code")
    return rows.withColumn("slot", F.row_number().over(w) - 1).where(F.col("slot") < top).select("dt", "slot", "code")


def shuffled_labels(df: DataFrame, label: str, seed: int) -> DataFrame:
    """df with the label moved among a day's rows by a seeded hash."""
    by_code = F.row_number().over(Window.partitionBy("dt").orderBy("code"))
    by_hash = F.row_number().over(Window.partitionBy("dt").orderBy(F.xxhash64(F.lit(seed), "dt", "code"), "code"))
    moved = df.select("dt", F.col(label), by_hash.alias("__k"))
    return df.drop(label).withColumn("__k", by_code).join(moved, ["dt", "__k"]).drop("__k")


def regimes(market: DataFrame, fold_rows: DataFrame, quantile: float = 0.8) -> DataFrame:
    """dt, fold, above, vol_ok: the index above its long mean, and its volatility at most the quantile of all dates before the fold."""
    m, f = market.select("dt", "mk_above200", "mk_vol20"), fold_rows.select("fold", "val_start", "val_end")
    past = m.join(F.broadcast(f), m["dt"] < f["val_start"]).groupBy("fold").agg(F.percentile("mk_vol20", F.lit(quantile)).alias("limit"))
    f = f.join(past, "fold", "left")
    df = m.join(F.broadcast(f), (m["dt"] >= f["val_start"]) & (m["dt"] <= f["val_end"]))
    return df.select("dt", "fold", F.coalesce(F.col("mk_above200") == 1, F.lit(False)).alias("above"), F.coalesce(F.col("mk_vol20") <= F.col("limit"), F.lit(False)).alias("vol_ok"))


def regime_ok(name: str) -> Column:
    """Whether a day of `regimes` may be traded under a rule by name."""
    above, calm = F.col("above"), F.col("vol_ok")
    return {"none": F.lit(True), "idx_above_sma200": above, "idx_vol_below_p80": calm, "excl_down_lowvol": above | ~calm}[name]


def calibration(df: DataFrame, pred: str, actual: str, bins: int = 10) -> DataFrame:
    """bin, n, mean_pred, mean_actual by quantiles of pred, right-closed; equal edges are merged."""
    edges = df.agg(F.percentile(pred, F.array(*[F.lit(i / bins) for i in range(1, bins)])).alias("e")).select(F.array_sort(F.array_distinct("e")).alias("e"))
    b = F.size(F.filter("e", lambda e: F.col(pred) > e))
    return df.where(f"{pred} is not null").crossJoin(F.broadcast(edges)).groupBy(b.cast("long").alias("bin")).agg(F.count("*").alias("n"), F.avg(pred).alias("mean_pred"), F.avg(actual).alias("mean_actual"))


def calibrated(df: DataFrame, pred: str, actual: str, bins: int = 10, within: float = 0.05) -> DataFrame:
    """worst, ok: the largest difference of a bin's mean prediction and its frequency over rows with both; ok is null without rows."""
    table = calibration(df.where(F.col(actual).isNotNull()), pred, actual, bins)
    return table.agg(F.max(F.abs(F.col("mean_pred") - F.col("mean_actual"))).alias("worst")).withColumn("ok", F.col("worst") <= within)


def percentile_of(values: DataFrame, distribution: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """values with percentile: the share, in hundredths, of its group's distribution that is below; null for a null value or an empty
    distribution. Both are ordered together once, so no value meets every other."""
    low = distribution.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("__v"), F.lit(None).alias("__row"), F.lit(1).alias("__d"))
    own = values.select(*by, F.col(value).alias("__v"), F.struct(*values.columns).alias("__row"), F.lit(0).alias("__d"))
    both = own.unionByName(low.withColumn("__row", F.lit(None).cast(own.schema["__row"].dataType)))
    w = Window.partitionBy(*by)
    below = F.sum("__d").over(w.orderBy(F.col("__v").asc_nulls_first(), "__d").rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumns({"__b": below, "__n": F.sum("__d").over(w)}).where("__row is not null")
    share = F.when(F.col("__v").isNotNull() & (F.col("__n") > 0), 100.0 * F.col("__b") / F.col("__n"))
    return both.select("__row.*", share.alias("percentile"))


def train_against_walk(train: DataFrame, walk: DataFrame, least: float = 0.5) -> DataFrame:
    """median, walk, ratio, ok of Sharpe ratios by fold on their training days (fold, sharpe) and one row of the walk-forward's (sharpe):
    ok where the ratio is at least `least` or the median isn't positive."""
    m = train.agg(F.median("sharpe").alias("median"))
    both = m.join(F.broadcast(walk.select(F.col("sharpe").alias("walk"))))  # one row each
    ratio = F.when(F.col("median") > 0, F.col("walk") / F.col("median"))
    return both.withColumn("ratio", ratio).withColumn("ok", F.coalesce((F.col("median") <= 0) | (F.col("ratio") >= least), F.lit(False)))


def seed_spread(sharpes: DataFrame, most: float = 0.3) -> DataFrame:
    """cv, ok of one Sharpe ratio a seed: their deviation over their mean's size; a mean of zero isn't ok."""
    df = sharpes.agg(F.stddev_samp("sharpe").alias("s"), F.avg("sharpe").alias("m"))
    return df.select(div(F.col("s"), F.abs("m")).alias("cv")).withColumn("ok", F.coalesce(F.col("cv") <= most, F.lit(False)))
