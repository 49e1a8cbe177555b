"""Fitted scores: logistic regression and gradient-boosted trees of Spark ML over walk-forward folds."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import corr, pct_rank
from .labels import inner_split
from .research import daily_ic, random_candidates


def prepared(df: DataFrame, ranks: list[str], extra: list[str] = ()) -> DataFrame:
    """df with x: ranks less a half and the extra columns, nulls as 0."""
    cols = {f"__{c}": F.coalesce(F.col(c).cast("double") - (0.5 if c in ranks else 0.0), F.lit(0.0)) for c in [*ranks, *extra]}
    return VectorAssembler(inputCols=list(cols), outputCol="x").transform(df.withColumns(cols)).drop(*cols)


def daily_sample(df: DataFrame, most: int, seed: int) -> DataFrame:
    """At most so many rows of each day, by a seeded hash."""
    return df.join(random_candidates(df.select("dt", "code"), most, seed).select("dt", "code"), ["dt", "code"])


def logistic(train: DataFrame, label: str, c: float = 0.1) -> Callable[[DataFrame], DataFrame]:
    """L2-penalised with the penalty 1 / (c n); scores are the probability of 1."""
    n = train.count()
    model = LogisticRegression(featuresCol="x", labelCol=label, regParam=1 / (c * max(n, 1)), elasticNetParam=0.0, standardization=False, maxIter=50).fit(train)
    return lambda df: model.transform(df).withColumn("pred", F.get(vector_to_array("probability"), F.lit(1))).drop("rawPrediction", "probability", "prediction")


def boosted(train: DataFrame, label: str, classify: bool = False, depth: int = 3, rounds: int = 10, seed: int = 42) -> Callable[[DataFrame], DataFrame]:
    kind = GBTClassifier if classify else GBTRegressor
    model = Pipeline(stages=[kind(featuresCol="x", labelCol=label, maxDepth=depth, maxIter=rounds, stepSize=0.1, maxBins=63, seed=seed)]).fit(train)
    if classify:
        return lambda df: model.transform(df).withColumn("pred", F.get(vector_to_array("probability"), F.lit(1))).drop("rawPrediction", "probability", "prediction")
    return lambda df: model.transform(df).withColumnRenamed("prediction", "pred")


def walk_forward(df: DataFrame, folds: list, label: str, fit: Callable) -> DataFrame:
    """dt, code, fold, score: for each fold (fold, train_end, val_start, val_end) a model of the rows up to train_end scores its span."""
    out = None
    for f in folds:
        train = df.where((F.col("dt") <= F.lit(f["train_end"])) & F.col(label).isNotNull())
        part = df.where(F.col("dt").between(F.lit(f["val_start"]), F.lit(f["val_end"])))
        scored = fit(train, label)(part).select("dt", "code", F.lit(f["fold"]).alias("fold"), F.col("pred").alias("score"))
        out = scored if out is None else out.unionByName(scored)
    return out


def by_regime(df: DataFrame, regime: str, label: str, fit: Callable, least: float = 0.15) -> Callable[[DataFrame], DataFrame] | None:
    """A scorer with one model for each value of regime; None if a value has less than that share of the training rows."""
    shares = {r[regime]: r["n"] for r in df.groupBy(regime).agg(F.count("*").alias("n")).collect()}
    if not shares or min(shares.values()) < least * sum(shares.values()):
        return None
    scorers = {v: fit(df.where(F.col(regime) == v), label) for v in shares}

    def score(rows: DataFrame) -> DataFrame:
        out = None
        for v, s in scorers.items():
            part = s(rows.where(F.col(regime) == v))
            out = part if out is None else out.unionByName(part)
        return out

    return score


@dataclass
class Fit:
    """A fitted model: score adds pred to rows, rounds is what early stopping kept (None without), importance is by feature."""

    score: Callable[[DataFrame], DataFrame]
    rounds: int | None
    importance: dict[str, float]


def stopped(train: DataFrame, label: str, features: list[str], horizon: int, classify: bool = False, depth: int = 3, most: int = 50, tolerance: float = 0.001, step: float = 0.1, seed: int = 42) -> Fit:
    """Boosted trees on the first part of the training days, stopped by the last part (labels.inner_split, purged by the horizon).

    A round is kept while the error on the last part falls by at least `tolerance` of itself; at most `most` rounds. Where either
    part has no rows all rows are trained on and the rounds are `most`. features are those of column x, in order.
    """
    rows = inner_split(train, horizon).where("part is not null").withColumn("held", F.col("part") == "valid")
    parts = {r["part"] for r in rows.select("part").distinct().collect()}
    kind = GBTClassifier if classify else GBTRegressor
    model = kind(featuresCol="x", labelCol=label, maxDepth=depth, maxIter=most, stepSize=step, maxBins=63, seed=seed, cacheNodeIds=False)
    if len(parts) == 2:
        model = model.setValidationIndicatorCol("held").setParams(validationTol=tolerance)
    else:
        rows = train
    fitted = model.fit(rows)
    weights = fitted.featureImportances.toArray().tolist()
    pred = F.get(vector_to_array("probability"), F.lit(1)) if classify else F.col("prediction")
    score = lambda df: fitted.transform(df).withColumn("pred", pred).drop("rawPrediction", "probability", "prediction")
    return Fit(score, fitted.getNumTrees, dict(zip(features, weights)))


def fold_fits(df: DataFrame, folds: list, label: str, fit: Callable[[DataFrame, str], Fit]) -> tuple[DataFrame, DataFrame]:
    """dt, code, fold, rounds, score of every fold's span, and fold, rounds, feature, importance of its model."""
    out, rows = None, []
    for f in folds:
        train = df.where((F.col("dt") <= F.lit(f["train_end"])) & F.col(label).isNotNull())
        one = fit(train, label)
        part = one.score(df.where(F.col("dt").between(F.lit(f["val_start"]), F.lit(f["val_end"]))))
        scored = part.select("dt", "code", F.lit(f["fold"]).cast("long").alias("fold"), F.lit(one.rounds).cast("long").alias("rounds"), F.col("pred").alias("score"))
        out = scored if out is None else out.unionByName(scored)
        rows += [(int(f["fold"]), one.rounds, name, float(x)) for name, x in one.importance.items()]
    return out, df.sparkSession.createDataFrame(rows, "fold long, rounds long, feature string, importance double")


def top_stability(importances: DataFrame, top: int = 10) -> DataFrame:
    """fold, shared, corr: for each fold and the one before it how many of their `top` features they share, and the rank correlation of
    the importances over the union of both tops. Ties for a place in the top go by name; corr is null where one side doesn't vary."""
    place = Window.partitionBy("fold").orderBy(F.desc("importance"), "feature")
    own = importances.select("fold", "feature", "importance", (F.row_number().over(place) <= top).alias("in_top"))
    order = F.dense_rank().over(Window.orderBy("fold"))  # a row for each fold and feature
    own = own.withColumn("at", order)
    before = own.select((F.col("at") + 1).alias("at"), "feature", F.col("importance").alias("was"), F.col("in_top").alias("was_top"))
    both = own.join(before, ["at", "feature"]).where("in_top or was_top")
    both = both.withColumns({"a": pct_rank("importance", ["fold"]), "b": pct_rank("was", ["fold"])})
    return both.groupBy("fold").agg(F.count_if(F.col("in_top") & F.col("was_top")).alias("shared"), corr("a", "b").alias("corr"))


def standardised(train: DataFrame, columns: list[str]) -> dict[str, Column]:
    """For each column (x - mean) / deviation by the training rows, nulls as 0; a column that doesn't vary is only shifted."""
    x = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns}
    row = train.agg(*[f(x[c]).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {c: (x[c] - (row[f"m{i}"] or 0.0)) / (row[f"s{i}"] or 1.0) for i, c in enumerate(columns)}


def choose_penalty(train: DataFrame, label: str, target: str, horizon: int, penalties=(0.01, 0.1, 1.0), least: int = 30) -> tuple[float, DataFrame]:
    """The penalty (C) whose model on the first part of the training days has the best mean daily rank correlation of its predictions
    with the target on the last part, the first of equal ones, and the table of c, ic. Rows have x, dt, code, label and target."""
    split = inner_split(train, horizon)
    fit_on, held = split.where("part = 'train'"), split.where("part = 'valid'")
    found = []
    for c in penalties:
        scored = logistic(fit_on.where(F.col(label).isNotNull()), label, c)(held)
        ic = daily_ic(scored.select("dt", "pred", F.col(target).alias("y")), ["pred"], "y", least).agg(F.avg("ic")).first()[0]
        found.append((c, ic))
    best = max(found, key=lambda f: (f[1] if f[1] is not None else float("-inf"), -penalties.index(f[0])))[0]
    return best, train.sparkSession.createDataFrame(found, "c double, ic double")


def seed_mean(fit: Callable[[DataFrame, str, int], Callable], seeds: list[int]) -> Callable[[DataFrame, str], Callable]:
    """A fit whose prediction is the mean of one model for each seed."""

    def apply(train: DataFrame, label: str):
        scorers = [fit(train, label, s) for s in seeds]

        def score(df: DataFrame) -> DataFrame:
            for i, s in enumerate(scorers):
                df = s(df).withColumnRenamed("pred", f"__p{i}")
            names = [f"__p{i}" for i in range(len(scorers))]
            return df.withColumn("pred", sum((F.col(c) for c in names[1:]), F.col(names[0])) / len(names)).drop(*names)

        return score

    return apply


def regime_split(train: DataFrame, label: str, fit: Callable, least: float = 0.15) -> tuple[str, Callable] | None:
    """The scheme and scorer of models by market regime (columns mk_above200, mk_vol20): four regimes, or two by the trend alone where
    one of four has less than `least` of the rows; None where one of two has too."""
    limit = train.select("dt", "mk_vol20").distinct().agg(F.median("mk_vol20")).first()[0]
    above = (F.coalesce(F.col("mk_above200"), F.lit(0.0)) > 0.5).cast("int")
    wild = F.coalesce(F.col("mk_vol20") > F.lit(limit), F.lit(False)).cast("int")
    for scheme, regime, kinds in (("4", above * 2 + wild, 4), ("2", above, 2)):
        rows = train.withColumn("regime", regime)
        if rows.select("regime").distinct().count() == kinds and (scorer := by_regime(rows, "regime", label, fit, least)):
            return scheme, lambda df, r=regime, s=scorer: s(df.withColumn("regime", r)).drop("regime")
    return None
