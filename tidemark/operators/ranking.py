"""Learning to rank the rows of a day: boosted trees on pairwise lambda gradients, all sums made by Spark.

A row is paired with the rows 1, 2, 4, 8, ... places above and below it in the day's order of scores, so that a day of n rows makes
about 2 n log n pairs, near and far ones, and none are emitted as rows: windows bring the partners. A tree is grown from histograms,
one aggregation by (node, feature, bin) for each of its levels.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import pct_rank
from ..sources.stores import staged

GRADES = 10
#: The farthest partner of a row, in places.
REACH = 1024


def grades(df: DataFrame, label: str, n: int = GRADES) -> DataFrame:
    """df with grade: 0 to n - 1 by the label's rank in its day, null for a null label."""
    return df.withColumn("__r", pct_rank(label, ["dt"])).withColumn("grade", F.least(F.floor(F.col("__r") * n), F.lit(n - 1)).cast("int")).drop("__r")


def ndcg(df: DataFrame, score: str, grade: str = "grade", k: int = 20) -> DataFrame:
    """dt, ndcg: the discounted gain (2^grade - 1) of the day's first k rows by score over that of its best order. Null scores come
    last, ties go by code, rows without a grade are left out; null for a day without gain."""
    df = df.where(F.col(grade).isNotNull())
    gain = F.pow(F.lit(2.0), F.col(grade)) - 1
    place = lambda order: F.row_number().over(Window.partitionBy("dt").orderBy(*order))
    df = df.select("dt", gain.alias("g"), place([F.col(score).desc_nulls_last(), F.col("code")]).alias("a"), place([F.col(grade).desc(), F.col("code")]).alias("b"))
    part = lambda at: F.sum(F.when(F.col(at) <= k, F.col("g") / F.log2(F.col(at) + 1.0)))
    return df.groupBy("dt").agg(F.when(part("b") > 0, part("a") / part("b")).alias("ndcg"))


def gradients(rows: DataFrame, reach: int = REACH) -> DataFrame:
    """rows (dt, code, grade, s, ...) with g and h: how a higher score would better the day's order, and the curvature.

    A pair counts by the change of the discounted gain if its rows changed places.
    """
    day = Window.partitionBy("dt").orderBy(F.desc("s"), "code")
    own = F.struct("s", "grade", F.row_number().over(day).alias("place"))
    rows = rows.withColumn("__own", own)
    g = h = F.lit(0.0)
    offset = 1
    mine = F.col("__own")
    gain = lambda r: F.pow(F.lit(2.0), r["grade"]) - 1
    discount = lambda r: 1 / F.log2(r["place"] + 1.0)
    partners = {}
    while offset <= reach:
        partners |= {f"__u{offset}": F.lag("__own", offset).over(day), f"__d{offset}": F.lead("__own", offset).over(day)}
        offset *= 2
    rows = rows.withColumns(partners)
    for name in partners:
        other = F.col(name)
        sign = F.signum((mine["grade"] - other["grade"]).cast("double"))
        weight = F.abs(gain(mine) - gain(other)) * F.abs(discount(mine) - discount(other))
        wrong = 1 / (1 + F.exp(sign * (mine["s"] - other["s"])))
        g = g + F.coalesce(sign * weight * wrong, F.lit(0.0))
        h = h + F.coalesce(weight * wrong * (1 - wrong), F.lit(0.0))
    return rows.withColumns({"g": g, "h": h}).drop("__own", *partners)


@dataclass
class Ranker:
    """Cut points by feature and trees: splits (node, feature's place, bin) and the values of leaves."""

    features: list[str]
    cuts: list[list[float]]
    trees: list[tuple[list[tuple[int, int, int]], dict[int, float]]]

    def bins(self) -> Column:
        """Each feature's bin: how many cut points are below its value; one more than all for null."""
        out = []
        for name, cuts in zip(self.features, self.cuts):
            at = F.array(*[F.lit(float(c)) for c in cuts]) if cuts else F.array().cast("array<double>")
            value = F.col(name).cast("double")
            out.append(F.when(value.isNull() | F.isnan(value), len(cuts) + 1).otherwise(F.size(F.filter(at, _below(value)))))
        return F.array(*out)

    def value(self, bins: str) -> Column:
        total = F.lit(0.0)
        for splits, leaves in self.trees:
            node = node_of(splits, bins)
            leaf = F.lit(0.0)
            for n, x in leaves.items():
                leaf = F.when(node == n, x).otherwise(leaf)
            total = total + leaf
        return total

    def score(self, df: DataFrame) -> DataFrame:
        """df with pred."""
        return df.withColumn("__b", self.bins()).withColumn("pred", self.value("__b")).drop("__b")


def _below(value: Column):
    return lambda cut: cut < value


def node_of(splits: list[tuple[int, int, int]], bins: str) -> Column:
    """The node that a row reaches: from node k to 2k + 1 for a bin up to the split's, else to 2k + 2."""
    at = {n: (f, b) for n, f, b in splits}

    def down(n: int) -> Column:
        if n not in at:
            return F.lit(n)
        f, b = at[n]
        return F.when(F.get(F.col(bins), F.lit(f)) <= b, down(2 * n + 1)).otherwise(down(2 * n + 2))

    return down(0)


def _split(rows: DataFrame, penalty: float, least: int) -> list:
    """For each node the split of the best gain, if any gains: node, f, b and the values left and right of it. Histograms have a row for each node, feature and bin."""
    sums = rows.select("node", "g", "h", F.posexplode("b").alias("f", "b")).groupBy("node", "f", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count("*").alias("n"))
    upto = Window.partitionBy("node", "f").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("node", "f")
    left = {c: F.sum(c).over(upto) for c in ("g", "h", "n")}
    every = {f"{c}_all": F.sum(c).over(whole) for c in ("g", "h", "n")}
    sums = sums.withColumns({f"{c}_left": x for c, x in left.items()} | every)
    part = lambda g, h: g * g / (h + penalty)
    g, h, ga, ha = (F.col(c) for c in ("g_left", "h_left", "g_all", "h_all"))
    gain = F.round(part(g, h) + part(ga - g, ha - h) - part(ga, ha), 9)
    sums = sums.where((F.col("n_left") >= least) & (F.col("n_all") - F.col("n_left") >= least)).withColumn("gain", gain).where("gain > 0")
    found = F.struct("f", "b", (g / (h + penalty)).alias("left"), ((ga - g) / (ha - h + penalty)).alias("right"))
    return sums.groupBy("node").agg(F.min_by(found, F.struct(-F.col("gain"), "f", "b")).alias("s")).select("node", "s.*").collect()


def fit(train: DataFrame, features: list[str], label: str, rounds: int = 20, depth: int = 3, step: float = 0.1, bins: int = 32, penalty: float = 1.0, least: int = 20) -> Ranker:
    """A ranker of the days' rows (dt, code, label and features), by grades of the label.

    Rows without a label are left out; a null feature has a bin of its own; ties go by code. Without rows, or with labels that don't
    vary within a day, no tree has a split and all predictions are 0. A day's rows are one window; what comes to the driver are cut
    points and one split a node.
    """
    rows = grades(train.where(F.col(label).isNotNull()), label)
    marks = [F.lit(i / bins) for i in range(1, bins)]
    cuts = rows.agg(*[F.percentile_approx(F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")), F.array(*marks), F.lit(10_000)).alias(f"c{i}") for i, f in enumerate(features)]).first()
    model = Ranker(features, [sorted(set(cuts[f"c{i}"] or [])) for i in range(len(features))], [])
    base = staged(rows.select("dt", "code", "grade", model.bins().alias("b")))
    for _ in range(rounds):
        tree = staged(gradients(base.withColumn("s", model.value("b"))).select("b", "g", "h"))
        splits: list[tuple[int, int, int]] = []
        leaves: dict[int, float] = {}
        for _ in range(depth):
            found = _split(tree.withColumn("node", node_of(splits, "b")), penalty, least)
            for r in found:
                n = r["node"]
                splits.append((n, r["f"], r["b"]))
                leaves.pop(n, None)
                leaves |= {2 * n + 1: step * r["left"], 2 * n + 2: step * r["right"]}
            if not found:
                break
        if not splits:
            break
        model.trees.append((splits, leaves))
    return model
