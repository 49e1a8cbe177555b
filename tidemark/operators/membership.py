"""Membership intervals from change events, and point-in-time lookups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _steps(events: DataFrame) -> DataFrame:
    """dt, code, is_in (0 or 1): an event's out and in as rows of their own."""
    step = lambda name, n: F.when(F.col(name).isNotNull(), F.struct(F.col(name).alias("code"), F.lit(n).alias("is_in")))
    return events.select("dt", F.explode(F.array_compact(F.array(step("out_code", 0), step("in_code", 1)))).alias("s")).select("dt", "s.*")


def intervals(events: DataFrame, members: DataFrame) -> DataFrame:
    """code, in_dt, out_dt from (dt, out_code, in_code) and today's members; half-open, null where open.

    Each code's ins and outs are paired in order of date, an out before an in on one day; an out that comes first opens at
    null, and a member without events has both ends open.
    """
    w = Window.partitionBy("code").orderBy("dt", "is_in")
    steps = _steps(events).withColumns({"before": F.lag("is_in").over(w), "after": F.lead("dt").over(w)})
    opened = steps.where("is_in = 1").select("code", F.col("dt").alias("in_dt"), F.col("after").alias("out_dt"))
    first = steps.where("is_in = 0 and before is null").select("code", F.lit(None).cast("date").alias("in_dt"), F.col("dt").alias("out_dt"))
    quiet = members.join(steps.select("code").distinct(), "code", "left_anti").select("code", F.lit(None).cast("date").alias("in_dt"), F.lit(None).cast("date").alias("out_dt"))
    return opened.union(first).union(quiet)


def inconsistent(events: DataFrame, members: DataFrame) -> DataFrame:
    """code, why: ins that follow ins, outs that follow outs, and codes whose last event disagrees with today's members."""
    w = Window.partitionBy("code").orderBy("dt", "is_in")
    steps = _steps(events).withColumns({"before": F.lag("is_in").over(w), "after": F.lead("is_in").over(w)})
    twice = steps.where("is_in = before").select("code", F.lit("same event twice").alias("why"))
    last = steps.where("after is null").join(members.withColumn("now", F.lit(1)), "code", "left")
    return twice.union(last.where(F.col("is_in") != F.coalesce("now", F.lit(0))).select("code", F.lit("last event disagrees with members").alias("why"))).distinct()


def members_at(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """rows (code, dt, ...) with member: whether dt is in one of the code's intervals. Intervals of a code don't overlap."""
    s = spans.select(F.col("code").alias("__c"), "in_dt", "out_dt")
    inside = (rows["code"] == s["__c"]) & (s["in_dt"].isNull() | (rows["dt"] >= s["in_dt"])) & (s["out_dt"].isNull() | (rows["dt"] < s["out_dt"]))
    return rows.join(s, inside, "left").withColumn("member", F.col("__c").isNotNull()).drop("__c", "in_dt", "out_dt")


def unpriced_share(rows: DataFrame, priced: DataFrame) -> DataFrame:
    """year, share: of the days on which codes are members (dt, code, member), the share that falls on codes that priced lacks."""
    df = rows.where("member").join(priced.select("code").distinct().withColumn("__has", F.lit(True)), "code", "left")
    return df.groupBy(F.year("dt").alias("year")).agg(F.avg(F.col("__has").isNull().cast("double")).alias("share"))


def outsiders(chosen: DataFrame, spans: DataFrame) -> DataFrame:
    """The rows (code, dt, ...) chosen on days on which their code was no member: none for a choice that knows only its own day."""
    return members_at(chosen, spans).where("not member").drop("member")


def two_views(rows: DataFrame, spans: DataFrame, members: DataFrame, plan: Callable[[DataFrame], DataFrame], keys: list[str]) -> DataFrame:
    """keys, side: one plan over rows with membership as it stood (member by spans) and with today's members on all days, joined by keys.

    plan takes rows with member and returns rows with unique keys. side is both, then (only as it stood) or now (only with today's
    members: what a universe of survivors lets in). Keys may be null.
    """
    then = plan(members_at(rows, spans)).select(*keys, F.lit(1).alias("__then"))
    today = members.select("code").distinct().withColumn("__m", F.lit(True))
    now = plan(rows.join(today, "code", "left").withColumn("member", F.coalesce("__m", F.lit(False))).drop("__m")).select(*keys, F.lit(1).alias("__now"))
    grouped = then.withColumn("__now", F.lit(0)).unionByName(now.withColumn("__then", F.lit(0))).groupBy(*keys).agg(F.max("__then").alias("a"), F.max("__now").alias("b"))
    return grouped.select(*keys, F.when(F.col("a") + F.col("b") == 2, "both").when(F.col("a") == 1, "then").otherwise("now").alias("side"))


def leak_summary(sides: DataFrame, outcomes: DataFrame, keys: list[str], value: str) -> DataFrame:
    """view, n, mean of an outcome by key under membership as it stood (then) and under today's (now), and n_only, the rows that only
    this view has."""
    df = sides.join(outcomes.select(*keys, F.col(value).alias("__y")), keys, "left")
    df = df.select("side", "__y", F.explode(F.when(F.col("side") == "both", F.array(F.lit("then"), F.lit("now"))).otherwise(F.array("side"))).alias("view"))
    return df.groupBy("view").agg(F.count("*").alias("n"), F.count_if(F.col("side") != "both").alias("n_only"), F.avg("__y").alias("mean"))
