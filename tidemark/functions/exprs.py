"""Column expressions with the semantics that panel analytics needs, all of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

EPS = 1e-12
BLOCK = 256  # rows that a recursion takes at once


def by_code() -> WindowSpec:
    return Window.partitionBy("code").orderBy("dt")


def last_rows(n: int) -> WindowSpec:
    return by_code().rowsBetween(1 - n, 0)


def r6(x: Column | str) -> Column:
    """Six decimals, never minus zero."""
    return F.round(F.col(x) if isinstance(x, str) else x, 6) + F.lit(0.0)


def div(a: Column, b: Column) -> Column:
    """a / b; null for a zero or null divisor."""
    return a / F.nullif(b, F.lit(0.0))


def corr(a: str, b: str) -> Column:
    """Their correlation over a group's rows, of which both have values; null where one of them doesn't vary (the built-in divides by zero)."""
    return div(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def lag(x: str | Column, n: int = 1) -> Column:
    return F.lag(x, n).over(by_code())


def lead(x: str | Column, n: int = 1) -> Column:
    return F.lead(x, n).over(by_code())


def rolling(fn, x: str | Column, n: int, least: int | None = None) -> Column:
    """fn over the last n rows of the code; null with fewer than `least` (by default n) values."""
    w = last_rows(n)
    return F.when(F.count(x).over(w) >= (n if least is None else least), fn(x).over(w))


def sma(x: str | Column, n: int) -> Column:
    return rolling(F.avg, x, n)


def both_greatest(*xs: Column) -> Column:
    """The largest, null if any is null."""
    out = F.greatest(*xs)
    for x in xs:
        out = F.when(x.isNotNull(), out)
    return out


def both_least(*xs: Column) -> Column:
    out = F.least(*xs)
    for x in xs:
        out = F.when(x.isNotNull(), out)
    return out


def pct_rank(x: str, by: list[str], descending: bool = False) -> Column:
    """Average rank of ties over the number of non-null values; null for null."""
    c = F.col(x)
    up, down = (F.rank().over(Window.partitionBy(*by).orderBy(o)) for o in (c.asc_nulls_last(), c.desc_nulls_last()))
    n = F.count(c).over(Window.partitionBy(*by))
    first, last = (down, up) if descending else (up, down)  # of equal values: how many are before them and behind them
    return F.when(c.isNotNull(), (first + n + 1 - last) / 2 / n)  # one partitioning for all three


def streak(df: DataFrame, cond: Column, out: str) -> DataFrame:
    """df with out: how many rows up to this one have cond without a break; null conditions break."""
    df = df.withColumn("__t", F.coalesce(cond, F.lit(False)).cast("int"))
    df = df.withColumn("__i", F.sum(1 - F.col("__t")).over(by_code().rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("code", "__i").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum("__t").over(run).cast("long")).drop("__t", "__i")


def since_sign_change(df: DataFrame, sign: str, out: str, cap: int = 250) -> DataFrame:
    """df with out: sign times the rows since the sign came up, at most cap; null where the sign is 0 or null, which also ends a run."""
    s = F.nullif(F.col(sign), F.lit(0.0))
    df = df.withColumn("__s", s)
    new = F.coalesce((F.col("__s") != lag("__s")), F.lit(True)) | F.col("__s").isNull()
    df = df.withColumn("__new", new.cast("int")).withColumn("__i", F.sum("__new").over(by_code().rowsBetween(Window.unboundedPreceding, 0)))
    n = F.row_number().over(Window.partitionBy("code", "__i").orderBy("dt")) - 1
    return df.withColumn(out, F.col("__s") * F.least(n, F.lit(cap))).drop("__s", "__new", "__i")


def ewm(df: DataFrame, specs: dict[str, tuple[str, float, int]]) -> DataFrame:
    """df with recursive means y = (1 - a) y' + a x by code: out -> (column, a, least number of values).

    A null x keeps the mean, and the next value weighs more against it: over k nulls the old mean has (1 - a)^(k + 1) to a.
    Each code's rows are one array in order of dt, along which the mean is folded in blocks, so that the work grows with the rows;
    its length is bounded by the calendar.
    """
    names = [c for c in df.columns if c != "code"]
    rows = df.groupBy("code").agg(F.sort_array(F.collect_list(F.struct("dt", *[c for c in names if c != "dt"]))).alias("__rows"))
    starts = F.sequence(F.lit(0), F.call_function("div", F.size("__rows") - 1, F.lit(BLOCK)).cast("int"))
    rows = rows.withColumn("__blocks", F.transform(starts, lambda b: F.slice("__rows", b * BLOCK + 1, F.lit(BLOCK))))
    rows = rows.withColumns({f"__{out}": _folded(F.col("__blocks"), x, a, least) for out, (x, a, least) in specs.items()})
    each = F.transform("__rows", lambda r, i: F.struct(*[r[c].alias(c) for c in names], *[F.get(F.col(f"__{o}"), i).alias(o) for o in specs]))
    return rows.select("code", F.inline(each)).select(*df.columns, *specs)


def _folded(blocks: Column, name: str, a: float, least: int) -> Column:
    """The means of the values of all blocks in turn. A block's means are one short array, to which appending is cheap; a block goes on
    from where the one before it ended."""
    at_first = [F.lit(None).cast("double").alias("y"), F.lit(1.0).alias("w"), F.lit(0).alias("n")]

    def step(s: Column, r: Column) -> Column:
        x = r[name].cast("double")
        x = F.when(~F.isnan(x), x)
        w = s["w"] * (1 - a)
        y = F.when(s["y"].isNull(), x).when(x.isNull(), s["y"]).otherwise((w * s["y"] + a * x) / (w + a))
        n = s["n"] + x.isNotNull().cast("int")
        w = F.when(x.isNotNull() | s["y"].isNull(), 1.0).otherwise(w)
        return F.struct(y.alias("y"), w.alias("w"), n.alias("n"), F.array_append(s["out"], F.when(n >= least, y)).alias("out"))

    def block(s: Column, b: Column) -> Column:
        inside = F.aggregate(b, F.struct(s["y"].alias("y"), s["w"].alias("w"), s["n"].alias("n"), F.array().cast("array<double>").alias("out")), step)
        joined = F.transform(F.array(inside), lambda i: F.struct(i["y"].alias("y"), i["w"].alias("w"), i["n"].alias("n"), F.array_append(s["out"], i["out"]).alias("out")))
        return F.get(joined, F.lit(0))  # the one element binds the block's result, which is used four times

    start = F.struct(*at_first, F.array().cast("array<array<double>>").alias("out"))
    return F.aggregate(blocks, start, block, lambda s: F.flatten(s["out"]))


def ema_alpha(span: int) -> float:
    return 2.0 / (span + 1)


#: A table row's cells of a code and a name, as pages of index members write them.
CELLS = r"<td[^>]*>\s*([0-9][0-9A-Z]{3})\s*</td>\s*<td[^>]*>([\s\S]*?)</td>"


def cell_pairs(html: str | Column, pattern: str = CELLS) -> Column:
    """An array of (code, name) of the pattern's two groups in a page, tags taken out of the names; empty for none, null for null."""
    part = lambda group: F.regexp_extract_all(html, F.lit(pattern), F.lit(group))
    return F.transform(F.arrays_zip(part(1).alias("code"), part(2).alias("name")), lambda p: F.struct(p["code"].alias("code"), F.trim(F.regexp_replace(p["name"], "<[^>]*>", "")).alias("name")))
