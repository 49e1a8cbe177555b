"""Source divergence audit: how far each source's use of terms is from that of the other sources of its language.

Every term becomes a wide vector: an array over the language's sources, indexed by source, of which only the places with a count
are held. Higher-order functions make each vector's shares, a vector's places are paired, and a map-side aggregation sums the
pairs' contributions. A pair of whose sources one or both lack a term contributes what only depends on one count or on none;
those are summed from a histogram of counts, so that no vector makes more pairs than its places with a count allow. Equal
vectors, of which rare terms have many, are counted first and contribute once, times their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, staged

#: ASCII letters and everything beyond ASCII; terms are what stands between runs of other characters.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
MIN_DOCS = 3
TOP = 200
SCALE_STEPS, STEP = 3, 1000  # shares are in units of 1 / STEP^SCALE_STEPS


def sources(docs: DataFrame) -> DataFrame:
    """lang, source, i: the sources of each language that occur, numbered from 0 in order; nulls are empty strings."""
    groups = docs.select(*[F.coalesce(docs[c], F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    return groups.withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)


def term_counts(docs: DataFrame, axis: DataFrame) -> DataFrame:
    """lang, i, term, n, docs: occurrences and documents of each term by language and number of the source. A null text is an empty one.

    A document's terms are sorted, so that the first of equal ones stands for the document; rows are documents, repeats included.
    """
    low = F.when(F.octet_length("text") == F.length("text"), F.lower("text")).otherwise(ascii_lower(F.col("text")))  # quicker for ASCII
    rows = docs.select(*[F.coalesce(docs[c], F.lit("")).alias(c) for c in ("lang", "source")], F.sort_array(F.split(low, BETWEEN)).alias("w"))
    rows = rows.join(axis, ["lang", "source"])
    before = F.concat(F.array(F.lit("")), F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(1))))
    each = rows.select("lang", "i", F.inline(F.arrays_zip(F.col("w").alias("term"), before.alias("before")))).where("term <> ''")
    first = (F.col("term") != F.col("before")).cast("int")
    return each.select("lang", "i", "term", first.alias("first")).groupBy("lang", "i", "term").agg(F.count("*").alias("n"), F.sum("first").alias("docs"))


def kept_terms(docs: DataFrame, axis: DataFrame, least: int = MIN_DOCS) -> DataFrame:
    """lang, term, total, entries (i, n in order of i): the terms in at least so many documents of the language."""
    entries = F.sort_array(F.collect_list(F.struct("i", "n")))  # one entry a source
    per = term_counts(docs, axis).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), entries.alias("entries"))
    return per.where(F.col("docs") >= least).drop("docs")


def share(count: Column, whole: Column) -> Column:
    """1 + floor(10^9 (count + 1) / whole) by long division in steps, so that no product leaves 64 bits below 9 * 10^15 occurrences."""
    rest, out = count + 1, F.lit(0).cast("long")
    for _ in range(SCALE_STEPS):
        rest = rest * STEP
        digit = F.call_function("div", rest, whole)
        out, rest = out * STEP + digit, rest % whole
    return out + 1


def excess(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def audit(docs: DataFrame, least: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank of documents (text, lang, source).

    Part `pair`: for each source of a language every other one, value being the sum over the language's kept terms of
    floor((p - q)^2 / q), p and q the smoothed shares of a term in the source and in the other. Part `term`: the source's terms
    that are more frequent than in the whole language, the first `top` by the same measure against the language's share.

    Nulls count as empty strings. A source without terms has its pairs, a language without kept terms has pairs of value 0, a
    language with one source has no pairs, no documents give no rows. Repeated rows are documents of their own; ties go by the
    item's bytes; columns other than text, lang and source are not read. A text's terms are one array in a task.
    """
    docs = docs.select("text", "lang", "source")
    axis = staged(sources(docs), "divergence-sources")  # a row for each source of a language
    kept = staged(kept_terms(docs, axis, least), "divergence-terms")
    used = kept.select("lang", F.inline("entries")).groupBy("lang", "i").agg(F.sum("n").alias("used"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("all"))
    stats = axis.join(used, ["lang", "i"], "left").join(langs, "lang", "left").na.fill(0, ["used", "v", "all"])
    stats = stats.withColumn("whole", F.col("used") + F.col("v"))
    stats = staged(stats.withColumn("zero", F.when(F.col("whole") > 0, share(F.lit(0).cast("long"), F.col("whole")))), "divergence-groups")
    out = _pairs(kept, stats).unionByName(_terms(kept, stats, top))
    return out.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


def _pairs(kept: DataFrame, stats: DataFrame) -> DataFrame:
    wide = stats.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "source", "whole", "zero"))).alias("axis"), F.first("v").alias("v"))
    wide = wide.select("lang", "v", *[F.col("axis").getField(c).alias(c + "s") for c in ("source", "whole", "zero")])  # an array of each
    # both sources have the term: what the pair adds to what each place adds alone
    vectors = kept.groupBy("lang", "entries").agg(F.count("*").alias("k")).join(wide, "lang")
    places = F.transform("entries", lambda e: F.struct(e["i"].alias("i"), share(e["n"], F.get("wholes", e["i"])).alias("p"), F.get("zeros", e["i"]).alias("z")))
    rows = vectors.select("lang", "k", places.alias("e")).select("lang", "k", "e", F.inline("e"))
    rows = rows.select("lang", "k", "i", "p", "z", F.inline("e").alias("j", "o", "oz"))  # contributions are compiled: a lambda's are interpreted
    p, z, o, oz = (F.col(c) for c in ("p", "z", "o", "oz"))
    extra = (excess(p, o) - excess(p, oz) - excess(z, o) + excess(z, oz)) * F.col("k")
    both = rows.select("lang", "i", "j", extra.alias("value")).groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
    # one of them has it: by the histogram of a source's counts
    counts = kept.select("lang", F.inline("entries")).groupBy("lang", "i", "n").agg(F.count("*").alias("k")).join(wide, "lang")
    counts = counts.select("lang", "i", "k", "zeros", share(F.col("n"), F.get("wholes", F.col("i"))).alias("p"), F.get("zeros", F.col("i")).alias("z"))
    counts = counts.select("lang", "i", "k", "p", "z", F.posexplode("zeros").alias("j", "o"))
    sides = F.array(
        F.struct(F.col("i"), F.col("j"), ((excess(p, o) - excess(z, o)) * F.col("k")).alias("value")),
        F.struct(F.col("j").alias("i"), F.col("i").alias("j"), ((excess(o, p) - excess(o, z)) * F.col("k")).alias("value")),
    )
    one = counts.select("lang", F.inline(sides)).groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
    # neither: for all kept terms
    every = wide.select("lang", "v", "sources", "zeros", F.posexplode("sources").alias("i", "source")).withColumn("z", F.get("zeros", F.col("i")))
    every = every.select("lang", "v", "zeros", "i", "source", "z", F.posexplode("sources").alias("j", "item")).where("i <> j")
    every = every.withColumn("none", F.coalesce(excess(z, F.get("zeros", F.col("j"))) * F.col("v"), F.lit(0)))
    sums = both.union(one).groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
    found = every.join(sums, ["lang", "i", "j"], "left").withColumn("value", F.col("none") + F.coalesce("value", F.lit(0)))
    place = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return found.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(place).alias("rank"))


def _terms(kept: DataFrame, stats: DataFrame, top: int) -> DataFrame:
    rows = kept.select("lang", F.col("term").alias("item"), "total", F.inline("entries"))
    rows = rows.join(stats, ["lang", "i"])
    rows = rows.withColumns({"p": share(F.col("n"), F.col("whole")), "q": share(F.col("total"), F.col("all") + F.col("v"))}).where("p > q")
    rows = rows.select("lang", "source", "item", excess(F.col("p"), F.col("q")).alias("value"))
    place = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top).withColumn("part", F.lit("term"))
