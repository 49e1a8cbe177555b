"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, parts_for, running_sum, staged

#: Source tables up to this many bytes of names (and rows times 50) are broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 8_000_000
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _ranked(df: DataFrame, order: list, label: str) -> DataFrame:
    """df range-sorted and written with its partition as part: (part, order) is then the global order in every later read."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return staged(df.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), label)


def source_targets(sizes: DataFrame, weights: tuple = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """source, source_size, rank, weight, target for a table (source, size).

    Sources in code point order, null last, get the weights in turn. They share `share` of all sizes by weight; a target
    above `most` times its source's size is set to that and the excess shared again by weight until none is above.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = _ranked(per, [F.col("source").asc_nulls_last()], "mix-sources")
    per = running_sum(per.withColumn("one", F.lit(1)), [], "part", [F.col("source").asc_nulls_last()], "one", "rank").drop("one", "part")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    per = staged(per.withColumn("weight", weight).withColumn("cap", most * F.col("source_size")), "mix-targets")
    budget = share * (per.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:  # each round caps at least one more source
        above = F.col("weight") * F.lit(level) > F.col("cap")
        kept, free, n = per.agg(F.sum(F.when(above, F.col("cap")).otherwise(0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight"))), F.count_if(above)).first()
        if n == capped or not free:
            break
        level, capped = (budget - kept) / free, n
    return per.withColumn("target", F.round(F.least(F.col("weight") * F.lit(level), F.col("cap").cast("double")), 6)).drop("cap")


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple = (3, 1, 2), share: float = 1.5, most: int = 2, seed: str = SEED, keep: tuple = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken and the columns of keep, one row for each input row.

    Documents are shuffled within their source by a hash of seed and doc_id. A document's virtual finish time is the words
    of its source up to its end over the source's target; a further pass over the source adds its size. All passes are
    range-sorted by finish time and cut at the total budget, so that each source has its share at every moment; the document
    at the cut is taken in part. taken counts words over all passes and is at most `most` times size. Null texts have size
    0 and take 0; rows repeated in full are drawn one after the other; an empty table gives an empty result.
    """
    h = F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), h.alias("h"), *[F.col(c).alias(f"keep_{c}") for c in keep])
    rows = staged(rows, "mix-sizes")
    bits = (parts_for(rows.count()) - 1).bit_length()
    per = source_targets(rows, weights, share, most)
    n, names = per.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("source")), F.lit(0))).first()
    per = per.withColumnRenamed("source", "s")
    rows = rows.join(F.broadcast(per) if 50 * n + names <= BROADCAST_BYTES else per, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rows = rows.withColumn("bucket", F.shiftright("h", 60 - bits))
    rows = staged(running_sum(rows, ["rank"], "bucket", ["h", "doc_id", "size"], "size", "before"), "mix-times")
    budget = int(share * (rows.agg(F.sum("size")).first()[0] or 0))

    finish = [(F.col("before") + F.col("size") + p * F.col("source_size")) / F.nullif(F.col("target"), F.lit(0.0)) for p in range(most)]
    place = [F.struct(f.alias("f"), F.col("rank"), F.col("h"), F.lit(p).alias("p")) for p, f in enumerate(finish)]
    entries = rows.where("size > 0 and target > 0").select("size", F.explode(F.array(*place)).alias("e")).select("size", "e.*")
    order = ["f", "rank", "h", "p"]
    entries = running_sum(_ranked(entries, order, "mix-entries"), [], "part", order, "size", "ahead")
    cut = entries.where((F.col("ahead") < budget) & (F.col("ahead") + F.col("size") >= budget)).first()
    if cut is None:
        taken = F.lit(0)
    else:
        at = F.struct(*[F.lit(cut[c]).cast(t).alias(c) for c, t in zip(order, ("double", "long", "long", "int"))])
        rest = F.lit(budget - cut["ahead"])
        taken = sum((F.when(x < at, F.col("size")).when(x == at, rest).otherwise(0) for x in place), F.lit(0))
        taken = F.when((F.col("size") > 0) & (F.col("target") > 0), taken).otherwise(0)
    return rows.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), *[f"keep_{c}" for c in keep])
