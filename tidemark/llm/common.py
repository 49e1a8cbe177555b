"""Shared helpers: reading tables, written intermediate tables, running sums over a global order."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: ASCII white space, the separator of words in most contracts.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on a local master without one a new folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def staged(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: lineage ends here, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 4 << 20) -> None:
    """Rows and bytes that Python gets at once. Texts are long: the defaults would be up to 64 MB twice for each core.

    The settings hold for the rest of the session, since the plans that need them run later.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def parts_for(n_rows: int, per_part: int = 2_000) -> int:
    return max(1, -(-n_rows // per_part))


def running_sum(df: DataFrame, by: list[str], bucket: str, order: list, value: str, out: str) -> DataFrame:
    """Adds out: the sum of value over the rows before this one in the order (bucket, order) within by.

    Rows meet only within (by, bucket); the totals of whole buckets, one row for each (by, bucket), are summed apart, so a
    hot value of by is spread over its buckets.
    """
    keys = [*by, bucket]
    totals = df.groupBy(*keys).agg(F.sum(value).alias("__total"))
    before = Window.partitionBy(*by).orderBy(F.col(bucket).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("__before", F.coalesce(F.sum("__total").over(before), F.lit(0))).drop("__total")
    totals = totals.select(*[F.col(k).alias(f"__k_{k}") for k in keys], "__before")
    here = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("__here", F.coalesce(F.sum(value).over(here), F.lit(0)))
    on = [rows[k].eqNullSafe(totals[f"__k_{k}"]) for k in keys]
    joined = rows.join(totals, [*on], "inner") if len(on) else rows.crossJoin(totals)
    return joined.withColumn(out, F.col("__here") + F.col("__before")).drop("__here", "__before", *[f"__k_{k}" for k in keys])
