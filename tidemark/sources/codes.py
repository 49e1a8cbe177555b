"""Bars stored by code: a scan of some codes reads their buckets or folders only, and windows by code need no exchange."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .stores import work_dir

#: So many codes at most are written into a scan's condition; a longer list is a table of its own and joined.
LISTED = 1000


def store_buckets(bars: DataFrame, table: str, buckets: int, path: str | None = None) -> None:
    """bars as a table of so many buckets by code, each sorted by code and dt. path is where its files are, by default in the shared
    folder; the table must not exist. Rows with a null code are kept, in one bucket."""
    where = path or f"{work_dir(bars.sparkSession)}/{table}-{uuid.uuid4().hex}"
    bars.repartition(buckets, "code").write.bucketBy(buckets, "code").sortBy("code", "dt").option("path", where).saveAsTable(table)


def store_folders(bars: DataFrame, path: str, folders: int) -> None:
    """bars in Parquet folders part=k by a hash of the code, for scans whose codes are only known when they run."""
    parted = bars.withColumn("part", folder_of(F.col("code"), folders))
    parted.repartition(folders, "part").sortWithinPartitions("code", "dt").write.partitionBy("part").parquet(path)


def folder_of(code, folders: int):
    return F.pmod(F.xxhash64(code), F.lit(folders)).cast("int")


def scan_listed(spark: SparkSession, table: str, codes: list[str]) -> DataFrame:
    """The rows of the listed codes of a bucketed table; only their buckets are read, and windows by code need no exchange.

    No codes give no rows, codes that the table lacks none of theirs, repeats and nulls in the list don't matter.
    """
    wanted = sorted({c for c in codes if c is not None})
    if len(wanted) > LISTED:
        raise ValueError(f"more than {LISTED} codes: give them to scan_joined as a table")
    return spark.table(table).where(F.col("code").isin(wanted) if wanted else F.lit(False))


def scan_joined(stored: DataFrame, codes: DataFrame, folders: int) -> DataFrame:
    """The rows of stored (as store_folders writes them) whose code is in codes, each once however often it is named there.

    The numbers of the folders that the codes fall in, at most `folders`, are found first and prune the scan; the codes themselves
    stay a table that is semi-joined, broadcast or not. No codes give no rows.
    """
    wanted = codes.where("code is not null").select("code", folder_of(F.col("code"), folders).alias("part")).distinct()
    parts = [r["part"] for r in wanted.select("part").distinct().collect()]
    pruned = stored.where(F.col("part").isin(parts) if parts else F.lit(False))
    return pruned.join(wanted, ["part", "code"], "left_semi")
