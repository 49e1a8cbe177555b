"""Scans that conform to a schema, manifests, and sinks that append or refuse to overwrite."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

BARS = "dt date, code string, open double, high double, low double, close double, volume double, dividend double, split double"
DEFAULTS = {"dividend": 0.0, "split": 0.0}


def conform(df: DataFrame, schema: str = BARS, defaults: dict = DEFAULTS) -> DataFrame:
    """The schema's columns in its order and types: missing ones from defaults or null, not-a-number as null, others dropped."""
    out = []
    for f in T._parse_datatype_string(schema).fields if isinstance(schema, str) else schema.fields:
        c = F.col(f.name) if f.name in df.columns else F.lit(defaults.get(f.name))
        c = c.cast(f.dataType)
        if isinstance(f.dataType, T.DoubleType):
            c = F.when(~F.isnan(c), c)
            if f.name in defaults:
                c = F.coalesce(c, F.lit(defaults[f.name]))
        out.append(c.alias(f.name))
    return df.select(out)


def scan(spark: SparkSession, path, fmt: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    """A file scan of parquet, orc, csv or json; csv and json need a schema, so that no pass over the data is spent on guessing."""
    if fmt in ("csv", "json") and schema is None:
        raise ValueError(f"{fmt} needs a schema")
    reader = spark.read.format(fmt).options(**({"header": True} if fmt == "csv" else {}) | options)
    return (reader.schema(schema) if schema else reader).load(path)


def long_from_wide(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, code and fields from columns named field|code, rows with no value left out."""
    codes = sorted({c.split("|", 1)[1] for c in df.columns if "|" in c})
    has = set(df.columns)
    part = lambda code, f: (F.col(f"`{f}|{code}`") if f"{f}|{code}" in has else F.lit(None)).cast("double").alias(f)
    rows = F.array(*[F.struct(F.lit(code).alias("code"), *[part(code, f) for f in fields]) for code in codes])
    return df.select(key, F.explode(rows).alias("r")).select(key, "r.*").dropna(how="all", subset=fields)


def dense(df: DataFrame, value: str, codes: list[str]) -> DataFrame:
    """One row for each dt with a column for each of the given codes."""
    return df.where(F.col("code").isin(codes)).groupBy("dt").pivot("code", codes).agg(F.first(value))


def manifest(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """name, bytes, sha256, combined: a digest of each file below a folder and that of all digests in order of name. A file is one
    row of at most 2 GB; a larger one fails the job. What is gathered is 100 bytes a file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    inside = F.substring_index("path", path.rstrip("/").rsplit("/", 1)[-1] + "/", -1)
    rows = staged(files.select(inside.alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("name", "sha256"))), lambda r: r["sha256"])
    return rows.crossJoin(F.broadcast(rows.agg(F.sha2(F.array_join(ordered, ""), 256).alias("combined"))))


def tree_digest(rows: DataFrame, part: str, key: str, line: Column, fan: int = 1000, levels: int = 3) -> DataFrame:
    """part, digest: lines in order of a whole-number key are digested by ranges of `fan` keys, those digests by ranges of `fan`
    ranges and so on for `levels` levels, then all of a part. With unique keys no value holds more than `fan` lines below the part."""
    df, glue = rows.select(F.col(part).alias("part"), F.col(key).cast("long").alias("k"), line.alias("d")), "\n"
    for _ in range(levels):
        df = df.groupBy("part", F.floor(F.col("k") / fan).alias("k")).agg(_digest(glue).alias("d"))
        glue = ""
    return df.groupBy("part").agg(_digest("").alias("digest"))


def _digest(glue: str) -> Column:
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "d"))), lambda r: r["d"]), glue), 256)


def work_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors (spark.checkpoint.dir); on a local master without one a new temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (path or tempfile.mkdtemp(prefix="spark-work-")).rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read again: what follows doesn't compute it anew, and a lost executor loses none of it."""
    path = f"{work_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append_log(rows: DataFrame, path: str, order: list[str]) -> None:
    """Appends rows to a Parquet log with ids that go on from its largest; one writer at a time."""
    spark = rows.sparkSession
    try:
        last = spark.read.parquet(path).agg(F.max("trial_id")).first()[0] or 0
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
            raise
        last = 0
    place = F.row_number().over(Window.orderBy(*order))  # a batch of log rows
    rows.withColumn("trial_id", (place + last).cast("long")).withColumn("logged_at", F.current_timestamp()).write.mode("append").parquet(path)


def write_once(df: DataFrame, path: str) -> None:
    """Writes JSON rows to a path that must not exist: the second evaluation of a held-out period fails."""
    df.write.mode("errorifexists").json(path)
