"""A corpus in five steps: language ID, near-dedup, secret scan, mixing, packing. Each stage gets what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import langid, mixing, nearcopies, packing, secrets
from tidemark.llm.common import WORD, small_batches, staged, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that language ID rejects: no letters, or a text that fits no learned language.

    The model is fitted on the same documents, those whose crc32(doc_id) mod 4 isn't 2.
    """
    model = langid.train(docs.where(langid.fold() != 2))
    return langid.predict(docs.select(COLUMNS), model).where("not rejected").select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate class: that of the smallest doc_id, then of the smallest text hash.

    Near duplicates are texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, and what such
    links lead to. Null doc_ids come last; rows repeated in full are one document.
    """
    classes = staged(nearcopies.near_copies(docs), "dedup-classes")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    keep = classes.groupBy("class").agg(F.min(order).alias("k")).select(F.col("k.doc_id").alias("id"), F.col("k.text_hash").alias("hash"))
    kept = docs.select(COLUMNS).join(keep, docs["doc_id"].eqNullSafe(keep["id"]) & (F.xxhash64(docs["text"]) == keep["hash"]), "left_semi")
    if classes.groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty():
        return kept
    return kept.withColumn("h", F.xxhash64("text")).dropDuplicates(["doc_id", "h"]).drop("h")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark in place of each secret and sets n_chars anew; a null text stays null and has no n_chars."""
    small_batches(spark)
    clean = docs.select(COLUMNS).withColumn("text", secrets.redact(F.col("text")))
    return clean.withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes it, leaves out what it doesn't take, and cuts the one at the budget's end.

    Rows repeated in full share what the mix takes of them evenly, in whole words.
    """
    keyed = docs.select(COLUMNS).withColumn("hash", F.xxhash64("text"))
    taken = mixing.mix(keyed, keep=("hash",)).groupBy("doc_id", "keep_hash").agg(F.expr("sum(taken) div count(*)").alias("taken"), F.max("size").alias("size"))
    taken = taken.where("taken > 0").withColumnRenamed("doc_id", "id")
    rows = keyed.join(taken, keyed["doc_id"].eqNullSafe(taken["id"]) & (keyed["hash"] == taken["keep_hash"]))
    rest = F.expr("cast(taken % size as int)")
    cut = F.concat_ws(" ", F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), 1, F.greatest(rest, F.lit(1))))
    texts = F.concat(F.expr("array_repeat(text, cast(taken div size as int))"), F.when(rest > 0, F.array(cut)).otherwise(F.array().cast("array<string>")))
    rows = rows.select("doc_id", F.explode_outer(texts).alias("text"), "lang", "source")
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents."""
    return packing.pack(docs)


STAGES = [("language", language), ("near_dedup", near_dedup), ("secrets", secret_scan), ("mixing", mix_sources), ("packing", pack)]
#: Fingerprints, language models and token ids can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
