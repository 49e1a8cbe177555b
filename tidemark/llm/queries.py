"""The registered queries of this package and, where DuckDB can express them, their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, html, langid, licenses, mixing, multiset, negatives, oracles, packing, quality, secrets, simhash, toxicity, warc
from .common import shared_dir, small_batches, staged, table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_print(F.col("fp")).alias("fingerprint"), "component_id")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    found = warc.captures(warc.read_warc(spark, path)).select(
        F.col("metadata.fields")["page-id"].cast("long").alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"), F.col("response.record_type").alias("record_type"), "capture_id", "refers_to_record",
    )
    found = staged(found, "warc-captures")
    first = found.where("record_type = 'response'").select(F.col("capture_id").alias("first"), F.col("page_id").alias("refers_to"))
    first = staged(first.distinct(), "warc-responses")  # a plain exchange in the join: a response with many revisits is split
    again = found.where("refers_to_record is not null").join(first, F.col("refers_to_record") == F.col("first"), "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    alone = found.where("refers_to_record is null").select(*columns, F.lit(None).cast("long").alias("refers_to"))
    return alone.union(again.select(*columns, "refers_to"))


OP2_SQL = """
with p as (select page_id, strlen(coalesce(html, '')) as n, sha1(coalesce(html, '')) as d from pages),
q as (select *, max(page_id) over (partition by d) as last from p)
select page_id, n as payload_bytes, d as payload_digest,
       case when n >= 1000 and page_id <> last then 'revisit' else 'response' end as record_type,
       case when n >= 1000 and page_id <> last then last end as refers_to
from q
"""


def op3_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset.edited(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
                  ('0x' || substr(md5('mix-1|' || doc_id), 1, 15))::bigint as h from documents),
s as (select source, sum(size)::bigint as ss, row_number() over (order by source nulls last) - 1 as r from d group by source),
w as (select *, (case r % 3 when 0 then 3 when 1 then 1 else 2 end)::double as w from s),
o as (select *, 1.5::double * (sum(ss) over ())::double as b,
             coalesce(sum(2 * ss) over (order by 2 * ss / w, r rows between unbounded preceding and 1 preceding), 0) as kept,
             sum(w) over (order by 2 * ss / w, r rows between current row and unbounded following) as free from w),
l as (select max((b - kept) / free) filter (where (b - kept) / free <= 2 * ss / w) as level from o),
t as (select source, ss, r, round(least(w * level, (2 * ss)::double), 6) as target from w, l),
f as (select d.*, t.ss, t.r, t.target, sum(size) over (partition by t.r order by h, doc_id rows unbounded preceding) as cum
      from d join t on d.source is not distinct from t.source),
e as (select *, (cum + p * ss) / target as fin from f, (values (0), (1)) v(p) where size > 0),
c as (select *, coalesce(sum(size) over (order by fin, r, h, p rows between unbounded preceding and 1 preceding), 0) as ahead from e),
g as (select doc_id, sum(greatest(0, least(size, (select (sum(size) * 3) // 2 from d) - ahead))) as taken from c group by doc_id)
select f.doc_id, f.size::bigint as size, f.ss as source_size, f.target, coalesce(g.taken, 0)::bigint as taken
from f left join g on f.doc_id = g.doc_id
"""


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(langid.fold() != 2))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(langid.fold() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "entropy", "rejected")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = table(spark, sf_dir, "documents").select("doc_id", secrets.secret_spans(F.col("text")).alias("found"))
    base = F.filter("found", lambda s: s["via"] == "")
    kinds = F.transform(base, lambda s: s["kind"])
    count = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in secrets.KINDS]
    return found.select("doc_id", *count, F.sha2(secrets.span_text(base), 256).alias("base_sha256"), secrets.span_text(F.col("found")).alias("spans"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in ("char_distance", "word_distance")})


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    pages = table(spark, sf_dir, "pages").select("page_id", "url", html.extract(F.col("html")).alias("text"))
    return pages.select("*", F.length("text").cast("long").alias("n_chars"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(toxicity.labelled(docs.where(langid.fold() != 2), labels))
    found = toxicity.score(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(langid.fold() == 2, F.lit(False)).alias("held_out"), "score", "predicted", "n_abuse", "n_quoted")


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    rows = negatives.prepared(rows)
    return negatives.mine(rows, rows.where("id % 100 = 0"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_warc": op2_warc,
    "op3_multiset": op3_multiset,
    "op4_mixing": op4_mixing,
    "op5_licenses": op5_licenses,
    "op6_language": op6_language,
    "op7_secrets": op7_secrets,
    "op8_packing": op8_packing,
    "op9_quality": op9_quality,
    "op10_html": op10_html,
    "op11_divergence": op11_divergence,
    "op12_toxicity": op12_toxicity,
    "op13_negatives": op13_negatives,
}
ORACLES: dict[str, str] = {"op2_warc": OP2_SQL, "op4_mixing": OP4_SQL, "op5_licenses": oracles.licenses(), "op9_quality": oracles.quality(), "op11_divergence": oracles.divergence(), "op13_negatives": oracles.negatives()}
