"""WARC archives of pages: writing, reading, and assembling captures from concurrent records."""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged
from .components import connected_components

#: Records of one archive file; a file is read by one task, so this bounds what a task holds.
RECORDS_PER_FILE = 8192
#: Repeated payloads up to this many are broadcast (about 200 bytes each); beyond, the join is shuffled.
BROADCAST_ROWS = 50_000
NL = "\r\n"
#: The header that a record may have several times.
MANY = "warc-concurrent-to"

RECORD = (
    "record_id string, record_type string, concurrent_to array<string>, target_uri string, warc_date string, refers_to string, "
    "payload_bytes long, payload_digest string, fields map<string,string>, payload binary"
)


def _record_id(kind: str, *parts: Column) -> Column:
    digest = F.md5(F.concat_ws("|", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("\\N")) for p in parts]))
    return F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")


def _line(name: str, value: Column) -> Column:
    """A header line; nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(NL)), F.lit(""))


def _record(kind: Column, record_id: Column, date: str, media: str, headers: list[Column], block: Column) -> Column:
    head = [F.lit("WARC/1.1" + NL), _line("WARC-Type", kind), _line("WARC-Record-ID", record_id), _line("WARC-Date", F.lit(date))]
    size = F.octet_length(block).cast("string")
    return F.concat(*head, *headers, _line("Content-Type", F.lit(media)), _line("Content-Length", size), F.lit(NL), block)


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = 1000, date: str = "1970-01-01T00:00:00Z", records_per_file: int = RECORDS_PER_FILE) -> None:
    """Writes a request, a response or revisit, and a metadata record for each row to gzipped WARC files under path.

    Of rows with equal payloads of at least min_revisit bytes those with the largest id are responses and the others
    revisits that refer to it. A null html is an empty payload, a null url leaves its header out, a null id is smaller than
    any other. Rows repeated in full get equal record ids and are told apart only by their number.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    uri = F.regexp_replace(F.col(url_col), r"[\x00-\x20]", "%20")
    rows = pages.select(F.col(id_col).alias("id"), uri.alias("uri"), html.alias("html"), F.sha1(html).alias("digest"), F.octet_length(html).cast("long").alias("n"))
    long = F.when(F.col("n") >= min_revisit, F.col("digest"))
    first = rows.select(long.alias("key"), F.struct("id", "uri").alias("who")).where("key is not null")
    first = staged(first.groupBy("key").agg(F.max("who").alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies"), "warc-firsts")
    if first.count() <= BROADCAST_ROWS:
        first = F.broadcast(first)
    rows = rows.join(first, (rows["digest"] == first["key"]) & (rows["n"] >= min_revisit), "left")
    again = F.col("key").isNotNull() & ~F.col("id").eqNullSafe(F.col("first.id"))
    kind = F.when(again, "revisit").otherwise("response")
    rid = {k: _record_id(k, F.col("id"), F.col("uri"), F.col("digest")) for k in ("capture", "request", "metadata")}
    rows = rows.select("*", kind.alias("kind"), *[c.alias(k) for k, c in rid.items()], F.when(again, _record_id("capture", F.col("first.id"), F.col("first.uri"), F.col("digest"))).alias("refers"))

    target, near = _line("WARC-Target-URI", F.col("uri")), _line("WARC-Concurrent-To", F.col("capture"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{NL}Content-Type: text/html; charset=utf-8{NL}Content-Length: "), F.col("n").cast("string"), F.lit(NL + NL))
    profile = F.when(F.col("kind") == "revisit", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    main = [target, _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), _line("WARC-Profile", profile), _line("WARC-Refers-To", F.col("refers"))]
    path_part = F.coalesce(F.nullif(F.regexp_replace("uri", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), F.lit("")), F.lit("/"))
    host = F.regexp_extract(F.coalesce("uri", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    ask = F.concat(F.lit("GET "), path_part, F.lit(f" HTTP/1.1{NL}Host: "), host, F.lit(NL + NL))
    about = F.concat(_line("page-id", F.col("id").cast("string")), F.lit(f"via: archive{NL}"))
    records = F.array(
        _record(F.lit("request"), F.col("request"), date, "application/http; msgtype=request", [target, near], ask),
        _record(F.col("kind"), F.col("capture"), date, "application/http; msgtype=response", main, F.concat(http, F.when(F.col("kind") == "response", F.col("html")).otherwise(""))),
        _record(F.lit("metadata"), F.col("metadata"), date, "application/warc-fields", [target, near], about),
    )
    out = rows.select(F.explode(records).alias("value"))
    out.write.option("lineSep", NL + NL).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def records_of(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record of an uncompressed stream, by its Content-Length.

    Values of a repeated WARC-Concurrent-To are joined by spaces; of another repeated header the last counts.
    """
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        fields: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8").partition(":")
            name, value = name.strip().lower(), value.strip()
            if name == MANY and name in fields:
                value = f"{fields[name]} {value}"
            fields[name] = value
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("a record ends early")
        yield fields, block


def _row(fields: dict[str, str], block: bytes, payloads: bool) -> dict:
    kind, payload, size, digest, more = fields.get("warc-type"), None, None, None, {}
    if kind in ("response", "revisit"):
        head, _, body = block.partition(b"\r\n\r\n")
        if kind == "response":
            payload, size, digest = body, len(body), hashlib.sha1(body).hexdigest()
            said = fields.get("warc-payload-digest", "").removeprefix("sha1:")
            if len(said) == 40 and said.lower() != digest:
                raise ValueError(f"{fields.get('warc-record-id')}: the payload's digest differs from its header's")
        else:
            digest = fields.get("warc-payload-digest", "").removeprefix("sha1:").lower() or None
            size = next((int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
    elif kind == "metadata":
        more = {k.strip(): v.strip() for k, s, v in (x.partition(":") for x in block.decode("utf-8").splitlines()) if s}
    elif kind == "request":
        more = {"request-line": block.split(b"\r\n", 1)[0].decode("utf-8", "replace")}
    names = ("warc-record-id", "warc-type", "warc-concurrent-to", "warc-target-uri", "warc-date", "warc-refers-to")
    keys = ("record_id", "record_type", "concurrent_to", "target_uri", "warc_date", "refers_to")
    return dict(zip(keys, map(fields.get, names))) | {"concurrent_to": fields.get(MANY, "").split(), "payload_bytes": size, "payload_digest": digest, "fields": list(more.items()), "payload": payload if payloads else None}


def read_warc(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """A row for each record of the .gz archives under path, with the columns of RECORD.

    payload_bytes and payload_digest (SHA-1, hex) are measured on the payload of a response, and taken from the headers of
    a revisit. A digest that differs from its header's or a truncated record is an error. payload is null unless asked for.
    concurrent_to is empty for a record without that header. Repeated records give a row each; empty archives none.
    """
    kind = pa.struct(
        [("record_id", pa.string()), ("record_type", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("target_uri", pa.string()), ("warc_date", pa.string()), ("refers_to", pa.string())]
        + [("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())]
    )

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for fields, block in records_of(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer())))):
                    rows.append(_row(fields, block, payloads))
                    if len(rows) == (256 if payloads else 4096):
                        yield pa.RecordBatch.from_struct_array(pa.array(rows, kind))
                        rows = []
                yield pa.RecordBatch.from_struct_array(pa.array(rows, kind))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(parse, RECORD)


def _rooted(records: DataFrame) -> DataFrame:
    """The distinct records with n (how often each occurs) and root: the response or revisit that a record names, else itself."""
    part = F.struct("record_id", "record_type", "target_uri", "warc_date", "payload_bytes", "payload_digest", "fields", "payload", "refers_to", "concurrent_to")
    order = F.struct("record_type", "target_uri", "warc_date", "payload_digest", "payload_bytes", "concurrent_to")
    nameless = F.concat(F.lit("no-id-"), F.md5(F.to_json(order)))
    rows = records.select(F.coalesce("record_id", nameless).alias("key"), part.alias("part"), order.alias("order"))
    rows = staged(rows.groupBy("key").agg(F.min_by("part", "order").alias("part"), F.count("*").alias("n")), "warc-records")
    main = F.coalesce(F.col("part.record_type").isin("response", "revisit"), F.lit(False))
    names = F.array_distinct(F.coalesce("part.concurrent_to", F.array().cast("array<string>")))
    sides = rows.where(~main).withColumn("to", F.when(F.size(names) == 1, names[0]).otherwise(F.col("key")))
    mains = rows.where(main)
    found = sides.join(mains.select(F.col("key").alias("main")), F.col("to") == F.col("main"), "left")
    rooted = mains.withColumn("root", F.col("key")).unionByName(found.select("key", "part", "n", F.coalesce("main", "key").alias("root")))
    return staged(rooted, "warc-rooted")


def _chained(rooted: DataFrame) -> DataFrame:
    """A row (root, label) for each root that other concurrent-to names connect with further ones; label is the same for all of a capture."""
    names = rooted.where((F.col("root") == F.col("key")) & (F.size("part.concurrent_to") > 0))
    links = names.select(F.col("root").alias("a"), F.explode(F.array_distinct("part.concurrent_to")).alias("to"))
    ends = rooted.select("key", F.col("root").alias("end"))
    links = links.join(ends, F.col("to") == F.col("key"), "left").select("a", F.coalesce("end", "to").alias("b")).where("a <> b")
    links = staged(links.distinct(), "warc-links")
    found = connected_components(links, "a", "b")
    return staged(found.select(F.col("node").alias("root"), F.col("component").alias("label")), "warc-labels")


def captures(records: DataFrame) -> DataFrame:
    """One nested row for each capture: capture_id, response (or revisit), request, metadata, refers_to_record, and all of each kind.

    Records are joined to the responses and revisits that they name as concurrent. What that leaves (chains, several names, a
    response that names its request, names of records that aren't there) is connected transitively in either direction.
    response, request and metadata are the records with the smallest id of their kind and null if there are none; responses,
    requests, metadatas and others are arrays of all, in that order. capture_id is the response's id, else the smallest.
    Records with one id are taken as one; a response that occurs n times makes n equal rows. No records give no rows.
    """
    rooted = _rooted(records)
    labels = _chained(rooted)
    label = F.lit(None).cast("string")
    if not labels.isEmpty():
        rooted, label = rooted.join(labels, "root", "left"), F.col("label")
    by_id = lambda x, y: F.when(x["record_id"] < y["record_id"], -1).when(x["record_id"] > y["record_id"], 1).otherwise(0)
    kind = F.coalesce(F.col("part.record_type"), F.lit(""))
    of = lambda test: F.array_sort(F.collect_list(F.when(test, F.col("part"))), by_id)
    main = kind.isin("response", "revisit")
    grouped = rooted.groupBy(F.coalesce(label, "root").alias("label")).agg(
        of(main).alias("responses"), of(kind == "request").alias("requests"), of(kind == "metadata").alias("metadatas"), of(~main & ~kind.isin("request", "metadata")).alias("others"),
        F.min("key").alias("least"), F.greatest(F.max(F.when(main, F.col("n"))), F.lit(1)).alias("n"),
    )
    first = {c: F.get(F.col(f"{c}s"), F.lit(0)) for c in ("response", "request", "metadata")}
    grouped = grouped.withColumns(first).withColumns({"capture_id": F.coalesce("response.record_id", "least"), "refers_to_record": F.col("response.refers_to")})
    grouped = grouped.select("capture_id", "response", "request", "metadata", "refers_to_record", "n", "responses", "requests", "metadatas", "others")
    return grouped.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("n")
