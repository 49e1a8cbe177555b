import gzip
import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import warc

SCHEMA = "page_id long, url string, html string, record_type string"


def captures(spark, rows, path, **more):
    warc.write_warc(spark.createDataFrame(rows, SCHEMA), str(path), **more)
    return warc.read_warc(spark, str(path), payloads=True)


def test_round_trip_keeps_payloads(spark, tmp_path):
    tricky = "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nxyz\r\n\r\n" + "é" * 2000
    rows = [(1, "http://a.example/x?y", tricky, ""), (2, None, None, ""), (3, "http://b.example", "", ""), (None, "u", "short", "")]
    records = captures(spark, rows, tmp_path / "w", records_per_file=2).collect()
    payloads = sorted((r.payload or b"") for r in records if r.record_type == "response")
    assert payloads == sorted((r[2] or "").encode() for r in rows)
    assert len(records) == 12
    for r in records:
        if r.record_type == "response":
            assert r.payload_digest == hashlib.sha1(r.payload).hexdigest() and r.payload_bytes == len(r.payload)
    nested = warc.captures(warc.read_warc(spark, str(tmp_path / "w"))).collect()
    assert len(nested) == 4
    assert all(c.response and c.request and c.metadata for c in nested)
    assert sorted(c.metadata.fields.get("page-id", "") for c in nested) == ["", "1", "2", "3"]


def test_revisits_refer_to_the_largest_id(spark, tmp_path):
    big = "x" * 1000
    rows = [(i, f"http://h/{i}", big, "") for i in (5, 9, 7)] + [(20, "http://h/20", "x" * 999, ""), (21, "http://h/21", "x" * 999, ""), (9, "http://h/9", big, "")]
    nested = warc.captures(captures(spark, rows, tmp_path / "w")).collect()
    got = sorted((int(c.metadata.fields["page-id"]), c.response.record_type, c.response.payload_bytes) for c in nested)
    assert got == [(5, "revisit", 1000), (7, "revisit", 1000), (9, "response", 1000), (9, "response", 1000), (20, "response", 999), (21, "response", 999)]
    first = {c.capture_id for c in nested if c.metadata.fields["page-id"] == "9"}
    assert {c.refers_to_record for c in nested if c.response.record_type == "revisit"} == first


def test_empty_table_and_broken_records(spark, tmp_path):
    warc.write_warc(spark.createDataFrame([], SCHEMA), str(tmp_path / "w"))
    assert warc.captures(warc.read_warc(spark, str(tmp_path / "w"))).count() == 0
    with pytest.raises(ValueError):
        list(warc.records_of(io.BytesIO(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc")))
    with pytest.raises(ValueError):
        list(warc.records_of(io.BytesIO(b"HTTP/1.1 200 OK\r\n")))


def test_files_are_plain_warc(spark, tmp_path):
    captures(spark, [(1, "http://a", "hi", "")], tmp_path / "w")
    data = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").glob("*.gz"))
    assert data.count(b"WARC/1.1\r\n") == 3 and data.endswith(b"\r\n\r\n")
    assert b"WARC-Concurrent-To: <urn:uuid:" in data


def record(kind, name, *near, refers=None):
    return (f"<{name}>" if name else None, kind, [f"<{x}>" for x in near] or None, None, None, refers, None, None, {"a": name or ""}, None)


def brute_captures(rows):
    """The sets of record ids that names of either direction connect; nameless records by themselves."""
    ids = {r[0] for r in rows if r[0]}
    near = {i: {i} for i in ids | {x for r in rows for x in r[2] or []}}
    for r in rows:
        for x in r[2] or []:
            near[r[0]].add(x)
            near[x].add(r[0])
    out = set()
    for i in ids:
        seen, todo = set(), [i]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += near[x]
        out.add(frozenset(seen & ids))
    return out


def members(c):
    return frozenset(r.record_id for k in ("responses", "requests", "metadatas", "others") for r in c[k])


def test_chains_and_several_records_of_a_kind(spark):
    rows = [
        record("response", "r1"), record("request", "q1", "r1"), record("metadata", "m1", "r1"), record("metadata", "m2", "r1"),
        record("request", "q2"), record("response", "r2", "q2"), record("metadata", "m3", "r2"), record("metadata", "m4", "m3"),
        record("revisit", "v1", refers="<r1>"), record("metadata", "m5", "v1", "q5"), record("request", "q5"),
        record("metadata", "m6", "gone"), record("request", "q6", "gone"), record("warcinfo", "w"), record("metadata", "m7", "m7"),
        record("response", "r1"), record("metadata", "m1", "r1"),
    ]
    found = warc.captures(spark.createDataFrame(rows, warc.RECORD).repartition(3)).collect()
    assert sorted(map(members, found), key=sorted) == sorted([*brute_captures(rows), frozenset(["<r1>", "<q1>", "<m1>", "<m2>"])], key=sorted)
    by = {c.capture_id: c for c in found}
    assert [m.record_id for m in by["<r1>"].metadatas] == ["<m1>", "<m2>"] and by["<r1>"].metadata.record_id == "<m1>"
    assert by["<r2>"].request.record_id == "<q2>" and [m.record_id for m in by["<r2>"].metadatas] == ["<m3>", "<m4>"]
    assert by["<v1>"].refers_to_record == "<r1>" and by["<m6>"].response is None and by["<w>"].others[0].record_type == "warcinfo"


def test_random_names_match_brute_force(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(150):
        near = rnd.sample(range(170), rnd.choice([0, 1, 1, 1, 2])) if rnd.random() < 0.6 else []
        rows.append(record(rnd.choice(["response", "revisit", "request", "metadata", "metadata"]), f"{i:03}", *(f"{x:03}" for x in near)))
    rows += [record("metadata", None), record("request", None)]
    found = warc.captures(spark.createDataFrame(rows, warc.RECORD).repartition(5)).collect()
    assert {members(c) for c in found} - {frozenset([None])} == brute_captures(rows) and len(found) == len(brute_captures(rows)) + 2


def test_repeated_headers_and_long_pages(spark, tmp_path):
    head = "WARC/1.1\r\nWARC-Type: metadata\r\nWARC-Record-ID: <m>\r\nWARC-Concurrent-To: <a>\r\nWARC-Concurrent-To: <b>\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    (tmp_path / "x.gz").write_bytes(gzip.compress(head.encode()) * 2)
    assert [r.concurrent_to for r in warc.read_warc(spark, str(tmp_path)).collect()] == [["<a>", "<b>"]] * 2
    df = spark.createDataFrame([(1, "http://h", "x" * 5_000_000, "a"), (2, "http://g", "y", None)], SCHEMA).withColumns({"key": F.lit(1), "first": F.lit("z"), "digest": F.lit("d")})
    warc.write_warc(df, str(tmp_path / "w"))
    got = {c.metadata.fields["page-id"]: c.response.payload_bytes for c in warc.captures(warc.read_warc(spark, str(tmp_path / "w"))).collect()}
    assert got == {"1": 5_000_000, "2": 1}
