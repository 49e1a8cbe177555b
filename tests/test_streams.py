"""Streams that mature labels, and recursions in order of time."""

import datetime as dt
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import exprs
from tidemark.operators import labels
from tidemark.streaming import maturity, ordered, stream_bars

DAY = dt.datetime(2020, 1, 1)
PRICE = "code string, pos long, ts timestamp, open double"


def put(spark, rows, schema, folder, k):
    """One file in a folder, newer than those before it."""
    path = f"{folder}/part-{k:03d}.parquet"
    pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")]).to_parquet(path, coerce_timestamps="us", index=False)
    os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))


def run(stream, path, k):
    """All that the stream gives for the files there now; its state goes on in the next call."""
    got = []
    q = stream.writeStream.foreachBatch(lambda df, _: got.extend(df.collect())).outputMode("append").option("checkpointLocation", str(path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return got, q.lastProgress


def test_labels_mature_when_their_prices_come(spark, tmp_path):
    """Files of ten days each: a label comes with its sale's price, equals the batch, late and open ones are withheld, and state expires."""
    random.seed(1)
    prices = [(c, i, DAY + dt.timedelta(days=i), None if (c, i) == ("A", 17) else 0.0 if (c, i) == ("B", 12) else 100 + random.random()) for i in range(120) for c in "AB"]
    folder = tmp_path / "in"
    folder.mkdir()
    stream = lambda: maturity.read_prices(spark, str(folder), 1)
    found, sizes = [], []
    for k in range(12):
        put(spark, [p for p in prices if p[1] // 10 == k], PRICE, folder, k)
        got, progress = run(maturity.mature_labels(stream(), stream(), 3, "5 days", "8 days"), tmp_path, k)
        assert all(r.pos + 4 <= 10 * k + 9 for r in got)
        found += got
        sizes.append(sum(s.numRowsTotal for s in progress.stateOperators))
    rows = spark.createDataFrame([(c, t.date(), o, i) for c, i, t, o in prices], "code string, dt date, open double, pos long")
    want = {(r.code, r.pos): r.L1_3 for r in labels.forward_returns(rows, (3,)).collect() if r.sell_dt_3}
    assert {(r.code, r.pos): r.label for r in found} == want and len(found) == len(want) and want["A", 16] is None and want["B", 11] is None
    assert max(sizes[4:]) <= max(sizes[:4]) * 1.5 and sizes[-1] < 240
    put(spark, [("A", 2, DAY + dt.timedelta(days=2), 1.0), ("A", 500, DAY + dt.timedelta(days=500), 1.0)], PRICE, folder, 20)
    put(spark, [("A", 501, DAY + dt.timedelta(days=501), 1.0)], PRICE, folder, 21)  # late is what is behind the watermark of the batch before
    put(spark, [("A", 117, DAY + dt.timedelta(days=117), 1.0), ("A", 121, DAY + dt.timedelta(days=121), 1.0)], PRICE, folder, 22)
    assert run(maturity.mature_labels(stream(), stream(), 3, "5 days", "8 days"), tmp_path, 22)[0] == []


ROWS = "code string, id long, ts timestamp, x double"


@pytest.mark.parametrize("seed", [1, 2])
def test_recursions_equal_the_batch_over_shuffled_files(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("abc"), i, DAY + dt.timedelta(minutes=i // 2), None if rng.random() < 0.1 else rng.gauss(0, 1)) for i in range(240)]
    folder = tmp_path / "in"
    folder.mkdir()
    moved = sorted(rows, key=lambda r: r[1] + rng.uniform(0, 30))  # at most a quarter of an hour out of order
    for k in range(6):
        put(spark, moved[40 * k : 40 * k + 40], ROWS, folder, k)
    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(str(folder))
    with ordered.rocksdb(spark):
        got, progress = run(ordered.recursions(stream, 0.3, "20 minutes"), tmp_path, 0)
    last = rows[-1][2] - dt.timedelta(minutes=20)
    batch = spark.createDataFrame([(c, t.isoformat() + f"-{i:04d}", i, t, x) for c, i, t, x in rows], "code string, dt string, id long, ts timestamp, x double")
    up = F.col("x") > exprs.lag("x")
    want = exprs.streak(exprs.ewm(batch, {"mean": ("x", 0.3, 1)}), up, "streak").where(F.col("ts") < F.lit(last)).collect()
    assert {(r.code, r.id) for r in got} == {(r.code, r.id) for r in want} and len(got) == len(want) > 150
    mine = {r.id: r for r in got}
    for r in want:
        m = mine[r.id]
        assert m.streak == r.streak and m.ts == r.ts and (m.mean is None and r.mean is None or abs(m.mean - r.mean) < 1e-12)
    assert [r.id for r in sorted((r for r in got if r.code == "a"), key=lambda r: (r.ts, r.id))] == [i for c, i, t, _ in rows if c == "a" and t < last]
    put(spark, [("a", 999, DAY, 5.0)], ROWS, folder, 9)  # far behind the watermark
    with ordered.rocksdb(spark):
        assert run(ordered.recursions(stream, 0.3, "20 minutes"), tmp_path, 1)[0] == []


def test_recursions_of_no_rows(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    put(spark, [], ROWS, folder, 0)
    stream = spark.readStream.schema(ROWS).parquet(str(folder))
    with ordered.rocksdb(spark):
        assert stream_bars.available_now(ordered.recursions(stream, 0.3, "1 hour"), str(tmp_path / "rows"), str(tmp_path / "state")).count() == 0
