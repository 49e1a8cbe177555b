"""Hard negatives against a plain sort of all rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import negatives as ng

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, chosen, k_pos=5, k_neg=10):
    good = []
    for i, v, y in rows:
        if i is None or v is None or y is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        good.append((i, [math.floor(256 * float(x)) for x in v], y))
    dot = lambda a, b: sum(x * z for x, z in zip(a, b))
    out = []
    for a in {(i, tuple(v), y) for i, v, y in good if chosen(i)}:
        scored = sorted((-dot(a[1], v), i, y) for i, v, y in good if i != a[0])
        for s, p, _ in [r for r in scored if r[2] == a[2]][:k_pos]:
            fit = [(n, i) for n, i, y in scored if y != a[2] and 30 * -s <= 100 * -n <= 90 * -s][:k_neg]
            out += [(a[0], p, rank, i, -s, -n) for rank, (n, i) in enumerate(fit, 1)]
    return sorted(out)


def mined(df, chosen, **k):
    rows = ng.prepared(df)
    return sorted(tuple(r) for r in ng.mine(rows, rows.where(chosen), **k).collect())


def vectors(n, dim=8, labels=3, seed=0):
    rng = random.Random(seed)
    return [(i, [round(rng.gauss(0.1, 0.5), 3) for _ in range(dim)], rng.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_mining_equals_brute_force(spark, monkeypatch, seed):
    """With few buckets, so that windows are refined, and few anchors a pass."""
    monkeypatch.setattr(ng, "BUCKETS", 8)
    monkeypatch.setattr(ng, "ENOUGH", 12)
    monkeypatch.setattr(ng, "ROWS", 50)
    monkeypatch.setattr(ng, "ANCHORS", 7)
    rows = vectors(400, seed=seed)
    got = mined(spark.createDataFrame(rows, SCHEMA).repartition(5), "id % 20 = 0")
    assert got == brute(rows, lambda i: i % 20 == 0) and len(got) > 300


def test_a_very_common_vector_and_ties(spark):
    rows = vectors(90, seed=3) + [(i, [0.5] * 8, i % 2) for i in range(90, 390)]
    got = mined(spark.createDataFrame(rows, SCHEMA).repartition(6), "id % 30 = 0")
    assert got == brute(rows, lambda i: i % 30 == 0)


def test_nulls_odd_lengths_repeats_and_large_numbers(spark):
    rows = vectors(60, seed=4) + [(61, None, 1), (62, [1.0, None], 1), (63, [float("nan")] * 8, 1), (64, [float("inf")] * 8, 1), (65, [1.0] * 8, None), (None, [1.0] * 8, 1), (66, [], 1), (67, [2.0], 0)]
    rows += [(68, [1e6] * 8, 0), (69, [1e6] * 7 + [-1e6], 1), (40, rows[40][1], rows[40][2]), (41, rows[41][1], rows[41][2])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", id string, w int")
    assert mined(df, "id % 10 = 0 or id > 65") == brute(rows, lambda i: i % 10 == 0 or i > 65)
    with pytest.raises(ValueError):
        mined(spark.createDataFrame([(0, [1e15], 0), (1, [1e15], 0)], SCHEMA), "id = 0")


def test_too_few_rows(spark):
    df = spark.createDataFrame(vectors(30, labels=1), SCHEMA)
    assert mined(df, "id = 0") == [] and mined(df.where(F.lit(False)), "id = 0") == [] and mined(df, "id = 77") == []
    few = vectors(6, labels=2, seed=5)
    assert mined(spark.createDataFrame(few, SCHEMA), "id < 3") == brute(few, lambda i: i < 3)
