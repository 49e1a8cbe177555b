import random

import xxhash
from pyspark.sql import functions as F

from tidemark.llm import simhash
from tidemark.llm.components import connected_components

SCHEMA = "doc_id long, text string, fp string, component_id string"


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def brute_classes(prints):
    label = {}
    for start in sorted(prints, key=lambda x: x[0]):
        if start[0] in label:
            continue
        todo = [start]
        label[start[0]] = start[0]
        while todo:
            at = todo.pop()
            for other in prints:
                if other[0] not in label and (at[1] ^ other[1]).bit_count() <= 2:
                    label[other[0]] = start[0]
                    todo.append(other)
    return label


def test_prints_and_classes_match_brute_force(spark):
    rnd = random.Random(1)
    words = [f"w{i}" for i in range(50)] + ["É", " x", "A\x1cb"]
    texts = [" ".join(rnd.choices(words, k=rnd.choice([0, 1, 2, 3, 5, 40, 200]))) for _ in range(120)]
    texts += [t.replace("w3", "W3") for t in texts[:20]] + [t + " tail" for t in texts[20:60]] + [None, "", " \t\n"]
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    prints = [(i, brute_print(t)) for i, t in enumerate(texts)]
    label = brute_classes(prints)
    assert len(got) == len(rows)
    for i, fp in prints:
        assert got[i].fp & (2**64 - 1) == fp
        assert got[i].component_id == label[i]


def test_large_buckets_are_exact(spark):
    rnd = random.Random(2)
    base = [rnd.getrandbits(64) for _ in range(3)]
    prints = set(base)
    for _ in range(900):  # chains of near fingerprints around few centres fill buckets
        prints.add(rnd.choice([*base, *list(prints)[-5:]]) ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)))
    prints = sorted(prints)
    df = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    edges = simhash.links(df, "fp", direct=4)
    found = {r.node: r.component for r in connected_components(edges, "a", "b").collect()}
    label = brute_classes([(i, p) for i, p in enumerate(prints)])
    classes, want = {}, {}
    for i, p in enumerate(prints):
        classes.setdefault(found.get(simhash._signed(p), simhash._signed(p)), set()).add(i)
        want.setdefault(label[i], set()).add(i)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, want.values()))


def test_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c d", "", ""), (3, "a b c d", "", ""), (3, "a b c d", "", ""), (None, None, "", "")], SCHEMA)
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in simhash.near_duplicates(df).collect())
    assert got == [(-1, -1), (-1, 3), (3, 3), (3, 3)]
    assert simhash.near_duplicates(df.where("false")).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 1)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}


def test_covering_never_misses_two_bits():
    for mask_set in (simhash.covering(list(range(64))), simhash.covering(list(range(27)))):
        n = max(m.bit_length() for m in mask_set)
        for i in range(n):
            for j in range(i + 1):
                assert any(not m >> i & 1 and not m >> j & 1 for m in mask_set)
