"""Near copies with edits, against brute force over all pairs."""

import random

import corpus_pipeline as cp
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.llm import nearcopies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_sets(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar(a, b):
    return a == b or len(a & b) / len(a | b) >= 0.8


def edited(rnd, words, n):
    out = list(words)
    for at in rnd.sample(range(len(out)), n):
        out[at] = f"e{rnd.randrange(10**6)}"
    return out


def test_edited_copies_go(spark):
    rnd = random.Random(3)
    new = lambda n: [f"w{rnd.randrange(5000)}" for _ in range(n)]
    texts = []
    for n, k in ((200, 2), (400, 8), (1000, 20), (1000, 5), (100, 40), (30, 0), (4, 0), (4, 1)) * 6:
        w = new(n)
        texts += [" ".join(w), " ".join(edited(rnd, w, k)).upper()]
    hub = new(300)
    texts += [" ".join(edited(rnd, hub, 1)) for _ in range(150)] + [None, "", " \n"]  # a bucket of over DIRECT sets
    sets = [brute_sets(t) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        if label[i] == i:
            todo = [i]
            while todo:
                x = todo.pop()
                more = [j for j in range(i + 1, len(texts)) if label[j] == j and j != i and similar(sets[x], sets[j])]
                for j in more:
                    label[j] = i
                todo += more
    want = [i for i in range(len(texts)) if label[i] == i]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    assert sorted(r.doc_id for r in cp.near_dedup(spark, docs, "").collect()) == want
    assert 40 < len(want) < 80


def brute_label(sets):
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if label[i] != label[j] and similar(sets[i], sets[j]):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def test_leaders_reach_what_all_pairs_reach(spark):
    """Every bucket counts as large: chains of copies that are like their neighbours only, round a text that many share."""
    rnd = random.Random(8)
    texts, words = [], [f"w{rnd.randrange(5000)}" for _ in range(120)]
    for _ in range(60):  # each text is an edit of the one before: the ends of the chain are no longer alike
        words = edited(rnd, words, 2)
        texts.append(" ".join(words))
    common = [f"c{i}" for i in range(150)]
    for _ in range(40):  # shared passages, too short a part for a link
        texts.append(" ".join(common + [f"v{rnd.randrange(10**6)}" for _ in range(60)]))
    sets = [brute_sets(t) for t in texts]
    label = brute_label(sets)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"), nearcopies.sketches(F.col("text")).alias("s")).select("doc_id", "text", "text_hash", "s.*")
    found = nearcopies.links(rows, docs.select("text", F.xxhash64("text").alias("text_hash")), direct=1, leaders=2)
    number = {r["set"]: r["doc_id"] for r in rows.collect()}
    pairs = [(number[r["a"]], number[r["b"]]) for r in found.collect()]
    assert all(similar(sets[a], sets[b]) for a, b in pairs)
    got = list(range(len(texts)))
    for a, b in pairs:
        old, new = max(got[a], got[b]), min(got[a], got[b])
        got = [new if x == old else x for x in got]
    assert got == label and len(set(label)) > 40


def test_pairs_in_blocks():
    rnd = np.random.default_rng(4)
    raws = [np.unique(rnd.integers(0, 1 << 60, 200, dtype=np.uint64)) for _ in range(3)]
    raws = [raws[0], raws[0][:190], raws[0][:180], raws[1], raws[2], raws[2]]
    rows = pa.array([{"set": i, "comp": c, "sig": nearcopies.sketch(r)[2], "raw": r.tobytes()} for i, (c, r) in enumerate(zip((0, 0, 1, 2, 3, 4), raws))])
    assert nearcopies.likely(rows) == [(0, 1), (0, 2), (1, 2), (4, 5)]
    assert nearcopies.joining(rows.slice(0, 2), rows) == [(0, 2)]  # one link joins components 0 and 1
    assert nearcopies.joining(rows.slice(5, 1), rows) == [(5, 4)] and nearcopies.joining(rows.slice(3, 1), rows) == []


def test_copies_repeats_and_empty_tables(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (2, "A  b c d\ne f", None), (None, None, None), (3, "", ""), (4, "q" * 100_000 + " r", ""), (5, " ".join(["long"] * 200_000), "")]
    got = nearcopies.near_copies(spark.createDataFrame(rows, "doc_id long, text string, set string")).collect()
    by = {}
    for r in got:
        by.setdefault(r["class"], []).append(r.doc_id)
    assert sorted(map(str, by.values())) == sorted(map(str, [[1, 1, 2], [None, 3], [4], [5]])) or len(by) == 4 and len(got) == len(rows)
    assert nearcopies.near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_fingerprints_of_sets():
    rnd = np.random.default_rng(9)
    for n in (0, 1, 7, 5000):
        found = np.unique(rnd.integers(0, 1 << 63, n, dtype=np.uint64))
        for j, got in enumerate(nearcopies.fingerprint(found)):
            tops = [int(h) * int(nearcopies._SPREAD[j]) % 2**64 >> 24 for h in found]
            assert got == sum(1 << i for i in range(40) if 2 * sum(t >> i & 1 for t in tops) > len(tops)) + (j << 40)


def test_covering_finds_every_near_block(spark):
    """Candidates are pairs with a block within two bits, and connect all such pairs, but no set has many in a large group."""
    rnd = random.Random(12)
    texts = []
    for n, k in ((200, 1), (300, 3), (300, 6), (80, 60)) * 10:
        w = [f"w{rnd.randrange(5000)}" for _ in range(n)]
        texts += [" ".join(w), " ".join(edited(rnd, w, k))]
    hub = [f"w{rnd.randrange(5000)}" for _ in range(400)]
    texts += [" ".join(edited(rnd, hub, 1)) for _ in range(100)]  # buckets of over 64 blocks, and equal blocks
    found = [nearcopies.sketch(nearcopies.shingles(t.encode())) for t in texts]
    sets = spark.createDataFrame([(s, prints) for s, _, _, prints in found], "set long, prints array<long>")
    pairs = {(r.a, r.b) for r in nearcopies.covered_pairs(sets).collect()}
    by = {s: prints for s, _, _, prints in found}
    close = lambda a, b: min((x ^ y).bit_count() for x, y in zip(by[a], by[b])) <= 2
    label = {s: s for s in by}
    for a, b in pairs:
        old, new = max(label[a], label[b]), min(label[a], label[b])
        label = {s: new if x == old else x for s, x in label.items()}
    near = {(a, b) for a in by for b in by if a < b and close(a, b)}
    assert pairs <= near and all(label[a] == label[b] for a, b in near) and len(near) > 1000
    assert len(pairs) <= 56 * len(by)


def test_near_dedup_takes_candidates_from_covering(spark, monkeypatch):
    """Without MinHash candidates, covering and the exact check alone link the lightly edited copies, and nothing else."""
    rnd = random.Random(13)
    monkeypatch.setattr(nearcopies, "first_pairs", lambda buckets, sets, direct: nearcopies.covered_pairs(sets).where("false"))
    texts = []
    for _ in range(40):
        w = [f"w{rnd.randrange(5000)}" for _ in range(400)]
        texts += [" ".join(w), " ".join(edited(rnd, w, 2))]  # similarity 0.95
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    kept = [r.doc_id for r in cp.near_dedup(spark, docs, "").collect()]
    assert 40 <= len(kept) <= 44 and set(range(0, 80, 2)) <= set(kept)


def test_components_come_from_new_links_only(spark, monkeypatch):
    """Rounds that add links meet components that these join, rounds without links find none, and no link is gone through twice."""
    rnd, seen = random.Random(14), []

    def counted(edges, a, b, run=nearcopies.connected_components):
        seen.append({tuple(sorted(e)) for e in edges.select(a, b).collect() if e[0] != e[1]})
        return run(edges, a, b)

    monkeypatch.setattr(nearcopies, "connected_components", counted)
    texts = []
    for k in (2, 2, 8, 20):  # near by fingerprint, and beyond
        w = [f"w{rnd.randrange(5000)}" for _ in range(400)]
        texts += [" ".join(edited(rnd, w, k)) for _ in range(6)]
    common = [f"c{i}" for i in range(150)]
    texts += [" ".join(common + [f"v{rnd.randrange(10**6)}" for _ in range(60)]) for _ in range(80)]  # large buckets without links
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["class"] for r in nearcopies.near_copies(docs).collect()}
    label = brute_label([brute_sets(t) for t in texts])
    assert len({(got[i], label[i]) for i in got}) == len(set(got.values())) == len(set(label))
    assert seen and all(seen) and sum(map(len, seen)) == len(set().union(*seen))
