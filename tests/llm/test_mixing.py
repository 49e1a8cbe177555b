import hashlib
import random

from tidemark.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, target string"


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    budget, capped = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        left = budget - sum(capped.values())
        target = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if target[s] > 2 * sizes[s]]
        if not over:
            return {s: capped.get(s, target.get(s)) for s in names}, {s: i for i, s in enumerate(names)}
        capped |= {s: 2 * sizes[s] for s in over}


def brute_mix(rows):
    size = {r[0]: len((r[1] or "").encode().split()) for r in rows}
    source = {r[0]: r[2] for r in rows}
    sizes = {s: sum(size[d] for d in size if source[d] == s) for s in set(source.values())}
    target, rank = brute_targets(sizes)
    entries = []
    for s in sizes:
        h = lambda d: int(hashlib.md5(f"mix-1|{d}".encode()).hexdigest()[:15], 16)
        at = 0
        for d in sorted((d for d in size if source[d] == s), key=lambda d: (h(d), d)):
            at += size[d]
            for p in (0, 1):
                if size[d]:
                    entries.append(((at + p * sizes[s]) / round(target[s], 6), rank[s], h(d), p, d))
    left, taken = int(1.5 * sum(sizes.values())), dict.fromkeys(size, 0)
    for *_, d in sorted(entries):
        taken[d] += min(size[d], left)
        left -= min(size[d], left)
    return {d: (size[d], sizes[source[d]], round(target[source[d]], 6), taken[d]) for d in size}


def test_matches_brute_force(spark):
    rnd = random.Random(3)
    for n, k in ((60, 5), (200, 9)):
        names = [f"s{i}" for i in range(k)] + [None, "é", "Z"]
        weights = [30] + [1] * (k + 2)
        rows = [(i, rnd.choice([None, "", " a", "a b\tc\n" * rnd.randint(1, 30)]), rnd.choices(names, weights)[0], "", "") for i in range(n)]
        got = {r.doc_id: (r["size"], r.source_size, r.target, r.taken) for r in mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()}
        want = brute_mix(rows)
        assert got.keys() == want.keys()
        for d in want:
            assert got[d][:2] == want[d][:2] and abs(got[d][2] - want[d][2]) < 1e-5 and got[d][3] == want[d][3], d


def test_totals_and_limits(spark):
    rows = [(i, "w " * (i % 17), f"s{i % 4}" if i % 3 else "s0", "", "") for i in range(300)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sum(r.taken for r in got) == int(1.5 * sum(r["size"] for r in got))
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    by = {}
    for r in got:
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    assert all(abs(sum(t) - target) <= 17 for (_, target), t in by.items())


def test_empty_repeats_and_nulls(spark):
    df = spark.createDataFrame([(1, "a b", "x", "", "")] * 3 + [(None, "c d e", None, "", "")], SCHEMA)
    got = mixing.mix(df).collect()
    assert len(got) == 4 and sum(r.taken for r in got) == 13
    assert mixing.mix(df.where("false")).count() == 0
    assert {r.taken for r in mixing.mix(df.selectExpr("doc_id", "'' as text", "source")).collect()} == {0}
