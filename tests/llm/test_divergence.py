"""The divergence audit against a plain count of everything."""

import re
from collections import Counter, defaultdict

import pytest

from tidemark.llm import divergence as dv

SCHEMA = "doc_id long, text string, lang string, source string"


def brute(rows, least=3, top=200):
    """(lang, source, part, item) -> (value, rank) by plain dictionaries of all terms."""
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    seen, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(low))
        groups[lang].add(source)
        seen[lang].update(set(words))
        counts[lang, source].update(words)
    out = {}
    for lang, names in groups.items():
        kept = sorted(t for t, n in seen[lang].items() if n >= least)
        whole = Counter()
        for s in names:
            whole.update({t: counts[lang, s][t] for t in kept})
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[t] for t in kept) + len(kept)) for t in kept}
        p, q = {s: share(counts[lang, s]) for s in names}, share(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in names:
            pairs = {o: sum(f(p[s][t], p[o][t]) for t in kept) for o in names if o != s}
            terms = {t: f(p[s][t], q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]}
            for part, values in (("pair", pairs), ("term", terms)):
                for rank, (item, v) in enumerate(sorted(values.items(), key=lambda x: (-x[1], x[0].encode())), 1):
                    if part == "pair" or rank <= top:
                        out[lang, s, part, item] = (v, rank)
    return out


def found(df):
    got = df.collect()
    out = {(r.lang, r.source, r.part, r.item): (r.value, r["rank"]) for r in got}
    assert len(out) == len(got)
    return out


ROWS = [
    (1, "The cat sat on the Mat", "en", "a"), (2, "the cat! the CAT? The dog", "en", "b"), (3, "a cat and the DOG and the cat", "en", "c"), (4, "the the the zebra", "en", "a"),
    (5, "Émile et ÉMILE et l'été", "fr", "a"), (6, "émile Émile été", "fr", None), (7, "Émile", "fr", "a"), (8, None, "fr", "z"), (9, "", "en", "d"), (10, "12 34 %%", "en", "d"),
    (11, "solo words", "de", "a"), (12, "dog cat dog", None, None), (12, "dog cat dog", None, None), (13, "dog", None, "b"), (14, "mat mat mat mat", "en", "b"), (None, "mat \U0001d54f\U0001d54f mat", "en", "c"),
]


@pytest.mark.parametrize("least", [1, 3])
def test_audit_equals_brute_force(spark, least):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(4)
    assert found(dv.audit(df, least)) == brute(ROWS, least)


def test_ranks_stop_at_the_top_and_ties_go_by_bytes(spark):
    rows = [(i, " ".join(f"w{chr(97 + k)}é" for k in range(20)), "en", "ab"[i % 2]) for i in range(6)] + [(9, "waé " * 9, "en", "b")]
    got = found(dv.audit(spark.createDataFrame(rows, SCHEMA), 3, 4))
    assert got == brute(rows, 3, 4) and max(r for _, r in got.values()) == 4


def test_hot_source_long_text_and_clashing_columns(spark):
    rows = [(i, "common words of a hot source", "en", "hot") for i in range(300)] + [(i, f"common rare{i % 3}x", "en", f"s{i % 2}") for i in range(9)] + [(999, "Word tail " * 40_000, "en", "s1")]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA + ", term int, i string, n int")
    assert found(dv.audit(df, 3)) == brute(rows, 3)


def test_no_documents(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert dv.audit(df).count() == 0 and dict(dv.audit(df).dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}


def test_long_division_is_exact(spark):
    cases = [(0, 1), (5, 7), (10**12, 3 * 10**12 + 1), (8 * 10**14, 8 * 10**14 + 2)]
    df = spark.createDataFrame(cases, "c long, w long")
    got = {(r.c, r.w): r.s for r in df.select("c", "w", dv.share(df["c"], df["w"]).alias("s")).collect()}
    assert got == {(c, w): 1 + 10**9 * (c + 1) // w for c, w in cases}
