"""The operators that use DataFrame operations only: fingerprints, licenses, quality."""

import collections
import hashlib
import random
import re

from pyspark.sql import functions as F

from tidemark.llm import licenses, multiset, quality

DOCS = "doc_id long, text string, lang string, n_chars string, n_words string"


def some_texts(rnd, n):
    words = ["the", "of", "and", "cc", "by", "mit", "license", "gnu", "general", "public", "apache", "été", "x1", "A", "#$", "&"]
    sep = [" ", " ", " ", "\n", ". ", ", ", "\t"]
    return ["".join(rnd.choice(words) + rnd.choice(sep) for _ in range(rnd.choice([0, 1, 5, 60, 300]))) for _ in range(n)]


def test_edited_texts_and_fingerprints(spark):
    rnd = random.Random(7)
    texts = [*some_texts(rnd, 40), None, "", "a\nb\nc", "c\na\n\nb", "𝒳é" * 9]
    df = spark.createDataFrame([(i * 3, t, "", "", "") for i, t in enumerate(texts)], DOCS).repartition(3)
    got = {r.doc_id // 3: r for r in multiset.edited(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        t, after = t or "", texts[(i + 1) % len(texts)] or ""
        half = len(t) // 2
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.near_next == 1) == (r.fingerprint == got[(i + 1) % len(texts)].fingerprint)
    assert got[42].fingerprint == got[43].fingerprint != got[41].fingerprint == got[40].fingerprint


def test_fingerprints_add_up(spark):
    df = spark.createDataFrame([("one, two. three\nfour", "five; six\nseven")], "a string, b string").withColumn("ab", F.concat_ws("\n", "b", "a"))
    for c in ("a", "b", "ab"):
        df = multiset.fingerprint(df, F.col(c), f"f_{c}")
    r = df.select("f_ab", "f_a", multiset.combine(F.col("f_a"), F.col("f_b")).alias("up"), multiset.combine(F.col("f_ab"), F.col("f_b"), -1).alias("down")).first()
    assert r.up == r.f_ab and r.down == r.f_a


def brute_clauses(text):
    lines = [p.strip(" ") for p in (text or "").split("\n")]
    return collections.Counter(c for p in lines if p for c in re.split(r"(?<=[.!?,;:])\s+", p))


def exact_likeness(a, b):
    dot = lambda x, y: sum(n * y[c] for c, n in x.items())
    return 2 * dot(a, b) / (dot(a, a) + dot(b, b)) if a or b else 1.0


def test_likeness_is_near_the_exact_one(spark):
    """Over random pairs with any share in common the error has the stated size, and no bias."""
    rnd = random.Random(21)
    rows = []
    for _ in range(150):
        n, m = rnd.choice([1, 5, 40, 300]), rnd.random()
        a = [f"c{rnd.randrange(10**9)}." for _ in range(n)]
        b = [c if rnd.random() < m else f"d{rnd.randrange(10**9)}." for c in a]
        rnd.shuffle(b)
        rows.append((" ".join(a), "\n".join(b)))
    df = spark.createDataFrame(rows, "a string, b string")
    for c in "ab":
        df = multiset.fingerprint(df, F.col(c), f"f{c}")
    got = multiset.likeness(df, "fa", "fb", "near").collect()
    errors = [r.near - exact_likeness(brute_clauses(r.a), brute_clauses(r.b)) for r in got]
    assert (sum(e * e for e in errors) / len(errors)) ** 0.5 < 0.08 and abs(sum(errors) / len(errors)) < 0.03
    assert max(map(abs, errors)) < 0.35


def test_lanes_are_sums_of_signs(spark):
    """Lanes are what a brute-force sum over clauses gives, in chunks of any size; equal lanes of mod only for equal multisets."""
    texts = ["one, two. three\nfour; four", "", "x " * 50, "a, " * 300]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    whole = multiset.fingerprint(multiset.fingerprint(df, F.col("t"), "f"), F.col("t"), "g", chunk=7)
    clauses = df.select("t", F.explode(F.filter(F.flatten(F.transform(multiset.paragraphs(F.col("t")), lambda p: F.split(p, multiset.CLAUSE_END))), lambda c: F.lit(True))).alias("c"))
    hashes = clauses.select("t", *[F.xxhash64(F.lit(s), F.xxhash64("c")).alias(f"h{i}") for i, s in enumerate(multiset.SKETCH_SALTS)]).collect()
    for r in whole.collect():
        mine = [h for h in hashes if h.t == r.t]
        want = [sum(1 if (h[1 + i] >> (k + 20 * j)) & 1 else -1 for h in mine) for i in range(len(multiset.SKETCH_SALTS)) for k in range(multiset.SHIFTS) for j in range(3)]
        assert r.f == r.g and list(r.f.lanes) == want and len(want) == 270 and r.f.n == len(mine)


def test_large_multisets_do_not_overflow(spark):
    """Over 2^20 clauses, a union of many texts and what is taken off again: disjoint texts stay unlike."""
    rows = [("a, ", "b, ", (1 << 20) + 9), ("a, b, c, ", "a, b, d, ", 5)]
    df = spark.createDataFrame(rows, "a string, b string, k int").withColumns({"a": F.expr("repeat(a, k)"), "b": F.expr("repeat(b, k)")})
    for c in "ab":
        df = multiset.fingerprint(df, F.col(c), f"f{c}")
    df = df.withColumns({"up": multiset.combine(F.col("fa"), F.col("fb")), "less": multiset.combine(F.col("fa"), F.col("fb"), -1)})
    got = [r.near for r in multiset.likeness(df, "fa", "fb", "near").select("near").collect()]
    assert got[0] < 0.2 and abs(got[1] - 2 / 3) < 0.2
    r = df.withColumn("back", multiset.combine(F.col("up"), F.col("fb"), -1)).where("k > 5").select("fa", "back", "less").first()
    assert r.fa == r.back and min(r.less.lanes) < 0


def test_edited_very_long_and_clashing(spark):
    schema = "doc_id long, text string, fp string, n long, half int, prev_id long, edited string"
    rows = [(1, "word, " * 300_000, "x", 1, 2, 3, "y"), (2, "other. " * 10, None, None, None, None, None), (3, None, "x", 1, 2, 3, "y")]
    got = {r.doc_id: r for r in multiset.edited(spark.createDataFrame(rows, schema)).collect()}
    want = rows[0][1][: -len(rows[0][1]) // 2] + rows[1][1]
    assert got[1].edited_sha256 == hashlib.sha256(want.encode()).hexdigest() and got[3].n_chars == 0 and len(got) == 3


def test_edited_edge_cases(spark):
    one = spark.createDataFrame([(None, "abcd", "", "", "")], DOCS)
    r = multiset.edited(one).first()
    assert r.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and r.near_next == 1
    twice = spark.createDataFrame([(1, "abcd", "", "", ""), (1, "abcd", "", "", ""), (2, "x", "", "", "")], DOCS)
    assert multiset.edited(twice).count() == 3
    assert multiset.edited(one.where("false")).count() == 0


def brute_license(text):
    w = re.findall(licenses.TOKEN, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places = [(i, label) for p, label in licenses.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_licenses_match_brute_force(spark):
    rnd = random.Random(8)
    texts = [*some_texts(rnd, 60), None, "", "MIT license", "cc-by cc_by CC  BY", "mit", "license mit license", "mit licenseé", "ccby"]
    rows = [(i, t, "", "", "") for i, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, rows[0], (0, "cc by", "", "", ""), (None, "mit license", "", "", "")], DOCS)
    got = licenses.scan(df).collect()
    assert len(got) == len(rows) + 3
    for i, t in enumerate(texts[1:], 1):
        r = next(r for r in got if r.doc_id == i)
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_license(t), t
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert sorted((r.n_base, r.base_labels) for r in got if r.doc_id == 0) == sorted([brute_license(texts[0])[1::3]] * 2 + [(1, "cc-by")])
    assert licenses.scan(df.where("false")).count() == 0


def test_notices_with_edits(spark):
    notice = licenses.NOTICES[0][0].split()
    edited = notice[:12] + ["new"] + notice[12:30] + notice[31:]
    rows = [(1, " ".join(["lead"] * 9 + edited), "", "", ""), (2, " ".join(notice[:15]), "", "", ""), (3, " ".join(reversed(notice)), "", "", "")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[1].labels == "mit" and got[1].base_labels == "" and 0.7 <= got[1].score < 1
    assert got[2].labels == got[3].labels == ""


def test_repeated_fragments_are_no_license(spark):
    """A few words of a notice over and over cover few of its positions; a span's words are those of the template."""
    whole = next(t for t, label in licenses.NOTICES if label == "mit")
    rows = [(1, "use copy modify merge publish distribute " * 12, "x"), (2, whole.upper(), None), (3, " ".join(reversed(whole.split())), "x"), (4, None, None), (5, "filler " * 200_000 + whole, "x"), (5, "filler " * 200_000 + whole, "x")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, hits string")).collect()}
    assert [got[i].labels for i in range(1, 6)] == ["", "mit", "", "", "mit"]
    assert got[1].score == 0 and got[2].score == got[5].score == 1 and got[5].n_words == 200_000 + len(whole.split())


def brute_quality(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = collections.Counter(grams)
    covered = {j for i, g in enumerate(grams) if count[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_quality_matches_brute_force(spark):
    rnd = random.Random(9)
    texts = [*some_texts(rnd, 60), None, "", " \n\t", "a b c " * 40, "a a a a", "x y z x y z", "l 1\nl 1\n \nl 2\nl 1"]
    rows = [(i, t, rnd.choice(["en", "xx", None]), "", "") for i, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, rows[5]], DOCS)
    got = quality.judge(df).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(texts[r.doc_id]), r
        assert not (r.base_failed and r.kept)
    assert quality.judge(df.where("false")).count() == 0


def test_divergence(spark):
    rnd = random.Random(10)
    line = lambda: " ".join(rnd.choice(["the", "of", "and", "river", "stone", "cloud", "green", "walks"]) + rnd.choice(["", "", "s", "ed"]) for _ in range(120)) + "."
    rows = [(i, line(), "en", "", "") for i in range(60)] + [(100, " ".join(f"w{i}#$%&" for i in range(200)), "en", "", ""), (101, " ".join(f"qqx{i}zz" for i in range(150)), "en", "", "")]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(got[i].kept for i in range(60) if not got[i].base_failed)
    assert not got[100].kept and not got[100].base_failed
    assert got[101].word_distance > got[0].word_distance
    assert not got[101].kept and not got[101].base_failed
    same = quality.js_distance(spark.createDataFrame([([1, 3], [2, 6]), ([1, 0], [0, 5]), ([0, 0], [1, 1])], "p array<long>, q array<long>"), "p", "q", "d")
    a, b, c = [r.d for r in same.collect()]
    assert abs(a) < 1e-9 and abs(b - 1) < 1e-9 and c is None


def test_common_words_match_brute_force(spark):
    rnd = random.Random(12)
    texts = [*some_texts(rnd, 60), None, "", "Zz zz ZZ " * 90, "w" * 31, *[" ".join(f"v{rnd.randrange(90)}" for _ in range(40)) for _ in range(30)]]
    rows = [(i, t, rnd.choice(["en", "xx", None]), "", "") for i, t in enumerate(texts)]
    got = {r.word_lang: r["list"] for r in quality.common_words(spark.createDataFrame(rows, DOCS).repartition(3)).collect()}
    for lang in ("en", "xx"):
        count = collections.Counter(w for _, t, k, *_ in rows if k == lang for w in set(re.findall(r"[^\W_]+", (t or "").lower())) if len(w) <= quality.MAX_WORD)
        assert got[lang] == sorted(count, key=lambda w: (-count[w], w))[: quality.N_COMMON]
    assert set(got) == {"en", "xx"}


def test_odd_words_are_rejected_at_any_length(spark):
    """Without a language's common words, or with one of them over and over among rare ones, letters alike; clean texts of any length stay."""
    rnd = random.Random(13)
    common = [f"com{a}{b}" for a in "abcde" for b in "abcdefghij"]
    rare = lambda: "".join(rnd.choice("abcdefgmno") for _ in range(5))
    clean = lambda n: " ".join(rnd.choice(common) if rnd.random() < 0.5 else rare() for _ in range(n))
    rows = [(i, clean(rnd.choice([110, 300, 1000, 4000])), "en", "x", "x", 1) for i in range(60)]
    rows += [(100 + n, " ".join(rare() for _ in range(n)), "en", "x", "x", 1) for n in (200, 1000, 5000)]
    rows += [(101 + n, " ".join(common[0] if rnd.random() < 0.4 else rare() for _ in range(n)), "en", "x", "x", 1) for n in (400, 5000)]
    rows += [(7000, " ".join(rare() for _ in range(90)), "en", "x", "x", 1), (7001, clean(100_000), "en", None, None, None), (7002, clean(300), None, "x", "x", 1), (7002, clean(300), None, "x", "x", 1)]
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, chars string, word string, list int")).collect()
    assert len(got) == len(rows) and not any(r.base_failed for r in got)
    assert {r.doc_id for r in got if not r.kept} == {300, 1100, 5100, 501, 5101}


def test_a_license_among_repeated_fragments_is_found(spark):
    """Before, behind and inside the text; the fragments alone are none, whatever their number."""
    text, label = licenses.NOTICES[0]
    w = text.split()
    part = " ".join(w[:5]) + " a "
    rows = [
        (1, part * 200 + text), (2, text + " " + part * 200), (3, " ".join(w[: len(w) // 2]) + " " + part * 3 + " ".join(w[len(w) // 2 :])), (4, part * 400), (5, part * 100 + text + " " + part * 100), (6, text),
        (7, part * 50 + " ".join(w[60:80])), (8, None), (8, part * 200 + text),
    ]
    got = [(r.doc_id, r.labels, r.score) for r in licenses.scan(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)).collect()]
    assert sorted((i, label) for i, t in rows if i in (1, 2, 3, 5, 6) or (i == 8 and t)) == sorted((i, y) for i, y, _ in got if y == label)
    assert {(i, y) for i, y, _ in got if i in (4, 7)} == {(4, ""), (7, "")} and all(s == 1.0 for i, y, s in got if y and i != 3)


def test_common_words_are_looked_up_by_hash(spark):
    """Histograms count every common word, whatever its bucket and whatever signs it has, and no word is compared with the whole list."""
    known = [f"w{i}" for i in range(47)] + ["ß", "漢字", "a"]  # more than fit 64 buckets without collisions
    text = " ".join(w + ("." if i % 3 else " other ") for i, w in enumerate(known) for _ in range(1 + i % 4)) + " A a\\r [x]"
    docs = spark.createDataFrame([(1, text, "en"), (2, None, "en"), (3, "w1 w1", "xx"), (4, "w0", None)], "doc_id long, text string, lang string")
    words = spark.createDataFrame([("en", known), ("xx", ["w1", "r"])], "word_lang string, list array<string>")
    stats = quality.measures(docs, words)
    got = {r.doc_id: r.common for r in stats.collect()}
    count = collections.Counter(re.findall(r"[^\W_]+", text.lower()))
    want = [count[w] for w in known]
    assert got[1] == [sum(count.values()) - sum(want), *want] and got[2] == [0] * 51
    assert got[3] == [0, 2, 0] + [0] * 48 and got[4] is None
    plan = stats._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "array_contains(list" not in plan and "array_remove(" not in plan
