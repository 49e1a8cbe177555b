"""Misspelled terms, quotation, and a learned lexicon on planted texts."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import toxicity as tx
from tidemark.llm.common import table


def distance(a, b):
    """Edits of a letter or of two neighbours' order between two words, each letter touched once (optimal string alignment)."""
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@pytest.mark.parametrize("states", [50, 20_000])
def test_automaton_equals_distances_to_all_terms(monkeypatch, states):
    monkeypatch.setattr(tx, "MAX_STATES", states)
    rng = random.Random(1)
    terms = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(2, 11))) for _ in range(25)})
    machine = tx.Automaton(terms)
    for _ in range(3000):
        word = list(rng.choice(terms))
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(word) + 1)
            kind = rng.randrange(4)
            if kind == 0:
                word.insert(i, rng.choice("abcde"))
            elif word and i < len(word):
                if kind == 1:
                    del word[i]
                elif kind == 2:
                    word[i] = rng.choice("abcde")
                elif i + 1 < len(word):
                    word[i], word[i + 1] = word[i + 1], word[i]
        w = "".join(word)
        near = min(((distance(w, t), k) for k, t in enumerate(terms) if distance(w, t) <= machine.edits[k]), default=None)
        assert machine.match(w) == near, (w, near)


WORDS = [a + b + c for a in ("ba", "ke", "lo", "mi") for b in ("na", "ro", "ti", "su") for c in ("dor", "lim", "pek", "zan")]
BAD = ["grumbold", "snarfle", "vexwort", "klud"]


def texts(n=900, seed=2):
    rng, out = random.Random(seed), []
    for i in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randint(5, 120))]
        bad = i % 8 == 0
        if bad:
            for _ in range(2 + len(words) // 30):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        out.append((i, " ".join(words), int(bad)))
    return out


@pytest.fixture(scope="module")
def model(spark):
    return tx.train(spark.createDataFrame(texts(), "doc_id long, text string, toxic int").select("text", "toxic"))


def scores(spark, model, rows):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    return [r for r in tx.score(df, model).orderBy("doc_id").collect()]


def test_the_lexicon_is_learned_and_held_out_texts_are_told_apart(spark, model):
    assert set(BAD) == set(model.lexicon.terms)
    held = texts(300, seed=9)
    got = scores(spark, model, [t for _, t, _ in held])
    assert [r.predicted for r in got] == [y for _, _, y in held] and all(0 <= r.score <= 1 for r in got)


def test_misspelled_disguised_and_quoted_terms(spark, model):
    clean = " ".join(WORDS[:30])
    rows = [clean, f"{clean} you grumbolt and snarlfe", f"{clean} gr.u.m.b.o.l.d v3xwort", f"{clean} s n a r f l e grumboldd", f'{clean} he wrote "grumbold" and "snarfle" there', f"{clean} grumbold snarfle", "", None, "GRUMBOLD! SNARFLE!"]
    got = scores(spark, model, rows)
    assert [r.predicted for r in got[:4]] == [0, 1, 1, 1] and got[5].predicted == 1 and got[8].predicted == 1
    assert (got[4].n_abuse, got[4].n_quoted) == (0, 2) and got[4].score < got[5].score and got[6].score == got[7].score < 0.3
    assert list(tx.contexts("she said klud today", [(9, 13, 0, 2.0)])) == [(0, 2.0, tx.REPORTED)] and list(tx.contexts("she said you klud", [(13, 17, 0, 2.0)])) == [(0, 2.0, 1.0)]


def test_long_texts_repeats_and_clashing_columns(spark, model):
    long = " ".join(WORDS * 4000)
    rows = [long, long + " grumbold snarfle vexwort klud" * 400]
    got = scores(spark, model, rows)
    assert [r.predicted for r in got] == [0, 1] and got[1].n_abuse == 1600
    df = spark.createDataFrame([(1, "grumbold snarfle", 7.0, "x"), (1, "grumbold snarfle", 8.0, "y")], "doc_id long, text string, score double, m string")
    out = tx.score(df, model).collect()
    assert len(out) == 2 and out[0].score == out[1].score and {r.m for r in out} == {"x", "y"}
    assert tx.score(df.where("false"), model).count() == 0


def test_labels_of_one_kind_none_and_copies(spark):
    one = spark.createDataFrame([("a b", 1), (None, 1)], "text string, toxic int")
    assert [r.score for r in scores(spark, tx.train(one), ["x", None])] == [1.0, 1.0] and scores(spark, tx.train(one.withColumn("toxic", F.lit(0))), ["x"])[0].score == 0.0
    assert scores(spark, tx.train(one.where("false")), ["x"])[0].predicted == 0
    copies = [(f"{' '.join(WORDS[:40])} oddword{i // 200}", 1) for i in range(200)]
    rows = spark.createDataFrame([(t, y) for _, t, y in texts()] + copies, "text string, toxic int")
    assert "oddword" not in tx.train(rows).lexicon.terms  # one text, however often it is repeated


def test_every_labelled_document_is_joined(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(500)] + [(None, "none"), (7, "again")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 3) for i in range(0, 500, 2)] + [(4, 1), (4, 0), (6, None), (None, 1)], "doc_id long, toxic int")
    got = sorted((r.text, r.toxic) for r in tx.labelled(docs, labels).collect())
    assert got == sorted((f"t{i}", int(i % 3 > 0 or i == 4)) for i in range(0, 500, 2))


def test_held_out_documents_of_the_tables(spark):
    from tidemark.llm import queries

    sf = "/root/testdata/sf0.01"
    got = queries.op12_toxicity(spark, sf).join(table(spark, sf, "labels"), "doc_id").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").where("held_out and lang = 'en'")
    wrong = got.where("toxic <> predicted").count()
    assert got.count() > 40 and wrong <= 2
