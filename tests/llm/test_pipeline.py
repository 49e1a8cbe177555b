"""Each stage of the pipeline against a brute-force version on its own input, and the whole run."""

import collections
import random

import corpus_pipeline as cp
import numpy as np
import public_tokenizers
import pytest
from test_mixing import brute_mix
from test_nearcopies import brute_label, brute_sets
from tokenizers import Tokenizer

from tidemark.llm import packing, secrets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PARTS = {"en": "the and ing ed er on at th", "de": "sch ung heit ver keit er der", "fr": "eau le ouè ment que ré"}


def documents():
    rnd = random.Random(11)
    rows = []
    for i in range(150):
        lang = rnd.choice(list(PARTS))
        text = " ".join("".join(rnd.choices(PARTS[lang].split(), k=rnd.randint(1, 3))) for _ in range(rnd.choice([3, 30, 120, 400])))
        rows.append([i, text, lang, rnd.choice(["s0", "s0", "s0", "s1", "s2", None])])
    rows += [[200 + i, r[1] + " end" * (i % 2), r[2], r[3]] for i, r in enumerate(rows[:40])]
    for i in (3, 50, 160):
        rows[i][1] += " token = 'abcdefgh12345' " + "0f" * 20
    rows += [[300, None, "en", "s0"], [301, "", None, "s1"], [302, "漢字 かな 한국어 пример", None, "s1"], [303, "123 --- 456", "en", "s2"], [None, rows[5][1] + " other words here", "en", None], rows[7], rows[7]]
    return [(i, t, lang, s, len(t or "")) for i, t, lang, s in rows]


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.createDataFrame(documents(), SCHEMA), []
    for name, stage in cp.STAGES:
        after = cp.staged(stage(spark, docs, ""), "test-stage")
        out.append((name, docs.collect(), after.collect(), after.columns))
        docs = after
    return {name: rest for name, *rest in out}


def test_columns(stages):
    for name, (_, _, columns) in stages.items():
        if name != "packing":
            assert columns == cp.COLUMNS


def test_language_keeps_clean_documents(stages):
    before, after, _ = stages["language"]
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert gone == {300, 301, 302, 303} and len(before) - len(after) == 4


def test_near_dedup_keeps_one_of_each_class(stages):
    before, after, _ = stages["near_dedup"]
    rows = sorted({(r.doc_id is None, r.doc_id or 0, r.text) for r in before})
    label = brute_label([brute_sets(t) for _, _, t in rows])  # five words, Jaccard similarity 0.8
    want = sorted(rows[k] for k in set(label))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in after) == want and len(after) < len(before)


def test_secrets_are_replaced(stages):
    before, after, _ = stages["secrets"]
    assert len(before) == len(after)
    want = {(r.doc_id, secrets.redacted_text(r.text)) for r in before}
    assert {(r.doc_id, r.text) for r in after} == want
    assert all(r.n_chars == len(r.text) and not secrets.find(r.text) for r in after)
    assert any("[REDACTED]" in r.text for r in after)


def test_mixing_repeats_documents_as_taken(stages):
    before, after, _ = stages["mixing"]
    known = [r for r in before if r.doc_id is not None]
    words = lambda t: len(t.encode().split())
    assert sum(words(r.text) for r in after) == int(1.5 * sum(words(r.text) for r in before))
    if len(known) == len(before):
        want = brute_mix([(r.doc_id, r.text, r.source, "", "") for r in before])
        got = collections.Counter()
        for r in after:
            got[r.doc_id] += words(r.text)
        assert got == {d: w[3] for d, w in want.items() if w[3]}
    count = collections.Counter((r.doc_id, r.source) for r in after)
    assert max(count.values()) <= 2 and sum(1 for r in after if r.text not in {b.text for b in before}) <= 1


def test_packing_holds_every_id_once(stages):
    before, after, _ = stages["packing"]
    tok = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    tok.encode_special_tokens = True
    want = sorted(len(tok.encode(r.text, add_special_tokens=False).ids) + 1 for r in before)
    assert sum(r.length for r in after) == sum(want)
    assert all(r.offset == 0 and r.length & (r.length - 1) == 0 for r in after) and len({r.sequence_id for r in after}) == len(after)
    assert sorted(np.repeat([r.doc_tokens for r in after if r.start == 0], 1).tolist()) == want


def test_run_is_the_stages_in_turn(spark, stages, tmp_path):
    spark.createDataFrame(documents(), SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = cp.run(spark, str(tmp_path)).collect()
    strip = lambda rows: sorted((r.doc_id is None, r.doc_id or 0, r.start, r.length, r.ids_crc32) for r in rows)
    assert strip(got) == strip(stages["packing"][1])


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in cp.STAGES:
        assert stage(spark, docs, "").count() == 0


def test_stages_take_null_columns(spark):
    docs = spark.createDataFrame([(None, None, None, None, None)] * 2 + [(1, None, None, None, None), (2, "kato mina kato", None, None, 3)], SCHEMA)
    for name, stage in cp.STAGES:
        assert stage(spark, docs, "").count() >= (0 if name in ("language", "mixing") else 1)
