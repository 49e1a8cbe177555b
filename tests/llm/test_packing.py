import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import packing

TEXTS = [
    "Hello, World! it's 42 o'clock", "", None, "Ünïcode été ÇA straße ΑΣ İstanbul ĸ ŉ ẞ", "漢字 かな 한국어 عربى हिन्दी", "é ä  nbsp em\x1csep\x0b\x0c",
    "don't we'll I'M they'VE 12 345 ½ ² _under_ !!! ... <|endoftext|>", "a\r\nb\tc  d", "x" * 3000, "word " * 5000, "ſ K 'S 'ſ",
]


@pytest.fixture(scope="module")
def reference():
    tok = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    tok.encode_special_tokens = True
    return lambda t: tok.encode(t or "", add_special_tokens=False).ids


def test_ids_equal_the_tokenizers(reference):
    ids = packing.WordIds(public_tokenizers.path(packing.TOKENIZER))
    assert ids.by_word
    rnd = random.Random(4)
    letters = "abcDEF éÉßñÑıſ'’.,!?0123$€—\n\t  _-½ĲŸÿ́ "
    texts = TEXTS + ["".join(rnd.choices(letters, k=rnd.randint(1, 200))) for _ in range(400)]
    for t in texts:
        assert np.frombuffer(ids(t or ""), dtype="<u4").tolist() == reference(t), t


def test_pieces_cover_each_document_once(spark, reference):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string")
    got = packing.pack(df, with_ids=True).collect()
    assert len({r.sequence_id for r in got}) == len(got)
    for i, t in enumerate(TEXTS):
        want = reference(t) + [1]
        for copy in range(2 if i == 0 else 1):
            mine = sorted((r for r in got if r.doc_id == i), key=lambda r: (r.start, r.sequence_id))[copy :: 2 if i == 0 else 1]
            assert [x for r in mine for x in r.ids] == want
            at = 0
            for r in mine:
                assert r.start == at and r.length == len(r.ids) and r.length & (r.length - 1) == 0 and r.length <= 2048
                assert r.offset == 0 and r.doc_tokens == len(want) and r.bucket == r.length.bit_length() - 1
                assert r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
                at += r.length
    assert packing.pack(df.where("false")).count() == 0


def test_decomposition():
    for n in (*range(1, 70), 2047, 2048, 2049, 5000):
        pieces = packing.pieces_of(n)
        assert sum(size for _, size in pieces) == n and pieces[0][0] == 0
        assert all(a + s == b for (a, s), (b, _) in zip(pieces, pieces[1:]))
    with pytest.raises(ValueError):
        packing.pack(None, longest=1000)
