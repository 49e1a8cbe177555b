"""Tokenizing and packing documents into sequences by power-of-two decomposition."""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import small_batches

TOKENIZER = "word_bpe_49k.json"
END = 1
#: Words, and parts of words, whose ids a task keeps; about 50 MB each. They go when the task ends, the tokenizer stays.
CACHE = 200_000
#: Words of these characters are the same after NFC, and their lower case is the same everywhere.
PLAIN = re.compile(r"[\x21-\x7EÀ-įı-ž]+")


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself, or the next one from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return {b: chr(b) if b in shown else chr(next(rest)) for b in range(256)}


class WordIds:
    """Token ids of whole texts, little-endian 32-bit, from a tokenizers file; equal to encode(text, add_special_tokens=False).

    For a vocabulary that lower-cases and splits by a pattern no match of which crosses white space, ids are made word by
    word and kept for the next time a word occurs. Special tokens' strings in a text are ordinary text.
    """

    def __init__(self, path: str) -> None:
        self.full = Tokenizer.from_file(path)
        self.full.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.words: dict[str, bytes] = {"": b""}
        self.pieces: dict[str, bytes] = {}
        steps = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self.by_word = steps == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in split] == ["Split", "ByteLevel"] and split[0]["behavior"] == "Removed"
        if self.by_word:
            self.findall = regex.compile(split[0]["pattern"]["Regex"]).findall
            self.letters = str.maketrans({chr(b): x for b, x in byte_letters().items()})
            self.model = self.full.model

    def _piece(self, piece: str) -> bytes:
        if (ids := self.pieces.get(piece)) is None:
            tokens = self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))
            ids = b"".join([t.id.to_bytes(4, "little") for t in tokens])
            if len(self.pieces) < CACHE:
                self.pieces[piece] = ids
        return ids

    def _word(self, word: str) -> bytes:
        if PLAIN.fullmatch(word):
            ids = b"".join(map(self._piece, self.findall(word.lower())))
        else:
            ids = np.array(self.full.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if len(self.words) < CACHE and len(word) < 64:
            self.words[word] = ids
        return ids

    def clear(self) -> None:
        self.words, self.pieces = {"": b""}, {}

    def __call__(self, text: str) -> bytes:
        if not self.by_word:
            return np.array(self.full.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        known, make = self.words.get, self._word
        return b"".join([ids if (ids := known(w)) is not None else make(w) for w in text.replace("\n", " ").split(" ")])


_loaded: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


def pieces_of(n: int, longest: int = 2048) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: as many of the longest as fit, then n's binary digits downwards."""
    starts = list(range(0, n - n % longest, longest))
    out, at = [(s, longest) for s in starts], n - n % longest
    while at < n:
        size = 1 << (n - at).bit_length() - 1
        out.append((at, size))
        at += size
    return out


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, end: int = END, longest: int = 2048, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket, batch_id, slot (and ids), one row for each piece.

    A document's ids and the end id are cut into pieces of powers of two, longest at most (itself a power of two). Each piece is a
    sequence of its own: no sequence crosses documents and none is padded. Pieces of equal length fill the buckets: bucket
    is log2 of the length, and longest / length pieces of a bucket are a batch of `longest` ids, in slots from 0; each partition
    leaves at most one batch of each bucket unfilled. A null text is empty and gives the end id alone; rows repeated in
    full are packed each; sequence ids are unique; an empty table gives an empty result; other columns are ignored.
    tokenizer is the path of a tokenizers file on every executor; by default that of TOKENIZER.
    """
    if longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    small_batches(docs.sparkSession)
    names = ["start", "length", "ids_crc32", "doc_tokens", "batch", "slot"]
    fields = [(n, pa.int64()) for n in names] + [("ids", pa.list_(pa.int32()))] * with_ids
    kind = pa.list_(pa.struct(fields))

    @F.arrow_udf("array<struct<" + ",".join(f"{n}:long" for n in names) + ",ids:array<int>" * with_ids + ">>")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ids_of, last = word_ids(tokenizer or public_tokenizers.path(TOKENIZER)), np.array([end], dtype="<u4").tobytes()
        filled: Counter[int] = Counter()  # pieces of each bucket so far in this partition
        try:
            for texts in batches:
                out = []
                for t in texts:
                    ids = memoryview(ids_of(t.as_py() or "") + last)
                    n = len(ids) // 4
                    row = []
                    for start, size in pieces_of(n, longest):
                        part = ids[4 * start : 4 * (start + size)]
                        batch, slot = divmod(filled[size], longest // size)
                        filled[size] += 1
                        row.append((start, size, zlib.crc32(part), n, batch, slot) + (np.frombuffer(part, dtype="<i4"),) * with_ids)
                    out.append([dict(zip([f for f, _ in fields], p)) for p in row])
                yield pa.array(out, kind)
        finally:
            ids_of.clear()

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.explode(cut(F.col(text))).alias("p")).select("doc_id", "p.*")
    bucket = F.log2("length").cast("int")
    batch = F.concat_ws("-", F.spark_partition_id(), bucket, "batch").alias("batch_id")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]
    return rows.select(*columns, F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"), bucket.alias("bucket"), batch, "slot")
