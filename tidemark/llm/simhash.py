"""SimHash fingerprints and near-duplicate classes by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, staged
from .components import connected_components

BITS = 64
#: Buckets of at most this many fingerprints are compared directly; larger ones are split by a second covering.
DIRECT = 64


def majority(parts: Iterable[np.ndarray], width: int) -> np.ndarray:
    """The bits, as bytes, that over half of the rows of all parts have set; a part holds rows of width bytes."""
    ones, n = np.zeros(8 * width, dtype=np.int64), 0
    for part in parts:
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(part)
    return np.packbits(2 * ones > n, bitorder="little")


def fingerprint_of(text: bytes, k: int = 3, seed: int = 42) -> int:
    """The signed 64-bit SimHash of UTF-8 text; zero for a text without words."""
    words = text.lower().split()
    if not words:
        return 0
    line, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= k:
        hashes = np.array([h(line, seed)], dtype="<u8")
    else:
        starts = [0, *accumulate(len(w) + 1 for w in words)]
        hashes = np.fromiter((h(line[a : b - 1], seed) for a, b in zip(starts, starts[k:])), dtype="<u8", count=len(words) - k + 1)
    parts = (hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8) for at in range(0, len(hashes), 1 << 15))
    return int(majority(parts, 8).view("<i8")[0])


def simhash(text: Column, k: int = 3, seed: int = 42) -> Column:
    """A long column: bit i is set where over half of the k-word shingles' XXH64 have it. Null counts as empty text: 0."""

    @F.arrow_udf("long")
    def apply(batch: pa.Array) -> pa.Array:
        return pa.array([fingerprint_of(t.as_py() or b"", k, seed) for t in batch.cast(pa.binary())], pa.int64())

    return apply(text)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def covering(bits: list[int], radius: int = 2) -> list[int]:
    """Masks over the given bit positions such that any radius positions are all outside at least one mask.

    Position number i is given the non-zero vector g = i mod (2^(radius+1) - 1) + 1 over GF(2); mask v holds the positions
    whose g has odd overlap with v. Any radius vectors leave a non-zero v orthogonal to them all, so two words that differ
    in at most radius positions agree on the whole of that mask.
    """
    m = (1 << (radius + 1)) - 1
    return [sum(1 << b for i, b in enumerate(bits) if ((i % m + 1) & v).bit_count() % 2) for v in range(1, m + 1)]


def masks(radius: int = 2, bits: int = BITS) -> list[tuple[int, list[int]]]:
    """For each table its mask, and the finer masks that split its large buckets. Positions from bits on are in every mask."""
    out, above = [], (1 << BITS) - (1 << bits)
    for mask in covering(list(range(bits)), radius):
        mask |= above
        free = [b for b in range(bits) if not mask >> b & 1]
        out.append((_signed(mask), [_signed(mask | fine) for fine in covering(free, radius)]))
    return out


def bucket_links(prints: np.ndarray, radius: int, star: bool = True) -> list[tuple[int, int]]:
    """Links within one bucket of distinct fingerprints: each one but the first of its class to that first.

    Without star, to one within radius of it instead.
    """
    prints = np.sort(prints)
    left, out = prints, []
    while len(left):
        root, frontier, left = left[0], [left[0]], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            near = np.bitwise_count((left ^ at).view(np.uint64)) <= radius
            found, left = left[near], left[~near]
            frontier += list(found)
            out += [(int(x), int(root if star else at)) for x in found]
    return out


def links(prints: DataFrame, col: str, radius: int = 2, direct: int = DIRECT, bits: int = BITS, star: bool = True) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints that connect every class of fingerprints within radius bits, step by step.

    Each distinct fingerprint is put in 2^(radius+1) - 1 tables under its masked value. A bucket of up to direct
    fingerprints is compared at once. A larger one is split by a second covering of the bits its mask leaves free; what
    shares a finer key differs only in the 3/7 of the 3/7 free bits, at most 12 of 64 for radius 2, so that no group holds
    over 4,096 fingerprints whatever the input. Within a bucket only links to one member of each class are made, not all pairs.
    Fingerprints of fewer bits may carry a number above them, which must be equal. Without star, both ends of every link are within radius.
    """
    tables = masks(radius, bits)
    fp = prints.select(F.col(col).alias("fp")).where("fp is not null").distinct()
    keyed = fp.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m, _ in tables])).alias("t", "key"))
    shared = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    rows = staged(keyed.join(shared, ["t", "key"]), "buckets")
    small = rows.where(F.col("n") <= direct).select("t", F.lit(-1).alias("u"), "key", "fp")
    fine = F.array(*[F.array(*[F.lit(x) for x in f]) for _, f in tables])
    large = rows.where(F.col("n") > direct).select("t", "fp", F.posexplode(F.element_at(fine, F.col("t") + 1)).alias("u", "mask"))
    large = large.select("t", "u", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")

    @F.arrow_udf("array<struct<a:long,b:long>>")
    def connect(groups: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
        prints, at = groups.values.to_numpy(), groups.offsets.to_numpy()
        return pa.array([bucket_links(prints[a:b], radius, star) for a, b in zip(at, at[1:])], kind)

    groups = small.union(large).groupBy("t", "u", "key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    return groups.select(F.explode(connect("fps")).alias("l")).select("l.a", "l.b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2) -> DataFrame:
    """doc_id, fp (signed), component_id: the smallest id reachable through fingerprints that differ in at most radius bits.

    Further columns: class, the component's smallest fingerprint, and text_hash. One row for each input row. Null and
    word-free texts have fingerprint 0 and are linked like any other; a null id is never a component's smallest id unless
    all its ids are null; repeated rows and ids are kept; an empty table gives an empty result; other columns are
    ignored, whatever their names.
    """
    small_batches(docs.sparkSession)
    text = F.col(text_col)
    rows = staged(docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), simhash(text).alias("fp")), "prints")
    first = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    found = staged(connected_components(links(rows, "fp", radius), "a", "b"), "nodes")
    named = found.join(first, found.node == first.fp).groupBy("component").agg(F.min("first_id").alias("component_id"))
    linked = found.join(named, "component").select(F.col("node").alias("fp"), F.col("component").alias("class"), "component_id")
    labels = first.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"), F.coalesce("class", "fp").alias("class"))
    labels = staged(labels, "labels")  # both sides of the join are plain exchanges then: a hot fingerprint's documents are split
    return rows.join(labels, "fp").select("doc_id", "fp", "component_id", "class", "text_hash")


def hex_print(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
