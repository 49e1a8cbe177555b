"""Near-duplicate classes by the Jaccard similarity of five-word shingles, links checked exactly.

Candidates are SimHash fingerprints under covering masks, as in op1 but wider; MinHash bands add the pairs beyond their radius.
"""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import small_batches, staged
from .components import connected_components

WORDS, LEAST = 5, 0.8
#: The fingerprint of a set: BLOCKS blocks of BITS bits, candidates where RADIUS or fewer bits of a block differ. Short blocks reach
#: further than op1's 64 bits; 40 are so many that among 10^7 unlike texts about 10^5.5 pairs are near by chance.
BLOCKS, BITS, RADIUS = 8, 40, 2
#: Buckets of up to so many blocks are compared at once.
SPLIT = 1024
#: Two texts of similarity s share a band with probability 1 - (1 - s^ROWS)^BANDS: 0.9999 at 0.8.
BANDS, ROWS = 24, 5
#: Buckets of at most this many sets are compared in all pairs at once; of larger ones about so many leaders in the second
#: round, GROW times as many in each round after it, in blocks of BLOCK sets.
DIRECT, GROW, BLOCK = 64, 4, 128
#: Estimate from which a pair is checked exactly: five standard deviations below LEAST.
MAYBE = 0.62
_RND = np.random.default_rng(42)
_FACTORS = _RND.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _RND.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2)
_SPREAD = _RND.integers(0, 1 << 63, BLOCKS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PAIRS = "array<struct<a:long,b:long>>"
_PAIRS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def shingles(text: bytes, k: int = WORDS) -> np.ndarray:
    """The sorted distinct XXH64 of the k-word shingles of UTF-8 text, words as in op1; a shorter text is one shingle."""
    words = text.lower().split()
    if not words:
        return np.array([], dtype=np.uint64)
    line, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([h(line)], dtype=np.uint64)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    return np.unique(np.fromiter((h(line[a : b - 1]) for a, b in zip(starts, starts[k:])), dtype=np.uint64, count=len(words) - k + 1))


def fingerprint(found: np.ndarray) -> list[int]:
    """The SimHash of a set of shingles in blocks: BITS bits and above them the block's number."""
    width, step = BITS // 8, 1 << 12
    words = ((found[at : at + step, None] * _SPREAD).astype("<u8").view(np.uint8).reshape(-1, BLOCKS, 8) for at in range(0, len(found), step))
    blocks = simhash.majority((w[:, :, 8 - width :].reshape(len(w), -1) for w in words), BLOCKS * width).reshape(BLOCKS, width)
    return [int.from_bytes(b.tobytes(), "little") | j << BITS for j, b in enumerate(blocks)]


def sketch(found: np.ndarray) -> tuple[int, list[int], bytes, list[int]]:
    """The digest of a set of shingles, the keys of its bands, a byte of each of its minima and its fingerprint."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(found), 1024):
        least = np.minimum(least, (found[at : at + 1024, None] * _FACTORS + _OFFSETS).min(axis=0))
    keys = [xxhash.xxh64_intdigest(b.tobytes(), seed=t) for t, b in enumerate(least.reshape(BANDS, ROWS))]
    signed = np.array([xxhash.xxh64_intdigest(found.tobytes()), *keys], dtype=np.uint64).view(np.int64).tolist()
    return signed[0], signed[1:], (least >> np.uint64(32)).astype(np.uint8).tobytes(), fingerprint(found)


def sketches(text: Column) -> Column:
    kind = pa.struct([("set", pa.int64()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary()), ("prints", pa.list_(pa.int64()))])

    @F.arrow_udf("struct<set:long,bands:array<long>,sig:binary,prints:array<long>>")
    def apply(batch: pa.Array) -> pa.Array:
        return pa.array([dict(zip(kind.names, sketch(shingles(t.as_py() or b"")))) for t in batch.cast(pa.binary())], kind)

    return apply(text)


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(len(x) + len(y) - both, 1)


def _sigs(rows: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(rows.field("sig").to_pylist()), dtype=np.uint8).reshape(len(rows), -1)


def likely(rows: pa.Array) -> list[tuple[int, int]]:
    """Pairs of (set, sig) structs that may be similar."""
    ids, sigs = rows.field("set").to_numpy(), _sigs(rows)
    return [(int(ids[i]), j) for i, sig in enumerate(sigs) for j in ids[i + 1 :][(sigs[i + 1 :] == sig).mean(axis=1) >= MAYBE].tolist()]


def joining(leaders: pa.Array, rows: pa.Array) -> list[tuple[int, int]]:
    """Links between (set, comp, sig, raw) structs of leaders and rows that join all components which any such link joins.

    The likeliest partner in each other component is checked first, and no more once one is found there.
    """
    ids, comps = ([x.field(f).to_numpy() for x in (leaders, rows)] for f in ("set", "comp"))
    sigs = [_sigs(x) for x in (leaders, rows)]
    raws = [[np.frombuffer(v, dtype=np.uint64) for v in x.field("raw").to_pylist()] for x in (leaders, rows)]
    root: dict[int, int] = {}

    def top(c: int) -> int:
        while (up := root.get(c, c)) != c:
            c = up
        return c

    out = []
    for i, sig in enumerate(sigs[0]):
        like = (sigs[1] == sig).mean(axis=1)
        for j in np.argsort(-like, kind="stable"):
            if like[j] < MAYBE:
                break
            mine, its = top(int(comps[0][i])), top(int(comps[1][j]))
            if mine != its and jaccard(raws[0][i], raws[1][j]) >= LEAST:
                root[its] = mine
                out.append((int(ids[0][i]), int(ids[1][j])))
    return out


def _within(groups: pa.Array) -> pa.Array:
    return pa.array([[{"a": x, "b": y} for x, y in likely(g.values)] for g in groups], _PAIRS)


def _between(left: pa.Array, right: pa.Array) -> pa.Array:
    return pa.array([[{"a": x, "b": y} for x, y in joining(g.values, h.values)] for g, h in zip(left, right)], _PAIRS)


def _jaccard(left: pa.Array, right: pa.Array) -> pa.Array:
    return pa.array([jaccard(*(np.frombuffer(v.as_py(), dtype=np.uint64) for v in pair)) for pair in zip(left, right)], pa.float64())


def _maybe(left: pa.Array, right: pa.Array) -> pa.Array:
    x, y = (np.frombuffer(b"".join(v.to_pylist()), dtype=np.uint8).reshape(len(v), -1) for v in (left, right))
    return pa.array((x == y).mean(axis=1) >= MAYBE)


def _members(batch: pa.Array) -> pa.Array:
    return pa.array([shingles(t.as_py() or b"").tobytes() for t in batch.cast(pa.binary())], pa.binary())


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _with(pairs: DataFrame, of: DataFrame, col: str) -> DataFrame:
    """pairs with x and y: the column of both sets, each joined on a plain exchange."""
    for side, out in (("a", "x"), ("b", "y")):
        pairs = pairs.join(of.select(F.col("set").alias(side), F.col(col).alias(out)), side)
    return pairs


def estimated(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose minima leave it open that they are similar."""
    return _with(pairs, sets, "sig").where(F.arrow_udf(_maybe, "boolean")("x", "y")).select("a", "b")


def covered_pairs(sets: DataFrame) -> DataFrame:
    """Pairs that may be similar by SimHash: sets with a block in common, each with the least of them, and sets with near blocks.

    Near are blocks that differ in RADIUS or fewer bits; covering masks find all of them, and op1's links connect them by near pairs.
    """
    prints = staged(sets.select("set", F.explode("prints").alias("fp")), "dedup-blocks")
    first = staged(prints.groupBy("fp").agg(F.min("set").alias("first"), F.count("*").alias("n")), "dedup-first")
    same = prints.join(first.where("n > 1"), "fp").where(F.col("set") != F.col("first")).select(F.col("set").alias("a"), F.col("first").alias("b"))
    near = simhash.links(first, "fp", RADIUS, SPLIT, BITS, star=False)
    for side in ("a", "b"):
        near = near.join(first.select(F.col("fp").alias(side), F.col("first").alias(f"{side}_set")), side)
    near = near.select(F.col("a_set").alias("a"), F.col("b_set").alias("b")).where("a <> b")
    return staged(_ordered(same.union(near)), "dedup-near")


def first_pairs(buckets: DataFrame, sets: DataFrame, direct: int) -> DataFrame:
    """Pairs that may be similar: all of each small bucket, and each set of a large one with the bucket's leader, its least set."""
    small = buckets.where(F.col("n") <= direct).select("bucket", "set").join(sets.select("set", "sig"), "set")
    groups = small.groupBy("bucket").agg(F.collect_list(F.struct("set", "sig")).alias("g"))
    found = groups.select(F.explode(F.arrow_udf(_within, PAIRS)("g")).alias("p")).select("p.a", "p.b")
    star = buckets.where((F.col("n") > direct) & (F.col("set") != F.col("leader"))).select(F.col("set").alias("a"), F.col("leader").alias("b")).distinct()
    star = estimated(star, sets)
    return staged(_ordered(found.union(star)), "dedup-pairs")


def open_rows(rows: DataFrame, leaders: int, salt: int) -> DataFrame:
    """bucket, set, comp, n, rest, lead of the buckets that hold several components, of rows (bucket, set, comp).

    Leaders are drawn, by a hash, from the sets outside their bucket's largest component: about `leaders` of the rest.
    """
    size = rows.groupBy("bucket", "comp").agg(F.count("*").alias("k"))
    per = size.groupBy("bucket").agg(F.sum("k").alias("n"), F.max_by("comp", F.struct("k", "comp")).alias("main"), F.max("k").alias("most"), F.count("*").alias("comps"))
    per = staged(per.where("comps > 1").select("bucket", "n", "main", (F.col("n") - F.col("most")).alias("rest")), "dedup-open")
    draw = F.shiftrightunsigned(F.xxhash64("set", "bucket", F.lit(salt)), 11) / float(1 << 53)
    drawn = rows.join(per, "bucket").withColumn("lead", (F.col("comp") != F.col("main")) & (draw < leaders / F.col("rest")))
    return staged(drawn.drop("main"), "dedup-rows")


def leader_links(rows: DataFrame, sets: DataFrame, raw: DataFrame) -> DataFrame:
    """Links of the leaders and the sets of other components of their buckets, of open_rows.

    They meet in blocks of about BLOCK against BLOCK; a bucket's blocks are dealt over keys of 64 each. Only links leave a block.
    """
    item = F.struct("set", "comp", "sig", "raw")
    full = rows.join(sets.select("set", "sig"), "set").join(raw, "set")
    blocks = full.withColumn("block", F.expr(f"pmod(xxhash64(set), ceil(n / {BLOCK}))")).groupBy("bucket", "block").agg(F.collect_list(item).alias("g"))
    blocks = blocks.withColumn("deal", F.expr("block div 64"))
    heads = full.where("lead").withColumn("block", F.expr(f"pmod(xxhash64(set, 1), ceil(rest / {BLOCK}))"))
    heads = heads.groupBy("bucket", "block").agg(F.collect_list(item).alias("h"), F.first("n").alias("n"))
    heads = heads.select("bucket", "h", F.explode(F.expr(f"sequence(0L, cast(ceil(n / {BLOCK}) as long) div 64)")).alias("deal"))
    met = heads.join(blocks.select("bucket", "deal", "g"), ["bucket", "deal"])
    found = met.select(F.explode(F.arrow_udf(_between, PAIRS)("h", "g")).alias("p")).select("p.a", "p.b")
    return staged(_ordered(found), "dedup-links")


def labelled(rows: DataFrame, nodes: DataFrame, of: str = "set", out: str = "comp") -> DataFrame:
    """rows with out: the component of the set in column of, by nodes (set, comp); sets without links are their own."""
    names = nodes.select(F.col("set").alias(of), F.col("comp").alias(out))
    return rows.join(names, of, "left").withColumn(out, F.coalesce(out, of))


def merged(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """nodes (set, comp: the smallest set) of all linked sets once the links new are added.

    Components are found only among those that a new link joins, not among all links made so far; without new links nothing runs.
    """
    if new.isEmpty():
        return nodes
    ends = labelled(labelled(new, nodes, "a", "x"), nodes, "b", "y")
    moved = staged(connected_components(ends.where("x <> y"), "x", "y"), "dedup-moved")
    kept = nodes.join(moved, nodes["comp"] == moved["node"], "left").select("set", F.coalesce("component", "comp").alias("comp"))
    single = moved.join(nodes, moved["node"] == nodes["set"], "left_anti").select(F.col("node").alias("set"), F.col("component").alias("comp"))
    return staged(kept.union(single), "dedup-comps")


def links(prints: DataFrame, texts: DataFrame, direct: int = DIRECT, leaders: int = DIRECT) -> DataFrame:
    """Links (a, b), Jaccard similarity LEAST or more, that connect all sets which chains of similar sets in common buckets connect."""
    return linked(prints, texts, direct, leaders)[0]


def linked(prints: DataFrame, texts: DataFrame, direct: int = DIRECT, leaders: int = DIRECT) -> tuple[DataFrame, DataFrame]:
    """The links and set, comp of all sets that have one.

    prints: set, bands, sig, prints, text_hash; texts: text, text_hash. Links between near fingerprints come first. A round
    checks one pair of each component, that to its least neighbour; when rounds no longer halve the components that have one, all pairs of two components are
    checked. MinHash buckets that still hold several components add the links beyond the fingerprints' radius. All pairs of small buckets are checked. In a large bucket all
    sets are first compared with one leader. What that leaves in several components goes on in rounds: leaders drawn from the
    sets outside the largest component are compared with all sets of other components and then leave the bucket, until the
    bucket has one component. The number of leaders grows from round to round, so that every bucket ends after a number of rounds
    in proportion to the logarithm of its size, and no pair of a bucket whose link could matter stays unchecked.
    """
    firsts = [F.any_value(c).alias(c) for c in ("bands", "sig", "prints")]
    sets = staged(prints.groupBy("set").agg(*firsts, F.min("text_hash").alias("one")), "dedup-sets")

    def hold(wanted: DataFrame) -> None:
        """Adds the shingles of these sets to raw where they are missing."""
        nonlocal raw
        wanted = wanted.distinct().join(raw, "set", "left_anti") if raw else wanted.distinct()
        one = staged(sets.select("set", "one").join(wanted, "set", "left_semi"), "dedup-wanted")
        if raw and one.isEmpty():
            return
        rows = texts.join(one, F.col("text_hash") == F.col("one")).dropDuplicates(["set"])
        more = staged(rows.select("set", F.arrow_udf(_members, "binary")("text").alias("raw")), "dedup-texts")
        raw = raw.unionByName(more) if raw else more

    def add(pairs: DataFrame) -> None:
        """Checks the pairs; what is similar becomes links."""
        nonlocal nodes
        hold(pairs.select(F.explode(F.array("a", "b")).alias("set")))
        found.append(staged(_with(pairs, raw, "raw").where(F.arrow_udf(_jaccard, "double")("x", "y") >= LEAST).select("a", "b"), "dedup-links"))
        nodes = merged(nodes, found[-1])

    raw, found, nodes = None, [], sets.select("set", F.col("set").alias("comp")).where("false")
    rest, last = covered_pairs(sets).select("a", "b", F.col("a").alias("x"), F.col("b").alias("y")), None
    while True:
        least = staged(rest.groupBy("y").agg(F.min(F.struct("x", "a", "b")).alias("p")).select("p.a", "p.b"), "dedup-least")
        size = least.count()
        if not size:
            break
        some = last is None or 2 * size <= last
        add(staged(estimated(least if some else rest.select("a", "b"), sets), "dedup-pairs"))
        if not some:
            break
        rest = labelled(labelled(rest.select("a", "b"), nodes, "a", "x"), nodes, "b", "y").where("x <> y")
        rest = staged(rest.select("a", "b", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")), "dedup-rest")
        last = size
    keyed = labelled(sets.select("set", "bands"), nodes).select("set", "comp", F.explode("bands").alias("bucket"))
    shared = keyed.groupBy("bucket").agg(F.count("*").alias("n"), F.min("set").alias("leader"), (F.min("comp") < F.max("comp")).alias("open"))
    buckets = staged(keyed.drop("comp").join(shared.where("open"), "bucket").drop("open"), "dedup-buckets")
    add(first_pairs(buckets, sets, direct))
    rows, salt = buckets.where((F.col("n") > direct) & (F.col("set") != F.col("leader"))).select("bucket", "set"), 0
    while not rows.isEmpty():
        drawn = open_rows(staged(labelled(rows, nodes).select("bucket", "set", "comp"), "dedup-named"), leaders * GROW**salt, salt)
        if drawn.isEmpty():
            break
        hold(drawn.select("set"))
        found.append(leader_links(drawn, sets, raw))
        nodes = merged(nodes, found[-1])
        rows, salt = drawn.where("not lead").select("bucket", "set"), salt + 1
    return reduce(DataFrame.union, found), nodes


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, class: texts are in one class if links of Jaccard similarity LEAST or more lead from one to the other.

    Similarity is that of the sets of five-word shingles, exact but for collisions of 64-bit hashes; texts with equal sets
    are in one class, and so are all null and word-free ones. Candidates are near SimHash fingerprints, found by covering masks, and
    what shares a MinHash band. A pair of similarity 0.8 is found with probability 0.9999, a
    closer one with more. One row for each input row; repeated rows and ids are kept; an empty table gives an empty result;
    other columns are ignored, whatever their names.
    """
    small_batches(docs.sparkSession)
    text = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    rows = staged(text.withColumn("s", sketches(F.col("text"))).select("doc_id", "text_hash", "s.*"), "dedup-prints")
    labels = linked(rows, text.select("text", "text_hash"))[1]  # a written table, so a plain exchange in the join: a hot set's documents are split
    return labelled(rows, labels, out="class").select("doc_id", "text_hash", "class")
