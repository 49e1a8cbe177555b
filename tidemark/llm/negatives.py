"""Hard negatives by distributed radix selection.

For windows of scores (one for each anchor and positive) tasks count their rows in equal buckets of the window; the summed
histogram shows the bucket in which the kth row lies, which becomes the next window. It is refined until few rows are left
above its lower end, or until it is a single score. Only rows from there on are gathered. No scores are ever shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged

#: Anchors whose vectors and windows a pass over the rows holds in each task; more anchors take more passes.
ANCHORS = 2048
#: Buckets of a histogram, and how many rows a window may keep before it is refined further.
BUCKETS, ENOUGH = 256, 64
#: Rows that a task scores at once.
ROWS = 4096
SCALE = 256


def prepared(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """id, label, v (whole numbers floor(scale * x)) of rows (vec_id, embedding, label).

    Left out: a null id, label or vector, and vectors with a null or non-finite component.
    """
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(~bad).select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), v.alias("v"))


def _matrix(column: pa.Array, width: int, kind: np.dtype) -> np.ndarray:
    """Rows of whole numbers; shorter rows are filled with zeros."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    size = np.diff(column.offsets.to_numpy())
    if (size == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(size), width), dtype=kind)
    row, at = np.repeat(np.arange(len(size)), size), np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)
    out[row, at] = values
    return out


def _blocks(batches: Iterator[pa.RecordBatch], width: int, kind: np.dtype) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """ids, labels and vectors of about ROWS rows at a time."""
    held, n = [], 0

    def joined():
        ids, labels, v = pa.Table.from_batches(held).combine_chunks().columns
        return ids.chunk(0).to_numpy(), labels.chunk(0).to_numpy(), _matrix(v.chunk(0), width, kind)

    for b in batches:
        for start in range(0, b.num_rows, ROWS):
            held.append(b.slice(start, ROWS))
            n += held[-1].num_rows
            if n >= ROWS:
                yield joined()
                held, n = [], 0
    if n:
        yield joined()


class Windows:
    """Open windows over the anchors of a pass: anchor (its place), same (label), low, high (scores, inclusive), need (rows wanted)."""

    def __init__(self, anchor, same, low, high, need):
        self.anchor, self.same, self.low, self.high, self.need = (np.asarray(x, dtype=np.int64) for x in (anchor, same, low, high, need))

    def width(self) -> np.ndarray:
        """Scores in a bucket."""
        return (self.high - self.low) // BUCKETS + 1


def _scored(batches, anchors, windows: Windows) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each block of rows and window: the window, ids and scores of the rows with the label asked for and a score within bounds."""
    ids, labels, vectors = anchors
    used, column = np.unique(windows.anchor, return_inverse=True)
    order = np.lexsort((windows.same, windows.anchor))
    for row_ids, row_labels, m in _blocks(batches, vectors.shape[1], vectors.dtype):
        scores, last = vectors[used] @ m.T, None
        for w in order.tolist():
            a, same = windows.anchor[w], windows.same[w]
            if (a, same) != last:
                last = (a, same)
                fits = (row_labels == labels[a]) & (row_ids != ids[a]) if same else row_labels != labels[a]
                s, who = scores[column[w], fits].astype(np.int64), row_ids[fits]
            inside = (s >= windows.low[w]) & (s <= windows.high[w])
            if inside.any():
                yield w, who[inside], s[inside]


def _histograms(rows: DataFrame, anchors, windows: Windows) -> dict[str, np.ndarray]:
    """For each window the bucket of its last wanted row, bucket 0 holding the highest scores, and the rows before it and up to it.

    A window with fewer rows than wanted has bucket BUCKETS.
    """
    shared, buckets = rows.sparkSession.sparkContext.broadcast((anchors, windows, windows.width())), BUCKETS

    def count(batches):
        anchors, windows, width = shared.value
        out = np.zeros((len(windows.anchor), buckets), dtype=np.int64)
        for w, _, s in _scored(batches, anchors, windows):
            out[w] += np.bincount((windows.high[w] - s) // width[w], minlength=buckets)
        w, b = np.nonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(b.astype(np.int32)), pa.array(out[w, b])], ["w", "b", "n"])

    summed = rows.mapInArrow(count, "w long, b int, n long").groupBy("w", "b").agg(F.sum("n").alias("n"))
    need = summed.sparkSession.createDataFrame(list(enumerate(windows.need.tolist())), "w long, need long")
    upto = F.sum("n").over(Window.partitionBy("w").orderBy("b").rowsBetween(Window.unboundedPreceding, 0))  # BUCKETS rows at most
    found = summed.withColumn("upto", upto).join(F.broadcast(need), "w").where("upto >= need")
    found = found.groupBy("w").agg(F.min(F.struct("b", "upto", "n")).alias("k")).select("w", "k.*").collect()  # a row for each window of the pass
    shared.destroy()
    size = len(windows.anchor)
    out = {"bucket": np.full(size, BUCKETS), "before": np.zeros(size, dtype=np.int64), "upto": np.zeros(size, dtype=np.int64)}
    for r in found:
        out["bucket"][r["w"]], out["before"][r["w"]], out["upto"][r["w"]] = r["b"], r["upto"] - r["n"], r["upto"]
    return out


def _lowest(rows: DataFrame, anchors, windows: Windows) -> np.ndarray:
    """For each window a score from which on it has the rows wanted and few more, or only rows of that score more."""
    low, active = windows.low.copy(), np.arange(len(windows.anchor))
    above = np.zeros(len(active), dtype=np.int64)
    while len(active):
        now = windows
        found, width = _histograms(rows, anchors, now), now.width()
        few = found["bucket"] == BUCKETS
        low[active] = np.where(few, now.low, np.maximum(now.low, now.high - (found["bucket"] + 1) * width + 1))
        more = ~few & (width > 1) & (above + found["upto"] > ENOUGH)
        high = now.high - found["bucket"] * width
        windows = Windows(now.anchor[more], now.same[more], low[active][more], high[more], (now.need - found["before"])[more])
        above, active = (above + found["before"])[more], active[more]
    return low


def _select(rows: DataFrame, anchors, windows: Windows, k: int) -> DataFrame:
    """w, id, score, rank: each window's first k rows by score, highest first, then by id.

    A task hands on at most k rows of a window, so that ties of a very common vector aren't gathered.
    """
    windows = Windows(windows.anchor, windows.same, _lowest(rows, anchors, windows), windows.high, windows.need)
    shared = rows.sparkSession.sparkContext.broadcast((anchors, windows))

    def gather(batches):
        anchors, windows = shared.value
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for w, who, s in _scored(batches, anchors, windows):
            if w in best:
                who, s = np.concatenate([best[w][0], who]), np.concatenate([best[w][1], s])
            order = np.lexsort((who, -s))[:k]
            best[w] = who[order], s[order]
        if best:
            w = np.repeat(np.array(list(best), dtype=np.int64), [len(x) for x, _ in best.values()])
            yield pa.RecordBatch.from_arrays([pa.array(w), *(pa.array(np.concatenate([x[i] for x in best.values()]).astype(np.int64)) for i in (0, 1))], ["w", "id", "score"])

    found = rows.mapInArrow(gather, "w long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("w").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of rows and anchors as `prepared` gives them.

    An anchor's positives are the first `positives` rows of its label and another id. A pair's hard negatives are the first
    `negatives` rows of another label whose score is from low to high hundredths of the positive's. Higher scores come first, then
    smaller ids. Rows with one id are rows of their own; an anchor repeated in full is one. Shorter vectors count as filled with
    zeros. No rows, no anchors, one label or no fitting rows give no results. Scores must fit 64 bits.

    Anchors are taken in passes of about ANCHORS, whose vectors and windows go to all tasks; each pass reads all rows.
    """
    spark = rows.sparkSession
    rows, anchors = staged(rows, "negatives-rows"), staged(anchors.distinct(), "negatives-anchors")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    most = rows.agg(F.max(square).alias("square"), F.max(F.size("v")).alias("width"), F.count("*").alias("n")).first()
    n_anchors = anchors.count()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not most["n"] or not n_anchors:
        return spark.createDataFrame([], schema)
    if most["square"] >= 2.0**62:
        raise ValueError("scores don't fit 64 bits")
    passes = -(-n_anchors // ANCHORS)
    out = None
    for i in range(passes):
        chosen = anchors.where(F.expr(f"pmod(xxhash64(id), {passes})") == i).collect()  # about ANCHORS rows
        if chosen:
            found = staged(_pass(rows, chosen, most, positives, negatives, low, high), "negatives-found")
            out = found if out is None else out.union(found)
    return out


def _pass(rows: DataFrame, chosen: list, most, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    spark = rows.sparkSession
    exact = most["square"] < 2.0**52  # else products of doubles could be rounded, and whole numbers are multiplied
    vectors = np.zeros((len(chosen), max(most["width"], *(len(r["v"]) for r in chosen))), dtype=np.float64 if exact else np.int64)
    for i, r in enumerate(chosen):
        vectors[i, : len(r["v"])] = r["v"]
    anchors = (np.array([r["id"] for r in chosen]), np.array([r["label"] for r in chosen]), vectors)
    bound = np.array([int((sum(float(x) * x for x in r["v"]) * most["square"]) ** 0.5) + 2 for r in chosen])  # no score is larger
    ones = np.ones(len(chosen), dtype=np.int64)
    best = _select(rows, anchors, Windows(np.arange(len(chosen)), ones, -bound, bound, positives * ones), positives).orderBy("w", "rank").collect()
    best = [r for r in best if r["score"] >= 0]  # below zero no score is between the bounds
    pairs = [(i, int(anchors[0][r["w"]]), r["id"], r["score"]) for i, r in enumerate(best)]
    score = np.array([r["score"] for r in best], dtype=np.int64)
    windows = Windows([r["w"] for r in best], np.zeros(len(best)), -((-low * score) // 100), high * score // 100, np.full(len(best), negatives))
    found = _select(rows, anchors, windows, negatives).withColumnRenamed("score", "negative_score")
    named = spark.createDataFrame(pairs, "w long, anchor_id long, positive_id long, positive_score long")  # positives of one pass
    return found.join(F.broadcast(named), "w").select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", "negative_score")
