"""Language identification by interpolated Kneser-Ney character models."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, staged

#: Letters and other word characters but digits and the underscore.
LETTERS = re.compile(r"[^\W\d_]+")
UND = "und"
#: About half the labelled documents taken of each language: so many fit and so many calibrate. All of a language of at most FEW fit.
PER_LANG, FEW = 500, 20
#: n-grams of the highest order kept of a language, and cells (n-grams times languages) that a table is to hold at most.
MAX_GRAMS, MAX_CELLS = 400_000, 1 << 25
#: Letters from which a held-back text counts as long.
LONG = 100
ORDER = 4
#: Words whose scores a task keeps.
CACHE = 100_000
#: Characters scored at once.
STEP = 1 << 20
MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def gram_keys(codes: np.ndarray, n: int) -> np.ndarray:
    """64-bit keys of the n code points that end at each position from n - 1 on."""
    key = np.zeros(max(0, len(codes) - n + 1), dtype=np.uint64)
    for i in range(n):
        key = (key ^ codes[i : i + len(key)]) * MULTIPLY
        key ^= key >> np.uint64(29)
    return key


def _keys_of(grams: list[str]) -> np.ndarray:
    """The keys of grams of one length."""
    codes = np.frombuffer("".join(grams).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    n = len(grams[0]) if grams else 1
    return gram_keys(codes, n)[::n] if grams else np.zeros(0, dtype=np.uint64)


class Model:
    """Interpolated Kneser-Ney models of all languages in arrays sorted by the hash of the n-gram or context.

    Words are padded with order - 1 spaces before and one after, so that each is scored on its own. Order k has, for each n-gram
    seen in any language, the discounted share of its last character after its context, and for each context the weight of
    the next lower order; both have a column for each language. The lowest order is interpolated with a uniform share.
    """

    def __init__(self, counts: dict[str, dict[str, int]], order: int = ORDER) -> None:
        self.langs, self.order = sorted(counts), order
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []
        self.contexts: list[tuple[np.ndarray, np.ndarray]] = []
        alphabet = {g[-1] for c in counts.values() for g in c}
        self.floor = 1.0 / (len(alphabet) + 1)
        tables = [self._orders(counts[x]) for x in self.langs]
        for k in range(order):
            grams = sorted({g for t in tables for g in t[k]})
            share = np.zeros((len(grams), len(self.langs)), dtype=np.float32)
            rows = {g: i for i, g in enumerate(grams)}
            contexts = sorted({g[:-1] for g in grams})
            weight = np.ones((len(contexts), len(self.langs)), dtype=np.float32)
            at = {c: i for i, c in enumerate(contexts)}
            for j, t in enumerate(tables):
                values = Counter(t[k].values())
                d = values[1] / (values[1] + 2 * values[2]) if values[1] and values[2] else 0.5
                total: dict[str, int] = defaultdict(int)
                types: dict[str, int] = defaultdict(int)
                for g, n in t[k].items():
                    total[g[:-1]] += n
                    types[g[:-1]] += 1
                for g, n in t[k].items():
                    share[rows[g], j] = max(n - d, 0.0) / total[g[:-1]]
                for c, n in total.items():
                    weight[at[c], j] = d * types[c] / n
            self.grams.append(self._sorted(grams, share))
            self.contexts.append(self._sorted(contexts, weight))
        self.limits, self.slack, self.scale = np.full(len(self.langs), -np.log(self.floor)), 0.0, 1.0

    @staticmethod
    def _orders(counts: dict[str, int]) -> list[dict[str, int]]:
        """From the highest order's counts those of all orders, lowest first: below it, how many characters stand before."""
        out = [counts]
        while len(next(iter(out[0]), "x")) > 1:
            out.insert(0, Counter(g[1:] for g in out[0]))
        return out

    @staticmethod
    def _sorted(grams: list[str], values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = _keys_of(grams) if grams and grams[0] else np.zeros(len(grams), dtype=np.uint64)
        by = np.argsort(keys, kind="stable")
        return keys[by], values[by]

    @staticmethod
    def _lookup(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, missing: float) -> np.ndarray:
        known, values = table
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        out = values[at]
        out[known[at] != keys] = missing
        return out

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Natural log-probability of each word and its end in each language."""
        if not words:
            return np.zeros((0, len(self.langs)))
        n = self.order
        text = "".join(" " * (n - 1) + w + " " for w in words)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + n
        first = np.cumsum(size) - size
        at = np.ones(len(codes), dtype=bool)
        for i in range(n - 1):
            at[first + i] = False
        at = np.flatnonzero(at)  # the characters that are predicted
        p = np.full((len(at), len(self.langs)), self.floor)
        for k in range(1, n + 1):
            context = gram_keys(codes, k - 1)[at - k + 1] if k > 1 else np.zeros(len(at), dtype=np.uint64)
            p = self._lookup(self.grams[k - 1], gram_keys(codes, k)[at - k + 1], 0.0) + self._lookup(self.contexts[k - 1], context, 1.0) * p
        return np.add.reduceat(np.log(p), np.concatenate([[0], np.cumsum(size - n + 1)[:-1]]), axis=0)


class _Index(dict):
    """Numbers for words in order of first sight."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = i = len(self)
        self.new.append(word)
        return i


class Scorer:
    """Cross-entropies of texts under a model; word scores are kept from batch to batch up to CACHE words."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.index, self.scores = _Index(), np.zeros((0, len(self.model.langs)), dtype=np.float32)

    def _flush(self, texts: list[list[str]]) -> list[tuple[int, np.ndarray | None]]:
        words = [w for t in texts for w in t]
        ids = np.fromiter(map(self.index.__getitem__, words), dtype=np.int64, count=len(words))
        new, self.index.new = self.index.new, []
        parts = [self.scores] + [self.model.word_scores(new[i : i + 8_000]).astype(np.float32) for i in range(0, len(new), 8_000)]
        self.scores = np.concatenate(parts)
        size = np.fromiter((len(w) + 1 for w in words), dtype=np.int64, count=len(words))
        out, at = [], 0
        for t in texts:
            n = len(t)
            letters = int(size[at : at + n].sum())
            out.append((letters, -self.scores[ids[at : at + n]].sum(axis=0, dtype=np.float64) / letters if n else None))
            at += n
        if len(self.index) > CACHE:
            self._clear()
        return out

    def entropies(self, texts: Iterator[str | None]) -> Iterator[tuple[int, np.ndarray | None]]:
        """Letters, with a word end each, and nats a letter in each language; 0 and None for a text without letters."""
        wait, n = [], 0
        for t in texts:
            words = words_of(t) if t else []
            if not any(w.isalpha() for w in words[:50]) and not any(map(str.isalpha, words)):
                words = []
            wait.append(words)
            n += len(t or "")
            if n >= STEP:  # so that the words of many texts are scored together
                yield from self._flush(wait)
                wait, n = [], 0
        yield from self._flush(wait)


def _grams(rows: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in rows:
        for lang, text in zip(batch.column(0), batch.column(1)):
            counts.update((lang.as_py(), w) for w in words_of(text.as_py() or ""))
    grams: Counter = Counter()
    for (lang, word), n in counts.items():
        padded = " " * (order - 1) + word + " "
        for i in range(len(padded) - order + 1):
            grams[lang, padded[i : i + order]] += n
    kind = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())])
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in grams], pa.string()), pa.array([k[1] for k in grams], pa.string()), pa.array(list(grams.values()), pa.int64())], schema=kind)


def sample(rows: DataFrame, sizes: dict[str, int], per_lang: int) -> DataFrame:
    """lang, text, fit of the rows (lang, h, text) whose hash h is under their language's threshold, equal ones once.

    The threshold lets about 2 * per_lang rows of a language through, whatever its size, so that no language is sorted or
    gathered. fit is the lowest bit of h; it holds for all rows of a language of at most FEW.
    """
    rates = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(2.0 * per_lang / n))])
    few = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(n <= FEW))])
    draw = F.shiftrightunsigned("h", 11) / float(1 << 53)
    chosen = rows.where(draw < F.element_at(rates, F.col("lang"))).dropDuplicates(["lang", "h"])
    return chosen.select("lang", "text", ((F.col("h") % 2 != 0) | F.element_at(few, F.col("lang"))).alias("fit"))


def _counted(fit: DataFrame, order: int, most: int) -> dict[str, dict[str, int]]:
    """The n-gram counts of each language, of its most frequent n-grams if it has over `most`."""
    grams = staged(fit.mapInArrow(lambda rows: _grams(rows, order), "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "langid-grams")
    least: dict[str, int] = {}
    total: Counter = Counter()
    for r in grams.groupBy("lang", "n").count().orderBy("lang", F.desc("n")).collect():
        total[r["lang"]] += r["count"]
        if total[r["lang"]] <= most:
            least[r["lang"]] = r["n"]
        else:
            least.setdefault(r["lang"], r["n"] + 1)
    counts: dict[str, dict[str, int]] = defaultdict(dict)
    if least:
        floor = F.create_map(*[x for lang, n in least.items() for x in (F.lit(lang), F.lit(n))])
        for r in grams.where(F.col("n") >= F.element_at(floor, F.col("lang"))).collect():
            counts[r["lang"]][r["gram"]] = r["n"]
    return counts


def calibrate(model: Model, held: list) -> None:
    """Sets the model's limits and scale from held-back rows (lang, letters, entropy array).

    own are the cross-entropies of a language's texts that it describes best, other those of texts of other languages under its
    model. A long text is within the limit up to midway between the highest hundredth of own and the lowest of other
    (of evenly drawn letters where that is less), and in any case up to all but the highest thousandth of own. A text of n
    letters has slack / sqrt(n) more; slack is half as much again as any held-back text of any language needs. scale is such that the margin
    which all but the lowest hundredth of the held-back texts reach gives 99 to 1.
    """
    even = -np.log(model.floor)
    model.limits, needs, margins = np.full(len(model.langs), even), [0.0], []
    rows = [(model.langs.index(r["lang"]), r["letters"], np.array(r["e"])) for r in held if r["lang"] in model.langs and r["e"] is not None]
    for i in range(len(model.langs)):
        own = np.array([(e[i], n) for j, n, e in rows if j == i and e.argmin() == i]).reshape(-1, 2)
        other = [e[i] for j, n, e in rows if j != i and n >= LONG]
        margins += [np.partition(e, 1)[1] - e[i] for j, _, e in rows if len(e) > 1 and j == i and e.argmin() == i]
        if not len(own):
            continue
        long = own[own[:, 1] >= LONG, 0] if (own[:, 1] >= LONG).any() else own[:, 0]
        high, low = np.quantile(long, 0.99), min([np.quantile(other, 0.01), even] if other else [even])
        model.limits[i] = max(np.quantile(long, 0.999), (high + low) / 2)
        needs.append(((own[:, 0] - model.limits[i]) * np.sqrt(own[:, 1])).max())
    model.slack = 1.5 * max(needs)
    if margins:
        model.scale = max(float(np.quantile(margins, 0.01)), 1e-3) / np.log(99)


def train(docs: DataFrame, lang: str = "lang", text: str = "text", key: Column | None = None, per_lang: int = PER_LANG, max_grams: int = MAX_GRAMS, order: int = ORDER) -> Model | None:
    """A model of all languages named in lang, from rows with a language and a text.

    Documented bounds: about 2 * per_lang rows of each language, by a hash of key (by default doc_id), language and text, rows
    repeated in full once; half are counted in Spark, by n-gram, and half calibrate rejection. Of each language the most
    frequent max_grams n-grams are kept, fewer if there are so many languages that the tables would have over MAX_CELLS
    cells. Null keys are as good as any other. None if there is no such row.
    """
    key = F.col("doc_id") if key is None else key
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.xxhash64(key, F.col(lang), F.col(text)).alias("h"), F.col(text).alias("text"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return None
    small_batches(docs.sparkSession)
    chosen = staged(sample(rows, sizes, per_lang), "langid-sample")
    counts = _counted(chosen.where("fit").select("lang", "text"), order, max(100, min(max_grams, MAX_CELLS // len(sizes) ** 2)))
    if not counts:
        return None
    model = Model(counts, order)
    measured, shared = _measured(chosen.where("not fit"), model, "text")
    calibrate(model, measured.select("lang", "m.*").collect())  # a row of the sample each
    shared.destroy()
    return model


def _measured(docs: DataFrame, model: Model | None, text: str) -> tuple[DataFrame, Broadcast]:
    """docs with m, a struct of letters (with a word end each) and e, the cross-entropies in each language; and the broadcast model."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("letters", pa.int64()), ("e", pa.list_(pa.float64()))])

    @F.arrow_udf("struct<letters:long,e:array<double>>")
    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value) if shared.value else None
        for batch in batches:
            found = scorer.entropies(t.as_py() for t in batch) if scorer else ((0, None) for _ in batch)
            yield pa.array([{"letters": n, "e": e} for n, e in found], kind)

    # Not deterministic for the optimizer only: a filter on the outcome must not run the model a second time.
    return docs.withColumn("m", apply.asNondeterministic()(F.col(text))), shared


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs with lang_pred, score, entropy, rejected from the text alone.

    lang_pred is the language of the lowest cross-entropy for each character, the first in order on ties; und for a null text, a
    text without letters, or without a model. score is that language's share when each has exp(-entropy / scale) with the
    calibrated scale; 0 for und. rejected holds for und and for texts whose entropy is above their language's calibrated limit
    for their length. Columns of these names in docs are replaced; an empty table gives an empty result; repeated
    rows are predicted each.
    """
    named = docs.drop("lang_pred", "score", "entropy", "rejected")
    columns = [named[c].alias(f"c{i}") for i, c in enumerate(named.columns)]
    found, _ = _measured(named.select(*columns), model, f"c{named.columns.index(text)}")
    langs, limits, slack, scale = (model.langs, model.limits, float(model.slack), float(model.scale)) if model else ([UND], [0.0], 0.0, 1.0)
    e, lit = F.col("m.e"), lambda xs: F.array(*[F.lit(x if isinstance(x, str) else float(x)) for x in xs])
    found = found.withColumn("best", F.array_min(e)).withColumn("at", F.array_position(e, F.col("best")).cast("int"))
    share = F.aggregate(F.transform(e, lambda x: F.exp((F.col("best") - x) / scale)), F.lit(0.0), lambda a, x: a + x)
    over = F.col("best") > F.element_at(lit(limits), F.col("at")) + slack / F.sqrt("m.letters")
    out = {
        "lang_pred": F.when(F.col("best").isNull(), UND).otherwise(F.element_at(lit(langs), F.col("at"))), "score": F.when(F.col("best").isNull(), 0.0).otherwise(1 / share),
        "entropy": F.col("best"), "rejected": F.col("best").isNull() | over,
    }
    found = found.withColumns({f"p_{k}": c for k, c in out.items()})  # a step of its own, so that names of docs can't stand for these
    return found.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(named.columns)], *[F.col(f"p_{k}").alias(k) for k in out])


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4."""
    return F.crc32(F.col(doc_id).cast("string")) % 4
