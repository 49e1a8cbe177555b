"""Toxicity: a learned lexicon as a trie, misspelled terms by Levenshtein automata, and context windows that tell quotation from abuse.

Terms are the words that labelled toxic texts hold far more often than others. The Levenshtein automata of all terms are walked
over the trie at once: a state is a set of (trie node, edits), and states are made as texts need them. How much a misspelled form
tells is learned too, so that clean words that look like a term weigh little.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, staged

#: A lexicon term is in at least so many toxic texts and this share of them, and its log odds less ERRORS standard errors are above
#: LEAST_ODDS (many words are tried, so some are only by chance in toxic texts).
MIN_TEXTS, MIN_SHARE, LEAST_ODDS, ERRORS = 3, 0.002, 1.0, 2.3
#: What each edit leaves of a form's weight.
BLUR = 0.7
#: Edits allowed by the number of letters: none below the first, one from it on, two from the second on.
ONE_EDIT, TWO_EDITS = 4, 9
#: Labelled rows, by a hash threshold, that the weights of the features are fitted on.
FIT_ROWS = 20_000
THRESHOLD = 0.3
#: Bits of the broadcast map of labelled ids, 8 MB.
BITS = 1 << 26
NOT_LETTERS = r"[^\p{L}\p{M}]+"
#: Words before a term in which a reporting word makes it a quotation, and what a quoted or reported term still weighs.
WINDOW, QUOTED, REPORTED = 5, 0.25, 0.5
#: Words that report speech or name a word, words that address the reader, paired quotation marks.
REPORTING = frozenset("said says say called calls word term quote quoted quoting wrote insult insults slur meaning dit appelle mot sagte sagt nannte wort dijo dice palabra llama".split())
ADDRESS = frozenset("you your youre u ur tu toi vous du dich dir ihr euch usted ustedes te".split())
QUOTES = re.compile(r'"[^"\n]{1,300}"|“[^”\n]{1,300}”|„[^“”\n]{1,300}[“”]|«[^»\n]{1,300}»|‘[^’\n]{1,300}’')
TOKEN = re.compile(r"[^\W_](?:[\w@$!*.+\-]*[^\W_])?")
LETTERS = re.compile(r"[^\W\d_]+")
SPACED = re.compile(r"(?<![^\W_])[^\W\d_](?:[ .*_\-][^\W\d_](?![^\W_])){3,}")
LOOKS = str.maketrans("013457@$!", "oieastasi")
MAX_STATES, MAX_WORDS = 20_000, 200_000  # what a worker remembers; it starts anew beyond


class Automaton:
    """The Levenshtein automata of all terms, intersected with their trie; edits are of a letter or of two neighbours' order."""

    def __init__(self, terms: list[str]):
        self.edits = [0 if len(t) < ONE_EDIT else 1 if len(t) < TWO_EDITS else 2 for t in terms]
        self.children: list[dict[str, int]] = [{}]
        self.most, self.ends = [0], [-1]
        for i, t in enumerate(terms):
            node = 0
            self.most[0] = max(self.most[0], self.edits[i])
            for c in t:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.most.append(0)
                    self.ends.append(-1)
                node = self.children[node][c]
                self.most[node] = max(self.most[node], self.edits[i])
            self.ends[node] = i
        self.letters = frozenset(c for kids in self.children for c in kids)
        self.forget()

    def forget(self) -> None:
        self.states: list[frozenset] = []
        self.ids: dict[frozenset, int] = {}
        self.moves: list[dict[str, int]] = []
        self.found: list[tuple[int, int] | None] = []
        self.start = self._add(self._closed({(0, 0, "")}))

    def _closed(self, states: set) -> frozenset:
        """With the letters of terms that a word may leave out."""
        todo = list(states)
        while todo:
            node, e, wait = todo.pop()
            if not wait:
                for kid in self.children[node].values():
                    s = (kid, e + 1, "")
                    if e < self.most[kid] and s not in states:
                        states.add(s)
                        todo.append(s)
        return frozenset(states)

    def _add(self, states: frozenset) -> int:
        if states not in self.ids:
            self.ids[states] = len(self.states)
            self.states.append(states)
            self.moves.append({})
            ends = [(e, self.ends[n]) for n, e, wait in states if not wait and self.ends[n] >= 0 and e <= self.edits[self.ends[n]]]
            self.found.append(min(ends) if ends else None)
        return self.ids[states]

    def _step(self, states: frozenset, c: str) -> frozenset:
        out = set()
        for node, e, wait in states:
            kids = self.children[node]
            if wait:  # the first of two letters in the other order is due
                if c == wait:
                    out.add((node, e, ""))
                continue
            if c in kids:
                out.add((kids[c], e, ""))
            if e < self.most[node]:
                out.add((node, e + 1, ""))
                for x, kid in kids.items():
                    if e < self.most[kid]:
                        if x != c:
                            out.add((kid, e + 1, ""))
                        after = self.children[kid].get(c)
                        if x != c and after is not None and e < self.most[after]:
                            out.add((after, e + 1, x))
        return self._closed(out)

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, term) of the nearest term within its edits, the first of equally near ones; None without."""
        if len(self.states) > MAX_STATES:
            self.forget()
        at = self.start
        for c in word:
            c = c if c in self.letters else ""
            to = self.moves[at].get(c)
            if to is None:
                to = self.moves[at][c] = self._add(self._step(self.states[at], c))
            at = to
            if not self.states[at]:
                return None
        return self.found[at]


class Lexicon:
    """terms with their weights, weights of forms by (term, edits), and weights of forms that were often seen."""

    def __init__(self, terms: dict[str, float], near: dict[tuple[int, int], float], forms: dict[str, tuple[int, float]]):
        self.terms, self.near, self.forms = terms, near, forms
        self.names = list(terms)
        self.automaton, self.known = None, {}

    def look_up(self, word: str) -> tuple[int, float] | None:
        """(term, weight) of a word."""
        if word in self.known:
            return self.known[word]
        if self.automaton is None:
            self.automaton = Automaton(self.names)
        if len(self.known) > MAX_WORDS:
            self.known = {}
        hit = self.forms.get(word)
        if hit is None and (m := self.automaton.match(word)):
            e, term = m
            hit = (term, self.terms[self.names[term]] if e == 0 else self.near.get((term, e), 0.0))
        self.known[word] = hit = hit if hit and hit[1] > 0 else None
        return hit

    def __getstate__(self):
        return self.terms, self.near, self.forms

    def __setstate__(self, state):
        self.__init__(*state)


def _hits(text: str, lexicon: Lexicon) -> tuple[list[tuple[int, int, int, float]], int]:
    """(start, end, term, weight) of the terms in a lower-case text, and its number of words."""
    found, n = [], 0
    for m in TOKEN.finditer(text):
        n += 1
        token = m[0]
        if token.isalpha():
            if hit := lexicon.look_up(token):
                found.append((m.start(), m.end(), *hit))
            continue
        before = len(found)
        for part in LETTERS.finditer(token):
            if hit := lexicon.look_up(part[0]):
                found.append((m.start() + part.start(), m.start() + part.end(), *hit))
        if len(found) == before and (whole := "".join(LETTERS.findall(token.translate(LOOKS)))) and (hit := lexicon.look_up(whole)):
            found.append((m.start(), m.end(), *hit))
    for m in SPACED.finditer(text):
        if hit := lexicon.look_up("".join(LETTERS.findall(m[0]))):
            found.append((m.start(), m.end(), *hit))
    return found, n


def contexts(text: str, found: list[tuple[int, int, int, float]]) -> Iterator[tuple[int, float, float]]:
    """(term, weight, factor) of each hit: 1 for abuse, less for terms between quotation marks or behind a reporting word, unless the reader is addressed in the window."""
    quoted = [m.span() for m in QUOTES.finditer(text)] if found else []
    i = 0
    for start, end, term, weight in sorted(found):
        while i < len(quoted) and quoted[i][1] < end:
            i += 1
        inside = i < len(quoted) and quoted[i][0] <= start
        words = LETTERS.findall(text[max(0, start - 80) : start])[-WINDOW:]
        behind = LETTERS.findall(text[end : end + 40])[:2]
        factor = QUOTED if inside else REPORTED if REPORTING.intersection(words) else 1.0
        if factor == REPORTED and ADDRESS.intersection([*words, *behind]):
            factor = 1.0
        yield term, weight, factor


def measures(text: str | None, lexicon: Lexicon) -> tuple[list[float], int, int]:
    """The features of a text, and how many of its hits are abuse and quotations."""
    text = (text or "").lower()
    found, n = _hits(text, lexicon)
    best: dict[int, float] = {}
    quoted, n_quoted, most = 0.0, 0, 0.0
    for term, weight, factor in contexts(text, found):
        best[term] = max(best.get(term, 0.0), weight * factor)
        most = max(most, weight * factor)
        if factor < 1:
            quoted, n_quoted = quoted + weight, n_quoted + 1
    total = sum(best.values())
    density = math.log1p(100 * total / (n + 20))
    return [math.log1p(total), most, density, math.log1p(n) if best else 0.0, math.log1p(len(best)), math.log1p(quoted)], len(found) - n_quoted, n_quoted


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, toxic of documents with a label; of several labels of a document the largest counts.

    Only documents whose hashed id is marked in a bitmap of BITS bits are joined, so that few texts without a label are shuffled.
    """
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(BITS)) + 1
    bits = marks.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit"))
    bits = bits.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))  # BITS / 8 bytes in all
    rows = docs.select("doc_id", "text", F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit")).join(F.broadcast(bits), "bucket")
    byte = F.conv(F.hex(F.substring("bits", F.expr("cast(bit div 8 + 1 as int)"), F.lit(1))), 16, 10).cast("int")
    rows = rows.where(F.call_function("shiftright", byte, (F.col("bit") % 8).cast("int")).bitwiseAND(1) == 1)
    return rows.select("doc_id", "text").hint("merge").join(marks, "doc_id").select("text", "toxic")


def _counted(rows: DataFrame) -> DataFrame:
    """word, n1, n0: toxic and other texts with a word; the empty word stands for all texts with words. Near copies, told by two equal
    min-hashes of their pairs of words, are one text."""
    words = rows.where("text is not null").select("toxic", F.array_remove(F.split(F.lower("text"), NOT_LETTERS), "").alias("words")).where("size(words) > 0")
    pair = lambda seed: lambda w, i: F.xxhash64(F.lit(seed), w, F.get(F.col("words"), i + 1))
    g = F.xxhash64(*[F.array_min(F.transform("words", pair(seed))) for seed in (1, 2)])
    packed = words.select("toxic", g.alias("g"), F.array_join(F.array_append(F.array_distinct("words"), F.lit("")), " ").alias("words"))
    one = packed.groupBy("g").agg(F.min_by("words", F.xxhash64("words")).alias("words"), F.max("toxic").alias("toxic"))
    return one.select("toxic", F.explode(F.split("words", " ")).alias("word")).groupBy("word").agg(F.sum("toxic").alias("n1"), F.sum(1 - F.col("toxic")).alias("n0"))


def _odds(n1: float, n0: float, all1: int, all0: int) -> float:
    return math.log(n1 / all1) - math.log(n0 / all0)


class Model:
    def __init__(self, lexicon: Lexicon, weights: list[float] | None, base: float):
        self.lexicon, self.weights, self.base = lexicon, weights, base


def train(rows: DataFrame) -> Model:
    """A model of rows (text, toxic 0 or 1). Words are counted over all rows; the weights of the features are fitted on about FIT_ROWS of them.

    The lexicon is small: a term takes MIN_SHARE of the toxic texts, so that there are at most 1 / MIN_SHARE terms for each
    distinct word of an average text. Without toxic rows every score is 0, without others it is 1.
    """
    spark = rows.sparkSession
    small_batches(spark)
    rows = staged(rows, "toxicity-rows")
    n = rows.agg(F.count("*").alias("all"), F.sum("toxic").alias("toxic")).first()
    if not n["toxic"] or n["toxic"] == n["all"]:
        return Model(Lexicon({}, {}, {}), None, float(bool(n["toxic"])))
    counts = staged(_counted(rows), "toxicity-words")
    texts = counts.where("word = ''").first()
    all1, all0 = (texts["n1"], texts["n0"]) if texts else (0, 0)
    if not all1 or not all0:
        return Model(Lexicon({}, {}, {}), None, n["toxic"] / n["all"])
    counts = counts.where("word <> ''")
    likely = counts.where((F.col("n1") >= MIN_TEXTS) & (F.col("n1") >= MIN_SHARE * all1) & (F.length("word") > 1))
    odds = F.log((F.col("n1") + 0.5) / all1) - F.log((F.col("n0") + 0.5) / all0)
    error = F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5))
    terms = {r["word"]: (r["odds"], r["n1"], r["n0"]) for r in likely.withColumn("odds", odds).where(odds - ERRORS * error > LEAST_ODDS).orderBy("word").collect()}
    names = list(terms)
    shared = spark.sparkContext.broadcast(names)

    def nearest(batches):
        automaton = Automaton(shared.value)
        exact = set(shared.value)
        for b in batches:
            got = [(i, *m) for i, w in enumerate(b.column(0).to_pylist()) if w not in exact and (m := automaton.match(w))]
            take = b.take(pa.array([i for i, _, _ in got], pa.int64()))
            yield pa.RecordBatch.from_arrays([*take.columns, pa.array([t for _, _, t in got], pa.int32()), pa.array([e for _, e, _ in got], pa.int32())], ["word", "n1", "n0", "term", "edits"])

    forms = staged(counts.select("word", "n1", "n0").mapInArrow(nearest, "word string, n1 long, n0 long, term int, edits int"), "toxicity-forms")
    shared.destroy()
    near, pooled = {}, forms.groupBy("term", "edits").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    sums = {(r["term"], r["edits"]): (r["n1"], r["n0"]) for r in pooled.collect()}  # two rows a term at most
    for i, (_, n1, n0) in enumerate(terms.values()):
        share1, share0 = (n1 + 0.5) / all1, (n0 + 0.5) / all0
        one, zero = share1 / (share1 + share0), share0 / (share1 + share0)
        for e in (1, 2):
            s1, s0 = sums.get((i, e), (0, 0))
            near[i, e] = BLUR**e * max(0.0, min(terms[names[i]][0], _odds(s1 + one, s0 + zero, all1, all0)))
    often = forms.where((F.col("n1") + F.col("n0") >= MIN_TEXTS) & ((F.col("n1") >= MIN_SHARE * all1) | (F.col("n0") >= MIN_SHARE * all0)))
    known = {}
    for r in often.collect():
        prior = 1 / (1 + math.exp(-near[r["term"], r["edits"]]))
        known[r["word"]] = (r["term"], max(0.0, min(terms[names[r["term"]]][0], _odds(r["n1"] + prior, r["n0"] + 1 - prior, all1, all0))))
    lexicon = Lexicon({t: x[0] for t, x in terms.items()}, near, known)
    share = min(1.0, FIT_ROWS / n["all"])
    fit = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20))).select("toxic", _measured(spark, lexicon)(F.col("text")).alias("m"))
    fit = staged(fit.select(F.col("toxic").cast("double").alias("label"), "m.x"), "toxicity-features").select("label", array_to_vector("x").alias("features"))
    if fit.select("label").distinct().count() < 2:
        return Model(lexicon, None, n["toxic"] / n["all"])
    model = LogisticRegression(maxIter=40, regParam=1e-4).fit(fit)
    return Model(lexicon, model.coefficients.tolist(), float(model.intercept))


def _measured(spark, lexicon: Lexicon):
    shared = spark.sparkContext.broadcast(lexicon)

    @F.pandas_udf("x array<double>, n_abuse long, n_quoted long")
    def measured(texts: pd.Series) -> pd.DataFrame:
        out = [measures(t, shared.value) for t in texts]
        return pd.DataFrame({"x": [x for x, _, _ in out], "n_abuse": [a for _, a, _ in out], "n_quoted": [q for _, _, q in out]})

    return measured


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with score (0 to 1), predicted (1 from the threshold on), n_abuse and n_quoted (terms found in either use).

    A null text is an empty one; texts without terms, empty ones included, have the score of none. Texts are read whole, whatever
    their length. Rows are scored one by one, so repeated rows agree; other columns stay, those named like a result are replaced.
    """
    small_batches(docs.sparkSession)
    found = docs.drop("score", "predicted", "n_abuse", "n_quoted").withColumn("__m", _measured(docs.sparkSession, model.lexicon)(F.col(text)))
    if model.weights is None:
        value: Column = F.lit(model.base)
    else:
        z = F.lit(model.base)
        for i, w in enumerate(model.weights):
            z = z + F.get(F.col("__m.x"), F.lit(i)) * w
        value = 1 / (1 + F.exp(-z))
    return found.select("*", value.alias("score"), "__m.n_abuse", "__m.n_quoted").drop("__m").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
