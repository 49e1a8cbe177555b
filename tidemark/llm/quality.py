"""Quality rules: repetition counts and divergence from language references, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, WORD, staged

CLASSES = ("lower", "upper", "digit", "space", "symbol", "punct", "other")
#: Common words of a language: so many that the most of its documents hold, of at most MAX_WORD characters, which bounds their table.
N_COMMON, MAX_WORD = 50, 30
LETTERS = r"[\p{L}\p{N}]+"
#: A document is rejected if a distance (Jensen-Shannon, base 2, 0 to 1) is above both the floor and the factor times the
#: median of its language. Distances of words are compared times the root of their number: n words drawn from the reference
#: itself are about 1 / sqrt(n) away from it.
QUANTILE, CLASS_FACTOR, CLASS_FLOOR, WORD_FACTOR, WORD_FLOOR = 0.5, 2.75, 0.2, 1.5, 0.25
#: Lengths below which a document isn't judged, and the largest scaled distance that the median tells apart.
MIN_CHARS, MIN_WORDS, MAX_SCALED = 200, 100, 100.0
BROADCAST_LANGS = 10_000
#: Common words are looked up by hash in so many buckets, most of which hold one or none.
BUCKETS = 64


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def _repeat_words(df: DataFrame, out: str) -> DataFrame:
    """df with out: the words (of array w) in 3-word windows that occur twice or more in the array."""
    df = df.withColumn("__h", F.transform(F.expr("slice(w, 1, greatest(size(w) - 2, 0))"), lambda x, i: F.xxhash64(x, F.get(F.col("w"), i + 1), F.get(F.col("w"), i + 2))))
    pairs = F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    some = F.size(F.array_distinct("__h")) < F.size("__h")
    df = df.withColumn("__p", F.when(some, pairs))
    near = lambda x, j: (x["h"] == F.get(F.col("__p"), j - 1)["h"]) | (x["h"] == F.get(F.col("__p"), j + 1)["h"])
    df = df.withColumn("__s", F.sort_array(F.transform(F.filter("__p", lambda x, j: F.coalesce(near(x, j), F.lit(False))), lambda x: x["i"])))
    width = F.transform("__s", lambda s, j: F.least(F.lit(3), F.coalesce(F.get(F.col("__s"), j + 1) - s, F.lit(3))))
    covered = F.aggregate(width, F.lit(0).cast("long"), lambda a, n: a + n)
    return df.withColumn(out, F.coalesce(covered, F.lit(0).cast("long"))).drop("__h", "__p", "__s")


def _runs(text: Column) -> Column:
    """The words that common words are sought among: runs of letters and digits, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(LETTERS), F.lit(0))


def _bucket(word: Column) -> Column:
    return F.pmod(F.hash(word), F.lit(BUCKETS))


def _letter(i: Column) -> Column:
    """The character that stands for word number i, from 0, of a list."""
    return F.char(i + 65)


def letters(words: Column) -> Column:
    """BUCKETS maps of the words of a list to their letters: a word's map is that of its bucket."""
    entries = F.transform(words, lambda w, i: F.struct(_bucket(w).alias("b"), w.alias("w"), _letter(i).alias("c")))
    pairs = lambda b: F.transform(F.filter(entries, lambda e: e["b"] == b), lambda e: F.struct(e["w"], e["c"]))
    return F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda b: F.map_from_entries(pairs(b)))


def common_words(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """word_lang, list: for each non-null language the N_COMMON words that the most documents hold; ties go by the word.

    A word counts once a document, so that a text of one word repeated adds one. Counts are summed before the shuffle, and the
    ranking keeps N_COMMON words of each partition and language before its own.
    """
    words = docs.where(F.col(lang).isNotNull()).select(F.col(lang).alias("word_lang"), F.explode(F.array_distinct(_runs(F.col(text)))).alias("word"))
    counts = words.where(F.length("word") <= MAX_WORD).groupBy("word_lang", "word").agg(F.count("*").alias("n"))
    best = Window.partitionBy("word_lang").orderBy(F.desc("n"), "word")
    top = counts.withColumn("k", F.row_number().over(best)).where(F.col("k") <= N_COMMON)
    pairs = top.groupBy("word_lang").agg(F.sort_array(F.collect_list(F.struct("k", "word"))).alias("pairs"))
    return pairs.select("word_lang", F.col("pairs.word").alias("list"))


def _small(df: DataFrame) -> DataFrame:
    """A written table of a row for each language, broadcast if it has at most BROADCAST_LANGS of them."""
    return F.broadcast(df) if df.count() <= BROADCAST_LANGS else df


def measures(docs: DataFrame, words: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, lang, the base counts, and histograms: chars (by CLASSES) and common (other words, then its language's common words, padded by 0)."""
    df = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    words = words.withColumn("letters", letters(F.col("list")))
    df = df.join(words, df["lang"] == words["word_lang"], "left").drop("word_lang")
    df = df.withColumns({"w": F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), "lines": F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    df = _repeat_words(df, "n_repeat_words")
    space = _count(F.col("text"), SPACE)
    df = df.withColumns({
        "n_words": F.size("w").cast("long"), "n_all": F.length("text").cast("long"), "space": space, "n_symbols": _count(F.col("text"), r"[#*$%&|<>]"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"), "upper": _count(F.col("text"), "[A-Z]"), "digit": _count(F.col("text"), "[0-9]"),
        "punct": _count(F.col("text"), r"[!\"'()+,\-./:;=?@\[\\\]^_`{}~]"), "other": _count(F.col("text"), r"[^\x09-\x0D\x20-\x7E]"),
    }).withColumn("word_chars", F.col("n_all") - F.col("space"))
    lower = F.col("n_all") - F.col("space") - F.col("n_symbols") - F.col("upper") - F.col("digit") - F.col("punct") - F.col("other")
    df = df.withColumn("runs", F.when(F.col("list").isNotNull(), _runs(F.col("text"))))
    # a text's common words as a string of their letters: a lookup a word, where comparing each with the whole list took most of the time
    df = df.withColumn("seen", F.array_join(F.transform("runs", lambda w: F.get(F.col("letters"), _bucket(w))[w]), ""))
    known = F.transform("list", lambda w, i: (F.length("seen") - F.length(F.replace(F.col("seen"), _letter(i), F.lit("")))).cast("long"))
    rest = (F.size("runs") - F.length("seen")).cast("long")
    pad = F.array_repeat(F.lit(0).cast("long"), F.lit(N_COMMON) - F.size("list"))
    chars = F.array(lower, "upper", "digit", "space", "n_symbols", "punct", "other")
    common = F.when(F.col("list").isNotNull(), F.concat(F.array(rest), known, pad))
    return df.select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", chars.alias("chars"), common.alias("common"))


def references(stats: DataFrame) -> DataFrame:
    """lang_key, ref_chars, ref_common: sums over all documents of each language that pass the base rules, and over all (null)."""
    n, m = len(CLASSES), N_COMMON + 1
    add = lambda col, size: F.array(*[F.sum(F.coalesce(F.get(F.col(col), F.lit(i)), F.lit(0))) for i in range(size)])
    good = stats.where(~base_failed())
    per = good.groupBy(F.col("lang").alias("lang_key")).agg(add("chars", n).alias("ref_chars"), add("common", m).alias("ref_common")).where("lang_key is not null")
    every = good.agg(add("chars", n).alias("ref_chars")).select(F.lit(None).cast("string").alias("lang_key"), "ref_chars", F.lit(None).cast("array<bigint>").alias("ref_common"))
    return per.unionByName(every)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def js_distance(df: DataFrame, p: str, q: str, out: str) -> DataFrame:
    """df with out: the Jensen-Shannon distance of two histograms of counts, base 2; null if either is null or empty."""
    total = {f"__{c}": F.aggregate(c, F.lit(0.0), lambda a, v: a + v) for c in (p, q)}
    df = df.withColumns(total)
    share = lambda c: F.transform(c, lambda x: x / F.nullif(F.col(f"__{c}"), F.lit(0.0)))
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    terms = F.zip_with(share(p), share(q), lambda a, b: part(a, (a + b) / 2) + part(b, (a + b) / 2))
    total = F.aggregate(terms, F.lit(0.0), lambda a, v: a + v) / 2
    both = (F.col(f"__{p}") > 0) & (F.col(f"__{q}") > 0)
    return df.withColumn(out, F.when(both, F.sqrt(F.greatest(total, F.lit(0.0))))).drop(f"__{p}", f"__{q}")


def distances(stats: DataFrame, refs: DataFrame) -> DataFrame:
    """stats with char_distance and word_distance in place of the histograms, and word_scaled, the latter times the root of the words."""
    has = stats.join(_small(refs), stats["lang"].eqNullSafe(refs["lang_key"]), "left")
    has = js_distance(js_distance(has, "chars", "ref_chars", "char_distance"), "common", "ref_common", "word_distance")
    n_runs = F.aggregate("common", F.lit(0).cast("long"), lambda a, v: a + v)
    has = has.withColumns({"n_all": F.aggregate("chars", F.lit(0).cast("long"), lambda a, v: a + v), "word_scaled": F.col("word_distance") * F.sqrt(n_runs)})
    return has.drop("chars", "common", "ref_chars", "ref_common", "lang_key")


def limits(far: DataFrame) -> DataFrame:
    """limit_lang, char_mid, word_mid: QUANTILE of the distances of each language's documents that pass the base rules and are long enough.

    Distances are rounded and bounded before, so that a group holds at most 10,001 different values however many its rows are.
    """
    good = far.where(~base_failed())
    char = F.when(F.col("n_all") >= MIN_CHARS, F.round("char_distance", 4))
    word = F.when(F.col("n_words") >= MIN_WORDS, F.least(F.round("word_scaled", 2), F.lit(MAX_SCALED)))
    return good.groupBy(F.col("lang").alias("limit_lang")).agg(F.percentile(char, F.lit(QUANTILE)).alias("char_mid"), F.percentile(word, F.lit(QUANTILE)).alias("word_mid"))


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, char_distance, word_distance.

    A document that passes the base rules is kept unless its character classes are too far from all those of its language
    (texts of MIN_CHARS on), or its shares of the language's common words are (texts of MIN_WORDS on); what is too far
    follows from the language's median. Documents of a null language are compared with all documents' classes, and not by words.
    Null texts have no words and fail the base rules; repeated rows are judged each; an empty table gives an empty result.
    """
    words = staged(common_words(docs, text, lang), "quality-words")
    stats = staged(measures(docs, _small(words), doc_id, text, lang), "quality")
    far = staged(distances(stats, staged(references(stats), "quality-refs")), "quality-distances")
    mid = staged(limits(far), "quality-limits")
    has = far.join(_small(mid), far["lang"].eqNullSafe(mid["limit_lang"]), "left")
    odd_chars = (F.col("n_all") >= MIN_CHARS) & (F.col("char_distance") > F.greatest(F.lit(CLASS_FLOOR), CLASS_FACTOR * F.col("char_mid")))
    odd_words = (F.col("n_words") >= MIN_WORDS) & (F.col("word_distance") > WORD_FLOOR) & (F.col("word_scaled") > WORD_FACTOR * F.col("word_mid"))
    kept = ~(base_failed() | F.coalesce(odd_chars, F.lit(False)) | F.coalesce(odd_words, F.lit(False)))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return has.select("doc_id", *counts, base_failed().alias("base_failed"), kept.alias("kept"), "char_distance", "word_distance")
