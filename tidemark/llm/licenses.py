"""License scans by diagonal voting over rolling word k-gram hashes, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, staged

TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases that name a license, and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Whole texts, openings and notices of public licenses, and their labels.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software", "isc"),
    ("this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions", "zlib"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "apache"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version", "gpl"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "lgpl"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "isc"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "mpl"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", "unlicense"),
)
SHORT, LONG = 2, 4
#: Diagonals at most this far apart are one alignment; one that covers this share of its template's k-grams is a match.
NEAR, COVER = 6, 0.7


def words(text: Column) -> Column:
    """A-Z lower-cased, then runs of digits, a-z and non-ASCII characters; none for null."""
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def gram_hash(k: int, words: list[Column]) -> Column:
    return F.xxhash64(F.lit(k), *words)


def templates(spark, phrases=PHRASES, notices=NOTICES) -> list[tuple]:
    """(template, label, base, k, n, tpos, words): a row for each k-gram of a text, of which it has n; bounded by the given texts."""
    rows = []
    for i, (text, label) in enumerate([*phrases, *notices]):
        w, k = text.split(" "), SHORT if i < len(phrases) else LONG
        n = len(w) - k + 1
        rows += [(i, label, i < len(phrases), k, n, at, " ".join(w[at : at + k])) for at in range(n)]
    return rows


def hits(docs: DataFrame, text: Column) -> DataFrame:
    """docs with n_words and hits: (k, dpos, words) of the k-grams of text whose hash is one of a template's.

    All rolling k-gram hashes of a text are made in one pass and met with the set of the templates' hashes, so that only those
    few go on to the join.
    """
    spark = docs.sparkSession
    known = spark.createDataFrame(sorted({(t[3], t[6]) for t in templates(spark)}), "k int, words string").withColumn("w", F.split("words", " "))
    known = known.withColumn("h", F.coalesce(*[F.when(F.col("k") == k, gram_hash(k, [F.get("w", F.lit(j)) for j in range(k)])) for k in (SHORT, LONG)]))
    hashes = {k: [r["h"] for r in known.where(F.col("k") == k).collect()] for k in (SHORT, LONG)}  # the templates' own, a few hundred
    docs = docs.withColumn("__w", words(text))

    def found(k: int) -> Column:
        made = F.transform("__w", lambda w, i: F.struct(F.lit(k).alias("k"), i.cast("long").alias("dpos"), gram_hash(k, [w, *[F.get(F.col("__w"), i + j) for j in range(1, k)]]).alias("h")))
        kept = F.filter(made, lambda x: x["h"].isin(hashes[k]) & (x["dpos"] + k <= F.size("__w")))
        return F.transform(kept, lambda x: F.struct(x["k"].alias("k"), x["dpos"].alias("dpos"), F.concat_ws(" ", F.slice("__w", (x["dpos"] + 1).cast("int"), F.lit(k))).alias("words")))

    return docs.withColumns({"n_words": F.size("__w").cast("long"), "hits": F.concat(found(SHORT), found(LONG))}).drop("__w")


def _verified(votes: DataFrame, spans: DataFrame, key: list[str]) -> DataFrame:
    """spans that are phrases or no longer than twice their template, and of the longer ones those that hold a place where a template's
    length of diagonals alone has votes enough, with the best such share."""
    longer = ~F.col("base") & (F.col("length") > 2 * F.col("n"))
    one = [*key, "template", "span"]
    again = spans.where(longer).select(*one, "label", "base", "n", "at", "length")
    inside = Window.partitionBy(*one).orderBy(F.col("diagonal") / F.col("n")).rangeBetween(0, 1)
    slid = votes.select(*[F.col(c).alias(f"__{c}") for c in one], "diagonal", "tpos")
    same = F.lit(True)
    for c in one:
        same = same & slid[f"__{c}"].eqNullSafe(again[c])
    slid = again.join(slid, same).select(*one, "label", "base", "n", "at", "length", F.size(F.collect_set("tpos").over(inside)).alias("votes"))
    best = slid.groupBy(*one, "label", "base", "n", "at", "length").agg(F.max("votes").alias("votes"))
    best = best.withColumn("share", F.least(F.col("votes") / F.col("n"), F.lit(1.0))).where(F.col("share") >= COVER)
    return spans.where(~longer).unionByName(best.select(*spans.columns))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, one row for each input row.

    All rolling 2-gram hashes of the words are met with those of the phrases, all 4-gram hashes with those of the notices; what
    meets is joined to the template positions on its words, so that no collision of hashes counts. Hits vote for their offset,
    the diagonal. A phrase stands where all its k-grams vote for one diagonal. For notices, diagonals at most NEAR apart are
    merged, so that a few words put in or left out don't part an alignment; a span is verified if the different template
    positions that its words match, each counted once, are at least COVER of all, in no more than twice the template's length; in a
    longer span, as repeated fragments beside a text make it, so are those of some stretch of a template's length of diagonals.
    score is the largest covered share of a verified span, 1 with a phrase, 0 without any. Null texts have no words. Rows
    repeated in full get equal results; rows that share a doc_id but not the text each get their own; ties of labels are
    listed once; an empty table gives an empty result; other columns are ignored, whatever their names.
    """
    own = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    plain = docs.select(F.col(doc_id).alias("doc_id"), own.alias("th"), F.col(text).alias("text"))
    rows = staged(hits(plain, F.col("text")).select("doc_id", "th", "n_words", "hits"), "license-hits")
    key = ["doc_id", "th"]
    table = F.broadcast(docs.sparkSession.createDataFrame(templates(docs.sparkSession), "template int, label string, base boolean, k int, n int, tpos int, words string"))
    found = rows.where(F.size("hits") > 0).dropDuplicates(key).select(*key, F.inline("hits")).join(table, ["k", "words"])
    found = found.select(*key, "template", "label", "base", "n", "tpos", (F.col("dpos") - F.col("tpos")).alias("diagonal"))
    by_doc = Window.partitionBy(*key, "template").orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(by_doc)
    own_span = F.col("base") & (gap > 0)  # a phrase's diagonals are spans of their own
    votes = found.withColumn("new", F.when(gap.isNull() | (gap > NEAR) | own_span, 1).otherwise(0)).withColumn("span", F.sum("new").over(by_doc))
    place = F.col("diagonal") + F.col("tpos")
    spans = votes.groupBy(*key, "template", "label", "base", "n", "span").agg(F.size(F.collect_set("tpos")).alias("votes"), F.min("diagonal").alias("at"), (F.max(place) - F.min(place) + 1).alias("length"))
    spans = spans.withColumn("share", F.least(F.col("votes") / F.col("n"), F.lit(1.0))).where(F.when(F.col("base"), F.col("votes") == F.col("n")).otherwise(F.col("share") >= COVER))
    spans = _verified(votes, spans, key)
    base = F.when(F.col("base"), F.col("at"))
    label = lambda c: F.concat_ws(",", F.array_sort(F.collect_set(c)))
    per = spans.groupBy(*key).agg(
        F.count(base).alias("n_base"), F.min(base).cast("long").alias("first_word"), F.max(base).cast("long").alias("last_word"),
        label(F.when(F.col("base"), F.col("label"))).alias("base_labels"), label(F.col("label")).alias("labels"), F.max("share").alias("score"),
    )
    per = per.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    all_rows = rows.select(*key, "n_words")
    out = all_rows.join(per, all_rows["doc_id"].eqNullSafe(per["d"]) & (all_rows["th"] == per["t"]), "left")
    none = {"n_base": F.lit(0).cast("long"), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0)}
    return out.select("doc_id", "n_words", *[F.coalesce(c, none[c]).alias(c) if c in none else c for c in ("n_base", "first_word", "last_word", "base_labels", "labels", "score")])
