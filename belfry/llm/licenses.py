"""License scans by diagonal voting, in DataFrame functions only.

Every word pair of a text is hashed and joined to the template places with that hash (words compared
too, so hashes only speed up the join).  Hits vote for the diagonal ``place - template place`` they lie
on; neighbouring diagonals (a word more or less in between) are merged, and a span counts when
enough of its template's pairs were met.

Edge cases: null and empty texts have 0 words, no labels, score 0; repeated rows each get their row;
repeated phrases count every place; extra columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from belfry.session import written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ACCEPT = 0.7
MOST_WORDS = 64  # of a template
NEAR = 2  # diagonals this close belong to one span

# Base phrases, and this method's own templates (at most MOST_WORDS words each).
BASE = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]
OWN = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
]


def templates(df: DataFrame, base: list[tuple[str, str]] = BASE, own: list[tuple[str, str]] = OWN) -> DataFrame:
    """One row per word pair of every template; its size is fixed by the two lists."""
    long = [phrase for _, phrase in base + own if len(phrase.split(" ")) > MOST_WORDS]
    if long:  # one bit of a 64-bit word per pair: more would fall on those of other places
        raise ValueError(f"templates of more than {MOST_WORDS} words: {long}")
    rows = [(n, label, n < len(base), i, len(words) - 1, words[i], words[i + 1])
            for n, (label, phrase) in enumerate(base + own) for words in [phrase.split(" ")] for i in range(len(words) - 1)]
    schema = "template int, label string, is_base boolean, at int, pairs int, w0 string, w1 string"
    return df.sparkSession.createDataFrame(rows, schema).withColumn("h", F.xxhash64("w0", "w1"))


def license_scan(docs: DataFrame, base: list[tuple[str, str]] = BASE, own: list[tuple[str, str]] = OWN) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    pairs = templates(docs, base, own)
    firsts = sorted({phrase.split(" ")[i] for _, phrase in base + own for i in range(len(phrase.split(" ")) - 1)})
    lowered = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))
    read = docs.select("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("key"), words.alias("words"))
    grams = F.transform("words", lambda w, i: F.struct(i.alias("at"), w.alias("w0"), F.get(F.col("words"), i + 1).alias("w1")))
    # pairs whose first word starts no template pair can meet no template: they are left out before the rows fan out
    grams = F.filter(grams, lambda g: g["w0"].isin(firsts) & g["w1"].isNotNull())
    narrow = written(read.select("doc_id", "key", F.size("words").cast("long").alias("n_words"), grams.alias("grams")), "license-words")
    hits = (narrow.where(F.size("grams") > 0).select("key", F.explode("grams").alias("g"))
            .select("key", F.col("g.at").alias("place"), F.col("g.w0").alias("w0"), F.col("g.w1").alias("w1"))
            .withColumn("h", F.xxhash64("w0", "w1"))
            .join(F.broadcast(pairs), ["h", "w0", "w1"]))  # the template list is fixed: a few hundred rows at most
    # a bit per template place: copies of one text vote once
    votes = (hits.groupBy("key", "template", "label", "is_base", "pairs", (F.col("place") - F.col("at")).alias("diagonal"))
             .agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("met")))
    order = Window.partitionBy("key", "template").orderBy("diagonal")
    new = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > NEAR).cast("int"), F.lit(1))
    spans = (votes.withColumn("new", new).withColumn("span", F.sum("new").over(order))
             .groupBy("key", "template", "label", "is_base", "pairs", "span")
             .agg(F.bit_or("met").alias("met"),
                  F.count(F.when(F.bit_count("met") == F.col("pairs"), 1)).alias("whole"),
                  F.min(F.when(F.bit_count("met") == F.col("pairs"), F.col("diagonal"))).alias("first"),
                  F.max(F.when(F.bit_count("met") == F.col("pairs"), F.col("diagonal"))).alias("last"))
             .withColumn("share", F.bit_count("met") / F.col("pairs")))
    base_place = F.col("is_base") & (F.col("whole") > 0)
    kept = base_place | (~F.col("is_base") & (F.col("share") >= ACCEPT))
    def joined(label):
        return F.array_join(F.array_sort(F.collect_set(label)), ",")
    found = spans.groupBy("key").agg(
        F.sum(F.when(base_place, F.col("whole"))).alias("n_base"),
        F.min(F.when(base_place, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(base_place, F.col("last"))).cast("long").alias("last_word"),
        joined(F.when(base_place, F.col("label"))).alias("base_labels"),
        joined(F.when(kept, F.col("label"))).alias("labels"),
        F.max(F.when(kept, F.col("share"))).alias("score"))
    return (narrow.select("doc_id", "key", "n_words").join(found, "key", "left")
            .select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
                    F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
                    F.coalesce("score", F.lit(0.0)).alias("score")))
