"""License scan by diagonal voting.

All rolling word 2-grams of every text are looked up by their hash, and those with a
template's hash join the templates' 2-grams on hash and words; a match at word p of the text and position t of the template is a vote for the
diagonal p - t. A diagonal that gets every vote of a short phrase is a place of that
phrase. For longer notices the votes of neighbouring diagonals (a word more or less)
are merged, and their span is verified: of the merged votes, which are equal words and not
hashes alone, each place of the notice keeps the one nearest to the diagonal, and only
those that stand in the text in the notice's order count. A label holds where these cover
enough of the notice; the verified cover is the score.

Templates are a parameter. Up to ``MAX_TEMPLATE_WORDS`` words they are broadcast and only
places with a template's hash become rows; a larger library is joined by a shuffle on the
hash, with the same result. A text's rows meet again by (doc_id, hash of the text), so a hot source or
group of copies spreads evenly; only one text's own matches share a task.

Defined cases: a null or empty text has no words, no places and score 0; a null doc_id
is kept; rows repeated in full each give their own result row; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import with_copies

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Label and words of the phrases that make the base.
PHRASES = (
    ("mit", "mit license"),
    ("apache", "apache license"),
    ("gpl", "general public license"),
)

#: Label and words of the notices that the method adds.
NOTICES = (
    ("notice-mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("notice-mit", "released under the mit license"),
    ("notice-apache", "licensed under the apache license version 2 0"),
    ("notice-gpl", "this work is licensed under the gnu general public license version 3"),
    ("notice-gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("notice-bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("notice-cc-by-nc", "licensed under cc by nc 4 0"),
)

MAX_TEMPLATE_WORDS = 50_000
"""The bound of what is broadcast; more words are joined by a shuffle."""
SENTINEL = -1


def words_of(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    plain = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWERED))
    return F.regexp_extract_all(plain, F.lit(WORD), F.lit(0))


def _template_grams(spark, phrases, notices) -> tuple[DataFrame, int]:
    """A row for each 2-gram of the templates and one for the end of a text, and how many words the templates have."""
    rows, n = [], 0
    for t, (label, words) in enumerate([*phrases, *notices]):
        words = words.split()
        if len(words) < 2:
            raise ValueError("a template needs two words at least")
        n += len(words)
        rows += [(t, label, t < len(phrases), len(words) - 1, i, *words[i : i + 2]) for i in range(len(words) - 1)]
    grams = spark.createDataFrame(rows, "t int, label string, base boolean, need int, at int, a string, b string").coalesce(1)
    ends = spark.createDataFrame([(SENTINEL, None, False, 0, 0, "", "")], grams.schema).coalesce(1)
    return grams.union(ends).select("t", "label", "base", "need", "at", F.col("a").alias("ta"), F.col("b").alias("tb"), F.xxhash64("a", "b").alias("hash")), n


def in_order(band: Column, diagonal: Column) -> Column:
    """How many places of the notice stand in the text in its order, from votes struct(at, d) near a diagonal."""
    nearest = F.array_sort(F.transform(band, lambda v: F.struct(v["at"].alias("at"), F.abs(v["d"] - diagonal).alias("off"), v["d"].alias("d"))))
    start = F.struct(F.lit(-1).alias("at"), F.lit(-(1 << 30)).alias("last"), F.lit(0).alias("n"))

    def step(state: Column, v: Column) -> Column:
        word = v["at"] + v["d"]
        first, after = v["at"] != state["at"], word > state["last"]
        return F.struct(v["at"].alias("at"), F.when(first & after, word).otherwise(state["last"]).alias("last"), (state["n"] + (first & after).cast("int")).alias("n"))

    return F.aggregate(nearest, start, step)["n"]


def scan(docs: DataFrame, phrases=PHRASES, notices=NOTICES, reach: int = 2, cover: float = 0.6) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and the spans of notices."""
    spark = docs.sparkSession
    templates, n_words = _template_grams(spark, phrases, notices)
    few = n_words <= MAX_TEMPLATE_WORDS
    known = [r["hash"] for r in templates.select("hash").distinct().collect()] if few else []  # MAX_TEMPLATE_WORDS at most
    words = docs.select("doc_id", F.xxhash64("text").alias("text_key"), words_of(F.col("text")).alias("w"))
    # places whose 2-gram has the hash of some template's; the others are not made rows, but where templates are many
    may = (lambda x, i: F.xxhash64(x, F.get("w", i + 1)).isin(known)) if few else (lambda x, i: i < F.size("w") - 1)
    places = F.filter(F.transform("w", lambda x, i: F.when(may(x, i), i)), lambda i: i.isNotNull())
    grams = words.select("doc_id", "text_key", "w", F.explode(F.concat(places, F.array(F.size("w")))).alias("p"))
    word = lambda i: F.coalesce(F.get("w", i), F.lit(""))
    grams = grams.select("doc_id", "text_key", "p", word(F.col("p")).alias("a"), word(F.col("p") + 1).alias("b"))
    votes = grams.withColumn("hash", F.xxhash64("a", "b"))
    if few:
        votes = votes.join(F.broadcast(templates), ["hash"])
    else:
        # ends of texts would be one hot key of the join; the row that they meet is one
        ends = votes.filter("a = ''").crossJoin(F.broadcast(templates.filter(F.col("t") == SENTINEL).drop("hash")))
        votes = votes.filter("a <> ''").join(templates.filter(F.col("t") != SENTINEL), ["hash"]).unionByName(ends)
    votes = votes.filter((F.col("a") == F.col("ta")) & (F.col("b") == F.col("tb")))
    votes = votes.select("doc_id", "text_key", "t", "label", "base", "need", "at", (F.col("p") - F.col("at")).alias("diagonal"))

    # from here on one text's rows stay together: no further exchange
    votes = votes.repartition("doc_id", "text_key")
    diagonals = votes.groupBy("doc_id", "text_key", "t", "label", "base", "need", "diagonal").agg(F.count("*").alias("n"), F.collect_set("at").alias("ats"))
    near = Window.partitionBy("doc_id", "text_key", "t").orderBy("diagonal").rangeBetween(-reach, reach)
    band = F.flatten(F.collect_list(F.transform("ats", lambda at: F.struct(at.alias("at"), F.col("diagonal").alias("d")))).over(near))
    merged = diagonals.withColumn("covered", F.when(~F.col("base") & (F.col("t") >= 0), in_order(band, F.col("diagonal")) / F.col("need")))
    place = F.col("base") & (F.size("ats") == F.col("need"))
    notice = F.coalesce(F.col("covered") >= cover, F.lit(False))
    end = F.col("t") == SENTINEL
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    out = merged.groupBy("doc_id", "text_key").agg(
        F.max(F.when(end, F.col("diagonal"))).cast("long").alias("n_words"),
        F.max(F.when(end, F.col("n"))).alias("copies"),
        F.count(F.when(place, 1)).alias("n_base"),
        F.min(F.when(place, F.col("diagonal"))).cast("long").alias("first_word"),
        F.max(F.when(place, F.col("diagonal"))).cast("long").alias("last_word"),
        joined(F.when(place, F.col("label"))).alias("base_labels"),
        joined(F.when(place | notice, F.col("label"))).alias("labels"),
        F.coalesce(F.max(F.when(place, 1.0).when(notice, F.col("covered"))), F.lit(0.0)).alias("score"),
        F.min(F.when(notice, F.col("diagonal"))).cast("long").alias("first_notice"),
        F.max(F.when(notice, F.col("diagonal") + F.col("need") + 1)).cast("long").alias("notice_end"),
    )
    return with_copies(out, "copies").drop("text_key")
