"""License scans by diagonal voting; DataFrame functions only.

All runs of K words of all texts are joined, by their hash and then their words, to the places they
have in license phrases and notices.  A match votes for a diagonal, the difference of both places;
votes are added up per text, template and diagonal, neighbouring diagonals (words put in or left
out) are merged into one span, and a span counts if it holds enough of the template's runs in
not too many words.  A phrase must be there in full; each such place is a base find.

Defined results: a null text is empty; a text without finds has empty labels, null places and
score 0; rows that repeat an id are scanned one by one (rows equal in id and text give equal
rows); other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.runtime import pin

K = 3
#: share of a notice's word runs that a span must hold, and its most words as a multiple of the notice's
LEAST_SHARE, MOST_STRETCH = 0.6, 1.5
#: diagonals at most so far apart, and spans at most so many words apart, are merged
NEAR_DIAGONALS, NEAR_WORDS = 8, 16

#: fixed values: words are runs of letters, digits and all characters beyond ASCII
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
KELVIN = "K"  # the one character beyond ASCII whose lower case is an ASCII letter

# fixed values: phrases that must stand in full, with their labels
BASE_PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
MORE_PHRASES = (
    ("gnu general public license", "gpl"), ("gnu lesser general public license", "lgpl"), ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"), ("bsd 2 clause license", "bsd"), ("bsd 3 clause license", "bsd"),
    ("creative commons attribution", "cc-by"), ("cc by sa", "cc-by-sa"), ("cc by nd", "cc-by-nd"), ("the unlicense license", "unlicense"),
    ("under the isc license", "isc"), ("licensed under the apache license", "apache-2"),
)
# fixed values: openings of public license texts
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction including without limitation the "
            "rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at "
                 "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing "
                 "software distributed under the license is distributed on an as is basis without warranties or conditions "
                 "of any kind either express or implied"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that "
            "the following conditions are met redistributions of source code must retain the above copyright notice this "
            "list of conditions and the following disclaimer"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
            "public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
            "granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not "
            "distributed with this file you can obtain one at http mozilla org mpl 2 0"),
)


def _words(text: Column) -> Column:
    """Lower-cased words; lower case outside ASCII never makes an ASCII word."""
    plain = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit(KELVIN), F.lit("å")))
    return F.regexp_extract_all(plain, F.lit(WORD), F.lit(0))


def templates(docs: DataFrame, k: int) -> DataFrame:
    """One row per template and run of k words: a few hundred rows, fixed by the constants above."""
    rows = []
    kinds = [(p, lab, "base") for p, lab in BASE_PHRASES] + [(p, lab, "phrase") for p, lab in MORE_PHRASES] + [
        (t, lab, "notice") for lab, t in NOTICES
    ]
    for number, (text, label, kind) in enumerate(kinds):
        words = re.findall(WORD, text)
        rows += [
            (" ".join(words[i: i + k]), number, i, len(words), len(words) - k + 1, label, kind) for i in range(len(words) - k + 1)
        ]
    shape = "t_gram string, template int, t_pos int, t_words int, t_grams int, label string, kind string"
    return docs.sparkSession.createDataFrame(rows, shape).withColumn("t_hash", F.xxhash64("t_gram"))


def matches(docs: DataFrame, k: int = K) -> DataFrame:
    """Places (doc_id, digest, pos) of word runs that are in a template, at (template, t_pos)."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("digest"), _words(F.col("text")).alias("words")).filter(F.size("words") >= k)
    w = F.col("words")
    grams = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.concat_ws(" ", *[w[i + j] for j in range(k)]))
    every = rows.select("doc_id", "digest", F.posexplode(grams).alias("pos", "gram")).withColumn("hash", F.xxhash64("gram"))
    known = F.broadcast(templates(docs, k))
    return every.join(known, (F.col("hash") == F.col("t_hash")) & (F.col("gram") == F.col("t_gram"))).select(
        "doc_id", "digest", "pos", "template", "t_pos", "t_words", "t_grams", "label", "kind"
    ).distinct()


def spans(found: DataFrame) -> DataFrame:
    """Verified spans (first, last word) of templates, and the share of the template they hold."""
    key = ["doc_id", "digest", "template"]
    about = ["t_words", "t_grams", "label", "kind"]
    diagonals = found.withColumn("diagonal", F.col("pos") - F.col("t_pos")).groupBy(*key, *about, "diagonal").agg(
        F.min("pos").alias("first"), F.max("pos").alias("last"), F.collect_set("t_pos").alias("places")
    )
    exact = diagonals.filter((F.col("kind") != "notice") & (F.size("places") == F.col("t_grams"))).select(
        "doc_id", "digest", "label", "kind", "first", F.lit(1.0).alias("share")
    )
    along = Window.partitionBy(*key).orderBy("first", "diagonal")
    new = F.coalesce(
        (F.abs(F.col("diagonal") - F.lag("diagonal").over(along)) > NEAR_DIAGONALS)
        | (F.col("first") - F.lag("last").over(along) > NEAR_WORDS), F.lit(True),
    )
    merged = diagonals.filter("kind = 'notice'").withColumn("new", new.cast("int")).withColumn(
        "span", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0))
    ).groupBy(*key, *about, "span").agg(
        F.min("first").alias("first"), F.max("last").alias("last"),
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("held"),
    )
    share = F.col("held") / F.col("t_grams")
    close = merged.filter((share >= LEAST_SHARE) & (F.col("last") - F.col("first") + K <= MOST_STRETCH * F.col("t_words"))).select(
        "doc_id", "digest", "label", "kind", "first", share.alias("share")
    )
    return exact.unionByName(close)


def license_report(docs: DataFrame) -> DataFrame:
    """Per document: base phrases by number and place, the labels of these and of all finds, and the best share."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = F.col("kind") == "base"
    finds = spans(pin(matches(texts))).groupBy(F.col("doc_id").alias("f_doc"), F.col("digest").alias("f_digest")).agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("first"))).cast("bigint").alias("first_word"),
        F.max(F.when(base, F.col("first"))).cast("bigint").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.max("share").alias("score"),
    )
    rows = texts.select("doc_id", F.xxhash64("text").alias("digest"), F.regexp_count(
        "text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    ).cast("bigint").alias("n_words"))
    return rows.join(finds, F.col("doc_id").eqNullSafe(F.col("f_doc")) & (F.col("digest") == F.col("f_digest")), "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
