"""Licences named or quoted in texts, by a positional index of rare licence words.

Every row keeps the positions of licence words other than everyday ones, with the words around
those that a phrase may be recognised by. How many documents hold each of these words gives its
weight. Of each file the words of highest weight are looked up in the index of template positions,
and postings are intersected by where the template would begin: those that agree within `SLIP`
words, so that a notice with words put in or left out stays together. A template is reported where
the words in place have `LEAST_SHARE` of its weight and its mandatory key phrase stands there word
for word. A key phrase alone is so refused, and a notice that was changed a little is found.

Only DataFrame functions are used. The index is made from the templates below, a few hundred
postings; it and the key phrases are the only things that are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelscope.llm.stages import kept

#: Phrases that are always reported, wherever they stand: fixed values.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Template notices with their labels and mandatory key phrases, in words as they are indexed:
#: fixed values.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with "
                   "the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by "
                   "applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
                   "without warranties or conditions of any kind either express or implied", "apache license version 2 0"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction including without limitation the rights "
            "to use copy modify merge publish distribute sublicense and or sell copies of the software",
     "permission is hereby granted free of charge"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files", "permission is hereby granted free of charge"),
    ("mit", "released under the mit license", "mit license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
     "redistribution and use in source and binary forms"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the "
            "following conditions are met redistributions of source code must retain the above copyright notice this list of "
            "conditions and the following disclaimer", "redistribution and use in source and binary forms"),
    ("gpl-2", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
              "license as published by the free software foundation either version 2 of the license or at your option any later "
              "version", "either version 2 of the license"),
    ("gpl-3", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
              "license as published by the free software foundation either version 3 of the license or at your option any later "
              "version", "either version 3 of the license"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general "
             "public license as published by the free software foundation", "gnu lesser general public license"),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general "
             "public license as published by the free software foundation", "gnu affero general public license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not "
                "distributed with this file you can obtain one at http mozilla org mpl 2 0", "mozilla public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    ("creative-commons", "this work is licensed under a creative commons attribution 4 0 international license",
     "creative commons attribution"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
            "provided that the above copyright notice and this permission notice appear in all copies",
     "permission to use copy modify and or distribute"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use "
                  "compile sell or distribute this software either in source code form or as a compiled binary for any purpose "
                  "commercial or non commercial and by any means", "free and unencumbered software"),
]
#: Everyday words; they stand in key phrases but are not indexed.
EVERYDAY = frozenset("a all an and any appear are as at be by can c either for form free freely from if in including into is it law "
                     "later list met must not of on one or org person source terms that the this to under use v was were with "
                     "without work www you your http file files code option 0 2 3 4".split())
BEFORE, AFTER = 8, 16
#: Words looked up for one file and template; those of highest weight that the file has.
LOOKED_UP = 12
#: Share of a template's weight that must be in place, and how far apart words in place may shift.
LEAST_SHARE, SLIP = 0.6, 6

_POSTINGS = [
    (t, word, at)
    for t, (_, text, _) in enumerate(TEMPLATES)
    for at, word in enumerate(text.split())
    if word not in EVERYDAY
]


def _anchor(phrase: str) -> int:
    """The place in a phrase of the word it is recognised by: the longest that is indexed."""
    words = phrase.split()
    return max((k for k, w in enumerate(words) if w not in EVERYDAY), key=lambda k: (len(words[k]), -k))


#: `word, offset, words of the phrase, label of a base phrase or number of a template, its begin`.
_PHRASES = [(p.split()[_anchor(p)], _anchor(p), p.split(), label, -1, 0) for p, label in BASE.items()] + [
    (p.split()[_anchor(p)], _anchor(p), p.split(), None, t, len(body.partition(p)[0].split()))
    for t, (_, body, p) in enumerate(TEMPLATES)]
ANCHORS = sorted({row[0] for row in _PHRASES})
VOCABULARY = sorted({w for _, w, _ in _POSTINGS} | set(ANCHORS))
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _scanned(text: Column) -> Column:
    """`n_words, hits` of a text; a hit is a licence word, its position and the words around it."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def scan(words: Column) -> Column:
        lead = (words[0] == "").cast("int")  # a text that begins with a separator
        size = F.size(words)
        tail = ((size > 1) & (F.element_at(words, -1) == "")).cast("int")
        found = F.filter(F.sequence(F.lit(0), size - 1), lambda i: words[i].isin(VOCABULARY))

        def hit(i: Column) -> Column:
            first = F.greatest(i - BEFORE, lead)
            around = F.when(words[i].isin(ANCHORS), F.slice(words, first + 1, i - first + 1 + AFTER))
            return F.struct((i - lead).alias("pos"), words[i].alias("word"), (i - first).alias("at"), around.alias("around"))

        return F.struct((size - lead - tail).cast("bigint").alias("n_words"), F.transform(found, hit).alias("hits"))

    return F.transform(F.array(F.split(lower, _SEPARATORS)), scan)[0]


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score` of every row.

    Words are runs of a-z (A-Z lower-cased), digits and non-ASCII characters, from 0. `n_base`
    counts the places of base phrases, `first_word` and `last_word` are their smallest and
    largest start (null without any). Labels are distinct and sorted. `score` is the share of a
    template's indexed weight found in place, of the best template; a base phrase alone is 0.5.
    Null, empty and wordless texts have no words and no labels. Rows come back one for one, also
    repeated ones and those without an id; other columns are not read.
    """
    spark = docs.sparkSession
    rows = kept(
        docs.select(F.col(key).cast("bigint").alias("doc_id"), _scanned(F.col(text).cast("string")).alias("s"))
        .select(F.monotonically_increasing_id().alias("row"), "doc_id", "s.n_words", "s.hits"),
        "license-words",
    )
    seen, n = rows.filter(F.size("hits") > 0), rows.count()
    # One row per licence word at most; every count is over all documents.
    weights = kept(
        seen.select(F.explode(F.array_distinct("hits.word")).alias("word")).groupBy("word")
        .agg(F.log(F.lit(n + 1) / F.count(F.lit(1))).alias("idf")),
        "license-weights",
    )
    hits = seen.select("row", F.inline("hits"))
    # All phrases in one pass: each is recognised by one word, and compared with the words around.
    phrases = spark.createDataFrame(
        _PHRASES, "word string, offset int, phrase array<string>, label string, template int, begins int")
    begin = F.col("at") - F.col("offset")
    standing = hits.join(F.broadcast(phrases), "word").filter(begin >= 0).filter(
        F.slice("around", begin + 1, F.size("phrase")) == F.col("phrase"))
    standing = standing.select("row", "label", "template", (F.col("pos") - F.col("offset")).cast("bigint").alias("start"), "begins")
    standing = kept(standing, "license-phrases")
    bases = standing.filter("template < 0").groupBy("row").agg(
        F.count(F.lit(1)).alias("n_base"), F.min("start").alias("first_word"), F.max("start").alias("last_word"),
        F.collect_set("label").alias("base"))
    # Begins within `SLIP` of each other share one of two buckets.
    buckets = lambda at: F.explode(F.array(F.floor(at / SLIP), F.floor(at / SLIP) + 1)).alias("bucket")
    verified = standing.filter("template >= 0").select("row", "template", buckets(F.col("start") - F.col("begins"))).distinct()

    index = spark.createDataFrame(_POSTINGS, "template int, word string, place int")
    index = F.broadcast(index.join(F.broadcast(weights), "word", "left").withColumn(
        "idf", F.coalesce("idf", F.log(F.lit(n + 1.0)))))
    # Only files and templates whose key phrase stands somewhere can be reported.
    likely = verified.select("row", "template").distinct()
    words = seen.select("row", F.explode(F.array_distinct("hits.word")).alias("word"))
    best = F.slice(F.sort_array(F.collect_set(F.struct("idf", "word")), asc=False), 1, LOOKED_UP)
    chosen = words.join(index, "word").join(likely, ["row", "template"]).groupBy("row", "template").agg(best.alias("best"))
    chosen = chosen.select("row", "template", F.inline("best")).drop("idf")
    # A word counts once, however many of its postings agree.
    votes = (
        hits.select("row", "word", "pos").join(chosen, ["row", "word"]).join(index, ["word", "template"])
        .select("row", "template", "word", "idf", buckets(F.col("pos") - F.col("place")))
        .groupBy("row", "template", "bucket", "word").agg(F.max("idf").alias("idf"))
        .groupBy("row", "template", "bucket").agg(F.sum("idf").alias("weight"))
    )
    # A template's weight is that of its best words, as many as are looked up.
    mass = index.select("template", "word", "idf").distinct().groupBy("template").agg(
        F.slice(F.sort_array(F.collect_list("idf"), asc=False), 1, LOOKED_UP).alias("best")
    ).select("template", F.aggregate("best", F.lit(0.0), lambda x, y: x + y).alias("mass"))
    found = (
        votes.join(verified, ["row", "template", "bucket"]).join(F.broadcast(mass), "template")
        .withColumn("share", F.least(F.col("weight") / F.col("mass"), F.lit(1.0))).filter(F.col("share") >= LEAST_SHARE)
    )
    names = F.array(*[F.lit(label) for label, _, _ in TEMPLATES])
    found = found.groupBy("row").agg(F.collect_set(F.element_at(names, F.col("template") + 1)).alias("more"),
                                     F.max("share").alias("share"))
    none = F.array().cast("array<string>")
    base, more = F.coalesce("base", none), F.coalesce("more", none)
    return (
        rows.select("row", "doc_id", "n_words").join(bases, "row", "left").join(found, "row", "left")
        .select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"),
                "first_word", "last_word", F.array_join(F.sort_array(base), ",").alias("base_labels"),
                F.array_join(F.sort_array(F.array_distinct(F.concat(base, more))), ",").alias("labels"),
                F.greatest(F.coalesce("share", F.lit(0.0)), F.when(F.col("n_base") > 0, 0.5).otherwise(0.0)).alias("score"))
    )
