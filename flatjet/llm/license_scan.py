"""License texts by diagonal voting of word k-grams; DataFrame functions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Phrases whose places are counted exactly, and their labels.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

#: Sentences and notices of common licenses, found also when some of their words differ.
TEMPLATES = [
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license", "apache-2.0"),
    ("released under the mit license", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("this work is licensed under the gnu general public license", "gpl"),
    ("you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lgpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this work is dedicated to the public domain", "public-domain"),
    # Whole texts, by paragraph.
    (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction,"
        " including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is"
        " furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "mit",
    ),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice"
        " appear in all copies.",
        "isc",
    ),
    (
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright"
        " notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "bsd",
    ),
    (
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is"
        " granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
        "zlib",
    ),
    (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or"
        " as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "unlicense",
    ),
    (
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either"
        " express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "apache-2.0",
    ),
    (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the"
        " License, or (at your option) any later version.",
        "gpl",
    ),
]

#: Words that say nothing in pairs: pairs of two of them do not vote.
COMMON = frozenset("a all an and any any are as at be by for from in is it its no not of on or shall that the this to under will with".split())

_SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words of letters, digits and non-ASCII characters, A-Z lower-cased; none for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _SEPARATOR), "")


def bigram_hashes(words: Column) -> Column:
    """Hash of each word and the next; the last word's is of itself alone and matches nothing."""
    return F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.xxhash64(a, b))


def template_index(spark: SparkSession, base: list[tuple[str, str]], templates: list[tuple[str, str]]) -> DataFrame:
    """One row for each voting bigram of each template: hash, template, place, label, exactness, number of such bigrams and words."""
    rows = []
    for t, (phrase, label) in enumerate([*base, *templates]):
        words = [w for w in re.split(_SEPARATOR, phrase.translate(str.maketrans(_UPPER, _LOWER))) if w]
        exact = t < len(base)
        pairs = [i for i in range(len(words) - 1) if exact or not (words[i] in COMMON and words[i + 1] in COMMON)]
        if not pairs:
            raise ValueError(f"a phrase needs two words that say something: {phrase!r}")
        for i in pairs:
            rows.append((words[i], words[i + 1], t, i, label, exact, len(pairs), len(words)))
    # Joins the mark that every document carries, so that documents without a match keep one row.
    rows.append((None, None, -1, 0, None, True, 1, 0))
    table = spark.createDataFrame(rows, "a string, b string, tid int, tpos int, label string, exact boolean, size int, words int")
    return table.select(F.when(F.col("a").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64("a", "b")).alias("h"), "tid", "tpos", "label", "exact", "size", "words")


def chain_length(votes: Column, words: Column, width: Column) -> Column:
    """Most votes (pos, tpos), sorted by pos, that rise in both places and lie within ``width`` words of the document.

    For each place in the template the best chain that ends there is kept, with
    its start; of equally long ones the one that started last.
    """
    state = "struct<top:int,ends:array<struct<n:int,start:int>>>"
    first = F.struct(F.lit(0).alias("top"), F.array_repeat(F.struct(F.lit(0).alias("n"), F.lit(0).alias("start")), words).alias("ends")).cast(state)

    def step(acc: Column, vote: Column) -> Column:
        before = F.filter(F.slice(acc["ends"], F.lit(1), vote["tpos"]), lambda e: (e["n"] > 0) & (vote["pos"] - e["start"] < width))
        best = F.array_max(before)
        new = F.struct((F.coalesce(best["n"], F.lit(0)) + 1).alias("n"), F.coalesce(best["start"], vote["pos"]).alias("start"))
        ends = F.transform(acc["ends"], lambda e, i: F.when((i == vote["tpos"]) & ((new["n"] >= e["n"]) | (vote["pos"] - e["start"] >= width)), new).otherwise(e))
        return F.struct(F.greatest(acc["top"], new["n"]).alias("top"), ends.alias("ends")).cast(state)

    return F.aggregate(votes, first, step, lambda acc: acc["top"])


def scan(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    base: list[tuple[str, str]] = BASE,
    templates: list[tuple[str, str]] = TEMPLATES,
    least: float = 0.7,
    slack: int = 3,
) -> DataFrame:
    """Find license texts in whole documents.

    The hashes of all word bigrams are joined to the template bigrams (a fixed
    list, so the join is a broadcast). A match votes for its diagonal, the
    difference of the places in document and template. Votes are gathered by
    diagonal; diagonals of a template that lie within ``slack`` of the one before
    are merged, which takes in inserted and left-out words. A merged span in
    which ``least`` of the template's bigrams voted is verified: it counts if so
    many of them stand there in the template's order, within the template's
    length and the words that may be added. For base phrases diagonals are not
    merged and all bigrams must vote, so each is a place where the words stand
    consecutively.

    Returns one row per document: ``id_col``, n_words, n_base, first_word,
    last_word (of the base phrases' places; else null), base_labels, labels
    (sorted, comma-joined; else empty) and score (largest verified share of a
    template; else 0). Null and empty texts have no words; null and repeated ids
    keep their rows; other columns are ignored; an empty table gives no rows.
    """
    index = template_index(documents.sparkSession, base, templates)
    rows = documents.select(F.col(f"`{id_col}`").alias("id"), words_of(F.col(f"`{text_col}`").cast("string")).alias("words")).withColumn("row", F.monotonically_increasing_id())
    rows = rows.select("row", "id", F.size("words").cast("long").alias("n"), F.posexplode(F.concat(F.array(F.lit(0).cast("long")), bigram_hashes(F.col("words")))).alias("pos", "h"))
    votes = rows.join(F.broadcast(index), "h").select("row", "id", "n", "tid", "label", "exact", "size", F.col("words").alias("length"), "tpos", (F.col("pos") - 1).alias("pos"), (F.col("pos") - 1 - F.col("tpos")).alias("diagonal"))
    # All that follows is by document, so this is the only exchange.
    votes = votes.repartition("row")
    about = ("id", "n", "label", "exact", "size", "length")
    lines = votes.groupBy("row", "tid", "diagonal").agg(*[F.first(c).alias(c) for c in about], F.collect_list("pos").alias("seen"))
    ordered = Window.partitionBy("row", "tid").orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(ordered)
    apart = F.coalesce(gap > F.when(F.col("exact"), 0).otherwise(slack), F.lit(True))
    lines = lines.withColumn("apart", apart).withColumn("span", F.sum(F.col("apart").cast("int")).over(ordered))
    seen = F.transform("seen", lambda p: F.struct(p.alias("pos"), (p - F.col("diagonal")).cast("int").alias("tpos")))
    spans = lines.groupBy("row", "tid", "span").agg(*[F.first(c).alias(c) for c in about], F.min("diagonal").cast("long").alias("start"), F.flatten(F.collect_list(seen)).alias("votes"))
    voted = F.size(F.array_distinct(F.transform("votes", lambda v: v["tpos"])))
    wanted = F.ceil(F.when(F.col("exact"), F.col("size")).otherwise(F.col("size") * least) - 1e-9)
    spans = spans.withColumn("voted", voted).where(F.col("voted") >= wanted)
    width = F.col("length") + F.ceil(F.col("length") * (1 - least)).cast("int") + slack
    held = F.when(F.col("exact"), F.col("voted")).otherwise(chain_length(F.array_sort("votes"), F.col("length"), width))
    spans = spans.withColumn("share", held / F.col("size")).where(F.col("share") >= F.when(F.col("exact"), 1.0).otherwise(least - 1e-9))
    place = F.col("exact") & (F.col("tid") >= 0)

    def labels(which: Column) -> Column:
        return F.array_join(F.sort_array(F.collect_set(F.when(which, F.col("label")))), ",")

    return spans.groupBy("row").agg(
        F.first("id").alias(id_col),
        F.first("n").alias("n_words"),
        F.count(F.when(place, 1)).alias("n_base"),
        F.min(F.when(place, F.col("start"))).alias("first_word"),
        F.max(F.when(place, F.col("start"))).alias("last_word"),
        labels(place).alias("base_labels"),
        labels(F.lit(True)).alias("labels"),
        F.coalesce(F.max(F.when(F.col("tid") >= 0, F.col("share"))), F.lit(0.0)).alias("score"),
    ).drop("row")
