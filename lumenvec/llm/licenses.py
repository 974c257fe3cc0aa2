"""License scans by diagonal voting.

All rolling word k-grams of all texts are hashed and joined to the positions of the same k-grams in
a fixed set of license templates. A match at text word p and template word q votes for the diagonal
p - q; votes are summed by diagonal, neighbouring diagonals are merged, so a few words put in or
left out don't break a match, and spans with enough votes are verified: the words around their
diagonals must agree, in order, with all of the template's. Only DataFrame functions run; the
templates are a constant of this module, so their broadcast has a fixed size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenvec.llm._native import let, lower_ascii, text

K = 3
#: Diagonals so far apart are one match; shares of a template's k-grams that must vote, and of its words that must agree.
NEAR = 3
LEAST_VOTES = 0.4
LEAST_AGREE = 0.9
#: Words that tell licenses apart, besides numbers: those of a template must stand in the place, and no others of these may.
TELLING = ("nc", "sa", "nd", "noncommercial", "sharealike", "noderivatives", "lesser", "affero")
#: Fixed phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Openings, notices, conditions and disclaimers of published licenses, a paragraph each, in lower case and without punctuation; fixed values.
TEMPLATES = {
    "apache-2.0": ["licensed under the apache license version 2 0", "you may not use this file except in compliance with the license", "you may obtain a copy of the license at http www apache org licenses license 2 0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "mit": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "released under the mit license", "licensed under the mit license",
            "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
            "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
            "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistributions of source code must retain the above copyright notice",
            "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
            "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"],
    "gpl-3.0": ["licensed under the gnu general public license version 3", "either version 3 of the license or at your option any later version"],
    "gpl-2.0": ["licensed under the gnu general public license version 2", "either version 2 of the license or at your option any later version"],
    "gpl": ["this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "lgpl": ["licensed under the gnu lesser general public license"],
    "mpl-2.0": ["this source code form is subject to the terms of the mozilla public license v 2 0", "if a copy of the mpl was not distributed with this file you can obtain one at"],
    "cc-by-4.0": ["licensed under cc by 4 0", "licensed under a creative commons attribution 4 0 international license"],
    "cc-by-sa-4.0": ["licensed under cc by sa 4 0", "licensed under a creative commons attribution sharealike 4 0 international license"],
    "cc-by-nc-4.0": ["licensed under cc by nc 4 0", "licensed under a creative commons attribution noncommercial 4 0 international license"],
    "unlicense": ["this is free and unencumbered software released into the public domain", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"],
    "zlib": ["this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"],
    "proprietary": ["no part of this publication may be reproduced distributed or transmitted in any form", "unauthorized copying of this file via any medium is strictly prohibited"],
}
_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(value: Column) -> Column:
    return F.filter(F.split(lower_ascii(value), _SPLIT), lambda x: x != "")


def _gram(w, i: Column, k: int = K) -> Column:
    return F.xxhash64(*[F.get(w, i + j) for j in range(k)])


def templates(spark) -> DataFrame:
    """(template, label, t_words) of the fixed set."""
    rows = [(f"{label}/{k}", label, t.split(" ")) for label, ts in TEMPLATES.items() for k, t in enumerate(ts)]
    return spark.createDataFrame(rows, "template string, label string, t_words array<string>")


def _phrase_starts(w: Column) -> list[tuple[str, Column]]:
    """By label, an array of the starts of its phrase; texts without the phrase's first words do no more than look for them."""
    def starts(parts: list[str]) -> Column:
        here = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: _all([F.get(w, i + j) == F.lit(p) for j, p in enumerate(parts)]))
        return F.when(F.array_contains(w, parts[-1]) & F.array_contains(w, parts[0]), here).otherwise(F.array().cast("array<int>"))

    return [(label, starts(phrase.split(" "))) for phrase, label in PHRASES.items()]


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return F.coalesce(out, F.lit(False))


def spans(docs: DataFrame) -> DataFrame:
    """(row, template, label, first, last, diagonals): places with enough votes, by the words' numbers from 0; docs: (row, text)."""
    t = templates(docs.sparkSession)
    grams = t.select("template", "label", F.size("t_words").alias("t_size"), F.posexplode(F.transform(F.sequence(F.lit(0), F.size("t_words") - K), lambda i: _gram("t_words", i))).alias("t_pos", "gram"))
    rolling = let(words_of(F.col("text")), lambda w: F.when(F.size(w) >= K, F.transform(F.sequence(F.lit(0), F.size(w) - K), lambda i: _gram(w, i))))
    own = docs.select("row", F.posexplode(rolling).alias("pos", "gram"))
    votes = own.join(F.broadcast(grams), "gram").groupBy("row", "template", "label", "t_size", (F.col("pos") - F.col("t_pos")).alias("diagonal")).agg(F.count("*").alias("votes"), F.min("pos").alias("first"), (F.max("pos") + K - 1).alias("last"))
    by = Window.partitionBy("row", "template").orderBy("diagonal")
    votes = votes.withColumn("new", (F.col("diagonal") - F.lag("diagonal", 1, -1 << 30).over(by) > NEAR).cast("int"))
    votes = votes.withColumn("band", F.sum("new").over(by))
    bands = votes.groupBy("row", "template", "label", "t_size", "band").agg(F.sum("votes").alias("votes"), F.min("first").alias("first"), F.max("last").alias("last"), F.collect_list("diagonal").alias("diagonals"))
    bands = bands.where(F.col("votes") >= LEAST_VOTES * (F.col("t_size") - (K - 1)))
    return bands.select("row", "template", "label", "first", "last", "diagonals")


def _common(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays."""
    step = lambda row, w: F.aggregate(F.sequence(F.lit(1), F.size(a)), F.array(F.lit(0)), lambda done, j: F.concat(done, F.array(F.when(F.get(a, j - 1) == w, F.get(row, j - 1) + 1).otherwise(F.greatest(F.get(done, j - 1), F.get(row, j))))))
    return F.get(F.aggregate(b, F.array_repeat(F.lit(0), F.size(a) + 1), step), F.size(a))


def _verified(found: DataFrame, docs: DataFrame) -> DataFrame:
    """(row, label, score) of spans whose words agree, in order, with their template's: on one of its diagonals all words of the template are asked for, and NEAR more on either side.

    Numbers of the template must be there, and of TELLING the same words. A text meets all its spans at once, and its words are worked out once. What stands on a diagonal is
    told by two hashes, so that a notice that a text repeats is compared with its template once.
    """
    t = templates(docs.sparkSession)
    sized = found.join(F.broadcast(t.select("template", F.size("t_words").alias("t_size"))), "template")
    by_row = sized.groupBy("row").agg(F.collect_list(F.struct("template", "t_size", "diagonals")).alias("spans"))
    begin = lambda d: F.greatest(d - NEAR, F.lit(0))

    def places(w: Column) -> Column:
        def of_span(s: Column) -> Column:
            size = s["t_size"]
            told = F.transform(s["diagonals"], lambda d: F.struct(F.xxhash64(F.slice(w, begin(d) + 1, size + 2 * NEAR)).alias("a"), F.xxhash64(F.lit(1), F.slice(w, begin(d) + 1, size + 2 * NEAR)).alias("b"), d.alias("d")))
            return let(F.array_sort(told), lambda every: F.transform(F.filter(every, lambda x, i: (i == 0) | (F.get(every, i - 1)["a"] != x["a"]) | (F.get(every, i - 1)["b"] != x["b"])), lambda x: F.struct(s["template"].alias("template"), F.slice(w, begin(x["d"]) + 1, size + 2 * NEAR).alias("near"))))

        return F.flatten(F.transform("spans", of_span))

    each = by_row.join(docs.select("row", "text"), "row").select("row", F.explode(let(words_of(F.col("text")), places)).alias("p"))
    each = each.select("row", "p.*").join(F.broadcast(t), "template")
    size = F.size("t_words")
    # the template itself, NEAR words in (or from the start, at the start of a text), needs no comparing in order
    whole = F.exists(F.sequence(F.lit(1), F.lit(NEAR + 1)), lambda i: F.slice("near", i, size) == F.col("t_words"))
    most = _common(F.col("t_words"), F.filter("near", lambda x: F.array_contains("t_words", x)))
    numbers = F.filter("t_words", lambda x: x.rlike(r"^[0-9]+$"))
    told = F.array(*map(F.lit, TELLING))
    same = (F.size(F.array_except(numbers, "near")) == 0) & (F.size(F.array_intersect(told, "t_words")) == F.size(F.array_intersect(told, "near"))) & (F.size(F.array_except(F.array_intersect(told, "t_words"), "near")) == 0)
    rows = each.where(same).select("row", "label", F.when(whole, 1.0).otherwise(most / size).alias("score"))
    return rows.where(F.col("score") >= LEAST_AGREE)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row of `docs`.

    A null or empty text has no words, no labels (empty strings) and score 0; base matches alone
    score 1. Repeated rows are scanned each: rows, not ids, are matched, told apart by 128 bits of hashes
    of id and text, so rows without an id are matched too. Texts of any length are scanned whole; other
    columns aren't looked at, and an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text().alias("text")).withColumn("row", F.struct(F.xxhash64("doc_id", "text").alias("a"), F.xxhash64(F.lit(1), "text", "doc_id").alias("b")))
    found = lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), *[s.alias(f"s{k}") for k, (_, s) in enumerate(_phrase_starts(w))])
    base = rows.select("doc_id", "row", let(words_of(F.col("text")), found).alias("b")).select("doc_id", "row", "b.*")
    starts = list(PHRASES.items())
    every = F.concat(*[F.col(f"s{k}") for k in range(len(starts))])
    names = F.filter(F.array(*[F.when(F.size(f"s{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(starts)]), lambda x: x.isNotNull())
    base = base.select("doc_id", "row", "n_words", F.size(every).cast("bigint").alias("n_base"), F.array_min(every).cast("bigint").alias("first_word"), F.array_max(every).cast("bigint").alias("last_word"), F.array_sort(names).alias("base"))
    # equal rows are the same text: matched once
    once = rows.select("row", "text")
    found = _verified(spans(once).dropDuplicates(["row", "template", "first", "last"]), once)
    by_row = found.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("score").alias("best"))
    out = base.join(by_row, "row", "left")
    labels = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("more", F.array().cast("array<string>")))))
    score = F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.col("n_base") > 0, 1.0).otherwise(0.0))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))
