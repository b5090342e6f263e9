"""License scans by diagonal voting, with DataFrame functions only.

Texts are lower-cased in A-Z and cut into words. Every `GRAM` neighbouring words of a document are hashed and joined
with the places of the templates' own word runs; the words themselves decide whether a hit counts. A hit votes for its
diagonal, the word at which the template would begin. Votes are summed for each document, template and diagonal;
neighbouring diagonals, as words that were put in or left out make them, are merged, and a merged span is verified by
the share of the template's places that it covers and by its width. Texts are read once; what is shuffled are votes,
summed diagonals and a row for each document.

Two kinds of templates: a phrase has to stand word for word, on one diagonal, and each place counts (the base); a text
counts from a share of `SHARE` of its places on. The tables of phrases and texts are parameters and part of the plan.

Defined results: a null or empty text has no words and no labels; rows that repeat a doc_id are judged one by one; places
that overlap all count; ties need no order; a text of any length is read whole, as an array of its words, which has to
fit in a task; an empty table gives an empty result; other columns of the input, whatever their names, are ignored by
`license_report` and may be kept by `license_spans`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.decontaminate import words

GRAM = 3
#: Words by which neighbouring diagonals may differ, votes that a diagonal of a text needs, the share of a text's places that a span must cover, and its width against the text's.
DRIFT, VOTES, SHARE, WIDTH = 12, 3, 0.7, 1.5

#: Phrases and their labels.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

#: Passages of well-known public licenses and their labels.
TEXTS = [
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:", "mit"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "isc"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "bsd"),
    ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "bsd-3-clause"),
    ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at", "apache-2"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "gpl-3"),
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "gpl-2"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", "mpl-2"),
    ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "unlicense"),
    ("This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy of this license, visit", "cc-by-nc"),
]


def templates(spark: SparkSession, phrases: list[tuple[str, str]], passages: list[tuple[str, str]], gram: int = GRAM) -> DataFrame:
    """template, label, base, places, at, run, key: a row for each run of `gram` words of each template, and one (template -1) that meets every document's first row."""
    rows = [(text, label, True) for text, label in phrases] + [(text, label, False) for text, label in passages]
    made = F.array(*[F.struct(F.lit(k).alias("template"), F.lit(label).alias("label"), F.lit(base).alias("base"), F.lit(text).alias("text")) for k, (text, label, base) in enumerate(rows)])
    t = spark.range(1).select(F.explode(made).alias("t")).select("t.*").withColumn("w", words(F.col("text"))).withColumn("places", F.size("w") - (gram - 1))
    short = F.assert_true(F.col("places") > 0, F.concat(F.lit("a template has too few words: "), F.col("text")))
    t = t.where(short.isNull()).select("template", "label", "base", "places", "w", F.posexplode(F.sequence(F.lit(0), F.col("places") - 1)).alias("at", "i"))
    t = t.select("template", "label", "base", "places", "at", F.array_join(F.slice("w", F.col("i") + 1, gram), " ").alias("run"), F.xxhash64(*[F.get("w", F.col("i") + j) for j in range(gram)]).alias("key"))
    first = spark.range(1).select(F.lit(-1).alias("template"), F.lit("").alias("label"), F.lit(False).alias("base"), F.lit(0).alias("places"), F.lit(0).alias("at"), F.lit("").alias("run"), F.lit(0).cast("long").alias("key"))
    return t.unionByName(first)


def license_spans(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), phrases: list[tuple[str, str]] = PHRASES, passages: list[tuple[str, str]] = TEXTS, gram: int = GRAM, text: str = "text") -> DataFrame:
    """One row for each row of `docs`: the columns `keep`, n_words, `places` (label, start, end) of phrases and `spans` (label, start, end, covered, verified) of passages; words count from 0, ends are exclusive."""
    told = ("n_words", "places", "spans")
    if any(c.lower() in told for c in keep):
        raise ValueError(f"a result column can't be kept: {', '.join(told)}")
    names, keep = keep, tuple(f"_keep{k}" for k in range(len(keep)))  # names of its own can't clash
    slim = docs.select(*[F.col(c).alias(k) for c, k in zip(names, keep, strict=True)], F.monotonically_increasing_id().alias("_rid"), words(F.col(text)).alias("_w"))
    # The row at 0 stands for the document itself, which so takes part without a hit.
    every = slim.select(*keep, "_rid", "_w", F.size("_w").cast("long").alias("n_words"), F.posexplode(F.concat(F.array(F.lit("")), "_w")).alias("_i", "_first"))
    run = [F.col("_first"), *[F.get("_w", F.col("_i") + (j - 1)) for j in range(1, gram)]]
    every = every.withColumn("key", F.when(F.col("_i") == 0, F.lit(0).cast("long")).otherwise(F.xxhash64(*run)))
    same = F.when(F.col("_i") == 0, F.col("template") == -1).otherwise(F.col("run") == F.concat_ws(" ", *run))
    hit = every.join(F.broadcast(templates(docs.sparkSession, phrases, passages, gram)), "key").where(same)  # a fixed number of rows
    kept = [F.first(c).alias(c) for c in (*keep, "n_words", "label", "base", "places")]
    of = ["_rid", "template"]
    diagonals = hit.groupBy(*of, (F.col("_i") - 1 - F.col("at")).alias("_diagonal")).agg(F.count(F.lit(1)).alias("_votes"), F.min("_i").alias("_lo"), F.max("_i").alias("_hi"), F.collect_set("at").alias("_at"), *kept)
    diagonals = diagonals.where(F.col("base") | (F.col("template") < 0) | (F.col("_votes") >= F.least(F.lit(VOTES), F.col("places"))))
    before = F.lag("_diagonal").over(Window.partitionBy(*of).orderBy("_diagonal"))
    apart = F.col("base") | before.isNull() | (F.col("_diagonal") - before > DRIFT)
    merged = diagonals.withColumn("_new", apart.cast("int")).withColumn("_span", F.sum("_new").over(Window.partitionBy(*of).orderBy("_diagonal")))
    spans = merged.groupBy(*of, "_span").agg((F.min("_lo") - 1).cast("long").alias("_start"), (F.max("_hi") - 1 + gram).cast("long").alias("_end"), F.size(F.array_distinct(F.flatten(F.collect_list("_at")))).alias("_n"), *kept)
    covered = F.round(F.col("_n") / F.col("places"), 6)
    fits = F.col("_end") - F.col("_start") <= WIDTH * (F.col("places") + gram - 1) + DRIFT
    place = F.when(F.col("base") & (F.col("_n") == F.col("places")), F.struct("label", F.col("_start").alias("start"), F.col("_end").alias("end")))
    span = F.when(~F.col("base") & (F.col("template") >= 0), F.struct("label", F.col("_start").alias("start"), F.col("_end").alias("end"), covered.alias("covered"), ((covered >= SHARE) & fits).alias("verified")))
    return (
        spans.groupBy("_rid")
        .agg(*[F.first(c).alias(c) for c in (*keep, "n_words")], F.array_sort(F.collect_list(place)).alias("places"), F.array_sort(F.collect_list(span)).alias("spans"))
        .select(*[F.col(k).alias(c) for c, k in zip(names, keep, strict=True)], "n_words", "places", "spans")
    )


def license_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    The score is 1 where a phrase stands, else the largest share of a passage's places that a span covers, else 0.
    """
    found = license_spans(docs)
    starts = F.transform("places", lambda p: p["start"])
    base = F.transform("places", lambda p: p["label"])
    more = F.transform(F.filter("spans", lambda s: s["verified"]), lambda s: s["label"])
    listed = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    share = F.coalesce(F.array_max(F.transform("spans", lambda s: s["covered"])), F.lit(0.0))
    score: Column = F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.least(share, F.lit(1.0)))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), listed(base).alias("base_labels"), listed(F.concat(base, more)).alias("labels"), score.alias("score")
    )


def _sql_rows() -> str:
    rows = [(k, label, base, text) for k, (text, label, base) in enumerate([(t, x, "TRUE") for t, x in PHRASES] + [(t, x, "FALSE") for t, x in TEXTS])]
    return ", ".join(f"({k}, '{label}', {base}, '{text}')" for k, label, base, text in rows)


ORACLE = (
    r"""
WITH t AS (SELECT template, label, base, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM (VALUES """
    + _sql_rows()
    + r""") v(template, label, base, text)),
tg AS (SELECT template, label, base, len(w) - 2 places, pos - 1 at_pos, w[pos:pos+2] g FROM (SELECT *, unnest(range(1, len(w) - 1)) pos FROM t)),
d AS (SELECT doc_id, row_number() OVER () r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
dg AS (SELECT r, i - 1 i, w[i:i+2] g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) i FROM d)),
h AS (SELECT r, template, label, base, places, at_pos, i, i - at_pos diagonal FROM dg JOIN tg USING (g)),
a AS (SELECT r, template, label, base, places, diagonal, min(i) lo, max(i) hi, list(DISTINCT at_pos) held FROM h GROUP BY ALL HAVING base OR count(*) >= least(3, places)),
b AS (SELECT r, label, places, diagonal AS start_word FROM a WHERE base AND len(held) = places),
n AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal) <= 12 THEN 0 ELSE 1 END fresh FROM a WHERE NOT base),
m AS (SELECT *, sum(fresh) OVER (PARTITION BY r, template ORDER BY diagonal) span FROM n),
s AS (SELECT r, label, places, lo, hi, round(len(list_distinct(held)) / places, 6) covered FROM (SELECT r, template, span, label, places, min(lo) lo, max(hi) + 3 hi, flatten(list(held)) held FROM m GROUP BY ALL)),
v AS (SELECT r, label FROM s WHERE covered >= 0.7 AND hi - lo <= 1.5 * (places + 2) + 12),
bl AS (SELECT r, count(*) n_base, min(start_word) first_word, max(start_word) last_word, string_agg(DISTINCT label, ',' ORDER BY label) base_labels FROM b GROUP BY r),
al AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) labels FROM (SELECT r, label FROM b UNION ALL SELECT r, label FROM v) GROUP BY r),
sc AS (SELECT r, max(covered) covered FROM s GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(n_base, 0) AS BIGINT) n_base, CAST(first_word AS BIGINT) first_word, CAST(last_word AS BIGINT) last_word,
       coalesce(base_labels, '') base_labels, coalesce(labels, '') labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(covered, 0)::DOUBLE END score
FROM d LEFT JOIN bl USING (r) LEFT JOIN al USING (r) LEFT JOIN sc USING (r)
"""
)
