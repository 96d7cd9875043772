"""License scans by diagonal voting, in DataFrame functions only.

All rolling word k-grams of all documents (pairs for the base phrases, triples for the license texts) are joined
with the grams of a fixed table of templates. A match of document position p with template position q votes for
the diagonal p - q. A template that stands in a text word for word collects all its votes on one
diagonal; one with words inserted, dropped or changed spreads them over neighbouring diagonals, which are merged into
one span. Every span is then rebuilt from the grams that voted for it and held against the stretch of the template it
stands for: the share of words that are the same in both decides.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, text_or_empty

# The phrases of the contract and their labels.
BASE_PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]
# Notices of published licenses and the labels that they add.
NOTICES = [
    (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
        "mit",
    ),
    (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "bsd",
    ),
    (
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the "
        "License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
        "apache",
    ),
    (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        "gpl",
    ),
    ("GNU Lesser General Public License", "lgpl"),
    ("GNU Affero General Public License", "agpl"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", "mpl"),
    (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies",
        "isc",
    ),
    ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", "unlicense"),
    ("This work is licensed under a Creative Commons Attribution", "cc-by"),
    ("CC BY NC", "cc-by-nc"),
    ("CC BY SA", "cc-by-sa"),
    ("Boost Software License Version 1.0", "boost"),
    ("Eclipse Public License", "epl"),
]
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def templates() -> list[tuple[list[str], str, bool]]:
    """Words, label and whether it is a base phrase, of every template."""
    return [(re.findall(WORD, text.lower()), label, n < len(BASE_PHRASES)) for n, (text, label) in enumerate(BASE_PHRASES + NOTICES)]


def gram_rows() -> list[tuple]:
    """t1, t2, t3 (null for pairs), phrase, pos, k, size, label, base: a row per gram of a template, a few hundred in all."""
    rows = []
    for n, (w, label, base) in enumerate(templates()):
        k = 2 if base else 3
        rows += [(*w[i : i + k], *[None] * (3 - k), n, i, k, len(w), label, base) for i in range(len(w) - k + 1)]
    return rows


def template_grams(spark: SparkSession) -> DataFrame:
    """``gram_rows`` with their hash g."""
    grams = spark.createDataFrame(gram_rows(), "t1 string, t2 string, t3 string, phrase int, pos int, k int, size int, label string, base boolean")
    return grams.withColumn("g", F.xxhash64("t1", "t2", "t3"))


def diagonals(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per (row, template, diagonal) with the positions that voted for it, and one per row that carries its number of words."""
    words = df.select(
        F.col(id_col).alias("doc_id"),
        F.monotonically_increasing_id().alias("rid"),
        F.regexp_extract_all(ascii_lower(text_or_empty(F.col(text_col))), F.lit(WORD), F.lit(0)).alias("w"),
    )
    # the last element of each array is no gram: it carries the row itself
    none = F.array(F.struct(*[F.lit(None).cast("string").alias(x) for x in "abc"]))
    grams = F.arrays_zip(F.col("w").alias("a"), F.slice("w", F.lit(2), F.size("w")).alias("b"), F.slice("w", F.lit(3), F.size("w")).alias("c"))
    rolled = words.select("doc_id", "rid", F.size("w").cast("long").alias("n"), F.posexplode(F.concat(grams, none)).alias("p", "x"))
    sizes = F.explode(F.when(F.col("x.c").isNotNull(), F.array(F.lit(2), F.lit(3))).otherwise(F.array(F.lit(2)))).alias("k")
    rolled = rolled.select("doc_id", "rid", "n", "p", F.col("x.a").alias("a"), F.col("x.b").alias("b"), F.col("x.c").alias("third"), sizes)
    d = rolled.withColumn("c", F.when(F.col("k") == 3, F.col("third"))).withColumn("g", F.xxhash64("a", "b", "c")).alias("d")
    t = F.broadcast(template_grams(df.sparkSession)).alias("t")  # a fixed table of a few hundred rows
    equal = (F.col("d.g") == F.col("t.g")) & (F.col("d.a") == F.col("t.t1")) & (F.col("d.b") == F.col("t.t2")) & F.col("d.c").eqNullSafe(F.col("t.t3"))
    met = d.join(t, equal, "left").filter("t.phrase IS NOT NULL OR d.a IS NULL")
    key = ["doc_id", "rid", "phrase", "label", "base", "size", "k"]
    return (
        met.select("d.doc_id", "d.rid", F.when(F.col("d.a").isNull(), F.col("d.n")).alias("n"), "t.phrase", "t.label", "t.base", "t.size", "t.k", F.col("d.p").cast("long").alias("p"), (F.col("d.p") - F.col("t.pos")).cast("long").alias("diagonal"))
        .groupBy(*key, "diagonal")
        .agg(F.max("n").alias("n_words"), F.collect_list("p").alias("ps"))  # a diagonal has no more votes than its template has grams
    )


def merged_spans(votes: DataFrame, slack: int) -> DataFrame:
    """Diagonals of a template that are at most ``slack`` apart become one span; those of a base phrase stay apart.

    start, end: its words; part: the number of template words it stands for; same: words that both have.
    """
    along = Window.partitionBy("rid", "phrase").orderBy("diagonal")
    fresh = F.col("base") | F.col("diagonal").isNull() | (F.col("diagonal") - F.lag("diagonal").over(along) > slack)
    numbered = votes.withColumn("span", F.sum(F.coalesce(fresh, F.lit(True)).cast("int")).over(along))
    qs = F.transform("ps", lambda p: p - F.col("diagonal"))
    spans = (
        numbered.withColumn("qs", qs)
        .groupBy("rid", "doc_id", "phrase", "label", "base", "size", "k", "span")
        .agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("ps")).alias("ps"), F.flatten(F.collect_list("qs")).alias("qs"))
    )
    covered = lambda at: F.size(F.array_distinct(F.flatten(F.transform(at, lambda p: F.sequence(p, p + F.col("k") - 1)))))
    ends = {"start": F.array_min("ps"), "end": F.array_max("ps") + F.col("k"), "part": F.array_max("qs") + F.col("k") - F.array_min("qs")}
    return spans.withColumns(ends | {"same": F.least(covered("ps"), covered("qs"))})


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", slack: int = 2, least: float = 0.7, least_words: int = 8) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Phrases of the base table count where all their words stand in a row. A notice adds its label where a span of its
    merged diagonals and the stretch of the notice that it stands for have at least ``least`` of their words in common,
    and that stretch has ``least_words`` words or is the whole notice. ``score`` is the best such share, 1 with any base
    phrase, 0 where nothing passes. ``spans`` lists label:start:end (words, end exclusive) in order. Null and empty texts
    have no words. Repeated rows give repeated results, null ids are kept, an empty table gives an empty result, other columns are not read.
    """
    v = merged_spans(diagonals(df, id_col, text_col), slack)
    share = (F.col("same") / F.greatest(F.col("end") - F.col("start"), F.col("part"))).cast("double")
    full = F.col("base") & (F.col("same") == F.col("size"))
    near = ~F.col("base") & (share >= least) & (F.col("part") >= F.least(F.col("size"), F.lit(least_words)))
    v = v.withColumns({"full": F.coalesce(full, F.lit(False)), "found": F.coalesce(full | near, F.lit(False)), "share": share})
    listed = F.sort_array(F.collect_list(F.when(F.col("found"), F.struct("start", "end", "label"))))
    out = v.groupBy("rid", "doc_id").agg(
        F.max("n_words").alias("n_words"),
        F.count(F.when(F.col("full"), 1)).alias("n_base"),
        F.min(F.when(F.col("full"), F.col("start"))).alias("first_word"),
        F.max(F.when(F.col("full"), F.col("start"))).alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("full"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("found"), F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(F.when(F.col("found"), F.col("share"))), F.lit(0.0)).alias("score"),
        F.array_join(F.transform(listed, lambda x: F.concat_ws(":", x["label"], x["start"].cast("string"), x["end"].cast("string"))), ",").alias("spans"),
    )
    return out.drop("rid")


def oracle() -> str:
    """DuckDB SQL for ``license_scan`` with its default options, over the same templates."""
    quoted = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
    values = ", ".join(f"({', '.join(map(quoted, row))})" for row in gram_rows())
    return rf"""
WITH t(t1, t2, t3, phrase, pos, k, size, label, base) AS (VALUES {values}),
     w AS (SELECT row_number() OVER () AS rid, doc_id,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
     g AS (SELECT rid, unnest(w) AS a, unnest(w[2:]) AS b, unnest(w[3:]) AS c, unnest(range(len(w))) AS p FROM w),
     v AS (SELECT rid, phrase, label, base, size, k, p, pos AS q, p - pos AS diagonal
           FROM g JOIN t ON g.a = t.t1 AND g.b = t.t2 AND (t.t3 IS NULL OR g.c = t.t3)),
     d AS (SELECT DISTINCT rid, phrase, base, diagonal FROM v),
     n AS (SELECT *, base OR coalesce(diagonal - lag(diagonal) OVER a > 2, true) AS fresh FROM d WINDOW a AS (PARTITION BY rid, phrase ORDER BY diagonal)),
     m AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY rid, phrase ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS span FROM n),
     e AS (SELECT v.*, m.span, unnest(range(k)) AS i FROM v JOIN m USING (rid, phrase, diagonal)),
     s AS (SELECT rid, phrase, label, base, size, span, min(p) AS first, max(p) + any_value(k) AS last, max(q) + any_value(k) - min(q) AS part,
                  least(count(DISTINCT p + i), count(DISTINCT q + i)) AS same
           FROM e GROUP BY ALL),
     x AS (SELECT *, same::DOUBLE / greatest(last - first, part) AS share, base AND same = size AS is_full FROM s),
     f AS (SELECT *, is_full OR (NOT base AND share >= 0.7::DOUBLE AND part >= least(size, 8)) AS found FROM x),
     r AS (SELECT rid, count(*) FILTER (WHERE is_full) AS n_base,
                  min(first) FILTER (WHERE is_full) AS first_word, max(first) FILTER (WHERE is_full) AS last_word,
                  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE is_full) AS base_labels,
                  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE found) AS labels,
                  max(share) FILTER (WHERE found) AS score,
                  string_agg(label || ':' || first || ':' || last, ',' ORDER BY first, last, label) FILTER (WHERE found) AS spans
           FROM f GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score, coalesce(spans, '') AS spans
FROM w LEFT JOIN r USING (rid)
"""
