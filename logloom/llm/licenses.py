"""License scan by diagonal voting, in DataFrame functions only.

Every pair of consecutive words of a text (k = 2) is hashed and joined to the
positions of the same pair in the templates. A pair votes for the diagonal
text position - template position, that is for one placement of the template;
the words themselves are compared in the join, so a hash collision cannot vote.
A placement with a vote for each of the template's pairs holds the whole
phrase. Neighbouring diagonals, which words put in or left out make, are merged
and their span is verified against the template's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases that count wherever they stand in full: (phrase, label).
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
#: Sentences that are found when most of them stands there: (sentence, label).
SENTENCES = [
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("licensed under the apache license", "apache"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("licensed under the gnu general public license version", "gpl"),
    ("licensed under the gnu lesser general public license", "lgpl"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("creative commons attribution", "cc-by"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    # sentences of the licenses' own bodies
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit"),
    ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "bsd"),
    ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products", "bsd-3-clause"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "apache-2.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("this software is provided as is without any express or implied warranty", "zlib"),
    ("everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", "gpl"),
    ("to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "cc0"),
]
#: Share of a sentence's pairs that must vote.
COVER = 0.8
#: Diagonals this far apart are neighbours: so many words may be put in or left out.
SLACK = 2
#: Template pairs that are broadcast, at most.
MAX_PAIRS = 50_000


def template_rows(base: list[tuple[str, str]], sentences: list[tuple[str, str]]) -> list[tuple]:
    """(template, is_base, label, pairs, position, first word, second word) of each pair of each template."""
    rows = []
    for t, (phrase, label, is_base) in enumerate([(p, n, True) for p, n in base] + [(p, n, False) for p, n in sentences]):
        words = phrase.split(" ")
        if len(words) < 2:
            raise ValueError(f"a template needs two words: {phrase!r}")
        rows += [(t, is_base, label, len(words) - 1, k, words[k], words[k + 1]) for k in range(len(words) - 1)]
    if len(rows) > MAX_PAIRS:
        raise ValueError(f"{len(rows)} template pairs; at most {MAX_PAIRS} are broadcast")
    return rows


def _pairs_table(spark: SparkSession, base: list, sentences: list) -> DataFrame:
    rows = template_rows(base, sentences)
    made = spark.createDataFrame(rows, "t int, is_base boolean, label string, pairs int, tpos int, ta string, tb string")
    return made.withColumn("h", F.xxhash64("ta", "tb"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: list[tuple[str, str]] | None = None, sentences: list[tuple[str, str]] | None = None, cover: float = COVER) -> DataFrame:
    """One row per input row: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts every place of every base phrase, overlapping ones too.
    score is the largest share of a found template's pairs: 1 with a whole
    phrase, 0 where nothing is found. A null or empty text has no words, no
    places, empty label lists, null first and last words. Rows with null or
    equal ids each return. Very long texts are one array of words in one task.
    Other columns are ignored, whatever their names; an empty table stays empty.
    """
    base = BASE if base is None else base
    sentences = SENTENCES if sentences is None else sentences
    pairs = _pairs_table(docs.sparkSession, base, sentences)
    words = docs.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col(id_col).alias("id"),
        F.regexp_extract_all(F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0)).alias("words"),
    )
    # the last pair of a text has no second word: that row keeps texts without any hit
    zipped = words.select("rid", "id", F.size("words").cast("long").alias("n_words"), F.arrays_zip(F.col("words").alias("a"), F.slice("words", 2, F.size("words")).alias("b")).alias("zipped"))
    rows = zipped.select("rid", "id", "n_words", F.posexplode_outer("zipped")).select("rid", "id", "n_words", "pos", F.col("col.a").alias("a"), F.col("col.b").alias("b"))
    rows = rows.withColumn("h", F.when(F.col("b").isNotNull(), F.xxhash64("a", "b")))
    hits = rows.join(F.broadcast(pairs), (rows.h == pairs.h) & (rows.a == pairs.ta) & (rows.b == pairs.tb), "left").filter("t is not null or b is null")
    hits = hits.select("rid", "id", "n_words", "t", "is_base", "label", "pairs", F.col("tpos").cast("long").alias("tpos"), (F.col("pos") - F.col("tpos")).cast("long").alias("diag"), F.col("pos").cast("long").alias("pos"))
    of = Window.partitionBy("rid", "t")
    # a diagonal has each template pair once at most: its votes are the pairs that it matches
    voted = hits.repartition("rid").withColumn("votes", F.count("*").over(Window.partitionBy("rid", "t", "diag")))
    gap = F.col("diag") - F.lag("diag").over(of.orderBy("diag", "tpos"))
    merged = voted.withColumn("apart", F.when(gap.isNull() | (gap > F.when(F.col("is_base"), 0).otherwise(SLACK)), 1).otherwise(0))
    merged = merged.withColumn("run", F.sum("apart").over(of.orderBy("diag", "tpos")))
    # of neighbouring diagonals each template pair counts once, where it is nearest the one with the most votes, and in the template's order
    in_run = Window.partitionBy("rid", "t", "run")
    merged = merged.withColumn("main", F.first("diag").over(in_run.orderBy(F.desc("votes"), "diag", "tpos").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    merged = merged.withColumn("main", F.when(F.col("t").isNull(), F.lit(None)).otherwise(F.col("main")))
    nearest = Window.partitionBy("rid", "t", "run", "tpos").orderBy(F.abs(F.col("diag") - F.col("main")), "diag")
    once = merged.withColumn("nearest", F.row_number().over(nearest)).filter("nearest = 1")
    before = F.max("pos").over(in_run.orderBy("tpos").rowsBetween(Window.unboundedPreceding, -1))
    ordered = once.withColumn("counts", F.col("t").isNotNull() & (before.isNull() | (F.col("pos") > before)))
    held = F.when(F.col("counts"), F.col("pos"))
    spans = ordered.groupBy("rid", "id", "n_words", "t", "is_base", "label", "pairs", "run").agg(F.count(held).alias("votes"), F.min("diag").alias("diag"), F.min(held).alias("lo"), F.max(held).alias("hi"))
    whole = F.col("is_base") & (F.col("votes") == F.col("pairs"))
    near = ~F.col("is_base") & (F.col("votes") >= cover * F.col("pairs")) & (F.col("hi") - F.col("lo") + 1 <= F.col("pairs") + 2 * SLACK)
    share = F.when(whole | near, F.least(F.lit(1.0), F.col("votes") / F.col("pairs")))

    def listed(when: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.when(when, F.col("label")))), ",")

    return spans.groupBy("rid", "id", "n_words").agg(
        F.sum(F.when(whole, 1).otherwise(0)).cast("long").alias("n_base"),
        F.min(F.when(whole, F.col("diag"))).alias("first_word"),
        F.max(F.when(whole, F.col("diag"))).alias("last_word"),
        listed(whole).alias("base_labels"),
        listed(whole | near).alias("labels"),
        F.coalesce(F.max(share), F.lit(0.0)).alias("score"),
    ).drop("rid")


def oracle_sql(base: list[tuple[str, str]] | None = None, sentences: list[tuple[str, str]] | None = None, cover: float = COVER) -> str:
    """DuckDB SQL for scan() over documents; ids must be unique."""
    rows = template_rows(BASE if base is None else base, SENTENCES if sentences is None else sentences)
    values = ", ".join(f"({t}, {str(b).lower()}, '{n}', {m}, {k}, '{x}', '{y}')" for t, b, n, m, k, x, y in rows)
    return f"""
WITH tp(t, is_base, label, pairs, tpos, ta, tb) AS (VALUES {values}),
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS words FROM documents),
n AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words FROM w),
p AS (SELECT doc_id, words, unnest(range(1, len(words))) AS i FROM w WHERE len(words) > 1),
g AS (SELECT doc_id, i - 1 AS pos, words[i] AS a, words[i + 1] AS b FROM p),
v AS (SELECT doc_id, t, is_base, label, pairs, CAST(tpos AS BIGINT) AS tpos, pos, pos - tpos AS diag, count(*) OVER (PARTITION BY doc_id, t, pos - tpos) AS votes
      FROM g JOIN tp ON a = ta AND b = tb),
m AS (SELECT *, CASE WHEN coalesce(diag - lag(diag) OVER q > CASE WHEN is_base THEN 0 ELSE {SLACK} END, true) THEN 1 ELSE 0 END AS apart
      FROM v WINDOW q AS (PARTITION BY doc_id, t ORDER BY diag, tpos)),
r AS (SELECT *, sum(apart) OVER (PARTITION BY doc_id, t ORDER BY diag, tpos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM m),
e AS (SELECT *, first_value(diag) OVER (PARTITION BY doc_id, t, run ORDER BY votes DESC, diag, tpos) AS main FROM r),
o AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY doc_id, t, run, tpos ORDER BY abs(diag - main), diag) = 1),
c AS (SELECT *, coalesce(pos > max(pos) OVER (PARTITION BY doc_id, t, run ORDER BY tpos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS counts FROM o),
s AS (SELECT doc_id, t, is_base, label, pairs, run, count(*) FILTER (counts) AS votes, min(diag) AS diag, min(pos) FILTER (counts) AS lo, max(pos) FILTER (counts) AS hi
      FROM c GROUP BY doc_id, t, is_base, label, pairs, run),
f AS (SELECT *, is_base AND votes = pairs AS whole,
             NOT is_base AND votes >= {cover} * pairs AND hi - lo + 1 <= pairs + {2 * SLACK} AS near FROM s),
a AS (SELECT doc_id, sum(CASE WHEN whole THEN 1 ELSE 0 END) AS n_base,
             min(CASE WHEN whole THEN diag END) AS first_word, max(CASE WHEN whole THEN diag END) AS last_word,
             string_agg(DISTINCT CASE WHEN whole THEN label END, ',' ORDER BY CASE WHEN whole THEN label END) AS base_labels,
             string_agg(DISTINCT CASE WHEN whole OR near THEN label END, ',' ORDER BY CASE WHEN whole OR near THEN label END) AS labels,
             max(CASE WHEN whole OR near THEN least(1.0, CAST(votes AS DOUBLE) / pairs) END) AS score
      FROM f GROUP BY doc_id)
SELECT n.doc_id, n.n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
       CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM n LEFT JOIN a ON a.doc_id = n.doc_id
"""
