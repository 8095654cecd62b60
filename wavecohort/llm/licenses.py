"""License scans by diagonal voting (operator 6), DataFrame functions only.

Every text is cut into words; the hash of every two neighbouring words is joined
with the word pairs of the templates (a constant table of a few hundred rows,
broadcast) and the words themselves are compared.  A hit votes for its diagonal,
text position minus template position.  A base phrase stands where one diagonal
has all votes.  For the longer templates, diagonals at most ``MERGE`` apart are
merged (words inserted or left out); a span is verified when it covers at least
``COVERAGE`` of the template's pairs and isn't much longer than the template.

Only hits leave the scan; they are grouped by text and template.  Rows are told
apart by id and two hashes of the text, and hits are counted as sets, so repeated
rows get equal results.  The grouped table is written before it is joined back, so
Spark broadcasts it only if its size allows, and splits a hot key otherwise.

Defined cases: null text counts as empty (no words, no labels, score 0); no label
is the empty string; null ids are kept; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavecohort.llm.common import staged, text_or_empty

MERGE, COVERAGE, SLACK = 2, 0.8, 4
#: Base phrases and their labels.
BASE = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))
#: Usual wording of license notices and their labels.
NOTICES = (
    ("agpl", "gnu affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl-notice", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "gnu lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "released under the mit license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def templates(base=BASE, notices=NOTICES) -> list[tuple]:
    """``(template, label, is_base, n_pairs, position, word, next_word)`` of every word pair."""
    out = []
    for t, (label, text) in enumerate((*base, *notices)):
        w = text.split()
        if len(w) < 2:
            raise ValueError("a template has at least two words")
        out += [(t, label, t < len(base), len(w) - 1, p, w[p], w[p + 1]) for p in range(len(w) - 1)]
    return out


def _values(base=BASE, notices=NOTICES) -> str:
    """The template pairs as SQL rows (words have letters and digits only)."""
    return ", ".join(f"({t}, '{label}', {str(b).lower()}, {n}, {p}, '{w}', '{x}')" for t, label, b, n, p, w, x in templates(base, notices))


def _words():
    # A-Z only: lower() maps the Kelvin sign to k, too
    return F.array_remove(F.split(F.translate(F.col("text_"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), _GAP), "")


def _pairs(df: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, at, word, next_word``: every two neighbouring words."""
    words = df.withColumn("words_", _words())
    zipped = words.select(*keys, F.arrays_zip(F.col("words_").alias("word"), F.slice("words_", F.lit(2), F.size("words_")).alias("next_word")).alias("z"))
    return zipped.select(*keys, F.posexplode("z").alias("at", "p")).select(*keys, "at", "p.word", "p.next_word")


def spans(df: DataFrame, keys: list[str], base=BASE, notices=NOTICES) -> DataFrame:
    """``keys, label, is_base, first_word, last_word, coverage, verified``: one row for each
    place of a base phrase and each merged diagonal of a notice.  ``df`` has ``keys``
    and the text as ``text_``."""
    spark: SparkSession = df.sparkSession
    grams = spark.sql(f"SELECT * FROM VALUES {_values(base, notices)} AS "
                      "t(template, label, is_base, n_pairs, position, t_word, t_next)")
    grams = F.broadcast(grams.withColumn("t_hash", F.xxhash64("t_word", "t_next")))
    hits = _pairs(df, keys).withColumn("hash", F.xxhash64("word", "next_word")).join(
        grams, F.expr("hash = t_hash and word = t_word and next_word = t_next"))
    votes = hits.groupBy(*keys, "template", "label", "is_base", "n_pairs", (F.col("at") - F.col("position")).alias("diagonal"), "position").agg(
        F.count(F.lit(1)).alias("rows_"))
    near = Window.partitionBy(*keys, "template").orderBy("diagonal")
    step = F.col("diagonal") - F.lag("diagonal").over(near)
    apart = F.when(F.col("is_base"), step > 0).otherwise(step > MERGE)
    merged = (votes.withColumn("new", F.coalesce(apart, F.lit(True)).cast("int"))
              .withColumn("band", F.sum("new").over(near.rangeBetween(Window.unboundedPreceding, 0)))
              .groupBy(*keys, "template", "label", "is_base", "n_pairs", "band")
              .agg(F.count_distinct("position").alias("covered"), F.min(F.col("diagonal") + F.col("position")).alias("first_word"),
                   F.max(F.col("diagonal") + F.col("position") + 1).alias("last_word")))
    coverage = F.col("covered") / F.col("n_pairs")
    length = F.col("last_word") - F.col("first_word") + 1
    return merged.select(*keys, "label", "is_base", "first_word", "last_word", coverage.alias("coverage"),
                         F.when(F.col("is_base"), F.col("covered") == F.col("n_pairs"))
                         .otherwise((coverage >= COVERAGE) & (length <= F.col("n_pairs") + 1 + SLACK)).alias("verified"))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``."""
    keys = ["doc_id", "hash_1", "hash_2"]
    text = text_or_empty(text_col)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("hash_1"), F.xxhash64(F.lit(1), text).alias("hash_2"),
                     text.alias("text_"))
    base = F.col("is_base") & F.col("verified")

    def joined(where):
        return F.array_join(F.array_sort(F.collect_set(F.when(where, F.col("label")))), ",")
    found = spans(rows, keys).groupBy(*keys).agg(
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("first_word"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first_word"))).cast("long").alias("last_word"), joined(base).alias("base_labels"),
        joined(F.col("verified")).alias("labels"), F.max("coverage").alias("score"))
    found = staged(found, "licenses")
    counted = rows.select(*keys, F.size(_words()).cast("long").alias("n_words"))
    same = F.col("r.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("r.hash_1") == F.col("f.hash_1")) & (F.col("r.hash_2") == F.col("f.hash_2"))
    return (counted.alias("r").join(found.alias("f"), same, "left")
            .select("r.doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
                    F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
                    F.coalesce("score", F.lit(0.0)).alias("score")))


def oracle_sql() -> str:
    """The scan of ``documents`` as DuckDB SQL."""
    return f"""
WITH grams(template, label, is_base, n_pairs, position, t_word, t_next) AS (VALUES {_values()}),
d AS (SELECT doc_id, row_number() OVER () AS k,
             list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
pairs AS (SELECT k, unnest(range(len(w) - 1)) AS pos, unnest(w[1:len(w) - 1]) AS word, unnest(w[2:]) AS next_word FROM d WHERE len(w) > 1),
votes AS (SELECT DISTINCT k, template, label, is_base, n_pairs, pos - position AS diagonal, position
          FROM pairs JOIN grams ON word = t_word AND next_word = t_next),
steps AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER s > (CASE WHEN is_base THEN 0 ELSE {MERGE} END)
                           OR lag(diagonal) OVER s IS NULL THEN 1 ELSE 0 END AS fresh
          FROM votes WINDOW s AS (PARTITION BY k, template ORDER BY diagonal, position)),
bands AS (SELECT *, sum(fresh) OVER (PARTITION BY k, template ORDER BY diagonal RANGE UNBOUNDED PRECEDING) AS band FROM steps),
merged AS (SELECT k, label, is_base, n_pairs, count(DISTINCT position) AS covered, min(diagonal + position) AS f,
                  max(diagonal + position + 1) AS l FROM bands GROUP BY k, template, label, is_base, n_pairs, band),
spans AS (SELECT *, CASE WHEN is_base THEN covered = n_pairs
                         ELSE covered / n_pairs >= {COVERAGE} AND l - f + 1 <= n_pairs + 1 + {SLACK} END AS ok FROM merged),
found AS (SELECT k, count(*) FILTER (is_base AND ok) AS n_base, min(f) FILTER (is_base AND ok) AS first_word,
                 max(f) FILTER (is_base AND ok) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (is_base AND ok) AS base_labels,
                 string_agg(DISTINCT label, ',' ORDER BY label) FILTER (ok) AS labels, max(covered / n_pairs) AS score FROM spans GROUP BY k)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN found USING (k)"""
