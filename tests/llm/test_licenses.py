"""License scans against plain Python and the oracle SQL on odd texts."""

import re

import duckdb

from pyspark.sql import functions as F

from wavecohort.llm import licenses

SCHEMA = "doc_id long, text string, label string, words_ string"


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    at = [(i, label) for label, p in licenses.BASE for n in [len(p.split())] for i in range(len(words) - n + 1) if words[i:i + n] == p.split()]
    starts = [i for i, _ in at]
    return len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


TEXTS = [None, "", "cc by", "CC BY CC-BY, cc by", "x" * 5000 + " cc", "All rights reserved. all RIGHTS\nreserved", "(general public license",
         "Licensed under the  Apache License, Version 2.0.", "licensed under the fine apache license version 2 0", "licensed apache",
         "This work is licensed under the GNU General Public License, version 3.", "é cc by ñ cc\xa0by", "cc " * 30_000 + "by",
         "Released under the MIT License. Released under the MIT License.", "all rights all rights reserved", "Licensed under CC BY-NC 4.0."]


def test_against_brute_force_and_oracle(spark):
    rows = [(i, t, "q", "z") for i, t in enumerate(TEXTS)] + [(2, "cc by", "q", "z"), (2, "other all rights reserved", "q", "z"), (None, "cc by", None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, licenses.scan(df).collect()), key=repr)
    want = sorted([(i, *brute(t)) for i, t, *_ in rows], key=repr)
    assert sorted([g[:6] for g in got], key=repr) == want
    documents = df.toArrow()
    con = duckdb.connect()
    con.register("documents", documents)
    assert sorted(con.execute(licenses.oracle_sql()).fetchall(), key=repr) == got
    by = {g[0]: g for g in got}
    assert by[7][6] == "apache-2.0" and by[7][7] == 1.0 and by[8][6] == "apache-2.0" and 0.8 <= by[8][7] < 1
    assert by[9][6] == "" and by[10][6] == "gpl,gpl-3.0" and by[13][6] == "mit" and by[15][6] == "cc-by,cc-by-nc"
    assert licenses.scan(df.limit(0)).count() == 0


def test_spans_of_repeated_notices(spark):
    df = spark.createDataFrame([(1, " ".join(["Released under the MIT License."] * 3))], "k int, text_ string")
    out = licenses.spans(df, ["k"]).filter("verified").collect()
    assert sorted((r.label, r.first_word, r.last_word) for r in out) == [("mit", 0, 4), ("mit", 5, 9), ("mit", 10, 14)]


def test_only_a_to_z_are_lowered(spark):
    # the Kelvin sign is no k, so these words are in no template
    df = spark.createDataFrame([(1, "This wor\u212a is licensed under", "q", "z"), (2, "CC BY", "q", "z")], SCHEMA)
    words = {r[0]: r[1] for r in df.withColumn("text_", F.col("text")).select("doc_id", licenses._words()).collect()}
    assert words == {1: ["this", "wor\u212a", "is", "licensed", "under"], 2: ["cc", "by"]}
