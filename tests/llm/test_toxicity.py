"""Toxicity: folding, exceptions, matching against plain search, held-out accuracy."""

import zlib

from pyspark.sql import functions as F

from wavecohort.llm import toxicity
from wavecohort.llm.toxicity import Model, fold


def test_folding():
    for word in ("1d10t", "IDIOT", "іdіоt", "ｉｄｉｏｔ", "id​iot", "Idi0t!", "i­diot,"):
        assert fold(f"an {word} here") == " an idiot here ", word
    assert fold("c1own $tup1d 5cum 2024 3") == " ciown stupid scum 2024 3 " and fold("clown") == " ciown "
    assert fold("") == "  " and fold("été") == " été "


def test_heaviest_entry_and_exceptions():
    m = Model({" idiot ": 4.0, fold("clown"): 3.0, fold("low"): 2.5, " iowei": 5.0}, (1.0, 1.0, 1.0, -9.0), ("clown fish",))
    assert m.features(fold("loweient"))[2] == 5.0
    assert m.features(fold("a clown fish swims"))[2] == 0.0
    assert m.features(fold("a clown fishes"))[2] == 3.0
    assert m.features(fold("idiots and midiot"))[2] == 0.0
    text = "idiot clown idiot " * 3 + "word " * 50
    brute = sum({"idiot": 4.0, "clown": 3.0}.get(w, 0) for w in text.split())
    assert abs(m.features(fold(text))[0] - __import__("math").log1p(brute)) < 1e-12
    assert m.score(text) > m.score("word " * 40 + "idiot") > m.score("") == m.score("word")


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    out = toxicity.scored(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and 0 <= r.score <= 1 for r in out)
    hit = sum(r.predicted and r.toxic for r in out)
    assert hit >= 0.9 * sum(r.toxic for r in out)
    assert sum(r.predicted and not r.toxic for r in out) <= 0.01 * len(out)


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 5.0), (2, "", 1.0), (None, "x", 2.0), (3, "a b " * 20_000, 0.0), (3, "a", 0.0)],
                                 "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    odd = spark.createDataFrame([(1, None), (None, 1), (2, 1), (2, 0), (77, 1)], "doc_id long, toxic int")
    for labels in (none, odd):
        out = toxicity.scored(docs, toxicity.fit(docs, labels)).collect()
        assert len(out) == 5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
        assert not [r.held_out for r in out if r.doc_id is None][0]
    assert toxicity.scored(docs.limit(0), toxicity.fit(docs.limit(0), odd)).count() == 0
    assert docs.filter(F.lit(False)).count() == 0


def test_disguised_forms():
    for word in ("dis9usting", "di5gu$t1ng", "(disgu5ting)"):
        assert fold(f"so {word} here") == " so disgusting here ", word
    for word in ("(1diot)", '"1diot"', "!diot", "|diot", "-!d1ot", "_1diot_"):
        assert fold(f"an {word} here") == " an idiot here ", word
    assert fold("9 2024 (3) ! | 1999") == " 9 2024 3 1999 "
    m = Model({" idiot ": 4.0, fold("loser"): 3.0, " été ": 2.5}, (1.0, 1.0, 1.0, -9.0), ("sore loser",))
    assert m.features(fold("an ídíot here")) == m.features(fold("an i\u0301di\u0301ot here")) == m.features(fold("an idiot here"))
    assert m.features(fold("a ĺóser"))[2] == 3.0 and m.features(fold("a sóre loser"))[2] == 0.0
    assert m.features(fold("l'été"))[2] == 2.5 and m.features(fold("ete 한국어"))[2] == 0.0


def test_the_lexicon_has_no_cap(spark):
    words = [f"zq{a}{b}x" for a in "abcdefghijklmnop" for b in "abcdefghijklmnop"]
    toxic = [(i, " ".join(f"{w}{c}" for w in words for c in "qrstuvwxyz" * 1), 1) for i in range(1, 40) if i]
    clean = [(1000 + i, "a plain text of common words", 0) for i in range(40)]
    docs = spark.createDataFrame([r[:2] for r in toxic + clean], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in toxic + clean], "doc_id long, toxic int")
    found = toxicity.fit(docs, labels).weights
    assert sum(e.count("zq") > 0 for e in found) >= len(words)
