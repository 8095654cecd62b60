"""Quality rules: counts by plain Python, bounds by sorted values, planted junk."""

import math
import re

from pyspark.sql import functions as F

from wavecohort.llm import quality


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    hit = set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1 if len(grams) < 300 else False:
            hit.update(range(i, i + 8))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit) if len(grams) < 300 else None


def test_counts_and_base_rule(spark, small_docs):
    extra = spark.createDataFrame([(9001, None, "en", None, 0), (9002, "", None, "s", 0), (9003, "a\x0bb c\x85d É# | \n\n a\n a", "en", "s", 0),
                                   (9004, "x y z " * 10, "en", "s", 0)], small_docs.schema)
    docs = small_docs.union(extra)
    got = {r.doc_id: r for r in quality.report(docs).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for d in rows:
        n, chars, sym, dup, rep = brute_counts(d.text)
        r = got[d.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == (n, chars, sym, dup)
        if rep is not None:
            assert r.n_repeat_words == rep
        assert r.base_failed == (n < 20 or 100 * r.n_repeat_words > 30 * n)
        assert not (r.base_failed and r.kept)


def test_sketch_quartiles_within_accuracy(spark):
    rows = [(f"{'ab'[i % 2] * (1 + i % 9)} " * 30, "en", "big") for i in range(400)]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    counted = quality.with_counts(df)
    lim = quality.bounds(counted).collect()[0]
    ratios = sorted(x.word_chars / x.n_words for x in counted.collect())
    q25, q75 = (ratios[math.ceil(q * len(ratios)) - 1] for q in (0.25, 0.75))
    spread = max(q75 - q25, 1.0)
    assert abs(lim.word_length_hi - (q75 + 3 * spread)) <= 0.01 * 8 * q75
    assert abs(lim.word_length_lo - (q25 - 3 * spread)) <= 0.01 * 8 * q75


def test_junk_goes_clean_stays_at_any_group_size(spark):
    def clean(i):
        return " ".join(f"word{(i * 31 + j * 7) % 997}" for j in range(60)) + "."
    rows = [(i, clean(i), "en" if i % 3 else "fr", "hot" if i % 2 else f"s{i % 40}") for i in range(600)]
    junk = [(10_000 + i, " ".join(f"w{i}{j}###$$" for j in range(50)), "en", "hot") for i in range(30)]
    df = spark.createDataFrame(rows + junk, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.kept for r in quality.report(df).collect()}
    assert all(got[i] for i in range(600)) and not any(got[i] for i, *_ in junk)
    clash = df.withColumns({"count_x": F.lit(1), "kept_": F.lit(2), "n_words": F.lit(3)})
    out = quality.filtered(clash)
    assert out.columns == clash.columns and {r.doc_id for r in out.collect()} == set(range(600))
    assert quality.filtered(df.limit(0)).count() == 0 and quality.report(df.limit(0)).count() == 0
