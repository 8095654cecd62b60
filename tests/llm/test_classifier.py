"""Kneser-Ney perplexities against a dictionary version; kept and rejected texts."""

import math
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from wavecohort.llm import classifier

ORDER = classifier.ORDER


def symbols(text):
    out = []
    for c in map(ord, text or ""):
        out.append(32 if c < 33 else 48 if 48 <= c < 58 else c)
    return [0] * (ORDER - 1) + out + [1]


class Brute:
    def __init__(self, texts):
        c = {ORDER: Counter(tuple(s[i:i + ORDER]) for s in map(symbols, texts) for i in range(len(s) - ORDER + 1))}
        for k in range(ORDER - 1, 0, -1):
            c[k] = Counter(g[1:] for g in c[k + 1])
        self.c, self.d, self.ctx = c, {}, {}
        for k in c:
            n = Counter(min(v, 5) for v in c[k].values())
            y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
            self.d[k] = {i: min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.1 * i), i) if n[i] and n[i + 1] else 0.5 * i for i in (1, 2, 3)}
            self.ctx[k] = defaultdict(lambda: [0, 0.0])
            for g, v in c[k].items():
                self.ctx[k][g[:-1]][0] += v
                self.ctx[k][g[:-1]][1] += self.d[k][min(v, 3)]

    def p(self, g):
        k = len(g)
        lower = self.p(g[1:]) if k > 1 else 1 / classifier.SYMBOLS
        total, back = self.ctx[k].get(g[:-1], (0, 0))
        if not total:
            return lower
        v = self.c[k].get(g, 0)
        return (v - self.d[k][min(v, 3)] if v else 0) / total + back / total * lower

    def logp(self, text):
        s = symbols(text)
        return sum(math.log(self.p(tuple(s[i:i + ORDER]))) for i in range(len(s) - ORDER + 1))


def test_scores_match_brute_force(spark, small_docs):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    extra = spark.createDataFrame([(9001, None, None, "s", 0), (9002, "", "en", "s", 0), (9003, "日本語 😀 text 12", "ja", "s", 0), (None, "x", "en", "s", 0)],
                                  small_docs.schema)
    docs = small_docs.filter("n_chars < 1500").union(extra)
    rows = docs.collect()
    good = {r.doc_id for r in labels.collect() if r.quality}
    model = Brute([r.text for r in rows if r.doc_id in good and zlib.crc32(str(r.doc_id).encode()) % 5])
    text = {r.doc_id: r.text for r in rows}
    got = classifier.scored(docs, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_symbols == len(text[r.doc_id] or "") + 1
        assert abs(r.logp - model.logp(text[r.doc_id])) < 1e-6 * max(1, abs(r.logp)), r.doc_id
        assert r.trusted == (r.doc_id in good)
    # for a context the probabilities of all symbols sum to one
    ctx = tuple(symbols("the")[-ORDER:-1])
    assert abs(sum(model.p((*ctx, x)) for x in range(classifier.SYMBOLS)) - 1) < 1e-9


def test_blocks_of_scan_splits_give_the_same(spark):
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    a = {(r.doc_id, round(r.logp, 6)) for r in classifier.scored(docs, labels, from_files=True).collect()}
    b = {(r.doc_id, round(r.logp, 6)) for r in classifier.scored(docs.repartition(7), labels).collect()}
    assert a == b


def test_clean_stays_junk_goes(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    out = classifier.report(docs, labels, from_files=True).join(labels, "doc_id").collect()
    assert all(r.kept for r in out if r.quality)
    bad = [r for r in out if not r.quality]
    assert sum(not r.kept for r in bad) > 0.7 * len(bad)
    clash = docs.withColumns({"key_": F.lit(1), "block": F.lit("x"), "logp": F.lit(2)})
    kept = classifier.filtered(clash, labels)
    assert kept.columns == clash.columns
    assert kept.count() == sum(r.kept for r in classifier.report(docs, labels).collect())


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, "a b", "en"), (1, "a b", "en"), (2, None, None)], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    odd = spark.createDataFrame([(1, 1), (1, None), (2, 0), (None, 1)], "doc_id long, quality int")
    for labels in (none, odd):
        assert [r.kept for r in classifier.report(docs, labels).collect()] == [True] * 3
        assert classifier.filtered(docs, labels).count() == 3
        assert classifier.report(docs.limit(0), labels).count() == 0


def test_limits_are_quantiles_of_the_language(spark):
    n = 100_000
    held = [(i, i, "en", True, True, n, -n * (1.5 + i / 1000)) for i in range(200)]
    held += [(5000 + i, i, "en", True, False, n, -n * 1.5) for i in range(40)]
    new = [(1000 + i, i, "en", False, False, n, -n * h) for i, h in enumerate((1.6, 1.69, 1.72, 0.2))]
    got = {r.doc_id: r for r in classifier.judged(spark.createDataFrame(
        held + new, "doc_id long, row_hash long, lang string, trusted boolean, held_out boolean, n_symbols long, logp double")).collect()}
    assert [got[1000 + i].kept for i in range(4)] == [True, True, False, False]
    assert sum(not got[i].kept for i in range(200)) == 2


def test_bad_texts_of_each_kind_go(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    out = (classifier.report(docs, labels, from_files=True).join(labels, "doc_id")
           .join(docs.select("doc_id", "text"), "doc_id").collect())
    clean = [r for r in out if r.quality and r.held_out]
    assert sum(r.kept for r in clean) >= 0.98 * len(clean)
    bad = [r for r in out if not r.quality]
    repeated = [r for r in bad if len(set(r.text.lower().split())) < 0.3 * len(r.text.split())]
    for group in (bad, repeated):
        assert sum(not r.kept for r in group) > 0.9 * len(group) > 90


def test_language_without_trusted_text_stays(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    without = labels.join(docs.filter("lang = 'es'").select("doc_id"), "doc_id", "left_anti")
    out = classifier.report(docs, without, from_files=True).join(docs.select("doc_id", F.col("lang").alias("l")), "doc_id").collect()
    spanish = [r for r in out if r.l == "es"]
    assert spanish and all(r.kept and r.threshold is None for r in spanish)
    assert any(not r.kept for r in out if r.l == "en")


def grams(texts):
    m, r, _ = classifier._ngrams(texts)
    return set(zip(m.tolist(), r.tolist()))


def test_ngrams_reach_over_words_and_tell_symbols_apart():
    one = {chr(c): grams([chr(c)]) for c in range(0x4E00, 0x5200)}
    assert len({frozenset(g) for g in one.values()}) == len(one) and grams(["😀"]) != grams(["😁"])
    # the same words in another order give other n-grams inside, so the table grows with the corpus
    assert len(grams(["one two red", "two one red", "red two one"])) > 1.8 * len(grams(["one two red"]))


def test_pressed_arrays_come_back():
    import numpy as np
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 1000):
        a, b = np.sort(rng.integers(0, 2 ** 62, n)), rng.integers(-2 ** 62, 2 ** 62, n)
        got = classifier._unpressed(classifier._pressed(a, b), n, 2)
        assert (got[0] == a).all() and (got[1] == b).all()


def test_many_small_blocks_give_the_same(spark, small_docs):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    docs = small_docs.filter("n_chars < 1500")
    want = sorted((r.doc_id, round(r.logp, 2)) for r in classifier.scored(docs, labels).collect())
    got = classifier.scored(docs.repartition(3), labels, block_bytes=3000).collect()
    assert sorted((r.doc_id, round(r.logp, 2)) for r in got) == want


def test_very_long_text(spark, small_docs):
    labels = spark.createDataFrame([(1, 1), (7, 1)], "doc_id long, quality int")
    rows = [(1, "the cat sat on the mat. " * 40, "en"), (2, "the cat " * 300_000, "en"), (2, "the cat " * 300_000, "en"), (3, "the cat sat", "en"), (7, "é" * 70_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = Brute([r[1] for r in rows if r[0] in (1, 7) and zlib.crc32(str(r[0]).encode()) % 5])
    got = classifier.scored(docs, labels).collect()
    assert len(got) == 5 and sorted(r.n_symbols for r in got) == sorted(len(r[1]) + 1 for r in rows)
    short = next(r for r in got if r.doc_id == 3)
    assert abs(short.logp - model.logp("the cat sat")) < 1e-5 * abs(short.logp)


def test_copies_are_spread_and_scored_once(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa
    copies = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("the same text").alias("text_"))
    assert copies.select(classifier._share(8)).distinct().count() == 8
    m, r, _ = classifier._ngrams(["a text", "b"])
    m, r, _ = classifier._merged(m, r, np.ones(len(m), np.int64))
    p = -1.0 - np.arange(len(m), dtype=np.float32)
    table = pa.table({"n": [len(m)], "grams": [classifier._pressed(m, r)],
                      "logp": [pa.compress(np.ascontiguousarray(p.view(np.uint8).reshape(-1, 4).T).tobytes(), "zstd", asbytes=True)]})
    texts = ["a text", "b", "a text"] * 100
    batch = pa.RecordBatch.from_arrays([pa.array([5] * 300), pa.array(range(300)), pa.array([0] * 300), pa.array(["en"] * 300), pa.array(texts)],
                                       names=["block", "doc_id", "row_hash", "lang", "text"])
    chunks, scored, ngrams = pa.Table.from_batches(list(classifier._chunks([batch, batch]))), [], classifier._ngrams
    monkeypatch.setattr(classifier, "_ngrams", lambda t: scored.extend(t) or ngrams(t))
    out = classifier._scores(chunks, table)
    assert sorted(scored) == ["a text", "b"]
    assert out.column("n_symbols").to_pylist() == [7, 2, 7] * 200
    logp = out.column("logp").to_pylist()
    assert logp == logp[:3] * 200 and logp[0] == logp[2] != logp[1]


def test_trusted_ids_joined_by_a_shuffle_give_the_same(spark, small_docs, monkeypatch):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    docs = small_docs.filter("n_chars < 1500")
    want = sorted((r.doc_id, round(r.logp, 2)) for r in classifier.scored(docs, labels).collect())
    monkeypatch.setattr(classifier, "TRUSTED_SENT", 0)
    assert sorted((r.doc_id, round(r.logp, 2)) for r in classifier.scored(docs, labels).collect()) == want
