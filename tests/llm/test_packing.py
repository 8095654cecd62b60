"""Packing against its contract and a brute-force reading of the pieces."""

import functools
import zlib
from array import array

from pyspark.sql import functions as F

from wavecohort.llm.common import vocabulary_path
from wavecohort.llm.packing import Limits, pack, sequences


@functools.cache
def _tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(vocabulary_path())


def _encode(text):
    return _tokenizer().encode(text or "", add_special_tokens=False).ids + [2]


def _check(rows, docs, size=4096):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == {d for d, _ in docs}
    for d, text in docs:
        ids, at = _encode(text), 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            at += r.length
            assert r.ids_crc32 == zlib.crc32(array("I", ids[r.start:at]).tobytes())
        assert at == len(ids)
    padding = total = 0
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= size and all(r.sequence_tokens == at for r in rs)
        total += at
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding / max(total, 1)


def test_small_table(spark, small_docs):
    docs = [(r.doc_id, r.text) for r in small_docs.collect()]
    assert _check(pack(small_docs).collect(), docs) < 0.01


def test_edge_cases(spark):
    docs = [(1, None), (2, ""), (3, "one two three"), (4, "word " * 30_000), (5, "x" * 3000), (6, "a\x1cb <|endoftext|>")]
    df = spark.createDataFrame([(i, t, 9) for i, t in docs], "doc_id long, text string, length int").coalesce(1)
    rows = pack(df).collect()
    assert _check(rows, docs) < 0.01
    assert pack(df.limit(0)).count() == 0
    again = pack(df.union(df).coalesce(1)).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in again} == {d: 2 * len(_encode(t)) for d, t in docs}


def test_three_limits_hold(spark):
    rows = [(i, "question " * (i % 7 + 1), "answer " * (i % 11 + 1)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, p string, text string")
    lim = Limits(tokens=64, segments=5, loss=40, min_cut=4, pool_examples=50)
    out = pack(df, prompt_col="p", limits=lim, with_ids=True)
    got = out.collect()
    assert sum(r.length for r in got) == sum(len(_encode(p)) + len(_encode(t)) - 1 for _, p, t in rows)
    assert sum(r.loss_tokens for r in got) == sum(len(_encode(t)) for _, _, t in rows)
    per = out.groupBy("sequence_id").agg(F.sum("length").alias("t"), F.count("*").alias("s"), F.sum("loss_tokens").alias("l")).collect()
    assert all(r.t <= 64 and r.s <= 5 and r.l <= 40 for r in per)
    assert all(len(r.ids) == 4 * r.n_tokens for r in sequences(out).collect())


def test_many_tiny_documents_need_no_padding(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    docs = [(i, "") for i in range(3000)]
    assert _check(pack(df).collect(), docs) == 0


def test_loss_limit_below_the_shortest_cut(spark):
    df = spark.createDataFrame([(i, "q", "answer " * 30) for i in range(6)], "doc_id long, p string, text string")
    lim = Limits(tokens=64, segments=5, loss=8, min_cut=16)
    out = pack(df, prompt_col="p", limits=lim)
    assert out.agg(F.sum("length")).first()[0] == 6 * (len(_encode("answer " * 30)) + len(_encode("q")) - 1)
    assert out.groupBy("sequence_id").agg(F.sum("loss_tokens").alias("l")).agg(F.max("l")).first()[0] <= 8
