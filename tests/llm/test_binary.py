"""Exact round trip of the written shards."""

import zlib
from array import array

import numpy as np
import pytest

from wavecohort.llm import binary
from wavecohort.llm.binary import Layout, permute
from tests.llm.test_packing import _encode


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 65, 1000, 4097])
def test_permutation_is_a_bijection_and_inverts(n):
    slots = permute(np.arange(n), n, "k")
    assert sorted(slots.tolist()) == list(range(n))
    assert permute(slots, n, "k", back=True).tolist() == list(range(n))
    if n >= 64:
        assert permute(np.arange(n), n, "other").tolist() != slots.tolist() and (slots != np.arange(n)).mean() > 0.9


def test_round_trip(spark, small_docs):
    extra = spark.createDataFrame([(9001, None, "en", "s", 0), (9002, "", "en", "s", 0), (None, "word " * 20_000, "en", "s", 0), (5, "five", "x", "y", 1)],
                                  small_docs.schema)
    docs = small_docs.union(extra)
    layout = Layout(length=256, per_shard=100, key="seed")
    manifest, path = binary.materialise(docs, layout)
    rows = {r.slot: r for r in manifest.collect()}
    n = len(rows)
    assert sorted(rows) == list(range(n)) and sorted(r.number for r in rows.values()) == list(range(n))
    slots = permute(np.array([r.number for r in rows.values()]), n, "seed")
    assert slots.tolist() == list(rows)
    want, got = {}, {}
    for d in docs.collect():
        want.setdefault(d.doc_id, []).append(_encode(d.text))
    seen = 0
    for s in range(-(-n // 100)):
        for r in binary.read_records(spark, path, layout, s).collect():
            m, ids = rows[r.slot], np.frombuffer(r.ids, "<u2")
            assert len(ids) == 256 and (m.shard, m.record) == (s, r.slot - 100 * s)
            assert zlib.crc32(array("I", ids[:m.n_ids].tolist()).tobytes()) == m.ids_crc32 and (ids[m.n_ids:] == 2).all()
            at = 0
            for doc, start, length in zip(m.doc_ids, m.starts, m.lengths):
                got.setdefault(doc, []).append((start, ids[at:at + length].tolist()))
                at += length
            assert at == m.n_ids
            seen += 1
    assert seen == n
    for doc, texts in want.items():
        flat = sorted(sum((list(enumerate(t)) for t in texts), []))
        assert sorted((s + i, x) for s, ids in got[doc] for i, x in enumerate(ids)) == flat
    rest = binary.read_records(spark, path, layout, 0, first=97).collect()
    assert [r.slot for r in rest] == [97, 98, 99]


def test_empty(spark, small_docs):
    assert binary.materialise(small_docs.limit(0))[0].count() == 0
