"""Fingerprints: next rows and edits by brute force, estimates against true likeness."""

import hashlib

from pyspark.sql import functions as F

from wavecohort.llm import fingerprints


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def edits(docs):
    """docs in order -> (text, edited, next text)."""
    for i, t in enumerate(docs):
        nxt = docs[(i + 1) % len(docs)]
        q = len(t) // 4
        yield t, t[:len(t) - q] + nxt[:q], nxt


def test_documents(spark, small_docs):
    rows = sorted((r.doc_id, r.text) for r in small_docs.collect())
    got = {r.doc_id: r for r in fingerprints.compared(small_docs.repartition(3)).collect()}
    assert len(got) == len(rows)
    errors, by_text = [], {}
    for (i, _), (t, e, nxt) in zip(rows, edits([t for _, t in rows])):
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint and len(r.fingerprint) == 256
        errors += [r.near_edited - jaccard(t, e), r.near_next - jaccard(t, nxt)]
    assert abs(sum(errors) / len(errors)) < 0.02 and sum(x * x for x in errors) / len(errors) < 0.045 ** 2


def test_edge_cases_and_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGES", 4)
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 3)
    texts = [None, "", " \n", "one two", "é" * 9, "a b c d e f g h", "w " * 20_000] + [f"text number {i} " * 5 for i in range(60)]
    rows = [(None if i == 3 else i * i * 1000, t, 1, 2) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int, range int")
    got = {r.doc_id: r for r in fingerprints.compared(df).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for (i, *_), (t, e, nxt) in zip(order, edits([t or "" for _, t, *_ in order])):
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest()), i
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[0].fingerprint == "0" * 256 and got[0].near_next == 1.0
    single = fingerprints.compared(df.filter("doc_id = 25000")).collect()[0]
    assert single.near_next == 1.0
    copies = fingerprints.compared(df.filter("doc_id = 25000").union(df.filter("doc_id = 25000"))).collect()
    assert len(copies) == 2 and all(r.near_next == 1.0 for r in copies)
    assert fingerprints.compared(df.filter(F.lit(False))).count() == 0
