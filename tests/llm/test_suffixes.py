"""Repeated passages against a plain count of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wavecohort.llm import suffixes as S
from wavecohort.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows, w=200):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[a:a + w] for _, t in texts for a in range(len(t) - w + 1))
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for a in range(len(t) - w + 1):
            if seen[t[a:a + w]] > 1:
                gone[a:a + w] = b"\1" * w
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df, **options):
    return sorted(map(tuple, S.cleaned(df, keep_text=False, **options).collect()), key=str)


def words(rng, n):
    return " ".join("".join(rng.choice("aeiouklmnrst") for _ in range(rng.randint(1, 9))) for _ in range(n))


@pytest.mark.parametrize("d", ["sf0.001", "sf0.01"])
def test_registered_query(spark, d):
    path = f"/root/testdata/{d}"
    want = brute([(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()])
    out = QUERIES["op13_suffixes"][0](spark, path)
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(map(tuple, out.collect()), key=str) == want
    assert sum(r[2] for r in want) > 1000


def test_edge_cases(spark):
    rng = random.Random(5)
    a, b, c = words(rng, 90), words(rng, 60), words(rng, 200)
    texts = [None, "", "short", a, a, "é" * 150, "x" * 199, "x" * 200, "y" * 201, "ab " * 3000, b + c[:300] + a[:250], c, c[50:], a[:199], "日本語" * 120, "日本語" * 121,
             words(rng, 100_000) + a[:220], a[:220] + b[:201] + a[:220], "\0" * 250 + b, b + "\0" * 200]
    rows = [(i if i % 5 else None, t, "en", "s", 0) for i, t in enumerate(texts)] + [(3, a, "en", "s", 0)] * 2
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute([(r[0], r[1]) for r in rows])
    for hot in (S.HOT_BYTES, 0):
        assert got(df.withColumns({"anchor": F.lit(1), "rid": F.lit("x"), "n": F.lit(2), "z": F.lit(3), "id": F.lit(4)}), hot_bytes=hot) == want
    assert got(df.limit(0)) == [] and len(got(df.filter("text is null"))) == 1
    kept = {r.doc_id: r for r in S.cleaned(df.filter("doc_id is not null")).collect()}
    assert all(len(r.kept) == r.n_bytes - r.n_removed and hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in kept.values())


def test_common_passage_with_other_words_around_it(spark):
    """One passage in half of all texts: its anchors are hot, so their strings go by strips and single windows."""
    rng = random.Random(6)
    common = words(rng, 60)
    rows = [(i, f"{words(rng, 30)} {common} {words(rng, 30)}" if i % 2 else words(rng, 90) + "ab"[i % 4 // 2] * (i % 3), "en", "s", 0) for i in range(300)]
    rows += [(1000 + i, rows[1][1][:-i - 1] + "z", "en", "s", 0) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute([(r[0], r[1]) for r in rows])
    assert got(df, hot_bytes=20_000) == want == got(df)


def test_pieces_of_a_long_text(spark, monkeypatch):
    rng = random.Random(7)
    a = words(rng, 400)
    texts = [words(rng, 300) + a, a[100:900], a[700:], words(rng, 50)]
    want = brute(list(enumerate(texts)))
    for size in (256, 1000):
        source = [(i, len(t), t.encode()) for i, t in enumerate(texts)]
        monkeypatch.setattr(S, "PIECE", size)
        import pyarrow as pa
        batch = pa.RecordBatch.from_arrays([pa.array([s[0] for s in source]), pa.array([s[1] for s in source]),
                                            pa.array([pa.compress(s[2], "zstd", asbytes=True) for s in source], pa.binary())], names=["rid", "n", "z"])
        covered = Counter()
        for out in S._occurrences([batch]):
            for r in out.to_pylist():
                for k in range(r["windows"]):
                    covered[r["rid"], r["at"] + k] += 1
        assert covered == Counter((i, k) for i, t in enumerate(texts) for k in range(len(t) - 199))
    assert want[0][2] > 0


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10 ** 9), st.integers(1, 4), st.sampled_from([6, 9, 14]))
def test_collection_against_all_windows(seed, letters, w):
    """Runs and rounds for short windows: repeated in the sense of equal windows of the collection."""
    rng, gram = random.Random(seed), 3
    texts = [bytes(rng.randrange(97, 97 + letters) for _ in range(rng.randint(w, 40))) for _ in range(rng.randint(1, 12))]
    texts += [t[rng.randrange(len(t)):] + t for t in texts[:3]]
    piece, start, windows, left, anchor = S.runs(texts, w, gram)
    # every window is in one run, whose anchor lies in all of its windows
    where = Counter((p, a + k) for p, a, n in zip(piece.tolist(), start.tolist(), windows.tolist()) for k in range(n))
    assert where == Counter((p, a) for p, t in enumerate(texts) for a in range(len(t) - w + 1))
    strings = [texts[p][a:a + n + w - 1] for p, a, n in zip(piece.tolist(), start.tolist(), windows.tolist())]
    once = Counter(zip(anchor.tolist(), strings))
    place = {(h, s): x for h, s, x in zip(anchor.tolist(), strings, left.tolist())}
    group = np.unique([h for h, _ in once], return_inverse=True)[1]
    hit, begins = S.repeated_windows(group, np.array([place[k] for k in once]), np.array(list(once.values())), [s for _, s in once], w)
    seen = Counter(t[a:a + w] for t in texts for a in range(len(t) - w + 1))
    flags = {k: b for k, b in zip(once, begins.tolist())}
    for p, a, n, h, s in zip(piece.tolist(), start.tolist(), windows.tolist(), anchor.tolist(), strings):
        for k in range(n):
            assert hit[flags[h, s] + k] == (seen[texts[p][a + k:a + k + w]] > 1)
