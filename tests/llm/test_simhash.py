"""SimHash components against all-pairs brute force."""

import random

import xxhash

from wavecohort.llm import simhash


def brute_fp(text, k=4):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    k = min(k, len(words))
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i:i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(ids, fps, distance=4):
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(ids[i])
    return {i: min((x for x in groups[find(n)] if x is not None), default=None) for n, i in enumerate(ids)}


def test_documents_match_brute_force(spark, small_docs):
    rows = small_docs.select("doc_id", "text").collect()
    fps = [brute_fp(r.text) for r in rows]
    want = brute([r.doc_id for r in rows], fps)
    got = {r.doc_id: r for r in simhash.components_of(small_docs).collect()}
    assert {i: r.fingerprint for i, r in got.items()} == {r.doc_id: f"{f:016x}" for r, f in zip(rows, fps)}
    assert {i: r.component_id for i, r in got.items()} == want


def test_links_at_every_distance(spark):
    rnd, values = random.Random(7), []
    for _ in range(120):
        base = rnd.getrandbits(64)
        values.append(base)
        for _ in range(rnd.randrange(4)):
            x = base
            for b in rnd.sample(range(64), rnd.randrange(1, 7)):
                x ^= 1 << b
            values.append(x)
    center = rnd.getrandbits(64)                     # a dense group in one run
    values += [center ^ (1 << a) ^ (1 << b) for a in range(0, 40) for b in range(41, 50)]
    values = list(dict.fromkeys(values))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(signed)], "order_id long, fingerprint long")
    got = simhash.classes(df, ["order_id"]).collect()
    want = brute(list(range(len(values))), values)
    assert {r["first"].order_id: r.least.order_id for r in got} == want


def test_edge_cases(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, " \n\t", "c"), (4, "one two", "d"), (4, "one two", "d"), (5, "One\x0bTWO", "e"),
            (None, "alone here in the dark", "f"), (6, "w " * 20_000, "g"), (7, "W " * 20_001, "h"), (8, "é É\xa0x", "i")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = sorted((r.doc_id or -1, r.fingerprint, r.component_id) for r in simhash.components_of(df).collect())
    assert len(got) == len(rows)
    comp = {i: c for i, _, c in got}
    assert comp[1] == comp[2] == comp[3] == 1 and comp[4] == comp[5] == 4 and comp[6] == comp[7] == 6 and comp[-1] is None
    assert {i: f for i, f, _ in got}[1] == "0" * 16
    kept = simhash.dedup(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 1, 4, 6, 8]
    assert simhash.components_of(df.limit(0)).count() == 0 and simhash.dedup(df.limit(0)).count() == 0
