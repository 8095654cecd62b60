"""Budgets by recursive water filling, prefixes by plain sorting."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from wavecohort.llm import mixing
from wavecohort.llm.mixing import Mix


def brute_budgets(leaves, mix):
    total = sum(leaves.values())
    amount = min(total * mix.epochs, total * mix.budget if mix.budget <= 1 else mix.budget)
    out = {}

    def go(prefix, amount):
        if len(prefix) == 3:
            out[prefix] = amount
            return
        caps = defaultdict(float)
        for leaf, t in leaves.items():
            if leaf[:len(prefix)] == prefix:
                caps[leaf[:len(prefix) + 1]] += t * mix.epochs
        open_, got = dict(caps), {}
        while open_:
            level = amount / sum(mix.weights.get(c, 1.0) for c in open_)
            full = [c for c in open_ if open_[c] <= level * mix.weights.get(c, 1.0) + 1e-9]
            if not full:
                got.update({c: level * mix.weights.get(c, 1.0) for c in open_})
                break
            for c in full:
                got[c] = open_.pop(c)
                amount -= got[c]
        for c, a in got.items():
            go(c, a)
    go((), amount)
    return out


@pytest.mark.parametrize("budget,epochs", [(0.6, 1), (0.6, 4), (1.0, 2), (5000, 3), (10_000_000, 2)])
def test_budgets_and_prefixes(spark, budget, epochs):
    rows = [(i, f"d{i % 3}", ("en", "de")[i % 2] if i % 50 else "fr", "hot" if i % 3 == 0 else f"s{i % 7}", i * 7919 % 1_000_003, 1 + i * i % 90)
            for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, domain string, lang string, source string, row_hash long, tokens long")
    mix = Mix(budget, epochs, 5, {("d0",): 4.0, ("d1",): 0.5, ("d0", "fr"): 9.0, ("d2", "en", "s2"): 6.0})
    leaves = defaultdict(int)
    for r in rows:
        leaves[r[1:4]] += r[5]
    want = brute_budgets(leaves, mix)
    got = mixing.taken(df, mix).collect()
    assert len(got) == len(rows)
    per = defaultdict(list)
    for r in got:
        per[r.domain, r.lang, r.source].append(r)
    for leaf, rs in per.items():
        b = rs[0].leaf_budget
        assert abs(b - want[leaf]) <= 1.01
        assert sum(r.taken_tokens for r in rs) == b
        assert {r.epochs for r in rs} == {b // leaves[leaf]} and b // leaves[leaf] <= epochs
        rest = b - b // leaves[leaf] * leaves[leaf]
        for r in sorted(rs, key=lambda r: r.order):
            assert r.part_tokens == min(r.tokens, max(0, rest))
            rest -= r.tokens


def test_documents_and_selection(spark, small_docs):
    extra = spark.createDataFrame([(9001, None, None, None, 0), (None, "", "en", "src1", 0), (9003, "w " * 9000, "en", "src1", 0)], small_docs.schema)
    docs = small_docs.union(extra).union(small_docs.limit(3)).withColumns({"tokens": F.lit("x"), "epochs": F.lit(1), "salt": F.lit(2), "domain": F.lit("?")})
    mix = Mix(0.5, 1, 3)
    out = mixing.mixed(docs, mix).collect()
    assert len(out) == docs.count()
    total = sum(r.tokens for r in out)
    assert 0.5 * total - 90 <= sum(r.taken_tokens for r in out) <= 0.5 * total
    kept = mixing.selected(docs, mix)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in out if r.taken_tokens > 0)
    assert mixing.mixed(docs.limit(0), mix).count() == 0 and mixing.selected(docs.limit(0), mix).count() == 0


def test_equal_rows_at_the_end_of_a_prefix(spark):
    docs = spark.createDataFrame([(7, "one two three", "en", "s", i) for i in range(200)], "doc_id long, text string, lang string, source string, n_chars long")
    for parts in (1, 9):
        rows = docs.repartition(parts)
        out = mixing.mixed(rows, Mix(240, 1)).collect()
        size = out[0].tokens
        assert sum(r.taken_tokens for r in out) == 240
        kept = mixing.selected(rows, Mix(240, 1)).collect()
        assert len(kept) == -(-240 // size) == sum(r.taken_tokens > 0 for r in out) and len({r.n_chars for r in kept}) == len(kept)


@pytest.mark.parametrize("budget,epochs", [(3.0 * 50, 3), (0.5, 1), (137, 4), (10 ** 6, 3)])
def test_selected_tokens_equal_mixed(spark, small_docs, budget, epochs):
    docs = small_docs.filter("n_chars < 900").limit(60)
    docs = docs.union(docs.limit(20)).union(docs.limit(20)).withColumn("copy", F.lit("x"))
    mix = Mix(budget, epochs, 9)
    want = mixing.mixed(docs, mix).collect()
    kept = mixing.selected(docs, mix)
    assert kept.columns == docs.columns
    got = sorted(r.doc_id for r in kept.collect())
    # as often as taken, a row that counts in part included
    assert got == sorted(i for r in want for i in [r.doc_id] * (r.epochs + (r.part_tokens > 0)))
    part = sum(r.tokens - r.part_tokens for r in want if r.part_tokens)
    tokens = {r.doc_id: r.tokens for r in want}
    assert sum(tokens[i] for i in got) == sum(r.taken_tokens for r in want) + part
