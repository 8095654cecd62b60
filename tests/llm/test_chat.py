"""Snapshot collapse against brute-force prefixes and the oracle SQL."""

import random

import duckdb

from wavecohort.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, n_turns int, part string"


def render(turns):
    return "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns)


def brute(convs):
    seqs = {}
    for c, turns in convs.items():
        seqs.setdefault(tuple(turns), []).append(c)
    return {min(ids): (len(s), len(ids), render(s)) for s, ids in seqs.items()
            if not any(len(o) > len(s) and o[:len(s)] == s for o in seqs)}


def test_snapshots_match_brute_force_and_oracle(spark):
    rnd, convs, cid = random.Random(3), {}, 0
    for _ in range(25):
        full = [(("user", "assistant")[i % 2], rnd.choice(["hi", "ok", "a\nb", "", "yes"])) for i in range(rnd.randrange(1, 12))]
        for _ in range(rnd.randrange(1, 4)):
            convs[cid] = full[:rnd.randrange(1, len(full) + 1)]
            cid += 1
    long = [("user", f"t{i}") for i in range(1200)]  # several blocks
    convs[cid], convs[cid + 1], convs[cid + 2] = long, long[:700], long[:699] + [("user", "else")]
    rows = [(c, 3 * i, r, t, 1, "x") for c, ts in convs.items() for i, (r, t) in enumerate(ts)]
    df = spark.createDataFrame(rows + rows[:40], SCHEMA).repartition(5)
    got = {}
    for r in sorted(chat.formatted(df).collect(), key=lambda r: (r.conv_id, r.part)):
        n, k, text = got.get(r.conv_id, (0, 0, ""))
        got[r.conv_id] = (r.n_turns, r.copies, text + r.text)
    assert got == brute(convs)
    con = duckdb.connect()
    con.register("conversations", df.toArrow())
    want = sorted(con.execute(chat.oracle_sql()).fetchall())
    assert sorted(map(tuple, chat.formatted(df).collect())) == want


def test_edge_cases(spark):
    rows = [(1, None, "user", "x"), (1, 0, None, None), (2, 0, "user", "same"), (2, 0, "user", "other"), (None, 0, "user", "<|im_end|>"),
            (3, 0, "user", "w " * 50_000), (3, 0, "user", "w " * 50_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {(r.conv_id, r.part): r for r in chat.formatted(df).collect()}
    assert set(out) == {(1, -1), (1, 0), (2, 0), (None, 0), (3, 0)}
    assert out[1, 0].text == render([("user", "")]) and out[1, 0].n_turns == 2 and out[2, 0].n_turns == 2
    assert out[3, 0].n_turns == 1 and "<| im_end|>" in out[None, 0].text
    assert chat.formatted(df.limit(0)).count() == 0
