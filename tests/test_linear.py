"""Newton fits against other implementations; kernel machine; folds at once; adaptive search."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavecohort.operators import ensembles as T
from wavecohort.operators import linear as L
from wavecohort.operators import models as M


def frame(spark, n=600, seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = rng.gauss(0, 1), rng.gauss(1, 2)
        rows.append((i, a, b, float(rng.random() < 1 / (1 + math.exp(-a + b / 2))), i % 5))
    return spark.createDataFrame(rows, "id long, a double, b double, label double, fold int")


def test_folds_at_once_equal_separate_fits(spark):
    from pyspark.ml.classification import LogisticRegression
    df = frame(spark)
    rows = M.fold_rows(df, ["a", "b"], "fold", "id", "label", 5)
    together = M.fold_logistic(rows, 5)
    for m in together[:2]:
        alone, = L.newton(rows.filter(F.col("fold") != m.fold), [L.Linear("logistic", 0.9)])
        assert np.allclose(alone.weights, m.weights, rtol=0, atol=1e-6)
    # another implementation: the same loss in Spark ML, per row
    train = df.filter("fold <> 0")
    est = LogisticRegression(regParam=1 / (0.9 * train.count()), standardization=False, maxIter=200, tol=1e-12)
    ml = M.fit(est, train, ["a", "b"]).stages[-1]
    assert np.allclose([*ml.coefficients, ml.intercept], together[0].weights, atol=1e-5)
    got = M.cross_validate(df, ["a", "b"], "fold", 5, "id").collect()
    w = together[3].weights
    held = df.filter("fold = 3").collect()
    want = np.mean([(w[0] * r.a + w[1] * r.b + w[2] > 0) == (r.label > 0) for r in held])
    assert [r.fold for r in got] == list(range(5)) and abs(got[3].accuracy - want) < 1e-12


def test_squared_hinge_is_at_its_minimum(spark):
    df = frame(spark, 200)
    rows = M.fold_rows(df, ["a", "b"], "fold", "id", "label", 5)
    m, = L.newton(rows, [L.Linear("squared_hinge", 2.0)])
    x, y = np.array([[*r.x, 1.0] for r in rows.collect()]), np.array([r.y for r in rows.collect()])

    def loss(w):
        s = np.where(y > 0, 1, -1)
        return 2.0 * (np.maximum(0, 1 - s * (x @ w)) ** 2).sum() + (w[:-1] ** 2).sum() / 2
    w = np.array(m.weights)
    rng = np.random.default_rng(0)
    assert all(loss(w) <= loss(w + rng.normal(size=3) * s) for s in (1e-3, 1e-2, 0.3) for _ in range(30))


def rings(spark, n=800):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        r, t = (1.0 if i % 2 else 2.5) + rng.gauss(0, 0.15), rng.uniform(0, 2 * math.pi)
        rows.append((i, r * math.cos(t), r * math.sin(t), float(i % 2), i % 4))
    return spark.createDataFrame(rows, "id long, a double, b double, label double, fold int")


def test_kernel_machine_separates_two_rings(spark):
    df, names = rings(spark), ["a", "b"]
    right = {}
    for name, x in (("linear", L.vector(names)), ("kernel", L.fourier(L.standardised(df, names), 2, 0.5))):
        rows = M.fold_rows(df, names, "fold", "id", "label", 4, x)
        machines = L.newton(rows, [L.Linear("squared_hinge", 1.0, 0, "fit"), L.Linear("squared_hinge", 1.0, 1, "fit")])
        scales = L.calibrated(rows, machines)
        p = L.logistic(scales[0].weights[0] * L.linear_margin(F.col("x"), machines[0].weights) + scales[0].weights[1])
        right[name] = rows.filter("fold = 0").select(F.avg(((p > 0.5) == (F.col("y") > 0)).cast("double"))).first()[0]
    assert right["kernel"] > 0.98 and right["linear"] < 0.65
    # products of the features approximate the kernel
    a, b = (spark.createDataFrame([v], "a double, b double").select(L.fourier(L.vector(names), 2, 0.5, 4000)).first()[0] for v in ((0.3, -0.2), (1.0, 0.4)))
    assert abs(np.dot(a, b) - math.exp(-0.5 * (0.49 + 0.36))) < 0.05


def test_cross_validation_of_every_classifier(spark):
    df = frame(spark, 400)
    got = M.cross_validate_all(df, ["a", "b"], "fold", 5, "id", forest_trees=8, boost={"n_estimators": 6}).collect()
    assert {(r.classifier, r.fold) for r in got} == {(c, f) for c in ("logreg", "svm", "tree", "forest", "boost") for f in range(5)}
    assert all(0.5 < r.accuracy < 1 for r in got)
    # the tree of fold 2 is the one grown without it
    rows = M.fold_rows(df, ["a", "b"], "fold", "id", "label", 5)
    alone = T.bag(rows.filter("fold <> 2").select("id", "y", "b"), 2, 1, min_leaf=50, bootstrap=False)
    scored = T.bag_scores(rows.filter("fold = 2").select("id", "b"), alone).join(rows.select("id", "y"), "id")
    want = scored.select(F.avg(((F.col("proba") > 0.5) == (F.col("y") > 0.5)).cast("double"))).first()[0]
    assert abs(next(r.accuracy for r in got if r.classifier == "tree" and r.fold == 2) - want) < 1e-12


SPACE = {"x": ("uniform", -5, 5), "y": ("uniform", -5, 5), "k": ("quniform", 0, 20, 1), "c": ("choice", ["a", "b", "c"])}


def surface(p):
    return -(p["x"] - 2) ** 2 - (p["y"] + 1) ** 2 - abs(p["k"] - 13) / 4 - (p["c"] != "b")


def test_suggestions_beat_uniform_draws():
    better = 0
    for seed in range(10):
        seen = []
        while len(seen) < 100:
            seen += [(p, surface(p)) for p in M.suggest(SPACE, seen, 10, seed)]
        uniform = max(surface(p) for p in M.sample_param_maps(SPACE, 100, seed))
        better += max(s for _, s in seen) > uniform
        assert all(-5 <= p["x"] <= 5 and isinstance(p["k"], int) and 0 <= p["k"] <= 20 for p, _ in seen)
        late, early = (np.mean([s for _, s in part]) for part in (seen[-30:], seen[:30]))
        assert late > early
    assert better >= 8


def test_search_of_300_trials_goes_on_after_a_stop(spark, tmp_path):
    path, calls = str(tmp_path / "trials"), []

    def evaluate(params, first):
        calls.append(first)
        if first >= 120 and len(calls) < 4:
            raise RuntimeError("executor lost")
        return [surface(p) for p in params]
    with pytest.raises(RuntimeError):
        M.adaptive_search(spark, SPACE, 300, evaluate, path, 60)
    got = M.adaptive_search(spark, SPACE, 300, evaluate, path, 60).orderBy("trial").collect()
    assert calls == [0, 60, 120, 120, 180, 240] and [r.trial for r in got] == list(range(300))
    assert all(abs(surface(json.loads(r.params)) - r.auc) < 1e-12 for r in got)
    whole = M.adaptive_search(spark, SPACE, 300, lambda ps, first: [surface(p) for p in ps], str(tmp_path / "whole"), 60).orderBy("trial").collect()
    assert whole == got


def test_saved_boosted_model_scores_alike(spark, tmp_path):
    df, names = frame(spark, 300), ["a", "b"]
    cuts = T.cut_points(df, names)
    rows = T.binned(df, names, cuts, [F.col("id"), F.col("label").alias("y"), F.col("fold")])
    model, = T.boost(rows, 2, [T.Boost(n_estimators=5, max_depth=3, base_score=0.4)])
    want = {r.id: r.proba[0] for r in T.boost_scores(rows.select("id", "b"), [model]).collect()}
    T.save_boost(spark, model, names, cuts, str(tmp_path / "model"))
    got = {r.id: r.proba for r in T.load_boost(spark, str(tmp_path / "model"))(df).collect()}
    assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-12 for i in got)


def test_adaboost_rounds_sum_in_the_tasks(spark, monkeypatch):
    import math

    import numpy as np

    from wavecohort.operators import models as M
    rng = np.random.default_rng(3)
    x = rng.integers(0, 6, (400, 2)).astype(float)
    y = ((x[:, 0] > 2) ^ (rng.random(400) < 0.2) | (x[:, 1] > 4)).astype(float)
    df = spark.createDataFrame([(float(a), None if b == 0 else float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, label double")

    def no_row_per_feature(*_):
        raise AssertionError("a row per feature and round")
    monkeypatch.setattr(M.F, "posexplode", no_row_per_feature)
    stumps = M.adaboost(df, ["a", "b"], rounds=12)
    assert len(stumps) == 12
    votes = np.zeros(400)
    for f, cut, low, high in stumps:
        w = np.exp(-(2 * y - 1) * votes)
        split = lambda g, c: sum(2 * w[m & (y > 0)].sum() * w[m & (y <= 0)].sum() / w[m].sum() for m in (x[:, g] <= c, x[:, g] > c) if m.any())
        assert split(f, cut) <= min(split(g, c) for g in (0, 1) for c in range(5)) * (1 + 1e-9)
        vote = np.where(x[:, f] <= cut, low, high)
        err = w[(vote > 0) != (y > 0)].sum() / w.sum()
        assert abs(high) == abs(low) and math.isclose(abs(high), 0.5 * math.log((1 - err) / err), rel_tol=1e-9)
        votes += vote


def test_waves_made_in_the_tasks_equal_written_ones(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(i, rng.gauss(0, 1), rng.gauss(0, 1), i % 3, i % 5 == 0) for i in range(900)], "id long, a double, b double, fold int, held boolean")
    df = df.withColumn("y", (F.col("a") * F.col("b") > 0).cast("double"))
    x, models = L.standardised(df, ["a", "b"]), lambda: [L.Linear("squared_hinge", 1.0, f, "fit") for f in (0, 1)]
    rows = df.select("y", "fold", "held", x.alias("x"))
    waves = L.waves_of(2, 0.5, 60)
    written = L.newton(df.select("y", "fold", "held", L.fourier(x, 2, 0.5, 60).alias("x")).persist(), models())
    made = L.newton(rows, models(), waves=waves)
    for a, b in zip(written, made):
        assert len(b.weights) == 61 and np.allclose(a.weights, b.weights, rtol=1e-6, atol=1e-8)
    seen = L.margins(rows, made, waves).withColumn("i", F.lit(1)).persist()
    assert seen.count() == 900 and sum(r.margin[0] > 0 for r in seen.filter("y = 1 and fold = 0").collect()) > 100
    wide = df.select("y", "fold", "held", L.fourier(x, 2, 0.5, 60).alias("x"))
    for a, b in zip(L.calibrated(wide, written), L.calibrated(seen, made, [F.get("margin", F.lit(i)) for i in range(2)])):
        assert np.allclose(a.weights, b.weights, rtol=1e-4)


def test_a_folds_rows_go_down_the_trees_that_left_them_out(spark, monkeypatch):
    rng = random.Random(5)
    df = spark.createDataFrame([(i, rng.gauss(0, 1), rng.gauss(0, 1), i % 5) for i in range(200)], "id long, a double, b double, fold int")
    df = df.withColumn("label", (F.col("a") + F.col("b") > 0).cast("double"))
    seen, plain = [], T.bag_scores

    def scored(rows, trees, *model):
        seen.append(({r.fold for r in rows.select("fold").distinct().collect()}, rows.count(), trees.select("tree").distinct().count()))
        return plain(rows, trees, *model)
    monkeypatch.setattr(T, "bag_scores", scored)
    got = M.cross_validate_all(df, ["a", "b"], "fold", 5, "id", forest_trees=3, boost={"n_estimators": 1}).collect()
    assert seen == [({f}, 40, n) for n in (1, 3) for f in range(5)]
    assert len(got) == 25 and all(r.accuracy is not None for r in got)


def test_adaboost_rows_are_packed_and_scored_per_interval(spark, monkeypatch):
    import numpy as np

    from wavecohort.operators import models as M
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 2))
    y = ((x[:, 0] > 0.2) ^ (rng.random(500) < 0.2)).astype(float)
    data = [(i, None if i % 50 == 0 else float("nan") if i % 61 == 0 else float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y))]
    df = spark.createDataFrame(data, "id int, a double, b double, label double").repartition(3)
    monkeypatch.setattr(M, "STUMP_ROWS", 64)
    plans = []
    from wavecohort.sources import tables
    kept = tables.checkpoint_to_shared
    monkeypatch.setattr(tables, "checkpoint_to_shared", lambda d, name: plans.append(kept(d, name)) or plans[-1])
    stumps = M.adaboost(df, ["a", "b"], rounds=30)
    packs = plans[-1].collect()                              # the votes of the last write
    assert len(plans) == 1 + len(stumps) // M.CHECKPOINT_ROUNDS > 2 and len(packs) < 20 and sum(len(p.y) for p in packs) == 500
    votes = [sum(lo if (0.0 if v is None else v) <= t else hi for f, t, lo, hi in stumps for v in [(a, b)[f]]) for _, a, b, _ in data]
    total = sum(abs(hi) for *_, hi in stumps)
    got = {r.id: r.proba for r in M.adaboost_score(stumps, df, ["a", "b"]).collect()}
    assert np.allclose([got[i] for i in range(500)], (np.array(votes) / total + 1) / 2)
    # the rows' votes in training are those that score them, NaN too
    upto = stumps[:len(stumps) // M.CHECKPOINT_ROUNDS * M.CHECKPOINT_ROUNDS]
    want = sorted(sum(lo if (0.0 if v is None else v) <= t else hi for f, t, lo, hi in upto for v in [(a, b)[f]]) for _, a, b, _ in data)
    assert np.allclose(np.sort(np.concatenate([np.frombuffer(bytes(p.s)) for p in packs])), want)
