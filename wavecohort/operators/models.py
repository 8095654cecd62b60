"""Classifiers, validation and search with ``pyspark.ml``.

Fitting is distributed by Spark ML; the driver only holds models, parameter
maps and a handful of metrics.  Evaluation reuses the exact metrics of
:mod:`wavecohort.operators.evaluate` on the scored DataFrames.
"""

from __future__ import annotations

import math
import random
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavecohort.operators.evaluate import validation_summary


#: The deepest trees Spark ML allows; leaves are bounded by their number of rows.
MAX_DEPTH = 30


def classifier(kind: str, n_train: int | None = None, seed: int = 42, **kw):
    """Estimators named as in the source.

    ``logreg``: L2 with C=0.9 → ``regParam = 1/(C·N)``, no standardisation;
    ``tree`` / ``forest``: leaves of at least 50 rows, 200 trees, no other depth bound;
    ``gbt``: 200 rounds of depth 3, leaves of at least 40 rows, early stop on a validation column;
    bagging (M12) and second-order boosting are in :mod:`wavecohort.operators.ensembles`, kernel machines (M10)
    in :mod:`wavecohort.operators.linear`.
    """
    if kind == "logreg":
        c = kw.pop("C", 0.9)
        return LogisticRegression(regParam=1.0 / (c * max(n_train or 1, 1)), elasticNetParam=0.0,
                                  standardization=False, maxIter=kw.pop("maxIter", 100), **kw)
    depth = kw.pop("maxDepth", 3 if kind == "gbt" else MAX_DEPTH)
    if kind == "tree":
        return DecisionTreeClassifier(minInstancesPerNode=kw.pop("minInstancesPerNode", 50), maxDepth=depth, seed=seed, **kw)
    if kind == "forest":
        return RandomForestClassifier(numTrees=kw.pop("numTrees", 200), minInstancesPerNode=kw.pop("minInstancesPerNode", 50),
                                      maxDepth=depth, seed=seed, **kw)
    if kind == "gbt":
        return GBTClassifier(maxIter=kw.pop("maxIter", 200), minInstancesPerNode=kw.pop("minInstancesPerNode", 40),
                             maxDepth=depth, seed=seed, **kw)
    raise ValueError(kind)


def assemble(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")


def fit(est, df: DataFrame, features: list[str], label: str = "label"):
    est = est.copy().setLabelCol(label).setFeaturesCol("features")
    return Pipeline(stages=[assemble(features), est]).fit(df)


def positive_proba(scored: DataFrame) -> DataFrame:
    """Probability of the positive class as a plain DOUBLE column ``proba``."""
    if "probability" in scored.columns:
        return scored.withColumn("proba", vector_to_array("probability")[1])
    return scored.withColumn("proba", vector_to_array("rawPrediction")[1])


def validate(est, train: DataFrame, valid: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """M3: fit on ``train``, score ``valid``: accuracy, recall, precision, AUC (one row)."""
    model = fit(est, train, features, label)
    return evaluate_model(model, valid, label)


def evaluate_model(model, valid: DataFrame, label: str = "label") -> DataFrame:
    s = positive_proba(model.transform(valid)).select(label, "prediction", "proba")
    return validation_summary(s, label, F.col("prediction") > 0.5, "proba")


def fold_rows(df: DataFrame, features: list[str], fold_col: str, id_col: str, label: str, k: int, x: Column | None = None) -> DataFrame:
    """Rows of the fits of all folds: ``id, y, fold, held`` (a fifth, for calibration), ``x`` and the binned ``b`` (written)."""
    from wavecohort.operators import ensembles, linear
    from wavecohort.sources.tables import checkpoint_to_shared
    keep = [F.xxhash64(id_col).alias("id"), F.col(label).cast("double").alias("y"), F.col(fold_col).cast("int").alias("fold"),
            (F.pmod(F.xxhash64(F.col(id_col), F.lit("held")), F.lit(5)) == 0).alias("held"), (linear.vector(features) if x is None else x).alias("x")]
    return checkpoint_to_shared(ensembles.binned(df, features, ensembles.cut_points(df, features), keep), "fold-rows")


def _accuracies(scored: DataFrame, fold: str = "fold") -> dict:
    """Accuracy per fold of rows ``y, proba`` and the fold they were left out of."""
    right = (F.col("proba") > 0.5) == (F.col("y") > 0.5)
    return {r.f: r.a for r in scored.groupBy(F.col(fold).alias("f")).agg(F.avg(right.cast("double")).alias("a")).collect()}


def fold_logistic(rows: DataFrame, k: int, c: float = 0.9):
    """M2: logistic regressions that leave out one fold each, fitted together (one aggregate a Newton step)."""
    from wavecohort.operators import linear
    return linear.newton(rows, [linear.Linear("logistic", c, f) for f in range(k)])


def cross_validate(df: DataFrame, features: list[str], fold_col: str, k: int, id_col: str, label: str = "label", c: float = 0.9) -> DataFrame:
    """M2: stratified k-fold accuracy of the logistic regression, one row per fold (fold column from
    :func:`stratified_split`)."""
    from wavecohort.operators import linear
    rows = fold_rows(df, features, fold_col, id_col, label, k)
    models = fold_logistic(rows, k, c)
    got = _accuracies(rows.withColumn("proba", linear.logistic(linear.by_fold(models, lambda m: linear.linear_margin(F.col("x"), m.weights)))))
    return df.sparkSession.createDataFrame([(f, got.get(f)) for f in range(k)], "fold int, accuracy double")


def cross_validate_all(df: DataFrame, features: list[str], fold_col: str, k: int, id_col: str, label: str = "label", forest_trees: int = 200,
                       boost: dict | None = None) -> DataFrame:
    """M2 for every classifier, the folds of each fitted together: ``classifier, fold, accuracy``."""
    from wavecohort.operators import ensembles as T
    from wavecohort.operators import linear
    from wavecohort.sources.tables import checkpoint_to_shared
    d, out = len(features), []
    rows = fold_rows(df, features, fold_col, id_col, label, k)

    def add(name, got):
        out.extend((name, f, got.get(f)) for f in range(k))
    models = fold_logistic(rows, k)
    add("logreg", _accuracies(rows.withColumn("proba", linear.logistic(linear.by_fold(models, lambda m: linear.linear_margin(F.col("x"), m.weights))))))
    waves = linear.waves_of(d, 1.0 / d)
    scaled = fold_rows(df, features, fold_col, id_col, label, k, linear.standardised(df, features))
    machines = linear.newton(scaled, [linear.Linear("squared_hinge", 1.0, f, "fit") for f in range(k)], waves=waves)
    seen = checkpoint_to_shared(linear.margins(scaled, machines, waves), "svm-margins")
    margin = [F.get("margin", F.lit(i)) for i in range(k)]
    proba = F.lit(None)
    for m, s, x in zip(machines, linear.calibrated(seen, machines, margin), margin):
        proba = F.when(F.col("fold") == m.fold, linear.logistic(s.weights[0] * x + s.weights[1])).otherwise(proba)
    add("svm", _accuracies(seen.withColumn("proba", proba)))
    binned, labels = rows.select("id", "y", "fold", "b"), rows.select("id", "y", "fold")
    for name, trees, options in (("tree", 1, {"bootstrap": False}), ("forest", forest_trees, {"mtry": max(1, int(d ** 0.5))})):
        grown = T.bag(binned, d, trees * k, min_leaf=50, of=F.col("fold") != F.col("tree") % k, **options)
        # a fold's rows go down the trees that left them out, and no others
        scored = [T.bag_scores(binned.filter(F.col("fold") == f), grown.filter(F.col("tree") % k == f).withColumn("tree", F.floor(F.col("tree") / k).cast("int")), F.lit(f))
                  for f in range(k)]
        add(name, _accuracies(reduce(DataFrame.unionByName, scored).join(labels, "id")))
    boosted = T.boost(binned, d, [T.Boost(fold=f, **(boost or {})) for f in range(k)])
    scored = T.boost_scores(rows.select("y", "fold", "b"), boosted)
    add("boost", _accuracies(scored.select("y", "fold", F.get("proba", F.col("fold")).alias("proba"))))
    return df.sparkSession.createDataFrame(out, "classifier string, fold int, accuracy double")


#: A vote costs a row about a nanosecond a round, a write of the votes a hundred.
CHECKPOINT_ROUNDS, STUMP_BINS, STUMP_ROWS = 12, 32, 1 << 15


def _margin(stumps: list, x: list) -> Column:
    """Sum of the votes of depth-1 trees (feature position, threshold, vote at or below it, vote above) for a row with the
    feature columns ``x``: per feature a sum for each interval between its thresholds."""
    from wavecohort.functions.ranges import range_bucket
    total = F.lit(0.0)
    for f, column in enumerate(x):
        cuts = sorted({t for g, t, _, _ in stumps if g == f})
        if not cuts:
            continue
        sums = [float(sum(lo if cut <= t else hi for g, t, lo, hi in stumps if g == f)) for cut in (*cuts, math.inf)]
        # thresholds below the value: a value at a threshold is not above it, NaN is above all
        above = F.when(F.isnan(column), F.lit(len(cuts))).otherwise(F.lit(len(cuts)) - range_bucket(-column, [-c for c in reversed(cuts)]))
        total = total + F.get(F.array(*map(F.lit, sums)), above)
    return total


def _best_stump(hist: list, bounds: list):
    """Split of least weighted Gini impurity from ``(feature, bin, positive weight, negative
    weight)`` rows, and its weighted error: ``(feature, threshold, low class, high class, error)``."""
    best = None
    for f, cuts in enumerate(bounds):
        pos, neg = [0.0] * (len(cuts) + 1), [0.0] * (len(cuts) + 1)
        for h in hist:
            if h["f"] == f:
                pos[h["bin"]] += h["pos"]
                neg[h["bin"]] += h["neg"]
        tp, tn, lp, ln = sum(pos), sum(neg), 0.0, 0.0
        for i, cut in enumerate(cuts):
            lp, ln = lp + pos[i], ln + neg[i]
            hp, hn = tp - lp, tn - ln
            impurity = sum(2 * p * n / (p + n) for p, n in ((lp, ln), (hp, hn)) if p + n > 0)
            low, high = lp > ln, hp > hn
            err = ((ln if low else lp) + (hn if high else hp)) / (tp + tn)
            if best is None or impurity < best[0]:
                best = (impurity, f, cut, low, high, err)
    return best and best[1:]


_VOTES = "y binary, b binary, s binary"


def _pack_votes(bounds: list):
    """Worker function: (label, features) rows -> one row per ``STUMP_ROWS`` with labels, bins (the cuts below a value, feature by
    feature) and votes so far (none)."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        def packed(parts):
            y, *x = (np.concatenate(c) for c in zip(*parts))
            # NaN is above all cuts
            b = np.array([np.searchsorted(np.array(c, float), v, side="left") for c, v in zip(bounds, x)], np.uint8)
            return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in (y > 0, b, np.zeros(len(y)))], names=["y", "b", "s"])
        parts, held = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            parts.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            held += batch.num_rows
            if held >= STUMP_ROWS:
                yield packed(parts)
                parts, held = [], 0
        if parts:
            yield packed(parts)
    return run


def _voted(batches, stumps: list):
    """The packs of a task, with the votes of new stumps ``(feature, cut's position, vote up to it, vote above)``."""
    import numpy as np
    for batch in batches:
        for i in range(batch.num_rows):
            y, b, s = (np.frombuffer(c[i].as_buffer(), t) for c, t in zip(batch.columns, (np.bool_, np.uint8, np.float64)))
            b, s = b.reshape(-1, len(y)), s.copy()
            for f, cut, low, high in stumps:
                s += np.where(b[f] <= cut, low, high)
            yield y, b, s


def _add_votes(stumps: list):
    def run(batches):
        import pyarrow as pa
        for pack in _voted(batches, stumps):
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in pack], names=["y", "b", "s"])
    return run


def _stump_cells(stumps: list, sizes: list):
    """Worker function: packs -> weight per feature, bin and class, summed once per task."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        wide = max(sizes, default=1)
        sums = np.zeros((len(sizes), 2 * wide))
        for y, b, s in _voted(batches, stumps):
            # the weight of a row is exp(-(2y - 1) * votes); a constant factor doesn't matter
            w, at = np.exp(np.where(y, -s, s)), np.where(y, 0, wide).astype(np.int16)
            for f in range(len(sizes)):
                sums[f] += np.bincount(at + b[f], w, 2 * wide)
        pos, neg = sums[:, :wide], sums[:, wide:]
        f, bin_ = np.nonzero(pos + neg)
        yield pa.RecordBatch.from_arrays([pa.array(f.astype(np.int32)), pa.array(bin_.astype(np.int32)), pa.array(pos[f, bin_]), pa.array(neg[f, bin_])], names=["f", "bin", "pos", "neg"])
    return run


def adaboost(df: DataFrame, features: list[str], label: str = "label", rounds: int = 200):
    """Discrete AdaBoost (SAMME, two classes) over weighted depth-1 trees.

    Features are cut at ``STUMP_BINS`` quantiles (as Spark's own trees do).  A round
    is one aggregate: weight per feature, bin and class, from which the driver (features
    times bins rows) reads the best split, its error and alpha.  A row's weight follows
    from the votes so far, so no table of weights is written each round; rows are packed by column
    (bins, votes), and the sum of votes is written every ``CHECKPOINT_ROUNDS`` rounds.  Returns the stumps.
    """
    from wavecohort.functions.ranges import quantile_bounds
    from wavecohort.sources.tables import checkpoint_to_shared, forget
    x = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features]
    bounds = [quantile_bounds(df.select(c.alias("v")), "v", STUMP_BINS) for c in x]
    rows = df.select(F.col(label).cast("double").alias("y"), *[c.alias(f"x{i}") for i, c in enumerate(x)])
    d = checkpoint_to_shared(rows.mapInArrow(_pack_votes(bounds), _VOTES), "stump-rows")
    done, fresh = [], []
    for _ in range(rounds):
        hist = (d.mapInArrow(_stump_cells(list(fresh), [len(c) + 1 for c in bounds]), "f int, bin int, pos double, neg double")
                .groupBy("f", "bin").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).collect())
        best = _best_stump(hist, bounds)
        if best is None or best[4] >= 0.5:
            break
        f, cut, low, high, err = best
        alpha = 0.5 * math.log((1 - err) / max(err, 1e-12))
        done.append((f, cut, alpha if low else -alpha, alpha if high else -alpha))
        fresh.append((f, bounds[f].index(cut), *done[-1][2:]))
        if err == 0:
            break
        if len(fresh) == CHECKPOINT_ROUNDS:
            before, d = d, checkpoint_to_shared(d.mapInArrow(_add_votes(fresh), _VOTES), "stump-rows")
            forget(before, "stump-rows")
            fresh = []
    return done


def adaboost_score(stumps, df: DataFrame, features: list[str]) -> DataFrame:
    """Weighted vote of the AdaBoost rounds as a score in [-1, 1] (``proba`` in [0, 1])."""
    x = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features]
    total = sum(abs(hi) for _f, _t, _lo, hi in stumps) or 1.0
    scored = df.withColumn("proba", (_margin(stumps, x) / total + 1) / 2)
    return scored.withColumn("prediction", (F.col("proba") > 0.5).cast("double"))


def importances(model, features: list[str]) -> DataFrame:
    """Feature importances of a tree model, sorted descending."""
    est = model.stages[-1] if hasattr(model, "stages") else model
    imp = est.featureImportances.toArray().tolist()
    spark = __import__("pyspark.sql", fromlist=["SparkSession"]).SparkSession.getActiveSession()
    rows = sorted(zip(features, [float(x) for x in imp]), key=lambda t: (-t[1], t[0]))
    return spark.createDataFrame(rows, "feature string, importance double")


def sample_param_maps(space: dict, n: int, seed: int = 42) -> list[dict]:
    """``n`` parameter maps from uniform (``('uniform', lo, hi)``),
    quantised (``('quniform', lo, hi, q)``) and choice (``('choice', [...])``)
    spaces, seeded."""
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        p = {}
        for k, spec in space.items():
            kind = spec[0]
            if kind == "uniform":
                p[k] = rnd.uniform(spec[1], spec[2])
            elif kind == "quniform":
                v = round(rnd.uniform(spec[1], spec[2]) / spec[3]) * spec[3]
                p[k] = int(v) if float(spec[3]).is_integer() else v
            elif kind == "choice":
                p[k] = rnd.choice(spec[1])
            else:
                raise ValueError(kind)
        out.append(p)
    return out


def sample_feature_sets(candidates: list[str], n: int, max_k: int = 5, seed: int = 42) -> list[list[str]]:
    """``n`` random subsets (0..max_k) of the features to derive."""
    rnd = random.Random(seed)
    return [sorted(rnd.sample(candidates, rnd.randint(0, min(max_k, len(candidates))))) for _ in range(n)]


def _parzen(values: list, low: float, high: float):
    """Density of values in a range: a normal around each, as wide as the way to its next neighbour, and a flat part."""
    points = sorted(values)
    gaps = [b - a for a, b in zip(points, points[1:])]
    least = (high - low) / (10 + 2 * len(points))
    widths = [max(least, min(a, b)) for a, b in zip([*gaps[:1], *gaps], [*gaps, *gaps[-1:]])] if gaps else [(high - low) / 2] * len(points)

    def density(x):
        flat = 1 / (high - low) if high > low else 1.0
        return (flat + sum(math.exp(-((x - m) / s) ** 2 / 2) / (s * 2.5066282746310002) for m, s in zip(points, widths))) / (len(points) + 1)

    def draw(rnd):
        i = rnd.randrange(len(points) + 1)
        if i == len(points):
            return rnd.uniform(low, high)
        while True:
            x = rnd.gauss(points[i], widths[i])
            if low <= x <= high:
                return x
    return density, draw


def suggest(space: dict, seen: list[tuple[dict, float]], n: int, seed: int, startup: int = 10, good: float = 0.7, candidates: int = 24) -> list[dict]:
    """``n`` parameter maps given the earlier trials ``(parameters, score)``.

    The first ``startup`` are uniform draws.  Then each parameter is drawn from the density of its values in the
    best trials (``good`` times the root of their number), and of ``candidates`` draws the one is kept that is likeliest there
    against the density of the other trials (tree-structured Parzen estimators).
    """
    rnd = random.Random(f"{seed}-{len(seen)}")
    if len(seen) < startup:
        return sample_param_maps(space, n, rnd.randrange(2 ** 30))
    ranked = sorted(seen, key=lambda t: -t[1] if t[1] == t[1] else math.inf)
    cut = max(1, math.ceil(good * math.sqrt(len(ranked))))
    out = []
    for _ in range(n):
        p = {}
        for k, spec in space.items():
            best, rest = ([t[0][k] for t in part] for part in (ranked[:cut], ranked[cut:]))
            if spec[0] == "choice":
                weight = {c: (best.count(c) + 1) / (len(best) + len(spec[1])) for c in spec[1]}
                other = {c: (rest.count(c) + 1) / (len(rest) + len(spec[1])) for c in spec[1]}
                draws = rnd.choices(spec[1], [weight[c] for c in spec[1]], k=candidates)
                p[k] = max(draws, key=lambda c: weight[c] / other[c])
                continue
            low, high = float(spec[1]), float(spec[2])
            (likely, draw), (other, _) = _parzen(best, low, high), _parzen(rest, low, high)
            x = max((draw(rnd) for _ in range(candidates)), key=lambda v: math.log(likely(v)) - math.log(other(v)))
            if spec[0] == "quniform":
                x = round(x / spec[3]) * spec[3]
                x = int(x) if float(spec[3]).is_integer() else x
            p[k] = x
        out.append(p)
    return out


def adaptive_search(spark, space: dict, n: int, evaluate, path: str, batch: int = 12, seed: int = 42, startup: int = 10) -> DataFrame:
    """``n`` trials, ``batch`` at a time, each batch suggested by all earlier ones; ``evaluate(params, first)`` gets a
    list of parameter maps and their first trial number and returns their scores.

    Trials are written to ``path`` batch by batch, and a search that is started again on that path goes on after the last
    written batch.  Returns the trial table ``trial, params, auc`` (parameters as JSON).
    """
    import json
    schema = "trial int, params string, auc double"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    known = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    rows = spark.read.schema(schema).parquet(path).orderBy("trial").collect() if known else []
    seen = [(json.loads(r.params), r.auc if r.auc is not None else float("nan")) for r in rows]
    while len(seen) < n:
        params = suggest(space, seen, min(batch, n - len(seen)), seed, startup)
        scores = evaluate(params, len(seen))
        new = [(len(seen) + i, json.dumps(p, sort_keys=True), None if a is None else float(a)) for i, (p, a) in enumerate(zip(params, scores))]
        spark.createDataFrame(new, schema).coalesce(1).write.mode("append").parquet(path)
        seen += [(p, float("nan") if a is None else float(a)) for p, a in zip(params, scores)]
    return spark.read.schema(schema).parquet(path)
