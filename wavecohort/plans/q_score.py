"""Registered form-matrix, risk-score, split, evaluation and model queries
(survey §2.9-§2.10)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wavecohort.functions import keys as K
from wavecohort.operators import ensembles as T
from wavecohort.operators import evaluate as E
from wavecohort.operators import linear as L
from wavecohort.operators import models as M
from wavecohort.operators import score as P
from wavecohort.plans import bindings as B
from wavecohort.plans import stages as ST
from wavecohort.plans.bindings import with_ctes
from wavecohort.plans.registry import query
from wavecohort.session import shared_path
from wavecohort.sources import tables as S

# Fields kept in the form matrix (prefix 'f0' or listed) and the total-score field.
FORM_FIELDS = [f"f{i:02d}" for i in range(12)]
DATE_FIELDS_EXTRA = ["f10"]          # the dates query omits the score field, as the source does
SCORE_FIELD = "f11"
WEIGHT_MOD = 13
ENCODED = ["f01", "f02", "f03"]


def _forms(spark, d):
    """Form answers and form headers (dates from the order of the same key)."""
    rows = B.form_rows(spark, d)
    o = B.table(spark, d, "orders").select(F.col("o_orderkey").alias("id_form"), "o_orderdate", "o_orderstatus")
    ans = rows.filter(K.form_fields("champ_formulaire", ["f0"], ["f10", SCORE_FIELD])).select(
        "id_form", K.stay_key("id_form").alias("id_nda"), "champ_formulaire",
        F.col("lwert").alias("value_field"))
    heads = (rows.filter(K.form_fields("champ_formulaire", ["f0"], DATE_FIELDS_EXTRA)).select("id_form").distinct()
             .join(o, "id_form").select("id_form", K.stay_key("id_form").alias("id_nda"),
                                        (F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("dt_ins"),
                                        F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("j1")))
    return ans, heads


def form_matrix_df(spark, d):
    ans, heads = _forms(spark, d)
    return P.form_matrix(ans, P.form_dates(heads), FORM_FIELDS)


_FORMS_SQL = """answers AS (SELECT id_form, lpad(CAST(id_form AS VARCHAR), 10, '0') AS id_nda, champ_formulaire,
        lwert AS value_field FROM form_rows WHERE champ_formulaire LIKE 'f0%' OR champ_formulaire IN ('f10', 'f11')),
    heads AS (SELECT DISTINCT f.id_form, lpad(CAST(f.id_form AS VARCHAR), 10, '0') AS id_nda,
        o.o_orderdate + INTERVAL 1 DAY AS dt_ins, CASE WHEN o.o_orderstatus = 'F' THEN o.o_orderdate END AS j1
        FROM (SELECT DISTINCT id_form FROM form_rows WHERE champ_formulaire LIKE 'f0%' OR champ_formulaire = 'f10') f
        JOIN orders o ON f.id_form = o.o_orderkey),
    dates AS (SELECT DISTINCT id_form, id_nda, coalesce(j1, dt_ins) AS dt_ins FROM heads),
    keyed AS (SELECT a.id_nda || strftime(d.dt_ins, '%Y-%m-%d') || '_' || CAST(a.id_form AS VARCHAR) AS id_form_ndaj1,
        a.champ_formulaire, a.value_field FROM answers a JOIN dates d ON a.id_form = d.id_form),
    fm AS (SELECT id_form_ndaj1, regexp_extract(id_form_ndaj1, '(.*)_.*', 1) AS id_ndaj1, """ + ", ".join(
    f"max(CASE WHEN champ_formulaire = '{f}' THEN value_field END) AS {f}" for f in FORM_FIELDS) + """
        FROM keyed GROUP BY id_form_ndaj1)"""

_LOGIT = "(CAST(-7.7631 AS DOUBLE) + CAST(0.0737 AS DOUBLE) * ({s}) + CAST(0.9971 AS DOUBLE) * ln(({s}) + 1))"
_PROB = "(exp({l}) / (1 + exp({l})))"


def _logit_sql(s):
    return _LOGIT.format(s=s)


def _prob_sql(s):
    return _PROB.format(l=_logit_sql(s))


@query("form_matrix", with_ctes(f"WITH {_FORMS_SQL} SELECT * FROM fm", "form_rows"))
def q_form_matrix(spark, d):
    """Answers pivoted to one row per form (duplicates raise)."""
    return form_matrix_df(spark, d)


@query("score_dataset", with_ctes(f"""WITH {_FORMS_SQL}, pm AS (SELECT lpad(CAST(o.o_orderkey AS VARCHAR), 10, '0') AS id_nda,
    p.dt_deces FROM orders o JOIN patients p ON o.o_custkey = p.ids_pat)
    SELECT fm.*, pm.dt_deces, {_logit_sql("TRY_CAST(fm.f11 AS DOUBLE)")} AS logit, {_prob_sql("TRY_CAST(fm.f11 AS DOUBLE)")} AS pr
    FROM fm JOIN pm ON substr(fm.id_ndaj1, 1, 10) = pm.id_nda""", "form_rows", "patients"))
def q_score_dataset(spark, d):
    """Form matrix, patient's death date, SAPS2 logit and probability."""
    o = B.table(spark, d, "orders").select(K.stay_key("o_orderkey").alias("id_nda"),
                                           F.col("o_custkey").alias("ids_pat"))
    return P.score_dataset(form_matrix_df(spark, d), o, B.patients(spark, d), SCORE_FIELD)


@query("enrich_death", with_ctes(f"""WITH {_FORMS_SQL}, pm AS (SELECT lpad(CAST(o.o_orderkey AS VARCHAR), 10, '0') AS id_nda,
    o.o_custkey AS ids_pat, p.dt_deces FROM orders o JOIN patients p ON o.o_custkey = p.ids_pat)
    SELECT fm.id_form_ndaj1, fm.id_ndaj1, pm.ids_pat, pm.dt_deces FROM fm JOIN pm ON substr(fm.id_ndaj1, 1, 10) = pm.id_nda""",
                                 "form_rows", "patients"))
def q_enrich_death(spark, d):
    """Death date of each form's patient joined onto the form matrix."""
    from wavecohort.operators import joins as J
    m = form_matrix_df(spark, d).select("id_form_ndaj1", "id_ndaj1")
    m = m.withColumn("id_case", F.expr("substring(id_ndaj1, 1, char_length(id_ndaj1) - 10)"))
    pmap = B.table(spark, d, "orders").select(K.stay_key("o_orderkey").alias("id_case"),
                                              F.col("o_custkey").alias("ids_pat"))
    return J.enrich_death(m, pmap, B.patients(spark, d)).drop("id_case")


@query("saps2_prob", with_ctes(f"SELECT doc_id, score, {_logit_sql('score')} AS logit, {_prob_sql('score')} AS pr FROM scores",
                               "scores"), rounded=('logit', 'pr'))
def q_saps2_prob(spark, d):
    """SAPS2 logit and probability of a total score."""
    s = B.scores(spark, d)
    return s.select("doc_id", "score", P.saps2_logit("score").alias("logit"), P.saps2_prob("score").alias("pr"))


@query("saps2_alarm", with_ctes(f"SELECT doc_id, {_prob_sql('score')} > {_prob_sql('CAST(15 AS DOUBLE)')} AS alarm FROM scores",
                                "scores"))
def q_saps2_alarm(spark, d):
    """Alarm when the probability is strictly above that of score 15."""
    s = B.scores(spark, d)
    return s.select("doc_id", (P.saps2_prob("score") > P.saps2_prob(F.lit(15.0))).alias("alarm"))


def _answers_weighted(spark, d):
    r = B.form_rows(spark, d)
    return r.select("id_form", "champ_formulaire", F.pmod(F.col("lwert").cast("int"), F.lit(WEIGHT_MOD)).alias("weight"))


_CATS_SQL = f"""aw AS (SELECT id_form, champ_formulaire, CAST(lwert AS INTEGER) % {WEIGHT_MOD} AS weight FROM form_rows),
    cats AS (SELECT PARENT, 'w' || saps2weight AS LID, saps2weight,
             CAST(row_number() OVER (PARTITION BY PARENT ORDER BY CAST(saps2weight AS INTEGER)) AS INTEGER) AS "index"
             FROM (SELECT DISTINCT champ_formulaire AS PARENT, CAST(weight AS VARCHAR) AS saps2weight FROM aw))"""


@query("categories", with_ctes(f"WITH {_CATS_SQL} SELECT * FROM cats ORDER BY PARENT, \"index\"", "form_rows"))
def q_categories(spark, d):
    """Reference categories ordered by variable and index."""
    a = _answers_weighted(spark, d)
    return P.categories(a, F.col("weight"))


@query("label_encode", with_ctes(f"""WITH {_CATS_SQL}, codes AS (SELECT PARENT, saps2weight,
    CAST(dense_rank() OVER (PARTITION BY PARENT ORDER BY saps2weight) - 1 AS INTEGER) AS code FROM cats)
    SELECT aw.id_form, aw.champ_formulaire, aw.weight, c.code FROM aw JOIN codes c
    ON aw.champ_formulaire = c.PARENT AND CAST(aw.weight AS VARCHAR) = c.saps2weight""", "form_rows"))
def q_label_encode(spark, d):
    """P5: answer weights encoded in the string order of the reference weights."""
    a = _answers_weighted(spark, d)
    return P.label_encode(a, P.categories(a, F.col("weight")), "champ_formulaire", "weight")


@query("add_features", with_ctes(f"""WITH {_FORMS_SQL}, x AS (SELECT id_form_ndaj1, TRY_CAST(f01 AS DOUBLE) AS f01,
    TRY_CAST(f02 AS DOUBLE) AS f02 FROM fm)
    SELECT id_form_ndaj1, f01, f02, count(*) OVER (PARTITION BY f01) AS C_f01, sqrt(f01) AS SQ_f01, ln(f01 + 1) AS LN_f01,
    count(*) OVER (PARTITION BY f02) AS C_f02, sqrt(f02) AS SQ_f02, ln(f02 + 1) AS LN_f02 FROM x""", "form_rows"), rounded=('SQ_f01', 'LN_f01', 'SQ_f02', 'LN_f02'))
def q_add_features(spark, d):
    """C_, SQ_ and LN_ features of two answer columns."""
    m = form_matrix_df(spark, d).select("id_form_ndaj1", F.col("f01").try_cast("double").alias("f01"),
                                        F.col("f02").try_cast("double").alias("f02"))
    return P.add_features(m, ["f01", "f02"])


# ----------------------------------------------------------------- split and metrics (scores binding)

@query("stratified_split", with_ctes("""SELECT doc_id, score, y, CAST((row_number() OVER (PARTITION BY y
    ORDER BY md5(CAST(doc_id AS VARCHAR) || '42')) - 1) % 3 AS INTEGER) AS fold FROM scores""", "scores"))
def q_stratified_split(spark, d):
    """Stratified 3 folds (md5 order, seed 42); fold 0 validates."""
    return E.stratified_split(B.scores(spark, d), "y", "doc_id", 3, 42)


@query("binary_metrics", with_ctes("""SELECT tp, fp, tn, fn, (tp + tn) * 1.0 / (tp + fp + tn + fn) AS accuracy,
    CASE WHEN tp + fn > 0 THEN tp * 1.0 / (tp + fn) END AS recall, CASE WHEN tp + fp > 0 THEN tp * 1.0 / (tp + fp) END AS precision
    FROM (SELECT count(CASE WHEN y = 1 AND score > 15 THEN 1 END) AS tp, count(CASE WHEN y = 0 AND score > 15 THEN 1 END) AS fp,
                 count(CASE WHEN y = 0 AND NOT score > 15 THEN 1 END) AS tn, count(CASE WHEN y = 1 AND NOT score > 15 THEN 1 END) AS fn
          FROM scores)""", "scores"))
def q_binary_metrics(spark, d):
    """M4: confusion counts, accuracy, recall and precision of the score-15 alarm."""
    s = B.scores(spark, d)
    return E.binary_metrics(s, "y", P.saps2_prob("score") > P.saps2_prob(F.lit(15.0)))


@query("roc_auc", with_ctes("""SELECT sum(pos * (neg_below + neg / 2.0)) / (sum(pos) * 1.0 * sum(neg)) AS auc,
    CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg FROM (
    SELECT score, pos, neg, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below
    FROM (SELECT score, count(CASE WHEN y = 1 THEN 1 END) AS pos, count(CASE WHEN y = 0 THEN 1 END) AS neg FROM scores GROUP BY score))""",
                            "scores"))
def q_roc_auc(spark, d):
    """M5: exact ROC AUC of the score against the quality label (ties halved)."""
    return E.roc_auc(B.scores(spark, d), "y", "score")


@query("roc_auc_continuous", """WITH s AS (SELECT l_extendedprice AS score, count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS pos,
    count(CASE WHEN l_returnflag <> 'R' THEN 1 END) AS neg FROM lineitem GROUP BY 1),
    r AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below FROM s)
    SELECT sum(pos * (neg_below + neg / 2.0)) / (sum(pos) * 1.0 * sum(neg)) AS auc,
    CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg FROM r""")
def q_roc_auc_continuous(spark, d):
    """M5 on a continuous score: price of a line against its return flag."""
    li = B.table(spark, d, "lineitem").select((F.col("l_returnflag") == "R").alias("y"), "l_extendedprice")
    return E.roc_auc(li, "y", "l_extendedprice")


@query("roc_points_continuous", """WITH s AS (SELECT value AS score, count(CASE WHEN event_type = 'error' THEN 1 END) AS pos,
    count(CASE WHEN event_type <> 'error' THEN 1 END) AS neg FROM events GROUP BY 1)
    SELECT score AS threshold, sum(neg) OVER (ORDER BY score DESC) * 1.0 / sum(neg) OVER () AS fpr,
    sum(pos) OVER (ORDER BY score DESC) * 1.0 / sum(pos) OVER () AS tpr FROM s""")
def q_roc_points_continuous(spark, d):
    """M6 on a continuous score: value of an event against its being an error."""
    ev = B.table(spark, d, "events").select((F.col("event_type") == "error").alias("y"), "value")
    return E.roc_curve(ev, "y", "value")


@query("stratified_split_orders", """SELECT o_orderkey, o_orderstatus, CAST((row_number() OVER (PARTITION BY o_orderstatus
    ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '42')) - 1) % 3 AS INTEGER) AS fold FROM orders""")
def q_stratified_split_orders(spark, d):
    """M1/T10 on all orders: folds stratified by order status."""
    return E.stratified_split(B.table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey", 3, 42)


@query("roc_points", with_ctes("""SELECT score AS threshold,
    sum(neg) OVER (ORDER BY score DESC) * 1.0 / sum(neg) OVER () AS fpr,
    sum(pos) OVER (ORDER BY score DESC) * 1.0 / sum(pos) OVER () AS tpr FROM (
    SELECT score, count(CASE WHEN y = 1 THEN 1 END) AS pos, count(CASE WHEN y = 0 THEN 1 END) AS neg FROM scores GROUP BY score)""",
                               "scores"))
def q_roc_points(spark, d):
    """M6: ROC points for every distinct score threshold."""
    return E.roc_curve(B.scores(spark, d), "y", "score")


@query("roc_alarm", with_ctes(f"""WITH p AS (SELECT y, {_prob_sql('score')} AS pr FROM scores),
    c AS (SELECT pr AS score, count(CASE WHEN y = 1 THEN 1 END) AS pos, count(CASE WHEN y = 0 THEN 1 END) AS neg FROM p GROUP BY pr),
    r AS (SELECT score AS threshold, sum(neg) OVER (ORDER BY score DESC) * 1.0 / sum(neg) OVER () AS fpr,
          sum(pos) OVER (ORDER BY score DESC) * 1.0 / sum(pos) OVER () AS tpr FROM c)
    SELECT * FROM r WHERE threshold >= {_prob_sql('CAST(15 AS DOUBLE)')} ORDER BY threshold LIMIT 1""", "scores"),
       rounded=("threshold",))
def q_roc_alarm(spark, d):
    """M6: ROC point of the SAPS2 alarm (probability of score 15) on the probability ROC."""
    s = B.scores(spark, d).select("y", P.saps2_prob("score").alias("pr"))
    return E.alarm_point(E.roc_curve(s, "y", "pr"), P.saps2_prob(F.lit(15.0)))


# ----------------------------------------------------------------- classifiers (lineitem by order)

FEATURES = ["qty", "price", "disc", "tax", "n_lines"]
#: The source's boosting parameters.
SOURCE_BOOST = {"max_depth": 3, "n_estimators": 95, "min_child_weight": 3.7, "base_score": 0.5, "colsample_bytree": 0.8}


def clf_frame(spark, d):
    """Per order: mean quantity, unit price, discount, tax, line count; label =
    any line returned ('R'); stratified fold column (fold 0 = validation).

    Written once as a stage: model fitting passes over it many times, and
    each pass then reads the table instead of recomputing its lineage."""
    return ST.stage(spark, d, "clf_frame", lambda: _clf_frame(spark, d))


def _clf_frame(spark, d):
    li = B.table(spark, d, "lineitem")
    f = li.groupBy("l_orderkey").agg(
        F.avg("l_quantity").alias("qty"), F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.avg("l_discount").alias("disc"), F.avg("l_tax").alias("tax"), F.count(F.lit(1)).cast("double").alias("n_lines"),
        F.max((F.col("l_returnflag") == "R").cast("double")).alias("label"))
    return E.stratified_split(f, "label", "l_orderkey", 3, 42)


def _split(spark, d):
    f = clf_frame(spark, d)
    return f.filter(F.col("fold") != 0), f.filter(F.col("fold") == 0)


def _validate(spark, d, kind, **kw):
    tr, va = _split(spark, d)
    n = tr.count() if kind == "logreg" else None
    return M.validate(M.classifier(kind, n_train=n, **kw), tr, va, FEATURES)


@query("validate_logreg")
def q_validate_logreg(spark, d):
    """M3/M7 (rows only): logistic regression, validation metrics."""
    return _validate(spark, d, "logreg")


@query("validate_tree")
def q_validate_tree(spark, d):
    """M8 (rows only): decision tree with leaves of at least 50 rows."""
    return _validate(spark, d, "tree")


def _forest(spark, d):
    """M8: the rows of all folds, and 200 trees over the training folds (leaves of at least 50 rows, root of the features at a node)."""
    rows = M.fold_rows(clf_frame(spark, d), FEATURES, "fold", "l_orderkey", "label", 3)
    return rows, T.bag(rows.filter("fold <> 0").select("id", "y", "b"), len(FEATURES), 200, min_leaf=50, mtry=2)


@query("validate_forest")
def q_validate_forest(spark, d):
    """M8 (rows only): random forest, 200 trees, leaves of at least 50 rows."""
    rows, trees = _forest(spark, d)
    valid = rows.filter("fold = 0")
    s = T.bag_scores(valid, trees).join(valid.select("id", "y"), "id")
    return E.validation_summary(s, "y", F.col("proba") > 0.5, "proba")


@query("validate_gbt")
def q_validate_gbt(spark, d):
    """M9 (rows only): gradient-boosted trees with early stopping on a held-out part of the training set."""
    tr, va = _split(spark, d)
    tr = tr.withColumn("is_val", F.pmod(F.xxhash64("l_orderkey"), F.lit(5)) == 0)
    est = M.classifier("gbt", validationIndicatorCol="is_val", maxIter=200, stepSize=0.1)
    return M.validate(est, tr, va, FEATURES)


@query("validate_boost")
def q_validate_boost(spark, d):
    """M9 (rows only): second-order boosting with the source's parameters."""
    f = clf_frame(spark, d)
    rows = M.fold_rows(f, FEATURES, "fold", "l_orderkey", "label", 3)
    model, = T.boost(rows.select("id", "y", "fold", "b"), len(FEATURES), [T.Boost(fold=0, **SOURCE_BOOST)])
    s = T.boost_scores(rows.filter("fold = 0").select("y", "b"), [model]).withColumn("proba", F.col("proba")[0])
    return E.validation_summary(s, "y", F.col("proba") > 0.5, "proba")


@query("validate_svm")
def q_validate_svm(spark, d):
    """M10 (rows only): kernel SVM (random Fourier features) with probabilities calibrated on held-out margins."""
    f = clf_frame(spark, d)
    waves = L.waves_of(len(FEATURES), 1.0 / len(FEATURES))
    rows = M.fold_rows(f, FEATURES, "fold", "l_orderkey", "label", 3, L.standardised(f, FEATURES, f.filter("fold <> 0")))
    machines = L.newton(rows, [L.Linear("squared_hinge", 1.0, 0, "fit")], waves=waves)
    # written: the calibration and the metrics pass over the margins several times
    seen, margin = S.checkpoint_to_shared(L.margins(rows, machines, waves), "svm-margins"), F.get("margin", F.lit(0))
    scale, = L.calibrated(seen, machines, [margin])
    s = seen.filter("fold = 0").select("y", L.logistic(scale.weights[0] * margin + scale.weights[1]).alias("proba"))
    return E.validation_summary(s, "y", F.col("proba") > 0.5, "proba")


@query("validate_adaboost")
def q_validate_adaboost(spark, d):
    """M11 (rows only): AdaBoost of depth-1 trees, 200 rounds."""
    tr, va = _split(spark, d)
    models = M.adaboost(tr, FEATURES, "label", rounds=200)
    s = M.adaboost_score(models, va, FEATURES)
    return E.validation_summary(s, "label", F.col("prediction") > 0.5, "proba")


@query("validate_bagging")
def q_validate_bagging(spark, d):
    """M12 (rows only): 1000 fully grown trees on Poisson-weighted rows, all features at every split."""
    rows = M.fold_rows(clf_frame(spark, d), FEATURES, "fold", "l_orderkey", "label", 3)
    trees = T.bag(rows.filter("fold <> 0").select("id", "y", "b"), len(FEATURES), 1000)
    valid = rows.filter("fold = 0")
    s = T.bag_scores(valid, trees).join(valid.select("id", "y"), "id")
    return E.validation_summary(s, "y", F.col("proba") > 0.5, "proba")


def _cv_frame(spark, d):
    f0 = clf_frame(spark, d).drop("fold")
    return ST.stage(spark, d, "clf_frame_cv", lambda: E.stratified_split(f0, "label", "l_orderkey", 5, 42, out="cv"))


@query("cv_accuracy")
def q_cv_accuracy(spark, d):
    """M2 (rows only): stratified 5-fold cross-validated accuracy of the logistic regression, all folds at once."""
    return M.cross_validate(_cv_frame(spark, d), FEATURES, "cv", 5, "l_orderkey")


@query("cv_classifiers")
def q_cv_classifiers(spark, d):
    """M2 (rows only): stratified 5-fold cross-validated accuracy of every classifier of the source's list."""
    return M.cross_validate_all(_cv_frame(spark, d), FEATURES, "cv", 5, "l_orderkey", boost=SOURCE_BOOST)


@query("importances")
def q_importances(spark, d):
    """M13 (rows only): forest feature importances, largest first."""
    _rows, trees = _forest(spark, d)
    name = F.get(F.array(*[F.lit(f) for f in FEATURES]), F.col("feature"))
    return T.bag_importances(trees, len(FEATURES)).select(name.alias("feature"), "importance").orderBy(F.desc("importance"), "feature")


#: The rounds are those of the source's live space.
RANDOM_SPACE = {"maxIter": ("quniform", 40, 45, 1), "max_depth": ("quniform", 2, 6, 1), "learning_rate": ("uniform", 0.05, 0.3),
                "subsample": ("uniform", 0.5, 1.0), "min_child_weight": ("uniform", 1, 10)}
SEARCH_TRIALS, SEARCH_BATCH = 24, 12


@query("random_search")
def q_random_search(spark, d):
    """M14/M15 (rows only): boosting parameters suggested by earlier trials, scored by validation AUC; a batch is fitted at once."""
    rows = M.fold_rows(clf_frame(spark, d), FEATURES, "fold", "l_orderkey", "label", 3).select("id", "y", "fold", "b")

    def evaluate(params, first):
        models = T.boost(rows, len(FEATURES), [T.Boost(n_estimators=p["maxIter"], fold=0, patience=30, seed=first + i, **{k: v for k, v in p.items() if k != "maxIter"})
                                                 for i, p in enumerate(params)])
        return [max(m.aucs) if m.aucs else None for m in models]
    return M.adaptive_search(spark, RANDOM_SPACE, SEARCH_TRIALS, evaluate, shared_path(spark, f"trials-{uuid.uuid4().hex}"), SEARCH_BATCH)


@query("score_saved")
def q_score_saved(spark, d):
    """M16 (rows only): save the fitted model, load it back, score the validation fold."""
    tr, va = _split(spark, d)
    model = M.fit(M.classifier("logreg", n_train=tr.count()), tr, FEATURES)
    path = shared_path(spark, f"model_logreg_{uuid.uuid4().hex}")
    S.save_model(model, path)
    return M.evaluate_model(S.load_model(path), va)
