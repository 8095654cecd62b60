"""Splits and evaluation (M1, M4-M6), without single-partition windows.

Ranks and running sums over a global order are computed in parallel: every row
has an order-preserving bucket that is a function of its own value; sums run inside
each bucket, and offsets (one row per bucket and group) are added.  No task ever
has to hold a whole class or all scores, and every evaluation of the plan puts a
row in the same bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavecohort.functions.ranges import hex_bucket, quantile_bounds, range_bucket

#: Buckets of a score order; their bounds are literals in the plan.
SCORE_BUCKETS = 256


def running_sums(df: DataFrame, bucket: Column, order: list[Column], sums: list[str], groups: list[str] | None = None,
                 prefix: str = "cum_") -> DataFrame:
    """Inclusive running sums of ``sums`` in ``order`` within each ``groups`` value.

    ``bucket`` never decreases along ``order`` and depends on the row only; rows that
    are equal in ``order`` share a bucket.
    """
    groups = groups or []
    s = df.withColumn("_bucket", bucket)
    w = Window.partitionBy("_bucket", *groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    tot = s.groupBy("_bucket", *groups).agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    # offsets over the totals: one row per bucket and group
    wo = (Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))).orderBy("_bucket") \
        .rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select(F.col("_bucket").alias("_ob"), *[F.col(g).alias(f"_og_{g}") for g in groups],
                      *[F.coalesce(F.sum(f"_t_{c}").over(wo), F.lit(0)).alias(f"_o_{c}") for c in sums])
    on = F.col("_bucket").eqNullSafe(F.col("_ob"))
    for g in groups:
        on = on & F.col(g).eqNullSafe(F.col(f"_og_{g}"))
    out = s.withColumns({f"_l_{c}": F.sum(c).over(w) for c in sums}).join(offs, on)
    out = out.withColumns({f"{prefix}{c}": F.col(f"_o_{c}") + F.col(f"_l_{c}") for c in sums})
    return out.drop("_bucket", "_ob", *[f"_og_{g}" for g in groups], *[f"_l_{c}" for c in sums], *[f"_o_{c}" for c in sums])


def stratified_split(df: DataFrame, label: str, id_col: str, folds: int = 3, seed: int = 42,
                     out: str = "fold") -> DataFrame:
    """M1: stratified folds: within each class, rows ordered by
    ``md5(id || seed)`` are dealt round-robin into ``folds`` folds; fold 0 is
    the validation set (~1/3).  Class shares differ by at most one row between
    folds.  The fold is a column, so later runs reuse the same split."""
    h = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(str(seed))))
    d = df.withColumn("_h", h).withColumn("_one", F.lit(1))
    r = running_sums(d, hex_bucket(F.col("_h")), [F.col("_h")], ["_one"], [label], prefix="_rank")
    return r.withColumn(out, F.pmod(F.col("_rank_one") - 1, F.lit(folds)).cast("int")).drop("_h", "_one", "_rank_one")


def binary_metrics(df: DataFrame, y: str, pred) -> DataFrame:
    """M4: confusion counts, accuracy, recall and precision (NULL when undefined)."""
    p = F.col(pred) if isinstance(pred, str) else pred
    yt = F.col(y).cast("boolean")
    c = df.agg(F.count(F.when(yt & p, 1)).alias("tp"), F.count(F.when(~yt & p, 1)).alias("fp"),
               F.count(F.when(~yt & ~p, 1)).alias("tn"), F.count(F.when(yt & ~p, 1)).alias("fn"))
    tp, fp, tn, fn = (F.col(x).cast("double") for x in ("tp", "fp", "tn", "fn"))
    return c.select("tp", "fp", "tn", "fn", F.try_divide(tp + tn, tp + fp + tn + fn).alias("accuracy"),
                    F.try_divide(tp, tp + fn).alias("recall"), F.try_divide(tp, tp + fp).alias("precision"))


def score_counts(df: DataFrame, y: str, score: str) -> DataFrame:
    """Positives and negatives per distinct score (partial aggregation)."""
    yt = F.col(y).cast("boolean")
    return df.groupBy(F.col(score).alias("score")).agg(F.count(F.when(yt, 1)).alias("pos"),
                                                       F.count(F.when(~yt, 1)).alias("neg"))


def roc_auc(df: DataFrame, y: str, score: str) -> DataFrame:
    """M5: exact ROC AUC with tied scores counted half (Mann-Whitney form):
    ``Σ_s pos_s · (neg below s + neg_s / 2) / (P · N)``."""
    counts = score_counts(df, y, score)
    bounds = quantile_bounds(counts, "score", SCORE_BUCKETS)
    sc = running_sums(counts, range_bucket(F.col("score"), bounds), [F.col("score")], ["neg"])
    below = F.col("cum_neg") - F.col("neg")
    return sc.agg(F.sum(F.col("pos") * (below + F.col("neg") / 2.0)).alias("_w"), F.sum("pos").alias("P"),
                  F.sum("neg").alias("N")).select(
        F.try_divide(F.col("_w"), F.col("P").cast("double") * F.col("N")).alias("auc"),
        F.col("P").cast("long").alias("n_pos"), F.col("N").cast("long").alias("n_neg"))


def roc_curve(df: DataFrame, y: str, score: str) -> DataFrame:
    """M6: one ROC point per distinct score used as threshold (``score >= t``
    is positive), all thresholds kept: ``(threshold, fpr, tpr)``."""
    sc = score_counts(df, y, score)
    # the two class totals are fetched as numbers (one aggregate row) and
    # enter the plan as literals
    tot = sc.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")).first()
    p_tot, n_tot = F.lit(tot["P"]).cast("double"), F.lit(tot["N"]).cast("double")
    bounds = quantile_bounds(sc, "score", SCORE_BUCKETS)
    r = running_sums(sc, -range_bucket(F.col("score"), bounds), [F.col("score").desc()], ["pos", "neg"])
    return r.select(F.col("score").alias("threshold"), F.try_divide(F.col("cum_neg").cast("double"), n_tot).alias("fpr"),
                    F.try_divide(F.col("cum_pos").cast("double"), p_tot).alias("tpr"))


def validation_summary(scored: DataFrame, y: str, pred, proba: str) -> DataFrame:
    """M3 summary: accuracy, recall, precision and AUC as one row (two
    aggregates, each one row, combined on the driver)."""
    m = binary_metrics(scored, y, pred).first()
    a = roc_auc(scored, y, proba).first()
    return scored.sparkSession.createDataFrame(
        [(m["accuracy"], m["recall"], m["precision"], a["auc"])],
        "accuracy double, recall double, precision double, auc double")


def alarm_point(roc: DataFrame, threshold, inclusive: bool = True) -> DataFrame:
    """M6: the ROC point of an alarm threshold, found by comparison, not float
    equality: the lowest ROC threshold ``>= t`` (the point whose threshold
    equals ``t`` when a case scores exactly ``t``, as the source looks it up),
    or ``> t`` with ``inclusive=False`` (the strict alarm rule)."""
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    cond = F.col("threshold") >= t if inclusive else F.col("threshold") > t
    return roc.filter(cond).orderBy("threshold").limit(1)
