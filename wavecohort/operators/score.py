"""Form matrix, SAPS2 risk score and feature encoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavecohort.functions.keys import effective_date, form_key, log1p_col, sqrt_col, strip_form
from wavecohort.operators.aggregates import group_count

# Published SAPS II logistic model (logit coefficients).
SAPS2_INTERCEPT = -7.7631
SAPS2_COEF = 0.0737
SAPS2_LN_COEF = 0.9971
SAPS2_ALARM_SCORE = 15


def form_dates(forms: DataFrame) -> DataFrame:
    """K4 per form: ``j1`` when filled, else the creation date (distinct per form)."""
    return forms.select("id_form", "id_nda", effective_date("j1", "dt_ins").alias("dt_ins")).distinct()


def form_matrix(answers: DataFrame, dates: DataFrame, fields: list[str]) -> DataFrame:
    """Long answers → one row per form, one column per field.

    The key is ``id_nda || date || '_' || form`` (K3) and the stay key its
    greedy prefix.  Each cell must hold one answer: a duplicate raises at run
    time (``raise_error`` inside the aggregate, no extra pass).  The field
    list is explicit, so the pivot needs no pass to discover it.
    """
    j = answers.join(dates.select("id_form", "dt_ins"), "id_form", "inner")
    key = form_key("id_nda", "dt_ins", "id_form")
    j = j.select(key.alias("id_form_ndaj1"), "champ_formulaire", "value_field")
    cells = []
    for f in fields:
        hit = F.col("champ_formulaire") == F.lit(f)
        n = F.count(F.when(hit, F.lit(1)))
        cells.append(F.when(n > 1, F.raise_error(F.lit(f"duplicate answer for field {f}")))
                     .otherwise(F.max(F.when(hit, F.col("value_field")))).cast("string").alias(f))
    m = j.groupBy("id_form_ndaj1").agg(*cells)
    return m.select("id_form_ndaj1", strip_form("id_form_ndaj1").alias("id_ndaj1"), *fields)


def saps2_logit(score) -> Column:
    s = (F.col(score) if isinstance(score, str) else score).cast("double")
    return F.lit(SAPS2_INTERCEPT) + F.lit(SAPS2_COEF) * s + F.lit(SAPS2_LN_COEF) * F.log1p(s)


def saps2_prob(score) -> Column:
    """``p = e^l / (1 + e^l)`` with the published logit."""
    lg = saps2_logit(score)
    return F.exp(lg) / (F.lit(1.0) + F.exp(lg))


def saps2_threshold(at: float = SAPS2_ALARM_SCORE) -> float:
    """Probability of the alarm score (driver constant)."""
    import math
    lg = SAPS2_INTERCEPT + SAPS2_COEF * at + SAPS2_LN_COEF * math.log(at + 1.0)
    return math.exp(lg) / (1.0 + math.exp(lg))


def saps2_alarm(prob, at: float = SAPS2_ALARM_SCORE, inclusive: bool = False) -> Column:
    """Alarm when the probability is **strictly** above that of score ``at``
    (``inclusive=True`` gives the ``>=`` the prose describes)."""
    p = F.col(prob) if isinstance(prob, str) else prob
    t = F.lit(saps2_threshold(at))
    return p >= t if inclusive else p > t


def score_dataset(matrix: DataFrame, patient_map: DataFrame, patients: DataFrame, score_field: str) -> DataFrame:
    """Form matrix + death date of the case's patient (J9) + SAPS2 logit and
    probability of the total score field."""
    pm = patient_map.join(patients.select("ids_pat", "dt_deces"), "ids_pat").select("id_nda", "dt_deces")
    m = matrix.withColumn("id_nda", F.expr("substring(id_ndaj1, 1, char_length(id_ndaj1) - 10)"))
    s = F.col(score_field).try_cast("double")
    return (m.join(pm, "id_nda", "inner").drop("id_nda")
            .withColumn("logit", saps2_logit(s)).withColumn("pr", saps2_prob(s)))


def categories(answers: DataFrame, weight: Column) -> DataFrame:
    """Reference categories (PARENT, LID, saps2weight, index), ordered by
    variable then index; ``index`` follows the numeric weight."""
    c = answers.select(F.col("champ_formulaire").alias("PARENT"), weight.cast("string").alias("saps2weight")).distinct()
    w = Window.partitionBy("PARENT").orderBy(F.col("saps2weight").cast("int"))
    return (c.withColumn("index", F.row_number().over(w).cast("int"))
            .withColumn("LID", F.concat(F.lit("w"), F.col("saps2weight")))
            .select("PARENT", "LID", "saps2weight", "index").orderBy("PARENT", "index"))


def label_encode(df: DataFrame, cats: DataFrame, var_col: str, weight_col: str, out: str = "code") -> DataFrame:
    """P5: code = position of the answer's weight in the **string** sort of
    its variable's reference weights; an unknown weight raises.

    The category table has one row per (variable, weight); Spark broadcasts it when
    its size allows.
    """
    codes = cats.select(F.col("PARENT").alias("_var"), F.col("saps2weight").alias("_w"),
                        (F.dense_rank().over(Window.partitionBy("PARENT").orderBy("saps2weight")) - 1)
                        .cast("int").alias("_code"))
    j = df.join(codes, (df[var_col] == codes._var) & (df[weight_col].cast("string") == codes._w), "left")
    code = F.when(F.col("_code").isNull(), F.raise_error(F.concat(
        F.lit("unknown weight "), F.col(weight_col).cast("string"), F.lit(" for "), F.col(var_col)))).otherwise(F.col("_code"))
    return j.withColumn(out, code.cast("int")).drop("_var", "_w", "_code")


def add_features(df: DataFrame, cols: list[str]) -> DataFrame:
    """For each column ``f``: ``C_f`` (rows sharing its value), ``SQ_f`` and ``LN_f``."""
    out = df
    for f in cols:
        out = group_count(out, f, f"C_{f}")
        out = out.withColumn(f"SQ_{f}", sqrt_col(f)).withColumn(f"LN_{f}", log1p_col(f))
    return out
