"""Cohort selection (A3-A8, C1-C10): which stays have enough measures, the
right age and a long enough common window.

Design for scale: the measure table is the only large input.  It is read
once; a single ``groupBy(case, code)`` with conditional aggregates (partially
aggregated before the shuffle) produces counts and time bounds together.
Everything after that works on one row per (case, code) or per case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavecohort.functions.keys import active, stay_key
from wavecohort.operators.joins import first_window, icu_moves

CASE = ["id_nda", "dt_deb"]


def case_code_stats(sensors24: DataFrame, codes: list) -> DataFrame:
    """One pass over the measures of ``codes`` (active rows only):

    ``n``      measures with a positive value (A3 ``counter``),
    ``min_dt`` / ``max_dt`` over all active measures (A5).
    """
    s = sensors24.filter(F.col("id_measure_type").isin(list(codes)) & (F.col("dt_cancel") == ""))
    return s.groupBy(*CASE, F.col("id_measure_type").alias("code")).agg(
        F.count(F.when(F.col("value_numeric") > 0, F.lit(1))).alias("n"),
        F.min("dt_insert").alias("min_dt"), F.max("dt_insert").alias("max_dt"))


def measure_counter(sensors24: DataFrame, codes: list) -> DataFrame:
    """A3: measures per (case, code), active and positive, long form."""
    return (active(sensors24, positive=True).filter(F.col("id_measure_type").isin(list(codes)))
            .groupBy(*CASE, "id_measure_type").agg(F.count(F.lit(1)).alias("counter")))


def counter_matrix(sensors24: DataFrame, codes: list, names: list[str] | None = None) -> DataFrame:
    """A4: wide counter matrix, one column per code (explicit value list, so the
    pivot needs no extra pass to find the values); absent code → NULL."""
    names = names or [str(c) for c in codes]
    long = measure_counter(sensors24, codes)
    return long.groupBy(*CASE).agg(*[
        F.sum(F.when(F.col("id_measure_type") == F.lit(c), F.col("counter"))).alias(n)
        for c, n in zip(codes, names)])


def voi_case_stats(stats: DataFrame, voi_codes: DataFrame) -> DataFrame:
    """Per (case, voi): total positive measures and the VOI's own time bounds.

    ``voi_codes`` is the exploded dictionary ``(voi, code)``: a bounded
    dimension, broadcast.
    """
    vc = F.broadcast(voi_codes.select("voi", "code"))
    return stats.join(vc, "code").groupBy(*CASE, "voi").agg(
        F.sum("n").alias("n_voi"), F.min("min_dt").alias("voi_min"), F.max("max_dt").alias("voi_max"))


def require_all_vois(voi_stats: DataFrame, vois: list[str], optional=("BT",)) -> DataFrame:
    """Cases with at least one positive measure for every required VOI."""
    req = [v for v in vois if v not in optional]
    return (voi_stats.filter(F.col("voi").isin(req) & (F.col("n_voi") > 0))
            .groupBy(*CASE).agg(F.count(F.lit(1)).alias("_k"))
            .filter(F.col("_k") == len(req)).drop("_k"))


def require_min_points(voi_stats: DataFrame, vois: list[str], min_pts: int = 10,
                       optional=("BT",)) -> DataFrame:
    """Every required VOI has **strictly** more than ``min_pts`` measures."""
    req = [v for v in vois if v not in optional]
    return (voi_stats.filter(F.col("voi").isin(req) & (F.col("n_voi") > min_pts))
            .groupBy(*CASE).agg(F.count(F.lit(1)).alias("_k"))
            .filter(F.col("_k") == len(req)).drop("_k"))


def voi_window(voi_stats: DataFrame, vois: list[str], optional=("BT",)) -> DataFrame:
    """Common window per case: latest VOI start, earliest VOI end, and
    its length (INTERVAL and seconds)."""
    req = [v for v in vois if v not in optional]
    w = (voi_stats.filter(F.col("voi").isin(req)).groupBy(*CASE)
         .agg(F.max("voi_min").alias("dt_min"), F.min("voi_max").alias("dt_max")))
    return w.withColumn("stay_len_s", F.timestamp_diff("SECOND", "dt_min", "dt_max"))


def patient_info(moves: DataFrame, patients: DataFrame, sensors24: DataFrame) -> DataFrame:
    """Per stay with measures: demographics and movement bounds."""
    return patient_info_for(moves, patients, sensors24.select("id_nda"))


def patient_info_for(moves: DataFrame, patients: DataFrame, stay_keys: DataFrame | None) -> DataFrame:
    """A8 restricted to ``stay_keys`` (all movements when ``None``)."""
    m = moves if stay_keys is None else moves.join(stay_keys.select("id_nda"), "id_nda", "left_semi")
    return (m.join(patients, "ids_pat")
            .groupBy("id_nda", "age", "cd_sex_tr", "dt_deces", "dpt")
            .agg(F.min("dt_deb_mouv_ufr").alias("min_dt_deb_mouv"),
                 F.max("dt_deb_mouv_ufr").alias("max_dt_deb_mouv"),
                 F.max("dt_fin_mouv_ufr").alias("max_dt_fin_mouv")))


def stays_with_measures(stays: DataFrame, sensors24: DataFrame) -> DataFrame:
    """Stays that hold at least one measure in the window."""
    return stays.join(sensors24.select("id_nda"), "id_nda", "left_semi")


def filter_age(cases: DataFrame, demo: DataFrame, age_min: float = 18) -> DataFrame:
    """Inner join with demographics, ``age >= age_min``."""
    return cases.join(demo.filter(F.col("age") >= age_min), CASE, "inner")


def filter_stay(cases: DataFrame, window: DataFrame, hours: float = 6) -> DataFrame:
    """C4: inner join with the common window, ``stay_len >= hours``."""
    return cases.join(window.filter(F.col("stay_len_s") >= int(hours * 3600)), CASE, "inner")


def build_cohort(sensors: DataFrame, moves: DataFrame, units: DataFrame, stays: DataFrame,
                 patients: DataFrame, voi_codes: DataFrame, vois: list[str], codes: list,
                 min_pts: int = 10, min_stay_h: float = 20, age_min: float = 15,
                 span: str = "1 day", optional=("BT",)) -> DataFrame:
    """The full cohort as one plan: first window (J2) → counts per code
    (A3) → coverage (C1, C2) → demographics (J5, C3) → common window (A6, C4).

    Output: case key (the raw stay id; sinks write it as text), one total per
    VOI, demographics, window bounds.
    """
    icu = icu_moves(moves, units)
    s24 = first_window(sensors, icu, span)
    # on the whole case key: the aggregates per case are a stage of their own, and so are the demographics (a task holds
    # memory for every join and aggregate of its stage)
    stats = case_code_stats(s24, codes).repartition(*CASE)
    vstats = voi_case_stats(stats, voi_codes)
    per_case = case_summary(vstats, vois, min_pts, optional)
    req = [v for v in vois if v not in optional]
    passed = per_case.filter((F.col("_n_req") == len(req)) & (F.col("_n_pass") == len(req)))
    # Demographics are derived per stay from the movement-sized tables and
    # joined to the passing cases on the stay id: the same rows as restricting
    # them to stays with measures first (the inner join does that), without
    # deriving the case keys a second time from the measures.
    demo = stay_demographics(icu, patients, stays)
    c = (passed.join(demo.filter(F.col("age") >= age_min), "id_nda", "inner")
         .filter(F.col("stay_len_s") >= int(min_stay_h * 3600)))
    return c.select("id_nda", F.col("dt_deb").alias("j1"), *vois, "age", "cd_sex_tr", "dpt", "dt_deces",
                    "dt_min", "dt_max", "stay_len_s")


def stay_demographics(icu: DataFrame, patients: DataFrame, stays: DataFrame) -> DataFrame:
    """J5 per stay: patient demographics, death date kept only inside the stay
    ``[deb, fin]`` (distinct rows, as the source's DISTINCT)."""
    p = patient_info_for(icu, patients, None).select(
        "id_nda", "age", "cd_sex_tr", "dpt", F.col("dt_deces").alias("pat_dt_deces"))
    n = stays.select("id_nda", "dt_deb_nda", "dt_fin_nda")
    inside = (F.col("dt_deb_nda") <= F.col("pat_dt_deces")) & (F.col("pat_dt_deces") <= F.col("dt_fin_nda"))
    return p.join(n, "id_nda").select("id_nda", "age", "pat_dt_deces", "cd_sex_tr", "dpt",
                                      F.when(inside, F.col("pat_dt_deces")).alias("dt_deces")).distinct()


def case_summary(voi_stats: DataFrame, vois: list[str], min_pts: int, optional=("BT",)) -> DataFrame:
    """C1 + C2 + A6 + A13 in ONE aggregate per case: VOI totals, number of
    required VOIs present (C1) and above ``min_pts`` (C2, strict), and the
    common window (latest VOI start, earliest VOI end) with its length.
    ``voi_stats`` holds one row per (case, voi), so plain counts are
    distinct counts."""
    req = [v for v in vois if v not in optional]
    # SQL text: one parse per expression instead of one JVM call per operator
    req_list = ", ".join("'" + v.replace("'", "''") + "'" for v in req) or "NULL"
    is_req = f"voi IN ({req_list})"
    w = voi_stats.groupBy(*CASE).agg(
        *[F.expr("sum(CASE WHEN voi = '" + v.replace("'", "''") + "' THEN n_voi END)").alias(v) for v in vois],
        F.expr(f"count(CASE WHEN {is_req} AND n_voi > 0 THEN 1 END)").alias("_n_req"),
        F.expr(f"count(CASE WHEN {is_req} AND n_voi > {int(min_pts)} THEN 1 END)").alias("_n_pass"),
        F.expr(f"max(CASE WHEN {is_req} THEN voi_min END)").alias("dt_min"),
        F.expr(f"min(CASE WHEN {is_req} THEN voi_max END)").alias("dt_max"))
    return w.withColumn("stay_len_s", F.expr("timestampdiff(SECOND, dt_min, dt_max)"))


def useful(sensors24: DataFrame, cases: DataFrame) -> DataFrame:
    """Active, positive measures of the kept cases (semi join on the real
    key columns)."""
    k = cases.select("id_nda", F.col("j1").alias("dt_deb"))
    return active(sensors24, positive=True).join(k, CASE, "left_semi")


def case_measures(useful_df: DataFrame) -> DataFrame:
    """Measures of kept cases with their string case id, ordered by stay,
    day, type and time.  A global sort (range partitioning on the whole
    composite key) rather than one partition per case: a case holding a third
    of all measures is spread over many tasks."""
    id10 = stay_key("id_nda")
    return (useful_df.select(id10.alias("id_nda"), F.col("dt_deb").cast("string").alias("j1"),
                             F.concat(id10, F.col("dt_deb").cast("string")).alias("id_case"),
                             "id_measure_type", "dt_insert", "value_numeric")
            .orderBy("id_nda", "j1", "id_measure_type", "dt_insert"))


def adjust_outcome(cases: DataFrame, true_deaths: DataFrame) -> DataFrame:
    """Keep the death date only for cases in ``true_deaths``; the others
    get none.  One left join instead of IN ∪ NOT IN; rows are de-duplicated
    as UNION does."""
    t = true_deaths.select("id_nda", "j1").distinct().withColumn("_ok", F.lit(True))
    j = cases.join(t, ["id_nda", "j1"], "left")
    cols = [c for c in cases.columns if c != "dt_deces"]
    return j.select(*cols, F.when(F.col("_ok"), F.col("dt_deces")).alias("dt_deces")).distinct()
