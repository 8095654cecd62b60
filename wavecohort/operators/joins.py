"""Joins (J1-J12).

Dimension sides whose size is bounded (dictionaries, units, reference
tables) are broadcast; fact-to-fact joins are equi joins on real key
columns, never on concatenated strings, so Spark can hash/sort-merge on
them and AQE can split skewed partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavecohort.functions.keys import active, epoch_us, stay_key


def first_window(sensors: DataFrame, moves: DataFrame, span: str = "1 day") -> DataFrame:
    """Measures inside ``[start, start + span]`` of a movement of the same stay.

    Equi join on ``id_nda`` plus a range residual; one output row per matching
    movement.  ``dt_deb`` is the movement's start day (the case day).
    """
    m = moves.select(F.col("id_nda").alias("_m_id"), F.col("dt_deb_mouv_ufr").alias("_start"))
    end = F.col("_start") + F.expr(f"INTERVAL {span}")
    j = sensors.join(m, (sensors.id_nda == m._m_id) & (sensors.dt_insert >= m._start) & (sensors.dt_insert <= end),
                     "inner")
    return j.select(F.to_date("_start").alias("dt_deb"), *[sensors[c] for c in sensors.columns])


def first_window_bucketed(sensors: DataFrame, moves: DataFrame, days: int = 1) -> DataFrame:
    """J2 for hot stays, same rows as :func:`first_window` with a span of whole days.

    Equi join on (stay, time bucket): a bucket is as long as the window, a measure lies in one
    and a window in two of them (every one it touches), so a stay's measures
    spread over as many tasks as it has buckets and every matching pair meets once.
    """
    width = days * 86_400_000_000
    bucket = lambda t: F.floor(epoch_us(t) / F.lit(width))
    m = moves.select(F.col("id_nda").alias("_m_id"), F.col("dt_deb_mouv_ufr").alias("_start"))
    end = F.col("_start") + F.expr(f"INTERVAL {days} DAY")
    m = m.filter(F.col("_start").isNotNull()).withColumn("_m_bucket", F.explode(F.sequence(bucket(F.col("_start")), bucket(end))))
    s = sensors.withColumn("_bucket", bucket(F.col("dt_insert")))
    j = s.join(m, (s.id_nda == m._m_id) & (s._bucket == m._m_bucket) & (s.dt_insert >= m._start) & (s.dt_insert <= end), "inner")
    return j.select(F.to_date("_start").alias("dt_deb"), *[s[c] for c in sensors.columns])


def anti(df: DataFrame, keys_df: DataFrame, on: list[str] | str) -> DataFrame:
    """``NOT IN`` on non-null keys as a plain left anti join.

    SQL ``NOT IN`` is null-aware and forces a broadcast; the keys here are
    declared non-null, so null keys are dropped from both sides first (with
    them ``NOT IN`` would return nothing at all).
    """
    keys = [on] if isinstance(on, str) else on
    k = keys_df.select(*keys).dropna()
    return df.dropna(subset=keys).join(k, keys, "left_anti")


def icu_moves(moves: DataFrame, units: DataFrame) -> DataFrame:
    """Movements in ICU units; ``left_semi`` keeps one row per movement
    even if a unit id repeats.  No broadcast hint: the unit table is data, so
    the planner's size estimate (and AQE's measured size) decides."""
    return moves.join(units.select("ids_ufr"), "ids_ufr", "left_semi")


def case_data(pat_info: DataFrame, sensors24: DataFrame, nda: DataFrame) -> DataFrame:
    """Demographics per case; death date kept only inside the stay ``[deb, fin]``.

    Distinct case keys are taken first (the reference joins every measure row
    and de-duplicates at the end).
    """
    cases = active(sensors24, positive=False).select("id_nda", "dt_deb").distinct()
    return case_data_for(cases, pat_info, nda)


def case_data_for(cases: DataFrame, pat_info: DataFrame, nda: DataFrame) -> DataFrame:
    """J5 on already distinct case keys ``(id_nda, dt_deb)``."""
    p = pat_info.select("id_nda", "age", "cd_sex_tr", "dpt", F.col("dt_deces").alias("pat_dt_deces"))
    n = nda.select("id_nda", "dt_deb_nda", "dt_fin_nda")
    j = cases.join(p, "id_nda").join(n, "id_nda")
    inside = (F.col("dt_deb_nda") <= F.col("pat_dt_deces")) & (F.col("pat_dt_deces") <= F.col("dt_fin_nda"))
    return j.select("id_nda", "dt_deb", "age", "pat_dt_deces", "cd_sex_tr", "dpt",
                    F.when(inside, F.col("pat_dt_deces")).alias("dt_deces")).distinct()


def map_forms(cases: DataFrame, forms: DataFrame, days: int = 15, bucket_days: int = 30) -> DataFrame:
    """A form belongs to a case of the same stay when ``j1 + days >= form date``
    (no lower bound), distinct.

    Only a form's earliest date decides, so both sides are made distinct before the
    join and its pairs need no second pass.  The join is on (stay, bucket of form dates): a case becomes one row for
    every bucket of its stay that holds a form and starts before the case's own limit, so a stay with very
    many cases and forms spreads over its buckets and all but the last of them match whole.
    """
    bucket = lambda day: F.floor(F.unix_date(day) / F.lit(bucket_days))
    f = (forms.groupBy(F.col("id_nda").alias("_f_id"), "id_form").agg(F.min(F.to_date("form_date")).alias("_day"))
         .withColumn("_bucket", bucket(F.col("_day"))))
    c = cases.select("id_nda", "j1").distinct().withColumn("_limit", F.date_add("j1", days))
    held = f.select("_f_id", "_bucket").distinct().filter(F.col("_bucket").isNotNull())
    held = held.select(F.col("_f_id").alias("_h_id"), F.col("_bucket").alias("_h_bucket"))
    c = c.join(held, (c.id_nda == held._h_id) & (held._h_bucket <= bucket(c._limit))).select("id_nda", "j1", "_limit", "_h_bucket")
    return c.join(f, (c.id_nda == f._f_id) & (c._h_bucket == f._bucket) & (c._limit >= f._day)).select("id_nda", "j1", "id_form")


def true_death(cases: DataFrame, nda: DataFrame) -> DataFrame:
    """Cases whose death falls in ``(start, end]`` of the stay (start strict)."""
    n = nda.select(stay_key("id_nda").alias("_n_id"), "dt_deb_nda", "dt_fin_nda")
    d = cases.filter(F.col("dt_deces").isNotNull())
    cond = ((d.id_nda == n._n_id) & (n.dt_deb_nda < d.dt_deces) & (d.dt_deces <= n.dt_fin_nda))
    return d.join(n, cond, "inner").select("id_nda", "j1")


def map_patient(case_map: DataFrame, moves: DataFrame, nda: DataFrame) -> DataFrame:
    """J9 (first half): case → patient, distinct, with the stay bounds."""
    m = moves.select("id_nda", "ids_pat").distinct()
    return (case_map.join(m, "id_nda").join(nda.select("id_nda", "dt_deb_nda", "dt_fin_nda"), "id_nda")
            .select("id_case", "ids_pat", "dt_deb_nda", "dt_fin_nda").distinct())


def enrich_death(matrix: DataFrame, patient_map: DataFrame, patients: DataFrame,
                 dedupe: bool = False) -> DataFrame:
    """Attach the patient's death date to each form-matrix row.

    A case mapped to two patients yields two rows, as in the source;
    ``dedupe=True`` keeps one (the earliest death date).
    """
    pm = patient_map.join(patients.select("ids_pat", "dt_deces"), "ids_pat").select("id_case", "ids_pat", "dt_deces")
    out = matrix.join(pm, "id_case", "inner")
    if dedupe:
        out = out.groupBy(*matrix.columns).agg(F.min("dt_deces").alias("dt_deces"), F.min("ids_pat").alias("ids_pat"))
    return out


def dt_ranges(cases: DataFrame, useful: DataFrame) -> DataFrame:
    """Min and max time of the useful measures of each stored case."""
    u = useful.select("id_nda", F.col("dt_deb").alias("j1"), "dt_insert")
    return (cases.select("id_nda", "j1").join(u, ["id_nda", "j1"])
            .groupBy("id_nda", "j1").agg(F.min("dt_insert").alias("dt_min"), F.max("dt_insert").alias("dt_max")))
