"""Registered cohort queries (flagship C5 and its stages)."""

from __future__ import annotations

from wavecohort.functions import voi as V
from wavecohort.functions.keys import stay_key
from wavecohort.operators import cohort as C
from wavecohort.operators import joins as J
from wavecohort.plans import bindings as B
from wavecohort.plans.bindings import with_ctes
from wavecohort.plans.registry import query

# Parameters of the cohort run (source: 24 h window, 15 years,
# 20 h stay; the test stays span the whole month, hence the 30-day window).
COHORT_SPAN = "30 days"
MIN_PTS = 10
MIN_STAY_H = 20
AGE_MIN = 15

_REQ = [v for v in B.TEST_VOI_NAMES if v not in V.OPTIONAL_VOIS]
_CODES_SQL = "(" + ", ".join(f"'{c}'" for c in B.TEST_CODES) + ")"
_REQ_SQL = "(" + ", ".join(f"'{v}'" for v in _REQ) + ")"


def _inputs(spark, d):
    return (B.sensors(spark, d), B.moves(spark, d), B.units(spark, d), B.stays(spark, d),
            B.patients(spark, d), V.voi_code_table(V.dictionary(spark, B.TEST_VOIS)))


def cohort_df(spark, d, span=COHORT_SPAN, min_pts=MIN_PTS, min_stay_h=MIN_STAY_H, age_min=AGE_MIN):
    s, m, u, st, p, vc = _inputs(spark, d)
    return C.build_cohort(s, m, u, st, p, vc, B.TEST_VOI_NAMES, B.TEST_CODES,
                          min_pts=min_pts, min_stay_h=min_stay_h, age_min=age_min, span=span)


def sensors24(spark, d, span):
    return J.first_window(B.sensors(spark, d), J.icu_moves(B.moves(spark, d), B.units(spark, d)), span)


_S24_SQL = """icu_moves AS (SELECT * FROM moves WHERE ids_ufr IN (SELECT ids_ufr FROM units)),
s24 AS (SELECT CAST(n.dt_deb_mouv_ufr AS DATE) AS dt_deb, s.* FROM sensors s JOIN icu_moves n
        ON s.id_nda = n.id_nda AND s.dt_insert >= n.dt_deb_mouv_ufr
        AND s.dt_insert <= n.dt_deb_mouv_ufr + INTERVAL {span})"""

# Oracle parts.  A person row: one per stay with measures and set of demographic
# values, with the bounds of its movements; demographics per case keep the death
# date only where it lies between the stay's bounds.
_PERSON_SQL = """person AS (SELECT mv.id_nda, pt.age, pt.cd_sex_tr, pt.dt_deces, pt.dpt, min(mv.dt_deb_mouv_ufr) AS first_start,
    max(mv.dt_deb_mouv_ufr) AS last_start, max(mv.dt_fin_mouv_ufr) AS last_end
    FROM icu_moves mv JOIN patients pt USING (ids_pat) WHERE EXISTS (SELECT 1 FROM s24 WHERE s24.id_nda = mv.id_nda) GROUP BY ALL)"""
_DEMO_SQL = """demo AS (SELECT DISTINCT k.id_nda, k.dt_deb, pr.age, pr.dt_deces AS pat_dt_deces, pr.cd_sex_tr, pr.dpt,
    CASE WHEN pr.dt_deces BETWEEN st.dt_deb_nda AND st.dt_fin_nda THEN pr.dt_deces END AS dt_deces
    FROM (SELECT DISTINCT id_nda, dt_deb FROM s24 WHERE dt_cancel = '') k JOIN person pr USING (id_nda) JOIN stays st USING (id_nda))"""

COHORT_SQL = with_ctes(f"""WITH {_S24_SQL.format(span=COHORT_SPAN)},
counts AS (SELECT id_nda, dt_deb, id_measure_type, count(*) AS counter FROM s24
           WHERE id_measure_type IN {_CODES_SQL} AND dt_cancel = '' AND value_numeric > 0 GROUP BY 1, 2, 3),
vt AS (SELECT c.id_nda, c.dt_deb, d.voi, sum(c.counter) AS n FROM counts c JOIN vdict d ON c.id_measure_type = d.code
       GROUP BY 1, 2, 3),
lvl1 AS (SELECT id_nda, dt_deb FROM vt WHERE voi IN {_REQ_SQL} GROUP BY 1, 2 HAVING count(DISTINCT voi) = {len(_REQ)}),
lvl2 AS (SELECT id_nda, dt_deb FROM vt WHERE voi IN {_REQ_SQL} GROUP BY 1, 2
         HAVING count(CASE WHEN n > {MIN_PTS} THEN 1 END) = {len(_REQ)}),
{_PERSON_SQL},
{_DEMO_SQL},
bounds AS (SELECT id_nda, dt_deb, id_measure_type, min(dt_insert) AS min_dt, max(dt_insert) AS max_dt FROM s24
           WHERE id_measure_type IN {_CODES_SQL} AND dt_cancel = '' GROUP BY 1, 2, 3),
vw AS (SELECT b.id_nda, b.dt_deb, d.voi, min(b.min_dt) AS vmin, max(b.max_dt) AS vmax
       FROM bounds b JOIN vdict d ON b.id_measure_type = d.code WHERE d.voi IN {_REQ_SQL} GROUP BY 1, 2, 3),
win AS (SELECT id_nda, dt_deb, max(vmin) AS dt_min, min(vmax) AS dt_max FROM vw GROUP BY 1, 2),
totals AS (SELECT id_nda, dt_deb, {", ".join(f"CAST(sum(CASE WHEN voi = '{v}' THEN n END) AS BIGINT) AS {v}" for v in B.TEST_VOI_NAMES)}
           FROM vt GROUP BY 1, 2)
SELECT lpad(CAST(t.id_nda AS VARCHAR), 10, '0') AS id_nda, t.dt_deb AS j1, {", ".join("t." + v for v in B.TEST_VOI_NAMES)},
       d.age, d.cd_sex_tr, d.dpt, d.dt_deces, w.dt_min, w.dt_max,
       (epoch_us(w.dt_max) - epoch_us(w.dt_min)) // 1000000 AS stay_len_s
FROM totals t JOIN lvl1 USING (id_nda, dt_deb) JOIN lvl2 USING (id_nda, dt_deb)
     JOIN demo d USING (id_nda, dt_deb) JOIN win w USING (id_nda, dt_deb)
WHERE d.age >= {AGE_MIN} AND w.dt_max - w.dt_min >= INTERVAL {MIN_STAY_H} HOUR""",
    "sensors", "vdict", "moves", "units", "stays", "patients")


@query("cohort", COHORT_SQL)
def q_cohort(spark, d):
    """The full cohort (flagship), stay ids in their stored form."""
    return cohort_df(spark, d).withColumn("id_nda", stay_key("id_nda"))


@query("first_24h", with_ctes(f"WITH {_S24_SQL.format(span='1 DAY')} SELECT * FROM s24",
                              "sensors", "moves", "units"))
def q_first_24h(spark, d):
    """Measures of the first 24 h of each ICU movement."""
    return sensors24(spark, d, "1 day")


@query("icu_moves", with_ctes("SELECT * FROM moves WHERE ids_ufr IN (SELECT ids_ufr FROM units)",
                              "moves", "units"))
def q_icu_moves(spark, d):
    """Movements restricted to ICU units."""
    return J.icu_moves(B.moves(spark, d), B.units(spark, d))
