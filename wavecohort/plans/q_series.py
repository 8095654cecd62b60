"""Registered wave, spectral and covariance queries (survey §2.7-§2.8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavecohort.functions import voi as V
from wavecohort.functions.keys import stay_key
from wavecohort.operators import aggregates as A
from wavecohort.operators import covariance as CV
from wavecohort.operators import series as W
from wavecohort.operators import spectral as SP
from wavecohort.plans import bindings as B
from wavecohort.plans import stages as ST
from wavecohort.plans.bindings import with_ctes
from wavecohort.plans.q_cohort import COHORT_SPAN, _REQ, _REQ_SQL, _S24_SQL
from wavecohort.plans.registry import query

# Grid of the waves (source: 96 points over the window, 30-point gap limit).
N_PTS = 96
GAP_LIMIT = 30
# Inertial binding: 6-hour resampling period, minima searched between day 2 and day 25.
CUE_PERIOD_MS = 6 * 3600 * 1000
MINIMA_RANGE_S = (2 * 86400, 25 * 86400)
TENSOR_D = 4

_BASE = ("sensors", "vdict", "vlabels", "moves", "units", "stays", "patients")


def _sql(body, *names):
    return with_ctes(body, *(names or _BASE))


def _cohort_sql():
    from wavecohort.plans.q_cohort import COHORT_SQL
    return COHORT_SQL


# ----------------------------------------------------------------- wave pipeline (cohort binding)

def _vc(spark):
    return V.voi_code_table(V.dictionary(spark, B.TEST_VOIS), _REQ)


def wave_inputs(spark, d):
    """Cases (with window and outcome), their useful measures and the 3-sigma
    limits; the cohort and the windowed measures are planned once and shared."""
    cohort = ST.cohort(spark, d)
    useful0 = ST.useful(spark, d)
    cases = cohort.select(F.concat(stay_key("id_nda"), F.col("j1").cast("string")).alias("id_case"),
                          "dt_min", "dt_max", "dt_deces")
    useful = useful0.select(
        F.concat(stay_key("id_nda"), F.col("dt_deb").cast("string")).alias("id_case"),
        "id_measure_type", "dt_insert", "value_numeric")
    # one row per VOI, read by several branches of the later plans
    lim = ST.stage(spark, d, "limits", lambda: A.sigma_limits(A.voi_stats(useful0, _vc(spark), _REQ), 3.0))
    return cases, useful, lim


def _pipeline(spark, d):
    cases, useful, lim = wave_inputs(spark, d)
    wl = W.waves_from_measures(useful, _vc(spark), lim, "id_case", _REQ)
    c = cases.select("id_case", "dt_min", W.grid_step(cases, N_PTS).alias("step"))
    binned = W.resample_waves(useful, _vc(spark), lim, c, _REQ, N_PTS)
    return cases, wl, binned


def waves_long_df(spark, d):
    return _pipeline(spark, d)[1]


def binned_df(spark, d):
    return _pipeline(spark, d)[2]


def interpolated_df(spark, d, binned=None):
    g = W.fill_grid(binned if binned is not None else binned_df(spark, d), ["id_case", "voi"], N_PTS)
    return W.interpolate(g, ["id_case", "voi"], GAP_LIMIT, fill=True)


_W_SQL = f"""{_S24_SQL.format(span=COHORT_SPAN)}, cohort AS ({_cohort_sql()}),
useful AS (SELECT lpad(CAST(id_nda AS VARCHAR), 10, '0') || CAST(dt_deb AS VARCHAR) AS id_case, id_measure_type,
           dt_insert, value_numeric FROM s24 WHERE dt_cancel = '' AND value_numeric > 0
           AND (lpad(CAST(id_nda AS VARCHAR), 10, '0'), dt_deb) IN (SELECT id_nda, j1 FROM cohort)),
lim AS (SELECT d.voi, avg(u.value_numeric) - 3.0 * stddev_samp(u.value_numeric) AS min_limit,
        avg(u.value_numeric) + 3.0 * stddev_samp(u.value_numeric) AS max_limit
        FROM useful u JOIN vdict d ON u.id_measure_type = d.code WHERE d.voi IN {_REQ_SQL} GROUP BY d.voi),
cases AS (SELECT id_nda || CAST(j1 AS VARCHAR) AS id_case, dt_min, dt_max, dt_deces,
          greatest(CAST(round_even((epoch_us(dt_max) - epoch_us(dt_min)) / 1e6 / {N_PTS} / 60.0, 0) AS BIGINT), 1) AS step
          FROM cohort),
wl AS (SELECT u.id_case, d.voi, u.dt_insert, u.value_numeric FROM useful u JOIN vdict d ON u.id_measure_type = d.code
       JOIN lim ON lim.voi = d.voi WHERE u.value_numeric BETWEEN lim.min_limit AND lim.max_limit),
w1 AS (SELECT * FROM wl WHERE id_case IN (SELECT id_case FROM wl GROUP BY id_case HAVING count(DISTINCT voi) = {len(_REQ)})),
ft AS (SELECT id_case, voi, min(dt_insert) AS t_first FROM w1 GROUP BY 1, 2),
bb AS (SELECT w1.id_case, w1.voi, w1.dt_insert, w1.value_numeric AS v, c.step, least(ft.t_first, c.dt_min) AS t0
       FROM w1 JOIN ft ON w1.id_case = ft.id_case AND w1.voi = ft.voi JOIN cases c ON w1.id_case = c.id_case),
bins AS (SELECT id_case, voi, v, CAST(floor((epoch_us(dt_insert) - epoch_us(date_trunc('day', t0))) / (step * 60000000))
                - floor((epoch_us(t0) - epoch_us(date_trunc('day', t0))) / (step * 60000000)) AS INTEGER) AS idx FROM bb),
rs AS (SELECT id_case, voi, idx, avg(v) AS value FROM bins WHERE idx < {N_PTS} GROUP BY 1, 2, 3),
gv AS (SELECT g.id_case, g.voi, g.idx, rs.value FROM (SELECT s.id_case, s.voi, CAST(t.i AS INTEGER) AS idx
       FROM (SELECT DISTINCT id_case, voi FROM rs) s, range(0, {N_PTS}) t(i)) g
       LEFT JOIN rs ON g.id_case = rs.id_case AND g.voi = rs.voi AND g.idx = rs.idx),
iw AS (SELECT *,
    last_value(value IGNORE NULLS) OVER (PARTITION BY id_case, voi ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v0,
    last_value(CASE WHEN value IS NOT NULL THEN idx END IGNORE NULLS) OVER (PARTITION BY id_case, voi ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS i0,
    first_value(value IGNORE NULLS) OVER (PARTITION BY id_case, voi ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v1,
    first_value(CASE WHEN value IS NOT NULL THEN idx END IGNORE NULLS) OVER (PARTITION BY id_case, voi ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS i1
    FROM gv),
interp AS (SELECT id_case, voi, idx, CASE WHEN value IS NOT NULL THEN value
    WHEN i0 IS NOT NULL AND i1 IS NOT NULL THEN v0 + (v1 - v0) * least(idx - i0, {GAP_LIMIT}) / (i1 - i0)
    WHEN i0 IS NOT NULL THEN v0 WHEN i1 IS NOT NULL THEN v1 END AS value FROM iw)"""


@query("grid_step", _sql(f"WITH {_W_SQL} SELECT id_case, step FROM cases"))
def q_grid_step(spark, d):
    """Resampling step (minutes, half-even, at least 1) per case."""
    cases, _u, _l = wave_inputs(spark, d)
    return cases.select("id_case", W.grid_step(cases, N_PTS).alias("step"))


@query("waves_long", _sql(f"WITH {_W_SQL} SELECT * FROM w1"))
def q_waves_long(spark, d):
    """Measures split by VOI inside the 3-sigma limits, complete cases only."""
    return waves_long_df(spark, d)


@query("resample_mean", _sql(f"WITH {_W_SQL} SELECT * FROM rs"))
def q_resample_mean(spark, d):
    """Mean per bin from midnight of the first tick, 96 bins kept."""
    return binned_df(spark, d)


_CASE_ANCHOR_SQL = _W_SQL.replace(
    "bb AS (SELECT w1.id_case, w1.voi, w1.dt_insert, w1.value_numeric AS v, c.step, least(ft.t_first, c.dt_min) AS t0\n"
    "       FROM w1 JOIN ft ON w1.id_case = ft.id_case AND w1.voi = ft.voi JOIN cases c ON w1.id_case = c.id_case)",
    "fc AS (SELECT id_case, min(t_first) AS t_first FROM ft GROUP BY id_case),\n"
    "bb AS (SELECT w1.id_case, w1.voi, w1.dt_insert, w1.value_numeric AS v, c.step, least(fc.t_first, c.dt_min) AS t0\n"
    "       FROM w1 JOIN fc ON w1.id_case = fc.id_case JOIN cases c ON w1.id_case = c.id_case)")


@query("resample_mean_case", _sql(f"WITH {_CASE_ANCHOR_SQL} SELECT * FROM rs"))
def q_resample_mean_case(spark, d):
    """W4 with the case anchor: every VOI of a case binned from the case's earliest tick (aligned VOIs)."""
    cases, useful, lim = wave_inputs(spark, d)
    c = cases.select("id_case", "dt_min", W.grid_step(cases, N_PTS).alias("step"))
    return W.resample_waves(useful, _vc(spark), lim, c, _REQ, N_PTS, anchor="case")


@query("interpolate_time", _sql(f"WITH {_W_SQL} SELECT * FROM interp"))
def q_interpolate_time(spark, d):
    """Time interpolation with the 30-point gap rule, then ffill, bfill."""
    return interpolated_df(spark, d)


# Array outputs carry doubles whose last bits depend on summation order; both
# sides round the elements to 9 places so that nested values compare exactly.
ARRAY_DIGITS = 9


@query("wave_matrix", _sql(f"""WITH {_W_SQL}, pv AS (SELECT id_case, voi, list(round(value, {ARRAY_DIGITS}) ORDER BY idx) AS w
    FROM interp GROUP BY 1, 2)
    SELECT pv.id_case, c.dt_deces IS NOT NULL AS outcome, list(pv.w ORDER BY pv.voi) AS waves
    FROM pv JOIN cases c ON pv.id_case = c.id_case GROUP BY pv.id_case, c.dt_deces"""))
def q_wave_matrix(spark, d):
    """Per case the VOI × 96 matrix and the outcome."""
    cases, _wl, binned = _pipeline(spark, d)
    long = interpolated_df(spark, d, binned).join(cases.select("id_case", (F.col("dt_deces").isNotNull()).alias("outcome")),
                                          "id_case")
    m = W.to_matrix(long, "id_case", "voi", ["outcome"])
    return m.withColumn("waves", F.transform("waves", lambda w: F.transform(w, lambda x: F.round(x, ARRAY_DIGITS))))


# The oracle solves each series' system by elimination: one recursive step a knot, forward and back.
_SPLINE_SQL = """kn AS (SELECT id_case, voi, CAST(idx AS DOUBLE) AS x, value AS y, row_number() OVER s AS i, count(*) OVER (PARTITION BY id_case, voi) AS n,
    CAST(idx AS DOUBLE) - lag(CAST(idx AS DOUBLE)) OVER s AS h0, lead(CAST(idx AS DOUBLE)) OVER s - CAST(idx AS DOUBLE) AS h1,
    value - lag(value) OVER s AS e0, lead(value) OVER s - value AS e1
    FROM gv WHERE value IS NOT NULL WINDOW s AS (PARTITION BY id_case, voi ORDER BY idx)),
mm AS (WITH RECURSIVE fw(id_case, voi, i, n, c, d) AS (
        SELECT id_case, voi, i, n, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM kn WHERE i = 1
        UNION ALL SELECT k.id_case, k.voi, k.i, k.n, k.h1 / (2 * (k.h0 + k.h1) - k.h0 * f.c),
            (6 * (k.e1 / k.h1 - k.e0 / k.h0) - k.h0 * f.d) / (2 * (k.h0 + k.h1) - k.h0 * f.c)
        FROM fw f JOIN kn k ON k.id_case = f.id_case AND k.voi = f.voi AND k.i = f.i + 1 WHERE k.i < k.n),
    bw(id_case, voi, i, m) AS (SELECT id_case, voi, n, CAST(0 AS DOUBLE) FROM kn WHERE i = 1
        UNION ALL SELECT f.id_case, f.voi, f.i, f.d - f.c * b.m FROM bw b JOIN fw f ON f.id_case = b.id_case AND f.voi = b.voi AND f.i = b.i - 1)
    SELECT k.id_case, k.voi, k.x, b.m FROM kn k JOIN bw b ON k.id_case = b.id_case AND k.voi = b.voi AND k.i = b.i)"""


@query("interpolate_spline", _sql(f"""WITH {_W_SQL}, {_SPLINE_SQL} SELECT w.id_case, w.voi, w.idx, CASE WHEN w.value IS NOT NULL THEN w.value
    WHEN w.i0 IS NULL THEN w.v1 WHEN w.i1 IS NULL THEN w.v0
    ELSE (a.m * (w.i1 - w.idx) ** 3 + b.m * (w.idx - w.i0) ** 3) / (6 * (w.i1 - w.i0))
        + (w.v0 / (w.i1 - w.i0) - a.m * (w.i1 - w.i0) / 6) * (w.i1 - w.idx)
        + (w.v1 / (w.i1 - w.i0) - b.m * (w.i1 - w.i0) / 6) * (w.idx - w.i0) END AS value
    FROM iw w LEFT JOIN mm a ON a.id_case = w.id_case AND a.voi = w.voi AND a.x = w.i0
    LEFT JOIN mm b ON b.id_case = w.id_case AND b.voi = w.voi AND b.x = w.i1"""), rounded=("value",))
def q_interpolate_spline(spark, d):
    """Cubic-spline filling of the resampled grid per series."""
    g = W.fill_grid(binned_df(spark, d), ["id_case", "voi"], N_PTS)
    return SP.interpolate_spline(g, ["id_case", "voi"])


@query("case_raw", _sql(f"""WITH {_W_SQL}, top AS (SELECT id_case FROM useful GROUP BY id_case
    ORDER BY count(*) DESC, id_case LIMIT 1) SELECT u.* FROM useful u JOIN top ON u.id_case = top.id_case"""))
def q_case_raw(spark, d):
    """Single-case view (the case with the most measures)."""
    _c, useful, _l = wave_inputs(spark, d)
    top = useful.groupBy("id_case").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "id_case").first()
    return W.case_raw(useful, "id_case", top["id_case"] if top else None)


CASE_POSITION = 3


@query("case_raw_at", _sql(f"""WITH {_W_SQL}, one AS (SELECT DISTINCT id_case FROM useful ORDER BY id_case LIMIT 1 OFFSET {CASE_POSITION})
    SELECT u.* FROM useful u JOIN one ON u.id_case = one.id_case"""))
def q_case_raw_at(spark, d):
    """The measures of the case at a position in the order of case ids."""
    _c, useful, _l = wave_inputs(spark, d)
    return W.case_raw_at(useful, "id_case", CASE_POSITION)


# ----------------------------------------------------------------- tensor binding (embeddings)

_TL = "tensor_long"


def _tl(spark, d):
    return B.tensor_long(spark, d, TENSOR_D)


@query("scale_minmax", _sql("""SELECT "case", outcome, voi, idx, CASE WHEN hi = lo THEN 0.0 ELSE (value - lo) / (hi - lo) END AS value
    FROM (SELECT *, min(value) OVER (PARTITION BY "case", idx) AS lo, max(value) OVER (PARTITION BY "case", idx) AS hi
          FROM tensor_long)""", _TL))
def q_scale_minmax(spark, d):
    """Min-max scaling per grid point across the VOIs."""
    return W.scale(_tl(spark, d), "case", "min_max", "point")


@query("scale_standard", _sql("""SELECT "case", outcome, voi, idx,
    (value - mu) / CASE WHEN sd = 0 THEN 1.0 ELSE sd END AS value
    FROM (SELECT *, avg(value) OVER (PARTITION BY "case", idx) AS mu, stddev_pop(value) OVER (PARTITION BY "case", idx) AS sd
          FROM tensor_long)""", _TL), rounded=('value',))
def q_scale_standard(spark, d):
    """Standardisation per grid point (population std, zero std → 1)."""
    return W.scale(_tl(spark, d), "case", "standard", "point")


@query("wave_slope", _sql("""SELECT "case", voi, regr_slope(value, idx) AS slope, regr_intercept(value, idx) AS intercept
    FROM tensor_long GROUP BY 1, 2""", _TL), rounded=('slope', 'intercept'))
def q_wave_slope(spark, d):
    """Least-squares slope and intercept of each wave."""
    return W.wave_slope(_tl(spark, d), ["case", "voi"])


@query("detrend", _sql("""SELECT "case", outcome, voi, idx,
    value - coalesce(regr_slope(value, idx) OVER (PARTITION BY "case", voi), 0.0) * idx AS value FROM tensor_long""", _TL), rounded=('value',))
def q_detrend(spark, d):
    """Waves minus slope · idx."""
    return W.detrend(_tl(spark, d), ["case", "voi"])


_DFT_SQL = """dft AS (SELECT t."case", t.voi, k.k, count(*) OVER (PARTITION BY t."case", t.voi, k.k) AS n,
    sum(t.value * cos(2 * pi() * k.k * t.idx / nn.n)) OVER (PARTITION BY t."case", t.voi, k.k) AS re,
    sum(t.value * sin(2 * pi() * k.k * t.idx / nn.n)) OVER (PARTITION BY t."case", t.voi, k.k) AS im
    FROM tensor_long t JOIN (SELECT "case", voi, count(*) AS n FROM tensor_long GROUP BY 1, 2) nn
      ON t."case" = nn."case" AND t.voi = nn.voi,
    (SELECT CAST(range AS INTEGER) AS k FROM range(0, 64)) k WHERE k.k < nn.n)"""


@query("spectrum", _sql(f"""WITH {_DFT_SQL} SELECT DISTINCT "case", voi, k, k * (n / 86400.0) / n AS freq,
    sqrt(re * re + im * im) / n AS amplitude FROM dft WHERE k < n // 2""", _TL), rounded=('amplitude',))
def q_spectrum(spark, d):
    """One-sided amplitude spectrum, Fs = n per day."""
    return SP.spectrum(_tl(spark, d), ["case", "voi"])


@query("fft_magnitude", _sql(f"""WITH {_DFT_SQL}, m AS (SELECT DISTINCT "case", voi, k, n, sqrt(re * re + im * im) AS mag FROM dft),
    s AS (SELECT "case", voi, avg(abs(mag)) AS mu, stddev_pop(abs(mag)) AS sd FROM m GROUP BY 1, 2)
    SELECT m."case", m.voi, m.k, m.k * CASE WHEN n // 2 > 1 THEN (1.0 / (2.0 * 0.5)) / (n // 2 - 1) ELSE 0.0 END AS freq,
    CASE WHEN abs(mag) > mu + 2.0 * sd OR abs(mag) < mu - 2.0 * sd THEN 0.0 ELSE mag END AS magnitude
    FROM m JOIN s ON m."case" = s."case" AND m.voi = s.voi WHERE m.k < n // 2""", _TL), rounded=('magnitude',))
def q_fft_magnitude(spark, d):
    """Unscaled |FFT| on the linspace grid, outliers beyond 2 std zeroed."""
    return SP.fft_magnitude(_tl(spark, d), ["case", "voi"], period=0.5, outlier_k=2.0)


@query("zero_outliers", _sql("""SELECT t."case", t.outcome, t.voi, t.idx,
    CASE WHEN abs(value) > mu + 2.0 * sd OR abs(value) < mu - 2.0 * sd THEN 0.0 ELSE value END AS value
    FROM tensor_long t JOIN (SELECT "case", voi, avg(abs(value)) AS mu, stddev_pop(abs(value)) AS sd FROM tensor_long GROUP BY 1, 2) s
    ON t."case" = s."case" AND t.voi = s.voi""", _TL))
def q_zero_outliers(spark, d):
    """Values beyond mean ± 2 population std of |x| per wave set to 0."""
    return SP.zero_outliers(_tl(spark, d), ["case", "voi"], 2.0)


# ----------------------------------------------------------------- inertial binding (events)

def cues_df(spark, d):
    ev = B.table(spark, d, "events")
    return W.resample_cues(ev, "user_id", "event_type", CUE_PERIOD_MS, "ts", "value")


_CUES_SQL = f"""bnd AS (SELECT user_id, min(ts) AS t0, max(ts) AS t1 FROM events GROUP BY user_id),
    ev AS (SELECT e.user_id, e.event_type, e.value,
           CAST(floor((epoch_us(e.ts) - epoch_us(date_trunc('day', b.t0))) / {CUE_PERIOD_MS * 1000})
                - floor((epoch_us(b.t0) - epoch_us(date_trunc('day', b.t0))) / {CUE_PERIOD_MS * 1000}) AS INTEGER) AS idx
           FROM events e JOIN bnd b ON e.user_id = b.user_id),
    rs AS (SELECT user_id, event_type, idx, avg(value) AS value FROM ev GROUP BY 1, 2, 3),
    gr AS (SELECT c.user_id, c.event_type, CAST(t.i AS INTEGER) AS idx,
           epoch_us(date_trunc('day', b.t0)) + (floor((epoch_us(b.t0) - epoch_us(date_trunc('day', b.t0))) / {CUE_PERIOD_MS * 1000}) + t.i) * {CUE_PERIOD_MS * 1000} AS tus
           FROM (SELECT DISTINCT user_id, event_type FROM events) c JOIN bnd b ON c.user_id = b.user_id,
           range(0, 10000) t(i)
           WHERE t.i <= floor((epoch_us(b.t1) - epoch_us(date_trunc('day', b.t0))) / {CUE_PERIOD_MS * 1000})
                        - floor((epoch_us(b.t0) - epoch_us(date_trunc('day', b.t0))) / {CUE_PERIOD_MS * 1000})),
    gv AS (SELECT gr.user_id, gr.event_type, gr.idx, gr.tus, rs.value FROM gr LEFT JOIN rs
           ON gr.user_id = rs.user_id AND gr.event_type = rs.event_type AND gr.idx = rs.idx),
    iw AS (SELECT *,
      last_value(value IGNORE NULLS) OVER (PARTITION BY user_id, event_type ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v0,
      last_value(CASE WHEN value IS NOT NULL THEN idx END IGNORE NULLS) OVER (PARTITION BY user_id, event_type ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS i0,
      first_value(value IGNORE NULLS) OVER (PARTITION BY user_id, event_type ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v1,
      first_value(CASE WHEN value IS NOT NULL THEN idx END IGNORE NULLS) OVER (PARTITION BY user_id, event_type ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS i1
      FROM gv),
    cues AS (SELECT user_id, event_type, idx, make_timestamp(CAST(tus AS BIGINT)) AS t,
      CASE WHEN value IS NOT NULL THEN value WHEN i0 IS NOT NULL AND i1 IS NOT NULL THEN v0 + (v1 - v0) * (idx - i0) / (i1 - i0)
           WHEN i0 IS NOT NULL THEN v0 END AS value FROM iw)"""


@query("resample_cues", f"WITH {_CUES_SQL} SELECT * FROM cues")
def q_resample_cues(spark, d):
    """Per (user, event type) mean per 6 h bin, unlimited time interpolation."""
    return cues_df(spark, d)


@query("local_minima", f"""WITH {_CUES_SQL}, r AS (SELECT *, (epoch_us(t) - epoch_us(min(t) OVER (PARTITION BY user_id, event_type))) / 1e6 AS off
    FROM cues), f AS (SELECT * FROM r WHERE off > {MINIMA_RANGE_S[0]} AND off < {MINIMA_RANGE_S[1]}),
    nb AS (SELECT *, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY t) AS p,
           lead(value) OVER (PARTITION BY user_id, event_type ORDER BY t) AS n FROM f)
    SELECT user_id, event_type, idx, t, value FROM nb WHERE value < p AND value < n""")
def q_local_minima(spark, d):
    """Strict local minima inside (t0 + 2 d, t0 + 25 d) of each resampled cue."""
    return W.local_minima(cues_df(spark, d), ["user_id", "event_type"], *MINIMA_RANGE_S)


@query("fft_cues", f"""WITH {_CUES_SQL}, cz AS (SELECT user_id, event_type, idx, coalesce(value, 0.0) AS v FROM cues),
    nn AS (SELECT user_id, event_type, count(*) AS n FROM cz GROUP BY 1, 2),
    kk AS (SELECT nn.user_id, nn.event_type, nn.n, CAST(t.k AS INTEGER) AS k FROM nn, range(nn.n) t(k)),
    dft AS (SELECT kk.user_id, kk.event_type, kk.k, kk.n,
            sqrt(pow(sum(c.v * cos(2 * pi() * kk.k * c.idx / kk.n)), 2) + pow(sum(c.v * sin(2 * pi() * kk.k * c.idx / kk.n)), 2)) AS mag
            FROM kk JOIN cz c ON c.user_id = kk.user_id AND c.event_type = kk.event_type GROUP BY 1, 2, 3, 4),
    st AS (SELECT user_id, event_type, avg(abs(mag)) AS mu, stddev_pop(abs(mag)) AS sd FROM dft GROUP BY 1, 2)
    SELECT d.user_id, d.event_type, d.k,
        CASE WHEN d.n // 2 > 1 AND d.k = d.n // 2 - 1 THEN CAST(1.0 AS DOUBLE) / (2.0 * {CUE_PERIOD_MS / 1000.0})
             WHEN d.n // 2 > 1 THEN d.k * ((CAST(1.0 AS DOUBLE) / (2.0 * {CUE_PERIOD_MS / 1000.0})) / (d.n // 2 - 1)) ELSE 0.0 END AS freq,
        CASE WHEN d.mag > st.mu + 20.0 * st.sd OR d.mag < st.mu - 20.0 * st.sd THEN 0.0 ELSE d.mag END AS magnitude
    FROM dft d JOIN st ON d.user_id = st.user_id AND d.event_type = st.event_type WHERE d.k < d.n // 2""", rounded=('magnitude',))
def q_fft_cues(spark, d):
    """W13/W14 on the resampled cues: numpy FFT per series (long-series path),
    outliers beyond 20 std zeroed, linspace frequency grid."""
    cues = cues_df(spark, d).withColumn("value", F.coalesce("value", F.lit(0.0)))
    return SP.fft_magnitude_long(cues, ["user_id", "event_type"], CUE_PERIOD_MS / 1000.0, 20.0)


_FS = 1000.0 / CUE_PERIOD_MS
_CUT = {c: _FS / f for c, f in [("click", 8), ("view", 8), ("error", 6), ("purchase", 5), ("signup", 4)]}


def _lowpass_sql():
    """The filter sample by sample (transposed direct form, five state numbers)."""
    rows = []
    for c, cut in _CUT.items():
        b, a = SP.butter_lowpass(5, cut, _FS)
        rows.append(f"('{c}', " + ", ".join(f"CAST('{x!r}' AS DOUBLE)" for x in [*map(float, b), *map(float, a[1:])]) + ")")
    names = ", ".join([*[f"b{i}" for i in range(6)], *[f"a{i}" for i in range(1, 6)]])
    nxt = ", ".join(f"k.b{i} * x.v + {f'f.z{i + 1}' if i < 5 else '0.0'} - k.a{i} * (k.b0 * x.v + f.z1) AS z{i}" for i in range(1, 6))
    first = ", ".join(f"k.b{i} * x.v - k.a{i} * (k.b0 * x.v) AS z{i}" for i in range(1, 6))
    return f"""WITH RECURSIVE {_CUES_SQL},
    x AS MATERIALIZED (SELECT user_id, event_type, idx, coalesce(value, 0.0) AS v FROM cues),
    k(event_type, {names}) AS (VALUES {", ".join(rows)}),
    f AS (SELECT x.user_id, x.event_type, x.idx, k.b0 * x.v AS value, {first} FROM x JOIN k ON x.event_type = k.event_type WHERE x.idx = 0
          UNION ALL
          SELECT x.user_id, x.event_type, x.idx, k.b0 * x.v + f.z1, {nxt}
          FROM f JOIN x ON x.user_id = f.user_id AND x.event_type = f.event_type AND x.idx = f.idx + 1 JOIN k ON x.event_type = k.event_type)
    SELECT user_id, event_type, idx, value FROM f"""


@query("lowpass", _lowpass_sql(), rounded=("value",))
def q_lowpass(spark, d):
    """Order-5 Butterworth low-pass per resampled cue."""
    cues = cues_df(spark, d).withColumn("value", F.coalesce("value", F.lit(0.0)))
    return SP.lowpass(cues, ["user_id", "event_type"], "event_type", _CUT, _FS, 5)


# ----------------------------------------------------------------- covariance (tensor binding)

def _cov(spark, d, method):
    return CV.covariance(_tl(spark, d), "case", method, vois=list(range(TENSOR_D)))


_COV_SQL = """pairs AS (SELECT a."case", a.voi AS i, b.voi AS j, a.value AS xi, b.value AS xj FROM tensor_long a
    JOIN tensor_long b ON a."case" = b."case" AND a.idx = b.idx WHERE a.voi >= b.voi),
    scm AS (SELECT "case", i, j, covar_pop(xi, xj) AS cov FROM pairs GROUP BY 1, 2, 3),
    mom AS (SELECT "case", sum(CASE WHEN i = j THEN cov END) AS tr,
            sum(CASE WHEN i = j THEN 1.0 ELSE 2.0 END * cov * cov) AS fro2, count(CASE WHEN i = j THEN 1 END) AS d
            FROM scm GROUP BY 1),
    mu AS (SELECT "case", voi, avg(value) AS m FROM tensor_long GROUP BY 1, 2),
    q AS (SELECT t."case", t.idx, sum((t.value - mu.m) * (t.value - mu.m)) AS q FROM tensor_long t
          JOIN mu ON t."case" = mu."case" AND t.voi = mu.voi GROUP BY 1, 2),
    q4 AS (SELECT "case", sum(q * q) AS q4, count(*) AS n FROM q GROUP BY 1),
    mm AS (SELECT mom.*, q4.q4, q4.n FROM mom JOIN q4 ON mom."case" = q4."case")"""


@query("cov_scm", _sql(f"WITH {_COV_SQL} SELECT * FROM scm", _TL), rounded=('cov',))
def q_cov_scm(spark, d):
    """V1: empirical covariance per case (lower triangle)."""
    return _cov(spark, d, "scm")


@query("cov_oas", _sql(f"""WITH {_COV_SQL}, r AS (SELECT "case", tr / d AS m,
    CASE WHEN (n + 1.0) * (fro2 - tr * tr / d) = 0 THEN 1.0
         ELSE least(1.0, (fro2 + tr * tr) / ((n + 1.0) * (fro2 - tr * tr / d))) END AS shrinkage FROM mm)
    SELECT s."case", s.i, s.j, CASE WHEN s.i = s.j THEN (1.0 - r.shrinkage) * s.cov + r.shrinkage * r.m
        ELSE (1.0 - r.shrinkage) * s.cov END AS cov, r.shrinkage FROM scm s JOIN r ON s."case" = r."case\"""", _TL), rounded=('cov', 'shrinkage'))
def q_cov_oas(spark, d):
    """V3: oracle approximating shrinkage covariance per case."""
    return _cov(spark, d, "oas")


@query("cov_lwf", _sql(f"""WITH {_COV_SQL}, r0 AS (SELECT "case", tr / d AS m,
    least((q4 / n - fro2) / (d * n), (fro2 - 2.0 * (tr / d) * tr + d * (tr / d) * (tr / d)) / d) AS beta,
    (fro2 - 2.0 * (tr / d) * tr + d * (tr / d) * (tr / d)) / d AS delta FROM mm),
    r AS (SELECT "case", m, CASE WHEN beta = 0 THEN 0.0 ELSE beta / delta END AS shrinkage FROM r0)
    SELECT s."case", s.i, s.j, CASE WHEN s.i = s.j THEN (1.0 - r.shrinkage) * s.cov + r.shrinkage * r.m
        ELSE (1.0 - r.shrinkage) * s.cov END AS cov, r.shrinkage FROM scm s JOIN r ON s."case" = r."case\"""", _TL), rounded=('cov', 'shrinkage'))
def q_cov_lwf(spark, d):
    """V2: Ledoit-Wolf shrinkage covariance per case."""
    return _cov(spark, d, "lwf")


@query("cov_diag", _sql(f"""WITH {_COV_SQL} SELECT "case", """ + ", ".join(
    f"max(CASE WHEN i = j AND i = {k} THEN cov END) AS var_{k}" for k in range(TENSOR_D))
    + " FROM scm WHERE i = j GROUP BY 1", _TL), rounded=('var_0', 'var_1', 'var_2', 'var_3'))
def q_cov_diag(spark, d):
    """V4: variances only, one column per VOI."""
    return CV.cov_diag(_cov(spark, d, "scm"), TENSOR_D)


@query("cov_vech", _sql(f"""WITH {_COV_SQL} SELECT "case", list(round(cov, {ARRAY_DIGITS}) ORDER BY j, i) AS vech
    FROM scm GROUP BY 1""", _TL))
def q_cov_vech(spark, d):
    """V5: half-vectorised lower triangle, column by column."""
    v = CV.cov_vech(_cov(spark, d, "scm"))
    return v.withColumn("vech", F.transform("vech", lambda x: F.round(x, ARRAY_DIGITS)))


@query("mean_cov_euclid", _sql(f"""WITH {_COV_SQL}, oc AS (SELECT DISTINCT "case", outcome FROM tensor_long)
    SELECT oc.outcome, s.i, s.j, avg(s.cov) AS mean_cov FROM scm s JOIN oc ON s."case" = oc."case" GROUP BY 1, 2, 3""", _TL), rounded=('mean_cov',))
def q_mean_cov_euclid(spark, d):
    """V6 (euclid): class mean covariance per outcome."""
    cases = _tl(spark, d).select("case", "outcome").distinct()
    return CV.mean_cov_euclid_long(_cov(spark, d, "scm"), cases, "outcome")


@query("mean_cov_riemann")
def q_mean_cov_riemann(spark, d):
    """V6 (rows only): affine-invariant class mean covariance per outcome."""
    tl = _tl(spark, d)
    flat = CV.to_flat(_cov(spark, d, "oas"), TENSOR_D).join(tl.select("case", "outcome").distinct(), "case")
    return CV.mean_cov_riemann(flat, "outcome", TENSOR_D)


@query("mean_cov_logeuclid")
def q_mean_cov_logeuclid(spark, d):
    """V6 (rows only): log-Euclidean class mean covariance per outcome."""
    tl = _tl(spark, d)
    flat = CV.to_flat(_cov(spark, d, "oas"), TENSOR_D).join(tl.select("case", "outcome").distinct(), "case")
    return CV.mean_cov_riemann(flat, "outcome", TENSOR_D, metric="logeuclid")


@query("sample_per_class", _sql("""SELECT "case", outcome FROM (SELECT *, row_number() OVER (PARTITION BY outcome
    ORDER BY md5(CAST("case" AS VARCHAR) || '42')) AS r FROM (SELECT DISTINCT "case", outcome FROM tensor_long)) WHERE r <= 4""", _TL))
def q_sample_per_class(spark, d):
    """V7: 4 pseudo-random cases per class (md5 order, seed 42)."""
    cases = _tl(spark, d).select("case", "outcome").distinct()
    return CV.sample_per_class(cases, "outcome", "case", 4, 42)
