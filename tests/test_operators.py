"""Hand-made frames for the traps of the survey (§2, §5): strict vs
inclusive limits, the 30-point gap rule, column-wise scaling, sentinels,
duplicate pivot cells, and the properties of spectra, covariances, splits."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavecohort.functions import keys as K
from wavecohort.functions import voi as V
from wavecohort.operators import aggregates as A
from wavecohort.operators import cohort as C
from wavecohort.operators import covariance as CV
from wavecohort.operators import evaluate as E
from wavecohort.operators import ranking as T
from wavecohort.operators import score as P
from wavecohort.operators import series as W
from wavecohort.operators import spectral as SP


def ts(s):
    return dt.datetime.fromisoformat(s)


# ---------------------------------------------------------------- keys

def test_case_id_pads_and_truncates(spark):
    df = spark.createDataFrame([(42, ts("2024-01-02 10:00:00")), (12345678901, ts("2024-01-03 00:00:00"))],
                               "id long, t timestamp_ntz")
    out = [r[0] for r in df.select(K.case_id("id", "t")).collect()]
    assert out == ["00000000422024-01-02", "12345678902024-01-03"]


def test_split_case_id_round_trip(spark):
    df = spark.createDataFrame([("00000000422024-01-02",)], "c string")
    a, b = K.split_case_id("c")
    c, d = K.split_case_id_fixed("c")
    assert df.select(a, b, c, d).first() == ("0000000042", "2024-01-02", "0000000042", "2024-01-02")


def test_strip_form_is_greedy(spark):
    df = spark.createDataFrame([("a_b_c",)], "k string")
    assert df.select(K.strip_form("k")).first()[0] == "a_b"


def test_outcome_sentinels(spark):
    df = spark.createDataFrame([("None",), (None,), ("2024-01-01 00:00:00",)], "d string")
    assert [r[0] for r in df.select(K.outcome("d")).collect()] == [False, False, True]
    assert df.select(K.to_ts("d")).collect()[0][0] is None


def test_url_unquote_like_unquote(spark):
    df = spark.createDataFrame([("a%20b",), ("a+b",), ("%zz%C3%A9",), ("100%",)], "u string")
    assert [r[0] for r in df.select(K.url_unquote("u")).collect()] == ["a b", "a+b", "%zzé", "100%"]


def test_form_fields_like_wildcard(spark):
    df = spark.createDataFrame([("int_esc1",), ("intXesc2",), ("int_igs2",), ("other",)], "f string")
    got = [r[0] for r in df.filter(K.form_fields("f", ["int_esc"], ["int_igs2"])).collect()]
    assert got == ["int_esc1", "intXesc2", "int_igs2"]  # '_' matches any character in LIKE


def test_voi_codes_union_sorted(spark):
    dic = V.dictionary(spark)
    assert V.voi_codes(dic, ["ABPS", "HR"]).first()[0] == [11, 14, 10102, 10280, 10281]
    assert V.voi_codes(dic, ["nope"]).first()[0] is None


def test_voi_label_unknown_raises(spark):
    dic = V.dictionary(spark)
    ok = V.voi_label(dic, spark.createDataFrame([("HR",)], "voi string")).first()["label"]
    assert ok == "Heart rate"
    with pytest.raises(Exception):
        V.voi_label(dic, spark.createDataFrame([("XX",)], "voi string")).collect()


# ---------------------------------------------------------------- cohort filters

def _vstats(spark, rows):
    return spark.createDataFrame(rows, "id_nda long, dt_deb date, voi string, n_voi long, voi_min timestamp_ntz, "
                                       "voi_max timestamp_ntz")


def test_min_points_is_strict_and_bt_optional(spark):
    d = dt.date(2024, 1, 1)
    t0, t1 = ts("2024-01-01 00:00:00"), ts("2024-01-02 00:00:00")
    rows = [(1, d, "HR", 10, t0, t1), (1, d, "RR", 11, t0, t1),
            (2, d, "HR", 11, t0, t1), (2, d, "RR", 11, t0, t1)]
    vs = _vstats(spark, rows)
    got = sorted(r.id_nda for r in C.require_min_points(vs, ["HR", "RR", "BT"], 10).collect())
    assert got == [2]
    s = C.case_summary(vs, ["HR", "RR", "BT"], 10).filter("id_nda = 1").first()
    assert s["_n_req"] == 2 and s["_n_pass"] == 1


def test_common_window_and_stay_filter_inclusive(spark):
    d = dt.date(2024, 1, 1)
    rows = [(1, d, "HR", 5, ts("2024-01-01 02:00:00"), ts("2024-01-01 22:00:00")),
            (1, d, "RR", 5, ts("2024-01-01 00:00:00"), ts("2024-01-01 23:00:00"))]
    w = C.voi_window(_vstats(spark, rows), ["HR", "RR"]).first()
    assert (w.dt_min, w.dt_max, w.stay_len_s) == (ts("2024-01-01 02:00:00"), ts("2024-01-01 22:00:00"), 72000)
    cases = spark.createDataFrame([(1, d)], "id_nda long, dt_deb date")
    assert C.filter_stay(cases, C.voi_window(_vstats(spark, rows), ["HR", "RR"]), 20).count() == 1


def test_true_death_start_strict_end_inclusive(spark):
    cases = spark.createDataFrame([("0000000001", dt.date(2024, 1, 1), ts("2024-01-01 00:00:00")),
                                   ("0000000002", dt.date(2024, 1, 1), ts("2024-01-05 00:00:00"))],
                                  "id_nda string, j1 date, dt_deces timestamp_ntz")
    nda = spark.createDataFrame([(1, ts("2024-01-01 00:00:00"), ts("2024-01-05 00:00:00")),
                                 (2, ts("2024-01-01 00:00:00"), ts("2024-01-05 00:00:00"))],
                                "id_nda long, dt_deb_nda timestamp_ntz, dt_fin_nda timestamp_ntz")
    from wavecohort.operators.joins import true_death
    assert [r.id_nda for r in true_death(cases, nda).collect()] == ["0000000002"]
    adj = {r.id_nda: r.dt_deces for r in C.adjust_outcome(cases, true_death(cases, nda)).collect()}
    assert adj == {"0000000001": None, "0000000002": ts("2024-01-05 00:00:00")}


def test_anti_join_drops_null_keys(spark):
    from wavecohort.operators.joins import anti
    a = spark.createDataFrame([(1,), (2,), (None,)], "k long")
    b = spark.createDataFrame([(2,), (None,)], "k long")
    assert sorted(r.k for r in anti(a, b, "k").collect()) == [1]


# ---------------------------------------------------------------- aggregates

def test_outcome_rate_both_definitions(spark):
    df = spark.createDataFrame([(True,), (False,), (False,), (False,)], "dead boolean")
    r = A.outcome_rate(df, "dead").first()
    assert (r.rate, r.odds) == (25.0, pytest.approx(100.0 / 3))


def test_histogram_strict_limits_and_closed_last_bin(spark):
    df = spark.createDataFrame([(float(x), 0.0, 10.0) for x in [0, 1, 2, 5, 9, 10]], "x double, lo double, hi double")
    h = A.histogram(df, "x", bins=4, lo="lo", hi="hi", strict=True).orderBy("bin").collect()
    assert sum(r.n for r in h) == 4            # 0 and 10 are excluded (strict)
    assert h[-1].bin == 3 and h[-1].n == 1     # the max (9) lands in the closed last bin, not a 5th


def test_coverage_sweep_one_pass(spark):
    df = spark.createDataFrame([(5, 20), (30, 40), (60, 70)], "HR long, RR long")
    got = {r.nb_pts: r.n_cases for r in A.coverage_sweep(df, ["HR", "RR"], [0, 10, 50]).collect()}
    assert got == {0: 3, 10: 2, 50: 1}


def test_group_count(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "c string")
    got = sorted((r.c or "", r.C_c) for r in A.group_count(df, "c").collect())
    assert got == [("", 1), ("a", 2), ("a", 2), ("b", 1)]


# ---------------------------------------------------------------- top-k

def test_top_pages_window_and_ties(spark):
    rows = [("0119", 12, "en", "p1", 5), ("0119", 13, "en", "p1", 5), ("0120", 12, "en", "p2", 10),
            ("0120", 13, "en", "p3", 100), ("0118", 20, "en", "p4", 100), ("0119", 14, "en", "p0", 5)]
    df = spark.createDataFrame(rows, "month_day string, hour int, prj string, page string, hits long")
    got = [(r.page, r.sum_hits) for r in T.top_pages(df, "0120", "0119", 13, k=3).collect()]
    assert got == [("p2", 10), ("p0", 5), ("p1", 5)]
    got30 = [r.page for r in T.top_pages(df, "0120", "0117", 13, k=10, full_days=True).collect()]
    assert got30[0] == "p4" and "p3" not in got30


# ---------------------------------------------------------------- waves

def _grid(spark, vals):
    return spark.createDataFrame([("c", "v", i, v) for i, v in enumerate(vals)], "id_case string, voi string, idx int, value double")


def test_interpolate_gap_rule(spark):
    vals = [None, 1.0] + [None] * 39 + [41.0, None, None]
    out = [r.value for r in W.interpolate(_grid(spark, vals), ["id_case", "voi"], 30).orderBy("idx").collect()]
    assert out[0] == 1.0                        # leading gap: backward fill
    assert out[2] == pytest.approx(2.0)         # on the line
    assert out[31] == pytest.approx(31.0)       # 30th point of the gap
    assert out[35] == pytest.approx(31.0)       # beyond 30: holds the 30th value
    assert out[-1] == 41.0                      # trailing gap: last value
    lo, hi = min(v for v in vals if v is not None), max(v for v in vals if v is not None)
    assert all(lo <= v <= hi for v in out)


def test_blocked_interpolation_equals_whole_series(spark):
    rng = np.random.default_rng(11)
    rows = []
    for sid in range(3):
        for i in range(200):
            v = float(rng.normal()) if rng.random() < (0.05 if sid == 2 else 0.3) else None
            rows.append((f"c{sid}", "v", i, v))
    rows[0] = ("c0", "v", 0, None)
    df = spark.createDataFrame(rows, "id_case string, voi string, idx int, value double")
    for limit, fill in [(30, True), (None, False), (3, True)]:
        a = {(r.id_case, r.idx): r.value for r in W.interpolate(df, ["id_case", "voi"], limit, fill).collect()}
        b = {(r.id_case, r.idx): r.value for r in W.interpolate(df, ["id_case", "voi"], limit, fill, block=7).collect()}
        assert a.keys() == b.keys()
        assert all((a[k] is None and b[k] is None) or a[k] == pytest.approx(b[k]) for k in a)


def test_resample_midnight_origin_and_trailing_drop(spark):
    rows = [("c", "v", ts("2024-01-01 00:50:00"), 1.0), ("c", "v", ts("2024-01-01 01:10:00"), 3.0),
            ("c", "v", ts("2024-01-01 01:20:00"), 5.0), ("c", "v", ts("2024-01-01 05:00:00"), 7.0)]
    df = spark.createDataFrame(rows, "id_case string, voi string, dt_insert timestamp_ntz, value_numeric double")
    df = df.withColumn("step", F.lit(30))
    got = {r.idx: r.value for r in W.resample(df, ["id_case", "voi"], "step", 4).collect()}
    assert got == {0: 1.0, 1: 4.0}              # bins 00:30, 01:00; 05:00 is beyond 4 bins


def test_grid_step_half_even(spark):
    df = spark.createDataFrame([(ts("2024-01-01 00:00:00"), ts("2024-01-01 00:25:00"))], "dt_min timestamp_ntz, dt_max timestamp_ntz")
    assert df.select(W.grid_step(df, 10)).first()[0] == 2          # 2.5 → 2
    assert df.select(W.grid_step(df, 100)).first()[0] == 1         # floor of one minute


def test_scale_is_per_point_across_vois(spark):
    rows = [("c", "a", 0, 1.0), ("c", "b", 0, 3.0), ("c", "a", 1, 5.0), ("c", "b", 1, 5.0)]
    df = spark.createDataFrame(rows, "case string, voi string, idx int, value double")
    got = {(r.voi, r.idx): r.value for r in W.scale(df, "case", "min_max").collect()}
    assert got == {("a", 0): 0.0, ("b", 0): 1.0, ("a", 1): 0.0, ("b", 1): 0.0}
    st = {(r.voi, r.idx): r.value for r in W.scale(df, "case", "standard").collect()}
    assert st[("a", 0)] == pytest.approx(-1.0) and st[("a", 1)] == 0.0


def test_detrend_removes_slope_keeps_intercept(spark):
    df = _grid(spark, [3.0 + 2.0 * i + (0.5 if i % 2 else -0.5) for i in range(20)])
    d = W.detrend(df, ["id_case", "voi"])
    s = W.wave_slope(d, ["id_case", "voi"]).first()
    assert abs(s.slope) < 1e-9 and s.intercept == pytest.approx(3.0, abs=0.1)


def test_local_minima_strict_inside_range(spark):
    base = ts("2024-01-01 00:00:00")
    vals = [5, 1, 5, 4, 4, 5, 2, 5, 0, 5]
    rows = [("r", base + dt.timedelta(seconds=i), float(v)) for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "rec string, t timestamp_ntz, value double")
    got = [r.value for r in W.local_minima(df, ["rec"], 0.5, 8.5, on_grid=False).orderBy("t").collect()]
    grid = spark.createDataFrame([("r", i, base + dt.timedelta(seconds=i), float(v)) for i, v in enumerate(vals)],
                                 "rec string, idx int, t timestamp_ntz, value double")
    assert [r.value for r in W.local_minima(grid, ["rec"], 0.5, 8.5).orderBy("t").collect()] == [2.0]
    # range first: t=1 (1.0) and t=8 (0.0) become edges; the 4,4 plateau is not strict
    assert got == [2.0]


def test_waves_drop_case_missing_a_voi(spark):
    m = spark.createDataFrame([("c1", 1, ts("2024-01-01 00:00:00"), 5.0), ("c1", 2, ts("2024-01-01 00:00:00"), 50.0),
                               ("c2", 1, ts("2024-01-01 00:00:00"), 5.0), ("c2", 2, ts("2024-01-01 00:00:00"), 500.0)],
                              "id_case string, id_measure_type int, dt_insert timestamp_ntz, value_numeric double")
    vc = spark.createDataFrame([("A", 1), ("B", 2)], "voi string, code int")
    lim = spark.createDataFrame([("A", 5.0, 6.0), ("B", 0.0, 50.0)], "voi string, min_limit double, max_limit double")
    got = sorted({r.id_case for r in W.waves_from_measures(m, vc, lim, "id_case", ["A", "B"]).collect()})
    assert got == ["c1"]                        # limits inclusive; c2 loses all of B


# ---------------------------------------------------------------- spectra and filters

def test_spectrum_matches_numpy_fft(spark):
    x = np.sin(np.arange(16) * 2 * np.pi * 3 / 16) + 0.3 * np.arange(16) / 16
    df = _grid(spark, [float(v) for v in x])
    amp = [r.amplitude for r in SP.spectrum(df, ["id_case", "voi"]).orderBy("k").collect()]
    ref = np.abs(np.fft.fft(x))[:8] / 16
    assert np.allclose(amp, ref)
    mag = [r.magnitude for r in SP.fft_magnitude(df, ["id_case", "voi"], 0.5, None).orderBy("k").collect()]
    assert np.allclose(mag, np.abs(np.fft.fft(x))[:8])
    # Parseval on the full spectrum
    assert np.isclose(np.sum(np.abs(np.fft.fft(x)) ** 2) / 16, np.sum(x ** 2))


def test_fft_long_path_matches_native(spark):
    rng = np.random.default_rng(5)
    df = _grid(spark, [float(v) for v in rng.normal(size=40)])
    a = [(r.k, r.freq, r.magnitude) for r in SP.fft_magnitude(df, ["id_case", "voi"], 0.25, 2.0).orderBy("k").collect()]
    b = [(r.k, r.freq, r.magnitude) for r in SP.fft_magnitude_long(df, ["id_case", "voi"], 0.25, 2.0).orderBy("k").collect()]
    assert len(a) == len(b) == 20
    assert np.allclose(np.array(a), np.array(b))


def recursion(b, a, x):
    """The filter's definition, sample by sample."""
    y = np.zeros(len(x))
    for t in range(len(x)):
        y[t] = (sum(b[i] * x[t - i] for i in range(min(len(b), t + 1)))
                - sum(a[i] * y[t - i] for i in range(1, min(len(a), t + 1)))) / a[0]
    return y


def test_fft_long_path_of_prime_and_composite_lengths(spark):
    rng = np.random.default_rng(6)
    for n in (1, 2, 37, 360):
        x = rng.normal(size=n)
        got = [r.magnitude for r in SP.fft_magnitude_long(_grid(spark, x.tolist()), ["id_case", "voi"], 0.5, None).orderBy("k").collect()]
        assert np.allclose(got, np.abs(np.fft.fft(x))[:n // 2])


def test_lowpass_in_blocks_equals_the_recursion(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=530)
    df = _grid(spark, x.tolist()).withColumn("voi", F.lit("g_x")).repartition(3)
    b, a = SP.butter_lowpass(5, 5.0, 125.0)
    want = recursion(b, a, x)
    for block in (64, 256, 1000):
        got = [r.value for r in SP.lowpass(df, ["id_case", "voi"], "voi", {"g_x": 5.0}, 125.0, block=block).orderBy("idx").collect()]
        assert np.allclose(got, want, atol=1e-9)
    other = SP.lowpass(df, ["id_case", "voi"], "voi", {"a_x": 5.0}, 125.0).orderBy("idx").collect()
    assert np.allclose([r.value for r in other], x)


def test_butterworth_gain_and_constant_input():
    b, a = SP.butter_lowpass(5, 5.0, 125.0)
    z = np.exp(1j * 2 * np.pi * 5.0 / 125.0)
    gain = abs(np.polyval(b[::-1], 1 / z) / np.polyval(a[::-1], 1 / z))
    assert gain == pytest.approx(1 / math.sqrt(2), rel=1e-6)
    assert np.all(np.abs(np.roots(a)) < 1)
    y = recursion(b, a, np.ones(400))
    assert y[-1] == pytest.approx(1.0, rel=1e-6)


def test_lowpass_and_spline_run_per_series(spark):
    df = _grid(spark, [1.0] * 50).withColumn("voi", F.lit("g_x"))
    out = [r.value for r in SP.lowpass(df, ["id_case", "voi"], "voi", {"g_x": 5.0}, 125.0).orderBy("idx").collect()]
    assert len(out) == 50 and out[-1] == pytest.approx(1.0, abs=0.05)
    g = _grid(spark, [0.0, None, 4.0, None, 16.0])
    sp = [r.value for r in SP.interpolate_spline(g, ["id_case", "voi"]).orderBy("idx").collect()]
    assert sp[0] == 0.0 and sp[2] == 4.0 and 0.0 < sp[1] < 4.0


def natural_cubic(xk, yk, x):
    """Second derivatives by a dense solve of the spline's equations."""
    n, h = len(xk), np.diff(xk)
    a, r = np.eye(n), np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1:i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        r[i] = 6 * ((yk[i + 1] - yk[i]) / h[i] - (yk[i] - yk[i - 1]) / h[i - 1])
    m = np.linalg.solve(a, r)
    j = np.clip(np.searchsorted(xk, x, side="right") - 1, 0, n - 2)
    u, w = xk[j + 1] - x, x - xk[j]
    return (m[j] * u ** 3 + m[j + 1] * w ** 3) / (6 * h[j]) + (yk[j] / h[j] - m[j] * h[j] / 6) * u + (yk[j + 1] / h[j] - m[j + 1] * h[j] / 6) * w


def test_spline_equals_a_dense_solve(spark):
    rng = np.random.default_rng(9)
    for n, share in ((96, 0.4), (96, 0.05), (10, 1.0), (7, 0.0)):
        y = np.where(rng.random(n) < share, rng.normal(size=n), np.nan)
        k = np.flatnonzero(~np.isnan(y))
        got = [r.value for r in SP.interpolate_spline(_grid(spark, [None if np.isnan(x) else float(x) for x in y]), ["id_case", "voi"])
               .orderBy("idx").collect()]
        if len(k) == 0:
            assert got == [None] * n
            continue
        want = y.copy()
        inside = np.arange(k[0], k[-1] + 1)
        if len(k) > 1:
            want[inside] = natural_cubic(k.astype(float), y[k], inside.astype(float))
        want[:k[0]], want[k[-1]:] = y[k[0]], y[k[-1]]
        assert np.allclose(got, want, atol=1e-9)


# ---------------------------------------------------------------- covariance

def _tensor(spark, n_cases=6, d=3, n=20, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(c, c % 2 == 0, i, t, float(rng.normal())) for c in range(n_cases) for i in range(d) for t in range(n)]
    return spark.createDataFrame(rows, "case long, outcome boolean, voi int, idx int, value double")


def _np_cases(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.case, {})[(r.voi, r.idx)] = r.value
    return {c: np.array([[v[(i, t)] for t in range(20)] for i in range(3)]) for c, v in out.items()}


def test_covariances_match_formulas(spark):
    df = _tensor(spark)
    X = _np_cases(df)
    for method in ("scm", "oas", "lwf"):
        got = {}
        for r in CV.covariance(df, "case", method, full=True).collect():
            got.setdefault(r.case, np.zeros((3, 3)))[r.i, r.j] = r.cov
        for c, x in X.items():
            xc = x - x.mean(axis=1, keepdims=True)
            s = xc @ xc.T / x.shape[1]
            if method == "scm":
                ref = s
            else:
                d, n, tr, fro2, mu = 3, x.shape[1], np.trace(s), np.sum(s * s), np.trace(s) / 3
                if method == "oas":
                    rho = min(1.0, (fro2 + tr ** 2) / ((n + 1) * (fro2 - tr ** 2 / d)))
                else:
                    q4 = np.sum(np.sum(xc ** 2, axis=0) ** 2)
                    delta = (fro2 - 2 * mu * tr + d * mu ** 2) / d
                    beta = min((q4 / n - fro2) / (d * n), delta)
                    rho = beta / delta
                ref = (1 - rho) * s + rho * mu * np.eye(3)
            assert np.allclose(got[c], ref)
            assert np.allclose(got[c], got[c].T) and np.all(np.linalg.eigvalsh(got[c]) >= -1e-12)


def test_vech_order(spark):
    rows = [(0, i, j, float(10 * i + j)) for i in range(3) for j in range(3) if i >= j]
    cov = spark.createDataFrame(rows, "case long, i int, j int, cov double")
    assert CV.cov_vech(cov).first().vech == [0.0, 10.0, 20.0, 11.0, 21.0, 22.0]


def test_riemann_mean_of_commuting_matrices(spark):
    rng = np.random.default_rng(3)
    mats = [np.diag(rng.uniform(0.5, 3.0, 3)) for _ in range(5)]
    flat = spark.createDataFrame([(0, [float(v) for v in m.ravel()]) for m in mats], "cls int, cov array<double>")
    got = np.array(CV.mean_cov_riemann(flat, "cls", 3).first().mean_cov).reshape(3, 3)
    ref = np.diag(np.exp(np.mean([np.log(np.diag(m)) for m in mats], axis=0)))
    assert np.allclose(got, ref, atol=1e-7)
    le = np.array(CV.mean_cov_riemann(flat, "cls", 3, metric="logeuclid").first().mean_cov).reshape(3, 3)
    assert np.allclose(le, ref, atol=1e-7)


def test_sample_per_class_exact_top_k(spark):
    df = spark.createDataFrame([(i, i % 3 == 0) for i in range(300)], "id long, cls boolean")
    got = CV.sample_per_class(df, "cls", "id", 4, 42, salts=7).collect()
    ref = CV.sample_per_class(df, "cls", "id", 4, 42, salts=1).collect()
    assert sorted(got) == sorted(ref) and len(got) == 8


# ---------------------------------------------------------------- forms and score

def test_form_matrix_duplicate_cell_raises(spark):
    ans = spark.createDataFrame([(1, "0000000001", "a", "3"), (1, "0000000001", "a", "4")],
                                "id_form long, id_nda string, champ_formulaire string, value_field string")
    dates = spark.createDataFrame([(1, ts("2024-01-01 00:00:00"))], "id_form long, dt_ins timestamp_ntz")
    with pytest.raises(Exception):
        P.form_matrix(ans, dates, ["a"]).collect()


def test_saps2_probability_and_strict_alarm(spark):
    df = spark.createDataFrame([(15.0,), (16.0,)], "s double")
    r = df.select(P.saps2_prob("s").alias("p"), P.saps2_alarm(P.saps2_prob("s")).alias("a")).collect()
    lg = -7.7631 + 0.0737 * 16 + 0.9971 * math.log(17)
    assert r[1].p == pytest.approx(math.exp(lg) / (1 + math.exp(lg)))
    assert [x.a for x in r] == [False, True]


def test_label_encode_string_order_and_unknown(spark):
    cats = spark.createDataFrame([("v", "w2", "2", 1), ("v", "w10", "10", 2), ("v", "w7", "7", 3)],
                                 "PARENT string, LID string, saps2weight string, index int")
    df = spark.createDataFrame([("v", 2), ("v", 10), ("v", 7)], "var string, w int")
    got = {r.w: r.code for r in P.label_encode(df, cats, "var", "w").collect()}
    assert got == {10: 0, 2: 1, 7: 2}           # "10" < "2" < "7"
    with pytest.raises(Exception):
        P.label_encode(spark.createDataFrame([("v", 3)], "var string, w int"), cats, "var", "w").collect()


# ---------------------------------------------------------------- split and metrics

def test_stratified_folds_disjoint_complete_balanced(spark):
    df = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(301)], "id long, y int")
    f = E.stratified_split(df, "y", "id", 3, 42).collect()
    assert sorted(r.id for r in f) == list(range(301))
    for y in (0, 1):
        sizes = [sum(1 for r in f if r.y == y and r.fold == k) for k in range(3)]
        assert max(sizes) - min(sizes) <= 1


def test_auc_ties_and_negation(spark):
    rows = [(1, 0.9), (0, 0.9), (1, 0.7), (0, 0.3), (1, 0.3), (0, 0.1)]
    df = spark.createDataFrame(rows, "y int, s double")
    auc = E.roc_auc(df, "y", "s").first().auc
    pos = [s for y, s in rows if y]
    neg = [s for y, s in rows if not y]
    ref = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert auc == pytest.approx(ref)
    neg_auc = E.roc_auc(df.withColumn("s", -F.col("s")), "y", "s").first().auc
    assert neg_auc == pytest.approx(1 - ref)
    roc = E.roc_curve(df, "y", "s").orderBy(F.desc("threshold")).collect()
    assert (roc[-1].fpr, roc[-1].tpr) == (1.0, 1.0)
    assert E.alarm_point(E.roc_curve(df, "y", "s"), 0.5).first().threshold == 0.7
    assert E.alarm_point(E.roc_curve(df, "y", "s"), 0.7).first().threshold == 0.7
    assert E.alarm_point(E.roc_curve(df, "y", "s"), 0.7, inclusive=False).first().threshold == 0.9


def test_running_sums_across_buckets(spark):
    from wavecohort.functions.ranges import quantile_bounds, range_bucket
    df = spark.range(20_000).select(F.col("id").alias("k"), (F.col("id") % 2).alias("g"), F.lit(1).alias("one"))
    bounds = quantile_bounds(df, "k", 64)
    r = E.running_sums(df, range_bucket(F.col("k"), bounds), [F.col("k")], ["one"], ["g"])
    assert r.filter(F.col("cum_one") != F.floor(F.col("k") / 2) + 1).count() == 0 and r.count() == 20_000


def test_auc_and_folds_of_many_distinct_values(spark):
    """More distinct values than any sampler sees whole: exact and the same every time."""
    import pandas as pd
    n = 200_000
    rng = np.random.default_rng(1)
    s, y = rng.permutation(n) / 7.0, rng.random(n) < 0.3
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "s": s, "y": y.astype(int)})).repartition(6)
    rank = np.empty(n)
    rank[np.argsort(s)] = np.arange(1, n + 1)
    p = int(y.sum())
    want = (rank[y].sum() - p * (p + 1) / 2) / (p * (n - p))
    got = {E.roc_auc(df, "y", "s").first().auc for _ in range(3)}
    assert len(got) == 1 and got.pop() == pytest.approx(want, abs=1e-12)
    split = E.stratified_split(df, "y", "id", 3, 42)
    train, valid = split.filter("fold <> 0"), split.filter("fold = 0")
    assert train.join(valid, "id", "left_semi").count() == 0
    first, again = (split.groupBy("fold", "y").agg(F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("h"), F.count("*").alias("n")).collect()
                    for _ in range(2))
    assert sorted(first) == sorted(again)
    counts = {(r.fold, r.y): r.n for r in first}
    assert all(max(counts[f, c] for f in range(3)) - min(counts[f, c] for f in range(3)) <= 1 for c in (0, 1))


def test_long_stay_ids_keep_their_measures(spark):
    big = 12345678901
    s24 = spark.createDataFrame([(big, dt.date(2024, 1, 1), "HR", ts("2024-01-01 01:00:00"), 1.0, "")] * 5
                                + [(1234567890, dt.date(2024, 1, 1), "HR", ts("2024-01-01 01:00:00"), 1.0, "")],
                                "id_nda long, dt_deb date, id_measure_type string, dt_insert timestamp_ntz, value_numeric double, dt_cancel string")
    cases = spark.createDataFrame([(big, dt.date(2024, 1, 1))], "id_nda long, j1 date")
    kept = C.useful(s24, cases)
    assert [r.id_nda for r in kept.collect()] == [big] * 5
    assert {r.id_nda for r in C.case_measures(kept).collect()} == {"12345678901"}
    assert [r.k for r in spark.createDataFrame([(5,), (big,)], "i long").select(K.stay_key("i").alias("k")).collect()] == ["0000000005", str(big)]


def test_page_windows_across_new_year(spark):
    rows = [(dt.date(2023, 12, 14), 12, "a"), (dt.date(2023, 12, 14), 13, "b"), (dt.date(2023, 12, 31), 0, "c"),
            (dt.date(2024, 1, 13), 12, "d"), (dt.date(2024, 1, 13), 13, "e"), (dt.date(2022, 12, 31), 0, "f")]
    df = spark.createDataFrame([(d, h, "p", g, 1) for d, h, g in rows], "day date, hour int, prj string, page string, hits long")
    got = {r.page for r in T.top_pages_at(df, dt.datetime(2024, 1, 13, 13), 30).collect()}
    assert got == {"b", "c", "d"}
    md = df.filter("year(day) > 2022").withColumn("month_day", F.date_format("day", "MMdd"))
    assert {r.page for r in T.top_pages(md, "0113", "1214", 13, full_days=True).collect()} == {"b", "c", "d"}
    clamped = T.top_pages_at(df, dt.datetime(2030, 1, 1), 1, last=dt.datetime(2024, 1, 1, 0))
    assert {r.page for r in clamped.collect()} == {"c"}


def test_fix_charset_reads_bytes_as_latin1(spark):
    df = spark.createDataFrame([("é",), ("abc",)], "t string")
    got = [r[0] for r in df.select(K.fix_charset(F.encode("t", "UTF-8"), "ISO-8859-1")).collect()]
    assert got == ["é".encode("utf-8").decode("latin-1"), "abc"]


def test_split_blocks_stable_and_in_range(spark):
    df = spark.range(500).withColumn("k", F.col("id").cast("string"))
    a = {r.k: r.block for r in T.split_blocks(df, "k", 4, 42).collect()}
    b = {r.k: r.block for r in T.split_blocks(df.repartition(7), "k", 4, 42).collect()}
    assert a == b and set(a.values()) == {0, 1, 2, 3}


def test_window_bounds_clamp(spark):
    df = spark.createDataFrame([(ts("2011-02-03 10:00:00"), ts("2011-02-01 00:00:00"), ts("2011-03-01 00:00:00"))],
                               "day timestamp_ntz, lo timestamp_ntz, hi timestamp_ntz")
    r = df.select(*T.window_bounds(F.col("day"), F.col("lo"), F.col("hi"), 30)).first()
    assert (r.today_md, r.yesterday_md, r.month_ago_md, r.hour) == ("0203", "0202", "0201", 10)


def test_weights_matrix_keeps_nulls(spark):
    df = spark.createDataFrame([("a", "H01", 1.0), ("b", "H02", 2.0)], "variable string, interval string, weight double")
    m = {r.variable: (r.H01, r.H02) for r in T.weights_matrix(df, "variable", "interval", "weight", ["H01", "H02"]).collect()}
    assert m == {"a": (1.0, None), "b": (None, 2.0)}


def test_interpolation_matches_pandas_time_rule(spark):
    """The gap rule against the library call of the source:
    ``interpolate(method='time', limit=30).ffill().bfill()`` on an equally
    spaced index."""
    pd = pytest.importorskip("pandas")
    rng = np.random.default_rng(21)
    rows, ref = [], {}
    for sid in range(6):
        n = 96
        vals = np.where(rng.random(n) < [0.5, 0.2, 0.05, 0.8, 0.1, 0.02][sid], rng.normal(50, 10, n), np.nan)
        idx = pd.date_range("2024-01-01", periods=n, freq="15min")
        s = pd.Series(vals, index=idx).interpolate(method="time", limit=30).ffill().bfill()
        for i in range(n):
            rows.append((f"c{sid}", "v", i, None if np.isnan(vals[i]) else float(vals[i])))
            ref[(f"c{sid}", i)] = None if np.isnan(s.iloc[i]) else float(s.iloc[i])
    df = spark.createDataFrame(rows, "id_case string, voi string, idx int, value double")
    got = {(r.id_case, r.idx): r.value for r in W.interpolate(df, ["id_case", "voi"], 30, True).collect()}
    assert got.keys() == ref.keys()
    for k, v in ref.items():
        assert (v is None and got[k] is None) or got[k] == pytest.approx(v), k


def test_resample_bins_match_pandas(spark):
    """Bins of ``resample('13min').mean()`` (origin: midnight of the first
    tick's day) for an unsorted two-day series."""
    pd = pytest.importorskip("pandas")
    rng = np.random.default_rng(4)
    t = pd.to_datetime("2024-01-01 05:07:00") + pd.to_timedelta(rng.integers(0, 2 * 86400, 300), unit="s")
    v = rng.normal(size=300)
    ref = pd.Series(v, index=t).sort_index().resample("13min").mean()
    ref_idx = {i: x for i, x in enumerate(ref.values) if not np.isnan(x)}
    rows = [("c", "v", ts_.to_pydatetime(), float(x)) for ts_, x in zip(t, v)]
    df = spark.createDataFrame(rows, "id_case string, voi string, dt_insert timestamp_ntz, value_numeric double")
    got = {r.idx: r.value for r in W.resample(df.withColumn("step", F.lit(13)), ["id_case", "voi"], "step", 10_000).collect()}
    assert got.keys() == ref_idx.keys()
    assert all(got[i] == pytest.approx(ref_idx[i]) for i in got)


def test_adaboost_matches_a_plain_reading(spark):
    """Stumps, errors and votes against the algorithm written out over the rows."""
    import pandas as pd
    from wavecohort.operators import models as M
    rng = np.random.default_rng(11)
    x = rng.integers(0, 12, size=(300, 2)).astype(float)
    y = ((x[:, 0] > 5) ^ (x[:, 1] > 8) ^ (rng.random(300) < 0.1)).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "label": y}))
    got = M.adaboost(df, ["a", "b"], rounds=8)
    w, margin = np.ones(300), np.zeros(300)
    for f, cut, lo, hi in got:
        best = None
        for g in range(2):
            for c in sorted(set(x[:, g])):
                low = x[:, g] <= c
                parts = [(w[m & (y > 0)].sum(), w[m & (y == 0)].sum()) for m in (low, ~low)]
                gini = sum(2 * p * n / (p + n) for p, n in parts if p + n > 0)
                if best is None or gini < best[0] - 1e-12:
                    best = (gini, g, c, parts)
        gini = sum(2 * p * n / (p + n) for p, n in [(w[m & (y > 0)].sum(), w[m & (y == 0)].sum()) for m in (x[:, f] <= cut, x[:, f] > cut)] if p + n > 0)
        assert gini == pytest.approx(best[0])
        vote = np.where(x[:, f] <= cut, lo, hi)
        err = w[(vote > 0) != (y > 0)].sum() / w.sum()
        assert abs(hi) == pytest.approx(0.5 * math.log((1 - err) / err))
        margin += vote
        w = np.exp(-(2 * y - 1) * margin)
    s = M.adaboost_score(got, df, ["a", "b"]).toPandas()
    assert np.allclose(s.proba, (margin / sum(abs(h) for *_x, h in got) + 1) / 2)
