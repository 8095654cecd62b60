"""Long series of any length, null keys, long stay ids."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavecohort.functions import keys as K
from wavecohort.operators import series as W
from wavecohort.operators import spectral as SP
from wavecohort.sources import casetable as CT


@pytest.mark.parametrize("n", [1, 2, 3, 7, 97, 101, 128, 1009, 2 * 503, 3 * 1009])
def test_transform_of_any_length(spark, n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=n) + 3 * np.sin(np.arange(n) / 5)
    df = spark.createDataFrame([(None, i, float(v)) for i, v in enumerate(x)] + [(1, i, float(i % 7)) for i in range(64)], "rec long, idx int, value double")
    got = {}
    for r in SP.fft_magnitude_long(df, ["rec"], 0.5, None).orderBy("k").collect():
        got.setdefault(r.rec, []).append(r.magnitude)
    want = np.abs(np.fft.fft(x))[:n // 2]
    assert len(got.get(None, [])) == n // 2 and np.allclose(got.get(None, []), want, rtol=1e-9, atol=1e-9 * n)
    assert np.allclose(got[1], np.abs(np.fft.fft(np.arange(64) % 7))[:32], atol=1e-9)


def test_prime_length_costs_about_what_a_round_one_does(spark):
    took = {}
    for n in (16384, 20011, 16384, 20011):
        df = spark.range(n).select(F.lit(1).alias("rec"), F.col("id").cast("int").alias("idx"), F.sin(F.col("id") / 9).alias("value"))
        t = time.time()
        assert SP.fft_magnitude_long(df, ["rec"], 0.5, None).agg(F.count(F.lit(1))).first()[0] == n // 2
        took[n] = time.time() - t                            # the second, warm run counts
    # a direct sum would take 20011 / 256 times as many products
    assert took[20011] < 12 * took[16384] + 5


def test_null_recordings_stay(spark):
    rows = [(r, c, i, float(i % 50)) for r in (None, 1) for c in ("a", None) for i in range(300)]
    df = spark.createDataFrame(rows, "rec long, cue string, idx int, value double")
    out = SP.lowpass(df, ["rec", "cue"], "cue", {"a": 5.0}, 125.0)
    assert out.count() == len(rows)
    by = {(r.rec, r.cue): [x.value for x in out.filter(F.col("rec").eqNullSafe(F.lit(r.rec)) & F.col("cue").eqNullSafe(F.lit(r.cue))).orderBy("idx").collect()]
          for r in df.select("rec", "cue").distinct().collect()}
    assert by[None, "a"] == by[1, "a"] != by[1, None] == by[None, None]
    ticks = df.withColumn("ts", F.timestamp_micros(F.lit(10 ** 15) + F.col("idx") * 700_000).cast("timestamp_ntz"))
    cues = W.resample_cues(ticks, "rec", "cue", 1000, block=64)
    counts = {(r.rec, r.cue): r["count"] for r in cues.groupBy("rec", "cue").count().collect()}
    assert len(counts) == 4 and len(set(counts.values())) == 1
    assert cues.filter("value is null").count() == 0


def test_long_stay_ids_are_kept(spark):
    ids = ["12345678901", "1234567890", "0000000042", "123456789012345"]
    df = spark.createDataFrame([(i + "2101-02-03", 5) for i in ids], "id_ndaj1 string, v int")
    assert [r.id_nda for r in CT.case_table_frame(df, ["v"]).collect()] == ids
    assert {str(r.j1) for r in CT.case_table_frame(df, ["v"]).collect()} == {"2101-02-03"}
    a, b = K.split_case_id_fixed("id_ndaj1")
    assert [tuple(r) for r in df.select(a, b).collect()] == [(i, "2101-02-03") for i in ids]
    key = df.select(K.stay_key(F.lit(12345678901))).first()[0]
    assert key == ids[0]


def thomas(x, y):
    """Second derivatives of the natural spline by plain elimination."""
    n, h = len(x), np.diff(x)
    c, d, m = np.zeros(n), np.zeros(n), np.zeros(n)
    for i in range(1, n - 1):
        p = 2 * (h[i - 1] + h[i]) - h[i - 1] * c[i - 1]
        c[i], d[i] = h[i] / p, (6 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1]) - h[i - 1] * d[i - 1]) / p
    for i in range(n - 2, 0, -1):
        m[i] = d[i] - c[i] * m[i + 1]
    return m


def plain_spline(y):
    at, k = np.arange(len(y), dtype=float), np.flatnonzero(~np.isnan(y))
    if not len(k):
        return [None] * len(y)
    x, v = k.astype(float), y[k]
    if len(k) == 1:
        return [float(v[0])] * len(y)
    m, h = thomas(x, v), np.diff(x)
    j = np.clip(np.searchsorted(x, at, side="right") - 1, 0, len(x) - 2)
    b, a = x[j + 1] - at, at - x[j]
    s = (m[j] * b ** 3 + m[j + 1] * a ** 3) / (6 * h[j]) + (v[j] / h[j] - m[j] * h[j] / 6) * b + (v[j + 1] / h[j] - m[j + 1] * h[j] / 6) * a
    s = np.where(at < x[0], v[0], np.where(at > x[-1], v[-1], s))
    return [float(p) for p in np.where(np.isnan(y), s, y)]


@pytest.mark.parametrize("block", [1, 7, 256])
def test_spline_of_many_series_by_blocks(spark, block):
    rng = np.random.default_rng(4)
    series = {name: np.where(rng.random(n) < share, rng.normal(size=n).cumsum(), np.nan)
              for name, n, share in (("a", 300, 0.3), ("b", 300, 0.01), ("c", 41, 1.0), (None, 120, 0.5), ("none", 20, 0.0), ("long", 5000 if block > 7 else 600, 0.2))}
    one = np.full(30, np.nan)
    one[11] = 2.5
    series["one"] = one
    rows = [(k, i, None if np.isnan(v) and i % 2 else float(v)) for k, y in series.items() for i, v in enumerate(y)]     # NaN and NULL are both missing
    rng.shuffle(rows)
    got = SP.interpolate_spline(spark.createDataFrame(rows, "s string, idx int, value double"), ["s"], block=block)
    assert got.columns == ["s", "idx", "value"]
    out = {}
    for r in got.collect():
        out.setdefault(r.s, {})[r.idx] = r.value
    assert set(out) == set(series)
    for k, y in series.items():
        mine, want = [out[k][i] for i in range(len(y))], plain_spline(y)
        assert mine == (want if want[0] is None else pytest.approx(want, rel=1e-9, abs=1e-9)), k


def test_spline_of_an_empty_grid(spark):
    empty = spark.createDataFrame([], "s string, idx int, value double")
    assert SP.interpolate_spline(empty, ["s"]).collect() == []


def test_many_short_series_beside_a_long_one(spark):
    rng = np.random.default_rng(7)
    series = {(r, "a"): rng.normal(size=120) for r in range(40)} | {(99, "a"): rng.normal(size=SP.SHORT + 8)}
    rows = [(r, c, i, float(v)) for (r, c), x in series.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "rec long, cue string, idx int, value double").repartition(4)
    # short series don't meet as one row per product: no row is made more often than once
    for part, few in ((df, False), (df.filter("rec < 99"), True)):
        out = SP.fft_magnitude_long(part, ["rec", "cue"], 0.5, None)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert ("Generate" not in plan) == few
        got = {}
        for r in out.orderBy("k").collect():
            got.setdefault(r.rec, []).append(r.magnitude)
        for (r, _), x in series.items():
            if r < 99 or not few:
                assert np.allclose(got[r], np.abs(np.fft.fft(x))[:len(x) // 2], atol=1e-9)
    b, a = SP.butter_lowpass(5, 5.0, 125.0)
    for part in (df, df.filter("rec < 99")):
        out = {}
        for r in SP.lowpass(part, ["rec", "cue"], "cue", {"a": 5.0}, 125.0).collect():
            out.setdefault(r.rec, {})[r.idx] = r.value
        for r, y in out.items():
            x, z, want = series[r, "a"], np.zeros(6), []
            for v in x:
                want.append(b[0] * v + z[0])
                z[:5] = z[1:] + b[1:] * v - a[1:] * want[-1]
            assert np.allclose([y[i] for i in range(len(x))], want, atol=1e-9)


def test_grid_is_made_after_the_last_shuffle(spark):
    rows = [(r, c, i * 7 % 997 if r == 1 else i, float(i * i % 13) if i % 5 else None) for r in (None, 1, 2) for c in ("a", None) for i in range(3, 300, 4)]
    df = spark.createDataFrame(rows, "rec long, cue string, tick int, value double").withColumn(
        "ts", F.timestamp_micros(F.lit(10 ** 15) + F.col("tick") * 1_000_000).cast("timestamp_ntz"))
    out = W.resample_cues(df, "rec", "cue", 1000, block=50)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(sequence(") < plan.index("Join") and "sequence" in plan
    got = {}
    for r in out.collect():
        got.setdefault((r.rec, r.cue), {})[r.idx] = r.value
    for key in got:
        mine = [x for x in rows if x[:2] == key]
        start, end = min(x[2] for x in rows if x[0] == key[0]), max(x[2] for x in rows if x[0] == key[0])
        known = {x[2] - start: x[3] for x in mine if x[3] is not None}
        at, (xs, ys) = np.arange(end - start + 1), zip(*sorted(known.items()))
        want = [None if i < xs[0] else v for i, v in zip(at.tolist(), np.interp(at, xs, ys).tolist())]
        assert sorted(got[key]) == at.tolist()
        assert [got[key][i] for i in at.tolist()] == pytest.approx(want), key
    # minima in blocks of any size: those of the whole series
    low = {b: sorted((str(r.rec), str(r.cue), r.idx) for r in W.local_minima(out, ["rec", "cue"], 5, 150, block=b).collect()) for b in (1, 2, 16, 4096)}
    assert low[1] == low[2] == low[16] == low[4096] and {x[0] for x in low[16]} == {"None", "1", "2"}
