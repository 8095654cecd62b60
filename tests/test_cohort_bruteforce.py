"""The one-plan cohort against a brute-force pandas reading of the source's
steps, on a fixture where one stay holds more than a third of all measures."""

import datetime as dt

import numpy as np
import pandas as pd

from wavecohort.functions.keys import stay_key
from wavecohort.operators import cohort as C

VOIS = [("X", ["a", "b"]), ("Y", ["c"])]


def _fixture(seed=7):
    rng = np.random.default_rng(seed)
    base = dt.datetime(2024, 1, 1)
    rows = []
    sizes = {1: 900, 2: 300, 3: 250, 4: 200, 5: 40}         # stay 1 holds > 1/3 of the rows
    for sid, n in sizes.items():
        for _ in range(n):
            rows.append((sid, str(rng.choice(["a", "b", "c", "z"])), base + dt.timedelta(minutes=int(rng.integers(0, 3000))),
                         float(rng.normal(5, 5)), "x" if rng.random() < 0.1 else ""))
    sensors = pd.DataFrame(rows, columns=["id_nda", "id_measure_type", "dt_insert", "value_numeric", "dt_cancel"])
    moves = pd.DataFrame({"id_nda": [1, 2, 3, 4, 5], "ids_pat": [11, 12, 13, 14, 15], "ids_ufr": [1, 1, 2, 1, 1],
                          "dt_deb_mouv_ufr": [base + dt.timedelta(hours=h) for h in (0, 5, 0, 10, 0)],
                          "dt_fin_mouv_ufr": [base + dt.timedelta(days=3)] * 5})
    units = pd.DataFrame({"ids_ufr": [1]})
    stays = pd.DataFrame({"id_nda": [1, 2, 3, 4, 5], "dt_deb_nda": [base] * 5,
                          "dt_fin_nda": [base + dt.timedelta(days=d) for d in (2, 2, 2, 1, 2)]})
    patients = pd.DataFrame({"ids_pat": [11, 12, 13, 14, 15], "age": [40.0, 16.0, 50.0, 70.0, 30.0],
                             "cd_sex_tr": ["F", "M", "F", "M", "F"],
                             "dt_deces": [base + dt.timedelta(days=1), None, None, base + dt.timedelta(days=2), None],
                             "dpt": ["d1", "d2", "d3", "d4", "d5"]})
    patients["dt_deces"] = pd.to_datetime(patients["dt_deces"])
    return sensors, moves, units, stays, patients


def _brute(sensors, moves, units, stays, patients, min_pts, min_stay_h, age_min, span_h):
    icu = moves[moves.ids_ufr.isin(units.ids_ufr)]
    j = sensors.merge(icu, on="id_nda")
    j = j[(j.dt_insert >= j.dt_deb_mouv_ufr) & (j.dt_insert <= j.dt_deb_mouv_ufr + pd.Timedelta(hours=span_h))]
    j = j.assign(dt_deb=j.dt_deb_mouv_ufr.dt.date)
    codes = {c: v for v, cs in VOIS for c in cs}
    act = j[(j.dt_cancel == "") & j.id_measure_type.isin(list(codes))]
    pos = act[act.value_numeric > 0]
    out = []
    for (sid, day), g in pos.groupby(["id_nda", "dt_deb"]):
        tot = {v: int(g.id_measure_type.isin(cs).sum()) for v, cs in VOIS}
        if not all(t > min_pts for t in tot.values()):
            continue
        a = act[(act.id_nda == sid) & (act.dt_deb == day)]
        starts = [a[a.id_measure_type.isin(cs)].dt_insert.min() for _v, cs in VOIS]
        ends = [a[a.id_measure_type.isin(cs)].dt_insert.max() for _v, cs in VOIS]
        dt_min, dt_max = max(starts), min(ends)
        if dt_max - dt_min < pd.Timedelta(hours=min_stay_h):
            continue
        p = patients[patients.ids_pat == icu[icu.id_nda == sid].ids_pat.iloc[0]].iloc[0]
        if p.age < age_min:
            continue
        st = stays[stays.id_nda == sid].iloc[0]
        death = p.dt_deces if (pd.notna(p.dt_deces) and st.dt_deb_nda <= p.dt_deces <= st.dt_fin_nda) else None
        out.append((f"{sid:010d}", day, tot["X"], tot["Y"], death, dt_min, dt_max))
    return sorted(out, key=lambda r: r[0])


def test_cohort_matches_bruteforce_under_skew(spark):
    sensors, moves, units, stays, patients = _fixture()
    sp = {k: spark.createDataFrame(v) for k, v in
          dict(sensors=sensors, moves=moves, units=units, stays=stays, patients=patients).items()}
    sp["sensors"] = sp["sensors"].withColumn("dt_insert", sp["sensors"].dt_insert.cast("timestamp_ntz"))
    for k in ("moves",):
        for c in ("dt_deb_mouv_ufr", "dt_fin_mouv_ufr"):
            sp[k] = sp[k].withColumn(c, sp[k][c].cast("timestamp_ntz"))
    for c in ("dt_deb_nda", "dt_fin_nda"):
        sp["stays"] = sp["stays"].withColumn(c, sp["stays"][c].cast("timestamp_ntz"))
    sp["patients"] = sp["patients"].withColumn("dt_deces", sp["patients"].dt_deces.cast("timestamp_ntz"))
    vc = spark.createDataFrame([(v, c) for v, cs in VOIS for c in cs], "voi string, code string")
    for min_pts, min_stay_h, age_min in [(10, 20, 18), (50, 30, 15), (0, 0, 0)]:
        got = C.build_cohort(sp["sensors"], sp["moves"], sp["units"], sp["stays"], sp["patients"], vc,
                             ["X", "Y"], ["a", "b", "c"], min_pts=min_pts, min_stay_h=min_stay_h,
                             age_min=age_min, span="2 days").withColumn("id_nda", stay_key("id_nda"))   # as the sink writes it
        rows = sorted(((r.id_nda, r.j1, r.X, r.Y, r.dt_deces, r.dt_min, r.dt_max) for r in got.collect()),
                      key=lambda r: r[0])
        ref = _brute(sensors, moves, units, stays, patients, min_pts, min_stay_h, age_min, 48)
        norm = [(a, b, c, d, None if e is None else pd.Timestamp(e).to_pydatetime(),
                 pd.Timestamp(f).to_pydatetime(), pd.Timestamp(g).to_pydatetime()) for a, b, c, d, e, f, g in ref]
        assert rows == norm, (min_pts, min_stay_h, age_min)
        assert len(rows) > 0 or min_pts == 50
