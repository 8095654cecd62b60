"""Joins, ranks and means whose groups may be very large: same rows as the plain forms, spread over many tasks."""

import datetime as dt
import re

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from wavecohort.functions.ranges import range_bucket
from wavecohort.operators import covariance as CV
from wavecohort.operators import joins as J
from wavecohort.operators import ranking as T


def rows(df):
    return sorted(map(str, df.collect()))


def stays(spark, n=3000):
    """Measures over 60 days; stay 1 holds half of them, some stays and times are null."""
    r = spark.range(n).select(
        F.when(F.col("id") % 2 == 0, F.lit(1)).when(F.col("id") % 31 == 0, F.lit(None)).otherwise(F.col("id") % 7).cast("long").alias("id_nda"),
        F.when(F.col("id") % 97 != 0, F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, cast(id * 7919 % 86400 as int))")).alias("dt_insert"),
        F.col("id").cast("double").alias("value_numeric"))
    moves = spark.range(40).select((F.col("id") % 5).alias("id_nda"),
                                   F.expr("timestamp_ntz'2024-01-03' + make_dt_interval(cast(id * 13 % 50 as int), 0, 0)").alias("dt_deb_mouv_ufr"))
    moves = moves.unionByName(spark.createDataFrame([(1, None), (None, dt.datetime(2024, 1, 5))], moves.schema))
    return r, moves


@pytest.mark.parametrize("days", [1, 5])
def test_bucketed_window_equals_the_plain_one(spark, days):
    r, moves = stays(spark)
    want = J.first_window(r, moves, f"{days} days")
    got = J.first_window_bucketed(r, moves, days)
    assert got.columns == want.columns and rows(got) == rows(want) and got.count() > 100


def test_window_edges_meet_in_their_bucket(spark):
    r = spark.createDataFrame([(1, dt.datetime(2024, 1, 2)), (1, dt.datetime(2024, 1, 3)), (1, dt.datetime(2024, 1, 3, 0, 0, 1)),
                               (1, dt.datetime(1969, 12, 31, 12))], "id_nda long, dt_insert timestamp_ntz")
    moves = spark.createDataFrame([(1, dt.datetime(2024, 1, 2)), (1, dt.datetime(1969, 12, 31, 1))], "id_nda long, dt_deb_mouv_ufr timestamp_ntz")
    assert rows(J.first_window_bucketed(r, moves)) == rows(J.first_window(r, moves)) and J.first_window_bucketed(r, moves).count() == 3


def plain_forms(cases, forms, days):
    f = forms.withColumnRenamed("id_nda", "_f")
    return cases.join(f, (F.col("id_nda") == F.col("_f")) & (F.date_add("j1", days) >= F.to_date("form_date"))).select("id_nda", "j1", "id_form").distinct()


def test_forms_of_a_hot_stay(spark):
    day = lambda c: F.date_add(F.lit(dt.date(2020, 1, 1)), c.cast("int"))
    cases = spark.range(900).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 40).alias("id_nda"), day(F.col("id") * 37 % 400).alias("j1"))
    forms = spark.range(900).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 40).alias("id_nda"),
                                    day(F.col("id") * 53 % 500).alias("form_date"), (F.col("id") % 200).alias("id_form"))
    none = spark.createDataFrame([(1, None, 5), (None, dt.date(2020, 1, 1), 6), (1, dt.date(2020, 1, 2), None)], forms.schema)
    cases = cases.unionByName(spark.createDataFrame([(1, None), (None, dt.date(2020, 5, 1))], cases.schema)).unionByName(cases.limit(50))
    forms = forms.unionByName(none)
    got = J.map_forms(cases, forms, 15)
    assert rows(got) == rows(plain_forms(cases, forms, 15))
    assert got.count() == got.distinct().count()
    assert J.map_forms(cases, forms.limit(0)).count() == 0 and J.map_forms(cases.limit(0), forms).count() == 0


def test_form_on_the_last_day(spark):
    cases = spark.createDataFrame([(1, dt.date(2020, 1, 1))], "id_nda long, j1 date")
    forms = spark.createDataFrame([(1, dt.date(2020, 1, 16), 1), (1, dt.date(2020, 1, 17), 2), (1, dt.date(1960, 1, 1), 3)], "id_nda long, form_date date, id_form long")
    assert sorted(r.id_form for r in J.map_forms(cases, forms, 15).collect()) == [1, 3]


def test_ranks_of_a_hot_group(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 11 == 0, None).otherwise(F.concat(F.lit("g"), F.col("id") % 9)).alias("g"),
                                  F.when(F.col("id") % 53 != 0, F.md5(F.col("id").cast("string"))).alias("o"), "id")
    want = df.withColumn("seq", F.row_number().over(Window.partitionBy("g").orderBy("o", "id")))
    got = T.sequence_in_group(df, "g", ["o", "id"])
    assert got.columns == want.columns and got.schema["seq"].dataType == want.schema["seq"].dataType and rows(got) == rows(want)
    # the hot group's windows are many and small
    bounds = T.order_bounds(df, "g", ["o", "id"])
    sizes = [r["count"] for r in df.filter("g = 'hot'").groupBy(range_bucket(F.col("o"), bounds)).count().collect()]
    assert len(sizes) > 50 and max(sizes) < 125
    for empty in (df.limit(0), df.withColumn("o", F.lit(None).cast("string"))):
        assert T.sequence_in_group(empty, "g", ["o", "id"]).count() == empty.count()


def test_rolled_windows_equal_the_hourly_ones(spark, tmp_path):
    hours = spark.range(8000).select(F.date_add(F.lit(dt.date(2023, 12, 1)), (F.col("id") * 7 % 45).cast("int")).alias("day"),
                                     (F.col("id") * 5 % 24).cast("int").alias("hour"), F.lit("p").alias("prj"),
                                     (F.col("id") % 30).cast("string").alias("page"), F.when(F.col("id") % 50 != 0, F.col("id") % 17).alias("hits"))
    hours.write.partitionBy("day").parquet(str(tmp_path / "hours"))
    T.day_totals(hours).write.partitionBy("day").parquet(str(tmp_path / "days"))
    h, d = (spark.read.parquet(str(tmp_path / n)) for n in ("hours", "days"))
    for at in (dt.datetime(2024, 1, 9, 13), dt.datetime(2024, 1, 1, 0), dt.datetime(2023, 12, 2, 5), dt.datetime(2030, 1, 1)):
        for back in (0, 1, 2, 30):
            for first in (None, dt.datetime(2023, 12, 20, 7)):
                a = [at, back, 10, first, dt.datetime(2024, 1, 14, 23)]
                assert T.top_pages_rolled(d, h, *a).collect() == T.top_pages_at(h, *a).collect(), a


def test_rolled_window_reads_hours_of_two_days(spark, tmp_path):
    hours = spark.range(2400).select(F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col("id") % 40).cast("int")).alias("day"),
                                     (F.col("id") % 24).cast("int").alias("hour"), F.lit("p").alias("prj"), F.lit("x").alias("page"), F.lit(1).alias("hits"))
    hours.write.partitionBy("day").parquet(str(tmp_path / "hours"))
    h = spark.read.parquet(str(tmp_path / "hours"))
    edges = T.top_pages_rolled(T.day_totals(hours).limit(0), h, dt.datetime(2024, 2, 5, 12), 30)
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [day" in plan
    assert edges.count() == 1
    # the files of all other days may go: a new reading of the store with the two days alone gives the same
    two = h.filter(F.col("day").isin(dt.date(2024, 1, 6), dt.date(2024, 2, 5)))
    assert T.top_pages_rolled(T.day_totals(hours).limit(0), two, dt.datetime(2024, 2, 5, 12), 30).collect() == edges.collect()


def ill(rng, d, n, spread):
    out = []
    for _ in range(n):
        q = np.linalg.qr(rng.normal(size=(d, d)))[0]
        out.append(q @ np.diag(np.exp(rng.uniform(-spread, spread, d))) @ q.T)
    return out


def frame(spark, classes):
    return spark.createDataFrame([(k, [float(v) for v in m.ravel()]) for k, ms in classes.items() for m in ms], "cls int, cov array<double>")


def plain_steps(ms, n):
    fn = CV._sym_fn
    c = np.mean(ms, axis=0)
    for _ in range(n):
        i, s = fn(c, lambda w: 1 / np.sqrt(w)), fn(c, np.sqrt)
        j = np.mean([fn(i @ m @ i, np.log) for m in ms], axis=0)
        c = s @ fn(j, np.exp) @ s
    return float(np.linalg.norm(j))


def residual(c, ms):
    i = CV._sym_fn(c, lambda w: 1 / np.sqrt(w))
    return float(np.linalg.norm(np.mean([CV._sym_fn(i @ m @ i, np.log) for m in ms], axis=0)))


def test_riemann_mean_of_ill_conditioned_matrices(spark):
    rng = np.random.default_rng(1)
    classes = {0: ill(rng, 4, 6, 9.0), 1: ill(rng, 4, 6, 0.5)}
    assert plain_steps(classes[0], 50) > 1e-8              # unit steps don't get there
    got = {r.cls: np.array(r.mean_cov).reshape(4, 4) for r in CV.mean_cov_riemann(frame(spark, classes), "cls", 4).collect()}
    for k, ms in classes.items():
        assert residual(got[k], ms) < 1e-6


def test_riemann_mean_is_invariant(spark):
    rng = np.random.default_rng(5)
    ms, w = ill(rng, 3, 8, 1.5), rng.normal(size=(3, 3))
    classes = {0: ms, 1: [w @ m @ w.T for m in ms], 2: [np.linalg.inv(m) for m in ms]}
    got = {r.cls: np.array(r.mean_cov).reshape(3, 3) for r in CV.mean_cov_riemann(frame(spark, classes), "cls", 3).collect()}
    assert np.allclose(got[1], w @ got[0] @ w.T, rtol=1e-6) and np.allclose(got[2], np.linalg.inv(got[0]), rtol=1e-6)


def test_merged_partitions_stay_small_and_the_cohort_is_several_stages(spark):
    from tests.conftest import SF_SMALL
    from wavecohort.plans.q_cohort import cohort_df
    from wavecohort.session import apply_runtime_conf
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    try:
        for given, held in (("64m", "8m"), ("16k", "16k")):
            spark.conf.set(size, given)
            apply_runtime_conf(spark)
            assert spark.conf.get(size) == held
    finally:
        spark.conf.set(size, before)
    plan = cohort_df(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    # the aggregates per case have a shuffle of their own, apart from the measures' join on the stay
    assert re.search(r"Exchange hashpartitioning\(id_nda#\d+L, dt_deb#\d+", plan)
