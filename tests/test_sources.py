"""Sources, sinks and catalog helpers."""

import os

import pytest
from pyspark.sql import functions as F

from wavecohort.sources import casetable as CT
from wavecohort.sources import tables as S


def test_load_ticks_csv_and_period(spark, tmpdir_session):
    path = os.path.join(tmpdir_session, "imu.csv")
    with open(path, "w") as f:
        f.write("timestamp,g_x,g_z\n")
        for i in range(1, 11):
            f.write(f"{i * 8},{i * 0.5},{-i * 0.25}\n")
    df, period = S.load_ticks(spark, path, "timestamp", "ms")
    assert period.first().period == 8                 # floor(80 / 10)
    assert str(df.orderBy("timestamp").first().ts) == "1970-01-01 00:00:00.008000"


def test_partitioned_write_and_pruned_read(spark, tmpdir_session):
    path = os.path.join(tmpdir_session, "part")
    df = spark.range(20).withColumn("day", (F.col("id") % 3).cast("int"))
    S.write_table(df, path, partition_by=["day"])
    back = spark.read.parquet(path).filter("day = 1")
    assert sorted(r.id for r in back.collect()) == [i for i in range(20) if i % 3 == 1]
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan


def test_materialize_exists_replace_drop(spark):
    name = "wc_test_tbl"
    S.drop_table(spark, name)
    assert not S.table_exists(spark, name)
    t = S.materialize(spark.range(5), name)
    assert t.count() == 5 and S.table_exists(spark, name)
    assert S.materialize(spark.range(9), name).count() == 5          # reused when present
    S.replace_table(spark, name, spark.table(name).filter("id > 2"))
    assert spark.table(name).count() == 2
    S.drop_table(spark, name)
    assert not S.table_exists(spark, name)


def test_tensor_round_trip(spark, tmpdir_session):
    rows = [(c, c % 2 == 0, v, i, float(c + v + i)) for c in range(3) for v in range(2) for i in range(4)]
    long = spark.createDataFrame(rows, "case long, outcome boolean, voi int, idx int, value double")
    t = CT.tensor_frame(long)
    first = t.orderBy("case").first()
    assert first.waves == [[0.0, 1.0, 2.0, 3.0], [1.0, 2.0, 3.0, 4.0]]
    path = os.path.join(tmpdir_session, "tensor")
    CT.write_tensor(t, path)
    assert CT.tensors_equal(t, CT.read_tensor(spark, path))


def test_case_table_frame_types(spark):
    df = spark.createDataFrame([("00000000072024-01-02", 5, None)], "id_ndaj1 string, HR long, dt_deces timestamp_ntz")
    out = CT.case_table_frame(df, ["HR"])
    assert out.dtypes[:2] == [("id_nda", "string"), ("j1", "date")]
    assert out.first().id_nda == "0000000007"


def test_model_save_load(spark, tmpdir_session):
    from wavecohort.operators import models as M
    df = spark.createDataFrame([(float(i), float(i % 2)) for i in range(40)], "x double, label double")
    model = M.fit(M.classifier("logreg", n_train=40), df, ["x"])
    path = os.path.join(tmpdir_session, "model")
    S.save_model(model, path)
    back = S.load_model(path)
    a = [r.prediction for r in model.transform(df).collect()]
    b = [r.prediction for r in back.transform(df).collect()]
    assert a == b


@pytest.mark.parametrize("kind", ["tree", "forest", "gbt"])
def test_classifiers_fit(spark, kind):
    from wavecohort.operators import models as M
    df = spark.createDataFrame([(float(i), float(i % 7), float(i > 50)) for i in range(120)], "a double, b double, label double")
    est = M.classifier(kind, numTrees=5) if kind == "forest" else (
        M.classifier(kind, maxIter=5) if kind == "gbt" else M.classifier(kind, minInstancesPerNode=5))
    r = M.validate(est, df, df, ["a", "b"]).first()
    assert r.auc > 0.9


def test_param_sampling_is_seeded():
    from wavecohort.operators import models as M
    space = {"d": ("quniform", 2, 8, 1), "lr": ("uniform", 0.01, 0.3), "c": ("choice", ["x", "y"])}
    a, b = M.sample_param_maps(space, 5, 7), M.sample_param_maps(space, 5, 7)
    assert a == b and all(2 <= p["d"] <= 8 and isinstance(p["d"], int) for p in a)
    sets = M.sample_feature_sets(list("abcdefg"), 10, 5, 1)
    assert all(len(s) <= 5 for s in sets)


def test_runtime_conf_applied_by_query_wrapper(spark):
    import __spark_entry__ as e
    from wavecohort.session import RUNTIME_CONF, cluster_conf
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "false")
    e.queries()["window_bounds"](spark, "/root/testdata/sf0.001").collect()
    assert all(spark.conf.get(k) == v for k, v in RUNTIME_CONF.items())
    c = cluster_conf(1000, 8)
    assert c["spark.sql.shuffle.partitions"] == "24000"


def test_random_search_draws_the_rounds():
    from wavecohort.operators import models as M
    from wavecohort.plans.q_score import RANDOM_SPACE
    rounds = [p["maxIter"] for p in M.sample_param_maps(RANDOM_SPACE, 300)]
    assert set(rounds) == set(range(40, 46))
