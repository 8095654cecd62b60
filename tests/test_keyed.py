"""Keyed store (S3): chosen keys, pruned files, hot and null keys, several filters over one relation."""

import datetime as dt
import os
import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, IsNotNull

from wavecohort.sources import keyed as K


def _store(df, tmpdir, key, cluster=None, parts=None):
    path = os.path.join(tmpdir, f"keyed-{uuid.uuid4().hex}")
    K.write_keyed(df, path, key, cluster, parts)
    return path


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def hits(spark):
    """Ten days, one of which holds half of all rows; some null days."""
    i = F.col("id")
    day = F.when(i % 2 == 0, "0105").when(i % 51 == 1, None).otherwise(F.concat(F.lit("01"), F.lpad((i % 10).cast("string"), 2, "0")))
    return spark.range(6000).select(day.alias("month_day"), (i % 24).cast("int").alias("hour"), i.alias("hits"),
                                    F.date_add(F.lit(dt.date(2024, 1, 1)), (i % 7).cast("int")).alias("at"),
                                    (i / 7).alias("ratio"))


@pytest.fixture(scope="module")
def path(hits, tmpdir_session):
    return _store(hits, tmpdir_session, "month_day", ["hour", "hits"], 8)


@pytest.mark.parametrize("choice, cond", [
    ({}, "true"), ({"keys": ["0105"]}, "month_day = '0105'"), ({"keys": ["0107", "0103", "9999", "0103"]}, "month_day in ('0103', '0107')"),
    ({"first": "0103", "last": "0107"}, "month_day between '0103' and '0107'"), ({"last": "0102"}, "month_day <= '0102'"),
    ({"first": "0108"}, "month_day >= '0108'"), ({"keys": []}, "false"), ({"keys": ["0102", "0105", None], "first": "0103"}, "month_day = '0105'")])
def test_a_choice_gives_the_rows_of_the_table(spark, hits, path, choice, cond):
    got = K.read_keyed(spark, path, "month_day", **choice)
    assert got.schema == hits.schema
    assert _rows(got) == _rows(hits.filter(cond))
    for more in ("hour in (3, 4)", "month_day = '0105' or hour = 3", "month_day is null", "month_day != '0105'", "at = date'2024-01-03'"):
        assert _rows(got.filter(more)) == _rows(hits.filter(cond).filter(more))


def test_several_filters_over_one_relation(spark, hits, path):
    got = K.read_keyed(spark, path, "month_day", first="0102")
    one, two = got.filter("month_day = '0103'"), got.filter("month_day = '0107'")
    assert _rows(one.unionAll(two)) == _rows(hits.filter("month_day in ('0103', '0107')"))
    assert got.count() == hits.filter("month_day >= '0102'").count()
    joined = one.alias("a").join(two.alias("b"), F.expr("a.hour + 4 = b.hour"))
    assert joined.count() == (hits.filter("month_day = '0103'").alias("a")
                              .join(hits.filter("month_day = '0107'").alias("b"), F.expr("a.hour + 4 = b.hour")).count())


def _scan(spark, df):
    return spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_the_plan_shows_the_pushed_key_and_only_its_files_are_read(spark, path):
    read = lambda **choice: K.read_keyed(spark, path, "month_day", **choice)
    one = read(keys=["0103"])
    assert "PushedFilters: [IsNotNull(month_day), EqualTo(month_day,0103)]" in _scan(spark, one) and "Condition" not in _scan(spark, one)
    ranged = _scan(spark, read(first="0103", last="0107"))
    assert "GreaterThanOrEqual(month_day,0103), LessThanOrEqual(month_day,0107)" in ranged and "Condition" not in ranged
    whole = read().rdd.getNumPartitions()
    assert whole >= 6 and one.rdd.getNumPartitions() <= 2
    assert read(keys=["9999"]).rdd.getNumPartitions() == 1


def test_a_hot_key_spreads_over_files(spark, path):
    hot = K.read_keyed(spark, path, "month_day", keys=["0105"])
    sizes = [n for n in hot.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert sum(sizes) >= 3000 and len(sizes) >= 3 and max(sizes) <= 1500


def test_columns(spark, hits, path):
    got = K.read_keyed(spark, path, "month_day", keys=["0102"], columns=["hits", "at"])
    assert "ReadSchema: struct<hits:bigint,at:date,month_day:string>" in _scan(spark, got)
    assert _rows(got) == _rows(hits.filter("month_day = '0102'").select("hits", "at"))


def test_integer_and_date_keys_other_types_and_repeated_rows(spark, tmpdir_session):
    df = spark.createDataFrame([(k, dt.date(2024, 1, 1 + k % 5), [k, None], {"a": k}, None) for k in [1, 2, 2, 2, 9]] + [(None, None, None, None, None)],
                               "k long, d date, xs array<long>, m map<string,long>, lo string")
    a = K.read_keyed(spark, _store(df, tmpdir_session, "k", parts=3), "k", first=2, last=8)
    assert _rows(a) == _rows(df.filter("k between 2 and 8"))
    path = _store(df, tmpdir_session, "d", parts=3)
    assert _rows(K.read_keyed(spark, path, "d")) == _rows(df)
    assert _rows(K.read_keyed(spark, path, "d", keys=[dt.date(2024, 1, 3)])) == _rows(df.filter("d = date'2024-01-03'"))
    assert _rows(K.read_keyed(spark, path, "d", last=dt.date(2024, 1, 3))) == _rows(df.filter("d <= date'2024-01-03'"))


def test_empty_store_and_bad_keys(spark, hits, tmpdir_session):
    path = _store(hits.filter("false"), tmpdir_session, "month_day", ["hour"])
    got = K.read_keyed(spark, path, "month_day")
    assert got.schema == hits.schema and got.count() == 0 and K.read_keyed(spark, path, "month_day", keys=["0101"]).count() == 0
    with pytest.raises(ValueError):
        _store(hits, tmpdir_session, "ratio")


def test_choice_of_files_and_implied_filters():
    some, span = K.Choice("k", [0, 4, 9]), K.Choice("k", None, 3, 7)
    assert some.may_hold(4, 5) and some.may_hold(2, 4) and not some.may_hold(5, 8) and not some.may_hold(None, None)
    assert span.may_hold(7, 9) and span.may_hold(1, 3) and not span.may_hold(8, 9) and not span.may_hold(1, 2)
    assert K.Choice("k").may_hold(None, None) and not K.Choice("k", []).may_hold(1, 2)
    assert some.implies(In(("k",), (0, 4, 9, 11))) and not some.implies(In(("k",), (0, 4))) and not some.implies(EqualTo(("k",), 4))
    assert span.implies(GreaterThanOrEqual(("k",), 2)) and not span.implies(GreaterThanOrEqual(("k",), 4))
    assert span.implies(IsNotNull(("k",))) and not span.implies(IsNotNull(("x",))) and not K.Choice("k").implies(IsNotNull(("k",)))
