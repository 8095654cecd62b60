"""Aggregations.

All are ``groupBy``/``agg`` plans: Spark aggregates partially before the
shuffle, so a hot key costs one partial row per task, not its raw rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavecohort.functions.keys import active


def measure_counts(sensors24: DataFrame, ref: DataFrame) -> DataFrame:
    """Active measures per type with its label, most frequent first
    (ties by code then label)."""
    r = ref.select(F.col("code").alias("id_measure_type"), "label")
    return (active(sensors24, positive=False).join(r, "id_measure_type")
            .groupBy("id_measure_type", "label").agg(F.count(F.lit(1)).alias("counter"))
            .orderBy(F.desc("counter"), "id_measure_type", "label"))


def count_cases(sensors: DataFrame, codes: list, case_cols=("id_nda", "dt_deb")) -> DataFrame:
    """A2: exact number of distinct cases with an active measure of ``codes``."""
    s = active(sensors, positive=False).filter(F.col("id_measure_type").isin(list(codes)))
    return s.agg(F.count_distinct(*[F.col(c) for c in case_cols]).alias("n_cases"))


def code_bounds(sensors: DataFrame, codes: list, case_cols=("id_nda", "dt_deb")) -> DataFrame:
    """A5: first and last active measure per (case, code), in one aggregate."""
    s = active(sensors, positive=False).filter(F.col("id_measure_type").isin(list(codes)))
    return s.groupBy(*case_cols, "id_measure_type").agg(F.min("dt_insert").alias("min_dt"),
                                                        F.max("dt_insert").alias("max_dt"))


def voi_stats(useful: DataFrame, voi_codes: DataFrame, vois: list[str] | None = None) -> DataFrame:
    """A10: per VOI count, min, max, mean, sample variance and sample std."""
    vc = voi_codes.select("voi", F.col("code").alias("id_measure_type"))
    if vois is not None:
        vc = vc.filter(F.col("voi").isin(list(vois)))
    v = F.col("value_numeric")
    return (useful.join(F.broadcast(vc), "id_measure_type")
            .groupBy("voi").agg(F.count(v).alias("number"), F.min(v).alias("minimum"), F.max(v).alias("maximum"),
                                F.avg(v).alias("mean"), F.var_samp(v).alias("variance"),
                                F.stddev_samp(v).alias("std")))


def sigma_limits(stats: DataFrame, k: float = 3.0) -> DataFrame:
    """``mean ± k·std`` per VOI."""
    return stats.select("voi", (F.col("mean") - F.lit(float(k)) * F.col("std")).alias("min_limit"),
                        (F.col("mean") + F.lit(float(k)) * F.col("std")).alias("max_limit"))


def time_bounds(df: DataFrame, col: str) -> DataFrame:
    """Earliest and latest value of ``col``."""
    return df.agg(F.min(col).alias("beginning"), F.max(col).alias("ending"))


def voi_totals(counter_long: DataFrame, voi_codes: DataFrame, vois: list[str],
               case_cols=("id_nda", "dt_deb")) -> DataFrame:
    """Per case, the sum of its code counts for each VOI (one column per
    VOI, explicit value list)."""
    vc = F.broadcast(voi_codes.select("voi", F.col("code").alias("id_measure_type")))
    return (counter_long.join(vc, "id_measure_type").groupBy(*case_cols)
            .agg(*[F.sum(F.when(F.col("voi") == v, F.col("counter"))).alias(v) for v in vois]))


def coverage_sweep(totals: DataFrame, vois: list[str], thresholds: list[int]) -> DataFrame:
    """Number of cases whose every VOI total is strictly above each
    threshold, all thresholds in one aggregate (no cross join, no re-runs)."""
    least = F.least(*[F.coalesce(F.col(v), F.lit(0)) for v in vois]) if len(vois) > 1 else F.coalesce(F.col(vois[0]), F.lit(0))
    aggs = [F.count(F.when(least > F.lit(t), F.lit(1))).alias(f"t{t}") for t in thresholds]
    wide = totals.agg(*aggs)
    stack = ", ".join(f"{t}, t{t}" for t in thresholds)
    return wide.selectExpr(f"stack({len(thresholds)}, {stack}) AS (nb_pts, n_cases)").select(
        F.col("nb_pts").cast("int"), F.col("n_cases").cast("long"))


def histogram(df: DataFrame, col: str, bins: int = 50, by: str | None = None,
              lo: str | None = None, hi: str | None = None, strict: bool = True) -> DataFrame:
    """Equal-width histogram per group between the group's min and max
    (last bin closed).  When ``lo``/``hi`` columns are given, only values
    strictly (or inclusively) inside them are counted first."""
    x = F.col(col)
    d = df
    if lo and hi:
        d = d.filter((x > F.col(lo)) & (x < F.col(hi)) if strict else x.between(F.col(lo), F.col(hi)))
    keys = [by] if by else []
    d = d.select(*keys, x.alias("_x"))
    if keys:
        # bounds: one row per group, joined back (broadcast where their size allows)
        bounds = d.groupBy(*keys).agg(F.min("_x").alias("lo"), F.max("_x").alias("hi"))
        d = d.join(bounds, keys)
    else:
        b = d.agg(F.min("_x").alias("lo"), F.max("_x").alias("hi")).first()
        d = d.withColumn("lo", F.lit(b["lo"])).withColumn("hi", F.lit(b["hi"]))
    width = (F.col("hi") - F.col("lo")) / F.lit(bins)
    b = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("_x") - F.col("lo")) / width), F.lit(bins - 1))).cast("int")
    return (d.groupBy(*keys, "lo", "hi", b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
            .select(*keys, "bin", (F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / F.lit(bins)).alias("bin_start"),
                    "n"))


def age_by_outcome(df: DataFrame, age: str = "age", death: str = "dt_deces") -> DataFrame:
    """Number of cases per rounded age and outcome."""
    from wavecohort.functions.keys import outcome_label, round_int
    return df.groupBy(round_int(age).alias("age"), outcome_label(death).alias("outcome")).agg(
        F.count(F.lit(1)).alias("n"))


def outcome_rate(df: DataFrame, flag) -> DataFrame:
    """Both definitions: ``rate`` = dead / total × 100 and ``odds`` =
    dead / alive × 100 (the latter is what two source cells compute)."""
    f = F.col(flag) if isinstance(flag, str) else flag
    dead = F.sum(F.when(f, F.lit(1)).otherwise(F.lit(0)))
    alive = F.sum(F.when(f, F.lit(0)).otherwise(F.lit(1)))
    return df.agg(dead.alias("dead"), alive.alias("alive")).select(
        F.col("dead").cast("long"), F.col("alive").cast("long"),
        F.try_divide(F.col("dead") * 100.0, F.col("dead") + F.col("alive")).alias("rate"),
        F.try_divide(F.col("dead") * 100.0, F.col("alive")).alias("odds"))


def group_count(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Number of rows sharing the row's value of ``col``
    (``transform('count')``), NULL values counted together.

    Aggregate (partial before the shuffle) then join back; AQE broadcasts the
    aggregate when its measured size is small, so a hot value never lands in
    one task (a window over ``col`` would put all its rows in one).
    """
    out = out or f"C_{col}"
    cnt = df.groupBy(col).agg(F.count(F.lit(1)).alias(out))
    return df.join(cnt, df[col].eqNullSafe(cnt[col]), "left").drop(cnt[col])


def count_measures(useful: DataFrame, codes: list) -> DataFrame:
    """Number of kept measures of ``codes``."""
    return useful.filter(F.col("id_measure_type").isin(list(codes))).agg(F.count(F.lit(1)).alias("n"))
