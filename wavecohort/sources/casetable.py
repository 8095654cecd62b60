"""Case-table and wave-tensor sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavecohort.functions.keys import split_case_id


def case_table_frame(df: DataFrame, vois: list[str], id_col: str = "id_ndaj1") -> DataFrame:
    """S6 transform: split the string case id into ``id_nda`` and a typed ``j1``
    date, keep the VOI counts, keep dates typed (no string sentinels)."""
    nda, j1 = split_case_id(id_col)
    keep = [c for c in ("dt_deces", "dt_min", "dt_max", "dpt", "cd_sex_tr", "stay_len_s") if c in df.columns]
    return df.select(nda.alias("id_nda"), F.to_date(j1).alias("j1"), *vois, *keep)


def stored_case_table(df: DataFrame) -> DataFrame:
    """The case table as the source stores it: every date as text and the
    death date as the ``'None'`` sentinel when absent."""
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("None")).alias(c) if c == "dt_deces"
                       else (F.col(c).cast("string").alias(c) if c in ("j1", "dt_min", "dt_max") else F.col(c))
                       for c in df.columns])


def case_features(stored: DataFrame) -> DataFrame:
    """Load stored cases with typed columns: ``j1`` DATE, window bounds
    TIMESTAMP, sentinel death dates as NULL."""
    from wavecohort.functions.keys import to_ts
    out = stored
    for c in ("dt_min", "dt_max", "dt_deces"):
        if c in out.columns:
            out = out.withColumn(c, to_ts(c))
    if "j1" in out.columns:
        out = out.withColumn("j1", F.to_date("j1"))
    if "id_nda" in out.columns:
        out = out.withColumn("id_nda", F.col("id_nda").cast("string"))
    return out


def save_case_table(df: DataFrame, path: str, vois: list[str], id_col: str = "id_ndaj1") -> None:
    """Write the case table (overwrite)."""
    case_table_frame(df, vois, id_col).write.mode("overwrite").parquet(path)


def tensor_frame(long: DataFrame, case: str = "case", voi: str = "voi", idx: str = "idx",
                 value: str = "value", outcome: str = "outcome") -> DataFrame:
    """Long ``(case, outcome, voi, idx, value)`` → ``(case, outcome, waves ARRAY<ARRAY<DOUBLE>>)``.

    Rows of one case are collected into one array: a case holds d × n values
    (a few hundred), bounded by the grid, not by the data.
    """
    per_voi = (long.groupBy(case, outcome, voi)
               .agg(F.array_sort(F.collect_list(F.struct(F.col(idx).alias("i"), F.col(value).alias("v")))).alias("pts")))
    return (per_voi.groupBy(case, outcome)
            .agg(F.array_sort(F.collect_list(F.struct(F.col(voi).alias("k"), F.col("pts.v").alias("w")))).alias("rows"))
            .select(F.col(case).alias("case"), F.col(outcome).alias("outcome"), F.col("rows.w").alias("waves")))


def write_tensor(df: DataFrame, path: str) -> None:
    """One Parquet table ``(case, outcome, waves)``, aligned by column, not position."""
    df.write.mode("overwrite").parquet(path)


def read_tensor(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def tensors_equal(a: DataFrame, b: DataFrame) -> bool:
    """S7 check: equal as multisets (``exceptAll`` both ways is empty)."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
