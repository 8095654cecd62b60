"""Table scans, sinks and catalog helpers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wavecohort.session import shared_path


def read_table(spark: SparkSession, name_or_path: str, schema: StructType | None = None,
               fmt: str = "parquet", options: dict | None = None) -> DataFrame:
    """A named-column table from a catalog name or a path.

    A name without a path separator resolves through the catalog; otherwise
    ``fmt`` picks the reader (``parquet``, ``csv``, ``jdbc`` or any DSv2 source
    such as a keyed store, whose ``options`` carry keyspace/table).  Filters and
    projections applied afterwards are pushed into the scan by Catalyst.
    """
    if fmt == "parquet" and "/" not in name_or_path and spark.catalog.tableExists(name_or_path):
        return spark.table(name_or_path)
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if options:
        reader = reader.options(**options)
    return reader.load(name_or_path) if fmt != "jdbc" else reader.load()


def write_table(df: DataFrame, path: str, mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    """Parquet sink, optionally partitioned (e.g. by day) for pruning."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def load_ticks(spark: SparkSession, path: str, time_col: str = "timestamp",
               unit: str = "ms", schema: StructType | str | None = None) -> tuple[DataFrame, DataFrame]:
    """CSV with a header and an integer tick column.

    Returns ``(df, period)`` where ``df`` gains ``ts`` (TIMESTAMP_NTZ from the
    tick in ``unit``) and ``period`` is a one-row frame with the sample period
    = floor(last tick / row count), the integer division of the source.
    """
    r = spark.read.option("header", "true")
    r = r.schema(schema) if schema is not None else r.option("inferSchema", "true")
    df = r.csv(path)
    return with_tick_ts(df, time_col, unit), sample_period(df, time_col)


def with_tick_ts(df: DataFrame, time_col: str, unit: str = "ms") -> DataFrame:
    from wavecohort.functions.keys import ntz_from_epoch_us
    mult = {"s": 1_000_000, "ms": 1_000, "us": 1}[unit]
    return df.withColumn("ts", ntz_from_epoch_us(F.col(time_col).cast("long") * F.lit(mult)))


def sample_period(df: DataFrame, time_col: str) -> DataFrame:
    """Sample period estimate in one aggregate: floor(max(tick) / count)."""
    return df.agg(F.floor(F.max(time_col) / F.count(F.lit(1))).alias("period"),
                  F.max(time_col).alias("last_tick"), F.count(F.lit(1)).alias("n_rows"))


# ---------------------------------------------------------------- catalog

def table_exists(spark: SparkSession, name: str) -> bool:
    """Catalog lookup, no scan."""
    return spark.catalog.tableExists(name)


def drop_table(spark: SparkSession, name: str) -> None:
    """DROP TABLE IF EXISTS."""
    spark.sql(f"DROP TABLE IF EXISTS {_ident(name)}")


def materialize(df: DataFrame, name: str, if_absent: bool = True) -> DataFrame:
    """Create-table-as-select, reused when present.

    Unlike the source, errors are raised, never swallowed.  The written table
    also cuts the lineage of the plan that produced it.
    """
    spark = df.sparkSession
    if not (if_absent and spark.catalog.tableExists(name)):
        df.write.mode("overwrite").saveAsTable(_ident(name))
    return spark.table(name)


def replace_table(spark: SparkSession, name: str, df: DataFrame) -> DataFrame:
    """Replace a table by an adjusted version of itself.

    The new version is written to a fresh location first (never over the path
    being read); the old table is set aside, the new one takes its name, and only
    then is the old one dropped.
    """
    tmp = f"{name}__new_{uuid.uuid4().hex[:8]}"
    df.write.mode("overwrite").saveAsTable(_ident(tmp))
    old = f"{name}__old_{uuid.uuid4().hex[:8]}"
    if spark.catalog.tableExists(name):
        # a crash between the renames leaves both versions in the catalog
        spark.sql(f"ALTER TABLE {_ident(name)} RENAME TO {_ident(old)}")
    spark.sql(f"ALTER TABLE {_ident(tmp)} RENAME TO {_ident(name)}")
    spark.sql(f"DROP TABLE IF EXISTS {_ident(old)}")
    return spark.table(name)


def checkpoint_to_shared(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back.

    Cuts lineage so that a lost executor re-reads the written stage instead of
    recomputing the whole plan.
    """
    path = shared_path(df.sparkSession, f"{name}-{uuid.uuid4().hex[:8]}")
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def forget(df: DataFrame, name: str) -> None:
    """Delete what :func:`checkpoint_to_shared` wrote under ``name`` for ``df``, after its last reader."""
    jvm = df.sparkSession.sparkContext._jvm
    for folder in {jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)).getParent().toString() for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if path.getName().startswith(f"{name}-"):
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _ident(name: str) -> str:
    return ".".join(f"`{p}`" for p in name.split("."))


# ---------------------------------------------------------------- models

def save_model(model, path: str) -> None:
    """Persist a fitted pyspark.ml model or pipeline."""
    model.write().overwrite().save(path)


def load_model(path: str):
    """Load a model saved by :func:`save_model` (pipeline or single stage)."""
    from pyspark.ml import PipelineModel, classification
    from pyspark.ml.util import DefaultParamsReader
    from pyspark.sql import SparkSession
    meta = DefaultParamsReader.loadMetadata(path, SparkSession.getActiveSession())
    name = meta["class"].rsplit(".", 1)[1]
    if name == "PipelineModel":
        return PipelineModel.load(path)
    kind = getattr(classification, name, None)
    if kind is None:
        raise ValueError(f"not a saved classifier or pipeline: {meta['class']}")
    return kind.load(path)
