"""SparkSession construction and shared session helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on: UTC wall clock (the test tables hold
# TIMESTAMP_NTZ values, oracle comparisons are done in UTC) and AQE so that
# shuffle partition counts and skewed joins are re-planned at run time.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def cluster_conf(executors: int, cores_per_executor: int, target_partition_mb: int = 128) -> dict:
    """Settings for a large cluster run (e.g. 1000 executors over ~100 TB).

    Scan splits of 256 MB, AQE starting from ~3 shuffle partitions per core
    and coalescing toward ``target_partition_mb``-sized partitions, so a
    shuffle partition fits in executor memory and spills rarely; skewed
    partitions above 5× the median (and 256 MB) are split.
    """
    cores = executors * cores_per_executor
    return {
        "spark.sql.files.maxPartitionBytes": "256m",
        "spark.sql.shuffle.partitions": str(3 * cores),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(3 * cores),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": f"{target_partition_mb}m",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256m",
        "spark.sql.autoBroadcastJoinThreshold": "64m",
    }


def get_spark(master: str | None = None, app: str = "wavecohort",
              shuffle_partitions: int | None = None, conf: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the engine's defaults.

    ``master`` is only set when given, so that ``spark-submit`` on a cluster
    keeps its own master URL.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in _DEFAULTS.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (conf or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


# Runtime SQL settings the plans rely on; they change plans, never results.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join partition even when that costs an extra shuffle
    # (the join feeds an aggregate on the same key): a stay with a third of
    # all measures must not sit in one task
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

# Shuffle partitions are merged up to this size (compressed) and no further.  The cohort joins and aggregates a
# stay's rows in one stage of a dozen operators that all hold memory: at Spark's own 64 MB a task of it grew with
# the input up to several GB.  A session's smaller size stays.
_ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
PARTITION_SIZE = "8m"


def apply_runtime_conf(spark: SparkSession) -> None:
    """Set the engine's runtime SQL settings on an existing session (e.g. one
    created by a job driver), make sure a checkpoint folder is known and that
    the Python workers can import this package."""
    for k, v in RUNTIME_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    if byte_size(spark, spark.conf.get(_ADVISORY)) > byte_size(spark, PARTITION_SIZE):
        spark.conf.set(_ADVISORY, PARTITION_SIZE)
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def byte_size(spark: SparkSession, size: str) -> int:
    """Bytes of a size as settings give it (``8m``)."""
    return spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(size)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Distribute the package to the executors' Python workers once per
    application (``addPyFile`` of a zip of its sources; the driver's file
    server hands it to every executor), so pandas UDFs and ``applyInPandas``
    functions that call package helpers resolve wherever the workers run."""
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    import zipfile
    import wavecohort
    pkg = os.path.dirname(os.path.abspath(wavecohort.__file__))
    zpath = os.path.join(tempfile.mkdtemp(prefix="wavecohort-pyfiles-"), "wavecohort.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(zpath)
    _SHIPPED.add(app)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    On a cluster this points at shared storage and is only read.  When the
    setting is absent (local tests) a fresh scratch folder is used as the
    context's checkpoint directory.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(d)
        return d
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    d = tempfile.mkdtemp(prefix="wavecohort-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def session_key(spark: SparkSession) -> tuple:
    """Identity of a session for per-session caches: the application id and
    the session object (a stopped session's successor never matches)."""
    return (spark.sparkContext.applicationId, id(spark))


def shared_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder, for materialised stages."""
    return os.path.join(ensure_checkpoint_dir(spark), name)
