"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavecohort.session import byte_size, shared_path

#: Limits of what a task holds of texts at a time: rows and bytes of a batch sent to a worker, rows that
#: a scan decodes at once.
BATCH_ROWS, BATCH_BYTES, SCAN_ROWS = 1000, 4 << 20, 512
VOCABULARY = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Place of a public vocabulary file (installed alike on every machine)."""
    import public_tokenizers
    return public_tokenizers.path(name)


def staged(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back: cuts the
    lineage, and fixes the values of row numbers and partition numbers in it."""
    path = shared_path(df.sparkSession, f"llm-{name}-{uuid.uuid4().hex[:8]}")
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _bounded(spark: SparkSession) -> None:
    """Lower the session's batch sizes to the limits above; smaller ones stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES),
                      ("spark.sql.parquet.columnarReaderBatchSize", SCAN_ROWS)):
        have = spark.conf.get(key)
        if not 0 < (int(have) if have.lstrip("-").isdigit() else byte_size(spark, have)) <= most:
            spark.conf.set(key, str(most))


def release() -> None:
    """Give freed memory back to the system (worker side).  A worker lives on over all stages of
    an application, and would hold the peak of each."""
    import ctypes

    import pyarrow as pa
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)              # glibc's; others have none
    if trim:
        trim(0)


def map_batches(df: DataFrame, fn, schema) -> DataFrame:
    """``mapInArrow`` with batches of at most ``BATCH_ROWS`` rows and about ``BATCH_BYTES``, so that a
    worker holds a few megabytes of text at a time, and what it freed is released after each."""
    _bounded(df.sparkSession)

    def run(batches):
        for out in fn(batches):
            yield out
            del out
            release()
        release()
    return df.mapInArrow(run, schema)


def lean(fn):
    """Worker function of a group or co-group that releases what it freed."""
    def run(*tables):
        try:
            return fn(*tables)
        finally:
            release()
    # Spark tells functions with and without a key by their number of arguments
    return (lambda table: run(table)) if fn.__code__.co_argcount == 1 else (lambda left, right: run(left, right))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have (names compare without case)."""
    have = {c.lower() for c in df.columns}
    name = base
    while name.lower() in have:
        name = "_" + name
    return name
