"""S3: a keyed store, as a Python data source.

:func:`write_keyed` lays rows out by ranges of a key (and of clustering columns inside a
key): one sorted Parquet file per range, and a small table ``ranges`` with every file's
least and greatest key.  :func:`read_keyed` reads chosen keys, a range of keys or all, one
partition per file that can hold them; the choice is exact, and the plan shows it under
``PushedFilters``.

The choice is part of the relation (reader options).  A filter that the plan brings later never
changes what the reader returns: Spark 4.1 keeps one reader per relation, so with filters kept
from the plan a union of two filters over one relation reads the rows of the last one twice.
Such filters stay in Spark, but for those that the choice implies, which are taken as done.

A key of any size is cut at its clustering columns, so a hot key spreads over many files
as long as these differ.  Null keys are kept (they sort first); a choice of keys leaves them out.
The store lies in a folder that all executors reach; files are opened by pyarrow, which
knows local and mounted folders, hdfs, s3 and gs.  An empty table makes an empty store.  A store
whose write was cut short has no ``ranges`` and raises.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThanOrEqual,
)

#: Types whose order is the same in Spark, Python and Arrow; keys are of these.
COMPARABLE = (T.StringType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType)

#: Schema that Spark's Parquet writer leaves in every file.
SPARK_SCHEMA = b"org.apache.spark.sql.parquet.row.metadata"


def write_keyed(df: DataFrame, path: str, key: str, cluster: list[str] | None = None, parts: int | None = None) -> None:
    """Write ``df`` as a keyed store under ``path`` (which must not exist yet).

    ``cluster`` orders the rows of a key and splits large ones; ``parts`` fixes the number of
    ranges (default: as many as AQE finds for its target size).
    """
    if not isinstance(df.schema[key].dataType, COMPARABLE):
        raise ValueError(f"{key}: a key is a string, an integer or a date, not {df.schema[key].dataType.simpleString()}")
    order = [key, *(cluster or [])]
    ranged = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).write.parquet(f"{path}/rows")
    k = F.col(key)
    (df.sparkSession.read.schema(df.schema).parquet(f"{path}/rows").groupBy(F.col("_metadata.file_name").alias("file"))
     .agg(F.min(k).alias("lo"), F.max(k).alias("hi")).coalesce(1).write.parquet(f"{path}/ranges"))


def read_keyed(spark: SparkSession, path: str, key: str, keys: list | None = None, first=None, last=None,
               columns: list[str] | None = None) -> DataFrame:
    """Rows of the store under ``path`` whose ``key`` is one of ``keys`` and lies from ``first`` to ``last``
    (both included; None: no such limit), with ``columns`` only where given."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(KeyedSource)
    choice = {"key": key, "keys": None if keys is None else sorted({k for k in keys if k is not None}), "first": first, "last": last}
    read = spark.read.format(KeyedSource.name()).option("choice", json.dumps(choice, default=str))
    if columns is not None:
        read = read.option("columns", json.dumps(columns))
    rows, k = read.load(path), F.col(key)
    for limit, test in ((keys, lambda: k.isin(choice["keys"])), (first, lambda: k >= F.lit(first)), (last, lambda: k <= F.lit(last))):
        rows = rows if limit is None else rows.filter(test())
    return rows if columns is None else rows.select(*columns)


def _dataset(path: str, part: str):
    import pyarrow.dataset as ds
    from pyarrow.fs import FileSystem
    fs, root = FileSystem.from_uri(path)
    return ds.dataset(f"{root}/{part}", filesystem=fs, format="parquet")


class KeyedSource(DataSource):
    """``format("keyed")`` with the options that :func:`read_keyed` sets."""

    @classmethod
    def name(cls) -> str:
        return "keyed"

    def schema(self) -> T.StructType:
        found = _dataset(self.options["path"], "rows").schema.metadata[SPARK_SCHEMA]
        whole = T.StructType.fromJson(json.loads(found))
        if "columns" not in self.options:
            return whole
        names = json.loads(self.options["columns"])
        key = json.loads(self.options["choice"])["key"]
        return T.StructType([whole[name] for name in dict.fromkeys([*names, key])])

    def reader(self, schema: T.StructType) -> "KeyedReader":
        choice = json.loads(self.options["choice"])
        to = date.fromisoformat if isinstance(schema[choice["key"]].dataType, T.DateType) else (lambda v: v)
        return KeyedReader(self.options["path"], schema, Choice(
            choice["key"], None if choice["keys"] is None else [to(v) for v in choice["keys"]],
            None if choice["first"] is None else to(choice["first"]), None if choice["last"] is None else to(choice["last"])))


@dataclass
class Choice:
    """Keys to read: one of ``keys`` (sorted), from ``first`` to ``last``; None sets no limit."""

    key: str
    keys: list | None = None
    first: object = None
    last: object = None

    @property
    def all(self) -> bool:
        return self.keys is None and self.first is None and self.last is None

    def may_hold(self, lo, hi) -> bool:
        """Can a file with keys from ``lo`` to ``hi`` (None: null keys only) hold a chosen key?"""
        if self.all:
            return True
        if lo is None or (self.first is not None and hi < self.first) or (self.last is not None and lo > self.last):
            return False
        if self.keys is None:
            return True
        at = bisect_left(self.keys, lo)
        return at < len(self.keys) and self.keys[at] <= hi

    def implies(self, f) -> bool:
        """Does every chosen row pass ``f``?"""
        if self.all or getattr(f, "attribute", None) != (self.key,):
            return False
        if isinstance(f, IsNotNull):
            return True
        if isinstance(f, (EqualTo, In)):
            passed = set(f.value) if isinstance(f, In) else {f.value}
            return self.keys is not None and passed.issuperset(self.keys)
        if isinstance(f, GreaterThanOrEqual):
            return self.first is not None and f.value <= self.first
        return isinstance(f, LessThanOrEqual) and self.last is not None and f.value >= self.last

    def test(self, kind):
        """The choice as an Arrow expression (None: all rows); ``kind`` is the key's Arrow type."""
        import pyarrow as pa
        import pyarrow.dataset as ds
        column, tests = ds.field(self.key), []
        if self.keys is not None:
            # null keys are no member: isin would match them only if null were listed
            tests.append(column.isin(pa.array(self.keys, kind)))
        if self.first is not None:
            tests.append(column >= pa.scalar(self.first, kind))
        if self.last is not None:
            tests.append(column <= pa.scalar(self.last, kind))
        return reduce(lambda a, b: a & b, tests) if tests else None


@dataclass
class FilePart(InputPartition):
    """One file of the store (None: nothing to read)."""

    file: str | None


class KeyedReader(DataSourceReader):
    """Files that can hold chosen keys, and in them the rows that do."""

    def __init__(self, path: str, schema: T.StructType, choice: Choice):
        self.path, self.schema, self.choice = path, schema, choice

    def pushFilters(self, filters):
        return [f for f in filters if not self.choice.implies(f)]

    def partitions(self):
        files = _dataset(self.path, "ranges").to_table().to_pylist()
        kept = sorted(r["file"] for r in files if self.choice.may_hold(r["lo"], r["hi"]))
        return [FilePart(file) for file in kept] or [FilePart(None)]

    def read(self, partition):
        if partition.file is None:
            return
        from pyspark.sql.pandas.types import to_arrow_schema
        rows = _dataset(self.path, f"rows/{partition.file}")
        out = to_arrow_schema(self.schema)
        for batch in rows.to_batches(columns=out.names, filter=self.choice.test(rows.schema.field(self.choice.key).type),
                                     batch_size=16384):
            if batch.num_rows:
                yield batch.cast(out)
