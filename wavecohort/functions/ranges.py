"""Order-preserving bucket numbers as functions of the row.

A running sum or a global rank can be split by such a bucket: sums inside each
bucket and offsets per bucket.  The bucket must depend on the row's own value only;
a range partitioning that samples its bounds can differ between two branches of
one plan.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hex_bucket(h: Column, digits: int = 3) -> Column:
    """Bucket of a hexadecimal digest by its leading digits (16^digits buckets)."""
    return F.conv(F.substring(h, 1, digits), 16, 10).cast("int")


def quantile_bounds(df: DataFrame, column: str, n: int) -> list:
    """At most ``n - 1`` distinct finite bounds at approximate quantiles (one aggregate
    job; the result is a list of numbers that enters plans as literals)."""
    if n < 2:
        return []
    got = df.agg(F.percentile_approx(column, [i / n for i in range(1, n)], 10_000).alias("q")).first()["q"] or []
    return sorted({x for x in got if x is not None and not (isinstance(x, float) and not math.isfinite(x))})


def range_bucket(column: Column, bounds: list) -> Column:
    """Number of ``bounds`` that are ``<= column`` (nulls: -1), by nested comparisons."""
    def tree(a: int, b: int) -> Column:
        if a == b:
            return F.lit(a)
        m = (a + b) // 2
        return F.when(column < F.lit(bounds[m]), tree(a, m)).otherwise(tree(m + 1, b))
    return F.when(column.isNull(), F.lit(-1)).otherwise(tree(0, len(bounds)))
