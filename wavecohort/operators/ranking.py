"""Top-k, ranks, pivots, splits into blocks."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavecohort.functions.ranges import range_bucket
from wavecohort.operators.evaluate import running_sums


def window_bounds(day: Column, lo: Column, hi: Column, back_days: int = 30) -> list[Column]:
    """Clamp ``day`` (a timestamp) to ``[lo, hi]``; derive yesterday and
    ``back_days`` ago (never before ``lo``), their ``MMdd`` keys and the hour."""
    today = F.when(day < lo, lo).when(day > hi, hi).otherwise(day)
    yesterday = F.greatest(lo, today - F.expr("INTERVAL 1 DAY"))
    month_ago = F.greatest(lo, today - F.make_dt_interval(days=F.lit(back_days)))
    return [today.alias("today"), yesterday.alias("yesterday"), month_ago.alias("month_ago"),
            F.date_format(today, "MMdd").alias("today_md"), F.date_format(yesterday, "MMdd").alias("yesterday_md"),
            F.date_format(month_ago, "MMdd").alias("month_ago_md"), F.hour(today).alias("hour")]


def pages_in_window(counts: DataFrame, today_md: str, first_md: str, hour: int, full_days: bool) -> DataFrame:
    """Rows of the rolling window as ONE disjunctive predicate over one scan
    (the source unions separate filtered scans): from ``hour`` on the first
    day, every full day in between (30-day form), and before ``hour`` today.
    The ``month_day``/``hour`` columns are partition keys of a partitioned
    store, so the predicate also prunes partitions."""
    md, hr = F.col("month_day"), F.col("hour")
    cond = ((md == first_md) & (hr >= hour)) | ((md == today_md) & (hr < hour))
    if full_days:
        # a window across New Year wraps around in MMdd order
        between = (md > first_md) & (md < today_md) if first_md <= today_md else (md > first_md) | (md < today_md)
        cond = cond | between
    return counts.filter(cond)


def top_pages_at(counts: DataFrame, at: datetime, back_days: int, k: int = 20, first: datetime | None = None,
                 last: datetime | None = None, day: str = "day") -> DataFrame:
    """T1/T2 from a moment (K16): ``at`` is clamped to ``[first, last]``, the window goes
    ``back_days`` back (never before ``first``) and ends before ``at``'s hour.  ``counts``
    has a DATE column ``day`` (a partition key of the store) and ``hour``; dates keep
    years apart and need no wrap-around."""
    at = min(max(at, first or at), last or at)
    start = max(at - timedelta(days=back_days), first or datetime.min)
    d, h = F.col(day), F.col("hour")
    lo, hi = F.lit(start.date()), F.lit(at.date())
    w = counts.filter((d >= lo) & (d <= hi) & ((d > lo) | (h >= start.hour)) & ((d < hi) | (h < at.hour)))
    agg = w.groupBy("prj", "page").agg(F.sum("hits").alias("sum_hits"))
    return agg.orderBy(F.desc("sum_hits"), "prj", "page").limit(k)


def day_totals(hours: DataFrame, day: str = "day") -> DataFrame:
    """Rollup of hourly counts for :func:`top_pages_rolled`: hits per (day, prj, page)."""
    return hours.groupBy(day, "prj", "page").agg(F.sum("hits").alias("hits"))


def top_pages_rolled(days: DataFrame, hours: DataFrame, at: datetime, back_days: int, k: int = 20, first: datetime | None = None,
                     last: datetime | None = None, day: str = "day") -> DataFrame:
    """T1/T2 from two levels of partial sums, same result as :func:`top_pages_at`: the whole days of the window come from
    ``days`` (:func:`day_totals`), the hours of its two edge days from ``hours``.  With both stores partitioned by ``day`` a
    window reads two days of hourly rows whatever its length."""
    at = min(max(at, first or at), last or at)
    start = max(at - timedelta(days=back_days), first or datetime.min)
    d, h, lo, hi = F.col(day), F.col("hour"), F.lit(start.date()), F.lit(at.date())
    if start.date() == at.date():
        edges = (d == lo) & (h >= start.hour) & (h < at.hour)
    else:
        edges = d.isin(start.date(), at.date()) & (((d == lo) & (h >= start.hour)) | ((d == hi) & (h < at.hour)))
    w = days.filter((d > lo) & (d < hi)).select("prj", "page", "hits").unionAll(hours.filter(edges).select("prj", "page", "hits"))
    agg = w.groupBy("prj", "page").agg(F.sum("hits").alias("sum_hits"))
    return agg.orderBy(F.desc("sum_hits"), "prj", "page").limit(k)


def top_pages(counts: DataFrame, today_md: str, first_md: str, hour: int, k: int = 20,
              full_days: bool = False) -> DataFrame:
    """T1/T2 + A19: top-``k`` (prj, page) by summed hits in the window.

    ``orderBy(...).limit(k)`` plans as TakeOrderedAndProject: each task keeps
    its own top k, only k rows per task reach the final merge.  Ties are
    broken by (prj, page) so the result is deterministic.
    """
    w = pages_in_window(counts, today_md, first_md, hour, full_days)
    agg = w.groupBy("prj", "page").agg(F.sum("hits").alias("sum_hits"))
    return agg.orderBy(F.desc("sum_hits"), "prj", "page").limit(k)


#: Rows that give the bounds of :func:`sequence_in_group`'s buckets, and buckets.
ORDER_SAMPLE, ORDER_BUCKETS = 2048, 64


def order_bounds(df: DataFrame, by: str, order: list[str]) -> list:
    """Distinct bounds that cut the first order column into at most :data:`ORDER_BUCKETS` parts of about equal rows."""
    sample = (df.select(by, *order).filter(F.col(order[0]).isNotNull()).withColumn("_h", F.xxhash64(by, *order))
              .orderBy("_h").limit(ORDER_SAMPLE).select(order[0]).collect())
    values = sorted(r[0] for r in sample)
    return sorted({values[i * len(values) // ORDER_BUCKETS] for i in range(1, ORDER_BUCKETS)}) if values else []


def sequence_in_group(df: DataFrame, by: str, order: list[str], out: str = "seq") -> DataFrame:
    """1..n within each group in the given (ascending) order.

    A group of any size is ranked in buckets of its first order column, and offsets of one row a bucket are
    added.  The bounds come from :data:`ORDER_SAMPLE` rows (the least hashes); they set how evenly
    rows spread, never the result.  Rows equal in that column share a bucket; nulls come first.
    """
    bounds = order_bounds(df, by, order)
    ranked = running_sums(df.withColumn("_one", F.lit(1)), range_bucket(F.col(order[0]), bounds), [F.col(c) for c in order], ["_one"], [by], prefix="_rank")
    return ranked.withColumn(out, F.col("_rank_one").cast("int")).drop("_one", "_rank_one")


def weights_matrix(df: DataFrame, row: str, col: str, value: str, values: list, fill: float | None = None) -> DataFrame:
    """T4: pivot ``value`` to a ``row × col`` matrix with an explicit column
    list; NULL stays NULL unless ``fill`` is given (the source's fill result
    is discarded)."""
    m = df.groupBy(row).pivot(col, list(values)).agg(F.first(value))
    return m.na.fill(fill) if fill is not None else m


def top_k(df: DataFrame, order: list, k: int) -> DataFrame:
    """First ``k`` rows of an ordering (a top-k report)."""
    return df.orderBy(*order).limit(k)


def split_blocks(df: DataFrame, key: str, n: int, seed: int = 42, out: str = "block") -> DataFrame:
    """Stable pseudo-random block number in ``[0, n)`` from the leading digits of
    ``md5(key || seed)``, as a column (no driver-side batching needed)."""
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed))))
    return df.withColumn(out, F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), F.lit(n)).cast("int"))
