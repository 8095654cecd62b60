"""Wave (irregular time series) operators in long form.

A series is identified by ``keys`` (e.g. ``["id_case", "voi"]``); after
resampling a series is ``(keys..., idx, value)`` with ``idx`` on a grid.
Windows are always partitioned by the series (or by case and grid point), so
a partition holds one series of at most ``n`` points, whatever the data size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavecohort.functions.keys import day_start, epoch_us, ntz_from_epoch_us

US_PER_MIN = 60_000_000


def waves_from_measures(measures: DataFrame, voi_codes: DataFrame, limits: DataFrame,
                        case: str = "id_case", vois: list[str] | None = None) -> DataFrame:
    """Measures split by VOI, kept when inside the VOI's limits (inclusive);
    a case losing every value of one VOI is dropped whole.

    ``voi_codes`` (voi, code) and ``limits`` (voi, min_limit, max_limit) are
    dimensions with one row per code / VOI: broadcast.
    """
    vc = F.broadcast(voi_codes.select("voi", F.col("code").alias("id_measure_type")))
    lim = F.broadcast(limits.select("voi", "min_limit", "max_limit"))
    m = (measures.join(vc, "id_measure_type").join(lim, "voi")
         .filter(F.col("value_numeric").between(F.col("min_limit"), F.col("max_limit")))
         .select(case, "voi", "dt_insert", "value_numeric"))
    n_vois = len(vois) if vois is not None else None
    if n_vois is None:
        n_vois_col = F.lit(limits.select("voi").distinct().count())
    else:
        n_vois_col = F.lit(n_vois)
    full = (m.groupBy(case).agg(F.count_distinct("voi").alias("_k"))
            .filter(F.col("_k") == n_vois_col).select(case))
    return m.join(full, case, "left_semi")


def grid_step(cases: DataFrame, n: int, floor_one: bool = True) -> Column:
    """Resampling step in whole minutes, ``round((dt_max − dt_min)/n/60 s)``
    with half-even rounding; at least one minute (the source divides by zero)."""
    span_s = (epoch_us("dt_max") - epoch_us("dt_min")) / 1e6
    step = F.bround(span_s / F.lit(n) / F.lit(60.0), 0).cast("long")
    return F.greatest(step, F.lit(1)) if floor_one else step


def resample(series: DataFrame, keys: list[str], step_min: str, n: int, t0: str | None = None,
             time: str = "dt_insert", value: str = "value_numeric") -> DataFrame:
    """Mean per bin of ``step_min`` minutes (a column), ``n`` bins kept.

    Bins start at midnight of the first tick's day (the origin ``pandas``
    uses); the first tick is the earliest of the series and ``t0`` (the case's
    window start added as an empty tick), so VOIs may each start at their own
    first tick.  Trailing bins beyond ``n`` are dropped; missing bins are
    produced as NULL by :func:`fill_grid`.

    Returns ``(keys..., idx, value)`` for non-empty bins only.
    """
    # Per-series first tick by aggregation (partial before the shuffle) and a
    # join back: a hot series is split by AQE's skew-join handling, which a
    # window over the raw measures could not do.
    firsts = series.groupBy(*keys).agg(F.min(time).alias("_t0"))
    d = series.join(firsts, keys)
    if t0 is not None:
        d = d.withColumn("_t0", F.least(F.col("_t0"), F.col(t0)))
    step_us = F.col(step_min) * F.lit(US_PER_MIN)
    mid = epoch_us(day_start("_t0"))
    b = F.floor((epoch_us(time) - mid) / step_us)
    b0 = F.floor((epoch_us("_t0") - mid) / step_us)
    d = d.select(*keys, (b - b0).cast("int").alias("idx"), F.col(value).alias("_v"))
    return d.filter(F.col("idx") < n).groupBy(*keys, "idx").agg(F.avg("_v").alias("value"))


def fill_grid(binned: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Dense grid ``0..n-1`` per series, NULL where a bin is empty.

    The non-empty bins of a series (at most ``n``) are gathered into a map and
    the grid is generated from ``sequence``: one shuffle, and the output stays
    partitioned by the series, which the interpolation windows reuse.
    """
    m = binned.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("idx", "value"))).alias("_m"))
    g = m.select(*keys, "_m", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("idx"))
    return g.select(*keys, "idx", F.element_at("_m", F.col("idx")).alias("value"))


def resample_waves(measures: DataFrame, voi_codes: DataFrame, limits: DataFrame, cases: DataFrame,
                   vois: list[str], n: int, case: str = "id_case", anchor: str = "series") -> DataFrame:
    """W1 + W3 + W4 fused for a cohort: limits, complete-case rule, per-series
    first tick and binning with a single join of the measures.

    ``anchor='series'`` (the source's behaviour) starts each VOI at its own
    first tick (or the case's ``dt_min`` if earlier); ``anchor='case'`` starts
    every VOI of a case at the case's earliest tick, so the VOIs are aligned.

    ``cases`` holds ``(case, dt_min, step)``.  The per-series aggregate
    (partial before its shuffle) decides which cases keep every VOI and gives
    each series its first tick; the measures are then joined once to it.
    """
    vc = F.broadcast(voi_codes.select("voi", F.col("code").alias("id_measure_type")))
    lim = F.broadcast(limits.select("voi", "min_limit", "max_limit"))
    m = (measures.join(vc, "id_measure_type").join(lim, "voi")
         .filter(F.col("value_numeric").between(F.col("min_limit"), F.col("max_limit")))
         .select(case, "voi", "dt_insert", "value_numeric"))
    per_series = m.groupBy(case, "voi").agg(F.min("dt_insert").alias("_first"))
    # number of non-empty VOIs of the case: a window over the case's d series
    # rows (bounded by the number of VOIs)
    kept = (per_series.withColumn("_k", F.count(F.lit(1)).over(Window.partitionBy(case)))
            .filter(F.col("_k") == len(vois)).drop("_k"))
    if anchor == "case":
        kept = kept.join(kept.groupBy(case).agg(F.min("_first").alias("_cf")), case).withColumn("_first", F.col("_cf"))
    elif anchor != "series":
        raise ValueError(anchor)
    firsts = (kept.join(cases.select(case, "dt_min", "step"), case)
              .select(case, "voi", "step", F.least("_first", "dt_min").alias("_t0")))
    d = m.join(firsts, [case, "voi"])
    step_us = F.col("step") * F.lit(US_PER_MIN)
    mid = epoch_us(day_start("_t0"))
    idx = (F.floor((epoch_us("dt_insert") - mid) / step_us) - F.floor((epoch_us("_t0") - mid) / step_us)).cast("int")
    return (d.select(case, "voi", idx.alias("idx"), "value_numeric").filter(F.col("idx") < n)
            .groupBy(case, "voi", "idx").agg(F.avg("value_numeric").alias("value")))


def interpolate(grid: DataFrame, keys: list[str], limit: int | None = 30, fill: bool = True,
                value: str = "value", block: int | None = None) -> DataFrame:
    """Time interpolation on an equally spaced grid with the source's gap
    rule: inside a gap the first ``limit`` points lie on the line between the
    neighbours, the rest hold the ``limit``-th value; then forward fill, then
    backward fill.  ``fill=False`` keeps leading NULLs (trailing ones take the
    last value, as linear interpolation does).

    With ``block`` the grid is cut into blocks of that many points: windows
    then run per (series, block), and the nearest known points before and
    after a block are carried between blocks through a table of one row per
    block.  Same result; no task holds a whole long series.
    """
    v = F.col(value)
    known_i = F.when(v.isNotNull(), F.col("idx"))
    if block is None:
        part = keys
        g = grid
    else:
        part = [*keys, "_blk"]
        g = grid.withColumn("_blk", F.floor(F.col("idx") / F.lit(block)).cast("long"))
    w_prev = Window.partitionBy(*part).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    w_next = Window.partitionBy(*part).orderBy("idx").rowsBetween(0, Window.unboundedFollowing)
    g = g.select("*", F.last(v, ignorenulls=True).over(w_prev).alias("_v0"),
                 F.last(known_i, ignorenulls=True).over(w_prev).alias("_i0"),
                 F.first(v, ignorenulls=True).over(w_next).alias("_v1"),
                 F.first(known_i, ignorenulls=True).over(w_next).alias("_i1"))
    if block is not None:
        # one row per (series, block): its last and first known points, then
        # carried to the following / preceding blocks
        kn = g.filter(v.isNotNull())
        per_block = (g.select(*part).distinct()
                     .transform(join_on, kn.groupBy(*part).agg(F.max("idx").alias("_li"), F.max_by(value, "idx").alias("_lv"),
                                                               F.min("idx").alias("_fi"), F.min_by(value, "idx").alias("_fv")),
                                part, "left"))
        wb_prev = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
        wb_next = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(1, Window.unboundedFollowing)
        carry = per_block.select(*part, F.last("_li", ignorenulls=True).over(wb_prev).alias("_ci0"),
                                 F.last("_lv", ignorenulls=True).over(wb_prev).alias("_cv0"),
                                 F.first("_fi", ignorenulls=True).over(wb_next).alias("_ci1"),
                                 F.first("_fv", ignorenulls=True).over(wb_next).alias("_cv1"))
        g = join_on(g, carry, part)
        g = g.select(*[c for c in g.columns if c not in ("_v0", "_i0", "_v1", "_i1", "_ci0", "_cv0", "_ci1", "_cv1")],
                     F.coalesce("_v0", "_cv0").alias("_v0"),
                     F.when(F.col("_i0").isNotNull(), F.col("_i0")).otherwise(F.col("_ci0")).alias("_i0"),
                     F.coalesce("_v1", "_cv1").alias("_v1"),
                     F.when(F.col("_i1").isNotNull(), F.col("_i1")).otherwise(F.col("_ci1")).alias("_i1"))
    k = F.col("idx") - F.col("_i0")
    if limit is not None:
        k = F.least(k, F.lit(limit))
    lin = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * k / (F.col("_i1") - F.col("_i0"))
    out = (F.when(v.isNotNull(), v)
           .when(F.col("_i0").isNotNull() & F.col("_i1").isNotNull(), lin)
           .when(F.col("_i0").isNotNull(), F.col("_v0")))
    if fill:
        out = out.when(F.col("_i1").isNotNull(), F.col("_v1"))
    return g.select(*[c for c in grid.columns if c != value], out.alias(value))


def to_matrix(long: DataFrame, case: str, row: str, extra: list[str] | None = None,
              idx: str = "idx", value: str = "value") -> DataFrame:
    """Long ``(case, row, idx, value)`` → ``(case, extra..., waves ARRAY<ARRAY<DOUBLE>>)``.

    A case collects d × n values (bounded by the grid, not the data).
    """
    extra = extra or []
    per = (long.groupBy(case, *extra, row)
           .agg(F.array_sort(F.collect_list(F.struct(F.col(idx).alias("i"), F.col(value).alias("v")))).alias("p")))
    return (per.groupBy(case, *extra)
            .agg(F.array_sort(F.collect_list(F.struct(F.col(row).alias("r"), F.col("p.v").alias("w")))).alias("rows"))
            .select(case, *extra, F.col("rows.w").alias("waves")))


def scale(long: DataFrame, case: str, method: str = "min_max", axis: str = "point",
          row: str = "voi", value: str = "value") -> DataFrame:
    """Min-max or standard scaling of each case's matrix.

    ``axis='point'`` scales every grid point across the VOIs (what the
    column-wise library scalers do on a VOI × point matrix); ``axis='wave'``
    scales each wave on its own.  Zero range → 0; zero std → divided by 1.
    """
    part = [case, "idx"] if axis == "point" else [case, row]
    w = Window.partitionBy(*part)
    v = F.col(value)
    if method == "min_max":
        lo, hi = F.min(v).over(w), F.max(v).over(w)
        out = F.when(hi == lo, F.lit(0.0)).otherwise((v - lo) / (hi - lo))
    elif method == "standard":
        mu, sd = F.avg(v).over(w), F.stddev_pop(v).over(w)
        out = (v - mu) / F.when(sd == 0, F.lit(1.0)).otherwise(sd)
    else:
        raise ValueError(method)
    return long.withColumn(value, out)


def wave_slope(long: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Least-squares slope and intercept of each wave against ``idx``."""
    return long.groupBy(*keys).agg(F.regr_slope(value, "idx").alias("slope"),
                                   F.regr_intercept(value, "idx").alias("intercept"))


def detrend(long: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Subtract ``slope · idx`` from each wave (the intercept stays)."""
    w = Window.partitionBy(*keys)
    slope = F.regr_slope(value, "idx").over(w)
    return long.withColumn(value, F.col(value) - F.coalesce(slope, F.lit(0.0)) * F.col("idx"))


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi join in which null keys match each other; the right side's keys are dropped."""
    other = {k: f"_on_{k}" for k in keys}
    on = [F.col(k).eqNullSafe(F.col(o)) for k, o in other.items()]
    return left.join(right.withColumnsRenamed(other), on, how).drop(*other.values())


def resample_cues(df: DataFrame, rec: str, cue: str, period_ms: int, time: str = "ts",
                  value: str = "value", block: int = 4096) -> DataFrame:
    """One series per (recording, cue): mean per ``period_ms`` bin from
    the recording's first tick (midnight origin), every bin up to the
    recording's last tick, then unlimited time interpolation (leading gaps
    stay NULL, trailing gaps take the last value)."""
    bounds = df.groupBy(rec).agg(F.min(time).alias("_t0"), F.max(time).alias("_t1"))
    step = F.lit(period_ms * 1000)
    mid = epoch_us(day_start("_t0"))
    b0 = F.floor((epoch_us("_t0") - mid) / step)
    d = join_on(df.select(rec, cue, time, value), bounds, [rec])       # a null recording is one like any other
    binned = (d.select(rec, cue, F.col(value).alias("_v"),
                       (F.floor((epoch_us(time) - mid) / step) - b0).cast("int").alias("idx"))
              .groupBy(rec, cue, "idx").agg(F.avg("_v").alias("value")))
    cues = join_on(df.select(rec, cue).distinct(), bounds, [rec])
    last = (F.floor((epoch_us("_t1") - mid) / step) - b0).cast("int")
    # one row per block of points with the list of its known ones; recordings can be long, no task holds a whole series
    blocks = cues.select(rec, cue, "_t0", last.alias("_last"), F.explode(F.sequence(F.lit(0), F.floor(last / block).cast("int"))).alias("_b"))
    known = binned.filter(F.col("idx").isNotNull() & F.col("value").isNotNull())
    lists = known.groupBy(rec, cue, F.floor(F.col("idx") / block).cast("int").alias("_b")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("idx").alias("i"), F.col("value").alias("v")))).alias("_p"))
    g = join_on(blocks, lists, [rec, cue, "_b"], "left")
    # the nearest known points before and after a block, carried between blocks
    ends = blocks.select(rec, cue, "_b").transform(join_on, lists.select(
        rec, cue, "_b", F.get("_p", F.lit(0)).alias("_first"), F.element_at("_p", -1).alias("_final")), [rec, cue, "_b"], "left")
    over = Window.partitionBy(rec, cue).orderBy("_b")
    carry = ends.select(rec, cue, "_b", F.last("_final", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
                        F.first("_first", ignorenulls=True).over(over.rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
    g = join_on(g, carry, [rec, cue, "_b"])
    # stretches from one known point to the next; the grid is made from them last and not shuffled any more
    low, high = F.col("_b") * block, F.least(F.col("_b") * block + (block - 1), F.col("_last"))
    g = g.select(rec, cue, "_t0", low.alias("_low"), high.alias("_high"), "_after",
                 F.concat(F.array("_before"), F.coalesce("_p", F.array().cast(g.schema["_p"].dataType))).alias("_q"))

    def stretch(p, j):
        after = F.coalesce(F.get("_q", j + 1), F.col("_after"))
        return F.struct(p["i"].alias("i0"), p["v"].alias("v0"), after["i"].alias("i1"), after["v"].alias("v1"),
                        F.greatest(p["i"], F.col("_low")).alias("a"), F.least(F.get("_q", j + 1)["i"] - 1, F.col("_high")).alias("z"))
    g = g.select(rec, cue, "_t0", F.explode(F.filter(F.transform("_q", stretch), lambda x: x["a"] <= x["z"])).alias("_s"))
    g = g.select(rec, cue, "_t0", "_s.*").select(rec, cue, "_t0", "i0", "v0", "i1", "v1", F.explode(F.sequence("a", "z")).alias("idx"))
    line = F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("idx") - F.col("i0")) / (F.col("i1") - F.col("i0"))
    v = F.when((F.col("idx") == F.col("i0")) | F.col("i1").isNull(), F.col("v0")).otherwise(line)
    t = ntz_from_epoch_us(mid + (b0 + F.col("idx")) * step)
    return g.select(rec, cue, "idx", t.alias("t"), v.alias("value"))


def local_minima(series: DataFrame, keys: list[str], lo_s: float, hi_s: float,
                 time: str = "t", value: str = "value", on_grid: bool = True, block: int = 4096) -> DataFrame:
    """Points strictly below both neighbours, edges excluded, looked for
    only inside the open range ``(t0 + lo_s, t0 + hi_s)`` of each series (the
    range filter comes first, then the neighbours).

    ``t0`` comes from an aggregate joined back (a null key is one like any other).  On a resampled grid
    (``on_grid``: contiguous ``idx``) the neighbours are looked for in blocks of points, whose
    edge points the next block gets too, so a long series is processed by many tasks; otherwise
    ``lag``/``lead`` over the series order are used.
    """
    t0 = series.groupBy(*keys).agg(F.min(time).alias("_t0"))
    d = join_on(series, t0, keys).withColumn("_off", (epoch_us(time) - epoch_us("_t0")) / 1e6)
    d = d.filter((F.col("_off") > lo_s) & (F.col("_off") < hi_s)).drop("_off", "_t0")
    if on_grid:
        own, at = F.floor(F.col("idx") / block).cast("int"), F.pmod(F.col("idx"), F.lit(block))
        near = F.when(at == 0, F.array(own, own - 1)).when(at == block - 1, F.array(own, own + 1)).otherwise(F.array(own)) if block > 1 else F.array(own - 1, own, own + 1)
        d = d.withColumn("_blk", F.explode(near))
        o = Window.partitionBy(*keys, "_blk").orderBy("idx")
        beside = lambda f, step: F.when(f("idx").over(o) == F.col("idx") + step, f(value).over(o))
        j = d.withColumn("_p", beside(F.lag, -1)).withColumn("_n", beside(F.lead, 1)).filter(F.col("_blk") == own).drop("_blk")
    else:
        o = Window.partitionBy(*keys).orderBy(time)
        j = d.withColumn("_p", F.lag(value).over(o)).withColumn("_n", F.lead(value).over(o))
    return j.filter((F.col(value) < F.col("_p")) & (F.col(value) < F.col("_n"))).drop("_p", "_n")


def case_raw(measures: DataFrame, case_col: str, case_value) -> DataFrame:
    """The measures of one case (single-case view), ordered by time."""
    return measures.filter(F.col(case_col) == F.lit(case_value)).orderBy("id_measure_type", "dt_insert")


def case_raw_at(measures: DataFrame, case_col: str, position: int) -> DataFrame:
    """The measures of the case at a position (from 0) in the order of case ids."""
    one = measures.select(case_col).distinct().orderBy(case_col).offset(position).limit(1)
    return measures.join(F.broadcast(one), case_col, "left_semi").orderBy("id_measure_type", "dt_insert")
