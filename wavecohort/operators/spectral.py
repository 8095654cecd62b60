"""Spectra and filters of grid series (W12-W14, W16; W6 is in :mod:`spline`).

Short series (the 96-point waves) use native higher-order functions on the
series' array: the work stays in the JVM and the result is checkable in SQL.
Recursive filters cannot be written as column expressions; they run in blocks of
points in ``applyInPandas``.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavecohort.operators.series import join_on
from wavecohort.operators.spline import interpolate_spline  # noqa: F401

TWO_PI = 2.0 * math.pi


def _series_arrays(long: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    pts = F.array_sort(F.collect_list(F.struct(F.col("idx").alias("i"), F.col(value).alias("v"))))
    return long.groupBy(*keys).agg(pts.alias("_p")).select(*keys, F.col("_p.v").alias("_v"))


def _dft_parts(vals, n, k):
    re = F.aggregate(F.transform(vals, lambda v, j: v * F.cos(F.lit(TWO_PI) * k * j / n)), F.lit(0.0), lambda a, x: a + x)
    im = F.aggregate(F.transform(vals, lambda v, j: v * F.sin(F.lit(TWO_PI) * k * j / n)), F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(re * re + im * im)


def spectrum(long: DataFrame, keys: list[str], fs: float | None = None, norm: bool = True,
             value: str = "value") -> DataFrame:
    """One-sided amplitude spectrum ``|FFT| / n`` for ``k < n/2`` with
    frequency ``k·Fs/n``; ``Fs`` defaults to ``n / 86400`` (n points a day)."""
    a = _series_arrays(long, keys, value)
    n = F.size("_v")
    h = F.floor(n / 2).cast("int")
    amps = F.transform(F.sequence(F.lit(0), h - 1), lambda k: _dft_parts(F.col("_v"), n, k) / (n if norm else F.lit(1)))
    fs_col = F.lit(float(fs)) if fs is not None else n / F.lit(86400.0)
    return (a.select(*keys, n.alias("_n"), fs_col.alias("_fs"), F.posexplode(amps).alias("k", "amplitude"))
            .select(*keys, "k", (F.col("k") * F.col("_fs") / F.col("_n")).alias("freq"), "amplitude"))


def fft_magnitude(long: DataFrame, keys: list[str], period: float, outlier_k: float | None = 20.0,
                  value: str = "value") -> DataFrame:
    """W13 (+W14): unscaled ``|FFT|`` on the grid ``linspace(0, 1/(2T), n/2)``.

    With ``outlier_k`` the magnitudes further than k population std from
    their mean over the **whole** spectrum are set to 0 first, then the first
    half is kept (the source's order of operations).
    """
    a = _series_arrays(long, keys, value)
    n = F.size("_v")
    mags = F.transform(F.sequence(F.lit(0), n - 1), lambda k: _dft_parts(F.col("_v"), n, k))
    d = a.select(*keys, n.alias("_n"), F.posexplode(mags).alias("k", "magnitude"))
    if outlier_k is not None:
        # statistics over the whole spectrum of each series (n rows per window)
        w = Window.partitionBy(*keys)
        m = F.abs(F.col("magnitude"))
        mu, sd = F.avg(m).over(w), F.stddev_pop(m).over(w)
        d = d.withColumn("magnitude", F.when((m > mu + outlier_k * sd) | (m < mu - outlier_k * sd), F.lit(0.0))
                         .otherwise(F.col("magnitude")))
    h = F.floor(F.col("_n") / 2).cast("int")
    step = F.when(h > 1, F.lit(1.0 / (2.0 * period)) / (h - 1)).otherwise(F.lit(0.0))
    return d.filter(F.col("k") < h).select(*keys, "k", (F.col("k") * step).alias("freq"), "magnitude")


def _factors(df: DataFrame, size: str = "_n") -> DataFrame:
    """``_n1 * _n2`` = size, ``_n1`` the largest divisor up to the square root."""
    divisors = F.filter(F.sequence(F.lit(1), F.floor(F.sqrt(size)).cast("int")), lambda x: F.col(size) % x == 0)
    return df.withColumn("_n1", F.array_max(divisors).cast("long")).withColumn("_n2", F.expr(f"{size} div _n1"))


def _dft(x: DataFrame, keys: list[str], size: str) -> DataFrame:
    """Transform of each series ``_j, _x, _y`` (real and imaginary part; missing points are 0) of ``size = _n1 * _n2``
    points as two grouped sums: ``_j, _x, _y`` of the result, and all columns named in ``keys``."""
    turn = F.lit(-TWO_PI)

    def summed(rows, by, angle):
        c, s = F.cos(angle), F.sin(angle)
        return rows.groupBy(*by).agg(F.sum(F.col("_x") * c - F.col("_y") * s).alias("_x"), F.sum(F.col("_x") * s + F.col("_y") * c).alias("_y"))
    # j = j1 * n2 + j2, k = k1 + n1 * k2
    own = [*keys, size, "_n1", "_n2"]
    inner = x.withColumn("_k1", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n1") - 1)))
    inner = summed(inner, [*own, (F.col("_j") % F.col("_n2")).alias("_j2"), "_k1"], turn * ((F.expr("_j div _n2") * F.col("_k1")) % F.col("_n1")) / F.col("_n1"))
    outer = inner.withColumn("_k2", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n2") - 1))).withColumn("_k", F.col("_k1") + F.col("_n1") * F.col("_k2"))
    return summed(outer, [*own, F.col("_k").alias("_j")], turn * ((F.col("_j2") * F.col("_k")) % F.col(size)) / F.col(size))


def _chirped(x: DataFrame, keys: list[str]) -> DataFrame:
    """Transform of series whose length has no divisor near its root, as a convolution with a chirp (``exp(i pi j^2 / n)``) of
    a padded length ``_m = _n1 * _n2`` that has one: three transforms of that length."""
    root = F.ceil(F.sqrt(2 * F.col("_n") - 1)).cast("long")
    x = x.withColumn("_n1", root).withColumn("_n2", root).withColumn("_m", root * root)
    # j^2 mod 2n is exact in whole numbers; the angle stays small
    angle = lambda j: F.lit(TWO_PI / 2) * ((j * j) % (2 * F.col("_n"))) / F.col("_n")
    a = angle(F.col("_j"))
    lengths = x.select("_n", "_m", "_n1", "_n2").distinct()
    around = F.least(F.col("_j"), F.col("_m") - F.col("_j"))
    chirp = (lengths.withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m") - 1))).filter(around < F.col("_n"))
             .select("_n", "_m", "_n1", "_n2", "_j", F.cos(angle(around)).alias("_x"), F.sin(angle(around)).alias("_y")))
    turned = x.select(*keys, "_n", "_m", "_n1", "_n2", "_j", (F.col("_x") * F.cos(a) + F.col("_y") * F.sin(a)).alias("_x"),
                      (F.col("_y") * F.cos(a) - F.col("_x") * F.sin(a)).alias("_y"))
    left, right = _dft(turned, [*keys, "_n"], "_m"), _dft(chirp, ["_n"], "_m")
    right = right.select("_n", "_j", F.col("_x").alias("_cx"), F.col("_y").alias("_cy"))
    # product, conjugated: one more forward transform is the inverse one
    both = left.join(right, ["_n", "_j"]).select(*keys, "_n", "_m", "_n1", "_n2", "_j", (F.col("_x") * F.col("_cx") - F.col("_y") * F.col("_cy")).alias("_x"),
                                                 (-F.col("_x") * F.col("_cy") - F.col("_y") * F.col("_cx")).alias("_y"))
    # the factor exp(-i pi k^2 / n) that is left turns the result, and doesn't change its size
    done = _dft(both, [*keys, "_n"], "_m").filter(F.col("_j") < F.col("_n"))
    return done.select(*keys, "_n", "_j", (F.col("_x") / F.col("_m")).alias("_x"), (F.col("_y") / F.col("_m")).alias("_y"))


#: A series whose lesser factor is below this share of its root goes by the chirp.
EVEN_SHARE = 0.125
#: Series of at most so many points are transformed whole, many of them at once.
SHORT = 512


def _ddl(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*names).schema.fields)


def _fft_magnitude_short(long: DataFrame, keys: list[str], period: float, outlier_k: float | None, value: str) -> DataFrame:
    """:func:`fft_magnitude_long` of series of at most ``SHORT`` points: one row per series, transformed batch by batch."""
    point = F.struct(F.col("idx").cast("long").alias("i"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v"))
    lists = long.groupBy(*keys).agg(F.collect_list(point).alias("_p")).select(*keys, "_p.i", "_p.v")
    lists = lists.toDF(*[f"_key{i}" for i in range(len(keys))], "_i", "_v")
    top = 1.0 / (2.0 * period)

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            at, x = batch.column(len(keys)), batch.column(len(keys) + 1)
            ends = np.cumsum(at.value_lengths().to_numpy())
            at, x = at.flatten().to_numpy(), x.flatten().to_numpy()
            size = np.diff(np.append(0, ends))
            for n in np.unique(size[size > 1]):
                own = np.flatnonzero(size == n)
                places = (ends[own] - n)[:, None] + np.arange(n)
                dense = np.zeros((len(own), n))
                np.add.at(dense, (np.arange(len(own))[:, None], at[places] % n), x[places])
                m = np.abs(np.fft.fft(dense, axis=1))
                if outlier_k is not None:
                    m[np.abs(m - m.mean(axis=1, keepdims=True)) > outlier_k * m.std(axis=1, keepdims=True)] = 0.0
                h = int(n) // 2
                freq = np.arange(h) * (top / (h - 1)) if h > 1 else np.zeros(h)
                if h > 1:
                    freq[-1] = top
                who = pa.array(np.repeat(own, h))
                yield pa.RecordBatch.from_arrays([*[batch.column(i).take(who) for i in range(len(keys))], pa.array(np.tile(np.arange(h, dtype=np.int32), len(own))),
                                                  pa.array(np.tile(freq, len(own))), pa.array(m[:, :h].ravel())],
                                                 names=[*batch.schema.names[:len(keys)], "k", "freq", "magnitude"])
    return lists.mapInArrow(run, _ddl(lists, lists.columns[:len(keys)]) + ", k int, freq double, magnitude double").toDF(*keys, "k", "freq", "magnitude")


def fft_magnitude_long(long: DataFrame, keys: list[str], period: float, outlier_k: float | None = 20.0,
                       value: str = "value") -> DataFrame:
    """W13 for long series of any length, same output as :func:`fft_magnitude`: the
    divide-and-conquer Fourier transform as two grouped sums.

    A series of ``n = n1 * n2`` points (``n1`` the largest divisor up to the square
    root) is cut into ``n2`` interleaved parts; sums over ``j1`` give their transforms,
    a phase factor and sums over ``j2`` the whole one: ``n * (n1 + n2)`` products
    spread over all tasks, summed before each shuffle, and no task holds a series.  Where the two factors lie
    far apart (a prime length) the series is a convolution with a chirp, of a
    padded length with equal factors.  Series of at most ``SHORT`` points are transformed whole
    (:func:`_fft_magnitude_short`): their products would be more rows than points.
    """
    counts = long.groupBy(*keys).agg(F.count(F.lit(1)).cast("long").alias("_n"))
    longest = counts.agg(F.max("_n")).first()[0] or 0
    if longest <= SHORT:
        return _fft_magnitude_short(long, keys, period, outlier_k, value)
    few = join_on(long, counts.filter(F.col("_n") <= SHORT).drop("_n"), keys)
    n = _factors(counts.filter(F.col("_n") > SHORT)).withColumn("_even", F.col("_n1") >= EVEN_SHARE * F.sqrt("_n"))
    x = join_on(long.select(*keys, F.col("idx").cast("long").alias("_j"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("_x"),
                            F.lit(0.0).alias("_y")), n, keys)
    even = _dft(x.filter("_even").drop("_even"), keys, "_n").select(*keys, "_n", "_j", "_x", "_y")
    odd = _chirped(x.filter(~F.col("_even")).drop("_even", "_n1", "_n2"), keys)
    d = even.union(odd).select(*keys, F.col("_j").cast("int").alias("k"), "_n", F.sqrt(F.col("_x") * F.col("_x") + F.col("_y") * F.col("_y")).alias("magnitude"))
    if outlier_k is not None:
        m = F.col("magnitude")
        st = d.groupBy(*keys).agg(F.avg(m).alias("_mu"), F.stddev_pop(m).alias("_sd"))
        d = join_on(d, st, keys).withColumn("magnitude", F.when(F.abs(m - F.col("_mu")) > outlier_k * F.col("_sd"), F.lit(0.0)).otherwise(m))
    h = F.floor(F.col("_n") / 2).cast("int")
    top = F.lit(1.0 / (2.0 * period))
    freq = (F.when(h <= 1, F.lit(0.0)).when(F.col("k") == h - 1, top).otherwise(F.col("k") * (top / (h - 1))))
    return d.filter(F.col("k") < h).select(*keys, "k", freq.alias("freq"), "magnitude").unionByName(_fft_magnitude_short(few, keys, period, outlier_k, value))


def zero_outliers(long: DataFrame, keys: list[str], k: float = 20.0, value: str = "value") -> DataFrame:
    """W14 in long form: per series mean/std of ``|x|`` by aggregation, joined
    back, outliers set to 0."""
    st = long.groupBy(*keys).agg(F.avg(F.abs(value)).alias("_mu"), F.stddev_pop(F.abs(value)).alias("_sd"))
    v = F.col(value)
    out = F.when((F.abs(v) > F.col("_mu") + k * F.col("_sd")) | (F.abs(v) < F.col("_mu") - k * F.col("_sd")),
                 F.lit(0.0)).otherwise(v)
    return long.join(st, keys).withColumn(value, out).drop("_mu", "_sd")


# ---------------------------------------------------------------- Butterworth

def butter_lowpass(order: int, cutoff: float, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """Digital Butterworth low-pass ``(b, a)`` by the bilinear transform with
    frequency pre-warping (published design; computed once on the driver)."""
    warped = 4.0 * math.tan(math.pi * cutoff / fs)
    ks = np.arange(1, order + 1)
    poles = warped * np.exp(1j * math.pi * (2 * ks + order - 1) / (2 * order))
    z = (4.0 + poles) / (4.0 - poles)
    a = np.real(np.poly(z))
    b = np.array([math.comb(order, i) for i in range(order + 1)], dtype=float)
    b *= a.sum() / b.sum()
    return b, a


def _state_space(b: np.ndarray, a: np.ndarray, block: int):
    """Matrices of the recursion ``y_t = sum b_i x_{t-i} - sum a_i y_{t-i}`` over a block:
    impulse response (lower triangle), start state to outputs, inputs to end state,
    start state to end state."""
    b, a = np.asarray(b, float) / a[0], np.asarray(a, float) / a[0]
    m = len(a) - 1
    step = np.eye(m, k=1)                            # transposed direct form
    step[:, 0] -= a[1:]
    gain = b[1:] - a[1:] * b[0]
    powers = [np.eye(m)]
    for _ in range(block):
        powers.append(step @ powers[-1])
    observe = np.stack([p[0] for p in powers[:block]])
    impulse = np.concatenate([[b[0]], [p[0] @ gain for p in powers[:block - 1]]])
    i, j = np.indices((block, block))
    response = np.where(i >= j, impulse[np.maximum(i - j, 0)], 0.0)
    to_end = np.stack([powers[block - 1 - t] @ gain for t in range(block)], axis=1)
    return response, observe, to_end, powers[block]


def lowpass(long: DataFrame, keys: list[str], cue_col: str, cutoffs: dict, fs: float, order: int = 5,
            value: str = "value", block: int = 256) -> DataFrame:
    """Causal Butterworth low-pass per series with a per-cue cut-off, zero start.

    The recursion is linear, so a series is filtered in blocks of points: each block
    alone from a zero state (a matrix product of many blocks at once), then, for series of several blocks, one row per block carries the
    state of ``order`` numbers to the next block, and the carried state's response is
    added.  A task holds a batch of blocks, or one series' block rows.  ``idx`` is contiguous
    from 0; missing values count as 0; cues without a cut-off stay as they are; a null key is one like any other.
    """
    made = {c: _state_space(*butter_lowpass(order, f, fs), block) for c, f in cutoffs.items()}
    base = long.select(*keys, "idx", F.col(value).cast("double").alias(value))
    plain = base.filter(~F.col(cue_col).isin(list(cutoffs)) | F.col(cue_col).isNull())
    rows = base.filter(F.col(cue_col).isin(list(cutoffs)))
    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    key_ddl = ", ".join(f"`{k}` {fields[k]}" for k in keys)
    cue, k = keys.index(cue_col), len(keys)
    point = F.struct(F.col("idx").alias("i"), F.col(value).alias("v"))
    lists = rows.groupBy(*keys, F.expr(f"cast(idx div {block} as int)").alias("_blk")).agg(F.collect_list(point).alias("_p")).select(*keys, "_blk", "_p.i", "_p.v")

    def alone(batches):
        import pyarrow as pa
        for batch in batches:
            at, x = batch.column(k + 1), batch.column(k + 2)
            size, cues = at.value_lengths().to_numpy(), np.array(batch.column(cue).to_pylist(), dtype=object)
            owner, place = np.repeat(np.arange(len(size)), size), at.flatten().to_numpy() % block
            dense = np.zeros((len(size), block))
            dense[owner, place] = np.nan_to_num(x.flatten().to_numpy(zero_copy_only=False).astype(float))
            out, ends = np.zeros_like(dense), np.zeros((len(size), order))
            for c in set(cues):
                response, _observe, to_end, _next = made[c]
                own = np.flatnonzero(cues == c)
                part = np.zeros((-(-len(own) // 16) * 16, block))       # whole tiles: a row's result doesn't depend on the rows beside it
                part[:len(own)] = dense[own]
                out[own], ends[own] = (part @ response.T)[:len(own)], (part @ to_end.T)[:len(own)]
            offsets = np.append(0, np.cumsum(size)).astype(np.int32)
            values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(out[owner, place]))
            last = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * order), pa.array(ends.ravel()))
            idx = pa.ListArray.from_arrays(pa.array(offsets), at.flatten())
            yield pa.RecordBatch.from_arrays([*batch.columns[:k + 1], idx, values, last], names=[*batch.schema.names[:k + 1], "_i", "_v", "_end"])
    done = lists.mapInArrow(alone, f"{key_ddl}, _blk int, _i array<{fields['idx']}>, _v array<double>, _end array<double>")
    zipped = F.explode(F.arrays_zip(F.col("_i").alias("i"), F.col("_v").alias("v"))).alias("_p")
    if (rows.agg(F.max("idx")).first()[0] or 0) < block:
        return done.select(*keys, zipped).select(*keys, F.col("_p.i").alias("idx"), F.col("_p.v").alias(value)).unionByName(plain)

    def carry(key, pdf):
        pdf = pdf.sort_values("_blk")
        move = made[pdf[cue_col].iloc[0]][3]
        state, states = np.zeros(order), []
        for end in pdf["_end"]:
            states.append(state.tolist())
            state = move @ state + np.asarray(end)
        return pdf.drop(columns="_end").assign(_state=states)
    ends = done.select(*keys, "_blk", "_end").withColumn("_most", F.max("_blk").over(Window.partitionBy(*keys))).filter("_most > 0").drop("_most")
    states = ends.groupBy(*keys).applyInPandas(carry, f"{key_ddl}, _blk int, _state array<double>")
    # constant tables: ``block`` rows for each cue
    spark = long.sparkSession
    seen = spark.createDataFrame([(c, t, m[1][t].tolist()) for c, m in made.items() for t in range(block)],
                                 f"_cue {fields[cue_col]}, _t int, _observe array<double>")
    joined = (join_on(done, states, [*keys, "_blk"], "left").select(*keys, "_state", zipped)
              .select(*keys, "_state", F.col("_p.i").alias("idx"), F.col("_p.v").alias(value))
              .join(F.broadcast(seen), (F.col(cue_col) == F.col("_cue")) & (F.col("idx") % block == F.col("_t"))))
    added = F.aggregate(F.zip_with("_observe", "_state", lambda o, z: o * z), F.lit(0.0), lambda s, v: s + v)
    return joined.select(*keys, "idx", (F.col(value) + F.coalesce(added, F.lit(0.0))).alias(value)).unionByName(plain)
