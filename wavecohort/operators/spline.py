"""Natural cubic splines over series of any length.

The second derivatives of a spline solve one tridiagonal system per series.  It is
solved by substructuring: a series is cut into blocks of grid points, and every
block (one row with an array of bounded length) writes its inner derivatives as a linear function of the
derivative at its own first known point and at the next block's one.  What is left is a
tridiagonal system with one unknown a block; its solution goes back to the blocks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavecohort.operators.series import join_on


def _inner(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Second derivatives at the points between the two ends: constant part, factor of the left end's one, of the right end's one."""
    h = np.diff(x)
    k = len(x) - 2
    if k < 1:
        return np.zeros((0, 3))
    matrix = np.diag(2 * (h[:-1] + h[1:])) + np.diag(h[1:-1], 1) + np.diag(h[1:-1], -1)
    sides = np.zeros((k, 3))
    sides[:, 0] = 6 * np.diff(np.diff(y) / h)
    sides[0, 1] -= h[0]
    sides[-1, 2] -= h[-1]
    return np.linalg.solve(matrix, sides)


def _span(idx, val, right_x, right_y):
    """Known points of a block, and the next block's first one where there is one."""
    idx, val = np.asarray(idx, float), np.asarray(val, float)
    own = ~np.isnan(val)
    x, y = idx[own], val[own]
    return (x, y) if np.isnan(right_x) else (np.append(x, right_x), np.append(y, right_y))


def _equation(idx, val, right_x, right_y) -> dict:
    """A block's shares in the equation of its first point (``own``, ``next``, ``rhs``) and of the next block's first point
    (``back``, ``theirs``, ``their_rhs``), and its last point's derivative (``end``: constant, factors of both)."""
    x, y = _span(idx, val, right_x, right_y)
    if len(x) == 1:                                  # the last known point of the series
        return {"own": 0.0, "next": 0.0, "rhs": 0.0, "back": 0.0, "theirs": 0.0, "their_rhs": 0.0, "end": [0.0, 0.0, 0.0]}
    h, slope, inner = np.diff(x), np.diff(y) / np.diff(x), _inner(x, y)
    first, last = (inner[0], inner[-1]) if len(inner) else (np.array([0.0, 0.0, 1.0]), np.array([0.0, 1.0, 0.0]))
    out = {"own": h[0] * (2 + first[1]), "next": h[0] * first[2], "rhs": 6 * slope[0] - h[0] * first[0]}
    if np.isnan(right_x):                            # natural end: the right factor meets a zero
        return {**out, "next": 0.0, "back": 0.0, "theirs": 0.0, "their_rhs": 0.0, "end": [0.0, 0.0, 0.0]}
    return {**out, "back": h[-1] * last[1], "theirs": h[-1] * (2 + last[2]), "their_rhs": -6 * slope[-1] - h[-1] * last[0], "end": last.tolist()}


def _solved(pdf):
    """Derivatives at the first point of every block of a series (rows in block order), zero at the series' ends."""
    own, nxt, rhs = (pdf[c].to_numpy(float) for c in ("own", "next", "rhs"))
    back, theirs, their_rhs = (pdf[c].to_numpy(float) for c in ("back", "theirs", "their_rhs"))
    n = len(own)
    c, d, m = np.zeros(n), np.zeros(n), np.zeros(n + 1)
    for b in range(1, n):
        if b == n - 1 and own[b] == 0.0:             # a single point ends the series
            break
        pivot = own[b] + theirs[b - 1] - back[b - 1] * c[b - 1]
        c[b] = nxt[b] / pivot
        d[b] = (rhs[b] + their_rhs[b - 1] - back[b - 1] * d[b - 1]) / pivot
    for b in range(n - 1, 0, -1):
        m[b] = d[b] - c[b] * m[b + 1]
    return m


def _filled(idx, val, first_m, left, right):
    """Values of a block's grid points; ``left`` and ``right`` are the neighbours' known points ``(x, y, m)`` (nan: none)."""
    x, y = _span(idx, val, right[0], right[1])
    at, v = np.asarray(idx, float), np.asarray(val, float)
    own = int((~np.isnan(v)).sum())
    right_m = 0.0 if np.isnan(right[0]) else right[2]
    if own:
        inner = _inner(x, y) @ np.array([1.0, first_m, right_m])
        m = np.concatenate([[first_m], inner, [right_m]])[:len(x)] if len(x) > 1 else np.array([first_m])
    else:
        m = np.full(len(x), right_m)
    if not np.isnan(left[0]):
        x, y, m = np.insert(x, 0, left[0]), np.insert(y, 0, left[1]), np.insert(m, 0, left[2])
    if not len(x):
        return v
    if len(x) == 1:
        return np.where(np.isnan(v), y[0], v)
    j = np.clip(np.searchsorted(x, at, side="right") - 1, 0, len(x) - 2)
    h, b, a = x[j + 1] - x[j], x[j + 1] - at, at - x[j]
    cubic = (m[j] * b ** 3 + m[j + 1] * a ** 3) / (6 * h) + (y[j] / h - m[j] * h / 6) * b + (y[j + 1] / h - m[j + 1] * h / 6) * a
    cubic = np.where(at < x[0], y[0], np.where(at > x[-1], y[-1], cubic))
    return np.where(np.isnan(v), cubic, v)


def _neighbours(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Last known point before each block and first one behind it (one row a block; the order is turned for the latter,
    so that both frames grow row by row)."""
    up = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*keys).orderBy(F.desc("_blk")).rowsBetween(Window.unboundedPreceding, -1)
    return (blocks.withColumn("_left", F.last("_last", ignorenulls=True).over(up))
            .withColumn("_right", F.last("_first", ignorenulls=True).over(down)))


def interpolate_spline(grid: DataFrame, keys: list[str], value: str = "value", block: int = 256) -> DataFrame:
    """Cubic-spline filling of the NULL grid points between known points
    of each series (natural end conditions), edges held at the nearest known
    value.

    ``idx`` is unique in a series; NaN counts as missing, a series without known points stays NULL, a null key is one
    like any other.  A task holds blocks of ``block`` grid points, or one row a block of a series; the solution doesn't depend on ``block``.
    """
    fields = {f.name: f.dataType.simpleString() for f in grid.schema.fields}
    key_ddl = "".join(f"`{k}` {fields[k]}, " for k in keys)
    y = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    g = grid.select(*keys, "idx", y.alias("_y"), F.floor(F.col("idx") / block).cast("long").alias("_blk"))
    known = F.when(F.col("_y").isNotNull(), F.struct(F.col("idx").cast("double").alias("x"), F.col("_y").alias("y")))
    cells = g.groupBy(*keys, "_blk").agg(F.min(known).alias("_first"), F.max(known).alias("_last"),
                                         F.sort_array(F.collect_list(F.struct("idx", "_y"))).alias("_p"))
    arrays = [F.col("_p.idx").alias("_idx"), F.col("_p._y").alias("_val")]
    blocks = cells.select(*keys, "_blk", "_first", "_last")

    def equations(batches):
        for pdf in batches:
            rows = [_equation(*r) for r in zip(pdf["_idx"], pdf["_val"], pdf["_rx"], pdf["_ry"])]
            out = pdf[[*keys, "_blk"]].copy()
            for c in ("own", "next", "rhs", "back", "theirs", "their_rhs", "end"):
                out[c] = [r[c] for r in rows]
            yield out
    near = _neighbours(blocks, keys).select(*keys, "_blk", F.col("_right.x").alias("_rx"), F.col("_right.y").alias("_ry"))
    known_cells = join_on(cells.filter(F.col("_first").isNotNull()).select(*keys, "_blk", *arrays), near, [*keys, "_blk"])
    eq = known_cells.mapInPandas(equations, f"{key_ddl}_blk long, own double, next double, rhs double, back double, theirs double, "
                                            "their_rhs double, end array<double>")

    def reduced(key, pdf):
        pdf = pdf.sort_values("_blk")
        m = _solved(pdf)
        end = np.stack(pdf["end"].to_numpy())
        return pdf[[*keys, "_blk"]].assign(_m=m[:-1], _m_end=end[:, 0] + end[:, 1] * m[:-1] + end[:, 2] * m[1:])
    solved = eq.groupBy(*keys).applyInPandas(reduced, f"{key_ddl}_blk long, _m double, _m_end double")

    def with_m(point, m):
        return F.when(F.col(point).isNotNull(), F.struct(F.col(f"{point}.x").alias("x"), F.col(f"{point}.y").alias("y"), F.col(m).alias("m"))).alias(point)
    ends = join_on(blocks, solved, [*keys, "_blk"], "left").select(*keys, "_blk", "_m", with_m("_first", "_m"), with_m("_last", "_m_end"))
    sides = _neighbours(ends, keys).select(*keys, "_blk", "_m", *[F.col(f"_{s}.{c}").alias(f"_{s}_{c}") for s in ("left", "right") for c in "xym"])

    def fill(batches):
        for pdf in batches:
            left, right = (pdf[[f"_{s}_{c}" for c in "xym"]].to_numpy(float) for s in ("left", "right"))
            out = pdf[[*keys, "_idx"]].copy()
            out["_val"] = [_filled(i, v, m, a, b) for i, v, m, a, b in zip(pdf["_idx"], pdf["_val"], pdf["_m"], left, right)]
            yield out
    done = join_on(cells.select(*keys, "_blk", *arrays), sides, [*keys, "_blk"]).mapInPandas(
        fill, f"{key_ddl}_idx array<{fields['idx']}>, _val array<double>")
    points = done.select(*keys, F.explode(F.arrays_zip(F.col("_idx").alias("i"), F.col("_val").alias("v"))).alias("_q"))
    return points.select(*keys, F.col("_q.i").alias("idx"), F.nanvl(F.col("_q.v"), F.lit(None).cast("double")).alias(value))
