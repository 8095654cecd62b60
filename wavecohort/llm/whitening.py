"""Embedding whitening (operator 11).

Vectors become whole numbers (``floor(scale * c)``); the fit list is each distinct one once.

1. Sums and the covariance (divisor n, centred before multiplying) are made per scan
   partition with numpy and added by cell with Spark, so the driver reads ``d * d`` numbers
   however many vectors there are.
2. On the driver the matrix is brought to tridiagonal form by Householder reflections; the
   leading eigenvalues are found by bisection on Sturm counts, their vectors by inverse
   iteration, made orthogonal again within clusters of close eigenvalues, and turned back.
3. Mean and components (``d * k`` numbers) go to every task, which projects its rows.  The
   covariance of the whitened fit list is measured as in step 1, not taken for granted.

Defined cases: rows whose vector is null or holds a null, NaN or infinite entry are left out;
shorter vectors are filled with zeros up to the longest; entries beyond 32 bits count as
the greatest or least such number; repeated rows all come back, but count once in the fit; null
ids stay null; a ``deviation`` beyond 64 bits is null.  Directions without variance (fewer
distinct vectors than dimensions) have null ``whitened`` and don't enter ``identity_error``;
without any variance ``explained`` and ``identity_error`` are null.  An empty table, and one
of empty vectors, gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavecohort.llm.common import map_batches, staged

SCALE, COMPONENTS = 256, 4
#: Eigenvalues closer than this share of the greatest are a cluster.
CLUSTER = 1e-3
_LEAST, _MOST = -2.0 ** 31, 2.0 ** 31 - 1


def whole(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``id, x`` of the usable rows (written): vectors as whole numbers, filled to one length."""
    v = F.col(vector_col).cast("array<double>")
    usable = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = F.transform(v, lambda c: F.floor(F.greatest(F.lit(_LEAST), F.least(F.lit(_MOST), c * scale))).cast("int"))
    rows = staged(df.filter(F.coalesce(usable, F.lit(False))).select(F.col(id_col).alias("id"), x.alias("x")), "white-rows")
    d = rows.agg(F.max(F.size("x"))).first()[0] or 0
    return rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0), F.lit(d) - F.size("x"))))


def _matrix(column, dtype):
    """A batch's vectors (all of one length) as the rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(dtype)


def sums(fit: DataFrame):
    """Number of rows of ``x`` and their exact sums, as Python integers."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        n, total = 0, 0
        for batch in batches:
            n, total = n + batch.num_rows, total + _matrix(batch.column(0), np.int64).sum(axis=0)
        if n:
            s = np.concatenate([[n], total])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(s)) - 1), pa.array(s)], names=["j", "s"])
    got = {r.j: int(r.s) for r in map_batches(fit.select("x"), run, "j long, s long").groupBy("j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()}
    return got.get(-1, 0), [got[j] for j in range(len(got) - 1)]


def covariance(fit: DataFrame, mean, n: int, components=None, scale=None):
    """Covariance of ``x`` (with ``components``: of its projections, divided by ``scale``), divisor ``n``:
    centred products per partition, added by cell."""
    import numpy as np

    def projected(batch):
        y = _matrix(batch.column(0), np.float64) - mean
        return y if components is None else y @ components / scale

    def totals(batches):
        import pyarrow as pa
        total = None
        for batch in batches:
            if batch.num_rows:
                total = projected(batch).sum(axis=0) + (0 if total is None else total)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["j", "s"])
    d = len(mean) if components is None else components.shape[1]
    centre = np.zeros(d)
    if components is not None:                               # the centre of the projections, as they came out
        for r in map_batches(fit.select("x"), totals, "j long, s double").groupBy("j").agg(F.sum("s").alias("s")).collect():
            centre[r.j] = r.s / n

    def products(batches):
        import pyarrow as pa
        total = None
        for batch in batches:
            if batch.num_rows:
                y = projected(batch) - centre
                total = y.T @ y + (0 if total is None else total)
        if total is not None:
            i, j = np.triu_indices(d)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "s"])
    out = np.zeros((d, d))
    for r in map_batches(fit.select("x"), products, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        out[r.i, r.j] = out[r.j, r.i] = r.s / n
    return out


def tridiagonal(a):
    """Householder reduction: diagonal, off-diagonal, and the reflection vectors."""
    import numpy as np
    a = np.array(a, float)
    d, mirrors = len(a), []
    for k in range(d - 2):
        v = a[k + 1:, k].copy()
        length = np.sqrt(v @ v)
        if length == 0 or not np.any(v[1:]):
            mirrors.append(None)
            continue
        alpha = -length if v[0] >= 0 else length
        v[0] -= alpha
        v /= np.sqrt(v @ v)
        sub = a[k + 1:, k + 1:]
        p = sub @ v
        w = p - (v @ p) * v
        sub -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1:, k] = 0
        a[k + 1, k] = alpha
        mirrors.append(v)
    return np.diagonal(a).copy(), np.diagonal(a, -1).copy(), mirrors


def sturm_counts(diagonal, off, at):
    """How many eigenvalues lie below each number of ``at``."""
    import numpy as np
    tiny = np.finfo(float).tiny * 1e16
    q, count = diagonal[0] - at, np.zeros(len(at), int)
    count += q < 0
    for i in range(1, len(diagonal)):
        q = diagonal[i] - at - off[i - 1] ** 2 / np.where(np.abs(q) < tiny, -tiny, q)
        count += q < 0
    return count


def leading_eigenvalues(diagonal, off, k: int):
    """The ``k`` greatest eigenvalues, falling, by bisection on Sturm counts."""
    import numpy as np
    d = len(diagonal)
    reach = np.abs(np.concatenate([[0], off])) + np.abs(np.concatenate([off, [0]]))
    low, high = np.full(k, np.min(diagonal - reach)), np.full(k, np.max(diagonal + reach))
    pad = np.finfo(float).eps * max(1e-300, np.abs([low[0], high[0]]).max()) * d
    low, high, want = low - pad, high + pad, d - np.arange(k)
    while True:
        mid = (low + high) / 2
        if np.all((mid <= low) | (mid >= high)):
            return mid
        below = sturm_counts(diagonal, off, mid) >= want
        low, high = np.where(below, low, mid), np.where(below, mid, high)


def _solve(diagonal, off, shift, y):
    """Tridiagonal solve with row exchanges; pivots that vanish are made tiny (inverse iteration wants that)."""
    d = len(diagonal)
    small = 2.3e-16 * max(1e-300, max(map(abs, diagonal)), max(map(abs, off), default=0.0))
    a, b, c, y = [x - shift for x in diagonal], list(off) + [0.0], [0.0] * d, list(y)
    for i in range(d - 1):
        low = off[i]
        if abs(low) > abs(a[i]):                             # row i + 1 first
            a[i], b[i], c[i], a[i + 1], b[i + 1], low, y[i], y[i + 1] = low, a[i + 1], b[i + 1], b[i], c[i], a[i], y[i + 1], y[i]
        if abs(a[i]) < small:
            a[i] = small
        f = low / a[i]
        a[i + 1], b[i + 1], y[i + 1] = a[i + 1] - f * b[i], b[i + 1] - f * c[i], y[i + 1] - f * y[i]
    if abs(a[-1]) < small:
        a[-1] = small
    for i in range(d - 1, -1, -1):
        y[i] = (y[i] - (b[i] * y[i + 1] if i + 1 < d else 0.0) - (c[i] * y[i + 2] if i + 2 < d else 0.0)) / a[i]
        if abs(y[i]) > 1e150:                                # only the direction counts
            y = [v * 1e-150 for v in y]
    return y


def eigenpairs(matrix, k: int):
    """The ``k`` leading eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns
    (their greatest entry by size is positive)."""
    import numpy as np
    d = len(matrix)
    k, size = min(k, d), np.abs(matrix).max() if d else 0.0
    if not d or size == 0:
        return np.zeros(k), np.eye(d, k)
    diagonal, off, mirrors = tridiagonal(np.asarray(matrix) / size)
    values = leading_eigenvalues(diagonal, off, k)
    span, out, rng = max(abs(values[0]), abs(values[-1]), 1e-300), [], np.random.default_rng(11)
    diag, side = diagonal.tolist(), off.tolist()
    first = 0
    for i in range(k):
        if i and values[i - 1] - values[i] > CLUSTER * span:
            first = i
        y = rng.standard_normal(d)
        for _ in range(6):
            y = np.array(_solve(diag, side, float(values[i]), y / np.abs(y).max()))
            y /= np.abs(y).max()
            for _ in range(2):                               # twice is enough to be orthogonal to rounding
                for j in range(first, i):
                    y -= (out[j] @ y) * out[j]
            y /= np.sqrt(y @ y)
        out.append(y)
    vectors = np.array(out).T
    for step in range(len(mirrors) - 1, -1, -1):
        if (v := mirrors[step]) is not None:
            vectors[step + 1:] -= 2 * np.outer(v, v @ vectors[step + 1:])
    vectors /= np.sqrt((vectors ** 2).sum(axis=0))
    vectors *= np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)
    return values * size, vectors


@dataclass(frozen=True)
class Whitening:
    """A fit: vectors counted, their exact sums, leading eigenvalues and components, total variance,
    and how far the whitened fit list's covariance is from the identity."""
    n: int
    sums: list
    values: object
    components: object
    trace: float
    identity_error: float | None


def fit(rows: DataFrame, k: int = COMPONENTS) -> Whitening | None:
    """Fit on the distinct vectors of ``rows`` (of :func:`whole`); None without any."""
    import numpy as np
    distinct = staged(rows.select("x").distinct(), "white-fit")
    n, total = sums(distinct)
    if not n or not total:
        return None
    mean = np.array([s / n for s in total])
    cov = covariance(distinct, mean, n)
    values, components = eigenpairs(cov, k)
    trace = float(np.trace(cov))
    values = np.where(values > max(0.0, trace) * len(mean) * 4e-16, values, 0.0)      # the rest is rounding
    m, error = int((values > 0).sum()), None
    if m:
        white = covariance(distinct, mean, n, components[:, :m], np.sqrt(values[:m]))
        error = float(np.abs(white - np.eye(m)).max())
    return Whitening(n, total, values, components, trace, error)


def whitened(rows: DataFrame, w: Whitening) -> DataFrame:
    """``id, component, n, deviation, whitened, explained, identity_error``: one row per vector and component."""
    import numpy as np
    k, mean = len(w.values), np.array([s / w.n for s in w.sums])
    used = w.values > 0
    scale = np.where(used, np.sqrt(np.where(used, w.values, 1.0)), 1.0)
    explained = [float(e / w.trace) if w.trace > 0 else None for e in w.values]
    squares = sum(s * s for s in w.sums)

    def run(batches):
        import pyarrow as pa
        total = np.array(w.sums, object)
        for batch in batches:
            x = _matrix(batch.column(1), np.int64)
            # sum of (n x - S)^2 = n n x.x - 2 n x.S + S.S
            most = int(np.abs(x).max(initial=0))
            if len(w.sums) * (w.n * most + max(map(abs, w.sums))) ** 2 < 2 ** 61:
                own = w.n * x - np.array(w.sums, np.int64)
                deviation = (own * own).sum(axis=1).tolist()
            else:
                o = x.astype(object)
                deviation = [v if v < 2 ** 63 else None for v in (w.n * w.n * (o * o).sum(axis=1) - 2 * w.n * (o @ total) + squares).tolist()]
            y = (x - mean) @ w.components / scale
            n = len(x)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(np.repeat(np.arange(n), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                pa.array(np.full(n * k, w.n)), pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(n), k))),
                pa.array(y.ravel(), mask=~np.tile(used, n)), pa.array(explained * n, pa.float64()), pa.array([w.identity_error] * (n * k), pa.float64()),
            ], names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    kind = rows.schema["id"].dataType.simpleString()
    return map_batches(rows.select("id", "x"), run, f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def report(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """Every usable row of ``df`` whitened by the fit on all its distinct vectors."""
    rows = whole(df, id_col, vector_col)
    w = fit(rows, k)
    if w is None:
        empty = F.lit(None)
        return rows.limit(0).select("id", empty.cast("int").alias("component"), *[empty.cast("long").alias(c) for c in ("n", "deviation")],
                                    *[empty.cast("double").alias(c) for c in ("whitened", "explained", "identity_error")]).withColumnRenamed("id", id_col)
    return whitened(rows, w).withColumnRenamed("id", id_col)
