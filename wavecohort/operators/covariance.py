"""Covariance operators on wave matrices (V1-V7).

Input is long ``(case, voi, idx, value)`` with an orderable ``voi`` index.
Population moments (divide by n).  Matrices stay long ``(case, i, j, cov)``
with ``i >= j`` until an edge needs an array.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


def covariance(long: DataFrame, case: str = "case", method: str = "scm", full: bool = False,
               vois: list | None = None) -> DataFrame:
    """V1-V3: per-case covariance, ``scm`` (empirical), ``lwf`` (Ledoit-Wolf)
    or ``oas`` (oracle approximating shrinkage).

    Each grid point of a case becomes one row with a column per VOI (explicit
    value list), then one aggregate per case computes every ``covar_pop``
    pair, the VOI means and the point count: no self join, no pairs of rows.
    One hash partitioning by case serves both aggregates and the shrinkage
    moments; a case holds d × n rows (the grid), so no case can be hot.
    ``vois`` lists the VOI values (read from the data when omitted: d values).
    """
    if vois is None:
        vois = sorted(r[0] for r in long.select("voi").distinct().collect())
    d = len(vois)
    # Expressions are written as SQL text: one parse per expression instead of
    # one JVM call per operator (the plans stay identical).
    lit = [repr(v) if isinstance(v, str) else str(v) for v in vois]
    wide = (long.repartition(case).groupBy(case, "idx")
            .agg(*[F.expr(f"max(CASE WHEN voi = {lv} THEN value END)").alias(f"_x{k}") for k, lv in enumerate(lit)]))
    pairs = [(a, b) for a in range(d) for b in range(d) if a >= b]
    st = wide.groupBy(case).agg(*[F.expr(f"covar_pop(_x{a}, _x{b})").alias(f"_c{a}_{b}") for a, b in pairs],
                                *[F.expr(f"avg(_x{k})").alias(f"_m{k}") for k in range(d)],
                                F.expr("count(1)").alias("_n"))
    cells = "array(" + ", ".join(f"named_struct('i', {lit[a]}, 'j', {lit[b]}, 'cov', _c{a}_{b})" for a, b in pairs) + ")"
    s = st.select(case, F.explode(F.expr(cells)).alias("_p")).select(case, "_p.i", "_p.j", "_p.cov")
    if method != "scm":
        s = _shrink(wide, st, s, case, d, pairs, method)
    return mirror(s, case) if full else s


def mirror(lower: DataFrame, case: str = "case") -> DataFrame:
    """Lower triangle → full symmetric matrix rows."""
    rest = [c for c in lower.columns if c not in (case, "i", "j")]
    up = lower.filter(F.col("i") != F.col("j")).select(case, F.col("j").alias("i"), F.col("i").alias("j"), *rest)
    return lower.unionByName(up)


def _shrink(wide: DataFrame, st: DataFrame, s: DataFrame, case: str, d: int, pairs, method: str) -> DataFrame:
    """Shrinkage toward the scaled identity from per-case moments:
    tr S, ‖S‖²_F and Σ_k ‖x_k − m‖⁴ (centred grid points)."""
    tr = " + ".join(f"_c{a}_{a}" for a in range(d))
    fro2 = " + ".join(f"{1.0 if a == b else 2.0} * _c{a}_{b} * _c{a}_{b}" for a, b in pairs)
    m = st.selectExpr(case, f"{tr} AS tr", f"{fro2} AS fro2", "CAST(_n AS DOUBLE) AS n", *[f"_m{k}" for k in range(d)])
    q = " + ".join(f"pow(_x{k} - _m{k}, 2)" for k in range(d))
    q4 = (wide.join(m.select(case, *[f"_m{k}" for k in range(d)]), case)
          .groupBy(case).agg(F.expr(f"sum(pow({q}, 2))").alias("q4")))
    m = m.join(q4, case)
    mu = f"(tr / {float(d)})"
    if method == "oas":
        den = f"((n + 1.0) * (fro2 - tr * tr / {float(d)}))"
        rho = f"CASE WHEN {den} = 0 THEN 1.0 ELSE least(1.0, (fro2 + tr * tr) / {den}) END"
    elif method == "lwf":
        delta = f"((fro2 - 2.0 * {mu} * tr + {float(d)} * {mu} * {mu}) / {float(d)})"
        beta = f"least((q4 / n - fro2) / ({float(d)} * n), {delta})"
        rho = f"CASE WHEN {beta} = 0 THEN 0.0 ELSE {beta} / {delta} END"
    else:
        raise ValueError(method)
    r = m.selectExpr(case, f"{rho} AS shrinkage", f"{mu} AS _mu")
    return s.join(r, case).selectExpr(
        case, "i", "j", "CASE WHEN i = j THEN (1.0 - shrinkage) * cov + shrinkage * _mu "
                        "ELSE (1.0 - shrinkage) * cov END AS cov", "shrinkage")


def cov_diag(cov: DataFrame, d: int, case: str = "case") -> DataFrame:
    """V4: variances only, one column per VOI (explicit value list)."""
    return (cov.filter(F.col("i") == F.col("j")).groupBy(case)
            .agg(*[F.max(F.when(F.col("i") == k, F.col("cov"))).alias(f"var_{k}") for k in range(d)]))


def cov_vech(cov: DataFrame, case: str = "case") -> DataFrame:
    """V5: half-vectorisation, lower triangle column by column:
    (0,0), (1,0), …, (d−1,0), (1,1), (2,1), …"""
    pts = F.array_sort(F.collect_list(F.struct(F.col("j").alias("c"), F.col("i").alias("r"), F.col("cov").alias("v"))))
    return cov.filter(F.col("i") >= F.col("j")).groupBy(case).agg(pts.alias("_p")).select(case, F.col("_p.v").alias("vech"))


def to_flat(cov_lower: DataFrame, d: int, case: str = "case", extra: list[str] | None = None) -> DataFrame:
    """Full d×d matrix as a row-major ``ARRAY<DOUBLE>`` per case."""
    extra = extra or []
    full = mirror(cov_lower.select(case, "i", "j", "cov"), case)
    pts = F.array_sort(F.collect_list(F.struct((F.col("i") * d + F.col("j")).alias("p"), F.col("cov").alias("v"))))
    return full.groupBy(case).agg(pts.alias("_p")).select(case, F.col("_p.v").alias("cov"))


def mean_cov_euclid(flat: DataFrame, by: str) -> DataFrame:
    """V6 (euclid): element-wise mean of the flattened matrices per class.

    Entries are exploded and averaged per (class, position), so a class is
    aggregated in parallel; only the d² means are gathered per class.
    """
    e = flat.select(by, F.posexplode("cov").alias("p", "x")).groupBy(by, "p").agg(F.avg("x").alias("x"))
    pts = F.array_sort(F.collect_list(F.struct("p", "x")))
    return e.groupBy(by).agg(pts.alias("_m")).select(by, F.col("_m.x").alias("mean_cov"))


def mean_cov_euclid_long(cov_lower: DataFrame, cases: DataFrame, by: str, case: str = "case") -> DataFrame:
    """V6 (euclid) in long form: ``avg(cov)`` per (class, i, j); the scalable
    form (no per-class array)."""
    return (cov_lower.join(cases.select(case, by), case).groupBy(by, "i", "j")
            .agg(F.avg("cov").alias("mean_cov")))


def _sym_fn(m: np.ndarray, fn) -> np.ndarray:
    w, v = np.linalg.eigh(m)
    return (v * fn(w)[..., None, :]) @ np.swapaxes(v, -1, -2)


def mean_cov_riemann(flat: DataFrame, by: str, d: int, tol: float = 1e-8, max_iter: int = 100,
                     metric: str = "riemann") -> DataFrame:
    """V6: affine-invariant (``riemann``) or log-Euclidean mean per class.

    Riemann: start at the Euclidean mean; each iteration maps every matrix to
    the tangent space at the class's current mean with a vectorised pandas UDF
    (``log(C^-½ Ci C^-½)``), averages natively per class, and moves the d×d
    mean on the driver (classes × d² numbers) along the averaged tangent, whose norm is the residual.  The step
    follows from the last two residuals (secant quotient); a step after which the residual has grown is
    taken back and halved.  A class whose residual is below ``tol`` stops: its matrices
    are mapped no more.  Input is checkpointed once to the cluster's checkpoint folder so each iteration rereads it
    instead of recomputing the lineage.  Raises when a class isn't done after ``max_iter`` iterations.
    """
    spark = flat.sparkSession
    data = flat.select(by, "cov").checkpoint(eager=True)
    arr_t = ArrayType(DoubleType())

    @F.pandas_udf(arr_t)
    def logm_at(cov: pd.Series, isq: pd.Series) -> pd.Series:
        c = np.stack(cov.map(np.asarray).to_numpy()).reshape(-1, d, d)
        s = np.stack(isq.map(np.asarray).to_numpy()).reshape(-1, d, d)
        t = s @ c @ s
        t = (t + np.swapaxes(t, -1, -2)) / 2
        out = _sym_fn(t, np.log)
        return pd.Series(list(out.reshape(-1, d * d)))

    @F.pandas_udf(arr_t)
    def logm(cov: pd.Series) -> pd.Series:
        c = np.stack(cov.map(np.asarray).to_numpy()).reshape(-1, d, d)
        return pd.Series(list(_sym_fn((c + np.swapaxes(c, -1, -2)) / 2, np.log).reshape(-1, d * d)))

    def avg_arrays(df, col):
        e = df.select(by, F.posexplode(col).alias("p", "x")).groupBy(by, "p").agg(F.avg("x").alias("x"))
        rows = e.collect()  # classes × d² numbers
        out = {}
        for r in rows:
            out.setdefault(r[by], np.zeros(d * d))[r["p"]] = r["x"]
        return {k: v.reshape(d, d) for k, v in out.items()}

    if metric == "logeuclid":
        means = {k: _sym_fn(v, np.exp) for k, v in avg_arrays(data.withColumn("l", logm("cov")), "l").items()}
    else:
        means = avg_arrays(data, "cov")
        tried = dict(means)                              # where the residual is measured next
        steps = dict.fromkeys(means, 1.0)
        tangents: dict = {}                              # at the accepted means
        live = set(means)
        for _ in range(max_iter):
            isq = {k: _sym_fn(tried[k], lambda w: 1.0 / np.sqrt(w)) for k in live}
            lut = spark.createDataFrame([(k, [float(x) for x in v.ravel()]) for k, v in isq.items()],
                                        f"{by} {data.schema[by].dataType.simpleString()}, isq array<double>")
            t = data.join(F.broadcast(lut), by).withColumn("l", logm_at("cov", "isq"))
            for k, tangent in avg_arrays(t, "l").items():
                residual, before = np.linalg.norm(tangent), tangents.get(k)
                if before is not None and residual >= np.linalg.norm(before):
                    steps[k] /= 2.0
                else:
                    if before is not None:
                        moved, turned = steps[k] * before, before - tangent
                        quotient = float(np.sum(moved * moved) / np.sum(moved * turned)) if np.sum(moved * turned) > 0 else 1.0
                        steps[k] = min(max(quotient, 0.05), 2.0)
                    means[k], tangents[k] = tried[k], tangent
                    if residual < tol:
                        live.discard(k)
                        continue
                sq = _sym_fn(means[k], np.sqrt)
                tried[k] = sq @ _sym_fn(steps[k] * tangents[k], np.exp) @ sq
            if not live:
                break
        else:
            worst = max(float(np.linalg.norm(tangents[k])) for k in live)
            raise RuntimeError(f"Riemannian mean: residual {worst:.3g} after {max_iter} iterations (tolerance {tol:.3g})")
    rows = [(k, [float(x) for x in v.ravel()]) for k, v in means.items()]
    return spark.createDataFrame(rows, f"{by} {data.schema[by].dataType.simpleString()}, mean_cov array<double>")


def sample_per_class(df: DataFrame, by: str, id_col: str, k: int, seed: int = 42, salts: int = 64) -> DataFrame:
    """V7: ``k`` pseudo-random rows per class, by ``md5(id || seed)`` order.

    Two phases so that a huge class never sits in one window partition: top
    ``k`` inside each (class, salt) bucket, then top ``k`` among those
    ``k · salts`` candidates per class.  Exact: the global top k of a class is
    contained in the union of its buckets' top k.
    """
    h = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(str(seed))))
    d = df.withColumn("_h", h).withColumn("_s", F.pmod(F.xxhash64("_h"), F.lit(salts)))
    w1 = Window.partitionBy(by, "_s").orderBy("_h")
    cand = d.withColumn("_r", F.row_number().over(w1)).filter(F.col("_r") <= k)
    w2 = Window.partitionBy(by).orderBy("_h")
    return cand.withColumn("_r", F.row_number().over(w2)).filter(F.col("_r") <= k).drop("_h", "_s", "_r")
