"""Query registry: name → (Spark plan builder, DuckDB oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}


# Oracle contract: doubles whose last bits depend on summation order or on
# the math library are rounded to this many places on both sides.
ROUND_DIGITS = 6


def query(name: str, sql: str | None = None, rounded: tuple[str, ...] = ()):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` with its oracle SQL.

    ``rounded`` names DOUBLE output columns that both the Spark result and the
    oracle round to :data:`ROUND_DIGITS` places.
    """
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        run, oracle = fn, sql
        if rounded:
            from pyspark.sql import functions as F

            def run(spark, d, _fn=fn):
                df = _fn(spark, d)
                return df.withColumns({c: F.round(c, ROUND_DIGITS) for c in rounded})
            run.__doc__, run.__name__ = fn.__doc__, fn.__name__
            if sql:
                # "+ 0.0" turns a rounded -0.0 into 0.0, as Spark's decimal rounding does
                repl = ", ".join(f'round("{c}", {ROUND_DIGITS}) + 0.0 AS "{c}"' for c in rounded)
                oracle = f"SELECT * REPLACE ({repl}) FROM (\n{sql}\n) AS _q"
        REGISTRY[name] = (run, oracle)
        return fn
    return deco


def load_all() -> dict[str, tuple[QueryFn, str | None]]:
    # Importing the query modules fills the registry.
    from wavecohort.plans import q_cohort, q_jobs, q_relational, q_score, q_series  # noqa: F401
    return REGISTRY
