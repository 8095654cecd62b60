"""Connected components of an edge table by alternating star contractions.

Each round points every larger neighbour of a vertex at the vertex's smallest
neighbour, then every smaller neighbour likewise; rounds are staged in the shared
folder and stop when the edges no longer change.  Joins on a vertex are salted
by the other end, so a vertex with a large share of all edges is spread out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavecohort.llm.common import staged

SALTS = 16


def _joined(edges: DataFrame, least: DataFrame) -> DataFrame:
    salt = F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")
    spread = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return edges.withColumn("salt", salt).join(spread, ["u", "salt"])


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    return _joined(both.filter("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = _joined(e, least).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def stars(edges: DataFrame, name: str = "star") -> DataFrame:
    """``(u, v)``: every vertex that has an edge and is not the least of its
    component, with that least vertex.  ``edges``: columns ``u, v`` of one ordered
    type, ``u <> v``."""
    e = staged(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    seen = None
    while True:
        now = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == seen or not now.n:
            return e
        seen = now
        e = staged(_small_star(_large_star(e)), name)
