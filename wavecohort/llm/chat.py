"""Chat formatting with cumulative-snapshot collapse (operator 4), DataFrame functions only.

A service that logs a conversation after every turn leaves prefixes of the final
one.  Every turn gets its position and a rolling hash of the whole prefix up to it:
the sums of position-dependent 32-bit hashes of role and text (96 bits in all).
Two prefixes are equal when length and sums are.  A conversation whose last hash
is a proper prefix hash of another one is dropped by an anti-join; of equal
conversations the least id stays.  The kept ones are rendered in ChatML form.

A conversation of any length is cut into blocks of ``BLOCK`` turn numbers: sums run
within blocks, and over one row per block, so no task needs a whole conversation;
the rendered text has one row per block (``part``).  Prefixes that many
conversations share are made distinct before the join.

Defined cases: null role is ``user``, null text empty, a null turn comes first
(block -1); a null conv_id is one conversation with no id; repeated rows count once;
different rows with one turn number are put in the order of their hashes; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 256
START, END = "<|im_start|>", "<|im_end|>"


def _turns(df: DataFrame) -> DataFrame:
    role = F.coalesce(F.col("role").cast("string"), F.lit("user"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    turn = F.col("turn").cast("long")
    return df.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"), role.alias("role"), text.alias("text"),
                     F.coalesce(F.floor(turn / BLOCK), F.lit(-1)).alias("part"),
                     F.xxhash64(role, text).alias("h1"), F.xxhash64(F.lit(1), text, role).alias("h2"))


def _running(df: DataFrame, values: list[str]) -> DataFrame:
    """``df`` with every value replaced by its running sum over the conversation."""
    block = df.groupBy("conv_id", "part").agg(*[F.sum(v).alias(f"{v}_block") for v in values])
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    block = block.select(F.col("conv_id").alias("b_conv"), F.col("part").alias("b_part"),
                         *[F.coalesce(F.sum(f"{v}_block").over(before), F.lit(0)).alias(f"{v}_before") for v in values])
    within = Window.partitionBy("conv_id", "part").orderBy(F.col("turn").asc_nulls_first(), "h1", "h2").rowsBetween(Window.unboundedPreceding, 0)
    run = df.withColumns({v: F.sum(v).over(within) for v in values})
    on = F.col("conv_id").eqNullSafe(F.col("b_conv")) & (F.col("part") == F.col("b_part"))
    return run.join(block, on).withColumns({v: F.col(v) + F.col(f"{v}_before") for v in values}).select(*df.columns)


def prefixes(df: DataFrame) -> DataFrame:
    """``conv_id, length, s1, s2, s3, n_turns``: the hash of every prefix of every conversation."""
    turns = _turns(df).select("conv_id", "part", "turn", "h1", "h2").distinct().withColumn("length", F.lit(1).cast("long"))
    placed = _running(turns, ["length"])
    g1, g2 = F.xxhash64("length", "h1", "h2"), F.xxhash64("h2", "length", "h1")
    low = F.lit(0xFFFFFFFF).cast("long")
    summed = _running(placed.withColumns({"s1": g1.bitwiseAND(low), "s2": F.shiftrightunsigned(g1, 32), "s3": g2.bitwiseAND(low)}),
                      ["s1", "s2", "s3"])
    total = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns")).withColumnRenamed("conv_id", "t_conv")
    return summed.join(total, F.col("conv_id").eqNullSafe(F.col("t_conv"))).select("conv_id", "length", "s1", "s2", "s3", "n_turns")


def maximal(df: DataFrame) -> DataFrame:
    """``conv_id, n_turns, copies`` of the conversations that are no prefix of another."""
    every, key = prefixes(df), ["length", "s1", "s2", "s3"]
    proper = every.filter("length < n_turns").select(*key).distinct()
    whole = every.filter("length = n_turns").groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"))
    return whole.join(proper, key, "left_anti").select("conv_id", F.col("length").alias("n_turns"), "copies")


def formatted(df: DataFrame) -> DataFrame:
    """Rendered maximal conversations: ``conv_id, part, n_turns, copies, text``.

    The texts of a conversation's parts in order are its whole rendering; markers
    inside a turn are broken up.
    """
    kept = maximal(df).withColumnRenamed("conv_id", "k_conv")

    def safe(c):
        return F.replace(c, F.lit("<|im_"), F.lit("<| im_"))
    shown = F.concat(F.lit(START), safe(F.col("role")), F.lit("\n"), safe(F.col("text")), F.lit(END + "\n"))
    rows = _turns(df).join(kept, F.col("conv_id").eqNullSafe(F.col("k_conv")))
    # a group is one block of one conversation
    return (rows.groupBy("conv_id", "part", "n_turns", "copies")
            .agg(F.array_sort(F.collect_set(F.struct("turn", "h1", "h2", shown.alias("shown")))).alias("turns"))
            .select("conv_id", "part", "n_turns", "copies", F.array_join(F.col("turns.shown"), "").alias("text")))


def oracle_sql() -> str:
    """The formatting of ``conversations`` as DuckDB SQL (turn numbers without ties)."""
    def safe(c):
        return f"replace({c}, '<|im_', '<| im_')"
    return f"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations),
c AS (SELECT conv_id, list(md5(role || chr(31) || text) ORDER BY turn NULLS FIRST) AS h FROM t GROUP BY conv_id),
proper AS (SELECT DISTINCT md5(array_to_string(h[1:k], '')) AS x FROM (SELECT h, unnest(range(1, len(h))) AS k FROM c)),
kept AS (SELECT min(conv_id) AS conv_id, len(h) AS n_turns, count(*) AS copies FROM c
         WHERE md5(array_to_string(h, '')) NOT IN (SELECT x FROM proper) GROUP BY h)
SELECT conv_id, coalesce(floor(turn / {BLOCK}), -1)::BIGINT AS part, n_turns, copies,
       string_agg('{START}' || {safe('role')} || chr(10) || {safe('text')} || '{END}' || chr(10), '' ORDER BY turn NULLS FIRST) AS text
FROM t JOIN kept USING (conv_id) GROUP BY ALL"""
