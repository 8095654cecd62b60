"""Mixing sources to target weights by hierarchical budgeting (operator 9).

Documents hang on the leaves of a tree (domain, language, source).  The token budget
runs down from the root: siblings share their parent's amount in proportion to
their weights, no node gets more than its subtree can supply (tokens of its leaves
times ``epochs``), and what a node can't use goes to its siblings first; only what
the whole family can't use has gone to the parent's siblings, as the parent's own
share was bounded by the family's supply.  With caps ``c`` and weights ``w`` that is
``min(c, level * w)`` with one level per family, found by window sums over the
siblings in the order of ``c / w``.

A leaf with budget ``b`` and ``t`` tokens takes every document ``b // t`` times and, in
the next epoch's seeded order, the prefix that holds the rest; the last document
may count in part.  Prefixes are found without sorting a leaf: token sums of 4096
hash ranges per leaf, then running sums inside each range.  So a leaf with a third
of all rows is spread over 4096 groups.

Defined cases: null text counts as empty (its end id is one token); null branch
names are the branch ``(none)``; repeated rows count as often as they occur (the
order among equal rows doesn't matter); weights that aren't given are 1, weights
must be positive; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavecohort.llm.common import fresh, map_batches, staged, text_or_empty, vocabulary_path
from wavecohort.llm.tokens import MAX_WORDS

LEVELS = ("domain", "lang", "source")
BITS, SALTS = 12, 16


@dataclass(frozen=True)
class Mix:
    """Target: ``budget`` is a share of all tokens, or tokens when above 1."""
    budget: float = 0.6
    epochs: int = 4
    seed: int = 0
    weights: dict = field(default_factory=lambda: {("d0",): 2.0, ("d0", "en"): 3.0, ("d1", "en"): 3.0, ("d2", "en"): 2.0, ("d3", "en"): 2.0})


def default_domain(source: Column) -> Column:
    """Domain of a source where the table has none: four groups of sources."""
    return F.concat(F.lit("d"), F.pmod(F.crc32(source.cast("binary")), F.lit(4)).cast("string"))


def _branches(df: DataFrame, domain: Column | None, lang_col: str, source_col: str) -> list[Column]:
    none = F.lit("(none)")
    source = F.coalesce(F.col(source_col).cast("string"), none)
    return [(domain if domain is not None else default_domain(source)).alias("domain"),
            F.coalesce(F.col(lang_col).cast("string"), none).alias("lang"), source.alias("source")]


def _row_hash(id_col: str, text: Column) -> Column:
    return F.xxhash64(F.col(id_col), text)


def _order(seed: int, epoch: Column, row_hash: Column) -> Column:
    """Place in the seeded order of an epoch."""
    return F.xxhash64(F.lit(seed), epoch.cast("long"), row_hash)


def counted(df: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", domain: Column | None = None,
            lang_col: str = "lang", source_col: str = "source", max_words: int = MAX_WORDS) -> DataFrame:
    """``doc_id, domain, lang, source, row_hash, tokens``: the only reading of texts.
    ``max_words`` bounds a worker's word table (speed against memory)."""
    path, text = vocabulary or vocabulary_path(), text_or_empty(text_col)
    rows = df.select(F.col(id_col).alias("doc_id"), *_branches(df, domain, lang_col, source_col), _row_hash(id_col, text).alias("row_hash"),
                     text.alias("text"))

    def run(batches):
        import pyarrow as pa

        from wavecohort.llm.tokens import encoder, slices
        enc = encoder(path, max_words)
        for batch in batches:
            n = []
            for a, k in slices(batch.column(5)):
                n += [len(x) // 4 + 1 for x in enc.encode(batch.column(5).slice(a, k))]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(5)] + [pa.array(n, pa.int64())],
                                             names=[*batch.schema.names[:5], "tokens"])
    return map_batches(rows, run, rows.drop("text").withColumn("tokens", F.lit(0).cast("long")).schema)


def _share(children: DataFrame, parents: DataFrame, family: list[str]) -> DataFrame:
    """``amount`` of each child: ``min(cap, level * weight)``, summing to the parent's."""
    rows = children.join(parents.withColumnRenamed("amount", "whole"), family)
    by = Window.partitionBy(*family).orderBy(F.col("cap") / F.col("weight"), "name")
    used, left = F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing))
    full = F.col("cap") / F.col("weight") <= (F.col("whole") - F.coalesce(used, F.lit(0.0))) / left
    rows = rows.withColumn("full", full)
    all_ = Window.partitionBy(*family)
    level = (F.col("whole") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(all_)) / F.sum(F.when(~F.col("full"), F.col("weight"))).over(all_)
    return rows.withColumn("amount", F.when(F.col("full"), F.col("cap")).otherwise(level * F.col("weight")))


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """``domain, lang, source, tokens, budget`` from leaf token sums ``domain, lang, source, tokens``."""
    spark, keys = leaves.sparkSession, list(LEVELS)
    if any(w <= 0 for w in mix.weights.values()):
        raise ValueError("weights must be positive")
    given = [("/".join(map(str, path)), float(w)) for path, w in mix.weights.items()] or [("", 1.0)]
    given = F.broadcast(spark.createDataFrame(given, "path string, weight double"))     # the parameter itself
    supply = F.sum("tokens").cast("double")
    total = F.least(supply * mix.epochs, supply * mix.budget if mix.budget <= 1 else F.lit(float(mix.budget)))
    parents, family = leaves.agg(total.alias("amount")).withColumn("root", F.lit(0)), ["root"]
    for depth, name in enumerate(keys):
        nodes = leaves.withColumn("root", F.lit(0)).groupBy("root", *keys[:depth + 1]).agg((supply * mix.epochs).alias("cap"))
        nodes = (nodes.withColumn("path", F.concat_ws("/", *keys[:depth + 1])).join(given, "path", "left")
                 .withColumn("weight", F.coalesce("weight", F.lit(1.0))).withColumn("name", F.col(name)))
        parents = _share(nodes, parents, family).select("root", *keys[:depth + 1], "amount")
        family = ["root", *keys[:depth + 1]]
    return leaves.join(parents.drop("root"), keys).select(*keys, "tokens", F.floor(F.col("amount") + 1e-6).alias("budget"))


def _plan(df_counted: DataFrame, mix: Mix) -> DataFrame:
    leaves = df_counted.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    plan = budgets(staged(leaves, "mix-leaves"), mix)
    plan = plan.withColumn("epochs", F.floor(F.col("budget") / F.col("tokens"))).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens"))
    return staged(plan.withColumnRenamed("tokens", "leaf_tokens"), "mix-plan")


def _with_plan(rows: DataFrame, plan: DataFrame, salt: Column) -> DataFrame:
    """Join on the leaf, salted: one leaf may hold most rows (and Spark broadcasts
    the written plan where its size allows)."""
    spread = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(salt, F.lit(SALTS)).cast("int")).join(spread, [*LEVELS, "salt"]).drop("salt")


def taken(df_counted: DataFrame, mix: Mix) -> DataFrame:
    """Rows of a written ``counted`` table with ``leaf_budget, epochs`` (whole ones), ``part_tokens``
    (taken in the last epoch), ``taken_tokens`` and ``order`` (place in the last epoch)."""
    plan = _plan(df_counted, mix)
    rows = _with_plan(df_counted, plan, F.col("row_hash")).withColumn("order", _order(mix.seed, F.col("epochs"), F.col("row_hash")))
    rows = rows.withColumn("bin", F.shiftright("order", 64 - BITS))
    # sums before each bin in two steps of 2^(BITS / 2) rows: a leaf with most rows is no large group here
    wide = F.shiftright("bin", BITS // 2)
    sums = rows.groupBy(*LEVELS, "bin").agg(F.sum("tokens").alias("bin_tokens")).withColumn("wide", wide)

    def upto(value, keys, order):
        w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(value).over(w), F.lit(0))
    coarse = (sums.groupBy(*LEVELS, "wide").agg(F.sum("bin_tokens").alias("wide_tokens"))
              .select(*LEVELS, "wide", upto("wide_tokens", LEVELS, "wide").alias("wide_before")))
    before = (sums.withColumn("inside", upto("bin_tokens", [*LEVELS, "wide"], "bin")).join(coarse, [*LEVELS, "wide"])
              .select(*LEVELS, "bin", (F.col("wide_before") + F.col("inside")).alias("before")))
    inside = Window.partitionBy(*LEVELS, "bin").orderBy("order", "row_hash").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("rest") - F.col("before") - F.coalesce(F.sum("tokens").over(inside), F.lit(0))
    return (rows.join(before, [*LEVELS, "bin"]).withColumn("part_tokens", F.greatest(F.lit(0).cast("long"), F.least("tokens", left)))
            .withColumn("taken_tokens", F.col("epochs") * F.col("tokens") + F.col("part_tokens"))
            .select("doc_id", *LEVELS, "tokens", F.col("budget").alias("leaf_budget"), "epochs", "part_tokens", "taken_tokens", "order"))


def mixed(df: DataFrame, mix: Mix = Mix(), **options) -> DataFrame:
    """One row per row of ``df``: its leaf, tokens and how much of it the mix takes."""
    return taken(staged(counted(df, **options), "mix-counted"), mix)


def selected(df: DataFrame, mix: Mix, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", domain: Column | None = None,
             lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Rows of ``df`` (same columns) as often as the mix takes them: once for every whole epoch, and once
    more in the last epoch's prefix (whose last row may count in part).

    A leaf's prefix ends at one place of its order, so rows are selected by
    comparing their own place: no text is shuffled.  Rows equal in id and text share that place; the
    rows at the end of a prefix are written and numbered (per file, plus those of earlier files), and as many as
    the mix takes are kept.
    """
    named = dict(id_col=id_col, text_col=text_col, domain=domain, lang_col=lang_col, source_col=source_col)
    rows = taken(staged(counted(df, vocabulary, **named), "mix-counted"), mix)
    places = rows.groupBy(*LEVELS, "order").agg(F.max("epochs").alias("epochs"), F.count(F.when(F.col("part_tokens") > 0, 1)).alias("n"))
    place = F.when(F.col("n") > 0, F.col("order"))
    ends = staged(places.groupBy(*LEVELS).agg(F.max("epochs").alias("epochs"), F.max(place).alias("last"), F.max_by("n", place).alias("n_last")), "mix-ends")
    tmp = fresh(df, "mix_row")
    inner = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(tmp)
    keyed = df.select(inner, *_branches(df, domain, lang_col, source_col), _row_hash(id_col, text_or_empty(text_col)).alias("row_hash"))
    placed = _with_plan(keyed, ends, F.col("row_hash")).withColumn("own", _order(mix.seed, F.col("epochs"), F.col("row_hash")))
    at_end = F.coalesce(F.col("own") == F.col("last"), F.lit(False))
    last = staged(placed.filter(at_end).withColumns({"part": F.spark_partition_id(), "seq": F.monotonically_increasing_id()}), "mix-last")
    earlier = Window.partitionBy(*LEVELS).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)        # one row a file
    files = last.groupBy(*LEVELS, "part").agg(F.count(F.lit(1)).alias("rows")).select(*LEVELS, "part", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"))
    number = F.row_number().over(Window.partitionBy(*LEVELS, "part").orderBy("seq")) + F.col("before")
    last = last.join(files, [*LEVELS, "part"]).withColumn("more", (number <= F.col("n_last")).cast("int"))
    rest = placed.filter(~at_end).withColumn("more", F.coalesce((F.col("own") < F.col("last")).cast("int"), F.lit(0)))
    out = rest.select(tmp, "epochs", "more").union(last.select(tmp, "epochs", "more"))
    times = (F.col("epochs") + F.col("more")).cast("int")
    return out.filter(times > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), times))).select(F.col(f"{tmp}.*"))
