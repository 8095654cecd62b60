"""One-permutation MinHash fingerprints (operator 7), DataFrame functions only.

Every 5-word shingle is hashed once; the hash's top bits name one of ``BINS`` bins,
and a bin keeps its least hash.  An empty bin takes the value of the first filled bin in a
random sequence of its own (optimal densification); after ``PROBES`` misses, of the
filled bin with the least hash of the pair of bin numbers, which is as uniform.  A
fingerprint stores the ``BITS`` low-order bits of every bin, packed.  Equal lanes
happen by chance with probability 2^-BITS, so the estimate of the Jaccard likeness
is ``(equal share - 2^-BITS) / (1 - 2^-BITS)``, at least 0.

Neighbours in the order of ids are found without a global sort: ids are cut into
ranges at quantiles (and those into equal parts when there are many rows), one
window runs inside each range, and a copy of the next range's first row closes each.

Defined cases: null text counts as empty; a text without words has a fingerprint of
its own, likeness 1 to another such and 0 to others; fewer than five words are one
shingle; null ids come first, rows with equal ids are ordered by a hash of the text;
a single row is its own next one; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavecohort.llm.common import text_or_empty

BINS, BITS, SHINGLE, PROBES = 128, 8, 5, 8
RANGES, RANGE_ROWS = 256, 20_000
_LANES = 64 // BITS
_BIN_SHIFT = 64 - (BINS.bit_length() - 1)
_LOW = 0x0101010101010101


def _bin(h: Column) -> Column:
    return F.shiftrightunsigned(h, _BIN_SHIFT).cast("int")


def with_fingerprint(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """``df`` with the packed fingerprint (array of longs) of a string column in ``out``."""
    w, h, m, p, b, d = (f"{x}_{out}" for x in ("w", "h", "m", "p", "b", "d"))
    keep = df.columns
    words = F.array_remove(F.split(F.lower(F.col(text_col)), r"[\s]+"), "")
    n = F.greatest(F.size(w) - (SHINGLE - 1), F.lit(1))
    shingles = F.arrays_zip(*[F.slice(F.col(w), F.lit(i + 1), n).alias(f"w{i}") for i in range(SHINGLE)])
    hashes = F.sort_array(F.transform(shingles, lambda z: F.xxhash64(z)))
    # sorted hashes: bins are runs, their first element is the least
    least = F.filter(F.col(h), lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(F.col(h), i - 1))))

    # least hash of every bin, null where empty
    filled = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda j: F.get(F.col(m), (F.array_position(F.col(p), j) - 1).cast("int")))

    def value(j):
        probes = [F.get(F.col(b), F.xxhash64(j, F.lit(t)).bitwiseAND(F.lit(BINS - 1).cast("long")).cast("int")) for t in range(PROBES)]
        order = F.array_min(F.transform(F.col(m), lambda x: F.struct(F.xxhash64(j, _bin(x)).alias("o"), x.alias("x"))))
        return F.coalesce(F.get(F.col(b), j), *probes, order["x"])
    bins = F.when(F.size(m) == 0, F.array_repeat(F.lit(0).cast("long"), BINS)).otherwise(
        F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), value))
    low = F.lit((1 << BITS) - 1).cast("long")
    packed = F.transform(F.sequence(F.lit(0), F.lit(BINS // _LANES - 1)), lambda i: reduce(
        lambda a, c: a.bitwiseOR(c), [F.shiftleft(F.get(F.col(d), i * _LANES + k).bitwiseAND(low), BITS * k) for k in range(_LANES)]))
    return (df.withColumn(w, words).withColumn(h, hashes).select(*keep, h).withColumn(m, least).select(*keep, m)
            .withColumn(p, F.transform(F.col(m), _bin)).withColumn(b, filled).withColumn(d, bins).select(*keep, F.size(m).alias(h), d)
            .withColumn(out, F.when(F.col(h) > 0, packed).otherwise(F.array().cast("array<bigint>"))).select(*keep, out))


def as_hex(fp: str) -> Column:
    """Hexadecimal text of a packed fingerprint (no words: all zeros)."""
    digits = F.lower(F.array_join(F.transform(F.col(fp), lambda x: F.lpad(F.hex(x), 16, "0")), ""))
    return F.rpad(digits, BINS * BITS // 4, "0")


def likeness(a: str, b: str) -> Column:
    """Bias-corrected Jaccard estimate of two packed fingerprints."""
    def unequal(x, y):
        d = x.bitwiseXOR(y)
        shift = BITS // 2
        while shift:                                 # a lane's lowest bit becomes the OR of its bits
            d = d.bitwiseOR(F.shiftrightunsigned(d, shift))
            shift //= 2
        return F.bit_count(d.bitwiseAND(F.lit(_LOW).cast("long")))
    differ = F.aggregate(F.zip_with(F.col(a), F.col(b), unequal), F.lit(0), lambda s, x: s + x)
    chance = 2.0 ** -BITS
    corrected = F.greatest(F.lit(0.0), (1 - differ / F.lit(float(BINS)) - chance) / (1 - chance))
    return (F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(corrected))


def _ranges(ids: DataFrame, column: str) -> Column:
    """Order-preserving range number of an id column (no nulls): quantile ranges,
    each cut into equal parts so that a part has about ``RANGE_ROWS`` rows."""
    cut = [i / RANGES for i in range(RANGES + 1)]
    got = ids.agg(F.percentile_approx(column, cut, 10_000).alias("q"), F.count(F.lit(1)).alias("n"), F.min(column).alias("lo"),
                  F.max(column).alias("hi")).first()
    if not got.n:
        return F.lit(0).cast("long")
    bounds = sorted({got.lo, *got.q, got.hi + 1 if got.hi < 2 ** 63 - 1 else got.hi})
    parts = -(-got.n // (RANGES * RANGE_ROWS))

    def tree(a, b):
        """Nested comparisons with the bounds between a and b."""
        if b - a <= 1:
            lo, width = bounds[a], max(1, bounds[min(b, len(bounds) - 1)] - bounds[a])
            if parts == 1:
                return f"{a}L"
            inside = f"least({parts - 1}L, greatest(0L, floor((cast(`{column}` as double) - {float(lo)}D) / {float(width)}D * {parts})))"
            return f"({a * parts}L + {inside})"
        c = (a + b) // 2
        return f"if(`{column}` < {bounds[c]}L, {tree(a, c)}, {tree(c, b)})"
    return F.expr(tree(0, len(bounds)))


def with_next(df: DataFrame, id_col: str, tie: str, carry: list[str], prepare=lambda rows: rows) -> DataFrame:
    """``prepare(df)`` (columns derived from each row) with ``next_<c>`` of every column in ``carry``: the value in the next row by
    ``(id_col, tie)``, for the last row that of the first.  ``id_col`` has no nulls."""
    number = _ranges(df.select(id_col), id_col)
    firsts = df.select(F.col(id_col).alias("first_id"), number.alias("range")).groupBy("range").agg(F.min("first_id").alias("first_id"))
    follows = Window.orderBy("range")                # at most one row for each range
    target = firsts.select("range", F.coalesce(F.lag("range").over(follows), F.max("range").over(follows.rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing))).alias("closes"), "first_id")
    first_rows = df.join(F.broadcast(target), F.col(id_col) == F.col("first_id"))   # RANGES times parts small rows
    one = Window.partitionBy("closes").orderBy(tie)
    closing = (first_rows.withColumn("rank", F.row_number().over(one)).filter("rank = 1")
               .select(*df.columns, F.col("closes").alias("range"), F.lit(1).alias("closing")))
    every = prepare(df.withColumn("range", number).withColumn("closing", F.lit(0))).unionByName(prepare(closing))
    order = Window.partitionBy("range").orderBy("closing", id_col, tie)
    return (every.withColumns({f"next_{c}": F.lead(c).over(order) for c in carry}).filter("closing = 0").drop("range", "closing"))


def compared(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text: ``doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next``."""
    doc = F.col(id_col).cast("long")
    rows = df.select(doc.alias("doc_id"), F.coalesce(doc, F.lit(-2 ** 63).cast("long")).alias("order_id"), text_or_empty(text_col).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    near = with_next(rows, "order_id", "tie", ["text", "fp"], lambda r: with_fingerprint(r, "text", "fp"))
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    made = near.select("doc_id", n.cast("long").alias("n_chars"), "fp", "next_fp", edited.alias("edited"))
    made = with_fingerprint(made, "edited", "edited_fp")
    return made.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_hex("fp").alias("fingerprint"),
                       as_hex("edited_fp").alias("edited_fingerprint"), likeness("fp", "edited_fp").alias("near_edited"),
                       likeness("fp", "next_fp").alias("near_next"))
