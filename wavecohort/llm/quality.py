"""Quality rules with adaptive thresholds (operator 8).

Every text gets counts (words, code points in words, symbols, repeated lines,
8-word windows and neighbouring words, capitals) and ratios of them.  Per language and source the
distribution of each ratio is kept as a mergeable quantile sketch: counts of
logarithmic bins, whose quantiles have a relative error of at most ``ACCURACY``.
Sketches merge by adding counts, so they are built before the shuffle, are the
same for every partitioning and merge upward: a source with fewer than
``MIN_GROUP`` texts takes the sketch of its language, a small language that of
all texts.  A ratio is out of bounds beyond Tukey's outer fence, ``q75 + FENCE *
spread`` (mean word length also below ``q25 - FENCE * spread``), where the spread
is the interquartile range, at least the ratio's ``least spread``.  Bounds are
joined to the texts; the join is salted, as one source may hold most rows, and
Spark broadcasts the bounds only where their written size allows it.

Base rules are fixed: fewer than 20 words, or more than 30 % of the words in
repeated windows.

Defined cases: null text counts as empty (no words: base failure); null language
or source is a group of its own; repeated rows count as often as they occur; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from operator import eq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavecohort.llm.common import fresh, map_batches, staged, text_or_empty

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
ACCURACY, SMALLEST = 0.01, 1e-4
FENCE, MIN_GROUP, SALTS = 3.0, 100, 16
#: Ratio -> least spread: below it differences are not taken for signs of quality.
RATIOS = {"symbols_per_word": 0.05, "duplicate_lines": 0.15, "repeated_words": 0.1, "stutter": 0.1,
          "word_length": 1.0, "capitals": 0.1}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_stutter")
_SPACE, _SYMBOLS = b" \t\n\r\x0b\x0c", b"#*$%&|<>"
_CAPITALS = bytes(range(65, 91))


def _repeated(words: list[bytes]) -> int:
    """Words in windows of ``WINDOW`` words that occur at least twice."""
    import numpy as np
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    w = np.zeros(n, np.uint64)
    for j in range(WINDOW):                          # rolling polynomial, odd base, modulo 2^64
        w = w * np.uint64(0x9E3779B97F4A7C15) + (h[j:j + n] ^ (h[j:j + n] >> np.uint64(29)))
    s = np.sort(w)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0
    cover = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(np.isin(w, twice))
    np.add.at(cover, at, 1)
    np.add.at(cover, at + WINDOW, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def _counts(text: str) -> tuple:
    b = text.encode("utf-8", "replace")
    words = b.split()
    lines = [x for x in b.split(b"\n") if x.strip()]
    return (len(words), len(text) - (len(b) - len(b.translate(None, _SPACE))), len(b) - len(b.translate(None, _SYMBOLS)),
            len(lines) - len(set(lines)), _repeated(words), len(lines), len(b) - len(b.translate(None, _CAPITALS)),
            sum(map(eq, words, words[1:])))


def with_counts(df: DataFrame, text_col: str = "text", prefix: str = "", keep_text: bool = True) -> DataFrame:
    """``df`` with the columns of ``COUNTS`` (names prefixed with ``prefix``)."""
    text = fresh(df, "text_")
    rows = df.withColumn(text, text_or_empty(text_col))
    kept = [c for c in df.columns if keep_text or c != text_col]
    names, at = [prefix + c for c in COUNTS], len(df.columns)

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            got = [_counts(x.as_py()) for x in batch.column(at)]
            cols = [pa.array(c, pa.int64()) for c in zip(*got)] if got else [pa.array([], pa.int64())] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(i) for i, c in enumerate(batch.schema.names) if c in kept] + cols,
                                             names=kept + names)
    schema = df.select(*[F.col(f"`{c}`") for c in kept]).withColumns({c: F.lit(0).cast("long") for c in names}).schema
    return map_batches(rows, run, schema)


def _ratios(prefix: str) -> dict:
    c = {x: F.col(prefix + x) for x in COUNTS}
    words = F.greatest(c["n_words"], F.lit(1))
    return {"symbols_per_word": c["n_symbols"] / words, "duplicate_lines": c["n_dup_lines"] / F.greatest(c["n_lines"], F.lit(1)),
            "repeated_words": c["n_repeat_words"] / words, "stutter": c["n_stutter"] / words, "word_length": c["word_chars"] / words,
            "capitals": c["n_capitals"] / F.greatest(c["word_chars"], F.lit(1))}


def _base_failed(prefix: str):
    n = F.col(prefix + "n_words")
    return (n < MIN_WORDS) | (100 * F.col(prefix + "n_repeat_words") > MAX_REPEAT_PERCENT * n)


def bounds(counted: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source``, then ``<ratio>_hi`` of every ratio and ``word_length_lo``: the
    bounds of every (language, source) of a table with the columns of ``COUNTS``."""
    gamma = math.log((1 + ACCURACY) / (1 - ACCURACY))
    ratio, value = F.explode(F.create_map(*[x for k, v in _ratios("").items() for x in (F.lit(k), v)])).alias("ratio", "x"), F.col("x")
    b = F.when(value <= SMALLEST, F.lit(None)).otherwise(F.ceil(F.log(value / SMALLEST) / gamma)).cast("int")
    fine = (counted.select(F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), ratio)
            .groupBy("lang", "source", "ratio", b.alias("bin")).agg(F.count(F.lit(1)).alias("n")))
    fine = staged(fine, "quality-sketch")

    def level(keys):
        """Quartiles of the sketches merged to ``keys``."""
        merged = fine.groupBy(*keys, "ratio", "bin").agg(F.sum("n").alias("n"))
        group = Window.partitionBy(*keys, "ratio")
        run = merged.withColumn("upto", F.sum("n").over(group.orderBy(F.col("bin").asc_nulls_first()))).withColumn("total", F.sum("n").over(group))
        center = F.when(F.col("bin").isNull(), 0.0).otherwise(SMALLEST * F.exp(F.col("bin") * gamma) * (1 - ACCURACY))
        quartile = [F.min(F.when(F.col("upto") >= q * F.col("total"), center)).alias(f"q{int(100 * q)}") for q in (0.25, 0.75)]
        return run.groupBy(*keys, "ratio").agg(F.max("total").alias("total"), *quartile)

    def tagged(df, k):
        return df.select(*[c for c in df.columns if c not in ("total", "q25", "q75")], *[F.col(c).alias(c + k) for c in ("total", "q25", "q75")])

    by_source, by_lang, of_all = tagged(level(["lang", "source"]), "_s"), tagged(level(["lang"]), "_l"), tagged(level([]), "_a")
    s, la = by_source.alias("s"), by_lang.alias("l")
    joined = (s.join(la, F.col("s.lang").eqNullSafe(F.col("l.lang")) & (F.col("s.ratio") == F.col("l.ratio")))
              .drop(F.col("l.lang")).drop(F.col("l.ratio")).join(of_all, "ratio"))

    def pick(q):
        return (F.when(F.col("total_s") >= MIN_GROUP, F.col(q + "_s")).when(F.col("total_l") >= MIN_GROUP, F.col(q + "_l")).otherwise(F.col(q + "_a")))
    least = F.element_at(F.create_map(*[x for k, v in RATIOS.items() for x in (F.lit(k), F.lit(v))]), F.col("ratio"))
    spread = F.greatest(pick("q75") - pick("q25"), least)
    out = joined.select("lang", "source", "ratio", (pick("q75") + FENCE * spread).alias("hi"), (pick("q25") - FENCE * spread).alias("lo"))
    high = [F.max(F.when(F.col("ratio") == k, F.col("hi"))).alias(f"{k}_hi") for k in RATIOS]
    return out.groupBy("lang", "source").agg(*high, F.max(F.when(F.col("ratio") == "word_length", F.col("lo"))).alias("word_length_lo"))


def judged(counted: DataFrame, limits: DataFrame, out: str = "kept", prefix: str = "", lang_col: str = "lang", source_col: str = "source",
           salt_col: str = "doc_id") -> DataFrame:
    """``counted`` with ``out``: whether the text passes the base rules and the bounds."""
    have, tmp = counted, "limit_"
    while any(c.lower().startswith(tmp) for c in have.columns):
        tmp = "_" + tmp
    salt = tmp + "salt"
    lim = staged(limits, "quality-bounds").select(*[F.col(c).alias(tmp + c) for c in limits.columns])
    lim = lim.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = have.withColumn(tmp + "of", F.pmod(F.xxhash64(salt_col), F.lit(SALTS)).cast("int"))
    on = (F.col(lang_col).eqNullSafe(F.col(tmp + "lang")) & F.col(source_col).eqNullSafe(F.col(tmp + "source")) & (F.col(tmp + "of") == F.col(salt)))
    ratios = _ratios(prefix)
    ok = ~_base_failed(prefix) & (ratios["word_length"] >= F.col(tmp + "word_length_lo"))
    for k in RATIOS:
        ok = ok & (ratios[k] <= F.col(f"{tmp}{k}_hi"))
    return rows.join(lim, on).withColumn(out, ok).select(*have.columns, out)


def report(df: DataFrame) -> DataFrame:
    """Per row of a table with ``doc_id, text, lang, source``: counts, ``base_failed``, ``kept``."""
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source")
    counted = staged(with_counts(rows, keep_text=False), "quality-counts")
    return (judged(counted, bounds(counted)).withColumn("base_failed", _base_failed(""))
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"))


def filtered(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Rows of ``df`` (same columns) that pass.  Counts are made twice, so that no
    text is shuffled or written."""
    counted = with_counts(df.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source")), keep_text=False)
    limits = bounds(counted)
    prefix, out = "count_", fresh(df, "kept_")
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix = "_" + prefix
    rows = with_counts(df, text_col, prefix)
    return (judged(rows, limits, out, prefix, lang_col, source_col, prefix + "word_chars").filter(F.col(out))
            .select(*[F.col(f"`{c}`") for c in df.columns]))
