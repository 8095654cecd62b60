"""SimHash near-duplicates found by deletion-variant signatures (operator 10).

A 64-bit fingerprint has the majority bit of the XXH64 values (seed 42) of all
``shingle``-word shingles of a text.  Two fingerprints link when they differ in
at most ``distance`` bits.  With ``s`` segments and a distance below ``2 s`` one
segment differs by at most one bit; so ``distance // 2 + 1`` segments are enough
(three for four bits; exact matching would need five).  Every distinct
fingerprint is indexed under each segment with each one of its bits replaced by a
wildcard: 64 signatures.  Fingerprints that share a signature meet in one run of
equal keys, their full distance is verified, and the run gives a spanning forest
of its links (never all pairs).  Components of the forest edges are those of all
links.

Equal fingerprints are one vertex, so a group of copies, however large, is one
row here.  A run is read as a stream; it holds distinct fingerprints only.

Defined cases: null text is empty; texts with no word have fingerprint zero and
link like any other; fewer words than a shingle make one shingle; a null doc_id
counts as larger than any number and comes out null; repeated rows stay; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavecohort.llm import components
from wavecohort.llm.common import fresh, map_batches, staged, text_or_empty

SHINGLE, DISTANCE = 4, 4
NO_ID = 2 ** 63 - 1


def _fingerprint(text: str, k: int) -> int:
    """Signed 64-bit value of the fingerprint bits."""
    import numpy as np
    import xxhash
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    k = min(k, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n, digest, set_bits = len(words) - k + 1, xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for a in range(0, n, 50_000):
        b = min(n, a + 50_000)
        spans = zip(starts[a:b].tolist(), ends[a + k - 1:b + k - 1].tolist())
        h = np.fromiter([digest(joined[x:y], 42) for x, y in spans], np.uint64, b - a)
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > n, bitorder="little").view("<i8")[0])


def with_fingerprint(df: DataFrame, out: str = "fingerprint", text_col: str = "text", shingle: int = SHINGLE,
                     keep_text: bool = True) -> DataFrame:
    """``df`` with the signed 64-bit fingerprint in column ``out``."""
    text = fresh(df, "text_")
    rows = df.withColumn(text, text_or_empty(text_col))
    kept = [c for c in df.columns if keep_text or c != text_col]
    at = rows.columns.index(text)

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            # element by element: one text at a time becomes a Python string
            got = pa.array([_fingerprint(x.as_py(), shingle) for x in batch.column(at)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(i) for i, c in enumerate(batch.schema.names) if c in kept] + [got],
                                             names=[*kept, out])
    schema = df.select(*[F.col(f"`{c}`") for c in kept]).withColumn(out, F.lit(0).cast("long")).schema
    return map_batches(rows, run, schema)


def _signatures(fp: Column, distance: int) -> Column:
    """All one-wildcard variants of all segments, as longs that tell segment and wildcard."""
    n, keys = distance // 2 + 1, []
    cuts = [64 * i // n for i in range(n + 1)]
    for lo, hi in zip(cuts, cuts[1:]):
        width = hi - lo
        segment = F.shiftrightunsigned(fp, lo)
        for p in range(width):
            mask = ((1 << width) - 1) & ~(1 << p)
            keys.append(segment.bitwiseAND(F.lit(mask).cast("long")) + F.lit((lo + p) << (64 // n + 1)).cast("long"))
    return F.array(*keys)


def _forest(values, distance: int):
    """Star edges (member, least member) of the link components of distinct values."""
    import numpy as np
    rest, edges = np.sort(values), []
    while len(rest) > 1:
        root, rest, queue = rest[0], rest[1:], [rest[0]]
        while queue and len(rest):
            near = np.bitwise_count(rest ^ queue.pop()) <= distance
            if near.any():
                found = rest[near]
                queue.extend(found)
                edges.append(np.stack([found, np.full(len(found), root)]))
                rest = rest[~near]
    return edges


def _run_links(distance: int):
    """Worker function over rows sorted by key: links of every run of equal keys."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        left_k, left_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def links(k, f):
            out = []
            first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
            size = np.diff(np.append(first, len(k)))
            of = np.repeat(size, size)
            for step in range(1, 8):                 # short runs: compare at each offset at once
                i = np.flatnonzero((k[:-step] == k[step:]) & (of[:-step] <= 8)) if len(k) > step else []
                if len(i):
                    i = i[np.bitwise_count(f[i] ^ f[i + step]) <= distance]
                    out.append(np.stack([f[i], f[i + step]]))
            for a, n in zip(first[size > 8], size[size > 8]):
                out += _forest(f[a:a + n], distance)
            if not out:
                return None
            u, v = np.concatenate(out, axis=1).astype(np.uint64).view(np.int64)
            pairs = np.unique(np.stack([np.maximum(u, v), np.minimum(u, v)], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

        waiting = []                                 # batches since the last change of key
        for batch in batches:
            k = batch.column(0).to_numpy(zero_copy_only=False)
            f = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(k):
                continue
            waiting.append((k, f))
            if k[0] == k[-1] and (len(waiting) == 1 or waiting[0][0][0] == k[0]):
                continue                             # still within one run
            k = np.concatenate([left_k, *[x for x, _ in waiting]])
            f = np.concatenate([left_f, *[x for _, x in waiting]])
            waiting = []
            end = int(np.searchsorted(k, k[-1]))     # the last run may go on
            left_k, left_f = k[end:], f[end:]
            got = links(k[:end], f[:end])
            if got is not None:
                yield got
        k = np.concatenate([left_k, *[x for x, _ in waiting]])
        f = np.concatenate([left_f, *[x for _, x in waiting]])
        got = links(k, f)
        if got is not None:
            yield got
    return run


def link_edges(fps: DataFrame, fp: str = "fingerprint", distance: int = DISTANCE) -> DataFrame:
    """Forest edges ``(u, v)`` over the distinct fingerprints of ``fps``."""
    if not 2 <= distance <= 20:
        raise ValueError("distance must be between 2 and 20")
    sig = fps.select(F.explode(_signatures(F.col(fp), distance)).alias("key"), F.col(fp).alias("f"))
    sorted_runs = sig.repartition("key").sortWithinPartitions("key")
    return sorted_runs.mapInArrow(_run_links(distance), "u long, v long").distinct()


def classes(fps: DataFrame, order: list[str], fp: str = "fingerprint", distance: int = DISTANCE) -> DataFrame:
    """One row per distinct fingerprint: ``fp``, ``first`` (its least row by the
    long columns ``order``, a struct) and ``least`` (that of its whole component).
    ``fps`` should be a written table: it is read more than once."""
    one = staged(fps.groupBy(fp).agg(F.min(F.struct(*order)).alias("first")), "simhash-classes")
    edges = link_edges(one, fp, distance)
    vertex = F.struct(F.col("first"), F.col(fp))
    ends = one.select(F.col(fp).alias("end"), vertex.alias("vertex"))
    named = (edges.join(ends, F.col("u") == F.col("end")).select(F.col("vertex").alias("u"), "v")
             .join(ends, F.col("v") == F.col("end")).select("u", F.col("vertex").alias("v")))
    star = components.stars(named, "simhash-star").select(F.col(f"u.{fp}").alias(fp), F.col("v.first").alias("root"))
    joined = one.join(star, fp, "left").select(fp, "first", F.coalesce("root", "first").alias("least"))
    return staged(joined, "simhash-labels")


def components_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                  distance: int = DISTANCE) -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits), ``component_id``: one row per row of ``df``."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    fps = staged(with_fingerprint(rows, shingle=shingle, keep_text=False), "simhash-fps")
    fps = fps.withColumn("order_id", F.coalesce("doc_id", F.lit(NO_ID)))
    label = classes(fps, ["order_id"], distance=distance)
    least = F.col("least.order_id")
    return (fps.join(label, "fingerprint")
            .select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
                    F.when(least < NO_ID, least).alias("component_id")))


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
          distance: int = DISTANCE) -> DataFrame:
    """Rows of ``df`` (same columns), one of each component: the least id (of
    repeated rows the first read)."""
    fp, uid = fresh(df, "fingerprint_"), fresh(df, "row_")
    rows = staged(with_fingerprint(df, fp, text_col, shingle).withColumn(uid, F.monotonically_increasing_id()), "simhash-docs")
    fps = rows.select(F.col(fp).alias("fingerprint"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("order_id"),
                      F.col(uid).alias("row_id"))
    label = classes(fps, ["order_id", "row_id"], distance=distance)
    keep = label.filter("first = least").select(F.col("first.row_id").alias(uid))
    return rows.join(keep, uid, "left_semi").select(*[F.col(f"`{c}`") for c in df.columns])
