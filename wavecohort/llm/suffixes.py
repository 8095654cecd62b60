"""Removal of repeated passages by column-wise suffix sorting of a collection (operator 13).

Every byte is removed that a string of ``WINDOW`` bytes covers which also starts anywhere
else, in the same text or another.  Strings that long only need to meet their equals, so the
corpus is cut into many small collections that are built side by side:

1. Each ``WINDOW``-byte window has an *anchor*: the ``GRAM``-byte string in it with the least
   hash (the leftmost one).  Equal windows have equal anchors at equal distances.  A run of
   windows with one anchor occurrence is a *string* of at most ``2 * WINDOW - GRAM`` bytes.
   Strings whose anchor occurs once in the corpus hold no repeat and go no further; equal
   strings are counted and built once.
2. The strings of a bucket of anchors are one collection.  It is built column by column from
   the right end, one symbol of every string each round, columns counted from the anchor: the
   symbols before the sorted suffixes are the next column of the Burrows-Wheeler transform, a stable
   sort by symbol within an anchor's strings is its last-to-first step, and the common prefix of
   two neighbours is one more than the least one between them a column before.  Windows in
   different columns can't be equal, so a round holds one suffix of every string.
   A window is repeated when its common prefix with a neighbour reaches ``WINDOW``
   or its string occurs twice.
3. Repeated windows go back to all occurrences of their string and cover bytes there.

The sequential files between the steps (compressed texts, occurrences, strings, covers)
are Parquet in the shared folder; a collection is bounded by its bucket.  An anchor with too
many different strings (a passage that many texts share, with other words around it) is cut
again: its windows go by strips of ``STRIPS[0]`` columns and the bytes that all
windows of a strip share, and at the last single windows, of which equal ones are one string.

Strings are told apart by 64 bits of hash beside the 64 of their anchor.

Defined cases: null text is empty; repeated rows are copies of each other; texts shorter than
``WINDOW`` stay whole; texts of any length are read in pieces of ``PIECE`` bytes that overlap by
a window; null ids stay null; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavecohort.llm.common import map_batches, staged

WINDOW, GRAM, PIECE = 200, 40, 1 << 19
#: Bytes of strings in a collection, about, and of different strings with one anchor.
BUCKET_BYTES, HOT_BYTES = 8 << 20, 8 << 20
#: Columns that a strip of a hot anchor's windows has, cut by cut.
STRIPS = (16, 1)
_BASE = 0x9E3779B97F4A7C15
_STRING = "anchor long, shash long, left int, n long, s binary"


def _hashes(data, gram: int):
    """A well-mixed hash of the ``gram`` bytes from each position."""
    import numpy as np
    n = len(data)
    power, back = (np.cumprod(np.append(np.uint64(1), np.full(n, np.uint64(b)))) for b in (_BASE, pow(_BASE, -1, 2 ** 64)))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    h = (sums[gram:] - sums[:n - gram + 1]) * back[:n - gram + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _least(x, width: int):
    """Least of each ``width`` neighbours."""
    import numpy as np
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:len(x) - (width - have)], x[width - have:]) if width > have else x


def runs(pieces: list[bytes], window: int = WINDOW, gram: int = GRAM):
    """Runs of windows with one anchor: ``piece, start, windows, left, anchor`` arrays; ``left`` is the
    anchor's distance from the start, ``anchor`` the hash of its bytes."""
    import numpy as np
    data = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.array([len(p) for p in pieces], np.int64)
    if len(data) < window:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    starts = np.cumsum(sizes) - sizes
    h = _hashes(data, gram)
    low = np.uint64((1 << 24) - 1)                           # the place breaks ties: the leftmost is least
    at = (_least((h & ~low) | np.arange(len(h), dtype=np.uint64), window - gram + 1) & low).astype(np.int64)
    piece = np.repeat(np.arange(len(pieces)), sizes)[:len(at)]
    last = (starts + sizes)[piece] - window                  # last window of the piece
    new = np.flatnonzero(np.insert((at[1:] != at[:-1]) | (piece[1:] != piece[:-1]), 0, True))
    ends = np.append(new[1:], len(at))
    some = new <= last[new]
    new, ends = new[some], np.minimum(ends[some], last[new[some]] + 1)
    return piece[new], new - starts[piece[new]], ends - new, at[new] - new, h[at[new]].astype(np.int64)


def _pieces(batches):
    """Batches (rid, size, z) -> groups of up to ``PIECE`` bytes of (rid, offset, bytes)."""
    import pyarrow as pa
    group, size = [], 0
    for batch in batches:
        for rid, n, z in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            text = pa.decompress(z.as_buffer(), n, "zstd", asbytes=True)
            for a in range(0, n - WINDOW + 1, PIECE):
                part = text[a:a + PIECE + WINDOW - 1]
                if size and size + len(part) > PIECE:
                    yield group
                    group, size = [], 0
                group.append((rid, a, part))
                size += len(part)
    if group:
        yield group


def _anchors(batches):
    import pyarrow as pa
    for group in _pieces(batches):
        yield pa.RecordBatch.from_arrays([pa.array(runs([p for _, _, p in group])[4])], names=["anchor"])


def _occurrences(batches):
    import numpy as np
    import pyarrow as pa
    import xxhash
    for group in _pieces(batches):
        piece, start, windows, left, anchor = runs([p for _, _, p in group])
        views = [memoryview(p) for _, _, p in group]
        shash = np.array([xxhash.xxh3_64_intdigest(views[p][a:a + w + WINDOW - 1]) for p, a, w in zip(piece.tolist(), start.tolist(), windows.tolist())], np.uint64)
        rid, offset = np.array([g[0] for g in group], np.int64), np.array([g[1] for g in group], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(shash.astype(np.int64)), pa.array(rid[piece]), pa.array(offset[piece] + start),
                                          pa.array(windows.astype(np.int32)), pa.array(left.astype(np.int32))],
                                         names=["anchor", "shash", "rid", "at", "windows", "left"])


def _strings(batches):
    """Batches (size, z, wanted) -> the wanted strings with their bytes."""
    import pyarrow as pa
    for batch in batches:
        of = batch.column(2).flatten()
        anchor, shash, n, at, windows, left = (of.field(i) for i in range(6))
        sizes, k, cut, held, a = batch.column(2).value_lengths().to_pylist(), 0, [], 0, 0

        def rows(b):
            return pa.RecordBatch.from_arrays([anchor[a:b], shash[a:b], left[a:b], n[a:b], pa.array(cut, pa.binary())], names=["anchor", "shash", "left", "n", "s"])
        places, widths = at.to_pylist(), windows.to_pylist()
        for size, z, many in zip(batch.column(0).to_pylist(), batch.column(1), sizes):
            text = pa.decompress(z.as_buffer(), size, "zstd", asbytes=True)
            for place, width in zip(places[k:k + many], widths[k:k + many]):
                cut.append(text[place:place + width + WINDOW - 1])
                held += len(cut[-1])
            k += many
            if held > PIECE:
                yield rows(k)
                cut, held, a = [], 0, k
        if k > a:
            yield rows(k)


def repeated_windows(group, left, n, strings: list[bytes], window: int = WINDOW):
    """Which windows of the strings of a collection are repeated: one boolean array for all windows of all
    strings, and where each string's windows begin in it.

    ``group``: anchor number of each string, ``left``: its anchor's place, ``n``: how often it occurs.
    """
    import numpy as np
    data, size = np.frombuffer(b"".join(strings), np.uint8), np.array([len(s) for s in strings], np.int64)
    base = np.cumsum(size) - size + left                     # place of the anchor in the data
    right = size - left                                      # columns from the anchor on
    begins = np.cumsum(size - window + 1) - (size - window + 1)
    out = np.zeros(int((size - window + 1).sum()), bool)
    entering = np.lexsort((group, right))                    # by right end, then group
    edges = np.searchsorted(right[entering], np.arange(right.max(initial=0) + 2))
    order, common = np.zeros(0, np.int64), np.zeros(0, np.uint16)
    for t in range(int(right.max(initial=0)) - 1, -int(left.max(initial=0)) - 1, -1):
        gone = left[order] < -t
        if gone.any():                                       # the least prefix over rows that leave stays with the next
            stay = np.flatnonzero(~gone)
            order, common = order[stay], np.minimum.reduceat(common[:stay[-1] + 1], np.append(0, stay[:-1] + 1)) if len(stay) else common[:0]
        if t >= 0 and edges[t + 1] < edges[t + 2]:           # strings whose last symbol this is: least in their group
            new = entering[edges[t + 1]:edges[t + 2]]
            order, common = np.concatenate([new, order]), np.concatenate([np.zeros(len(new), np.uint16), common])
            by = np.argsort(group[order], kind="stable")
            order, common = order[by], common[by]
        if not len(order):
            continue
        # next column of the transform; stable sort by symbol within a group is the last-to-first step
        key = group[order] * 256 + data[base[order] + t]
        by = np.argsort(key, kind="stable")
        between = np.minimum.reduceat(np.append(common, np.uint16(0)), by + 1)      # least prefix from a row to the next with its symbol
        key, order = key[by], order[by]
        common = np.zeros(len(by), np.uint16)
        same = key[1:] == key[:-1]
        common[1:][same] = np.minimum(between[:-1][same], window - 1) + 1
        full = np.flatnonzero(right[order] - t >= window)
        if len(full):
            near = np.append(common, np.uint16(0))
            own = order[full]
            out[begins[own] + t + left[own]] = (near[full] >= window) | (near[full + 1] >= window) | (n[own] >= 2)
    return out, begins


def _collection(table):
    """Worker function of a bucket: its strings -> ``anchor, shash, runs`` (first and last repeated window)."""
    import numpy as np
    import pyarrow as pa
    anchor = table.column("anchor").to_numpy()
    _, group = np.unique(anchor, return_inverse=True)
    strings = table.column("s").to_pylist()
    left, n = table.column("left").to_numpy().astype(np.int64), table.column("n").to_numpy()
    hit, begins = repeated_windows(group.astype(np.int64), left, n, strings)
    ends = np.append(begins[1:], len(hit))
    flank = np.zeros(len(hit) + 1, bool)
    flank[begins] = flank[-1] = True                         # runs don't cross strings
    inside = np.append(hit, False)
    first = np.flatnonzero(hit & (flank[:-1] | ~np.insert(hit[:-1], 0, False)))
    last = np.flatnonzero(hit & (flank[1:] | ~inside[1:]))
    owner = np.searchsorted(ends, first, side="right")
    counts = np.bincount(owner, minlength=len(strings))
    spans = pa.StructArray.from_arrays([pa.array((first - begins[owner]).astype(np.int32)), pa.array((last - begins[owner]).astype(np.int32))], ["a", "b"])
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), spans)
    keep = pa.array(counts > 0)
    return pa.table([table.column("anchor").combine_chunks().filter(keep), table.column("shash").combine_chunks().filter(keep), lists.filter(keep)],
                    names=["anchor", "shash", "runs"])


def _strips(width: int):
    """Worker function: strings of hot anchors -> strips of at most ``width`` windows in fixed columns, named by
    the bytes that all windows of the strip share."""
    def run(batches):
        import pyarrow as pa
        import xxhash
        signed = lambda h: h - (h >> 63 << 64)
        for batch in batches:
            rows = []
            for anchor, shash, left, n, s in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                end = len(s) - WINDOW - left                 # last window's column; the first is -left
                for t0 in range(-left // width * width, end + 1, width):
                    a, b = max(t0, -left), min(t0 + width - 1, end)
                    part = s[a + left:b + left + WINDOW]
                    shared = s[t0 + width - 1 + left:t0 + WINDOW + left]
                    name = xxhash.xxh3_64_intdigest(b"%d %d " % (anchor, t0) + shared)
                    rows.append((signed(name), signed(xxhash.xxh3_64_intdigest(part)), t0 + width - 1 - a, n, part, anchor, shash, a + left))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32()))],
                                             names=["anchor", "shash", "left", "n", "s", "of", "of_hash", "shift"])
    return run


def repeats(strings: DataFrame, depth: int = 0, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """``anchor, shash, runs`` of the strings (written: each once) that have repeated windows."""
    spark, keys = strings.sparkSession, ["anchor", "shash"]
    sizes = strings.groupBy("anchor").agg(F.sum(F.octet_length("s")).alias("bytes"))
    hot = staged(sizes.filter(F.col("bytes") > hot_bytes).select("anchor"), "suffix-hot") if depth < len(STRIPS) else None
    cold = strings
    if hot is not None and hot.limit(1).count():
        cut = staged(map_batches(strings.join(hot, "anchor", "left_semi").select(*keys, "left", "n", "s"), _strips(STRIPS[depth]),
                                 _STRING + ", of long, of_hash long, shift int"), "suffix-strips")
        # equal strips are one string; its bytes are taken from any of them
        once = staged(cut.groupBy(*keys).agg(F.first("left").alias("left"), F.sum("n").alias("n"), F.first("s").alias("s")), "suffix-strings")
        found = cut.select(*keys, "of", "of_hash", "shift").join(repeats(once, depth + 1, hot_bytes), keys)
        moved = F.transform("runs", lambda r: F.struct((r["a"] + F.col("shift")).alias("a"), (r["b"] + F.col("shift")).alias("b")))
        found = found.groupBy(F.col("of").alias("anchor"), F.col("of_hash").alias("shash")).agg(F.flatten(F.collect_list(moved)).alias("runs"))
        cold = strings.join(hot, "anchor", "left_anti")
    total = strings.agg(F.sum(F.octet_length("s"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))
    out = (cold.withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets))).groupBy("bucket")
           .applyInArrow(_collection, "anchor long, shash long, runs array<struct<a:int,b:int>>"))
    return out if cold is strings else out.union(found.select(*out.columns))


def _left_over(keep_text: bool):
    """Worker function: rows (id, n_bytes, z, cover) -> what is left of each text."""
    def run(batches):
        import hashlib

        import pyarrow as pa
        for batch in batches:
            removed, spans, digests, texts = [], [], [], []
            for n, z, cover in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
                text, ends = pa.decompress(z.as_buffer(), n, "zstd", asbytes=True) if n else b"", []
                for a, b in sorted((c["a"], c["b"]) for c in cover or []):
                    if ends and a <= ends[-1][1]:
                        ends[-1][1] = max(ends[-1][1], b)
                    else:
                        ends.append([a, b])
                if ends:
                    text = b"".join(text[a:b] for a, b in zip([0] + [e[1] for e in ends], [e[0] for e in ends] + [n]))
                removed.append(n - len(text))
                spans.append(len(ends))
                digests.append(hashlib.sha256(text).hexdigest())
                if keep_text:
                    texts.append(text)
            columns = [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(texts, pa.binary())] * keep_text,
                                             names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_text)
    return run


def _compressed(batches):
    import pyarrow as pa
    for batch in batches:
        texts = [t or b"" for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()),
                                          pa.array([pa.compress(t, "zstd", asbytes=True) if t else b"" for t in texts], pa.binary())], names=["id", "n_bytes", "z"])


def cleaned(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_bytes: int = HOT_BYTES, keep_text: bool = True) -> DataFrame:
    """``id, n_bytes, n_removed, n_spans, kept_sha256, kept`` (the remaining bytes) of every row."""
    kind = df.schema[id_col].dataType.simpleString()
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    homes = map_batches(texts, _compressed, f"id {kind}, n_bytes long, z binary").withColumn("rid", F.monotonically_increasing_id())
    homes = staged(homes, "suffix-texts", compression="none")
    source = homes.filter(F.col("n_bytes") >= WINDOW).select("rid", "n_bytes", "z")
    # written, so that both sides of the next join are plain shuffles and a hot anchor's partition is split
    common = staged(map_batches(source, _anchors, "anchor long").groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("anchor"), "suffix-anchors")
    live = staged(map_batches(source, _occurrences, "anchor long, shash long, rid long, at long, windows int, left int").join(common, "anchor", "left_semi"), "suffix-live")
    # any occurrence of equal strings will do
    once = live.groupBy("anchor", "shash").agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("rid", "at", "windows", "left")])
    wanted = (once.groupBy("rid")
              .agg(F.collect_list(F.struct("anchor", "shash", "n", "at", "windows", "left")).alias("wanted")))    # strings of one text
    strings = staged(map_batches(homes.select("rid", "n_bytes", "z").join(wanted, "rid").select("n_bytes", "z", "wanted"), _strings, _STRING), "suffix-strings", "zstd")
    found = staged(repeats(strings, 0, hot_bytes), "suffix-found")
    hits = live.join(found, ["anchor", "shash"]).select("rid", "at", F.explode("runs").alias("r"))
    cover = hits.groupBy("rid").agg(F.collect_list(F.struct((F.col("at") + F.col("r.a")).alias("a"), (F.col("at") + F.col("r.b") + WINDOW).alias("b"))).alias("cover"))
    rows = homes.join(cover, "rid", "left").select("id", "n_bytes", "z", "cover")
    schema = f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    return map_batches(rows, _left_over(keep_text), schema).withColumnRenamed("id", id_col)
