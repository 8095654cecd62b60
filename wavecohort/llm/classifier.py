"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model (operator 2).

The model has character n-grams of order 6 (spaces and digits each one symbol, every other
code point its own, 21 bits each, nothing hashed) of all trusted texts: labelled good, outside
the held-out fifth (crc32(id as text) a multiple of 5).  They reach over a word's edge, and their
number grows with the corpus.  Nothing of it is capped.

1. Every scan split (a *block*) gives its distinct n-grams with their trusted counts, dealt to
   shards by the three symbols before the last: sorted and compressed, two or three bytes each.
2. A shard holds all n-grams with its contexts, so the counts of orders 6, 5 and 4 (distinct left
   neighbours below 6), their context sums and counts of counts are made in it.  What it knows
   of order 3 is summed over the shards; orders 3 to 1 are small tables, joined up from the
   lowest: counts, context sums and the next lower order, each join hashed by its own key.
3. The shards meet the order-3 probabilities of their n-grams and send every block the
   log-probabilities of its own, where they meet its (compressed) texts; a text's perplexity is that of
   its characters and its end.  Neither model nor corpus is broadcast.

A text is rejected when its log-perplexity, pulled towards the language's middle as by
``PRIOR`` more characters (short texts vary), lies above the ``HIGH`` quantile of the
held-out trusted texts of its language, taken of the same pulled figure, or below the
``LOW`` quantile of all its trusted texts.  With fewer than ``MIN_HELD_OUT`` held-out
trusted texts in a language its limits reach at least as far from its own middle as those
of all languages do from theirs.  A language with fewer than ``MIN_TRAINED`` trained or
``MIN_OWN`` held-out trusted texts is not known to the model: its texts are kept (null limits).

Defined cases: null text is empty (its end is scored); null language is a language of
its own; several labels of one id: the least counts; null ids and labels are not trusted;
repeated rows count as often as they occur; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavecohort.llm.common import fresh, lean, map_batches, staged, text_or_empty

ORDER, SYMBOL_BITS, SYMBOLS = 6, 21, 0x110000
#: Orders up to this one are joined as tables; n-grams are dealt to shards by as many symbols before the last.
SMALL_ORDER = 3
LOW, HIGH, PRIOR, MIN_HELD_OUT = 0.001, 0.99, 200, 50

#: Decimals of the log-perplexities that limits and verdicts are taken from.
GRID_DIGITS = 4
#: Languages with fewer trained or held-out trusted texts are not judged.
MIN_TRAINED, MIN_OWN = 30, 3
#: Text of one block, about: larger scan splits are dealt to several blocks.
BLOCK_BYTES = 64 * 2 ** 20
#: Shards of the n-grams of few blocks, and for so many blocks one more: a task holds some ten million
#: n-grams.  Larger blocks give fewer of them (at 100 TB: half a gigabyte of text a block).
SHARDS, BLOCKS_A_SHARD = 16, 8
#: So many trusted ids (16 bytes each, counted first) go to the scan tasks; more are joined by a shuffle
#: of the texts, with the same result.
TRUSTED_SENT = 1_000_000
#: Symbols that a task turns into n-grams at a time.
_CHUNK = 2 ** 20
_END = 1


def _ngrams(texts: list[str]):
    """All n-grams of the texts (with start padding and end) as two numbers, ``m`` (the three symbols
    before the last) and ``r`` (the others), and how many each text has."""
    import numpy as np
    parts, sizes = [], np.zeros(len(texts), np.int64)
    start, end = np.zeros(ORDER - 1, np.int64), np.array([_END])
    for i, t in enumerate(texts):
        s = np.frombuffer(t.encode("utf-32-le", "replace"), "<u4").astype(np.int64)
        s[s < 33] = 32
        s[(s >= 48) & (s < 58)] = 48
        parts += [start, s, end]
        sizes[i] = len(s) + 1
    x = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    n = max(0, len(x) - ORDER + 1)
    whole = x[ORDER - 1:] != 0

    def packed(a, b, c):
        return ((x[a:a + n] << 2 * SYMBOL_BITS) | (x[b:b + n] << SYMBOL_BITS) | x[c:c + n])[whole]
    return packed(2, 3, 4), packed(0, 1, 5), sizes


def _texts_by(texts: list[str]):
    """Ranges of ``texts`` of about ``_CHUNK`` symbols."""
    a, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t) + ORDER
        if held > _CHUNK:
            yield a, i + 1
            a, held = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


def _mixed(m, r):
    """A number of every n-gram, to look up by; equality is always that of the n-gram."""
    import numpy as np
    h = np.zeros(len(m), np.uint64)
    for g in (m, r):
        h = (h ^ g.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h * np.uint64(0xD6E8FEB86659FD93)


def _merged(m, r, counts):
    """Equal n-grams summed, in the order of their mixed numbers (two rows may stay where others have the same one)."""
    import numpy as np
    by = np.argsort(_mixed(m, r))
    m, r = m[by], r[by]
    first = np.flatnonzero(np.append(True, (m[1:] != m[:-1]) | (r[1:] != r[:-1]))) if len(by) else by
    return m[first], r[first], np.add.reduceat(counts[by], first) if len(first) else counts[:0]


def _small(raw: bytes) -> bytes:
    import pyarrow as pa
    return pa.Codec("zstd", compression_level=7).compress(raw, asbytes=True)


def _pressed(*arrays) -> bytes:
    """Arrays of whole numbers as differences, byte by byte of their places, compressed."""
    import numpy as np
    planes = [np.diff(np.append(0, a)).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes() for a in arrays]
    return _small(b"".join(planes))


def _unpressed(z, n: int, k: int) -> list:
    """The ``k`` arrays of ``n`` numbers that were compressed."""
    import numpy as np
    import pyarrow as pa
    raw = np.frombuffer(pa.decompress(z, 8 * n * k, "zstd", asbytes=True), np.uint8).reshape(k, 8, n)
    return [np.cumsum(np.ascontiguousarray(p.T).view("<i8").ravel()) for p in raw]


def _block_counts(shards: int):
    """Worker function: rows (block, trusted, text) -> rows (shard, block, n, grams, counts): the block's
    distinct n-grams and their trusted occurrences."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        held = {}                                            # block -> merged n-grams, parts that came after them

        def merge(block):
            base, parts = held[block]
            held[block] = (_merged(*[np.concatenate(c) for c in zip(base, *parts)]), [])

        def rows(block):
            merge(block)
            m, r, n = held.pop(block)[0]
            shard = (_mixed(m, np.zeros_like(m)) >> np.uint64(33)).astype(np.int64) % shards
            by = np.lexsort((r, m, shard))
            m, r, n, shard = m[by], r[by], n[by], shard[by]
            ends = np.searchsorted(shard, np.arange(shards + 1)).tolist()
            some = [(k, a, b) for k, (a, b) in enumerate(zip(ends, ends[1:])) if a < b]
            yield pa.RecordBatch.from_arrays([
                pa.array([k for k, _, _ in some], pa.int32()), pa.array([block] * len(some), pa.int64()), pa.array([b - a for _, a, b in some], pa.int32()),
                *[pa.array([_pressed(*[x[a:b] for x in xs]) for _, a, b in some], pa.binary()) for xs in ((m, r), (n,))]],
                names=["shard", "block", "n", "grams", "counts"])
        nothing = tuple(np.zeros(0, np.int64) for _ in range(3))
        for batch in batches:
            blocks, trusted = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for block in np.unique(blocks).tolist():
                for good in (False, True):
                    texts = batch.column(2).filter(pa.array((blocks == block) & (trusted == good))).to_pylist()
                    for a, b in _texts_by(texts):
                        m, r, _ = _ngrams(texts[a:b])
                        base, parts = held.setdefault(block, (nothing, []))
                        parts.append(_merged(m, r, np.full(len(m), int(good))))
                        if sum(len(p[0]) for p in parts) > max(500_000, len(base[0])):
                            merge(block)
            while sum(len(x[0]) for base, parts in held.values() for x in (base, *parts)) > 4_000_000:
                # a block that comes back gives more rows; they are summed
                yield from rows(max(held, key=lambda b: len(held[b][0][0]) + sum(len(p[0]) for p in held[b][1])))
        for block in list(held):
            yield from rows(block)
    return run


class _Shard:
    """All n-grams of a shard, each once, with the counts of orders 6, 5 and 4.

    ``counts[k]``: trusted count of each order-k n-gram; ``shorter[k]``: where its suffix is among
    those of order k - 1; ``context[k]``: number of its context; ``of[i]``: where the n-gram in
    position i of row j of the given table is.
    """

    def __init__(self, table):
        import numpy as np
        sizes = table.column("n").to_pylist()
        parts = [_unpressed(g.as_buffer(), n, 2) + _unpressed(c.as_buffer(), n, 1) for g, c, n in zip(table.column("grams"), table.column("counts"), sizes)]
        m, r, c = (np.concatenate(x) for x in zip(*parts))
        mask = (1 << SYMBOL_BITS) - 1
        _, mid = np.unique(m, return_inverse=True)
        last, first = r & mask, r >> SYMBOL_BITS             # first: the two symbols before m
        _, edge = np.unique(r, return_inverse=True)
        _, at, self.of = np.unique(mid * (edge.max() + 1) + edge, return_index=True, return_inverse=True)
        self.ends = np.cumsum(sizes)
        self.counts, self.shorter, self.context = {ORDER: np.bincount(self.of, c, len(at)).astype(np.int64)}, {}, {}
        m, mid, first, last = m[at], mid[at], first[at], last[at]
        for k in range(ORDER, SMALL_ORDER, -1):
            self.context[k] = self.ids(mid, first)[1]
            if k == SMALL_ORDER + 1:
                break
            first = first & (mask if k == ORDER else 0)      # without its first symbol
            at, self.shorter[k] = self.ids(mid, first, last)
            self.counts[k - 1] = np.bincount(self.shorter[k], self.counts[k] > 0, len(at)).astype(np.int64)
            m, mid, first, last = m[at], mid[at], first[at], last[at]
        # of order 3: the last two of m, and the last symbol
        self.tail, self.tail_of = np.unique(((m & ((1 << 2 * SYMBOL_BITS) - 1)) << SYMBOL_BITS) | last, return_inverse=True)
        self.tail_counts = np.bincount(self.tail_of, self.counts[SMALL_ORDER + 1] > 0, len(self.tail)).astype(np.int64)

    @staticmethod
    def ids(*columns):
        """First row of each distinct combination, and the number of every row's."""
        import numpy as np
        at, number = None, np.zeros(len(columns[0]), np.int64)
        for c in columns:
            _, c = np.unique(c, return_inverse=True)
            _, at, number = np.unique(number * (c.max(initial=0) + 1) + c, return_index=True, return_inverse=True)
        return at, number


def _shard_counts(table):
    """Worker function of a shard: rows (shard, order, gram, c): order-3 n-grams with the distinct left neighbours that
    the shard knows, and counts of counts of orders above (``gram``: the count, 1 to 4)."""
    import numpy as np
    import pyarrow as pa
    s = _Shard(table)
    order, gram, c = [np.full(len(s.tail), SMALL_ORDER)], [s.tail], [s.tail_counts]
    for k, counts in s.counts.items():
        order.append(np.full(4, k))
        gram.append(np.arange(1, 5))
        c.append(np.bincount(np.minimum(counts, 5), minlength=6)[1:5])
    order, gram, c = np.concatenate(order), np.concatenate(gram), np.concatenate(c)
    return pa.table([pa.array(np.full(len(c), table.column("shard")[0].as_py(), np.int32)), pa.array(order.astype(np.int32)), pa.array(gram), pa.array(c)],
                    names=["shard", "order", "gram", "c"])


def _shard_probabilities(discounts: dict):
    """Worker function of a shard and the order-3 log-probabilities of its n-grams: rows (block, n, grams, logp)."""
    def run(table, small):
        import numpy as np
        import pyarrow as pa
        s = _Shard(table)
        gram, logp = small.column("gram").to_numpy(), small.column("logp").to_numpy()
        by = np.argsort(gram)
        p = np.exp(logp[by][np.searchsorted(gram[by], s.tail)])[s.tail_of]
        for k in range(SMALL_ORDER + 1, ORDER + 1):
            c, context, d = s.counts[k], s.context[k], discounts[k]
            if k > SMALL_ORDER + 1:
                p = p[s.shorter[k]]
            less = np.where(c > 0, np.array([0.0, d[1], d[2], d[3]])[np.minimum(c, 3)], 0.0)
            total, back = np.bincount(context, c)[context], np.bincount(context, less)[context]
            seen = total > 0
            p = np.where(seen, (c - less + back * p) / np.where(seen, total, 1), p)
        logp, ends = np.log(p)[s.of].astype(np.float32), s.ends.tolist()
        packed = [_small(np.ascontiguousarray(logp[a:b].view(np.uint8).reshape(-1, 4).T).tobytes())
                  for a, b in zip([0] + ends, ends)]
        return pa.table([table.column("block"), table.column("n"), table.column("grams"), pa.array(packed, pa.binary())], names=["block", "n", "grams", "logp"])
    return run


def _discounts(n: dict) -> dict:
    """Modified Kneser-Ney discounts of one order, from its counts of counts."""
    y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    return {i: min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.1 * i), float(i)) if n[i] and n[i + 1] else 0.5 * i for i in (1, 2, 3)}


def log_probabilities(counts: DataFrame, order: int = SMALL_ORDER) -> DataFrame:
    """``gram, logp`` for every row of ``counts`` (``gram``: up to three symbols, ``c``; c = 0: seen only in
    texts that are not trusted)."""
    levels, mask = {order: counts}, lambda k: F.lit((1 << SYMBOL_BITS * (k - 1)) - 1).cast("long")
    for k in range(order, 1, -1):
        above = F.sum(F.when(F.col("c") > 0, 1).otherwise(0)).alias("c")       # distinct left neighbours in trusted text
        levels[k - 1] = staged(levels[k].groupBy(F.col("gram").bitwiseAND(mask(k)).alias("gram")).agg(above), "kn-counts")
    below = None
    for k in range(1, order + 1):
        seen, context = levels[k].filter("c > 0"), F.shiftright("gram", SYMBOL_BITS).alias("context")
        n = seen.agg(*[F.count(F.when(F.col("c") == i, 1)).alias(f"n{i}") for i in range(1, 5)]).first()
        d = _discounts({i: n[f"n{i}"] for i in range(1, 5)})
        less = F.when(F.col("c") >= 3, d[3]).when(F.col("c") == 2, d[2]).otherwise(d[1])
        sums = seen.groupBy(context).agg(F.sum("c").alias("total"), F.sum(less).alias("kept_back"))
        rows = levels[k].select("*", context).join(sums, "context", "left")
        own = F.when(F.col("c") == 0, 0.0).otherwise((F.col("c") - less) / F.col("total"))
        rest = F.when(F.col("total").isNull(), 1.0).otherwise(F.col("kept_back") / F.col("total"))
        if k == 1:
            rows = rows.withColumn("lower", F.lit(1.0 / SYMBOLS))
        else:
            rows = rows.withColumn("shorter", F.col("gram").bitwiseAND(mask(k))).join(below.select(F.col("gram").alias("shorter"), F.col("p").alias("lower")), "shorter")
        below = staged(rows.select("gram", (own + rest * F.col("lower")).alias("p")), "kn-level")
    return below.select("gram", F.log("p").alias("logp"))


def _chunks(batches):
    """Rows (block, doc_id, row_hash, lang, text) -> per batch and block one row with its texts compressed together."""
    import numpy as np
    import pyarrow as pa
    for batch in batches:
        blocks, rows = batch.column(0).to_numpy(zero_copy_only=False), []
        for block in np.unique(blocks).tolist():
            own = batch.filter(pa.array(blocks == block))
            texts = [t.encode() for t in own.column(4).to_pylist()]
            sizes = [len(t) for t in texts]
            rows.append((block, *[own.column(i).to_pylist() for i in (1, 2, 3)], sizes, _small(b"".join(texts)) if any(sizes) else b""))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (
            pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary()))],
            names=["block", "doc_id", "row_hash", "lang", "sizes", "z"])


def _scores(chunks, grams):
    """Worker function of the co-group: texts of a block and the log-probabilities of its n-grams."""
    import numpy as np
    import pyarrow as pa
    names, parts = ["doc_id", "row_hash", "lang", "n_symbols", "logp"], [np.zeros((2, 0), np.int64)]
    logps = [np.zeros(0, np.float32)]
    for n, g, p in zip(grams.column("n").to_pylist(), grams.column("grams"), grams.column("logp")):
        parts.append(np.array(_unpressed(g.as_buffer(), n, 2)))
        raw = np.frombuffer(pa.decompress(p.as_buffer(), 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n)
        logps.append(np.ascontiguousarray(raw.T).view(np.float32).ravel())
    (m, r), p = np.concatenate(parts, axis=1), np.concatenate(logps)
    h = _mixed(m, r)
    by = np.argsort(h)
    m, r, p, h = m[by], r[by], p[by].astype(np.float64), h[by]
    drop = np.uint64(64 - max(16, len(h).bit_length()))
    slots = np.zeros(1 << 64 - int(drop), np.int32)           # direct look-up, sorted search for the rest
    slots[(h >> drop).astype(np.int64)] = np.arange(len(h))

    def differ(at, x, y):
        return (m[at] != x) | (r[at] != y)

    def logp(texts):
        x, y, size = _ngrams(texts)
        hx = _mixed(x, y)
        at = slots[(hx >> drop).astype(np.int64)].astype(np.int64)
        miss = np.flatnonzero(differ(at, x, y))
        at[miss] = np.searchsorted(h, hx[miss])
        while len(miss := miss[differ(at[miss], x[miss], y[miss])]):
            at[miss] += 1                                      # another n-gram with the same mixed number
        return size, np.add.reduceat(p[at], np.cumsum(size) - size)
    known, out = {}, {c: [] for c in names}                    # copies are scored once
    for row in range(chunks.num_rows):
        sizes = chunks.column("sizes")[row].as_py()
        z, ends = chunks.column("z")[row].as_buffer(), np.cumsum(sizes).tolist()
        raw = pa.decompress(z, ends[-1], "zstd", asbytes=True) if ends[-1] else b""
        keys, new = [], {}
        for a, b in zip([0] + ends, ends):
            text = raw[a:b]
            keys.append((b - a, hash(text)))
            if keys[-1] not in known:
                new.setdefault(keys[-1], text.decode("utf-8", "replace"))
        texts, names_ = list(new.values()), list(new)
        for a, b in _texts_by(texts):
            size, value = logp(texts[a:b])
            known.update(zip(names_[a:b], zip(size.tolist(), value.tolist())))
        for c in names[:3]:
            out[c] += chunks.column(c)[row].as_py()
        for c, i in (("n_symbols", 0), ("logp", 1)):
            out[c] += [known[k][i] for k in keys]
    return pa.table([pa.array(out[c], t) for c, t in zip(names, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.float64()))], names=names)


def scored(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "quality",
           from_files: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, row_hash, lang, trusted, held_out, n_symbols, logp`` of every row (written).

    ``from_files``: ``df`` reads files directly, so the blocks are its scan splits; other
    tables are written first.
    """
    text = text_or_empty(text_col)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), text.alias("text_"))
    if not from_files:
        rows = staged(rows, "kn-docs")
    # files hold texts compressed, to about a third
    shares = F.greatest(F.lit(1), F.ceil(F.input_file_block_length() * 3 / block_bytes))
    rows = rows.withColumn("block", F.xxhash64(F.input_file_name(), F.input_file_block_start(), _share(shares)))
    held = F.crc32(F.col("id").cast("string").cast("binary")) % 5 == 0
    good = (labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("q")).dropna()
            .groupBy("id").agg(F.min("q").alias("q")).filter("q > 0").select("id", held.alias("held")))
    good = staged(good, "kn-trusted")
    sent = F.broadcast(good) if good.count() <= TRUSTED_SENT else good
    marked = rows.join(sent, F.col("doc_id") == F.col("id"), "left")
    train = F.coalesce(~F.col("held"), F.lit(False))
    blocks = rows.select("block").distinct().count()
    pairs = staged(map_batches(marked.select("block", train.alias("train"), "text_"), _block_counts(SHARDS + blocks // BLOCKS_A_SHARD),
                               "shard int, block long, n int, grams binary, counts binary"), "kn-pairs", compression="none")
    seen = staged(pairs.groupBy("shard").applyInArrow(lean(_shard_counts), "shard int, order int, gram long, c long"), "kn-shards")
    tops = {(r.order, r.gram): r.c for r in seen.filter(F.col("order") > SMALL_ORDER).groupBy("order", "gram").agg(F.sum("c").alias("c")).collect()}
    discounts = {k: _discounts({i: tops.get((k, i), 0) for i in range(1, 5)}) for k in range(SMALL_ORDER + 1, ORDER + 1)}
    seen = seen.filter(F.col("order") == SMALL_ORDER)
    small = log_probabilities(staged(seen.groupBy("gram").agg(F.sum("c").alias("c")), "kn-counts"))
    needed = seen.select("shard", "gram").join(small, "gram").groupBy("shard")
    logp = pairs.groupBy("shard").cogroup(needed).applyInArrow(lean(_shard_probabilities(discounts)), "block long, n int, grams binary, logp binary")
    chunks = map_batches(rows.select("block", "doc_id", F.xxhash64("text_").alias("row_hash"), "lang", "text_"), _chunks,
                         "block long, doc_id array<long>, row_hash array<long>, lang array<string>, sizes array<long>, z binary")
    out = chunks.groupBy("block").cogroup(logp.groupBy("block")).applyInArrow(
        lean(_scores), "doc_id long, row_hash long, lang string, n_symbols long, logp double")
    out = staged(out, "kn-scores")
    return out.join(good, F.col("doc_id") == F.col("id"), "left").select(
        "doc_id", "row_hash", "lang", F.col("id").isNotNull().alias("trusted"), F.coalesce("held", F.lit(False)).alias("held_out"), "n_symbols", "logp")


def _share(n):
    """Share of a scan split that a row is dealt to: the same in every scan, and copies of a text are spread."""
    return F.pmod(F.xxhash64("doc_id", "text_"), n if not isinstance(n, int) else F.lit(n))


def judged(scores: DataFrame) -> DataFrame:
    """``scores`` with ``perplexity, adjusted, lowest, threshold, kept``."""
    # limits and verdicts on a grid: the same in every run, whatever order sums and quantiles are merged in
    def grid(x):
        return F.round(x, GRID_DIGITS)
    entropy = -F.col("logp") / F.col("n_symbols")
    same = F.col("lang").eqNullSafe(F.col("t_lang"))

    def pulled(middle):
        return grid((-F.col("logp") + PRIOR * middle) / (F.col("n_symbols") + PRIOR))

    def quantile(at, of):
        # exact, over at most some 100 000 values of the grid
        return F.expr(f"percentile_disc({at}) WITHIN GROUP (ORDER BY {of})")
    # the model has seen the trained texts, and copies of them: none of these is too predictable
    limits = F.array(quantile(LOW, "off"), quantile(HIGH, "IF(held_out, off, NULL)")).alias("q")
    known = scores.filter("trusted").withColumn("entropy", grid(entropy))
    middles = staged(known.groupBy(F.col("lang").alias("t_lang")).agg(
        quantile(0.5, "IF(held_out, entropy, NULL)").alias("middle"),
        F.count(F.when(F.col("held_out"), 1)).alias("n_held"), F.count(F.when(~F.col("held_out"), 1)).alias("n_trained"))
        .filter((F.col("n_held") >= MIN_OWN) & (F.col("n_trained") >= MIN_TRAINED)), "kn-middles")
    off = known.join(middles, same).withColumn("off", grid(pulled(F.col("middle")) - F.col("middle")))
    own = off.groupBy("t_lang").agg(F.first("middle").alias("middle"), F.first("n_held").alias("n_held"), limits)
    low, high = off.agg(limits).first()["q"] or (None, None)         # two numbers
    few = F.col("n_held") < MIN_HELD_OUT
    cut = own.select("t_lang", "middle",
                     (F.col("middle") + F.when(few, F.least(F.get("q", 0), F.lit(low).cast("double"))).otherwise(F.get("q", 0))).alias("low"),
                     (F.col("middle") + F.when(few, F.greatest(F.get("q", 1), F.lit(high).cast("double"))).otherwise(F.get("q", 1))).alias("high"))
    # at most one row a language, broadcast where its written size allows
    cut = staged(cut.withColumns({c: grid(F.col(c)) for c in ("low", "high")}), "kn-limits")
    return (scores.join(cut, same, "left")
            .withColumn("perplexity", F.exp(entropy)).withColumn("adjusted_", pulled(F.coalesce("middle", entropy)))
            .withColumn("kept", F.coalesce(F.col("adjusted_").between(F.col("low"), F.col("high")), F.lit(True)))
            .withColumn("adjusted", F.exp("adjusted_")).withColumn("lowest", F.exp("low")).withColumn("threshold", F.exp("high"))
            .drop("t_lang", "middle", "low", "high", "adjusted_"))


def report(df: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Perplexity and verdict of every row."""
    return judged(scored(df, labels, **options)).select("doc_id", "lang", "n_symbols", "perplexity", "adjusted", "lowest", "threshold", "trusted", "held_out", "kept")


def filtered(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows of ``df`` (same columns) that are kept.  Rejected rows are few, so Spark
    usually sends their keys to the scan; else both sides are shuffled."""
    out = judged(scored(df, labels, id_col=id_col, text_col=text_col, **options)).filter(~F.col("kept"))
    gone = staged(out.select(F.col("doc_id").alias("g_id"), F.col("row_hash").alias("g_hash")).distinct(), "kn-rejected")
    key, row = fresh(df, "key_"), fresh(df, "hash_")
    keyed = df.withColumn(key, F.col(id_col).cast("long")).withColumn(row, F.xxhash64(text_or_empty(text_col)))
    same = F.col(key).eqNullSafe(F.col("g_id")) & (F.col(row) == F.col("g_hash"))
    return keyed.join(gone, same, "left_anti").drop(key, row)
