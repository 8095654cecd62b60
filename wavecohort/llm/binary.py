"""Training-order materialisation of token ids (operator 5).

Texts of a partition are put one after the other (each with the end id) and cut
into sequences of ``length`` ids; the last one of a partition is filled up with the
end id.  Sequences are numbered 0..N-1 and a keyed Feistel network, walked along
its cycles until it falls below N, maps each number to its global slot: a
bijection that needs no sort, no shuffle of keys and no table, and that can be
inverted.  Slots are dealt to shards of ``per_shard`` slots in slot order; one task
writes one shard, as records of a fixed stride: the ids in little-endian order
(two bytes each when the vocabulary allows it, else four) and a line feed.  So
record ``r`` of shard ``s`` starts at byte ``r * stride`` and holds slot
``s * per_shard + r``; a reader goes on from any slot.

Numbers come from a written table (partition number and running number within
it), so that they never change when a task is done again.  Spark's own text writer
commits the shards, on any file system that it knows.

Defined cases: null text counts as empty (the end id alone); repeated rows are
written as often as they occur; a null doc_id stays null; an empty table gives no
shard and an empty manifest; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavecohort.llm.common import map_batches, staged, text_or_empty, vocabulary_path
from wavecohort.session import shared_path

ROUNDS = 6


@dataclass(frozen=True)
class Layout:
    """Shape of the shards."""
    length: int = 2048
    per_shard: int = 8192
    width: int = 2
    end_id: int = 2
    key: str = "0"

    @property
    def stride(self) -> int:
        return self.length * self.width + 1


def _round_keys(key: str):
    import numpy as np
    raw = hashlib.blake2b(key.encode(), digest_size=8 * ROUNDS).digest()
    return np.frombuffer(raw, "<u8")


def _mix(x, k):
    """A 64-bit finaliser as round function."""
    import numpy as np
    x = (x + k) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def _network(x, half: int, keys, back: bool):
    import numpy as np
    mask, h = np.uint64((1 << half) - 1), np.uint64(half)
    left, right = x >> h, x & mask
    for k in (keys[::-1] if back else keys):
        if back:
            left, right = right ^ (_mix(left, k) & mask), left
        else:
            left, right = right, left ^ (_mix(right, k) & mask)
    return (left << h) | right


def permute(numbers, n: int, key: str, back: bool = False):
    """Slots of sequence numbers (``back``: numbers of slots), both in [0, n)."""
    import numpy as np
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    keys, x = _round_keys(key), np.array(numbers, np.uint64)
    if n <= 1:
        return x
    x = _network(x, half, keys, back)
    while len(at := np.flatnonzero(x >= np.uint64(n))):
        x[at] = _network(x[at], half, keys, back)
    return x


def tokenised(df: DataFrame, layout: Layout, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sequences before their order: ``local, n_ids, ids_crc32, doc_ids, starts, lengths, ids``."""
    path = vocabulary or vocabulary_path()
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    size, width = 4 * layout.length, layout.width

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from wavecohort.llm.tokens import encoder, slices
        enc, end = encoder(path), layout.end_id.to_bytes(4, "little")
        names = ["local", "n_ids", "ids_crc32", "doc_ids", "starts", "lengths", "ids"]
        out, parts, spans, filled, local = [], [], [], 0, 0

        def close():
            nonlocal parts, spans, filled, local
            raw = b"".join(parts)
            ids = np.frombuffer(raw + end * (layout.length - filled // 4), "<u4")
            if width == 2 and int(ids.max()) > 0xFFFF:
                raise ValueError("ids need four bytes: use width=4")
            out.append((local, filled // 4, zlib.crc32(raw), spans, ids.astype(f"<u{width}").tobytes()))
            parts, spans, filled, local = [], [], 0, local + 1

        def flush():
            cols = [pa.array([r[i] for r in out], pa.int64()) for i in range(3)]
            at = pa.array(np.cumsum([0] + [len(r[3]) for r in out]), pa.int32())
            for i in range(3):
                cols.append(pa.ListArray.from_arrays(at, pa.array([s[i] for r in out for s in r[3]], pa.int64())))
            cols.append(pa.array([r[4] for r in out], pa.binary()))
            out.clear()
            return pa.RecordBatch.from_arrays(cols, names=names)
        for batch in batches:
            for a, k in slices(batch.column(1)):
                part = batch.slice(a, k)
                for doc, ids in zip(part.column(0).to_pylist(), enc.encode(part.column(1))):
                    ids, at = ids + end, 0
                    while at < len(ids):
                        take = min(size - filled, len(ids) - at)
                        parts.append(ids[at:at + take])
                        spans.append((doc, at // 4, take // 4))
                        at, filled = at + take, filled + take
                        if filled == size:
                            close()
                    if len(out) >= 256:
                        yield flush()
        if filled:
            close()
        yield flush()

    return map_batches(rows, run, "local long, n_ids long, ids_crc32 long, doc_ids array<long>, starts array<long>, "
                                "lengths array<long>, ids binary")


def _compress(pack: bool):
    """Worker function: (shard, slot, ids) with the ids of each sequence compressed, or back."""
    def run(batches):
        import pyarrow as pa
        import zstandard
        change = zstandard.ZstdCompressor(level=1).compress if pack else zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([change(x.as_buffer()) for x in part.column(2)], pa.binary())],
                                                 names=["shard", "slot", "ids"])
    return run


def materialise(df: DataFrame, layout: Layout = Layout(), path: str | None = None, vocabulary: str | None = None,
                id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """Write the shards; returns the manifest (``slot, shard, record, number, n_ids, ids_crc32,
    doc_ids, starts, lengths``; the crc is that of the unpadded ids as 32-bit numbers) and
    the folder."""
    import uuid
    spark: SparkSession = df.sparkSession
    path = path or shared_path(spark, f"llm-shards-{uuid.uuid4().hex[:8]}")
    made = tokenised(df, layout, vocabulary, id_col, text_col).withColumn("part", F.spark_partition_id())
    kept = staged(made, "sequences", compression="zstd")
    counts = kept.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(F.col("part").alias("base_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    n = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not n:
        manifest = (kept.select(*[F.col("local").alias(c) for c in ("slot", "shard", "record", "number")], "n_ids", "ids_crc32",
                                "doc_ids", "starts", "lengths"))
        return manifest, path
    key = layout.key

    @F.pandas_udf("long")
    def slot_of(number):
        import pandas as pd
        return pd.Series(permute(number.to_numpy(), n, key).astype("int64"))
    # one row for each input partition
    numbered = (kept.join(F.broadcast(base), F.col("part") == F.col("base_part")).withColumn("number", F.col("base") + F.col("local"))
                .withColumn("slot", slot_of("number")))
    shard = F.floor(F.col("slot") / layout.per_shard).cast("int")
    shards = -(-n // layout.per_shard)
    # the one shuffle of ids carries them compressed
    records = numbered.select(shard.alias("shard"), "slot", "ids").mapInArrow(_compress(True), "shard int, slot long, ids binary")
    dealt = records.repartitionById(shards, "shard").mapInArrow(_compress(False), "shard int, slot long, ids binary")
    (dealt.sortWithinPartitions("shard", "slot").select("shard", F.col("ids").cast("string").alias("value"))
     .write.mode("overwrite").partitionBy("shard").text(path))
    manifest = numbered.select("slot", shard.alias("shard"), F.pmod(F.col("slot"), F.lit(layout.per_shard)).alias("record"), "number",
                               "n_ids", "ids_crc32", "doc_ids", "starts", "lengths")
    return manifest, path


def read_records(spark: SparkSession, path: str, layout: Layout, shard: int, first: int = 0) -> DataFrame:
    """``slot, ids`` of one shard from record ``first`` on, in slot order."""
    file = spark.read.format("binaryFile").load(f"{path}/shard={shard}")
    n = (F.length("content") / layout.stride).cast("long")
    rows = file.filter(n > first).select("content", F.explode(F.sequence(F.lit(first).cast("long"), n - 1)).alias("r"))
    return rows.select((F.lit(shard).cast("long") * layout.per_shard + F.col("r")).alias("slot"),
                       F.substring("content", (F.col("r") * layout.stride + 1).cast("int"), F.lit(layout.stride - 1)).alias("ids"))
