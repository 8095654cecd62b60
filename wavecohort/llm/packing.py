"""Vector bin packing of token sequences (operator 1).

Every example is a vector: tokens, one segment, loss-bearing tokens.  A task
reads its partition as a stream and keeps a pool of waiting examples.  It fills
one sequence after the other: of the examples that fit in all three remaining
capacities it takes the one with the largest dot product with the remaining
capacities (each dimension divided by its limit; ties: the oldest).  When none
fits and at least ``min_cut`` tokens are free, the longest waiting example is cut
to what is left; its rest goes on waiting.  A sequence that closes with more free
space than that (last sequence of a partition, or segment limit reached) is split
at powers of two, which need no padding.

Nothing is shuffled: work and memory are bounded by the pool (``pool_examples``
examples, ``pool_tokens`` tokens), whatever a partition holds, and a lost task is
done again from its input partition with the same result.  ``sequence_id`` is
unique: partition number times 2^40 plus a running number.

Defined cases: null text or prompt counts as empty (an empty text still has the
end id, so one piece); repeated rows and repeated ids are packed once per row;
texts longer than a sequence fill whole sequences first; an empty table gives an
empty result; columns other than those named are not read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavecohort.llm.common import map_batches, text_or_empty, vocabulary_path
from wavecohort.llm.tokens import MAX_WORDS


@dataclass(frozen=True)
class Limits:
    """Limits of one sequence, and the shortest piece worth a cut."""
    tokens: int = 4096
    segments: int = 512
    loss: int = 4096
    min_cut: int = 16
    pool_examples: int = 1024
    pool_tokens: int = 4_000_000


class Packer:
    """Fills sequences from a pool of examples; ``pieces`` gets
    ``(example, start, length, sequence, offset, sequence_tokens)``."""

    def __init__(self, lim: Limits):
        import numpy as np
        self.np, self.lim = np, lim
        self.items: list = []                       # example objects, aligned with the arrays
        self.tok = np.zeros(0, np.int64)            # tokens left (0: placed)
        self.start = np.zeros(0, np.int64)
        self.prompt = np.zeros(0, np.int64)         # ids before this index bear no loss
        self.sequence = 0
        self.pieces: list[tuple] = []

    def add(self, examples: list, n, prompt) -> None:
        np = self.np
        live = np.flatnonzero(self.tok)
        self.items = [self.items[i] for i in live] + examples
        self.tok = np.concatenate([self.tok[live], np.asarray(n, np.int64)])
        self.start = np.concatenate([self.start[live], np.zeros(len(examples), np.int64)])
        self.prompt = np.concatenate([self.prompt[live], np.asarray(prompt, np.int64)])
        self.loss = self._loss()

    def _loss(self):
        end = self.start + self.tok
        return self.np.maximum(0, end - self.np.maximum(self.start, self.prompt))

    def waiting(self) -> tuple[int, int]:
        return int((self.tok > 0).sum()), int(self.tok.sum())

    def _take(self, i: int, length: int, placed: list) -> int:
        """Place the first ``length`` tokens of example ``i``; its loss tokens."""
        s = int(self.start[i])
        loss = max(0, s + length - max(s, int(self.prompt[i])))
        placed.append((self.items[i], s, length))
        self.start[i] += length
        self.tok[i] -= length
        self.loss[i] -= loss
        return loss

    def fill(self) -> None:
        """One sequence."""
        lim, tok, loss = self.lim, self.tok, self.loss
        ct, cs, cl = lim.tokens, lim.segments, lim.loss
        placed: list[tuple] = []
        while ct > 0 and cs > 0:
            fits = (tok > 0) & (tok <= ct) & (loss <= cl)
            score = self.np.where(fits, tok * (ct / lim.tokens ** 2) + loss * (cl / lim.loss ** 2) + cs / lim.segments ** 2, -1.0)
            i = int(score.argmax())
            if score[i] > 0:
                length = int(tok[i])
            else:                                    # nothing fits: cut the longest
                i = int(tok.argmax())
                # ids before the prompt's end are free of loss
                free = max(0, int(self.prompt[i]) - int(self.start[i]))
                length = min(ct, int(tok[i]), free + cl)
                if length < lim.min_cut and placed:  # an empty sequence takes what the limits allow
                    break
            cl -= self._take(i, length, placed)
            ct -= length
            cs -= 1
        self._close(placed, lim.tokens - ct)

    def _close(self, placed: list, filled: int) -> None:
        size = self.lim.tokens
        whole = [filled]
        if filled < size and size - filled >= self.lim.min_cut:
            whole = [1 << b for b in range(filled.bit_length() - 1, -1, -1) if filled >> b & 1]
        room, offset = whole[0], 0
        at = 0
        for item, start, length in placed:
            while length:
                n = min(length, room - offset)
                self.pieces.append((item, start, n, self.sequence, offset, room))
                start, length, offset = start + n, length - n, offset + n
                if offset == room:
                    self.sequence, at, offset = self.sequence + 1, at + 1, 0
                    room = whole[at] if at < len(whole) else size


def pack(df: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text",
         prompt_col: str | None = None, end_id: int = 2, limits: Limits = Limits(), with_ids: bool = False,
         max_words: int = MAX_WORDS) -> DataFrame:
    """Pieces of all rows of ``df`` packed into sequences.

    An example's ids are those of the prompt (no loss) and of the text (loss),
    then ``end_id``.  Columns: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, sequence_tokens, loss_tokens`` and, with ``with_ids``,
    ``ids`` (little-endian unsigned 32-bit).  A sequence of ``sequence_tokens``
    ids is padded to ``limits.tokens`` unless that is a power of two.
    ``max_words`` bounds a worker's word table (speed against memory).
    """
    path = vocabulary or vocabulary_path()
    schema = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
              "offset long, sequence_tokens long, loss_tokens long" + (", ids binary" if with_ids else ""))
    prompt = text_or_empty(prompt_col) if prompt_col else F.lit("")
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), prompt.alias("prompt"), text_or_empty(text_col).alias("text"))

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        from wavecohort.llm.tokens import encoder, slices
        enc, packer = encoder(path, max_words), Packer(limits)
        base = TaskContext.get().partitionId() << 40
        end = end_id.to_bytes(4, "little")

        def out():
            rows, packer.pieces = packer.pieces, []
            cols: list[list] = [[] for _ in range(10 if with_ids else 9)]
            for (doc, ids, prompt_n), start, n, seq, offset, total in rows:
                cut = ids[4 * start:4 * (start + n)]
                row = [doc, start, n, zlib.crc32(cut), len(ids) // 4, base + seq, offset, total,
                       max(0, start + n - max(start, prompt_n))] + ([cut] if with_ids else [])
                for c, v in zip(cols, row):
                    c.append(v)
            kinds = [pa.int64()] * 9 + [pa.binary()] * with_ids
            names = [c.split()[0] for c in schema.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

        for batch in batches:
            for a, k in slices(batch.column(2)):
                part = batch.slice(a, k)
                docs = part.column(0).to_pylist()
                heads = enc.encode(part.column(1)) if prompt_col else [b""] * len(docs)
                items = [(d, h + t + end, len(h) // 4) for d, h, t in zip(docs, heads, enc.encode(part.column(2)))]
                packer.add(items, [len(i[1]) // 4 for i in items], [i[2] for i in items])
                n, tokens = packer.waiting()
                if n > limits.pool_examples or tokens > limits.pool_tokens:
                    while n > limits.pool_examples // 4 or tokens > limits.pool_tokens:
                        packer.fill()
                        n, tokens = packer.waiting()
                    yield out()
        while packer.waiting()[0]:
            packer.fill()
            if len(packer.pieces) > 4096:
                yield out()
        yield out()

    return map_batches(rows, run, schema)


def sequences(pieces: DataFrame) -> DataFrame:
    """Sequences from pieces with ids: ``sequence_id, n_tokens, n_segments, ids``
    (a group is one sequence, so at most ``limits.segments`` pieces)."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return (pieces.groupBy("sequence_id")
            .agg(F.sum("length").alias("n_tokens"), F.count(F.lit(1)).alias("n_segments"), parts.alias("parts"))
            .withColumn("ids", F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])))
            .drop("parts"))
