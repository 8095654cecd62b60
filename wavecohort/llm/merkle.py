"""Merkle manifest of a dataset by butterfly exchange (operator 12).

Rows of a group (language) are leaves in the order of an id.  ``fanout`` consecutive nodes of
a level (the last run may have fewer) are hashed to one node, until one is left, the
group's subroot; the subroots in group order likewise give the root.

1. Leaves get their place by a range sort: numbers inside a range, plus the rows of
   earlier ranges (one row a range and group).
2. An aligned block of ``fanout ** BLOCK_LEVELS`` leaves is one group of rows; it hashes its
   subtree and gives every leaf its lower proof.
3. Butterfly over the blocks: in round r a block holds the root of the aligned ``fanout ** r``
   blocks around it and swaps it with one block of each sibling subtree (partners are spread
   over the blocks of a smaller last subtree).  All blocks of a subtree hash the same
   parent, so each has its upper proof when the last round ends and no pass goes down.
4. The subroots are leaves of one more such tree; a leaf's proof is the three parts in turn.

A proof is an array of ``(left, right)``, the digests beside the node on each level, so that
folding is ``sha2(left || node || right)`` level by level.

Defined cases: a null field hashes as ``-``, an empty one as ``0:``; null groups and ids come
first; rows with one id follow by their leaf (equal rows are interchangeable, so
one row with most of the table is spread over ranges); a lone leaf is its subroot; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavecohort.llm.common import staged

BLOCK_LEVELS = 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PROOF = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(columns: list[Column]) -> Column:
    """Digest of the fields of a row: ``-`` for null, else byte count, colon and value."""
    def part(c):
        s = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))
    return digest(*map(part, columns))


def fold(node: Column, proof: Column) -> Column:
    """Root that a node and its proof lead to."""
    return F.aggregate(proof, node, lambda h, p: digest(p["left"], h, p["right"]))


def proof_digest(proof: Column) -> Column:
    """Digest of all siblings of a proof, from the leaf's level up."""
    return digest(F.array_join(F.transform(proof, lambda p: F.concat(p["left"], p["right"])), ""))


def _placed(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` (written: ``g, id, leaf, tie``) with ``rank`` in the group and the group's size ``n``."""
    order = [F.col("g"), F.col("id").asc_nulls_first(), F.col("leaf"), F.col("tie")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = staged(ranged.withColumns({"part": F.spark_partition_id(), "seq": F.monotonically_increasing_id()}), f"merkle-{name}-placed")
    runs = ranged.groupBy("g", "part").agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("rows"))
    by = Window.partitionBy("g").orderBy("part")           # one row a range
    start = F.coalesce(F.sum("rows").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("g", "part", (start - F.col("first")).alias("shift"), F.sum("rows").over(Window.partitionBy("g")).alias("n"))
    return ranged.join(runs, ["g", "part"]).withColumn("rank", F.col("seq") + F.col("shift")).drop("part", "seq", "shift", "tie")


def _subtrees(fanout: int, levels: int):
    """Worker function: the leaves of a block -> with lower proofs, and the block's root on its first row."""
    def run(table):
        import hashlib

        import pyarrow as pa
        table = table.sort_by("rank")
        n, size, top = table.num_rows, table.column("n")[0].as_py(), levels
        if size <= fanout ** levels:                        # the only block: up to its single node
            top = 0
            while fanout ** top < size:
                top += 1
        nodes, proofs, span = table.column("leaf").to_pylist(), [[] for _ in range(n)], 1
        for _ in range(top):
            parents = []
            for a in range(0, len(nodes), fanout):
                run_ = nodes[a:a + fanout]
                for j in range(len(run_)):
                    step = {"left": "".join(run_[:j]), "right": "".join(run_[j + 1:])}
                    for leaf in range((a + j) * span, min(n, (a + j + 1) * span)):
                        proofs[leaf].append(step)
                parents.append(hashlib.sha256("".join(run_).encode()).hexdigest())
            nodes, span = parents, span * fanout
        table = table.append_column("proof", pa.array(proofs, pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))))
        return table.append_column("node", pa.array([nodes[0]] + [None] * (n - 1), pa.string()))
    return run


def _swapped(blocks: DataFrame, fanout: int, r: int) -> DataFrame:
    """One round: every block meets one block of each sibling subtree and hashes the common parent."""
    span = fanout ** r
    own = F.floor(F.col("block") / span) % fanout
    base = F.floor(F.col("block") / (span * fanout)) * (span * fanout)
    open_ = F.col("blocks") > span
    asked = (blocks.filter(open_).select("g", "block", "blocks", own.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(fanout - 1))).alias("j"),
                                         base.alias("base"))
             .filter("j <> own").withColumn("first", F.col("base") + F.col("j") * span).filter("first < blocks")
             .select("g", "block", "j", (F.col("first") + F.col("block") % F.least(F.lit(span), F.col("blocks") - F.col("first"))).alias("partner")))
    seen = (asked.join(blocks.select("g", F.col("block").alias("partner"), F.col("node").alias("theirs")), ["g", "partner"])
            .groupBy("g", "block").agg(F.sort_array(F.collect_list(F.struct("j", "theirs"))).alias("met")))      # fewer than fanout

    def beside(test):
        return F.array_join(F.transform(F.filter(F.coalesce("met", F.lit(None)), test), lambda m: m["theirs"]), "")
    left = F.coalesce(beside(lambda m: m["j"] < own), F.lit(""))
    right = F.coalesce(beside(lambda m: m["j"] > own), F.lit(""))
    step = F.struct(left.alias("left"), right.alias("right"))
    return blocks.join(seen, ["g", "block"], "left").select(
        "g", "block", "blocks", F.when(open_, digest(left, F.col("node"), right)).otherwise(F.col("node")).alias("node"),
        F.when(open_, F.array_append("upper", step)).otherwise(F.col("upper")).alias("upper"))


def trees(rows: DataFrame, name: str, fanout: int = 2, levels: int = BLOCK_LEVELS) -> DataFrame:
    """Rows (``g`` never null, ``id, leaf`` and others) with ``rank``, ``proof`` and their group's ``subroot``."""
    rows = staged(rows.withColumn("tie", F.rand()), f"merkle-{name}-leaves")
    placed = _placed(rows, name).withColumn("block", F.floor(F.col("rank") / fanout ** levels))
    out = staged(placed.groupBy("g", "block").applyInArrow(_subtrees(fanout, levels), _fields(placed) + f", proof {_PROOF}, node string"),
                 f"merkle-{name}-blocks")
    blocks = out.filter("node is not null").select("g", "block", F.ceil(F.col("n") / fanout ** levels).alias("blocks"), "node",
                                                   F.array().cast(_PROOF).alias("upper"))
    most, r = blocks.agg(F.max("blocks")).first()[0] or 1, 0
    while fanout ** r < most:
        blocks, r = staged(_swapped(blocks, fanout, r), f"merkle-{name}-round"), r + 1
    tops = blocks.select("g", "block", F.col("node").alias("subroot"), "upper")
    return out.drop("node").join(tops, ["g", "block"]).withColumn("proof", F.concat("proof", "upper")).drop("block", "upper", "n")


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def manifest(df: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields=FIELDS, fanout: int = 2, levels: int = BLOCK_LEVELS,
             extra: dict[str, Column] | None = None) -> DataFrame:
    """``id, group, rank, leaf, proof, subroot, root`` of every row, and the columns ``extra`` made from ``df``."""
    key = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))       # null comes first, and is a key
    rows = df.select(key.alias("g"), F.col(id_col).alias("id"), leaf_digest([F.col(c) for c in fields]).alias("leaf"),
                     *[c.alias(f"x_{name}") for name, c in (extra or {}).items()])
    low = trees(rows, "rows", fanout, levels)
    groups = low.filter("rank = 0").select(F.lit("").alias("g"), F.col("g").alias("id"), F.col("subroot").alias("leaf"))
    high = trees(groups, "groups", fanout, levels).select(F.col("id").alias("g"), F.col("proof").alias("above"), F.col("subroot").alias("root"))
    return low.join(high, "g").select(
        "id", F.when(F.col("g") != "", F.expr("substring(g, 2)")).alias("group"), "rank", "leaf", F.concat("proof", "above").alias("proof"),
        "subroot", "root", *[F.col(f"x_{name}").alias(name) for name in (extra or {})])


def audited(df: DataFrame, **options) -> DataFrame:
    """The manifest of ``df`` as digests, and what its proofs say when every row whose id has a checksum
    divisible by 7 is changed (one character more counted) after the manifest was made."""
    fields = [F.try_add(F.col(c), F.lit(1)) if c == "n_chars" else F.col(c) for c in FIELDS]
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    rows = manifest(df, extra={"found": F.when(hit, leaf_digest(fields))}, **options)
    rows = rows.withColumn("folded_root", fold(F.coalesce("found", "leaf"), F.col("proof")))
    return rows.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"),
                       "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def oracle_sql() -> str:
    """The audited manifest in DuckDB (fanout 2)."""
    def leaf(n_chars):
        parts = [f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", n_chars, "text")]
        return "sha256(" + " || ".join(parts) + ")"
    # crc32 of the decimal id: byte by byte, eight shifts each
    step = "list_reduce([xor(c, b)] || [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384::UBIGINT))"
    crc = f"xor(list_reduce([4294967295::UBIGINT] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: ascii(s)::UBIGINT), lambda c, b: {step}), 4294967295::UBIGINT)"

    def levels(source):
        return f"""SELECT g, 0 AS lvl, i, h FROM {source} UNION ALL
            SELECT g, lvl + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM LV) WHERE c > 1 GROUP BY g, lvl, i // 2"""
    return f"""WITH RECURSIVE d AS (SELECT doc_id, lang AS g, {leaf('n_chars')} AS h, CASE WHEN {crc} % 7 = 0 THEN {leaf('n_chars + 1')} END AS found FROM documents),
        r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i FROM d),
        a AS ({levels('r').replace('LV', 'a')}),
        ends AS (SELECT g, max(lvl) AS top FROM a GROUP BY g),
        subs AS (SELECT a.g AS name, h FROM a JOIN ends ON a.g IS NOT DISTINCT FROM ends.g AND lvl = top),
        s AS (SELECT name, h, 0 AS g, row_number() OVER (ORDER BY name NULLS FIRST) - 1 AS i FROM subs),
        b AS ({levels('s').replace('LV', 'b')}),
        root AS (SELECT h FROM b ORDER BY lvl DESC LIMIT 1),
        steps AS (
            SELECT r.doc_id, r.h AS leaf, l.lvl, sib.i < (r.i >> l.lvl) AS before, coalesce(sib.h, '') AS h
            FROM r JOIN ends ON r.g IS NOT DISTINCT FROM ends.g JOIN (SELECT DISTINCT lvl FROM a) l ON l.lvl < ends.top
            LEFT JOIN a sib ON sib.g IS NOT DISTINCT FROM r.g AND sib.lvl = l.lvl AND sib.i = xor(r.i >> l.lvl, 1)
            UNION ALL
            SELECT r.doc_id, r.h, 1000 + l.lvl, sib.i < (s.i >> l.lvl), coalesce(sib.h, '')
            FROM r JOIN s ON r.g IS NOT DISTINCT FROM s.name JOIN (SELECT DISTINCT lvl FROM b) l ON l.lvl < (SELECT max(lvl) FROM b)
            LEFT JOIN b sib ON sib.lvl = l.lvl AND sib.i = xor(s.i >> l.lvl, 1)),
        proofs AS (SELECT doc_id, leaf, list((coalesce(before, false), h) ORDER BY lvl) AS p, string_agg(h, '' ORDER BY lvl) AS siblings FROM steps GROUP BY 1, 2),
        folded AS (
            SELECT r.doc_id, r.h AS leaf, subs.h AS subroot, (SELECT h FROM root) AS root, sha256(coalesce(siblings, '')) AS proof_sha256,
                list_reduce([(true, coalesce(r.found, r.h))] || coalesce(p, []),
                    lambda x, y: (true, sha256(CASE WHEN y[1] THEN y[2] || x[2] ELSE x[2] || y[2] END)))[2] AS folded_root
            FROM r JOIN subs ON r.g IS NOT DISTINCT FROM subs.name LEFT JOIN proofs ON proofs.doc_id IS NOT DISTINCT FROM r.doc_id AND proofs.leaf = r.h)
        SELECT *, folded_root = root AS verified FROM folded"""
