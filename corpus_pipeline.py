"""Training-corpus pipeline: documents in, packed token sequences out.

``STAGES`` are (name, function) pairs; each function takes (spark, docs, sf_dir) and
returns a DataFrame.  ``run`` writes every stage's result as Parquet in the shared
folder and reads it back as the next one's ``docs``: a lost executor repeats only its
part of one stage.  All stages but the last return the columns of ``docs``.
"""

from __future__ import annotations

from wavecohort.llm import classifier, mixing, packing, quality, simhash
from wavecohort.llm.common import staged, table
from wavecohort.session import apply_runtime_conf

#: Target mix: equal domains and languages but for more weight on English, no repeats.
MIX = mixing.Mix(budget=0.8, epochs=1)


def quality_rules(spark, docs, sf_dir):
    """Keeps the documents inside the adaptive bounds of their language and source."""
    return quality.filtered(docs)


def quality_classifier(spark, docs, sf_dir):
    """Keeps the documents whose perplexity is usual for their language."""
    return classifier.filtered(docs, table(spark, sf_dir, "labels"), from_files=True)


def simhash_dedup(spark, docs, sf_dir):
    """Keeps one document of each near-duplicate component."""
    return simhash.dedup(docs, shingle=simhash.SHINGLE, distance=simhash.DISTANCE)


def source_mixing(spark, docs, sf_dir):
    """Keeps each leaf's prefix under the target weights."""
    return mixing.selected(docs, MIX)


def pack(spark, docs, sf_dir):
    """Pieces of all documents in sequences of at most 4096 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("simhash_dedup", simhash_dedup),
    ("source_mixing", source_mixing),
    ("packing", pack),
]

#: Python stages: tested against a brute-force version instead.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``."""
    apply_runtime_conf(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
