"""Registered queries of the training-data operators: name -> (function, oracle SQL or None)."""

from __future__ import annotations

from wavecohort.llm import (
    binary, chat, classifier, fingerprints, licenses, merkle, mixing, packing, quality, simhash, suffixes, toxicity, whitening,
)
from wavecohort.llm.common import table
from wavecohort.llm.tokens import MANY_WORDS


def op1_packing(spark, d):
    """All documents packed into sequences of at most 4096 ids."""
    return packing.pack(table(spark, d, "documents"), max_words=MANY_WORDS)


def op2_classifier(spark, d):
    """Perplexity and verdict of every document."""
    return classifier.report(table(spark, d, "documents"), table(spark, d, "labels"), from_files=True)


def op3_toxicity(spark, d):
    """Toxicity score of every document, learned from ``labels``."""
    docs = table(spark, d, "documents")
    return toxicity.scored(docs, toxicity.fit(docs, table(spark, d, "labels")))


def op4_chat(spark, d):
    """Maximal logged conversations, rendered."""
    return chat.formatted(table(spark, d, "conversations"))


def op5_binary(spark, d):
    """All documents as token sequences in training order: manifest of the written shards."""
    return binary.materialise(table(spark, d, "documents"))[0]


def op6_licenses(spark, d):
    """License phrases and notices in every document."""
    return licenses.scan(table(spark, d, "documents"))


def op7_fingerprints(spark, d):
    """Fingerprints of every document and of its edited text."""
    return fingerprints.compared(table(spark, d, "documents"))


def op8_quality_rules(spark, d):
    """Counts, base rules and adaptive verdict of every document."""
    return quality.report(table(spark, d, "documents"))


def op9_mixing(spark, d):
    """How much of every document the target mix takes."""
    return mixing.mixed(table(spark, d, "documents"), max_words=MANY_WORDS)


def op10_simhash(spark, d):
    """Near-duplicate components of all documents (4-word shingles, 4 bits)."""
    return simhash.components_of(table(spark, d, "documents"))


def op11_whitening(spark, d):
    """All embeddings on the four leading components of their covariance."""
    return whitening.report(table(spark, d, "embeddings"))


def op12_merkle(spark, d):
    """Merkle manifest of all documents, and what it says of rows changed afterwards."""
    return merkle.audited(table(spark, d, "documents"))


def op13_suffixes(spark, d):
    """What is left of all documents without passages of 200 bytes or more that repeat."""
    return suffixes.cleaned(table(spark, d, "documents"), keep_text=False)


QUERIES = {
    "op1_packing": (op1_packing, None),
    "op2_classifier": (op2_classifier, None),
    "op3_toxicity": (op3_toxicity, None),
    "op4_chat": (op4_chat, chat.oracle_sql()),
    "op5_binary": (op5_binary, None),
    "op6_licenses": (op6_licenses, licenses.oracle_sql()),
    "op7_fingerprints": (op7_fingerprints, None),
    "op8_quality_rules": (op8_quality_rules, None),
    "op9_mixing": (op9_mixing, None),
    "op10_simhash": (op10_simhash, None),
    "op11_whitening": (op11_whitening, None),
    "op12_merkle": (op12_merkle, merkle.oracle_sql()),
    "op13_suffixes": (op13_suffixes, None),
}
