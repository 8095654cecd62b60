"""The pipeline's stages on the smallest tables, and the packed result of what they keep."""

import corpus_pipeline
from tests.llm.test_packing import _check
from tests.llm.test_simhash import brute, brute_fp

D = "/root/testdata/sf0.001"


def test_stages_and_result(spark):
    from wavecohort.llm.common import staged
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = staged(stage(spark, docs, D), f"test-{name}")
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        assert set(after) < set(before) or name == "quality_classifier" and set(after) <= set(before)
        assert all(before[i] == t for i, t in after.items())
        if name == "simhash_dedup":
            ids = list(before)
            assert set(after) == set(brute(ids, [brute_fp(before[i]) for i in ids]).values())
        kept[name] = after
    rows = corpus_pipeline.run(spark, D).collect()
    assert _check(rows, list(kept["source_mixing"].items())) < 0.02
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    assert not any(labels.get(i) == 0 for i in kept["quality_classifier"])
