"""What a worker holds of texts is bounded, and what it freed goes back to the system."""

import re

from pyspark.sql import functions as F

from wavecohort.llm.common import map_batches


def test_batches_are_bounded_by_bytes(spark):
    df = spark.range(0, 400, 1, 1).select("id", F.repeat(F.lit("x"), 100_000).alias("text"))

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["rows", "bytes"])
    got = map_batches(df, run, "rows long, bytes long").collect()
    assert sum(r.rows for r in got) == 400
    assert max(r.bytes for r in got) < 8 << 20


def test_freed_memory_is_released(spark):
    df = spark.range(0, 10_000, 1, 1)

    def run(batches):
        import pyarrow as pa

        def held():
            with open("/proc/self/smaps_rollup") as f:
                return int(re.search(r"\nPss_Anon:\s+(\d+)", f.read()).group(1)) // 1024
        before, pin = held(), None
        for i, _ in enumerate(batches):
            if i == 0:
                junk = [bytes(1000) for _ in range(200_000)]
                pin = bytes(1000)                            # above all that is freed
                del junk
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([held() - before])], names=["i", "mb"])
        assert pin
    got = {r.i: r.mb for r in map_batches(df, run, "i long, mb long").collect()}
    assert len(got) > 1 and got[max(got)] < 100
