"""What tasks get and keep: batches bounded by bytes, caches bounded by a stage."""

import pyarrow as pa
from pyspark.sql import functions as F

from meshframes.llm import common, packing


def test_batches_are_bounded_by_bytes(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    docs = spark.range(6_000, numPartitions=1).select("id", F.repeat(F.lit("word "), 1_000).alias("text"))
    got = common.in_tasks(docs, sizes, "n long, size long").collect()
    assert sum(r["n"] for r in got) == 6_000
    assert max(r["size"] for r in got) <= common.BATCH_BYTES + 10_000


def test_an_own_limit_of_batches_stays(spark):
    before = spark.conf.get(common.BATCH_CONF, None)
    spark.conf.set(common.BATCH_CONF, "1m")
    try:
        common.in_tasks(spark.range(1), lambda batches: batches, "id long")
        assert spark.conf.get(common.BATCH_CONF) == "1m"
    finally:
        spark.conf.unset(common.BATCH_CONF) if before is None else spark.conf.set(common.BATCH_CONF, before)


def test_a_worker_forgets_the_tokenizer_in_the_next_stage(spark):
    n = spark.sparkContext.defaultParallelism
    docs = spark.range(4 * n, numPartitions=2 * n).select(F.col("id").alias("doc_id"), F.lit("two words").alias("text"))
    assert packing.tokenize(docs).agg(F.sum("n")).first()[0] == 12 * n

    def left(batches):
        from meshframes.llm.tokens import encoder

        kept = encoder.cache_info().currsize
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([kept] * b.num_rows)], names=["kept"])

    assert common.in_tasks(docs, left, "kept long").agg(F.max("kept")).first()[0] == 0
