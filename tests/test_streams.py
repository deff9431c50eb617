"""Streams against the batch forms of what they keep up."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import operations
from quarry.streaming import circuits, terms

JOBS = "job_id long, provider string, status string, ts timestamp"


def test_breaker_over_a_stream_equals_the_one_over_a_table(spark, tmp_path):
    rng = random.Random(6)
    at, rows = 1_700_000_000, []
    for i in range(240):
        at += rng.choice([0, 1, 5, 40, 900]) + (i % 60 == 0)  # a batch begins at a time of its own
        rows.append((i, rng.choice(["a", "b", None]), rng.choice(["failed", "failed", "succeeded"]), at))
    jobs = spark.createDataFrame([r[:3] + (None,) for r in rows], JOBS).drop("ts").join(spark.createDataFrame([(r[0], r[3]) for r in rows], "job_id long, t long"), "job_id").withColumn("ts", F.timestamp_seconds("t"))
    for k in range(4):
        part = jobs.where((F.col("job_id") >= 60 * k) & (F.col("job_id") < 60 * (k + 1)))
        part.select("job_id", "provider", "status", "ts").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(JOBS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = circuits.breaker_stream(stream, 60, 2, 30).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    plain = operations.breaker(jobs.withColumn("provider", F.coalesce("provider", F.lit("-"))), 60, 2, 30)
    want = sorted((r.job_id, r.provider, r.failures, r.open) for r in plain.collect())
    got = sorted((r.job_id, r.provider or "-", r.failures, r.open) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == want and any(r[3] for r in want)


def sets(df):
    return sorted((r.file_id, r.generation, r.term or "") for r in df.collect())


def test_late_and_repeated_batches_change_no_terms(spark):
    make = lambda rows: spark.createDataFrame(rows, terms.TERMS)
    first, second = make([(1, 1, "a"), (1, 1, "b"), (2, 1, "c"), (2, 1, "c")]), make([(1, 2, "d"), (2, 2, None), (None, 9, "x"), (3, 1, "e")])
    want = [(1, 2, "d"), (2, 2, ""), (3, 1, "e")]
    after = lambda *batches: sets(_fold(spark, batches))
    assert after(first, second) == after(second, first) == after(first, second, first) == after(first, second, second) == want
    assert sets(terms.live_postings(_fold(spark, (first, second))).withColumn("generation", F.lit(0))) == [(1, 0, "d"), (3, 0, "e")]
    mixed = make([(1, 1, "a"), (1, 3, "z"), (1, 2, "y")])
    assert after(mixed) == [(1, 3, "z")]


def _fold(spark, batches):
    stored = spark.createDataFrame([], terms.TERMS)
    for b in batches:
        stored = terms.merged_terms(stored, b)
    return stored


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 0, 1)])
def test_a_stream_of_term_sets_ends_alike_in_any_order(spark, tmp_path, order):
    batches = [[(1, 1, "a"), (2, 1, "b")], [(1, 2, "c"), (1, 2, "d")], [(2, 3, None), (3, 1, "e")]]
    for k in order:
        spark.createDataFrame(batches[k], terms.TERMS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        updates = spark.readStream.schema(terms.TERMS).parquet(str(tmp_path / "in"))
        terms.term_stream(updates, str(tmp_path / "terms"), str(tmp_path / "cp")).awaitTermination()
    assert sets(terms.stored_terms(spark, str(tmp_path / "terms"))) == [(1, 2, "c"), (1, 2, "d"), (2, 3, ""), (3, 1, "e")]
    assert terms.stored_terms(spark, str(tmp_path / "nowhere")).count() == 0
