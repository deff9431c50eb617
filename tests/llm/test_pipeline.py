"""The pipeline's stages on a small folder of tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import quality, simhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """``documents`` with awkward rows and further columns, beside the benchmark."""
    path = tmp_path_factory.mktemp("tables")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(3).withColumn("doc_id", F.lit(None).cast("long")).unionByName(docs.limit(2)).unionByName(docs.limit(2).withColumn("text", F.lit(None).cast("string")))
    docs.unionByName(odd).withColumn("row_key", F.lit("mine")).withColumn("_", F.lit(1)).withColumn("a.b", F.lit("dot")).withColumn("size", F.lit("own")).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    first, rows = docs, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == first.columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        rows.append(docs.count())
    assert rows[0] > rows[1] > rows[2] >= rows[3] == rows[4] > 0
    assert docs.where("text is null").count() == 0
    assert docs.groupBy("text").count().where("count > 1").count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert last.count() == rows[4] and last.columns == [*first.columns, "size_", "source_size", "target", "taken", "copies"]
    assert last.where("taken > 2 * size_ or text is null").count() == 0 and last.where("`a.b` <> 'dot'").count() == 0


def test_quality_and_duplicates_equal_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = corpus_pipeline.STAGES[0][1](spark, docs, folder)
    verdicts = {(r.doc_id, r.n_words): r.kept for r in quality.quality(docs).collect()}
    count = lambda t: len((t or "").encode().split())
    want = sorted(str((r.doc_id, r.text)) for r in docs.collect() if verdicts[r.doc_id, count(r.text)])
    assert sorted(str((r.doc_id, r.text)) for r in kept.collect()) == want

    left = corpus_pipeline.STAGES[1][1](spark, kept, folder).collect()
    texts = sorted({r.text for r in kept.collect()})
    prints = [np.concatenate([simhash.majority(simhash._widen(np.array(h, np.uint64), k), np.array([len(h)])) for k in range(corpus_pipeline.BITS // 64)]) for h in (simhash.shingle_hashes(t, 5) for t in texts)]
    apart = np.array([[int(np.bitwise_count(a ^ b).sum()) for b in prints] for a in prints])
    label = np.arange(len(texts))
    for _ in texts:
        label = np.array([label[row <= corpus_pipeline.RADIUS].min() for row in apart])
    assert len(left) == len(set(label.tolist()))
    assert sorted(label[texts.index(r.text)] for r in left) == sorted(set(label.tolist()))


def test_equal_rows_are_mixed_each(spark):
    row = (1, "one two three", "en", "a")
    docs = spark.createDataFrame([row] * 2500 + [(2, "four", "en", "b"), (None, None, None, None)], "doc_id long, text string, lang string, source string")
    got = corpus_pipeline.source_mix(spark, docs, "").collect()
    assert len(got) == 2502 and len({r.source_size for r in got}) == 3


def test_run_agrees_with_itself(spark, folder):
    one, two = (corpus_pipeline.run(spark, folder).collect() for _ in range(2))
    assert sorted(map(str, one)) == sorted(map(str, two))


def test_empty_documents(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
