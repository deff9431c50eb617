import random

from quarry.operators import sequence


def test_alignment_reads_scores_in_small_batches(spark):
    rng = random.Random(2)
    rows = [(f, s, c, float(rng.randrange(4))) for f in (1, 2, None) for c in range(0, 60, 2) for s in range(3, 3 * rng.randrange(2, 12), 3)]
    df = spark.createDataFrame(rows, "file_id long, segment long, chunk long, score double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        found = sequence.align_monotonic(df)
        got = {(r.file_id, r.chunk): r.segment for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().executedPlan().toString()  # that holds a whole file
    want = {}
    for f in (1, 2, None):
        names, chunks = sorted({s for g, s, _, _ in rows if g == f}), sorted({c for g, _, c, _ in rows if g == f})
        score = {(c, s): v for g, s, c, v in rows if g == f}
        total, moved = [0.0 if k == 0 else float("-inf") for k in range(len(names))], []
        for t, c in enumerate(chunks):
            on = [t > 0 and k > 0 and total[k - 1] > total[k] for k in range(len(names))]
            total = [(total[k - 1] if on[k] else total[k]) + score.get((c, names[k]), 0.0) for k in range(len(names))]
            moved.append(on)
        k = total.index(max(total))
        for t in range(len(chunks) - 1, -1, -1):
            want[f, chunks[t]] = names[k]
            k -= moved[t][k]
    assert got == want
