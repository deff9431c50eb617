"""Queries against their SQL on rows at the edge of a rule."""

import datetime

import duckdb
import pytest

from quarry import queries as own


@pytest.mark.parametrize("name", ["watch_engagement", "lane_weights", "cluster_lanes", "feed_interleave"])
def test_a_tenth_of_a_video_is_judged_alike(spark, tmp_path, name):
    ts = datetime.datetime(2024, 1, 2)
    events = [(k, ts, k % 3, "view", round((10 + k) / 10, 2), f'{{"k": {k}}}') for k in range(400)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    vectors = [(k, [float(k % 7 == j) + 0.1 for j in range(8)], k % 5) for k in range(400)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label long").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    for t in ("events", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    found = own.queries()[name](spark, str(tmp_path))
    result = con.execute(own.oracle_sql()[name])
    order = [d[0] for d in result.description]
    want = sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in result.fetchall())
    assert want and sorted(tuple(r[c] for c in order) for r in found.collect()) == want
