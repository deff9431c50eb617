import random
from datetime import datetime, timedelta

from quarry.operators import operations


def test_a_circuit_breaker_counts_as_by_definition_across_blocks_and_ties(spark):
    rng = random.Random(11)
    begin = datetime(2024, 1, 1)
    at = [0, 5_000_000, 9_999_999, 10_000_000, 10_000_001, 19_999_999, 20_000_000, *(rng.randrange(120_000_000) for _ in range(150))]
    jobs = [(i, rng.choice(["a", "b", None]), rng.choice(["failed", "failed", "succeeded", None]), t) for i, t in enumerate([*at, *rng.choices(at, k=40)])]
    df = spark.createDataFrame([(i, p, s, begin + timedelta(microseconds=t)) for i, p, s, t in jobs], "job_id long, provider string, status string, ts timestamp")
    for window, threshold, pause in ((10, 2, 4), (3, 1, 25)):
        failures = {i: sum(q == p and s == "failed" and t - window * 1_000_000 <= u <= t for _, q, s, u in jobs) for i, p, _, t in jobs}
        trips = [(p, t) for i, p, s, t in jobs if s == "failed" and failures[i] > threshold]
        want = {(i, p, failures[i], any(q == p and u <= t and t - u < pause * 1_000_000 for q, u in trips)) for i, p, _, t in jobs}
        found = operations.breaker(df, window, threshold, pause)
        assert {tuple(r) for r in found.collect()} == want
        assert "hashpartitioning(provider" not in found._jdf.queryExecution().optimizedPlan().toString()
        assert all("_block" in line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Window [" in line)
