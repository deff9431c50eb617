"""Replays: what a task holds does not grow with the plays."""

import random

from quarry.operators import feed


def test_a_replay_takes_tasks_in_proportion_and_equals_its_definition(spark, monkeypatch):
    monkeypatch.setattr(feed, "PLAYS_AT_ONCE", 50)
    rng = random.Random(4)
    plays = [(v, rng.randrange(9), rng.randrange(400) / 2) for v in range(20) for _ in range(30)]
    cuts = [(v, c) for v in range(20) for c in (40.0, 90.0)]
    df, at = spark.createDataFrame(plays, "viewer long, file_id long, t double"), spark.createDataFrame(cuts, "viewer long, cut double")
    ranked = feed.rankings(df, at, [7])
    assert ranked.rdd.getNumPartitions() == 12
    assert feed.played_after(df, at, 48.0).rdd.getNumPartitions() == 12
    got = {r.config: r for r in feed.replay_report(df, at, ranked, 48.0, (2, 4)).collect()}
    targets, a, b = [], [], []
    for v, c in cuts:
        wanted = {f for w, f, t in plays if w == v and c <= t < c + 48}
        last = {}
        for w, f, t in plays:
            if w == v and t < c:
                last[f] = max(t, last.get(f, 0.0))
        order = sorted(last, key=lambda f: (-last[f], f))
        if wanted:
            targets.append(len(wanted))
            a.append(len(wanted & set(order[:2])) / len(wanted))
            b.append(len(wanted & set(order[:4])) / len(wanted))
    r = got["newest"]
    assert set(got) == {"newest", "random", "fresh_7"} and (r.cuts, r.targets) == (len(targets), sum(targets))
    assert abs(r.recall_a - sum(a) / len(a)) < 1e-9 and abs(r.recall_b - sum(b) / len(b)) < 1e-9
    assert abs(r.hit - sum(x > 0 for x in b) / len(b)) < 1e-9
