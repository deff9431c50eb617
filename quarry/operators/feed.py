"""A recommendation feed: playback, engagement, lanes, scoring, interleaving, evaluation."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import kept
from .vector import best, neighbours

#: Playback, freshness and feed constants (fixed values).
BUCKET, HALF_LIFE_DAYS, FRESH_HALF_LIFE, FRESH_FLOOR = 5, 7.0, 365.0, 0.0
LANE_FLOOR, LANE_LOW, IDENTICAL, PER_LANE, DEPTH = 0.25, 0.45, 0.999, 120, 300
#: Plays that a task of a replay has.
PLAYS_AT_ONCE = 25_000


def coverage(plays: DataFrame, duration: Column) -> DataFrame:
    """(viewer, file_id, watched, share): seconds of the distinct five-second segments played, the last cut at the duration."""
    one = plays.select("viewer", "file_id", "segment", duration.alias("duration")).distinct()
    seconds = F.least(F.lit(float(BUCKET)), F.greatest(F.lit(0.0), F.col("duration") - BUCKET * F.col("segment")))
    sums = one.groupBy("viewer", "file_id").agg(F.sum(seconds).alias("watched"), F.max("duration").alias("duration"))
    return sums.select("viewer", "file_id", "watched", F.when(F.col("duration") > 0, F.col("watched") / F.col("duration")).otherwise(0.0).alias("share"))


#: Shares and lengths of the rule of engagement (fixed values).
BRIEF, HALF, UNKNOWN_EMBED, SHORT_SECONDS = 0.10, 0.5, 0.5, 20.0


def engagement(liked: Column, dismissed: Column, watched: Column, duration: Column, position: Column, legacy: Column, embed: Column | None = None) -> Column:
    """How much a video counts: 1 for what is liked, 0 for what is dismissed, else by how much of it was played.

    1 if half of the duration is covered by ``watched`` seconds, or reached by
    ``position`` in a video of under 20 seconds. Rows of before coverage was
    recorded (``legacy``) count by the share reached: none below a tenth, up to
    1 at a half; without a duration, an ``embed`` counts half.
    """
    known = duration > 0
    reached = F.least(F.lit(1.0), F.greatest(F.coalesce(position, F.lit(0.0)), F.least(watched, duration), F.lit(0.0)) / duration)
    old = F.when(known, F.when(reached < BRIEF, 0.0).otherwise(F.least(F.lit(1.0), reached / HALF))).when(F.lit(False) if embed is None else embed, UNKNOWN_EMBED).otherwise(0.0)
    enough = F.when(duration < SHORT_SECONDS, 2 * F.coalesce(position, F.lit(0.0)) >= duration).otherwise(2 * watched >= duration)
    return F.when(liked, 1.0).when(dismissed, 0.0).when(legacy, old).when(known & enough, 1.0).otherwise(0.0)


def profile_history(history: DataFrame, window_days: float = 365.0, most: int = 2000) -> DataFrame:
    """``history`` (viewer, file_id, engagement, age_days, ...) that forms a profile: what counts, of known age within the window, the newest ``most`` of each viewer."""
    rows = history.where((F.col("engagement") > 0) & F.col("age_days").between(-1.0, window_days))
    return best(rows, "viewer", [F.asc("age_days"), F.asc("file_id")], most)


def cluster_lanes(history: DataFrame, clusters: DataFrame) -> DataFrame:
    """(viewer, cluster, weight, position) of history (viewer, id, engagement, age_days) and (viewer, id, cluster): heaviest first."""
    weights = lane_weights(history.join(clusters, ["viewer", "id"]).withColumnRenamed("cluster", "lane"))
    order = Window.partitionBy("viewer").orderBy(F.desc(F.round("weight", 9)), F.asc("lane"))
    return weights.select("viewer", F.col("lane").alias("cluster"), "weight", F.row_number().over(order).alias("position"))


def tasks_for(rows: DataFrame, times: int = 1) -> int:
    """As many tasks as give each about PLAYS_AT_ONCE rows, or ``times`` as many, so that what a task holds does not grow with their number."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // (times * PLAYS_AT_ONCE)))


def played_after(plays: DataFrame, cuts: DataFrame, hours: float) -> DataFrame:
    """(viewer, cut, file_id): what a viewer of ``plays`` (viewer, file_id, t) plays in the hours after each of ``cuts`` (viewer, cut).

    Found by the blocks of ``hours`` that a cut and the next one make, not by
    all pairs of a viewer.
    """
    spread = cuts.select("viewer", "cut", F.explode(F.array(F.floor(F.col("cut") / hours), F.floor(F.col("cut") / hours) + 1)).alias("block"))
    n, keys = tasks_for(plays), ["viewer", "cut", "file_id"]
    near = plays.withColumn("block", F.floor(F.col("t") / hours)).repartition(n, "viewer", "block").join(spread.repartition(n, "viewer", "block"), ["viewer", "block"])
    return near.where((F.col("t") >= F.col("cut")) & (F.col("t") < F.col("cut") + hours)).select(*keys).repartition(n, *keys).distinct()


def replay(plays: DataFrame, cuts: DataFrame, ranked: DataFrame, hours: float, depth: int) -> DataFrame:
    """(viewer, cut, targets, hits, recall, hit) of feeds ``ranked`` (viewer, cut, file_id, position) against what is played in the hours after each cut.

    ``plays`` is (viewer, file_id, t) and ``cuts`` (viewer, cut), times in hours.
    """
    targets = played_after(plays, cuts, hours)
    found = targets.join(ranked.where(F.col("position") <= depth).select("viewer", "cut", "file_id", F.lit(1).alias("found")), ["viewer", "cut", "file_id"], "left")
    sums = found.groupBy("viewer", "cut").agg(F.count("*").alias("targets"), F.count("found").alias("hits"))
    return sums.select("viewer", "cut", "targets", "hits", (F.col("hits") / F.col("targets")).alias("recall"), (F.col("hits") > 0).alias("hit"))


def rankings(plays: DataFrame, cuts: DataFrame, half_lives: list[float]) -> DataFrame:
    """(config, viewer, cut, file_id, position) of what a viewer played before each cut, in several orders.

    ``newest`` has the last played first; ``random`` is a shuffle that viewer
    and cut seed, so that it comes out alike every time; ``fresh_<h>`` adds
    plays up, each halved every h days. ``plays`` is (viewer, file_id, t) and
    ``cuts`` (viewer, cut), in hours.
    """
    n = tasks_for(plays)
    before = plays.select("viewer", "file_id", "t").repartition(n, "viewer").join(cuts.repartition(n, "viewer"), "viewer").where(F.col("t") < F.col("cut"))
    fresh = [F.round(F.sum(F.pow(F.lit(0.5), (F.col("cut") - F.col("t")) / (24 * h))), 9).alias(f"fresh_{h:g}") for h in half_lives]
    rows = before.groupBy("viewer", "cut", "file_id").agg(F.max("t").alias("newest"), *fresh)
    seeded = F.md5(F.concat_ws("|", F.col("viewer").cast("string"), F.round("cut").cast("long").cast("string"), F.col("file_id").cast("string")))
    rows = rows.withColumn("random", seeded)
    own = Window.partitionBy("viewer", "cut")
    configs = ["newest", "random", *[f"fresh_{h:g}" for h in half_lives]]
    rows = rows.select("viewer", "cut", "file_id", *[F.row_number().over(own.orderBy(F.desc(c), F.asc("file_id"))).alias(c) for c in configs])
    orders = F.array(*[F.struct(F.lit(c).alias("config"), F.col(c).alias("position")) for c in configs])
    return rows.select("viewer", "cut", "file_id", F.explode(orders).alias("x")).select("x.config", "viewer", "cut", "file_id", "x.position")


def replay_report(plays: DataFrame, cuts: DataFrame, ranked: DataFrame, hours: float, depths: tuple[int, int] = (12, 40)) -> DataFrame:
    """(config, cuts, targets, recall_a, recall_b, hit) of :func:`rankings` over all viewers.

    A cut without plays in the hours after it is left out; recalls at the two
    depths and hits at the greater are means over cuts.
    """
    wanted = kept(played_after(plays, cuts, hours), "wanted")
    own = wanted.groupBy("viewer", "cut").agg(F.count("*").alias("targets"))
    ranked = kept(ranked.where(F.col("position") <= depths[1]), "ranked")
    n, keys = tasks_for(ranked, 10), ["viewer", "cut", "file_id"]
    met = wanted.repartition(n, *keys).join(ranked.repartition(n, *keys), keys)
    configs = [r.config for r in ranked.select("config").distinct().orderBy("config").collect()]
    own = own.withColumn("config", F.explode(F.array(*[F.lit(c) for c in configs]).cast("array<string>")))
    n, keys = tasks_for(own, 10), ["config", "viewer", "cut"]
    hits = met.repartition(n, *keys).groupBy(*keys).agg(F.count_if(F.col("position") <= depths[0]).alias("a"), F.count("*").alias("b"))
    all_ = own.repartition(n, *keys).join(hits, keys, "left")
    rate = lambda c: F.avg(F.coalesce(c, F.lit(0)) / F.col("targets"))
    return all_.groupBy("config").agg(F.count("*").alias("cuts"), F.sum("targets").alias("targets"), rate("a").alias("recall_a"), rate("b").alias("recall_b"), F.avg((F.coalesce("b", F.lit(0)) > 0).cast("double")).alias("hit"))


def freshness(age_days: Column, half_life: float = FRESH_HALF_LIFE, floor: float = FRESH_FLOOR) -> Column:
    """floor + (1 - floor) halved every ``half_life`` days; the floor for an unknown age or one over a day ahead."""
    decayed = floor + (1 - floor) * F.pow(F.lit(0.5), F.greatest(age_days, F.lit(0.0)) / half_life)
    return F.when(age_days.isNull() | (age_days < -1), F.lit(floor)).otherwise(decayed)


def lane_weights(history: DataFrame) -> DataFrame:
    """(viewer, lane, weight) of history (viewer, lane, engagement, age_days): ln(1 + decayed engagement) over the viewer's most, 0.25 at least."""
    decayed = F.sum(F.col("engagement") * F.pow(F.lit(0.5), F.col("age_days") / HALF_LIFE_DAYS))
    sums = history.groupBy("viewer", "lane").agg(F.log1p(decayed).alias("raw"))
    top = F.max("raw").over(Window.partitionBy("viewer"))
    return sums.select("viewer", "lane", F.when(top > 0, F.greatest(F.col("raw") / top, F.lit(LANE_FLOOR))).otherwise(F.lit(LANE_FLOOR)).alias("weight"))


def lane_scores(lanes: DataFrame, rows: DataFrame, low: float = LANE_LOW, per_lane: int = PER_LANE) -> DataFrame:
    """(lane, id, similarity, score): the best rows (id, vector, fresh) of each lane (lane, vector), by similarity times freshness."""
    found = neighbours(lanes.select(F.col("lane").cast("long").alias("query_id"), "vector"), rows, floor=low).where(F.col("score") < IDENTICAL)
    scored = found.join(rows.select("id", "fresh"), "id").select(F.col("query_id").alias("lane"), "id", F.col("score").alias("similarity"), (F.col("score") * F.col("fresh")).alias("score"))
    return best(scored, "lane", [F.desc(F.round("score", 9)), F.desc(F.round("similarity", 9)), F.asc("id")], per_lane)


def interleave(scored: DataFrame, weights: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(viewer, id, lane, position): each file in the lane it is nearest to, lanes taking turns by weight.

    ``scored`` is (lane, id, similarity, score), ``weights`` (viewer, lane, weight).
    """
    rows = scored.join(weights, "lane")
    rows = best(rows, ["viewer", "id"], [F.desc(F.round("similarity", 9)), F.desc(F.round("weight", 9)), F.asc("lane")], 1)
    own = Window.partitionBy("viewer", "lane").orderBy(F.desc(F.round("score", 9)), F.desc(F.round("similarity", 9)), F.asc("id"))
    rows = rows.withColumn("rank", F.row_number().over(own)).withColumn("turn", F.round(F.col("rank") / F.col("weight"), 9))
    return best(rows, "viewer", [F.asc("turn"), F.asc("lane"), F.asc("rank")], depth, rank="position").select("viewer", "id", "lane", "position")


def choose_k(n: int) -> int:
    """Clusters for ``n`` files."""
    return 1 if n < 12 else min(8, max(2, round((n / 2) ** 0.5)))


def interest_clusters(history: DataFrame, rounds: int = 25) -> DataFrame:
    """(viewer, id, cluster) of history (viewer, id, vector, weight): weighted spherical k-means for each viewer.

    ``history`` is that of :func:`profile_history`, so that a viewer has 2,000
    rows at most. Seeds follow from the viewer, far ones by squared distance. Clusters of one file join the nearest other.
    """

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        x = np.stack([np.asarray(v, float) for v in pdf["vector"]])
        w = pdf["weight"].to_numpy(float)
        k = min(choose_k(len(x)), len(x))
        seed = int.from_bytes(hashlib.sha256(str(pdf["viewer"].iloc[0]).encode()).digest()[:8], "big")
        rng = np.random.default_rng(seed)
        centres = [x[rng.integers(len(x))]]
        while len(centres) < k:
            far = np.clip(1 - np.max(x @ np.array(centres).T, axis=1), 0, None) ** 2
            centres.append(x[rng.choice(len(x), p=far / far.sum())] if far.sum() > 0 else x[len(centres)])
        c, label = np.array(centres), np.zeros(len(x), int)
        for _ in range(rounds):
            new = np.argmax(x @ c.T, axis=1)
            for j in range(len(c)):
                total = (x[new == j] * w[new == j, None]).sum(axis=0)
                if np.linalg.norm(total) > 0:
                    c[j] = total / np.linalg.norm(total)
            if (new == label).all():
                break
            label = new
        for j in range(len(c)):
            if (label == j).sum() == 1 and len(set(label)) > 1:
                i = int(np.flatnonzero(label == j)[0])
                near = c @ x[i]
                near[[q for q in range(len(c)) if q == j or not (label == q).any()]] = -np.inf
                label[i] = int(np.argmax(near))
        order = {old: i for i, old in enumerate(dict.fromkeys(label.tolist()))}
        return pd.DataFrame({"viewer": pdf["viewer"], "id": pdf["id"], "cluster": [order[j] for j in label.tolist()]})

    return history.groupBy("viewer").applyInPandas(cluster, "viewer long, id long, cluster long")


def online_hits(plays: DataFrame, feeds: DataFrame, hours: int = 48) -> DataFrame:
    """(viewer, file_id, ts, hit): whether a feed (viewer, computed_at, files) of the last hours before a play has its file."""
    near = plays.alias("p").join(
        feeds.alias("f"),
        (F.col("p.viewer") == F.col("f.viewer")) & (F.col("f.computed_at") < F.col("p.ts")) & (F.col("f.computed_at") >= F.col("p.ts") - F.expr(f"INTERVAL {hours} HOURS")),
        "left",
    )
    hit = F.coalesce(F.max(F.array_contains("f.files", F.col("p.file_id")).cast("int")), F.lit(0))
    return near.groupBy(F.col("p.viewer").alias("viewer"), F.col("p.file_id").alias("file_id"), F.col("p.ts").alias("ts")).agg((hit == 1).alias("hit"))


def time_range(name: str, now: Column) -> tuple[Column, Column]:
    """[after, before) of a symbolic range at ``now``; weeks begin on Monday."""
    day, week, month, year = (F.date_trunc(u, now) for u in ("day", "week", "month", "year"))
    back = lambda c, unit: c - F.expr(f"INTERVAL 1 {unit}")
    on = lambda c, unit: c + F.expr(f"INTERVAL 1 {unit}")
    ranges = {
        "today": (day, on(day, "DAY")),
        "yesterday": (back(day, "DAY"), day),
        "this_week": (week, week + F.expr("INTERVAL 7 DAYS")),
        "last_week": (week - F.expr("INTERVAL 7 DAYS"), week),
        "this_month": (month, on(month, "MONTH")),
        "last_month": (back(month, "MONTH"), month),
        "this_year": (year, on(year, "YEAR")),
        "recent": (now - F.expr("INTERVAL 14 DAYS"), now),
    }
    return ranges[name]
