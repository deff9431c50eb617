"""Recommendation queries: ``events`` as playback, ``embeddings`` as files, their labels as lanes.

Now is 2024-01-31 00:00, the day after the last event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import feed as O
from ..sources import tables as T
from . import Registry
from .vector import MEANS

register = Registry()

NOW = "2024-01-31 00:00:00"
#: Before it, coverage is taken as not recorded.
RECORDED = "2024-01-08 00:00:00"

PLAYS = """WITH e AS (SELECT user_id AS viewer, (props->>'$.k')::BIGINT AS file_id, ts, floor(value / 5) AS segment, event_type = 'purchase' AS liked, event_type = 'error' AS dismissed, value FROM events),
segs AS (SELECT DISTINCT viewer, file_id, segment FROM e),
cov AS (SELECT viewer, file_id, sum(least(5.0, greatest(0.0, 10.0 + file_id - 5 * segment))) AS watched, max(10.0 + file_id) AS duration FROM segs GROUP BY ALL),
st AS (SELECT viewer, file_id, max(ts) AS ts, max(value) AS position, bool_or(liked) AS liked, bool_or(dismissed) AS dismissed FROM e GROUP BY ALL),
h AS (SELECT viewer, file_id, ts, watched, watched / duration AS share, CASE WHEN liked THEN 1.0 WHEN dismissed THEN 0.0
  WHEN ts < TIMESTAMP '2024-01-08 00:00:00' THEN CASE WHEN greatest(position, watched) / duration < 0.1::DOUBLE THEN 0.0 ELSE least(1.0, greatest(position, watched) / duration / 0.5) END
  WHEN duration < 20 THEN CASE WHEN 2 * position >= duration THEN 1.0 ELSE 0.0 END WHEN 2 * watched >= duration THEN 1.0 ELSE 0.0 END::DOUBLE AS engagement,
  (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(ts)) / 86400e6 AS age FROM cov JOIN st USING (viewer, file_id)),
hl AS (SELECT h.*, label AS lane FROM h JOIN embeddings ON vec_id = file_id),
raw AS (SELECT viewer, lane, ln(1 + sum(engagement * power(0.5, age / 7))) AS raw FROM hl GROUP BY ALL),
lw AS (SELECT viewer, lane, CASE WHEN max(raw) OVER (PARTITION BY viewer) > 0 THEN greatest(raw / max(raw) OVER (PARTITION BY viewer), 0.25) ELSE 0.25 END AS weight FROM raw)
"""


def _history(spark: SparkSession, sf: str) -> DataFrame:
    plays = T.plays(spark, sf)
    covered = O.coverage(plays, 10.0 + F.col("file_id"))
    state = plays.groupBy("viewer", "file_id").agg(F.max("ts").alias("ts"), F.max("value").alias("position"), F.bool_or("liked").alias("liked"), F.bool_or("dismissed").alias("dismissed"))
    age = (F.unix_micros(F.lit(NOW).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 86400e6
    rows = covered.join(state, ["viewer", "file_id"])
    return rows.withColumn("engagement", O.engagement(F.col("liked"), F.col("dismissed"), F.col("watched"), 10.0 + F.col("file_id"), F.col("position"), F.col("ts") < F.lit(RECORDED).cast("timestamp"))).withColumn("age_days", age)


@register(PLAYS + "SELECT viewer, file_id, round(watched, 6)::DOUBLE AS watched, round(share, 6)::DOUBLE AS share, round(engagement, 6) AS engagement FROM h")
def watch_engagement(spark: SparkSession, sf: str) -> DataFrame:
    return _history(spark, sf).select("viewer", "file_id", *[F.round(c, 6).alias(c) for c in ("watched", "share", "engagement")])


@register("SELECT event_id, round(CASE WHEN d < -1 THEN 0.2 ELSE 0.2 + 0.8 * power(0.5, greatest(d, 0) / 365) END, 9) AS fresh FROM (SELECT event_id, (epoch_us(TIMESTAMP '2024-01-15 00:00:00') - epoch_us(ts)) / 86400e6 AS d FROM events)")
def freshness(spark: SparkSession, sf: str) -> DataFrame:
    age = (F.unix_micros(F.lit("2024-01-15 00:00:00").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 86400e6
    return T.table(spark, sf, "events").select("event_id", F.round(O.freshness(age, floor=0.2), 9).alias("fresh"))


def _lane_weights(spark: SparkSession, sf: str) -> DataFrame:
    labels = T.vectors(spark, sf).select(F.col("id").alias("file_id"), F.col("label").alias("lane"))
    return O.lane_weights(_history(spark, sf).join(labels, "file_id"))


@register(PLAYS + "SELECT viewer, lane, round(weight, 6) AS weight FROM lw")
def lane_weights(spark: SparkSession, sf: str) -> DataFrame:
    return _lane_weights(spark, sf).withColumn("weight", F.round("weight", 6))


SCORED = ", " + MEANS.strip().removeprefix("WITH ") + """, fr AS (SELECT vec_id AS id, 0.2 + 0.8 * power(0.5, vec_id / 365.0) AS fresh FROM embeddings),
ls AS (SELECT query_id AS lane, pairs.id, s AS similarity, s * fresh AS score FROM pairs JOIN fr USING (id) WHERE s >= 0.1 AND s < 0.999
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(s * fresh, 9) DESC, round(s, 9) DESC, id) <= 40)
"""


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.vectors(spark, sf).withColumn("fresh", O.freshness(F.col("id").cast("double"), floor=0.2))
    lanes = V.pool(rows, "label", "vector").select(F.col("label").alias("lane"), "vector")
    return O.lane_scores(lanes, rows, low=0.1, per_lane=40)


@register(PLAYS + SCORED + "SELECT lane::BIGINT AS lane, id, round(similarity, 6) AS similarity, round(score, 6) AS score FROM ls")
def lane_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).withColumns({c: F.round(c, 6) for c in ("similarity", "score")})


@register(PLAYS + SCORED + """, cr AS (SELECT viewer, id, lw.lane, similarity, score, weight FROM ls JOIN lw USING (lane)
  QUALIFY row_number() OVER (PARTITION BY viewer, id ORDER BY round(similarity, 9) DESC, round(weight, 9) DESC, lw.lane) = 1),
rk AS (SELECT *, row_number() OVER (PARTITION BY viewer, lane ORDER BY round(score, 9) DESC, round(similarity, 9) DESC, id) AS rank FROM cr)
SELECT viewer, id, lane::BIGINT AS lane, row_number() OVER (PARTITION BY viewer ORDER BY round(rank / weight, 9), lane, rank) AS position FROM rk QUALIFY position <= 50""")
def feed_interleave(spark: SparkSession, sf: str) -> DataFrame:
    out = O.interleave(_scored(spark, sf), _lane_weights(spark, sf), depth=50)
    return out.select("viewer", "id", F.col("lane").cast("long").alias("lane"), F.col("position").cast("long").alias("position"))


@register()
def feed_clusters(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.vectors(spark, sf).select(F.col("id").alias("file_id"), "vector")
    history = O.profile_history(_history(spark, sf)).join(rows, "file_id")
    return O.interest_clusters(history.select("viewer", F.col("file_id").alias("id"), "vector", F.col("engagement").alias("weight")))


@register("""WITH e AS (SELECT user_id AS viewer, (props->>'$.k')::BIGINT AS file_id, ts FROM events),
p AS (SELECT DISTINCT viewer, file_id, ts FROM e), f AS (SELECT viewer, date_trunc('day', ts) AS computed_at, list(DISTINCT file_id) AS files FROM e GROUP BY ALL),
h AS (SELECT p.viewer, p.file_id, p.ts, coalesce(max(list_contains(files, p.file_id)::INT), 0) AS hit FROM p LEFT JOIN f ON p.viewer = f.viewer AND computed_at < p.ts AND computed_at >= p.ts - INTERVAL 48 HOURS GROUP BY ALL)
SELECT CASE WHEN grouping(yearweek(ts)) = 1 THEN 'all' ELSE 'w' || weekofyear(any_value(ts)) END AS week, count(*) AS plays, sum(hit)::BIGINT AS hits FROM h GROUP BY GROUPING SETS ((yearweek(ts)), ())""")
def feed_online_hits(spark: SparkSession, sf: str) -> DataFrame:
    plays = T.plays(spark, sf).select("viewer", "file_id", "ts").distinct()
    feeds = T.plays(spark, sf).groupBy("viewer", F.date_trunc("day", "ts").alias("computed_at")).agg(F.collect_set("file_id").alias("files"))
    hits = O.online_hits(plays, feeds).withColumn("week", F.concat(F.lit("w"), F.weekofyear("ts")))
    rolled = hits.rollup("week").agg(F.count("*").alias("plays"), F.count_if("hit").alias("hits"))
    return rolled.withColumn("week", F.coalesce("week", F.lit("all")))


RANGES = {"today": ("day", "0 DAY", "1 DAY"), "yesterday": ("day", "1 DAY", "0 DAY"), "this_week": ("week", "0 DAY", "7 DAY"), "last_week": ("week", "7 DAY", "0 DAY"), "this_month": ("month", "0 DAY", "1 MONTH")}


@register(" UNION ALL ".join(
    f"SELECT '{n}' AS name, user_id, count(*) AS viewed FROM events WHERE ts >= date_trunc('{u}', TIMESTAMP '2024-01-24 12:00:00') - INTERVAL {a} AND ts < date_trunc('{u}', TIMESTAMP '2024-01-24 12:00:00') + INTERVAL {b} GROUP BY user_id"
    for n, (u, a, b) in RANGES.items()))
def time_ranges_history(spark: SparkSession, sf: str) -> DataFrame:
    events, now, out = T.table(spark, sf, "events"), F.lit("2024-01-24 12:00:00").cast("timestamp_ntz"), None
    for name in RANGES:
        after, before = O.time_range(name, now)
        one = events.where((F.col("ts") >= after) & (F.col("ts") < before)).groupBy("user_id").agg(F.count("*").alias("viewed")).select(F.lit(name).alias("name"), "user_id", "viewed")
        out = one if out is None else out.unionByName(one)
    return out


@register("""WITH p AS (SELECT user_id AS viewer, (props->>'$.k')::BIGINT AS file_id, epoch_us(ts) / 3.6e9 - 473352 AS t FROM events),
c AS (SELECT DISTINCT viewer, 24.0 * d AS cut FROM p, (SELECT unnest(range(2, 30, 4)) AS d)),
b AS (SELECT c.viewer, cut, file_id, max(t) AS newest, md5(c.viewer || '|' || round(cut)::BIGINT || '|' || file_id) AS random, round(sum(power(0.5, (cut - t) / 24)), 9) AS f1, round(sum(power(0.5, (cut - t) / 168)), 9) AS f7, round(sum(power(0.5, (cut - t) / 720)), 9) AS f30
  FROM c JOIN p ON p.viewer = c.viewer AND p.t < cut GROUP BY c.viewer, cut, file_id),
r AS (SELECT 'newest' AS config, viewer, cut, file_id, row_number() OVER (PARTITION BY viewer, cut ORDER BY newest DESC, file_id) AS position FROM b
  UNION ALL SELECT 'random', viewer, cut, file_id, row_number() OVER (PARTITION BY viewer, cut ORDER BY random DESC, file_id) FROM b
  UNION ALL SELECT 'fresh_1', viewer, cut, file_id, row_number() OVER (PARTITION BY viewer, cut ORDER BY f1 DESC, file_id) FROM b
  UNION ALL SELECT 'fresh_7', viewer, cut, file_id, row_number() OVER (PARTITION BY viewer, cut ORDER BY f7 DESC, file_id) FROM b
  UNION ALL SELECT 'fresh_30', viewer, cut, file_id, row_number() OVER (PARTITION BY viewer, cut ORDER BY f30 DESC, file_id) FROM b),
w AS (SELECT DISTINCT c.viewer, cut, file_id FROM c JOIN p ON p.viewer = c.viewer AND p.t >= cut AND p.t < cut + 48),
g AS (SELECT viewer, cut, count(*) AS targets FROM w GROUP BY ALL),
h AS (SELECT config, viewer, cut, count(*) FILTER (position <= 12) AS a, count(*) FILTER (position <= 40) AS b FROM w JOIN r USING (viewer, cut, file_id) GROUP BY ALL)
SELECT k.config, count(*) AS cuts, sum(targets)::BIGINT AS targets, round(avg(coalesce(a, 0) / targets), 6) AS recall_12, round(avg(coalesce(h.b, 0) / targets), 6) AS recall_40, round(avg((coalesce(h.b, 0) > 0)::INT), 6) AS hit_40
FROM g, (SELECT DISTINCT config FROM r) k LEFT JOIN h ON h.config = k.config AND h.viewer = g.viewer AND h.cut = g.cut GROUP BY k.config""")
def replay_configs(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of what viewers played before, replayed at cuts four days apart: the newest first, at random, and by freshness of three half-lives."""
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9 - 473352
    plays = T.plays(spark, sf).select("viewer", "file_id", t.alias("t"))
    cuts = plays.select("viewer").distinct().select("viewer", F.explode(F.array(*[F.lit(24.0 * d) for d in range(2, 30, 4)])).alias("cut"))
    found = O.replay_report(plays, cuts, O.rankings(plays, cuts, [1, 7, 30]), 48.0)
    return found.select("config", "cuts", "targets", F.round("recall_a", 6).alias("recall_12"), F.round("recall_b", 6).alias("recall_40"), F.round("hit", 6).alias("hit_40"))
