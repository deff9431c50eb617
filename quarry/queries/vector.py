"""Vector search queries. Every fiftieth row of ``embeddings`` is a query, against all rows.

The test vectors are close to random, so that floors are lower than the defaults.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import scenes as S
from ..operators import vector as O
from ..sources import tables as T
from . import Registry

register = Registry()

FLOOR, MARGIN, GAP = 0.10, 0.15, 0.02

PAIRS = """
WITH rows_ AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label, ['metadata', 'text_content', 'clip'][label % 3 + 1] AS kind FROM embeddings),
q AS (SELECT * FROM rows_ WHERE id % 50 = 0),
pairs AS (SELECT q.id AS query_id, r.id, r.label, q.label AS qlabel, r.kind, q.kind AS qkind, list_inner_product(q.v, r.v) AS s FROM q, rows_ r),
top50 AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) <= 50)
"""


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = T.vectors(spark, sf)
    return rows.where("id % 50 = 0").withColumnRenamed("id", "query_id"), rows


def _top50(spark: SparkSession, sf: str) -> DataFrame:
    return O.neighbours(*_sides(spark, sf), k=50)


@register(PAIRS + "SELECT query_id, id, round(s, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM pairs) WHERE rank <= 10")
def knn_exact_topk(spark: SparkSession, sf: str) -> DataFrame:
    found = O.neighbours(*_sides(spark, sf), k=10)
    found = O.best(found, "query_id", [F.desc("score"), F.asc("id")], 10, rank="rank")
    return found.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@register(PAIRS + """SELECT query_id, id, round(s, 6) AS score FROM pairs WHERE kind = qkind AND id IN (SELECT doc_id FROM documents WHERE lang = 'en')
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) <= 10""")
def knn_by_type_scope(spark: SparkSession, sf: str) -> DataFrame:
    queries, rows = _sides(spark, sf)
    scope = T.files(spark, sf).where("lang = 'en'").select(F.col("file_id").alias("id"))
    found = O.neighbours(queries, rows.join(scope, "id", "left_semi"), k=10, same="kind")
    return found.withColumn("score", F.round("score", 6))


@register(PAIRS + f"""SELECT query_id, id, round(s, 6) AS score FROM (
SELECT *, max(s) OVER (PARTITION BY query_id) AS best FROM (
  SELECT *, max(s) OVER w - avg(s) OVER w AS gap, count(*) OVER w AS n, stddev_pop(s) OVER w / avg(s) OVER w AS cv, avg(s) OVER w AS m FROM top50 WINDOW w AS (PARTITION BY query_id))
WHERE gap >= {GAP} AND NOT (n >= 5 AND m > 0 AND cv < 0.01) AND kind <> 'clip' AND s >= {FLOOR}) WHERE s >= best - {MARGIN}""")
def text_channel_guards(spark: SparkSession, sf: str) -> DataFrame:
    found = _top50(spark, sf).join(T.vectors(spark, sf).select("id", "kind"), "id")
    found = O.guarded(found, FLOOR, GAP, MARGIN, allow=F.col("kind") != "clip")
    return found.select("query_id", "id", F.round("score", 6).alias("score"))


@register(PAIRS + f"""SELECT query_id, id, round(s, 6) AS score FROM (SELECT *, max(s) OVER (PARTITION BY query_id) AS best FROM top50
WHERE (kind = 'clip' AND s >= {FLOOR}) OR (kind = 'metadata' AND s >= {2 * FLOOR})) WHERE s >= best - {MARGIN}""")
def clip_channel(spark: SparkSession, sf: str) -> DataFrame:
    found = _top50(spark, sf).join(T.vectors(spark, sf).select("id", "kind"), "id")
    allow = ((F.col("kind") == "clip") & (F.col("score") >= FLOOR)) | ((F.col("kind") == "metadata") & (F.col("score") >= 2 * FLOOR))
    return O.guarded(found, FLOOR, None, MARGIN, flat=False, allow=allow).select("query_id", "id", F.round("score", 6).alias("score"))


@register(PAIRS + f"""SELECT query_id, label, round(max(s), 6) AS score FROM pairs WHERE s >= {FLOOR} GROUP BY query_id, label
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY max(s) DESC, label) <= 5""")
def image_ranking(spark: SparkSession, sf: str) -> DataFrame:
    found = O.neighbours(*_sides(spark, sf), k=5, floor=FLOOR, group="label")
    return found.select("query_id", F.col("id").alias("label"), F.round("score", 6).alias("score"))


@register(PAIRS + f""", near AS (SELECT *, max(s) OVER (PARTITION BY query_id) AS best FROM top50 WHERE s >= {FLOOR}),
kept AS (SELECT * FROM near WHERE s >= best - {MARGIN}),
top_files AS (SELECT query_id, label FROM kept GROUP BY query_id, label QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY max(s) DESC, label) <= 10)
SELECT query_id, label, id, round(s, 6) AS score FROM kept JOIN top_files USING (query_id, label)
QUALIFY row_number() OVER (PARTITION BY query_id, label ORDER BY s DESC, id) <= 3""")
def knn_topn_per_file(spark: SparkSession, sf: str) -> DataFrame:
    kept = O.guarded(_top50(spark, sf), FLOOR, None, MARGIN, flat=False).join(T.vectors(spark, sf).select("id", "label"), "id")
    top = O.best(kept.groupBy("query_id", "label").agg(F.max("score").alias("best")), "query_id", [F.desc("best"), F.asc("label")], 10)
    passages = kept.join(top.select("query_id", "label"), ["query_id", "label"])
    return O.best(passages, ["query_id", "label"], [F.desc("score"), F.asc("id")], 3).select("query_id", "label", "id", F.round("score", 6).alias("score"))


MEANS = """
WITH rows_ AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings),
places AS (SELECT label, unnest(v) AS x, unnest(range(len(v))) AS place FROM rows_),
pooled AS (SELECT label, place, avg(x) AS m, max(x) AS top FROM places GROUP BY ALL),
means AS (SELECT label, list(m / n ORDER BY place) AS v FROM (SELECT *, sqrt(sum(m * m) OVER (PARTITION BY label)) AS n FROM pooled) GROUP BY label),
pairs AS (SELECT means.label AS query_id, r.id, r.label, list_inner_product(means.v, r.v) AS s FROM means, rows_ r)
"""


def _means(spark: SparkSession, sf: str) -> DataFrame:
    return V.pool(T.vectors(spark, sf), "label", "vector").select(F.col("label").cast("long").alias("query_id"), "vector")


@register(MEANS + """, kept AS (SELECT * FROM pairs WHERE label <> query_id AND s >= 0.05 AND s < 0.999),
open_ AS (SELECT *, max(s) OVER w AS best, avg(s) OVER w AS m, count(*) OVER w AS n FROM kept WINDOW w AS (PARTITION BY query_id)),
near AS (SELECT * FROM open_ WHERE NOT (n >= 5 AND best < 0.85 AND best - m < 0.01) AND s >= best - 0.15),
last_ AS (SELECT *, count(*) OVER w AS n2, stddev_pop(s) OVER w / avg(s) OVER w AS cv, max(s) OVER w AS top FROM near WINDOW w AS (PARTITION BY query_id))
SELECT query_id::BIGINT AS query_id, id, round(s, 6) AS score FROM last_ WHERE NOT (n2 >= 5 AND top < 0.85 AND cv < 0.01)
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) <= 20""")
def similar_mean_vector(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.vectors(spark, sf)
    found = O.neighbours(_means(spark, sf), rows, floor=0.05).join(rows.select("id", "label"), "id").where("label <> query_id")
    found = O.similar_filters(found, floor=0.05, margin=0.15)
    return O.best(found, "query_id", [F.desc("score"), F.asc("id")], 20).select("query_id", "id", F.round("score", 6).alias("score"))


@register(MEANS + "SELECT label::BIGINT AS label, place::BIGINT AS place, round(top / sqrt(sum(top * top) OVER (PARTITION BY label)), 6) AS value FROM pooled")
def pool_max(spark: SparkSession, sf: str) -> DataFrame:
    pooled = V.pool(T.vectors(spark, sf), "label", "vector", "max")
    return pooled.select(F.col("label").cast("long").alias("label"), F.posexplode("vector").alias("place", "value")).select("label", F.col("place").cast("long").alias("place"), F.round("value", 6).alias("value"))


@register(PAIRS + """, a AS (SELECT query_id, id, s FROM pairs WHERE kind = 'text_content' AND s >= 0.15),
b AS (SELECT query_id, id, s FROM pairs WHERE s >= 0.2),
an AS (SELECT query_id, id, CASE WHEN max(s) OVER w > min(s) OVER w THEN (s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w) ELSE 1.0 END AS s FROM a WINDOW w AS (PARTITION BY query_id)),
bn AS (SELECT query_id, id, CASE WHEN max(s) OVER w > min(s) OVER w THEN (s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w) ELSE 1.0 END AS s FROM b WINDOW w AS (PARTITION BY query_id))
SELECT query_id, id, round(CASE WHEN an.s IS NOT NULL AND bn.s IS NOT NULL THEN 0.5 * an.s + 0.5 * bn.s ELSE 0.7 * coalesce(an.s, bn.s) END, 6) AS score,
CASE WHEN an.s IS NULL THEN 'right' WHEN bn.s IS NULL THEN 'left' ELSE 'both' END AS sources FROM an FULL JOIN bn USING (query_id, id)""")
def similar_merge_minmax(spark: SparkSession, sf: str) -> DataFrame:
    queries, rows = _sides(spark, sf)
    left = O.neighbours(queries, rows.where("kind = 'text_content'"), floor=0.15)
    merged = O.merge_similar(left, O.neighbours(queries, rows, floor=0.2))
    return merged.withColumn("score", F.round("score", 6))


@register(PAIRS + """, k20 AS (SELECT * FROM pairs WHERE id <> query_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) <= 20),
votes AS (SELECT query_id, label AS tag, sum(s) AS score, count(*) AS support FROM k20 GROUP BY ALL HAVING count(*) >= 2)
SELECT query_id, tag, round(score, 6) AS score, support FROM votes QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, tag) <= 3""")
def tag_knn_vote(spark: SparkSession, sf: str) -> DataFrame:
    queries, rows = _sides(spark, sf)
    found = O.neighbours(queries, rows, k=21).where("id <> query_id")
    found = O.best(found, "query_id", [F.desc("score"), F.asc("id")], 20)
    votes = O.tag_votes(found, rows.select("id", F.col("label").alias("tag")), k=3)
    return votes.withColumn("score", F.round("score", 6))


@register(MEANS + "SELECT query_id::BIGINT AS concept, count(*) AS frames, round(max(s), 6) AS top, round(count(*) * max(s), 6) AS weight FROM pairs WHERE s >= 0.2 GROUP BY 1")
def concept_scores(spark: SparkSession, sf: str) -> DataFrame:
    found = O.concept_scores(O.neighbours(_means(spark, sf), T.vectors(spark, sf), floor=0.2))
    return found.select("concept", "frames", F.round("top", 6).alias("top"), F.round("weight", 6).alias("weight"))


@register("""WITH hits AS (SELECT user_id AS file_id, epoch(ts) AS ts, value AS score FROM events),
flagged AS (SELECT *, lead(ts) OVER w AS nxt, CASE WHEN ts - lag(ts) OVER w <= 14400 THEN 0 ELSE 1 END AS f FROM hits WINDOW w AS (PARTITION BY file_id ORDER BY ts, score)),
runs AS (SELECT *, sum(f) OVER (PARTITION BY file_id ORDER BY ts, score ROWS UNBOUNDED PRECEDING) AS run FROM flagged),
gr AS (SELECT file_id, run, min(ts) AS start, max(ts) AS last, max(score) AS peak, count(*) AS hits FROM runs GROUP BY ALL),
seg AS (SELECT file_id, run, start, peak, hits, least(last + 30, coalesce((SELECT min(h.ts) FROM hits h WHERE h.file_id = gr.file_id AND h.ts > gr.last), last + 30), CASE WHEN (file_id * 17777 + 1704067200) > last THEN file_id * 17777 + 1704067200 ELSE last + 30 END) AS "end" FROM gr),
withpeak AS (SELECT seg.*, (SELECT min(r.ts) FROM runs r WHERE r.file_id = seg.file_id AND r.run = seg.run AND r.score = seg.peak) AS peak_ts FROM seg)
SELECT file_id, round(start, 3) AS start, round("end", 3) AS "end", round(peak, 6) AS peak, round(peak_ts, 3) AS peak_ts, hits FROM withpeak
QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY peak DESC, start) <= 2""")
def scene_segments(spark: SparkSession, sf: str) -> DataFrame:
    hits = T.plays(spark, sf).select(F.col("viewer").alias("file_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), F.col("value").alias("score"))
    durations = hits.select("file_id", (F.col("file_id") * 17777 + 1704067200).cast("double").alias("duration")).distinct()
    found = O.segments(hits, gap=14400.0, durations=durations)
    return found.select("file_id", *[F.round(c, 3).alias(c) for c in ("start", "end")], F.round("peak", 6).alias("peak"), F.round("peak_ts", 3).alias("peak_ts"), "hits")


@register(PAIRS + "SELECT query_id, id, round(1 - power(sqrt(2 - 2 * s), 2) / 2, 6) AS score FROM pairs WHERE id <> query_id AND s < 1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) <= 5")
def image_to_image(spark: SparkSession, sf: str) -> DataFrame:
    found = O.neighbours(*_sides(spark, sf), k=6).where("id <> query_id")
    found = O.best(found, "query_id", [F.desc("score"), F.asc("id")], 5)
    return found.withColumn("score", F.round(V.l2_to_cosine(F.sqrt(2 - 2 * F.col("score"))), 6))


def _films(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Of every fifty vectors, 36 are a film's frames seven seconds apart, every fourth a changed one, and 14 its transcript's chunks."""
    rows = T.vectors(spark, sf).select(F.floor(F.col("id") / 50).alias("file_id"), (F.col("id") % 50).alias("n"), F.col("id"), "vector")
    frames = rows.where("n < 36").select("file_id", F.col("id").alias("frame_id"), (F.col("n") * 7.0).alias("ts"), (F.col("n") % 4 == 3).alias("changed"), "vector")
    said = rows.where("n >= 36").select("file_id", ((F.col("n") - 36) * 18.0 + 1).alias("ts"), "id", "vector")
    return frames, said


@register("""WITH e AS (SELECT vec_id // 50 AS file_id, vec_id % 50 AS n, vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
fr AS (SELECT file_id, n * 7.0::DOUBLE AS ts, id, v FROM e WHERE n < 36), en AS (SELECT file_id, 0.0 AS lo, max(ts) + 1 AS hi FROM fr GROUP BY file_id),
tx AS (SELECT e.file_id, (n - 36) * 18.0::DOUBLE + 1 AS ts, id, v FROM e JOIN en USING (file_id) WHERE n >= 36 AND (n - 36) * 18.0 + 1 < hi),
al AS (SELECT 'p' AS s, 2 AS m, * FROM fr UNION ALL SELECT 't', 3, * FROM tx),
nu AS (SELECT *, row_number() OVER (PARTITION BY s, file_id ORDER BY ts, id) AS r, count(*) OVER (PARTITION BY s, file_id) AS c FROM al),
el AS (SELECT a.s, a.file_id, a.ts, a.id, i, sum(CASE WHEN b.r < a.r THEN b.v[i] END) AS x, sum(CASE WHEN b.r >= a.r THEN b.v[i] END) AS y FROM nu a JOIN nu b ON a.s = b.s AND a.file_id = b.file_id AND b.r BETWEEN a.r - a.m AND a.r + a.m - 1, LATERAL (SELECT unnest(range(1, 65)) AS i)
  WHERE a.r > 1 AND (a.s = 'p' OR a.c > 6) GROUP BY ALL),
sc AS (SELECT s, file_id, ts, id, round(1 - sum(x * y) / sqrt(sum(x * x) * sum(y * y)), 9) AS score FROM el GROUP BY s, file_id, ts, id),
rk AS (SELECT *, row_number() OVER (PARTITION BY s, file_id ORDER BY score, ts, id) / count(*) OVER (PARTITION BY s, file_id) AS rank FROM sc),
jo AS (SELECT t.file_id, t.id, t.rank, p.id AS pid FROM rk t JOIN rk p ON t.s = 't' AND p.s = 'p' AND p.file_id = t.file_id AND t.rank >= 0.7 AND p.rank >= 0.8 AND abs(p.ts - t.ts) <= 5 QUALIFY row_number() OVER (PARTITION BY t.file_id, t.id ORDER BY p.rank DESC, p.ts) = 1),
ga AS (SELECT file_id, pid, max(rank) AS topic FROM jo GROUP BY ALL),
bo AS (SELECT p.file_id, p.ts AS time, CASE WHEN topic IS NULL THEN 'visual' ELSE 'visual_topic' END AS kind, CASE WHEN topic IS NULL THEN rank ELSE greatest(rank, topic) + 0.25 END AS score, coalesce(topic, 0) AS strength FROM rk p LEFT JOIN ga ON ga.file_id = p.file_id AND ga.pid = p.id WHERE s = 'p'
  UNION ALL SELECT t.file_id, t.ts, 'topic', rank, rank FROM rk t WHERE s = 't' AND NOT EXISTS (SELECT 1 FROM jo WHERE jo.file_id = t.file_id AND jo.id = t.id))
SELECT file_id, time, kind, round(CASE WHEN time - lo < greatest(20, 0.03 * (hi - lo)) OR hi - time < greatest(30, 0.06 * (hi - lo)) THEN score * 0.3 ELSE score END, 8) AS score, round(strength, 8) AS strength FROM bo JOIN en USING (file_id)""")
def scene_boundaries(spark: SparkSession, sf: str) -> DataFrame:
    """Boundaries of films by pictures and by topics, where all frames count."""
    frames, said = _films(spark, sf)
    pool = frames.select("file_id", "ts", F.col("frame_id").alias("id"), "vector")
    found = S.boundaries(pool, said, S.spans(pool))
    return found.select("file_id", "time", "kind", F.round("score", 8).alias("score"), F.round("strength", 8).alias("strength"))


@register()
def scene_selection(spark: SparkSession, sf: str) -> DataFrame:
    """Scenes of films with a frame each."""
    found = S.select_scenes(*_films(spark, sf))
    return found.select("file_id", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "frame_id", "kind", "asked")
