"""Queries of the smaller operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import library as O
from ..sources import tables as T
from ..sources.scratch import kept
from . import Registry
from . import keyword as K

register = Registry()


@register(K.IDF + """, b AS (SELECT id, any_value(drive) AS drive, list(term ORDER BY rank) AS bag FROM top_ WHERE rank <= 20 GROUP BY id),
p AS (SELECT a.id AS a, b.id AS b, list_filter(a.bag, lambda x: list_contains(b.bag, x)) AS shared FROM b a JOIN b ON a.drive = b.drive AND a.id <> b.id WHERE a.id % 50 = 0)
SELECT a, b, array_to_string(shared[1:10], ' ') AS shared FROM p WHERE len(shared) > 0""")
def shared_keywords(spark: SparkSession, sf: str) -> DataFrame:
    """Keywords that every fiftieth document shares with the others of its drive."""
    top = kept(K._heaviest(spark, sf, 20).select("id", F.col("drive").alias("group"), "term", "rank", F.col("weight").alias("own"), "weight"), "heaviest")
    return O.sharing(top, F.col("id") % 50 == 0)


@register("""WITH s AS (SELECT DISTINCT conv_id AS id FROM conversations WHERE role = 'system'), d AS (SELECT doc_id AS id FROM documents WHERE lang = 'fr'), l AS (SELECT doc_id AS id FROM labels)
SELECT id FROM s UNION SELECT id FROM d WHERE id IN (SELECT id FROM l)""")
def scope_members(spark: SparkSession, sf: str) -> DataFrame:
    base = T.chunks(spark, sf).where("speaker = 'system'").select(F.col("file_id").alias("id"))
    extra = T.files(spark, sf).where("lang = 'fr'").select(F.col("file_id").alias("id"))
    return O.scope(base, extra, T.table(spark, sf, "labels").select(F.col("doc_id").alias("id")))


@register("""WITH t AS (SELECT doc_id AS id, lower(text) AS x FROM documents), h AS (SELECT id, unnest([{'at': instr(x, 'thing'), 's': -5, 't': 'thing'}, {'at': instr(x, 'the'), 's': -3, 't': 'the'}, {'at': instr(x, 'th'), 's': -2, 't': 'th'}]) AS h FROM t)
SELECT id, arg_min(h.t, row(h."at", h.s)) AS term, min(h."at")::BIGINT AS place FROM h WHERE h."at" > 0 GROUP BY id""")
def first_hits(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.files(spark, sf).select(F.col("file_id").alias("id"), O.first_hit(F.col("text"), ["the", "thing", "th"]).alias("h")).where("h is not null")
    return rows.select("id", "h.term", F.col("h.at").cast("long").alias("place"))


@register("""WITH f AS (SELECT user_id AS viewer, (props->>'$.k')::BIGINT AS id, count(*) AS n, max(ts) AS last FROM events GROUP BY ALL),
p AS (SELECT viewer, id, row_number() OVER (PARTITION BY viewer ORDER BY n DESC, last DESC, id) AS position FROM f),
s AS (SELECT DISTINCT user_id AS viewer, (props->>'$.k')::BIGINT AS id FROM events WHERE event_type IN ('purchase', 'error')),
l AS (SELECT viewer, id, row_number() OVER (PARTITION BY viewer ORDER BY position) AS position FROM p WHERE (viewer, id) NOT IN (SELECT viewer, id FROM s))
SELECT viewer, id, position FROM l WHERE position BETWEEN 3 AND 12""")
def feed_page(spark: SparkSession, sf: str) -> DataFrame:
    plays = T.plays(spark, sf)
    ranked = plays.groupBy("viewer", F.col("file_id").alias("id")).agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    ranked = ranked.withColumn("position", F.row_number().over(Window.partitionBy("viewer").orderBy(F.desc("n"), F.desc("last"), F.asc("id"))))
    seen = plays.where("liked or dismissed").select("viewer", F.col("file_id").alias("id"))
    return O.serve(ranked.select("viewer", "id", "position"), seen, limit=10, offset=2).withColumn("position", F.col("position").cast("long"))


@register("""SELECT a.event_id FROM events a WHERE a.event_type = 'click' AND NOT EXISTS (SELECT 1 FROM events b WHERE b.event_type = 'view' AND b.user_id = a.user_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 3600000000)""")
def movable_frames(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.table(spark, sf, "events").select("event_id", "event_type", F.col("user_id").alias("file_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"))
    return O.movable(rows.where("event_type = 'click'"), rows.where("event_type = 'view'"), 3600.0).select("event_id")


@register("""WITH s AS (SELECT user_id AS file_id, epoch_us(ts) / 1e6 - epoch_us(TIMESTAMP '2024-01-01') / 1e6 AS a, value FROM events),
m AS (SELECT file_id, a + value / 2 AS mid, value, round((a + value / 2) / 86400)::BIGINT AS k FROM s)
SELECT file_id, k, round(mid, 3) AS place FROM m WHERE k >= 1 AND abs(mid - k * 86400) <= 7200 QUALIFY row_number() OVER (PARTITION BY file_id, k ORDER BY round(value, 6) DESC, mid) = 1""")
def audio_split_points(spark: SparkSession, sf: str) -> DataFrame:
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - F.unix_micros(F.lit("2024-01-01").cast("timestamp")) / 1e6
    rows = T.plays(spark, sf).select(F.col("viewer").alias("file_id"), start.alias("start"), (start + F.col("value")).alias("end"))
    return O.split_points(rows, 86400.0, 7200.0).select("file_id", "k", F.round("at", 3).alias("place"))


@register("""WITH a AS (SELECT conv_id, role, count(*) AS n FROM conversations WHERE turn % 2 = 0 OR turn % 2 = 1 GROUP BY ALL),
p AS (SELECT conv_id, 'h' || (turn // 2) AS speaker, role AS "is", count(*) AS n FROM conversations GROUP BY ALL)
SELECT conv_id AS file_id, speaker, "is" FROM p QUALIFY row_number() OVER (PARTITION BY conv_id, speaker ORDER BY n DESC, "is") = 1""")
def speaker_mapping(spark: SparkSession, sf: str) -> DataFrame:
    true = T.chunks(spark, sf).select("file_id", "speaker", "start", "end", "chunk")
    heard = true.select("file_id", F.concat(F.lit("h"), F.floor(F.col("chunk") / 2).cast("string")).alias("speaker"), (F.col("start") + 1).alias("start"), (F.col("end") - 1).alias("end"))
    return O.attribute_speakers(heard, true.drop("chunk"))


@register("""SELECT user_id, sha256(string_agg(event_id || ':' || event_type, '|' ORDER BY event_id)) AS fingerprint FROM events GROUP BY user_id""")
def fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return O.fingerprint(T.table(spark, sf, "events"), "user_id", "event_id", ["event_id", "event_type"])


@register("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
c AS (SELECT *, n <= 10 OR floor((i + 1) * 10 / n - 1e-9) > floor(i * 10 / n - 1e-9) AS keep FROM n) SELECT user_id, event_id FROM c WHERE keep""")
def thinned_frames(spark: SparkSession, sf: str) -> DataFrame:
    return O.thin(T.table(spark, sf, "events").select("user_id", "event_id"), "user_id", "event_id", 10)


@register("""SELECT d.doc_id AS id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id AND e.label * 400 = d.n_chars // 400 * 400)""")
def unchanged_skip(spark: SparkSession, sf: str) -> DataFrame:
    new = T.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), (F.floor(F.col("n_chars") / 400) * 400).cast("long").alias("n"))
    stored = T.vectors(spark, sf).select("id", (F.col("label") * 400).cast("long").alias("n"))
    return O.changed_only(new, stored, "id", ["n"]).select("id")


@register("""WITH c AS (SELECT l_orderkey AS answer, l_partkey AS file_id, l_suppkey AS location, l_linenumber AS position, l_discount * 20 AS relevance FROM lineitem),
r AS (SELECT DISTINCT l_orderkey AS answer, l_partkey AS file_id FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size > 10)
SELECT answer, file_id, location, position::BIGINT AS position, greatest(0, least(1, relevance))::DOUBLE AS relevance FROM c SEMI JOIN r USING (answer, file_id) QUALIFY row_number() OVER (PARTITION BY answer, file_id, location ORDER BY position) = 1""")
def citation_validation(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("answer"), F.col("l_partkey").alias("file_id"), F.col("l_suppkey").alias("location"), F.col("l_linenumber").cast("long").alias("position"), (F.col("l_discount") * 20).cast("double").alias("relevance"))
    got = rows.join(T.table(spark, sf, "part").where("p_size > 10").select(F.col("p_partkey").alias("file_id")), "file_id", "left_semi")
    return O.valid_citations(rows, got)


@register(K.WORDS.rstrip().rstrip(",") + " SELECT term, lower(strip_accents(term)) AS normal, count(*) AS files FROM tf GROUP BY term")
def normalised_tokens(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.files(spark, sf).select(F.col("file_id").alias("id"), F.explode(F.array_distinct(K._unicode_words(F.col("text")))).alias("term"))
    terms = rows.groupBy("term").agg(F.count("*").alias("files"))
    return terms.select("term", O.normalise_token("term").alias("normal"), "files")


@register("""WITH k AS (SELECT user_id, event_type, count(*) AS n, max(ts)::VARCHAR AS last FROM events GROUP BY user_id, event_type)
SELECT user_id, sha256('[' || string_agg('{"event_type":"' || event_type || '","n":' || n || ',"last":"' || last || '"}', ',' ORDER BY event_type) || ']') AS stamp FROM k GROUP BY user_id""")
def arrival_stamps(spark: SparkSession, sf: str) -> DataFrame:
    return O.arrival_stamp(T.table(spark, sf, "events"), "user_id", "event_type", "ts")


@register("""WITH f AS (SELECT DISTINCT user_id AS file_id, 10 * value AS ts FROM events), d AS (SELECT user_id AS file_id, 10 * max(value) + 30 AS duration FROM events GROUP BY user_id),
a AS (SELECT file_id, ts, false AS filled FROM f UNION ALL SELECT file_id, 0, true FROM d WHERE file_id NOT IN (SELECT file_id FROM f WHERE ts < 1)),
g AS (SELECT *, coalesce(lead(ts) OVER (PARTITION BY file_id ORDER BY ts), duration) - ts AS gap FROM a JOIN d USING (file_id)),
t AS (SELECT file_id, ts, filled FROM g UNION ALL SELECT file_id, ts + k * gap / ceil(gap / 7), true FROM (SELECT *, unnest(range(1, ceil(gap / 7)::BIGINT)) AS k FROM g WHERE gap > 7)),
n AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY file_id) AS n FROM t)
SELECT file_id, round(ts, 6) AS ts, filled FROM n WHERE n <= 40 OR (i * 40 + n - 1) // n * n < (i + 1) * 40""")
def filled_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Frames of users' events, filled up to one in seven seconds, of which forty are kept."""
    rows = T.table(spark, sf, "events").select(F.col("user_id").alias("file_id"), (10 * F.col("value")).alias("ts"))
    files = rows.groupBy("file_id").agg((F.max("ts") + 30).alias("duration"))
    return O.thin(O.fill_times(rows.distinct(), files, 7.0), "file_id", "ts", 40).withColumn("ts", F.round("ts", 6))
