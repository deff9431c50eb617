"""Rank and score fusion, grouping, budgets and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fusion as O
from ..operators import vector as VO
from ..sources import tables as T
from . import Registry
from . import keyword as K
from . import vector as V

register = Registry()

# Channels of every fiftieth id: nearest vectors, and documents of similar terms.
CHANNELS = V.PAIRS + ", " + K.IDF.strip().removeprefix("WITH ") + """,
t AS (SELECT * FROM top_ WHERE rank <= 10), sz AS (SELECT id, sqrt(sum(weight * weight)) AS s FROM t GROUP BY id),
u AS (SELECT t.id, drive, term, weight / s AS x FROM t JOIN sz USING (id)),
p AS (SELECT a.id AS query_id, b.id AS id, sum(a.x * b.x) AS score FROM u a JOIN u b USING (drive, term) WHERE a.id % 50 = 0 AND a.id <> b.id GROUP BY ALL),
kw AS (SELECT query_id, id, round(score, 6) AS score FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) <= 10),
vec AS (SELECT query_id, id, kind, round(s, 6) AS score FROM top50),
ch AS (SELECT 'vector' AS channel, query_id, id, score FROM vec UNION ALL SELECT 'keyword', query_id, id, score FROM kw),
rk AS (SELECT *, row_number() OVER (PARTITION BY channel, query_id ORDER BY greatest(score, 0) DESC, id) - 1 AS rank FROM ch),
rrf AS (SELECT query_id, id, sum(CASE channel WHEN 'keyword' THEN 1.5 ELSE 1.0 END / (60 + rank + 1)) AS score FROM rk GROUP BY query_id, id)
"""


def _channels(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    vector = V._top50(spark, sf).withColumn("score", F.round("score", 6)).join(T.vectors(spark, sf).select("id", "kind"), "id")
    keyword = K.tfidf_similar(spark, sf).select(F.col("a").alias("query_id"), F.col("b").alias("id"), "score")
    return vector, keyword


@register(CHANNELS + """SELECT query_id, id, round(score, 9) AS score FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM rrf) WHERE score >= 0.5 * top
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) <= 20""")
def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    vector, keyword = _channels(spark, sf)
    name = lambda df, n: df.select(F.lit(n).alias("channel"), "query_id", "id", "score")
    fused = O.rrf(name(vector, "vector").unionByName(name(keyword, "keyword")), {"keyword": 1.5})
    return O.cut_off(fused).withColumn("score", F.round("score", 9))


@register(CHANNELS + """, v AS (SELECT query_id, id, max(score * CASE kind WHEN 'metadata' THEN 1.3 WHEN 'text_content' THEN 0.9 ELSE 1.0 END) AS v FROM vec GROUP BY query_id, id),
f AS (SELECT query_id, id, 0.7 * coalesce(v, 0) + (1 - 0.7) * coalesce(kw.score, 0) AS score FROM v FULL JOIN kw USING (query_id, id))
SELECT query_id, id, round(score, 8) AS score FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM f) WHERE score >= 0.5 * top
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) <= 20""")
def cosine_fusion_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    return O.cut_off(O.cosine_fusion(*_channels(spark, sf))).withColumn("score", F.round("score", 8))


@register(CHANNELS + """, c AS (SELECT query_id, channel AS source, count(*) AS files, round(max(score), 6) AS top FROM ch GROUP BY 1, 2)
SELECT query_id, source, files, top FROM c UNION ALL SELECT query_id, 'rrf', count(*), round(max(score), 6) FROM rrf GROUP BY query_id""")
def compare_sources(spark: SparkSession, sf: str) -> DataFrame:
    vector, keyword = _channels(spark, sf)
    name = lambda df, n: df.select(F.lit(n).alias("channel"), "query_id", "id", "score")
    channels = name(vector, "vector").unionByName(name(keyword, "keyword"))
    counted = lambda df: df.groupBy("query_id", "source").agg(F.count("*").alias("files"), F.round(F.max("score"), 6).alias("top"))
    return counted(channels.withColumnRenamed("channel", "source")).unionByName(counted(O.rrf(channels, {"keyword": 1.5}).withColumn("source", F.lit("rrf"))))


@register("""WITH s AS (SELECT user_id AS file_id, epoch_us(ts) / 1e6 AS start, epoch_us(ts) / 1e6 + 60 * value AS "end" FROM events),
f AS (SELECT *, CASE WHEN start > max("end") OVER (PARTITION BY file_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1800 THEN 1 ELSE 0 END AS n FROM s),
g AS (SELECT *, sum(n) OVER (PARTITION BY file_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS grp FROM f)
SELECT file_id, round(min(start), 3) AS start, round(max("end"), 3) AS "end", count(*) AS n FROM g GROUP BY file_id, grp""")
def segment_groups(spark: SparkSession, sf: str) -> DataFrame:
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    spans = T.plays(spark, sf).select(F.col("viewer").alias("file_id"), start.alias("start"), (start + 60 * F.col("value")).alias("end"))
    return O.group_spans(spans, "file_id", 1800.0).withColumns({c: F.round(c, 3) for c in ("start", "end")})


@register("""WITH c AS (SELECT conv_id AS file_id, turn AS chunk, role, 10.0::DOUBLE * turn AS start, 10.0::DOUBLE * turn + 10 AS "end", text FROM conversations)
SELECT a.file_id, a.chunk AS span_id, b.chunk, abs(a.chunk - b.chunk) <= 1 AS neighbour FROM c a JOIN c b USING (file_id) WHERE a.role = 'user' AND b.start <= a."end" + 15 AND b."end" >= a.start - 15""")
def context_window_join(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.chunks(spark, sf)
    spans = rows.where("speaker = 'user'").select("file_id", F.col("chunk").alias("span_id"), F.col("start").alias("at"), F.col("end").alias("until"))
    found = O.around(rows.select("file_id", "chunk", "start", "end"), spans, "file_id", 15.0)
    return found.select("file_id", "span_id", "chunk", (F.abs(F.col("span_id") - F.col("chunk")) <= 1).alias("neighbour"))


@register("""WITH l AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents),
u AS (SELECT *, sum(length(line)) OVER (PARTITION BY id ORDER BY n ROWS UNBOUNDED PRECEDING) AS used FROM l)
SELECT id, n, used::BIGINT AS used FROM u WHERE used <= 3500 OR n = 0""")
def budget_cut(spark: SparkSession, sf: str) -> DataFrame:
    lines = T.files(spark, sf).select(F.col("file_id").alias("id"), F.posexplode(F.split("text", "\n")).alias("n", "line"))
    kept = O.within_budget(lines.withColumn("size", F.length("line")), "id", [F.asc("n")], "size", 3500, keep_first=True)
    return kept.select("id", F.col("n").cast("long").alias("n"), "used")


@register("""WITH u AS (SELECT conv_id AS conv, turn, text, sum(length(text)) OVER w AS used, row_number() OVER w AS rn FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING))
SELECT conv, turn, CASE WHEN used > 600 THEN substring(text, 1, 600) ELSE text END AS text FROM u WHERE used <= 600 OR rn = 1""")
def history_trim(spark: SparkSession, sf: str) -> DataFrame:
    return O.trim_history(T.chunks(spark, sf).select(F.col("file_id").alias("conv"), F.col("chunk").alias("turn"), "text"), 1200)


@register("""WITH u AS (SELECT conv_id, turn, length(text) AS n, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM conversations)
SELECT conv_id, turn, (before // 1000)::BIGINT AS page, (before % 1000)::BIGINT AS "offset" FROM u""")
def page_units(spark: SparkSession, sf: str) -> DataFrame:
    units = T.chunks(spark, sf).select(F.col("file_id").alias("conv_id"), F.col("chunk").alias("turn"), F.length("text").alias("n"))
    return O.pages(units, "conv_id", "turn", "n", 1000).drop("n")


@register("""WITH c AS (SELECT conv_id, turn, 10.0 * turn AS start, 10.0 * turn + 10 AS "end", text FROM conversations),
s AS (SELECT DISTINCT conv_id, turn // 3 AS section, 30.0 * (turn // 3) + 5 AS lo, 30.0 * (turn // 3) + 25 AS hi FROM conversations)
SELECT conv_id, section::BIGINT AS section, string_agg(text, chr(10) ORDER BY start) AS text FROM c JOIN s USING (conv_id) WHERE start < hi AND "end" > lo GROUP BY conv_id, section""")
def section_excerpt(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.chunks(spark, sf).withColumnRenamed("file_id", "conv_id")
    section = F.floor(F.col("chunk") / 3)
    sections = rows.select("conv_id", section.alias("section"), (30 * section + 5).alias("lo"), (30 * section + 25).alias("hi")).distinct()
    return O.excerpt_rows(rows.select("conv_id", "start", "end", "text"), sections, "conv_id")


def _passages(spark: SparkSession, sf: str) -> DataFrame:
    found = VO.best(V._top50(spark, sf), "query_id", [F.desc("score"), F.asc("id")], 20)
    return found.join(T.files(spark, sf).select(F.col("file_id").alias("id"), "text"), "id")


SHINGLED = V.PAIRS + """, t20 AS (SELECT query_id, id, s FROM top50 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) <= 20),
d AS (SELECT doc_id AS id, lower(text) AS x FROM documents), ids AS (SELECT DISTINCT id FROM t20),
sh AS (SELECT DISTINCT id, substring(x, unnest(range(1, length(x) - 3)), 5) AS g FROM d JOIN ids USING (id)),
n AS (SELECT id, count(*) AS n FROM sh GROUP BY id),
pr AS (SELECT a.query_id, a.id AS a, b.id AS b FROM t20 a JOIN t20 b ON a.query_id = b.query_id AND a.id < b.id),
ov AS (SELECT pr.query_id, pr.a, pr.b, count(*) AS both_ FROM pr JOIN sh x ON x.id = pr.a JOIN sh y ON y.id = pr.b AND x.g = y.g GROUP BY ALL)
SELECT query_id, a, b, round(both_ / (na.n + nb.n - both_), 6) AS jaccard FROM ov JOIN n na ON na.id = a JOIN n nb ON nb.id = b"""


@register(SHINGLED)
def near_dup_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return O.passage_overlap(_passages(spark, sf)).withColumn("jaccard", F.round("jaccard", 6))


@register(SHINGLED.strip().replace("WITH", "WITH RECURSIVE", 1).rpartition("SELECT query_id, a, b, round(")[0].rstrip() + """,
cl AS (SELECT query_id, a, b FROM ov JOIN n na ON na.id = a JOIN n nb ON nb.id = b WHERE both_ / (na.n + nb.n - both_) >= 0.6),
nb AS (SELECT query_id, id, list(y) AS ys FROM (SELECT query_id, a AS id, b AS y FROM cl UNION ALL SELECT query_id, b, a FROM cl) GROUP BY query_id, id),
o AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS r FROM t20 JOIN d USING (id)),
acc AS (SELECT DISTINCT query_id, 0::BIGINT AS r, []::BIGINT[] AS taken FROM o
 UNION ALL SELECT a.query_id, o.r, CASE WHEN list_has_any(a.taken, coalesce(nb.ys, []::BIGINT[])) THEN a.taken ELSE list_append(a.taken, o.id) END FROM acc a JOIN o ON o.query_id = a.query_id AND o.r = a.r + 1 LEFT JOIN nb ON nb.query_id = o.query_id AND nb.id = o.id)
SELECT query_id, unnest(taken) AS id FROM (SELECT * FROM acc QUALIFY r = max(r) OVER (PARTITION BY query_id))""")
def near_dup_accepted(spark: SparkSession, sf: str) -> DataFrame:
    rows = _passages(spark, sf)
    return O.accept_distinct(rows, O.passage_overlap(rows))


@register("""WITH c AS (SELECT doc_id AS id, CASE WHEN quality = 1 THEN 'Good' ELSE 'Poor' END AS tag, 2 AS priority, 0 AS position FROM labels
UNION ALL SELECT vec_id, 'label' || label, 0, 0 FROM embeddings UNION ALL SELECT doc_id, lang, 1, 0 FROM documents UNION ALL SELECT doc_id, upper(lang), 2, 1 FROM documents),
h AS (SELECT doc_id AS id, 'POOR' AS tag FROM labels WHERE toxic = 1),
o AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY id, lower(tag) ORDER BY priority, position, tag) = 1)
SELECT id, tag, row_number() OVER (PARTITION BY id ORDER BY priority, position, lower(tag)) AS rank FROM o WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.id = o.id AND lower(h.tag) = lower(o.tag)) QUALIFY rank <= 3""")
def tag_merge_priority(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = T.files(spark, sf), T.table(spark, sf, "labels")
    row = lambda df, i, tag, p, pos: df.select(F.col(i).alias("id"), tag.alias("tag"), F.lit(p).alias("priority"), F.lit(pos).alias("position"))
    tags = row(labels, "doc_id", F.when(F.col("quality") == 1, "Good").otherwise("Poor"), 2, 0)
    tags = tags.unionByName(row(T.vectors(spark, sf), "id", F.concat(F.lit("label"), "label"), 0, 0))
    tags = tags.unionByName(row(docs, "file_id", F.col("lang"), 1, 0)).unionByName(row(docs, "file_id", F.upper("lang"), 2, 1))
    have = labels.where("toxic = 1").select(F.col("doc_id").alias("id"), F.lit("POOR").alias("tag"))
    return O.merge_tags(tags, have, 3).withColumn("rank", F.col("rank").cast("long"))


@register("""WITH RECURSIVE o AS (SELECT conv_id, turn AS chunk, length(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY len(string_split(text, ' ')) DESC, turn) AS r FROM conversations),
acc AS (SELECT DISTINCT conv_id, 0::BIGINT AS r, 1000::BIGINT AS room, []::BIGINT[] AS taken FROM o
 UNION ALL SELECT a.conv_id, o.r, CASE WHEN o.size <= room THEN room - o.size ELSE room END, CASE WHEN o.size <= room THEN list_append(taken, o.chunk) ELSE taken END FROM acc a JOIN o ON o.conv_id = a.conv_id AND o.r = a.r + 1)
SELECT conv_id, unnest(taken) AS chunk FROM (SELECT * FROM acc QUALIFY r = max(r) OVER (PARTITION BY conv_id))""")
def material_fill(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.chunks(spark, sf).select(F.col("file_id").alias("conv_id"), "chunk", F.length("text").alias("size"), F.size(F.split("text", " ")).cast("double").alias("score"))
    return O.skip_fill(rows, "conv_id", 1000)
