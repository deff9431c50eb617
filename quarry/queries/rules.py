"""Queries of filters, fallbacks, records and evaluation rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import feed as FO
from ..operators import filters as O
from ..operators import keyword as KO
from ..operators import library as L
from ..operators import metrics as M
from ..operators import operations as OP
from ..operators import vector as VO
from ..sources import tables as T
from ..sources.scratch import kept
from . import Registry, feed
from . import keyword as K

register = Registry()


@register("""SELECT doc_id AS id FROM documents WHERE n_chars >= 200 AND n_chars < 2500 AND n_chars IS NOT NULL AND source IN ('src1', 'src2', 'src3', 'src10')
UNION ALL SELECT doc_id FROM documents WHERE lang = 'fr' AND n_chars > 400 AND lower(format('doc_{}.md', doc_id)) LIKE '%7.md'""")
def filtered_files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of some drives by size, and French ones whose file name has a suffix."""
    files = T.files(spark, sf)
    by_folder = files.where(O.folders(F.col("drive"), ["src1", "/src2/", "src3", "src10"]) & O.comparisons(F.col("n_chars"), ["gte:200", "lt:2500", "gte:200"]))
    by_kind = files.where((F.col("lang") == "fr") & O.comparisons(F.col("n_chars"), ["gt:400"]) & O.kind("markdown", F.lit("document"), F.lit(None).cast("string"), F.col("filename"), ["text/markdown"], ["7.md"]))
    return by_folder.select(F.col("file_id").alias("id")).unionAll(by_kind.select(F.col("file_id").alias("id")))


TERMS = [("password", ["passwd", "pass word"]), ("thing", []), ("qqzz", ["zzqq"])]


@register("""WITH d AS (SELECT doc_id AS id, contains(lower(text), 'password') OR contains(lower(text), 'passwd') OR contains(lower(text), 'pass word') AS p, contains(lower(text), 'thing') AS t, contains(lower(text), 'qqzz') OR contains(lower(text), 'zzqq') AS q FROM documents),
l AS (SELECT id, unnest([CASE WHEN p AND t AND q THEN 0 END, CASE WHEN t AND q THEN 1 END, CASE WHEN t THEN 2 END, 3]) AS level FROM d)
SELECT id, level::BIGINT AS level FROM l WHERE level = (SELECT min(level) FROM l)""")
def fallback_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with all required terms or their aliases, or with the largest subset of the ladder that finds any."""
    low, aliases = F.lower("text"), {t: [t, *more] for t, more in TERMS}
    has = {t: F.greatest(*[F.contains(low, F.lit(x)) for x in names], F.lit(False)) for t, names in aliases.items()}
    rungs = [list(has), *O.fallback_ladder(TERMS)]
    level = F.coalesce(*[F.when(F.least(F.lit(True), *[has[t] for t in rung], F.lit(True)), F.lit(i)) for i, rung in enumerate(rungs)])
    rows = T.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), level.cast("long").alias("level"))
    return rows.join(F.broadcast(rows.agg(F.min("level").alias("level"))), "level").select("id", "level")


@register("""WITH t AS (SELECT item_id, unnest(regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?[一-龥ァ-ヴー%]|[一-龥々]+|[ァ-ヴー]+|[A-Za-z][A-Za-z0-9]+|[0-9]+(?:\\.[0-9]+)?')) AS w, generate_subscripts(regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?[一-龥ァ-ヴー%]|[一-龥々]+|[ァ-ヴー]+|[A-Za-z][A-Za-z0-9]+|[0-9]+(?:\\.[0-9]+)?'), 1) AS n FROM benchmark),
f AS (SELECT item_id, w, min(n) AS n FROM t WHERE length(w) >= 2 GROUP BY item_id, w QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY min(n)) <= 20)
SELECT item_id, string_agg(w, ' ' ORDER BY n) AS tokens FROM f GROUP BY item_id""")
def salient_parts(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.table(spark, sf, "benchmark").select("item_id", X.salient_tokens(F.col("text")).alias("t"))
    return rows.where(F.size("t") > 0).select("item_id", F.array_join("t", " ").alias("tokens"))


@register("SELECT user_id, count(value) AS runs, round(median(value), 6) AS median, round(min(value), 6) AS least, round(max(value), 6) AS most, max(value) - min(value) > 100 AS unstable FROM events GROUP BY user_id")
def spread_of_runs(spark: SparkSession, sf: str) -> DataFrame:
    found = M.spread_of_runs(T.table(spark, sf, "events"), "user_id", "value", 100.0)
    return found.select("user_id", "runs", *[F.round(c, 6).alias(c) for c in ("median", "least", "most")], "unstable")


@register("""WITH a AS (SELECT user_id, avg(value) FILTER (ts < TIMESTAMP '2024-01-15') AS b, avg(value) FILTER (ts >= TIMESTAMP '2024-01-15') AS c FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN abs(c - b) <= 1 THEN 'tied' WHEN c < b THEN 'improved' ELSE 'regressed' END AS verdict FROM a WHERE b IS NOT NULL AND c IS NOT NULL""")
def compared_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's mean value after the middle of the month against that before it; lower is better."""
    early = F.col("ts") < F.lit("2024-01-15 00:00:00").cast("timestamp")
    means = T.table(spark, sf, "events").groupBy("user_id").agg(F.avg(F.when(early, F.col("value"))).alias("b"), F.avg(F.when(~early, F.col("value"))).alias("c"))
    means = means.where("b is not null and c is not null")
    return means.select("user_id", M.compared(F.col("b"), F.col("c"), 1.0, lower_is_better=True).alias("verdict"))


@register("""SELECT doc_id AS id, round((contains(lower(text), 'thing')::INT + contains(lower(text), 'nation')::INT + contains(lower(text), 'éau')::INT) / 3, 6) AS coverage, (contains(lower(text), 'password')::INT + contains(lower(text), '@')::INT)::BIGINT AS violations FROM documents""")
def mention_coverage(spark: SparkSession, sf: str) -> DataFrame:
    share, bad = M.mentions(F.col("text"), ["THING", "nation", "Éau"], ["password", "@"], lambda c: X.to_katakana(X.folded(c)))
    return T.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.round(share, 6).alias("coverage"), bad.alias("violations"))


@register("""WITH g AS (SELECT doc_id FROM labels WHERE toxic = 1)
SELECT 'conversations' AS name, conv_id AS file_id, count(*) AS n FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM g) GROUP BY conv_id
UNION ALL SELECT 'embeddings', vec_id, 1 FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM g) UNION ALL SELECT 'files', doc_id, 1 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM g)""")
def purged_rows(spark: SparkSession, sf: str) -> DataFrame:
    """What is left of all tables after the toxic files are purged."""
    tables = {"files": T.files(spark, sf), "conversations": T.chunks(spark, sf), "embeddings": T.vectors(spark, sf).withColumnRenamed("id", "file_id")}
    left = OP.purge(tables, T.table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("file_id")))
    counts = [rows.groupBy("file_id").agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "file_id", "n") for name, rows in left.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@register("SELECT conv_id AS item, arg_min(text, turn) AS original, arg_max(text, turn) AS current, count(*) - 1 AS generation FROM conversations GROUP BY conv_id")
def corrected_items(spark: SparkSession, sf: str) -> DataFrame:
    return OP.corrected(T.chunks(spark, sf).select(F.col("file_id").alias("item"), F.col("chunk").alias("version"), F.col("text").alias("value")))


@register(r"""WITH e AS (SELECT event_id AS id, concat('call ', event_id, ' Authorization: Bearer tok.', event_id, ' and bearer abcdefgh', user_id, ' API_KEY = k', user_id, ' sk-secretkey', event_id, ' in /app/a b/app/x/y/f', user_id, '.py ', repeat('z', (event_id % 300)::INT)) AS t FROM events),
a AS (SELECT id, regexp_replace(t, '(?i)authorization\s*[:=]\s*bearer\s+[A-Za-z0-9._-]+', '[REDACTED]', 'g') AS t FROM e), b AS (SELECT id, regexp_replace(t, '(?i)bearer\s+[A-Za-z0-9._-]{8,}', '[REDACTED]', 'g') AS t FROM a),
c AS (SELECT id, regexp_replace(regexp_replace(t, '(?i)api[_-]?key\s*[:=]\s*[A-Za-z0-9._-]+', '[REDACTED]', 'g'), '\bsk-[A-Za-z0-9_-]{8,}\b', '[REDACTED]', 'g') AS t FROM b), d AS (SELECT id, regexp_replace(t, '/app/[^\s''"]+/', '…/', 'g') AS t FROM c)
SELECT id, CASE WHEN length(t) <= 256 THEN t ELSE concat(substring(t, 1, 255), '…') END AS excerpt FROM d""")
def scrubbed_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Error texts made from events, without the credentials and paths in them."""
    e, u = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    parts = ["call ", e, " Authorization: Bearer tok.", e, " and bearer abcdefgh", u, " API_KEY = k", u, " sk-secretkey", e, " in /app/a b/app/x/y/f", u, ".py ", F.repeat(F.lit("z"), (F.col("event_id") % 300).cast("int"))]
    text = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return T.table(spark, sf, "events").select(F.col("event_id").alias("id"), OP.scrub(text).alias("excerpt"))


@register(feed.PLAYS + "SELECT viewer, file_id, round(engagement, 6) AS engagement FROM h WHERE engagement > 0 AND age BETWEEN -1 AND 14 QUALIFY row_number() OVER (PARTITION BY viewer ORDER BY age, file_id) <= 5")
def profile_history(spark: SparkSession, sf: str) -> DataFrame:
    return FO.profile_history(feed._history(spark, sf), window_days=14.0, most=5).select("viewer", "file_id", F.round("engagement", 6).alias("engagement"))


@register(feed.PLAYS + "SELECT viewer, lane AS cluster, round(weight, 6) AS weight, row_number() OVER (PARTITION BY viewer ORDER BY round(weight, 9) DESC, lane) AS position FROM lw")
def cluster_lanes(spark: SparkSession, sf: str) -> DataFrame:
    history = feed._history(spark, sf).withColumnRenamed("file_id", "id")
    labels = T.vectors(spark, sf).select("id", F.col("label").alias("cluster"))
    clusters = history.select("viewer", "id").join(labels, "id")
    return FO.cluster_lanes(history, clusters).select("viewer", "cluster", F.round("weight", 6).alias("weight"), F.col("position").cast("long").alias("position"))


@register("""WITH p AS (SELECT user_id AS viewer, (props->>'$.k')::BIGINT AS file_id, epoch_us(ts) / 3.6e9 - 473352 AS t FROM events),
c AS (SELECT DISTINCT viewer, 24.0 * d AS cut FROM p, (SELECT unnest(range(2, 30, 4)) AS d)),
r AS (SELECT c.viewer, cut, file_id, row_number() OVER (PARTITION BY c.viewer, cut ORDER BY max(t) DESC, file_id) AS position FROM c JOIN p ON p.viewer = c.viewer AND p.t < cut GROUP BY c.viewer, cut, file_id),
g AS (SELECT DISTINCT c.viewer, cut, file_id FROM c JOIN p ON p.viewer = c.viewer AND p.t >= cut AND p.t < cut + 48)
SELECT g.viewer, g.cut, count(*) AS targets, count(r.file_id) AS hits, round(count(r.file_id) / count(*), 6) AS recall, count(r.file_id) > 0 AS hit FROM g LEFT JOIN r ON r.viewer = g.viewer AND r.cut = g.cut AND r.file_id = g.file_id AND r.position <= 12 GROUP BY g.viewer, g.cut""")
def replay_newest(spark: SparkSession, sf: str) -> DataFrame:
    """The feed of what a viewer played last, replayed at cuts four days apart against the two days after each."""
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9 - 473352
    plays = T.plays(spark, sf).select("viewer", "file_id", t.alias("t"))
    cuts = plays.select("viewer").distinct().select("viewer", F.explode(F.array(*[F.lit(24.0 * d) for d in range(2, 30, 4)])).alias("cut"))
    last = plays.withColumn("cut", F.explode(F.filter(F.array(*[F.lit(24.0 * d) for d in range(2, 30, 4)]), lambda c: c > F.col("t")))).groupBy("viewer", "cut", "file_id").agg(F.max("t").alias("t"))
    order = Window.partitionBy("viewer", "cut").orderBy(F.desc("t"), F.asc("file_id"))
    return FO.replay(plays, cuts, last.withColumn("position", F.row_number().over(order)), 48.0, 12).withColumn("recall", F.round("recall", 6))


@register("""WITH h AS (SELECT user_id AS file_id, epoch(ts) AS ts, value AS score FROM events), n AS (SELECT count(*) AS n FROM h),
lowest AS (SELECT min(score) AS lowest FROM (SELECT score FROM h ORDER BY score DESC LIMIT (SELECT least(greatest(least(50, ceil(n / 10)), n // 100), 4096)::BIGINT FROM n))),
s0 AS (SELECT h.* FROM h, lowest WHERE score >= lowest), best AS (SELECT file_id FROM s0 GROUP BY file_id ORDER BY max(score) DESC, file_id LIMIT 30), s AS (SELECT * FROM s0 WHERE file_id IN (SELECT file_id FROM best)),
flagged AS (SELECT *, lead(ts) OVER w AS nxt, CASE WHEN ts - lag(ts) OVER w <= 14400 THEN 0 ELSE 1 END AS f FROM s WINDOW w AS (PARTITION BY file_id ORDER BY ts, score)),
runs AS (SELECT *, sum(f) OVER (PARTITION BY file_id ORDER BY ts, score ROWS UNBOUNDED PRECEDING) AS run FROM flagged),
gr AS (SELECT file_id, run, min(ts) AS start, max(ts) AS last, max(score) AS peak, count(*) AS hits FROM runs GROUP BY ALL),
seg AS (SELECT gr.file_id, run, start, peak, hits, least(last + 30, coalesce((SELECT min(h.ts) FROM h WHERE h.file_id = gr.file_id AND h.ts > gr.last), last + 30)) AS "end" FROM gr)
SELECT file_id, round(start, 3) AS start, round("end", 3) AS "end", round(peak, 6) AS peak, hits FROM seg QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY peak DESC, start) <= 2""")
def seeded_segments(spark: SparkSession, sf: str) -> DataFrame:
    hits = T.plays(spark, sf).select(F.col("viewer").alias("file_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), F.col("value").alias("score"))
    found = VO.seeded_segments(hits, gap=14400.0)
    return found.select("file_id", *[F.round(c, 3).alias(c) for c in ("start", "end")], F.round("peak", 6).alias("peak"), "hits")


@register(K.IDF + """, t AS (SELECT id, drive, term, weight, idf FROM top_ WHERE rank <= 20),
r AS (SELECT a.id AS a, b.id AS b, a.term, a.idf * a.weight * b.weight AS relevance FROM t a JOIN t b ON a.drive = b.drive AND a.term = b.term AND a.id <> b.id WHERE a.id % 50 = 0)
SELECT a, b, term, round(relevance, 6) AS relevance FROM r QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY round(relevance, 9) DESC, term) <= 10""")
def scored_shared_keywords(spark: SparkSession, sf: str) -> DataFrame:
    """Keywords that every fiftieth document shares with others of its drive, by idf and both weights."""
    top = K._heaviest(spark, sf, 20).select("id", F.col("drive").alias("group"), "term", "rank", (F.col("idf") * F.col("weight")).alias("own"), "weight")
    return L.sharing(kept(top, "heaviest"), F.col("id") % 50 == 0, joined=False, digits=6)


@register(r"""SELECT event_id AS id, p::BIGINT AS "at" FROM (SELECT event_id, concat('at 12:3', user_id % 10, ' or 1,500. 3. ', event_id, 'km') AS t FROM events), LATERAL (SELECT unnest(range(1, 24)) AS p)
WHERE p < length(t) AND ((regexp_matches(substring(t, 1, p), '[0-9]$') AND regexp_matches(substring(t, p + 1), '^([0-9]|[.,:][0-9])')) OR (regexp_matches(substring(t, 1, p), '[0-9][.,:] ?$') AND regexp_matches(substring(t, p + 1), '^[0-9]')))""")
def number_breaks(spark: SparkSession, sf: str) -> DataFrame:
    """Places of texts made from events where a line break would cut a number."""
    text = F.concat(F.lit("at 12:3"), (F.col("user_id") % 10).cast("string"), F.lit(" or 1,500. 3. "), F.col("event_id").cast("string"), F.lit("km"))
    rows = T.table(spark, sf, "events").select(F.col("event_id").alias("id"), text.alias("t")).withColumn("at", F.explode(F.sequence(F.lit(1), F.lit(23))))
    return rows.where(X.splits_number(F.col("t"), F.col("at"))).select("id", F.col("at").cast("long").alias("at"))


@register("SELECT vec_id AS id, CASE label % 4 WHEN 0 THEN 'clip_thumbnail' WHEN 1 THEN 'clip_thumbnail tfidf_keywords' WHEN 2 THEN 'text_content' ELSE 'metadata' END AS types FROM embeddings")
def types_by_kind(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("image", "video", "document", "other"))), (F.col("label") % 4 + 1).cast("int"))
    return T.vectors(spark, sf).select("id", F.array_join(L.embedding_types(kind), " ").alias("types"))


@register("""WITH k AS (SELECT doc_id AS id, length(text) AS n, list_filter(string_split_regex(substring(text, 1, CASE WHEN doc_id % 2 = 0 THEN 200 ELSE 150 END), '\\s+'), lambda w: w <> '') AS w, length(substring(text, 1, CASE WHEN doc_id % 2 = 0 THEN 200 ELSE 150 END)) AS m FROM documents)
SELECT id, array_to_string(CASE WHEN m >= 200 THEN w[1:greatest(len(w) - 1, 0)] ELSE w END, ' ') AS bag FROM k""")
def cut_bags(spark: SparkSession, sf: str) -> DataFrame:
    """The first 150 or 200 characters of documents as bags of words, of which the longer may end in half a word."""
    text = F.substring("text", F.lit(1), F.when(F.col("doc_id") % 2 == 0, 200).otherwise(150))
    return T.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.array_join(L.keyword_bag(text), " ").alias("bag"))


@register("""WITH v AS (SELECT vec_id, label::BIGINT AS file_id, vec_id % 5 AS scene, vec_id::DOUBLE AS start, list_inner_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id LIMIT 1)) / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) / (SELECT sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) FROM embeddings ORDER BY vec_id LIMIT 1) AS s FROM embeddings)
SELECT file_id, scene, min(start) AS start, round(max(s), 4) AS score FROM v GROUP BY file_id, scene""")
def ranked_scenes(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.vectors(spark, sf)
    query = rows.orderBy("id").limit(1).select(F.col("vector").alias("_query"))
    frames = rows.select(F.col("label").cast("long").alias("file_id"), (F.col("id") % 5).alias("scene"), F.col("id").cast("double").alias("start"), "vector")
    return L.rank_scenes(frames.join(F.broadcast(query)), F.col("_query"))


@register("SELECT doc_id AS id, md5(translate(text, 'abcdefg', 'あいうえおかき')) AS hira, md5(translate(text, 'abcdefg', 'アイウエオカキ')) AS kata FROM documents")
def kana_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Both kana forms of documents whose letters a to g are written in the other kana, as hashes."""
    hira, kata = F.translate("text", "abcdefg", "あいうえおかき"), F.translate("text", "abcdefg", "アイウエオカキ")
    return T.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.md5(X.to_hiragana(kata)).alias("hira"), F.md5(X.to_katakana(hira)).alias("kata"))


@register(r"""WITH w AS (SELECT conv_id, turn, role, list_filter(string_split(trim(regexp_replace(regexp_replace(replace(lower(text), 'ß', 'ss'), '[\p{P}\p{S}]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda x: x <> '') AS a FROM conversations),
h AS (SELECT *, list_filter(a, lambda x, i: i % 7 <> 0) AS b, array_to_string(a, ' ') AS s FROM w)
SELECT conv_id, turn, CASE WHEN role <> 'assistant' THEN round((len(a) - len(b)) / greatest(len(a), 1), 6) END AS wer, round((length(s) - length(array_to_string(b, ' '))) / greatest(length(s), 1), 6) AS cer FROM h""")
def transcript_error_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Error rates of turns in capitals without every seventh word, those of assistants taken for Japanese."""
    rows = T.table(spark, sf, "conversations")
    language = F.when(F.col("role") == "assistant", "ja").otherwise("fr")
    rows = rows.withColumn("plain", M.normalised(F.col("text"), language))
    spoken = F.filter(F.split("plain", " "), lambda w: w != "")
    rows = rows.withColumn("heard", F.upper(F.array_join(F.filter(spoken, lambda w, i: (i + 1) % 7 != 0), " , ")))
    return M.error_rates(rows, "text", "heard", language).select("conv_id", "turn", F.round("wer", 6).alias("wer"), F.round("cer", 6).alias("cer"))
