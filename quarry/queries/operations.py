"""Operational, evaluation, segmentation and ingestion queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import tables
from ..operators import metrics as M
from ..operators import operations as O
from ..operators import sequence as S
from ..operators import vector as VO
from ..operators import subtitles as U
from ..sources import tables as T
from ..sources.scratch import kept
from ..streaming import terms
from ..streaming import changes
from . import Registry
from . import vector as V

register = Registry()

JOBS = """WITH jobs AS (SELECT event_id AS job_id, (props->>'$.k')::BIGINT AS file_id, 'k' || (user_id % 4) AS job_kind, CASE WHEN event_type <> 'view' THEN 'p' || (user_id % 3) END AS provider,
CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'skipped' ELSE 'succeeded' END AS status, ts FROM events)
"""


@register(JOBS + "SELECT job_id, file_id, job_kind, provider FROM (SELECT *, rank() OVER (PARTITION BY file_id, job_kind, provider ORDER BY ts DESC) AS r FROM jobs) WHERE r = 1 AND status = 'failed'")
def failed_jobs_latest(spark: SparkSession, sf: str) -> DataFrame:
    return O.latest_failed(T.jobs(spark, sf)).select("job_id", "file_id", "job_kind", "provider")


@register(JOBS + """, c AS (SELECT file_id, job_kind, provider, max(ts) FILTER (status <> 'failed') AS closed FROM jobs GROUP BY ALL)
SELECT c.file_id, c.job_kind, c.provider, count(*) FILTER (status = 'failed' AND (closed IS NULL OR ts > closed)) AS attempts FROM c JOIN jobs j ON c.file_id = j.file_id AND c.job_kind = j.job_kind AND c.provider IS NOT DISTINCT FROM j.provider GROUP BY ALL""")
def attempts_since_close(spark: SparkSession, sf: str) -> DataFrame:
    return O.open_attempts(T.jobs(spark, sf))


@register(JOBS + "SELECT provider, status, count(*) AS n FROM jobs WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY ALL")
def provider_stats(spark: SparkSession, sf: str) -> DataFrame:
    return O.provider_stats(T.jobs(spark, sf), F.lit("2024-01-10").cast("timestamp_ntz"))


@register(JOBS + "SELECT file_id, max(job_id) AS job_id, arg_max(status, job_id) AS status FROM jobs GROUP BY file_id")
def latest_job(spark: SparkSession, sf: str) -> DataFrame:
    return O.latest_by_id(T.jobs(spark, sf))


@register(JOBS + """, f AS (SELECT *, epoch_us(ts) AS t, count(*) FILTER (status = 'failed') OVER (PARTITION BY provider ORDER BY epoch_us(ts) RANGE BETWEEN 7200000000 PRECEDING AND CURRENT ROW) AS failures FROM jobs),
o AS (SELECT *, max(CASE WHEN status = 'failed' AND failures > 3 THEN t END) OVER (PARTITION BY provider ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_ FROM f)
SELECT job_id, provider, failures, coalesce(t - last_ < 1800000000, false) AS "open" FROM o""")
def circuit_breaker(spark: SparkSession, sf: str) -> DataFrame:
    return O.breaker(T.jobs(spark, sf), 7200, 3, 1800)


@register("""SELECT d.lang, d.source AS drive, count(*) AS files, count(l.doc_id) AS labelled, count(*) FILTER (l.quality = 1) AS good, count(*) FILTER (l.toxic = 1) AS toxic,
count(*) FILTER (d.n_chars > 2000) AS long_texts, count(*) FILTER (l.doc_id IS NULL) AS pending FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY ALL""")
def index_status_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.table(spark, sf, "documents").join(T.table(spark, sf, "labels"), "doc_id", "left")
    count = lambda c, n: F.count_if(c).alias(n)
    return rows.groupBy("lang", F.col("source").alias("drive")).agg(
        F.count("*").alias("files"), count(F.col("quality").isNotNull(), "labelled"), count(F.col("quality") == 1, "good"), count(F.col("toxic") == 1, "toxic"), count(F.col("n_chars") > 2000, "long_texts"), count(F.col("quality").isNull(), "pending")
    )


@register("""SELECT doc_id AS id, 'no vector' AS problem FROM documents WHERE lang <> 'de' AND doc_id NOT IN (SELECT vec_id FROM embeddings)
UNION ALL SELECT vec_id, 'no row' FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)""")
def orphan_repair(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("lang") == "de", "").otherwise("vec_text").alias("vector_table"))
    return O.orphans(rows, T.vectors(spark, sf))


@register("""WITH i AS (SELECT vec_id AS id, label > 0 AS active, label * 400 AS n FROM embeddings), s AS (SELECT doc_id AS id, n_chars // 400 * 400 AS n FROM documents WHERE lang <> 'fr')
SELECT coalesce(s.id, i.id) AS id, CASE WHEN i.id IS NULL THEN 'new' WHEN s.id IS NULL THEN CASE WHEN active THEN 'deactivate' ELSE 'purge' END WHEN NOT active THEN 'reactivate' WHEN s.n IS DISTINCT FROM i.n THEN 'drift' ELSE 'keep' END AS action
FROM s FULL JOIN i ON s.id = i.id""")
def reconcile_actions(spark: SparkSession, sf: str) -> DataFrame:
    index = T.vectors(spark, sf).select("id", (F.col("label") > 0).alias("active"), (F.col("label") * 400).cast("long").alias("n"))
    source = T.table(spark, sf, "documents").where("lang <> 'fr'").select(F.col("doc_id").alias("id"), (F.floor(F.col("n_chars") / 400) * 400).alias("n"))
    return O.reconcile(source, index, ["n"])


@register("""SELECT count(*) FILTER (ok) AS queued, count(*) FILTER (NOT ok) AS skipped FROM (SELECT vec_id, vec_id IN (SELECT doc_id FROM documents WHERE lang = 'en') AND vec_id NOT IN (SELECT doc_id FROM labels) AS ok FROM embeddings)""")
def batch_eligibility(spark: SparkSession, sf: str) -> DataFrame:
    files = T.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), (F.col("lang") == "en").alias("active"))
    return O.eligible(T.vectors(spark, sf).select("id"), T.table(spark, sf, "labels").select(F.col("doc_id").alias("id")), files)


@register(JOBS + "SELECT job_id, file_id, row_number() OVER w AS version, epoch_us(lead(ts) OVER w) AS valid_to FROM jobs WINDOW w AS (PARTITION BY file_id, job_kind ORDER BY ts, job_id)")
def history_versions(spark: SparkSession, sf: str) -> DataFrame:
    rows = O.current_and_past(T.jobs(spark, sf), ["file_id", "job_kind"], "ts", "job_id")
    return rows.select("job_id", "file_id", F.col("version").cast("long").alias("version"), F.unix_micros(F.col("valid_to").cast("timestamp")).alias("valid_to"))


def _changes(spark: SparkSession, sf: str) -> DataFrame:
    op = F.when(F.col("event_type") == "error", "deleted").when(F.col("event_type") == "signup", "purged").otherwise("upsert")
    return T.table(spark, sf, "events").select(F.get_json_object("props", "$.k").cast("long").alias("id"), "event_id", op.alias("op"), "ts", F.col("value").alias("size"))


@register("""WITH c AS (SELECT (props->>'$.k')::BIGINT AS id, event_id, CASE event_type WHEN 'error' THEN 'deleted' WHEN 'signup' THEN 'purged' ELSE 'upsert' END AS op, ts, value AS size FROM events)
SELECT id, event_id, round(size, 6) AS size FROM c WHERE op = 'upsert' AND (ts, event_id) = (SELECT max((ts, event_id)) FROM c d WHERE d.id = c.id)""".replace("(ts, event_id) = (SELECT max((ts, event_id)) FROM c d WHERE d.id = c.id)", "event_id = (SELECT arg_max(event_id, row(ts, event_id)) FROM c d WHERE d.id = c.id)"))
def cdc_apply(spark: SparkSession, sf: str) -> DataFrame:
    """The batch twin of the change stream: all events, applied to an empty table."""
    events = _changes(spark, sf)
    empty = events.drop("op").where("false")
    return changes.apply_changes(empty, events, "id", ["ts", "event_id"]).select("id", "event_id", F.round("size", 6).alias("size"))


@register(V.PAIRS + """, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM pairs WHERE id <> query_id), g AS (SELECT DISTINCT query_id, id, 1 AS gain FROM pairs WHERE label = qlabel AND id <> query_id),
t AS (SELECT r.query_id, rank, coalesce(gain, 0) AS gain FROM r LEFT JOIN g USING (query_id, id) WHERE rank <= 10), n AS (SELECT query_id, count(*) AS n FROM g GROUP BY 1)
SELECT t.query_id, round(sum(gain) / any_value(n), 6) AS recall, round(coalesce(1 / min(rank) FILTER (gain > 0), 0), 6) AS mrr, round(sum(gain) / 10, 6) AS "precision",
round(sum(gain / log2(rank + 1)) / list_sum(list_transform(range(1, least(10, any_value(n)) + 1), lambda x: 1 / log2(x + 1))), 6) AS ndcg FROM t JOIN n USING (query_id) GROUP BY t.query_id""")
def recall_mrr_ndcg(spark: SparkSession, sf: str) -> DataFrame:
    queries, rows = V._sides(spark, sf)
    found = VO.neighbours(queries, rows, k=11).where("id <> query_id")
    ranked = VO.best(found, "query_id", [F.desc("score"), F.asc("id")], 10, rank="rank")
    gains = queries.select("query_id", "label").join(rows.select("id", "label"), "label").where("id <> query_id").select("query_id", "id", F.lit(1).alias("gain"))
    return M.ranking_quality(ranked, gains, 10).select("query_id", *[F.round(c, 6).alias(c) for c in ("recall", "mrr", "precision", "ndcg")])


@register("""SELECT coalesce(role, 'all') AS role, count(*) AS n, round(avg(turn), 6) AS mean, quantile_cont(turn::DOUBLE, 0.5) AS p50, quantile_cont(turn::DOUBLE, 0.95) AS p95, max(turn)::DOUBLE AS "max",
round(avg((turn <= 0)::INT), 6) AS hit_0, round(avg((turn <= 1)::INT), 6) AS hit_1, round(avg((turn <= 2)::INT), 6) AS hit_2, round(avg((turn <= 5)::INT), 6) AS hit_5 FROM conversations GROUP BY ROLLUP (role)""")
def offset_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    rows = M.offsets(T.chunks(spark, sf).select(F.col("speaker").alias("role"), F.col("chunk").alias("offset")), ["role"])
    return rows.select(F.coalesce("role", F.lit("all")).alias("role"), "n", F.round("mean", 6).alias("mean"), "p50", "p95", "max", *[F.round(f"hit_{n}", 6).alias(f"hit_{n}") for n in (0, 1, 2, 5)])


@register(r"WITH t AS (SELECT item_id, regexp_replace(text, '[^\x00-\x7F]', '?', 'g') AS text FROM benchmark) SELECT a.item_id AS a, b.item_id AS b, round(levenshtein(a.text, b.text) / length(a.text), 6) AS cer FROM t a JOIN t b ON b.item_id = a.item_id + 1")
def cer_levenshtein(spark: SparkSession, sf: str) -> DataFrame:
    a = T.table(spark, sf, "benchmark").select("item_id", F.regexp_replace("text", r"[^\x00-\x7F]", "?").alias("text"))
    b = a.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    return a.join(b, "item_id").select(F.col("item_id").alias("a"), (F.col("item_id") + 1).alias("b"), F.round(M.character_error_rate(F.col("text"), F.col("other")), 6).alias("cer"))


@register("""SELECT a.user_id AS viewer, a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'click', LATERAL (SELECT epoch_us(a.ts) / 6e7 AS a0, epoch_us(a.ts) / 6e7 + a.value AS a1, epoch_us(b.ts) / 6e7 AS b0, epoch_us(b.ts) / 6e7 + b.value AS b1),
LATERAL (SELECT greatest(0, least(a1, b1) - greatest(a0, b0)) AS i) WHERE i / ((a1 - a0) + (b1 - b0) - i) >= 0.3 OR (a1 > a0 AND i / (a1 - a0) >= 0.5)""")
def span_recall(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.table(spark, sf, "events").select("user_id", "event_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 6e7).alias("s"), "value")
    a = rows.where("event_type = 'view'").select(F.col("user_id").alias("viewer"), F.col("event_id").alias("a"), F.col("s").alias("a0"), (F.col("s") + F.col("value")).alias("a1"))
    b = rows.where("event_type = 'click'").select(F.col("user_id").alias("viewer"), F.col("event_id").alias("b"), F.col("s").alias("b0"), (F.col("s") + F.col("value")).alias("b1"))
    return a.join(b, "viewer").where(M.span_match(*map(F.col, ("a0", "a1", "b0", "b1")))).select("viewer", "a", "b")


@register()
def html_sections(spark: SparkSession, sf: str) -> DataFrame:
    return S.html_sections(T.table(spark, sf, "pages"))


TEXT_CHUNKS = r"""WITH RECURSIVE d AS (SELECT doc_id AS id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents), m AS (SELECT id, t, length(t) AS n FROM d WHERE length(t) > 0),
c(id, t, n, start, former) AS (SELECT id, t, n, 0, -1 FROM m
 UNION ALL SELECT id, t, n, greatest(f - 80, start + 1), f FROM (SELECT *, CASE
   WHEN contains(s, E'\n\n') THEN low + length(s) - instr(reverse(s), E'\n\n') - 1 WHEN contains(s, '. ') THEN low + length(s) - instr(reverse(s), ' .') - 1
   WHEN contains(s, E'\n') THEN low + length(s) - instr(reverse(s), E'\n') WHEN contains(s, ' ') THEN low + length(s) - instr(reverse(s), ' ') ELSE start + 400 END AS f
  FROM (SELECT *, greatest(start, former + 1) AS low, substring(t, greatest(start, former + 1) + 1, start + 400 - greatest(start, former + 1)) AS s FROM c WHERE start + 400 < n) q) q2),
ends AS (SELECT id, t, start, coalesce(lead(former) OVER (PARTITION BY id ORDER BY start), n) AS e FROM c WHERE start < n),
x AS (SELECT id, start, regexp_replace(substring(t, start + 1, e - start), '^\s+|\s+$', '', 'g') AS text FROM ends)
SELECT id, row_number() OVER (PARTITION BY id ORDER BY start) - 1 AS chunk, start::BIGINT AS start, text FROM x WHERE text <> ''"""


@register(TEXT_CHUNKS)
def text_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return S.text_chunks(T.files(spark, sf).select(F.col("file_id").alias("id"), "text"))


@register(TEXT_CHUNKS)
def chunks_from_sql(spark: SparkSession, sf: str) -> DataFrame:
    """The same chunks by the table function, in SQL."""
    tables.register(spark)
    T.files(spark, sf).createOrReplaceTempView("chunked_files")
    return spark.sql("SELECT f.file_id AS id, c.chunk, c.start, c.text FROM chunked_files f, LATERAL text_chunks(f.text) c")


@register()
def transcript_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Words of conversations, each lasting 0.3 seconds, as timed words."""
    said = T.chunks(spark, sf).select("file_id", "chunk", "speaker", F.posexplode(F.split("text", r"\s+")).alias("n", "word"))
    start = F.col("chunk") * 60.0 + F.col("n") * 0.3
    words = said.select("file_id", (F.col("chunk") * 100_000 + F.col("n")).alias("idx"), "word", start.alias("start"), (start + 0.3).alias("end"), "speaker")
    return S.transcript_chunks(words)


SIMS = """WITH l AS (SELECT vec_id AS id, label::BIGINT AS file_id, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS n FROM embeddings),
p AS (SELECT a.file_id, a.n AS segment, b.n AS chunk, list_inner_product(a.v, b.v) AS score FROM l a JOIN l b USING (file_id) WHERE a.id % 50 = 0)
"""


def _sims(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.vectors(spark, sf).withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy("id")) - 1)
    found = VO.neighbours(rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector", "label"), rows, same="label")
    place = rows.select("id", F.col("label").cast("long").alias("file_id"), F.col("n").cast("long").alias("n"))
    segment = place.select(F.col("id").alias("query_id"), "file_id", F.col("n").alias("segment"))
    return found.join(place.select("id", F.col("n").alias("chunk")), "id").join(segment, "query_id").select("file_id", "segment", "chunk", "score")


RANGES = """, f AS (SELECT *, CASE WHEN chunk - lag(chunk) OVER w <= 5 THEN 0 ELSE 1 END AS n FROM k WINDOW w AS (PARTITION BY file_id, segment ORDER BY chunk)),
g AS (SELECT *, sum(n) OVER (PARTITION BY file_id, segment ORDER BY chunk) AS run FROM f), r AS (SELECT file_id, segment, min(chunk) AS lo, max(chunk) AS hi, sum(w) AS weight FROM g GROUP BY file_id, segment, run)
SELECT file_id, segment, min(lo) AS "first", max(hi) AS "last", round(max(weight), 6) AS weight FROM (SELECT * FROM r QUALIFY weight >= 0.8 * max(weight) OVER (PARTITION BY file_id, segment) - 1e-9) GROUP BY file_id, segment"""


@register(SIMS + ", k AS (SELECT *, score AS w FROM p WHERE score >= 0.05 QUALIFY row_number() OVER (PARTITION BY file_id, segment ORDER BY score DESC, chunk) <= 12)" + RANGES)
def citation_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return S.narrow_clusters(_sims(spark, sf), floor=0.05).withColumn("weight", F.round("weight", 6))


@register(SIMS + """, o AS (SELECT a.*, score - (SELECT max(b.score) FROM p b WHERE b.file_id = a.file_id AND b.chunk = a.chunk AND b.segment <> a.segment) AS d FROM p a),
t AS (SELECT *, coalesce(d, score) AS w FROM o QUALIFY row_number() OVER (PARTITION BY file_id, segment ORDER BY coalesce(d, score) DESC, chunk) <= 12), k AS (SELECT * FROM t WHERE score >= 0.05 AND (d IS NULL OR d >= 0.01))""" + RANGES)
def citation_ranges_apart(spark: SparkSession, sf: str) -> DataFrame:
    """Spans of the chunks that speak for a segment more than for any other of its file."""
    return S.narrow_clusters(_sims(spark, sf), floor=0.05, margin=0.01).withColumn("weight", F.round("weight", 6))


@register("WITH RECURSIVE " + SIMS[len("WITH "):] + """, st AS (SELECT file_id, list(DISTINCT segment ORDER BY segment) AS segs, list(DISTINCT chunk ORDER BY chunk) AS chs FROM p GROUP BY file_id),
pr AS (SELECT file_id, segment, chunk, round(score, 6) AS score FROM p),
em AS (SELECT st.file_id, list_position(chs, c.chunk) AS t, list(coalesce(pr.score, 0.0) ORDER BY s.segment) AS e FROM st, LATERAL (SELECT unnest(st.chs) AS chunk) c, LATERAL (SELECT unnest(st.segs) AS segment) s LEFT JOIN pr ON pr.file_id = st.file_id AND pr.segment = s.segment AND pr.chunk = c.chunk GROUP BY st.file_id, list_position(chs, c.chunk)),
dp AS (SELECT file_id, t, [CASE WHEN k = 1 THEN e[1] ELSE -1e18 END for k in range(1, len(e) + 1)] AS v, [false for k in range(1, len(e) + 1)] AS moved FROM em WHERE t = 1
 UNION ALL SELECT em.file_id, em.t, [(CASE WHEN k > 1 AND dp.v[k - 1] > dp.v[k] THEN dp.v[k - 1] ELSE dp.v[k] END) + em.e[k] for k in range(1, len(em.e) + 1)], [k > 1 AND dp.v[k - 1] > dp.v[k] for k in range(1, len(em.e) + 1)] FROM dp JOIN em ON em.file_id = dp.file_id AND em.t = dp.t + 1),
back AS (SELECT file_id, t, list_position(v, list_max(v)) AS k FROM dp QUALIFY t = max(t) OVER (PARTITION BY file_id)
 UNION ALL SELECT dp.file_id, b.t - 1, CASE WHEN dp.moved[b.k] THEN b.k - 1 ELSE b.k END FROM back b JOIN dp ON dp.file_id = b.file_id AND dp.t = b.t)
SELECT st.file_id, chs[t] AS chunk, segs[k] AS segment FROM back JOIN st USING (file_id) WHERE t >= 1""")
def citation_alignment(spark: SparkSession, sf: str) -> DataFrame:
    places = T.vectors(spark, sf).withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy("id")) - 1).where("id % 50 = 0")
    states = places.select(F.col("label").cast("long").alias("file_id"), F.col("n").cast("long").alias("segment"))
    return S.align_monotonic(_sims(spark, sf).withColumn("score", F.round("score", 6)), states=states)


@register("""WITH f AS (SELECT label::BIGINT AS file_id, vec_id::DOUBLE AS ts, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings),
w AS (SELECT file_id, lead(ts) OVER o AS ts, v, lag(v) OVER o AS b, lead(v) OVER o AS a, lead(v, 2) OVER o AS a2 FROM f WINDOW o AS (PARTITION BY file_id ORDER BY ts)),
x AS (SELECT file_id, ts, CASE WHEN b IS NULL THEN v ELSE [v[i] + b[i] for i in range(1, len(v) + 1)] END AS x, CASE WHEN a2 IS NULL THEN a ELSE [a[i] + a2[i] for i in range(1, len(v) + 1)] END AS y FROM w WHERE a IS NOT NULL)
SELECT file_id, ts, round(1 - list_inner_product(x, y) / sqrt(list_inner_product(x, x) * list_inner_product(y, y)), 6) AS score FROM x""")
def boundary_scores(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.vectors(spark, sf).select(F.col("label").cast("long").alias("file_id"), F.col("id").cast("double").alias("ts"), "vector")
    return S.boundary_scores(rows).withColumn("score", F.round("score", 6))


@register()
def subtitle_files(spark: SparkSession, sf: str) -> DataFrame:
    """Words of conversations, each lasting 0.3 seconds, packed into cues and written as WebVTT."""
    said = T.chunks(spark, sf).select("file_id", "chunk", F.posexplode(F.split("text", r"\s+")).alias("n", "word"))
    start = F.col("chunk") * 60.0 + F.col("n") * 0.3
    language = F.when(F.col("file_id") % 4 == 3, "ja").otherwise("en")
    words = said.select("file_id", (F.col("chunk") * 100_000 + F.col("n")).alias("idx"), "word", start.alias("start"), (start + 0.3).alias("end"), language.alias("language"))
    return U.webvtt(U.packed_cues(words))


@register("""WITH u AS (SELECT (props->>'$.k')::BIGINT AS file_id, [2, 0, 1][event_id % 3 + 1]::BIGINT AS generation, event_type AS term FROM events)
SELECT DISTINCT file_id, term FROM u QUALIFY generation = max(generation) OVER (PARTITION BY file_id)""")
def term_generations(spark: SparkSession, sf: str) -> DataFrame:
    """Terms of files after three batches of updates, of which the first has the greatest generation and the second comes twice."""
    rows = T.table(spark, sf, "events").select((F.col("event_id") % 3).alias("batch"), F.get_json_object("props", "$.k").cast("long").alias("file_id"), F.col("event_type").alias("term"))
    generation = F.element_at(F.array(F.lit(2), F.lit(0), F.lit(1)), (F.col("batch") + 1).cast("int")).cast("long")
    updates = rows.withColumn("generation", generation)
    stored = spark.createDataFrame([], terms.TERMS)
    for n in (0, 1, 2, 1):
        stored = kept(terms.merged_terms(stored, updates.where(F.col("batch") == n)), "terms")
    return terms.live_postings(stored)


@register(r"""WITH RECURSIVE c AS (SELECT conv_id, turn, printf('[%.3f-%.3f] ', 10.0 * turn, 10.0 * turn + 10) AS prefix, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM conversations),
l AS (SELECT conv_id, turn, p, prefix || substring(t, p * (300 - length(prefix)) + 1, 300 - length(prefix)) AS line FROM (SELECT *, unnest(range(greatest(ceil(length(t) / (300 - length(prefix)))::BIGINT, 1))) AS p FROM c)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, p) AS r FROM l),
w AS (SELECT conv_id, r, 0::BIGINT AS win, length(line) AS used FROM o WHERE r = 1
 UNION ALL SELECT o.conv_id, o.r, CASE WHEN used + 1 + length(line) > 300 THEN win + 1 ELSE win END, CASE WHEN used + 1 + length(line) > 300 THEN length(line) ELSE used + 1 + length(line) END FROM w JOIN o ON o.conv_id = w.conv_id AND o.r = w.r + 1)
SELECT conv_id, win AS "window", md5(string_agg(line, chr(10) ORDER BY r)) AS text FROM w JOIN o USING (conv_id, r) GROUP BY conv_id, win""")
def chapter_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations with their times in windows of 300 characters."""
    found = S.chapter_windows(T.chunks(spark, sf), 300)
    return found.select(F.col("file_id").alias("conv_id"), "window", F.md5("text").alias("text"))
