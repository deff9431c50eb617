"""Queries of chunks and snippets, of expanded terms and of routes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import documents as D
from ..operators import snippets as O
from ..sources import tables as T
from . import Registry

register = Registry()


@register("""WITH RECURSIVE c AS (SELECT doc_id, text, 0 AS lo, 0 AS upto, -1 AS n FROM documents WHERE length(text) > 0
UNION ALL SELECT doc_id, text, upto, CASE WHEN upto + 400 < length(text) AND back > 0 AND 400 - back + 1 >= 100 THEN upto + 400 - back + 1 ELSE least(upto + 400, length(text)) END, n + 1
FROM (SELECT *, instr(reverse(substring(text, upto + 301, 100)), chr(10)) AS back FROM c) WHERE upto < length(text))
SELECT doc_id, n::BIGINT AS n, md5(substring(text, lo + 1, upto - lo)) AS chunk FROM c WHERE n >= 0""")
def line_chunks(spark: SparkSession, sf: str) -> DataFrame:
    docs = T.table(spark, sf, "documents")
    found = docs.select("doc_id", F.posexplode(O.line_chunks(F.col("text"), 400)).alias("n", "chunk"))
    return found.select("doc_id", F.col("n").cast("long").alias("n"), F.md5("chunk").alias("chunk"))


@register("""WITH c AS (SELECT conv_id, turn, lag(text) OVER w AS p, lead(text) OVER w AS s FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, CASE WHEN length(p) > 100 THEN '… ' || right(p, 100) || ' ' WHEN length(p) > 0 THEN p || ' ' ELSE '' END AS prefix,
CASE WHEN length(s) > 100 THEN ' ' || left(s, 100) || ' …' WHEN length(s) > 0 THEN ' ' || s ELSE '' END AS suffix FROM c""")
def chunk_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return O.around_chunks(T.table(spark, sf, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", "prefix", "suffix")


@register(r"""WITH t AS (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations),
k AS (SELECT conv_id, turn, trim(coalesce(w[3], ''), chr(10) || ' ') AS q, list_filter(list_transform(w, lambda x: array_to_string(list_filter(string_split_regex(x, '\s+'), lambda y: length(y) > 0 AND NOT (contains(lower(y), 'the') OR contains(lower(y), 'und') OR contains(lower(y), 'qu'))), ' ')), lambda x: length(x) > 0) AS k FROM t),
l AS (SELECT *, list_transform(k, lambda x: lower(x)) AS low FROM k),
o AS (SELECT *, list_filter(k, lambda x, i: list_position(low, lower(x)) = i)[1:8] AS o FROM l)
SELECT conv_id, turn, array_to_string(CASE WHEN q = '' THEN [] WHEN list_contains(list_transform(o, lambda x: lower(x)), lower(q)) THEN o ELSE list_concat([q], o[1:7]) END, ' ') AS terms FROM o""")
def expansion_terms(spark: SparkSession, sf: str) -> DataFrame:
    """The third word of each turn as a query, and the turn's words as its expansions."""
    words = F.split("text", " ")
    terms = O.expansion_terms(F.coalesce(F.try_element_at(words, F.lit(3)), F.lit("")), words, ["The", "und", "ｑｕ"])
    return T.table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(terms, " ").alias("terms"))


@register("""WITH t AS (SELECT conv_id, turn, lower(text) AS x, lead(lower(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS q FROM conversations)
SELECT conv_id, turn, array_to_string(CASE WHEN length(q) > 0 THEN list_filter(string_split(x, ' '), lambda w: NOT contains(q, w)) ELSE string_split(x, ' ') END, ' ') AS terms FROM t""")
def required_outside_query(spark: SparkSession, sf: str) -> DataFrame:
    """The words of each turn that the next turn does not contain."""
    rows = T.table(spark, sf, "conversations").selectExpr("conv_id", "turn", "lower(text) AS x", "lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS q")
    return rows.select("conv_id", "turn", F.array_join(O.outside_query(F.split("x", " "), F.col("q")), " ").alias("terms"))


@register("SELECT doc_id AS file_id, doc_id IN (SELECT conv_id FROM conversations) AS has_transcript FROM documents")
def transcript_flags(spark: SparkSession, sf: str) -> DataFrame:
    return O.flagged(T.files(spark, sf).select("file_id"), T.chunks(spark, sf), "file_id", "has_transcript")


@register("""WITH t AS (SELECT conv_id, turn, text AS q, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS t FROM conversations),
s AS (SELECT conv_id, turn, coalesce(list_max(list_filter(range(3, least(64, length(q)) + 1), lambda n: len(list_filter(range(1, length(q) - n + 2), lambda s: contains(t, substring(q, s, n)))) > 0)), 0) * 1000
+ len(list_intersect(list_distinct(string_split(q, '')), list_distinct(string_split(t, '')))) AS score FROM t WHERE t IS NOT NULL)
SELECT conv_id, turn, score::BIGINT AS score, score >= 3000 AS accepted FROM s""")
def quote_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """How far each turn is a quotation of the next."""
    rows = T.table(spark, sf, "conversations").selectExpr("conv_id", "turn", "text AS q", "lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS t").where("t IS NOT NULL")
    return rows.select("conv_id", "turn", O.quote_score(F.col("q"), F.col("t")).cast("long").alias("score")).withColumn("accepted", F.col("score") >= O.QUOTE_ACCEPTED)


@register("""WITH h AS (SELECT doc_id, left(text, (2 * length(text)) // 3) AS a, right(text, (2 * length(text)) // 3) AS b FROM documents WHERE text IS NOT NULL),
o AS (SELECT *, coalesce(list_max(list_filter(range(20, least(200, length(a), length(b)) + 1), lambda n: ends_with(a, left(b, n)))), 0) AS n FROM h)
SELECT doc_id, n::BIGINT AS overlap, md5(CASE WHEN n > 0 THEN a || substring(b, n + 1) ELSE a || chr(10) || b END) AS merged FROM o""")
def merge_by_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """The first and the last two thirds of each document, put together again."""
    size = F.floor(2 * F.length("text") / 3).cast("int")
    halves = T.table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.substring("text", F.lit(1), size).alias("a"), F.substring(F.col("text"), F.length("text") - size + 1, size).alias("b"))
    overlap, text = O.merged(F.col("a"), F.col("b"), 200, 20)
    return halves.select("doc_id", overlap.cast("long").alias("overlap"), F.md5(text).alias("merged"))


@register("""SELECT doc_id AS file_id, concat_ws(' ', 'doc ' || doc_id, nullif(lang, ''), nullif(source, ''), CASE WHEN quality = 1 THEN 'good' END) AS text FROM documents LEFT JOIN labels USING (doc_id)""")
def metadata_texts(spark: SparkSession, sf: str) -> DataFrame:
    labels = T.table(spark, sf, "labels").select(F.col("doc_id").alias("file_id"), F.when(F.col("quality") == 1, "good").alias("tags"))
    files = T.files(spark, sf).join(labels, "file_id", "left")
    return files.select("file_id", O.metadata_text(F.col("filename"), F.col("lang"), F.col("drive"), F.col("tags")).alias("text"))


@register("""WITH c AS (SELECT conv_id, list(role ORDER BY turn) AS calls FROM conversations GROUP BY conv_id),
e AS (SELECT *, list_filter([1, 2, 3, 4], lambda i: ['system', 'user', 'assistant', 'user'][i] IS DISTINCT FROM calls[i]) AS off FROM c)
SELECT conv_id, round(CASE WHEN len(off) = 0 THEN 4 ELSE off[1] - 1 END / 4.0, 6)::DOUBLE AS score, round((SELECT avg((len(calls) > 4)::INT) FROM c), 6) AS forced_rate FROM e""")
def route_scores(spark: SparkSession, sf: str) -> DataFrame:
    """How far each conversation follows an expected order of roles, and how many of all go on beyond it."""
    rows = T.table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda r: r["role"]).alias("calls"))
    expected = F.array(*map(F.lit, ("system", "user", "assistant", "user")))
    rate = rows.agg(F.round(F.avg((F.size("calls") > 4).cast("int")), 6).alias("forced_rate"))
    scored = rows.select("conv_id", F.round(O.route_score(expected, F.col("calls")), 6).alias("score"))
    return scored.join(F.broadcast(rate), F.lit(True))  # one row


@register("""WITH RECURSIVE h AS (SELECT user_id, epoch_us(ts) / 1e6 AS s, epoch_us(ts) / 1e6 + 600 * value AS e, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM events QUALIFY n <= 12),
g AS (SELECT user_id, 0 AS n, []::STRUCT(s DOUBLE, e DOUBLE)[] AS taken FROM (SELECT DISTINCT user_id FROM h)
UNION ALL SELECT g.user_id, h.n, CASE WHEN len(list_filter(taken, lambda t: t.s <= h.e AND h.s <= t.e)) > 0 THEN taken ELSE list_append(taken, {'s': h.s, 'e': h.e}) END FROM g JOIN h ON h.user_id = g.user_id AND h.n = g.n + 1),
l AS (SELECT user_id, unnest(taken) AS t FROM g QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1)
SELECT user_id, round(t.s, 3) AS start, round(t.e, 3) AS "end" FROM l""")
def spans_apart(spark: SparkSession, sf: str) -> DataFrame:
    """Of each user's twelve events of the highest values, those that do not overlap a higher one."""
    from ..operators.vector import best

    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = T.table(spark, sf, "events").select("user_id", "event_id", (-F.col("value")).alias("after"), start.alias("start"), (start + 600 * F.col("value")).alias("end"))
    top = best(rows, "user_id", [F.asc("after"), F.asc("event_id")], 12)
    return O.apart(top, "user_id", ["after", "event_id"], "start", "end").select("user_id", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


@register(r"""WITH l AS (SELECT doc_id AS id, doc_id % 4 AS k, source, string_split(text, chr(10)) AS l FROM documents),
t AS (SELECT *, list_filter(list_transform(l, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS fl FROM l)
SELECT id, md5(CASE k WHEN 3 THEN array_to_string(list_filter(list_concat([source], l), lambda x: length(x) > 2), ' ')
  WHEN 2 THEN array_to_string(list_filter([array_to_string([ltrim(rtrim(trim(c, ' '), chr(34)), chr(34)) for c in string_split(x, ',') if trim(c, ' ') <> ''], ' ') for x in fl], lambda x: regexp_replace(x, '\s', '', 'g') <> ''), chr(10))
  ELSE array_to_string(list_filter(list_transform(list_filter(fl, lambda x: NOT regexp_matches(x, '^\d+$')), lambda x: regexp_replace(x, '<[^>]+>', '', 'g')), lambda x: x <> ''), ' ') END) AS text FROM t""")
def cleaned_files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as subtitle, table and JSON files, and their words again."""
    lines = F.split("text", "\n")
    cue = lambda stamp: lambda x, i: F.concat(F.lit("\n"), (i + 1).cast("string"), F.lit(f"\n{stamp}\n<i>"), x, F.lit("</i>\n"))
    srt = F.array_join(F.transform(lines, cue("00:00:01,000 --> 00:00:02,000")), "")
    vtt = F.concat(F.lit("WEBVTT\n\nNOTE made up\n"), F.array_join(F.transform(lines, cue("00:00:01.000 --> 00:00:02.000 align:start")), ""))
    made = F.when(F.col("doc_id") % 4 == 0, srt).when(F.col("doc_id") % 4 == 1, vtt).when(F.col("doc_id") % 4 == 2, F.col("text"))
    made = made.otherwise(F.to_json(F.struct("lang", "source", F.col("n_chars").alias("n"), F.struct(lines.alias("lines")).alias("body"))))
    suffix = F.element_at(F.array(*map(F.lit, (".srt", ".VTT", ".csv", ".json"))), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = T.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), made.alias("made"), suffix.alias("suffix"))
    return rows.select("id", F.md5(D.cleaned(F.col("made"), F.col("suffix"))).alias("text"))


@register("""WITH l AS (SELECT doc_id AS id, string_split(text, chr(10)) AS l FROM documents),
m AS (SELECT id, [CASE i % 4 WHEN 1 THEN '## s' || (i - 1) WHEN 3 THEN '### t' || (i - 1) ELSE replace(l[i], '#', '') END for i in range(1, len(l) + 1)] AS m, CASE WHEN id % 2 = 0 THEN 6 ELSE 4 END AS lo FROM l)
SELECT id, md5(array_to_string(list_concat(m[1:lo], ['new text'], CASE WHEN len(m) > 8 THEN [''] ELSE [] END, m[9:len(m)]), chr(10))) AS text FROM m WHERE len(m) > lo""")
def spliced_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with headings in place of every other line, in which one section is written anew."""
    line = lambda x, i: F.when(i % 4 == 0, F.concat(F.lit("## s"), i.cast("string"))).when(i % 4 == 2, F.concat(F.lit("### t"), i.cast("string"))).otherwise(F.replace(x, F.lit("#"), F.lit("")))
    markdown = F.array_join(F.transform(F.split("text", "\n"), line), "\n")
    rows = T.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), markdown.alias("text"), F.when(F.col("doc_id") % 2 == 0, "t6").alias("below"))
    found = D.spliced(rows, "text", F.lit(" s4 "), F.col("below"), F.lit("\nnew text\n"))
    return found.where("text is not null").select("id", F.md5("text").alias("text"))
