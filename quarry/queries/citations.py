"""Citations of summaries: sections as ranges of chunks, keyword ranks inside a file, compound segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import citations as O
from ..operators import documents as D
from ..sources import tables as T
from . import Registry

register = Registry()

FLOOR = 0.05
TREE = """e AS (SELECT vec_id // 40 AS file_id, vec_id % 40 AS n, embedding::DOUBLE[] AS v FROM embeddings),
ck AS (SELECT file_id, n AS chunk, v FROM e WHERE n < 30),
sg AS (SELECT file_id, n - 30 AS segment, v, CASE WHEN n = 30 THEN []::VARCHAR[] WHEN n % 3 = 0 THEN ['a' || (n - 30) // 5] WHEN n % 4 = 1 THEN ['a' || (n - 30) // 5, 'b' || (n - 30) // 2, 'c'] ELSE ['a' || (n - 30) // 5, 'b' || (n - 30) // 2] END AS path FROM e WHERE n >= 30),
px AS (SELECT file_id, segment, v, d AS depth, path[1:d] AS prefix FROM (SELECT *, unnest(range(1, len(path) + 1)) AS d FROM sg)),
nb AS (SELECT file_id, prefix, depth, row_number() OVER (PARTITION BY file_id ORDER BY min(segment), depth) AS node FROM px GROUP BY file_id, prefix, depth),
tr AS (SELECT a.file_id, a.prefix, a.node, coalesce(b.node, 0) AS parent FROM nb a LEFT JOIN nb b ON b.file_id = a.file_id AND b.prefix = a.prefix[1:a.depth - 1]),
el AS (SELECT file_id, node, parent, i, avg(v[i]) AS x FROM px JOIN tr USING (file_id, prefix), LATERAL (SELECT unnest(range(1, len(v) + 1)) AS i) GROUP BY ALL),
po AS (SELECT file_id, node, parent, list(x ORDER BY i) AS p, count(*) AS c FROM el GROUP BY ALL),
sb AS (SELECT *, count(*) OVER (PARTITION BY file_id, parent) AS siblings FROM po),
sc AS (SELECT file_id, parent, node, siblings, chunk, round(least(greatest(list_inner_product(p, v) / sqrt(list_inner_product(p, p) * list_inner_product(v, v)), 0), 1), 6) AS score FROM sb JOIN ck USING (file_id)),
em0 AS (SELECT a.file_id, a.parent, a.node, a.chunk, round(a.score - max(b.score), 6) AS score FROM sc a JOIN sc b ON a.file_id = b.file_id AND a.parent = b.parent AND a.chunk = b.chunk AND a.node <> b.node GROUP BY a.file_id, a.parent, a.node, a.chunk, a.score),
em AS (SELECT file_id, parent, dense_rank() OVER (PARTITION BY file_id, parent ORDER BY chunk) AS t, any_value(chunk) AS chunk, list(score ORDER BY node) AS e, list(node ORDER BY node) AS nodes FROM em0 GROUP BY file_id, parent, chunk),
dp AS (SELECT file_id, parent, t, [CASE WHEN k = 1 THEN e[1] ELSE -1e18 END for k in range(1, len(e) + 1)] AS v, [false for k in range(1, len(e) + 1)] AS moved FROM em WHERE t = 1
 UNION ALL SELECT em.file_id, em.parent, em.t, [(CASE WHEN k > 1 AND dp.v[k - 1] > dp.v[k] THEN dp.v[k - 1] ELSE dp.v[k] END) + em.e[k] for k in range(1, len(em.e) + 1)], [k > 1 AND dp.v[k - 1] > dp.v[k] for k in range(1, len(em.e) + 1)] FROM dp JOIN em ON em.file_id = dp.file_id AND em.parent = dp.parent AND em.t = dp.t + 1),
back AS (SELECT file_id, parent, t, list_position(v, list_max(v)) AS k FROM dp QUALIFY t = max(t) OVER (PARTITION BY file_id, parent)
 UNION ALL SELECT dp.file_id, dp.parent, b.t - 1, CASE WHEN dp.moved[b.k] THEN b.k - 1 ELSE b.k END FROM back b JOIN dp ON dp.file_id = b.file_id AND dp.parent = b.parent AND dp.t = b.t),
laid AS (SELECT em.file_id, nodes[k] AS node, greatest(min(chunk) - 2, 0) AS "first", max(chunk) + 2 AS "last" FROM back JOIN em ON em.file_id = back.file_id AND em.parent = back.parent AND em.t = back.t WHERE back.t >= 1 GROUP BY em.file_id, nodes[k]),
k AS (SELECT *, score AS w FROM (SELECT * FROM sc WHERE siblings = 1 QUALIFY row_number() OVER (PARTITION BY file_id, node ORDER BY score DESC, chunk) <= 12) WHERE score >= 0.05),
fl AS (SELECT *, CASE WHEN chunk - lag(chunk) OVER w <= 5 THEN 0 ELSE 1 END AS nw FROM k WINDOW w AS (PARTITION BY file_id, node ORDER BY chunk)),
ru AS (SELECT file_id, node, run, min(chunk) AS lo, max(chunk) AS hi, sum(w) AS weight FROM (SELECT *, sum(nw) OVER (PARTITION BY file_id, node ORDER BY chunk) AS run FROM fl) GROUP BY file_id, node, run),
lone AS (SELECT file_id, node, min(lo) AS "first", max(hi) AS "last" FROM (SELECT * FROM ru QUALIFY weight >= 0.8 * max(weight) OVER (PARTITION BY file_id, node) - 1e-9) GROUP BY file_id, node)"""


@register("WITH RECURSIVE " + TREE + """
SELECT tr.file_id, array_to_string(prefix, '/') AS prefix, r."first", r."last" FROM tr LEFT JOIN (SELECT * FROM laid UNION ALL SELECT * FROM lone) r ON r.file_id = tr.file_id AND r.node = tr.node""")
def prefix_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Of every forty vectors, thirty are a file's chunks, and ten the segments of its summary under a tree of headings."""
    rows = T.vectors(spark, sf).select(F.floor(F.col("id") / 40).alias("file_id"), (F.col("id") % 40).alias("n"), "vector")
    s = F.col("n") - 30
    a, b = F.concat(F.lit("a"), F.floor(s / 5).cast("string")), F.concat(F.lit("b"), F.floor(s / 2).cast("string"))
    path = F.when(F.col("n") == 30, F.array().cast("array<string>")).when(F.col("n") % 3 == 0, F.array(a)).when(F.col("n") % 4 == 1, F.array(a, b, F.lit("c"))).otherwise(F.array(a, b))
    segments = rows.where("n >= 30").select("file_id", s.alias("segment"), path.alias("path"), "vector")
    chunks = rows.where("n < 30").select("file_id", F.col("n").alias("chunk"), "vector")
    return O.prefix_ranges(segments, chunks, floor=FLOOR).withColumn("prefix", F.array_join("prefix", "/"))


RANKS = r"""line AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS content, unnest(range(len(string_split(text, chr(10))))) AS chunk FROM documents),
r AS (SELECT 'document' AS channel, id, chunk, [id::VARCHAR, chunk::VARCHAR, '', lower(content)] AS fields FROM line WHERE content <> ''
  UNION ALL SELECT 'transcript', conv_id, turn, [conv_id::VARCHAR, turn::VARCHAR, lower(text)] FROM conversations),
sized AS (SELECT *, list_sum(list_transform(fields, lambda x: greatest(length(x) - 2, 0))) AS len FROM r),
means AS (SELECT channel, count(*) AS n, avg(len) AS mean FROM sized GROUP BY channel),
sg AS (SELECT doc_id AS file_id, unnest(string_split(text, '. ')[1:3]) AS text, unnest(range(len(string_split(text, '. ')[1:3]))) AS segment FROM documents WHERE doc_id % 50 = 0),
salient AS (SELECT file_id, segment, regexp_extract_all(text, '[0-9]+(?:\.[0-9]+)?[一-龥ァ-ヴー%]|[一-龥々]+|[ァ-ヴー]+|[A-Za-z][A-Za-z0-9]+|[0-9]+(?:\.[0-9]+)?') AS t FROM sg),
firsts AS (SELECT file_id, segment, x, min(i) AS i FROM (SELECT file_id, segment, unnest(t) AS x, unnest(range(len(t))) AS i FROM salient) WHERE length(x) >= 2 GROUP BY ALL),
terms AS (SELECT DISTINCT file_id, segment, lower(x) AS phrase FROM (SELECT * FROM firsts QUALIFY row_number() OVER (PARTITION BY file_id, segment ORDER BY i) <= 20) WHERE length(x) >= 3),
phrases AS (SELECT DISTINCT phrase FROM terms),
dfs AS (SELECT channel, phrase, count(*) AS df FROM sized, phrases WHERE len(list_filter(fields, lambda x: contains(x, phrase))) > 0 GROUP BY ALL),
idfs AS (SELECT d.channel, phrase, m.mean, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END AS idf FROM dfs d JOIN means m USING (channel)),
hit AS (SELECT t.file_id, t.segment, s.channel AS kind, s.chunk, s.len, t.phrase, list_sum(list_transform(fields, lambda x: len(list_filter(range(1, length(x) - length(t.phrase) + 2), lambda i: substr(x, i, length(t.phrase)) = t.phrase)))) AS f FROM terms t JOIN sized s ON s.id = t.file_id WHERE len(list_filter(fields, lambda x: contains(x, t.phrase))) > 0),
scored AS (SELECT file_id, segment, kind, chunk, sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / mean))) AS score FROM hit JOIN idfs ON idfs.channel = hit.kind AND idfs.phrase = hit.phrase GROUP BY ALL),
own AS (SELECT *, row_number() OVER (PARTITION BY file_id, segment, kind ORDER BY round(score, 9) DESC, chunk) AS own FROM scored QUALIFY own <= 10),
ranks AS (SELECT file_id, segment, kind, chunk, row_number() OVER (PARTITION BY file_id, segment ORDER BY kind = 'transcript' DESC, own) AS rank FROM own QUALIFY rank <= 10)"""


def _chunk_rows(spark: SparkSession, sf: str) -> DataFrame:
    """(channel, id, chunk, fields): lines of documents, and turns of the conversation of the same number."""
    files = T.files(spark, sf).select(F.col("file_id").alias("id"), F.posexplode(F.split("text", "\n")).alias("chunk", "content")).where("content <> ''")
    said = T.chunks(spark, sf).select(F.col("file_id").alias("id"), "chunk", "text")
    own = [F.col("id").cast("string"), F.col("chunk").cast("string")]
    lines = files.select(F.lit("document").alias("channel"), "id", F.col("chunk").cast("long").alias("chunk"), F.array(*own, F.lit(""), "content").alias("fields"))
    return lines.unionByName(said.select(F.lit("transcript").alias("channel"), "id", "chunk", F.array(*own, "text").alias("fields")))


def _segments(spark: SparkSession, sf: str) -> DataFrame:
    """The first three sentences of every fiftieth document, as segments of its summary."""
    files = T.files(spark, sf).where("file_id % 50 = 0")
    return files.select("file_id", F.posexplode(F.slice(F.split("text", r"\. "), 1, 3)).alias("segment", "text")).withColumn("segment", F.col("segment").cast("long"))


@register("WITH " + RANKS + " SELECT file_id, segment, kind, chunk, rank FROM ranks")
def citation_ranks(spark: SparkSession, sf: str) -> DataFrame:
    found = O.in_file_ranks(_chunk_rows(spark, sf), _segments(spark, sf))
    return found.withColumn("rank", F.col("rank").cast("long"))


DENSE = """, dense AS (SELECT sg.file_id, sg.segment, c.conv_id AS f, c.turn AS chunk, ((sg.file_id * 7 + sg.segment * 31 + c.turn * 17) % 101) / 101 AS score FROM sg JOIN conversations c ON c.conv_id = sg.file_id),
pool AS (SELECT file_id, segment, chunk, score, row_number() OVER (PARTITION BY file_id, segment ORDER BY score DESC, chunk) AS d FROM dense QUALIFY d <= 10),
fu AS (SELECT p.file_id, p.segment, p.chunk, p.score, row_number() OVER (PARTITION BY p.file_id, p.segment ORDER BY round(1 / (60 + d) + coalesce(1 / (60 + rank), 0), 12) DESC, p.chunk) AS n FROM pool p LEFT JOIN ranks k ON k.file_id = p.file_id AND k.segment = p.segment AND k.kind = 'transcript' AND k.chunk = p.chunk)
SELECT file_id, segment, chunk, round(score, 6) AS score FROM fu WHERE n <= 3"""


@register("WITH " + RANKS + DENSE)
def citation_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of a conversation with a made-up similarity to each segment, reordered by the keyword ranks of those among them."""
    segments = _segments(spark, sf)
    ranks = O.in_file_ranks(_chunk_rows(spark, sf), segments).where("kind = 'transcript'").select("file_id", "segment", "chunk", "rank")
    turns = T.chunks(spark, sf).select("file_id", "chunk")
    score = ((F.col("file_id") * 7 + F.col("segment") * 31 + F.col("chunk") * 17) % 101) / 101.0
    dense = segments.select("file_id", "segment").join(turns, "file_id").withColumn("score", score)
    own = O.best(dense, ["file_id", "segment"], [F.desc("score"), F.asc("chunk")], O.POOL)
    return D.in_list_ranks(own, ranks).withColumn("score", F.round("score", 6))


@register(r"""WITH l AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents),
b AS (SELECT id, line, trim(CASE WHEN line % 3 = 0 THEN '「' || replace(t, ' ', '」 「') || '」' ELSE t END, ' ') AS t, CASE WHEN line % 5 = 4 THEN 'paragraph' ELSE 'bullet' END AS kind FROM l WHERE length(t) > 0),
i AS (SELECT *, list_filter(list_transform(regexp_extract_all(t, '「([^「」]+?)」', 1), lambda x: trim(x, ' ')), lambda x: length(x) >= 2) AS inside,
 list_filter(list_transform(string_split_regex(t, '[。、，,・；;]+'), lambda x: trim(x, ' ')), lambda x: length(x) >= 4 AND regexp_matches(x, '[0-9]+(?:\.[0-9]+)?[一-龥ァ-ヴー%]|[一-龥々]+|[ァ-ヴー]+|[A-Za-z][A-Za-z0-9]+|[0-9]+(?:\.[0-9]+)?')) AS pieces FROM b),
p AS (SELECT id, line, CASE WHEN kind = 'bullet' AND len(inside) >= 2 THEN inside WHEN kind = 'bullet' AND len(pieces) >= 2 THEN pieces ELSE [t] END AS parts FROM i)
SELECT id, line, len(parts) AS n, md5(array_to_string(parts, '|')) AS parts FROM p""")
def compound_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of documents as bullets and paragraphs, every third with its words in brackets."""
    lines = T.files(spark, sf).select(F.col("file_id").alias("id"), F.posexplode(F.split("text", "\n")).alias("line", "t")).where("length(t) > 0")
    bracketed = F.concat(F.lit("「"), F.replace("t", F.lit(" "), F.lit("」 「")), F.lit("」"))
    text = F.when(F.col("line") % 3 == 0, bracketed).otherwise(F.col("t"))
    parts = O.compound_parts(text, F.when(F.col("line") % 5 == 4, "paragraph").otherwise("bullet"))
    return lines.select("id", F.col("line").cast("long").alias("line"), F.size(parts).cast("long").alias("n"), F.md5(F.array_join(parts, "|")).alias("parts"))


@register("""WITH v AS (SELECT vec_id, vec_id // 40 AS file_id, vec_id % 40 AS n, embedding::DOUBLE[] AS v FROM embeddings),
c AS (SELECT s.file_id, (s.n - 30) // 3 AS segment, c.n AS chunk, max(round(list_inner_product(s.v, c.v), 6)) AS score FROM v s JOIN v c ON c.file_id = s.file_id AND c.n < 30 WHERE s.n >= 30 GROUP BY ALL)
SELECT file_id, segment, chunk, score FROM c QUALIFY row_number() OVER (PARTITION BY file_id, segment ORDER BY score DESC, chunk) <= 3""")
def multi_anchor_union(spark: SparkSession, sf: str) -> DataFrame:
    """Segments of up to three parts, each part with its own vector, over the thirty chunks of their file."""
    rows = T.vectors(spark, sf).select(F.floor(F.col("id") / 40).alias("file_id"), (F.col("id") % 40).alias("n"), "vector")
    parts = rows.where("n >= 30").select("file_id", F.floor((F.col("n") - 30) / 3).alias("segment"), F.col("n").alias("part"), F.col("vector").alias("asked"))
    pairs = parts.join(rows.where("n < 30").withColumnRenamed("n", "chunk"), "file_id")
    scored = pairs.select("file_id", "segment", "part", "chunk", F.round(V.dot(F.col("asked"), F.col("vector")), 6).alias("score"))
    return O.union_of_parts(scored, 3)
