"""Where a summary's segments are in their file: sections as ranges of chunks, keyword ranks inside a file, compound segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..sources.scratch import bounded, kept
from . import sequence, trigram
from .vector import best

#: Least cosine of a section's chunks, chunks of a section that count, chunks on either side that a range takes in (fixed values).
NARROW, RANGE_TOP, BOUNDARY = 0.5, 12, 2
#: Candidates of a segment, and characters of a part of a compound segment and of one in brackets (fixed values).
POOL, PART, BRACKETED = 10, 4, 2
#: What parts of a compound segment are cut at, and brackets (fixed patterns).
CUTS, BRACKETS = "[。、，,・；;]+", "「([^「」]+?)」"


def prefix_ranges(segments: DataFrame, chunks: DataFrame, floor: float = NARROW, top: int = RANGE_TOP, boundary: int = BOUNDARY) -> DataFrame:
    """(file_id, prefix, first, last): the chunks that each heading of a summary speaks about.

    ``segments`` is (file_id, segment, path, vector), path being the headings
    above a segment, ``chunks`` (file_id, chunk, vector). A prefix of paths has
    the mean vector of all segments below it. Two or more prefixes under one
    heading are laid along the file's chunks in the order of the summary, each
    chunk going by how far a prefix exceeds its best sibling, and take in
    ``boundary`` chunks more on either side; one alone has its densest run of
    chunks over ``floor``. A prefix without vectors, without chunks of its own
    or without a run has nulls. Segments of no path belong to no prefix.
    """
    rows = segments.where(F.size("path") > 0).select("file_id", "segment", "vector", "path", F.explode(F.sequence(F.lit(1), F.size("path"))).alias("depth"))
    rows = rows.select("file_id", "segment", "vector", "depth", F.slice("path", 1, F.col("depth")).alias("prefix"))
    seen = rows.groupBy("file_id", "prefix", "depth").agg(F.min("segment").alias("seen"))
    number = F.row_number().over(Window.partitionBy("file_id").orderBy("seen", "depth")).cast("long")
    tree = seen.withColumn("segment", number)
    above = tree.select("file_id", F.col("prefix").alias("up"), F.col("segment").alias("parent"))
    up = F.slice("prefix", 1, F.col("depth") - 1)
    tree = kept(tree.withColumn("up", up).join(above, ["file_id", "up"], "left").select("file_id", "prefix", "segment", F.coalesce("parent", F.lit(0)).alias("parent")), "prefixes")
    pools = V.pool(rows.where("vector is not null").drop("segment").join(tree, ["file_id", "prefix"]), ["file_id", "parent", "segment"], "vector")
    pools = pools.withColumn("siblings", F.count("*").over(Window.partitionBy("file_id", "parent"))).withColumnRenamed("vector", "pool")
    score = F.round(F.least(F.greatest(F.coalesce(V.cosine(F.col("pool"), V.doubles("vector")), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)), 6)
    scores = kept(pools.join(chunks.select("file_id", F.col("chunk").cast("long").alias("chunk"), "vector"), "file_id").select("file_id", "parent", "segment", "siblings", "chunk", score.alias("score")), "prefix-scores")
    rivals = Window.partitionBy("file_id", "parent", "chunk").orderBy(F.desc("score"), F.asc("segment")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    other = F.when(F.first("segment").over(rivals) == F.col("segment"), F.nth_value("score", 2).over(rivals)).otherwise(F.first("score").over(rivals))
    lead = scores.where("siblings > 1").select("file_id", "parent", "segment", "chunk", F.round(F.col("score") - other, 6).alias("score"))
    laid = sequence.align_monotonic(lead, ("file_id", "parent")).groupBy("file_id", "segment").agg(F.min("chunk").alias("first"), F.max("chunk").alias("last"))
    laid = laid.select("file_id", "segment", F.greatest(F.col("first") - boundary, F.lit(0)).alias("first"), (F.col("last") + boundary).alias("last"))
    lone = sequence.narrow_clusters(scores.where("siblings = 1").select("file_id", "segment", "chunk", "score"), top=top, floor=floor).select("file_id", "segment", "first", "last")
    return tree.join(laid.unionByName(lone), ["file_id", "segment"], "left").select("file_id", "prefix", "first", "last")


def in_file_ranks(rows: DataFrame, segments: DataFrame, ranges: DataFrame | None = None, k: int = POOL) -> DataFrame:
    """(file_id, segment, kind, chunk, rank): a segment's best chunks of its own file by keywords, from 1; transcripts come before documents.

    ``rows`` is (channel, id, chunk, fields) with the channels transcript and
    document, ``segments`` (file_id, segment, text). Chunks match by any salient
    part of the segment's text, of three characters or more; scores are BM25
    over the whole channel. With ``ranges`` (file_id, segment, first, last),
    only chunks within them count. A segment without salient parts has no rows.
    """
    keyed = segments.select(F.to_json(F.struct("file_id", "segment")).alias("query_id"), F.col("file_id").alias("id"), "segment", F.explode(X.salient_tokens(F.col("text"))).alias("phrase"))
    scored = trigram.bm25(rows, None, keyed.select("query_id", "id", F.lit(0).alias("term"), "phrase"))
    named = scored.join(keyed.select("query_id", "segment").distinct(), "query_id").select(F.col("id").alias("file_id"), "segment", F.col("channel").alias("kind"), "chunk", "score")
    if ranges is not None:
        named = named.join(bounded(ranges), ["file_id", "segment"], "left").where("first is null or chunk between first and last").drop("first", "last")
    first = best(named, ["file_id", "segment", "kind"], [F.desc(F.round("score", 9)), F.asc("chunk")], k, rank="own")
    order = [F.desc(F.col("kind") == "transcript"), F.asc("own")]
    return best(first, ["file_id", "segment"], order, k, rank="rank").select("file_id", "segment", "kind", "chunk", "rank")


def compound_parts(text: Column, kind: Column) -> Column:
    """The parts of a compound bullet, or the whole text alone.

    Two or more phrases in corner brackets are the parts; else the pieces
    between list signs that are long enough and have something salient, if
    there are two at least. Only bullets have parts.
    """
    whole = F.trim(text)
    inside = F.filter(F.transform(F.regexp_extract_all(whole, F.lit(BRACKETS)), lambda p: F.trim(p)), lambda p: F.length(p) >= BRACKETED)
    pieces = F.filter(F.transform(F.split(whole, CUTS), lambda p: F.trim(p)), lambda p: (F.length(p) >= PART) & F.regexp_like(p, F.lit(X.SALIENT)))
    parts = F.when(F.size(inside) >= 2, inside).when(F.size(pieces) >= 2, pieces).otherwise(F.array(whole))
    return F.when(F.coalesce(kind, F.lit("")) == "bullet", parts).otherwise(F.array(whole))


def union_of_parts(candidates: DataFrame, k: int) -> DataFrame:
    """(file_id, segment, chunk, score): the ``k`` best chunks of any part (file_id, segment, part, chunk, score), each by its best score."""
    one = candidates.groupBy("file_id", "segment", "chunk").agg(F.max("score").alias("score"))
    return best(one, ["file_id", "segment"], [F.desc("score"), F.asc("chunk")], k)
