"""Whole searches, put together from the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import fusion, keyword, library, trigram, vector
from ..sources.scratch import bounded, kept

#: Channel weights of a search for recall (fixed values); for precision all are 1.
RECALL = {"text": 1.0, "clip": 0.2, "file": 1.0, "transcript": 1.5, "content": 1.5, "retrieval": 0.8}
#: Text channel of a search for recall: least score, and distance from the best (fixed values).
RECALL_FLOOR, RECALL_MARGIN = 0.75, 0.15
#: What a match is called, by the channel of its words, and the kinds of picture vectors (fixed values).
MATCH = {"file": "keyword", "transcript": "transcript_keyword", "content": "text_content_keyword", "retrieval": "retrieval_keywords"}
PICTURES = ("clip", "clip_thumbnail")


def hybrid(
    queries: DataFrame, phrases: DataFrame, rows: DataFrame, docs: DataFrame, columns: list[str], scope: DataFrame | None = None, recall: bool = False, floor: float | None = None, candidates: int = 50, limit: int = 20
) -> DataFrame:
    """(query_id, id, score): nearest vectors and BM25 fused by rank, within ``scope`` (id) from the start, and cut off.

    ``queries`` is (query_id, vector), ``phrases`` (query_id, phrase), ``rows``
    (id, vector), ``docs`` (id, columns...).
    """
    if scope is not None:
        rows, docs = rows.join(scope, "id", "left_semi"), docs.join(scope, "id", "left_semi")
    found = vector.neighbours(queries, rows, k=candidates)
    near = vector.guarded(found, (0.75 if recall else vector.TEXT_FLOOR) if floor is None else floor, None if recall else vector.GAP, 0.15 if recall else vector.MARGIN, flat=not recall)
    words = keyword.max_normalised(keyword.bm25(docs, phrases, columns))
    words = vector.best(words, "query_id", [F.desc(F.round("score", 9)), F.asc("id")], candidates)
    named = [df.select(F.lit(name).alias("channel"), "query_id", "id", "score") for name, df in (("text", near), ("content", words))]
    fused = fusion.rrf(reduce(DataFrame.unionByName, named), RECALL if recall else {})
    return fusion.cut_off(fused, fusion.RECALL_RATIO if recall else fusion.RATIO, limit)


def channel_matches(queries: DataFrame, terms: DataFrame, vectors: DataFrame, found: DataFrame, lengths: DataFrame | None, recall: bool = False, candidates: int = 50, floor: float | None = None, gap: float | None = vector.GAP) -> DataFrame:
    """(channel, query_id, id, chunk, kind, score): what the six channels let through, a row for each vector or chunk.

    ``queries`` is (query_id, vector), ``terms`` (query_id, term, phrase),
    ``vectors`` (vec_id, id, kind, vector, and chunk if known), ``found`` and ``lengths`` a trigram
    index of the channels file, transcript, content and retrieval, or their rows and None. Texts and
    pictures are guarded each in their way; words are scored over the best of
    their query and channel.
    """
    picture = F.col("kind").isin(*PICTURES)
    plain = lambda of: vectors.where(of).select(F.col("vec_id").alias("id"), "vector")
    floor = (RECALL_FLOOR if recall else vector.TEXT_FLOOR) if floor is None else floor
    margin = RECALL_MARGIN if recall else vector.MARGIN
    texts = vector.guarded(vector.neighbours(queries, plain(~picture), k=candidates), floor, None if recall else gap, margin, flat=not recall)
    pictures = vector.guarded(vector.neighbours(queries, plain(picture), k=candidates), vector.CLIP_FLOOR, None, margin, flat=False)
    near = texts.withColumn("channel", F.lit("text")).unionByName(pictures.withColumn("channel", F.lit("clip")))
    chunk = F.col("chunk") if "chunk" in vectors.columns else F.lit(None)
    near = near.withColumnRenamed("id", "vec_id").join(vectors.select("vec_id", "id", "kind", chunk.cast("long").alias("chunk")), "vec_id")
    near = near.select("channel", "query_id", "id", "chunk", "kind", "score")
    words = trigram.normalised(trigram.bm25(found, lengths, terms, candidates))
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in MATCH.items() for x in kv]), F.col("channel"))
    return near.unionByName(words.select("channel", "query_id", "id", "chunk", kind.alias("kind"), "score"))


def fused_channels(matches: DataFrame, recall: bool = False, required: DataFrame | None = None, limit: int = 20) -> DataFrame:
    """(query_id, id, score, types): :func:`channel_matches` as files, fused and cut off.

    For recall by rank, with weights; for precision by score, where a file with
    a picture match stays whatever its score. ``required`` (query_id, id) are
    files that hold a query's required terms: no others stay, and those that no
    channel found come in just above the cut-off.
    """
    ratio = fusion.RECALL_RATIO if recall else fusion.RATIO
    matches = kept(matches, "matches")
    if recall:
        scored = fusion.rrf(matches.select("channel", "query_id", "id", "score"), RECALL)
    else:
        by_vector = F.col("channel").isin("text", "clip")
        scored = fusion.cosine_fusion(matches.where(by_vector), matches.where(~by_vector))
    types = matches.groupBy("query_id", "id").agg(F.array_sort(F.collect_set("kind")).alias("types"))
    scored = scored.join(types, ["query_id", "id"])
    if required is not None:
        # unseen files of a query are alike but for their ids, and no more of them than the limit can come in
        seen = bounded(scored.select("query_id", "id", F.col("id").alias("_seen")))
        required = vector.best(required.join(seen, ["query_id", "id"], "left"), ["query_id", "_seen"], [F.asc("id")], limit).drop("_seen")
        floors = library.required_floor(scored.select("query_id", "id", "score"), required, ratio)
        scored = floors.join(types, ["query_id", "id"], "left").withColumn("types", F.coalesce("types", F.array(F.lit("required"))))
    top = F.max("score").over(Window.partitionBy("query_id"))
    stays: Column = F.col("score") >= F.col("_top") * ratio
    if not recall:
        stays = stays | F.arrays_overlap("types", F.array(*[F.lit(p) for p in PICTURES]))
    above = scored.withColumn("_top", top).where(stays).drop("_top")
    return vector.best(above, "query_id", [F.desc(F.round("score", 9)), F.asc("id")], limit)


def passages(matches: DataFrame, texts: DataFrame, terms: DataFrame, alpha: float = fusion.ALPHA) -> DataFrame:
    """(query_id, id, place, chunk, score, keyword, text): one for each place that :func:`channel_matches` point at.

    Transcripts are utterances, pictures scenes, contents texts; matches of no
    chunk point at none. A place's score is alpha of its best weighted vector
    and the rest of its best words, to four digits. ``texts`` is (place, id,
    chunk, text); a place found by words shows its text from 40 characters
    before the first term (query_id, phrase) if that is beyond the first 200.
    """
    kinds = {"whisper": "utterance", "transcript_keyword": "utterance", "clip": "scene", "text_content": "text", "text_content_keyword": "text"}
    place = F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("kind"))
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in fusion.TYPE_WEIGHTS.items() for x in kv]), F.col("kind")), F.lit(1.0))
    by_vector = F.col("channel").isin("text", "clip")
    rows = matches.withColumn("place", place).where("place is not null and chunk is not null")
    one = kept(rows.groupBy("query_id", "id", "place", "chunk").agg(F.max(F.when(by_vector, F.col("score") * weight)).alias("v"), F.max(F.when(~by_vector, F.col("score"))).alias("w")), "places")
    score = F.round(alpha * F.coalesce("v", F.lit(0.0)) + (1 - alpha) * F.coalesce("w", F.lit(0.0)), 4)
    asked = terms.groupBy("query_id").agg(F.collect_set(F.lower("phrase")).alias("terms"))
    texts = texts.join(bounded(one.select("place", "id", "chunk").distinct()), ["place", "id", "chunk"], "left_semi")
    shown = one.join(texts, ["place", "id", "chunk"], "left").join(asked, "query_id", "left")
    low = F.lower("text")
    first = F.array_min(F.filter(F.transform("terms", lambda t: F.instr(low, t)), lambda at: at > 0))
    start = F.greatest(first - 40, F.lit(1))
    excerpt = F.concat(F.when(start > 1, "…").otherwise(""), F.col("text").substr(start, F.lit(200)), F.when(start + 199 < F.length("text"), "…").otherwise(""))
    inside = F.exists("terms", lambda t: F.contains(F.substring(low, 1, 200), t))
    text = F.when(F.col("place") == "scene", "").when(F.col("w").isNotNull() & ~F.coalesce(inside, F.lit(False)) & first.isNotNull(), excerpt).otherwise(F.substring("text", 1, 200))
    return shown.select("query_id", "id", "place", "chunk", score.alias("score"), F.col("w").isNotNull().alias("keyword"), text.alias("text"))


def shortlist(queries: DataFrame, summaries: DataFrame, files: DataFrame, top_k: int) -> DataFrame:
    """(query_id, id, score, rank, drive_files): the files whose summaries are nearest to each query (query_id, drive, vector) in its drive.

    ``summaries`` is (vec_id, id, drive, vector), ``files`` (id, drive); a file
    counts by its best summary. ``drive_files`` is how many files the drive has.
    """
    rows = summaries.select(F.col("vec_id").alias("id"), F.col("id").alias("file"), "drive", "vector")
    near = vector.neighbours(queries, rows, same="drive", group="file", k=top_k)
    ranked = vector.best(near, "query_id", [F.desc("score"), F.asc("id")], top_k, rank="rank")
    sizes = files.groupBy("drive").agg(F.count_distinct("id").alias("drive_files"))
    return ranked.join(queries.select("query_id", "drive"), "query_id").join(sizes, "drive").select("query_id", "id", "score", "rank", "drive_files")


def chunks_within(queries: DataFrame, listed: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """(query_id, id, chunk, score): the ``n`` chunks nearest to a query in each file of its shortlist (query_id, id); rows are (id, chunk, vector)."""
    pairs = listed.select("query_id", "id").join(queries.select("query_id", F.col("vector").alias("_q")), "query_id").join(rows, "id")
    scored = pairs.select("query_id", "id", "chunk", V.dot(V.doubles("_q"), V.doubles("vector")).alias("score"))
    return vector.best(scored, ["query_id", "id"], [F.desc(F.round("score", 9)), F.asc("chunk")], n)


def merge_clues(lists: DataFrame, top_k: int) -> DataFrame:
    """(query_id, id, score): the result lists of a query's clues (query_id, clue, id, score) fused by rank.

    Clues count from 1 down to a half, in their order.
    """
    ranked = fusion.file_ranks(lists.withColumn("channel", F.col("clue").cast("string")))
    clues = lists.groupBy("query_id").agg(F.max("clue").alias("last"))
    weight = F.when(F.col("last") > 0, 1 - 0.5 * F.col("channel").cast("int") / F.col("last")).otherwise(1.0)
    merged = ranked.join(clues, "query_id").groupBy("query_id", "id").agg(F.sum(weight / (fusion.RRF_K + F.col("rank") + 1)).alias("score"))
    return vector.best(merged, "query_id", [F.desc(F.round("score", 9)), F.asc("id")], top_k)
