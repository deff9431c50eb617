"""Vector search: exact nearest neighbours, channel guards, similar items, segments, votes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import kept

#: Default limits of the search channels (fixed values).
TEXT_FLOOR, CLIP_FLOOR, IMAGE_FLOOR = 0.85, 0.05, 0.70
GAP, MARGIN, FLATNESS, FLAT_ROWS = 0.02, 0.05, 0.01, 5
SIMILAR_FLOOR, SIMILAR_GAP, SIMILAR_SURE, IDENTICAL = 0.70, 0.01, 0.85, 0.999
SEGMENT_GAP, SEGMENT_TAIL, SEGMENT_FILES, SEGMENTS_PER_FILE = 45.0, 30.0, 30, 2


#: Queries and rows of one matrix product in a task: 16 MB of scores.
QUERY_TILE, ROW_TILE = 512, 4096
#: Scores that a task holds before it keeps only the best.
HELD = 1_000_000


def _first_k(scores: np.ndarray, k: int) -> np.ndarray:
    """Where the k greatest of each row are, of equal ones the first; -inf never."""
    open_ = scores > -np.inf
    if scores.shape[1] <= k:
        return open_
    least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k, None]
    above, level = scores > least, scores == least
    room = k - above.sum(axis=1, keepdims=True)
    return (above | (level & (np.cumsum(level, axis=1) <= room))) & open_


def best_held(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]], least: np.ndarray, k: int, digits: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query among (query, id, score), to so many digits if given, ties by id; ``least`` gets the last score of those that have k."""
    query, ids, scores = (np.concatenate(c) for c in zip(*held))
    level = scores if digits is None else np.round(scores, digits)
    order = np.lexsort((ids, -level, query))
    own = query[order]
    begin = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    size = np.diff(np.r_[begin, len(own)])
    order = order[np.arange(len(own)) - np.repeat(begin, size) < k]
    full = size >= k
    least[own[begin[full]]] = level[order[np.searchsorted(query[order], own[begin[full]], "right") - 1]]
    return query[order], ids[order], scores[order]


def neighbours(
    queries: DataFrame, rows: DataFrame, k: int | None = None, floor: float | None = None, same: str | None = None, group: str | None = None, queries_at_once: int = 8192
) -> DataFrame:
    """(query_id, id, score) for the ``k`` best rows of each query, or all of ``floor`` or more.

    ``queries`` has (query_id, vector), ``rows`` (id, vector); with ``same``, both
    have that column and only rows of equal value are compared. The score is
    the inner product, ties go to the lesser id. Queries go out in blocks of
    bounded size, each against all rows in tiles of one matrix product; a
    batch gives k rows for a query at most, before they are shuffled. With
    ``group``, a column of whole numbers of ``rows``, its values take the place
    of ids, and a group's score is that of its best row: a batch then gives one
    row for a query and group.
    """
    spark = rows.sparkSession
    extra = [same] if same else []
    if group:
        rows = rows.withColumn("id", F.col(group).cast("long"))
    plan = queries.select("query_id", "vector", *extra)
    n = plan.count()
    blocks = max(1, -(-n // queries_at_once))
    plan = plan.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    parts = []
    for block in range(blocks):
        local = plan.where(F.col("_block") == block).toArrow().to_pandas()
        if not len(local):
            continue
        ids = local["query_id"].to_numpy()
        matrix = np.stack([np.asarray(v, np.float64) for v in local["vector"]])
        kinds = local[same].to_numpy() if same else None
        shared = spark.sparkContext.broadcast((ids, matrix, kinds))

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, matrix, kinds = shared.value
            for pdf in batches:
                for begin in range(0, len(pdf), ROW_TILE):
                    tile = pdf.iloc[begin : begin + ROW_TILE].sort_values("id", kind="stable")
                    own = tile["id"].to_numpy()
                    vectors = np.stack([np.asarray(v, np.float64) for v in tile["vector"]]).T
                    starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                    for q in range(0, len(ids), QUERY_TILE):
                        sims = matrix[q : q + QUERY_TILE] @ vectors
                        if kinds is not None:
                            sims[kinds[q : q + QUERY_TILE, None] != tile[same].to_numpy()[None, :]] = -np.inf
                        if floor is not None:
                            sims[sims < floor] = -np.inf
                        if group:
                            sims = np.maximum.reduceat(sims, starts, axis=1)
                        places = own[starts] if group else own
                        row, column = np.nonzero(_first_k(sims, k) if k is not None else sims > -np.inf)
                        if len(row):
                            yield pd.DataFrame({"query_id": ids[q + row], "id": places[column], "score": sims[row, column]})

        parts.append(rows.select("id", "vector", *extra).mapInPandas(score, "query_id long, id long, score double"))
    if not parts:
        return spark.createDataFrame([], "query_id long, id long, score double")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    if group:
        found = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    if k is None:
        return found
    return best(found, "query_id", [F.desc("score"), F.asc("id")], k)


def best(df: DataFrame, by: str | list[str], order: list[Column], k: int, rank: str | None = None) -> DataFrame:
    """The first ``k`` rows of each group, with their rank from 1 if that is named."""
    keys = [by] if isinstance(by, str) else by
    ranked = df.withColumn(rank or "_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    ranked = ranked.where(F.col(rank or "_rank") <= k)
    return ranked if rank else ranked.drop("_rank")


def guarded(found: DataFrame, floor: float = TEXT_FLOOR, gap: float | None = GAP, margin: float = MARGIN, flat: bool = True, allow: Column | None = None) -> DataFrame:
    """Neighbours of (query_id, id, score) that a channel lets through.

    A query's rows all go if the best is less than ``gap`` above their mean, or
    if five or more of them are nearly equal; both are judged before ``allow``,
    a condition on rows. Then each must reach ``floor``, and come within
    ``margin`` of the best that did.
    """
    whole = Window.partitionBy("query_id")
    rows = found
    if gap is not None:
        rows = rows.withColumn("_open", F.max("score").over(whole) - F.avg("score").over(whole) >= gap)
    if flat:
        mean = F.avg("score").over(whole)
        level = (F.count("*").over(whole) >= FLAT_ROWS) & (mean > 0) & (F.stddev_pop("score").over(whole) / mean < FLATNESS)
        rows = rows.withColumn("_flat", level)
    for name, keep in (("_open", True), ("_flat", False)):
        if name in rows.columns:
            rows = rows.where(F.col(name) == keep).drop(name)
    if allow is not None:
        rows = rows.where(allow)
    rows = rows.where(F.col("score") >= floor)
    return rows.withColumn("_best", F.max("score").over(whole)).where(F.col("score") >= F.col("_best") - margin).drop("_best")


def similar_filters(found: DataFrame, floor: float = SIMILAR_FLOOR, gap: float = SIMILAR_GAP, sure: float = SIMILAR_SURE, margin: float = MARGIN) -> DataFrame:
    """Similar items of (query_id, id, score): no identical ones, none below ``floor``, none far from the best.

    Five or more candidates that tell nothing apart are all dropped, unless the
    best of them is ``sure``.
    """
    whole = Window.partitionBy("query_id")
    rows = found.where((F.col("score") < IDENTICAL) & (F.col("score") >= floor))
    top, mean, n = F.max("score").over(whole), F.avg("score").over(whole), F.count("*").over(whole)
    unsure = (n >= FLAT_ROWS) & (top < sure)
    rows = rows.withColumn("_drop", unsure & (top - mean < gap)).where(~F.col("_drop")).drop("_drop")
    rows = rows.withColumn("_top", top).where(F.col("score") >= F.col("_top") - margin).drop("_top")
    spread = F.stddev_pop("score").over(whole) / F.avg("score").over(whole)
    rows = rows.withColumn("_drop", (F.count("*").over(whole) >= FLAT_ROWS) & (F.max("score").over(whole) < sure) & (spread < FLATNESS))
    return rows.where(~F.col("_drop")).drop("_drop")


def _grouped(batches: Iterator[pd.DataFrame], matrix: np.ndarray, kinds: np.ndarray | None, same: str | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(queries, groups, scores): tiles of the best score of each group for some rows of ``matrix``, from rows in the order of kind and group.

    A group that goes on in the next tile is held back, one number for a query.
    """
    places = {None: np.arange(len(matrix))} if kinds is None else {kind: np.flatnonzero(kinds == kind) for kind in set(kinds)}
    held = None
    for pdf in batches:
        for begin in range(0, len(pdf), ROW_TILE):
            tile = pdf.iloc[begin : begin + ROW_TILE]
            for kind, run in tile.groupby(same, sort=False) if same else [(None, tile)]:
                if kind not in places:
                    continue
                own, mine = run["id"].to_numpy(), places[kind]
                vectors = np.stack([np.asarray(v, np.float64) for v in run["vector"]]).T
                starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                if held and held[:2] != (kind, own[0]):
                    yield places[held[0]], np.array([held[1]]), held[2][:, None]
                    held = None
                last = np.empty(len(mine))
                for q in range(0, len(mine), QUERY_TILE):
                    part = mine[q : q + QUERY_TILE]
                    sims = np.maximum.reduceat(matrix[part] @ vectors, starts, axis=1)
                    if held:
                        sims[:, 0] = np.maximum(sims[:, 0], held[2][q : q + QUERY_TILE])
                    last[q : q + QUERY_TILE] = sims[:, -1]
                    if len(starts) > 1:
                        yield part, own[starts[:-1]], sims[:, :-1]
                held = (kind, own[-1], last)
    if held:
        yield places[held[0]], np.array([held[1]]), held[2][:, None]


def similar(
    queries: DataFrame, rows: DataFrame, group: str, k: int, floor: float = SIMILAR_FLOOR, gap: float = SIMILAR_GAP, sure: float = SIMILAR_SURE, margin: float = MARGIN, same: str | None = None, queries_at_once: int = 16_384
) -> DataFrame:
    """(query_id, id, score): the ``k`` best groups like each query that :func:`similar_filters` lets through, other than its own.

    ``queries``, ``rows``, ``group`` and ``same`` are those of :func:`neighbours`;
    a query's own group is the one of its id. Rows are dealt by group and gone
    through twice: for the number, the sum and the best of a query's
    candidates, and then for those that come near enough to the best. A task
    gives a few numbers for a query and its ``k`` best of each tile, so that
    no other pairs are shuffled.
    """
    spark, extra = rows.sparkSession, [same] if same else []
    plan = kept(queries.select("query_id", "vector", *extra), "queries")
    blocks = max(1, -(-plan.count() // queries_at_once))
    plan = plan.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    rows = rows.select(F.col(group).cast("long").alias("id"), "vector", *extra).where("id is not null")
    if same:
        rows = rows.join(F.broadcast(plan.select(same).distinct()), same, "left_semi")
    tasks = max(4 * spark.sparkContext.defaultParallelism, rows.count() // 20_000)
    dealt = rows.repartition(tasks, "id").sortWithinPartitions(*extra, "id")

    def each_block(asked: DataFrame, look: Callable, schema: str) -> DataFrame:
        parts = []
        for block in range(blocks):
            local = asked.where(F.col("_block") == block).toArrow().to_pandas()
            if not len(local):
                continue
            matrix = np.stack([np.asarray(v, np.float64) for v in local["vector"]])
            shared = spark.sparkContext.broadcast((local["query_id"].to_numpy(), matrix, local[same].to_numpy() if same else None, local["top"].to_numpy() if "top" in local else None))
            parts.append(dealt.mapInPandas(look(shared), schema))
        return kept(reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema), "similar")

    def count(shared):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, matrix, kinds, _ = shared.value
            n, total, top = np.zeros(len(ids), np.int64), np.zeros(len(ids)), np.full(len(ids), -np.inf)
            for part, groups, sims in _grouped(batches, matrix, kinds, same):
                fits = (sims >= floor) & (sims < IDENTICAL) & (groups[None, :] != ids[part, None])
                n[part] += fits.sum(axis=1)
                total[part] += np.where(fits, sims, 0.0).sum(axis=1)
                top[part] = np.maximum(top[part], np.where(fits, sims, -np.inf).max(axis=1))
            some = n > 0
            yield pd.DataFrame({"query_id": ids[some], "n": n[some], "total": total[some], "top": top[some]})

        return run

    def choose(shared):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, matrix, kinds, top = shared.value
            least = np.maximum(top - margin, floor)
            n, off, square = np.zeros(len(ids), np.int64), np.zeros(len(ids)), np.zeros(len(ids))
            for part, groups, sims in _grouped(batches, matrix, kinds, same):
                fits = (sims >= least[part, None]) & (sims < IDENTICAL) & (groups[None, :] != ids[part, None])
                some = np.flatnonzero(fits.any(axis=1))
                if not len(some):
                    continue
                part, sims, fits = part[some], sims[some], fits[some]
                below = np.where(fits, top[part, None] - sims, 0.0)
                n[part] += fits.sum(axis=1)
                off[part] += below.sum(axis=1)
                square[part] += (below * below).sum(axis=1)
                row, column = np.nonzero(_first_k(np.where(fits, np.round(sims, 9), -np.inf), k))
                yield pd.DataFrame({"query_id": ids[part[row]], "id": groups[column], "score": sims[row, column], "n": 0, "off": 0.0, "square": 0.0})
            some = n > 0
            yield pd.DataFrame({"query_id": ids[some], "id": 0, "score": top[some], "n": n[some], "off": off[some], "square": square[some]})

        return run

    counted = each_block(plan, count, "query_id long, n long, total double, top double")
    counted = counted.groupBy("query_id").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("top").alias("top"))
    unsure = (F.col("n") >= FLAT_ROWS) & (F.col("top") < sure)
    plan = plan.join(counted.where(~(unsure & (F.col("top") - F.col("total") / F.col("n") < gap))).select("query_id", "top"), "query_id")
    chosen = each_block(plan, choose, "query_id long, id long, score double, n long, off double, square double")
    near = chosen.where("n > 0").groupBy("query_id").agg(F.sum("n").alias("n"), F.max("score").alias("top"), F.sum("off").alias("off"), F.sum("square").alias("square"))
    off = F.col("off") / F.col("n")
    spread = F.sqrt(F.greatest(F.col("square") / F.col("n") - off * off, F.lit(0.0))) / (F.col("top") - off)
    open_ = near.where(~(unsure & (spread < FLATNESS))).select("query_id")
    found = chosen.where("n = 0").select("query_id", "id", "score").join(open_, "query_id")
    return best(found, "query_id", [F.desc(F.round("score", 9)), F.asc("id")], k)


def merge_similar(left: DataFrame, right: DataFrame, alone: float = 0.7) -> DataFrame:
    """(query_id, id, score, sources) of two lists, each scaled to 0..1 within its query.

    What both lists have gets the mean of the two, the rest ``alone`` times its own.
    """
    whole = Window.partitionBy("query_id")
    low, high = F.min("score").over(whole), F.max("score").over(whole)
    scaled = lambda df, name: df.select("query_id", "id", F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(1.0).alias(name))
    both = scaled(left, "a").join(scaled(right, "b"), ["query_id", "id"], "full")
    score = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 0.5 * F.col("a") + 0.5 * F.col("b")).otherwise(alone * F.coalesce("a", "b"))
    sources = F.when(F.col("a").isNull(), "right").when(F.col("b").isNull(), "left").otherwise("both")
    return both.select("query_id", "id", score.alias("score"), sources.alias("sources"))


def segments(hits: DataFrame, gap: float = SEGMENT_GAP, tail: float = SEGMENT_TAIL, per_file: int = SEGMENTS_PER_FILE, frames: DataFrame | None = None, durations: DataFrame | None = None) -> DataFrame:
    """(file_id, start, end, peak, peak_ts, hits): runs of hits (file_id, ts, score) at most ``gap`` apart.

    A segment ends ``tail`` after its last hit, or at the file's next frame of
    ``frames`` (file_id, ts), a hit or not, or where the file ends by
    ``durations`` (file_id, duration), whichever comes first; without frames
    the hits are all there are. The ``per_file`` segments of the best peaks stay.
    """
    own = Window.partitionBy("file_id").orderBy("ts", "score")
    rows = hits.withColumn("_new", F.coalesce((F.col("ts") - F.lag("ts").over(own) > gap).cast("int"), F.lit(1)))
    rows = rows.withColumn("_run", F.sum("_new").over(own))
    times = (hits if frames is None else frames).select("file_id", "ts").unionByName(hits.select("file_id", "ts")).distinct()
    after = times.withColumn("_next", F.lead("ts").over(Window.partitionBy("file_id").orderBy("ts"))).withColumnRenamed("ts", "_last")
    groups = rows.groupBy("file_id", "_run").agg(F.min("ts").alias("start"), F.max("ts").alias("_last"), F.max(F.struct("score", (-F.col("ts")).alias("before"))).alias("top"), F.count("*").alias("hits"))
    groups = groups.join(after, ["file_id", "_last"], "left")
    groups = groups.join(durations.groupBy("file_id").agg(F.max("duration").alias("_whole")), "file_id", "left") if durations is not None else groups.withColumn("_whole", F.lit(None).cast("double"))
    end = F.least(F.col("_last") + tail, "_next", F.when(F.col("_whole") > F.col("_last"), F.col("_whole")))
    groups = groups.select("file_id", "start", end.alias("end"), F.col("top.score").alias("peak"), (-F.col("top.before")).alias("peak_ts"), "hits")
    return best(groups, "file_id", [F.desc("peak"), F.asc("start")], per_file)


def required_seeds(n: int) -> int:
    """How many of ``n`` frames seed segments: 50, or a tenth if that is less, or a hundredth if that is more, and 4,096 at most."""
    return min(max(min(50, -(-n // 10)), n // 100), 4096)


def seeded_segments(frames: DataFrame, files: int = SEGMENT_FILES, gap: float = SEGMENT_GAP, tail: float = SEGMENT_TAIL, durations: DataFrame | None = None) -> DataFrame:
    """:func:`segments` of those frames (file_id, ts, score) that reach the score of the last required seed, in the ``files`` best files.

    The threshold's rank is 4,096 at most, so that it is found by a top-k.
    """
    lowest = frames.orderBy(F.desc("score")).limit(required_seeds(frames.count())).agg(F.min("score").alias("lowest"))
    seeds = frames.join(F.broadcast(lowest), F.col("score") >= F.col("lowest")).drop("lowest")
    top = seeds.groupBy("file_id").agg(F.max("score").alias("_top")).orderBy(F.desc("_top"), "file_id").limit(files)
    top = F.broadcast(top.select("file_id"))
    return segments(seeds.join(top, "file_id", "left_semi"), gap, tail, frames=frames.join(top, "file_id", "left_semi"), durations=durations)


def tag_votes(found: DataFrame, tags: DataFrame, min_support: int = 2, k: int = 10) -> DataFrame:
    """(query_id, tag, score, support): tags (id, tag) of the neighbours, weighted by their scores."""
    votes = found.join(tags, "id").groupBy("query_id", "tag").agg(F.sum("score").alias("score"), F.count("*").alias("support"))
    return best(votes.where(F.col("support") >= min_support), "query_id", [F.desc(F.round("score", 9)), F.asc("tag")], k)


def concept_scores(found: DataFrame) -> DataFrame:
    """(concept, frames, top, weight) of neighbours (query_id as the concept): how many, and how good the best is."""
    one = found.groupBy(F.col("query_id").alias("concept")).agg(F.count("*").alias("frames"), F.max("score").alias("top"))
    return one.withColumn("weight", F.col("frames") * F.col("top"))
