"""Fusing ranked channels, and shaping what is found: groups, budgets, windows, paging."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .vector import best

#: Rank fusion, score fusion and cut-offs (fixed values).
RRF_K, ALPHA, RATIO, RECALL_RATIO = 60, 0.7, 0.5, 0.2
TYPE_WEIGHTS = {"metadata": 1.3, "text_content": 0.9}
GROUP_WINDOW, NEAR_DUPLICATE, SHINGLE = 30.0, 0.6, 5


def file_ranks(channel: DataFrame) -> DataFrame:
    """(channel, query_id, id, score, rank): the best score of each file, ranked from 0, ties by id."""
    one = channel.groupBy("channel", "query_id", "id").agg(F.greatest(F.max("score"), F.lit(0.0)).alias("score"))
    order = Window.partitionBy("channel", "query_id").orderBy(F.desc("score"), F.asc("id"))
    return one.withColumn("rank", F.row_number().over(order) - 1)


def rrf(channels: DataFrame, weights: dict[str, float], k: int = RRF_K) -> DataFrame:
    """(query_id, id, score): sum of weight / (k + rank + 1) over the channels that have a file."""
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("channel")), F.lit(1.0))
    ranked = file_ranks(channels).withColumn("own", weight / (k + F.col("rank") + 1))
    return ranked.groupBy("query_id", "id").agg(F.sum("own").alias("score"))


def cosine_fusion(vector: DataFrame, keyword: DataFrame, alpha: float = ALPHA, weights: dict[str, float] | None = None) -> DataFrame:
    """(query_id, id, score): alpha of a file's best weighted vector score (…, kind, score) and the rest of its best keyword score."""
    weights = TYPE_WEIGHTS if weights is None else weights
    by_kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("kind")), F.lit(1.0))
    v = vector.groupBy("query_id", "id").agg(F.max(F.col("score") * by_kind).alias("v"))
    w = keyword.groupBy("query_id", "id").agg(F.max("score").alias("w"))
    both = v.join(w, ["query_id", "id"], "full")
    return both.select("query_id", "id", (alpha * F.coalesce("v", F.lit(0.0)) + (1 - alpha) * F.coalesce("w", F.lit(0.0))).alias("score"))


def cut_off(scored: DataFrame, ratio: float = RATIO, limit: int = 20) -> DataFrame:
    """The ``limit`` best of each query that reach ``ratio`` times its best score."""
    top = F.max("score").over(Window.partitionBy("query_id"))
    kept = scored.withColumn("_top", top).where(F.col("score") >= F.col("_top") * ratio).drop("_top")
    return best(kept, "query_id", [F.desc(F.round("score", 9)), F.asc("id")], limit)


def group_spans(spans: DataFrame, by: str, window: float = GROUP_WINDOW) -> DataFrame:
    """(by, start, end, n): spans (by, start, end) of a file put together while the next starts within ``window`` of their end.

    A span of no end lasts ``window``; one of no start is left out.
    """
    rows = spans.where(F.col("start").isNotNull()).withColumn("end", F.coalesce("end", F.col("start") + window))
    order = Window.partitionBy(by).orderBy("start", "end")
    until = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.coalesce((F.col("start") > until + window).cast("int"), F.lit(1)))
    rows = rows.withColumn("_group", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(by, "_group").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")).drop("_group")


def around(rows: DataFrame, spans: DataFrame, by: str, window: float) -> DataFrame:
    """Pairs of a span (by, span_id, at, until) and the rows (by, start, end, ...) that overlap it, ``window`` wider."""
    near = (F.col("start") <= F.col("until") + window) & (F.col("end") >= F.col("at") - window)
    return spans.join(rows, by).where(near)


def within_budget(rows: DataFrame, by: str, order: list[Column], size: str, budget: int, keep_first: bool = False) -> DataFrame:
    """The rows of each group, in order, up to the one at which the sum of sizes passes the budget."""
    own = Window.partitionBy(by).orderBy(*order)
    rows = rows.withColumn("used", F.sum(size).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    fits = F.col("used") <= budget
    if keep_first:
        rows = rows.withColumn("_n", F.row_number().over(own))
        return rows.where(fits | (F.col("_n") == 1)).drop("_n")
    return rows.where(fits)


def trim_history(turns: DataFrame, budget: int) -> DataFrame:
    """(conv, turn, text): a conversation's newest turns (conv, turn, text) that fit into half the budget, the newest cut to it if need be."""
    half = budget // 2
    sized = turns.withColumn("size", F.length("text"))
    kept = within_budget(sized, "conv", [F.desc("turn")], "size", half, keep_first=True)
    text = F.when(F.col("used") > half, F.substring("text", 1, half)).otherwise(F.col("text"))
    return kept.select("conv", "turn", text.alias("text"))


def pages(units: DataFrame, by: str, order: str, size: str, width: int) -> DataFrame:
    """Units with the page of ``width`` characters they begin on, and how far into it."""
    before = F.coalesce(F.sum(size).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return units.withColumn("page", F.floor(before / width).cast("long")).withColumn("offset", (before % width).cast("long"))


def excerpt_rows(rows: DataFrame, sections: DataFrame, by: str) -> DataFrame:
    """(by, section, text): the texts of rows (by, start, end, text) that strictly overlap a section (by, section, lo, hi), in order, joined by lines."""
    hit = (F.col("start") < F.col("hi")) & (F.coalesce("end", "start") > F.col("lo"))
    found = rows.join(sections, by).where(hit).groupBy(by, "section").agg(F.sort_array(F.collect_list(F.struct("start", "text"))).alias("_rows"))
    return found.select(by, "section", F.array_join(F.transform("_rows", lambda r: r["text"]), "\n").alias("text"))


def shingles(text: Column, n: int = SHINGLE) -> Column:
    """Distinct runs of ``n`` characters, lower-cased; a shorter text is its own."""
    low = F.lower(text)
    runs = F.regexp_extract_all(low, F.lit(f"(?s)(?=(.{{{n}}}))"))
    return F.when(F.length(low) >= n, F.array_distinct(runs)).otherwise(F.array(low))


def passage_overlap(passages: DataFrame) -> DataFrame:
    """(query_id, a, b, jaccard) of the passages (query_id, id, text) of a query that share a shingle, a < b.

    A text is cut into shingles once, however many queries have it; they are
    compared by 64-bit hashes. A query's passages, the top of a ranking, are
    one row.
    """
    one = passages.groupBy("id").agg(F.any_value("text").alias("text")).select("id", F.transform(shingles(F.col("text")), lambda s: F.xxhash64(s)).alias("s"))
    rows = passages.select("query_id", "id").distinct().join(one, "id").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("id", "s"))).alias("all"))
    pair = lambda x, y: F.struct(x["id"].alias("a"), y["id"].alias("b"), F.size(F.array_intersect(x["s"], y["s"])).alias("both"), (F.size(x["s"]) + F.size(y["s"])).alias("n"))
    pairs = F.flatten(F.transform("all", lambda x, i: F.transform(F.slice(F.col("all"), i + 2, F.size("all")), lambda y: pair(x, y))))
    found = rows.select("query_id", F.explode(pairs).alias("p")).select("query_id", "p.*").where("both > 0")
    return found.select("query_id", "a", "b", (F.col("both") / (F.col("n") - F.col("both"))).alias("jaccard"))


def accept_distinct(passages: DataFrame, overlap: DataFrame, limit: float = NEAR_DUPLICATE) -> DataFrame:
    """(query_id, id): passages (query_id, id, score) in order of score, but those near one already accepted.

    A query's passages are few: the top of a ranking.
    """
    close = overlap.where(F.col("jaccard") >= limit)
    near = close.select("query_id", F.col("a").alias("id"), F.col("b").alias("to")).unionByName(close.select("query_id", F.col("b").alias("id"), F.col("a").alias("to")))
    near = near.groupBy("query_id", "id").agg(F.collect_list("to").alias("near"))

    def accept(pdf: pd.DataFrame) -> pd.DataFrame:
        taken: list[int] = []
        for r in pdf.sort_values(["score", "id"], ascending=[False, True]).itertuples():
            if r.near is None or not set(r.near) & set(taken):
                taken.append(r.id)
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[0], "id": taken})

    joined = passages.select("query_id", "id", "score").join(near, ["query_id", "id"], "left")
    return joined.groupBy("query_id").applyInPandas(accept, "query_id long, id long")


def merge_tags(tags: DataFrame, have: DataFrame, k: int) -> DataFrame:
    """(id, tag, rank): candidates (id, tag, priority, position) once each, whatever their case, but for those a file has (id, tag)."""
    rows = tags.withColumn("low", F.lower("tag"))
    one = best(rows, ["id", "low"], [F.asc("priority"), F.asc("position"), F.asc("tag")], 1)
    new = one.join(have.select("id", F.lower("tag").alias("low")).distinct(), ["id", "low"], "left_anti")
    return best(new, "id", [F.asc("priority"), F.asc("position"), F.asc("low")], k, rank="rank").select("id", "tag", "rank")


def skip_fill(rows: DataFrame, by: str, budget: int) -> DataFrame:
    """(by, chunk): chunks (by, chunk, size, score) of a file, best first, each taken if it still fits, a smaller later one too."""

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        left, taken = budget, []
        for r in pdf.sort_values(["score", "chunk"], ascending=[False, True]).itertuples():
            if r.size_ <= left:
                left -= r.size_
                taken.append(r.chunk)
        return pd.DataFrame({by: pdf[by].iloc[0], "chunk": sorted(taken)})

    kind = dict(rows.dtypes)[by]
    return rows.withColumnRenamed("size", "size_").groupBy(by).applyInPandas(fill, f"{by} {kind}, chunk long")
