"""Retrieval and transcription quality."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def ranking_quality(ranked: DataFrame, gains: DataFrame, k: int) -> DataFrame:
    """(query_id, recall, mrr, precision, ndcg) of ranked (query_id, id, rank from 1) against gains (query_id, id, gain).

    What has no gain is irrelevant; a query of nothing relevant has recall 1
    and the rest 0.
    """
    relevant = gains.where("gain > 0")
    ideal = relevant.withColumn("_i", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("gain"), F.asc("id"))))
    ideal = ideal.groupBy("query_id").agg(F.sum(F.when(F.col("_i") <= k, F.col("gain") / F.log2(F.col("_i") + 1))).alias("best"), F.count("*").alias("n"))
    top = ranked.where(F.col("rank") <= k).join(relevant, ["query_id", "id"], "left").withColumn("gain", F.coalesce("gain", F.lit(0)))
    got = top.groupBy("query_id").agg(
        F.sum(F.col("gain") / F.log2(F.col("rank") + 1)).alias("dcg"), F.count_if(F.col("gain") > 0).alias("hits"), F.min(F.when(F.col("gain") > 0, F.col("rank"))).alias("first")
    )
    rows = got.join(ideal, "query_id", "left")
    zero = F.lit(0.0)
    return rows.select(
        "query_id",
        F.when(F.coalesce("n", F.lit(0)) == 0, 1.0).otherwise(F.col("hits") / F.col("n")).alias("recall"),
        F.coalesce(1 / F.col("first"), zero).alias("mrr"),
        (F.col("hits") / k).alias("precision"),
        F.coalesce(F.col("dcg") / F.col("best"), zero).alias("ndcg"),
    )


def span_match(a0: Column, a1: Column, b0: Column, b1: Column, iou: float = 0.3, coverage: float = 0.5) -> Column:
    """Whether span b answers span a: enough of their union is shared, or enough of a covered."""
    both = F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))
    union = (a1 - a0) + (b1 - b0) - both
    return ((union > 0) & (both / union >= iou)) | ((a1 > a0) & (both / (a1 - a0) >= coverage))


def offsets(rows: DataFrame, by: list[str]) -> DataFrame:
    """Mean, percentiles and hit rates of ``offset`` by group, and over all rows where the groups are null."""
    one = rows.withColumn("offset", F.col("offset").cast("double"))
    hits = [F.avg((F.col("offset") <= n).cast("double")).alias(f"hit_{n}") for n in (0, 1, 2, 5)]
    percentile = lambda p: F.expr(f"percentile(offset, {p})")
    return one.rollup(*by).agg(F.count("*").alias("n"), F.avg("offset").alias("mean"), percentile(0.5).alias("p50"), percentile(0.95).alias("p95"), F.max("offset").alias("max"), *hits)


def character_error_rate(reference: Column, hypothesis: Column) -> Column:
    return F.levenshtein(reference, hypothesis) / F.greatest(F.length(reference), F.lit(1))


def normalised(text: Column, language: Column) -> Column:
    """Folded, punctuation as white space and that as single spaces; Japanese in hiragana."""
    plain = X.folded(text)
    plain = F.when(F.startswith(F.lower(language), F.lit("ja")), X.to_hiragana(plain)).otherwise(plain)
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"[\p{P}\p{S}]", " "), r"\s+", " "))


def edits(a: Sequence, b: Sequence) -> int:
    """Levenshtein's distance of two sequences, a column of its table at a time as bits of a number (Myers, Hyyrö)."""
    if not a or not b:
        return len(a) + len(b)
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    whole, last, distance = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    more, less = whole, 0
    for x in b:
        same = places.get(x, 0)
        across = (((same & more) + more) ^ more) | same
        up, down = (less | ~(across | more)) & whole, more & across
        distance += 1 if up & last else -1 if down & last else 0
        up, down = up << 1 | 1, down << 1
        more, less = (down | ~(same | less | up)) & whole, up & (same | less) & whole
    return distance


def error_rates(rows: DataFrame, reference: str, hypothesis: str, language: Column) -> DataFrame:
    """``rows`` with wer and cer, the word and character error rates of two columns once normalised; Japanese has no word error rate.

    An empty reference counts as one word and one character.
    """
    rows = rows.select("*", language.alias("_l"), normalised(F.col(reference), language).alias("_a"), normalised(F.col(hypothesis), language).alias("_b"))
    spaced = F.coalesce(~F.startswith(F.lower(F.col("_l")), F.lit("ja")), F.lit(False))

    @F.pandas_udf("wer double, cer double")
    def rates(reference: pd.Series, hypothesis: pd.Series, spaced: pd.Series) -> pd.DataFrame:
        out = []
        for a, b, words in zip(reference, hypothesis, spaced):
            if a is None or b is None:
                out.append((None, None))
                continue
            x, y = ([w for w in t.split(" ") if w] for t in (a, b))
            out.append((edits(x, y) / max(len(x), 1) if words else None, edits(a, b) / max(len(a), 1)))
        return pd.DataFrame(out, columns=["wer", "cer"], dtype="float64")

    rows = rows.withColumn("_r", rates("_a", "_b", spaced))
    return rows.withColumn("wer", F.col("_r.wer")).withColumn("cer", F.col("_r.cer")).drop("_l", "_a", "_b", "_r")


def spread_of_runs(runs: DataFrame, key: str, value: str, epsilon: float) -> DataFrame:
    """(key, runs, median, least, most, unstable) of repeated measurements; unstable if they spread over ``epsilon``."""
    low, high = F.min(value), F.max(value)
    return runs.groupBy(key).agg(F.count(value).alias("runs"), F.median(value).alias("median"), low.alias("least"), high.alias("most"), (high - low > epsilon).alias("unstable"))


def compared(baseline: Column, current: Column, epsilon: float, lower_is_better: bool = False) -> Column:
    """``tied`` within ``epsilon``, else ``improved`` or ``regressed``."""
    gain = baseline - current if lower_is_better else current - baseline
    return F.when(F.abs(gain) <= epsilon, "tied").when(gain > 0, "improved").otherwise("regressed")


def mentions(text: Column, wanted: list[str], forbidden: list[str], normalise) -> tuple[Column, Column]:
    """The share of ``wanted`` that a text has, 1 if nothing is wanted, and how many of ``forbidden``, all normalised."""
    own = normalise(F.coalesce(text, F.lit("")))
    count = lambda needles: sum((F.contains(own, normalise(F.lit(n))).cast("int") for n in needles if n), F.lit(0))
    return (count(wanted) / len(wanted) if wanted else F.lit(1.0)), count(forbidden).cast("long")
