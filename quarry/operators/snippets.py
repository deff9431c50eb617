"""Snippets: chunks of a text, what surrounds and overlaps them, and the terms that look for them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

from ..functions import text as X

#: Widths and limits of snippets (fixed values).
CHUNK_WIDTH, BREAK_WITHIN, AROUND = 500, 100, 100
QUOTE_WIDTH, QUOTE_ACCEPTED, EXPANSIONS = 64, 3000, 8


def line_chunks(text: Column, width: int = CHUNK_WIDTH, within: int = BREAK_WITHIN) -> Column:
    """The text cut into chunks of ``width`` characters at most, as an array.

    A cut moves back to just after the last newline of its final ``within``
    characters, unless the chunk would be below a quarter of the width. A null
    or empty text has no chunks.
    """
    least = max(1, width // 4)

    def cut(t: str) -> list[str]:
        out, at = [], 0
        while at < len(t):
            end = min(at + width, len(t))
            line = t.rfind("\n", max(at, end - within), end) + 1 if end < len(t) else 0
            upto = line if line - at >= least else end
            out.append(t[at:upto])
            at = upto
        return out

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: cut(t or ""))

    return F.pandas_udf(run, ArrayType(StringType()))(text)


def around_chunks(rows: DataFrame, by: str, order: str, text: str, width: int = AROUND) -> DataFrame:
    """``rows`` with ``prefix`` and ``suffix``: the end of the chunk before and the beginning of the one after.

    A neighbour that is cut has an ellipsis; one that is absent, null or empty
    gives an empty string.
    """
    own = Window.partitionBy(by).orderBy(order)
    before, after = F.lag(text).over(own), F.lead(text).over(own)
    longer = lambda c: F.length(c) > width
    tail, head = F.when(longer(before), F.right(before, F.lit(width))).otherwise(before), F.substring(after, 1, width)
    prefix = F.when(F.length(before) > 0, F.concat(F.when(longer(before), "… ").otherwise(""), tail, F.lit(" "))).otherwise("")
    suffix = F.when(F.length(after) > 0, F.concat(F.lit(" "), head, F.when(longer(after), " …").otherwise(""))).otherwise("")
    return rows.withColumn("prefix", prefix).withColumn("suffix", suffix)


def expansion_terms(query: Column, terms: Column, blocked: list[str], most: int = EXPANSIONS) -> Column:
    """At most ``most`` terms to search for: those of the array ``terms``, once each whatever their case.

    Words of a term that contain a blocked one are left out of it.

    The query itself comes first unless a term equals it; without terms it is
    alone; a null or blank query has none.
    """
    return X.expanded(query, terms, blocked, most)


def outside_query(terms: Column, query: Column) -> Column:
    """The required terms of an array that the expanded query does not contain, whatever their case."""
    low = F.lower(F.trim(query))
    return F.when(F.length(low) > 0, F.filter(terms, lambda t: ~F.contains(low, F.lower(F.trim(t))))).otherwise(terms)


def flagged(rows: DataFrame, having: DataFrame, by: str, name: str) -> DataFrame:
    """``rows`` with a boolean ``name``: whether ``having`` has their ``by``."""
    known = having.select(by).distinct().withColumn(name, F.lit(True))
    return rows.join(known, by, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def quote_score(quote: Column, text: Column, width: int = QUOTE_WIDTH) -> Column:
    """1,000 for each character of the longest run of 3 to ``width`` characters of ``quote`` that is in ``text``, and 1 for each distinct character that both have."""

    def score(quote: str, text: str) -> int:
        low, high = 2, min(width, len(quote))  # what is in the text is so without its last character, too
        while low < high:
            n = (low + high + 1) // 2
            runs = {quote[i : i + n] for i in range(len(quote) - n + 1)}
            low, high = (n, high) if any(text[i : i + n] in runs for i in range(len(text) - n + 1)) else (low, n - 1)
        return 1000 * (low if low >= 3 else 0) + len(set(quote) & set(text))

    def run(quotes: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([None if q is None or t is None else score(q, t) for q, t in zip(quotes, texts)], dtype="Int64")

    return F.pandas_udf(run, LongType())(quote, text)


def merged(text: Column, chunk: Column, limit: int, least: int) -> tuple[Column, Column]:
    """(overlap, text): the longest end of ``text`` of ``least`` to ``limit`` characters that ``chunk`` begins with, and both joined over it, or else by a newline."""
    most = F.least(F.lit(limit), F.length(text), F.length(chunk))
    sizes = F.when(most >= least, F.sequence(F.lit(least), most)).otherwise(F.array().cast("array<int>"))
    overlap = F.coalesce(F.array_max(F.filter(sizes, lambda n: F.endswith(text, F.substring(chunk, F.lit(1), n)))), F.lit(0))
    rest = F.substring(chunk, overlap + 1, F.length(chunk))
    return overlap, F.when(overlap > 0, F.concat(text, rest)).otherwise(F.concat(text, F.lit("\n"), chunk))


def metadata_text(filename: Column, *parts: Column) -> Column:
    """A file's name without its suffix, separators as spaces, and what else describes it; null and empty parts are left out."""
    stem = F.regexp_replace(filename, r"(?<=.)\.[^.]*$", "")
    clean = F.trim(F.regexp_replace(F.regexp_replace(stem, r"[_.-]+", " "), r"\s+", " "))
    return F.concat_ws(" ", *[F.when(F.length(p) > 0, p) for p in (clean, *parts)])


def route_score(expected: Column, actual: Column) -> Column:
    """The share of an array of expected calls that the actual ones begin with; null if either is null or nothing is expected."""
    pairs = F.zip_with(expected, F.slice(actual, 1, F.greatest(F.size(expected), F.lit(1))), lambda e, a: F.coalesce(e == a, F.lit(False)))
    differs = F.array_position(pairs, False)
    same = F.when(differs > 0, differs - 1).otherwise(F.size(expected))
    return F.when(F.size(expected) > 0, same / F.size(expected))


def apart(rows: DataFrame, by: str, order: list[str], start: str, end: str) -> DataFrame:
    """(by, start, end): spans of a group, in order, but those that touch one already taken.

    A group is the few best spans of a file; its spans are one array.
    """
    first = F.struct(*order, F.col(start).alias("_start"), F.col(end).alias("_end"))
    spans = rows.where(F.col(start).isNotNull() & F.col(end).isNotNull()).groupBy(by).agg(F.sort_array(F.collect_list(first)).alias("spans"))
    none = F.array().cast("array<struct<s:double,e:double>>")

    def take(acc: Column, x: Column) -> Column:
        s, e = x["_start"].cast("double"), x["_end"].cast("double")
        hit = F.exists(acc, lambda t: (t["s"] <= e) & (s <= t["e"]))
        return F.when(hit, acc).otherwise(F.array_append(acc, F.struct(s.alias("s"), e.alias("e"))))

    taken = spans.select(by, F.explode(F.aggregate("spans", none, take)).alias("t"))
    return taken.select(by, F.col("t.s").alias("start"), F.col("t.e").alias("end"))
