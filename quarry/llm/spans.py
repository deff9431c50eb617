"""Native building blocks for finding spans in texts: positions, merging and printing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<at:int,end:int,kind:string,value:string>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


#: Matches that are summed up at a time, so that a text of very many costs little more for each.
CHUNK = 128


def matches(text: Column, pattern: str, kind: str, only: Column | None = None) -> Column:
    """Leftmost non-overlapping matches as an array of (at, end, kind, value).

    Positions are code points, end exclusive. The lengths of the matches and of
    what lies between them are summed up to positions; a text without a match,
    or for which ``only`` is false, is settled by one search.
    """
    none = F.array().cast(f"array<{SPAN}>")
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"))
    between = F.transform(F.split(text, pattern, -1), F.length)
    rows = F.zip_with(found, between, lambda v, g: F.struct(g.alias("gap"), F.length(v).alias("own"), v.alias("value")))
    rows = F.filter(rows, lambda x: x["value"].isNotNull())
    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + x["gap"]
        span = F.struct(at.alias("at"), (at + x["own"]).alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value"))
        return F.struct((at + x["own"]).alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    def placed(chunks: Column) -> Column:
        totals = F.transform(chunks, lambda ch: F.aggregate(ch, F.lit(0), lambda acc, x: acc + x["gap"] + x["own"]))
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
        starts = F.aggregate(totals, begin, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")), lambda acc: acc["all"])
        own = lambda ch, at: F.aggregate(ch, F.struct(at.alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])
        return F.flatten(F.zip_with(chunks, starts, own))

    last = lambda r: F.floor((F.size(r) - 1) / CHUNK).cast("int")
    spans = let(rows, lambda r: let(F.transform(F.sequence(F.lit(0), last(r)), lambda c: F.slice(r, c * CHUNK + 1, CHUNK)), placed))
    there = F.regexp_like(text, F.lit(pattern))
    return F.when(there if only is None else only & there, spans).otherwise(none)


def ordered(spans: Column, kinds: list[str]) -> Column:
    """Spans by start, then by kind as listed, then by end."""
    order = F.create_map(*[x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(i))])
    rows = F.transform(spans, lambda s: F.struct(s["at"].alias("at"), order[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value")))
    return F.array_sort(rows)


def printed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["at"], s["end"])), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
