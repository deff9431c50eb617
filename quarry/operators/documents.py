"""Summaries, subtitles and pages: segments, cues, windows, gates."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Citation gates and window sizes (fixed values).
THRESHOLD, MARGIN_GATE, SURE, SPREAD, SPREAD_CHUNKS = 0.55, 0.05, 0.75, 0.3, 50
WINDOW_CHARS, WINDOWS = 2500, 3
SENTENCE_ENDS = ".!?。！？\n"


def markdown_segments(docs: DataFrame) -> DataFrame:
    """(id, segment, kind, path, text) of Markdown ``docs`` (id, text): paragraphs, bullets and table rows under their headings."""

    def parse(text: str) -> Iterator[tuple[str, str, str]]:
        path: list[tuple[int, str]] = []
        lines: list[str] = []
        where = lambda: " > ".join(t for _, t in path)

        def flush() -> Iterator[tuple[str, str, str]]:
            if lines:
                yield "paragraph", where(), " ".join(lines)
                lines.clear()

        for raw in text.split("\n"):
            line = raw.strip()
            heading = re.match(r"(#{1,6})\s+(.*)", line)
            bullet = re.match(r"(?:[-*+]|\d+[.)])\s+(.*)", line)
            if heading:
                yield from flush()
                level = len(heading[1])
                path[:] = [p for p in path if p[0] < level] + [(level, heading[2].strip())]
            elif bullet:
                yield from flush()
                yield "bullet", where(), bullet[1]
            elif line.startswith("|"):
                yield from flush()
                cells = [c.strip() for c in line.strip("|").split("|")]
                if not all(re.fullmatch(r":?-+:?", c) for c in cells):
                    yield "row", where(), " | ".join(cells)
            elif line:
                lines.append(line)
            else:
                yield from flush()
        yield from flush()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, n, *s) for i, t in zip(pdf["id"], pdf["text"]) for n, s in enumerate(parse(t or ""))]
            yield pd.DataFrame(rows, columns=["id", "segment", "kind", "path", "text"])

    return docs.select("id", "text").mapInPandas(run, "id long, segment long, kind string, path string, text string")


def seconds(stamp: str) -> float:
    """Seconds of h:mm:ss.mmm or mm:ss,mmm."""
    total = 0.0
    for part in stamp.replace(",", ".").split(":"):
        total = 60 * total + float(part)
    return total


def subtitle_cues(files: DataFrame) -> DataFrame:
    """(id, cue, start, end, text) of WebVTT or SRT ``files`` (id, text); a cue that repeats the line before shows only what is new."""
    stamp = r"((?:\d+:)?\d{1,2}:\d{2}[.,]\d{3})"

    def parse(text: str) -> Iterator[tuple[float, float, str]]:
        before = ""
        for block in re.split(r"\n\s*\n", text.replace("\r", "")):
            found = re.search(rf"{stamp}\s*-->\s*{stamp}[^\n]*\n(.*)", block, re.S)
            if not found:
                continue
            lines = [html.unescape(re.sub(r"<[^>]*>", "", x)).strip() for x in found[3].split("\n")]
            new = " ".join(x for x in lines if x and x != before)
            before = next((x for x in reversed(lines) if x), before)
            if new:
                yield seconds(found[1]), seconds(found[2]), new

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, n, *c) for i, t in zip(pdf["id"], pdf["text"]) for n, c in enumerate(parse(t or ""))]
            yield pd.DataFrame(rows, columns=["id", "cue", "start", "end", "text"])

    return files.select("id", "text").mapInPandas(run, "id long, cue long, start double, end double, text string")


def clamped(cues: DataFrame) -> DataFrame:
    """Cues (id, start, end, ...) that end where the next one starts, if not before."""
    own = Window.partitionBy("id").orderBy("start", "end")
    return cues.withColumn("end", F.least("end", F.coalesce(F.lead("start").over(own), "end")))


def merged_cues(cues: DataFrame, length: float = 20.0) -> DataFrame:
    """(id, start, end, text): neighbouring cues put together while they last up to ``length``."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = []
        for r in pdf.sort_values(["start", "end"]).itertuples():
            if out and r.end - out[-1][1] <= length:
                out[-1][2] = max(out[-1][2], r.end)
                out[-1][3] += " " + r.text
            else:
                out.append([r.id, r.start, r.end, r.text])
        return pd.DataFrame(out, columns=["id", "start", "end", "text"])

    return cues.select("id", "start", "end", "text").groupBy("id").applyInPandas(merge, "id long, start double, end double, text string")


def sample_windows(text: Column, size: int = WINDOW_CHARS, n: int = WINDOWS) -> Column:
    """``n`` evenly spread windows of a text as one string each, the first at its head and the last at its end; overlapping ones joined."""
    length = F.length(text)
    start = lambda i: F.floor((length - size) * i / (n - 1))
    parts = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.substring(text, (start(i) + 1).cast("int"), F.lit(size)))
    return F.when(length <= size * n, F.array(text)).otherwise(parts)


def trim_to_sentence(text: Column, most: int) -> Column:
    """The text cut to ``most`` characters, back to the end of a sentence if there is one in its second half."""
    cut = F.substring(text, 1, most)
    ended = F.regexp_extract(cut, rf"(?s)^(.*[{re.escape(SENTENCE_ENDS)}])", 1)
    return F.when(F.length(text) <= most, text).when(F.length(ended) * 2 >= most, F.rtrim(ended)).otherwise(cut)


def gated_citations(candidates: DataFrame, chunks: DataFrame, threshold: float = THRESHOLD, k: int = 3) -> DataFrame:
    """(file_id, segment, chunk, score): a segment's best chunks (file_id, segment, kind, chunk, score), if they can be told from the others.

    The best must reach the threshold; below ``SURE`` it must lead the second
    by the margin; a paragraph's must not lie all over a file of many chunks
    (file_id, chunks).
    """
    own = Window.partitionBy("file_id", "segment")
    ranked = candidates.withColumn("_r", F.row_number().over(own.orderBy(F.desc("score"), F.asc("chunk"))))
    top = ranked.where(F.col("_r") <= k).join(chunks, "file_id")
    best, second = F.max("score").over(own), F.max(F.when(F.col("_r") == 2, F.col("score"))).over(own)
    spread = (F.max("chunk").over(own) - F.min("chunk").over(own)) / F.col("chunks")
    unclear = (best < SURE) & (best - F.coalesce(second, F.lit(0.0)) < MARGIN_GATE)
    scattered = (F.col("kind") == "paragraph") & (F.col("chunks") >= SPREAD_CHUNKS) & (spread > SPREAD)
    return top.withColumn("_ok", (best >= threshold) & ~unclear & ~scattered).where(F.col("_ok")).select("file_id", "segment", "chunk", "score")


def in_list_ranks(dense: DataFrame, ranks: DataFrame, k: int = 60, most: int = 3) -> DataFrame:
    """(file_id, segment, chunk, score): dense candidates reordered by rank fusion with keyword ranks (…, rank) of those they have; scores stay."""
    own = Window.partitionBy("file_id", "segment")
    rows = dense.withColumn("_d", F.row_number().over(own.orderBy(F.desc("score"), F.asc("chunk"))))
    rows = rows.join(ranks, ["file_id", "segment", "chunk"], "left")
    fused = 1 / (k + F.col("_d")) + F.coalesce(1 / (k + F.col("rank")), F.lit(0.0))
    rows = rows.withColumn("_n", F.row_number().over(own.orderBy(F.desc(F.round(fused, 12)), F.asc("chunk"))))
    return rows.where(F.col("_n") <= most).select("file_id", "segment", "chunk", "score")


@F.pandas_udf(StringType())
def json_strings(text: pd.Series) -> pd.Series:
    """The strings of over two characters anywhere in a JSON text, in order, as one; what is no JSON stays as it is."""

    def strings(x: object) -> Iterator[str]:
        open_ = [x]  # a stack, so that depth is no limit
        while open_:
            x = open_.pop()
            if isinstance(x, str) and len(x) > 2:
                yield x
            elif isinstance(x, (dict, list)):
                open_ += reversed(list(x.values()) if isinstance(x, dict) else x)

    def one(t: str) -> str:
        try:
            return " ".join(strings(json.loads(t)))
        except (ValueError, RecursionError):
            return t

    return text.map(one, na_action="ignore")


def cleaned(text: Column, suffix: Column) -> Column:
    """The words of a file of the suffix .srt, .vtt, .csv or .json; others stay as they are.

    Subtitles lose numbers, times, headers and tags; cells of a table go on one
    line each row, without quotes and blank ones.
    """
    lines = F.transform(F.split(F.trim(text), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    spoken = lambda drop: F.array_join(F.filter(F.transform(F.filter(lines, lambda x: (x != "") & ~F.regexp_like(x, F.lit(drop))), lambda x: F.regexp_replace(x, "<[^>]+>", "")), lambda x: x != ""), " ")
    srt = spoken(r"^\d+$|^\d{2}:\d{2}:\d{2},\d{3}\s*-->")
    vtt = spoken(r"^\d+$|^WEBVTT|^NOTE|^\d{2}:\d{2}:\d{2}\.\d{3}\s*-->")
    cells = lambda x: F.array_join(F.transform(F.filter(F.split(x, ","), lambda c: F.trim(c) != ""), lambda c: F.regexp_replace(F.trim(c), '^"+|"+$', "")), " ")
    csv = F.array_join(F.transform(F.filter(lines, lambda x: F.regexp_replace(x, r"[,\s]", "") != ""), cells), "\n")
    low = F.lower(suffix)
    return F.when(low == ".srt", srt).when(low == ".vtt", vtt).when(low == ".csv", csv).when(low == ".json", json_strings(text)).otherwise(text)


def _titles(lines: list[str], level: int) -> list[str]:
    """The heading of that level on each line, or an empty string."""
    mark = re.compile("#" * level + "[ \\t]+([^\\n\\r\x85\u2028\u2029]*?)[ \\t\\n\\x0b\\f\\r]*[\x85\u2028\u2029]?\\Z")
    found = [mark.match(x) if x.startswith("#") else None for x in lines]
    return [f[1] if f else "" for f in found]


def splice(text: str, heading: str | None, below: str | None, content: str | None) -> str | None:
    """:func:`spliced` of one text; each line is looked at once for each level."""
    plain = lambda t: re.sub(r"\r\n|\r", "\n", t)
    ending = "(?=[\x85\u2028\u2029]?\\Z)"
    lines = re.sub("\n(?=[\n\x85\u2028\u2029]?\\Z)", "", plain(text)).split("\n")
    body = re.sub("^\n+|\n+" + ending, "", plain(content or ""))
    new, size = body.split("\n") if body else [], len(lines)
    first = lambda titles, lo, hi, test: next((i for i in range(lo, hi) if test(titles[i])), None)
    two = _titles(lines, 2)
    begin = first(two, 0, size, lambda x: heading is not None and x == heading.strip(" "))
    if begin is None:
        return None
    end = first(two, begin + 1, size, bool) or size
    if below is not None:
        three = _titles(lines, 3)
        begin = first(three, begin + 1, end, lambda x: x == below.strip(" "))
        if begin is None:
            return None
        end = first(three, begin + 1, end, bool) or end
    gap = [""] if end < size and new and new[-1].strip(" ") else []
    return "\n".join([*lines[:begin], *new, *gap, *lines[end:]])


def spliced(rows: DataFrame, markdown: str, heading: Column, below: Column, content: Column) -> DataFrame:
    """``rows`` with their Markdown column, in which a section, its heading with it, is replaced by ``content``; null if the section is not there.

    The section is that of the first ``## heading``, up to the next ``##``; if
    ``below`` is not null, that of the first ``### below`` in it, up to the next
    ``###``. What follows is set off by a blank line.
    """

    def run(text: pd.Series, heading: pd.Series, below: pd.Series, content: pd.Series) -> pd.Series:
        none = lambda x: None if pd.isna(x) else x
        return pd.Series([None if pd.isna(t) else splice(t, none(h), none(b), none(c)) for t, h, b, c in zip(text, heading, below, content)], dtype=object)

    once = F.pandas_udf(run, StringType()).asNondeterministic()  # a filter on the result would have it worked out twice
    return rows.withColumn(markdown, once(F.col(markdown), heading, below, content))
