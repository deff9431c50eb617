"""Subtitles from timed words: cues that fit a screen and end where a reader would pause."""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sequence import SEPARATORS, in_number

#: Columns and seconds of a cue at most, seconds at least, and the silence that ends one (fixed values).
WIDTH, LONGEST, SHORTEST, PAUSE = 42, 5.0, 0.6, 0.6
#: What ends a sentence and a clause, and what no line may begin with (fixed values).
HARD, SOFT = ".。!?！？…", ",、;:：；"
NOT_FIRST = "ーゝゞ々ぁぃぅぇぉっゃゅょゎァィゥェォッャュョヮヵヶ、。！？!?.,;:：；…」』）)】〉》"
#: Languages written without spaces (fixed values).
UNSPACED = ("ja", "jp", "zh", "ko", "th")


@lru_cache(maxsize=65_536)
def _columns(c: str) -> int:
    return 0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "FW" else 1


def columns_of(text: str) -> int:
    """Columns that a text takes on screen: two for wide characters, none for combining marks."""
    return len(text) if text.isascii() else sum(map(_columns, text))


def _breaks_number(text: str, at: int) -> bool:
    return 0 < at < len(text) and (in_number(text[: at - 1][-1:], text[at - 1], text[at:].lstrip(" ")) or (text[at - 1].isdigit() and (text[at].isdigit() or in_number(text[at - 1], text[at], text[at + 1 :].lstrip(" ")))))


def two_lines(text: str, most: int = WIDTH // 2) -> str:
    """The text as it is if it fits into ``most`` columns, else on two lines of about one length, numbers whole."""
    if columns_of(text) <= most:
        return text
    if " " in text:
        words = text.split(" ")
        ends = [i for i in range(1, len(words)) if not in_number("", words[i - 1], words[i])]
        room = columns_of(text) // 2
        upto = list(accumulate(columns_of(w) + 1 for w in words))
        fits = [i for i in ends if upto[i - 1] - 1 <= room]
        cut = fits[-1] if fits else ends[0] if ends else 0
        return " ".join(words[:cut]) + "\n" + " ".join(words[cut:]) if cut else text
    for i, c in enumerate(text):
        if c in SOFT and columns_of(text[: i + 1]) >= most // 2 and i + 1 < len(text) and not _breaks_number(text, i + 1):
            return text[: i + 1] + "\n" + text[i + 1 :].lstrip()
    good = [i for i in range(1, len(text)) if text[i] not in NOT_FIRST and not _breaks_number(text, i)]
    cut = min(good, key=lambda i: (abs(i - len(text) // 2), i), default=0)
    return text[:cut] + "\n" + text[cut:] if cut else text


def packed_cues(words: DataFrame) -> DataFrame:
    """(file_id, cue, start, end, text) of timed ``words`` (file_id, idx, word, start, end, language).

    A cue ends after a sentence or a pause once it has its least length, after a
    clause once it is three quarters full, and before it is too long or too
    wide: then at its last pause or mark past its half, else wherever a line
    may end. It ends before the next one begins. Blank words count for nothing;
    a file without words has no cues. A task holds the words of one file.
    """

    def pack(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("idx").to_numpy(), kind="stable")
        times = [table.column(c).to_numpy().astype(float)[order].tolist() for c in ("start", "end")]
        words, languages = (table.column(c).take(pa.array(order)).to_pylist() for c in ("word", "language"))
        said = [(w.strip(), *rest) for w, *rest in zip(words, *times, languages) if w and w.strip()]
        text, start, end, language = map(list, zip(*said)) if said else ([], [], [], [None])
        n, gap = len(text), "" if (language[0] or "").lower().startswith(UNSPACED) else " "
        after = [s - e for s, e in zip(start[1:] + end[-1:], end)]
        inside = [w[-1] in SEPARATORS and in_number(text[i - 1] if i else "", w, text[i + 1] if i + 1 < n else "") for i, w in enumerate(text)]
        ends = lambda i, marks: not inside[i] and text[i][-1] in marks
        katakana = lambda c: "゠" <= c <= "ヿ"
        may = lambda i: i + 1 < n and not inside[i] and text[i + 1][0] not in NOT_FIRST and not (katakana(text[i][-1]) and katakana(text[i + 1][0]))
        clean = lambda i: may(i) and (ends(i, HARD + SOFT) or after[i] >= PAUSE or " " in text[i])
        total = [0, *accumulate(map(columns_of, text))]
        width = lambda a, b: total[b + 1] - total[a] + (b - a) * len(gap)

        def pauses(a: int, b: int) -> bool:
            return end[b] - start[a] >= SHORTEST and (ends(b, HARD) or after[b] >= PAUSE or (ends(b, SOFT) and width(a, b) >= 0.75 * WIDTH))

        cues, begin = [], 0
        for i in range(n):
            if end[i] - start[begin] >= LONGEST or width(begin, i) >= WIDTH:
                places = range(i - 1, begin - 1, -1)
                last = next((c for c in places if width(begin, c) >= WIDTH / 2 and clean(c)), None)
                last = next((c for c in places if may(c)), i) if last is None else last
                cues.append((begin, last))
                begin = last + 1
            if begin <= i and pauses(begin, i):
                cues.append((begin, i))
                begin = i + 1
        cues += [(begin, n - 1)] if begin < n else []
        file = table.column("file_id")[0].as_py()
        rows = [(file, k, start[a], end[b], two_lines(gap.join(text[a : b + 1]))) for k, (a, b) in enumerate(cues)]
        kinds = {"file_id": pa.int64(), "cue": pa.int64(), "start": pa.float64(), "end": pa.float64(), "text": pa.string()}
        return pa.table([pa.array(c, kind, from_pandas=True) for c, kind in zip(zip(*rows) if rows else [()] * 5, kinds.values())], names=list(kinds))

    found = words.select("file_id", "idx", "word", "start", "end", "language").groupBy("file_id").applyInArrow(pack, "file_id long, cue long, start double, end double, text string")
    following = F.lead("start").over(Window.partitionBy("file_id").orderBy("cue"))
    return found.withColumn("end", F.when((following > F.col("start")) & (following < F.col("end")), following).otherwise(F.col("end")))


def webvtt(cues: DataFrame) -> DataFrame:
    """(file_id, vtt): the cues (file_id, cue, start, end, text) of a file as a WebVTT text; blank cues are left out, arrows written otherwise."""
    stamp = lambda c: F.format_string("%02d:%02d:%06.3f", F.floor(F.greatest(c, F.lit(0.0)) / 3600), F.floor(F.greatest(c, F.lit(0.0)) / 60) % 60, F.greatest(c, F.lit(0.0)) % 60)
    plain = F.array_join(F.filter(F.split(F.replace("text", F.lit("-->"), F.lit("→")), r"\r\n|\r|\n"), lambda x: F.trim(x) != ""), "\n")
    rows = cues.withColumn("_t", plain).where("_t <> ''").withColumn("_n", F.row_number().over(Window.partitionBy("file_id").orderBy("cue")))
    block = F.concat(F.col("_n").cast("string"), F.lit("\n"), stamp(F.col("start")), F.lit(" --> "), stamp(F.col("end")), F.lit("\n"), F.col("_t"), F.lit("\n"))
    whole = rows.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("_n", block.alias("b")))).alias("_b"))
    return whole.select("file_id", F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform("_b", lambda x: x["b"]), "\n")).alias("vtt"))
