"""Cutting texts and transcripts into chunks, and aligning summaries with them."""

from __future__ import annotations

import html.parser
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import bounded, kept

#: Chunk sizes in characters and seconds, silences, and where a text is cut best (fixed values).
TEXT_CHUNK, TEXT_OVERLAP = 400, 80
CHUNK_MIN, CHUNK_MAX, SILENCE = 10.0, 20.0, 0.4
BREAKS = ("\n\n", ". ", "\n", " ")
HARD, SOFT = "。．.!?！？", "、，,;；:"


def cut_points(text: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """[start, end) of overlapping chunks, each ended before the last of the best marks in it that lies past the former end."""
    start, former = 0, -1
    while start < len(text):
        if start + size >= len(text):
            yield start, len(text)
            return
        places = (text.rfind(mark, max(start, former + 1), start + size) for mark in BREAKS)
        former = next((at for at in places if at >= 0), start + size)
        yield start, former
        start = max(former - overlap, start + 1)


def text_chunks(docs: DataFrame, size: int = TEXT_CHUNK, overlap: int = TEXT_OVERLAP) -> DataFrame:
    """(id, chunk, start, text) of ``docs`` (id, text), white space around a text left out; blank chunks are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, a, t[a:b].strip()) for i, t in zip(pdf["id"], (t.strip() if t else "" for t in pdf["text"])) for a, b in cut_points(t, size, overlap)]
            out = pd.DataFrame([r for r in rows if r[2]], columns=["id", "start", "text"])
            out.insert(1, "chunk", out.groupby("id").cumcount())
            yield out

    return docs.select("id", "text").mapInPandas(run, "id long, chunk long, start long, text string")


def transcript_chunks(words: DataFrame, least: float = CHUNK_MIN, most: float = CHUNK_MAX) -> DataFrame:
    """(file_id, chunk, start, end, speaker, text) of timed words (file_id, idx, word, start, end, speaker).

    A chunk ends before a word that would make it longer than ``most``; once it
    has ``least`` seconds, after a sentence or a silence and at a change of
    speaker; once it has half as much again, after a clause.
    """

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        chunks, own = [], []

        def flush() -> None:
            if own:
                speakers = [w.speaker for w in own if w.speaker]
                main = max(sorted(set(speakers)), key=speakers.count) if speakers else None
                chunks.append((own[0].file_id, len(chunks), own[0].start, own[-1].end, main, " ".join(w.word for w in own)))
                own.clear()

        for w in pdf.itertuples():
            if own:
                length = own[-1].end - own[0].start
                # a point between digits ends no sentence
                last = "" if in_number(own[-2].word if len(own) > 1 else "", own[-1].word, w.word) else own[-1].word[-1:]
                ended = last in tuple(HARD) or w.start - own[-1].end >= SILENCE or w.speaker != own[-1].speaker
                if w.end - own[0].start > most or (length >= least and ended) or (length >= 1.5 * least and last in tuple(SOFT)):
                    flush()
            own.append(w)
        flush()
        return pd.DataFrame(chunks, columns=["file_id", "chunk", "start", "end", "speaker", "text"])

    return words.groupBy("file_id").applyInPandas(cut, "file_id long, chunk long, start double, end double, speaker string, text string")


SEPARATORS, NUMERALS = ".,:：", "0123456789"


def in_number(before: str, word: str, after: str) -> bool:
    """Whether the last character of ``word`` is a separator between two digits, of it or of its neighbours."""
    word, after = word.strip(), after.strip()
    if word[-1:] not in tuple(SEPARATORS):
        return False
    left = word[:-1] or before.strip()
    return left[-1:] in tuple(NUMERALS) and after[:1] in tuple(NUMERALS)


def changed_frames(frames: DataFrame, bits: int = 8, gap: float = 3.0) -> DataFrame:
    """(file_id, ts) of frames (file_id, ts, hash: array of longs) that differ in ``bits`` or more from the last one kept, ``gap`` after it."""

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        kept, last = [], None
        for ts, own in sorted(zip(pdf["ts"], pdf["hash"]), key=lambda x: x[0]):
            own = np.asarray(own, np.int64)
            if last is None or (int(np.bitwise_count(own ^ last[1]).sum()) >= bits and ts - last[0] >= gap):
                last = ts, own
                kept.append(ts)
        return pd.DataFrame({"file_id": pdf["file_id"].iloc[0], "ts": kept})

    return frames.select("file_id", F.col("ts").cast("double").alias("ts"), "hash").groupBy("file_id").applyInPandas(keep, "file_id long, ts double")


def boundary_scores(frames: DataFrame) -> DataFrame:
    """(file_id, ts, score): 1 - cosine of the means of up to two vectors before a frame and of up to two from it on; the first has none."""
    own = Window.partitionBy("file_id").orderBy("ts")
    before, after = F.collect_list("vector").over(own.rowsBetween(-1, 0)), F.collect_list("vector").over(own.rowsBetween(1, 2))
    rows = frames.select("file_id", F.lead("ts").over(own).alias("ts"), before.alias("b"), after.alias("a")).where(F.size("a") > 0)
    total = lambda c: F.aggregate(F.slice(c, 2, 2), F.element_at(c, 1), lambda x, y: F.zip_with(x, y, lambda p, q: p + q))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)
    rows = rows.select("file_id", "ts", total("b").alias("x"), total("a").alias("y"))
    size = F.sqrt(dot(F.col("x"), F.col("x")) * dot(F.col("y"), F.col("y")))
    return rows.select("file_id", "ts", F.when(size > 0, 1 - dot(F.col("x"), F.col("y")) / size).otherwise(0.0).alias("score"))


def align_monotonic(scores: DataFrame, by: tuple[str, ...] = ("file_id",), states: DataFrame | None = None) -> DataFrame:
    """(by..., chunk, segment): the best way of segments along the chunks, for scores (by..., segment, chunk, score).

    Every chunk has a segment; the first one has the first segment, and each
    next one the same or the one after it; the last may have any. Of equal ways,
    the one that stays longer; of equal ends, the first. Missing scores are 0.
    ``states`` (by..., segment) are the segments that have scores, if they are
    known. Scores are read in the order of their chunks; a task holds one bit
    for each chunk and segment of a file.
    """
    own = Window.partitionBy(*by)
    states = (scores.select(*by, "segment") if states is None else states).distinct()
    states = states.select(*[F.col(k).alias(f"_{k}") for k in by], F.col("segment").alias("_segment"), (F.row_number().over(own.orderBy("segment")) - 1).alias("_state"), F.count("*").over(own).alias("_states"))
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in by], F.col("segment") == F.col("_segment"))
    rows = scores.join(bounded(kept(states, "states")), same).select(*by, "chunk", "segment", F.col("score").cast("double").alias("score"), "_state", "_states")
    kinds = dict(scores.dtypes)

    def paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = total = scored = None

        def step() -> None:
            nonlocal total
            if total is None:
                total = np.full(len(scored), -np.inf)
                total[0] = scored[0]
                moved.append(None)
                return
            before = np.r_[-np.inf, total[:-1]]
            on = before > total
            moved.append(np.packbits(on))
            total = np.where(on, before, total) + scored

        def path() -> pd.DataFrame:
            step()
            at = [int(np.argmax(total))]
            for bits in moved[:0:-1]:
                at.append(at[-1] - (int(bits[at[-1] // 8]) >> (7 - at[-1] % 8) & 1))
            return pd.DataFrame({**dict(zip(by, ([k] * len(chunks) for k in key))), "chunk": chunks, "segment": names[at[::-1]]})

        for pdf in batches:
            group = pdf.groupby(list(by), dropna=False, sort=False).ngroup().to_numpy()
            chunk, state, score, segment = (pdf[c].to_numpy() for c in ("chunk", "_state", "score", "segment"))
            starts = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (chunk[1:] != chunk[:-1])]) if len(pdf) else []
            for lo, hi in zip(starts, [*starts[1:], len(pdf)]):
                mine = tuple(None if pd.isna(pdf[k].iat[lo]) else pdf[k].iat[lo] for k in by)
                if mine != key:
                    if key is not None:
                        yield path()
                    n = int(pdf["_states"].iat[lo])
                    key, total, moved, chunks, names, scored = mine, None, [], [chunk[lo]], np.zeros(n, np.int64), np.zeros(n)
                elif chunk[lo] != chunks[-1]:
                    step()
                    chunks.append(chunk[lo])
                    scored = np.zeros(len(scored))
                scored[state[lo:hi]] = score[lo:hi]
                names[state[lo:hi]] = segment[lo:hi]
        if key is not None:
            yield path()

    ordered = rows.repartition(*by).sortWithinPartitions(*by, "chunk")
    return ordered.mapInPandas(paths, ", ".join(f"{k} {kinds[k]}" for k in by) + ", chunk long, segment long")


def narrow_clusters(scores: DataFrame, gap: int = 5, top: int = 12, floor: float = 0.5, union: float = 0.8, margin: float | None = None) -> DataFrame:
    """(file_id, segment, first, last, weight): the span of a segment's heaviest run of chunks, and of runs of ``union`` of its weight.

    A chunk of scores (file_id, segment, chunk, score) weighs its score; with
    ``margin``, how far that exceeds the best of the file's other segments. Of a
    segment's ``top`` heaviest chunks, those with a score of ``floor`` and a
    weight of ``margin`` make up runs; in a run, chunks are at most ``gap``
    apart. ``weight`` is that of the heaviest run.
    """
    rows = scores.withColumn("_w", F.col("score"))
    if margin is not None:
        rivals = Window.partitionBy("file_id", "chunk").orderBy(F.desc("score"), F.asc("segment")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        other = F.when(F.first("segment").over(rivals) == F.col("segment"), F.nth_value("score", 2).over(rivals)).otherwise(F.first("score").over(rivals))
        rows = scores.withColumn("_other", other).withColumn("_w", F.col("score") - F.coalesce("_other", F.lit(0.0)))
    own = Window.partitionBy("file_id", "segment")
    kept = rows.withColumn("_r", F.row_number().over(own.orderBy(F.desc("_w"), F.asc("chunk")))).where((F.col("_r") <= top) & (F.col("score") >= floor))
    if margin is not None:
        kept = kept.where(F.col("_other").isNull() | (F.col("_w") >= margin))
    order = own.orderBy("chunk")
    kept = kept.withColumn("_new", F.coalesce((F.col("chunk") - F.lag("chunk").over(order) > gap).cast("int"), F.lit(1))).withColumn("_run", F.sum("_new").over(order))
    runs = kept.groupBy("file_id", "segment", "_run").agg(F.min("chunk").alias("first"), F.max("chunk").alias("last"), F.sum("_w").alias("weight"))
    near = runs.withColumn("_most", F.max("weight").over(own)).where(F.col("weight") >= F.col("_most") * union - 1e-9)
    return near.groupBy("file_id", "segment").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max("weight").alias("weight"))


class Outline(html.parser.HTMLParser):
    """A page's text under its headings; scripts and styles are left out."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.sections: list[list] = [[0, "", []]]
        self.hidden, self.heading = 0, False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style", "noscript"):
            self.hidden += 1
        elif len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
            self.sections.append([int(tag[1]), "", []])
            self.heading = True
        elif tag == "li":
            self.sections[-1][2].append("\n- ")
        elif tag in ("p", "br", "div", "tr", "ul", "ol", "table"):
            self.sections[-1][2].append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style", "noscript"):
            self.hidden = max(0, self.hidden - 1)
        elif len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
            self.heading = False

    def handle_data(self, data: str) -> None:
        if self.hidden:
            return
        if self.heading:
            self.sections[-1][1] += data
        else:
            self.sections[-1][2].append(data)


def html_sections(pages: DataFrame) -> DataFrame:
    """(page_id, section, level, title, text) of ``pages`` (page_id, html), in order; empty sections are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for page_id, source in zip(pdf["page_id"], pdf["html"]):
                outline = Outline()
                outline.feed(source or "")
                outline.close()
                n = 0
                for level, title, parts in outline.sections:
                    lines = [" ".join(line.split()) for line in "".join(parts).split("\n")]
                    text = "\n".join(line for line in lines if line)
                    if text or title.strip():
                        rows.append((page_id, n, level, " ".join(title.split()), text))
                        n += 1
            yield pd.DataFrame(rows, columns=["page_id", "section", "level", "title", "text"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, section long, level long, title string, text string")


def chapter_windows(chunks: DataFrame, budget: int) -> DataFrame:
    """(file_id, window, text): lines ``[start-end] text`` of chunks (file_id, chunk, start, end, text), in windows of up to ``budget`` characters.

    A text that does not fit goes on in lines of its own with the same times; a
    null or blank one is an empty line. Only lengths go to Python, a file's at a
    time.
    """
    prefix = F.format_string("[%.3f-%.3f] ", F.col("start").cast("double"), F.col("end").cast("double"))
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")
    room = F.greatest(budget - F.length("prefix"), F.lit(1))
    rows = chunks.select("file_id", "chunk", prefix.alias("prefix"), plain.alias("plain"))
    begins = F.when(F.length("plain") > 0, F.sequence(F.lit(1), F.length("plain"), room)).otherwise(F.array(F.lit(1)))
    rows = rows.select("file_id", "chunk", "prefix", "plain", room.alias("room"), F.posexplode(begins).alias("part", "at"))
    lines = rows.select("file_id", "chunk", "part", F.concat("prefix", F.substring("plain", F.col("at"), F.col("room"))).alias("line"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["chunk", "part"])
        window, used, out = 0, 0, []
        for n in pdf["n"]:
            if used and used + 1 + n > budget:
                window, used = window + 1, 0
            used += n + (used > 0)
            out.append(window)
        return pdf.assign(window=out)[["file_id", "chunk", "part", "window"]]

    kinds = dict(chunks.dtypes)
    sized = lines.select("file_id", "chunk", "part", F.length("line").alias("n"))
    placed = sized.groupBy("file_id").applyInPandas(pack, f"file_id {kinds['file_id']}, chunk {kinds['chunk']}, part int, window long")
    whole = lines.join(placed, ["file_id", "chunk", "part"]).groupBy("file_id", "window").agg(F.sort_array(F.collect_list(F.struct("chunk", "part", "line"))).alias("lines"))
    return whole.select("file_id", "window", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("text"))


def chapters(answer: Column) -> Column:
    """Chapters (start, end, title) of a JSON answer, an array or one under ``chapters``, in its order.

    One without a title or a finite start is left out, an end that is no finite
    number is null; what is no such JSON has none.
    """
    item = "array<struct<start_time:string,end_time:string,title:string>>"
    found = F.coalesce(F.from_json(F.get_json_object(answer, "$.chapters"), item), F.from_json(answer, item), F.array().cast(item))
    number = lambda c: F.when(F.regexp_like(F.trim(c), F.lit(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")), c.try_cast("double"))
    plain = F.transform(found, lambda x: F.struct(number(x["start_time"]).alias("start"), number(x["end_time"]).alias("end"), F.trim(x["title"]).alias("title")))
    return F.filter(plain, lambda x: x["start"].isNotNull() & (x["title"] != ""))
