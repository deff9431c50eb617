"""Scenes of a film: boundaries by pictures and by topics, sections between them, and a frame for each."""

from __future__ import annotations

import bisect
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V

#: Seconds a section stands for, least and most sections, and what a section may exceed before it is split (fixed values).
DENSITY, FEWEST, MOST, SPLIT = 75.0, 8, 40, 2.5
#: Seconds that a changed frame keeps from scene frames (fixed value).
APART = 3.0
#: Seconds and shares of head and tail, and what their boundaries' scores are worth (fixed values).
HEAD, TAIL, EDGE = (20.0, 0.03), (30.0, 0.06), 0.3
#: Ranks from which a topic joins a picture boundary, their distance in seconds, and what it adds (fixed values).
TOPIC_RANK, PICTURE_RANK, JOIN, BONUS = 0.7, 0.8, 5.0, 0.25
#: Cosines of frames that show the same, for merging and for asking; characters and bigram overlap of textual ones (fixed values).
MERGE, ASK, TEXTUAL, OVERLAP = 0.93, 0.95, 200, 0.85
#: A frame is taken so many seconds into its section; similarity to frames taken already counts against it (fixed values).
DELAY, AGAINST = 2.0, 0.7


def frame_pool(frames: DataFrame) -> DataFrame:
    """Scene frames, and changed frames that are far enough from each of them, of ``frames`` (file_id, frame_id, ts, changed, vector, ...)."""
    rows = frames.where("vector is not null and ts is not null")
    own = Window.partitionBy("file_id").orderBy("ts")
    scene = F.when(~F.col("changed"), F.col("ts"))
    before = F.last(scene, ignorenulls=True).over(own.rangeBetween(Window.unboundedPreceding, 0))
    after = F.first(scene, ignorenulls=True).over(own.rangeBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("_b", before).withColumn("_a", after)
    far = (F.coalesce(F.col("ts") - F.col("_b"), F.lit(math.inf)) > APART) & (F.coalesce(F.col("_a") - F.col("ts"), F.lit(math.inf)) > APART)
    return rows.where(~F.col("changed") | far).drop("_b", "_a")


def turning_points(rows: DataFrame, n: int, least: int = 0) -> DataFrame:
    """(file_id, time, id, rank): how much each row of (file_id, ts, id, vector) differs from what comes before it.

    The score is 1 - cosine of the means of up to ``n`` rows before and of up
    to ``n`` from it on; the rank is its place among the file's, as a share. A
    file of ``least`` rows or fewer has none.
    """
    own = Window.partitionBy("file_id").orderBy("ts", "id")
    total = lambda c: F.aggregate(F.slice(c, 2, n), F.element_at(c, 1), lambda x, y: F.zip_with(x, y, lambda p, q: p + q))
    held = rows.select("file_id", "ts", "id", F.collect_list(V.doubles("vector")).over(own.rowsBetween(-n, -1)).alias("b"), F.collect_list(V.doubles("vector")).over(own.rowsBetween(0, n - 1)).alias("a"), F.count("*").over(Window.partitionBy("file_id")).alias("rows"))
    held = held.where((F.size("b") > 0) & (F.col("rows") > least))
    scored = held.select("file_id", F.col("ts").alias("time"), "id", F.round(1 - F.coalesce(V.cosine(total("b"), total("a")), F.lit(0.0)), 9).alias("score"))
    rank = F.row_number().over(Window.partitionBy("file_id").orderBy("score", "time", "id")) / F.count("*").over(Window.partitionBy("file_id"))
    return scored.select("file_id", "time", "id", rank.alias("rank"))


def spans(pool: DataFrame) -> DataFrame:
    """(file_id, lo, hi, count): from 0 to a second after the last frame, and how many sections that makes."""
    ends = pool.groupBy("file_id").agg((F.max("ts") + 1.0).alias("hi"), F.count("*").alias("n"))
    wanted = F.greatest(F.lit(FEWEST), F.least(F.lit(MOST), F.ceil(F.col("hi") / DENSITY)))
    return ends.select("file_id", F.lit(0.0).alias("lo"), "hi", F.least(wanted, F.col("n")).cast("int").alias("count"))


def boundaries(pool: DataFrame, transcript: DataFrame, ends: DataFrame) -> DataFrame:
    """(file_id, time, kind, score, strength) of picture and topic boundaries.

    ``pool`` and ``transcript`` are (file_id, ts, id, vector), ``ends``
    :func:`spans`. A strong topic boundary goes over to the strongest picture
    boundary near it, which gains by it; ``strength`` is the topic's rank.
    Scores near a file's beginning and end count less.
    """
    pictures = turning_points(pool, 2).withColumnRenamed("rank", "picture")
    said = transcript.join(ends, "file_id").where("ts >= lo and ts < hi").select("file_id", "ts", "id", "vector")
    topics = turning_points(said, 3, least=6).withColumnRenamed("rank", "topic")
    cell = lambda c: F.floor(F.col(c) / JOIN)
    strong = pictures.where(F.col("picture") >= PICTURE_RANK).select("file_id", F.col("time").alias("at"), F.col("id").alias("to"), "picture", F.explode(F.array(cell("time") - 1, cell("time"), cell("time") + 1)).alias("cell"))
    near = topics.where(F.col("topic") >= TOPIC_RANK).withColumn("cell", cell("time")).join(strong, ["file_id", "cell"]).where(F.abs(F.col("at") - F.col("time")) <= JOIN)
    chosen = near.groupBy("file_id", "id").agg(F.max_by("to", F.struct("picture", -F.col("at"))).alias("to"), F.first("topic").alias("topic"))
    gains = chosen.groupBy("file_id", F.col("to").alias("id")).agg(F.max("topic").alias("topic"))
    gained = pictures.join(gains, ["file_id", "id"], "left")
    score = F.when(F.col("topic").isNull(), F.col("picture")).otherwise(F.greatest("picture", "topic") + BONUS)
    first = gained.select("file_id", "time", F.when(F.col("topic").isNull(), "visual").otherwise("visual_topic").alias("kind"), score.alias("score"), F.coalesce("topic", F.lit(0.0)).alias("strength"))
    alone = topics.join(chosen.select("file_id", "id"), ["file_id", "id"], "left_anti").select("file_id", "time", F.lit("topic").alias("kind"), F.col("topic").alias("score"), F.col("topic").alias("strength"))
    both = first.unionByName(alone).join(ends, "file_id")
    margin = lambda edge: F.greatest(F.lit(edge[0]), edge[1] * (F.col("hi") - F.col("lo")))
    edge = (F.col("time") - F.col("lo") < margin(HEAD)) | (F.col("hi") - F.col("time") < margin(TAIL))
    return both.select("file_id", "time", "kind", F.when(edge, F.col("score") * EDGE).otherwise(F.col("score")).alias("score"), "strength")


def sections(found: DataFrame, pool: DataFrame, ends: DataFrame) -> DataFrame:
    """(file_id, start, end, kind, strength): spans cut at their best boundaries, and long sections once more.

    Cuts keep a third of an even section's length from each other and leave
    frames on either side. A section 2.5 times an even one is split at its best
    boundary left, or at the frame nearest its middle.
    """

    def cut(bounds: pd.DataFrame, frames: pd.DataFrame) -> pd.DataFrame:
        lo, hi, count = frames["lo"].iloc[0], frames["hi"].iloc[0], int(frames["count"].iloc[0])
        times, margin = sorted(frames["ts"]), (hi - lo) / (3 * count)
        order = sorted(zip(-bounds["score"], bounds["time"], bounds["kind"], bounds["strength"]), key=lambda b: b[:2])

        def splits(start: float, time: float, end: float) -> bool:
            i = bisect.bisect_left(times, time)
            return 0 < i < len(times) and times[i - 1] >= start and times[i] < end

        cuts: list[tuple] = [(lo, "start", 0.0)]
        for _, time, kind, strength in order:
            if len(cuts) < count and min(time - lo, hi - time) >= margin and all(abs(time - c[0]) >= margin for c in cuts[1:]) and splits(lo, time, hi):
                cuts.append((time, kind, strength))
        used = {c[0] for c in cuts[1:]}
        while len(cuts) < min(math.ceil(1.5 * count), MOST):
            cuts.sort(key=lambda c: c[0])
            new = None
            for start, end in sorted(zip([c[0] for c in cuts], [c[0] for c in cuts[1:]] + [hi]), key=lambda s: (s[0] - s[1], s[0])):
                if end - start <= SPLIT * (hi - lo) / count:
                    break
                fits = lambda t: start + margin <= t <= end - margin and splits(start, t, end)  # noqa: B023, E731
                new = next(((t, kind, strength) for _, t, kind, strength in order if t not in used and fits(t)), None)
                if new:
                    used.add(new[0])
                else:
                    inside = [t for t in times if fits(t)]
                    new = (min(inside, key=lambda t: (abs(t - (start + end) / 2), t)), "coverage", 0.0) if inside else None
                if new:
                    break
            if not new:
                break
            cuts.append(new)
        cuts.sort(key=lambda c: c[0])
        out = pd.DataFrame(cuts, columns=["start", "kind", "strength"])
        return out.assign(file_id=frames["file_id"].iloc[0], end=[*out["start"][1:], hi])[["file_id", "start", "end", "kind", "strength"]]

    frames = pool.select("file_id", "ts").join(ends, "file_id")
    pair = frames.groupBy("file_id").cogroup(found.toDF(*found.columns).groupBy("file_id"))
    return pair.applyInPandas(lambda f, b: cut(b, f), "file_id long, start double, end double, kind string, strength double")


def _same(a: dict, b: dict, cosine: float) -> bool:
    """Whether two frames show the same: by their letters if both are textual, by their vectors if neither is."""
    if a["textual"] != b["textual"]:
        return False
    if a["textual"]:
        return bool(a["bigrams"] | b["bigrams"]) and len(a["bigrams"] & b["bigrams"]) / len(a["bigrams"] | b["bigrams"]) >= OVERLAP
    return float(a["unit"] @ b["unit"]) >= cosine


def scenes(cut: DataFrame, pool: DataFrame) -> DataFrame:
    """(file_id, start, end, frame_id, kind, asked): sections with a frame each, alike neighbours put together.

    ``pool`` is (file_id, frame_id, ts, vector, lines), lines being what is
    written in the picture. Longest section first, a section's frame is the one
    nearest the mean of its frames and farthest from frames taken before. A
    section without frames belongs to the one before it. A section goes to the one before it if their frames show the same and no
    strong topic begins there. ``asked`` is false for what shows the same as a
    longer one.
    """

    def choose(own: pd.DataFrame, frames: pd.DataFrame) -> pd.DataFrame:
        own, frames = own.sort_values("start").reset_index(drop=True), frames.sort_values(["ts", "changed", "frame_id"])
        ts, raw = frames["ts"].to_numpy(), np.stack(frames["vector"].map(lambda v: np.asarray(v, float)))
        size = np.linalg.norm(raw, axis=1, keepdims=True)
        unit = np.divide(raw, size, out=np.zeros_like(raw), where=size > 0)
        filled = [bool(((ts >= a) & (ts < b)).any()) for a, b in zip(own["start"], own["end"])]
        last = own["end"].iloc[-1]
        own = own[filled].reset_index(drop=True)
        own["end"] = [*own["start"][1:], last]
        length = (own["end"] - own["start"]).to_numpy()
        longest = sorted(range(len(own)), key=lambda i: (-length[i], own["start"][i]))
        reps: dict[int, dict] = {}
        for i in longest:
            start, end = own["start"][i], own["end"][i]
            at = np.flatnonzero((ts >= start + DELAY) & (ts < end))
            at = at if len(at) else np.flatnonzero((ts >= start) & (ts < end))
            mean = raw[at].mean(axis=0)
            norm = np.linalg.norm(mean)
            score = unit[at] @ mean / norm if norm else np.zeros(len(at))
            if reps:
                score = score - AGAINST * (unit[at] @ np.stack([r["unit"] for r in reps.values()]).T).max(axis=1)
            best = at[int(np.argmax(np.round(score, 12)))]
            lines = ["".join(x.split()) for x in frames["lines"].iloc[best] if x] if frames["lines"].iloc[best] is not None else []
            textual = max((len(x) for x in frames["lines"].iloc[best] if x), default=0) >= TEXTUAL if lines else False
            reps[i] = {"unit": unit[best], "frame_id": frames["frame_id"].iloc[best], "length": length[i], "textual": textual, "bigrams": {x[j : j + 2] for x in lines for j in range(len(x) - 1)}}
        out: list[dict] = []
        for i in range(len(own)):
            if out and own["strength"][i] < TOPIC_RANK and _same(out[-1]["rep"], reps[i], MERGE):
                out[-1]["end"] = own["end"][i]
                out[-1]["rep"] = max(out[-1]["rep"], reps[i], key=lambda r: r["length"])
            else:
                out.append({"start": own["start"][i], "end": own["end"][i], "kind": own["kind"][i], "rep": reps[i]})
        asked: list[dict] = []
        for scene in sorted(out, key=lambda s: (s["start"] - s["end"], s["start"])):
            scene["asked"] = not any(_same(scene["rep"], other["rep"], ASK) for other in asked)
            asked += [scene] if scene["asked"] else []
        rows = [(own["file_id"][0], s["start"], s["end"], s["rep"]["frame_id"], s["kind"], s["asked"]) for s in out]
        return pd.DataFrame(rows, columns=["file_id", "start", "end", "frame_id", "kind", "asked"])

    lines = F.col("lines") if "lines" in pool.columns else F.lit(None).cast("array<string>")
    frames = pool.select("file_id", "frame_id", "ts", "changed", V.doubles("vector").alias("vector"), lines.alias("lines"))
    pair = cut.groupBy("file_id").cogroup(frames.toDF(*frames.columns).groupBy("file_id"))
    return pair.applyInPandas(choose, "file_id long, start double, end double, frame_id long, kind string, asked boolean")


def select_scenes(frames: DataFrame, transcript: DataFrame) -> DataFrame:
    """:func:`scenes` of ``frames`` (file_id, frame_id, ts, changed, vector, lines) and ``transcript`` (file_id, ts, id, vector).

    Files without frames have none. A task holds the frames of one file.
    """
    pool = frame_pool(frames)
    ends = spans(pool)
    found = boundaries(pool.select("file_id", "ts", F.col("frame_id").alias("id"), "vector"), transcript, ends)
    return scenes(sections(found, pool, ends), pool)
