"""Scene selection against a plain version, on films of few frames."""

import math
import random

import numpy as np
import pytest

from quarry.operators import scenes

FRAMES = "file_id long, frame_id long, ts double, changed boolean, vector array<double>, lines array<string>"


def cosine(a, b):
    size = np.linalg.norm(a) * np.linalg.norm(b)
    return float(a @ b / size) if size else 0.0


def ranked(rows, n):
    scored = []
    for i in range(1, len(rows)):
        a, b = np.mean([r[2] for r in rows[max(0, i - n) : i]], axis=0), np.mean([r[2] for r in rows[i : i + n]], axis=0)
        scored.append((round(1 - cosine(a, b), 9), rows[i][0], rows[i][1]))
    return [((k + 1) / len(scored), time) for k, (_, time, _) in enumerate(sorted(scored))]


def plain(frames, transcript):
    """(start, end, frame_id, kind, asked) of one film."""
    steady = [f[1] for f in frames if not f[2]]
    pool = sorted((f for f in frames if not f[2] or all(abs(f[1] - t) > 3 for t in steady)), key=lambda f: (f[1], f[2], f[0]))
    hi = max(f[1] for f in pool) + 1
    count = min(max(8, min(40, math.ceil(hi / 75))), len(pool))
    margin, times = hi / (3 * count), [f[1] for f in pool]
    visual = [[t, "visual", r, 0.0] for r, t in ranked([(f[1], f[0], f[3]) for f in sorted(pool, key=lambda f: (f[1], f[0]))], 2)]
    said = sorted((t for t in transcript if 0 <= t[0] < hi), key=lambda t: t[:2])
    topics, joined = [], {}
    for r, t in ranked(said, 3) if len(said) > 6 else []:
        near = [v for v in visual if v[2] >= 0.8 and abs(v[0] - t) <= 5]
        if r >= 0.7 and near:
            best = min(near, key=lambda v: (-v[2], v[0]))
            joined[best[0]] = max(joined.get(best[0], 0), r)
        else:
            topics.append([t, "topic", r, r])
    for v in visual:
        if v[0] in joined:
            v[1:] = ["visual_topic", max(v[2], joined[v[0]]) + 0.25, joined[v[0]]]
    every = visual + topics
    for b in every:
        if b[0] < max(20, 0.03 * hi) or hi - b[0] < max(30, 0.06 * hi):
            b[2] *= 0.3
    every.sort(key=lambda b: (-b[2], b[0]))

    def sides(start, t, end):
        return any(start <= x < t for x in times) and any(t <= x < end for x in times) and max(x for x in times if x < t) >= start

    cuts = [(0.0, "start", 0.0)]
    for t, kind, _, strength in every:
        if len(cuts) < count and t >= margin and hi - t >= margin and all(abs(t - c[0]) >= margin for c in cuts[1:]) and sides(0, t, hi):
            cuts.append((t, kind, strength))
    taken = {c[0] for c in cuts[1:]}
    while len(cuts) < min(math.ceil(1.5 * count), 40):
        cuts.sort()
        ends = [*[c[0] for c in cuts[1:]], hi]
        new = None
        for start, end in sorted(((c[0], e) for c, e in zip(cuts, ends)), key=lambda s: (-(s[1] - s[0]), s[0])):
            if end - start <= 2.5 * hi / count:
                break
            ok = [b for b in every if b[0] not in taken and start + margin <= b[0] <= end - margin and sides(start, b[0], end)]
            at = [x for x in times if start + margin <= x <= end - margin and sides(start, x, end)]
            if ok:
                new = (ok[0][0], ok[0][1], ok[0][3])
                taken.add(new[0])
            elif at:
                new = (min(at, key=lambda x: (abs(x - (start + end) / 2), x)), "coverage", 0.0)
            if new:
                break
        if not new:
            break
        cuts.append(new)
    cuts.sort()
    own = [(c[0], e, c[1], c[2]) for c, e in zip(cuts, [*[c[0] for c in cuts[1:]], hi])]
    for i in range(len(own) - 1, 0, -1):  # a section without frames belongs to the one before it
        if not any(own[i][0] <= x < own[i][1] for x in times):
            own[i - 1 : i + 1] = [(own[i - 1][0], own[i][1], *own[i - 1][2:])]
    reps = {}
    for i in sorted(range(len(own)), key=lambda i: (-(own[i][1] - own[i][0]), own[i][0])):
        start, end = own[i][:2]
        fit = [f for f in pool if start + 2 <= f[1] < end] or [f for f in pool if start <= f[1] < end]
        mean = np.mean([f[3] for f in fit], axis=0)
        score = lambda f: cosine(f[3], mean) - (0.7 * max(cosine(f[3], r[3]) for r in reps.values()) if reps else 0)  # noqa: B023, E731
        reps[i] = max(fit, key=lambda f: round(score(f), 12))
    letters = lambda f: {x[j : j + 2] for x in f[4] or [] for j in range(len(x) - 1)}

    def same(a, b, limit):
        textual = [max(map(len, f[4] or [""])) >= 200 for f in (a, b)]
        if textual[0] != textual[1]:
            return False
        return len(letters(a) & letters(b)) / len(letters(a) | letters(b)) >= 0.85 if textual[0] else cosine(a[3], b[3]) >= limit

    out = []
    for i, (start, end, kind, strength) in enumerate(own):
        if out and strength < 0.7 and same(out[-1][3], reps[i], 0.93):
            longer = end - start > out[-1][4]
            out[-1][1] = end
            if longer:
                out[-1][3:] = [reps[i], end - start]
        else:
            out.append([start, end, kind, reps[i], end - start])
    asked = []
    for s in sorted(out, key=lambda s: (-(s[1] - s[0]), s[0])):
        if not any(same(s[3], o[3], 0.95) for o in asked):
            asked.append(s)
    return [(round(s[0], 6), round(s[1], 6), s[3][0], s[2], s in asked) for s in out]


@pytest.mark.parametrize("step", [1.5, 9.0, 40.0])
def test_scenes_equal_the_plain_version(spark, step):
    rng = np.random.default_rng(int(step))
    pick = random.Random(3)
    frames, said, id_ = [], [], 0
    for file_id, n in enumerate([1, 2, 5, 40, 90]):
        at, base = 0.0, rng.normal(size=6)
        for _ in range(n):
            at += step * pick.choice([0.4, 1.0, 1.7])
            if pick.random() < 0.25:
                base = rng.normal(size=6)
            lines = pick.choice([None, [], ["ab" * 120], ["short"], ["cd" * 130, "x"]])
            frames.append((file_id, id_, round(at, 3), pick.random() < 0.3 and n > 2, (base + 0.2 * rng.normal(size=6)).tolist(), lines))
            id_ += 1
        said += [(file_id, round(step * k * 1.3, 3), k, rng.normal(size=6).tolist()) for k in range(n // 2)]
    frames.append((9, id_, None, False, [1.0] * 6, None))
    got: dict[int, list] = {}
    rows = scenes.select_scenes(spark.createDataFrame(frames, FRAMES).repartition(3), spark.createDataFrame(said, "file_id long, ts double, id long, vector array<double>"))
    for r in rows.orderBy("file_id", "start").collect():
        got.setdefault(r.file_id, []).append((round(r.start, 6), round(r.end, 6), r.frame_id, r.kind, r.asked))
    want = {}
    for f in range(5):
        own = [(i, t, c, np.array(v), lines) for file_id, i, t, c, v, lines in frames if file_id == f]
        want[f] = plain(own, [(t, k, np.array(v)) for file_id, t, k, v in said if file_id == f])
    assert got == want


def test_no_frames_give_no_scenes(spark):
    none = spark.createDataFrame([], FRAMES)
    assert scenes.select_scenes(none, spark.createDataFrame([], "file_id long, ts double, id long, vector array<double>")).count() == 0
