"""Rules at their thresholds, on synthetic rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.functions import vectors as V
from quarry.operators import filters, feed, fusion, keyword, library, metrics, operations, sequence, snippets, vector
from quarry.streaming import changes


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_guards_judge_before_the_type_filter(spark):
    scores = [(1, i, s) for i, s in enumerate((0.95, 0.90, 0.88, 0.80))] + [(2, i, 0.9) for i in range(6)]
    df = spark.createDataFrame(scores, "query_id long, id long, score double")
    assert rows(vector.guarded(df), "query_id", "id") == [(1, 0), (1, 1)]
    assert rows(vector.guarded(df, gap=None, flat=False), "query_id").count((2,)) == 6
    only = vector.guarded(df, allow=F.col("id") > 0, margin=0.02)
    assert rows(only, "query_id", "id") == [(1, 1), (1, 2)]


def test_similar_filters_drop_identical_and_undecided(spark):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate((0.9995, 0.9, 0.86, 0.84, 0.69))] + [(2, i, 0.72) for i in range(5)], "query_id long, id long, score double")
    assert rows(vector.similar_filters(df), "query_id", "id") == [(1, 1), (1, 2)]


def test_neighbours_in_blocks_equal_one_block(spark):
    df = spark.createDataFrame([(i, [math.cos(i), math.sin(i)]) for i in range(50)], "id long, vector array<double>")
    q = df.where("id % 7 = 0").withColumnRenamed("id", "query_id")
    assert rows(vector.neighbours(q, df, k=3, queries_at_once=2), "query_id", "id") == rows(vector.neighbours(q, df, k=3), "query_id", "id")
    assert vector.neighbours(q.where("false"), df, k=3).count() == 0


def test_first_k_takes_the_first_of_equal_scores():
    rng = np.random.default_rng(1)
    for _ in range(200):
        k = int(rng.integers(1, 8))
        scores = rng.integers(0, 6, (rng.integers(1, 6), rng.integers(1, 30))).astype(float)
        scores[rng.random(scores.shape) < 0.3] = -np.inf
        for row, found in zip(scores, vector._first_k(scores, k)):
            order = np.lexsort((np.arange(len(row)), -row))[:k]
            assert sorted(order[row[order] > -np.inf]) == list(np.flatnonzero(found))


def test_neighbours_give_the_best_of_each_group(spark):
    df = spark.createDataFrame([(i, [float(i % 7), float(i % 3)], i % 4) for i in range(40)], "id long, vector array<double>, label int")
    q = spark.createDataFrame([(1, [1.0, 0.5]), (2, [-1.0, 1.0])], "query_id long, vector array<double>")
    found = {(r.query_id, r.id): r.score for r in vector.neighbours(q, df, k=2, group="label").collect()}
    want = {}
    for qid, (x, y) in ((1, (1.0, 0.5)), (2, (-1.0, 1.0))):
        best = {g: max(x * (i % 7) + y * (i % 3) for i in range(40) if i % 4 == g) for g in range(4)}
        want |= {(qid, g): best[g] for g in sorted(best, key=lambda g: (-best[g], g))[:2]}
    assert found == want


def test_snippets_of_null_and_empty_texts(spark):
    df = spark.createDataFrame([(None,), ("",), ("a" * 30 + "\n" + "b" * 30,)], "t string")
    cut = [r[0] for r in df.select(snippets.line_chunks(F.col("t"), 40, 20)).collect()]
    assert cut == [[], [], ["a" * 30 + "\n", "b" * 30]]
    got = df.select(snippets.quote_score(F.lit("xaaay"), F.coalesce("t", F.lit("")))).collect()
    assert [r[0] for r in got] == [0, 0, 3001]


def test_segments_split_beyond_the_gap(spark):
    df = spark.createDataFrame([(1, 0.0, 0.5), (1, 45.0, 0.9), (1, 90.01, 0.7), (1, 300.0, 0.1)], "file_id long, ts double, score double")
    assert rows(vector.segments(df), "start", "end", "peak", "hits") == [(0.0, 75.0, 0.9, 2), (90.01, 120.01, 0.7, 1)]


def test_merge_scales_each_list(spark):
    a = spark.createDataFrame([(1, 1, 0.2), (1, 2, 0.4)], "query_id long, id long, score double")
    b = spark.createDataFrame([(1, 2, 5.0), (1, 3, 5.0)], "query_id long, id long, score double")
    assert rows(vector.merge_similar(a, b), "id", "score", "sources") == [(1, 0.0, "left"), (2, 1.0, "both"), (3, 0.7, "right")]


def test_pool_is_of_unit_length(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0])], "k long, v array<double>")
    (row,) = V.pool(df, "k", "v").collect()
    assert row.v == pytest.approx([0.5**0.5] * 2)


def test_text_folds(spark):
    row = spark.range(1).select(
        X.ascii_lower(F.lit("ÀBC")).alias("low"), X.to_katakana(F.lit("かな")).alias("kata"), X.to_hiragana(F.lit("カナ")).alias("hira"), X.positions(F.lit("ab.ab.ab"), F.lit("ab.")).alias("at"), X.script(F.lit("漢字かな")).alias("script"), X.token_estimate(F.lit("漢字abcdefg")).alias("n")
    ).first()
    assert tuple(row) == ("Àbc", "カナ", "かな", [0, 3], "kanji", 4)


def test_bm25_short_phrase_matches_nothing_and_all_must_match(spark):
    docs = spark.createDataFrame([(1, "the thing"), (2, "other"), (3, "thing other")], "id long, text string")
    q = spark.createDataFrame([(1, "he"), (2, "thing"), (2, "other"), (3, "zebra")], "query_id long, phrase string")
    assert rows(keyword.bm25(docs, q, ["text"]), "query_id", "id") == [(2, 3)]


def test_rarity_keeps_all_if_none_is_rare(spark):
    tokens = spark.createDataFrame([(1, 0, "a"), (1, 1, "bb"), (2, 0, "bb")], "query_id long, position int, term string")
    terms = spark.createDataFrame([(1, "bb"), (2, "bb")], "id long, term string")
    assert rows(keyword.rarity_filter(tokens, terms, 2)) == [(1, "a"), (2, "bb")]


def test_group_spans_follow_the_running_end(spark):
    df = spark.createDataFrame([(1, 0.0, 100.0), (1, 10.0, 20.0), (1, 130.0, None), (1, 191.0, 200.0)], "f long, start double, end double")
    assert rows(fusion.group_spans(df, "f"), "start", "end", "n") == [(0.0, 160.0, 3), (191.0, 200.0, 1)]


def test_budget_and_history(spark):
    df = spark.createDataFrame([(1, 0, "a" * 50), (1, 1, "b" * 30), (1, 2, "c" * 30)], "conv long, turn long, text string")
    assert rows(fusion.trim_history(df, 100), "turn") == [(2,)]
    assert rows(fusion.trim_history(df, 40), "text") == [("c" * 20,)]


def test_skip_fill_takes_a_later_smaller_chunk(spark):
    df = spark.createDataFrame([(1, 0, 6, 0.9), (1, 1, 5, 0.8), (1, 2, 4, 0.7)], "f long, chunk long, size long, score double")
    assert rows(fusion.skip_fill(df, "f", 10)) == [(1, 0), (1, 2)]


def test_engagement_and_freshness(spark):
    lit, no, yes = F.lit, F.lit(False), F.lit(True)
    of = lambda liked, dismissed, watched, duration, position, legacy, embed=no: feed.engagement(liked, dismissed, lit(watched), lit(duration).cast("double"), lit(position).cast("double"), legacy, embed)
    cases = [
        (of(yes, yes, 0.0, 60.0, 0.0, no), 1.0), (of(no, yes, 60.0, 60.0, 0.0, no), 0.0), (of(no, no, 30.0, 60.0, 0.0, no), 1.0), (of(no, no, 29.9, 60.0, 60.0, no), 0.0),
        (of(no, no, 0.0, 19.0, 9.5, no), 1.0), (of(no, no, 19.0, 19.0, 9.0, no), 0.0), (of(no, no, 60.0, None, 9.0, no), 0.0), (of(no, no, 0.0, 100.0, 9.9, yes), 0.0),
        (of(no, no, 0.0, 100.0, 25.0, yes), 0.5), (of(no, no, 90.0, 100.0, None, yes), 1.0), (of(no, no, 0.0, None, None, yes), 0.0), (of(no, no, 0.0, None, None, yes, yes), 0.5), (of(no, yes, 90.0, 100.0, None, yes), 0.0),
    ]
    fresh = [(feed.freshness(lit(365.0)), 0.5), (feed.freshness(lit(-2.0), floor=0.1), 0.1), (feed.freshness(lit(-0.5)), 1.0)]
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(cases + fresh)]).first()
    assert list(row) == [want for _, want in cases + fresh]


def test_choose_k_rounds_half_to_even():
    assert [feed.choose_k(n) for n in (11, 12, 50, 1000)] == [1, 2, 5, 8]


def test_failed_jobs_keep_ties_and_null_providers(spark):
    df = spark.createDataFrame([(1, 1, "k", None, "succeeded", 1), (2, 1, "k", None, "failed", 2), (3, 1, "k", None, "failed", 2), (4, 1, "k", "p", "failed", 1), (5, 1, "k", "p", "succeeded", 3)], "job_id long, file_id long, job_kind string, provider string, status string, ts long")
    assert rows(operations.latest_failed(df), "job_id") == [(2,), (3,)]
    assert sorted(rows(operations.open_attempts(df), "attempts")) == [(0,), (2,)]


def test_scrub(spark):
    texts = ["401 Authorization: Bearer abc.def-1 x", "bearer short", "Bearer longenough1", "api-key: k1", "use sk-abcdefgh12 now", "in /app/a/b/c.py", "z" * 300]
    got = [r.t for r in spark.createDataFrame([(t,) for t in texts], "x string").select(operations.scrub(F.col("x")).alias("t")).collect()]
    assert got == ["401 [REDACTED] x", "bearer short", "[REDACTED]", "[REDACTED]", "use [REDACTED] now", "in …/c.py", "z" * 255 + "…"]


def test_ranking_quality(spark):
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 10, 1)], "query_id long, id long, rank int")
    gains = spark.createDataFrame([(1, 11, 1)], "query_id long, id long, gain int")
    assert rows(metrics.ranking_quality(ranked, gains, 2)) == [(1, 1.0, 0.5, 0.5, pytest.approx(1 / math.log2(3))), (2, 1.0, 0.0, 0.0, 0.0)]


def test_chunks_end_before_the_best_break():
    text = "a" * 250 + ". " + "b" * 300
    assert list(sequence.cut_points(text, 400, 80)) == [(0, 250), (170, 570 if len(text) > 570 else len(text))]
    assert list(sequence.cut_points("short " + "x" * 900, 400, 80))[:2] == [(0, 5), (1, 401)]
    assert list(sequence.cut_points("", 400, 80)) == [] and list(sequence.cut_points("a" * 400, 400, 80)) == [(0, 400)]


def test_a_point_between_digits_ends_no_sentence(spark):
    assert sequence.in_number("", "3.", "3km") and sequence.in_number("1", ",", "500") and not sequence.in_number("a", ".", "5") and not sequence.in_number("", "3.", "km")
    words = [(1, i, w, i * 2.0, i * 2.0 + 2.0, "a") for i, w in enumerate(["w"] * 5 + ["3.", "5", "end.", "next"])]
    df = spark.createDataFrame(words, "file_id long, idx long, word string, start double, end double, speaker string")
    assert rows(sequence.transcript_chunks(df), "chunk", "end") == [(0, 16.0), (1, 18.0)]


def test_frames_differ_from_the_last_one_kept(spark):
    df = spark.createDataFrame([(1, 0.0, [0]), (1, 2.0, [255]), (1, 3.0, [255]), (1, 5.9, [0]), (1, 6.0, [0]), (1, 9.0, [1])], "file_id long, ts double, hash array<long>")
    assert rows(sequence.changed_frames(df), "ts") == [(0.0,), (3.0,), (6.0,)]


def test_filters(spark):
    df = spark.createDataFrame([(1, "a/b", "X.MD", 10, ["Red", "blue"]), (2, "ab", "y.txt", None, None)], "id long, path string, name string, size long, tags array<string>")
    assert rows(df.where(filters.comparisons(F.col("size"), ["gte:10", "lt:11"])), "id") == [(1,)]
    assert rows(df.where(filters.folders(F.col("path"), ["/a/"])), "id") == [(1,)] and rows(df.where(filters.tags(F.col("tags"), ["RED", " "])), "id") == [(1,)]
    assert rows(df.where(filters.kind("markdown", F.lit("document"), F.lit(None).cast("string"), F.col("name"), ["text/markdown"], [".md"])), "id") == [(1,)]
    for bad in (["ge:1"], ["gt:01"], ["gt:1.5"], [f"gt:{i}" for i in range(21)]):
        with pytest.raises(ValueError):
            filters.comparisons(F.col("size"), bad)
    assert filters.fallback_ladder([("a", ["x"]), ("b", []), ("c", ["y"])]) == [["a", "b"], ["b"], []] and filters.fallback_ladder([]) == [[]]


def test_transcript_chunks_break_on_silence_and_speaker(spark):
    words = [(1, i, "w", i * 1.0, i + 1.0, "a") for i in range(11)] + [(1, 11, "x", 11.4, 12.0, "a"), (1, 12, "y", 12.0, 12.5, "b")]
    df = spark.createDataFrame(words, "file_id long, idx long, word string, start double, end double, speaker string")
    assert rows(sequence.transcript_chunks(df), "chunk", "start", "end") == [(0, 0.0, 11.0), (1, 11.4, 12.5)]


def test_alignment_stays_on_ties(spark):
    df = spark.createDataFrame([(1, s, c, v) for s, c, v in ((0, 0, 1.0), (0, 1, 0.0), (1, 0, 0.5), (1, 1, 0.5))], "file_id long, segment long, chunk long, score double")
    assert rows(sequence.align_monotonic(df), "chunk", "segment") == [(0, 0), (1, 1)]


def test_html_sections(spark):
    df = spark.createDataFrame([(1, "<h1>T</h1><p>a &amp; b</p><script>x</script><h2>U</h2><li>c"), (2, None)], "page_id long, html string")
    assert rows(sequence.html_sections(df), "section", "title", "text") == [(0, "T", "a & b"), (1, "U", "- c")]


def test_changes_are_idempotent_and_late_events_do_nothing(spark, tmp_path):
    schema = "id long, event_id long, op string, ts timestamp, size double"
    from datetime import datetime

    at = lambda h: datetime(2024, 1, 1, h)
    events = spark.createDataFrame([(1, 1, "upsert", at(1), 1.0), (1, 2, "upsert", at(3), 2.0), (2, 3, "upsert", at(1), 5.0), (2, 4, "deleted", at(2), None)], schema)
    table = changes.apply_changes(events.drop("op").where("false"), events, "id", ["ts", "event_id"])
    assert rows(table, "id", "size") == [(1, 2.0)]
    again = changes.apply_changes(table, events.where("event_id = 1"), "id", ["ts", "event_id"])
    assert rows(again, "id", "size") == [(1, 2.0)]

    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    state = {"table": events.drop("op").where("false")}

    def apply(batch, _):
        state["table"] = spark.createDataFrame(changes.apply_changes(state["table"], batch, "id", ["ts", "event_id"]).collect(), table.schema)

    changes.change_stream(stream, apply, str(tmp_path / "ck")).awaitTermination(60)
    assert rows(state["table"], "id", "size") == [(1, 2.0)]


def test_hybrid_search_scopes_before_ranking(spark):
    from quarry.plans import search

    rows_ = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.436]), (3, [0.0, 1.0]), (4, [1.0, 0.0])], "id long, vector array<double>")
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma"), (3, "alpha alpha"), (4, "alpha")], "id long, text string")
    q = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, vector array<double>")
    p = spark.createDataFrame([(7, "alpha")], "query_id long, phrase string")
    scope = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    got = [r.id for r in search.hybrid(q, p, rows_, docs, ["text"], scope=scope).orderBy(F.desc("score"), "id").collect()]
    assert got[0] == 1 and 4 not in got
    lists = spark.createDataFrame([(7, 0, 1, 0.9), (7, 1, 2, 0.8), (7, 1, 1, 0.7)], "query_id long, clue int, id long, score double")
    assert [r.id for r in search.merge_clues(lists, 1).collect()] == [1]


def test_library_rules(spark):
    from quarry.operators import library as L

    row = spark.range(1).select(
        L.keyword_bag(F.lit("a b" + " c" * 99)).alias("cut"), L.shared_keywords(F.array(*map(F.lit, "cab")), F.array(*map(F.lit, "abx"))).alias("shared"), L.markers(F.lit("x [2] y [1] [2] [0000009]")).alias("marks"),
        L.filename_tokens(F.lit("My_trip-2024 (final).mp4")).alias("tokens"), L.box_overlap([F.lit(x) for x in (0.0, 0.0, 2.0, 2.0)], [F.lit(x) for x in (1.0, 0.0, 3.0, 2.0)]).alias("iou"), L.normalise_token(F.lit("Été ガ")).alias("plain"),
    ).first()
    assert len(row.cut) == 100 and row.shared == ["a", "b"] and row.marks == [2, 1] and row.tokens == ["my", "trip", "2024", "final"] and row.iou == pytest.approx(1 / 3) and row.plain == "ete ガ"
    frames = spark.createDataFrame([(1, i) for i in range(25)], "f long, t long")
    assert L.thin(frames, "f", "t", 10).count() == 10 and L.thin(frames, "f", "t", 30).count() == 25


def test_markdown_subtitles_and_windows(spark):
    from quarry.operators import documents as D

    md = spark.createDataFrame([(1, "# A\nintro\nmore\n\n## B\n- x\n1. y\n| h | i |\n|---|:-:|\n| 1 | 2 |\n# C\nend"), (2, None)], "id long, text string")
    assert rows(D.markdown_segments(md), "segment", "kind", "path", "text") == [
        (0, "paragraph", "A", "intro more"), (1, "bullet", "A > B", "x"), (2, "bullet", "A > B", "y"), (3, "row", "A > B", "h | i"), (4, "row", "A > B", "1 | 2"), (5, "paragraph", "C", "end"),
    ]
    vtt = "WEBVTT\n\n00:01.000 --> 00:03.000\nhello\n\n1\n00:00:02.500 --> 00:00:04,000 align:start\nhello\n<b>world</b> &amp; all\n\n"
    cues = D.subtitle_cues(spark.createDataFrame([(1, vtt)], "id long, text string"))
    assert rows(cues, "start", "end", "text") == [(1.0, 3.0, "hello"), (2.5, 4.0, "world & all")]
    assert rows(D.clamped(cues), "end") == [(2.5,), (4.0,)]
    assert rows(D.merged_cues(cues), "start", "end", "text") == [(1.0, 4.0, "hello world & all")]
    row = spark.range(1).select(D.sample_windows(F.lit("abcdefghij" * 10), 10, 3).alias("w"), D.trim_to_sentence(F.lit("One two. Three four five"), 12).alias("s"), D.trim_to_sentence(F.lit("a. " + "b" * 30), 12).alias("hard")).first()
    assert [len(x) for x in row.w] == [10, 10, 10] and row.s == "One two." and row.hard == "a. bbbbbbbbb"


def test_citation_gates(spark):
    from quarry.operators import documents as D

    c = [(1, 0, "bullet", 3, 0.8), (1, 0, "bullet", 9, 0.79), (1, 1, "bullet", 1, 0.6), (1, 1, "bullet", 2, 0.58), (1, 2, "bullet", 1, 0.5), (1, 3, "paragraph", 1, 0.9), (1, 3, "paragraph", 60, 0.7)]
    found = D.gated_citations(spark.createDataFrame(c, "file_id long, segment long, kind string, chunk long, score double"), spark.createDataFrame([(1, 100)], "file_id long, chunks long"))
    assert {r[0] for r in rows(found, "segment")} == {0}
    dense = spark.createDataFrame([(1, 0, 1, 0.9), (1, 0, 2, 0.8)], "file_id long, segment long, chunk long, score double")
    ranks = spark.createDataFrame([(1, 0, 2, 1), (1, 0, 7, 2)], "file_id long, segment long, chunk long, rank long")
    assert rows(D.in_list_ranks(dense, ranks, most=1), "chunk", "score") == [(2, 0.8)]


def test_error_rates_count_words_and_characters(spark):
    rows = spark.createDataFrame(
        [("A b, c d", "a x c", "en"), ("One two", "one two", "en"), ("カナ。", "かな", "ja"), ("", "a", "en"), ("", "", "en")], "a string, b string, lang string"
    )
    got = [(r.wer, round(r.cer, 6)) for r in metrics.error_rates(rows, "a", "b", F.col("lang")).collect()]
    assert got == [(0.5, round(3 / 7, 6)), (0.0, 0.0), (None, 0.0), (1.0, 1.0), (0.0, 0.0)]


def test_runs_of_nearly_the_same_weight_make_one_range(spark):
    rows = [(1, 0, c, s) for c, s in ((1, 0.9), (2, 0.8), (30, 0.9), (31, 0.6), (60, 0.7))]
    scores = spark.createDataFrame(rows, "file_id long, segment long, chunk long, score double")
    assert [(r["first"], r["last"]) for r in sequence.narrow_clusters(scores).collect()] == [(1, 31)]
    assert [(r["first"], r["last"]) for r in sequence.narrow_clusters(scores, union=1.0).collect()] == [(1, 2)]
    rival = spark.createDataFrame([(1, 1, 1, 0.95), (1, 1, 2, 0.1), (1, 1, 30, 0.895)], scores.schema)
    apart = {r["segment"]: (r["first"], r["last"]) for r in sequence.narrow_clusters(scores.unionByName(rival), margin=0.01).collect()}
    assert apart == {0: (2, 60), 1: (1, 1)}


def test_times_between_frames(spark):
    frames = spark.createDataFrame([(1, 0.5), (1, 10.5), (2, 4.0)], "file_id long, ts double")
    files = spark.createDataFrame([(1, 12.0), (2, 5.0), (3, None), (4, 0.0)], "file_id long, duration double")
    got = sorted((r.file_id, r.ts, r.filled) for r in library.fill_times(frames, files, 5.0).collect())
    assert got == [(1, 0.5, False), (1, 5.5, True), (1, 10.5, False), (2, 0.0, True), (2, 4.0, False), (3, 0.0, True), (4, 0.0, True)]
