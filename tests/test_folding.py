"""Compatibility forms, cases and kana count as one; filters, segments and expansions at their edges."""

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import documents, filters, keyword, metrics, snippets, vector


def test_folded_forms(spark):
    df = spark.createDataFrame([("ﬁＶＩＤＥＯ",), ("Straße",), (None,)], "t string")
    assert [r.f for r in df.select(X.folded("t").alias("f")).collect()] == ["fivideo", "strasse", None]
    got = df.select(keyword.blocked(F.col("t"), ["Video", "STRASSE"]).alias("b")).collect()
    assert [r.b for r in got] == [True, True, None]
    kana = spark.createDataFrame([("どうがを見る",), ("ドウガ",), ("どう",)], "t string")
    assert [r.b for r in kana.select(keyword.blocked(F.col("t"), ["ドウガ"]).alias("b")).collect()] == [True, True, False]


def test_words_that_contain_a_blocked_one_leave_their_term(spark):
    rows = [("sf", ["SF", "写真集 京都", "Videos", "sf", "ｖｉｄｅｏ game", "kyoto"]), (" ", ["a"]), ("x", None), ("x", [None, " "])]
    df = spark.createDataFrame(rows, "q string, t array<string>")
    got = [r.e for r in df.select(snippets.expansion_terms(F.col("q"), F.col("t"), ["写真", "video"], 4).alias("e")).collect()]
    assert got == [["SF", "京都", "game", "kyoto"], [], ["x"], ["x"]]


def test_error_rates_fold_before_they_compare(spark):
    df = spark.createDataFrame([("Straße, ﬁne", "STRASSE fine", "de"), ("ネコ です", "ねこ です", "ja")], "a string, b string, l string")
    got = [(r.wer, r.cer) for r in metrics.error_rates(df, "a", "b", F.col("l")).collect()]
    assert got == [(0.0, 0.0), (None, 0.0)]


def test_comparisons_of_fractions(spark):
    df = spark.createDataFrame([(1, 1.25), (2, 1.5), (3, None)], "id long, d double")
    ids = lambda wanted: sorted(r.id for r in df.where(filters.comparisons(F.col("d"), wanted, whole=False)).collect())
    assert ids(["gt:1.25"]) == [2] and ids(["gte:1.25", "lt:1.5"]) == [1] and ids(["lte:1.125"]) == []
    for bad in ("gt:1.50", "gt:1.", "gt:.5", "gt:1.1234", "gt:01.5"):
        with pytest.raises(ValueError):
            filters.comparisons(F.col("d"), [bad], whole=False)


def test_segments_end_at_the_next_frame_or_the_end_of_the_file(spark):
    frames = [(1, float(t), s) for t, s in ((0, 0.9), (10, 0.8), (25, 0.1), (100, 0.7), (300, 0.95))] + [(2, 5.0, 0.5)]
    df = spark.createDataFrame(frames, "file_id long, ts double, score double")
    ends = spark.createDataFrame([(1, 310.0), (2, 3.0)], "file_id long, duration double")
    got = sorted((r.file_id, r.start, r.end) for r in vector.segments(df.where("score >= 0.5"), per_file=9, frames=df, durations=ends).collect())
    assert got == [(1, 0.0, 25.0), (1, 100.0, 130.0), (1, 300.0, 310.0), (2, 5.0, 35.0)]
    assert vector.required_seeds(3) == 1 and vector.required_seeds(2000) == 50 and vector.required_seeds(9000) == 90 and vector.required_seeds(10**6) == 4096
    best = vector.seeded_segments(df, files=1, durations=ends).collect()
    assert [(r.file_id, r.start) for r in best] == [(1, 300.0)]


def test_cleaned_files(spark):
    deep = "[" * 4000 + '"deep"' + "]" * 4000
    rows = [
        (".srt", "1\n00:00:01,000 --> 00:00:02,000\n<i>Hello</i>\n\n2\n00:00:03,000 --> 00:00:04,000\n there \n<b></b>", "Hello there"),
        (".VTT", "WEBVTT\n\nNOTE x\n\n1\n00:00:01.000 --> 00:00:02.000 align:start\nHi", "Hi"),
        (".csv", 'a,"b", ,c\n , \n"d"', "a b c\nd"),
        (".json", '{"a": ["xyz", {"b": "long one"}, 5, "no"], "c": null, "d": "end"}', "xyz long one end"),
        (".json", "{broken", "{broken"),
        (".txt", " as it is ", " as it is "),
        (".json", None, None),
    ]
    df = spark.createDataFrame([(s, t) for s, t, _ in rows], "s string, t string")
    assert [r.c for r in df.select(documents.cleaned(F.col("t"), F.col("s")).alias("c")).collect()] == [w for _, _, w in rows]
    got = spark.createDataFrame([(".json", deep)], "s string, t string").select(documents.cleaned(F.col("t"), F.col("s")).alias("c")).first().c
    assert got in ("deep", deep)
