"""Packing of timed words into cues, their lines and their WebVTT."""

import pytest

from quarry.operators import subtitles as S

WORDS = "file_id long, idx long, word string, start double, end double, language string"


def cues(spark, texts, language="en", length=0.4, gaps=()):
    at, rows = 0.0, []
    for i, t in enumerate(texts):
        rows.append((1, i, t, round(at, 3), round(at + length, 3), language))
        at += length + dict(gaps).get(i, 0.0)
    return [(round(r.start, 3), round(r.end, 3), r.text) for r in S.packed_cues(spark.createDataFrame(rows, WORDS)).orderBy("cue").collect()]


def test_sentences_and_pauses_end_cues(spark):
    assert cues(spark, ["Hello", "there.", "How", "are", "you?"]) == [(0.0, 0.8, "Hello there."), (0.8, 2.0, "How are you?")]
    assert [c[2] for c in cues(spark, ["one", "two", "three"], gaps=[(1, 0.65)])] == ["one two", "three"]
    assert [c[2] for c in cues(spark, ["one", "two", "three"], gaps=[(1, 0.5)])] == ["one two three"]
    assert [c[2] for c in cues(spark, ["Hi.", "Well", "then."])] == ["Hi. Well then."]  # the first is shorter than a cue may be


def test_a_point_between_digits_ends_nothing(spark):
    assert [c[2].replace("\n", " ") for c in cues(spark, ["It", "is", "3.", "5", "km"])] == ["It is 3. 5 km"]


def test_wide_cues_go_back_to_the_last_mark_past_their_half(spark):
    texts = ["a" * 9, "b" * 9, "c" * 6 + ",", "d" * 9, "e" * 9, "f" * 9]
    got = [c[2].replace("\n", " ") for c in cues(spark, texts, length=0.2)]
    assert got == [" ".join(texts[:3]), " ".join(texts[3:])]
    early = ["aaaa,", "b" * 20, "c" * 20, "d" * 3]  # the mark comes before the half: any place will do
    assert [c[2].replace("\n", " ") for c in cues(spark, early, length=0.2)] == ["aaaa, " + "b" * 20, "c" * 20 + " ddd"]


def test_cues_never_last_over_their_longest_and_end_before_the_next(spark):
    got = cues(spark, [f"w{i}" for i in range(30)], length=0.7)
    assert all(e - s <= 5.0 + 0.7 for s, e, _ in got) and all(a[1] <= b[0] for a, b in zip(got, got[1:]))
    rows = [(1, 0, "first.", 0.0, 3.0, "en"), (1, 1, "second.", 2.0, 4.0, "en"), (1, 2, " ", 4.0, 4.1, "en"), (2, 0, None, 0.0, 1.0, None)]
    found = S.packed_cues(spark.createDataFrame(rows, WORDS)).collect()
    assert [(r.file_id, r.start, r.end) for r in found] == [(1, 0.0, 2.0), (1, 2.0, 4.0)]


def test_katakana_and_small_kana_stay_together(spark):
    texts = ["これは"] * 6 + ["ド", "ラクエ", "ー", "です"]
    got = [c[2].replace("\n", "") for c in cues(spark, texts, "ja", length=0.2)]
    assert "".join(got) == "".join(texts) and not any(c[0] in S.NOT_FIRST for c in got) and not any(c.endswith("ド") for c in got)


@pytest.mark.parametrize(
    "text, lines",
    [
        ("short enough", "short enough"),
        ("one two three four five", "one two\nthree four five"),
        ("distance is 3. 5 km and more", "distance is\n3. 5 km and more"),
        ("今日はとても良い天気、明日も晴れ", "今日はとても良い天気、\n明日も晴れ"),
        ("あいうえおかきくけこっさしす", "あいうえおかき\nくけこっさしす"),
        ("x" * 30, "x" * 15 + "\n" + "x" * 15),
        ("価格は全部で1234567円です", "価格は全部で\n1234567円です"),
    ],
)
def test_two_lines(text, lines):
    assert S.two_lines(text) == lines


def test_webvtt(spark):
    rows = [(1, 0, 0.5, 2.0, "a --> b\n\nc"), (1, 1, 2.0, 3.0, " \n"), (1, 2, 3661.25, 3662.0, "d")]
    found = S.webvtt(spark.createDataFrame(rows, "file_id long, cue long, start double, end double, text string")).first().vtt
    assert found == "WEBVTT\n\n1\n00:00:00.500 --> 00:00:02.000\na → b\nc\n\n2\n01:01:01.250 --> 01:01:02.000\nd\n"
