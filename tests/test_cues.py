"""Cues without looking up what is known: plain letters, and other characters more than once."""

from types import SimpleNamespace

from quarry.operators import subtitles as S


def test_characters_are_looked_up_once_and_plain_ones_never(monkeypatch):
    seen = []
    known = S.unicodedata
    monkeypatch.setattr(S, "unicodedata", SimpleNamespace(combining=lambda c: seen.append(c) or known.combining(c), east_asian_width=known.east_asian_width))
    assert S.columns_of("plain words, 1.5") == 16 and S.two_lines("one two three four five") == "one two\nthree four five" and not seen
    assert S.columns_of("\u5b57\u5b57e\u0301\u5b57") == 7 and S.columns_of("\u5b57\u0301") == 2
    assert sorted(seen) == sorted(set(seen))


def test_words_without_times_and_files_without_words(spark):
    rows = [(1, 0, "one", 0.0, 0.5, "en"), (1, 1, "two", None, None, "en"), (2, 0, " ", 0.0, 1.0, None), (3, 1, "b", 1.0, 2.0, None), (3, 0, "a", 0.0, 1.0, None)]
    found = S.packed_cues(spark.createDataFrame(rows, "file_id long, idx long, word string, start double, end double, language string")).orderBy("file_id", "cue").collect()
    assert [(r.file_id, r.cue, r.start, r.end, r.text) for r in found] == [(1, 0, 0.0, None, "one two"), (3, 0, 0.0, 2.0, "a b")]
