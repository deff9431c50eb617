"""Windows of transcripts, and chapters of answers that may be anything."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import documents, sequence


def test_windows_hold_every_character_and_keep_to_their_budget(spark):
    rows = [(1, 0, 0.0, 1.0, " short "), (1, 1, 1.0, 2.0, "x" * 130), (1, 2, 2.0, 3.5, None), (1, 3, 3.5, 4.0, "end"), (2, 0, 0.0, 9.0, "")]
    df = spark.createDataFrame(rows, "file_id long, chunk long, start double, end double, text string")
    got = {(r.file_id, r.window): r.text for r in sequence.chapter_windows(df, 60).collect()}
    assert all(len(t) <= 60 for t in got.values()) and got[2, 0] == "[0.000-9.000] "
    lines = "\n".join(got[1, w] for w in range(len(got) - 1)).split("\n")
    assert lines[0] == "[0.000-1.000] short" and lines[-1] == "[3.500-4.000] end" and "[2.000-3.500] " in lines
    assert "".join(x[14:] for x in lines if x.startswith("[1.000-2.000] ")) == "x" * 130
    assert sequence.chapter_windows(df.where("false"), 60).count() == 0


@pytest.mark.parametrize(
    "answer, want",
    [
        ('{"chapters": [{"start_time": 1, "end_time": "2.5", "title": " A "}]}', [(1.0, 2.5, "A")]),
        ('[{"start_time": "1e2", "title": "B", "end_time": null}, {"start_time": 3, "title": "  "}]', [(100.0, None, "B")]),
        ('[{"start_time": "NaN", "title": "C"}, {"start_time": "x", "title": "D"}, {"start_time": 5, "end_time": "inf", "title": "E"}]', [(5.0, None, "E")]),
        ("no json", []),
        ('{"other": 1}', []),
        (None, []),
    ],
)
def test_chapters_of_an_answer(spark, answer, want):
    got = spark.createDataFrame([(answer,)], "a string").select(sequence.chapters(F.col("a")).alias("c")).first().c
    assert [(x.start, x.end, x.title) for x in got] == want


@pytest.mark.parametrize(
    "markdown, heading, below, content, want",
    [
        ("# t\n## a\nx\n## b\ny\n", "a", None, "## c\nz", "# t\n## c\nz\n\n## b\ny"),
        ("## a\n### p\nx\n### q\ny\n## b", "a", "p", "### r\n", "## a\n### r\n\n### q\ny\n## b"),
        ("## a\n### p\nx\n## b\n### q", "a", "q", "n", None),
        ("## a\nx", "b", None, "n", None),
        ("## a\nx", "a", None, "", ""),
        ("## a\r\nx\r\n## b", "a", None, "n\n", "n\n\n## b"),
        ("", "a", None, "n", None),
        (None, "a", None, "n", None),
    ],
)
def test_splicing_a_section(spark, markdown, heading, below, content, want):
    df = spark.createDataFrame([(markdown, heading, below, content)], "m string, h string, b string, c string")
    assert documents.spliced(df, "m", F.col("h"), F.col("b"), F.col("c")).first().m == want
