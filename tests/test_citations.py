"""Compound segments, keyword ranks inside a file, sections as ranges of chunks."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import citations


@pytest.mark.parametrize(
    "text, kind, parts",
    [
        ("洗って芯を切り落とし、葉と芯を分けて千切りにする", "bullet", ["洗って芯を切り落とし", "葉と芯を分けて千切りにする"]),
        ("「明るさ」「清潔感」「わかりやすさ」", "bullet", ["明るさ", "清潔感", "わかりやすさ"]),
        ("「一つ」だけ、二つ目の部分", "bullet", ["「一つ」だけ", "二つ目の部分"]),
        ("「あ」「い」、これはひらがな", "bullet", ["「あ」「い」、これはひらがな"]),
        ("short, ab; longer part", "bullet", ["short", "longer part"]),
        ("one part only", "bullet", ["one part only"]),
        (" first part, second part ", "paragraph", ["first part, second part"]),
        ("first part, second part", None, ["first part, second part"]),
        ("", "bullet", [""]),
    ],
)
def test_compound_parts(spark, text, kind, parts):
    df = spark.createDataFrame([(text, kind)], "text string, kind string")
    assert df.select(citations.compound_parts(F.col("text"), F.col("kind")).alias("p")).first().p == parts


def test_union_takes_each_chunk_by_its_best_part(spark):
    rows = [(1, 0, 0, 5, 0.4), (1, 0, 1, 5, 0.9), (1, 0, 0, 6, 0.5), (1, 0, 1, 7, 0.5), (1, 1, 0, 5, 0.1)]
    got = citations.union_of_parts(spark.createDataFrame(rows, "file_id long, segment long, part long, chunk long, score double"), 2)
    assert sorted(map(tuple, got.collect())) == [(1, 0, 5, 0.9), (1, 0, 6, 0.5), (1, 1, 5, 0.1)]


def test_ranks_stay_in_the_file_and_transcripts_come_first(spark):
    rows = [("document", 1, 0, ["Kyoto Kyoto temple"]), ("transcript", 1, 3, ["a word about Kyoto"]), ("transcript", 1, 4, ["nothing here"]), ("transcript", 2, 0, ["Kyoto elsewhere"]), ("document", 1, 9, ["temple bells"])]
    df = spark.createDataFrame(rows, "channel string, id long, chunk long, fields array<string>")
    segments = spark.createDataFrame([(1, 0, "the Kyoto temple"), (1, 1, "い"), (2, 0, None)], "file_id long, segment long, text string")
    got = [(r.segment, r.kind, r.chunk, r["rank"]) for r in citations.in_file_ranks(df, segments).orderBy("segment", "rank").collect()]
    assert got == [(0, "transcript", 3, 1), (0, "document", 0, 2), (0, "document", 9, 3)]
    ranges = spark.createDataFrame([(1, 0, 1, 5)], "file_id long, segment long, first long, last long")
    assert [(r.kind, r.chunk) for r in citations.in_file_ranks(df, segments, ranges).collect()] == [("transcript", 3)]


def test_sections_follow_each_other_along_the_file(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    segments = [(1, 0, ["A"], a), (1, 1, ["B", "x"], b), (1, 2, ["B", "x"], None), (1, 3, ["C"], None), (1, 4, [], a), (2, 0, ["A"], a)]
    chunks = [(1, c, a if c < 6 else b) for c in range(12)]
    got = citations.prefix_ranges(spark.createDataFrame(segments, "file_id long, segment long, path array<string>, vector array<double>"), spark.createDataFrame(chunks, "file_id long, chunk long, vector array<double>"))
    found = {(r.file_id, *r.prefix): (r["first"], r["last"]) for r in got.collect()}
    assert found == {(1, "A"): (0, 7), (1, "B"): (4, 13), (1, "B", "x"): (6, 11), (1, "C"): (None, None), (2, "A"): (None, None)}
