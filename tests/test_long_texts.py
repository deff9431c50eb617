import random
import time

from pyspark.sql import functions as F

from quarry.operators import documents, snippets


def _seconds(df) -> float:
    begin = time.time()
    df.collect()
    return time.time() - begin


def test_a_section_of_a_long_text_is_spliced_in_time_that_grows_with_its_lines(spark):
    text = "\n".join(f"## s{i}\nline\n### t{i}\nline" for i in range(4000))
    df = spark.createDataFrame([(text,)], "m string")
    one = documents.spliced(df, "m", F.lit("s3999"), F.lit("t3999"), F.lit("new")).where("m is not null").select(F.md5("m"))
    assert _seconds(df.select(F.md5("m"))) < 20 and _seconds(one) < 20
    got = documents.spliced(df, "m", F.lit("s3999"), F.lit("t3999"), F.lit("new")).first().m
    assert got == text.replace("### t3999\nline", "new")


def test_a_long_quote_is_scored_in_time_that_grows_with_its_length(spark):
    quote, text = "ab" * 4000 + "xyz", "ba" * 4000 + "é" * 4000 + "xyz"
    df = spark.createDataFrame([(quote, text), ("xyzw", text), ("xy", text), (None, text)], "q string, t string")
    scored = df.select(snippets.quote_score(F.col("q"), F.col("t")).alias("s"))
    assert _seconds(scored.limit(1)) < 20
    assert [r.s for r in scored.collect()] == [64005, 3003, 2, None]


def test_random_quotes_are_scored_as_by_definition(spark):
    rng = random.Random(5)
    rows = [("".join(rng.choices("ab\U0001f600", k=rng.randrange(90))), "".join(rng.choices("abc\U0001f600", k=rng.randrange(90)))) for _ in range(60)]
    got = [r[0] for r in spark.createDataFrame(rows, "q string, t string").select(snippets.quote_score(F.col("q"), F.col("t"), 7)).collect()]
    assert got == [1000 * max([n for n in range(3, 8) for i in range(len(q) - n + 1) if q[i : i + n] in t], default=0) + len(set(q) & set(t)) for q, t in rows]


def test_a_long_text_is_cut_in_time_that_grows_with_its_length(spark):
    text = ("é" * 390 + "\n") * 4000
    df = spark.createDataFrame([(text,), (None,), ("",)], "t string")
    cut = df.select(snippets.line_chunks(F.col("t"), 400).alias("c"))
    assert _seconds(cut.select(F.size("c"))) < 10
    assert [list(r.c) for r in cut.collect()] == [["é" * 390 + "\n"] * 4000, [], []]
