"""The trigram index, and searches over several channels, on small rows."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import keyword, trigram
from quarry.plans import search

ROWS = "channel string, id long, chunk long, fields array<string>"


def counted(rows, phrases):
    out = {}
    for channel, i, chunk, fields in rows:
        for p in {p.lower() for p in phrases if len(p) >= 3}:
            f = sum(t.lower()[k : k + len(p)] == p for t in fields or [] if t for k in range(len(t)))
            if f:
                out[p, channel, i, chunk] = f
    return out


def test_phrases_are_found_by_their_trigrams(spark):
    rng = random.Random(1)
    rows = [(rng.choice("xy"), i, i % 3, ["".join(rng.choice("ab ") for _ in range(rng.randint(0, 80))), rng.choice([None, "aaaaaa", "é𝒳ab"])]) for i in range(200)]
    rows += [("x", 900, 0, None), ("x", 901, 0, []), ("x", 902, 0, ["ABAB" * 500])]
    phrases = ["aaa", "abab", "ABABAB", "a b a", "é𝒳a", "ab", "", "zzz", "abazzz"] + ["".join(rng.choice("ab ") for _ in range(n)) for n in range(3, 14)]
    found = trigram.index(spark.createDataFrame(rows, ROWS).repartition(5))
    got = {(r.phrase, r.channel, r.id, r.chunk): r.f for r in trigram.phrase_hits(found, spark.createDataFrame([(p,) for p in phrases], "phrase string")).collect()}
    assert got == counted(rows, phrases) and ("aaa", "x", 902, 0) not in got


def test_phrases_joined_with_the_index(spark, monkeypatch):
    rows = [("x", i, 0, [f"word{i} and more"]) for i in range(30)]
    phrases = spark.createDataFrame([(f"word{i}",) for i in range(0, 30, 7)], "phrase string")
    monkeypatch.setattr(trigram, "FEW", 1)
    got = {(r.phrase, r.id) for r in trigram.phrase_hits(trigram.index(spark.createDataFrame(rows, ROWS)), phrases).collect()}
    assert got == {(f"word{i}", j) for i in range(0, 30, 7) for j in range(30) if str(j).startswith(str(i))}


def test_stored_index_answers_the_same(spark, tmp_path):
    rows = spark.createDataFrame([("x", i, 0, [f"common text {i % 7}"]) for i in range(100)], ROWS)
    phrases = spark.createDataFrame([("common",), ("text 3",)], "phrase string")
    trigram.dealt(trigram.index(rows)).write.parquet(str(tmp_path / "index"))
    of = lambda found: sorted(map(tuple, trigram.phrase_hits(found, phrases).collect()))
    assert of(spark.read.parquet(str(tmp_path / "index"))) == of(trigram.index(rows))


def test_kana_variants(spark):
    df = spark.createDataFrame([(1, ' みかん "tea" \n ミカ '), (2, ' "" ')], "query_id long, text string")
    got = {}
    for r in trigram.kana_variants(df).collect():
        got.setdefault((r.query_id, r.term), set()).add(r.phrase)
    assert got == {(1, 0): {"みかん", "ミカン"}, (1, 1): {"tea"}, (1, 2): {"ミカ", "みか"}}


def test_terms_are_met_by_any_of_their_phrases(spark):
    rows = spark.createDataFrame([("x", 1, 0, ["ミカンと tea"]), ("x", 2, 0, ["みかん"]), ("x", 3, 0, ["tea tea"]), ("y", 1, 0, ["みかん tea"])], ROWS)
    terms = spark.createDataFrame([(1, 0, "みかん"), (1, 0, "ミカン"), (1, 1, "tea"), (2, 0, "te")], "query_id long, term int, phrase string")
    found = trigram.index(rows)
    got = {(r.channel, r.query_id, r.id) for r in trigram.bm25(found, trigram.sizes(rows), terms).collect()}
    assert got == {("x", 1, 1), ("y", 1, 1)}
    assert {(r.query_id, r.id) for r in trigram.held(found, terms).collect()} == {(1, 1)}


@pytest.mark.parametrize("few", [1000, 0])
def test_few_and_many_phrases_are_found_alike(spark, monkeypatch, few):
    monkeypatch.setattr(keyword, "FEW", few)
    docs = spark.createDataFrame([(1, "a.md", "aaaa nation"), (2, "nation.md", None), (3, "b.md", "Nation \\E nation"), (4, "c.md", "")], "id long, name string, text string")
    queries = spark.createDataFrame([(1, "Nation"), (2, "aaa"), (3, "\\E n"), (3, "nation"), (4, "zz")], "query_id long, phrase string")
    got = {(r.query_id, r.id): round(r.score, 6) for r in keyword.bm25(docs, queries, ["name", "text"]).collect()}
    assert set(got) == {(1, 1), (1, 2), (1, 3), (2, 1), (3, 3)}
    terms = spark.createDataFrame([(1, "n", "NATION"), (1, "x", "a"), (2, "e", "b.")], "query_id long, term string, alias string")
    assert {(r.query_id, r.id) for r in keyword.required_terms(docs, terms, ["name", "text"]).collect()} == {(1, 1), (1, 2), (1, 3), (2, 3)}
    rows = docs.where("id < 4").select(F.lit("d").alias("source"), "id", F.lit(0).alias("position"), "text")
    exact = {(r.term, r.id): (r.matches, r.at) for r in keyword.find_exact(rows, spark.createDataFrame([("aa",), ("NATION",), ("\\e",)], "term string")).collect()}
    assert exact == {("aa", 1): (2, 1), ("NATION", 1): (1, 6), ("NATION", 3): (2, 1), ("\\e", 3): (1, 8)}
    assert keyword.bm25(docs, queries.where("false"), ["text"]).count() == 0


def test_files_with_a_picture_match_stay_and_required_ones_come_in(spark):
    rows = [("text", 1, 10, "metadata", 0.9), ("clip", 1, 11, "clip", 0.1), ("text", 1, 12, "whisper", 0.2), ("content", 1, 10, "text_content_keyword", 1.0)]
    matches = spark.createDataFrame(rows, "channel string, query_id long, id long, kind string, score double").withColumn("chunk", F.lit(0).cast("long"))
    got = {r.id: (round(r.score, 4), r.types) for r in search.fused_channels(matches).collect()}
    assert got == {10: (round(0.7 * 0.9 * 1.3 + 0.3, 4), ["metadata", "text_content_keyword"]), 11: (0.07, ["clip"])}
    required = spark.createDataFrame([(1, 10), (1, 77)], "query_id long, id long")
    got = {r.id: (round(r.score, 4), r.types) for r in search.fused_channels(matches, required=required).collect()}
    assert set(got) == {10, 77} and got[77] == (round(1.119 * 0.51, 4), ["required"])
    recall = {r.id: r.score for r in search.fused_channels(matches, recall=True).collect()}
    assert recall[10] == pytest.approx(1 / 61 + 1.5 / 61) and recall[12] == pytest.approx(1 / 62)
