"""Similar groups by a few numbers of each query."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import keyword, vector


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


@pytest.fixture(scope="module")
def sides(spark):
    rng = np.random.default_rng(5)
    v = unit(rng.standard_normal((900, 6)))
    v[600:660] = v[600]  # copies, in groups of their own
    rows = [(i, i // 6 if i < 400 else i // 3 + 1000, "xyz"[i % 3], v[i].tolist()) for i in range(900)]
    flat = [(2000 + i, 5000 + i, "w", unit(np.array([1.0, 0.001 * i, 0.0, 0.0, 0.0, 0.7])).tolist()) for i in range(8)]
    kinds = {g: k for _, g, k, _ in rows}
    queries = [(g, kinds[g], unit(np.mean([r[3] for r in rows if r[1] == g], axis=0)).tolist()) for g in sorted(kinds)[::7]] + [(7000, "w", unit(np.array([1.0, 0, 0, 0, 0, 0])).tolist())]
    return spark.createDataFrame(queries, "query_id long, type string, vector array<double>"), spark.createDataFrame(rows + flat, "id long, file long, type string, vector array<double>")


@pytest.mark.parametrize(("same", "tile", "at_once", "limits"), [("type", 4096, 8192, (0.05, 0.3)), ("type", 2, 10, (0.05, 0.3)), (None, 5, 20, (0.3, 0.2)), ("type", 3, 7, (0.5, 0.6))])
def test_similar_equals_filters_over_all_pairs(sides, monkeypatch, same, tile, at_once, limits):
    queries, rows = sides
    floor, margin = limits
    pairs = vector.neighbours(queries, rows, floor=floor, same=same, group="file")
    want = vector.best(vector.similar_filters(pairs.where("id <> query_id"), floor=floor, margin=margin), "query_id", [F.desc(F.round("score", 9)), F.asc("id")], 4)
    want = sorted((r.query_id, r.id, round(r.score, 9)) for r in want.collect())
    monkeypatch.setattr(vector, "ROW_TILE", tile)
    got = vector.similar(queries, rows, "file", 4, floor=floor, margin=margin, same=same, queries_at_once=at_once)
    assert sorted((r.query_id, r.id, round(r.score, 9)) for r in got.collect()) == want
    assert want and (same is None or 7000 not in {q for q, _, _ in want})


def test_few_rows_of_a_query_are_shuffled(spark, monkeypatch):
    """All 3,000 groups come near, of which a tile gives three."""
    rng = np.random.default_rng(2)
    v = unit(np.array([1.0, 0, 0, 0]) + 0.2 * rng.standard_normal((3000, 4)))
    rows = spark.createDataFrame([(i, i, x.tolist()) for i, x in enumerate(v)], "id long, file long, vector array<double>")
    written = []
    keep = vector.kept
    monkeypatch.setattr(vector, "kept", lambda df, label: written.append(keep(df, label)) or written[-1])
    found = vector.similar(rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector"), rows, "file", 3, floor=0.0, margin=2.0, gap=0.0)
    assert found.count() == 60 * 3
    assert max(df.count() for df in written) <= 60 * 64 * 5


def test_heaviest_terms_of_some_documents(spark):
    docs = spark.createDataFrame([(i, "xy"[i % 2], [f"w{(i * k) % 11}" for k in range(1, 9)]) for i in range(40)], "id long, drive string, words array<string>")
    counted = keyword.bags(docs, ["id", "drive"])
    rows = lambda df: sorted(tuple(r) for r in df.select("id", "drive", "term", F.round("weight", 9), "rank").collect())
    some = docs.where("id % 5 = 0").select("id")
    assert rows(keyword.heaviest(counted, "drive", 3, ids=some)) == [r for r in rows(keyword.heaviest(counted, "drive", 3)) if r[0] % 5 == 0]
