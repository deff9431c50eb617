"""Near duplicates among texts that have a key in common, against all pairs."""

import random

import numpy as np
import pytest

from quarry.llm import simhash
from quarry.llm.components import connected_components

WIDTH, RADIUS = 8, 60


def brute(prints, radius):
    apart = np.array([np.bitwise_count(prints ^ p).sum(axis=1) for p in prints])
    label = np.arange(len(prints))
    for _ in prints:
        label = np.array([label[row <= radius].min() for row in apart])
    return label.tolist()


@pytest.mark.parametrize(("few", "key_rows"), [(64, 1 << 16), (3, 1 << 16), (3, 40)])
def test_links_of_a_key_equal_all_pairs(spark, monkeypatch, few, key_rows):
    """Chains, a large group of near copies, and unrelated rows, all under one key, and under keys of their own."""
    rng = np.random.default_rng(3)
    rows = [rng.integers(0, 2**64, WIDTH, dtype=np.uint64) for _ in range(60)]
    flip = lambda row, n: row ^ np.bitwise_or.reduce([np.eye(WIDTH, dtype=np.uint64)[b // 64] << np.uint64(b % 64) for b in rng.choice(64 * WIDTH, n, False)])
    rows += [flip(rows[0], int(n)) for n in rng.integers(1, 90, 120)]
    for _ in range(12):
        rows.append(flip(rows[-1], 50))
    prints = np.unique(np.stack(rows), axis=0)
    keys = [[1, 2 + i % 3, 100 + i] for i in range(len(prints))]
    classes = spark.createDataFrame([(1000 + i, bytes(p.astype(">u8").tobytes()), k) for i, (p, k) in enumerate(zip(prints, keys))], "id long, fp binary, keys array<long>")
    monkeypatch.setattr(simhash, "FEW", few)
    roots = connected_components(simhash.keyed_links(classes.repartition(3), RADIUS, WIDTH, key_rows))
    got = {r.node: r.root for r in roots.collect()}
    want = brute(prints, RADIUS)
    assert [got.get(1000 + i, 1000 + i) for i in range(len(prints))] == [1000 + i for i in want]
    assert len(set(want)) < len(want) - 50


def test_unrelated_texts_are_not_compared(spark, monkeypatch):
    rng = random.Random(4)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(5000)], k=60)) for _ in range(1500)]
    texts += [" ".join(t.split()[:-2] + ["a", "b"]) for t in texts[:100]] + [texts[3]] * 20 + [None, "", "one", "one two", "one two"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    written = {}
    keep = simhash.materialize
    monkeypatch.setattr(simhash, "materialize", lambda df, label: written.setdefault(label, keep(df, label)))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs, 5, 32, 347, keys=24).collect()}
    prints = np.array([[int(got[i][0][16 * w : 16 * w + 16], 16) for w in range(32)] for i in range(len(texts))], np.uint64)
    assert [got[i][1] for i in range(len(texts))] == brute(prints, 347)
    assert written["simhash-keys"].count() <= 24 * 210 and "simhash-tiles" not in written


def test_keys_agree_as_often_as_texts_are_alike():
    rng = np.random.default_rng(6)
    common, one, other = (rng.integers(0, 2**64, n, dtype=np.uint64) for n in (300, 100, 100))
    a, b = np.r_[common, one], np.r_[other, common]
    first = simhash.first_shingles(np.r_[a, b], np.array([400, 400]), 400)
    assert 0.5 < (first[0] == first[1]).mean() < 0.7  # 300 of 500
    often = np.repeat(common[:1], 40)  # bits follow a hash that outweighs the others
    first = simhash.first_shingles(np.r_[often, one, often, other], np.array([140, 140]), 400)
    assert 0.8 < (first[0] == first[1]).mean() < 0.97  # 1600 of 1800
