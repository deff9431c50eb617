"""Scoring texts by context-tree weighting over bytes.

A byte is eight binary decisions, each made at a node named by the bits already
decided and by a context of up to ``depth`` bytes before it. Every node has a
Krichevsky-Trofimov estimate of its bit, and a context's estimates at all depths
are mixed by the weights that the training text itself gives them: half a node's
probability of what it saw is its own estimate, half the product of its
children's. A byte's probability depends on it and its context alone, so that
Spark counts the distinct (context, byte) strings of the corpus, works their
probabilities out once, and tasks look them up.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grams
from .common import by_batch, materialize, pa_schema

LOG_HALF = math.log(0.5)
#: Depth from which contexts that share their two nearest bytes are worked out together.
NEAR = 2


def _log_gamma_table(most: int = 1 << 14) -> np.ndarray:
    return np.array([0.0, *map(math.lgamma, (np.arange(1, 2 * most) / 2).tolist())])


LOG_GAMMA = _log_gamma_table()


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Natural log of the gamma function of halves and whole numbers above 0: a table, and Stirling's series beyond it."""
    twice = (2 * x).astype(np.int64)
    out = LOG_GAMMA[np.minimum(twice, len(LOG_GAMMA) - 1)]
    far = np.flatnonzero(twice >= len(LOG_GAMMA))
    if len(far):
        y = x[far]
        out[far] = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3)
    return out


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - math.log(math.pi) - log_gamma(zeros + ones + 1)


def node_tables(code: np.ndarray, n: np.ndarray, depth: int, to: int) -> tuple[np.ndarray, tuple]:
    """Predictions mixed over the depths ``to`` to ``depth``, and the nodes at ``to``.

    ``code`` has distinct strings of ``depth`` context bytes and the byte
    predicted, all of those in the corpus whose contexts agree in the ``to``
    nearest bytes; ``n`` counts them in the training text. The predictions are
    (8, strings): the probability of each bit. Nodes are (key, zeros, ones, log
    weighted probability), a key being the context and the bits decided.

    At each depth the strings are sorted once, and the nodes of each bit are
    runs of them.
    """
    count = len(code)
    bit = ((code[None, :] >> (np.uint64(7) - np.arange(8, dtype=np.uint64)[:, None])) & np.uint64(1)).astype(bool)
    predicted = np.empty((8, count))
    strings, sums = code, n.astype(np.float64)
    place = np.arange(count)
    above: list[tuple[np.ndarray, np.ndarray]] = []  # for each bit: the first string of each node one depth below, and its weighted probability
    for d in range(depth, to - 1, -1):
        short, at = np.unique(strings & np.uint64((1 << 8 * (d + 1)) - 1), return_inverse=True)
        sums, place = np.bincount(at, weights=sums, minlength=len(short)), at[place]
        keys, nodes, new = [], [], []
        for k in range(8):
            node = short >> np.uint64(8 - k)
            first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]) if len(node) else np.zeros(0, np.int64)
            number = np.cumsum(np.r_[False, node[1:] != node[:-1]]) if len(node) else np.zeros(0, np.int64)
            one = (short >> np.uint64(7 - k)) & np.uint64(1) == 1
            whole = np.bincount(number, weights=sums, minlength=len(first))
            ones = np.bincount(number[one], weights=sums[one], minlength=len(first))
            zeros = whole - ones
            own = log_kt(zeros, ones)
            of = number[place]
            estimate = (np.where(bit[k], ones[of], zeros[of]) + 0.5) / (whole[of] + 1)
            if d == depth:
                weighted, predicted[k] = own, estimate
            else:
                child, child_weighted = above[k]
                product = np.bincount(number[at[child]], weights=child_weighted, minlength=len(first))
                weighted = np.logaddexp(LOG_HALF + own, LOG_HALF + product)
                share = np.exp(LOG_HALF + own - weighted)[of]
                predicted[k] = share * estimate + (1 - share) * predicted[k]
            new.append((first, weighted))
            if d == to:
                context, prefix = node[first] >> np.uint64(k), node[first] & np.uint64((1 << k) - 1)
                keys.append((context << np.uint64(8)) | np.uint64(1 << k) | prefix)
                nodes.append((zeros, ones, weighted))
        strings, above = short, new
    return predicted, (np.concatenate(keys), *(np.concatenate(x) for x in zip(*nodes)))


def top_levels(nodes: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """Own estimates of a one and shares at depth 1, by nearest byte and prefix, and at depth 0, by prefix.

    ``nodes`` (key, zeros, ones, product) has the depth-1 nodes, with the
    product of their children's weighted probabilities as a log.
    """
    out = []
    key, zeros, ones, product = (nodes[c].to_numpy() for c in ("key", "zeros", "ones", "product"))
    for size in (65536, 256):
        key = key % size
        a, b, w = (np.bincount(key, weights=x, minlength=size) for x in (zeros, ones, product))
        own = log_kt(a, b)
        weighted = np.logaddexp(LOG_HALF + own, LOG_HALF + w)
        out += [(b + 0.5) / (a + b + 1), np.exp(LOG_HALF + own - weighted)]
        key, zeros, ones, product = np.arange(size), a, b, weighted
    return tuple(out)


def byte_model(sums: DataFrame, depth: int) -> DataFrame:
    """(code, value, n): log10 probability of the last byte of each string of ``sums`` (shard, keys, sums).

    ``sums`` is as :func:`grams.packed_counts` gives it; its flag is set for
    strings that are not learnt from. Contexts that share their two nearest
    bytes are in one shard, and are added up and worked out together. Nodes of
    depth 1, at most 65,536 of them, are mixed on the driver.
    """
    spark = sums.sparkSession
    packed = "code binary, n binary, bits binary"
    packed_schema, node_schema = pa_schema(packed, spark), "code long, value double, n long"
    target = pa_schema(node_schema, spark)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_shard: dict[int, list[tuple[bytes, bytes]]] = {}
        for batch in batches:
            for own, keys, n in zip(*(batch.column(c).to_pylist() for c in ("shard", "keys", "sums"))):
                by_shard.setdefault(own, []).append((keys, n))
        for own in list(by_shard):
            packed_keys, packed_sums = zip(*by_shard.pop(own))
            n = np.concatenate([np.diff(grams.unpack(x).view(np.int64), prepend=0) for x in packed_sums])
            key, n = grams.added_up(np.concatenate([grams.unpack(x) for x in packed_keys]), n)
            code, total = grams.added_up(key >> np.uint64(1), n)
            learnt = np.bincount(np.searchsorted(code, key >> np.uint64(1)), weights=np.where(key & np.uint64(1), 0, n), minlength=len(code))
            predicted, (keys, zeros, ones, weighted) = node_tables(code, learnt, depth, NEAR)
            first, at = np.unique(keys & np.uint64(0xFFFF), return_inverse=True)
            nodes = np.stack([first.astype(np.float64), *[np.bincount(at, weights=x) for x in (zeros, ones, weighted)]])
            step = 1 << 16
            arrays = [[x[..., i : i + step].tobytes() for i in range(0, len(code), step)] for x in (code, total, predicted)]
            yield pa.RecordBatch.from_arrays([pa.array([*x, y], pa.binary()) for x, y in zip(arrays, (b"", b"", nodes.tobytes()))], schema=packed_schema)

    rows = materialize(sums.repartition("shard").mapInArrow(near, packed), "ctw-near")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [np.frombuffer(x, np.float64).reshape(4, -1) for b in batches for x in b.column("bits").to_pylist()]
        if own:
            key, *values = np.concatenate(own, axis=1)
            first, at = np.unique(key, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(first.astype(np.int64)), *[pa.array(np.bincount(at, weights=x)) for x in values]], schema=node_target)

    nodes_ddl = "key long, zeros double, ones double, product double"
    node_target = pa_schema(nodes_ddl, spark)
    nodes = rows.where("octet_length(code) = 0").mapInArrow(summed, nodes_ddl)
    nodes = nodes.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "product")]).toArrow().to_pandas()
    shared = spark.sparkContext.broadcast(top_levels(nodes))

    def mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one1, share1, one0, share0 = shared.value
        for batch in batches:
            for codes, numbers, predicted in zip(*(batch.column(c).to_pylist() for c in ("code", "n", "bits"))):
                code, bits = np.frombuffer(codes, np.int64), np.frombuffer(predicted, np.float64).reshape(8, -1)
                value = np.zeros(len(code))
                for k in range(8):
                    prefix = (1 << k) | ((code & 255) >> (8 - k))
                    bit = (code >> (7 - k)) & 1
                    at = ((code >> 8 & 255) << 8) | prefix
                    own1 = np.where(bit == 1, one1[at], 1 - one1[at])
                    own0 = np.where(bit == 1, one0[prefix], 1 - one0[prefix])
                    p = share1[at] * own1 + (1 - share1[at]) * bits[k]
                    value += np.log10(share0[prefix] * own0 + (1 - share0[prefix]) * p)
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(value), pa.array(np.frombuffer(numbers, np.int64))], schema=target)

    return rows.where("octet_length(code) > 0").mapInArrow(mixed, node_schema)


def tokens(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased, and one end, which is the empty word."""
    return [*(text or "").encode().lower().split(), b""]


def count_tokens(texts: DataFrame, most: int = 300_000) -> DataFrame:
    """(word, n) over all rows; a task adds up ``most`` different words at a time."""
    schema = "word binary, n long"
    target = pa_schema(schema, texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], schema=target)
        for column in (b.slice(at, 1000).column(0) for b in batches for at in range(0, b.num_rows, 1000)):
            for text in column.to_pylist():
                found.update(tokens(text))
                if len(found) > most:
                    yield out()
                    found.clear()
        if found:
            yield out()

    return texts.select(F.col("text").cast("string")).mapInArrow(run, schema).groupBy("word").agg(F.sum("n").alias("n"))


def score_texts(docs: DataFrame, depth: int = 5, folds: int = 10, most_words: int = 1 << 17, most_strings: int = 1 << 21) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte) for every row of ``docs``.

    Learns from the rows whose crc32(doc_id as text) mod ``folds`` is not 0; a
    null doc_id is neither learnt from nor held out. Null texts count as empty:
    their only token is the end. ``base_score`` is the smoothed unigram model
    over tokens; ``score`` is the context-tree model's log10 probability of the
    text's bytes, A-Z lower-cased, and an end sign, and ``bits_per_byte`` the code
    length that this comes to for each of them. ``depth`` is 6 at most, as a
    string is a number of 56 bits. The commonest words and
    strings, ``most_words`` and ``most_strings`` at most, are broadcast; the
    others are joined, so that whatever the corpus holds is counted in full.
    Repeated rows come back as often as they came; no rows give no rows.
    """
    spark = docs.sparkSession
    checksum = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))
    base = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("held_out", F.coalesce(checksum == 0, F.lit(False)))
    base = base.withColumn("flag", F.col("held_out") | F.col("doc_id").isNull())
    encode = lambda t: (t or "").encode().lower()

    strings = materialize(byte_model(grams.packed_counts(base, depth + 1, encode), depth), "ctw-model")
    hot_strings, cold_strings = grams.split_by_count(strings, most_strings)

    words = materialize(count_tokens(base.where("not flag")), "ctw-words")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    scale = total + 0.1 * (distinct + 1)
    unseen = math.log10(0.1 / scale)
    words = words.withColumn("value", F.log10((F.col("n") + 0.1) / scale))
    hot_words, cold_words = common_words(words, most_words)
    shared = spark.sparkContext.broadcast((hot_strings, hot_words))
    joined = cold_words is not None
    models: list[grams.HashArray] = []  # one for each task

    def run(batch: dict) -> Iterator[dict]:
        arrays, known = shared.value
        if not models:
            models.append(grams.HashArray(*arrays))
        model = models[0]
        for at in range(0, len(batch["text"]), 500):
            texts = batch["text"][at : at + 500]
            sums, number, cold = grams.look_up([encode(t) for t in texts], depth + 1, model)
            out: dict = {c: batch[c][at : at + 500] for c in ("doc_id", "held_out")}
            out |= {"n_tokens": [], "n_known": [], "base_score": [], "rare": []}
            for text in texts:
                own = tokens(text)
                found = [known.get(w) for w in own]
                rare = [w for w, v in zip(own, found) if v is None]
                out["n_tokens"].append(len(own))
                out["n_known"].append(len(own) - len(rare))
                out["base_score"].append(sum(v for v in found if v is not None) + (0 if joined else unseen * len(rare)))
                out["rare"].append(rare if joined else [])
            yield out | {"score": sums, "n_bytes": number - 1, "cold": cold}

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, rare array<binary>, score double, n_bytes long, cold array<long>"
    scored = materialize(by_batch(base.drop("flag"), run, schema).withColumn("_row", F.monotonically_increasing_id()), "ctw-scores")
    scored = grams.add_cold(scored, cold_strings, "score", "cold")
    if joined:
        rare = scored.select("_row", F.explode("rare").alias("word")).join(cold_words, "word", "left")
        rare = rare.groupBy("_row").agg(F.sum(F.coalesce("value", F.lit(unseen))).alias("_more"), F.count("value").alias("_known"))
        scored = scored.drop("rare").join(rare, "_row", "left")
        scored = scored.withColumn("base_score", F.col("base_score") + F.coalesce("_more", F.lit(0.0)))
        scored = scored.withColumn("n_known", F.col("n_known") + F.coalesce("_known", F.lit(0)))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score", "n_bytes", (-F.col("score") * math.log2(10) / (F.col("n_bytes") + 1)).alias("bits_per_byte"))


def common_words(words: DataFrame, most: int) -> tuple[dict[bytes, float], DataFrame | None]:
    """Up to ``most`` of the commonest of (word, n, value) as a dict, and the others."""
    words = words.withColumn("_bin", F.floor(F.log2(F.col("n") + 1) * 8))
    rows, least = 0, None
    for r in words.groupBy("_bin").count().orderBy(F.desc("_bin")).collect():
        rows += r["count"]
        if rows > most:
            break
        least = r["_bin"]
    hot = words.where(F.col("_bin") >= least if least is not None else F.lit(False)).select("word", "value").toArrow()
    known = dict(zip(hot["word"].to_pylist(), hot["value"].to_pylist()))
    if rows <= most:
        return known, None
    return known, words.where(F.col("_bin") < least if least is not None else F.lit(True)).select("word", "value")
