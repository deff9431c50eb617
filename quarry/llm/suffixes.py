"""Removing long repeated byte strings by prefix doubling over named positions.

Prefix doubling gives each position the rank of the string of length h that
starts there, and gets ranks for longer ones from pairs of ranks at a distance;
positions of unique rank are let go. Here a rank is a 64-bit name that a task
works out for any position and length from running sums, and Spark sorts the
names of the corpus at each of ``LENGTHS``. It need not see all positions for
that: a string of ``threshold`` bytes is represented by the least name inside
it, which is the same wherever the string occurs, and neighbouring strings share
it (a block). A block whose name is unique is done with. Blocks that occur twice
as a whole are repeated in full. Only blocks that occur once, beside different
ones of the same name, go on to the next length, each different block once; at
the last length a block is one string, and what is still not unique is repeated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, by_batch, materialize
from .grams import mixed

#: Lengths at which names are sorted, short of the threshold itself.
LENGTHS = (100, 300, 380)
#: Most starts in one block; starts of a text that are named at once; bytes of texts that are named together.
BLOCK, SEGMENT, BUFFER = 1024, 1 << 16, 1 << 16
#: Low bits of a name that give way to its place when the least one is looked for: enough for a buffer.
PLACE = (1 << 18) - 1
#: Odd bases of the two running sums.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)

KEY = ["k1", "k2"]


class Powers:
    """Powers of the bases and of their inverses modulo 2^64, as far as asked for so far."""

    def __init__(self) -> None:
        self.size, self.tables = 0, []

    def upto(self, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        if n > self.size:
            self.size = max(n, 2 * self.size)
            row = lambda base: np.multiply.accumulate(np.r_[np.uint64(1), np.full(self.size, base, np.uint64)])
            self.tables = [(row(b), row(pow(b, -1, 1 << 64))) for b in BASES]
        return self.tables


class Named:
    """Two 64-bit names for every string of a buffer of eight bytes or more.

    Eight bytes at a time are hashed one-to-one; the running sums of the hashes
    times powers of a base give the name of any string as a difference.
    """

    def __init__(self, raw: np.ndarray, powers: Powers):
        eight = raw.astype(np.uint64)
        for have in (1, 2, 4):
            eight = (eight[:-have] << np.uint64(8 * have)) | eight[have:]
        self.sums, self.inverse, grams = [], [], mixed(eight + np.uint64(1))
        for up, down in powers.upto(len(raw)):
            self.sums.append(np.r_[np.uint64(0), np.cumsum(grams * up[: len(grams)])])
            self.inverse.append(down)
            grams = mixed(grams ^ np.uint64(BASES[1]))

    def all(self, length: int) -> np.ndarray:
        """The first name of each string of ``length`` bytes."""
        sums = self.sums[0]
        found = (sums[length - 7 :] - sums[: len(sums) - length + 7]) * self.inverse[0][: len(sums) - length + 7]
        found ^= found >> np.uint64(32)
        found *= np.uint64(BASES[1])
        return found ^ (found >> np.uint64(29))

    def at(self, start: np.ndarray, length: np.ndarray) -> list[np.ndarray]:
        """Both names of the strings at ``start``, as signed numbers."""
        long = mixed(np.asarray(length, np.uint64))
        return [mixed((s[start + length - 7] - s[start]) * d[start] + long).view(np.int64) for s, d in zip(self.sums, self.inverse)]


def least(names: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbouring names."""
    have = 1
    while have < width:
        step = min(have, width - have)
        names = np.minimum(names[:-step], names[step:])
        have += step
    return names


def blocks_of(named: Named, begin: np.ndarray, size: np.ndarray, length: int, threshold: int) -> tuple[np.ndarray, ...]:
    """(part, name, start, starts, whether the name occurs twice in it) of each block of the parts ``begin``, ``size``.

    Parts are in order and do not overlap, and ``threshold`` - 1 bytes follow
    the last start of each.
    """
    names = named.all(length)
    place, high = np.arange(len(names), dtype=np.uint64), names & np.uint64(2**64 - 1 - PLACE)
    width = threshold - length + 1
    first = (least(high | place, width) & np.uint64(PLACE)).astype(np.int64)
    last = PLACE - (least(high | (np.uint64(PLACE) - place), width) & np.uint64(PLACE)).astype(np.int64)
    own = names[first]
    edge = np.zeros(len(own) + 1, bool)
    edge[1:-1] = own[1:] != own[:-1]
    edge[begin], edge[begin + size] = True, True
    edges = np.flatnonzero(edge)
    part = np.searchsorted(begin, edges, "right") - 1
    inside = (part >= 0) & (edges < (begin + size)[part])
    start, part = edges[inside], part[inside]
    starts = np.r_[edges[1:], len(own)][inside] - start
    pieces = -(-starts // BLOCK)
    nth = np.arange(pieces.sum()) - np.repeat(np.r_[0, np.cumsum(pieces)[:-1]], pieces)
    start, part, starts = (np.repeat(x, pieces) for x in (start, part, starts))
    start, starts = start + nth * BLOCK, np.minimum(starts - nth * BLOCK, BLOCK)
    twice = first[start] != last[start + starts - 1]
    return part, own[start].view(np.int64), start, starts, twice


def pieces_of(size: int, los: list[int], sizes: list[int], weights: list[int], threshold: int) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
    """(from, to, parts) of the stretches of a text of ``size`` bytes that its parts need, a segment at a time."""
    cut: list[tuple[int, int, int]] = []
    for lo, n, weight in sorted(zip(los, sizes, weights)):
        n = min(n, size - threshold + 1 - lo)
        cut += [(a, min(SEGMENT, lo + n - a), weight) for a in range(lo, lo + n, SEGMENT)]
    held: list[tuple[int, int, int]] = []
    for part in cut:
        if held and (part[0] > held[-1][0] + held[-1][1] + threshold or part[0] + part[1] - held[0][0] > SEGMENT):
            yield held[0][0], held[-1][0] + held[-1][1] + threshold - 1, held
            held = []
        held.append(part)
    if held:
        yield held[0][0], held[-1][0] + held[-1][1] + threshold - 1, held


BLOCKS = "k1 long, k2 long, name long, b1 long, b2 long, lo long, size int, twice boolean, weight long"


def _blocks(parts: DataFrame, length: int, threshold: int) -> DataFrame:
    """The blocks of ``parts`` (k1, k2, text, lo, size, weight), the last three being lists of the starts to look at.

    At ``threshold`` itself each start is a block of its own.
    """

    def run(batch: dict) -> Iterator[dict]:
        powers = Powers()
        held: list[bytes] = []
        rows: list[tuple[int, int, int, int, int, int]] = []  # k1, k2, start in the buffer, start in the text, starts, weight
        filled = 0

        def out() -> dict:
            k1, k2, begin, lo, size, weight = (np.array(c, np.int64) for c in zip(*rows))
            named = Named(np.frombuffer(b"".join(held), np.uint8), powers)
            if length < threshold:
                part, name, start, starts, twice = blocks_of(named, begin, size, length, threshold)
                b1, b2 = named.at(start, starts + threshold - 1)
            else:
                part = np.repeat(np.arange(len(size)), size)
                start = begin[part] + np.arange(len(part)) - np.repeat(np.r_[0, np.cumsum(size)[:-1]], size)
                starts, twice = np.ones(len(part), np.int64), np.zeros(len(part), bool)
                name = b1 = b2 = None
                b1, b2 = named.at(start, np.full(len(part), threshold))
                name = b1
            columns = {"k1": k1[part], "k2": k2[part], "name": name, "b1": b1, "b2": b2, "lo": lo[part] + start - begin[part]}
            return columns | {"size": starts.astype(np.int32), "twice": twice, "weight": weight[part]}

        for k1, k2, text, *own in zip(*(batch[c] for c in ("k1", "k2", "text", "lo", "size", "weight"))):
            for a, b, inside in pieces_of(len(text), *own, threshold):
                rows += [(k1, k2, filled + lo - a, lo, n, w) for lo, n, w in inside]
                held.append(text[a:b])
                filled += b - a
                if filled > BUFFER:
                    yield out()
                    held.clear(), rows.clear()
                    filled = 0
        if rows:
            yield out()

    return by_batch(parts.select(*KEY, F.col("text").cast("binary").alias("text"), "lo", "size", "weight"), run, BLOCKS)


def remove_repeats(docs: DataFrame, threshold: int = 400) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of ``docs`` (doc_id, text).

    A byte is removed if a string of ``threshold`` bytes around it also starts
    anywhere else, in this or another row; strings never cross rows. Null texts
    count as empty, and texts shorter than the threshold lose nothing. Repeated
    rows repeat each other's text. Rows with equal texts get equal results; a
    null doc_id stays null. No rows give no rows. Other columns are ignored.
    ``threshold`` is 8 at least.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long"), text.alias("text")).select(
        "doc_id", "text", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit("second"), "text").alias("k2"), F.octet_length("text").cast("long").alias("n_bytes")
    )
    long_texts = texts.where(F.col("n_bytes") >= threshold)
    one = {"lo": F.lit(0).cast("long"), "size": F.col("n_bytes") - threshold + 1, "weight": F.lit(1).cast("long")}
    parts, spans = long_texts.select(*KEY, "text", *[F.array(v).alias(c) for c, v in one.items()]), []
    lengths = [n for n in LENGTHS if n < threshold] + [threshold]
    for level, length in enumerate(lengths):
        blocks = materialize(_blocks(parts, length, threshold), "repeat-blocks")
        shared = blocks.groupBy("name").agg(F.sum("weight").alias("n"), F.max("twice").alias("t")).where("n > 1 or t").select("name")
        # equal texts are rows of their own at first, and the same one thereafter
        weight = F.sum("weight") if level == 0 else F.max("weight")
        near = blocks.join(shared, "name").groupBy(*KEY, "lo", "size", "name", "b1", "b2", "twice").agg(weight.alias("weight"))
        near = materialize(near, "repeat-near")
        variants = near.groupBy("name", "b1", "b2").agg(
            F.sum("weight").alias("n"), F.max("twice").alias("twice"), *[F.first(c).alias(c) for c in (*KEY, "lo", "size")]
        )
        variants = materialize(variants, "repeat-variants")
        own = near if level == 0 else near.where("weight = 1")
        spans.append(own.join(variants.where("n > 1").select("b1", "b2"), ["b1", "b2"]).select(*KEY, "lo", "size"))
        if length == threshold:
            break
        names = variants.groupBy("name").agg(F.count("*").alias("m"), F.min("n").alias("least"), F.max("twice").alias("t"))
        names = names.where("least = 1 and (m > 1 or t)").select("name")
        lists = variants.join(names, "name").groupBy(*KEY).agg(F.collect_list(F.struct("lo", "size", F.col("n").alias("weight"))).alias("own"))
        parts = long_texts.select(*KEY, "text").join(bounded(materialize(lists, "repeat-open"), items=F.size("own")), KEY)
        parts = parts.select(*KEY, "text", "own.lo", "own.size", "own.weight")
    found = spans[0]
    for more in spans[1:]:
        found = found.unionByName(more)
    lists = found.groupBy(*KEY).agg(F.collect_list(F.struct("lo", "size")).alias("spans")).select(*KEY, "spans.lo", "spans.size")

    def merge(batch: dict) -> dict:
        out: dict = {"k1": batch["k1"], "k2": batch["k2"], "begins": [], "ends": []}
        for lo, size in zip(batch["lo"], batch["size"]):
            begin = np.sort(np.array(lo, np.int64))
            end = np.maximum.accumulate((np.array(lo, np.int64) + np.array(size))[np.argsort(np.array(lo, np.int64), kind="stable")] + threshold - 1)
            new = np.r_[True, begin[1:] > end[:-1]]
            out["begins"].append(begin[new].tolist())
            out["ends"].append(end[np.r_[new[1:], True]].tolist())
        return out

    cuts = materialize(by_batch(lists, merge, "k1 long, k2 long, begins array<long>, ends array<long>"), "repeat-cuts")

    def remove(batch: dict) -> dict:
        out: dict = {"k1": batch["k1"], "k2": batch["k2"], "n_removed": [], "n_spans": [], "kept_sha256": []}
        for text, begins, ends in zip(batch["text"], batch["begins"], batch["ends"]):
            digest, at = hashlib.sha256(), 0
            for a, b in zip(begins, ends):
                digest.update(text[at:a])
                at = b
            digest.update(text[at:])
            out["n_removed"].append(sum(ends) - sum(begins))
            out["n_spans"].append(len(begins))
            out["kept_sha256"].append(digest.hexdigest())
        return out

    joined = long_texts.select(*KEY, "text").join(bounded(cuts, items=F.size("begins")), KEY)
    joined = joined.select(*KEY, F.col("text").cast("binary").alias("text"), "begins", "ends")
    done = by_batch(joined, remove, "k1 long, k2 long, n_removed long, n_spans long, kept_sha256 string").distinct()
    base = texts.select("doc_id", *KEY, "n_bytes", F.sha2("text", 256).alias("sha"))
    return base.join(done, KEY, "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256")
    )
