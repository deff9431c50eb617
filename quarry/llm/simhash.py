"""SimHash near-duplicates by tiled exact comparison.

Whole texts are fingerprinted by word shingles. Equal fingerprints are folded
first, so that a group of exact copies of any size counts as one row. The
distinct fingerprints are cut into tiles by population count; two fingerprints
within the radius cannot differ more than the radius in population count, so
tile pairs beyond it are never formed. A task compares one pair of tiles with
numpy exclusive-or and bit counts and returns a spanning forest of the links it
finds: at most one link for each row it read, however dense a group is.

The comparison is exact and so quadratic in the number of *distinct*
fingerprints; a tile holds at most ``tile_rows`` of them, whatever the input.

Wide fingerprints need not be compared with all others: texts without shingles
in common differ in about half of their bits, and fingerprints within the
radius stand for texts that weigh most of their shingles alike. Texts then have
keys, each the shingle that comes first in an order of its own, and only those
of a common key are compared, again exactly (:func:`keyed_links`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_batch, doc_ids, materialize
from .components import connected_components

SEED = 42
#: Odd 64-bit constants of the splitmix64 finaliser (fixed values).
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
LANES = np.uint64(0x0101010101010101)
#: The key of fingerprints that an empty one may be within the radius of; rows of a key that one task compares; up to how many without a pivot.
LOW, KEY_ROWS, FEW = 0, 1 << 16, 64


def shingle_hashes(text: str | None, shingle: int) -> list[int]:
    """XXH64 (seed 42) of each run of ``shingle`` words of the text, A-Z lower-cased.

    A text of fewer words has one shingle, all of it; one of no words has none.
    """
    found = (text or "").encode().lower().split()
    if not found:
        return []
    joined = b" ".join(found)
    if len(found) <= shingle:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(found) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A 64-bit word for each run of ``counts`` hashes: bits set in over half of it.

    Eight shifted masks leave one bit in each byte of a hash; up to 255 of them
    add up without carry.
    """
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    size = counts[full]
    pieces = -(-size // 255)
    first_piece = np.r_[0, np.cumsum(pieces)[:-1]]
    begin = np.r_[0, np.cumsum(size)[:-1]]
    at = np.repeat(begin, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(first_piece, pieces))
    word = np.zeros(len(full), np.uint64)
    for k in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(k)) & LANES, at)
        ones = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), first_piece, axis=0)
        for byte in range(8):
            word |= (2 * ones[:, byte] > size).astype(np.uint64) << np.uint64(8 * byte + k)
    out[full] = word
    return out


def _widen(hashes: np.ndarray, word: int) -> np.ndarray:
    """The hashes themselves for word 0, else an independent mix of them."""
    if not word:
        return hashes
    x = hashes + np.uint64(word * MIX[0] % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[2])
    return x ^ (x >> np.uint64(31))


def first_shingles(hashes: np.ndarray, counts: np.ndarray, keys: int) -> np.ndarray:
    """(runs, keys): for each run of ``counts`` hashes, none of them empty, the hash that comes first in each of ``keys`` orders.

    Two runs have the same first hash in an order as often as they are alike: as
    sets, their Jaccard similarity. A hash that a run has c times counts for c
    squared, as it does in the cosine of the runs, which is what bits depend on.
    """
    row = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((hashes, row))
    row, found = row[order], hashes[order]
    new = np.r_[True, (row[1:] != row[:-1]) | (found[1:] != found[:-1])]
    times = np.diff(np.r_[np.flatnonzero(new), len(new)])
    row, found = row[new], found[new]
    begin = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    again = np.flatnonzero(times > 1)
    weight = times[again].astype(float) ** 2
    out = np.zeros((len(counts), keys), np.uint64)
    for k, factor in enumerate(_widen(np.arange(keys, dtype=np.uint64), 1) | np.uint64(1)):
        place = (found * factor).astype(float) * 2.0**-64
        place[again] = -np.expm1(np.log1p(-np.minimum(place[again], 1 - 2.0**-53)) / weight)
        at = np.flatnonzero(place == np.minimum.reduceat(place, begin)[row])
        out[row[at], k] = found[at]
    return out


def fingerprints(docs: DataFrame, shingle: int = 4, width: int = 1, keys: int = 0, radius: int = 0) -> DataFrame:
    """(doc_id, fp) for every row: ``width`` 64-bit words, big-endian; with ``keys``, so many keys besides.

    Null, empty and wordless texts have the fingerprint zero. They have no key
    but the one that all fingerprints of up to ``radius`` bits have.
    """

    def run(batch: dict) -> Iterator[dict]:
        ids, found, counts = [], [], []

        def flush() -> dict:
            hashes, sizes = np.array(found, np.uint64), np.array(counts, np.int64)
            fps = np.stack([majority(_widen(hashes, k), sizes) for k in range(width)], axis=1)
            out = {"doc_id": ids[:], "fp": [row.astype(">u8").tobytes() for row in fps]}
            if keys:
                own = [[] for _ in ids]
                full = np.flatnonzero(sizes)
                if len(full):
                    for i, first in zip(full, first_shingles(hashes, sizes[full], keys)):
                        own[i] = _numbered(first)
                for i in np.flatnonzero(np.bitwise_count(fps).sum(axis=1, dtype=np.int64) <= radius):
                    own[i] = [*own[i], LOW]
                out["keys"] = own
            ids.clear(), found.clear(), counts.clear()
            return out

        for doc_id, text in zip(batch["doc_id"], batch["text"]):
            own = shingle_hashes(text, shingle)
            ids.append(doc_id), counts.append(len(own)), found.extend(own)
            if len(found) > 500_000:
                yield flush()
        if ids:
            yield flush()

    doc_id, kind = doc_ids(docs)
    return by_batch(docs.select(doc_id, F.col("text").cast("string")), run, f"doc_id {kind}, fp binary" + ", keys array<long>" * bool(keys))


def _numbered(first: np.ndarray) -> list[int]:
    """Keys of the first hashes in each order, other ones for each order."""
    return (_widen(first, 1) + np.arange(1, len(first) + 1, dtype=np.uint64) * np.uint64(MIX[1])).view(np.int64).tolist()


def _close(left: np.ndarray, right: np.ndarray, radius: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs at most ``radius`` bits apart, block by block."""
    rows, cols, width = 64, 4096, left.shape[1]
    # so many words that unrelated texts, half of whose bits differ, are mostly beyond the radius by then
    half = next((w for w in range(1, max(1, width // 2)) if 32 * w - 10 * w**0.5 > radius), max(1, width // 2))
    for i in range(0, len(left), rows):
        a = left[i : i + rows]
        for j in range(i // cols * cols if same else 0, len(right), cols):
            b = right[j : j + cols]
            apart = np.zeros((len(a), len(b)), np.uint16 if left.shape[1] > 1 else np.uint8)
            for w in range(half):
                apart += np.bitwise_count(a[:, w, None] ^ b[None, :, w])
            at = np.flatnonzero(apart <= radius)
            if not len(at):
                continue
            x, y = at // len(b), at % len(b)
            rest = apart.reshape(-1)[at].astype(np.int64)
            for w in range(half, left.shape[1]):
                rest += np.bitwise_count(a[x, w] ^ b[y, w])
            near = rest <= radius
            x, y = x[near] + i, y[near] + j
            if same:
                x, y = x[x < y], y[x < y]
            if len(x):
                yield x, y


def _forest(keys: list[bytes], left: np.ndarray, right: np.ndarray, radius: int, same: bool) -> list[tuple[bytes, bytes]]:
    """A link from each row to the first row of its group, for groups over one."""
    label = np.arange(len(keys))
    shift = 0 if same else len(left)
    for x, y in _close(left, right, radius, same):
        _merge(label, x, y + shift)
    return [(keys[i], keys[r]) for i, r in enumerate(label.tolist()) if i != r]


def _merge(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Give the groups of each ``x`` and ``y`` one label, the least."""
    while True:
        new = label[x] != label[y]
        x, y = x[new], y[new]
        if not len(x):
            break
        low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label[:] = label[label]


def _small_groups(words: np.ndarray, begin: np.ndarray, size: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs at most ``radius`` bits apart inside each run of ``size`` rows that starts at one of ``begin``."""
    one, other = np.triu_indices(size, 1)
    runs = max(1, 200_000 // max(1, len(one)))
    for i in range(0, len(begin), runs):
        x, y = ((begin[i : i + runs, None] + side).ravel() for side in (one, other))
        apart = np.bitwise_count(words[x] ^ words[y]).sum(axis=1, dtype=np.int64)
        yield x[apart <= radius], y[apart <= radius]


def _large_group(words: np.ndarray, upper: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs at most ``radius`` bits apart that link all rows of one group which such pairs link; of two tiles, if some rows are ``upper``, those across.

    The rows near a pivot are linked by it. A row outside can be near one of them
    only if it is no farther from the pivot than the farthest of them and the
    radius, so that groups of near copies are not compared pair by pair.
    """
    left, at, misses = np.arange(len(words)), 0, 0
    while at < len(left) and len(left) > FEW and misses < 32:
        apart = np.bitwise_count(words[left] ^ words[left[at]]).sum(axis=1, dtype=np.int64)
        near = apart <= radius
        if near.sum() < max(2, len(left) // 32):
            at, misses = at + 1, misses + 1
            continue
        own, reach = left[near], radius + apart[near].max()
        yield own, np.full(len(own), left[at])
        around = left[~near & (apart <= reach)]
        for x, y in _close(words[own], words[around], radius, False):
            yield own[x], around[y]
        at -= int(near[:at].sum())
        left = left[~near]
    one, other = (left[~upper[left]], left[upper[left]]) if upper.any() else (left, left)
    for x, y in _close(words[one], words[other], radius, not upper.any()):
        yield one[x], other[y]


def keyed_links(classes: DataFrame, radius: int, width: int, key_rows: int = KEY_ROWS) -> DataFrame:
    """(a, b): links of the distinct fingerprints of ``classes`` (id, fp, keys), a spanning set of those within the radius that have a key in common.

    Keys of the very same rows count as one. A key of over ``key_rows`` rows is
    cut into tiles, of which each pair is compared in a task of its own.
    """
    whole = Window.partitionBy("key")
    rows = classes.select("id", F.explode("keys").alias("key")).withColumn("n", F.count("*").over(whole))
    rows = rows.withColumn("first", F.min("id").over(whole)).withColumn("all", F.bit_xor(F.xxhash64("id")).over(whole)).where("n > 1")
    rows = materialize(rows, "simhash-keys")
    once = rows.where("id = first").groupBy("n", "first", "all").agg(F.min("key").alias("key")).select("key")
    tiles = F.ceil(F.col("n") / key_rows).cast("int")
    own = F.pmod(F.xxhash64("id"), tiles).cast("int")
    dealt = rows.join(once, "key").select("key", "id", own.alias("own"), F.explode(F.sequence(F.lit(0), tiles - 1)).alias("other"))
    dealt = dealt.select("key", "id", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).alias("upper"))
    dealt = dealt.join(classes.select("id", "fp"), "id").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "id")

    def link(ids: np.ndarray, upper: np.ndarray, words: np.ndarray, begin: np.ndarray) -> pa.RecordBatch:
        label, size = np.arange(len(ids)), np.diff(np.r_[begin, len(ids)])
        for n in np.unique(size[(size > 1) & (size <= FEW)]):
            for x, y in _small_groups(words, begin[size == n], int(n), radius):
                _merge(label, x, y)
        for at, n in zip(begin[size > FEW], size[size > FEW]):
            for x, y in _large_group(words[at : at + n], upper[at : at + n], radius):
                _merge(label, x + at, y + at)
        far = np.flatnonzero(label != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([pa.array(ids[far]), pa.array(ids[label[far]])], names=["a", "b"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Group by group; the last of a batch waits for the next one."""
        held: list[list[np.ndarray]] = [[], [], [], []]
        for batch in batches:
            if not batch.num_rows:
                continue
            group = np.stack([np.asarray(batch.column(c), np.int64) for c in ("key", "lo", "hi")], axis=1)
            fp = np.frombuffer(b"".join(batch.column("fp").to_pylist()), ">u8").astype(np.uint64).reshape(-1, width)
            new = [group, np.asarray(batch.column("id"), np.int64), batch.column("upper").to_numpy(zero_copy_only=False).astype(bool), fp]
            held = [[*old, piece] for old, piece in zip(held, new)]
            begins = np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1
            if not len(begins) and (held[0][0][0] == group[0]).all():
                continue
            columns = [np.concatenate(pieces) for pieces in held]
            begin = np.flatnonzero(np.r_[True, (columns[0][1:] != columns[0][:-1]).any(axis=1)])
            yield link(*[x[: begin[-1]] for x in columns[1:]], begin[:-1])
            held = [[x[begin[-1] :]] for x in columns]
        if len(held[0]):
            yield link(*map(np.concatenate, held[1:]), np.array([0]))

    return dealt.mapInArrow(compare, "a long, b long")


def links(distinct: DataFrame, radius: int, width: int, tile_rows: int | None = None) -> DataFrame:
    """(a, b): a spanning set of the links between distinct fingerprints ``fp``.

    Tiles are bands of population counts, cut further by a hash where a band
    has over ``tile_rows`` rows, by default the fewer the wider fingerprints
    are, so that a task's work stays about the same. Only the band sizes (at most 64 * width + 1
    rows) and no fingerprint reach the driver.
    """
    band = max(1, radius // 4)
    tile_rows = tile_rows or min(1 << 18, (1 << 20) // width)
    bits = sum((F.bit_count(F.conv(F.hex(F.substring("fp", 8 * w + 1, 8)), 16, -10).cast("long")) for w in range(width)), F.lit(0))
    rows = materialize(distinct.select("fp", (F.floor(bits / band)).cast("int").alias("band")), "simhash-tiles")
    sizes = {r["band"]: r["count"] for r in rows.groupBy("band").count().collect()}
    parts = {k: -(-n // tile_rows) for k, n in sizes.items()}
    reach = -(-radius // band)
    spark = distinct.sparkSession
    if not parts:
        return spark.createDataFrame([], "a binary, b binary")
    cut = F.create_map(*[F.lit(x) for kv in parts.items() for x in kv])
    rows = rows.withColumn("part", F.pmod(F.xxhash64("fp"), cut[F.col("band")]).cast("int"))
    near = F.filter(F.array(*[F.lit(k) for k in sorted(parts)]), lambda k: F.abs(k - F.col("band")) <= reach)
    other = F.explode(F.flatten(F.transform(near, lambda k: F.transform(F.sequence(F.lit(0), cut[k] - 1), lambda p: F.struct(k.alias("band"), p.cast("int").alias("part"))))))
    dealt = rows.withColumn("own", F.struct("band", "part")).withColumn("other", other)
    dealt = dealt.select(
        "fp",
        F.least("own", "other").alias("lo"),
        F.greatest("own", "other").alias("hi"),
        (F.col("own") > F.col("other")).alias("upper"),
    )

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["upper", "fp"])
        keys = [bytes(x) for x in pdf["fp"]]
        words = np.frombuffer(b"".join(keys), ">u8").astype(np.uint64).reshape(len(keys), width)
        n = int((~pdf["upper"].astype(bool)).sum())
        same = bool((pdf["lo_band"].iloc[0] == pdf["hi_band"].iloc[0]) and (pdf["lo_part"].iloc[0] == pdf["hi_part"].iloc[0]))
        found = _forest(keys, words[:n], words if same else words[n:], radius, same)
        return pd.DataFrame(found, columns=["a", "b"])

    flat = dealt.select("fp", "upper", *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in ("lo", "hi") for c in ("band", "part")])
    return flat.groupBy("lo_band", "lo_part", "hi_band", "hi_part").applyInPandas(compare, "a binary, b binary")


def near_duplicates(docs: DataFrame, shingle: int = 5, width: int = 4, radius: int = 51, keys: int = 0) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs`` (doc_id, text).

    Fingerprints link at ``radius`` or fewer differing bits; the component is
    the closure of the links and is named by its smallest doc_id. The default
    is five-word shingles and 0.8 of 256 bits alike. Rows of null text or no
    words share the fingerprint zero and are linked like any others. A null
    doc_id stays null and names no component, unless all its members are null.
    Repeated rows come back as often as they came. Other columns are ignored.

    All fingerprints are compared, or, with ``keys``, those that have one of so
    many keys in common: for wide fingerprints, and radii that only texts reach
    of which at least half is alike. Such texts have no key in common with a
    probability of 2 ** -keys.
    """
    fps = materialize(fingerprints(docs, shingle, width, keys, radius), "simhash-fps")
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("first"), *[F.array_distinct(F.flatten(F.collect_set("keys"))).alias("keys")] * bool(keys))
    if keys:
        classes = materialize(classes.withColumn("id", F.monotonically_increasing_id()), "simhash-classes")
        found = keyed_links(classes, radius, width)
    else:
        classes = classes.withColumn("id", F.col("fp"))
        found = links(classes.select("fp"), radius, width)
    roots = connected_components(found)
    classes = classes.join(roots.withColumnRenamed("node", "id"), "id", "left").select("fp", "first", F.coalesce("root", "id").alias("root"))
    named = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = classes.join(named, "root").select("fp", "component_id")
    return fps.join(classes, "fp").select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
