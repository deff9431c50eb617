"""Byte n-grams: counting them with Spark, and looking values up in sorted hash arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pa_schema

#: Bytes of text that are turned into codes at once, so few that their arrays stay in a processor's cache.
PIECE = 1 << 17


def pieces(texts: list[bytes], n: int) -> Iterator[tuple[bytes, list[int], list[int]]]:
    """(buffer, rows, grams) covering each text and an end sign, zero bytes before it.

    A buffer holds blocks of n - 1 bytes of context and the bytes they precede;
    ``grams`` has the number of the latter. Long texts take several blocks.
    """
    held, rows, grams, size = [], [], [], 0
    for row, text in enumerate(texts):
        whole = b"\0" * (n - 1) + text + b"\0"
        for at in range(0, len(text) + 1, PIECE):
            block = whole[at : at + PIECE + n - 1]
            held.append(block), rows.append(row), grams.append(len(block) - n + 1)
            size += len(block)
            if size >= PIECE:
                yield b"".join(held), rows, grams
                held, rows, grams, size = [], [], [], 0
    if held:
        yield b"".join(held), rows, grams


def codes(buffer: bytes, grams: list[int], n: int) -> np.ndarray:
    """The n-grams of a buffer of :func:`pieces`, each as a number of n bytes, in order."""
    by_width = {1: np.frombuffer(buffer, np.uint8).astype(np.uint64)}
    width = 1
    while 2 * width <= n:
        by_width[2 * width] = (by_width[width][:-width] << np.uint64(8 * width)) | by_width[width][width:]
        width *= 2
    total = len(by_width[1]) - n + 1
    out, have = by_width[width][:total], width
    for width in sorted(by_width, reverse=True):
        if have + width <= n:
            out = (out << np.uint64(8 * width)) | by_width[width][have : have + total]
            have += width
    valid = np.ones(len(out), bool)
    ends = np.cumsum(np.array(grams) + n - 1)[:-1]
    for k in range(1, n):
        valid[ends - k] = False
    return out[valid]


def added_up(keys: np.ndarray, sums: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and how often each is there, or the sum of its ``sums``; without these, ``keys`` is sorted in place."""
    if sums is None:
        keys.sort()
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        return keys[first], np.diff(np.r_[first, len(keys)])
    order = np.argsort(keys, kind="stable")
    keys, sums = keys[order], sums[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(sums, first) if len(first) else sums


def task_counts(
    batches: Iterator[pa.RecordBatch], n: int, prepare: Callable[[str | None], bytes], flagged: bool, most: int, classify: Callable[[str | None], int] | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, numbers) of the n-grams of a task's texts, at most ``most`` and those of one piece at a time.

    A key is the n-gram; twice it plus the text's flag; or, with ``classify``,
    four times it plus the text's class, 0 to 3.
    """
    raw: list[np.ndarray] = []
    parts: list[tuple[np.ndarray, np.ndarray]] = []

    def fold() -> None:
        if raw:
            whole = np.concatenate(raw)
            raw.clear()
            parts.append(added_up(whole))
        if len(parts) > 1:
            parts[:] = [added_up(*(np.concatenate(x) for x in zip(*parts)))]

    for got in (b.slice(at, 1000).to_pydict() for b in batches for at in range(0, b.num_rows, 1000)):
        flags = np.array([classify(t) for t in got["text"]] if classify else got["flag"] if flagged else [], np.uint64)
        for buffer, rows, grams in pieces([prepare(t) for t in got["text"]], n):
            keys = codes(buffer, grams, n)
            raw.append((keys << np.uint64(2 if classify else 1)) | np.repeat(flags[rows], grams) if len(flags) else keys)
            if sum(map(len, raw)) > most:
                fold()
                if len(parts[0][0]) > most // 2:
                    yield parts.pop()
    fold()
    yield from parts


def count(docs: DataFrame, n: int, prepare: Callable[[str | None], bytes], most: int = 2_000_000) -> DataFrame:
    """(code, n) over all rows."""
    schema = "key long, n long"
    target = pa_schema(schema, docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, sums in task_counts(batches, n, prepare, False, most):
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(sums.astype(np.int64))], schema=target)

    sums = docs.select(F.col("text").cast("string")).mapInArrow(run, schema)
    return sums.groupBy(F.col("key").alias("code")).agg(F.sum("n").alias("n"))


def count_classes(docs: DataFrame, n: int, prepare: Callable[[str | None], bytes], classify: Callable[[str | None], int], most: int = 1_000_000) -> DataFrame:
    """(code, n, n0, n1) over all rows of ``docs`` (text): how often in all, in texts of class 1, and in those of class 2."""
    schema = "key long, n long"
    target = pa_schema(schema, docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, sums in task_counts(batches, n, prepare, False, most, classify):
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(sums.astype(np.int64))], schema=target)

    sums = docs.select(F.col("text").cast("string")).mapInArrow(run, schema)
    of = lambda k: F.sum(F.when(F.col("key") % 4 == k, F.col("n")).otherwise(0))
    return sums.groupBy(F.shiftright("key", 2).alias("code")).agg(F.sum("n").alias("n"), of(1).alias("n0"), of(2).alias("n1"))


#: Parts that packed counts are dealt to.
SHARDS = 2048


def shard(context: np.ndarray) -> np.ndarray:
    return (mixed(context + np.uint64(1)) % np.uint64(SHARDS)).astype(np.int64)


def pack(numbers: np.ndarray) -> bytes:
    """64-bit numbers in rising order, or small ones, as steps by planes of bytes, which compress well."""
    steps = np.diff(numbers.view(np.uint64), prepend=np.uint64(0))
    return steps.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(packed: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(8, -1).T).view(np.uint64).reshape(-1)
    return np.cumsum(steps, dtype=np.uint64)


def packed_counts(docs: DataFrame, n: int, prepare: Callable[[str | None], bytes], most: int = 1_500_000) -> DataFrame:
    """(shard, keys, sums): each task's n-grams and the running sums of their numbers, packed for each shard.

    A key is twice the n-gram, plus one where the boolean column ``flag`` of
    ``docs`` is set. The two bytes before an n-gram's last decide its shard.
    """
    schema = "shard int, keys binary, sums binary"
    target = pa_schema(schema, docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_context = shard(np.arange(1 << 16, dtype=np.uint64)).astype(np.uint16)
        for keys, sums in task_counts(batches, n, prepare, True, most):
            own = by_context[(keys >> np.uint64(9)) & np.uint64(0xFFFF)]
            order = np.argsort(own, kind="stable")
            keys, sums, own = keys[order], sums[order], own[order]
            del order
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            cut = list(zip(first.tolist(), [*first[1:].tolist(), len(own)]))
            arrays = [pa.array(own[first].astype(np.int32)), *[pa.array([pack(x[a:b]) for a, b in cut], pa.binary()) for x in (keys, np.cumsum(sums))]]
            yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return docs.select(F.col("text").cast("string"), F.col("flag").cast("boolean")).mapInArrow(run, schema)


def mixed(keys: np.ndarray) -> np.ndarray:
    """A one-to-one 64-bit hash of the keys (the splitmix64 finaliser)."""
    x = keys.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class HashArray:
    """Sorted hashes with a value each, or a row of values; a lookup starts at the place that the leading bits name."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray):
        self.hashes, self.values, self.size = hashes, values, len(hashes) - 1
        self.shift = np.uint64(64 - max(1, self.size.bit_length() - 1))
        self.starts = np.empty(1 << int(64 - self.shift), np.int32)
        for i in range(0, len(self.starts), 1 << 18):  # without large arrays beside it
            own = self.starts[i : i + (1 << 18)]
            own[:] = np.searchsorted(hashes, np.arange(i, i + len(own), dtype=np.uint64) << self.shift)

    @staticmethod
    def arrays(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What to broadcast: sorted hashes and their values, an end sign after them."""
        hashes, sorted_values = np.full(len(keys) + 1, 2**64 - 1, np.uint64), np.zeros((len(keys) + 1, *values.shape[1:]))
        hashes[:-1] = mixed(keys)
        order = np.argsort(hashes[:-1])
        hashes[:-1] = hashes[order]
        sorted_values[:-1] = values[order]
        return hashes, sorted_values

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The keys' values, and which of the keys are there.

        Keys are looked up in the order of their hashes, so that the array is
        read from one end to the other. For that, their places take the low bits
        of the hashes that are sorted.
        """
        values, there = np.empty((len(keys), *self.values.shape[1:])), np.empty(len(keys), bool)
        for i in range(0, len(keys), 1 << 18):
            own = mixed(keys[i : i + (1 << 18)])
            order = (own & np.uint64(2**64 - (1 << 18))) | np.arange(len(own), dtype=np.uint64)
            order.sort()
            order = (order & np.uint64((1 << 18) - 1)).astype(np.int64)
            hashes = own[order]
            at = self.starts[(hashes >> self.shift).astype(np.int64)]
            behind = np.flatnonzero(self.hashes[at] < hashes)
            while len(behind):
                at[behind] += 1
                behind = behind[self.hashes[at[behind]] < hashes[behind]]
            values[i + order] = self.values[at]
            there[i + order] = (self.hashes[at] == hashes) & (at < self.size)
        return values, there


def split_by_count(table: DataFrame, most: int, columns: tuple[str, ...] = ("value",)) -> tuple[tuple, DataFrame | None]:
    """The up to ``most`` commonest rows of (code, value..., n) as arrays of a HashArray, the rest as a DataFrame.

    ``most`` bounds what is broadcast; whatever lies beyond it is looked up by
    a join, so that no row is lost. None if nothing lies beyond.
    """
    bins = table.groupBy(F.floor(F.log2(F.col("n") + 1) * 8).alias("bin")).count().orderBy(F.desc("bin")).collect()
    rows, least = 0, None
    for r in bins:
        rows += r["count"]
        if rows > most:
            break
        least = r["bin"]
    table = table.withColumn("_bin", F.floor(F.log2(F.col("n") + 1) * 8))
    hot = table.where(F.col("_bin") >= least if least is not None else F.lit(False)).select("code", *columns).toArrow()
    keys, values = hot["code"].to_numpy().view(np.uint64), np.stack([hot[c].to_numpy() for c in columns], axis=1) if len(columns) > 1 else hot[columns[0]].to_numpy()
    del hot  # the driver holds few copies of the arrays at a time
    arrays = HashArray.arrays(keys, values)
    del keys, values
    if rows <= most:
        return arrays, None
    return arrays, table.where(F.col("_bin") < least if least is not None else F.lit(True)).select("code", *columns)


def look_up(texts: list[bytes], n: int, hot: HashArray, which: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """For each text: the sum of its n-grams' values, their number, and the codes that ``hot`` lacks.

    Where a key has several values, ``which`` says which of them a text takes.
    """
    sums, number = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    cold: list[list[int]] = [[] for _ in texts]
    for buffer, rows, grams in pieces(texts, n):
        keys = codes(buffer, grams, n)
        values, there = hot.find(keys)
        if which is not None:
            values = values[np.arange(len(keys)), np.repeat(np.array(which)[rows], grams)]
        lacking = np.flatnonzero(~there)
        values[lacking] = 0.0
        np.add.at(sums, rows, np.add.reduceat(values, np.r_[0, np.cumsum(grams)[:-1]]))
        np.add.at(number, rows, grams)
        if len(lacking):
            owner = np.repeat(rows, grams)[lacking]
            for row, code in zip(owner.tolist(), keys[lacking].view(np.int64).tolist()):
                cold[row].append(code)
    return sums, number, cold


def add_cold(scored: DataFrame, rest: DataFrame | None, total: str, cold: str, default: float = 0.0, along: tuple[str, ...] = ()) -> DataFrame:
    """``scored`` with the values of the codes in its array column ``cold`` added to ``total``; ``_row`` names its rows.

    ``rest`` is (code, along..., value); the columns ``along`` must agree.
    """
    if rest is None:
        return scored.drop(cold)
    found = scored.select("_row", *along, F.explode(cold).alias("code")).join(rest, ["code", *along], "left")
    found = found.groupBy("_row").agg(F.sum(F.coalesce("value", F.lit(default))).alias("_more"))
    joined = scored.join(found, "_row", "left")
    return joined.withColumn(total, F.col(total) + F.coalesce("_more", F.lit(0.0))).drop("_more", cold)
