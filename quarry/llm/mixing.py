"""Mixing sources to target sizes by weighted pivotal rounding.

Every document of a source is taken the same fractional number of times, and
the fractions are rounded so that each source's total is kept: documents are
paired, words move at random from one to the other until one of the two is
taken a whole number of times, and the other goes on to the next pair. Blocks
of documents are rounded in parallel; what each block has left over, one
document at most, is rounded in turn, block by block, up a reduction tree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, bounded, doc_ids, materialize

#: A fraction this close to a whole number counts as whole.
WHOLE = 1e-9


def targets(sizes: Sequence[float], weights: Sequence[float], share: float, most: float) -> list[float]:
    """Words for each source: ``share`` of all sizes dealt by weight, none over ``most`` times its size.

    What a source cannot take is dealt again among the rest, by weight.
    """
    out = [0.0] * len(sizes)
    left, open_ = share * sum(sizes), list(range(len(sizes)))
    while open_:
        weight = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / weight > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / weight
            break
        for i in over:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return out


def _uniform(*key: object) -> float:
    return xxhash.xxh64_intdigest(":".join(map(str, key)).encode(), 7) / 2.0**64


def pivot(rows: list[tuple], seed: int) -> Iterator[tuple[int, float]]:
    """(index, fraction) for each (id, nth, size, fraction) row: all 0 or 1, but one at most.

    The sum of size * fraction stays as it was, and so does the expectation of
    each fraction. Rows come largest first, so that what is left is small.
    """
    held = None
    for i, (doc_id, nth, size, p) in enumerate(rows):
        if held is None:
            held = i, p
            continue
        j, q = held
        other = rows[j][2]
        up, down = min((1 - p) * size, q * other), min(p * size, (1 - q) * other)
        if _uniform(seed, doc_id, nth, rows[j][0], rows[j][1]) * (up + down) < down:
            p, q = p + up / size, q - up / other
        else:
            p, q = p - down / size, q + down / other
        held = None
        for k, x in ((j, q), (i, p)):
            if x < WHOLE or x > 1 - WHOLE:
                yield k, float(round(x))
            elif held is None:
                held = k, x
            else:  # only by rounding errors
                yield k, float(x >= 0.5)
    if held:
        yield held


def _source_key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 42,
    block_rows: int = 16_384,
    fan_in: int = 256,
) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies, source, nth) for every row of ``docs``.

    Size is the number of words (0 for null and wordless texts, which are never
    taken). Sources in code-point order, null last, have the weights in turn,
    repeating. ``taken`` is size * copies; the copies of two documents of a
    source differ by one at most. A source's taken words miss its target by
    half the size of one document at most, and that one is
    small where a source has many. Rows that are equal in doc_id, source
    and size are told apart by a number, so that a key of any frequency spreads
    over the blocks. Runs agree for the same rows and seed. No rows give no
    rows; a null doc_id is kept. One row for each source reaches the driver.
    """
    doc_id, kind = doc_ids(docs)
    sized = docs.select(
        doc_id.cast("string"),  # pandas has no null among whole numbers
        F.col("source").cast("string"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    same = materialize(sized.groupBy("doc_id", "source", "size").count(), "mix-sizes")
    found = same.groupBy("source").agg(F.sum(F.col("size") * F.col("count")).alias("size"), F.sum("count").alias("rows")).collect()
    found = sorted(found, key=lambda r: (r["source"] is None, r["source"] or ""))
    own = [weights[i % len(weights)] for i in range(len(found))]
    wanted = targets([r["size"] for r in found], own, share, most)
    plan = [
        (("n" if r["source"] is None else "s" + r["source"]), int(r["size"]), t, t / r["size"] if r["size"] else 0.0, max(1, math.ceil(r["rows"] / block_rows)))
        for r, t in zip(found, wanted)
    ]
    spark = docs.sparkSession
    by_source = spark.createDataFrame(plan, "key string, source_size long, target double, ratio double, blocks int")
    # equal rows are numbered by thousands, so that no array grows with their number
    thousand = F.explode(F.sequence(F.lit(0), F.floor((F.col("count") - 1) / 1000)))
    rows = same.withColumn("_k", thousand)
    rows = rows.withColumn("nth", F.explode(F.sequence(F.col("_k") * 1000 + 1, F.least(F.col("count"), F.col("_k") * 1000 + 1000)))).drop("_k", "count")
    rows = rows.withColumn("key", _source_key(F.col("source"))).join(bounded(by_source), "key")
    rows = rows.withColumn("base", F.floor("ratio").cast("int")).withColumn(
        "p", F.when(F.col("size") == 0, 0.0).otherwise(F.col("ratio") - F.col("base"))
    )
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "nth", "size"), F.col("blocks")).cast("int"))
    rows = rows.select("doc_id", "source", "size", "nth", "key", "source_size", "target", "base", "p", "block")
    schema = rows.schema
    settled = (F.col("p") < WHOLE) | (F.col("p") > 1 - WHOLE)

    def round_block(pdf: pd.DataFrame) -> pd.DataFrame:
        tie = [xxhash.xxh64_intdigest(f"{seed}:{d}:{n}".encode()) for d, n in zip(pdf["doc_id"], pdf["nth"])]
        pdf = pdf.assign(_tie=tie).sort_values(["size", "_tie", "doc_id", "nth"], ascending=[False, True, True, True]).drop(columns="_tie").reset_index(drop=True)
        p = pdf["p"].to_numpy().copy()
        for i, x in pivot(list(zip(pdf["doc_id"], pdf["nth"], pdf["size"], p)), seed):
            p[i] = x
        return pdf.assign(p=p)

    done, blocks = [rows.where(settled)], max([r[4] for r in plan], default=1)
    rows = rows.where(~settled)
    while True:
        out = materialize(rows.groupBy("key", "block").applyInPandas(round_block, schema), "mix-level")
        done.append(out.where(settled))
        rows = out.where(~settled)
        if blocks == 1:
            break
        blocks = -(-blocks // fan_in)
        rows = rows.withColumn("block", F.floor(F.col("block") / fan_in).cast("int"))
    done.append(rows)  # one document of a source at most is left, and taken or not as is nearer to the target
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    copies = (F.col("base") + F.round("p")).cast("int")
    return whole.select(F.col("doc_id").cast(kind), "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"), "source", "nth")
