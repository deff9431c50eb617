"""A trie of conversations, whose nodes are beginnings that conversations share.

The depths are cut as in a van Emde Boas layout: blocks of depths are halved
until one depth is left, and the upper half and all lower halves of a round are
worked on at once. Going up, names of stretches are put together from the names
of their halves; going down, each cut prefix is named from the prefix at the
block's beginning and the stretch between them; at the end the totals of lower
tries are grafted onto the upper trie's nodes, smallest blocks first. A round
touches a stretch once, so that d turns take about 2 d names and log2 d rounds,
and no task walks along a whole conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, materialize

#: A conversation's base is the one at the beginning of its hundred; it lends up to five turns.
BASE_EVERY, LENT = 100, 6
#: Width of the ranges of conv_id in which ends are joined to one string.
RANGE = 1024


def _digest(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def ordered_turns(messages: DataFrame) -> DataFrame:
    """(conv_id, place, digest, chars): the turns of each conversation, numbered from 1.

    They stand by turn, null first, then role and text. Rows are dealt by range
    of all these, so that a long conversation is numbered by many tasks.
    """
    turns = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    digest = _digest(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    dealt = turns.where("conv_id is not null").repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = dealt.select("conv_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"), digest.alias("digest"), F.length("text").cast("long").alias("chars"))
    dealt = materialize(dealt, "trie-turns")
    pieces = dealt.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.select("conv_id", "part", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("at"))
    return dealt.withColumn("within", within).join(bounded(pieces), ["conv_id", "part"]).select("conv_id", (F.col("before") + F.col("within")).alias("place"), "digest", "chars")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of their base: (conv_id, turns) and their turns (conv_id, place, digest, chars).

    A conversation c takes the first crc32(c) % 6 turns of c - c % 100, and its
    own after as many.
    """
    sizes = turns.groupBy("conv_id").agg(F.max("place").alias("own"))
    lent = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % LENT).alias("lent")
    convs = sizes.select("conv_id", "own", lent, (F.col("conv_id") - F.col("conv_id") % BASE_EVERY).alias("base"))
    bases = sizes.where(F.col("conv_id") % BASE_EVERY == 0).toDF("base", "there")
    convs = convs.join(bounded(bases), "base", "left").withColumn("taken", F.least("lent", F.coalesce("there", F.lit(0))))
    convs = materialize(convs.withColumn("turns", F.col("taken") + F.greatest(F.col("own") - F.col("lent"), F.lit(0))), "trie-convs")
    heads = turns.where((F.col("conv_id") % BASE_EVERY == 0) & (F.col("place") < LENT)).withColumnRenamed("conv_id", "base")
    borrowed = convs.select("conv_id", "base", "taken").join(bounded(heads), "base").where("place <= taken").select("conv_id", "place", "digest", "chars")
    own = turns.join(bounded(convs.select("conv_id", "lent", "taken")), "conv_id").where("place > lent")
    own = own.select("conv_id", (F.col("place") - F.col("lent") + F.col("taken")).alias("place"), "digest", "chars")
    return convs.select("conv_id", "turns"), materialize(borrowed.unionByName(own), "trie-rebuilt")


def named_prefixes(convs: DataFrame, turns: DataFrame, rounds: int) -> DataFrame:
    """(conv_id, depth, name): every beginning of every conversation, the empty one at depth 0 too."""
    stretches = [turns.select("conv_id", (F.col("place") - 1).alias("at"), F.col("digest").alias("name"))]
    for _ in range(rounds - 1):
        half = stretches[-1].withColumn("right", F.col("at") % 2 == 1).withColumn("at", F.floor(F.col("at") / 2))
        part = lambda right: F.max(F.when(F.col("right") == right, F.col("name")))
        whole = half.groupBy("conv_id", "at").agg(part(False).alias("a"), part(True).alias("b")).where("a is not null and b is not null")
        stretches.append(materialize(whole.select("conv_id", "at", _digest(F.col("a"), F.col("b")).alias("name")), "trie-stretches"))
    known = convs.select("conv_id", F.lit(0).cast("long").alias("at"), F.unhex(F.sha2(F.lit(""), 256)).alias("name"))
    for stretch in reversed(stretches):
        known = known.withColumn("at", F.col("at") * 2)
        next_ = stretch.where("at % 2 = 0").select("conv_id", "at", F.col("name").alias("between")).join(known, ["conv_id", "at"])
        next_ = next_.select("conv_id", (F.col("at") + 1).alias("at"), _digest(F.col("name"), F.col("between")).alias("name"))
        known = materialize(known.unionByName(next_), "trie-prefixes")
    return known.withColumnRenamed("at", "depth")


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node's ids, which come in order, through one hash; only the hash is held."""
    name, state = None, hashlib.sha256()

    def closed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([state.hexdigest()])], names=["name", "ends_sha256"])

    for batch in batches:
        for node, ids in zip(batch.column(0), batch.column(1)):
            node = node.as_py()
            if node != name:
                if name is not None:
                    yield closed()
                name, state = node, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.as_py().encode())
    if name is not None:
        yield closed()


def ends_hash(ends: DataFrame) -> DataFrame:
    """(name, ends_sha256) of ``ends`` (name, conv_id): the hash of a node's ids, ascending.

    Ids are joined by ranges first, so that a node at which a third of all
    conversations end is one row for each range.
    """
    bands = ends.withColumn("band", F.floor(F.col("conv_id") / RANGE)).groupBy("name", "band")
    bands = bands.agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    dealt = bands.repartition("name").sortWithinPartitions("name", "band").select("name", "ids")
    return dealt.mapInArrow(_hash_ends, "name binary, ends_sha256 string")


def _grafted(nodes: DataFrame, paths: DataFrame, rounds: int) -> DataFrame:
    """``nodes`` (name, depth, conv_id, leaves, saved) with sums over their subtrees.

    After round j a node has the sum over the nodes below it within its block
    of 2^(j+1) depths; a round adds the sums of the lower half's roots to the
    nodes above them in the upper half, found through the root's smallest member.
    """
    for j in range(rounds):
        half, whole = 2**j, 2 ** (j + 1)
        block = F.floor(F.col("depth") / whole).alias("block")
        roots = nodes.where(F.col("depth") % whole == half).select("conv_id", block, "leaves", "saved")
        upper = paths.where(F.col("depth") % whole < half).select("conv_id", block, "name")
        credit = roots.join(upper, ["conv_id", "block"]).groupBy("name").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        more = nodes.join(credit, "name", "left")
        nodes = materialize(more.select("name", "depth", "conv_id", *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")]), "trie-totals")
    return nodes


def prefix_trie(messages: DataFrame) -> DataFrame:
    """Nodes of the trie of rebuilt conversations of ``messages`` (conv_id, turn, role, text).

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256), one row a node. Null roles and texts are empty,
    null turns come first; of turns of one number the lesser role and text come
    first, and repeated rows are turns of their own. Rows of a null conv_id are
    no conversation; without conversations there are no nodes. Other columns
    are ignored.
    """
    convs, turns = rebuilt(ordered_turns(messages))
    longest = convs.agg(F.max("turns")).first()[0] or 0
    rounds = max(1, int(longest).bit_length())
    paths = named_prefixes(convs, turns, rounds)
    last = turns.select("conv_id", F.col("place").alias("depth"), "chars")
    rows = materialize(paths.join(last, ["conv_id", "depth"], "left"), "trie-paths")
    nodes = rows.groupBy("name", "depth").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max(F.coalesce("chars", F.lit(0))).alias("chars"))
    above = rows.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"))
    nodes = materialize(nodes.join(above, ["conv_id", "depth"], "left"), "trie-nodes")
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    whole = materialize(nodes.join(children, "name", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-whole")
    own = whole.select("name", "depth", "conv_id", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    totals = _grafted(own, rows.select("conv_id", "depth", "name"), rounds)
    ends = ends_hash(rows.join(convs.select("conv_id", F.col("turns").alias("depth")), ["conv_id", "depth"]).select("name", "conv_id"))
    parents = whole.where("n_children > 0").select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    found = whole.join(totals.select("name", "leaves", "saved"), "name").join(ends, "name", "left").join(bounded(parents), "parent", "left")
    return found.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
