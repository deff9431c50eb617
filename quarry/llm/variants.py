"""Spelling variants: words one edit apart, found by a frontier that goes down a trie.

The words are put into a path-compressed trie, whose edges are a table. A state
(word, position, node, edits) says that the word's beginning up to a position
leads to a node with so many edits. Level by level, all states are joined with
the edges of that level; states that come to a word's end with one edit make two
words near. A state is kept only if the next character of its word goes on from
its node, so that the frontier stays near to the words themselves.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, by_batch, doc_ids, materialize

#: A run, in lower-cased UTF-8: a-z and U+00C0..U+00FF.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
#: One occurrence in so many loses a character.
LOSES = 97
#: Least code points of a word, and least occurrences in all.
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: Words counted in a task before their counts are passed on.
HELD = 400_000
#: Edges of a level up to which they are broadcast.
EDGES = 250_000


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[bytes] = Counter()

    def passed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for run, n in Counter(RUN.findall((text or "").encode().lower())).items():
                    h = zlib.crc32(run, start)
                    if h % LOSES == 0:
                        word = run.decode()
                        k = h % len(word)
                        run = (word[:k] + word[k + 1 :]).encode()
                    held[run] += n
            if len(held) >= HELD:
                yield passed()
                held.clear()
    if held:
        yield passed()


def words(docs: DataFrame) -> DataFrame:
    """(word, n): the words of ``docs`` (doc_id, text) that are long and frequent enough.

    A null text has none; a null doc_id stands as an empty one. Tasks pass on
    sums, so that a frequent word costs a row for each task.
    """
    found = docs.select(doc_ids(docs)[0].alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_counts, "word string, n long")
    found = found.where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.sum("n").alias("n"))
    return found.where(F.col("n") >= LEAST_COUNT)


def _beginnings(word: str, turned: bool) -> list[int]:
    """64-bit names of a word's beginnings, from the empty one to the whole; other names for turned words."""
    h = int(turned)
    names = [h]
    for c in word:
        h = (h * 0x9E3779B97F4A7C15 + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        names.append(h - 2**64 if h >> 63 else h)
    return names


def _named(part: dict) -> dict:
    return part | {"k1": [_beginnings(w, t)[-1] for w, t in zip(part["word"], part["turned"])]}


def _prefixes(part: dict) -> dict:
    """A row for each beginning of a word: its name, and that of the beginning one character longer."""
    out: dict[str, list] = {k: [] for k in ("k1", "k2", "depth", "node", "child")}
    for word, turned, k2 in zip(part["word"], part["turned"], part["k2"]):
        names = _beginnings(word, turned)
        out["k1"] += [names[-1]] * len(names)
        out["k2"] += [k2] * len(names)
        out["depth"] += range(len(names))
        out["node"] += names
        out["child"] += [*names[1:], None]
    return out


def _bit(character: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(character) % 63)


def trie(named: DataFrame) -> DataFrame:
    """Edges (level, node, first, label, child, mask, ends) of the path-compressed tries over ``named`` (word, turned, k1, k2).

    A node is a beginning of words after which they differ or one ends, named
    by 64 bits; ``level`` counts the edges above it. ``first`` is the label's
    first character, ``ends`` tells that a word ends at the child, ``mask`` has
    a bit for each character that goes on from there. Nodes of equal name would
    only add paths, which the last comparison of words strikes out.
    """
    rows = materialize(by_batch(named.select("word", "turned", "k2"), _prefixes, "k1 long, k2 long, depth int, node long, child long"), "trie-prefixes")
    kept = rows.groupBy("node").agg(F.min("child").alias("least"), F.max("child").alias("most"), F.bool_or(F.col("child").isNull()).alias("ends"), F.min("depth").alias("top"))
    kept = materialize(kept.where("least <> most or ends or top = 0").select("node", "ends"), "trie-nodes")
    path = Window.partitionBy("k1", "k2").orderBy("depth")
    steps = rows.drop("child").join(bounded(kept), "node").select(
        "k1", "k2", "node", "depth", (F.row_number().over(path) - 1).alias("level"), *[F.lead(c).over(path).alias(to) for c, to in (("node", "child"), ("depth", "end"), ("ends", "ends"))]
    )
    edges = steps.where("child is not null").groupBy("level", "node", "child").agg(F.min(F.struct("depth", "end", "k1", "k2")).alias("by"), F.bool_or("ends").alias("ends"))
    edges = edges.select("level", "node", "child", "ends", "by.*").join(named.drop("turned"), ["k1", "k2"])
    label = F.col("word").substr(F.col("depth") + 1, F.col("end") - F.col("depth"))
    edges = materialize(edges.select("level", "node", "child", "ends", label.alias("label")).withColumn("first", F.left("label", F.lit(1))), "trie-labels")
    masks = edges.groupBy(F.col("node").alias("child")).agg(F.bit_or(_bit(F.col("first"))).alias("mask"))
    return materialize(edges.join(masks, "child", "left").withColumn("mask", F.coalesce("mask", F.lit(0).cast("long"))), "trie-edges")


def _stepped(states: DataFrame, edges: DataFrame) -> DataFrame:
    """The states one edge further down; the first ``intact`` characters of a word are not edited.

    An edit is a character replaced by a greater one, or one left out where the
    label first differs; so every pair of words has one way, from the word with
    the lesser character or the longer word. Within the intact part, and after
    an edit, only the edge that begins with the next character is looked up.
    """
    size = F.length("label")
    part, longer = F.col("word").substr(F.col("pos") + 1, size), F.col("word").substr(F.col("pos") + 1, size + 1)
    left = F.col("intact") - F.col("pos")
    keeps = (left <= 0) | ((left < size) & (F.left(part, left) == F.left("label", left)))
    one = lambda x: F.levenshtein(x, F.col("label"), 1) == 1
    same = part == F.col("label")
    replaced = keeps & (part < F.col("label")) & (F.length(part) == size) & ((size == 1) | one(part))
    left_out = keeps & ~same & (F.length(longer) == size + 1) & F.when(size == 1, F.right(longer, F.lit(1)) == F.col("label")).otherwise(one(longer))
    next_first = states.withColumn("first", F.col("word").substr(F.col("pos") + 1, F.lit(1)))
    narrow = next_first.where((F.col("edits") == 1) | (F.col("pos") < F.col("intact"))).join(edges, ["node", "first"])
    wide = states.where((F.col("edits") == 0) & (F.col("pos") >= F.col("intact"))).join(edges.drop("first"), "node")
    columns = ["word", "n", "intact", "pos", "edits", "label", "child", "mask", "ends"]
    met = narrow.select(columns).unionByName(wide.select(columns))
    pure = F.col("edits") == 0
    onward = lambda when, chars, edits: F.when(when, F.struct((F.col("pos") + chars).alias("pos"), F.lit(edits).alias("edits")))
    ways = F.array(F.when(same, F.struct((F.col("pos") + size).alias("pos"), F.col("edits").alias("edits"))), onward(pure & replaced, size, 1), onward(pure & left_out, size + 1, 1))
    moved = met.where(same | (pure & (replaced | left_out))).select("word", "n", "intact", "child", "mask", "ends", F.explode(F.array_compact(ways)).alias("to")).select("word", "n", "intact", "child", "mask", "ends", "to.*")
    rest = F.length("word") - F.col("pos")
    goes_on = _bit(F.col("word").substr(F.col("pos") + 1, F.lit(1))).bitwiseAND(F.col("mask")) != 0
    done = F.col("ends") & (rest + F.col("edits") == 1)
    live = (rest > 0) & ((F.col("edits") == 0) | goes_on)
    return moved.select("word", "n", "intact", F.col("child").alias("node"), "pos", "edits", done.alias("done"), live.alias("live")).where("done or live")


def near_words(found: DataFrame) -> DataFrame:
    """Pairs (a, n_a, b, n_b) of words of ``found`` (word, n) that differ by one inserted, deleted or replaced code point, each pair once.

    An edit in a word's second half is found in the trie of the words, one in
    the first half in that of the turned words, beside it: a frontier branches
    only where half of the word has led down already, and few words are left.
    """
    half = lambda word: F.floor(F.length(word) / 2).cast("int")
    way = lambda turned, word, intact: found.select(word.alias("word"), "n", F.lit(turned).alias("turned"), intact.alias("intact"))
    both = way(False, F.col("word"), half("word")).unionByName(way(True, F.reverse("word"), F.length("word") - half("word")))
    both = both.withColumn("k2", F.xxhash64("word", "turned"))
    named = materialize(by_batch(both, _named, "word string, n long, turned boolean, intact int, k2 long, k1 long"), "variant-words")
    edges = trie(named.drop("n", "intact"))
    states = named.select("word", "n", "intact", F.col("turned").cast("long").alias("node"), F.lit(0).alias("pos"), F.lit(0).alias("edits"))
    levels = []
    for level in range((edges.agg(F.max("level")).first()[0] or 0) + 1):
        here = bounded(edges.where(F.col("level") == level).drop("level"), EDGES)
        reached = materialize(_stepped(states, here), "variant-states")
        levels.append(reached.where("done").select("word", "n", "node"))
        states = reached.where("live").drop("done", "live")
    done = reduce(DataFrame.unionByName, levels).toDF("a", "n_a", "node")
    pairs = done.join(named.select(F.col("k1").alias("node"), F.col("word").alias("b"), F.col("n").alias("n_b"), "turned"), "node")
    pairs = pairs.where(F.levenshtein("a", "b", 1) == 1)
    for side in "ab":
        pairs = pairs.withColumn(side, F.when(F.col("turned"), F.reverse(side)).otherwise(F.col(side)))
    # one of several equal characters left out may count to either half; those of the words as they are come first
    return pairs.where(~F.col("turned") | (F.left("a", half("a")) != F.left("b", half("a")))).select("a", "n_a", "b", "n_b")


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of ``docs`` (doc_id, text).

    ``form`` is the word's most frequent near word, the least of several, if it
    is at least twice as frequent; ``root`` is what forms lead to in the end.
    Null and empty texts have no words, repeated rows count as often as they
    stand there, and no rows or no words give no rows. Other columns of
    ``docs`` are ignored. Words may be of any length.
    """
    found = materialize(words(docs), "variant-counts")
    pairs = materialize(near_words(found), "variant-pairs")
    both = pairs.select(F.col("a").alias("word"), F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("other")).alias("x"))
    both = both.unionByName(pairs.select(F.col("b").alias("word"), F.struct((-F.col("n_a")).alias("less"), F.col("a").alias("other")).alias("x")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min("x").alias("x"))
    formed = found.join(best, "word", "left").withColumn("takes", F.coalesce(-F.col("x.less") >= 2 * F.col("n"), F.lit(False)))
    formed = formed.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("takes"), F.col("x.other")).alias("form"), F.when(F.col("takes"), -F.col("x.less")).alias("form_n"))
    formed = materialize(formed, "variant-forms")
    to = materialize(formed.where("form is not null").select("word", F.col("form").alias("root")), "variant-roots")
    while True:  # each round follows twice as many forms; a form is at least twice as frequent, so there are few
        onward = bounded(to.toDF("root", "next"))
        far = materialize(to.join(onward, "root", "left").select("word", "root", "next"), "variant-roots")
        if far.where("next is not null").isEmpty():
            break
        to = far.select("word", F.coalesce("next", "root").alias("root"))
    return formed.join(bounded(to), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
