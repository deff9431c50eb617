"""Benchmark decontamination by templates.

Numbers, names and units of a text become typed placeholders; runs of template
tokens are joined by hash with those of the benchmark items. Matching runs that
lie on one diagonal of a text and an item are put together, and what the
placeholders stand for is compared: an item whose numbers or names were changed
still matches, if each of its values is replaced by the same value throughout,
and different ones by different ones. Only DataFrame functions are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, doc_ids, materialize
from .spans import let

#: Units of measure that are placeholders of their own (fixed values).
UNITS = """mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms lb lbs pound pounds
ounce ounces ton tons ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks
month months year years dollar dollars cent cents euro euros percent degree degrees meter meters metre metres kilometer
kilometers watt watts volt volts""".split()

#: Signs before a word that is a placeholder for a name, a number, a unit, and before one that is a name or a plain word.
NAME, NUMBER, UNIT, EITHER = "\u0001", "\u0002", "\u0003", "\u0004"
#: Stands for the apostrophe of a possessive.
OWN = "\u0005"
SIGNS = NAME + NUMBER + UNIT + EITHER + OWN
TAIL = r"[^\s\p{L}\p{N}]*+(?!\S)"
CAPITALISED = r"[(\"']?(\p{Lu}\p{Ll}+(?:\x05s)?)"
#: A capitalised word that does not begin a sentence; a number; a unit; any other capitalised word.
PLACEHOLDERS = (
    (NAME, r"(?<=[^\s.!?:]\s)" + CAPITALISED + TAIL),
    (NUMBER, r"(?<!\S)[-+(\"'$€£]*([0-9]+(?:[.,:/][0-9]+)*)%?" + TAIL),
    (UNIT, r"(?<!\S)((?i:" + "|".join(UNITS) + "))" + TAIL),
    (EITHER, r"(?<!\S)" + CAPITALISED + TAIL),
)
#: Template tokens in a run: a power of two, as runs are hashed by doubling. Fewest of them that are no placeholders.
RUN, LITERALS = 8, 4


def tokens(text: Column) -> Column:
    """Lower-cased words without punctuation, placeholders with their sign in front."""
    text = F.regexp_replace(text, r"(?<=\p{Ll})['’]s(?![\p{L}\p{N}])", OWN + "s")
    for sign, form in PLACEHOLDERS:
        text = F.regexp_replace(text, form, sign + "$1")
    plain = F.regexp_replace(text, r"[^\p{L}\p{N}\s\x01-\x05]+", "")
    return F.filter(F.split(F.lower(plain), r"\s+"), lambda w: w != "")


def _plain(word: Column) -> Column:
    """The word without signs."""
    return F.translate(word, SIGNS, "")


def _template(word: Column, named: bool) -> Column:
    """A placeholder's sign, or a word; a word that may be a name is taken for one if ``named``."""
    sign = F.substring(word, 1, 1)
    either = F.lit(NAME) if named else _plain(word)
    return F.when(sign < EITHER, sign).when(sign == EITHER, either).otherwise(_plain(word))


def _slot(word: Column) -> Column:
    """What a placeholder stands for: a name is the same in its possessive, at a sentence's beginning, and as a plain word."""
    sign = F.substring(word, 1, 1)
    value = F.regexp_replace(word, r"\x05s$", "")
    return F.when(sign < EITHER, value).when(sign == EITHER, F.concat(F.lit(NAME), F.substring(value, 2, 1 << 20))).otherwise(F.concat(F.lit(NAME), value))


def sequences(words: Column, length: int) -> Column:
    """A hash of each ``length`` words that follow each other, from pairs of hashes at doubling distances."""
    out = F.transform(words, lambda w: F.xxhash64(w))
    have = 1
    while have < length:
        by = min(have, length - have)
        out = let(out, _pairs(by))
        have += by
    return out


def runs(words: Column) -> Column:
    """(at, named, run): a hash of each run of ``RUN`` template tokens, and one with names for what may be names, where that differs."""
    read = lambda w, named: sequences(F.transform(w, lambda x: _template(x, named)), RUN)
    placed = lambda hashes, named: F.transform(hashes, lambda h, at: F.struct(at.alias("at"), F.lit(named).alias("named"), h.alias("run")))

    def both(w: Column) -> Column:
        any_either = F.exists(w, lambda x: F.substring(x, 1, 1) == EITHER)
        none = F.array().cast("array<struct<at:int,named:boolean,run:bigint>>")
        return let(placed(read(w, False), False), lambda a: F.concat(a, F.when(any_either, F.filter(placed(read(w, True), True), lambda x: F.get(a, x["at"])["run"] != x["run"])).otherwise(none)))

    return let(words, both)


def plain_words(text: Column) -> Column:
    """The :func:`tokens` of a text as plain words, without looking for placeholders."""
    plain = F.regexp_replace(text, r"[^\p{L}\p{N}\s]+", "")
    return F.filter(F.split(F.lower(plain), r"\s+"), lambda w: w != "")


def _next_to(hashes: Column, by: int) -> Column:
    """A hash of each two words ``by`` apart."""
    n = F.greatest(F.size(hashes) - by, F.lit(0))
    return F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, by + 1, n), lambda x, y: F.xxhash64(F.lit(by), x, y))


def anchors(words: Column, literal) -> Column:
    """(letters, hash) of two literal words of an array that are one or two apart, of those with the most letters; of a lone word by itself.

    Whoever holds the array as a run holds these two words at this distance. A
    run with literals in half of its places has two such words.
    """
    pair = lambda by: F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - by, F.lit(0))), F.slice(words, by + 1, F.greatest(F.size(words) - by, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b"), F.lit(by).alias("by")))
    both = F.filter(F.concat(pair(1), pair(2)), lambda p: literal(p["a"]) & literal(p["b"]))
    most = F.array_max(F.transform(both, lambda p: F.struct((F.length(_plain(p["a"])) + F.length(_plain(p["b"]))).alias("n"), p.alias("p"))))
    best = most["p"]
    own = lambda w: F.xxhash64(_plain(w))
    of_two = F.when(best["by"] == 1, F.xxhash64(F.lit(1), own(best["a"]), own(best["b"]))).otherwise(F.xxhash64(F.lit(2), own(best["a"]), own(best["b"])))
    key = F.when(best.isNotNull(), of_two).otherwise(F.xxhash64(F.lit(0), own(F.element_at(words, 1))))
    return F.struct(F.coalesce(most["n"], F.lit(0)).alias("letters"), key.alias("key"))


def _pairs(by: int):
    def of(a: Column) -> Column:
        n = F.greatest(F.size(a) - by, F.lit(0))
        return F.zip_with(F.slice(a, 1, n), F.slice(a, by + 1, n), lambda x, y: F.xxhash64(x, y))

    return of


def contaminated(docs: DataFrame, benchmark: DataFrame, min_runs: int = 5, min_share: float = 0.5) -> DataFrame:
    """(doc_id, item_id, runs, item_runs, slots, changed) of documents that hold an item of ``benchmark``.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text. A document
    holds an item if ``min_runs`` runs of eight template tokens, or
    ``min_share`` of the item's, match on one diagonal, and the placeholders
    there (``slots``, different values of the item) stand for each other one to
    one; ``changed`` of them have another value in the document. The diagonal
    of the most runs counts. A capitalised word that begins a sentence is read
    both as a name and as a plain word. Runs of fewer than four literal tokens
    are not looked for, as tables of numbers are full of them; an item without
    any other run, or shorter than a run, is held by a document that has all of
    its words, numbers and names in sequence (``runs`` and ``item_runs`` are 0).
    An item of one word is thus held by every text with this word.

    Null texts count as empty, and match nothing. Repeated documents come back
    as often as they came, repeated items count once. A null doc_id or item_id
    stays null. Empty tables give no rows. Other columns are ignored.
    """
    items = benchmark.select(F.col("item_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    items = items.withColumn("item", F.xxhash64("item_id", "text")).withColumn("item_words", tokens(F.col("text")))
    items = materialize(items.select("item", "item_id", "item_words"), "bench-items")
    window = F.slice("item_words", F.col("r.at") + 1, RUN)
    literal = F.size(F.filter(window, lambda w: w >= F.when(F.col("r.named"), OWN).otherwise(EITHER)))
    wanted = items.select("item", "item_words", F.explode(runs(F.col("item_words"))).alias("r")).where(literal >= LITERALS)
    is_literal = lambda w: w >= F.when(F.col("r.named"), OWN).otherwise(EITHER)
    wanted = materialize(wanted.select("r.run", "item", F.col("r.at").alias("item_at"), anchors(window, is_literal).alias("anchor")).distinct(), "bench-runs")
    totals = materialize(wanted.groupBy("item").agg(F.count_distinct("item_at").alias("item_runs")), "bench-totals")
    # of the runs that must match, any but one may be left out of the first search: those whose words have the fewest letters
    needed = F.least(F.lit(float(min_runs)), F.ceil(min_share * F.col("item_runs") - 1e-9).cast("double"))
    by_place = wanted.groupBy("item", "item_at").agg(F.min("anchor.letters").alias("letters"))
    placed = by_place.join(totals, "item").withColumn("nth", F.row_number().over(Window.partitionBy("item").orderBy("letters", "item_at")))
    sought = wanted.join(placed.where(F.col("nth") >= needed).select("item", "item_at"), ["item", "item_at"], "left_semi").select("anchor.key")
    short = items.join(wanted.select("item").distinct(), "item", "left_anti").where(F.size("item_words") > 0)
    short = short.select("item_id", F.size("item_words").alias("length"), F.transform("item_words", _plain).alias("plain"))
    short = materialize(short.withColumn("anchor", anchors(F.col("plain"), lambda w: F.lit(True))), "bench-short")

    # texts with two words that some run, or item without runs, has as well; all others hold nothing
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    every = docs.select(doc_ids(docs)[0], text)
    every = every.select("doc_id", "text", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit("second"), "text").alias("k2"))
    lone = not short.where("length = 1").isEmpty()
    near = lambda h: F.concat(_next_to(h, 1), _next_to(h, 2), *([F.transform(h, lambda x: F.xxhash64(F.lit(0), x))] if lone else []))
    spread = every.select("k1", "k2", F.explode(let(F.transform(plain_words(F.col("text")), lambda w: F.xxhash64(w)), near)).alias("anchor"))
    known = materialize(sought.union(short.select("anchor.key")).distinct().select(F.col("key").alias("anchor")), "bench-anchors")
    likely = materialize(spread.join(bounded(known), "anchor", "left_semi").select("k1", "k2").distinct(), "bench-likely")
    texts = every.join(bounded(likely), ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.first("text").alias("text"))
    texts = materialize(texts, "bench-texts")
    spread = texts.select("k1", "k2", F.explode(runs(tokens(F.col("text")))).alias("r")).select("k1", "k2", "r.at", "r.run")
    hits = spread.join(bounded(wanted.drop("anchor")), "run").select("k1", "k2", "at", "item", "item_at").distinct()
    hits = materialize(hits, "bench-hits")

    # diagonals that are long enough, then their placeholders
    near = hits.withColumn("diagonal", F.col("at") - F.col("item_at"))
    long_ones = near.groupBy("k1", "k2", "item", "diagonal").agg(F.count("*").alias("runs")).join(totals, "item")
    long_ones = long_ones.where((F.col("runs") >= min_runs) | (F.col("runs") >= min_share * F.col("item_runs")))
    near = near.join(long_ones, ["k1", "k2", "item", "diagonal"])
    lists = near.groupBy("k1", "k2").agg(F.collect_list(F.struct("at", "item", "item_at", "diagonal", "runs", "item_runs")).alias("own"))
    lists = materialize(lists, "bench-lists")
    held = texts.select("k1", "k2", "text").join(bounded(lists, items=F.size("own")), ["k1", "k2"])
    there = lambda words: F.transform("own", lambda h: F.struct(h.alias("h"), F.slice(words, h["at"] + 1, RUN).alias("there")))
    held = held.select("k1", "k2", F.explode(let(tokens(F.col("text")), there)).alias("x"))
    held = held.select("k1", "k2", "x.h.*", "x.there").join(items, "item")
    pairs = F.zip_with("there", F.slice("item_words", F.col("item_at") + 1, RUN), lambda t, i: F.struct(i.alias("i"), t.alias("t")))
    slots = F.transform(F.filter(pairs, lambda p: p["i"] < OWN), lambda p: F.struct(_slot(p["i"]).alias("i"), _slot(p["t"]).alias("t")))
    found = held.select("k1", "k2", "item", "item_id", "diagonal", "runs", "item_runs", F.explode_outer(slots).alias("slot"))
    found = found.groupBy("k1", "k2", "item", "item_id", "diagonal", "runs", "item_runs").agg(F.collect_set("slot").alias("slots"))
    one = lambda side: F.size(F.array_distinct(F.transform("slots", lambda s: s[side])))
    found = found.where((one("i") == F.size("slots")) & (one("t") == F.size("slots")))
    best = found.groupBy("k1", "k2", "item", "item_id").agg(
        F.max(F.struct("runs", "item_runs", F.size("slots").cast("long").alias("slots"), F.size(F.filter("slots", lambda s: s["i"] != s["t"])).cast("long").alias("changed"))).alias("best")
    )
    best = best.select("k1", "k2", "item_id", "best.*")

    # items without runs, as whole sequences
    lengths = sorted(r["length"] for r in short.select("length").distinct().collect())
    if lengths:
        keyed = lambda words, n: F.transform(sequences(words, n), lambda h: F.xxhash64(F.lit(n), h))
        own = [short.where(F.col("length") == n).select("item_id", F.explode(keyed(F.col("plain"), n)).alias("key")) for n in lengths]
        own = materialize(reduce(DataFrame.unionByName, own), "bench-keys")
        every_key = lambda words: F.array_distinct(F.concat(*[keyed(words, n) for n in lengths]))
        all_keys = texts.select("k1", "k2", F.explode(let(plain_words(F.col("text")), every_key)).alias("key"))
        whole = all_keys.join(bounded(own), "key").select("k1", "k2", "item_id").distinct()
        best = best.unionByName(whole.select("*", *[F.lit(0).cast("long").alias(c) for c in ("runs", "item_runs", "slots", "changed")]))
    best = materialize(best, "bench-found")
    return every.select("doc_id", "k1", "k2").join(best, ["k1", "k2"]).select("doc_id", "item_id", "runs", "item_runs", "slots", "changed")
