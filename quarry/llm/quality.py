"""Quality rules: counts of a text's own make-up, and an n-gram perplexity band for each language.

The model is a modified Kneser-Ney model over bytes. Spark counts the n-grams
of all documents and carries the recursion out as windows and joins over the
table of distinct n-grams; tasks look log probabilities up in sorted hash
arrays. Bytes keep that table bounded by the writing systems in use rather than
by the vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import grams
from .common import bounded, by_batch, doc_ids, materialize
from .simhash import shingle_hashes

ORDER = 5
#: Characters that count as symbols (fixed values).
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\r\x0b\x0c"


def discounts(table: DataFrame, column: str = "n") -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney from the counts of counts of a table's column."""
    n1, n2, n3, n4 = table.agg(*[F.count_if(F.col(column) == k) for k in (1, 2, 3, 4)]).first()
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    ratio = lambda a, b: a / b if b else 1.0
    raw = (1 - 2 * y * ratio(n2, n1), 2 - 3 * y * ratio(n3, n2), 3 - 4 * y * ratio(n4, n3))
    return tuple(min(max(d, 0.1), k + 0.9) for k, d in enumerate(raw))


def kneser_ney(counts: DataFrame, order: int = ORDER, columns: tuple[str, ...] = ("n",)) -> DataFrame:
    """(code, value..., n...): log10 probability of the last byte of each n-gram of (code, n...), in a model for each column of counts.

    The highest order uses the counts, lower ones the number of distinct bytes
    seen before; the lowest is mixed with a uniform byte. An n-gram that a model
    has not seen gets what the lower orders give it, all of it where the context
    is unseen too. Values are named value, value1 and so on.
    """
    last = lambda code, m: code.bitwiseAND(F.lit((1 << 8 * m) - 1))
    tables = {order: counts.select("code", *columns)}
    for m in range(order - 1, 0, -1):
        seen = [F.count_if(F.col(n) > 0).alias(n) for n in columns]
        tables[m] = materialize(tables[m + 1].groupBy(last(F.col("code"), m).alias("code")).agg(*seen), f"kn-{m}")
    lower = None
    for m in range(1, order + 1):
        context = Window.partitionBy(F.shiftright("code", 8))
        parts = []
        for i, n in enumerate(columns):
            d1, d2, d3 = discounts(tables[m], n)
            off = F.when(F.col(n) == 0, 0.0).when(F.col(n) == 1, d1).when(F.col(n) == 2, d2).otherwise(d3)
            whole = F.sum(n).over(context)
            parts += [F.when(whole > 0, (F.col(n) - off) / whole).otherwise(0.0).alias(f"own{i}"), F.when(whole > 0, F.sum(off).over(context) / whole).otherwise(1.0).alias(f"back{i}")]
        rows = tables[m].select("code", *columns, *parts)
        if lower is None:
            rows = rows.select("*", *[F.lit(1 / 256).alias(f"below{i}") for i in range(len(columns))])
        else:
            rows = rows.withColumn("suffix", last(F.col("code"), m - 1)).join(lower, "suffix").drop("suffix")
        lower = rows.select("code", *columns, *[(F.col(f"own{i}") + F.col(f"back{i}") * F.col(f"below{i}")).alias(f"p{i}") for i in range(len(columns))])
        if m < order:
            lower = materialize(lower.select(F.col("code").alias("suffix"), *[F.col(f"p{i}").alias(f"below{i}") for i in range(len(columns))]), f"kn-p{m}")
    return lower.select("code", *[F.log10(f"p{i}").alias(f"value{i or ''}") for i in range(len(columns))], *columns)


def repeated_words(texts: list[bytes], window: int = 8) -> np.ndarray:
    """For each text, the words in windows of ``window`` words that occur twice or more in it.

    Windows are compared by a 64-bit hash of their words and of the text they
    are in.
    """
    out = np.zeros(len(texts), np.int64)
    held: list[int] = []
    owners: list[tuple[int, int]] = []

    def flush() -> None:
        sizes = np.array([n for _, n in owners])
        h = grams.mixed(np.array(held, np.int64).view(np.uint64))
        total = len(h) - window + 1
        key = np.repeat(grams.mixed(np.arange(1, len(sizes) + 1)), sizes)[:total]
        for j in range(window):
            key = key * np.uint64(0x9E3779B97F4A7C15) + h[j : total + j]
        begins = np.r_[0, np.cumsum(sizes)[:-1]]
        inside = np.repeat(begins + sizes - window, sizes)[:total] >= np.arange(total)
        starts = np.flatnonzero(inside)
        _, at, n = np.unique(key[starts], return_inverse=True, return_counts=True)
        starts = starts[n[at] > 1]
        edge = np.zeros(len(h) + 1, np.int64)
        edge[starts] += 1
        edge[starts + window] -= 1
        covered = (np.cumsum(edge)[:-1] > 0).astype(np.int64)
        out[[row for row, _ in owners]] = np.add.reduceat(covered, begins)
        held.clear(), owners.clear()

    for row, text in enumerate(texts):
        found = text.split()
        if len(found) > window:
            held.extend(map(hash, found))
            owners.append((row, len(found)))
            if len(held) > 300_000:
                flush()
    if owners:
        flush()
    return out


def repeated_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.strip(SPACES)]
    return len(lines) - len(set(lines))


def sketch(text: str | None) -> int:
    """The least hash of the text's five-word shingles; copies share it, near copies mostly."""
    return min(shingle_hashes(text, 5), default=0) >> 1


FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
#: Texts that train no model: of fewer words, or of more symbols or capitals, as shares of their bytes.
TRAINING_WORDS, TRAINING_SYMBOLS, TRAINING_CAPITALS = 20, 0.01, 0.3
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _language(lang: Column) -> Column:
    return F.when(lang.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), lang))


def trains(raw: bytes) -> bool:
    share = lambda of: (len(raw) - len(raw.translate(None, of))) / max(1, len(raw))
    return len(raw.split()) >= TRAINING_WORDS and share(SYMBOLS) <= TRAINING_SYMBOLS and share(CAPITALS) <= TRAINING_CAPITALS


def training_class(text: str | None) -> int:
    """1 or 2 for the model that a text trains, 0 if it trains none."""
    return 1 + (sketch(text) & 1) if text and trains(text.encode()) else 0


def quality(docs: DataFrame, width: float = 7.0, short: float = 150.0, order: int = ORDER, most_broadcast: int = 1 << 20, least: float = 0.03, below: float = 2.0) -> DataFrame:
    """Counts, perplexity and verdict for every row of ``docs`` (doc_id, text, lang).

    There are two models: texts are dealt to them by their :func:`sketch`, and
    each is scored by the model that it, its copies and most of its near copies
    did not train. Texts that are short, or full of symbols or capitals, train
    none. The band of a language and model reaches from the median of log
    perplexity, over its documents that pass the base rules, ``width`` times as
    far as the lower quartile does, and ``least`` at least; outside of it a
    document is rejected. It reaches ``below`` times as far down as up, as near
    copies that trained the other model are the better foreseen. So junk widens no band before it is half of a
    language. Texts that share their sketch count once, so that copies, however
    many, leave the band to the other texts. The mean over a short text varies
    more, so a text of n words has sqrt(1 + ``short`` / n) times that width. A
    null language is a language of its own. A null text counts as empty; such a text has no words
    and so fails the base rules. Repeated rows come back as often as they came;
    no rows give no rows. A null doc_id is kept. Other columns are ignored.
    """
    doc_id, kind = doc_ids(docs)
    base = docs.select(doc_id, F.col("text").cast("string"), F.col("lang").cast("string"))
    encode = lambda t: (t or "").encode()
    table = materialize(grams.count_classes(base, order, encode, training_class), "kn-counts")
    model = kneser_ney(table, order, ("n0", "n1")).join(table.select("code", "n"), "code")
    hot, rest = grams.split_by_count(materialize(model, "kn-model"), most_broadcast, ("value", "value1"))
    shared = docs.sparkSession.sparkContext.broadcast(hot)
    models: list[grams.HashArray] = []  # one for each task

    def run(batch: dict) -> Iterator[dict]:
        if not models:
            models.append(grams.HashArray(*shared.value))
        model = models[0]
        for at in range(0, len(batch["text"]), 500):
            ids, texts, langs = (batch[c][at : at + 500] for c in ("doc_id", "text", "lang"))
            raw = [encode(t) for t in texts]
            sketches = [sketch(t) for t in texts]
            other = [int(not s & 1) for s in sketches]  # the model that the text did not train
            sums, number, cold = grams.look_up(raw, order, model, other)
            yield {
                "doc_id": ids,
                "lang": langs,
                "n_words": [len(b.split()) for b in raw],
                "word_chars": [len(t or "") - len(b) + len(b.translate(None, SPACES)) for t, b in zip(texts, raw)],
                "n_symbols": [len(b) - len(b.translate(None, SYMBOLS)) for b in raw],
                "n_dup_lines": [repeated_lines(b) for b in raw],
                "n_repeat_words": repeated_words(raw),
                "log10_p": sums,
                "n_grams": number,
                "cold": cold,
                "_sketch": sketches,
                "_model": other,
            }

    schema = f"doc_id {kind}, lang string, {FEATURES}, log10_p double, n_grams long, cold array<long>, _sketch long, _model int"
    scored = materialize(by_batch(base, run, schema).withColumn("_row", F.monotonically_increasing_id()), "quality-scores")
    if rest is not None:
        rest = rest.select("code", F.explode(F.array(*[F.struct(F.lit(i).alias("_model"), F.col(v).alias("value")) for i, v in enumerate(("value", "value1"))])).alias("x")).select("code", "x.*")
    scored = grams.add_cold(scored, rest, "log10_p", "cold", along=("_model",))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    scored = scored.withColumn("base_failed", failed).withColumn("log10_perplexity", F.round(-F.col("log10_p") / F.col("n_grams"), 9))
    scored = scored.withColumn("_lang", _language(F.col("lang")))
    alike = scored.where(~F.col("base_failed")).groupBy("_lang", "_model", "_sketch")
    alike = alike.agg(((F.min("log10_perplexity") + F.max("log10_perplexity")) / 2).alias("log10_perplexity"))
    quartiles = alike.groupBy("_lang", "_model").agg(F.percentile_approx("log10_perplexity", F.array(F.lit(0.25), F.lit(0.5)), 10_000).alias("q"))
    low, middle = F.col("q")[0], F.col("q")[1]
    beyond = F.greatest(width * (middle - low), F.lit(least)) * F.sqrt(1 + short / F.greatest("n_words", F.lit(1)))
    inside = F.col("log10_perplexity").between(F.col("band_low"), F.col("band_high"))
    return (
        scored.join(bounded(materialize(quartiles, "quality-bands")), ["_lang", "_model"], "left")
        .withColumn("band_low", middle - below * beyond)
        .withColumn("band_high", middle + beyond)
        .withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))
        .drop("_lang", "_model", "_row", "_sketch", "n_grams", "q")
    )
