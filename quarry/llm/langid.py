"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary.
A word's probability in a language is the sum over all ways to cut it into
pieces, by a forward pass over its characters; a text's is the product over its
words. Spark adds the pieces' counts up by language; tasks score each distinct
word of a batch once, all words of a length and all languages at a time.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_batch
from .grams import HashArray

VOCABULARY = os.environ.get("QUARRY_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
MARK = "▁"
#: Pseudo-count of each piece, and the log probability of a character that no piece covers.
SMOOTH, UNKNOWN = 0.1, -25.0
#: About the inverse of a character's probability.
SCALE = 16.0


def load_model(path: str) -> bytes:
    """The vocabulary's file, as the driver reads it; tasks get its bytes."""
    with open(path, "rb") as f:
        return f.read()


def load_pieces(model: bytes) -> dict[str, int]:
    """The vocabulary's pieces of visible characters and their ids."""
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_proto=model)
    hidden = lambda i: own.is_control(i) or own.is_unknown(i) or own.is_byte(i) or own.is_unused(i)
    return {own.id_to_piece(i): i for i in range(own.get_piece_size()) if not hidden(i)}


def _extend(hashes: np.ndarray, characters: np.ndarray) -> np.ndarray:
    """Hashes of strings with one character more."""
    return hashes * np.uint64(0x9E3779B97F4A7C15) + characters.astype(np.uint64) + np.uint64(1)


def prefix_table(pieces: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Arrays of a HashArray: the id of each piece, and -1 for each other beginning of one."""
    ids = {p[:n]: -1 for p in pieces for n in range(1, len(p))} | pieces
    keys = []
    for text in ids:
        h = 0
        for c in text:
            h = (h * 0x9E3779B97F4A7C15 + ord(c) + 1) % 2**64
        keys.append(h)
    return HashArray.arrays(np.array(keys, np.uint64), np.array(list(ids.values()), np.float64))


def forward(words: list[str], table: HashArray, logp: np.ndarray, longest: int, most: int = 2_000_000) -> np.ndarray:
    """Natural log of each word's probability in each language: (words, languages).

    ``logp`` is (pieces, languages), ``longest`` the characters of the longest
    piece. Words of about one length go forward together, start by start: from
    each, pieces are followed as far as any begins like this. A single character
    can always be stepped over at ``UNKNOWN``. Sums are kept for as many places
    as a piece can reach, and brought back to 1 every few steps, so that words
    of any length stay within range. ``most`` bounds the sums held at a time.
    """
    langs, slots = logp.shape[1], longest + 1
    out = np.zeros((len(words), langs))
    p, step = np.exp(logp), np.exp(UNKNOWN) * SCALE
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    begin = 0
    while begin < len(order):
        n = max(1, min(len(order) - begin, most // (slots * max(1, langs))))
        while n > 1 and n * (len(words[order[begin + n - 1]]) + 1) > most:
            n //= 2
        at = order[begin : begin + n]
        begin += n
        ends = np.array([len(words[i]) + 1 for i in at])
        length = int(ends[-1])
        text = "".join((MARK + words[i]).ljust(length, "\0") for i in at).encode("utf-32-le", "surrogatepass")
        chars = np.frombuffer(text, np.uint32).reshape(n, length)
        ring, scale = np.zeros((slots, n, langs)), np.zeros((n, langs))
        ring[0] = 1.0
        for start in range(length):
            lo = int(np.searchsorted(ends, start, "right"))
            here = ring[start % slots, lo:].copy()
            ring[start % slots, lo:] = 0.0
            ring[(start + 1) % slots, lo:] += here * step
            alive, hashes = np.arange(lo, n), np.zeros(n - lo, np.uint64)
            for width in range(1, min(longest, length - start) + 1):
                hashes = _extend(hashes, chars[alive, start + width - 1])
                ids, known = table.find(hashes)
                alive, hashes, ids = alive[known], hashes[known], ids[known].astype(np.int64)
                if not len(alive):
                    break
                whole = ids >= 0
                rows, ids = alive[whole], ids[whole]
                if len(rows):
                    ring[(start + width) % slots, rows] += here[rows - lo] * (p[ids] * SCALE**width)
            hi = int(np.searchsorted(ends, start + 1, "right"))
            if hi > lo:
                out[at[lo:hi]] = np.log(ring[(start + 1) % slots, lo:hi]) + scale[lo:hi] - (start + 1) * np.log(SCALE)
            if start % 8 == 7 and hi < n:
                top = ring[:, hi:].max(axis=0)
                ring[:, hi:] /= top
                scale[hi:] += np.log(top)
    return out


def _checksum(doc_id: Column, mod: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(mod))


def piece_counts(docs: DataFrame, model: bytes) -> DataFrame:
    """(lang, piece, n): the vocabulary's own segmentation of all words, added up by language.

    A task holds one sum for each language and piece that it meets.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    loaded: list = []  # one for each task

    def run(batch: dict) -> Iterator[dict]:
        import sentencepiece

        if not loaded:
            loaded.append(sentencepiece.SentencePieceProcessor(model_proto=shared.value))
        model = loaded[0]
        by_lang: dict[str, Counter] = {}
        for lang, text in zip(batch["lang"], batch["text"]):
            by_lang.setdefault(lang, Counter()).update(text.split())
        for lang, found in by_lang.items():
            words = list(found)
            sums = np.zeros(model.get_piece_size(), np.int64)
            cut = model.encode(words, num_threads=1)
            sizes = np.fromiter(map(len, cut), np.int64, len(cut))
            weights = np.repeat(np.fromiter(found.values(), np.int64, len(found)), sizes)
            np.add.at(sums, np.fromiter((i for ids in cut for i in ids), np.int64, int(sizes.sum())), weights)
            used = np.flatnonzero(sums)
            yield {"lang": [lang] * len(used), "piece": used, "n": sums[used]}

    rows = by_batch(docs.select("lang", "text"), run, "lang string, piece int, n long", rows=10_000)
    return rows.groupBy("lang", "piece").agg(F.sum("n").alias("n"))


def identify(docs: DataFrame, folds: int = 5, path: str = VOCABULARY, words_at_once: int = 200_000) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs`` (doc_id, text, lang).

    Learns from the rows whose crc32(doc_id as text) mod ``folds`` is not 0 and
    whose lang and text are not null. ``score`` is the probability of the
    predicted language given the text, all languages being as likely before.
    A text that is null or has no letter is ``und`` with score 0, and so is
    every text if nothing was learnt. A null doc_id stays null and is neither
    held out nor learnt from. Repeated rows come back as often as they came. Ties
    go to the first language by code point. Other columns are ignored.

    Words of any length are scored whole. ``path`` is a file of the driver; what
    is broadcast is bounded by the vocabulary times the number of languages.
    """
    base = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    base = base.withColumn("held_out", F.coalesce(_checksum(F.col("doc_id"), folds) == 0, F.lit(False)))
    learn = base.where("not held_out and doc_id is not null and lang is not null and text is not null")
    model = load_model(path)
    table = piece_counts(learn, model).toArrow().to_pandas()
    pieces = load_pieces(model)
    longest = max(map(len, pieces))
    langs = sorted(table["lang"].unique())
    sums = np.zeros((max(pieces.values()) + 1, len(langs)))
    kept = table[table["piece"].isin(list(pieces.values()))]
    sums[kept["piece"], [langs.index(x) for x in kept["lang"]]] = kept["n"]
    own = np.zeros(len(sums), bool)
    own[list(pieces.values())] = True
    sums[own] += SMOOTH
    with np.errstate(divide="ignore"):
        logp = np.log(sums) - np.log(sums.sum(axis=0, keepdims=True))
    shared = docs.sparkSession.sparkContext.broadcast((*prefix_table(pieces), langs, logp))

    tables: list[HashArray] = []  # one for each task

    def run(batch: dict) -> Iterator[dict]:
        hashes, values, langs, logp = shared.value
        if not tables:
            tables.append(HashArray(hashes, values))
        pieces = tables[0]
        texts = batch["text"]
        total = np.zeros((len(texts), len(langs)))
        lettered = [bool(t) and any(map(str.isalpha, t)) for t in texts]
        index: dict[str, int] = {}
        rows: list[int] = []
        ids: list[int] = []
        times: list[int] = []

        def flush() -> None:
            by_word = forward(list(index), pieces, logp, longest)
            for k in range(len(langs)):
                total[:, k] += np.bincount(rows, weights=by_word[ids, k] * times, minlength=len(texts))
            index.clear(), rows.clear(), ids.clear(), times.clear()

        if langs:
            for row, text in enumerate(texts):
                if lettered[row]:
                    for w, n in Counter(text.split()).items():
                        rows.append(row), times.append(n)
                        ids.append(index.setdefault(w, len(index)))
                    if len(index) >= words_at_once:
                        flush()
            if index:
                flush()
        best = total.argmax(axis=1) if langs else np.zeros(len(texts), int)
        above = total - total.max(axis=1, keepdims=True) if langs else total
        score = 1 / np.exp(above).sum(axis=1) if langs else np.zeros(len(texts))
        known = [ok and bool(langs) for ok in lettered]
        return {
            "doc_id": batch["doc_id"],
            "held_out": batch["held_out"],
            "lang_pred": [langs[b] if ok else "und" for b, ok in zip(best, known)],
            "score": [float(s) if ok else 0.0 for s, ok in zip(score, known)],
        }

    return by_batch(base.drop("lang"), run, "doc_id long, held_out boolean, lang_pred string, score double", rows=10_000)
