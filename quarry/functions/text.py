"""Text expressions: folding, occurrences, excerpts, scripts."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Hiragana U+3041..U+3096 and the katakana 0x60 above them.
HIRAGANA = "".join(map(chr, range(0x3041, 0x3097)))
KATAKANA = "".join(chr(ord(c) + 0x60) for c in HIRAGANA)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def to_katakana(text: Column) -> Column:
    return F.translate(text, HIRAGANA, KATAKANA)


def to_hiragana(text: Column) -> Column:
    return F.translate(text, KATAKANA, HIRAGANA)


def fold(text: str) -> str:
    """Compatibility forms and cases made one: full-width letters, ligatures, sharp s."""
    return unicodedata.normalize("NFKC", text).casefold()


@F.pandas_udf(StringType())
def folded(text: pd.Series) -> pd.Series:
    """:func:`fold` of a column; null stays null."""
    return text.map(lambda t: unicodedata.normalize("NFKC", t).casefold(), na_action="ignore")


def expanded(query: Column, terms: Column, entries: list[str], most: int) -> Column:
    """The query and an array of terms to search for beside it, ``most`` in all; see :func:`quarry.operators.snippets.expansion_terms`."""
    kana = str.maketrans(HIRAGANA, KATAKANA)
    bad = [e for e in (fold(e).translate(kana) for e in entries) if e]

    @F.pandas_udf("array<string>")
    def kept(query: pd.Series, terms: pd.Series) -> pd.Series:
        plain = lambda w: unicodedata.normalize("NFKC", w).casefold().translate(kana)
        left = lambda t: " ".join(w for w in t.split() if (p := plain(w)) and not any(b in p for b in bad))

        def one(own: str | None, other: list[str] | None) -> list[str]:
            own = (own or "").strip()
            if not own:
                return []
            once: dict[str, str] = {}
            for t in (left(t) for t in (other if other is not None else []) if t is not None):
                if t:
                    once.setdefault(t.lower(), t)
            first = list(once.values())[:most]
            return first if own.lower() in {t.lower() for t in first} else [own, *first[: most - 1]]

        return pd.Series([one(*x) for x in zip(query, terms)])

    return kept(query, terms)


def words(text: Column) -> Column:
    """Lower-cased runs of word characters, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\w+)"))


def occurrences(text: Column, term: Column) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("long")


def overlapping(text: Column, term: Column) -> Column:
    """Occurrences of a literal, those that overlap each other too."""
    quoted = F.concat(F.lit("(?=\\Q"), F.replace(term, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))
    return F.regexp_count(text, quoted)


def excerpt(text: Column, at: Column, length: Column, around: int = 80) -> Column:
    """The text ``around`` characters on either side of [at, at + length), at from 1, with ellipses where it is cut."""
    start = F.greatest(F.lit(1), at - around)
    end = F.least(F.length(text), at + length + around - 1)
    cut = F.substring(text, start, end - start + 1)
    return F.concat(F.when(start > 1, "…").otherwise(""), cut, F.when(end < F.length(text), "…").otherwise(""))


def positions(text: Column, term: Column) -> Column:
    """Starts (from 0) of the non-overlapping occurrences of a literal, as an array."""
    gaps = F.transform(F.split(text, F.concat(F.lit("\\Q"), term, F.lit("\\E")), -1), F.length)
    gaps = F.slice(gaps, 1, F.greatest(F.size(gaps) - 1, F.lit(0)))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
    step = lambda acc, g: F.struct((acc["at"] + g + F.length(term)).alias("at"), F.concat(acc["all"], F.array(acc["at"] + g)).alias("all"))
    return F.aggregate(gaps, start, step, lambda acc: acc["all"])


def script(text: Column) -> Column:
    """kanji, hiragana, katakana, latin or other: whichever most characters are of, in this order for ties."""
    classes = {"kanji": r"[一-鿿]", "hiragana": r"[ぁ-ゟ]", "katakana": r"[゠-ヿ]", "latin": r"[A-Za-zÀ-ɏ]"}
    counts = [F.regexp_count(text, F.lit(p)) for p in classes.values()]
    top = F.greatest(*counts)
    out = F.lit("other")
    for name, n in reversed(list(zip(classes, counts))):
        out = F.when((n == top) & (top > 0), name).otherwise(out)
    return out


def token_estimate(text: Column) -> Column:
    """Language-model tokens: one for each CJK character, one for each 3.7 others and one at least."""
    cjk = F.regexp_count(text, F.lit(r"[぀-ヿ㐀-鿿가-힯]"))
    rest = F.length(text) - cjk
    return cjk + F.when(rest > 0, F.greatest(F.lit(1), F.bround(rest / 3.7).cast("int"))).otherwise(0)


#: Parts of a text that say much: a number with its unit, runs of kanji, katakana and latin letters, numbers (fixed pattern).
SALIENT = r"[0-9]+(?:\.[0-9]+)?[一-龥ァ-ヴー%]|[一-龥々]+|[ァ-ヴー]+|[A-Za-z][A-Za-z0-9]+|[0-9]+(?:\.[0-9]+)?"


def salient_tokens(text: Column, most: int = 20) -> Column:
    """The first different salient parts of two characters or more."""
    return F.slice(F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(f"({SALIENT})")), lambda t: F.length(t) >= 2)), 1, most)


def splits_number(text: Column, at: Column) -> Column:
    """Whether a break before the character ``at`` (from 0) would cut a number, with its separators, in two."""
    before, after = F.substring(text, F.lit(1), at), F.substring(text, at + 1, F.length(text))
    inside = (F.regexp_like(before, F.lit("[0-9]$")) & F.regexp_like(after, F.lit("^(?:[0-9]|[.,:：][0-9])"))) | (F.regexp_like(before, F.lit("[0-9][.,:：] ?$")) & F.regexp_like(after, F.lit("^[0-9]")))
    return F.coalesce((at > 0) & (at < F.length(text)) & inside, F.lit(False))
