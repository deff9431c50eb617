"""Secret scanning: known forms, and a battery of randomness tests for the rest.

A long token is taken for random unless its symbols are unevenly used
(chi-squared over groups of an alphabet, large enough for the statistic's
distribution to hold), its kinds of characters alternate too seldom or too often
(runs), or neighbours are correlated. Under randomness the combined p-value is
uniform; structured tokens crowd near zero. Tokens of one encoding and length
class share a threshold on it that bounds the share of structured tokens, that
is of false secrets, among those beyond it. Only DataFrame functions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .spans import count_kind, let, matches, ordered, printed

KINDS = ["assign", "access", "hex", "random"]

# The known forms (fixed values). Look-behinds replace matches that would fail
# by their length alone.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = r"""(?s)^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
#: Tokens that are tested for randomness, and what in them is no symbol.
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+"
SEPARATORS = r"[+/_=-]+"

DIGITS, VOWELS, COMMON, OTHERS = "0123456789", "aeiou", "dhlnrst", "bcfgjkmpqvwxyz"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LETTERS = VOWELS + COMMON + OTHERS
#: Encodings from the smallest on: what its tokens look like, groups of symbols, kinds whose runs count, symbols in order, fewest symbols.
#: Letters of one case alone need the most, as long words have them too. A token without a letter is in none of them.
ENCODINGS = {
    "hex": (r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$", ("01234", "56789", "abc", "def"), (DIGITS, "abcdef"), "0123456789abcdef", 16),
    "base36": (r"^(?=.*[0-9])(?=.*[a-z])[0-9a-z]+$", (DIGITS, VOWELS, COMMON, OTHERS), (DIGITS, LETTERS), DIGITS + "".join(sorted(LETTERS)), 16),
    "base26": (r"^[a-z]+$", (VOWELS, COMMON, OTHERS), (VOWELS, COMMON + OTHERS), "".join(sorted(LETTERS)), 32),
    "base52": (r"^[a-zA-Z]+$", (VOWELS, COMMON, OTHERS, UPPER), (LETTERS, UPPER), UPPER + "".join(sorted(LETTERS)), 20),
    "base62": (r"^[a-zA-Z0-9]+$", (DIGITS, VOWELS, COMMON, OTHERS, UPPER), (DIGITS, LETTERS, UPPER), UPPER + "".join(sorted(LETTERS)) + DIGITS, 16),
}
#: Bins of the p-value, and the least one that is ever taken for random.
BINS, FLOOR = 100, 1


def normal_tail(z: Column) -> Column:
    """Upper tail of the standard normal distribution, to about 1e-7 (a standard rational approximation)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _count(text: Column, symbols: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, symbols, ""))).cast("double")


def _chi_squared(text: Column, n: Column, groups: tuple[str, ...]) -> Column:
    """Upper tail for how evenly the groups are used (Wilson-Hilferty)."""
    total, df = sum(map(len, groups)), len(groups) - 1
    chi = sum((F.pow(_count(text, g) - n * (len(g) / total), F.lit(2.0)) / (n * (len(g) / total)) for g in groups), F.lit(0.0))
    return normal_tail((F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))


def _runs(text: Column, n: Column, kinds: tuple[str, ...]) -> Column:
    """Both tails for the number of places where the kind of character changes."""
    total = sum(map(len, kinds))
    q, r = (sum((len(k) / total) ** e for k in kinds) for e in (2, 3))
    signs = "xyz"[: len(kinds)]
    same = F.translate(text, "".join(kinds), "".join(s * len(k) for s, k in zip(signs, kinds)))
    changes = F.regexp_count(same, F.lit("|".join(f"{s}+" for s in signs))) - 1
    variance = (n - 1) * (q * (1 - q)) + 2 * (n - 2) * (r - q * q)
    return 2 * normal_tail(F.abs((changes - (n - 1) * (1 - q)) / F.sqrt(variance)))


def _serial(text: Column, symbols: str) -> Column:
    """Both tails for the correlation of neighbouring symbols' numbers."""
    middle = (len(symbols) - 1) / 2
    index = F.transform(F.split(text, ""), lambda c: F.instr(F.lit(symbols), c) - 1 - middle)

    def of(x: Column) -> Column:
        n = F.size(x).cast("double")
        total = F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
        squares = F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v)
        neighbours = F.aggregate(F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x) - 1), lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
        spread, ends = squares - total * total / n, F.element_at(x, 1) + F.element_at(x, -1)
        cross = neighbours - total / n * (2 * total - ends) + (n - 1) * F.pow(total / n, F.lit(2.0))
        return F.when(spread > 0, 2 * normal_tail(F.abs((cross / spread + 1 / n) * F.sqrt(n)))).otherwise(F.lit(0.0))

    return let(index, of)


def tested(token: Column) -> Column:
    """(encoding, n, p) of a token by its smallest encoding; null if it has too few symbols, or no letter."""

    def of(plain: Column) -> Column:
        out = F.lit(None).cast("struct<encoding:string,n:int,p:double>")
        n = F.length(plain).cast("double")
        for name, (form, groups, kinds, symbols, fewest) in reversed(ENCODINGS.items()):
            tails = [_chi_squared(plain, n, groups), _runs(plain, n, kinds), _serial(plain, symbols)]
            p = 1 - F.pow(1 - F.least(F.lit(1.0), *tails), F.lit(3.0))
            found = F.when(n >= fewest, F.struct(F.lit(name).alias("encoding"), F.length(plain).alias("n"), p.alias("p")))
            out = F.when(F.regexp_like(plain, F.lit(form)), found).otherwise(out)
        return F.when(F.regexp_like(plain, F.lit("[a-z]|[A-Z]")), out)

    plain = F.regexp_replace(token, SEPARATORS, "")
    one_case = F.when(F.regexp_like(plain, F.lit("[a-z]")), plain).otherwise(F.lower(plain))
    return let(one_case, of)


def _bin(p: Column) -> Column:
    return F.least(F.lit(BINS - 1), F.floor(p * BINS)).cast("int")


def scan(docs: DataFrame, rate: float = 0.05) -> DataFrame:
    """(doc_id, base, spans) for every row of ``docs`` (doc_id, text): arrays of (at, end, kind, value).

    ``base`` has the known forms; ``spans`` adds tokens that the battery takes
    for random and that no known form overlaps. Of the tokens of one encoding
    and length class (doubling lengths), twice those with p-values of 1/2 or
    more are the estimate of how many are random, evenly spread over all
    p-values; the threshold is the least p-value, 0.01 or more, beyond which the
    excess over that even spread is at most ``rate`` of the tokens, or else 1/2.
    Upper-case tokens are tested as lower-case ones.
    Null texts count as empty. Repeated rows come back as often as they came; a
    null doc_id stays null; no rows give no rows. Other columns are ignored.
    One row for each encoding and length class reaches the driver.
    """
    text = F.col("text")
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    assign = F.filter(matches(text, ASSIGN, "assign"), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN_VALUE, 1)) >= 6)
    access = F.filter(matches(text, ACCESS, "access"), lambda s: F.length(s["value"]) >= 20)
    rows = rows.withColumn("base", F.concat(assign, access, matches(text, HEX, "hex"))).withColumn("tokens", matches(text, TOKEN, "random"))
    tokens = F.filter("tokens", lambda t: ~F.exists("base", lambda b: (b["at"] < t["end"]) & (t["at"] < b["end"])))
    tokens = F.filter(F.transform(tokens, lambda t: F.struct(t.alias("span"), tested(t["value"]).alias("test"))), lambda t: t["test"].isNotNull())
    tokens = F.transform(tokens, lambda t: F.struct(t["span"].alias("span"), t["test"]["encoding"].alias("encoding"), F.floor(F.log2(t["test"]["n"])).cast("int").alias("scale"), _bin(t["test"]["p"]).alias("bin")))
    rows = materialize(rows.select("doc_id", "base", tokens.alias("tokens")), "secret-spans")

    found = rows.select(F.explode("tokens").alias("t")).groupBy("t.encoding", "t.scale", "t.bin").count()
    own = Window.partitionBy("encoding", "scale")
    beyond = F.sum("count").over(own.orderBy(F.desc("bin")))
    random = 2 * F.sum(F.when(F.col("bin") >= BINS // 2, F.col("count")).otherwise(0)).over(own)
    ranked = found.withColumn("beyond", beyond).withColumn("even", random * (1 - F.col("bin") / BINS))
    passed = ranked.where((F.col("bin") >= FLOOR) & ((F.col("bin") >= BINS // 2) | (F.col("beyond") - F.col("even") <= rate * F.col("beyond"))))
    limits = passed.groupBy("encoding", "scale").agg(F.min("bin").alias("bin")).collect()
    named = {(r["encoding"], r["scale"]): r["bin"] for r in limits}
    key = lambda t: F.concat_ws(":", t["encoding"], t["scale"])
    table = F.create_map(*[x for (e, s), b in named.items() for x in (F.lit(f"{e}:{s}"), F.lit(b))]) if named else F.create_map().cast("map<string,int>")
    kept = F.filter("tokens", lambda t: t["bin"] >= F.coalesce(table[key(t)], F.lit(BINS)))
    spans = F.concat("base", F.transform(kept, lambda t: t["span"]))
    return rows.select("doc_id", ordered(F.col("base"), KINDS).alias("base"), ordered(spans, KINDS).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """The counts and printed spans of :func:`scan`."""
    return found.select(
        "doc_id",
        *[count_kind(F.col("base"), k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(printed(F.col("base")), 256).alias("base_sha256"),
        printed(F.col("spans")).alias("spans"),
    )
