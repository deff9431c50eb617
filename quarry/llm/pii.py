"""Personal data: entities of known form, and terms that reveal them.

Corpus co-occurrence tells how much a word in a text says about an entity in it:
the pointwise mutual information of the two over the entity's own information
content, 1 if the word never comes without it. Words beyond a first threshold
are generalised, beyond a second removed, throughout the texts that hold the
entity. Texts that are copies or near copies of each other are one support, so
that a text's copies do not make its words reveal what it holds. Only DataFrame
functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, bounded, materialize, words
from .spans import count_kind, let, matches, ordered, printed

KINDS = ["email", "ip", "card", "phone", "term"]

# The known forms (fixed values). Look-behinds and possessive runs give the same
# matches as plain ones in linear time, and card runs of 12 to 19 digits only.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
IP_RANGE = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: A term: a run of three letters or more.
TERM = r"\p{L}{3,}+"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits pass the Luhn check."""
    from_right = F.transform(F.split(F.reverse(digits(value)), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).when(c.cast("int") > 4, 2 * c.cast("int") - 9).otherwise(2 * c.cast("int")))
    return F.aggregate(from_right, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def entities(text: Column) -> Column:
    """Entities of known form as an array of (at, end, kind, value)."""
    email = matches(text, EMAIL, "email", F.contains(text, F.lit("@")))
    ip = F.filter(matches(text, IP, "ip"), lambda s: F.regexp_like(s["value"], F.lit(IP_RANGE)))
    card = F.filter(matches(text, CARD, "card"), lambda s: luhn(s["value"]))
    phone = F.filter(matches(text, PHONE, "phone", F.contains(text, F.lit("+"))), lambda s: F.length(digits(s["value"])).between(9, 15))
    return F.concat(email, ip, card, phone)


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})")))


def _share(texts: int) -> Column:
    """Mutual information of a value and a term over the value's information content, from counts of texts."""
    content = F.log2(F.lit(float(texts)) / F.col("with_value"))
    mutual = F.log2(F.col("both") * F.lit(float(texts)) / (F.col("with_value") * F.col("with_term")))
    return F.when(content > 0, mutual / content).otherwise(0.0)


def _without(text: Column, spans: Column) -> Column:
    """The text with a space for each span."""
    return replaced(text, spans, lambda s: F.lit(" "))


def _sketch(text: Column) -> Column:
    """The least hash of the text's runs of eight words; copies share it, near copies mostly."""

    def runs(out: Column) -> Column:
        for by in (1, 2, 4):
            out = let(out, lambda a, by=by: F.zip_with(F.slice(a, 1, F.greatest(F.size(a) - by, F.lit(0))), F.slice(a, by + 1, F.greatest(F.size(a) - by, F.lit(0))), lambda x, y: F.xxhash64(x, y)))
        return F.array_min(out)

    return F.coalesce(runs(F.transform(words(ascii_lower(text)), lambda w: F.xxhash64(w))), F.xxhash64(text))


def term_counts(rows: DataFrame) -> tuple[DataFrame, int]:
    """(term, with_term): how many different texts of ``rows`` (k1, k2, text) have a term; and the number of texts."""
    keys = materialize(rows.groupBy("k1", "k2").agg(F.count("*").alias("n")), "pii-keys")
    again = bounded(keys.where("n > 1").select("k1", "k2"))
    narrow = rows.select("k1", "k2", "text")
    folded = narrow.join(again, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.first("text").alias("text"))
    once = narrow.join(again, ["k1", "k2"], "left_anti").unionByName(folded)
    counts = once.select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("with_term"))
    return materialize(counts, "pii-counts"), keys.count()


def generalised(told: DataFrame, counts: DataFrame, texts: int, generalise: float) -> DataFrame:
    """``told`` (value, term, with_value, removed) with ``general``: a beginning of the term that reveals too little, null if none.

    A beginning occurs in as many texts as the commonest term that has it, at
    least; the longest one whose share is then below ``generalise`` is taken.
    """
    begins = lambda term, least: F.transform(F.sequence(F.lit(1), F.greatest(F.length(term) - least, F.lit(1))), lambda n: F.substring(term, F.lit(1), n))
    open_ = told.where("not removed")
    wanted = bounded(materialize(open_.select(F.explode(begins(F.col("term"), 1)).alias("begin")).distinct(), "pii-begins"))
    spread = counts.select(F.explode(begins(F.col("term"), 0)).alias("begin"), "with_term").join(wanted, "begin", "left_semi")
    spread = spread.groupBy("begin").agg(F.max("with_term").alias("with_begin"))
    longest = open_.select("value", "term", "with_value", F.explode(begins(F.col("term"), 1)).alias("begin")).join(spread, "begin")
    wide = F.log2(F.lit(float(texts)) / F.col("with_begin")) < generalise * F.log2(F.lit(float(texts)) / F.col("with_value"))
    longest = longest.where(wide & (F.col("begin") != F.col("term"))).groupBy("value", "term").agg(F.max("begin").alias("general"))
    return told.join(longest, ["value", "term"], "left")


def revealing(rows: DataFrame, generalise: float, remove: float, min_contexts: int) -> tuple[DataFrame, DataFrame]:
    """(value, term, removed, general) for terms that reveal an entity of ``rows`` (k1, k2, text, base), and (k1, k2, value)."""
    held = rows.where(F.size("base") > 0).groupBy("k1", "k2").agg(F.first("text").alias("text"), F.first("base").alias("base"))
    own = F.array_distinct(F.transform("base", lambda s: F.concat_ws(":", s["kind"], s["value"])))
    held = held.select("k1", "k2", own.alias("values"), _terms(_without(F.col("text"), ordered(F.col("base"), KINDS))).alias("terms"), _sketch(F.col("text")).alias("sketch"))
    held = materialize(held, "pii-held")
    mentions = held.select("k1", "k2", F.explode("values").alias("value"))
    values = materialize(mentions.groupBy("value").agg(F.count("*").alias("with_value")), "pii-values")
    most = values.agg(F.max("with_value")).first()[0]
    if most is None:
        return values.select("value", F.lit("").alias("term"), F.lit(False).alias("removed"), F.lit("").alias("general")), mentions
    # both <= with_value, so that a term in too many texts cannot reach the threshold; the counts are exact
    counts, texts = term_counts(rows)
    rare = lambda with_value: F.log2(F.lit(float(texts)) / F.col("with_term")) >= generalise * F.log2(F.lit(float(texts)) / with_value) - 1e-9
    few = bounded(materialize(counts.where(rare(F.lit(most))), "pii-rare"))
    # an entity in fewer texts: the terms that are parts of it
    parts = F.array_intersect("terms", F.regexp_extract_all(F.lower("value"), F.lit(f"({TERM})")))
    near = held.select("k1", "k2", "sketch", "terms", F.explode("values").alias("value")).join(bounded(values), "value")
    near = near.withColumn("estimated", F.col("with_value") >= min_contexts)
    near = near.select("k1", "k2", "sketch", "value", "with_value", "estimated", F.explode(F.when(F.col("estimated"), F.col("terms")).otherwise(parts)).alias("term"))
    near = near.join(few, "term").where(rare(F.col("with_value")))
    pairs = near.groupBy("value", "term", "with_value", "with_term", "estimated").agg(F.count("*").alias("both"), F.count_distinct("sketch").alias("contexts"))
    whole = pairs.where((F.col("contexts") >= min_contexts) | ~F.col("estimated")).withColumn("share", _share(texts))
    told = whole.where(F.col("share") >= generalise).select("value", "term", "with_value", (F.col("share") >= remove).alias("removed"))
    return generalised(materialize(told, "pii-told"), counts, texts, generalise), mentions


def find(docs: DataFrame, carry: Column | None = None, generalise: float = 0.7, remove: float = 0.9, min_contexts: int = 3) -> DataFrame:
    """(doc_id, text, base, spans, general, carried) for every row of ``docs`` (doc_id, text), null text as empty.

    ``base`` has the entities of known form, ``spans`` adds the terms that
    reveal one of the text's entities, and ``general`` maps each of those terms
    to what stands for it: a beginning of it that many texts share and an ellipsis, ``[TERM]``
    if there is none, nothing if the term reveals the entity beyond ``remove``.
    A term is judged over whole texts: it must share ``min_contexts`` texts that
    are no near copies of each other with the same entity, and its share of the
    entity's information must reach ``generalise``, or ``remove``. For an entity
    in fewer texts, only terms that are part of it (the names in an address)
    are judged, in as many texts as there are. A text's terms inside
    its entities are not added. Counts are over different texts. Repeated rows
    come back as often as they came; a null doc_id stays null; no rows give no
    rows. Of other columns, only ``carry`` comes along.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    carry = F.lit(None).cast("string") if carry is None else carry
    rows = docs.select(F.col("doc_id").cast("long"), text, carry.alias("carried"))
    rows = rows.select("doc_id", "text", "carried", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit("second"), "text").alias("k2"))
    rows = rows.withColumn("base", entities(F.col("text")))
    told, mentions = revealing(rows.select("k1", "k2", "text", "base"), generalise, remove, min_contexts)
    told = materialize(told, "pii-terms")
    none = F.create_map().cast("map<string,string>")
    if told.isEmpty():
        return rows.select("doc_id", "text", ordered(F.col("base"), KINDS).alias("base"), ordered(F.col("base"), KINDS).alias("spans"), none.alias("general"), "carried")
    # of two entities in a text that a term reveals, the one that asks for more decides: nothing, a label, the shorter beginning
    general = F.when(F.col("removed"), F.lit("")).otherwise(F.coalesce(F.concat("general", F.lit("…")), F.lit("[TERM]")))
    order = F.when(F.col("removed"), -1).when(F.col("general").isNull(), 0).otherwise(F.length("general"))
    by_text = mentions.join(bounded(told), "value").groupBy("k1", "k2", "term").agg(F.min(F.struct(order.alias("order"), general.alias("general"))).alias("g"))
    lists = by_text.groupBy("k1", "k2").agg(F.map_from_entries(F.collect_list(F.struct("term", "g.general"))).alias("general"))
    rows = rows.join(bounded(materialize(lists, "pii-lists"), items=F.size("general")), ["k1", "k2"], "left")
    terms = F.filter(matches(F.col("text"), TERM, "term", F.col("general").isNotNull()), lambda t: F.map_contains_key("general", F.lower(t["value"])) & ~F.exists("base", lambda b: (b["at"] < t["end"]) & (t["at"] < b["end"])))
    spans = F.when(F.col("general").isNull(), F.col("base")).otherwise(F.concat("base", terms))
    return rows.select("doc_id", "text", ordered(F.col("base"), KINDS).alias("base"), ordered(spans, KINDS).alias("spans"), F.coalesce("general", none).alias("general"), "carried")


def replaced(text: Column, spans: Column, sign) -> Column:
    """The text with ``sign(span)`` for each of ``spans``, which are in order.

    A span that begins inside an earlier one is left out, its rest with it.
    """
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        kept = F.substring(text, acc["at"] + 1, s["at"] - acc["at"])
        new = F.struct(s["end"].alias("at"), F.concat(acc["parts"], F.array(kept, sign(s))).alias("parts"))
        longer = F.struct(F.greatest(s["end"], acc["at"]).alias("at"), acc["parts"].alias("parts"))
        return F.when(s["at"] >= acc["at"], new).otherwise(longer)

    whole = F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) == 0, text).otherwise(whole)


def sanitise(text: Column, spans: Column, general: Column) -> Column:
    """The text with each entity replaced by its kind in brackets, and each term by what ``general`` has for it."""
    kind = lambda s: F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
    return replaced(text, spans, lambda s: F.when(s["kind"] == "term", F.coalesce(F.element_at(general, F.lower(s["value"])), F.lit(""))).otherwise(kind(s)))


def digest(found: DataFrame) -> DataFrame:
    """The counts and printed spans of :func:`find`."""
    return found.select(
        "doc_id",
        *[count_kind(F.col("base"), k).alias(f"n_{k}") for k in KINDS[:4]],
        F.sha2(printed(F.col("base")), 256).alias("base_sha256"),
        printed(F.col("spans")).alias("spans"),
    )
