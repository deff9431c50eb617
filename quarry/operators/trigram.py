"""A stored trigram index: which rows hold which three characters, and where.

The index has a row for each trigram of each field of each row, with its places.
A phrase is looked up by trigrams that cover it: the places of its rarest one
are where it may begin, and the others strike out those that do not fit. The
text itself is not read again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.scratch import bounded, kept
from . import scan
from .vector import best

#: BM25 constants, and what an inverse document frequency of zero or less becomes (fixed values).
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
KEY = ["channel", "id", "chunk"]
INDEX = "channel string, id long, chunk long, field int, gram string, places array<int>"
#: Distinct trigrams of a search up to which they go into the scan's filter.
FEW = 2000


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            out: list[tuple] = []
            for channel, id_, chunk, fields in zip(*[part.column(i).to_pylist() for i in range(4)]):
                for n, text in enumerate(fields or []):
                    found: dict[str, list[int]] = {}
                    for i in range(len(text or "") - 2):
                        found.setdefault(text[i : i + 3], []).append(i)
                    out += [(channel, id_, chunk, n, g, p) for g, p in found.items()]
            columns = list(zip(*out)) or [()] * 6
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[*KEY, "field", "gram", "places"])


def index(rows: DataFrame) -> DataFrame:
    """(channel, id, chunk, field, gram, places) of ``rows`` (channel, id, chunk, fields), case folded.

    To store it, deal it out by gram with :func:`dealt`; a frequent gram is
    then spread over several files, and a search opens only files of its grams.
    """
    folded = F.transform("fields", lambda t: F.lower(F.coalesce(t.cast("string"), F.lit(""))))
    return rows.select("channel", F.col("id").cast("long").alias("id"), F.col("chunk").cast("long").alias("chunk"), folded.alias("fields")).mapInArrow(_grams, INDEX)


def dealt(found: DataFrame) -> DataFrame:
    """The index in the order in which it is stored."""
    return found.repartitionByRange("gram", *KEY).sortWithinPartitions("gram", *KEY)


def sizes(rows: DataFrame) -> DataFrame:
    """(channel, id, chunk, len): trigrams of ``rows`` (channel, id, chunk, fields), repeats included."""
    long = F.aggregate("fields", F.lit(0), lambda n, t: n + F.greatest(F.length(F.coalesce(t.cast("string"), F.lit(""))) - 2, F.lit(0)))
    return rows.select("channel", F.col("id").cast("long").alias("id"), F.col("chunk").cast("long").alias("chunk"), long.cast("long").alias("len"))


def phrase_hits(found: DataFrame, phrases: DataFrame) -> DataFrame:
    """(phrase, channel, id, chunk, f): how often each of ``phrases`` (phrase) occurs, overlaps counted, in the rows of an index.

    Case is folded; a phrase under three characters occurs nowhere.
    """
    length = F.length("phrase")
    places = F.array_distinct(F.concat(F.sequence(F.lit(0), length - 3, F.lit(3)), F.array(length - 3)))
    parts = phrases.select(F.lower("phrase").alias("phrase")).distinct().where(length >= 3).select("phrase", F.explode(places).alias("offset"))
    parts = parts.withColumn("gram", F.col("phrase").substr(F.col("offset") + 1, F.lit(3)))
    grams = parts.select("gram").distinct()
    few = [r.gram for r in grams.limit(FEW + 1).collect()]
    wanted = found.where(F.col("gram").isin(few)) if len(few) <= FEW else found.join(grams, "gram", "left_semi")
    df = wanted.groupBy("gram").agg(F.count("*").alias("df"))
    whole = Window.partitionBy("phrase")
    judged = parts.join(df, "gram", "left").withColumn("open", F.min(F.coalesce("df", F.lit(0))).over(whole)).where("open > 0")
    judged = judged.withColumn("nth", F.row_number().over(whole.orderBy("df", "offset"))).withColumn("others", F.count("*").over(whole) - 1)
    anchors = bounded(judged.where("nth = 1").select("phrase", "gram", F.col("offset").alias("own"), "others"))
    starts = wanted.join(anchors, "gram").select("phrase", "others", *KEY, "field", F.explode(F.transform("places", lambda p: p - F.col("own"))).alias("start")).where("start >= 0")
    rest = judged.where("nth > 1").select("phrase", "gram", "offset")
    asked = starts.where("others > 0").join(bounded(rest), "phrase")
    met = asked.join(wanted, [*KEY, "field", "gram"]).where(F.array_contains("places", F.col("start") + F.col("offset")))
    met = met.groupBy("phrase", *KEY, "field", "start", "others").agg(F.count("*").alias("n")).where("n = others")
    hits = starts.where("others = 0").select("phrase", *KEY).unionByName(met.select("phrase", *KEY))
    return hits.groupBy("phrase", *KEY).agg(F.count("*").alias("f"))


def kana_variants(queries: DataFrame) -> DataFrame:
    """(query_id, term, phrase): the words of ``queries`` (query_id, text), each as it is and in either kana, double quotes left out."""
    words = F.filter(F.transform(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " "), lambda w: F.replace(w, F.lit('"'), F.lit(""))), lambda w: w != "")
    terms = queries.select("query_id", F.posexplode(words).alias("term", "word"))
    forms = F.array_distinct(F.array(F.col("word"), X.to_katakana(F.col("word")), X.to_hiragana(F.col("word"))))
    return terms.select("query_id", "term", F.explode(forms).alias("phrase"))


def bm25(found: DataFrame, lengths: DataFrame | None, terms: DataFrame, limit: int | None = None) -> DataFrame:
    """(channel, query_id, id, chunk, score): BM25 of the rows that hold every term of a query by some of its phrases.

    ``found`` is a stored index with its ``lengths``, or for a search that is
    made once the rows (channel, id, chunk, fields) themselves, each of a key of
    its own; these are scanned, and nothing is written. ``terms`` is (query_id,
    term, phrase); statistics are those of a channel, so that scores of channels
    do not compare. With ``limit``, the best rows of a query in each channel. If
    ``terms`` has an id, a query looks at rows of that id only, statistics still
    being those of the whole channel.
    """
    own_id = ["id"] if "id" in terms.columns else []
    folded = terms.select("query_id", "term", F.lower("phrase").alias("phrase"), *own_id).distinct()
    scans = "fields" in found.columns
    if scans:
        rows = scan.folded(found)
        df, lengths = scan.frequencies(rows, folded.select("phrase")), rows.drop("fields")
        df = kept(df, "frequencies")
    else:
        hits = phrase_hits(found, folded.select("phrase"))
        df = hits.groupBy("channel", "phrase").agg(F.count("*").alias("df"))
    whole = lengths.groupBy("channel").agg(F.count("*").alias("n_rows"), F.avg("len").alias("mean"))
    idf = F.log((F.col("n_rows") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    stats = df.join(F.broadcast(whole), "channel").select("channel", "phrase", "mean", F.when(idf <= 0, LEAST_IDF).otherwise(idf).alias("idf"))
    if scans and not own_id and folded.count() <= scan.BLOCK:
        out = scan.met(rows, folded, stats, K1, B)
    else:
        own = F.col("idf") * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
        if scans:
            stats = bounded(kept(stats, "phrase-stats"))
            near = rows.join(bounded(folded.select("id").distinct()), "id", "left_semi") if own_id else rows
            hits = scan.hits(near, folded.select("phrase")).join(bounded(folded), ["phrase", *own_id])
        else:
            hits = hits.join(folded, ["phrase", *own_id]).join(lengths, KEY)
        scored = hits.join(stats, ["channel", "phrase"]).groupBy("query_id", *KEY).agg(F.sum(own).alias("score"), F.count_distinct("term").alias("met"))
        wanted = folded.groupBy("query_id").agg(F.count_distinct("term").alias("terms"))
        out = scored.join(bounded(wanted), "query_id").where("met = terms").select("channel", "query_id", "id", "chunk", "score")
    return best(out, ["channel", "query_id"], [F.desc(F.round("score", 9)), F.asc("id"), F.asc("chunk")], limit) if limit else out


def normalised(scored: DataFrame) -> DataFrame:
    """Scores over the best of their query in the channel."""
    return scored.withColumn("score", F.col("score") / F.max("score").over(Window.partitionBy("channel", "query_id")))


def held(found: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, id): what holds every term (query_id, term, phrase) somewhere, in whichever channel and row of an index, or of rows that are scanned."""
    folded = terms.select("query_id", "term", F.lower("phrase").alias("phrase")).distinct()
    pairs = scan.ids(scan.folded(found), folded.select("phrase")) if "fields" in found.columns else phrase_hits(found, folded.select("phrase")).select("phrase", "id").distinct()
    met = pairs.join(bounded(folded), "phrase")
    met = met.groupBy("query_id", "id").agg(F.count_distinct("term").alias("met"))
    wanted = folded.groupBy("query_id").agg(F.count_distinct("term").alias("terms"))
    return met.join(bounded(wanted), "query_id").where("met = terms").select("query_id", "id")


