"""Preparing a training corpus: quality rules, near duplicates, benchmark items, personal data, source mix.

Each stage works on all rows that the one before it kept, and is written as
Parquet before the next begins. A row is known by two 64-bit hashes of all its
columns, so that null and repeated doc_ids do no harm, and rows with one key are
equal throughout. All columns of ``documents``, further ones too, come along to
the end; the last stage adds to them how often each row is taken. No rows give
no rows; null texts are dropped by the quality rules, and stay null elsewhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import decontaminate, mixing, pii, quality, simhash
from quarry.llm.common import bounded, fresh, materialize


#: Bits of a fingerprint of five-word shingles, and how many may differ: about as many as do at a shingle similarity of 0.78.
BITS, RADIUS = 2048, 347
#: Keys of a text by which its likes are found; two that link are alike by 0.7 or more and have one in common but in 1e-12 of cases.
KEYS = 24


def _named(name: str) -> Column:
    """The column of this very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def _keyed(docs: DataFrame) -> tuple[DataFrame, str, DataFrame]:
    """The rows with a key, the key's name, and (doc_id, text, lang, source) with the key as doc_id."""
    key = fresh(docs, "row_key")
    plain = [_named(f.name) for f in docs.schema if "map" not in f.dataType.simpleString()]
    parts = [*plain, *[F.to_json(F.struct(_named(f.name))) for f in docs.schema if "map" in f.dataType.simpleString()]]
    null = F.concat(*[F.isnull(c).cast("int").cast("string") for c in parts])
    hashes = [F.hex(F.xxhash64(F.lit(n), null, *parts)) for n in (1, 2)]
    rows = docs.withColumn(key, F.concat_ws(":", *hashes))
    return rows, key, rows.select(F.col(key).alias("doc_id"), "text", "lang", "source")


def _without(rows: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """The rows whose key is not among the doc_ids of ``gone``."""
    gone = materialize(gone.select(F.col("doc_id").alias(key)).distinct(), "stage-gone")
    return rows.join(bounded(gone), key, "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality rules reject; null texts are among them."""
    rows, key, narrow = _keyed(docs)
    return _without(rows, key, quality.quality(narrow).where("not kept")).drop(key)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, the one of the least key, and one of rows that are equal throughout."""
    rows, key, narrow = _keyed(docs)
    found = simhash.near_duplicates(narrow, shingle=5, width=BITS // 64, radius=RADIUS, keys=KEYS)
    found = materialize(found.select("doc_id", "component_id"), "stage-groups")
    kept = _without(rows, key, found.where("doc_id <> component_id"))
    again = found.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1")
    again = materialize(again.select(F.col("doc_id").alias(key)), "stage-again")
    if again.isEmpty():
        return kept.drop(key)
    again = bounded(again)
    once = kept.join(again, key, "left_semi").dropDuplicates([key])
    return kept.join(again, key, "left_anti").unionByName(once).drop(key)


def benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, as it is or with other values."""
    rows, key, narrow = _keyed(docs)
    found = decontaminate.contaminated(narrow, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(rows, key, found).drop(key)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data, and terms that reveal it; null texts stay null."""
    found = pii.find(docs, F.struct(*[_named(c).alias(c) for c in docs.columns]))
    clean = F.when(F.col("carried")["text"].isNotNull(), pii.sanitise(F.col("text"), F.col("spans"), F.col("general")))
    rows = found.select(F.col("carried"), clean.alias("clean"))
    new = {"text": F.col("clean"), "n_chars": F.length("clean").cast("long")}
    return rows.select(*[new.get(c, F.col("carried").getField(c)).alias(c) for c in docs.columns])


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns of the documents, with how often each is taken for the sources' target sizes.

    Adds size, source_size, target, taken and copies; a name that is there
    already gets an underscore. Equal rows are numbered, to each its own copies.
    """
    rows, key, narrow = _keyed(docs)
    nth = fresh(docs, "nth")
    mixed = mixing.mix(narrow).select(F.col("doc_id").alias(key), F.col("nth").cast("long").alias(nth), *[F.col(c).alias(fresh(docs, c)) for c in ("size", "source_size", "target", "taken", "copies")])
    mixed = materialize(mixed, "stage-mix")
    again = bounded(materialize(mixed.where(F.col(nth) > 1).select(key).distinct(), "stage-again"))
    lone = rows.join(again, key, "left_anti").withColumn(nth, F.lit(1).cast("long"))
    equal = rows.join(again, key, "left_semi").withColumn(nth, F.row_number().over(Window.partitionBy(key).orderBy(key)).cast("long"))
    return lone.unionByName(equal).join(bounded(mixed), [key, nth]).drop(key, nth)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_items", benchmark_items),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
]

#: SQL can express neither the language model nor the fingerprints; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, on ``documents`` of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
