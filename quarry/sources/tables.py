"""Reading tables, and presenting them in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def files(spark: SparkSession, folder: str) -> DataFrame:
    """(file_id, drive, filename, text, lang, n_chars): documents as files, their source as the drive."""
    docs = table(spark, folder, "documents")
    return docs.select(F.col("doc_id").alias("file_id"), F.col("source").alias("drive"), F.format_string("doc_%d.md", "doc_id").alias("filename"), "text", "lang", "n_chars")


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """(id, vector, label, kind): embeddings, in three kinds by label."""
    rows = table(spark, folder, "embeddings")
    kind = F.element_at(F.array(F.lit("metadata"), F.lit("text_content"), F.lit("clip")), (F.col("label") % 3 + 1).cast("int"))
    return rows.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), "label", kind.alias("kind"))


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """(file_id, chunk, speaker, text, start, end): conversations as timed transcripts, ten seconds a turn."""
    rows = table(spark, folder, "conversations")
    return rows.select(F.col("conv_id").alias("file_id"), F.col("turn").alias("chunk"), F.col("role").alias("speaker"), "text", (10.0 * F.col("turn")).alias("start"), (10.0 * F.col("turn") + 10).alias("end"))


def plays(spark: SparkSession, folder: str) -> DataFrame:
    """(viewer, file_id, ts, segment, liked, dismissed, value): events as playback of the file in their props."""
    rows = table(spark, folder, "events")
    file_id = F.get_json_object("props", "$.k").cast("long")
    return rows.select(
        F.col("user_id").alias("viewer"),
        file_id.alias("file_id"),
        "ts",
        F.floor(F.col("value") / 5).alias("segment"),
        (F.col("event_type") == "purchase").alias("liked"),
        (F.col("event_type") == "error").alias("dismissed"),
        "value",
    )


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    """(job_id, file_id, job_kind, provider, status, ts): events as job records; views have no provider."""
    rows = table(spark, folder, "events")
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "skipped").otherwise("succeeded")
    provider = F.when(F.col("event_type") != "view", F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")))
    return rows.select(F.col("event_id").alias("job_id"), F.get_json_object("props", "$.k").cast("long").alias("file_id"), F.concat(F.lit("k"), (F.col("user_id") % 4).cast("string")).alias("job_kind"), provider.alias("provider"), status.alias("status"), "ts")
