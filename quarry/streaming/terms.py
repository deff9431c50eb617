"""Term sets of files, kept up by batches of a stream; of two writers of a file the later generation wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

TERMS = "file_id long, generation long, term string"


def merged_terms(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """The term sets ``stored`` (file_id, generation, term) after a ``batch`` of the same columns.

    A file's set is replaced as a whole by the one of its greatest generation
    in the batch, unless what is stored has a greater one, so that late and
    repeated batches change nothing. A null term stands for an empty set, and
    stays as the mark of its generation. Repeated rows count once.
    """
    rows = batch.select("file_id", "generation", "term").where("file_id is not null and generation is not null")
    newest = rows.groupBy("file_id").agg(F.max("generation").alias("newest"))
    kept = stored.groupBy("file_id").agg(F.max("generation").alias("own")).join(newest, "file_id", "full")
    wins = kept.where(F.col("own").isNull() | (F.col("newest") >= F.col("own"))).where("newest is not null").select("file_id", F.col("newest").alias("generation"))
    new = rows.join(wins, ["file_id", "generation"], "left_semi").distinct()
    return stored.select("file_id", "generation", "term").join(wins.select("file_id"), "file_id", "left_anti").unionByName(new)


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the whole versions of a stored table."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    found = [s.getPath() for s in files.listStatus(folder)]
    whole = [p.getName() for p in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(n[2:]) for n in whole if n.startswith("v="))


def stored_terms(spark: SparkSession, path: str) -> DataFrame:
    """The last whole version of the term sets in a folder; none if there is no version."""
    found = _versions(spark, path)
    return spark.read.schema(TERMS).parquet(f"{path}/v={found[-1]}") if found else spark.createDataFrame([], TERMS)


def term_stream(updates: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Merge a stream of term sets (file_id, generation, term) into the folder ``path``, a version for each batch, until what is there is done."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number not in _versions(spark, path):
            merged_terms(stored_terms(spark, path), batch).write.mode("overwrite").parquet(f"{path}/v={number}")

    return updates.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_postings(stored: DataFrame) -> DataFrame:
    """(file_id, term) without the marks of empty sets."""
    return stored.where("term is not null").select("file_id", "term")
