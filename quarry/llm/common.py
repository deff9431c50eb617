"""Shared helpers: word splitting, shared scratch tables, Arrow batch plumbing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than space and U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_own_scratch: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it.

    Only where that is unset, in local mode as in tests, a temporary folder of
    this process is used; on a cluster the setting is required.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_scratch:
        _own_scratch.append(tempfile.mkdtemp(prefix="spark-scratch-"))
    return _own_scratch[0]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage, so that a lost executor costs at most the stage that is
    running, and lets several consumers share one computation. The folder is
    deleted when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return spark.read.schema(df.schema).parquet(path)


def bounded(table: DataFrame, most: int = 1_000_000, items: Column | None = None) -> DataFrame:
    """A broadcast of a table of up to ``most`` rows; a larger one as it is, to be joined by a shuffle.

    For rows of no fixed size, ``items`` says how many a row counts for.
    """
    size = table.count() if items is None else table.agg(F.sum(items)).first()[0] or 0
    return F.broadcast(table) if size <= most else table


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def doc_ids(docs: DataFrame) -> tuple[Column, str]:
    """The column doc_id, as it is if it is a string and else as a long, and which of the two it is."""
    kind = "string" if docs.schema["doc_id"].dataType.typeName() == "string" else "long"
    return F.col("doc_id").cast(kind), kind


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def words(text: Column) -> Column:
    """Words of a text, in order; none for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(f"({WORD})")), F.array().cast("array<string>"))


def by_batch(
    df: DataFrame, fn: Callable[[dict], Iterator[dict] | dict], schema: str, rows: int = 1000
) -> DataFrame:
    """Apply ``fn`` to up to ``rows`` rows of an Arrow batch at a time, as a dict of Python lists.

    ``fn`` gives one dict of columns, or several in turn, in the order of
    ``schema``.
    """
    target = pa_schema(schema, df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = fn(batch.slice(at, rows).to_pydict())
                for columns in [out] if isinstance(out, dict) else out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(columns[f.name], type=f.type) for f in target], schema=target
                    )

    return df.mapInArrow(run, schema)


def pa_schema(ddl: str, spark: SparkSession) -> pa.Schema:
    """The Arrow schema of a DDL string."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))
