"""Operational analytics: job records, index status, reconciliation, histories, breakers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLOSED = ("succeeded", "skipped")
#: What is taken for a credential, and the beginnings of paths that are cut, in error texts (fixed patterns).
CREDENTIALS = (
    r"(?i)authorization\s*[:=]\s*bearer\s+[A-Za-z0-9._-]+",
    r"(?i)bearer\s+[A-Za-z0-9._-]{8,}",
    r"(?i)api[_-]?key\s*[:=]\s*[A-Za-z0-9._-]+",
    r"\bsk-[A-Za-z0-9_-]{8,}\b",
    r"\bskey-[A-Za-z0-9_-]{8,}\b",
)
PATHS = ("/data/drives/", "/app/", "/intelligence-data/")


def latest_failed(jobs: DataFrame) -> DataFrame:
    """Each (file_id, job_kind, provider)'s latest records, where they failed; all that tie for the latest.

    A null provider is a provider of its own.
    """
    order = Window.partitionBy("file_id", "job_kind", "provider").orderBy(F.desc("ts"))
    return jobs.withColumn("_rank", F.rank().over(order)).where("_rank = 1 and status = 'failed'").drop("_rank")


def open_attempts(jobs: DataFrame) -> DataFrame:
    """(file_id, job_kind, provider, attempts): failures since the last record that closed the matter, all if none did."""
    keys = ["file_id", "job_kind", "provider"]
    closed = jobs.groupBy(*keys).agg(F.max(F.when(F.col("status").isin(*CLOSED), F.col("ts"))).alias("closed"))
    same = [F.col(f"j.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]
    rows = jobs.alias("j").join(closed.alias("c"), same[0] & same[1] & same[2])
    since = (F.col("status") == "failed") & (F.col("closed").isNull() | (F.col("ts") > F.col("closed")))
    return rows.groupBy(*[F.col(f"j.{k}").alias(k) for k in keys]).agg(F.count_if(since).alias("attempts"))


def provider_stats(jobs: DataFrame, since: Column) -> DataFrame:
    """(provider, status, n) of records since a time."""
    return jobs.where(F.col("ts") >= since).groupBy("provider", "status").agg(F.count("*").alias("n"))


def latest_by_id(jobs: DataFrame) -> DataFrame:
    """(file_id, job_id, status): the record of the highest id of each file."""
    top = jobs.groupBy("file_id").agg(F.max(F.struct("job_id", "status")).alias("top"))
    return top.select("file_id", "top.job_id", "top.status")


def reconcile(source: DataFrame, index: DataFrame, compared: list[str]) -> DataFrame:
    """(id, action): what makes the index (id, active, ...) equal to the source (id, ...).

    new, reactivate, drift (a compared column differs), deactivate, purge (gone
    and inactive), or keep.
    """
    s, i = source.withColumn("_s", F.lit(True)).alias("s"), index.withColumn("_i", F.lit(True)).alias("i")
    both = s.join(i, F.col("s.id") == F.col("i.id"), "full")
    differs = F.lit(False)
    for c in compared:
        differs = differs | ~F.col(f"s.{c}").eqNullSafe(F.col(f"i.{c}"))
    action = (
        F.when(F.col("_i").isNull(), "new")
        .when(F.col("_s").isNull(), F.when(F.col("i.active"), "deactivate").otherwise("purge"))
        .when(~F.col("i.active"), "reactivate")
        .when(differs, "drift")
        .otherwise("keep")
    )
    return both.select(F.coalesce("s.id", "i.id").alias("id"), action.alias("action"))


def orphans(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """(id, problem): rows whose vector is missing, and vectors without a row; rows of no vector table have none to miss."""
    missing = rows.where("vector_table <> ''").select("id").join(vectors.select("id"), "id", "left_anti").withColumn("problem", F.lit("no vector"))
    return missing.unionByName(vectors.select("id").join(rows.select("id"), "id", "left_anti").withColumn("problem", F.lit("no row")))


def eligible(wanted: DataFrame, have: DataFrame, files: DataFrame) -> DataFrame:
    """(queued, skipped): wanted ids (id) that are files (id, active) in use and not done already."""
    ready = wanted.join(files.where("active").select("id"), "id", "left_semi").join(have.select("id").distinct(), "id", "left_anti")
    flagged = wanted.join(ready.withColumn("ready", F.lit(True)), "id", "left")
    return flagged.agg(F.count_if(F.col("ready")).alias("queued"), F.count_if(F.col("ready").isNull()).alias("skipped"))


def current_and_past(rows: DataFrame, keys: list[str], at: str, order: str) -> DataFrame:
    """Append-only rows with valid_to, the time of the row that replaced each; null for the current one."""
    own = Window.partitionBy(*keys).orderBy(at, order)
    return rows.withColumn("valid_to", F.lead(at).over(own)).withColumn("version", F.row_number().over(own))


def last_events(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last change of each key, as batches and streams apply it."""
    others = [c for c in events.columns if c != key]
    top = events.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("last"))
    return top.select(key, "last.*")


def breaker(jobs: DataFrame, window_s: int, threshold: int, pause_s: int) -> DataFrame:
    """(job_id, provider, failures, open): failures of a provider within the window up to each record, and whether its circuit is open then.

    It opens when they exceed the threshold, for ``pause_s`` seconds. Time is
    cut into blocks of the window, then of the pause: what a record depends on
    is in its own block and the one before, whose failures come along as one
    sum and are taken off as they run out. So a task holds blocks, not a
    provider, and each record is read once.
    """
    window, pause = window_s * 1_000_000, pause_s * 1_000_000
    block = lambda t, size: F.floor(t / F.lit(size)).cast("long")
    up_to = lambda: Window.partitionBy("provider", "_block").orderBy("_t").rangeBetween(Window.unboundedPreceding, 0)
    rows = jobs.select("job_id", "provider", (F.col("status") == "failed").alias("_failed"), F.unix_micros(F.col("ts").cast("timestamp")).alias("_t"))
    rows = rows.withColumn("_block", block(F.col("_t"), window)).withColumn("_n", F.coalesce(F.col("_failed"), F.lit(False)).cast("long"))
    extra = lambda df, t, n: df.select(F.lit(None).cast("long").alias("job_id"), "provider", F.lit(None).cast("boolean").alias("_failed"), t.alias("_t"), "_block", n.alias("_n"), F.lit(True).alias("_extra"))
    failed = rows.where("_failed").withColumn("_block", F.col("_block") + 1)
    carried = extra(failed.groupBy("provider", "_block").agg(F.count("*").alias("_n")), F.col("_block") * window - 1, F.col("_n"))
    ended = extra(failed, F.col("_t") + window + 1, F.lit(-1).cast("long"))
    rows = rows.withColumn("_extra", F.lit(False)).unionByName(carried).unionByName(ended)
    rows = rows.withColumn("failures", F.sum("_n").over(up_to())).where(~F.col("_extra")).drop("_extra", "_n")
    rows = rows.withColumn("_block", block(F.col("_t"), pause)).withColumn("_trip", F.when(F.col("_failed") & (F.col("failures") > threshold), F.col("_t")))
    before = rows.where("_trip is not null").groupBy("provider", (F.col("_block") + 1).alias("_block")).agg(F.max("_trip").alias("_trip"))
    before = before.select(F.lit(None).cast("long").alias("job_id"), "provider", F.lit(None).cast("boolean").alias("_failed"), (F.col("_block") * pause - 1).alias("_t"), "_block", F.lit(None).cast("long").alias("failures"), "_trip")
    rows = rows.unionByName(before).withColumn("_last", F.max("_trip").over(up_to())).where("failures is not null")
    return rows.withColumn("open", F.coalesce(F.col("_t") - F.col("_last") < pause, F.lit(False))).select("job_id", "provider", "failures", "open")


def scrub(text: Column, length: int = 256) -> Column:
    """An error text without credentials, paths cut to the file's name, and the whole cut at ``length`` characters with an ellipsis."""
    for pattern in CREDENTIALS:
        text = F.regexp_replace(text, pattern, "[REDACTED]")
    for begin in PATHS:
        text = F.regexp_replace(text, begin + r"[^\s'\"]+/", "…/")
    return F.when(F.length(text) <= length, text).otherwise(F.concat(F.substring(text, 1, length - 1), F.lit("…")))


def purge(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Each of ``tables``, which have file_id, without the rows of the files ``gone`` (file_id)."""
    gone = gone.select("file_id").where("file_id is not null").distinct()
    return {name: rows.join(gone, "file_id", "left_anti") for name, rows in tables.items()}


def corrected(versions: DataFrame) -> DataFrame:
    """(item, original, current, generation) of versions (item, version, value): the first one is kept beside the latest."""
    return versions.groupBy("item").agg(F.min_by("value", "version").alias("original"), F.max_by("value", "version").alias("current"), (F.count("*") - 1).alias("generation"))
