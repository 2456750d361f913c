"""The queue of raw files to distil, as pure steps from one table to the next."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_RETRIES, BACKOFF_S = 5, 10
COLUMNS = ["path", "status", "retry_count", "last_error", "queued_at", "updated_at"]


def enqueue(queue: DataFrame, paths: DataFrame, as_of: int) -> DataFrame:
    """The rows to add for paths that are not in the queue in whatever state; failed ones stay failed."""
    new = paths.select("path").where("path IS NOT NULL").distinct().join(queue.select("path"), "path", "left_anti")
    at = F.lit(as_of).cast("bigint")
    return new.select("path", F.lit("pending").alias("status"), F.lit(0).alias("retry_count"), F.lit(None).cast("string").alias("last_error"), at.alias("queued_at"), at.alias("updated_at"))


def next_pending(queue: DataFrame, n: int = 1) -> DataFrame:
    """The n pending rows queued longest; ties go by path."""
    return queue.where("status = 'pending'").orderBy("queued_at", "path").limit(n)


def _where(queue: DataFrame, taken: DataFrame, changes: dict) -> DataFrame:
    mark = taken.select("path").distinct().withColumn("_hit", F.lit(True))
    hit = F.coalesce("_hit", F.lit(False))
    joined = queue.join(mark, "path", "left")
    return joined.select(*[(F.when(hit, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c)) for c in COLUMNS])


def start(queue: DataFrame, taken: DataFrame, as_of: int) -> DataFrame:
    return _where(queue, taken, {"status": F.lit("processing"), "updated_at": F.lit(as_of).cast("bigint")})


def done(queue: DataFrame, taken: DataFrame) -> DataFrame:
    return queue.join(taken.select("path"), "path", "left_anti").select(COLUMNS)


def failed(queue: DataFrame, errors: DataFrame, as_of: int) -> DataFrame:
    """After failures (path, error): one retry more, and failed for good at MOST_RETRIES."""
    one = errors.groupBy("path").agg(F.min("error").alias("_error")).withColumn("_hit", F.lit(True))
    hit, retries = F.coalesce("_hit", F.lit(False)), F.col("retry_count") + 1
    status = F.when(retries >= MOST_RETRIES, "failed").otherwise("pending")
    joined = queue.join(one, "path", "left")
    return joined.select(
        "path", F.when(hit, status).otherwise(F.col("status")).alias("status"), F.when(hit, retries).otherwise(F.col("retry_count")).alias("retry_count"),
        F.when(hit, F.col("_error")).otherwise(F.col("last_error")).alias("last_error"), "queued_at", F.when(hit, F.lit(as_of).cast("bigint")).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def recover_stale(queue: DataFrame, as_of: int) -> DataFrame:
    """What was being processed is pending again."""
    stale = F.col("status") == "processing"
    return queue.withColumn("updated_at", F.when(stale, F.lit(as_of).cast("bigint")).otherwise(F.col("updated_at"))).withColumn("status", F.when(stale, "pending").otherwise(F.col("status")))


def available_at(queue: DataFrame) -> DataFrame:
    """Pending rows with the time from which they may be tried again: BACKOFF_S doubled with each retry but the last one made."""
    wait = F.when(F.col("retry_count") > 0, BACKOFF_S * F.pow(F.lit(2.0), F.col("retry_count") - 1)).otherwise(0.0)
    return queue.where("status = 'pending'").select("path", "retry_count", (F.col("updated_at") + wait.cast("bigint")).alias("available_at"))


def ready(queue: DataFrame, as_of: int, n: int) -> DataFrame:
    """The n pending rows queued longest whose wait after their last failure is over."""
    now = available_at(queue).where(F.col("available_at") <= as_of).select("path")
    return next_pending(queue.join(now, "path", "left_semi").select(COLUMNS), n)


def stats(queue: DataFrame, known: tuple[str, ...] = ("pending", "processing", "failed")) -> DataFrame:
    """status, n with the known states that don't occur."""
    from .wiki import zero_filled

    return zero_filled(queue.groupBy("status").agg(F.count("*").alias("n")), "status", known)
