"""The job queue as set-based changes of state: enqueue, lease, finish, abandon, renew, pipeline.

Jobs are rows (id, job_type, attachment_id, document_id, status, priority, attempts, max_attempts,
available_at, locked_by, locked_at, lease_until, completed_at, error_code, error_message); columns that
a table lacks are left out.  Changes by a worker are fenced: they touch only running jobs that this worker holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakepost.operators.merge import ready_jobs, recover_expired

LOCK = ("locked_by", "locked_at", "lease_until")


def _change(jobs: DataFrame, mine: Column, values: dict[str, Column]) -> DataFrame:
    return jobs.select(*[F.when(mine, values[c]).otherwise(F.col(c)).cast(jobs.schema[c].dataType).alias(c) if c in values else F.col(c) for c in jobs.columns])


def _mine(worker: str) -> Column:
    return (F.col("status") == "running") & F.col("locked_by").eqNullSafe(worker)


def enqueue(jobs: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``wanted`` that have no active job of the same ``keys``; each key once.  Null keys never match."""
    active = jobs.filter("status IN ('pending', 'running')").select(*keys)
    return wanted.dropDuplicates(keys).join(active, keys, "left_anti")


def lease_next(jobs: DataFrame, worker: str, now: Column, seconds: int, limit: int = 1) -> DataFrame:
    """Jobs after ``worker`` took the next ``limit`` ready ones: expired leases are recovered first."""
    j = recover_expired(jobs, now)
    taken = ready_jobs(j, now, limit).select("id", F.lit(True).alias("_taken"))
    j = j.join(F.broadcast(taken), "id", "left")  # at most ``limit`` rows
    mine = F.coalesce("_taken", F.lit(False))
    until = now + F.make_dt_interval(secs=F.lit(seconds).cast("decimal(18,6)"))
    out = _change(j, mine, {"status": F.lit("running"), "attempts": F.col("attempts") + 1, "locked_by": F.lit(worker), "locked_at": now, "lease_until": until})
    return out.drop("_taken").select(*jobs.columns)


def complete(jobs: DataFrame, worker: str, ids: list[int], now: Column) -> DataFrame:
    free = {c: F.lit(None) for c in LOCK}
    return _change(jobs, _mine(worker) & F.col("id").isin(ids), {"status": F.lit("completed"), "completed_at": now, **free})


def fail(jobs: DataFrame, worker: str, ids: list[int], code: str, message: str, now: Column, delay: int) -> DataFrame:
    """Pending again after ``delay`` seconds, or failed at the last attempt."""
    last = F.col("attempts") >= F.col("max_attempts")
    later = now + F.make_dt_interval(secs=F.lit(delay).cast("decimal(18,6)"))
    values = {"status": F.when(last, "failed").otherwise("pending"), "available_at": later, "error_code": F.lit(code), "error_message": F.lit(message), "completed_at": F.when(last, now)}
    return _change(jobs, _mine(worker) & F.col("id").isin(ids), values | {c: F.lit(None) for c in LOCK})


def abandon(jobs: DataFrame, worker: str, ids: list[int], now: Column) -> DataFrame:
    """Pending at once; the attempt is given back and the error forgotten."""
    values = {"status": F.lit("pending"), "attempts": F.greatest(F.lit(0), F.col("attempts") - 1), "available_at": now, "error_code": F.lit(None), "error_message": F.lit(None)}
    return _change(jobs, _mine(worker) & F.col("id").isin(ids), values | {c: F.lit(None) for c in LOCK})


def renew(jobs: DataFrame, worker: str, ids: list[int], now: Column, seconds: int) -> DataFrame:
    until = now + F.make_dt_interval(secs=F.lit(seconds).cast("decimal(18,6)"))
    return _change(jobs, _mine(worker) & F.col("id").isin(ids), {"lease_until": until})


def retry_failed(jobs: DataFrame, restored: DataFrame, now: Column) -> DataFrame:
    """The failed jobs ``restored`` (id) are pending again with all their attempts."""
    j = jobs.join(restored.select("id", F.lit(True).alias("_again")), "id", "left")
    values = {"status": F.lit("pending"), "attempts": F.lit(0), "available_at": now, "completed_at": F.lit(None), **{c: F.lit(None) for c in LOCK}}
    return _change(j, F.coalesce("_again", F.lit(False)), values).drop("_again").select(*jobs.columns)


def next_jobs(finished: DataFrame, semantic: bool = True) -> DataFrame:
    """Jobs that follow ``finished`` (job_type, attachment_id, document_id, status, mime_type) in the pipeline.

    download -> extract -> ocr or transcribe where the text is missing -> embed (priority 200).
    """
    mime = F.coalesce("mime_type", F.lit(""))
    image = (mime == "application/pdf") | mime.startswith("image/")
    media = mime.startswith("audio/") | mime.startswith("video/")
    done = F.col("status") == "completed"
    embed = F.lit("embed") if semantic else F.lit(None).cast("string")
    follows = (
        F.when((F.col("job_type") == "download") & (F.col("status") == "downloaded"), "extract")
        .when((F.col("job_type") == "extract") & (F.col("status") == "needs-ocr") & image, "ocr")
        .when((F.col("job_type") == "extract") & (F.col("status") == "needs-transcription") & media, "transcribe")
        .when(F.col("job_type").isin("extract", "ocr", "transcribe") & done, embed)
    )
    out = finished.select(follows.alias("job_type"), "attachment_id", "document_id").filter("job_type IS NOT NULL").distinct()
    return out.withColumn("priority", F.when(F.col("job_type") == "embed", 200).otherwise(100))
