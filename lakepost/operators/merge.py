"""Set-based changes of state: identity resolution, merges, soft deletes, prunes, ledgers, jobs, blobs.

Each is a pure function from snapshots to a snapshot; time is a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from lakepost.operators.rules import NoiseRules


def last_wins(batch: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return batch.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def last_of(batch: DataFrame, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """The row of each key that is the greatest by ``by`` (all other columns if not given): combined before the shuffle."""
    rest = [c for c in batch.columns if c not in keys]
    order = [*(by or []), *[c for c in rest if c not in (by or [])]]
    plain = [c for c in order if not isinstance(batch.schema[c].dataType, MapType)]
    top = batch.filter(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)).groupBy(*keys).agg(F.max(F.struct(*plain)).alias("_top"))
    return top.select(*[F.col(k) if k in keys else F.col(f"_top.{k}").alias(k) for k in batch.columns if k in keys or k in plain])


def upsert_mails(stored: DataFrame, batch: DataFrame, rules: NoiseRules | None = None) -> DataFrame:
    """Stored mails after a harvested batch.

    Rows without an entry_id are skipped; of repeated rows the last by harvested_at counts; a mail that
    is known by its source identity, by its legacy id in its store or by its id keeps its
    stored entry_id; all other columns are overwritten, but a source identity never becomes null;
    ``kind`` follows from the rules if they are given.
    """
    b = batch.filter(F.length(F.trim("entry_id")) > 0)
    by = [c for c in ("harvested_at",) if c in b.columns]
    b = resolve_identity(stored, last_of(b, ["entry_id"], by))
    b = b.withColumn("entry_id", F.coalesce("resolved_id", "entry_id")).drop("resolved_id")
    b = last_of(b, ["entry_id"], by)
    if rules is not None:
        b = b.withColumn("kind", F.when(F.size(rules.hits()) > 0, F.lit("alert")).otherwise(F.lit("mail")))
    return upsert(stored, b.select(*stored.columns), ["entry_id"], keep=("source_identity",))


def resolve_identity(target: DataFrame, batch: DataFrame) -> DataFrame:
    """batch with ``resolved_id``: the stored entry_id by source identity, else by legacy id and store, else by entry id."""
    by_source = target.filter("source_identity IS NOT NULL").groupBy("source_identity").agg(F.min("entry_id").alias("_a"))
    # a legacy id counts in its folder only, but for one service whose ids hold for the whole store
    if "folder_path" in target.columns and "folder_path" in batch.columns:
        own = target.filter("source_identity IS NULL").select(F.col("entry_id").alias("legacy_entry_id"), "store_id", F.col("folder_path").alias("_folder"), F.col("entry_id").alias("_id"))
        j = batch.join(by_source, "source_identity", "left").join(own, ["legacy_entry_id", "store_id"], "left")
        j = j.withColumn("_b", F.when((F.col("_folder") == F.col("folder_path")) | F.col("store_id").startswith("outlook"), F.col("_id"))).drop("_folder", "_id")
        known = target.groupBy("entry_id").agg(F.min("entry_id").alias("_c"))
        return j.join(known, "entry_id", "left").withColumn("resolved_id", F.coalesce("_a", "_b", "_c")).drop("_a", "_b", "_c")
    legacy = target.filter("source_identity IS NULL").groupBy(F.col("entry_id").alias("legacy_entry_id"), "store_id").agg(F.min("entry_id").alias("_b"))
    by_id = target.groupBy("entry_id").agg(F.min("entry_id").alias("_c"))
    j = batch.join(by_source, "source_identity", "left").join(legacy, ["legacy_entry_id", "store_id"], "left").join(by_id, "entry_id", "left")
    return j.withColumn("resolved_id", F.coalesce("_a", "_b", "_c")).drop("_a", "_b", "_c")


def upsert(target: DataFrame, batch: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """target overwritten by batch on keys; columns in ``keep`` never become null."""
    t, b = target.alias("t"), batch.withColumn("_new", F.lit(True)).alias("b")
    j = t.join(b, [F.col(f"t.{k}") == F.col(f"b.{k}") for k in keys], "full_outer")
    pick = lambda c: F.coalesce(f"b.{c}", f"t.{c}") if c in keys or c in keep else F.when(F.col("b._new"), F.col(f"b.{c}")).otherwise(F.col(f"t.{c}"))
    return j.select(*[pick(c).alias(c) for c in target.columns])


def soft_delete_diff(stored: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """stored rows with is_deleted: true for those no longer seen."""
    return stored.join(seen.select(*keys).distinct().withColumn("_s", F.lit(True)), keys, "left").withColumn("is_deleted", F.col("_s").isNull()).drop("_s")


def generation_prune(rows: DataFrame, generation: int, failed: DataFrame | None = None, key: str = "id") -> DataFrame:
    """Rows last seen in this generation, and those whose fetch failed."""
    if failed is None:
        return rows.filter(F.col("last_seen_generation") == generation)
    f = failed.select(key).distinct().withColumn("_f", F.lit(True))
    return rows.join(f, key, "left").filter((F.col("last_seen_generation") == generation) | F.col("_f")).drop("_f")


def merge_retries(ledger: DataFrame, failures: DataFrame, key: str) -> DataFrame:
    """attempts + failures, the first failure kept, the last one's code."""
    new = failures.groupBy(key).agg(F.count(F.lit(1)).alias("more"), F.min("failed_at").alias("first_new"), F.max("failed_at").alias("last_new"), F.max_by("error_code", "failed_at").alias("code_new"))
    j = ledger.join(new, key, "full_outer")
    return j.select(
        key, (F.coalesce("attempts", F.lit(0)) + F.coalesce("more", F.lit(0))).cast("long").alias("attempts"), F.coalesce("first_failed_at", "first_new").alias("first_failed_at"),
        F.coalesce("last_new", "last_failed_at").alias("last_failed_at"), F.coalesce("code_new", "error_code").alias("error_code"),
    )


def recover_expired(jobs: DataFrame, now: Column) -> DataFrame:
    """Expired leases: failed at the last attempt, else pending; an earlier diagnosis stays."""
    gone = (F.col("status") == "running") & (F.col("lease_until") <= now)
    return jobs.withColumn("error_code", F.when(gone, F.coalesce("error_code", F.lit("lease-expired"))).otherwise(F.col("error_code"))).withColumn(
        "status", F.when(gone & (F.col("attempts") >= F.col("max_attempts")), "failed").when(gone, "pending").otherwise(F.col("status"))
    )


def ready_jobs(jobs: DataFrame, now: Column, limit: int) -> DataFrame:
    """The next jobs of the queue: by priority, then id."""
    return jobs.filter((F.col("status") == "pending") & (F.col("attempts") < F.col("max_attempts")) & (F.col("available_at") <= now)).orderBy("priority", "id").limit(limit)


def finish_job(jobs: DataFrame, worker: str, ok: Column, now: Column, delay_s: int) -> DataFrame:
    """Complete or fail the worker's running jobs; others stay as they are."""
    mine = (F.col("status") == "running") & (F.col("locked_by") == worker)
    again = F.col("attempts") < F.col("max_attempts")
    return jobs.withColumn("available_at", F.when(mine & ~ok & again, now + F.expr(f"INTERVAL {int(delay_s)} SECONDS")).otherwise(F.col("available_at"))).withColumn(
        "status", F.when(mine & ok, "completed").when(mine & again, "pending").when(mine, "failed").otherwise(F.col("status"))
    )


def retry_newest_failed(jobs: DataFrame) -> DataFrame:
    """Failed jobs to restore: the newest of each (type, attachment) without an active twin; without an attachment all.

    Jobs without an attachment pass by: they never meet in one task.
    """
    key = ["job_type", "attachment_id"]
    failed = jobs.filter("status = 'failed'")
    held = jobs.filter("attachment_id IS NOT NULL AND status IN ('failed', 'pending', 'running')")
    best = held.groupBy(*key).agg(F.max(F.when(F.col("status") == "failed", F.col("id"))).alias("id"), F.bool_or(F.col("status") != "failed").alias("_busy")).filter("NOT _busy AND id IS NOT NULL")
    return failed.filter("attachment_id IS NULL").unionByName(failed.join(best.select("id"), "id", "left_semi").select(*jobs.columns).filter("attachment_id IS NOT NULL"))


def counts_by_status(jobs: DataFrame, statuses: list[str]) -> DataFrame:
    """One row for each status of the list, 0 if there is none."""
    n = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(s).alias("status"), F.count_if(F.col("status") == s).alias("n")) for i, s in enumerate(statuses)])
    return jobs.agg(n.alias("x")).select(F.explode("x").alias("x")).select("x.status", "x.n")


def orphans(blobs: DataFrame, used: DataFrame, busy: DataFrame, cutoff: Column, key: str = "id") -> DataFrame:
    """Blobs old enough that no active attachment and no running job holds."""
    return blobs.filter(F.col("created_at") <= cutoff).join(used, key, "left_anti").join(busy, key, "left_anti")


def busy_blobs(running: DataFrame, documents: DataFrame, attachments: DataFrame) -> DataFrame:
    """(blob_id) in use by running jobs (attachment_id, document_id): of their attachment, else of that of their document."""
    j = running.join(documents.select("document_id", F.col("attachment_id").alias("_of_document")), "document_id", "left")
    ids = j.select(F.coalesce("attachment_id", "_of_document").alias("id")).filter("id IS NOT NULL").distinct()
    return attachments.filter("blob_id IS NOT NULL").join(ids, "id", "left_semi").select("blob_id").distinct()


def collect_garbage(blobs: DataFrame, attachments: DataFrame, running: DataFrame, documents: DataFrame, now: Column, grace_hours: int = 1) -> tuple[DataFrame, DataFrame]:
    """(blobs to delete, attachments without them): blobs beyond the grace that no living attachment and no running job holds.

    The plan looks at the tables as they are when it runs, so asking again is the check before the
    files are deleted.  Deleted attachments forget their blob.
    """
    used = attachments.filter("NOT is_deleted AND blob_id IS NOT NULL").select(F.col("blob_id").alias("id"))
    busy = busy_blobs(running, documents, attachments).select(F.col("blob_id").alias("id"))
    gone = orphans(blobs, used, busy, now - F.make_dt_interval(hours=F.lit(grace_hours)))
    marked = attachments.join(gone.select(F.col("id").alias("blob_id"), F.lit(True).alias("_gone")), "blob_id", "left")
    return gone, marked.select(*[F.when(F.col("_gone"), F.lit(None)).otherwise(F.col(c)).alias(c) if c == "blob_id" else F.col(c) for c in attachments.columns])


def size_mismatch(declared: Column, actual: Column) -> Column:
    """Whether a size is grossly other than declared: by more than 4 KiB and one percent; a size that isn't declared never is."""
    return (declared > 0) & (F.abs(actual - declared) > F.greatest(F.lit(4096), F.floor(declared / 100)))
