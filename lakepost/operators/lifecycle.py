"""Attachments and documents: set-based changes of state of the whole tables.

Each operator is a function from snapshots to snapshots; time is a parameter.  Nothing is updated
row by row: keyed full outer joins decide for every row at once.  Columns that aren't named stay as
they are; keys that are null match nothing; of repeated rows of a batch the last by all columns counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakepost.operators.merge import last_of

KEY = ["mail_entry_id", "provider", "provider_attachment_key"]
METADATA = ["filename", "mime_type", "content_id", "is_inline", "part_id", "provider_message_key"]


def upsert_attachments(stored: DataFrame, seen: DataFrame, messages: DataFrame, generation: int, now: Column) -> DataFrame:
    """``stored`` after the attachments ``seen`` of ``messages`` (mail_entry_id, provider).

    Stored attachments of the messages that aren't seen are marked deleted and keep their state.
    Metadata is refreshed; another size resets the states, the blob and the error; an unchanged
    size keeps them, even under another name.
    """
    touched = messages.select("mail_entry_id", "provider").distinct().withColumn("_touched", F.lit(True))
    new = last_of(seen.filter(F.length(F.trim("provider_attachment_key")) > 0), KEY)
    meta = [c for c in METADATA if c in stored.columns and c in new.columns]
    n = new.select(*KEY, F.lit(True).alias("_seen"), F.col("size_bytes").alias("_size"), *[F.col(c).alias(f"_n_{c}") for c in meta])
    j = stored.join(n, KEY, "full_outer").join(touched, ["mail_entry_id", "provider"], "left")
    fresh, got = F.col("_seen") & F.col("download_status").isNull(), F.coalesce("_seen", F.lit(False))
    reset = fresh | F.coalesce(F.col("_seen") & (F.col("size_bytes") != F.col("_size")), F.lit(False))
    out = {
        "download_status": F.when(reset, "metadata-only").otherwise(F.col("download_status")),
        "processing_status": F.when(reset, "pending").otherwise(F.col("processing_status")),
        "size_bytes": F.when(got, F.col("_size")).otherwise(F.col("size_bytes")),
        "is_deleted": F.when(got, F.lit(False)).when(F.col("_touched"), F.lit(True)).otherwise(F.col("is_deleted")),
        "last_seen_generation": F.when(got, F.lit(generation)).otherwise(F.col("last_seen_generation")),
        "updated_at": F.when(got | F.col("_touched"), now).otherwise(F.col("updated_at")),
        "created_at": F.when(fresh, now).otherwise(F.col("created_at")),
    }
    out |= {c: F.when(~reset, F.col(c)) for c in ("blob_id", "error_code", "error_message")}
    out |= {c: F.when(got, F.col(f"_n_{c}")).otherwise(F.col(c)) for c in meta}
    return j.select(*[out[c].alias(c) if c in out else F.col(c) for c in stored.columns])


def to_reset(attachments: DataFrame) -> DataFrame:
    """Attachments (id) whose derived documents and jobs go, and that are downloaded anew."""
    return attachments.filter("download_status = 'metadata-only' AND NOT is_deleted").select("id")


def mark_downloaded(attachments: DataFrame, downloads: DataFrame, now: Column) -> DataFrame:
    """``downloads`` (id, blob_id, mime_type): the attachments have a blob and wait for extraction."""
    d = last_of(downloads, ["id"]).select("id", F.col("blob_id").alias("_blob"), F.col("mime_type").alias("_mime"), F.lit(True).alias("_got"))
    j = attachments.join(d, "id", "left")
    got = F.coalesce("_got", F.lit(False))
    out = {"blob_id": F.when(got, F.col("_blob")).otherwise(F.col("blob_id")), "mime_type": F.when(got, F.col("_mime")).otherwise(F.col("mime_type")), "download_status": F.when(got, "downloaded").otherwise(F.col("download_status")),
           "processing_status": F.when(got, "pending").otherwise(F.col("processing_status")), "updated_at": F.when(got, now).otherwise(F.col("updated_at"))}
    out |= {c: F.when(~got, F.col(c)) for c in ("inline_base64_data", "error_code", "error_message") if c in attachments.columns}
    return j.select(*[out[c].alias(c) if c in out else F.col(c) for c in attachments.columns])


def ensure_documents(documents: DataFrame, sources: DataFrame, version: int, now: Column) -> DataFrame:
    """One document for each attachment of ``sources`` (attachment_id, mail_entry_id, source_sha256, mime_type) and pipeline version.

    A new source makes the document pending and takes its results away; the same source only
    refreshes the media type; attachments without a hash are no sources.
    """
    s = last_of(sources.filter(F.length(F.trim("source_sha256")) > 0), ["attachment_id"])
    s = s.select("attachment_id", F.col("mail_entry_id").alias("_mail"), F.lower("source_sha256").alias("_hash"), F.col("mime_type").alias("_mime"), F.lit(version).alias("pipeline_version"))
    j = documents.join(s, ["attachment_id", "pipeline_version"], "full_outer")
    got = F.col("_hash").isNotNull()
    changed = got & ~F.lower("source_sha256").eqNullSafe(F.col("_hash"))
    fresh = got & F.col("status").isNull()
    out = {
        "mail_entry_id": F.coalesce("mail_entry_id", "_mail"), "document_kind": F.coalesce("document_kind", F.lit("attachment")), "source_sha256": F.when(got, F.col("_hash")).otherwise(F.col("source_sha256")),
        "detected_mime_type": F.when(got, F.col("_mime")).otherwise(F.col("detected_mime_type")), "status": F.when(changed, "pending").otherwise(F.col("status")), "created_at": F.when(fresh, now).otherwise(F.col("created_at")),
    }
    out |= {c: F.when(~changed, F.col(c)) for c in ("extractor_name", "extractor_version", "model_name", "confidence", "error_code", "error_message", "processed_at") if c in documents.columns}
    return j.select(*[out[c].alias(c) if c in out else F.col(c) for c in documents.columns])


def extraction_status(mime: Column, clean_length: Column, missing_pages: Column, ocr_done: Column | None = None, transcribed: Column | None = None) -> Column:
    """``needs-ocr``, ``needs-transcription`` or ``completed`` of an extraction."""
    no = F.lit(False)
    image = (mime == "application/pdf") | mime.startswith("image/")
    media = mime.startswith("audio/") | mime.startswith("video/")
    gaps = (mime == "application/pdf") & (F.coalesce(missing_pages, F.lit(0)) > 0)
    empty = F.coalesce(clean_length, F.lit(0)) == 0
    return F.when(~F.coalesce(ocr_done if ocr_done is not None else no, no) & image & (empty | gaps), "needs-ocr").when(~F.coalesce(transcribed if transcribed is not None else no, no) & media & empty, "needs-transcription").otherwise("completed")


def save_extractions(documents: DataFrame, segments: DataFrame, results: DataFrame, new_segments: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(documents, segments) after ``results`` (document_id, mime_type, extractor_name, missing_pages, language): segments are replaced by document."""
    r = last_of(results, ["document_id"])
    size = new_segments.groupBy("document_id").agg(F.sum(F.length("clean_text")).alias("_size"))
    r = r.join(size, "document_id", "left").select("document_id", F.lit(True).alias("_got"), F.col("mime_type").alias("_mime"), F.col("extractor_name").alias("_extractor"), F.col("language").alias("_language"), extraction_status(F.col("mime_type"), F.col("_size"), F.col("missing_pages")).alias("_status"))
    j = documents.join(r, "document_id", "left")
    got = F.coalesce("_got", F.lit(False))
    new = {"detected_mime_type": "_mime", "extractor_name": "_extractor", "detected_language": "_language", "status": "_status"}
    out = {c: F.when(got, F.col(n)).otherwise(F.col(c)) for c, n in new.items()} | {c: F.when(~got, F.col(c)) for c in ("error_code", "error_message")} | {"processed_at": F.when(got, now).otherwise(F.col("processed_at"))}
    kept = segments.join(r.select("document_id"), "document_id", "left_anti").select(*segments.columns)
    added = new_segments.join(r.select("document_id"), "document_id", "left_semi").select(*[F.col(c) if c in new_segments.columns else F.lit(None).alias(c) for c in segments.columns])
    return j.select(*[out[c].alias(c) if c in out and c in documents.columns else F.col(c) for c in documents.columns]), kept.unionByName(added)


def mark_documents(documents: DataFrame, segments: DataFrame, marks: DataFrame, status: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """(documents, segments) with the documents of ``marks`` (document_id, error_code, error_message) failed or skipped; skipped ones lose their segments."""
    m = last_of(marks, ["document_id"]).select("document_id", F.col("error_code").alias("_code"), F.col("error_message").alias("_message"), F.lit(True).alias("_got"))
    j = documents.join(m, "document_id", "left")
    got = F.coalesce("_got", F.lit(False))
    out = {"status": F.when(got, status).otherwise(F.col("status")), "error_code": F.when(got, F.col("_code")).otherwise(F.col("error_code")), "error_message": F.when(got, F.col("_message")).otherwise(F.col("error_message")), "processed_at": F.when(got, now).otherwise(F.col("processed_at"))}
    left = segments.join(m.select("document_id"), "document_id", "left_anti").select(*segments.columns) if status == "skipped" else segments
    return j.select(*[out[c].alias(c) if c in out and c in documents.columns else F.col(c) for c in documents.columns]), left


def delete_mails(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """``tables`` (mails, attachments, documents, segments, embeddings, jobs, postings; any may be missing) without the mails ``gone`` and all that hangs on them."""
    ids = gone.select("entry_id").filter("entry_id IS NOT NULL").distinct()
    out = dict(tables)
    without = lambda name, key, dead, dead_key: out[name].join(dead.select(F.col(dead_key).alias(key)), key, "left_anti").select(*out[name].columns)
    dead_docs = dead_segments = None
    if "documents" in out:
        dead_docs = out["documents"].join(ids.withColumnRenamed("entry_id", "mail_entry_id"), "mail_entry_id", "left_semi").select("document_id")
    if "segments" in out and dead_docs is not None:
        dead_segments = out["segments"].join(dead_docs, "document_id", "left_semi").select("segment_id").distinct()
    if "embeddings" in out and dead_segments is not None:
        out["embeddings"] = without("embeddings", "segment_id", dead_segments, "segment_id")
    if "jobs" in out and dead_docs is not None:
        out["jobs"] = without("jobs", "document_id", dead_docs, "document_id")
    if "segments" in out and dead_docs is not None:
        out["segments"] = without("segments", "document_id", dead_docs, "document_id")
    for name, key in (("documents", "mail_entry_id"), ("attachments", "mail_entry_id"), ("mails", "entry_id"), ("postings", "doc_id")):
        if name in out:
            out[name] = without(name, key, ids, "entry_id")
    return out


def delete_messages(messages: DataFrame, tables: dict[str, DataFrame], gone: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Messages without those ``gone`` (account_id, gmail_message_id), and the corpus without their mails."""
    ids = gone.select("account_id", "gmail_message_id").distinct()
    mails = ids.select(F.concat(F.lit("gmail:"), F.col("account_id").cast("string"), F.lit(":"), "gmail_message_id").alias("entry_id"))
    return messages.join(ids, ["account_id", "gmail_message_id"], "left_anti"), delete_mails(tables, mails)


def delete_account(accounts: DataFrame, messages: DataFrame, tables: dict[str, DataFrame], account: int) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """Accounts, messages and corpus without one account."""
    gone = messages.filter(F.col("account_id") == account)
    left, corpus = delete_messages(messages, tables, gone)
    return accounts.filter(F.col("id") != account), left, corpus
