"""Queries of state changes, scalars, sources and sync over the driver's tables, with SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakepost.functions import messages as msg
from lakepost.functions.text import unicode_trim
from lakepost.operators import changefeed, jobs, ledger, lifecycle, merge
from lakepost.sources import pages as page_ops
from lakepost.session import table
from lakepost.streaming import sync

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
NOW = "2026-01-01 00:00:00"


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def _now():
    return F.to_timestamp_ntz(F.lit(NOW))


def _mails(s, d):
    """One row of each mail: the greatest by all columns."""
    return merge.last_of(table(s, d, "mails"), ["entry_id"])


ONE_MAIL = "(SELECT entry_id, unnest(max(struct_pack({cols}))) FROM mails WHERE entry_id IS NOT NULL GROUP BY entry_id)"

# scalars


@query("byte_sizes", """SELECT entry_id, CASE WHEN v >= 1099511627776 THEN regexp_replace(printf('%.2f', round(v/1099511627776,2)), '\\.?0+$', '')||' TiB' WHEN v >= 1073741824 THEN regexp_replace(printf('%.2f', round(v/1073741824,2)), '\\.?0+$', '')||' GiB'
 WHEN v >= 1048576 THEN regexp_replace(printf('%.2f', round(v/1048576,2)), '\\.?0+$', '')||' MiB' WHEN v >= 1024 THEN regexp_replace(printf('%.2f', round(v/1024,2)), '\\.?0+$', '')||' KiB' ELSE v::BIGINT||' B' END AS label FROM (SELECT DISTINCT entry_id, greatest(size::BIGINT*size, 0)::DOUBLE AS v FROM mails)""")  # fmt: skip
def _(s, d):
    return table(s, d, "mails").select("entry_id", msg.byte_size(F.col("size").cast("long") * F.col("size")).alias("label")).distinct()


@query("sender_split", r"""SELECT DISTINCT entry_id, CASE WHEN regexp_matches(x, '^\s*(.*?)\s*<\s*([^<>]+@[^<>]+)\s*>\s*$') THEN trim(trim(regexp_extract(x, '^\s*(.*?)\s*<\s*([^<>]+@[^<>]+)\s*>\s*$', 1)), '"') WHEN e <> '' THEN CASE WHEN x = e THEN '' ELSE trim(replace(x, e, '')) END ELSE x END AS name,
 CASE WHEN regexp_matches(x, '^\s*(.*?)\s*<\s*([^<>]+@[^<>]+)\s*>\s*$') THEN trim(regexp_extract(x, '^\s*(.*?)\s*<\s*([^<>]+@[^<>]+)\s*>\s*$', 2)) ELSE e END AS email
 FROM (SELECT entry_id, x, regexp_extract(x, '[A-Za-z0-9.!#$%&''*+/=?^_`{|}~\-]+@[A-Za-z0-9.\-]+', 0) AS e FROM (SELECT entry_id, coalesce(to_recips, '') AS x FROM mails))""")
def _(s, d):
    x = table(s, d, "mails").select("entry_id", msg.split_sender(F.col("to_recips")).alias("x"))
    return x.select("entry_id", "x.name", "x.email").distinct()


@query("base64url_round_trip", "SELECT DISTINCT doc_id, octet_length(encode(text)) AS bytes, sha256(text) AS hash FROM documents WHERE length(text) > 0")
def _(s, d):
    t = table(s, d, "documents").filter("length(text) > 0")
    coded = F.rtrim(F.translate(F.regexp_replace(F.base64(F.col("text").cast("binary")), "\\s", ""), "+/", "-_"), F.lit("="))
    back = msg.base64url(coded)
    return t.select("doc_id", F.octet_length(back).cast("long").alias("bytes"), F.sha2(back, 256).alias("hash")).distinct()


@query("mime_headers", "SELECT DISTINCT entry_id, trim(coalesce(subject, '')) AS subject FROM mails")
def _(s, d):
    c = F.coalesce("subject", F.lit(""))
    word = F.when(F.length(F.trim(c)) > 0, F.concat(F.lit("=?utf-8?B?"), F.regexp_replace(F.base64(c.cast("binary")), "\\s", ""), F.lit("?="))).otherwise(c)
    return table(s, d, "mails").select("entry_id", msg.decode_header(word).alias("subject")).distinct()


@query("header_join", "SELECT account_id, gmail_message_id, array_to_string(list_transform(label_ids, lambda x: lower(x)), '; ') AS joined FROM (SELECT DISTINCT * FROM messages)")
def _(s, d):
    m = table(s, d, "messages").distinct()
    headers = F.concat(F.transform("label_ids", lambda x: F.struct(F.lit("X-Label").alias("name"), F.concat(F.lit(" "), F.lower(x)).alias("value"))), F.array(F.struct(F.lit("x-label").alias("name"), F.lit("  ").alias("value")), F.struct(F.lit("Other").alias("name"), F.lit("y").alias("value"))))
    return m.select("account_id", "gmail_message_id", msg.join_headers(headers, "X-LABEL").alias("joined"))


@query("charset_names", "SELECT document_id, CASE document_id % 4 WHEN 0 THEN 'iso-8859-2' WHEN 1 THEN 'utf-8' WHEN 2 THEN 'windows-1250' ELSE 'utf-8' END AS charset FROM content_documents")
def _(s, d):
    kind = F.element_at(F.array(F.lit("text/plain; charset=\"iso-8859-2\""), F.lit("text/plain"), F.lit("text/html; Charset = windows-1250; x=y"), F.lit(None).cast("string")), (F.col("document_id") % 4 + 1).cast("int"))
    return table(s, d, "content_documents").select("document_id", msg.charset_of(kind).alias("charset"))


@query("body_parts", "SELECT DISTINCT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE trim(text, chr(32)||chr(9)||chr(10)||chr(13)) END AS text, doc_id % 5 <> 0 AS ok FROM documents WHERE length(text) > 0")
def _(s, d):
    t = table(s, d, "documents").filter("length(text) > 0")
    coded = F.when(F.col("doc_id") % 5 == 0, F.lit("*no*")).otherwise(F.translate(F.regexp_replace(F.base64(F.col("text").cast("binary")), "\\s", ""), "+/", "-_"))
    part = msg.decode_part(coded, F.lit("text/plain; charset=utf-8"))
    return t.select("doc_id", part.alias("p")).select("doc_id", "p.text", "p.ok").distinct()


@query("simple_html", "SELECT DISTINCT segment_id, trim(regexp_replace(replace(replace(replace(clean_text, '<', ' '), '>', ' '), '&', ' '), '[\\s\\x{85}\\p{Z}]+', ' ', 'g')) AS text FROM content_segments WHERE clean_text IS NOT NULL")
def _(s, d):
    bare = F.translate("clean_text", "<>&", "   ")
    page = F.concat(F.lit("<STYLE type='x'>a{}\n</style><p>"), bare, F.lit("</p>&nbsp;<script>var x;</script>"))
    return table(s, d, "content_segments").filter("clean_text IS NOT NULL").select("segment_id", msg.strip_html(page).alias("text")).distinct()


@query("file_names", "SELECT document_id, coalesce(nullif(trim(CASE WHEN document_id % 3 = 0 THEN '  ' ELSE filename END), ''), 'attachment-'||document_id) AS name FROM content_documents")
def _(s, d):
    given = F.when(F.col("document_id") % 3 == 0, F.lit("  ")).otherwise(F.col("filename"))
    return table(s, d, "content_documents").select("document_id", msg.filename_or(given, F.col("document_id")).alias("name"))


@query("message_locators", "SELECT id, CASE WHEN id % 2 = 0 THEN email END AS account, CASE WHEN id % 2 = 0 THEN id END AS uid FROM accounts")
def _(s, d):
    a = table(s, d, "accounts")
    text = msg.message_locator(F.when(F.col("id") % 2 == 0, F.col("email")).otherwise(F.lit(" ")), F.lit("INBOX"), F.lit(7), F.col("id"))
    x = a.select("id", msg.read_message_locator(text).alias("x"))
    return x.select("id", "x.account", "x.uid")


@query("transcript_json", "SELECT DISTINCT document_id, s.ordinal, s.start_ms, s.end_ms, regexp_replace(trim(regexp_replace(s.clean_text, '[ \\t]+', ' ', 'g')), '[ \\t]+', ' ', 'g') AS text FROM content_segments s JOIN content_documents d USING (document_id) WHERE s.start_ms IS NOT NULL AND s.end_ms >= s.start_ms AND s.start_ms >= 0 AND length(trim(regexp_replace(s.clean_text, '\\s+', ' ', 'g'))) > 0")
def _(s, d):
    seg = table(s, d, "content_segments").join(table(s, d, "content_documents").select("document_id"), "document_id", "left_semi")
    seg = seg.filter("start_ms IS NOT NULL AND end_ms >= start_ms AND start_ms >= 0").select("document_id", "ordinal", "start_ms", "end_ms", "clean_text").distinct()
    item = F.struct(F.col("clean_text").alias("text"), F.struct(F.col("start_ms").alias("from"), F.col("end_ms").alias("to")).alias("offsets"))
    # each segment as a transcript of its own with an empty part, as the programs write them
    text = F.to_json(F.struct(F.array(item, F.struct(F.lit(" ").alias("text"), F.struct(F.lit(None).cast("long").alias("from"), F.lit(None).cast("long").alias("to")).alias("offsets"))).alias("transcription"), F.struct(F.lit("pl").alias("language")).alias("result")))
    x = seg.select("document_id", "ordinal", F.explode(msg.transcript_segments(text)["segments"]).alias("x"))
    return x.select("document_id", "ordinal", "x.start_ms", "x.end_ms", F.col("x.clean_text").alias("text")).distinct()


@query("label_flags", "SELECT account_id, gmail_message_id, coalesce(list_contains(label_ids,'UNREAD'), false) AS unread, coalesce(list_contains(label_ids,'TRASH'), false) AS trash, coalesce(list_contains(label_ids,'SPAM'), false) AS spam FROM (SELECT DISTINCT * FROM messages)")
def _(s, d):
    m = table(s, d, "messages").distinct().select("account_id", "gmail_message_id", msg.label_flags(F.col("label_ids")).alias("f"))
    return m.select("account_id", "gmail_message_id", "f.unread", "f.trash", "f.spam")


@query("message_keys", "SELECT DISTINCT account_id, gmail_message_id FROM messages WHERE length(gmail_message_id) > 0 AND account_id IS NOT NULL")
def _(s, d):
    m = table(s, d, "messages").filter("length(gmail_message_id) > 0 AND account_id IS NOT NULL")
    x = m.select(msg.parse_message_key(msg.message_key(F.col("account_id"), F.col("gmail_message_id"))).alias("k"))
    return x.select("k.account_id", F.col("k.message_id").alias("gmail_message_id")).distinct()


@query("extractor_names", "SELECT document_id, CASE WHEN detected_mime_type = 'application/pdf' THEN 'pdfpig' WHEN detected_mime_type LIKE '%wordprocessingml.document' THEN 'openxml-word' WHEN detected_mime_type LIKE '%spreadsheetml.sheet' THEN 'openxml-excel' WHEN detected_mime_type LIKE '%presentationml.presentation' THEN 'openxml-powerpoint' WHEN detected_mime_type = 'text/html' THEN 'html' ELSE 'plain-text' END AS name FROM content_documents")
def _(s, d):
    return table(s, d, "content_documents").select("document_id", msg.extractor_name(F.col("detected_mime_type")).alias("name"))


@query("diagnostics", "SELECT DISTINCT doc_id, substring(trim(translate(text, chr(13)||chr(10), '  ')), 1, 500) AS message FROM documents WHERE text IS NOT NULL")
def _(s, d):
    return table(s, d, "documents").filter("text IS NOT NULL").select("doc_id", msg.diagnostic(F.col("text")).alias("message")).distinct()


@query("utc_texts", "SELECT event_id, strftime(make_timestamp((event_id * 86399999) * 1000), '%Y-%m-%d %H:%M:%S') AS at FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", msg.utc_text(F.col("event_id") * 86399999).alias("at"))


@query("source_identities", "SELECT DISTINCT entry_id, CASE WHEN p IN ('gmail','imap','outlook') THEN p||':'||sha256(entry_id) END AS identity FROM (SELECT entry_id, lower(trim(split_part(entry_id, ':', 1))) AS p FROM mails)")
def _(s, d):
    p = F.split_part("entry_id", F.lit(":"), F.lit(1))
    return table(s, d, "mails").select("entry_id", msg.source_identity(p, F.col("entry_id")).alias("identity")).distinct()


@query("sender_addresses", "SELECT DISTINCT entry_id, CASE WHEN contains(sender_name, '@') THEN sender_name WHEN contains(sender_email, '@') THEN sender_email WHEN contains(to_recips, '@') THEN to_recips ELSE '' END AS address FROM mails")
def _(s, d):
    return table(s, d, "mails").select("entry_id", msg.smtp_address(F.col("sender_name"), F.col("sender_email"), F.col("to_recips")).alias("address")).distinct()


@query("unicode_trim", "SELECT DISTINCT doc_id, length(regexp_replace(regexp_replace(text, '^[\\s\\p{Z}\\x{85}]+', ''), '[\\s\\p{Z}\\x{85}]+$', '')) AS n FROM documents WHERE text IS NOT NULL")
def _(s, d):
    return table(s, d, "documents").filter("text IS NOT NULL").select("doc_id", F.length(unicode_trim(F.col("text"))).cast("long").alias("n")).distinct()


# pages and blobs


@query("poor_pages", "SELECT DISTINCT segment_id, length(regexp_replace(raw_text,'[^\\p{L}\\p{Nd}]','','g')) < 30 OR length(raw_text) - length(replace(raw_text, chr(65533), '')) > greatest(2, length(raw_text) // 20) AS poor FROM (SELECT segment_id, coalesce(raw_text, '') AS raw_text FROM content_segments)")
def _(s, d):
    return table(s, d, "content_segments").select("segment_id", page_ops.poor_text(F.col("raw_text")).alias("poor")).distinct()


_PAGES = "(SELECT document_id, page_number, max(raw_text) AS raw_text FROM content_segments WHERE page_number IS NOT NULL GROUP BY 1, 2)"


@query("page_merge", f"SELECT document_id, page_number, CASE WHEN length(raw_text) % 3 = 0 THEN 'ocr' ELSE 'text' END AS source FROM {_PAGES} WHERE length(regexp_replace(raw_text,'[^\\p{{L}}\\p{{Nd}}]','','g')) >= 30 AND length(raw_text) - length(replace(raw_text, chr(65533), '')) <= greatest(2, length(raw_text) // 20)")
def _(s, d):
    p = table(s, d, "content_segments").filter("page_number IS NOT NULL").groupBy("document_id", "page_number").agg(F.max("raw_text").alias("raw_text")).filter(~page_ops.poor_text(F.col("raw_text")))
    text = p.withColumn("raw_text", F.when(F.length("raw_text") % 3 == 0, F.lit("")).otherwise(F.col("raw_text")))
    return page_ops.merge_pages(text, p, ["document_id"]).select("document_id", "page_number", "source")


@query("mean_scores", "SELECT document_id, round(avg(confidence) FILTER (confidence >= 0.9), 6) AS score FROM (SELECT DISTINCT segment_id, document_id, confidence FROM content_segments) GROUP BY 1")
def _(s, d):
    # scores of one segment are few; those of a document are averaged in the JVM without a list
    seg = table(s, d, "content_segments").select("segment_id", "document_id", "confidence").distinct()
    one = seg.select("document_id", page_ops.mean_score(F.array_compact(F.array("confidence")), 0.9).alias("score"))
    return one.groupBy("document_id").agg(F.round(F.avg("score"), 6).alias("score"))


@query("ocr_fallback", "SELECT DISTINCT segment_id, CASE WHEN segment_id % 2 = 0 THEN clean_text ELSE 'second' END AS text FROM content_segments WHERE length(trim(clean_text)) > 0")
def _(s, d):
    seg = table(s, d, "content_segments").filter("length(trim(clean_text)) > 0")
    return seg.select("segment_id", page_ops.fallback(F.when(F.col("segment_id") % 2 == 0, F.col("clean_text")).otherwise(F.lit(" ")), F.lit("second")).alias("text")).distinct()


@query("new_blobs", "SELECT sha256(text) AS sha256, substring(sha256(text),1,2)||'/'||substring(sha256(text),3,2)||'/'||sha256(text)||'.blob' AS path, octet_length(encode(any_value(text))) AS original_size FROM documents WHERE text IS NOT NULL AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE text IS NOT NULL AND doc_id % 2 = 0) GROUP BY 1, 2")
def _(s, d):
    docs = table(s, d, "documents").filter("text IS NOT NULL").select("doc_id", F.col("text").cast("binary").alias("content"))
    stored = docs.filter("doc_id % 2 = 0").select(F.sha2("content", 256).alias("sha256")).distinct()
    return page_ops.new_blobs(docs, stored, _now()).select("sha256", "path", "original_size")


# attachments and documents, taken from content_documents

_ATT = "SELECT document_id AS id, mail_entry_id, 'imap' AS provider, 'k'||document_id AS provider_attachment_key, filename, detected_mime_type AS mime_type, (1000 + document_id % 7 * 100)::BIGINT AS size_bytes, CASE WHEN document_id % 2 = 0 THEN 'downloaded' ELSE 'failed' END AS download_status, 'extracted' AS processing_status, document_id AS blob_id, CASE WHEN document_id % 2 = 1 THEN 'e' END AS error_code, false AS is_deleted, 1::BIGINT AS last_seen_generation FROM content_documents"


def _attachments(s, d):
    return table(s, d, "content_documents").selectExpr(
        "document_id AS id", "mail_entry_id", "'imap' AS provider", "concat('k', document_id) AS provider_attachment_key", "filename", "detected_mime_type AS mime_type", "1000 + document_id % 7 * 100 AS size_bytes", "CASE WHEN document_id % 2 = 0 THEN 'downloaded' ELSE 'failed' END AS download_status",
        "'extracted' AS processing_status", "document_id AS blob_id", "CASE WHEN document_id % 2 = 1 THEN 'e' END AS error_code", "CAST(NULL AS string) AS error_message", "false AS is_deleted", "1L AS last_seen_generation", "CAST(NULL AS timestamp_ntz) AS created_at", "CAST(NULL AS timestamp_ntz) AS updated_at",
    )


@query("attachment_upsert", f"""SELECT mail_entry_id, provider_attachment_key, size, download_status, processing_status, blob_id, error_code, is_deleted, generation FROM (
 SELECT mail_entry_id, provider_attachment_key, CASE WHEN seen THEN size_bytes + grown ELSE size_bytes END AS size, CASE WHEN seen AND grown > 0 THEN 'metadata-only' ELSE download_status END AS download_status, CASE WHEN seen AND grown > 0 THEN 'pending' ELSE processing_status END AS processing_status,
  CASE WHEN NOT (seen AND grown > 0) THEN blob_id END AS blob_id, CASE WHEN NOT (seen AND grown > 0) THEN error_code END AS error_code, CASE WHEN seen THEN false WHEN touched THEN true ELSE is_deleted END AS is_deleted, CASE WHEN seen THEN 2 ELSE last_seen_generation END AS generation
  FROM (SELECT *, id % 5 <> 0 AND id % 3 <> 0 AS seen, id % 3 <> 0 AS touched, CASE WHEN id % 4 = 0 THEN 5 ELSE 0 END AS grown FROM ({_ATT})))
 UNION ALL SELECT mail_entry_id, 'new'||id, 7, 'metadata-only', 'pending', NULL, NULL, false, 2 FROM ({_ATT}) WHERE id % 11 = 1""")  # fmt: skip
def _(s, d):
    a = _attachments(s, d)
    seen = a.filter("id % 5 <> 0 AND id % 3 <> 0").withColumn("size_bytes", F.col("size_bytes") + F.when(F.col("id") % 4 == 0, 5).otherwise(0))
    new = a.filter("id % 11 = 1").withColumn("provider_attachment_key", F.concat(F.lit("new"), F.col("id"))).withColumn("size_bytes", F.lit(7).cast("long"))
    cols = ["mail_entry_id", "provider", "provider_attachment_key", "filename", "mime_type", "size_bytes"]
    # a message is told by its attachments here: the messages touched are those of ids that three doesn't divide
    touched = a.filter("id % 3 <> 0").select("id", "mail_entry_id", "provider")
    stored = a.withColumn("mail_entry_id", F.concat("mail_entry_id", F.lit("|"), "id"))
    tag = lambda df: df.withColumn("mail_entry_id", F.concat("mail_entry_id", F.lit("|"), "id"))
    out = lifecycle.upsert_attachments(stored, tag(seen).select(*cols).unionByName(tag(new).select(*cols)), tag(touched).select("mail_entry_id", "provider"), 2, _now())
    return out.select(F.regexp_replace("mail_entry_id", r"\|\d+$", "").alias("mail_entry_id"), "provider_attachment_key", F.col("size_bytes").alias("size"), "download_status", "processing_status", "blob_id", "error_code", "is_deleted", F.col("last_seen_generation").alias("generation"))


@query("mark_downloaded", f"SELECT id, CASE WHEN id % 4 = 1 THEN id + 1 ELSE blob_id END AS blob_id, CASE WHEN id % 4 = 1 THEN 'downloaded' ELSE download_status END AS download_status, CASE WHEN id % 4 = 1 THEN 'pending' ELSE processing_status END AS processing_status, CASE WHEN id % 4 = 1 THEN NULL ELSE error_code END AS error_code FROM ({_ATT})")
def _(s, d):
    a = _attachments(s, d)
    got = a.filter("id % 4 = 1").select("id", (F.col("id") + 1).alias("blob_id"), "mime_type")
    return lifecycle.mark_downloaded(a, got, _now()).select("id", "blob_id", "download_status", "processing_status", "error_code")


def _documents(s, d):
    return table(s, d, "content_documents").select(
        "document_id", F.col("document_id").alias("attachment_id"), "mail_entry_id", "document_kind", F.sha2("filename", 256).alias("source_sha256"), "detected_mime_type", "detected_language", "extractor_name", "pipeline_version", "status", "confidence",
        F.lit(None).cast("string").alias("error_code"), F.lit(None).cast("string").alias("error_message"), F.lit(None).cast("timestamp_ntz").alias("processed_at"), F.lit(None).cast("timestamp_ntz").alias("created_at"),
    )


@query("ensure_documents", "SELECT document_id AS attachment_id, pipeline_version, CASE WHEN pipeline_version = 1 AND document_id % 3 = 0 THEN 'pending' ELSE status END AS status, CASE WHEN pipeline_version = 1 AND document_id % 3 = 0 THEN NULL ELSE confidence END AS confidence, CASE WHEN pipeline_version = 1 AND document_id % 3 <> 2 THEN 'x/y' ELSE detected_mime_type END AS mime FROM content_documents UNION ALL SELECT document_id, 1, 'pending', NULL, 'x/y' FROM content_documents WHERE pipeline_version <> 1 AND document_id % 3 <> 2")
def _(s, d):
    docs = _documents(s, d)
    src = docs.filter("document_id % 3 <> 2").select("attachment_id", "mail_entry_id", F.when(F.col("document_id") % 3 == 0, F.lit("ab")).otherwise(F.upper("source_sha256")).alias("source_sha256"), F.lit("x/y").alias("mime_type"))
    out = lifecycle.ensure_documents(docs, src, 1, _now())
    return out.select("attachment_id", "pipeline_version", "status", "confidence", F.col("detected_mime_type").alias("mime"))


@query("extraction_status", "SELECT d.document_id, CASE WHEN (detected_mime_type = 'application/pdf' OR starts_with(detected_mime_type,'image/')) AND (coalesce(n,0) = 0 OR detected_mime_type = 'application/pdf' AND d.document_id % 4 = 0) THEN 'needs-ocr' WHEN (starts_with(detected_mime_type,'audio/') OR starts_with(detected_mime_type,'video/')) AND coalesce(n,0) = 0 THEN 'needs-transcription' ELSE 'completed' END AS status, coalesce(c, 0) AS segments FROM content_documents d LEFT JOIN (SELECT document_id, sum(length(clean_text)) AS n, count(*) AS c FROM (SELECT DISTINCT segment_id, document_id, clean_text FROM content_segments) GROUP BY 1) USING (document_id)")
def _(s, d):
    docs, seg = _documents(s, d), table(s, d, "content_segments").select("segment_id", "document_id", "clean_text").distinct()
    results = docs.select("document_id", F.col("detected_mime_type").alias("mime_type"), "extractor_name", F.when(F.col("document_id") % 4 == 0, 1).otherwise(0).alias("missing_pages"), F.lit(None).cast("string").alias("language"))
    after, segments = lifecycle.save_extractions(docs, seg.limit(0), results, seg, _now())
    n = segments.groupBy("document_id").agg(F.count(F.lit(1)).alias("segments"))
    return after.join(n, "document_id", "left").select("document_id", "status", F.coalesce("segments", F.lit(0)).alias("segments"))


@query("mark_skipped", "SELECT document_id, CASE WHEN document_id % 6 = 0 THEN 'skipped' ELSE status END AS status, CASE WHEN document_id % 6 = 0 THEN 0 ELSE coalesce(c, 0) END AS segments FROM content_documents LEFT JOIN (SELECT document_id, count(*) AS c FROM (SELECT DISTINCT segment_id, document_id FROM content_segments) GROUP BY 1) USING (document_id)")
def _(s, d):
    docs, seg = _documents(s, d), table(s, d, "content_segments").select("segment_id", "document_id").distinct()
    marks = docs.filter("document_id % 6 = 0").select("document_id", F.lit("unsupported").alias("error_code"), F.lit("no extractor").alias("error_message"))
    after, left = lifecycle.mark_documents(docs, seg, marks, "skipped", _now())
    n = left.groupBy("document_id").agg(F.count(F.lit(1)).alias("segments"))
    return after.join(n, "document_id", "left").select("document_id", "status", F.coalesce("segments", F.lit(0)).alias("segments"))


@query("delete_cascade", "SELECT 'mails' AS name, count(DISTINCT entry_id) AS n FROM mails WHERE NOT starts_with(entry_id, 'imap') UNION ALL SELECT 'documents', count(*) FROM content_documents WHERE NOT starts_with(mail_entry_id, 'imap') UNION ALL SELECT 'segments', count(*) FROM (SELECT DISTINCT segment_id FROM content_segments s JOIN content_documents d USING (document_id) WHERE NOT starts_with(mail_entry_id, 'imap')) UNION ALL SELECT 'embeddings', count(*) FROM embeddings WHERE vec_id NOT IN (SELECT segment_id FROM content_segments s JOIN content_documents d USING (document_id) WHERE starts_with(mail_entry_id, 'imap'))")
def _(s, d):
    m = table(s, d, "mails").select("entry_id").distinct()
    tables = {"mails": m, "documents": table(s, d, "content_documents"), "segments": table(s, d, "content_segments").select("segment_id", "document_id").distinct(), "embeddings": table(s, d, "embeddings").select(F.col("vec_id").alias("segment_id"))}
    out = lifecycle.delete_mails(tables, m.filter(F.col("entry_id").startswith("imap")))
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in out.items()]
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    return result


@query("account_delete", "SELECT (SELECT count(*) FROM accounts WHERE id <> 5) AS accounts, (SELECT count(*) FROM (SELECT DISTINCT account_id, gmail_message_id FROM messages WHERE account_id <> 5)) AS messages, (SELECT count(DISTINCT entry_id) FROM mails WHERE NOT (starts_with(entry_id, 'gmail:5:') AND split_part(entry_id, ':', 3) IN (SELECT gmail_message_id FROM messages WHERE account_id = 5))) AS mails")
def _(s, d):
    m = table(s, d, "messages").select("account_id", "gmail_message_id").distinct()
    accounts, left, corpus = lifecycle.delete_account(table(s, d, "accounts"), m, {"mails": table(s, d, "mails").select("entry_id").distinct()}, 5)
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return n(accounts, "accounts").join(F.broadcast(n(left, "messages"))).join(F.broadcast(n(corpus["mails"], "mails")))  # one row each


# jobs, taken from orders

JOBS = "(SELECT o_orderkey AS id, 'extract' AS job_type, o_custkey AS attachment_id, CASE o_orderstatus WHEN 'F' THEN 'running' WHEN 'O' THEN 'pending' ELSE 'failed' END AS status, o_orderpriority AS priority, (o_orderkey % 4)::BIGINT AS attempts, 3::BIGINT AS max_attempts, o_orderdate AS available_at, 'w'||(o_orderkey % 3) AS locked_by, o_orderdate AS lease_until FROM orders)"
JOB_NOW = "1996-06-01 00:00:00"


def _jobs(s, d):
    return table(s, d, "orders").selectExpr("o_orderkey AS id", "'extract' AS job_type", "o_custkey AS attachment_id", "CASE o_orderstatus WHEN 'F' THEN 'running' WHEN 'O' THEN 'pending' ELSE 'failed' END AS status", "o_orderpriority AS priority", "o_orderkey % 4 AS attempts", "3L AS max_attempts", "o_orderdate AS available_at", "concat('w', o_orderkey % 3) AS locked_by", "o_orderdate AS lease_until", "CAST(NULL AS string) AS error_code", "CAST(NULL AS string) AS error_message", "CAST(NULL AS timestamp_ntz) AS completed_at", "CAST(NULL AS timestamp_ntz) AS locked_at")


def _job_now():
    return F.to_timestamp_ntz(F.lit(JOB_NOW))


_REC = f"(SELECT id, priority, available_at, max_attempts, attempts, CASE WHEN status='running' AND lease_until <= TIMESTAMP '{JOB_NOW}' THEN CASE WHEN attempts >= max_attempts THEN 'failed' ELSE 'pending' END ELSE status END AS status FROM {JOBS})"


@query("lease_next", f"SELECT id, CASE WHEN taken THEN 'running' ELSE status END AS status, CASE WHEN taken THEN attempts + 1 ELSE attempts END AS attempts FROM (SELECT *, id IN (SELECT id FROM {_REC} WHERE status = 'pending' AND attempts < max_attempts AND available_at <= TIMESTAMP '{JOB_NOW}' ORDER BY priority, id LIMIT 20) AS taken FROM {_REC})")
def _(s, d):
    return jobs.lease_next(_jobs(s, d), "me", _job_now(), 300, 20).select("id", "status", "attempts")


_FENCE = "status = 'running' AND locked_by = 'w1'"


@query("job_complete", f"SELECT id, CASE WHEN {_FENCE} AND id % 2 = 0 AND id < 4000 THEN 'completed' ELSE status END AS status FROM {JOBS}")
def _(s, d):
    return jobs.complete(_jobs(s, d), "w1", list(range(0, 4000, 2)), _job_now()).select("id", "status")


@query("job_fail", f"SELECT id, CASE WHEN {_FENCE} AND id < 4000 THEN CASE WHEN attempts >= max_attempts THEN 'failed' ELSE 'pending' END ELSE status END AS status, CASE WHEN {_FENCE} AND id < 4000 THEN TIMESTAMP '{JOB_NOW}' + INTERVAL 60 SECONDS ELSE available_at END AS available_at, CASE WHEN {_FENCE} AND id < 4000 THEN 'timeout' END AS error_code FROM {JOBS}")
def _(s, d):
    return jobs.fail(_jobs(s, d), "w1", list(range(4000)), "timeout", "took too long", _job_now(), 60).select("id", "status", "available_at", "error_code")


@query("job_abandon", f"SELECT id, CASE WHEN {_FENCE} AND id < 4000 THEN 'pending' ELSE status END AS status, CASE WHEN {_FENCE} AND id < 4000 THEN greatest(0, attempts - 1) ELSE attempts END AS attempts FROM {JOBS}")
def _(s, d):
    return jobs.abandon(_jobs(s, d), "w1", list(range(4000)), _job_now()).select("id", "status", "attempts")


@query("job_renew", f"SELECT id, CASE WHEN {_FENCE} AND id < 4000 THEN TIMESTAMP '{JOB_NOW}' + INTERVAL 90 SECONDS ELSE lease_until END AS lease_until FROM {JOBS}")
def _(s, d):
    return jobs.renew(_jobs(s, d), "w1", list(range(4000)), _job_now(), 90).select("id", "lease_until")


@query("job_retry", f"SELECT id, CASE WHEN again THEN 'pending' ELSE status END AS status, CASE WHEN again THEN 0 ELSE attempts END AS attempts FROM (SELECT *, status = 'failed' AND id = top AND NOT busy AS again FROM (SELECT *, max(CASE WHEN status='failed' THEN id END) OVER (PARTITION BY job_type, attachment_id) AS top, bool_or(status IN ('pending','running')) OVER (PARTITION BY job_type, attachment_id) AS busy FROM {JOBS}))")
def _(s, d):
    j = _jobs(s, d)
    return jobs.retry_failed(j, merge.retry_newest_failed(j), _job_now()).select("id", "status", "attempts")


@query("pipeline_next", "SELECT DISTINCT CASE WHEN status = 'needs-ocr' AND (mime = 'application/pdf' OR starts_with(mime,'image/')) THEN 'ocr' WHEN status = 'needs-transcription' AND (starts_with(mime,'audio/') OR starts_with(mime,'video/')) THEN 'transcribe' ELSE 'embed' END AS job_type, document_id, CASE WHEN status = 'completed' THEN 200 ELSE 100 END AS priority FROM (SELECT document_id, coalesce(detected_mime_type,'') AS mime, status FROM content_documents) WHERE status = 'completed' OR (status = 'needs-ocr' AND (mime = 'application/pdf' OR starts_with(mime,'image/'))) OR (status = 'needs-transcription' AND (starts_with(mime,'audio/') OR starts_with(mime,'video/')))")
def _(s, d):
    done = table(s, d, "content_documents").select(F.lit("extract").alias("job_type"), F.col("document_id").alias("attachment_id"), "document_id", "status", F.col("detected_mime_type").alias("mime_type"))
    return jobs.next_jobs(done).select("job_type", "document_id", "priority")


# accounts, messages, ledgers


@query("label_upsert", "SELECT account_id, label_id, CASE WHEN label_id IN ('INBOX','UNREAD') THEN lower(label_id) ELSE label_id END AS name, CASE WHEN label_id IN ('INBOX','UNREAD') THEN 'system' ELSE 'unknown' END AS type FROM (SELECT DISTINCT account_id, unnest(label_ids) AS label_id FROM messages)")
def _(s, d):
    used = table(s, d, "messages").select("account_id", F.explode("label_ids").alias("label_id")).distinct()
    listed = used.filter("label_id IN ('INBOX', 'UNREAD')").select("account_id", "label_id", F.lower("label_id").alias("name"), F.lit("system").alias("type"))
    return ledger.upsert_labels(listed.limit(0), listed, used)


@query("label_replace", "SELECT DISTINCT account_id, gmail_message_id, label_id FROM (SELECT account_id, gmail_message_id, unnest(CASE WHEN account_id % 2 = 0 THEN ['NEW','NEW2'] ELSE label_ids END) AS label_id FROM messages)")
def _(s, d):
    m = table(s, d, "messages").distinct()
    stored = m.select("account_id", "gmail_message_id", F.explode("label_ids").alias("label_id")).distinct()
    new = m.filter("account_id % 2 = 0").withColumn("label_ids", F.array(F.lit("NEW"), F.lit("NEW2"), F.lit("NEW")))
    return ledger.replace_labels(stored, new)


@query("error_split", "SELECT 'ok' AS outcome, count(*) AS n FROM mails WHERE length(trim(subject)) > 0 AND length(body) > 0 UNION ALL SELECT 'no-subject', count(*) FROM mails WHERE NOT coalesce(length(trim(subject)) > 0, false) UNION ALL SELECT 'no-body', count(*) FROM mails WHERE length(trim(subject)) > 0 AND NOT coalesce(length(body) > 0, false)")
def _(s, d):
    good, bad = ledger.split_valid(table(s, d, "mails").select("subject", "body"), {"no-subject": F.length(F.trim("subject")) > 0, "no-body": F.length("body") > 0})
    zero = s.createDataFrame([("no-subject",), ("no-body",)], "outcome string")
    n = bad.groupBy(F.col("error_code").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    return good.agg(F.count(F.lit(1)).alias("n")).select(F.lit("ok").alias("outcome"), "n").unionByName(zero.join(n, "outcome", "left").select("outcome", F.coalesce("n", F.lit(0)).alias("n")))


@query("last_failures", "SELECT user_id, max(ts) AS failed_at, arg_max(event_type, (ts, event_type)) AS error_code FROM events GROUP BY 1")
def _(s, d):
    return ledger.last_failures(table(s, d, "events").select("user_id", F.col("ts").alias("failed_at"), F.col("event_type").alias("error_code")), ["user_id"])


@query("retry_ledger", "SELECT user_id, count(*) AS attempts, min(ts) AS first_failed_at, max(ts) AS last_failed_at, arg_max(props, (ts, props)) AS error_code FROM events WHERE event_type = 'error' GROUP BY 1")
def _(s, d):
    f = table(s, d, "events").filter("event_type = 'error'").select("user_id", F.col("ts").alias("failed_at"), F.col("props").alias("error_code"))
    cut_at = F.to_timestamp_ntz(F.lit("2024-01-15 00:00:00"))
    empty = f.limit(0).select("user_id", F.lit(0).cast("long").alias("attempts"), F.col("failed_at").alias("first_failed_at"), F.col("failed_at").alias("last_failed_at"), "error_code")
    # the failures of two runs, one after the other
    return merge.merge_retries(merge.merge_retries(empty, f.filter(F.col("failed_at") < cut_at), "user_id"), f.filter(F.col("failed_at") >= cut_at), "user_id")


@query("retry_resolved", "SELECT user_id FROM (SELECT DISTINCT user_id FROM events WHERE event_type='error') WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type='purchase') AND user_id % 10 <> 0")
def _(s, d):
    e = table(s, d, "events")
    led = e.filter("event_type='error'").select("user_id").distinct()
    return ledger.resolve_retries(led, e.filter("event_type='purchase'"), led.filter("user_id % 10 = 0"), ["user_id"])


@query("retry_order", "SELECT user_id, last_failed_at FROM (SELECT user_id, max(ts) AS last_failed_at FROM events WHERE event_type='error' GROUP BY 1) ORDER BY last_failed_at, user_id LIMIT 30")
def _(s, d):
    led = table(s, d, "events").filter("event_type='error'").groupBy("user_id").agg(F.max("ts").alias("last_failed_at"))
    return ledger.retry_order(led, "user_id", 30)


@query("seen_generation", "SELECT account_id, gmail_message_id, CASE WHEN length(gmail_message_id) % 2 = 0 OR is_unread THEN 2 ELSE 1 END AS generation FROM (SELECT account_id, gmail_message_id, bool_or(is_unread) AS is_unread FROM messages GROUP BY 1, 2)")
def _(s, d):
    m = table(s, d, "messages").groupBy("account_id", "gmail_message_id").agg(F.bool_or("is_unread").alias("is_unread")).withColumn("last_seen_generation", F.lit(1).cast("long"))
    up = ledger.upsert_messages(m, m.filter("is_unread").drop("last_seen_generation"), 2)
    out = ledger.mark_seen(up, m.filter("length(gmail_message_id) % 2 = 0"), 2)
    return out.select("account_id", "gmail_message_id", F.col("last_seen_generation").alias("generation"))


@query("sync_counters", "SELECT user_id, count_if(event_type IN ('click','view')) AS processed, count_if(event_type='click') AS inserted, count_if(event_type='view') AS updated, count_if(event_type='purchase') AS deleted, count_if(event_type='error') AS errors FROM events GROUP BY 1")
def _(s, d):
    kind = F.when(F.col("event_type") == "click", "inserted").when(F.col("event_type") == "view", "updated").when(F.col("event_type") == "purchase", "deleted").when(F.col("event_type") == "error", "error")
    return ledger.counters(table(s, d, "events").select("user_id", kind.alias("kind"), F.lit(1).alias("n")), ["user_id"])


@query("account_report", "SELECT a.id, a.email, coalesce(m.n, 0) AS messages, coalesce(e.n, 0) AS errors, coalesce(r.n, 0) AS retries FROM accounts a LEFT JOIN (SELECT account_id AS id, count(*) AS n FROM (SELECT DISTINCT account_id, gmail_message_id FROM messages) GROUP BY 1) m USING (id) LEFT JOIN (SELECT user_id % 40 AS id, count(*) AS n FROM events WHERE event_type='error' GROUP BY 1) e USING (id) LEFT JOIN (SELECT user_id % 40 AS id, count(DISTINCT user_id) AS n FROM events WHERE event_type='error' GROUP BY 1) r USING (id)")
def _(s, d):
    e = table(s, d, "events").filter("event_type='error'").select((F.col("user_id") % 40).alias("account_id"), "user_id")
    return ledger.account_status(table(s, d, "accounts"), table(s, d, "messages"), e, e.distinct())


@query("find_account", "SELECT id, email FROM accounts WHERE lower(email) = (SELECT lower(email) FROM accounts WHERE id = 7) OR id = 7")
def _(s, d):
    a = table(s, d, "accounts")
    return ledger.find_accounts(a, " 7 ").select("id", "email")


@query("mail_upsert", f"""SELECT entry_id, subject, kind, source_identity, harvested_at FROM {ONE_MAIL.format(cols="harvested_at, subject, source_identity, kind")}""")
def _(s, d):
    m = merge.last_of(table(s, d, "mails").select("entry_id", "legacy_entry_id", "store_id", "folder_path", "harvested_at", "subject", "source_identity", "kind", "folder_leaf", "sender_email", "sender_name"), ["entry_id"], ["harvested_at", "subject", "source_identity", "kind"])
    # the first half is stored, then all are harvested; kinds are told by the mails' own kinds here
    out = merge.upsert_mails(m.filter("length(entry_id) % 2 = 0"), m, None)
    return out.select("entry_id", "subject", "kind", "source_identity", "harvested_at")


@query("sync_plan", "SELECT id, CASE WHEN try_cast(trim(last_history_id) AS HUGEINT) IS NULL OR NOT coalesce(initial_sync_completed, false) OR try_cast(trim(last_history_id) AS HUGEINT) < 500 THEN 'full' ELSE 'incremental' END AS mode, (coalesce(sync_generation, 0) + CASE WHEN try_cast(trim(last_history_id) AS HUGEINT) IS NULL OR NOT coalesce(initial_sync_completed, false) OR try_cast(trim(last_history_id) AS HUGEINT) < 500 THEN 1 ELSE 0 END)::BIGINT AS generation FROM accounts")
def _(s, d):
    a = table(s, d, "accounts")
    return sync.plan_sync(a, a.select("id", F.lit("500").alias("oldest_history_id")))


@query("full_sync")
def _(s, d):
    m = table(s, d, "messages").groupBy("account_id", "gmail_message_id").agg(F.bool_or("is_unread").alias("is_unread"))
    h = F.pmod(F.crc32(F.col("gmail_message_id").cast("binary")), F.lit(10))
    outcome = F.when(h == 1, "missing").when(h == 2, "failed").otherwise("saved")
    fetched = m.select("account_id", "gmail_message_id", outcome.alias("outcome"), F.lit("timeout").alias("error_code"), "is_unread")
    return sync.full_sync(m, m.filter("account_id % 5 <> 0"), fetched, 3)[0].select("account_id", "gmail_message_id", "last_seen_generation")


@query("history_set_algebra", "SELECT account_id, id FROM (SELECT account_id, unnest(upsert_ids) AS id FROM history_pages UNION SELECT account_id, unnest(label_ids) FROM messages) WHERE length(trim(id)) > 0 EXCEPT SELECT account_id, unnest(deleted_ids) FROM history_pages")
def _(s, d):
    h, m = table(s, d, "history_pages"), table(s, d, "messages")
    added = h.select("account_id", F.explode("upsert_ids").alias("id"))
    return changefeed.set_algebra(added, m.select("account_id", F.explode("label_ids").alias("id")), None, h.select("account_id", F.explode("deleted_ids").alias("id")))
