import json

import pytest
from pyspark.sql import functions as F

from lakepost import config
from lakepost.functions import messages as msg
from lakepost.operators import jobs, ledger, lifecycle, merge
from lakepost.sources import pages
from lakepost.streaming import sync

ATT = "mail_entry_id string, provider string, provider_attachment_key string, filename string, size_bytes long, download_status string, processing_status string, blob_id long, error_code string, error_message string, is_deleted boolean, last_seen_generation long, created_at timestamp, updated_at timestamp"
SEEN = "mail_entry_id string, provider string, provider_attachment_key string, filename string, size_bytes long"


def now():
    return F.lit("2021-05-05 05:05:05").cast("timestamp")


def test_attachments_keep_their_state_by_size(spark):
    old = [("m", "imap", k, f"{k}.pdf", 10, "downloaded", "extracted", 1, None, None, False, 1, None, None) for k in ("same", "grown", "gone")] + [("n", "imap", "other", "o", 1, "downloaded", "extracted", 2, None, None, False, 1, None, None)]
    seen = spark.createDataFrame([("m", "imap", "same", "renamed.pdf", 10), ("m", "imap", "grown", "g", 11), ("m", "imap", "new", "n", 5), ("m", "imap", " ", "x", 5), ("m", "imap", "new", "n", 5)], SEEN)
    out = lifecycle.upsert_attachments(spark.createDataFrame(old, ATT), seen, seen, 2, now())
    got = {r["provider_attachment_key"]: (r["filename"], r["download_status"], r["blob_id"], r["is_deleted"], r["last_seen_generation"]) for r in out.collect()}
    assert got == {"same": ("renamed.pdf", "downloaded", 1, False, 2), "grown": ("g", "metadata-only", None, False, 2), "new": ("n", "metadata-only", None, False, 2), "gone": ("gone.pdf", "downloaded", 1, True, 1), "other": ("o", "downloaded", 2, False, 1)}


def test_status_of_extractions(spark):
    rows = [("application/pdf", 0, 0), ("application/pdf", 9, 1), ("application/pdf", 9, 0), ("image/png", 0, 0), ("video/mp4", 0, 0), ("audio/x", 3, 0), ("text/plain", 0, None)]
    df = spark.createDataFrame(rows, "m string, n long, p int")
    got = [r[0] for r in df.select(lifecycle.extraction_status(F.col("m"), F.col("n"), F.col("p"))).collect()]
    assert got == ["needs-ocr", "needs-ocr", "completed", "needs-ocr", "needs-transcription", "completed", "completed"]
    assert df.filter("m = 'image/png'").select(lifecycle.extraction_status(F.col("m"), F.col("n"), F.col("p"), F.lit(True))).head()[0] == "completed"


JOB = "id long, job_type string, attachment_id long, status string, priority int, attempts int, max_attempts int, available_at timestamp, locked_by string, lease_until timestamp, error_code string, error_message string, completed_at timestamp, locked_at timestamp"


def test_leases_are_fenced(spark):
    t = [(1, "e", 1, "running", 1, 1, 3, None, "w", None, None, None, None, None), (2, "e", 2, "running", 1, 3, 3, None, "w", None, None, None, None, None), (3, "e", 3, "running", 1, 1, 3, None, "v", None, None, None, None, None)]
    j = spark.createDataFrame(t, JOB)
    status = lambda df: {r["id"]: r["status"] for r in df.collect()}
    assert status(jobs.complete(j, "w", [1, 3], now())) == {1: "completed", 2: "running", 3: "running"}
    assert status(jobs.fail(j, "w", [1, 2, 3], "c", "m", now(), 9)) == {1: "pending", 2: "failed", 3: "running"}
    assert {r["id"]: r["attempts"] for r in jobs.abandon(j, "w", [1, 2], now()).collect()} == {1: 0, 2: 2, 3: 1}
    ready = spark.createDataFrame([(4, "e", 4, "pending", 2, 0, 3, None, None, None, None, None, None, None), (5, "e", 5, "pending", 1, 0, 3, None, None, None, None, None, None, None)], JOB).withColumn("available_at", now())
    taken = {r["id"]: (r["status"], r["attempts"], r["locked_by"]) for r in jobs.lease_next(ready, "me", now(), 30).collect()}
    assert taken == {4: ("pending", 0, None), 5: ("running", 1, "me")}
    assert jobs.enqueue(ready, spark.createDataFrame([("e", 4), ("e", 6), ("e", 6), ("e", None)], "job_type string, attachment_id long"), ["job_type", "attachment_id"]).count() == 2


def test_retries_without_attachment_pass_by(spark):
    rows = [(i, "e", None, "failed", 1, 1, 3, None, None, None, None, None, None, None) for i in range(5)] + [(10, "e", 1, "failed", 1, 1, 3, None, None, None, None, None, None, None), (11, "e", 1, "failed", 1, 1, 3, None, None, None, None, None, None, None), (12, "e", 2, "failed", 1, 1, 3, None, None, None, None, None, None, None), (13, "e", 2, "pending", 1, 1, 3, None, None, None, None, None, None, None)]
    j = spark.createDataFrame(rows, JOB)
    assert sorted(r["id"] for r in merge.retry_newest_failed(j).collect()) == [0, 1, 2, 3, 4, 11]


def test_full_sync_keeps_what_failed(spark):
    stored = spark.createDataFrame([(1, "a", False), (1, "b", False), (1, "c", True), (1, "d", True)], "account_id long, gmail_message_id string, is_unread boolean")
    listing = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (1, "e"), (1, " ")], "account_id long, gmail_message_id string")
    fetched = spark.createDataFrame([(1, "a", "saved", None, True), (1, "b", "failed", "x", None), (1, "c", "missing", None, None), (1, "e", "failed", "y", None)], "account_id long, gmail_message_id string, outcome string, error_code string, is_unread boolean")
    out, failed, missing = sync.full_sync(stored, listing, fetched, 7)
    assert sorted((r["gmail_message_id"], r["is_unread"]) for r in out.collect()) == [("a", True), ("b", False)] and failed.count() == 2 and missing.count() == 1


def test_expired_page_tokens_start_again():
    asked = []

    def fetch(token):
        asked.append(token)
        if token == "two" and asked.count("two") == 1:
            raise KeyError(token)
        return {None: (["m1"], "two"), "two": (["m2"], None)}[token]

    assert sync.read_listing(fetch) == [(None, ["m1"]), ("two", ["m2"])] and asked == [None, "two", None, "two"]


def test_message_scalars(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).head()[0]
    assert msg.decode_header_value("=?utf-8?Q?Ki=C5=9B_x?= =?zz?B?eA==?= =?iso-8859-2?B?sQ==?=") == "Kiś x =?zz?B?eA==?= ą"
    assert get(msg.base64url(F.lit("_w"))) == bytearray(b"\xff") and get(msg.base64url(F.lit(" "))) == bytearray() and get(msg.base64url(F.lit("*"))) is None
    assert tuple(get(msg.split_sender(F.lit(' "Ala K" < a@k.test > ')))) == ("Ala K", "a@k.test") and tuple(get(msg.split_sender(F.lit("a@k.test")))) == ("", "a@k.test") and tuple(get(msg.split_sender(F.lit("Ala")))) == ("Ala", "")
    assert [get(msg.byte_size(F.lit(n))) for n in (-1, 1023, 1024, 1536, 5 * 1024**4)] == ["0 B", "1023 B", "1 KiB", "1.5 KiB", "5 TiB"]
    assert tuple(get(msg.parse_message_key(F.lit("gmail:5:a:b")))) == (5, "a:b") and get(msg.parse_message_key(F.lit("imap:5:a"))) is None
    assert get(msg.read_message_locator(F.lit('{"Version":2,"AccountName":"a","FolderFullName":"f","UidValidity":1,"Uid":1}'))) is None
    said = json.dumps({"transcription": [{"text": " hej ", "offsets": {"from": 5, "to": 9}}, {"text": " ", "offsets": None}], "result": {"language": "pl"}})
    t = get(msg.transcript_segments(F.lit(said)))
    assert t["language"] == "pl" and t["error"] is None and [(x["start_ms"], x["clean_text"]) for x in t["segments"]] == [(5, "hej")]
    assert get(msg.transcript_segments(F.lit('{"transcription":[{"text":"x","offsets":{"from":9,"to":5}}]}')))["error"] == "bad-offsets" and get(msg.transcript_segments(F.lit("{}")))["error"] == "no-transcription"
    part = get(msg.decode_part(F.lit("sQ"), F.lit("text/plain; charset='iso-8859-2'")))
    assert part["text"] == "ą" and part["ok"] and get(msg.strip_html(F.lit("<b>x</b><script>y</script>&amp;\n z"))) == "x & z"
    assert get(msg.utc_text(F.lit(-1))) == "1969-12-31 23:59:59" and get(msg.utc_text(F.lit(10**18))) == ""


def test_pages_and_providers(spark):
    files = spark.createDataFrame([("a", b"one|two"), ("b", None)], "document_key string, content binary")
    text = pages.text_pages(files, lambda b: b.decode().split("|"))
    assert [(r["page_number"], r["raw_text"]) for r in text.orderBy("document_key", "page_number").collect()] == [(1, "one"), (2, "two"), (1, "")]
    assert {r["error"] for r in pages.text_pages(files, None).collect()} == {"no-provider"}
    images = spark.createDataFrame([("a", 1, b"x"), ("a", 2, b"bad"), ("a", 101, b"x")], "document_key string, page_number int, image binary")

    def first(b):
        if b == b"bad":
            raise ValueError("no")
        return [("maybe", 0.2)]

    got = {r["page_number"]: (r["raw_text"], r["confidence"], r["error"]) for r in pages.recognise_pages(images, [first, lambda b: [("sure", 0.9), ("dim", 0.1)]], 0.5).collect()}
    assert got == {1: ("sure", 0.9, None), 2: ("sure", 0.9, None), 101: (None, None, "page-limit")}
    long = "x" * 40
    t = spark.createDataFrame([("a", 1, long), ("a", 2, "poor"), ("a", 3, "also poor")], "k string, page_number int, raw_text string")
    o = spark.createDataFrame([("a", 1, "other"), ("a", 2, "better"), ("a", 4, "found")], "k string, page_number int, raw_text string")
    assert {r["page_number"]: (r["raw_text"], r["source"]) for r in pages.merge_pages(t, o, ["k"]).collect()} == {1: (long, "text"), 2: ("better", "ocr"), 3: ("also poor", "text"), 4: ("found", "ocr")}
    media = pages.transcribe(spark.createDataFrame([("v", b"1")], "document_key string, content binary"), lambda b: '{"transcription":[]}', lambda b: '{"transcription":[{"text":"ok","offsets":{"from":0,"to":1}}]}').head()
    assert media["segments"][0]["clean_text"] == "ok" and media["error"] is None
    blobs = pages.new_blobs(files, pages.new_blobs(files, spark.createDataFrame([], "sha256 string"), now()).select("sha256"), now())
    assert blobs.count() == 0


def test_settings_rules_and_catalog(spark, tmp_path):
    c = config.EngineConfig().set("limit", "40")
    c.save(str(tmp_path / "c.json"))
    assert config.load_config(str(tmp_path / "c.json")).limit == 40 and config.load_config(str(tmp_path / "none.json")) == config.EngineConfig()
    for bad in (("limit", "0"), ("limit", "x"), ("semantic", "maybe"), ("nothing", "1")):
        with pytest.raises(ValueError):
            c.set(*bad)
    path = tmp_path / "r.json"
    assert config.load_rules(str(path)).senders == () and path.exists()
    path.write_text('{"senders": ["a@k.test"]}')
    import os

    os.utime(path, (1, 1))
    assert config.load_rules(str(path)).senders == ("a@k.test",)
    path.write_text("{broken")
    os.utime(path, (2, 2))
    assert config.load_rules(str(path)).senders == ()
    cat = config.Catalog(spark, str(tmp_path / "cat"))
    assert not cat.verify()
    for n in range(4):
        cat.write("mails", spark.range(n))
    assert cat.verify() and cat.versions("mails") == [2, 3] and cat.table("mails").count() == 3


def test_ledgers(spark, collected):
    used = spark.createDataFrame([(1, "A"), (1, "B"), (1, None)], "account_id long, label_id string")
    listed = spark.createDataFrame([(1, "A", "Alpha", "user")], "account_id long, label_id string, name string, type string")
    assert collected(ledger.upsert_labels(listed.limit(0), listed, used)) == [(1, "A", "Alpha", "user"), (1, "B", "B", "unknown")]
    acc = spark.createDataFrame([(7, "Ala@k.test"), (70, "b@k.test")], "id long, email string")
    assert [r["id"] for r in ledger.find_accounts(acc, "ALA@K.TEST").collect()] == [7] and [r["id"] for r in ledger.find_accounts(acc, "70").collect()] == [70]
    m = spark.createDataFrame([("a", "old", "s1", "f", None), ("x", "keep", "s1", "f", "id1")], "entry_id string, subject string, store_id string, folder_path string, source_identity string").withColumn("legacy_entry_id", F.lit(None).cast("string"))
    b = spark.createDataFrame([("new-a", "fresh", "s1", "f", None, "a"), ("y", "again", "s1", "g", "id1", None), ("z", "other", "s1", "g", None, "a"), ("", "none", "s", "f", None, None)], "entry_id string, subject string, store_id string, folder_path string, source_identity string, legacy_entry_id string")
    assert sorted((r["entry_id"], r["subject"]) for r in merge.upsert_mails(m, b).collect()) == [("a", "fresh"), ("x", "again"), ("z", "other")]
