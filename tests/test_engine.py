import io
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lakepost.functions.text import clock_label, decode_bytes, flatten_html, fold_word, normalise, take_units, tokens
from lakepost.operators import fulltext, merge, rules, search, semantic, vector
from lakepost.sources.documents import TYPES, budget, detect_type, extract, extract_segments
from lakepost.streaming.sync import SyncState, apply_batch, sync_stream


def test_registry():
    q, sql = entry.queries(), entry.oracle_sql()
    assert {"p4_found", "p7_found", "fts_and_bm25", "hybrid_rrf"} <= set(q) and set(sql) <= set(q)


def test_dates():
    assert search.date_bound("2019-02-28", True) == "2019-03-01 00:00:00" and search.date_bound("2019-02-28 23:15") == "2019-02-28 23:15:00" and search.date_bound(" ") is None
    for bad in ("28.02.2019", "2019-2-8", "2019-02-30", "yesterday"):
        with pytest.raises(search.QueryError):
            search.date_bound(bad)


MAIL = "entry_id string, received string, folder_path string, folder_leaf string, sender_name string, sender_email string, subject string, body string, kind string, has_attachments boolean"


def test_search_mails(spark):
    rows = [
        ("late", "2019-02-28 23:59:59", "q://In", "Incoming", None, None, "t", None, "alert", True), ("noon", "2019-02-28 12:05:00", "q://Out", "Sent mail", "Zoe", "axb@k.test", "t", "w", "mail", False),
        ("eve", "2019-02-27 07:40:00", "q://In", "Incoming", "", "a_b@k.test", "t", "u\r\nv", None, True), ("none", "", "q", "q", "", "", "", "", None, None), ("noon", "2019-02-28 12:05:00", "q://Out", "Sent mail", "Zoe", "axb@k.test", "t", "w", "mail", False),
    ]
    m = spark.createDataFrame(rows, MAIL)
    ids = lambda **k: [r["entry_id"] for r in search.search_mails(m, **k).collect()]
    assert ids(date_from="2019-02-28", date_to="2019-02-28", noise="all") == ["late", "noon"]
    assert ids(sender="A_B") == ["eve"] and ids(folder="SENT") == ["noon"] and ids(noise="alerts") == ["late"] and ids(attachments=True, noise="all") == ["late", "eve"]
    assert ids(date_to="2019-02-27", noise="all") == ["eve", "none"] and ids(limit=1) == ["noon"] and len(ids(limit=-1, noise="all")) == 4
    first = search.search_mails(m, sender="a_b").collect()[0]
    assert (first["snippet"], first["direction"], first["sender"]) == ("u  v", "<-", "a_b@k.test")
    hits = spark.createDataFrame([("eve", -1.0), ("noon", -2.0), ("gone", -9.0)], "doc_id string, score double")
    assert ids(hits=hits) == ["noon", "eve"]


def _plan(spark, df):
    return df._jdf.queryExecution().toString()


def test_top_k_stays_a_top_k(spark):
    m = spark.range(100).selectExpr("CAST(id AS string) entry_id", "'2026' received", "'f' folder_path", "'l' folder_leaf", "'n' sender_name", "'e' sender_email", "'s' subject", "'b' body", "'mail' kind")
    assert "TakeOrderedAndProject" in _plan(spark, search.search_mails(m))


TEXTS = ["Rower stoi obok starej wierzby nad rzeką", "Łódź, façade Ørsted max_power@x.invalid", "rower rower wierzby", "", "jazda na ROWERZE pod wierzbą rower"]


def fts(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    return search.build_postings(docs, "doc_id", ["text"]), docs.select("doc_id", F.size(tokens(F.col("text"))).cast("long").alias("len"))


def sqlite_fts():
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(text, tokenize='unicode61 remove_diacritics 2')")
    db.executemany("INSERT INTO t(rowid, text) VALUES (?, ?)", enumerate(TEXTS))
    return db


@pytest.mark.parametrize("raw", ["rower", "rowe*", "NEAR(rower wierzby, 10)", "rower OR łódź", "rower NOT wierzby", "^rower", '"rower wierzby"', "text: rower AND wierz*", "(facade OR brak) AND lodz OR łodz", "rower + rower"])
def test_raw_grammar_like_fts5(spark, raw):
    postings, _ = fts(spark)
    got = sorted(r[0] for r in search.matching(postings, search.RawParser(raw).parse()).collect())
    assert got == sorted(r[0] for r in sqlite_fts().execute("SELECT rowid FROM t WHERE t MATCH ?", (raw,)))


def test_bm25_like_fts5(spark):
    postings, keys = fts(spark)
    for words in ("rower", "rower wierzby", "max_power"):
        got = {r["doc_id"]: r["score"] for r in search.bm25(postings, keys, search.sanitised(words)).collect()}
        quoted = " ".join(f'"{w}"' for w in words.split())
        want = dict(sqlite_fts().execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (quoted,)))
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_query_text():
    with pytest.raises(search.QueryError):
        search.RawParser("OR ) (").parse()
    assert fold_word("max_power") == ["max", "power"] and fold_word("+") == [] and fold_word("ŁÓDŹ") == ["łodz"]
    assert "[Rower]" in search.make_snippet(TEXTS[0], {"rower"}) and search.make_snippet(None, {"x"}) == ""


def test_stored_index(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    index = fulltext.TextIndex(spark, str(tmp_path / "ix"), ("text",)).write(docs, "doc_id")
    found = lambda i, q, **k: sorted(r["doc_id"] for r in i.scores(q, **k).collect())
    assert found(index, "rower") == [0, 2, 4] and found(index, "rowe*", raw=True) == [0, 2, 4] and found(index, " ") == [] and found(index, "+") == []
    assert "PartitionFilters: [isnotnull(bucket" in _plan(spark, search.phrase_hits(index.postings(), search.Phrase(["rower"])))
    index.write(spark.createDataFrame([(2, "kajak"), (9, "rower")], "doc_id long, text string"), "doc_id").remove(spark.createDataFrame([(4,)], "doc_id long"))
    assert found(index, "rower") == [0, 9] and found(index, "kajak") == [2] and index.lengths().count() == 5
    one = fulltext.compact(index, str(tmp_path / "one"))
    assert one.generations() == 1 and sorted(map(tuple, one.scores("rower").collect())) == sorted(map(tuple, index.scores("rower").collect()))
    empty = fulltext.TextIndex(spark, str(tmp_path / "no"), ("text",)).write(docs.limit(0), "doc_id")
    assert found(empty, "rower") == []


SEGMENT = "segment_id long, document_id long, received string, subject string, sender string, recipients string, filename string, text string, sender_shown string, mime_type string, page_number int, slide_number int, sheet_name string, start_ms long, end_ms long"


def test_semantic_search(spark, tmp_path):
    rows = spark.createDataFrame([(i, 1, f"2020-01-0{i}", "s", "a", "r", "f", t, "a", "m", None, None, None, None, None) for i, t in ((1, "kajak na jeziorze"), (2, "rower w lesie"), (3, "nic"))], SEGMENT)
    e = spark.createDataFrame([(1, "m", 2, [1.0, 0.0]), (2, "m", 2, [0.6, 0.8]), (3, "m", 2, [0.0, 1.0]), (1, "x", 2, [0.0, 1.0]), (2, "n", 2, [float("nan"), 1.0])], "segment_id long, model string, dimensions int, vector array<float>")
    got = semantic.search_semantic(e, "m", [2.0, 0.0], rows, 2)
    assert [r["segment_id"] for r in got.hits.collect()] == [1, 2] and got.indexed == 3 and not got.cap_reached and not got.mismatch
    capped = semantic.search_semantic(e, "m", [1.0, 0.0], rows, 1, 1)
    assert [r["segment_id"] for r in capped.hits.collect()] == [3] and capped.cap_reached
    wrong = semantic.search_semantic(e, "m", [1.0, 0.0, 0.0], rows, 2)
    assert wrong.hits.count() == 0 and wrong.mismatch and not wrong.cap_reached and wrong.indexed_dimensions == 2
    assert semantic.search_semantic(e, "n", [1.0, 0.0], rows, 2).hits.count() == 0
    index = fulltext.TextIndex(spark, str(tmp_path / "s"), tuple(fulltext.CONTENT_WEIGHTS)).write(rows, "segment_id")
    both = semantic.search_semantic(e, "m", [1.0, 0.0], rows, 3, hybrid=True, index=index, text="rower")
    assert [(r["segment_id"], r["channels"]) for r in both.hits.collect()][0] == (2, "fts+semantic") and "[rower]" in both.hits.filter("segment_id = 2").head()["snippet"]
    with pytest.raises(ValueError):
        semantic.search_semantic(e, "m", [0.0, 0.0], rows)


def test_embedding_index(spark):
    seg = spark.createDataFrame([(1, 1, "abc"), (1, 1, "abc"), (2, 1, " "), (3, 2, "b")], "segment_id long, document_id long, clean_text string")
    none = spark.createDataFrame([], "segment_id long, model string, dimensions int, vector array<float>")
    p = semantic.Provider("m", lambda t: [[float(len(x)), 1.0] for x in t])
    first = semantic.index_embeddings(seg, none, p).cache()
    assert sorted(r["segment_id"] for r in first.collect()) == [1, 3] and semantic.pending(seg, first, "m").count() == 0
    assert semantic.index_embeddings(seg, first, p, rebuild=True, document=2).count() == 2 and semantic.drop_model(first, "m", seg, 2).count() == 1
    other = semantic.Provider("m", lambda t: [[1.0] for _ in t])
    more = seg.unionByName(spark.createDataFrame([(4, 2, "neu")], seg.schema))
    with pytest.raises(Exception, match="dimensions changed"):
        semantic.index_embeddings(more, first, other).collect()


def test_tokens_column(spark):
    df = spark.createDataFrame([("Pchnąć—łodzią, façade é_x",), (None,)], "t string")
    assert [r[0] for r in df.select(tokens(F.col("t"))).collect()] == [["pchnac", "łodzia", "facade", "e", "x"], []]


def test_rules(spark, collected):
    m = spark.createDataFrame([("Alerts", "a@e", "A"), ("Inbox", "BOT@e", "Robot"), ("Inbox", " bot@e", ""), (None, None, None)], "folder_leaf string, sender_email string, sender_name string")
    r = rules.NoiseRules(senders=("bot@e",), contains=("robot",), folders=("alerts",))
    assert collected(rules.contribution(m, r)) == [("contains:robot", 1, 0), ("folder:alerts", 1, 1), ("sender:bot@e", 1, 0)]
    assert collected(rules.overlap(m, r)) == [(4, 2, 1)]


def test_vectors(spark):
    e = spark.createDataFrame([(1, [1.0, 0.0]), (2, [3.0, 4.0]), (3, [0.0, 0.0]), (4, [1.0])], "vec_id long, v array<float>")
    assert [round(x, 6) for x in e.filter("vec_id=2").select(vector.normalise(F.col("v"))).collect()[0][0]] == [0.6, 0.8]
    assert e.filter("vec_id=3").select(vector.normalise(F.col("v"))).collect()[0][0] is None
    assert [r["vec_id"] for r in vector.top_similar(e, [0.0, 1.0], "vec_id", "v", 2).collect()] == [2, 3]
    sem = spark.createDataFrame([(1, 0.9), (2, 0.8)], "id long, similarity double")
    lex = spark.createDataFrame([(2, -3.0)], "id long, score double")
    got = vector.fuse(sem, lex, "id", 5).collect()
    assert got[0]["id"] == 2 and got[0]["channels"] == "fts+semantic" and abs(got[0]["score"] - (1 / 62 + 1.25 / 61)) < 1e-12


JOBS = "id long, job_type string, attachment_id long, status string, priority int, attempts int, max_attempts int, available_at timestamp, lease_until timestamp, locked_by string, error_code string"


def test_jobs(spark, collected):
    t = "2026-01-01 12:00:00"
    j = spark.sql(f"SELECT * FROM VALUES (1L,'e',7L,'failed',1,3,3,timestamp'{t}',null,null,null),(2L,'e',7L,'failed',1,3,3,timestamp'{t}',null,null,null),(3L,'e',8L,'failed',1,3,3,timestamp'{t}',null,null,null),(4L,'e',8L,'pending',0,0,3,timestamp'{t}',null,null,null),(5L,'e',null,'failed',1,3,3,timestamp'{t}',null,null,null),(6L,'o',9L,'running',1,3,3,timestamp'{t}',timestamp'{t}','w','old'),(7L,'o',9L,'running',1,1,3,timestamp'{t}',timestamp'{t}','w',null) AS t({','.join(c.split()[0] for c in JOBS.split(', '))})")
    now = F.lit("2026-01-01 12:00:00").cast("timestamp")
    assert sorted(r["id"] for r in merge.retry_newest_failed(j).collect()) == [2, 5]
    assert [(r["id"], r["status"], r["error_code"]) for r in merge.recover_expired(j, now).filter("id > 5").orderBy("id").collect()] == [(6, "failed", "old"), (7, "pending", "lease-expired")]
    assert [r["id"] for r in merge.ready_jobs(j, now, 5).collect()] == [4]
    assert collected(merge.counts_by_status(j, ["pending", "running", "completed", "failed"])) == [("completed", 0), ("failed", 4), ("pending", 1), ("running", 2)]
    assert {r["id"]: r["status"] for r in merge.finish_job(j, "w", F.col("id") == 7, now, 60).filter("id > 5").collect()} == {6: "failed", 7: "completed"}


def test_merges(spark, collected):
    t = spark.createDataFrame([("a", "1", "i1"), ("b", "2", None)], "entry_id string, v string, source_identity string")
    b = spark.createDataFrame([("a", None, None), ("c", "3", "i3")], "entry_id string, v string, source_identity string")
    assert collected(merge.upsert(t, b, ["entry_id"], ("source_identity",))) == [("a", None, "i1"), ("b", "2", None), ("c", "3", "i3")]
    assert collected(merge.soft_delete_diff(t.select("entry_id"), b, ["entry_id"])) == [("a", False), ("b", True)]


def test_text_functions(spark):
    assert flatten_html('<i data-x="p > q">Krótki odsyłacz</i>') == "Krótki odsyłacz" and flatten_html("<p>x</p><style>boo") == "x"
    assert flatten_html("<div>Stary <u>most</u></div><div>Nowy&nbsp;most</div> 3 < 4") == "Stary most\nNowy most\n3 < 4"
    assert normalise("  Stary most\r\n\r\n\r\n\r\n  Nowy ﬁlar  ") == "Stary most\n\nNowy filar"
    assert decode_bytes("Wąski wał".encode("cp1250")) == "Wąski wał" and decode_bytes("rzęsa".encode("utf-16-le")) != "" and decode_bytes(b"\xff\xfeb\0") == "b"
    assert take_units("x🚲y", 2) == "x" and take_units("stary most", 5) == "stary"
    assert spark.range(1).select(clock_label(F.lit(3_725_999)), clock_label(F.lit(-5))).collect()[0][:] == ("01:02:05", "00:00:00")


def _docx(*paragraphs):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("word/document.xml", '<w:d xmlns:w="u"><w:body>' + "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs) + "</w:body></w:d>")
    return b.getvalue()


def test_sources(spark):
    d = _docx("Lewy brzeg", "Prawy brzeg")
    assert detect_type("x.bin", None, d) == TYPES["docx"] and extract("x", None, d)[0]["clean_text"] == "Lewy brzeg\nPrawy brzeg"
    assert detect_type("a.bin", None, b"<!DOCTYPE html><p>x") == "text/html" and detect_type("r.dat", "text/xml; q=1", b"x") == "text/xml"
    evil = io.BytesIO()
    with zipfile.ZipFile(evil, "w") as z:
        z.writestr("word/../../x", "a")
    assert "unsafe" in extract("x.docx", None, evil.getvalue())[0]["error"] and extract("x.bin", None, b"\0\1")[0]["error"] == "unsupported-type"
    assert [r["clean_text"] for r in budget([{"raw_text": "abc"}, {"raw_text": " "}, {"raw_text": "defgh"}], 8)] == ["abc", "def"]
    files = spark.createDataFrame([("k", "a.txt", None, b"hej"), ("n", None, None, None)], "document_key string, filename string, mime_type string, content binary")
    assert {(r["document_key"], r["clean_text"]) for r in extract_segments(files).collect()} == {("k", "hej"), ("n", None)}


PAGES = "account_id long, start_history_id string, page_token string, upsert_ids array<string>, deleted_ids array<string>, history_id string, next_page_token string"


def test_stream_of_pages(spark, tmp_path):
    spark.createDataFrame([(1, "1", None, ["b"], ["a"], "2", None)], PAGES).write.parquet(str(tmp_path / "pages"))
    base = spark.createDataFrame([(1, "a")], "account_id long, gmail_message_id string")
    acc = spark.createDataFrame([(1, "1")], "id long, last_history_id string")
    root = str(tmp_path / "snap")
    sync_stream(spark, str(tmp_path / "pages"), spark.createDataFrame([], PAGES).schema, root, base, acc, str(tmp_path / "ck"))
    assert SyncState(spark, root).version() == 1 and [tuple(r) for r in SyncState(spark, root).messages().collect()] == [(1, "b")]


def test_any_split_of_pages_gives_the_same(spark, tmp_path):
    from lakepost.operators.changefeed import live_messages

    rows = [
        (1, "1", None, ["a", "b"], None, "9", "t1"), (1, "1", "t1", ["c"], ["a"], None, None), (1, "1", None, ["a"], ["b"], "5", None), (2, "1", None, ["x"], [" ", None], "3", "u"), (2, "1", "u", None, ["x", "z"], "4", None),
    ]
    base = spark.createDataFrame([(1, "q"), (2, "z")], "account_id long, gmail_message_id string")
    acc = spark.createDataFrame([(1, "1"), (2, "1")], "id long, last_history_id string")
    want = sorted(map(tuple, live_messages(base, spark.createDataFrame(rows, PAGES), acc).collect()))
    assert want == [(1, "b"), (1, "c"), (1, "q")]
    for n, order in enumerate(([[4, 1], [0, 2], [3, 0]], [[2], [1, 3], [0, 4]])):
        root = str(tmp_path / f"s{n}")
        apply = apply_batch(spark, root, base, acc)
        for k, part in enumerate(order):
            for _ in range(2):  # a batch that is run again changes nothing
                apply(spark.createDataFrame([rows[i] for i in part], PAGES), k)
        assert sorted(map(tuple, SyncState(spark, root).messages().collect())) == want
