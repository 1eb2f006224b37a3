"""Queries of the engine's own operators over the driver's tables, with SQL for DuckDB."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakepost.functions.text import TOKEN, ascii_lower, clock_label, fold_pairs, html_to_text, place_label, tokens
from lakepost.operators import fulltext, merge, rules, search, semantic, vector
from lakepost.session import ensure_checkpoint_dir, path_exists, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


MAIL_SQL = """SELECT entry_id, received, CASE WHEN lower(folder_leaf) LIKE 'sent%' THEN '->' ELSE '<-' END AS direction, coalesce(nullif(sender_name,''),sender_email) AS sender, subject,
 trim(substring(translate(body, chr(13)||chr(10), '  '),1,160)) AS snippet FROM (SELECT DISTINCT entry_id, received, subject, sender_name, sender_email, folder_leaf, body, kind FROM mails) m WHERE {where} ORDER BY received DESC NULLS LAST, entry_id LIMIT {limit}"""


@query("mail_structured_search", MAIL_SQL.format(where="received >= '2023-01-01 00:00:00' AND received < '2024-07-01 00:00:00' AND (contains(lower(sender_name),'ski') OR contains(lower(sender_email),'ski')) AND starts_with(lower(folder_leaf),'inbox') AND (kind IS NULL OR kind <> 'alert')", limit=200))
def _(s, d):
    return search.search_mails(table(s, d, "mails"), "2023-01-01", "2024-06-30", "ski", "inbox", limit=200)


@query("mail_with_attachments", "SELECT entry_id, received FROM (SELECT DISTINCT entry_id, received, kind, has_attachments FROM mails) WHERE has_attachments AND (kind IS NULL OR kind <> 'alert') ORDER BY received DESC NULLS LAST, entry_id LIMIT 100")
def _(s, d):
    return search.search_mails(table(s, d, "mails"), limit=100, attachments=True).select("entry_id", "received")


@query("mail_date_whole_day", "SELECT entry_id, received FROM (SELECT DISTINCT entry_id, received FROM mails) WHERE received >= '2024-03-01 00:00:00' AND received < '2024-03-11 00:00:00'")
def _(s, d):
    lo, hi = search.date_bound("2024-03-01"), search.date_bound("2024-03-10", True)
    return table(s, d, "mails").select("entry_id", "received").distinct().filter((F.col("received") >= lo) & (F.col("received") < hi))


@query("sender_like_literal", "SELECT DISTINCT entry_id, sender_email FROM mails WHERE contains(translate(sender_email,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'),'_ma')")
def _(s, d):
    return table(s, d, "mails").filter(ascii_lower(F.col("sender_email")).contains("_ma")).select("entry_id", "sender_email").distinct()


@query("folder_prefix_filter", "SELECT DISTINCT entry_id, folder_path FROM mails WHERE starts_with(translate(folder_leaf,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'),'in')")
def _(s, d):
    return table(s, d, "mails").filter(ascii_lower(F.col("folder_leaf")).startswith("in")).select("entry_id", "folder_path").distinct()


for _mode, _where in (("mail", "kind IS NULL OR kind <> 'alert'"), ("alerts", "kind = 'alert'"), ("all", "TRUE")):

    @query(f"noise_mode_{'default' if _mode == 'mail' else _mode}", f"SELECT kind, count(*) AS n FROM mails WHERE {_where} GROUP BY kind")
    def _(s, d, mode=_mode):
        return table(s, d, "mails").filter(search.noise_filter(mode)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("sender_fallback_top10", "SELECT coalesce(nullif(sender_name,''),sender_email) AS sender, count(*) AS n FROM mails GROUP BY 1 ORDER BY n DESC, sender ASC NULLS FIRST LIMIT 10")
def _(s, d):
    return rules.volume(table(s, d, "mails"), search.sender_display(), "sender", 10)


@query("folder_volume", "SELECT folder_leaf, count(*) AS n FROM mails GROUP BY 1")
def _(s, d):
    return rules.volume(table(s, d, "mails"), F.col("folder_leaf"), "folder_leaf")


@query("corpus_stats", "SELECT count(*) AS mails, count_if(kind='alert') AS alerts, count(*) - count_if(kind='alert') AS correspondence, min(received) AS oldest, max(received) AS newest, count_if(has_attachments) AS with_attachments FROM mails")
def _(s, d):
    alerts = F.count_if(F.col("kind") == "alert")
    return table(s, d, "mails").agg(F.count(F.lit(1)).alias("mails"), alerts.alias("alerts"), (F.count(F.lit(1)) - alerts).alias("correspondence"), F.min("received").alias("oldest"), F.max("received").alias("newest"), F.count_if("has_attachments").alias("with_attachments"))


RULES = rules.NoiseRules(senders=("monitor@borvanta.example",), contains=("watchdog", "monitor"), folders=("Alerts",))
HITS_SQL = """SELECT entry_id, list_filter([CASE WHEN trim(lower(coalesce(folder_leaf,'')))='alerts' THEN 'folder:Alerts' END, CASE WHEN lower(coalesce(sender_email,''))='monitor@borvanta.example' THEN 'sender:monitor@borvanta.example' END,
 CASE WHEN contains(lower(coalesce(sender_email,''))||' '||lower(coalesce(sender_name,'')),'watchdog') THEN 'contains:watchdog' END, CASE WHEN contains(lower(coalesce(sender_email,''))||' '||lower(coalesce(sender_name,'')),'monitor') THEN 'contains:monitor' END], lambda x: x IS NOT NULL) AS h, kind FROM mails"""


@query("rule_hits", f"SELECT entry_id, array_to_string(h, ',') AS hits FROM ({HITS_SQL}) WHERE len(h) > 0")
def _(s, d):
    return table(s, d, "mails").select("entry_id", RULES.hits().alias("h")).filter(F.size("h") > 0).select("entry_id", F.concat_ws(",", "h").alias("hits"))


@query("rule_contribution", f"SELECT rule, count(*) AS gross, count_if(n=1) AS unique_hits FROM (SELECT unnest(h) AS rule, len(h) AS n FROM ({HITS_SQL})) GROUP BY rule")
def _(s, d):
    return rules.contribution(table(s, d, "mails"), RULES)


@query("rule_overlap", f"SELECT count(*) AS scanned, count_if(len(h)>0) AS hit, count_if(len(h)>1) AS overlapping FROM ({HITS_SQL})")
def _(s, d):
    return rules.overlap(table(s, d, "mails"), RULES)


@query("reclassify_diff", f"SELECT kind, k AS kind_new, count(*) AS n FROM (SELECT kind, CASE WHEN len(h)>0 THEN 'alert' ELSE 'mail' END AS k FROM ({HITS_SQL})) WHERE kind IS DISTINCT FROM k GROUP BY 1,2")
def _(s, d):
    r = rules.reclassify(table(s, d, "mails"), RULES)
    return r.filter(~F.col("kind").eqNullSafe(F.col("kind_new"))).groupBy("kind", "kind_new").agg(F.count(F.lit(1)).alias("n"))


@query("analyze_top_senders", """SELECT sender_email, name, n, round(100.0*n/total,6) AS pct, CASE WHEN contains(lower(coalesce(sender_email,''))||' '||lower(coalesce(name,'')),'watchdog') OR contains(lower(coalesce(sender_email,''))||' '||lower(coalesce(name,'')),'monitor') OR lower(sender_email)='monitor@borvanta.example' THEN 'noise' WHEN 100.0*n/total >= 3 THEN 'candidate' ELSE '' END AS tag
 FROM (SELECT sender_email, max(coalesce(nullif(sender_name,''),sender_email)) AS name, count(*) AS n FROM mails GROUP BY 1 ORDER BY n DESC, sender_email ASC NULLS FIRST LIMIT 20), (SELECT count(*) AS total FROM mails)""")
def _(s, d):
    return rules.top_senders(table(s, d, "mails"), RULES)


# full text over documents (title, text)
_before, _after = fold_pairs()
TOK = "list_transform(regexp_extract_all(lower(coalesce({c},'')), '" + TOKEN + "'), lambda t: translate(regexp_replace(t,'\\p{Mn}','','g'), '" + _before + "', '" + _after + "'))"
POSTINGS = "docs AS (SELECT DISTINCT doc_id, title, text FROM documents), tk AS (SELECT doc_id, 'title' AS col, " + TOK.replace("{c}", "title") + " AS t FROM docs UNION ALL SELECT doc_id, 'text', " + TOK.replace("{c}", "text") + " FROM docs), p AS (SELECT doc_id, col, unnest(generate_series(0, len(t)-1)) AS pos, unnest(t) AS term FROM tk WHERE len(t) > 0)"
COLUMNS = ["title", "text"]


def _stored(s, d, name: str, rows, key: str, columns: list[str]) -> fulltext.TextIndex:
    """The index of a data folder: written by the first query that asks for it, read by all others."""
    root = f"{ensure_checkpoint_dir(s)}/lakepost-index/{name}-{zlib.crc32(d.encode()):08x}-{s.sparkContext.applicationId}"
    index = fulltext.TextIndex(s, root, tuple(columns))
    if not path_exists(s, f"{root}/gone/gen=0/_SUCCESS"):
        index.write(rows(), key)
    return index


def _index(s, d):
    return _stored(s, d, "documents", lambda: table(s, d, "documents").select("doc_id", *COLUMNS).distinct(), "doc_id", COLUMNS)


def _mail_index(s, d):
    return _stored(s, d, "mails", lambda: fulltext.mail_rows(table(s, d, "mails")), "entry_id", fulltext.MAIL_COLUMNS)


def _segment_rows(s, d):
    return fulltext.segment_rows(table(s, d, "content_segments"), table(s, d, "content_documents"), table(s, d, "mails"))


def _segment_index(s, d):
    return _stored(s, d, "segments", lambda: _segment_rows(s, d), "segment_id", list(fulltext.CONTENT_WEIGHTS))


@query("tokenize_fold", f"WITH {POSTINGS} SELECT term, count(*) AS n FROM p GROUP BY term")
def _(s, d):
    docs = table(s, d, "documents").select("doc_id", *COLUMNS).distinct()
    return docs.select(F.explode(F.concat(tokens(F.col("title")), tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def _phrase_sql(i: int, terms: list[str], where: str = "TRUE", prefix: bool = False) -> str:
    cond = " AND ".join([f"a0.term = '{terms[0]}'" if not (prefix and len(terms) == 1) else f"starts_with(a0.term,'{terms[0]}')"] + [f"a{k}.term = '{t}'" for k, t in enumerate(terms) if k])
    joins = "".join(f" JOIN p a{k} ON a{k}.doc_id=a0.doc_id AND a{k}.col=a0.col AND a{k}.pos=a0.pos+{k}" for k in range(1, len(terms)))
    return f"SELECT {i} AS phrase, a0.doc_id, a0.col, a0.pos FROM p a0{joins} WHERE {cond} AND {where.format(a='a0')}"


def _bm25_sql(phrases: list[str], limit: int, weights: str = "1.0", match: str | None = None) -> str:
    match = match or f"SELECT doc_id FROM h GROUP BY doc_id HAVING count(DISTINCT phrase) = {len(phrases)}"
    return f"""WITH {POSTINGS}, h AS ({' UNION ALL '.join(phrases)}), len_ AS (SELECT doc_id, count(*) AS l FROM p GROUP BY doc_id), tot AS (SELECT (SELECT count(*) FROM docs) AS n, (SELECT sum(l) FROM len_) AS alls),
 tf AS (SELECT phrase, doc_id, sum({weights}) AS f FROM h GROUP BY 1,2), dfs AS (SELECT phrase, count(*) AS df FROM tf GROUP BY 1)
 SELECT doc_id, round(score, 6) AS score FROM (SELECT tf.doc_id, -sum((CASE WHEN ln((n-df+0.5)/(df+0.5)) <= 0 THEN 1e-6 ELSE ln((n-df+0.5)/(df+0.5)) END) * f*2.2/(f+1.2*(1-0.75+0.75*l/(alls*1.0/n)))) AS score
 FROM tf JOIN dfs USING (phrase) JOIN len_ USING (doc_id), tot WHERE tf.doc_id IN ({match}) GROUP BY 1) ORDER BY round(score, 6), doc_id LIMIT {limit}"""


def _ranked(s, d, node, limit, weights=None):
    index = _index(s, d)
    return search.bm25(index.postings(), index.lengths(), node, weights).select("doc_id", F.round("score", 6).alias("score")).orderBy("score", "doc_id").limit(limit)


@query("fts_single_term_bm25", _bm25_sql([_phrase_sql(0, ["archiwum"])], 50))
def _(s, d):
    return _ranked(s, d, search.sanitised("archiwum"), 50)


@query("fts_and_bm25", _bm25_sql([_phrase_sql(0, ["password"]), _phrase_sql(1, ["budget"])], 50))
def _(s, d):
    return _ranked(s, d, search.sanitised("password budget"), 50)


@query("fts_phrase", _bm25_sql([_phrase_sql(0, ["hasło", "wygasło"])], 100))
def _(s, d):
    return _ranked(s, d, search.Node("and", [search.Phrase(["hasło", "wygasło"])]), 100)


@query("fts_weighted_columns", _bm25_sql([_phrase_sql(0, ["ticket"])], 50, "CASE WHEN col='title' THEN 10.0 ELSE 1.0 END"))
def _(s, d):
    return _ranked(s, d, search.sanitised("ticket"), 50, {"title": 10.0, "text": 1.0})


def _raw(s, d, text):
    return _index(s, d).matches(text)


@query("fts_prefix", f"WITH {POSTINGS} SELECT DISTINCT doc_id FROM p WHERE starts_with(term,'archiw')")
def _(s, d):
    return _raw(s, d, "archiw*")


@query("fts_or_not", f"WITH {POSTINGS} SELECT DISTINCT doc_id FROM p WHERE term IN ('budget','budzecie') AND doc_id NOT IN (SELECT doc_id FROM p WHERE term='password')")
def _(s, d):
    return _raw(s, d, "(budget OR budżecie) NOT password")


@query("fts_near", f"WITH {POSTINGS} SELECT DISTINCT a.doc_id FROM p a JOIN p b ON a.doc_id=b.doc_id AND a.col=b.col WHERE a.term='password' AND b.term='file' AND greatest(a.pos,b.pos)+1-least(a.pos,b.pos)-2 <= 5")
def _(s, d):
    return _raw(s, d, "NEAR(password file, 5)")


@query("fts_initial", f"WITH {POSTINGS} SELECT DISTINCT doc_id FROM p WHERE term='witam' AND pos=0")
def _(s, d):
    return _raw(s, d, "^witam")


@query("fts_column_filter", f"WITH {POSTINGS} SELECT DISTINCT doc_id FROM p WHERE term='umowa' AND col='title'")
def _(s, d):
    return _raw(s, d, "title: umowa")


@query("fts_snippet")
def _(s, d):
    index, node = _index(s, d), search.sanitised("password budget")
    top = search.top_hits(search.bm25(index.postings(), index.lengths(), node), 25)
    terms = {t for p in search.all_phrases(node) for t in p.terms}
    snippet = F.udf(lambda x: search.make_snippet(x, terms), "string", useArrow=True)
    docs = table(s, d, "documents").select("doc_id", "text").join(F.broadcast(top), "doc_id").groupBy("doc_id", "score").agg(F.max("text").alias("text"))  # 25 rows
    return docs.select("doc_id", "score", snippet("text").alias("snippet"))


# full text over mails and segments

_TOK = lambda c: TOK.replace("{c}", c)
_MAIL_DOCS = "docs AS (SELECT entry_id AS doc_id, coalesce(m.subject,'') AS subject, coalesce(m.body,'') AS body, coalesce(m.sender_name,'')||' '||coalesce(m.sender_email,'') AS sender, coalesce(m.to_recips,'')||' '||coalesce(m.cc_recips,'') AS recips FROM (SELECT DISTINCT entry_id, subject, body, sender_name, sender_email, to_recips, cc_recips FROM mails) m)"
_SEG_DOCS = "docs AS (SELECT segment_id AS doc_id, received, coalesce(m.subject,'') AS subject, coalesce(sender_name,'')||' '||coalesce(sender_email,'') AS sender, coalesce(to_recips,'')||' '||coalesce(cc_recips,'') AS recipients, coalesce(filename,'') AS filename, clean_text AS text FROM (SELECT DISTINCT segment_id, document_id, clean_text FROM content_segments) s JOIN content_documents d USING (document_id) JOIN (SELECT DISTINCT entry_id, received, subject, sender_name, sender_email, to_recips, cc_recips FROM mails) m ON m.entry_id = d.mail_entry_id)"
_MAIL_P = _MAIL_DOCS + ", tk AS (" + " UNION ALL ".join(f"SELECT doc_id, '{c}' AS col, {_TOK(c)} AS t FROM docs" for c in fulltext.MAIL_COLUMNS) + "), p AS (SELECT doc_id, col, unnest(generate_series(0, len(t)-1)) AS pos, unnest(t) AS term FROM tk WHERE len(t) > 0)"
_SEG_P = _SEG_DOCS + ", tk AS (" + " UNION ALL ".join(f"SELECT doc_id, '{c}' AS col, {_TOK(c)} AS t FROM docs" for c in fulltext.CONTENT_WEIGHTS) + "), p AS (SELECT doc_id, col, unnest(generate_series(0, len(t)-1)) AS pos, unnest(t) AS term FROM tk WHERE len(t) > 0)"
_SEG_W = "CASE col WHEN 'subject' THEN 10.0 WHEN 'sender' THEN 5.0 WHEN 'recipients' THEN 2.0 WHEN 'filename' THEN 8.0 ELSE 1.0 END"


def _scored_sql(ctes: str, phrases: list[str], weights: str, tail: str) -> str:
    return f"""WITH {ctes}, h AS ({' UNION ALL '.join(phrases)}), len_ AS (SELECT doc_id, coalesce(l, 0) AS l FROM docs LEFT JOIN (SELECT doc_id, count(*) AS l FROM p GROUP BY doc_id) USING (doc_id)), tot AS (SELECT (SELECT count(*) FROM docs) AS n, (SELECT sum(l) FROM len_) AS alls),
 tf AS (SELECT phrase, doc_id, sum({weights}) AS f FROM h GROUP BY 1,2), dfs AS (SELECT phrase, count(*) AS df FROM tf GROUP BY 1),
 scored AS (SELECT tf.doc_id, round(-sum((CASE WHEN ln((n-df+0.5)/(df+0.5)) <= 0 THEN 1e-6 ELSE ln((n-df+0.5)/(df+0.5)) END) * f*2.2/(f+1.2*(1-0.75+0.75*l/(alls*1.0/n)))), 6) AS score
 FROM tf JOIN dfs USING (phrase) JOIN len_ USING (doc_id), tot WHERE tf.doc_id IN (SELECT doc_id FROM h GROUP BY doc_id HAVING count(DISTINCT phrase) = {len(phrases)}) GROUP BY 1) {tail}"""


@query("mail_fts", _scored_sql(_MAIL_P, [_phrase_sql(0, ["password"]), _phrase_sql(1, ["file"])], "1.0", "SELECT doc_id AS entry_id, score FROM scored JOIN (SELECT DISTINCT entry_id, kind, received FROM mails) m ON m.entry_id = doc_id WHERE (kind IS NULL OR kind <> 'alert') AND received >= '2022-01-01 00:00:00' ORDER BY score, doc_id LIMIT 50"))
def _(s, d):
    hits = _mail_index(s, d).scores("password file")
    return search.search_mails(table(s, d, "mails"), date_from="2022-01-01", limit=50, hits=hits).select("entry_id", "score")


@query("mail_fts_raw", f"WITH {_MAIL_P} SELECT DISTINCT doc_id AS entry_id FROM p WHERE term IN (SELECT term FROM p WHERE starts_with(term,'archiw')) AND col = 'body' AND doc_id NOT IN (SELECT doc_id FROM p WHERE term = 'password')")
def _(s, d):
    return _mail_index(s, d).matches("body: archiw* NOT password").withColumnRenamed("doc_id", "entry_id")


@query("content_search", _scored_sql(_SEG_P, [_phrase_sql(0, ["password"])], _SEG_W, "SELECT doc_id AS segment_id, score, docs.received FROM scored JOIN docs USING (doc_id) ORDER BY score, docs.received DESC NULLS LAST, doc_id LIMIT 40"))
def _(s, d):
    return fulltext.search_segments(_segment_index(s, d), _segment_rows(s, d), "password", 40).select("segment_id", "score", "received")


@query("content_snippets")
def _(s, d):
    return fulltext.search_segments(_segment_index(s, d), _segment_rows(s, d), "password file", 25)


@query("content_rebuild", f"WITH {_SEG_DOCS} SELECT count(*) AS n FROM docs")
def _(s, d):
    return _segment_index(s, d).lengths().agg(F.count(F.lit(1)).alias("n"))


@query("content_incremental", f"WITH {_SEG_P} SELECT term, count(DISTINCT doc_id) AS n FROM p WHERE doc_id % 3 <> 0 AND term IN ('password', 'budget', 'umowa') AND (col <> 'text' OR doc_id % 5 <> 0) GROUP BY term")
def _(s, d):
    rows = _segment_rows(s, d).select("segment_id", *fulltext.CONTENT_WEIGHTS)
    root = f"{ensure_checkpoint_dir(s)}/lakepost-index/incremental-{zlib.crc32(d.encode()):08x}-{s.sparkContext.applicationId}"
    index = fulltext.TextIndex(s, root, tuple(fulltext.CONTENT_WEIGHTS))
    if index.generations() < 3:
        # all segments, then every fifth with another text, then every third is deleted
        for _ in range(index.generations(), 1):
            index.write(rows, "segment_id")
        if index.generations() == 1:
            index.write(rows.filter("segment_id % 5 = 0").withColumn("text", F.lit("other")), "segment_id")
        if index.generations() == 2:
            index.remove(rows.filter("segment_id % 3 = 0").select(F.col("segment_id").alias("doc_id")))
    p = index.postings()
    want = [search.in_bucket(t) & (F.col("term") == t) for t in ("password", "budget", "umowa")]
    return p.filter(want[0] | want[1] | want[2]).groupBy("term").agg(F.count_distinct("doc_id").alias("n"))


def segment_context(s, d):
    docs, mails = table(s, d, "content_documents"), table(s, d, "mails").select("entry_id", "subject", "sender_name", "sender_email").dropDuplicates(["entry_id"])
    return table(s, d, "content_segments").distinct().join(docs.select("document_id", "mail_entry_id", "filename", "detected_mime_type"), "document_id").join(mails, F.col("mail_entry_id") == F.col("entry_id"), "left")


@query("segment_context_join", "SELECT s.segment_id, s.document_id, s.ordinal, d.filename, m.entry_id FROM (SELECT DISTINCT * FROM content_segments) s JOIN content_documents d USING (document_id) LEFT JOIN (SELECT DISTINCT entry_id FROM mails) m ON d.mail_entry_id = m.entry_id")
def _(s, d):
    return segment_context(s, d).select("segment_id", "document_id", "ordinal", "filename", "entry_id")


@query("location_label", """SELECT DISTINCT segment_id, coalesce('page '||page_number, 'slide '||slide_number, 'sheet '||nullif(sheet_name,''), CASE WHEN start_ms IS NOT NULL THEN printf('%02d:%02d:%02d', start_ms//1000//3600, start_ms//1000//60%60, start_ms//1000%60)||'-'||printf('%02d:%02d:%02d', coalesce(end_ms,start_ms)//1000//3600, coalesce(end_ms,start_ms)//1000//60%60, coalesce(end_ms,start_ms)//1000%60) END, '') AS place FROM content_segments""")
def _(s, d):
    c = F.col
    return table(s, d, "content_segments").select("segment_id", place_label(c("page_number"), c("slide_number"), c("sheet_name"), c("start_ms"), c("end_ms")).alias("place")).distinct()


@query("timestamp_label", "SELECT event_id, printf('%02d:%02d:%02d', (event_id*7919)//1000//3600, (event_id*7919)//1000//60%60, (event_id*7919)//1000%60) AS label FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", clock_label(F.col("event_id") * 7919).alias("label"))


@query("running_text_budget", "SELECT segment_id, document_id, ordinal, used FROM (SELECT *, coalesce(sum(length(clean_text)+2) OVER (PARTITION BY document_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)::BIGINT AS used FROM (SELECT DISTINCT segment_id, document_id, ordinal, clean_text FROM content_segments)) WHERE used < 3000")
def _(s, d):
    w = Window.partitionBy("document_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    seg = table(s, d, "content_segments").select("segment_id", "document_id", "ordinal", "clean_text").distinct()
    return seg.withColumn("used", F.coalesce(F.sum(F.length("clean_text") + 2).over(w), F.lit(0)).cast("long")).filter("used < 3000").select("segment_id", "document_id", "ordinal", "used")


@query("transcript_join", "SELECT document_id, string_agg(clean_text, chr(10) ORDER BY ordinal, segment_id) AS text FROM (SELECT DISTINCT s.* FROM content_segments s JOIN content_documents d USING (document_id) WHERE d.extractor_name='whisper') GROUP BY 1")
def _(s, d):
    seg = table(s, d, "content_segments").distinct().join(table(s, d, "content_documents").filter("extractor_name='whisper'").select("document_id"), "document_id", "left_semi")
    return seg.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "segment_id", "clean_text"))), lambda x: x["clean_text"]), "\n").alias("text"))


@query("html_to_text")
def _(s, d):
    page = F.concat(F.lit("<html><style>x{}</style><p title='a > b'>"), F.regexp_replace(F.coalesce("text", F.lit("")), "\n", "<br>"), F.lit("</p><!-- c --><script>1"))
    return table(s, d, "documents").select("doc_id", html_to_text(page).alias("text"))


@query("pdf_text_quality", "SELECT DISTINCT segment_id, length(regexp_replace(raw_text,'[^\\p{L}\\p{Nd}]','','g')) < 30 AS needs_ocr FROM content_segments")
def _(s, d):
    return table(s, d, "content_segments").select("segment_id", (F.length(F.regexp_replace("raw_text", r"[^\p{L}\p{Nd}]", "")) < 30).alias("needs_ocr")).distinct()


# vectors
QUERY_VECTOR_SQL = "(SELECT embedding AS q FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))"
DOT_SQL = "list_sum(list_transform(list_zip(embedding, q), lambda z: z[1]::DOUBLE*z[2]::DOUBLE))"


def _query_vector(s, d):
    e = table(s, d, "embeddings")
    return list(e.orderBy("vec_id").limit(1).collect()[0]["embedding"])


@query("vector_topk_cosine", f"SELECT vec_id, round({DOT_SQL},6) AS similarity FROM embeddings, {QUERY_VECTOR_SQL} ORDER BY {DOT_SQL} DESC, vec_id DESC LIMIT 40")
def _(s, d):
    top = vector.top_similar(table(s, d, "embeddings"), _query_vector(s, d), "vec_id", "embedding", 40)
    return top.select("vec_id", F.round("similarity", 6).alias("similarity"))


@query("vector_candidate_cap", f"SELECT vec_id, round({DOT_SQL},6) AS similarity FROM (SELECT * FROM embeddings ORDER BY vec_id DESC LIMIT 100), {QUERY_VECTOR_SQL} ORDER BY {DOT_SQL} DESC, vec_id DESC LIMIT 10")
def _(s, d):
    recent = vector.candidates(table(s, d, "embeddings"), [F.desc("vec_id")], 100)
    return vector.top_similar(recent, _query_vector(s, d), "vec_id", "embedding", 10).select("vec_id", F.round("similarity", 6).alias("similarity"))


@query("vector_normalise", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE*x::DOUBLE)),4) AS norm2 FROM embeddings")
def _(s, d):
    v = vector.normalise(F.transform("embedding", lambda x: x * 3))
    return table(s, d, "embeddings").select("vec_id", F.round(vector.dot(v, v), 4).alias("norm2"))


@query("hybrid_rrf", f"""WITH sem AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY sim DESC, vec_id DESC) AS sr FROM (SELECT vec_id, {DOT_SQL} AS sim FROM embeddings, {QUERY_VECTOR_SQL} ORDER BY sim DESC, vec_id DESC LIMIT 100)),
 lex AS (SELECT doc_id, row_number() OVER (ORDER BY score, doc_id) AS lr FROM ({_bm25_sql([_phrase_sql(0, ['archiwum'])], 100)}))
 SELECT doc_id, round(coalesce(1.0/(60+sr),0)+coalesce(1.25/(60+lr),0),6) AS score, CASE WHEN sr IS NOT NULL AND lr IS NOT NULL THEN 'fts+semantic' WHEN sr IS NOT NULL THEN 'semantic' ELSE 'fts' END AS channels FROM sem FULL OUTER JOIN lex USING (doc_id) ORDER BY coalesce(1.0/(60+sr),0)+coalesce(1.25/(60+lr),0) DESC, doc_id DESC LIMIT 25""")
def _(s, d):
    sem = vector.top_similar(table(s, d, "embeddings"), _query_vector(s, d), "vec_id", "embedding", 100).withColumnRenamed("vec_id", "doc_id")
    out = vector.fuse(sem, _ranked(s, d, search.sanitised("archiwum"), 100), "doc_id", 25)
    return out.select("doc_id", F.round("score", 6).alias("score"), "channels")


# semantic search: the vectors of the table belong to the segments of the same number

_SEM = "(SELECT e.vec_id AS segment_id, embedding, m.received FROM embeddings e JOIN (SELECT DISTINCT segment_id, document_id FROM content_segments) s ON s.segment_id = e.vec_id JOIN content_documents d USING (document_id) JOIN (SELECT entry_id, max(received) AS received FROM (SELECT entry_id, unnest(max(struct_pack(received, subject, sender_name, sender_email, to_recips, cc_recips))) FROM mails GROUP BY entry_id) GROUP BY 1) m ON m.entry_id = d.mail_entry_id)"


def _embeddings(s, d, model: str = "m"):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("segment_id"), F.lit(model).alias("model"), F.size("embedding").alias("dimensions"), F.col("embedding").alias("vector"))


@query("semantic_search", f"SELECT segment_id, round({DOT_SQL}, 6) AS similarity FROM (SELECT * FROM {_SEM} ORDER BY received DESC NULLS LAST, segment_id DESC LIMIT 100), {QUERY_VECTOR_SQL} ORDER BY {DOT_SQL} DESC, received DESC NULLS LAST, segment_id DESC LIMIT 20")
def _(s, d):
    both = _embeddings(s, d).unionByName(_embeddings(s, d, "other"))
    got = semantic.search_semantic(both, "m", _query_vector(s, d), _segment_rows(s, d), 20, 100)
    return got.hits.select("segment_id", F.round("similarity", 6).alias("similarity"))


@query("semantic_flags", "SELECT (SELECT count(*) FROM embeddings) AS indexed, (SELECT count(*) FROM embeddings) > 100 AS cap_reached, false AS mismatch, 0::BIGINT AS mismatch_hits, true AS mismatch_told, false AS mismatch_cap")
def _(s, d):
    rows, e = _segment_rows(s, d), _embeddings(s, d)
    right = semantic.search_semantic(e, "m", _query_vector(s, d), rows, 20, 100)
    wrong = semantic.search_semantic(e, "m", [1.0, 0.0], rows, 20, 100)
    told = s.createDataFrame([(right.indexed, right.cap_reached, right.mismatch, wrong.mismatch, wrong.cap_reached)], "indexed long, cap_reached boolean, mismatch boolean, mismatch_told boolean, mismatch_cap boolean")
    return told.join(F.broadcast(wrong.hits.agg(F.count(F.lit(1)).alias("mismatch_hits"))))  # one row


_LEX = _scored_sql(_SEG_P, [_phrase_sql(0, ["password"])], _SEG_W, "SELECT doc_id AS segment_id, row_number() OVER (ORDER BY score, docs.received DESC NULLS LAST, doc_id) AS lr FROM (SELECT scored.* FROM scored JOIN docs USING (doc_id) ORDER BY score, docs.received DESC NULLS LAST, doc_id LIMIT 80) scored JOIN docs USING (doc_id)")


@query("semantic_hybrid", f"""SELECT segment_id, round(coalesce(1.0/(60+sr),0)+coalesce(1.25/(60+lr),0),6) AS score, CASE WHEN sr IS NOT NULL AND lr IS NOT NULL THEN 'fts+semantic' WHEN sr IS NOT NULL THEN 'semantic' ELSE 'fts' END AS channels
 FROM (SELECT segment_id, row_number() OVER (ORDER BY sim DESC, received DESC NULLS LAST, segment_id DESC) AS sr FROM (SELECT segment_id, received, {DOT_SQL} AS sim FROM {_SEM}, {QUERY_VECTOR_SQL} ORDER BY sim DESC, received DESC NULLS LAST, segment_id DESC LIMIT 80)) FULL OUTER JOIN ({_LEX}) USING (segment_id)
 JOIN (SELECT s.segment_id, m.received FROM (SELECT DISTINCT segment_id, document_id FROM content_segments) s JOIN content_documents d USING (document_id) JOIN (SELECT DISTINCT entry_id, received FROM mails) m ON m.entry_id = d.mail_entry_id) r USING (segment_id)
 ORDER BY coalesce(1.0/(60+sr),0)+coalesce(1.25/(60+lr),0) DESC, received DESC NULLS LAST, sr ASC NULLS LAST, lr ASC NULLS LAST LIMIT 20""")
def _(s, d):
    got = semantic.search_semantic(_embeddings(s, d), "m", _query_vector(s, d), _segment_rows(s, d), 20, hybrid=True, index=_segment_index(s, d), text="password")
    return got.hits.select("segment_id", F.round("score", 6).alias("score"), "channels")


@query("semantic_pending", "SELECT segment_id FROM (SELECT DISTINCT segment_id, clean_text FROM content_segments) WHERE length(trim(clean_text)) > 0 AND segment_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 2 = 0)")
def _(s, d):
    e = _embeddings(s, d).filter("segment_id % 2 = 0").unionByName(_embeddings(s, d, "other"))
    return semantic.pending(table(s, d, "content_segments"), e, "m").select("segment_id")


def _letters(texts: list[str]) -> list[list[float]]:
    """A deterministic stand-in for a model: shares of a few letters."""
    return [[1.0, *(t.count(c) / max(1, len(t)) for c in "aeiou")] for t in texts]


@query("semantic_index", "SELECT model, dimensions, count(*) AS n FROM (SELECT 'letters' AS model, 6 AS dimensions, segment_id FROM (SELECT DISTINCT segment_id FROM content_segments WHERE length(trim(clean_text)) > 0) UNION ALL SELECT 'other', len(embedding), vec_id FROM embeddings) GROUP BY 1, 2")
def _(s, d):
    out = semantic.index_embeddings(table(s, d, "content_segments"), _embeddings(s, d, "other"), semantic.Provider("letters", _letters), rebuild=True)
    return out.groupBy("model", "dimensions").agg(F.count(F.lit(1)).alias("n"))


@query("semantic_count", "SELECT count(*) AS n FROM embeddings WHERE vec_id IN (SELECT segment_id FROM content_segments WHERE document_id = (SELECT min(document_id) FROM content_segments))")
def _(s, d):
    seg = table(s, d, "content_segments")
    first = seg.agg(F.min("document_id").alias("x")).head()["x"]
    return semantic.count_embeddings(_embeddings(s, d), "m", seg, first)


@query("pending_embeddings_anti", "SELECT doc_id FROM (SELECT DISTINCT doc_id, text FROM documents) WHERE length(trim(text)) > 0 AND doc_id NOT IN (SELECT vec_id FROM embeddings)")
def _(s, d):
    docs = table(s, d, "documents").select("doc_id", "text").distinct().filter("length(trim(text)) > 0")
    return docs.join(table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti").select("doc_id")


@query("blob_dedup_sha256", "SELECT sha256(text) AS sha256, count(*) AS copies, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1")
def _(s, d):
    return table(s, d, "documents").filter("text IS NOT NULL").groupBy(F.sha2("text", 256).alias("sha256")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc"))


@query("label_name_join", "SELECT l AS label, coalesce(m.name, l) AS name, count(*) AS n FROM (SELECT unnest(label_ids) AS l FROM (SELECT DISTINCT * FROM messages)) LEFT JOIN (VALUES ('INBOX','Inbox'),('UNREAD','Unread')) m(id,name) ON l = m.id GROUP BY 1,2")
def _(s, d):
    names = s.createDataFrame([("INBOX", "Inbox"), ("UNREAD", "Unread")], "label string, name string")
    l = table(s, d, "messages").distinct().select(F.explode("label_ids").alias("label"))
    return l.groupBy("label").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(names), "label", "left").select("label", F.coalesce("name", "label").alias("name"), "n")


@query("categories_agg", "SELECT account_id, gmail_message_id, array_to_string(list_sort(label_ids), '; ') AS categories, list_contains(label_ids,'UNREAD') AS unread FROM (SELECT DISTINCT * FROM messages)")
def _(s, d):
    m = table(s, d, "messages").distinct()
    return m.select("account_id", "gmail_message_id", F.array_join(F.array_sort("label_ids"), "; ").alias("categories"), F.array_contains("label_ids", "UNREAD").alias("unread"))


# jobs, taken from orders
JOBS_SQL = "(SELECT o_orderkey AS id, CASE WHEN o_custkey % 2 = 0 THEN 'extract' ELSE 'ocr' END AS job_type, CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_custkey END AS attachment_id, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'pending' ELSE 'running' END AS status, o_orderpriority AS priority, (o_orderkey % 4)::BIGINT AS attempts, 3::BIGINT AS max_attempts, o_orderdate AS available_at, o_orderdate AS lease_until, NULL::VARCHAR AS error_code FROM orders)"
NOW = "1996-06-01 00:00:00"


def _jobs(s, d):
    return table(s, d, "orders").selectExpr(
        "o_orderkey AS id", "CASE WHEN o_custkey % 2 = 0 THEN 'extract' ELSE 'ocr' END AS job_type", "CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_custkey END AS attachment_id",
        "CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'pending' ELSE 'running' END AS status", "o_orderpriority AS priority", "o_orderkey % 4 AS attempts", "3L AS max_attempts", "o_orderdate AS available_at", "o_orderdate AS lease_until", "CAST(NULL AS string) AS error_code",
    )


def _now():
    return F.to_timestamp_ntz(F.lit(NOW))


@query("job_counts_zero_filled", f"SELECT s.status, count(j.id) AS n FROM (VALUES ('pending'),('running'),('completed'),('failed')) s(status) LEFT JOIN {JOBS_SQL} j USING (status) GROUP BY 1")
def _(s, d):
    return merge.counts_by_status(_jobs(s, d), ["pending", "running", "completed", "failed"])


@query("lease_ready_queue", f"SELECT id, priority FROM {JOBS_SQL} WHERE status='pending' AND attempts<max_attempts AND available_at <= TIMESTAMP '{NOW}' ORDER BY priority, id LIMIT 100")
def _(s, d):
    return merge.ready_jobs(_jobs(s, d), _now(), 100).select("id", "priority")


@query("lease_transition", f"SELECT id, CASE WHEN gone AND attempts>=max_attempts THEN 'failed' WHEN gone THEN 'pending' ELSE status END AS status, CASE WHEN gone THEN coalesce(error_code,'lease-expired') ELSE error_code END AS error_code FROM (SELECT *, status='running' AND lease_until <= TIMESTAMP '{NOW}' AS gone FROM {JOBS_SQL})")
def _(s, d):
    return merge.recover_expired(_jobs(s, d), _now()).select("id", "status", "error_code")


@query("retry_newest_failed", f"SELECT id FROM (SELECT *, max(CASE WHEN status='failed' THEN id END) OVER w AS top, max(CASE WHEN status IN ('pending','running') THEN 1 ELSE 0 END) OVER w AS busy FROM {JOBS_SQL} WINDOW w AS (PARTITION BY job_type, attachment_id)) WHERE status='failed' AND (attachment_id IS NULL OR (id=top AND busy=0))")
def _(s, d):
    return merge.retry_newest_failed(_jobs(s, d)).select("id")


@query("enqueue_dedupe", f"SELECT job_type, attachment_id FROM (SELECT DISTINCT CASE WHEN c_custkey%2=0 THEN 'extract' ELSE 'ocr' END AS job_type, c_custkey AS attachment_id FROM customer) c WHERE NOT EXISTS (SELECT 1 FROM {JOBS_SQL} j WHERE j.status IN ('pending','running') AND j.job_type=c.job_type AND j.attachment_id=c.attachment_id)")
def _(s, d):
    wanted = table(s, d, "customer").selectExpr("CASE WHEN c_custkey%2=0 THEN 'extract' ELSE 'ocr' END AS job_type", "c_custkey AS attachment_id").distinct()
    return wanted.join(_jobs(s, d).filter("status IN ('pending','running')"), ["job_type", "attachment_id"], "left_anti").select("job_type", "attachment_id")


@query("orphan_blob_gc", "SELECT count(*) AS orphans, coalesce(sum(o_custkey),0)::BIGINT AS bytes FROM orders WHERE o_orderdate <= TIMESTAMP '1996-05-31 23:00:00' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def _(s, d):
    li = table(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), "l_quantity", "l_returnflag")
    blobs = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", F.col("o_orderdate").alias("created_at"))
    cutoff = _now() - F.make_dt_interval(hours=F.lit(1))
    return merge.orphans(blobs, li.filter("l_quantity > 45"), li.filter("l_returnflag = 'R'"), cutoff).agg(F.count(F.lit(1)).alias("orphans"), F.coalesce(F.sum("o_custkey"), F.lit(0)).cast("long").alias("bytes"))


@query("busy_blobs", "SELECT DISTINCT document_id AS blob FROM content_documents WHERE document_id IN (SELECT coalesce(CASE WHEN vec_id % 2 = 0 THEN vec_id END, vec_id + 1) FROM embeddings WHERE vec_id % 3 = 0)")
def _(s, d):
    att = table(s, d, "content_documents").select(F.col("document_id").alias("id"), F.col("document_id").alias("blob_id"))
    docs = table(s, d, "content_documents").select("document_id", F.col("document_id").alias("attachment_id"))
    running = table(s, d, "embeddings").filter("vec_id % 3 = 0").select(F.when(F.col("vec_id") % 2 == 0, F.col("vec_id")).alias("attachment_id"), (F.col("vec_id") + 1).alias("document_id"))
    return merge.busy_blobs(running, docs, att).select(F.col("blob_id").alias("blob"))


@query("semi_delete_survivors", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag='R')")
def _(s, d):
    gone = table(s, d, "lineitem").filter("l_returnflag='R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(s, d, "orders").select("o_orderkey").join(gone, "o_orderkey", "left_anti")


@query("upsert_last_wins", "SELECT user_id, event_type, round(value,6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn=1")
def _(s, d):
    return merge.last_wins(table(s, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", F.round("value", 6).alias("value"))


@query("mail_upsert_latest", "SELECT entry_id, max(harvested_at) AS harvested_at FROM mails GROUP BY 1")
def _(s, d):
    m = table(s, d, "mails").select("entry_id", "harvested_at")
    first = merge.last_wins(m, ["entry_id"], [F.asc_nulls_last("harvested_at")])
    return merge.upsert(first, merge.last_wins(m, ["entry_id"], [F.desc_nulls_last("harvested_at")]), ["entry_id"])


@query("insert_update_tally", "SELECT count_if(rn=1) AS inserted, count_if(rn>1) AS updated FROM (SELECT row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events)")
def _(s, d):
    n = table(s, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("k"))
    return n.agg(F.count(F.lit(1)).alias("inserted"), F.sum(F.col("k") - 1).alias("updated"))


@query("identity_resolution", """WITH b AS (SELECT DISTINCT entry_id, legacy_entry_id, store_id, source_identity FROM mails), t AS (SELECT * FROM b WHERE starts_with(store_id,'gmail') OR starts_with(store_id,'imap')), a1 AS (SELECT source_identity, min(entry_id) AS x FROM t WHERE source_identity IS NOT NULL GROUP BY 1), a2 AS (SELECT entry_id AS legacy_entry_id, store_id, min(entry_id) AS x FROM t WHERE source_identity IS NULL GROUP BY 1,2), a3 AS (SELECT DISTINCT entry_id AS x FROM t)
 SELECT b.entry_id, coalesce(a1.x,a2.x,a3.x) AS resolved_id FROM b LEFT JOIN a1 USING (source_identity) LEFT JOIN a2 ON a2.legacy_entry_id=b.legacy_entry_id AND a2.store_id=b.store_id LEFT JOIN a3 ON a3.x=b.entry_id""")
def _(s, d):
    b = table(s, d, "mails").select("entry_id", "legacy_entry_id", "store_id", "source_identity").distinct()
    t = b.filter(F.col("store_id").startswith("gmail") | F.col("store_id").startswith("imap"))
    return merge.resolve_identity(t, b).select("entry_id", "resolved_id")


@query("generation_prune", "SELECT event_id FROM (SELECT event_id, event_id % 3 AS g FROM events) WHERE g = 2 OR event_id IN (SELECT event_id FROM events WHERE event_type='error')")
def _(s, d):
    e = table(s, d, "events").select("event_id", (F.col("event_id") % 3).alias("last_seen_generation"))
    return merge.generation_prune(e, 2, table(s, d, "events").filter("event_type='error'").select("event_id"), "event_id").select("event_id")


@query("soft_delete_diff", "SELECT user_id, max(h)=0 AS is_deleted FROM (SELECT user_id, CASE WHEN event_type='purchase' THEN 1 ELSE 0 END AS h FROM events) GROUP BY 1")
def _(s, d):
    e = table(s, d, "events")
    return merge.soft_delete_diff(e.select("user_id").distinct(), e.filter("event_type='purchase'"), ["user_id"])


@query("cdc_set_algebra", "(SELECT user_id FROM events WHERE event_type='click' UNION SELECT user_id FROM events WHERE event_type='view') EXCEPT SELECT user_id FROM events WHERE event_type='error'")
def _(s, d):
    e = table(s, d, "events")
    ids = lambda k: e.filter(F.col("event_type") == k).select("user_id")
    return ids("click").union(ids("view")).distinct().join(ids("error"), "user_id", "left_anti")


@query("retry_ledger_merge", "SELECT user_id, count(*) AS attempts, arg_min(ts, event_id) AS first_failed_at, max(ts) AS last_failed_at, arg_max(props, (ts, props)) AS error_code FROM events WHERE event_type='error' AND ts IS NOT NULL GROUP BY 1")
def _(s, d):
    # failures in the order they happened: a first run up to a day, a second one after it
    f = table(s, d, "events").filter("event_type='error'").select("user_id", F.col("ts").alias("failed_at"), F.col("props").alias("error_code"))
    day = F.to_timestamp_ntz(F.lit("2024-01-15 00:00:00"))
    none = f.limit(0).select("user_id", F.lit(0).cast("long").alias("attempts"), F.col("failed_at").alias("first_failed_at"), F.col("failed_at").alias("last_failed_at"), "error_code")
    return merge.merge_retries(merge.merge_retries(none, f.filter(F.col("failed_at") < day), "user_id"), f.filter(F.col("failed_at") >= day), "user_id")


@query("newest_n_per_folder", "SELECT folder_path, entry_id FROM (SELECT *, row_number() OVER (PARTITION BY folder_path ORDER BY received DESC NULLS LAST, entry_id) AS rn FROM (SELECT DISTINCT entry_id, folder_path, received FROM mails)) WHERE rn <= 3")
def _(s, d):
    m = table(s, d, "mails").select("entry_id", "folder_path", "received").distinct()
    w = Window.partitionBy("folder_path").orderBy(F.desc_nulls_last("received"), "entry_id")
    return m.withColumn("rn", F.row_number().over(w)).filter("rn <= 3").select("folder_path", "entry_id")


@query("account_status", "SELECT a.id, a.email, count(m.gmail_message_id) AS messages FROM accounts a LEFT JOIN (SELECT DISTINCT account_id, gmail_message_id FROM messages) m ON m.account_id=a.id GROUP BY 1,2")
def _(s, d):
    n = table(s, d, "messages").select("account_id", "gmail_message_id").distinct().groupBy(F.col("account_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return table(s, d, "accounts").select("id", "email").join(n, "id", "left").select("id", "email", F.coalesce("n", F.lit(0)).alias("messages"))


@query("props_json_parse", "SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))



@query("size_tolerance", "SELECT l_orderkey, l_linenumber, d > 0 AND abs(a - d) > greatest(4096, d // 100) AS mismatch FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 3 THEN 0 ELSE l_extendedprice::BIGINT END AS d, (1000*l_quantity)::BIGINT AS a FROM lineitem)")
def _(s, d):
    li = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") == 3, F.lit(0)).otherwise(F.round("l_extendedprice")).cast("long").alias("d"), (1000 * F.col("l_quantity")).cast("long").alias("a"))
    return li.select("l_orderkey", "l_linenumber", merge.size_mismatch(F.col("d"), F.col("a")).alias("mismatch"))


@query("source_identity_hash", "SELECT DISTINCT entry_id, lower(trim(split_part(store_id,':',1)))||':'||sha256(entry_id) AS identity FROM mails")
def _(s, d):
    return table(s, d, "mails").select("entry_id", F.concat(F.lower(F.trim(F.split_part("store_id", F.lit(":"), F.lit(1)))), F.lit(":"), F.sha2("entry_id", 256)).alias("identity")).distinct()


@query("scope_all_union", "SELECT 'mail' AS section, entry_id AS id FROM (SELECT DISTINCT entry_id, subject FROM mails) WHERE contains(lower(subject),'faktura') UNION ALL SELECT 'content', segment_id::VARCHAR FROM (SELECT DISTINCT segment_id, clean_text FROM content_segments) WHERE contains(lower(clean_text),'faktura')")
def _(s, d):
    m = table(s, d, "mails").select("entry_id", "subject").distinct().filter(F.lower("subject").contains("faktura")).select(F.lit("mail").alias("section"), F.col("entry_id").alias("id"))
    c = table(s, d, "content_segments").select("segment_id", "clean_text").distinct().filter(F.lower("clean_text").contains("faktura"))
    return m.unionByName(c.select(F.lit("content").alias("section"), F.col("segment_id").cast("string").alias("id")))
