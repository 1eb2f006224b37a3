"""Stored full-text indexes: built once, read by bucket, changed by generations.

An index is a folder of Parquet tables: ``postings`` (bucket, term, doc_id, col, pos) partitioned by
the bucket of the term and sorted by term, so that a search reads the row groups of its terms only;
``lengths`` (doc_id, len) of every document; ``gone`` (doc_id, before): documents whose older
generations don't count any more.  Documents are added, changed and deleted by writing a further
generation; ``compact`` folds them into one.  A generation is visible when its last table is
written, so a lost job leaves the index as it was.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakepost.operators import search
from lakepost.session import path_exists

# Weights of the columns of segments.
CONTENT_WEIGHTS = {"subject": 10.0, "sender": 5.0, "recipients": 2.0, "filename": 8.0, "text": 1.0}
MAIL_COLUMNS = ["subject", "body", "sender", "recips"]


@dataclass(frozen=True)
class TextIndex:
    """An index below ``root`` over ``columns``."""

    spark: SparkSession
    root: str
    columns: tuple[str, ...]

    def generations(self) -> int:
        n = 0
        while path_exists(self.spark, f"{self.root}/gone/gen={n}/_SUCCESS"):
            n += 1
        return n

    def write(self, df: DataFrame, key: str, gone: DataFrame | None = None) -> "TextIndex":
        """A further generation: the rows of ``df`` replace older ones of their keys, ``gone`` (doc_id) only go."""
        gen = self.generations()
        rows = df.select(F.col(key).alias("doc_id"), *self.columns)
        postings = search.build_postings(rows, "doc_id", list(self.columns)).withColumn("bucket", search.bucket_of(F.col("term")))
        # a hot bucket is spread over several files by the document
        spread = F.pmod(F.xxhash64("doc_id"), F.lit(4))
        postings.repartition("bucket", spread).sortWithinPartitions("bucket", "term", "doc_id").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/postings/gen={gen}")
        rows.select("doc_id", self._length().alias("len")).write.mode("overwrite").parquet(f"{self.root}/lengths/gen={gen}")
        dead = rows.select("doc_id") if gone is None else rows.select("doc_id").unionByName(gone.select("doc_id"))
        # the first generation replaces nothing
        dead = dead.distinct() if gen else dead.limit(0)
        dead.write.mode("overwrite").parquet(f"{self.root}/gone/gen={gen}")
        return self

    def _length(self):
        return sum((F.size(search.tokens(F.col(c))) for c in self.columns), F.lit(0)).cast("long")

    def _live(self, name: str) -> DataFrame:
        gens = self.generations()
        out = None
        for g in range(gens):
            read = self.spark.read
            if name == "postings":
                # a generation without rows has no files to tell the schema
                key = self.spark.read.parquet(f"{self.root}/lengths/gen={g}").schema["doc_id"].dataType.simpleString()
                read = read.schema(f"doc_id {key}, col string, pos int, term string, bucket int")
            part = read.parquet(f"{self.root}/{name}/gen={g}")
            for later in range(g + 1, gens):
                part = part.join(self.spark.read.parquet(f"{self.root}/gone/gen={later}"), "doc_id", "left_anti")
            out = part if out is None else out.unionByName(part)
        if out is None:
            raise FileNotFoundError(self.root)
        return out

    def postings(self) -> DataFrame:
        return self._live("postings")

    def lengths(self) -> DataFrame:
        return self._live("lengths")

    def remove(self, gone: DataFrame) -> "TextIndex":
        """Delete documents (doc_id)."""
        empty = gone.select("doc_id", *[F.lit(None).cast("string").alias(c) for c in self.columns]).limit(0)
        return self.write(empty, "doc_id", gone)

    def scores(self, text: str, raw: bool = False, weights: dict[str, float] | None = None) -> DataFrame:
        """(doc_id, score) of the documents that match; raw text is read by the grammar, else each word is a phrase.

        A blank text matches nothing; raw text that can't be read raises QueryError.
        """
        if not text.strip():
            return self.lengths().select("doc_id", F.lit(0.0).alias("score")).limit(0)
        node = search.RawParser(text).parse() if raw else search.sanitised(text)
        return search.bm25(self.postings(), self.lengths(), node, weights)

    def matches(self, text: str, raw: bool = True) -> DataFrame:
        node = search.RawParser(text).parse() if raw else search.sanitised(text)
        return search.matching(self.postings(), node)


def compact(index: TextIndex, root: str) -> TextIndex:
    """The live rows of an index as one generation below another root."""
    out = TextIndex(index.spark, root, index.columns)
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(4))
    index.postings().repartition("bucket", spread).sortWithinPartitions("bucket", "term", "doc_id").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/postings/gen=0")
    index.lengths().write.mode("overwrite").parquet(f"{root}/lengths/gen=0")
    index.lengths().select("doc_id").limit(0).write.mode("overwrite").parquet(f"{root}/gone/gen=0")
    return out


def mail_rows(mails: DataFrame) -> DataFrame:
    """(entry_id, subject, body, sender, recips): what the index of mails holds; of repeated rows the greatest counts."""
    e = lambda c: F.coalesce(F.col(c), F.lit(""))
    cols = ["subject", "body", "sender_name", "sender_email", "to_recips", "cc_recips"]
    m = mails.filter("entry_id IS NOT NULL").groupBy("entry_id").agg(F.max(F.struct(*cols)).alias("m")).select("entry_id", "m.*")
    return m.select("entry_id", e("subject").alias("subject"), e("body").alias("body"), F.concat(e("sender_name"), F.lit(" "), e("sender_email")).alias("sender"), F.concat(e("to_recips"), F.lit(" "), e("cc_recips")).alias("recips"))


def segment_rows(segments: DataFrame, documents: DataFrame, mails: DataFrame) -> DataFrame:
    """Segments with the metadata of their mail and attachment: (segment_id, subject, sender, recipients, filename, text and what a hit shows)."""
    cols = ["received", "subject", "sender_name", "sender_email", "to_recips", "cc_recips"]
    m = mails.filter("entry_id IS NOT NULL").groupBy("entry_id").agg(F.max(F.struct(*cols)).alias("m")).select(F.col("entry_id").alias("mail_entry_id"), "m.*")
    seg = ["segment_id", "document_id", "page_number", "slide_number", "sheet_name", "start_ms", "end_ms", "clean_text"]
    s = segments.select(*seg).filter("segment_id IS NOT NULL").distinct()
    d = documents.select("document_id", "mail_entry_id", "filename", "detected_mime_type").distinct()
    e = lambda c: F.coalesce(F.col(c), F.lit(""))
    return s.join(d, "document_id").join(m, "mail_entry_id").select(
        "segment_id", "document_id", "received", F.coalesce("subject", F.lit("")).alias("subject"), F.concat(e("sender_name"), F.lit(" "), e("sender_email")).alias("sender"),
        F.concat(e("to_recips"), F.lit(" "), e("cc_recips")).alias("recipients"), e("filename").alias("filename"), F.col("clean_text").alias("text"), F.coalesce(F.nullif("sender_name", F.lit("")), "sender_email").alias("sender_shown"),
        e("detected_mime_type").alias("mime_type"), "page_number", "slide_number", "sheet_name", "start_ms", "end_ms",
    )


def search_segments(index: TextIndex, rows: DataFrame, text: str, limit: int = 25, raw: bool = False) -> DataFrame:
    """The best segments: score, then newest, then segment_id; limits are kept within 1 to 500; snippets are made for the hits alone."""
    limit = max(1, min(limit, 500))
    scores = index.scores(text, raw, CONTENT_WEIGHTS).select(F.col("doc_id").alias("segment_id"), F.round("score", 6).alias("score"))
    order = [F.asc("score"), F.desc("received"), F.asc("segment_id")]
    top = rows.select("segment_id", "received").join(scores, "segment_id").orderBy(*order).limit(limit).select("segment_id", "score")
    node = (search.RawParser(text).parse() if raw else search.sanitised(text)) if text.strip() else search.Node("and", [])
    terms = {t for p in search.all_phrases(node) for t in p.terms}
    snippet = F.udf(lambda x: search.make_snippet(x, terms), "string", useArrow=True)
    out = rows.join(F.broadcast(top), "segment_id").orderBy(*order)  # at most 500 rows
    return out.select("segment_id", "received", "subject", F.col("sender_shown").alias("sender"), "filename", "mime_type", "page_number", "slide_number", "sheet_name", "start_ms", "end_ms", snippet("text").alias("snippet"), "score")
