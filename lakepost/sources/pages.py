"""Pages of scanned files, images and media by providers: text layer, recognition, merge, transcripts.

Providers are plain functions that run in the tasks: ``page_text(bytes) -> list of texts``,
``page_images(bytes, numbers) -> list of bytes``, ``recognise(bytes) -> list of (text, score)``,
``transcribe(bytes) -> JSON``.  Without a provider a file keeps its ``needs-…`` status.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakepost.functions.messages import transcript_segments
from lakepost.functions.text import normalise

# When the text layer of a page is too poor.
LEAST_LETTERS, MOST_LOST = 30, 2
PAGE_LIMIT, PAGE_BATCH = 100, 4

PAGES = "document_key string, page_number int, raw_text string, confidence double, error string"


def poor_text(text: Column) -> Column:
    """Whether a page needs recognition: under 30 letters and digits, or more than max(2, length / 20) lost characters."""
    t = F.coalesce(text, F.lit(""))
    letters = F.length(F.regexp_replace(t, r"[^\p{L}\p{Nd}]", ""))
    lost = F.length(t) - F.length(F.replace(t, F.lit("�"), F.lit("")))
    return (letters < LEAST_LETTERS) | (lost > F.greatest(F.lit(MOST_LOST), F.floor(F.length(t) / 20)))


def text_pages(files: DataFrame, page_text: Callable[[bytes], list[str]] | None, key: str = "document_key") -> DataFrame:
    """(document_key, page_number, raw_text, confidence, error): the text layer of each page of ``files`` (key, content).

    Without a provider each file is one row with error ``no-provider``; a file that can't be read has the error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, content in zip(pdf[key], pdf["content"]):
                if page_text is None:
                    rows.append((k, None, None, None, "no-provider"))
                    continue
                try:
                    rows += [(k, n, t or "", None, None) for n, t in enumerate(page_text(bytes(content or b"")), 1)]
                except Exception as e:  # a provider's failure is a row, not a lost job
                    rows.append((k, None, None, None, f"{type(e).__name__}: {e}"[:500]))
            out = pd.DataFrame(rows, columns=["document_key", "page_number", "raw_text", "confidence", "error"])
            out["page_number"] = out["page_number"].astype("Int32")
            out["confidence"] = out["confidence"].astype("Float64")
            yield out.astype({"raw_text": object, "error": object}).where(out.notna(), None)

    return files.select(key, "content").mapInPandas(run, PAGES)


def mean_score(scores: Column, least: float = 0.0) -> Column:
    """Mean of the scores of at least ``least``; null without any."""
    kept = F.filter(scores, lambda s: s >= least)
    return F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda a, s: a + s) / F.size(kept))


def kept_text(lines: Column, least: float = 0.0) -> Column:
    """Text of recognised lines (text, score) whose score is at least ``least``."""
    return F.array_join(F.transform(F.filter(lines, lambda x: (x["score"] >= least) & (F.length(F.trim(x["text"])) > 0)), lambda x: x["text"]), "\n")


def recognise_pages(pages: DataFrame, engines: list[Callable[[bytes], list[tuple[str, float]]]], least: float = 0.0, key: str = "document_key") -> DataFrame:
    """Text of page images (key, page_number, image): later engines are asked only where earlier ones found nothing.

    A later engine's failure keeps what is there; at most ``PAGE_LIMIT`` pages of a file are asked, the
    others come out with error ``page-limit``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, n, image in zip(pdf[key], pdf["page_number"], pdf["image"]):
                text, score, error = "", None, None
                if not pd.isna(n) and n > PAGE_LIMIT:
                    rows.append((k, n, None, None, "page-limit"))
                    continue
                for i, engine in enumerate(engines):
                    try:
                        got = [(t, s) for t, s in engine(bytes(image or b"")) if t.strip() and s >= least]
                    except Exception as e:  # as above
                        error = error or (f"{type(e).__name__}: {e}"[:500] if i == 0 else None)
                        continue
                    if got:
                        text, score, error = "\n".join(t for t, _ in got), sum(s for _, s in got) / len(got), None
                        break
                rows.append((k, n, text, score, error))
            out = pd.DataFrame(rows, columns=["document_key", "page_number", "raw_text", "confidence", "error"])
            out["page_number"] = out["page_number"].astype("Int32")
            out["confidence"] = out["confidence"].astype("Float64")
            yield out.astype({"raw_text": object, "error": object}).where(out.notna(), None)

    return pages.select(key, "page_number", "image").mapInPandas(run, PAGES)


def merge_pages(text: DataFrame, recognised: DataFrame, keys: list[str]) -> DataFrame:
    """Text pages, those with poor text replaced by what was recognised for them; pages without any text are left out.

    Both have keys, page_number and raw_text; recognised pages replace only pages whose text is poor
    or missing.  Adds ``source`` (text or ocr).
    """
    k = [*keys, "page_number"]
    good = text.filter(~poor_text(F.col("raw_text")))
    cols = [*k, "raw_text"]
    better = recognised.filter("length(trim(raw_text)) > 0").join(good.select(*k), k, "left_anti")
    rest = text.filter(poor_text(F.col("raw_text")) & (F.length(F.trim("raw_text")) > 0)).join(better.select(*k), k, "left_anti")
    return good.unionByName(rest).select(*cols, F.lit("text").alias("source")).unionByName(better.select(*cols, F.lit("ocr").alias("source")))


def fallback(primary: Column, second: Column) -> Column:
    """The second text only where the first is empty; a missing second keeps the first."""
    return F.when(F.length(F.trim(F.coalesce(primary, F.lit("")))) > 0, primary).otherwise(F.coalesce(second, primary))


def transcribe(files: DataFrame, provider: Callable[[bytes], str] | None, second: Callable[[bytes], str] | None = None, key: str = "document_key") -> DataFrame:
    """(document_key, language, error, segments) of media files; the second model is asked where the first says nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, content in zip(pdf[key], pdf["content"]):
                said, error = None, None if provider else "no-provider"
                for model in (provider, second):
                    if model is not None and (said is None or '"text"' not in said):
                        try:
                            said = model(bytes(content or b""))
                        except Exception as e:  # as above
                            error = error or f"{type(e).__name__}: {e}"[:500]
                out.append((k, said, error))
            yield pd.DataFrame(out, columns=["document_key", "said", "failed"], dtype=object)

    x = files.select(key, "content").mapInPandas(run, "document_key string, said string, failed string").withColumn("t", transcript_segments(F.col("said")))
    return x.select("document_key", "t.language", F.coalesce("failed", "t.error").alias("error"), "t.segments")


def blob_path(sha256: Column) -> Column:
    """Where a blob lies: ``aa/bb/hash.blob``."""
    return F.concat_ws("/", F.substring(sha256, 1, 2), F.substring(sha256, 3, 2), F.concat(sha256, F.lit(".blob")))


def new_blobs(contents: DataFrame, stored: DataFrame, now: Column, content: str = "content") -> DataFrame:
    """(sha256, path, original_size, created_at, content) of the contents that aren't stored; each once."""
    c = contents.filter(F.col(content).isNotNull()).select(F.sha2(F.col(content), 256).alias("sha256"), F.col(content).alias("content"))
    one = c.groupBy("sha256").agg(F.min("content").alias("content"))
    return one.join(stored.select("sha256"), "sha256", "left_anti").select("sha256", blob_path(F.col("sha256")).alias("path"), F.octet_length("content").cast("long").alias("original_size"), now.alias("created_at"), "content")


def read_blobs(blobs: DataFrame) -> DataFrame:
    """Blobs with ``intact``: whether the content still has its hash."""
    return blobs.withColumn("intact", F.sha2("content", 256).eqNullSafe(F.col("sha256")))


def clean_pages(pages: DataFrame) -> DataFrame:
    """Pages with clean_text."""

    @F.pandas_udf("string")
    def clean(v: pd.Series) -> pd.Series:
        return v.map(normalise)

    return pages.withColumn("clean_text", clean(F.coalesce("raw_text", F.lit(""))))
