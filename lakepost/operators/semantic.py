"""Semantic search over segments: providers, incremental indexing, capped scan, fusion with full text.

Embeddings are rows (segment_id, model, dimensions, vector).  A provider maps a list of texts to
vectors; it runs in the tasks, in batches.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakepost.functions.text import take_units
from lakepost.operators import fulltext, search, vector

LIMIT, DEPTH, CAP, MOST = 500, 4, 25_000, 250_000
MAX_CHARS, MAX_BATCH, MAX_DIMENSIONS = 12_000, 64, 16_384


@dataclass(frozen=True)
class Provider:
    """A model: its name and a function from texts to vectors of one length."""

    model: str
    embed: Callable[[list[str]], list[list[float]]]


def check_vectors(vectors: list[list[float]], n: int) -> list[list[float]]:
    """Vectors scaled to length 1; wrong numbers, lengths or values raise ValueError."""
    if len(vectors) != n:
        raise ValueError("incomplete batch of embeddings")
    size = {len(v) for v in vectors}
    if n and (len(size) != 1 or not 1 <= next(iter(size)) <= MAX_DIMENSIONS):
        raise ValueError("embeddings of different or impossible dimensions")
    out = []
    for v in vectors:
        norm = math.sqrt(sum(float(x) * float(x) for x in v))
        if not math.isfinite(norm) or norm == 0:
            raise ValueError("embedding without direction")
        out.append([float(x) / norm for x in v])
    return out


def pending(segments: DataFrame, embeddings: DataFrame, model: str, document: int | None = None) -> DataFrame:
    """(segment_id, clean_text) of the segments with text that the model hasn't embedded."""
    s = segments.select("segment_id", "document_id", "clean_text").filter("length(trim(clean_text)) > 0")
    s = s if document is None else s.filter(F.col("document_id") == document)
    s = s.groupBy("segment_id").agg(F.max("clean_text").alias("clean_text"))
    return s.join(embeddings.filter(F.col("model") == model).select("segment_id"), "segment_id", "left_anti")


def embed(rows: DataFrame, provider: Provider, batch: int = 16) -> DataFrame:
    """(segment_id, model, dimensions, vector) of (segment_id, clean_text); texts are cut to 12,000 UTF-16 units."""
    size = max(1, min(batch, MAX_BATCH))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), size):
                part = pdf.iloc[i : i + size]
                texts = [take_units(t, MAX_CHARS) for t in part["clean_text"]]
                v = check_vectors(provider.embed(texts), len(texts))
                yield pd.DataFrame({"segment_id": part["segment_id"].to_numpy(), "model": provider.model, "dimensions": [len(x) for x in v], "vector": v})

    return rows.select("segment_id", "clean_text").mapInPandas(run, "segment_id long, model string, dimensions int, vector array<float>")


def model_dimensions(embeddings: DataFrame, model: str) -> int | None:
    got = embeddings.filter(F.col("model") == model).select("dimensions").limit(1).collect()
    return got[0]["dimensions"] if got else None


def count_embeddings(embeddings: DataFrame, model: str, segments: DataFrame | None = None, document: int | None = None) -> DataFrame:
    """One row (n): the embeddings of a model, or of one document of it."""
    e = embeddings.filter(F.col("model") == model)
    if document is not None:
        e = e.join(segments.filter(F.col("document_id") == document).select("segment_id").distinct(), "segment_id", "left_semi")
    return e.agg(F.count(F.lit(1)).alias("n"))


def drop_model(embeddings: DataFrame, model: str, segments: DataFrame | None = None, document: int | None = None) -> DataFrame:
    """Embeddings without those of a model, or of one document of it."""
    if document is None:
        return embeddings.filter(~F.col("model").eqNullSafe(model))
    gone = segments.filter(F.col("document_id") == document).select("segment_id", F.lit(model).alias("model")).distinct()
    return embeddings.join(gone, ["segment_id", "model"], "left_anti").select(*embeddings.columns)


def index_embeddings(segments: DataFrame, embeddings: DataFrame, provider: Provider, batch: int = 16, document: int | None = None, rebuild: bool = False) -> DataFrame:
    """Embeddings after indexing what is pending; a model that changed its dimensions raises ValueError unless rebuilt."""
    base = drop_model(embeddings, provider.model, segments, document) if rebuild else embeddings
    new = embed(pending(segments, base, provider.model, document), provider, batch)
    known = model_dimensions(base, provider.model)
    if known is not None:
        new = new.withColumn("vector", F.when(F.col("dimensions") == known, F.col("vector")).otherwise(F.raise_error(F.lit(f"dimensions changed from {known}"))))
    return base.unionByName(new.select(*base.columns))


@dataclass(frozen=True)
class Result:
    """Hits and what the search says of the index."""

    hits: DataFrame
    indexed: int
    cap_reached: bool
    mismatch: bool
    indexed_dimensions: int | None
    query_dimensions: int


def search_semantic(embeddings: DataFrame, model: str, query: list[float], rows: DataFrame, limit: int = 25, max_candidates: int = CAP, hybrid: bool = False, index: fulltext.TextIndex | None = None, text: str = "") -> Result:
    """Most similar segments of the newest ``max_candidates`` ones, fused with full-text hits if ``hybrid``.

    ``rows`` are those of ``fulltext.segment_rows``.  Another dimension than the index has gives no
    semantic hits and is told; a text that can't be read gives no lexical ones.
    """
    limit = max(1, min(limit, LIMIT))
    cap = max(limit, min(max_candidates, MOST))
    check_vectors([query], 1)  # the provider has scaled it
    q = [float(x) for x in query]
    mine = embeddings.filter(F.col("model") == model)
    indexed = mine.count()
    dims = model_dimensions(embeddings, model)
    mismatch = dims is not None and dims != len(q)
    right = mine.filter((F.col("dimensions") == len(q)) & (F.size("vector") == len(q))).filter(~F.exists("vector", lambda x: x.isNull() | F.isnan(x)))
    if mismatch:
        right = right.limit(0)
    scanned = right.select("segment_id", "vector").join(rows.select("segment_id", "received"), "segment_id").orderBy(F.desc("received"), F.desc("segment_id")).limit(cap)
    sim = vector.dot(F.col("vector"), F.array(*[F.lit(x) for x in q]))
    by = [F.desc("similarity"), F.desc("received"), F.desc("segment_id")]
    top = scanned.select("segment_id", "received", sim.alias("similarity")).orderBy(*by).limit(limit * DEPTH)
    reached = not mismatch and indexed > cap
    shown = rows.select("segment_id", "received", "subject", F.col("sender_shown").alias("sender"), "filename", "mime_type", "page_number", F.substring("text", 1, 400).alias("snippet"))
    if not hybrid:
        hits = top.orderBy(*by).limit(limit).select("segment_id", "similarity")
        out = shown.join(F.broadcast(hits), "segment_id").withColumn("score", F.col("similarity")).withColumn("channels", F.lit("semantic")).orderBy(F.desc("score"), F.desc("received"), F.desc("segment_id"))
        return Result(out, indexed, reached, mismatch, dims, len(q))
    try:
        lexical = fulltext.search_segments(index, rows, text, min(limit * DEPTH, LIMIT))
    except search.QueryError:
        lexical = fulltext.search_segments(index, rows, "", 1)
    s = top.withColumn("sr", F.row_number().over(Window.orderBy(*by))).select("segment_id", "similarity", "sr")  # at most 2000 rows
    x = lexical.withColumn("lr", F.row_number().over(Window.orderBy("score", F.desc("received"), "segment_id"))).select("segment_id", F.col("snippet").alias("lexical"), "lr")  # at most 500 rows
    score = F.coalesce(1.0 / (vector.RRF_K + F.col("sr")), F.lit(0.0)) + F.coalesce(vector.LEXICAL_WEIGHT / (vector.RRF_K + F.col("lr")), F.lit(0.0))
    chan = F.when(F.col("sr").isNotNull() & F.col("lr").isNotNull(), "fts+semantic").when(F.col("sr").isNotNull(), "semantic").otherwise("fts")
    fused = s.join(x, "segment_id", "full_outer").withColumn("score", score).withColumn("channels", chan)
    order = [F.desc("score"), F.desc("received"), F.asc_nulls_last("sr"), F.asc_nulls_last("lr")]
    full = shown.join(F.broadcast(fused), "segment_id").orderBy(*order).limit(limit)
    # the payload of a full-text hit wins
    out = full.withColumn("snippet", F.coalesce("lexical", "snippet")).drop("lexical", "sr", "lr")
    return Result(out, indexed, reached, mismatch, dims, len(q))
