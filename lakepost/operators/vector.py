"""Vectors and hybrid retrieval: double-precision dot products, candidate cap, reciprocal rank fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K, LEXICAL_WEIGHT = 60, 1.25


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def normalise(v: Column) -> Column:
    """Unit vector in floats; null for a zero or non-finite norm."""
    norm = F.sqrt(dot(v, v))
    return F.when((norm > 0) & (norm < float("inf")), F.transform(v, lambda x: (x.cast("double") / norm).cast("float")))


def candidates(embeddings: DataFrame, recency: list[Column], cap: int) -> DataFrame:
    """The most recent ``cap`` vectors: the cap is a feature, it bounds what is scored."""
    return embeddings.orderBy(*recency).limit(cap)


def top_similar(embeddings: DataFrame, query: list[float], key: str, vector: str, limit: int, recency: list[Column] | None = None) -> DataFrame:
    q = F.array(*[F.lit(float(x)) for x in query])
    ok = embeddings.filter(F.size(vector) == len(query))
    return ok.select(key, dot(F.col(vector), q).alias("similarity"), *[c.alias(f"_r{i}") for i, c in enumerate(recency or [])]).orderBy(F.desc("similarity"), *[F.desc(f"_r{i}") for i in range(len(recency or []))], F.desc(key)).limit(limit).select(key, "similarity")


def fuse(semantic: DataFrame, lexical: DataFrame, key: str, limit: int) -> DataFrame:
    """Full outer join of two ranked lists, both already limited; (key, score, channels)."""
    s = semantic.withColumn("sr", F.row_number().over(Window.orderBy(F.desc("similarity"), F.desc(key)))).select(key, "sr")
    x = lexical.withColumn("lr", F.row_number().over(Window.orderBy("score", key))).select(key, "lr")
    j = s.join(x, key, "full_outer")
    score = F.coalesce(1.0 / (RRF_K + F.col("sr")), F.lit(0.0)) + F.coalesce(LEXICAL_WEIGHT / (RRF_K + F.col("lr")), F.lit(0.0))
    chan = F.when(F.col("sr").isNotNull() & F.col("lr").isNotNull(), "fts+semantic").when(F.col("sr").isNotNull(), "semantic").otherwise("fts")
    return j.select(key, score.alias("score"), chan.alias("channels")).orderBy(F.desc("score"), F.desc(key)).limit(limit)
