"""Mixing sources to target shares of size by pivotal dependent rounding.

A document of source s is wanted x_s = M * share_s / T_s times, T_s the tokens of the source
and M the size of the mixture: by default the largest at which no x_s exceeds the source's
max_repeats.  Each document gets floor(x_s) copies and the fraction as a probability.  Pairs of
fractional documents of a source move token mass from one to the other, at random and without
changing either's expectation, until one is integral; a partition so leaves at most one
fractional document of each source, and these residuals go through a reduction tree of
fan-in ``FAN`` until one is left, which is rounded by its probability.  So the size of each
source misses its target by less than one document.

Defined cases: documents of sources without a target, and those without tokens, are not in
the mixture; a target source without tokens is reported with share 0 and its share is spread
over the others in proportion; duplicates of a target row count once (the largest).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakepost.llm.tokenize import TOKENIZERS, VOCABULARY, count_column
from lakepost.session import cut

FAN = 64
_SCHEMA = "doc_id long, source string, n_tokens long, copies int, p double, pid int, key long"


def sized_documents(documents: DataFrame, targets: DataFrame, folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens) of the documents whose source has a target."""
    wanted = targets.select("source").filter("source IS NOT NULL").distinct()
    return documents.join(wanted, "source", "left_semi").select("doc_id", "source", count_column(F.col("text"), folder, name).cast("long").alias("n_tokens"))


def plan_copies(totals: dict[str, int], targets: dict[str, tuple[float, int]], size: float | None = None) -> dict[str, float]:
    """Wanted copies of each document of a source (a real number), from the tokens of each source."""
    live = {s: v for s, v in targets.items() if totals.get(s, 0) > 0 and v[0] > 0}
    whole = sum(v[0] for v in live.values())
    if not live:
        return {}
    most = min(totals[s] * reps / (share / whole) for s, (share, reps) in live.items())
    m = most if size is None else min(size, most)
    return {s: min(float(reps), m * share / whole / totals[s]) for s, (share, reps) in live.items()}


def _pivot(tokens: np.ndarray, prob: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Round ``prob`` in pairs keeping the sum of tokens * prob; the place of the one left fractional, or -1."""
    held = -1
    eps = 1e-9
    draws = rng.random(len(prob))
    for i in range(len(prob)):
        if prob[i] <= eps or prob[i] >= 1 - eps:
            prob[i] = round(prob[i])
            continue
        if held < 0:
            held = i
            continue
        a, b = tokens[held], tokens[i]
        up = min((1 - prob[held]) * a, prob[i] * b)  # mass that can go from i to held
        down = min(prob[held] * a, (1 - prob[i]) * b)  # and back
        move = up if draws[i] * (up + down) < down else -down
        prob[held] += move / a
        prob[i] -= move / b
        open_held, open_i = eps < prob[held] < 1 - eps, eps < prob[i] < 1 - eps
        for j, still in ((held, open_held), (i, open_i)):
            if not still:
                prob[j] = round(prob[j])
        held = held if open_held else (i if open_i else -1)
    return prob, held


def _round_part(pdf: pd.DataFrame, seed: int) -> pd.DataFrame:
    parts = []
    for _, g in pdf.groupby("source", sort=True):
        g = g.sort_values(["key", "doc_id"], kind="stable")
        rng = np.random.default_rng([seed & 0x7FFFFFFF, int(g["key"].iloc[0]) & 0x7FFFFFFFFFFFFFFF])
        prob, held = _pivot(g["n_tokens"].to_numpy(float), g["p"].to_numpy(float).copy(), rng)
        done = np.arange(len(g)) != held
        parts.append(g.assign(copies=(g["copies"] + np.where(done, prob, 0)).astype("int32"), p=np.where(done, 0.0, prob)))
    return pd.concat(parts, ignore_index=True)


def _round_stream(batches: Iterator[pd.DataFrame], seed: int) -> Iterator[pd.DataFrame]:
    """Round a partition batch by batch; a batch's residuals join the next one."""
    held: pd.DataFrame | None = None
    for pdf in batches:
        if held is not None and len(held):
            pdf = pd.concat([held, pdf], ignore_index=True)
        if not len(pdf):
            continue
        out = _round_part(pdf, seed)
        yield out[out["p"] == 0]
        held = out[out["p"] > 0]
    if held is not None and len(held):
        yield held


def _round_group(seed: int):
    columns = [c.split()[0] for c in _SCHEMA.split(", ")]
    return lambda pdf: _round_part(pdf[columns], seed)


def mix_sources(documents: DataFrame, targets: DataFrame, size: float | None = None, seed: int = 7, folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens, copies): documents of the mixture with their number of copies."""
    spark = documents.sparkSession
    sized = cut(sized_documents(documents, targets, folder, name).filter("n_tokens > 0"))
    goal = {r["source"]: (r["s"], r["m"]) for r in targets.filter("source IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("s"), F.max("max_repeats").alias("m")).collect()}
    totals = {r["source"]: r["t"] for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    want = plan_copies(totals, goal, size)
    if not want:
        return sized.limit(0).select("doc_id", "source", "n_tokens", F.lit(0).alias("copies"))
    x = F.coalesce(*[F.when(F.col("source") == s, F.lit(v)) for s, v in want.items()], F.lit(0.0))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    key = F.xxhash64("doc_id", F.lit(seed))
    start = (
        sized.withColumn("x", x)
        .select("doc_id", "source", "n_tokens", F.floor("x").cast("int").alias("copies"), (F.col("x") - F.floor("x")).alias("p"), F.pmod(key, F.lit(n)).cast("int").alias("pid"), key.alias("key"))
        .repartition(n, "pid")
        .sortWithinPartitions("pid", "key", "doc_id")
    )
    rounded = cut(start.mapInPandas(lambda it: _round_stream(it, seed), _SCHEMA))
    done, rest = rounded.filter("p = 0"), rounded.filter("p > 0")
    for level in range(max(1, math.ceil(math.log(n * 64, FAN)))):
        rest = rest.withColumn("pid", F.floor(F.col("pid") / FAN).cast("int"))
        rest = cut(rest.groupBy("source", "pid").applyInPandas(_round_group(seed + 1 + level), _SCHEMA))
        done, rest = done.unionByName(rest.filter("p = 0")), rest.filter("p > 0")
    last = rest.withColumn("copies", (F.col("copies") + (F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1_000_003)) / 1_000_003.0 < F.col("p")).cast("int")).cast("int"))
    return done.unionByName(last).filter("copies > 0").select("doc_id", "source", "n_tokens", "copies")


def mixture_shares(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, tokens, documents, most_copies): the shares really reached."""
    per = mixture.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_copies"))
    total = per.agg(F.sum("tokens").alias("total"))
    goal = targets.filter("source IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("target_share"))
    full = goal.join(per, "source", "left").join(F.broadcast(total))  # one row
    return full.select("source", "target_share", (F.coalesce("tokens", F.lit(0)) / F.col("total")).alias("actual_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"))
