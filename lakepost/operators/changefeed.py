"""Change feed: order listing pages, then replay inserts, updates and deletes per key.

``order_pages`` ranks the pages of token-linked listings by pointer doubling (joins on
tokens, logarithmic rounds; no listing or account is gathered in one task).
``replay_changes`` is the ordered replay: repartition by key, sort by sequence inside
partitions, and a vectorised state machine that applies partial-column updates and skips
sequences that it has already applied.  The state machine carries one key's state over
Arrow batches, so a hot key is streamed, never gathered.

Defined cases: a null or blank key is no change; a null value column leaves the stored
value; of several changes with one sequence a delete wins and the others are skipped as
already applied; an empty feed gives the distinct base rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakepost.session import cut

SEQ = T.DecimalType(38, 0)


def order_pages(pages: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Rank the pages of history listings.

    ``pages`` has account_id, start_history_id, page_token, next_page_token, history_id.
    Returns (account_id, page_key, seq decimal, place long): seq is the page's history id, or
    that of the nearest page before it that has one; place counts from 0 in its listing.
    A token chain that loops ends after ``max_rounds`` doublings with the place reached then.
    """
    hid = F.expr("try_cast(trim(history_id) AS decimal(38,0))")
    nodes = (
        pages.select("account_id", page_key().alias("page_key"), "page_token", F.nullif("next_page_token", F.lit("")).alias("next_token"), hid.alias("seq"))
        .groupBy("account_id", "page_key")
        .agg(F.max("page_token").alias("page_token"), F.max("next_token").alias("next_token"), F.max("seq").alias("seq"))
    )
    before = nodes.filter("next_token IS NOT NULL").groupBy("account_id", F.col("next_token").alias("page_token")).agg(F.min("page_key").alias("prev"))
    state = cut(
        nodes.join(before, ["account_id", "page_token"], "left").select(
            "account_id", "page_key", "prev", "seq", F.when(F.col("prev").isNotNull(), F.lit(1)).otherwise(F.lit(0)).cast("long").alias("place")
        )
    )
    for _ in range(max_rounds):
        if state.filter("prev IS NOT NULL").isEmpty():
            break
        up = state.select("account_id", F.col("page_key").alias("prev"), F.col("prev").alias("prev2"), F.col("seq").alias("seq2"), F.col("place").alias("place2"))
        state = cut(
            state.join(up, ["account_id", "prev"], "left").select(
                "account_id",
                "page_key",
                F.col("prev2").alias("prev"),
                F.coalesce("seq", "seq2").alias("seq"),
                (F.col("place") + F.coalesce("place2", F.lit(0))).alias("place"),
            )
        )
    return state.select("account_id", "page_key", "seq", "place")


def page_key() -> Column:
    """Key of a page in its account: its token, or for the first page what tells its listing."""
    c = lambda x: F.coalesce(F.col(x), F.lit(""))
    return F.when(F.length(c("page_token")) > 0, F.col("page_token")).otherwise(F.concat_ws("|", F.lit("^"), c("start_history_id"), c("next_page_token"), c("history_id")))


def page_changes(pages: DataFrame) -> DataFrame:
    """One row (account_id, gmail_message_id, op, seq, place) for each id that a page upserts or deletes."""
    content = pages.select("account_id", page_key().alias("page_key"), "upsert_ids", "deleted_ids").distinct()
    ids = F.explode(
        F.concat(
            F.transform(F.coalesce("upsert_ids", F.array().cast("array<string>")), lambda x: F.struct(x.alias("id"), F.lit("U").alias("op"))),
            F.transform(F.coalesce("deleted_ids", F.array().cast("array<string>")), lambda x: F.struct(x.alias("id"), F.lit("D").alias("op"))),
        )
    )
    return (
        content.join(order_pages(pages), ["account_id", "page_key"])
        .select("account_id", ids.alias("c"), "seq", "place")
        .select("account_id", F.col("c.id").alias("gmail_message_id"), F.col("c.op").alias("op"), "seq", "place")
        .filter(F.length(F.trim("gmail_message_id")) > 0)
    )


def set_algebra(added: DataFrame, labels_added: DataFrame | None, labels_removed: DataFrame | None, deleted: DataFrame) -> DataFrame:
    """(account_id, id): what a listing upserts: everything added or relabelled, without what it deletes."""
    out = added.select("account_id", "id")
    for more in (labels_added, labels_removed):
        if more is not None:
            out = out.unionByName(more.select("account_id", "id"))
    return out.filter("length(trim(id)) > 0").distinct().join(deleted.select("account_id", "id"), ["account_id", "id"], "left_anti")


def replay_changes(base: DataFrame, changes: DataFrame, keys: Sequence[str], seq: Sequence[str], values: Sequence[str] = (), op: str = "op") -> DataFrame:
    """Rows of ``base`` after ``changes`` (columns keys, seq, op 'U' or 'D', values; null = unchanged)."""
    keys, seq, values = list(keys), list(seq), list(values)
    spark_types = {f.name: f.dataType for f in base.schema}
    sid = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in seq])
    started = base.select(*keys, *values).distinct().select(*keys, *values, *[F.lit(None).cast(dict(changes.dtypes)[c]).alias(c) for c in seq], F.lit("U").alias("_op"), F.lit(None).cast("string").alias("_sid"))
    fed = changes.filter(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)).select(
        *keys, *[(F.col(v) if v in changes.columns else F.lit(None)).cast(spark_types[v]).alias(v) for v in values], *seq, F.col(op).alias("_op"), sid.alias("_sid")
    )
    # repeats shrink before the shuffle by key; equal sequences stay in delete-first order
    fed = fed.groupBy(*keys, *seq, "_op", "_sid").agg(*[F.max(v).alias(v) for v in values]).select(*keys, *values, *seq, "_op", "_sid") if values else fed.distinct().select(*keys, *seq, "_op", "_sid")
    ordered = started.unionByName(fed).repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, *[F.col(c).asc_nulls_first() for c in seq], "_op")
    out = T.StructType([T.StructField(c, spark_types[c]) for c in [*keys, *values]])
    return ordered.select(*keys, *values, "_op", "_sid").mapInPandas(lambda it: _replay(it, keys, values), out)


def _replay(batches: Iterator[pd.DataFrame], keys: list[str], values: list[str]) -> Iterator[pd.DataFrame]:
    carry: pd.DataFrame | None = None
    for pdf in batches:
        if not len(pdf):
            continue
        pdf = pdf.assign(_kept=False)
        if carry is not None:
            pdf = pd.concat([carry, pdf], ignore_index=True)
        done, carry = _fold(pdf, keys, values, final=False)
        if len(done):
            yield done
    if carry is not None:
        done, _ = _fold(carry, keys, values, final=True)
        yield done


def _fold(pdf: pd.DataFrame, keys: list[str], values: list[str], final: bool) -> tuple[pd.DataFrame, pd.DataFrame | None]:
    """Fold sorted changes to the state of each key; the last key's state is carried on unless final."""
    pdf = pdf.reset_index(drop=True)
    n = len(pdf)
    new_key = np.zeros(n, bool)
    new_key[0] = True
    for k in keys:
        v = pdf[k].to_numpy()
        new_key[1:] |= v[1:] != v[:-1]
    sid = pdf["_sid"].to_numpy(object)
    kept = pdf["_kept"].to_numpy(bool)
    repeat = np.zeros(n, bool)
    repeat[1:] = ~new_key[1:] & ~kept[1:] & (sid[1:] == sid[:-1]) & pd.notna(sid[1:])
    starts = np.flatnonzero(new_key)
    at = np.arange(n)
    delete = (pdf["_op"].to_numpy(object) == "D") & ~repeat
    write = ~delete & ~repeat
    group = np.cumsum(new_key) - 1
    last_delete = np.maximum.reduceat(np.where(delete, at, -1), starts)
    live_write = write & (at > last_delete[group])
    last_write = np.maximum.reduceat(np.where(live_write, at, -1), starts)
    alive = last_write >= 0
    state = pdf.loc[starts, keys].reset_index(drop=True)
    for v in values:
        col = pdf[v]
        last = np.maximum.reduceat(np.where(live_write & col.notna().to_numpy(), at, -1), starts)
        got = col.take(np.maximum(last, 0)).reset_index(drop=True)
        state[v] = got.where(last >= 0, None)
    if final:
        return state[alive], None
    tail = state.iloc[[-1]].assign(_op="U" if alive[-1] else "D", _sid=sid[-1], _kept=True)
    return state[:-1][alive[:-1]], tail[[*keys, *values, "_op", "_sid", "_kept"]]


def live_messages(messages: DataFrame, pages: DataFrame, accounts: DataFrame) -> DataFrame:
    """(account_id, gmail_message_id) alive after all pages beyond each account's last_history_id."""
    applied = accounts.groupBy(F.col("id").alias("account_id")).agg(F.max(F.expr("try_cast(trim(last_history_id) AS decimal(38,0))")).alias("applied"))
    changes = page_changes(pages).join(applied, "account_id", "left").filter("seq IS NOT NULL AND (applied IS NULL OR seq > applied)")
    base = messages.select("account_id", "gmail_message_id").filter("account_id IS NOT NULL AND length(trim(gmail_message_id)) > 0")
    return replay_changes(base, changes, ["account_id", "gmail_message_id"], ["seq", "place"])
