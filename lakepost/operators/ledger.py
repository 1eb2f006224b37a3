"""Messages, labels, retries and errors of mail accounts as set-based merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakepost.operators.merge import last_of


def split_valid(batch: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good, bad): rows that pass all ``checks`` (code -> condition), and the others with the code of the first that fails."""
    code = F.lit(None).cast("string")
    for name, ok in reversed(checks.items()):
        code = F.when(F.coalesce(ok, F.lit(False)), code).otherwise(name)
    judged = batch.withColumn("error_code", code)
    return judged.filter("error_code IS NULL").drop("error_code"), judged.filter("error_code IS NOT NULL")


def upsert_labels(labels: DataFrame, listed: DataFrame, used: DataFrame) -> DataFrame:
    """labels (account_id, label_id, name, type): listed ones are refreshed, used but unknown ones appear as ``unknown``."""
    new = last_of(listed, ["account_id", "label_id"])
    known = labels.join(new, ["account_id", "label_id"], "left_anti").select(*labels.columns).unionByName(new.select(*labels.columns))
    missing = used.filter("label_id IS NOT NULL").select("account_id", "label_id").distinct().join(known, ["account_id", "label_id"], "left_anti")
    return known.unionByName(missing.select("account_id", "label_id", F.col("label_id").alias("name"), F.lit("unknown").alias("type")).select(*labels.columns))


def replace_labels(stored: DataFrame, messages: DataFrame) -> DataFrame:
    """(account_id, gmail_message_id, label_id): the labels of ``messages`` (with label_ids) replace the stored ones, each once."""
    touched = messages.select("account_id", "gmail_message_id").distinct()
    new = messages.select("account_id", "gmail_message_id", F.explode("label_ids").alias("label_id")).filter("label_id IS NOT NULL").distinct()
    return stored.join(touched, ["account_id", "gmail_message_id"], "left_anti").select(*new.columns).unionByName(new)


def upsert_messages(stored: DataFrame, batch: DataFrame, generation: int) -> DataFrame:
    """Stored messages after a batch: rows are overwritten by key and seen in this generation."""
    key = ["account_id", "gmail_message_id"]
    new = last_of(batch, key).withColumn("last_seen_generation", F.lit(generation).cast("long"))
    return stored.join(new, key, "left_anti").select(*stored.columns).unionByName(new.select(*[F.col(c) if c in new.columns else F.lit(None).cast(stored.schema[c].dataType).alias(c) for c in stored.columns]))


def mark_seen(stored: DataFrame, failed: DataFrame, generation: int) -> DataFrame:
    """Stored messages whose fetch failed count as seen, so that a prune leaves them."""
    f = failed.select("account_id", "gmail_message_id").distinct().withColumn("_f", F.lit(True))
    j = stored.join(f, ["account_id", "gmail_message_id"], "left")
    return j.select(*[F.when(F.col("_f"), F.lit(generation).cast("long")).otherwise(F.col(c)).alias(c) if c == "last_seen_generation" else F.col(c) for c in stored.columns])


def last_failures(failures: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, error_code, failed_at): the last failure of each message."""
    return last_of(failures.select(*keys, "failed_at", "error_code"), keys, ["failed_at", "error_code"])


def resolve_retries(ledger: DataFrame, saved: DataFrame, missing: DataFrame, keys: list[str]) -> DataFrame:
    """The ledger without messages that were saved or no longer exist."""
    return ledger.join(saved.select(*keys).union(missing.select(*keys)).distinct(), keys, "left_anti")


def retry_order(ledger: DataFrame, key: str = "gmail_message_id", limit: int = 1000) -> DataFrame:
    """The next retries, oldest failure first; at most 10,000 at a time."""
    return ledger.orderBy("last_failed_at", key).limit(max(1, min(limit, 10_000)))


def append_errors(errors: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    return errors.unionByName(new.withColumn("created_at", now), allowMissingColumns=True)


def counters(events: DataFrame, by: list[str]) -> DataFrame:
    """Sums of what a run did: (by, processed, inserted, updated, deleted, errors) of events (kind, n)."""
    total = lambda *kinds: F.coalesce(F.sum(F.when(F.col("kind").isin(*kinds), F.col("n"))), F.lit(0)).cast("long")
    return events.groupBy(*by).agg(total("inserted", "updated").alias("processed"), total("inserted").alias("inserted"), total("updated").alias("updated"), total("deleted").alias("deleted"), total("error").alias("errors"))


def account_status(accounts: DataFrame, messages: DataFrame, errors: DataFrame, retries: DataFrame) -> DataFrame:
    """(id, email, messages, errors, retries) of each account, by email whatever its case."""
    n = lambda df, name: df.groupBy(F.col("account_id").alias("id")).agg(F.count(F.lit(1)).alias(name))
    out = accounts.select("id", "email")
    for df, name in ((messages.select("account_id", "gmail_message_id").distinct(), "messages"), (errors, "errors"), (retries, "retries")):
        out = out.join(n(df, name), "id", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("messages", "errors", "retries")]
    return out.select("id", "email", *zero).orderBy(F.lower("email"), "id")


def find_accounts(accounts: DataFrame, selector: str) -> DataFrame:
    """Accounts whose email, whatever the case of its ASCII letters, or whose id is the selector."""
    from lakepost.functions.text import ascii_lower

    s = selector.strip()
    return accounts.filter((ascii_lower(F.col("email")) == ascii_lower(F.lit(s))) | (F.col("id").cast("string") == s))
