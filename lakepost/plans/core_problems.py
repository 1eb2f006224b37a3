"""Queries of the general data problems (timestamps, change feed)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakepost.functions.timestamps import normalise_timestamps
from lakepost.operators.changefeed import live_messages
from lakepost.session import ensure_checkpoint_dir, table
from lakepost.streaming import sync


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise_timestamps(table(spark, sf_dir, "mails"), ["received", "sent", "harvested_at"], "entry_id", table(spark, sf_dir, "store_zones"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live_messages(table(spark, sf_dir, "messages"), table(spark, sf_dir, "history_pages"), table(spark, sf_dir, "accounts"))


def p4_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value that denotes an instant, those in the standard form included."""
    return normalise_timestamps(table(spark, sf_dir, "mails"), ["received", "sent", "harvested_at"], "entry_id", table(spark, sf_dir, "store_zones"), only_odd=False)


def p7_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same state by the stream: the pages come in three batches, a page's batch by its own hash."""
    pages = table(spark, sf_dir, "history_pages")
    root = f"{ensure_checkpoint_dir(spark)}/lakepost-sync/{uuid.uuid4().hex}"
    apply = sync.apply_batch(spark, root, table(spark, sf_dir, "messages"), table(spark, sf_dir, "accounts"))
    batch = F.pmod(F.xxhash64("account_id", "page_token", "history_id", "fetched_at"), F.lit(3))
    for n in range(3):
        apply(pages.filter(batch == n), n)
    return sync.SyncState(spark, root).messages()


QUERIES = {"p4_found": p4_found, "p4_normalised": p4_normalised, "p7_found": p7_found, "p7_stream": p7_stream}
SQL: dict[str, str] = {
    "p7_found": """WITH RECURSIVE pages AS (SELECT DISTINCT account_id, start_history_id, nullif(page_token,'') AS tok, nullif(next_page_token,'') AS nxt, try_cast(trim(history_id) AS HUGEINT) AS hid, upsert_ids, deleted_ids FROM history_pages),
 chain AS (SELECT account_id, tok, nxt, hid, 0 AS place, upsert_ids, deleted_ids FROM pages WHERE tok IS NULL UNION ALL SELECT p.account_id, p.tok, p.nxt, coalesce(p.hid, c.hid), c.place + 1, p.upsert_ids, p.deleted_ids FROM chain c JOIN pages p ON p.account_id = c.account_id AND p.tok = c.nxt),
 changes AS (SELECT account_id, unnest(upsert_ids) AS id, hid, place, 0 AS del FROM chain UNION ALL SELECT account_id, unnest(deleted_ids), hid, place, 1 FROM chain),
 fresh AS (SELECT c.* FROM changes c LEFT JOIN accounts a ON a.id = c.account_id WHERE length(trim(c.id)) > 0 AND c.hid IS NOT NULL AND (try_cast(trim(a.last_history_id) AS HUGEINT) IS NULL OR c.hid > try_cast(trim(a.last_history_id) AS HUGEINT))),
 last AS (SELECT account_id, id, arg_max(del, (hid, place, del)) AS del FROM fresh GROUP BY 1, 2)
 SELECT coalesce(m.account_id, l.account_id) AS account_id, coalesce(m.gmail_message_id, l.id) AS gmail_message_id FROM (SELECT DISTINCT account_id, gmail_message_id FROM messages WHERE length(trim(gmail_message_id)) > 0) m FULL OUTER JOIN last l ON l.account_id = m.account_id AND l.id = m.gmail_message_id WHERE l.del IS NULL OR l.del = 0""",
}
SQL["p7_stream"] = SQL["p7_found"]
