"""Incremental sync as a stream: pages of changes are merged batch by batch into stored state.

The state is kept beside the snapshot: for each key the place (sequence, page) of the last change
that was applied and whether the key lives, and the pages whose place in their listing isn't
known yet.  A change counts only beyond what its key has seen, so late, repeated and overlapping
pages, and any split of the pages into batches, lead to the same messages as one replay of all.

State is spread over ``PARTS`` folders by the hash of the key; a batch rewrites only the parts that
it touches.  A version is visible when its last file is written: a lost executor or driver
leaves the last whole version, and a batch that is run again after a restart changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakepost.operators.changefeed import page_changes
from lakepost.session import cut, path_exists

PARTS = 64
KEY = ["account_id", "gmail_message_id"]


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class SyncState:
    """Stored state of a sync below ``root``."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def version(self) -> int:
        """Number of the newest complete version; -1 if there is none."""
        n = -1
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/done")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(path):
            n = max([int(s.getPath().getName()) for s in fs.listStatus(path) if s.getPath().getName().isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))], default=-1)
        return n

    def manifest(self, version: int) -> dict[int, int]:
        """Which version each part was last written in."""
        return {r["part"]: r["version"] for r in self.spark.read.parquet(f"{self.root}/done/{version}").collect()} if version >= 0 else {}

    def keys(self, version: int | None = None, parts: list[int] | None = None) -> DataFrame:
        """(account_id, gmail_message_id, seq, place, alive, part) of all keys that were ever seen."""
        v = self.version() if version is None else version
        wanted = {p: at for p, at in self.manifest(v).items() if parts is None or p in parts}
        schema = "account_id long, gmail_message_id string, seq decimal(38,0), place long, alive boolean, part int"
        if not wanted:
            return self.spark.createDataFrame([], schema)
        out = None
        for at in sorted(set(wanted.values())):
            mine = [p for p, v in wanted.items() if v == at]
            df = self.spark.read.parquet(f"{self.root}/keys/v{at}").filter(F.col("part").isin(mine))
            out = df if out is None else out.unionByName(df)
        return out

    def pages(self) -> DataFrame | None:
        """The pages seen so far whose listing may still be incomplete."""
        v = self.version()
        return self.spark.read.parquet(f"{self.root}/pages/v{v}") if v >= 0 else None

    def messages(self) -> DataFrame:
        """(account_id, gmail_message_id) of the living messages."""
        return self.keys().filter("alive").select(*KEY)


def _spread(df: DataFrame) -> DataFrame:
    return df.withColumn("part", F.pmod(F.xxhash64(*KEY), F.lit(PARTS)).cast("int"))


def initial_keys(messages: DataFrame, accounts: DataFrame) -> DataFrame:
    """The state that messages and cursors of accounts stand for: nothing up to a cursor counts again."""
    base = messages.select(*KEY).filter("account_id IS NOT NULL AND length(trim(gmail_message_id)) > 0").distinct()
    return _spread(base.select(*KEY, F.lit(None).cast("decimal(38,0)").alias("seq"), F.lit(None).cast("long").alias("place"), F.lit(True).alias("alive")))


def merge_keys(keys: DataFrame, changes: DataFrame) -> DataFrame:
    """Keys after changes (keys, op, seq, place): the last change by (seq, place) decides, deletes win a tie."""
    last = changes.groupBy(*KEY).agg(F.max(F.struct("seq", "place", (F.col("op") == "D").alias("gone"))).alias("c"))
    j = _spread(keys.drop("part").join(last, KEY, "full_outer"))
    newer = F.col("c").isNotNull() & (F.col("seq").isNull() | (F.struct("c.seq", "c.place") > F.struct("seq", "place")) | ((F.col("c.seq") == F.col("seq")) & (F.col("c.place") == F.col("place")) & F.col("c.gone")))
    pick = lambda new, old: F.when(newer, new).otherwise(F.col(old))
    return j.select(*KEY, pick(F.col("c.seq"), "seq").alias("seq"), pick(F.col("c.place"), "place").alias("place"), F.coalesce(pick(~F.col("c.gone"), "alive"), F.lit(False)).alias("alive"), "part")


def apply_batch(spark: SparkSession, root: str, base: DataFrame, accounts: DataFrame):
    """foreachBatch function: one batch of history pages onto the stored state (``base`` messages before the first)."""
    state = SyncState(spark, root)
    applied = accounts.groupBy(F.col("id").alias("account_id")).agg(F.max(F.expr("try_cast(trim(last_history_id) AS decimal(38,0))")).alias("applied"))
    columns = ["account_id", "start_history_id", "page_token", "upsert_ids", "deleted_ids", "history_id", "next_page_token"]

    def apply(batch: DataFrame, batch_id: int) -> None:
        done = state.version()
        if done >= batch_id + 1:
            return  # applied before a restart
        if done < 0:
            initial_keys(base, accounts).repartition(PARTS, "part").write.mode("overwrite").partitionBy("part").parquet(f"{root}/keys/v0")
            batch.select(*columns).limit(0).write.mode("overwrite").parquet(f"{root}/pages/v0")
            spark.createDataFrame([(p, 0) for p in range(PARTS)], "part int, version int").coalesce(1).write.mode("overwrite").parquet(f"{root}/done/0")
            done = 0
        v = batch_id + 1
        # a page's place may only be told by pages of other batches: listings are ordered with all their pages
        new = batch.select(*columns).distinct()
        touched = new.select("account_id").distinct()
        known = state.pages()
        listing = cut(known.join(touched, "account_id", "left_semi").unionByName(new).distinct())
        changes = page_changes(listing).join(applied, "account_id", "left").filter("seq IS NOT NULL AND (applied IS NULL OR seq > applied)")
        changes = cut(_spread(changes.select(*KEY, "op", "seq", "place").distinct()))
        parts = sorted(r["part"] for r in changes.select("part").distinct().collect())  # at most PARTS rows
        manifest = state.manifest(done)
        if parts:
            merged = merge_keys(state.keys(done, parts), changes.drop("part"))
            merged.repartition(len(parts), "part").write.mode("overwrite").partitionBy("part").parquet(f"{root}/keys/v{v}")
        known.join(touched, "account_id", "left_anti").unionByName(listing).write.mode("overwrite").parquet(f"{root}/pages/v{v}")
        rows = [(p, v if p in parts else at) for p, at in manifest.items()]
        spark.createDataFrame(rows, "part int, version int").coalesce(1).write.mode("overwrite").parquet(f"{root}/done/{v}")
        # older page lists and parts that no manifest names any more are removed
        _delete(spark, f"{root}/pages/v{done}")
        for at in set(manifest.values()) - {at for _, at in rows}:
            _delete(spark, f"{root}/keys/v{at}")

    return apply


def sync_stream(spark: SparkSession, pages_dir: str, schema, root: str, base: DataFrame, accounts: DataFrame, checkpoint: str, files: int = 64):
    """Run all available pages through ``apply_batch``; returns the finished query."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(pages_dir)
    q = stream.writeStream.foreachBatch(apply_batch(spark, root, base, accounts)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


# A full sync by listing pages


def full_sync(stored: DataFrame, listing: DataFrame, fetched: DataFrame, generation: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(messages, ledger rows, missing) after all pages of a listing.

    ``listing`` has (account_id, gmail_message_id) of every page, ``fetched`` (account_id,
    gmail_message_id, outcome saved | missing | failed, error_code, is_unread).  Saved messages are
    written in this generation, failed ones that are stored count as seen, missing ones go, and
    whatever this generation didn't see is pruned.
    """
    listed = listing.select(*KEY).filter("length(trim(gmail_message_id)) > 0").distinct()
    f = fetched.join(listed, KEY, "left_semi")
    saved = f.filter("outcome = 'saved'").groupBy(*KEY).agg(F.max("is_unread").alias("is_unread"))
    failed, missing = f.filter("outcome = 'failed'").select(*KEY, "error_code").distinct(), f.filter("outcome = 'missing'").select(*KEY).distinct()
    kept = stored.join(failed.select(*KEY).distinct(), KEY, "left_semi").join(saved, KEY, "left_anti").select(*KEY, "is_unread")
    out = saved.select(*KEY, "is_unread").unionByName(kept).withColumn("last_seen_generation", F.lit(generation).cast("long"))
    return out, failed, missing


def read_listing(fetch, token: str | None = None, restarts: int = 1) -> list[tuple[str | None, list[str]]]:
    """Pages (token, ids) of a listing by ``fetch(token) -> (ids, next token)``; an expired token starts it again from the first page.

    ``fetch`` raises KeyError for an expired token.  The pages of the interrupted pass are dropped:
    they are all listed again.
    """
    pages: list[tuple[str | None, list[str]]] = []
    while True:
        try:
            ids, nxt = fetch(token)
        except KeyError:
            if token is None or restarts <= 0:
                raise
            restarts -= 1
            pages, token = [], None
            continue
        pages.append((token, list(ids)))
        if not nxt:
            return pages
        token = nxt


def plan_sync(accounts: DataFrame, oldest: DataFrame) -> DataFrame:
    """(id, mode, generation): incremental, or full for accounts without cursor, unfinished or with an expired cursor; full ones begin a new generation.

    ``oldest`` (id, oldest_history_id) tells how far back the service still lists changes.
    """
    a = accounts.join(oldest, "id", "left")
    num = lambda c: F.expr(f"try_cast(trim({c}) AS decimal(38,0))")
    expired = num("last_history_id") < num("oldest_history_id")
    full = num("last_history_id").isNull() | ~F.coalesce("initial_sync_completed", F.lit(False)) | F.coalesce(expired, F.lit(False))
    return a.select("id", F.when(full, "full").otherwise("incremental").alias("mode"), (F.coalesce("sync_generation", F.lit(0)) + F.when(full, 1).otherwise(0)).cast("long").alias("generation"))
