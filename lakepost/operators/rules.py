"""Noise rules and volume statistics: rules are literal arrays, every mail is judged without a shuffle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakepost.operators.search import sender_display


@dataclass(frozen=True)
class NoiseRules:
    senders: tuple[str, ...] = ()
    contains: tuple[str, ...] = ()
    folders: tuple[str, ...] = ()

    def hits(self, folder: str = "folder_leaf", email: str = "sender_email", name: str = "sender_name") -> Column:
        """Labels of the rules that a mail hits; a repeated rule hits as often as it is listed."""
        low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
        both = F.concat_ws(" ", low(email), low(name))
        tests = [(f"folder:{r}", F.trim(low(folder)) == r.strip().lower()) for r in self.folders if r.strip()]
        tests += [(f"sender:{r}", low(email) == r.strip().lower()) for r in self.senders if r.strip()]
        tests += [(f"contains:{r}", both.contains(r.strip().lower())) for r in self.contains if r.strip()]
        return F.array_compact(F.array(*[F.when(t, F.lit(label)) for label, t in tests])) if tests else F.array().cast("array<string>")


def contribution(mails: DataFrame, rules: NoiseRules) -> DataFrame:
    """(rule, gross, unique_hits) of the rules with a hit."""
    h = mails.select(rules.hits().alias("h"))
    return h.select(F.size("h").alias("n"), F.explode("h").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("gross"), F.count_if(F.col("n") == 1).alias("unique_hits"))


def overlap(mails: DataFrame, rules: NoiseRules) -> DataFrame:
    n = mails.select(F.size(rules.hits()).alias("n"))
    return n.agg(F.count(F.lit(1)).alias("scanned"), F.count_if(F.col("n") > 0).alias("hit"), F.count_if(F.col("n") > 1).alias("overlapping"))


def reclassify(mails: DataFrame, rules: NoiseRules) -> DataFrame:
    """entry_id, kind and the kind by the rules."""
    return mails.select("entry_id", "kind", F.when(F.size(rules.hits()) > 0, F.lit("alert")).otherwise(F.lit("mail")).alias("kind_new"))


def volume(mails: DataFrame, by: Column, name: str, top: int | None = None) -> DataFrame:
    out = mails.groupBy(by.alias(name)).agg(F.count(F.lit(1)).alias("n"))
    return out.orderBy(F.desc("n"), F.asc_nulls_first(name)).limit(top) if top else out


def top_senders(mails: DataFrame, rules: NoiseRules, top: int = 20) -> DataFrame:
    """(sender_email, name, n, pct, tag) by count."""
    g = mails.groupBy("sender_email").agg(F.count(F.lit(1)).alias("n"), F.max(sender_display()).alias("name"))
    total = mails.agg(F.count(F.lit(1)).alias("total"))
    pct = F.when(F.col("total") > 0, 100.0 * F.col("n") / F.col("total")).otherwise(0.0)
    g = g.orderBy(F.desc("n"), F.asc_nulls_first("sender_email")).limit(top).join(F.broadcast(total))  # one row
    noisy = F.size(NoiseRules(rules.senders, rules.contains, ()).hits(email="sender_email", name="name")) > 0
    return g.select("sender_email", "name", "n", F.round(pct, 6).alias("pct"), F.when(noisy, "noise").when(pct >= 3, "candidate").otherwise("").alias("tag"))
