"""Queries of the text problems for the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakepost.llm.language import assign_languages, labelled_texts
from lakepost.llm.mixing import mix_sources, mixture_shares
from lakepost.llm.mojibake import damaged_values, repaired_values
from lakepost.llm.pii import personal_data, redact
from lakepost.llm.replies import new_text, old_text
from lakepost.llm.scans import scan_defects, scan_paragraphs
from lakepost.llm.sentences import sentence_texts, split_documents
from lakepost.llm.tokenize import encode_documents
from lakepost.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_defects(table(spark, sf_dir, "content_segments"), table(spark, sf_dir, "content_documents"))


def p1_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_paragraphs(table(spark, sf_dir, "content_segments"), table(spark, sf_dir, "content_documents"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return old_text(table(spark, sf_dir, "mails"), table(spark, sf_dir, "store_zones"))


def p2_new_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return new_text(table(spark, sf_dir, "mails"), table(spark, sf_dir, "store_zones"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return damaged_values(table(spark, sf_dir, "mails")).select("entry_id", "field")


def p3_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_values(table(spark, sf_dir, "mails"))


def p5_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = labelled_texts(table(spark, sf_dir, "lang_labels"), table(spark, sf_dir, "mails"), table(spark, sf_dir, "content_segments"))
    return assign_languages(items, table(spark, sf_dir, "documents")).distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = labelled_texts(table(spark, sf_dir, "lang_labels"), table(spark, sf_dir, "mails"), table(spark, sf_dir, "content_segments"), "inner").filter("length(text) > 0")
    return assign_languages(items, table(spark, sf_dir, "documents")).filter("wrong AND counts").select("item_kind", "item_key", "lang").distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "mails"), table(spark, sf_dir, "content_segments"))
    return found.select("item_kind", "item_key", "field", "pii_type", "start_pos").distinct()


def p6_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact(table(spark, sf_dir, "mails"), table(spark, sf_dir, "content_segments"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "mix_targets")
    return mixture_shares(mix_sources(table(spark, sf_dir, "documents"), targets), targets)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_documents(table(spark, sf_dir, "documents")).distinct()


def p10_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_texts(table(spark, sf_dir, "documents"))


QUERIES = {"p10_found": p10_found, "p10_sentences": p10_sentences, "p1_found": p1_found, "p1_paragraphs": p1_paragraphs, "p2_found": p2_found, "p2_new_text": p2_new_text, "p3_found": p3_found, "p3_repaired": p3_repaired, "p5_found": p5_found, "p5_languages": p5_languages, "p6_found": p6_found, "p6_redacted": p6_redacted, "p8_ids": p8_ids, "p9_mix": p9_mix, "p9_shares": p9_shares}
SQL: dict[str, str] = {}
