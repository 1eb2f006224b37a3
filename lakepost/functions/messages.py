"""Scalar functions that map messages of mail services to rows.

Built-in expressions where they exist; Arrow functions only for encoded words, charsets and HTML
entities.  Every function gives null or an empty string for values that can't be read, never an error,
unless its docstring says so.
"""

from __future__ import annotations

import base64
import binascii
import codecs
import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Services whose messages have an identity.
PROVIDERS = ("gmail", "imap", "outlook")
# Names of extractors by media type.
EXTRACTORS = {
    "application/pdf": "pdfpig",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "openxml-word",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "openxml-excel",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "openxml-powerpoint",
    "text/html": "html",
}
LOCATOR_VERSION = 1
TRANSCRIPT = "transcription array<struct<text: string, offsets: struct<`from`: long, `to`: long>>>, result struct<language: string>"


def byte_size(n: Column) -> Column:
    """Bytes as B, KiB, MiB, GiB or TiB with at most two decimals; negative sizes count as 0."""
    v = F.greatest(n, F.lit(0)).cast("double")
    unit = lambda power, name: F.concat(F.regexp_replace(F.format_string("%.2f", F.round(v / 1024.0**power, 2)), r"\.?0+$", ""), F.lit(" " + name))
    out = F.concat(v.cast("long").cast("string"), F.lit(" B"))
    return F.when(v >= 1024.0**4, unit(4, "TiB")).when(v >= 1024.0**3, unit(3, "GiB")).when(v >= 1024.0**2, unit(2, "MiB")).when(v >= 1024, unit(1, "KiB")).otherwise(out)


def source_identity(provider: Column, key: Column) -> Column:
    """``provider:sha256(key)``; null for other services and blank keys."""
    p = F.lower(F.trim(provider))
    return F.when(p.isin(*PROVIDERS) & (F.length(F.trim(key)) > 0), F.concat(p, F.lit(":"), F.sha2(key, 256)))


def base64url(value: Column) -> Column:
    """Bytes of Base64URL with or without padding; blank gives no bytes, what can't be read null."""
    t = F.translate(F.trim(F.coalesce(value, F.lit(""))), "-_", "+/")
    padded = F.rpad(t, (F.ceil(F.length(t) / 4) * 4).cast("int"), "=")
    return F.when(F.length(t) == 0, F.lit(b"")).otherwise(F.try_to_binary(padded, F.lit("base64")))


_ENCODED = re.compile(r"=\?([^?]+)\?([bBqQ])\?([^?]+)\?=")


def decode_header_value(value: str | None) -> str:
    """A header with its encoded words read; a word that can't be read stays as it is."""

    def word(m: re.Match) -> str:
        try:
            if m[2] in "bB":
                raw = base64.b64decode(m[3], validate=True)
            else:
                raw = re.sub(rb"=([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), m[3].replace("_", " ").encode("latin-1"))
            return raw.decode(m[1], errors="replace")
        except (LookupError, ValueError, binascii.Error):
            return m[0]

    return _ENCODED.sub(word, value or "").strip()


def decode_header(value: Column) -> Column:
    @F.pandas_udf("string")
    def decode(v: pd.Series) -> pd.Series:
        return v.map(decode_header_value)

    # only values with encoded words go to Python
    return F.when(value.contains("=?"), decode(value)).otherwise(F.trim(F.coalesce(value, F.lit(""))))


def join_headers(headers: Column, name: str) -> Column:
    """Values of all headers of a name, whatever its case, blank ones left out, joined by ``; ``; ``headers`` are (name, value) structs."""
    mine = F.filter(headers, lambda h: F.lower(h["name"]) == name.lower())
    values = F.filter(F.transform(mine, lambda h: F.trim(F.coalesce(h["value"], F.lit("")))), lambda v: F.length(v) > 0)
    return F.array_join(values, "; ")


_ANGLE = r"^\s*(.*?)\s*<\s*([^<>]+@[^<>]+)\s*>\s*$"
_BARE = r"[A-Za-z0-9.!#$%&'*+/=?^_`{|}~\-]+@[A-Za-z0-9.\-]+"


def split_sender(sender: Column) -> Column:
    """struct(name, email) of ``Name <address>``, of a bare address, or of text alone."""
    s = F.coalesce(sender, F.lit(""))
    bare = F.regexp_extract(s, _BARE, 0)
    angle = F.struct(F.trim(F.trim(F.regexp_extract(s, _ANGLE, 1)), F.lit('"')).alias("name"), F.trim(F.regexp_extract(s, _ANGLE, 2)).alias("email"))
    found = F.struct(F.when(s == bare, F.lit("")).otherwise(F.trim(F.replace(s, bare, F.lit("")))).alias("name"), bare.alias("email"))
    return F.when(s.rlike(_ANGLE), angle).when(bare != "", found).otherwise(F.struct(s.alias("name"), F.lit("").alias("email")))


def smtp_address(*candidates: Column) -> Column:
    """The first candidate that holds an at-sign, or an empty string."""
    return F.coalesce(*[F.when(c.contains("@"), c) for c in candidates], F.lit(""))


def charset_of(content_type: Column) -> Column:
    """Charset named by a Content-Type, without quotes, or utf-8."""
    found = F.regexp_extract(F.coalesce(content_type, F.lit("")), r"(?i)charset\s*=\s*([^;\s]+)", 1)
    return F.coalesce(F.nullif(F.regexp_replace(found, "^[\"']+|[\"']+$", ""), F.lit("")), F.lit("utf-8"))


def decode_part(data: Column, content_type: Column) -> Column:
    """struct(text, ok) of a Base64URL body part: unknown charsets are read as UTF-8, unreadable data has ok false."""

    @F.pandas_udf("string")
    def text(raw: pd.Series, names: pd.Series) -> pd.Series:
        out = []
        for b, n in zip(raw, names):
            if b is None:
                out.append(None)
                continue
            try:
                codecs.lookup(n)
            except (LookupError, ValueError):
                n = "utf-8"
            out.append(bytes(b).decode(n, errors="replace").strip())
        return pd.Series(out, dtype=object)

    read = base64url(data)
    return F.struct(text(read, charset_of(content_type)).alias("text"), read.isNotNull().alias("ok"))


def strip_html(source: Column) -> Column:
    """Text of simple HTML bodies: scripts and styles out, tags out, entities decoded, white space collapsed."""

    @F.pandas_udf("string")
    def entities(v: pd.Series) -> pd.Series:
        return v.map(html.unescape, na_action="ignore")

    bare = F.regexp_replace(F.regexp_replace(F.coalesce(source, F.lit("")), r"(?is)<(script|style)[^>]*>.*?</\1>", " "), "<[^>]+>", " ")
    return F.trim(F.regexp_replace(F.when(bare.contains("&"), entities(bare)).otherwise(bare), r"[\s\x85\p{Z}]+", " "))


def filename_or(name: Column, number: Column) -> Column:
    """The file name, or ``attachment-{number}``."""
    return F.coalesce(F.nullif(F.trim(name), F.lit("")), F.concat(F.lit("attachment-"), number.cast("string")))


def message_locator(account: Column, folder: Column, validity: Column, uid: Column) -> Column:
    """JSON locator of a message in a folder; the order of the keys is part of the identity that is hashed from it."""
    return F.to_json(F.struct(F.lit(LOCATOR_VERSION).alias("Version"), account.alias("AccountName"), folder.alias("FolderFullName"), validity.alias("UidValidity"), uid.alias("Uid")))


def read_message_locator(value: Column) -> Column:
    """struct of a locator, or null if its version is another or a field is missing."""
    x = F.from_json(value, "Version int, AccountName string, FolderFullName string, UidValidity long, Uid long")
    ok = (x["Version"] == LOCATOR_VERSION) & (F.length(F.trim(x["AccountName"])) > 0) & (F.length(F.trim(x["FolderFullName"])) > 0) & (x["UidValidity"] > 0) & (x["Uid"] > 0)
    return F.when(ok, F.struct(x["AccountName"].alias("account"), x["FolderFullName"].alias("folder"), x["UidValidity"].alias("validity"), x["Uid"].alias("uid")))


def transcript_segments(source: Column) -> Column:
    """struct(language, error, segments) of a transcript as JSON.

    Empty texts are left out; a missing list, a missing or wrong time range gives an error and no segments.
    """
    x = F.from_json(source, TRANSCRIPT)
    spoken = F.filter(x["transcription"], lambda s: F.length(F.trim(F.regexp_replace(F.coalesce(s["text"], F.lit("")), r"\s+", " "))) > 0)
    bad = F.exists(spoken, lambda s: s["offsets"]["from"].isNull() | s["offsets"]["to"].isNull() | (s["offsets"]["from"] < 0) | (s["offsets"]["to"] < s["offsets"]["from"]))
    error = F.when(x["transcription"].isNull(), "no-transcription").when(bad, "bad-offsets")
    parts = F.transform(spoken, lambda s, i: F.struct(i.alias("ordinal"), s["text"].alias("raw_text"), F.trim(F.regexp_replace(s["text"], r"[ \t]+", " ")).alias("clean_text"), s["offsets"]["from"].alias("start_ms"), s["offsets"]["to"].alias("end_ms")))
    return F.struct(x["result"]["language"].alias("language"), error.alias("error"), F.when(error.isNull(), parts).alias("segments"))


def label_flags(labels: Column) -> Column:
    """struct(unread, trash, spam) of label ids."""
    has = lambda x: F.coalesce(F.array_contains(labels, x), F.lit(False))
    return F.struct(has("UNREAD").alias("unread"), has("TRASH").alias("trash"), has("SPAM").alias("spam"))


def message_key(account: Column, message: Column) -> Column:
    return F.concat(F.lit("gmail:"), account.cast("string"), F.lit(":"), message)


def parse_message_key(key: Column) -> Column:
    """struct(account_id, message_id) of ``gmail:{account}:{message}``, or null for other keys."""
    ok = key.rlike(r"^gmail:\d+:.+$")
    return F.when(ok, F.struct(F.split_part(key, F.lit(":"), F.lit(2)).try_cast("long").alias("account_id"), F.regexp_replace(key, r"^gmail:\d+:", "").alias("message_id")))


def extractor_name(mime: Column) -> Column:
    out = F.lit("plain-text")
    for kind, name in reversed(EXTRACTORS.items()):
        out = F.when(mime == kind, name).otherwise(out)
    return out


def diagnostic(text: Column, limit: int = 500) -> Column:
    """An error text on one line, cut to its limit."""
    return F.left(F.trim(F.translate(text, "\r\n", "  ")), F.lit(limit))


def utc_text(ms: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` of epoch milliseconds, whatever the session's zone; an empty string beyond the years 1 to 9999."""
    ok = (ms >= -62135596800000) & (ms <= 253402300799999)
    s = F.floor(ms / 1000).cast("long")
    day, rest = F.floor(s / 86400).cast("int"), F.pmod(s, F.lit(86400))
    clock = F.format_string("%02d:%02d:%02d", F.floor(rest / 3600), F.floor(rest / 60) % 60, rest % 60)
    return F.when(ok, F.concat(F.date_format(F.date_from_unix_date(day), "yyyy-MM-dd"), F.lit(" "), clock)).otherwise("")


def join_bodies(bodies: Column) -> Column:
    """Non-blank bodies with an empty line between."""
    return F.trim(F.array_join(F.filter(bodies, lambda b: F.length(F.trim(b)) > 0), "\n\n"))
