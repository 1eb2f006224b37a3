"""Text functions: folding, tokens, HTML flattening, normalisation, charset detection, labels."""

from __future__ import annotations

import html
import re
import sqlite3
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}\p{Co}][\p{L}\p{N}\p{Co}\p{Mn}]*"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Fold A-Z only, as LIKE and NOCASE do."""
    return F.translate(c, _UPPER, _LOWER)


def unicode_trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\s\p{Z}\x85]+|[\s\p{Z}\x85]+$", "")


@lru_cache(maxsize=1)
def fold_pairs() -> tuple[str, str]:
    """Letters whose mark the full-text tokenizer takes off, and what is left, read from SQLite's own tokenizer."""
    db = sqlite3.connect(":memory:")
    try:
        db.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='unicode61 remove_diacritics 2')")
    except sqlite3.OperationalError:
        pairs = [(c, d[0]) for i in range(0xC0, 0x250) if len(d := unicodedata.normalize("NFD", c := chr(i))) == 2 and c == c.lower()]
        return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)
    points = [i for i in range(0x80, 0x10000) if not 0xD800 <= i < 0xE000 and unicodedata.category(chr(i))[0] in "LN" and chr(i) == chr(i).lower()]
    db.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", ((i, chr(i)) for i in points))
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab('t', 'instance')")
    got = [(chr(i), term) for term, i in db.execute("SELECT term, doc FROM v ORDER BY doc") if len(term) == 1 and term != chr(i)]
    return "".join(a for a, _ in got), "".join(b for _, b in got)


def tokens(c: Column) -> Column:
    """Tokens of the full-text index: runs of letters and numbers, lower case, marks taken off."""
    before, after = fold_pairs()
    raw = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(0))
    return F.transform(raw, lambda t: F.translate(F.regexp_replace(t, r"\p{Mn}", ""), before, after))


def fold_word(word: str) -> list[str]:
    """The driver-side twin of ``tokens`` for query text."""
    before, after = fold_pairs()
    table = str.maketrans(before, after)
    kept = [c if unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co" else c if unicodedata.category(c) == "Mn" else " " for c in word.lower()]
    return ["".join(c for c in t if unicodedata.category(c) != "Mn").translate(table) for t in "".join(kept).split() if not all(unicodedata.category(c) == "Mn" for c in t)]


_BLOCK_END = {"p", "div", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6"}
HTML_LIMIT = 2_000_000


def flatten_html(source: str | None, limit: int = HTML_LIMIT) -> str:
    """Text of an HTML string in one pass: comments and tags out, script and style dropped even if never
    closed, quoted > honoured, a stray < kept, entities decoded."""
    s = (source or "")[:limit]
    out: list[str] = []
    i, n = 0, len(s)
    low = s.lower()
    while i < n:
        j = s.find("<", i)
        if j < 0:
            out.append(s[i:])
            break
        out.append(s[i:j])
        if s.startswith("<!--", j):
            k = s.find("-->", j + 4)
            out.append(" ")
            i = n if k < 0 else k + 3
            continue
        nxt = s[j + 1 : j + 2]
        if not (nxt.isalpha() or nxt in "/!?" and nxt):
            out.append("<")
            i = j + 1
            continue
        k, quote = j + 1, ""
        while k < n:
            c = s[k]
            if quote:
                quote = "" if c == quote else quote
            elif c in "\"'":
                quote = c
            elif c == ">":
                break
            k += 1
        name = re.match(r"/?\s*([a-zA-Z][a-zA-Z0-9]*)?", s[j + 1 : j + 40])
        tag, closing = (name[1] or "").lower(), nxt == "/"
        i = min(n, k + 1)
        if tag in ("script", "style") and not closing:
            e = low.find(f"</{tag}", i)
            i = n if e < 0 else low.find(">", e) + 1 or n
            out.append(" ")
        elif tag == "br" or closing and tag in _BLOCK_END:
            out.append("\n")
        else:
            out.append(" ")
    text = html.unescape("".join(out)).replace("\r\n", "\n").replace("\r", "\n").replace(" ", " ")
    text = re.sub(r"[ \t\f\v]+", " ", text)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r" *\n *", "\n", text)).strip()


def normalise(text: str | None) -> str:
    """NFKC, one kind of line end, no NUL, trimmed lines, at most one blank line in a row."""
    t = unicodedata.normalize("NFKC", text or "").replace("\r\n", "\n").replace("\r", "\n").replace(" ", " ").replace("\0", "")
    return re.sub(r"\n{3,}", "\n\n", "\n".join(x.strip() for x in t.split("\n"))).strip()


def decode_bytes(data: bytes | None) -> str:
    """Text of bytes: byte order mark, UTF-16 by its zero bytes, strict UTF-8, else windows-1250."""
    b = bytes(data or b"")
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if b.startswith(mark):
            return b[len(mark) :].decode(name, errors="replace")
    if len(b) >= 4 and len(b) % 2 == 0:
        odd, even = b[1::2].count(0), b[0::2].count(0)
        if odd > 0.3 * len(b) / 2 and even == 0 or even > 0.3 * len(b) / 2 and odd == 0:
            return b.decode("utf-16-le" if odd else "utf-16-be", errors="replace")
    try:
        return b.decode("utf-8")
    except UnicodeDecodeError:
        return b.decode("cp1250", errors="replace")


def take_units(text: str, limit: int) -> str:
    """At most ``limit`` UTF-16 units, never half a pair."""
    raw = text.encode("utf-16-le")
    return text if len(raw) <= 2 * limit else raw[: 2 * limit].decode("utf-16-le", errors="ignore")


def html_to_text(c: Column) -> Column:
    @F.pandas_udf("string")
    def flat(v: pd.Series) -> pd.Series:
        return v.map(lambda x: normalise(flatten_html(x)))

    return flat(c)


def decode_column(c: Column) -> Column:
    @F.pandas_udf("string")
    def text(v: pd.Series) -> pd.Series:
        return v.map(decode_bytes)

    return text(c)


def clock_label(ms: Column) -> Column:
    """HH:MM:SS of milliseconds; negative ones are 0, hours may pass 99."""
    s = F.floor(F.greatest(ms, F.lit(0)) / 1000).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def place_label(page: Column, slide: Column, sheet: Column, start: Column, end: Column) -> Column:
    """Page, else slide, else sheet, else time range, else nothing."""
    return F.coalesce(
        F.concat(F.lit("page "), page.cast("string")), F.concat(F.lit("slide "), slide.cast("string")), F.concat(F.lit("sheet "), F.nullif(sheet, F.lit(""))),
        F.when(start.isNotNull(), F.concat(clock_label(start), F.lit("-"), clock_label(F.coalesce(end, start)))), F.lit(""),
    )
