"""Mail filters, the inverted index, phrase algebra and BM25, all as DataFrames.

Postings are (doc_id, col, pos, term).  A query is parsed on the driver to a tree of phrases;
each phrase finds its hits by pushed-down terms and joins on neighbouring positions, and the
tree becomes unions, semi and anti joins of document sets.  Scores need only the hits, the
lengths and one row of totals; payload columns are joined after the limit.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakepost.functions.text import ascii_lower, fold_word, tokens

K1, B = 1.2, 0.75


class QueryError(ValueError):
    """A query or date that can't be read."""


def date_bound(text: str | None, upper: bool = False) -> str | None:
    """A bound in the canonical form; an upper date without time becomes the next midnight."""
    t = (text or "").strip()
    if not t:
        return None
    for width, form in ((10, "%Y-%m-%d"), (16, "%Y-%m-%d %H:%M"), (19, "%Y-%m-%d %H:%M:%S")):
        if len(t) == width:
            try:
                d = datetime.strptime(t, form)
            except ValueError:
                break
            return (d + timedelta(days=1) if upper and width == 10 else d).strftime("%Y-%m-%d %H:%M:%S")
    raise QueryError(f"not a date: {t}")


def sender_display(name: str = "sender_name", email: str = "sender_email") -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), F.col(email))


def noise_filter(mode: str) -> Column:
    return {"alerts": F.col("kind") == "alert", "all": F.lit(True)}.get(mode, F.col("kind").isNull() | (F.col("kind") != "alert"))


def search_mails(mails: DataFrame, date_from: str | None = None, date_to: str | None = None, sender: str | None = None, folder: str | None = None, noise: str = "mail", limit: int = 25, hits: DataFrame | None = None, attachments: bool = False) -> DataFrame:
    """Mail search: newest first, or best first by the scores of ``hits`` (doc_id, score); only the active filters are in the plan.

    Only keys and what is filtered on go through the join and the order; bodies are read for the
    rows that are left.  A limit below 0 is none.
    """
    parts: list[Column] = []
    if lo := date_bound(date_from):
        parts.append(F.col("received") >= lo)
    if hi := date_bound(date_to, True):
        parts.append(F.col("received") < hi)
    if sender:
        s = ascii_lower(F.lit(sender))
        parts.append(ascii_lower(F.col("sender_name")).contains(s) | ascii_lower(F.col("sender_email")).contains(s))
    if folder:
        parts.append(ascii_lower(F.col("folder_leaf")).startswith(ascii_lower(F.lit(folder))))
    if attachments:
        parts.append(F.col("has_attachments"))
    if noise != "all":
        parts.append(noise_filter(noise))
    found = mails.filter(reduce(lambda a, b: a & b, parts)) if parts else mails
    # repeated rows of a mail count once: the greatest by what is shown
    shown = F.struct("received", "subject", "sender_name", "sender_email", "folder_leaf")
    found = found.groupBy("entry_id").agg(F.max(shown).alias("m")).select("entry_id", "m.*")
    if hits is not None:
        found = found.join(hits.select(F.col("doc_id").alias("entry_id"), F.round("score", 6).alias("score")), "entry_id")
    order = [F.asc("score"), F.asc("entry_id")] if hits is not None else [F.desc("received"), F.asc("entry_id")]
    found = found.orderBy(*order)
    if limit >= 0:
        found = found.limit(limit)
    bodies = mails.select("entry_id", F.substring(F.translate("body", "\r\n", "  "), 1, 160).alias("snippet"))
    bodies = bodies.join(F.broadcast(found.select("entry_id")) if 0 <= limit <= 10_000 else found.select("entry_id"), "entry_id", "left_semi").groupBy("entry_id").agg(F.max("snippet").alias("snippet"))
    out = found.join(bodies, "entry_id", "left").orderBy(*order)
    return out.select(
        "entry_id", "received", F.when(F.lower("folder_leaf").startswith("sent"), F.lit("->")).otherwise(F.lit("<-")).alias("direction"),
        sender_display().alias("sender"), "subject", F.trim("snippet").alias("snippet"), *(["score"] if hits is not None else []),
    )


@dataclass
class Phrase:
    """Terms in a row; the last may be a prefix; columns None = any."""

    terms: list[str]
    prefix: bool = False
    first: bool = False
    columns: tuple[str, ...] | None = None
    exclude: bool = False


@dataclass
class Node:
    """op: phrase, and, or, not, near."""

    op: str
    kids: list = field(default_factory=list)
    distance: int = 10


def sanitised(query: str) -> Node:
    """Each word a phrase of its tokens, all of them wanted; operators are plain text."""
    phrases = [Phrase(t) for w in query.split() if (t := fold_word(w))]
    return Node("and", phrases)


_LEX = re.compile(r'\s*(?:"((?:[^"]|"")*)"|([(){}:+*^,]|-(?=[\w{]))|([^\s"(){}:+*^,]+))')


class RawParser:
    """Grammar of raw full-text queries: AND OR NOT, NEAR, prefixes, ^, column filters, +, brackets."""

    def __init__(self, text: str) -> None:
        self.toks: list[tuple[str, str]] = []
        at = 0
        text = text.rstrip()
        while at < len(text):
            m = _LEX.match(text, at)
            if m is None:
                raise QueryError("syntax error")
            self.toks.append(("str", m[1].replace('""', '"')) if m[1] is not None else ("op", m[2]) if m[2] else ("word", m[3]))
            at = m.end()
        self.i = 0

    def peek(self) -> tuple[str, str]:
        return self.toks[self.i] if self.i < len(self.toks) else ("end", "")

    def take(self, value: str | None = None) -> tuple[str, str]:
        t = self.peek()
        if value is not None and t[1] != value or t[0] == "end":
            raise QueryError("syntax error")
        self.i += 1
        return t

    def parse(self) -> Node:
        if not self.toks:
            raise QueryError("empty query")
        n = self.either()
        if self.peek()[0] != "end":
            raise QueryError("syntax error")
        return n

    def _binary(self, word: str, inner, op: str) -> Node:
        kids = [inner()]
        while self.peek() == ("word", word):
            self.take()
            kids.append(inner())
        return kids[0] if len(kids) == 1 else Node(op, kids)

    def either(self):
        return self._binary("OR", self.both, "or")

    def both(self):
        return self._binary("AND", self.without, "and")

    def without(self):
        kids = [self.implicit()]
        while self.peek() == ("word", "NOT"):
            self.take()
            kids.append(self.implicit())
        return kids[0] if len(kids) == 1 else Node("not", kids)

    def implicit(self):
        kids = [self.primary()]
        while self.peek()[0] in ("str", "word") and self.peek()[1] not in ("AND", "OR", "NOT") or self.peek() in (("op", "("), ("op", "^"), ("op", "{"), ("op", "-")):
            kids.append(self.primary())
        return kids[0] if len(kids) == 1 else Node("and", kids)

    def primary(self):
        kind, value = self.peek()
        if (kind, value) == ("op", "("):
            self.take()
            n = self.either()
            self.take(")")
            return n
        columns, exclude = None, False
        if (kind, value) == ("op", "-"):
            self.take()
            exclude = True
            kind, value = self.peek()
        if (kind, value) == ("op", "{"):
            self.take()
            names = []
            while self.peek() != ("op", "}"):
                names.append(self.take()[1])
            self.take("}")
            self.take(":")
            columns = tuple(names)
        elif kind in ("word", "str") and self.toks[self.i + 1 : self.i + 2] == [("op", ":")]:
            self.take()
            self.take(":")
            columns = (value,)
        if exclude and columns is None:
            raise QueryError("syntax error")
        if columns is not None and self.peek() == ("op", "("):
            self.take()
            n = self.either()
            self.take(")")
            return self._restrict(n, columns, exclude)
        if self.peek() == ("word", "NEAR") and self.toks[self.i + 1 : self.i + 2] == [("op", "(")]:
            self.take()
            self.take("(")
            kids = []
            while self.peek() not in (("op", ")"), ("op", ",")):
                kids.append(self.phrase())
            far = 10
            if self.peek() == ("op", ","):
                self.take()
                far = int(self.take()[1])
            self.take(")")
            return self._restrict(Node("near", kids, far), columns, exclude)
        p = self.phrase()
        p.columns, p.exclude = columns, exclude
        return p

    def _restrict(self, n, columns, exclude):
        if isinstance(n, Phrase):
            n.columns, n.exclude = columns, exclude
        else:
            for k in n.kids:
                self._restrict(k, columns, exclude)
        return n

    def phrase(self) -> Phrase:
        first = False
        if self.peek() == ("op", "^"):
            self.take()
            first = True
        kind, value = self.take()
        if kind not in ("str", "word") or kind == "word" and value in ("AND", "OR", "NOT"):
            raise QueryError("syntax error")
        terms = fold_word(value)
        while self.peek() == ("op", "+"):
            self.take()
            terms += fold_word(self.take()[1])
        prefix = False
        if self.peek() == ("op", "*"):
            self.take()
            prefix = True
        return Phrase(terms, prefix, first)


def build_postings(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(doc_id, col, pos, term), positions from 0 in each column."""
    cols = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), tokens(F.col(c)).alias("t")) for c in columns]))
    return df.select(F.col(key).alias("doc_id"), cols.alias("c")).select("doc_id", "c.col", F.posexplode("c.t").alias("pos", "term"))


BUCKETS, LEAD = 64, 3


def bucket_of(term: Column) -> Column:
    """Bucket of a term by its first letters, so that a prefix of as many letters lies in one bucket."""
    return F.pmod(F.crc32(F.left(term, F.lit(LEAD)).cast("binary")), F.lit(BUCKETS)).cast("int")


def in_bucket(term: str, prefix: bool = False) -> Column:
    if prefix and len(term) < LEAD:
        return F.lit(True)
    return F.col("bucket") == zlib.crc32(term[:LEAD].encode()) % BUCKETS


def phrase_hits(postings: DataFrame, p: Phrase) -> DataFrame:
    """(doc_id, col, pos): starts of a phrase."""
    src = postings
    if p.columns is not None:
        inside = F.col("col").isin(*p.columns)
        src = src.filter(~inside if p.exclude else inside)
    if not p.terms:
        return src.select("doc_id", "col", "pos").limit(0)
    want = lambda k: F.col("term").startswith(p.terms[k]) if p.prefix and k == len(p.terms) - 1 else F.col("term") == p.terms[k]
    if "bucket" in postings.columns:
        plain = want
        want = lambda k: plain(k) & in_bucket(p.terms[k], p.prefix and k == len(p.terms) - 1)
    hits = src.filter(want(0)).select("doc_id", "col", "pos")
    if p.first:
        hits = hits.filter("pos = 0")
    for k in range(1, len(p.terms)):
        nxt = src.filter(want(k)).select("doc_id", "col", (F.col("pos") - k).alias("pos")).distinct()
        hits = hits.join(nxt, ["doc_id", "col", "pos"], "left_semi")
    return hits


def matching(postings: DataFrame, node) -> DataFrame:
    """Distinct doc_id of the documents that a query tree matches."""
    if isinstance(node, Phrase):
        return phrase_hits(postings, node).select("doc_id").distinct()
    if node.op == "or":
        return reduce(DataFrame.unionByName, [matching(postings, k) for k in node.kids]).distinct()
    if node.op == "near":
        base = phrase_hits(postings, node.kids[0]).select("doc_id", "col", F.col("pos").alias("lo"), (F.col("pos") + len(node.kids[0].terms)).alias("hi"))
        for k in node.kids[1:]:
            other = phrase_hits(postings, k).select("doc_id", "col", F.col("pos").alias("p"))
            n = len(k.terms)
            base = base.join(other, ["doc_id", "col"]).select("doc_id", "col", F.least("lo", "p").alias("lo"), F.greatest("hi", F.col("p") + n).alias("hi"))
        words = sum(len(k.terms) for k in node.kids)
        return base.filter(F.col("hi") - F.col("lo") - words <= node.distance).select("doc_id").distinct()
    parts = [matching(postings, k) for k in node.kids if not (isinstance(k, Phrase) and not k.terms)]
    if not parts:
        return postings.select("doc_id").limit(0)
    how = "left_semi" if node.op == "and" else "left_anti"
    return reduce(lambda a, b: a.join(b, "doc_id", how), parts)


def all_phrases(node) -> list[Phrase]:
    return ([node] if node.terms else []) if isinstance(node, Phrase) else [p for k in (node.kids[:1] if node.op == "not" else node.kids) for p in all_phrases(k)]


def bm25(postings: DataFrame, lens: DataFrame, node, weights: dict[str, float] | None = None) -> DataFrame:
    """(doc_id, score): more negative is better; ``lens`` has (doc_id, len) of every indexed document, empty ones too."""
    totals = lens.agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("all"))
    if not all_phrases(node):
        return lens.select("doc_id", F.lit(0.0).alias("score")).limit(0)
    w = F.lit(1.0) if not weights else F.coalesce(*[F.when(F.col("col") == c, F.lit(float(v))) for c, v in weights.items()], F.lit(1.0))
    tf = reduce(
        DataFrame.unionByName,
        [phrase_hits(postings, p).select("doc_id", w.alias("w")).groupBy("doc_id").agg(F.sum("w").alias("f")).select("doc_id", F.lit(i).alias("phrase"), "f") for i, p in enumerate(all_phrases(node))],
    )
    df = tf.groupBy("phrase").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf) * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("len") / (F.col("all") / F.col("n"))))
    hits = tf.join(matching(postings, node), "doc_id", "left_semi").join(F.broadcast(df), "phrase").join(lens, "doc_id").join(F.broadcast(totals))
    return hits.groupBy("doc_id").agg((-F.sum(part)).alias("score"))


def top_hits(scored: DataFrame, limit: int = 25) -> DataFrame:
    return scored.orderBy("score", "doc_id").limit(limit)


def make_snippet(text: str | None, terms: set[str], words: int = 24) -> str:
    """The window of ``words`` tokens with most hits, hits in brackets, cuts marked."""
    text = text or ""
    spans = [m.span() for m in re.finditer(r"[^\W_]+", text)]
    marks = [any(t in terms for t in fold_word(text[a:b])) for a, b in spans]
    if not spans:
        return ""
    best, at = -1, 0
    for i in range(max(1, len(spans) - words + 1)):
        n = sum(marks[i : i + words])
        if n > best:
            best, at = n, i
    last = min(len(spans), at + words) - 1
    out, pos = ["…"] if at else [], spans[at][0] if at else 0
    for k in range(at, last + 1):
        a, b = spans[k]
        out += [text[pos:a], f"[{text[a:b]}]" if marks[k] else text[a:b]]
        pos = b
    return "".join(out) + (text[pos:] if last == len(spans) - 1 else "…")
