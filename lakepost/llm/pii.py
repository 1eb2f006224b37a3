"""Personal data in free text, by anchor expansion.

One Aho-Corasick automaton over at-signs and their spelled forms, schemes, words of streets, cues of
identity numbers and known first names, together with starts of digit groups, finds anchors; a
local parser expands each anchor to the whole address, number, street or name and validates it
(hosts, lengths of numbers, check digits, house numbers).  First names and surnames are learned
from the structured sender fields: first names that stand before several surnames, surnames in a
bit filter sized by their number, and frequent endings of surnames.

Defined cases: null and empty texts hold nothing; places of the same type that overlap count
once (the longer); titles are left out; a street without a house number is no address; a bare
number of eleven digits needs a right check digit or a cue before it; texts are read whole and
anchors are expanded as far as they go.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakepost.llm import patterns
from lakepost.llm.filters import BitFilter, build_filter
from lakepost.session import cut

#: Surnames that a first name must stand before: so many, and this share of all surnames.
PARTNERS, PARTNER_SHARE = 5, 1e-5
#: Surnames that an ending must have, likewise: at most 1 / ENDING_SHARE endings are kept.
ENDINGS, ENDING_SHARE = 12, 2e-4
# Spelled at-signs.
AT_SIGNS = ["@", "(at)", "[at]", "{at}", "<at>", " at ", "(małpa)", "[małpa]", "(arroba)", "[arroba]", "(chiocciola)", "(zavináč)", "(собака)", "(ät)", "(@)", "[@]", "＠"]
SCHEMES = ["://"]
# Words before identity numbers.
NUMBER_CUES = "pesel document dokument identit identity ausweis identité documento nummer číslo номер passport паспорт 番号 身分 numerze".split()
_GAP = r"(?:[ \t\u00a0]|\r?\n[ \t]*(?:\p{L}{0,2}[>|][ \t]?)*)"
_LINE = r"\r?\n[ \t]*(?:\p{L}{0,2}[>|][ \t]?)*"
_W = r"[\p{Lu}][\p{L}\u0300-\u036f’'\-]+"
_ADDRESS = [
    regex.compile(rf"(?i:\b(?:ul|al|pl|os)\.){_GAP}(?:[\p{{L}}’'\-]+{_GAP}){{1,4}}\d{{1,4}}[a-zA-Z]?\b(?![.:]\d)"),
    regex.compile(rf"\b\d{{1,4}}(?:{_GAP}(?:bis|ter))?,{_GAP}(?:rue|avenue|boulevard|place|quai|impasse|allée|chemin|cours){_GAP}\p{{L}}"),
    regex.compile(rf"\b(?:Via|Viale|Piazza|Corso|Vicolo|Largo|Calle|Avda\.|Avenida|Plaza|Paseo|Rua|Travessa|Praça|Alameda|Rambla){_GAP}(?:[\p{{L}}’'\-]+{_GAP}){{1,5}}\d{{1,4}}\b(?![.:]\d)"),
    regex.compile(rf"\b(?:Flat{_GAP}\d{{1,4}}[A-Z]?,{_GAP})?\d{{1,4}}[A-Za-z]?{_GAP}(?:{_W}{_GAP}){{1,3}}(?:Street|Road|Lane|Avenue|Close|Drive|Court|Way|Square|Terrace|Gardens|Hill|Row)\b"),
    regex.compile(rf"(?:\b(?:{_W}[ \t]){{0,2}})(?<!\p{{L}})[\p{{Lu}}][\p{{L}}\-]*(?:straße|strasse|straat|weg|allee|platz|gasse|damm|ufer|laan|gracht|plein|kade|steeg|dijk|singel|gatan|vägen|gränd|torget|stigen){_GAP}\d{{1,4}}(?:{_GAP}?[a-zA-Z]\b)?(?:[/-]\d+)?(?![.:]\d)"),
    regex.compile(rf"\b(?:Am|An{_GAP}der|Im|Zum|Zur|Auf{_GAP}dem){_GAP}{_W}{_GAP}\d{{1,4}}[a-z]?\b(?![.:]\d)"),
    regex.compile(rf"\b(?:ул|вул|просп|пр|пл|бульв|наб|пер)\.{_GAP}(?:[\p{{L}}’'\-]+{_GAP}){{1,4}}(?:д\.{_GAP})?\d{{1,4}}\b(?![.:]\d)"),
    regex.compile(rf"\b{_W}{_GAP}(?:пер|ул|пр|просп|наб)\.,?{_GAP}(?:д\.{_GAP})?\d{{1,4}}\b"),
    regex.compile(rf"\bNa{_GAP}{_W}{_GAP}\d{{1,4}}/\d{{1,4}}\b"),
    regex.compile(rf"\b{_W}{_GAP}(?:mostů|ulice|náměstí|třída|nábřeží){_GAP}\d{{1,4}}(?:/\d+)?\b"),
    regex.compile(r"[\p{Han}]{1,6}(?:町|丁目|通り|番地)[\d０-９一二三四五六七八九十]+(?:[-−ー丁目番地の][\d０-９]+)*(?:号)?"),
]
# Words of streets, by the number of the pattern that expands them.
STREET_CUES = [
    "ul. al. pl. os. Ul. Al. Pl. Os. UL. AL. PL. OS.", "rue avenue boulevard place quai impasse allée chemin cours", "Via Viale Piazza Corso Vicolo Largo Calle Avda. Avenida Plaza Paseo Rua Travessa Praça Alameda Rambla",
    "Street Road Lane Avenue Close Drive Court Way Square Terrace Gardens Hill Row", "straße strasse straat weg allee platz gasse damm ufer laan gracht plein kade steeg dijk singel gatan vägen gränd torget stigen",
    "Am An Im Zum Zur Auf", "ул. вул. просп. пр. пл. бульв. наб. пер.", "пер. ул. пр. просп. наб.", "Na", "mostů ulice náměstí třída nábřeží", "町 丁目 通り 番地",
]
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT_ANCHOR = re.compile(r"(?<![\w./,+\-])[+(]?\d|(?<![\w/#\-.])[A-Z]{2,3}(?=[ \r\n\t>|]*\d\d)")
_EMAIL_HOST = regex.compile(rf"(?:[A-Za-z0-9\-]+(?:\.|{_GAP}?[\[({{<]{_GAP}?(?:dot|kropka|punkt|punto|ponto|tečka|точка){_GAP}?[\])}}>]{_GAP}?))+[A-Za-z]{{2,}}")
_PHONE = regex.compile(
    rf"(?<![\w./,+\-])(?:\+\d{{1,3}}(?:[ \-/.]|{_LINE})?(?:\(\d{{1,4}}\)(?:[ \-]|{_LINE})?)?\d(?:(?:[ \-./]|{_LINE})?\d){{5,12}}"
    rf"|00\d{{2}}(?:[ \-/])?\d(?:[ \-/]?\d){{6,11}}"
    rf"|\(\d{{2,5}}\)(?:[ \-]|{_LINE})?\d(?:(?:[ \-]|{_LINE})?\d){{5,9}}"
    rf"|\d{{3}}(?:[ \-.]|{_LINE})\d{{3}}(?:[ \-.]|{_LINE})\d{{3,4}}"
    rf"|0\d{{2,4}}(?:[ \-/]|{_LINE})\d{{3,5}}(?:(?:[ \-/]|{_LINE})\d{{2,5}})?)(?![\w/]|[.\-]\d)"
)
_ID = regex.compile(rf"(?<![\w/#\-.])(?:\d{{11}}|\d{{3}}-\d{{2}}-\d{{4}}|\d{{6}}(?: |{_LINE})\d{{5}}|[A-Z]{{3}} ?\d{{6}}|QQ(?: |{_LINE})?\d{{2}}(?: |{_LINE})?\d{{2}}(?: |{_LINE})?\d{{2}}(?: |{_LINE})?[A-D])(?![\w/]|-\d)")
_INITIAL = regex.compile(rf"(?<![\p{{L}}\p{{N}}.\-])\p{{Lu}}\.{_GAP}?(?:\p{{Lu}}\.{_GAP}?)?(?=\p{{Lu}}\p{{L}})")
_AFTER = regex.compile(rf"(?:{_GAP}?\p{{Lu}}\.)?{_GAP}([\p{{Lu}}][\p{{L}}’'\-?\ufffd]*[\p{{L}}?\ufffd])")
_TOKEN = regex.compile(r"[\p{L}?\ufffd][\p{L}\p{M}’'\-?\ufffd]*")
_BEFORE = regex.compile(rf"([\p{{Lu}}][\p{{L}}’'\-]*\p{{L}}){_GAP}$")
_WORDCHAR = regex.compile(r"[\p{L}\p{N}_]")


class Names:
    """Known first names, and surnames as a bit filter with their frequent endings."""

    def __init__(self, first: set[str], last: BitFilter, endings: set[str], han: set[str]) -> None:
        self.first, self.last, self.endings, self.han = first, last, endings, han
        self._automaton = None

    def __getstate__(self):
        return {"first": self.first, "last": self.last, "endings": self.endings, "han": self.han, "_automaton": None}

    @property
    def automaton(self):
        """Anchors of all kinds: text -> (kind, length, pattern of an address)."""
        if self._automaton is None:
            held: dict[str, list[tuple[str, int]]] = {}
            for n in self.first:
                for form in {n, n.upper()}:
                    held.setdefault(form, []).append(("first", 0))
            for h in self.han:
                held.setdefault(h, []).append(("han", 0))
            for s in AT_SIGNS:
                held.setdefault(s, []).append(("at", 0))
            for s in SCHEMES:
                held.setdefault(s, []).append(("scheme", 0))
            for i, words in enumerate(STREET_CUES):
                for w in words.split():
                    held.setdefault(w, []).append(("street", i))
            a = ahocorasick.Automaton()
            for text, kinds in held.items():
                a.add_word(text, (len(text), kinds))
            a.make_automaton()
            self._automaton = a
        return self._automaton

    def surname(self, word: str, known_only: bool = False) -> bool:
        w = word.split("-")[0].casefold()
        if len(w) < 4:
            return False
        return w in self.last or (not known_only and len(w) >= 6 and w[-4:] in self.endings)


def learn_names(people: DataFrame, column: str) -> Names:
    """Names from a column of personal names (``First Surname`` or, in Han, one word): one scan, then distinct names only."""
    clean = cut(people.select(F.trim(column).alias("n")).filter("n IS NOT NULL").groupBy("n").agg(F.count(F.lit(1)).alias("c")))
    pairs = clean.filter(F.col("n").rlike(r"^[\p{L}'’]+ [\p{L}'’]+(-[\p{L}'’]+)?$")).select(F.element_at(F.split("n", " "), 1).alias("first"), F.element_at(F.split(F.element_at(F.split("n", " "), 2), "-"), 1).alias("last")).distinct()
    all_lasts = pairs.select("last").distinct().count()
    firsts = cut(pairs.groupBy("first").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= max(PARTNERS, PARTNER_SHARE * all_lasts)).select("first"))
    first = {r["first"] for r in firsts.collect()}
    lasts = cut(pairs.join(firsts, "first", "left_semi").select(F.lower("last").alias("last")).distinct())
    known = build_filter(lasts, "last")
    least = max(ENDINGS, ENDING_SHARE * all_lasts)
    endings = {r["e"] for r in lasts.filter("length(last) >= 6").groupBy(F.expr("right(last, 4)").alias("e")).count().filter(F.col("count") >= least).collect()}
    han = {r["n"] for r in clean.filter(F.col("n").rlike(r"^\p{IsHan}{3,6}$") & (F.col("c") >= max(3, PARTNER_SHARE * all_lasts))).select("n").collect()}
    parts: dict[str, int] = {}
    for h in han:
        for p in ({h[2:]} if len(h) >= 4 else {h[2:], h[1:]}):
            if len(p) >= 2:
                parts[p] = parts.get(p, 0) + 1
    return Names(first, known, endings, han | {p for p, k in parts.items() if k >= 2})


class Spans:
    """Places that are taken, kept in order, none inside another."""

    def __init__(self) -> None:
        self.spans: list[tuple[int, int]] = []

    def free(self, s: int, e: int) -> bool:
        k = bisect_left(self.spans, (e, e))
        return not any(b > s for _, b in self.spans[max(0, k - 1) : k])

    def add(self, s: int, e: int) -> None:
        """Take s to e; what touches it becomes one with it."""
        k = bisect_right(self.spans, (s, 1 << 60))
        while k and self.spans[k - 1][1] > s:
            k -= 1
            a, b = self.spans.pop(k)
            s, e = min(a, s), max(b, e)
        while k < len(self.spans) and self.spans[k][0] < e:
            e = max(e, self.spans.pop(k)[1])
        insort(self.spans, (s, e))


def _emails(text: str, hits: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Addresses around at-signs: the whole local part before, a valid host behind."""
    for start, end in hits:
        e = start
        while e and text[e - 1] in " \t":
            e -= 1
        s = e
        while s and text[s - 1] in _LOCAL:
            s -= 1
        if s == e and start:
            # the local part may stand on the line before
            k = e
            while k and text[k - 1] in " \t\r\n>|":
                k -= 1
            if "\n" not in text[k:e] or text.count("\n", k, e) > 1:
                continue
            s = e = k
            while s and text[s - 1] in _LOCAL:
                s -= 1
        while s < e and text[s] in ".-+%":
            s += 1
        if s == e or text[start:end] == " at " and not any(c in "._-0123456789" for c in text[s:e]):
            continue
        g = _GAPS.match(text, end)
        h = _EMAIL_HOST.match(text, g.end() if g else end)
        if h is not None:
            yield s, h.end()


_GAPS = regex.compile(rf"{_GAP}*")
_SCHEME = re.compile(r"\w+://[!-~]+")
_PESEL = (1, 3, 7, 9, 1, 3, 7, 9, 1, 3)


def valid_number(token: str, before: str) -> bool:
    """Whether an identity number holds: check digits of eleven digits, or a cue before it; areas of nine digits that are given out."""
    if re.fullmatch(r"\d{11}", token):
        right = (10 - sum(int(x) * w for x, w in zip(token, _PESEL)) % 10) % 10 == int(token[10])
        low = before.lower()
        return right and len(set(token)) > 1 or any(c in low for c in NUMBER_CUES)
    if re.fullmatch(r"\d{3}-\d{2}-\d{4}", token):
        return token[:3] not in ("000", "666") and token[4:6] != "00" and token[7:] != "0000"
    return True


def _numbers(text: str, taken: Spans) -> Iterator[tuple[str, int, int]]:
    """Identity numbers and phones, parsed at the starts of digit groups."""
    phones = []
    for a in _DIGIT_ANCHOR.finditer(text):
        s = a.start()
        m = _ID.match(text, s)
        if m is not None and taken.free(*m.span()):
            e = m.end()
            if not (m[0].isdigit() and patterns.search(r"(?:\b(?:SR|ZG|K|REF)[ \-/])$", text[max(0, s - 4) : s])) and valid_number(m[0], text[max(0, s - 40) : s]):
                taken.add(s, e)
                yield "id_number", s, e
                continue
        m = _PHONE.match(text, s)
        if m is not None:
            phones.append(m)
    for m in phones:
        s, e = m.span()
        digits = sum(c.isdigit() for c in m[0])
        if not taken.free(s, e) or digits < 9 or digits > 15 or patterns.match(r"\d{3} \d{3} \d{3}[ ,]?\d*\s?(?:zł|€|元|円)", text[s : e + 8]):
            continue
        taken.add(s, e)
        yield "phone", s, e


def find_pii(text: str, names: Names) -> list[tuple[str, int, int]]:
    """(type, start, end) of each piece of personal data, in code points."""
    out: list[tuple[str, int, int]] = []
    ats, firsts, hans, streets, scheme = [], [], [], set(), False
    for end, (length, kinds) in names.automaton.iter(text):
        span = (end - length + 1, end + 1)
        for kind, pattern in kinds:
            if kind == "at":
                ats.append(span)
            elif kind == "first":
                firsts.append(span)
            elif kind == "han":
                hans.append(span)
            elif kind == "street":
                streets.add(pattern)
            else:
                scheme = True
    taken = Spans()
    for s, e in _emails(text, ats):
        if taken.free(s, e):
            out.append(("email", s, e))
            taken.add(s, e)
    if scheme:
        for m in _SCHEME.finditer(text):
            taken.add(*m.span())
    out += _numbers(text, taken)
    free = taken.free
    for k in sorted(streets):
        for m in _ADDRESS[k].finditer(text):
            s, e = m.span()
            if free(s, e):
                lead = patterns.match(rf"(?:(?:Die|Der|Das|Het|Den|La|El|Il|Nová|The|Uwe|lautet|is|är|est|es|é|in|der){_GAP})+", text[s:e])
                s += lead.end() if lead else 0
                out.append(("address", s, e))
                taken.add(s, e)
    named = Spans()
    whole: list[tuple[int, int]] = []

    def name(s: int, e: int) -> None:
        whole.append((s, e))
        named.add(s, e)

    for s, e in sorted(firsts, key=lambda x: (x[0], -x[1])):
        if s > 0 and (_WORDCHAR.match(text[s - 1]) or text[s - 1] in "@./-_+" and s > 1 and _WORDCHAR.match(text[s - 2])):
            continue
        if e < len(text) and (_WORDCHAR.match(text[e]) or text[e] in "@_" or (text[e] in ".+-" and e + 1 < len(text) and text[e + 1].islower() and text[e] != "-")):
            continue
        if not free(s, e) or not named.free(s, s + 1):
            continue
        b = _BEFORE.search(text[max(0, s - 50) : s])
        after = _AFTER.match(text, e)
        if after is not None and (names.surname(after[1]) or after[1].casefold() not in _COMMON and "\n" not in text[e : after.start(1)] and not names.surname(b[1]) if b else after is not None and names.surname(after[1])):
            name(s, after.end())
        elif b is not None and names.surname(b[1]) and b[1] not in names.first and free(max(0, s - 50) + b.start(1), s):
            name(max(0, s - 50) + b.start(1), e)
        else:
            tail = patterns.match(rf"{_GAP}\p{{Lu}}\.(?!\p{{L}})", text[e : e + 12])
            name(s, e + (tail.end() if tail else 0))
    for m in _INITIAL.finditer(text):
        s = m.start()
        if not named.free(s, s + 1) or not free(s, m.end()):
            continue
        t = _TOKEN.match(text, m.end())
        if t is not None and (names.surname(t[0]) or t[0] in names.first):
            name(s, t.end())
    # a surname before an initial
    for m in _SURNAME_INITIAL.finditer(text):
        if names.surname(m[1], True) and free(m.start(), m.end()) and named.free(m.start(), m.end()):
            name(*m.span())
    for s, e in sorted(hans, key=lambda x: (x[0], -x[1])):
        if free(s, e) and named.free(s, e):
            name(s, e)
    out += [("name", s, e) for s, e in whole]
    return sorted(set(out), key=lambda x: (x[1], x[2]))


_SURNAME_INITIAL = regex.compile(rf"(?<![\p{{L}}\-.])([\p{{Lu}}][\p{{L}}\-’']{{3,}}){_GAP}\p{{Lu}}\.(?!\p{{L}})")
_COMMON = {"dear", "hi", "hello", "re", "fw"}


def replace_pii(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with typed placeholders; the rest is unchanged."""
    out, at = [], 0
    for kind, s, e in found:
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
            at = e
    out.append(text[at:])
    return "".join(out)


def text_cells(mails: DataFrame, segments: DataFrame) -> DataFrame:
    """(item_kind, item_key, field, value) of the texts to look at."""
    cell = lambda f: F.struct(F.lit(f).alias("field"), F.col(f).alias("value"))
    m = mails.select(F.lit("mail").alias("item_kind"), F.col("entry_id").alias("item_key"), F.explode(F.array(cell("subject"), cell("body"))).alias("c"))
    s = segments.select(F.lit("segment").alias("item_kind"), F.col("segment_id").cast("string").alias("item_key"), F.explode(F.array(cell("clean_text"))).alias("c"))
    return m.unionByName(s).select("item_kind", "item_key", "c.field", "c.value").filter("length(value) > 0")


def personal_data(mails: DataFrame, segments: DataFrame, people: DataFrame | None = None, column: str = "sender_name") -> DataFrame:
    """(item_kind, item_key, field, pii_type, start_pos, end_pos): each piece of personal data."""
    names = mails.sparkSession.sparkContext.broadcast(learn_names(people if people is not None else mails, column))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = names.value
        for pdf in batches:
            rows = [(k, i, f, t, s, e) for k, i, f, v in zip(pdf["item_kind"], pdf["item_key"], pdf["field"], pdf["value"]) for t, s, e in find_pii(v, known)]
            yield pd.DataFrame(rows, columns=["item_kind", "item_key", "field", "pii_type", "start_pos", "end_pos"])

    return text_cells(mails, segments).mapInPandas(scan, "item_kind string, item_key string, field string, pii_type string, start_pos int, end_pos int").distinct()


def redact(mails: DataFrame, segments: DataFrame, people: DataFrame | None = None, column: str = "sender_name") -> DataFrame:
    """(item_kind, item_key, field, value): the texts with typed placeholders."""
    names = mails.sparkSession.sparkContext.broadcast(learn_names(people if people is not None else mails, column))

    @F.pandas_udf("string")
    def clean(values: pd.Series) -> pd.Series:
        known = names.value
        return pd.Series([replace_pii(v, find_pii(v, known)) for v in values])

    return text_cells(mails, segments).withColumn("value", clean("value"))
