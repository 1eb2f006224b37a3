"""Newly written text of mails: find quoted history, signatures and notices.

Everything earlier is a pattern, and a mail is what is left when the intervals of its patterns are
merged and subtracted:

* sentences of all earlier messages of the thread.  The automaton of a thread is kept as a
  distributed transition table (conversation, sentence) -> earliest instant and teller, for one
  thread may hold a third of all mails: its key spreads such a thread over all tasks.  A mail's
  sentences are scanned through it; neighbouring hits make an interval, which counts if its
  sentences aren't such as meet by chance: the product of their shares among all threads (and
  among the messages of the thread) must be at most ``CHANCE``.
* closing blocks.  Lines that stand before the sender's own name (closing formulas), lines that
  stand below a closing (device lines, notices) and banners above all text are learned from
  the whole corpus by their rates, with the lower bound of the rate at its number of cases;
  lines of one sender that only stand below that sender's closings are learned for the sender.
* marks that need no words: quote prefixes, separators, header blocks, lines that introduce a
  quotation.  Which words end an introduction and which keys begin a header block is learned as well.

Defined cases: null and empty bodies have no lines; a mail without conversation is judged without
thread; copies of a message (same instant but for a notation without seconds, same sender) are no
earlier message, nor is anything that isn't told before; a mail without any readable instant
neither gives nor takes sentences; of repeated rows with one entry_id the least by all columns
counts; texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate, compress

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakepost.functions.timestamps import utc_micros
from lakepost.session import cut

#: Chance that a matched interval was written anew all the same.
CHANCE = 0.01
#: Threads that are thought of besides those at hand, for the shares of few threads tell little.
FEW_THREADS = 100
#: So many messages of a thread may tell a sentence as their own: the first, its paste, and copies of both.
OWN = 4
#: Copies of one message differ in time by no more (notations without seconds, harvest of two stores).
COPY_US = 180_000_000
#: Lower bound of the rate (at 95 %) from which a line is a closing line.
RATE = 0.5
Z = 1.64

_MARKED = regex.compile(r"^[ \t]*(?:[\p{Lu}\p{Lo}]{0,3}>|[|»>](?!.*[^|\s].*\|[ \t]*$))")
_QUOTE = regex.compile(r"^[ \t]*(?:\p{L}{0,3}[>|»][ \t]?)+")
_LONE = re.compile(r"[ \t]*>[ ]?\d")
_RULE = re.compile(r"^[ \t]*(?:[-_=*~#–—+.·•]{2,}|-- ?)[ \t]*$")
_SEPARATOR = regex.compile(r"^[ \t>|*_]*[-–—_=]{3,}[ \t]*\p{L}.*?[-–—_=]{3,}[ \t*]*$")
_HEAD = regex.compile(r"^[ \t*_]*(\p{L}[^:：]{0,24}?)[ \t\xa0]?[*_]*[:：][*_]*[ \t]*\S")
_ADDRESS = re.compile(r"\S@\S|\[mailto:")
_DATE = re.compile(r"\d{4}|\d{1,2}[./]\d{1,2}|\d{1,2}:\d{2}")
_CONTACT = regex.compile(r"@|\d{2,}[ \-./]\d{2,}|^\s*\p{L}{1,6}[.:]\s*[+(\d]|\p{L} [|–,] \p{Lu}|^[\p{L}. ]{3,40} \d{1,4}\w?$")
_POSTSCRIPT = regex.compile(r"(?i)^[ \t]*(?:p\.? ?s\.?|ps|пс|п\.с\.|p\.p\.s|追伸)(?:[ .:：,–-]|$)")
_SENTENCE = re.compile(r"[^.!?。！？…]+(?:[.!?。！？…]+|$)|[.!?。！？…]+")
_LETTERS = re.compile(r"[^A-Za-z]+")
_CASED = regex.compile(r"[\p{Lu}\p{Ll}]")
_RULE_STARTS = frozenset("-_=*~#–—+.·• \t")
_ENDS = (".", "]", ")", "*")

#: What is known of a line from its place.
QUOTED, RULE, NAME, CONTACT, MARKED, FIRST, SAYS, HEAD, INTRO, POSTSCRIPT = (1 << i for i in range(10))
#: What is seen of a line for learning: it stands before a name, below a closing, above all text, or is sure.
BEFORE, BELOW, ABOVE, SURE = 1, 2, 4, 8
#: What a learned line is.
FORMULA, AFTER, BANNER, WORD = 1, 2, 4, 8


def strip_quote(line: str) -> str:
    return _QUOTE.sub("", line) if _MARKED.match(line) else line


def _key(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def _ascii(text: str) -> bytes:
    """ASCII characters of a text without spaces and question marks, which damage leaves as they are."""
    return "".join(text.split()).encode("ascii", "ignore").replace(b"?", b"")


def line_key(line: str) -> int:
    """Key of a line that damage and outer punctuation don't change."""
    bare = _ascii(line).strip(b",.!:;-")
    return xxhash.xxh64_intdigest(bare.lower() if len(bare) >= 8 else "".join(line.split()).strip(",.!:;、。！-").casefold().encode()) - (1 << 63)


def sentence_key(sentence: str) -> int | None:
    """Key of a sentence; null for one of less than four characters."""
    bare = _ascii(sentence)
    if len(bare) < 12:
        full = "".join(sentence.split())
        if len(full) < 5:
            return None
        bare = full.encode()
    return xxhash.xxh64_intdigest(bare) - (1 << 63)


def name_skeletons(sender: str) -> set[str]:
    """Parts of a sender's name: their ASCII letters where there are any, so that damaged forms agree."""
    return {_LETTERS.sub("", w).lower() or w.casefold() for w in re.split(r"[\s,]+", sender) if w} | ({sender.replace(" ", "")} if sender else set())


def is_own_name(line: str, parts: set[str]) -> bool:
    """Whether a line is nothing but the sender's name or a part of it."""
    t = line.strip(",.-–— \t")
    if not t or len(t) > 60 or t.count(" ") > 3 or not parts:
        return False
    words = t.split()
    known = [(_LETTERS.sub("", w).lower() or w.casefold()) in parts for w in words]
    bare = t.replace(" ", "")
    # names without spaces: a part of them is a name as well
    return all(k or len(w.rstrip(".")) == 1 for k, w in zip(known, words)) and any(known) or len(bare) > 1 and not _CASED.search(bare) and any(bare in p for p in parts)


def _intro_key(line: str) -> int:
    """Key of the word that ends an introduction (``wrote:``)."""
    t = line.rstrip().rstrip(":： ").split()
    last = t[-1] if t else ""
    return _key("i:" + (last[-5:] if not last.isascii() and len(last) > 12 else _LETTERS.sub("", last).lower() or last.casefold()))


def _lines_of_marks(lines: list[str], blank: list[bool]) -> list[int]:
    """Flags of each line by marks alone."""
    n = len(lines)
    flags = [0] * n
    quoted = [not b and (x[0] in ">|» \t" or ">" in x[:6]) and _MARKED.match(x) is not None for x, b in zip(lines, blank)]
    for i in range(n):
        if quoted[i] and _LONE.match(lines[i]) and not (i and quoted[i - 1]) and not (i + 1 < n and quoted[i + 1]):
            quoted[i] = False  # a comparison, no quotation
        if quoted[i]:
            flags[i] = QUOTED | MARKED
    # a short line between quoted ones is the wrapped end of one
    for i in range(1, n - 1):
        if not quoted[i] and not blank[i] and quoted[i - 1] and quoted[i + 1] and len(lines[i]) < 30 and len(lines[i - 1]) > 50 and len(lines[i].split()) <= 3:
            flags[i] = MARKED
    for i in range(n):
        if quoted[i] and (i == 0 or not quoted[i - 1]):
            j = i - 1
            while j >= 0 and blank[j]:
                j -= 1
            if j < 0 or i - j > 3 or flags[j] or not lines[j].rstrip().endswith((":", "：")):
                continue
            # up to the line that tells the time, within the paragraph
            top = j
            while top > 0 and j - top < 3 and not _DATE.search(lines[top]) and not blank[top - 1] and not flags[top - 1]:
                top -= 1
            if not _DATE.search(lines[top]):
                top = j
            joined = " ".join(lines[top : j + 1])
            sure = _DATE.search(joined) is not None and (_ADDRESS.search(joined) is not None or len(joined) < 140)
            for k in range(top, j + 1):
                flags[k] |= (MARKED if sure else 0) | (INTRO if k == j else 0)
    for i in range(n):
        if blank[i] or quoted[i] or flags[i] & MARKED:
            continue
        line = lines[i]
        nxt = next((k for k in range(i + 1, min(n, i + 4)) if not blank[k]), None)
        head = None
        if line.lstrip()[:1] in "-–—_=*" and _SEPARATOR.match(line) and nxt is not None and (_HEAD.match(lines[nxt]) or quoted[nxt]):
            head = i
        elif (":" in line or "：" in line) and len(line) < 160 and _HEAD.match(line):
            more = 0
            for k in range(i, min(n, i + 6)):
                if blank[k] or quoted[k]:
                    break
                more += len(lines[k]) < 160 and _HEAD.match(lines[k]) is not None
            if more >= 3:
                up = next((k for k in range(i - 1, max(-1, i - 3), -1) if not blank[k]), None)
                over = up is not None and (_RULE.match(lines[up]) is not None or lines[up].rstrip().endswith((":", "：")) and not _HEAD.match(lines[up]))
                if _ADDRESS.search(line) and i and blank[i - 1] or over:
                    head = up if over else i
                flags[i] |= HEAD
        if head is None and line.rstrip().endswith((":", "：")) and nxt is not None and not quoted[nxt]:
            if _DATE.search(line) or (i and not blank[i - 1] and _DATE.search(lines[i - 1])):
                flags[i] |= SAYS
        if head is not None:
            for k in range(head, n):
                if not blank[k]:
                    flags[k] |= MARKED
            break
    return flags


class Parsed:
    """What a mail's lines are by themselves: numbers, flags and keys of the lines, sentences with their pieces of lines."""

    def __init__(self, body: str, sender: str) -> None:
        lines = body.replace("\r", "").split("\n")
        blank = [not x.strip() for x in lines]
        marks = _lines_of_marks(lines, blank)
        parts = name_skeletons(sender)
        at = [i for i, b in enumerate(blank) if not b]
        place = {i: k for k, i in enumerate(at)}
        self.numbers = [i + 1 for i in at]
        self.flags: list[int] = []
        self.keys: list[int] = []
        self.more: list[int] = []
        self.sizes: list[int] = []
        for i in at:
            f, line = marks[i], lines[i]
            more = 0
            if i == 0 or blank[i - 1]:
                f |= FIRST
            if not f & QUOTED:
                if line[0] in _RULE_STARTS and _RULE.match(line):
                    f |= RULE
                elif is_own_name(line, parts):
                    f |= NAME
                if len(line) < 60 and _CONTACT.search(line):
                    f |= CONTACT
                if line.lstrip()[:1] in "pPпП追" and _POSTSCRIPT.match(line):
                    f |= POSTSCRIPT
                if f & (INTRO | SAYS):
                    more = _intro_key(line)
                elif f & HEAD:
                    more = _key("k:" + _HEAD.match(line)[1].strip().casefold())
            self.flags.append(f)
            self.keys.append(0 if f & (QUOTED | RULE) else line_key(line))
            self.more.append(more)
            self.sizes.append(len(line) - line.count(" "))
        self.told: set[int] = set()
        self.own: list[int] = []  # sentences with unmarked lines, 0 between paragraphs
        self.pieces: list[tuple[int, int, int]] = []  # (sentence in own, line, letters)
        start = 0
        while start < len(at):
            end = start + 1
            while end < len(at) and at[end] == at[end - 1] + 1:
                end += 1
            # a quotation and what stands around it are paragraphs of their own
            for a, b in _split_runs(self.flags, start, end):
                self._sentences(lines, at, a, b)
            start = end
        if not self.own:
            self.told.discard(0)

    def _sentences(self, lines: list[str], at: list[int], a: int, b: int) -> None:
        texts = [strip_quote(lines[at[k]]).strip() for k in range(a, b)]
        mine = not all(self.flags[k] & MARKED for k in range(a, b))
        text = " ".join(texts)
        ends, n = [], 0
        for t in texts:
            n += len(t) + 1
            ends.append(n)
        if mine and self.own:
            self.own.append(0)
        k = 0
        for m in _SENTENCE.finditer(text):
            key = sentence_key(m[0])
            if key is None:
                continue
            self.told.add(key)
            if not mine:
                continue
            s, e = m.span()
            s += len(m[0]) - len(m[0].lstrip())
            while ends[k] <= s:
                k += 1
            j, p = k, s
            while p < e:
                q = min(e, ends[j])
                self.pieces.append((len(self.own), a + j, q - p - text.count(" ", p, q)))
                p, j = q, j + 1
            self.own.append(key)

    def seen(self) -> list[tuple[int, int, int]]:
        """(line, key, what is seen of it) of each unmarked line, and of the words of introductions and headers."""
        out = []
        mine = [k for k, f in enumerate(self.flags) if not f & MARKED]
        texts = [k for k in mine if not self.flags[k] & RULE]
        below, first = False, True
        for j, k in enumerate(texts):
            f = self.flags[k]
            bits = 0
            if j and self.flags[k - 1] & RULE:
                below = True
            nxt = texts[j + 1] if j + 1 < len(texts) else None
            if nxt is not None and self.flags[nxt] & NAME and not f & NAME and (f | ~self.flags[nxt]) & FIRST:
                bits |= BEFORE
            # a short last line speaks for a closing line as well, unless it is the end of a wrapped paragraph
            if (below or j and nxt is None and self.sizes[k] < 40 and (f & FIRST or self.sizes[k - 1] < 40)) and not f & POSTSCRIPT:
                bits |= BELOW
            if first and nxt is not None:
                bits |= ABOVE
            out.append((k, self.keys[k], bits))
            if f & NAME and j:
                below = True
            first = False
        for k, f in enumerate(self.flags):
            if self.more[k]:
                out.append((k, self.more[k], SURE if f & MARKED else 0))
        return out


def _split_runs(flags: list[int], start: int, end: int) -> Iterator[tuple[int, int]]:
    a = start
    for k in range(start + 1, end + 1):
        if k == end or (flags[k] ^ flags[k - 1]) & QUOTED or (flags[k] | flags[k - 1]) & RULE:
            yield a, k
            a = k


def closing_lines(p_flags: list[int], known: dict[int, int], ends: list[bool]) -> list[bool]:
    """For each line whether its marks or the closing block say that it isn't newly written; ``known`` are the kinds of learned lines."""
    n = len(p_flags)
    old = [bool(f & MARKED) for f in p_flags]
    get = lambda k: known.get(k, 0)
    for k in range(n):
        f = p_flags[k]
        if old[k] or not f & (SAYS | HEAD | INTRO) or not get(k) & WORD:
            continue
        old[k] = True
        if f & INTRO:
            continue
        if k and not f & FIRST and f & SAYS and not p_flags[k] & HEAD and not old[k - 1] and not p_flags[k - 1] & NAME:
            old[k - 1] = True
        if k and p_flags[k - 1] & RULE:
            old[k - 1] = True
        for j in range(k, n):
            old[j] = True
        break
    mine = [k for k in range(n) if not old[k]]
    closed = False
    above = True
    script = False
    for j, k in enumerate(mine):
        f = p_flags[k]
        kind = get(k)
        nxt = mine[j + 1] if j + 1 < len(mine) and mine[j + 1] == k + 1 else None  # what follows without a mark between
        if f & FIRST:
            script = False
        if closed:
            script = script or bool(f & POSTSCRIPT)
            old[k] = not script or bool(kind & AFTER)
            continue
        if above and not f & RULE:
            if kind & BANNER and ends[k]:
                old[k] = True
                continue
            above = False
        if f & RULE:
            # a delimiter stands between new text and a closing block
            if k and nxt is not None and _closing_like(p_flags[nxt], get(nxt), nxt + 1 >= n or bool(p_flags[nxt + 1] & FIRST), p_flags[nxt + 1] if nxt + 1 < n else 0):
                old[k] = closed = True
        elif kind & FORMULA and j and (f & FIRST or nxt is not None and not p_flags[nxt] & FIRST):
            if nxt is None or p_flags[nxt] & (FIRST | RULE | NAME | CONTACT) or get(nxt) & (AFTER | FORMULA) or nxt + 1 >= n or p_flags[nxt + 1] & (FIRST | CONTACT | RULE):
                old[k] = closed = True
        elif f & NAME and j:
            if nxt is None or p_flags[nxt] & (FIRST | RULE | CONTACT | POSTSCRIPT) or get(nxt) & AFTER or p_flags[nxt] & NAME or not f & FIRST and p_flags[k - 1] & RULE:
                old[k] = closed = True
        elif kind & AFTER:
            old[k] = True
            if j:
                closed = True
    # delimiters next to what is old
    for k in range(n):
        if p_flags[k] & RULE and not old[k] and (k and old[k - 1] or k + 1 < n and old[k + 1]):
            old[k] = True
    return old


def _closing_like(flags: int, kind: int, alone: bool, after: int) -> bool:
    return bool(flags & (NAME | CONTACT) or kind & (AFTER | FORMULA))


def pasted_lines(breaks: set[int], pieces: list[tuple[int, int, int]], sizes: list[int], shares: dict[int, float], greets: set[int]) -> list[int]:
    """Lines most of which lie in merged intervals of matched sentences.

    ``pieces`` are (sentence, line, letters), ``breaks`` the places between paragraphs among the
    sentences, ``shares`` the chance of each matched sentence.

    The chance of an interval counts as often as there are sentences that may begin one.  A sentence
    alone counts if it is a whole paragraph.  ``greets`` are the lines that begin new
    text as paragraphs of their own: greetings are new, whatever was said before.
    """
    n = 1 + max([s for s, _, _ in pieces] + [*breaks], default=-1)
    hit = [s in shares for s in range(n)]
    if greets:
        for s, line, _ in pieces:
            if line in greets:
                hit[s] = False
    keep = [False] * n
    asked = n - len(breaks)
    i = 0
    while i < n:
        if not hit[i]:
            i += 1
            continue
        j, chance = i, 1.0
        while j < n and (hit[j] or j in breaks and j + 1 < n and hit[j + 1]):
            if j not in breaks:
                chance *= shares[j]
            j += 1
        if chance * asked <= CHANCE:
            a = i
            while a < j:
                b = a
                while b < j and b not in breaks:
                    b += 1
                if b - a > 1 or (a == 0 or a - 1 in breaks) and (b == n or b in breaks):
                    keep[a:b] = [True] * (b - a)
                a = b + 1
        i = j
    covered = [0] * len(sizes)
    for s, line, letters in pieces:
        if keep[s]:
            covered[line] += letters
    return [k for k, c in enumerate(covered) if c and 2 * c >= sizes[k]]


def greetings(flags: list[int], sizes: list[int]) -> set[int]:
    """Short lines that begin new text, as paragraphs of their own."""
    out = set()
    for k, f in enumerate(flags):
        if not f & (MARKED | RULE) and f & FIRST and sizes[k] < 45 and (k == 0 or flags[k - 1] & MARKED) and (k + 1 == len(flags) or flags[k + 1] & FIRST):
            out.add(k)
    return out


def _sevens(numbers: list[int]) -> bytes:
    out = bytearray()
    for x in numbers:
        while x > 127:
            out.append(x & 127 | 128)
            x >>= 7
        out.append(x)
    return bytes(out)


def pack(lists: list[list[int]]) -> bytes:
    """Lists of whole numbers from 0 in seven bits a byte, each after its bytes: small numbers take one byte, none is too large."""
    out = []
    for numbers in lists:
        part = bytes(numbers) if max(numbers, default=0) < 128 else _sevens(numbers)
        out += (_sevens([len(part)]), part)
    return b"".join(out)


def unpack(data: bytes) -> list[list[int]]:
    """What ``pack`` packed."""
    out, i = [], 0
    while i < len(data):
        n = shift = 0
        while data[i] > 127:
            n |= (data[i] & 127) << shift
            i, shift = i + 1, shift + 7
        n |= data[i] << shift
        part = data[i + 1 : i + 1 + n]
        i += 1 + n
        if part.isascii():
            out.append(list(part))
            continue
        numbers, x, shift = [], 0, 0
        for b in part:
            x |= (b & 127) << shift
            if b > 127:
                shift += 7
            else:
                numbers.append(x)
                x = shift = 0
        out.append(numbers)
    return out


def _steps(rising: list[int]) -> list[int]:
    return [b - a for a, b in zip([0, *rising], rising)]


def _rate_floor(k, n):
    """Lower bound of a rate of k in n cases (Wilson)."""
    z2 = Z * Z
    return (k + z2 / 2 - Z * F.sqrt(k * (n - k) / n + z2 / 4)) / (n + z2)


#: Keys that occur more than once are sent to the tasks up to so many (under 20 MB), and joined beyond.
SENT_KEYS = 200_000


def one_of_each(rows: DataFrame, key: str) -> DataFrame:
    """The least row of each key.  Only keys that occur more than once are brought together, all other rows stay where they are."""
    again = cut(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(key))
    few = again.count() <= SENT_KEYS
    mark = F.broadcast(again) if few else again
    rest = [c for c in rows.columns if c != key]
    least = rows.join(mark, key, "left_semi").groupBy(key).agg(F.min(F.struct(*rest)).alias("r")).select(key, "r.*")
    return rows.join(mark, key, "left_anti").select(*rows.columns).unionByName(least)


def parsed_mails(mails: DataFrame, stores: DataFrame) -> DataFrame:
    """Each mail's lines and sentences as arrays, with its instant ``t`` and the instant ``by`` which its text is told by.

    ``shape`` packs what only the last step asks for: numbers, flags, sentence ends and letters of the lines, the pieces
    (sentence, line, letters) and the breaks between paragraphs; rising numbers as their steps.
    """
    zones = stores.groupBy("store_id").agg(F.max("zone_name").alias("zone_name"), F.max("date_order").alias("date_order"))
    to_us = utc_micros()
    column = lambda c: F.col(c) if c in mails.columns else F.lit(None).cast("string")
    once = ["store_id", "conversation_id", "sender_name", "sender_email", "body", "sent", "received", "harvested_at"]
    rows = one_of_each(mails.select("entry_id", *[column(c).alias(c) for c in once]).filter("entry_id IS NOT NULL AND length(body) > 0"), "entry_id")
    sent, received, harvested = (F.coalesce(to_us(c, "zone_name", "date_order"), F.lit(0).cast("long")) for c in ("sent", "received", "harvested_at"))
    own = F.when(sent > 0, sent).otherwise(received)
    # a mail may be harvested weeks late: that time dates its text for later mails, but doesn't make it later than others
    timed = rows.join(zones, "store_id", "left").withColumn("t", own).withColumn("by", F.when(own > 0, own).otherwise(harvested))
    teller = F.xxhash64(F.lower(F.coalesce(F.nullif("sender_email", F.lit("")), "sender_name", F.lit(""))))
    columns = ["row", "entry_id", "thread", "teller", "t", "by", "shape", "seen_at", "seen", "bits", "told", "mine", "mine_at"]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row, e, c, s, who, b, t, by in pdf.itertuples(index=False):
                p = Parsed(b, s or "")
                lines = b.replace("\r", "").split("\n")
                seen = p.seen()
                ends = [lines[i - 1].rstrip().endswith(_ENDS) and lines[i - 1].count(" ") >= 4 for i in p.numbers]
                threaded = not pd.isna(c)
                in_own, in_line, letters = map(list, zip(*p.pieces)) if threaded and p.pieces else ([], [], [])
                breaks = [i for i, x in enumerate(p.own) if not x] if threaded else []
                shape = pack([_steps(p.numbers), p.flags, ends, p.sizes, _steps(in_own), _steps(in_line), letters, _steps(breaks)])
                mine = dict((x, i) for i, x in reversed(list(enumerate(p.own)))) if threaded else {}
                mine.pop(0, None)
                places = [(x, i) for i, x in enumerate(p.own) if x] if threaded else []
                out.append((row, e, c, who, t, by, shape, [k for k, _, _ in seen], [x for _, x, _ in seen], [y for _, _, y in seen], list(p.told - mine.keys()) if threaded else [], [x for x, _ in places], [i for _, i in places]))
            frame = pd.DataFrame(out, columns=columns)
            frame["thread"] = frame["thread"].astype("Int64")
            yield frame

    schema = "row long, entry_id string, thread long, teller long, t long, by long, shape binary, seen_at array<int>, seen array<long>, bits array<int>, told array<long>, mine array<long>, mine_at array<int>"
    thread = F.when(F.length("conversation_id") > 0, F.xxhash64("conversation_id"))
    return timed.select(F.monotonically_increasing_id().alias("row"), "entry_id", thread.alias("thread"), "sender_name", teller.alias("teller"), "body", "t", "by").mapInPandas(scan, schema)


#: Learned lines are sent to the tasks up to so many rows (24 bytes each), and joined beyond.
SENT_ROWS = 300_000


def learned_lines(parsed: DataFrame) -> DataFrame:
    """(teller, key, kind) of the closing lines, banners and words of introductions; a null teller stands for all."""
    # what is repeated a few times within one thread only may be pasted; a mail without thread is one of its own
    x = parsed.select("teller", F.pmod(F.coalesce("thread", "row"), F.lit(127)).cast("int").alias("thread"), F.explode(F.arrays_zip("seen", "bits")).alias("x")).select("teller", "thread", F.col("x.seen").alias("key"), F.col("x.bits").alias("bits"))
    count = lambda bit: F.sum(F.when(F.col("bits").bitwiseAND(bit) > 0, 1).otherwise(0))
    by_teller = x.groupBy("key", "teller").agg(F.count(F.lit(1)).alias("n"), F.min("thread").alias("lo"), F.max("thread").alias("hi"), *[count(b).alias(c) for b, c in ((BEFORE, "before"), (BELOW, "below"), (ABOVE, "above"), (SURE, "sure"))])
    wide = (F.col("lo") < F.col("hi")) | (F.col("n") > 2 * OWN)
    # a teller's own lines go the way of all tellers' sums, so that the counts of tellers are brought together once
    own = (_rate_floor(F.col("below"), F.col("n")) > RATE) & wide
    nobody = F.lit(None).cast("long")
    to = F.explode(F.when(own, F.array(nobody, F.col("teller"))).otherwise(F.array(nobody))).alias("to")
    sums = by_teller.select("key", to, "n", "before", "below", "above", "sure", "lo", "hi").groupBy("key", "to").agg(*[F.sum(c).alias(c) for c in ("n", "before", "below", "above", "sure")], F.count(F.lit(1)).alias("tellers"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    kind = sum(F.when(_rate_floor(F.col(c), F.col("n")) > RATE, bit).otherwise(0) for c, bit in (("before", FORMULA), ("below", AFTER), ("above", BANNER), ("sure", WORD)))
    general = (F.col("tellers") > 1) & wide & (F.greatest("before", "below", "above", "sure") * 2 > F.col("n"))
    return sums.filter(F.col("to").isNotNull() | general).select(F.col("to").alias("teller"), "key", F.when(F.col("to").isNull(), kind).otherwise(AFTER).cast("int").alias("kind")).filter("kind > 0")


def known_lines(parsed: DataFrame) -> DataFrame:
    """(row, at, kind): the learned lines of each mail."""
    learned = cut(learned_lines(parsed))
    sent = F.broadcast if learned.count() <= SENT_ROWS else (lambda df: df)
    lines = parsed.select("row", "teller", F.explode(F.arrays_zip("seen", "seen_at")).alias("x")).select("row", "teller", F.col("x.seen").alias("key"), F.col("x.seen_at").alias("at"))
    general = learned.filter("teller IS NULL").select("key", F.col("kind").alias("general"))
    special = learned.filter("teller IS NOT NULL").select("teller", "key", F.col("kind").alias("special"))
    both = lines.join(sent(general), "key", "left").join(sent(special), ["teller", "key"], "left")
    return both.select("row", "at", F.coalesce("general", F.lit(0)).bitwiseOR(F.coalesce("special", F.lit(0))).alias("kind")).filter("kind > 0")


#: The first instant of a sentence, in milliseconds, and 20 bits of its teller share one number.
_TELLER = 1 << 20
#: So do the messages that tell a sentence and, in the lower half, those that tell it as their own.
_TELLING = 1 << 32


def thread_hits(parsed: DataFrame) -> DataFrame:
    """(row, at, share): sentences of each mail that its thread told before, by place, with their chance."""
    threads = parsed.filter("thread IS NOT NULL")
    first = F.shiftleft(F.floor(F.col("by") / 1000), 20).bitwiseOR(F.pmod("teller", F.lit(_TELLER)))
    told = threads.filter("by > 0").select("thread", first.alias("first"), F.explode(F.concat(F.array(F.lit(0).cast("long")), "told", F.array_distinct("mine"))).alias("key"), "mine")
    # messages that tell it, and in the lower half those that tell it as their own
    told = told.select("thread", "key", "first", (F.lit(_TELLING) + ((F.col("key") == 0) | F.array_contains("mine", F.col("key"))).cast("long")).alias("k"))
    # key 0 is told by every message of the thread: it counts them
    table = cut(told.groupBy("thread", "key").agg(F.min("first").alias("first"), F.sum("k").alias("k")))
    table = table.select("thread", "key", "first", F.shiftright("k", 32).alias("tellings"), F.col("k").bitwiseAND(_TELLING - 1).alias("k"))
    size = table.filter("key = 0").select("thread", F.col("k").alias("messages"))
    threads_of = table.filter("key <> 0").groupBy("key").agg(F.count(F.lit(1)).alias("threads"))
    total = size.agg(F.count(F.lit(1)).alias("all"))
    when = F.shiftleft(F.floor(F.col("t") / 1000), 20).bitwiseOR(F.pmod("teller", F.lit(_TELLER)))
    asked = threads.filter("t > 0").select("row", "thread", when.alias("when"), F.explode(F.arrays_zip("mine", "mine_at")).alias("x")).select("row", "thread", "when", F.col("x.mine").alias("key"), F.col("x.mine_at").alias("at"))
    copies = F.when(F.pmod("first", F.lit(_TELLER)) == F.pmod("when", F.lit(_TELLER)), COPY_US // 1000).otherwise(0)
    # who asks has told it too: what one message tells, nobody has told before
    held = asked.join(table.filter("key <> 0 AND tellings > 1").drop("tellings"), ["thread", "key"]).filter(F.shiftright("first", 20) + copies < F.shiftright("when", 20)).select("row", "thread", "key", "at", "k")
    share = F.greatest((F.col("threads") - 1) / (F.col("all") + FEW_THREADS), (F.col("k") - OWN) / F.greatest(F.col("messages"), F.lit(1)), F.lit(0.0))
    return held.join(threads_of, "key").join(size, "thread").join(F.broadcast(total)).select("row", "at", share.alias("share"))  # one row


def old_text(mails: DataFrame, stores: DataFrame) -> DataFrame:
    """(entry_id, line_no) of the non-blank lines of body that aren't newly written by the sender."""
    parsed = cut(parsed_mails(mails, stores))
    known = known_lines(parsed).select("row", "at", "kind", F.lit(None).cast("float").alias("share"))
    hits = thread_hits(parsed).select("row", "at", F.lit(0).alias("kind"), F.col("share").cast("float").alias("share"))
    found = known.unionByName(hits).groupBy("row").agg(F.collect_list(F.struct("at", "kind", "share")).alias("found"))

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids: list[str] = []
            numbers: list[int] = []
            for e, shape, found_here in pdf.itertuples(index=False):
                no, flags, ends, sizes, in_own, in_line, letters, breaks = unpack(shape)
                kinds: dict[int, int] = {}
                shares: dict[int, float] = {}
                for x in found_here if found_here is not None else ():
                    if x["kind"]:
                        kinds[x["at"]] = kinds.get(x["at"], 0) | x["kind"]
                    else:
                        shares[x["at"]] = x["share"]
                old = closing_lines(flags, kinds, ends)
                if shares:
                    parts = list(zip(accumulate(in_own), accumulate(in_line), letters))
                    for k in pasted_lines(set(accumulate(breaks)), parts, sizes, shares, greetings(flags, sizes)):
                        old[k] = True
                got = list(compress(accumulate(no), old))
                ids += [e] * len(got)
                numbers += got
            yield pd.DataFrame({"entry_id": pd.Series(ids, dtype=object), "line_no": np.array(numbers, np.int32)})

    wide = parsed.select("row", "entry_id", "shape").join(found, "row", "left").drop("row")
    return wide.mapInPandas(decide, "entry_id string, line_no int")


def new_text(mails: DataFrame, stores: DataFrame) -> DataFrame:
    """(entry_id, new_text): each mail reduced to the newly written lines."""
    old = old_text(mails, stores).groupBy("entry_id").agg(F.collect_set("line_no").alias("old"))
    lines = F.split(F.regexp_replace("body", "\r", ""), "\n")
    kept = F.filter(F.transform(lines, lambda x, i: F.struct((i + 1).alias("n"), x.alias("x"))), lambda y: ~F.coalesce(F.array_contains("old", y["n"]), F.lit(False)))
    text = F.regexp_replace(F.array_join(F.transform(kept, lambda y: y["x"]), "\n"), "\n{3,}", "\n\n")
    bodies = mails.select("entry_id", "body").filter("entry_id IS NOT NULL").groupBy("entry_id").agg(F.min("body").alias("body"))
    return bodies.join(old, "entry_id", "left").select("entry_id", F.trim(text).alias("new_text"))
