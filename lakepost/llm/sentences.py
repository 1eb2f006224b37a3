"""Sentence units of documents in many languages, scripts and layouts.

Characters are tagged as boundary or inside by a linear chain over the candidate places of a
block: after final punctuation with its closing quotes and brackets, and at spaces of scripts that
write without periods.  Emissions are log-likelihood ratios of what stands left (the word that
bears the stop), of the mark, and of what stands right; the transition speaks against units of a
few characters; Viterbi decodes the block.

The chain is trained on the corpus itself, without labels or word lists.  What stands left of a
boundary is known from the ends of blocks, what stands right of one from their starts; what
stands around marks inside a sentence is found by expectation-maximization over all candidates
within blocks.  So a word whose stop hardly ever ends a block is an abbreviation, a word that hardly
ever begins one (``Mai`` after ``3.``) goes on.  Text without punctuation (Thai, Lao, Khmer,
Burmese) is trained on blocks stripped of punctuation, by the characters at their edges.
Words are hashed to ``WIDTH`` buckets, so the model has one size at any corpus size.

Line breaks are wrapping if the next word wouldn't have fitted in the width of the document;
else the line is a unit of its own.

Defined cases: null, empty and blank texts have no units; brackets and quotations are never
divided, whatever their length, unless they aren't closed in their block; an untrained model
judges by shapes alone; texts are read whole.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakepost.llm import patterns
from lakepost.session import cut

_FINAL = ".!?…。！？।॥؟։።‼⁇⁈⁉"
_CLOSE = "\"'”’»›)]}」』）】》“‘"
_OPEN = "\"'“„«‚‘¿¡([「『（‹【《{-–—*_"
_CANDIDATE = re.compile(f"[{re.escape(_FINAL)}]+[{re.escape(_CLOSE)}]*")
_LIST = regex.compile(r"^[ \t]*(?:[-*•·–—+▪◦‣>]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)]|[ivxIVX]{1,4}[.)])[ \t]+\S")
_TABLE = re.compile(r"\t|\S {3,}\S| \| ")
_PROSE = re.compile(f"[{re.escape(_FINAL)}]\\s+\\S+\\s+\\S+\\s+\\S+\\s")
_THAI = regex.compile(r"[\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]")
_EAST = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
_OPEN_SPACE = _OPEN + " "
_ENUMERATOR = re.compile(r"\(?(?:\d{1,3}|[^\W\d_]|[ivxIVX]{1,4})")
_SPACE = re.compile(r"\s+")
_PUNCT = regex.compile(r"\p{P}")
_PAIR = re.compile("[()\\[\\]{}（）「」『』«»“”„‚‘’‹›【】《》\"]")
_PAIRS = {"(": ")", "[": "]", "（": "）", "「": "」", "『": "』", "«": "»", "“": "”", "„": "”“", "‘": "’", "‚": "‘’", "‹": "›", "{": "}", "【": "】", "《": "》"}
#: Buckets of hashed words.
WIDTH = 1 << 18
ROUNDS = 4
#: Occurrences that a word must outweigh before it counts by itself and not by its shape.
PSEUDO = 2.0
#: Counts of a task are handed on when it holds so many distinct candidates.
FLUSH = 200_000
SHORT, SHORT_COST = 4, 2.0

SHAPES, MARKS, SIDES = 20, 48, 16
THAI_SHAPE, THAI_MARK, THAI_SIDE = SHAPES - 1, MARKS - 1, SIDES - 1


def blocks(text: str) -> list[tuple[int, int]]:
    """(start, end) of the stretches of text that wrapped lines make up; each other line is a block."""
    if "\n" not in text:
        return [(0, len(text))] if text.strip() else []
    lines, at = [], 0
    for line in text.split("\n"):
        lines.append((at, line.rstrip(), line.strip()))
        at += len(line) + 1
    width = max(len(r) for _, r, _ in lines)
    east = not text.isascii() and _EAST.search(text) is not None
    wraps = width >= (28 if east else 40)

    def fits(r: str, nxt: str) -> bool:
        if east:
            return len(r.strip()) < width - 4 if not nxt[0].isascii() else len(r) + 1 + len(nxt.split(None, 1)[0]) <= width
        return len(r) + 1 + len(nxt.split(None, 1)[0]) <= width

    if wraps and width > 110:
        # long lines are wrapped only if most of them fill the width
        pairs = [not fits(a[1], b[2]) for a, b in zip(lines, lines[1:]) if a[2] and b[2]]
        wraps = sum(pairs) >= 2 and 2 * sum(pairs) >= len(pairs)
    out: list[tuple[int, int]] = []
    start = end = None
    for k, (a, r, line) in enumerate(lines):
        if not line:
            if start is not None:
                out.append((start, end))
                start = None
            continue
        start = a if start is None else start
        end = a + len(r)
        nxt = lines[k + 1][2] if k + 1 < len(lines) else ""
        split = True
        if nxt and wraps:
            split = fits(r, nxt)
            if split and not east and nxt[0].islower() and line[-1] not in ".!?:…" and len(line) > 0.6 * width:
                split = False
            if not split and (_LIST.match(nxt) or _TABLE.search(line) or _TABLE.search(nxt)):
                split = True
        if split:
            out.append((start, end))
            start = None
    if start is not None:
        out.append((start, end))
    return out


def _bucket(word: str) -> int:
    return xxhash.xxh32_intdigest(word) & (WIDTH - 1)


def left_code(token: str) -> int:
    """Shape and bucket of the word that bears a full stop."""
    t = token.lstrip(_OPEN)
    t = t[max(t.rfind("’"), t.rfind("'")) + 1 :] if ("’" in t or "'" in t) and not t.endswith(("’", "'")) else t
    if not t:
        shape = 0
    elif t.isdigit():
        shape = 3 if len(t) <= 3 else 4
    elif t.replace(".", "").isalpha():
        if "." in t:
            shape = 5 if all(len(p) <= 3 for p in t.split(".")) else 6
        elif t[0].isupper() or t[0].islower():
            n, up = len(t), t[0].isupper()
            shape = (1 if up else 2) if n == 1 else (8 if up else 7) if n <= 3 else (10 if up else 9) if n <= 6 else (12 if up else 11)
        else:
            shape = 13 if len(t) > 1 else 18
    elif any(c.isdigit() for c in t):
        shape = 14
    elif t[-1] in _CLOSE:
        shape = 15
    elif t[-1].isalpha():
        shape = 16
    else:
        shape = 17
    return shape * WIDTH + _bucket(t.lower() if shape not in (3, 4, 14) else "0")


def right_code(token: str) -> int:
    """Kind of the next character behind what opens a quotation or bracket, and bucket of the next word."""
    t = token.lstrip(_OPEN)
    opened = len(t) != len(token)
    m = patterns.match(r"[\p{L}\p{M}\p{N}]+", t)
    word = m[0] if m else ""
    c = t[:1]
    kind = 0 if not c else 1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 4 if c.isalpha() else 5 if c in ",;:、，；：" else 6
    if kind == 4:
        word = word[:2]
    elif kind == 3:
        word = "0"
    return (kind + 7 * opened) * WIDTH + _bucket(word.lower() or c)


def mark_code(mark: str, closers: str, gap: bool, after_text: bool) -> int:
    """Kind of final punctuation, of what closes after it, and whether a space follows."""
    first = mark[0]
    kind = 0 if mark == "." else 1 if first in "!?" else 2 if first in ".…" else 3 if first in "。！？" else 4
    close = 0 if not closers else 1 if all(c in ")]}）】" for c in closers) else 2 if after_text else 3
    return (kind * 4 + close) * 2 + gap


class Boundaries:
    """Log-likelihood ratios of boundary against inside: by left word, right word and mark."""

    def __init__(self, left: np.ndarray, right: np.ndarray, left_shape: np.ndarray, right_shape: np.ndarray, mark: np.ndarray) -> None:
        self.left, self.right, self.left_shape, self.right_shape, self.mark = left, right, left_shape, right_shape, mark
        self.lefts: dict[str, float] = {}
        self.rights: dict[str, float] = {}

    def __getstate__(self):
        return {k: getattr(self, k) for k in ("left", "right", "left_shape", "right_shape", "mark")} | {"lefts": {}, "rights": {}}

    def left_of(self, token: str, thai: bool = False) -> float:
        key = "\0" + token if thai else token
        got = self.lefts.get(key)
        if got is None:
            if len(self.lefts) > 300_000:
                self.lefts.clear()
            code = THAI_SHAPE * WIDTH + _bucket("<" + token) if thai else left_code(token)
            got = self.lefts[key] = float(self.left[code & (WIDTH - 1)] + self.left_shape[code // WIDTH])
        return got

    def right_of(self, token: str, thai: bool = False) -> float:
        key = "\0" + token if thai else token
        got = self.rights.get(key)
        if got is None:
            if len(self.rights) > 300_000:
                self.rights.clear()
            code = THAI_SIDE * WIDTH + _bucket(">" + token) if thai else right_code(token)
            got = self.rights[key] = float(self.right[code & (WIDTH - 1)] + self.right_shape[code // WIDTH])
        return got


def untrained() -> Boundaries:
    """What is thought of shapes and marks before anything is counted."""
    left, right, mark = np.zeros(SHAPES), np.zeros(SIDES), np.zeros(MARKS)
    left[[1, 2, 5, 18]] = -2.5
    right[[1, 5, 8, 12]] = -4.0
    right[3] = -0.5
    for m in range(MARKS):
        kind, close, gap = m // 8, m // 2 % 4, m % 2
        mark[m] = 2.5 if gap or kind in (3, 4) else -4.0
        if close == 3 and kind in (3, 4):
            mark[m] = 0.0
    mark[THAI_MARK] = 1.5
    z = np.zeros(WIDTH, np.float32)
    return Boundaries(z, z, left, right, mark)


class Candidate:
    """A place in a block with what stands around it."""

    __slots__ = ("left", "mark", "place", "right", "thai")

    def __init__(self, place: int, left: str, mark: int, right: str, thai: bool = False) -> None:
        self.place, self.left, self.mark, self.right, self.thai = place, left, mark, right, thai


def closed_spans(block: str) -> tuple[list[tuple[int, int]], set[int]]:
    """Merged (start, end) of the brackets and quotations that are closed in the block, and the places of all that close."""
    found: list[tuple[int, int]] = []
    stack: list[tuple[str, int]] = []
    straight = None
    n = len(block)
    for m in _PAIR.finditer(block):
        i, c = m.start(), m[0]
        if c in "’‘" and i and block[i - 1].isalnum() and i + 1 < n and block[i + 1].isalnum():
            continue
        if stack and c in _PAIRS[stack[-1][0]]:
            found.append((stack.pop()[1], i))
        elif c in _PAIRS:
            if not (c == "‘" and i and block[i - 1].isalpha()):
                stack.append((c, i))
        elif c == '"':
            if straight is None:
                straight = i
            else:
                found.append((straight, i))
                straight = None
        elif c in "”»’" and (i == 0 or block[i - 1].isspace()) and (k := block.find(c, i + 1)) > 0:
            # some languages open with the closing mark
            if c != "’":
                stack.append(("“" if c == "”" else "‹", i))
                if c == "»":
                    stack.pop()
                    found.append((i, k))
        elif c in ")]}）」』】》":
            # what was opened in between isn't closed
            for d in range(len(stack) - 1, -1, -1):
                if c in _PAIRS[stack[d][0]]:
                    found.append((stack[d][1], i))
                    del stack[d:]
                    break
    found.sort()
    out: list[tuple[int, int]] = []
    for a, b in found:
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out, {b for _, b in found}


def candidates(block: str) -> list[Candidate]:
    """The places of a block (without outer space) where a unit may end, the end of the block excepted."""
    flat = block.replace("\n", " ").replace("\t", " ").replace("　", " ").replace("\xa0", " ")
    spans, closing = closed_spans(block) if _PAIR.search(block) else ([], ())
    starts = [a for a, _ in spans]
    inside = lambda p: (k := bisect_right(starts, p) - 1) >= 0 and spans[k][0] < p < spans[k][1]
    out: list[Candidate] = []
    n = len(block)
    last = 0
    for m in _CANDIDATE.finditer(flat):
        s, e = m.span()
        if e >= n:
            break
        found = m[0]
        mark = found.rstrip(_CLOSE)
        closers = len(found) - len(mark)
        while closers and found[e - s - 1] in "“‘\"'" and flat[e] != " " and flat[e] not in ",.;:" and e - 1 not in closing:
            e -= 1
            closers -= 1
        if spans and inside(e - 1 if closers else s):
            continue
        gap = flat[e] == " "
        a = flat.rfind(" ", 0, s) + 1
        if not gap and mark == "." and not closers:
            z = flat.find(" ", e)
            token = flat[a : z if z > 0 else n]
            if "@" in token or "://" in token or token.startswith("www."):
                continue
        r = e
        while r < n and flat[r] == " ":
            r += 1
        q = r
        while q < n and flat[q] in _OPEN_SPACE:
            q += 1
        z = flat.find(" ", q)
        close = found[len(mark) : e - s]
        after_text = False
        if close and close[0] not in ")]}）】":
            k = bisect_right(starts, s) - 1
            after_text = bool(flat[last : starts[k]].strip()) if k >= 0 and starts[k] >= last else bool(flat[last:s].strip())
        single = mark == "." and not close
        if single and gap and s - a <= 4 and not flat[:a].strip(_OPEN_SPACE) and _ENUMERATOR.fullmatch(flat[a:s]):
            continue
        right = flat[q : z if z > 0 else n]
        out.append(Candidate(e, flat[a:s] if single else "", mark_code(mark, close, gap, after_text), flat[r] + right if q > r else right))
        last = e
    if not block.isascii() and _THAI.search(block):
        for m in _SPACE.finditer(block):
            a, b = m.span()
            if a and b < n and _THAI.match(block[a - 1]) and _THAI.match(block[b]) and not inside(a):
                out.append(Candidate(a, block[max(0, a - 3) : a], THAI_MARK, block[b : b + 3], True))
        out.sort(key=lambda c: c.place)
    return out


def _text_blocks(text: str) -> Iterator[tuple[int, str, bool]]:
    """(start, block without outer space, whether it is a row of a table)."""
    for a, b in blocks(text):
        block = text[a:b]
        inner = block.strip()
        if inner:
            row = "\n" not in inner and _TABLE.search(inner) is not None and not _PROSE.search(inner)
            yield a + len(block) - len(block.lstrip()), inner, row


def _count(text: str, c: Counter) -> None:
    """Candidates, block ends and block starts of a text as (left, mark, right) codes; -1 where there is none."""
    for _, block, row in _text_blocks(text):
        if row:
            continue
        for x in candidates(block):
            if x.thai:
                c[(THAI_SHAPE * WIDTH + _bucket("<" + x.left), THAI_MARK, THAI_SIDE * WIDTH + _bucket(">" + x.right))] += 1
            else:
                c[(left_code(x.left) if x.left else -1, x.mark, right_code(x.right))] += 1
        if not block.isascii() and _THAI.search(block):
            bare = _PUNCT.sub("", block).strip()
            c[(THAI_SHAPE * WIDTH + _bucket("<" + bare[-3:]), -1, -1)] += 1
            c[(-1, -1, THAI_SIDE * WIDTH + _bucket(">" + bare[:3]))] += 1
            continue
        if len(block) >= 20:
            # short lines (greetings, headings) are no sample of sentences
            if block[-1] in _FINAL + _CLOSE and (m := re.search(f"([{re.escape(_FINAL)}]+)[{re.escape(_CLOSE)}]*$", block)):
                if m[1] == "." and m[0] == ".":
                    c[(left_code(block[block.replace("\n", " ").rfind(" ", 0, m.start()) + 1 : m.start()]), -1, -1)] += 1
                c[(-1, -1, right_code(block.split(None, 1)[0][:40]))] += 1


def train(documents: DataFrame, rounds: int = ROUNDS) -> Boundaries:
    """Fit the chain on all documents: the driver gets arrays of fixed size only."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c: Counter[tuple[int, int, int]] = Counter()
        frame = lambda: pd.DataFrame([(*k, n) for k, n in c.items()], columns=["l", "m", "r", "n"])
        for pdf in batches:
            for t in pdf["text"]:
                _count(t, c)
            if len(c) > FLUSH:
                yield frame()
                c.clear()
        yield frame()

    table = cut(documents.select("text").filter("length(text) > 0").mapInPandas(count, "l long, m int, r long, n long").groupBy("l", "m", "r").agg(F.sum("n").alias("n")))

    def sums(weights: Boundaries | None) -> dict[str, np.ndarray]:
        """Total and inside counts: of left buckets and shapes, right buckets and sides, marks; of ends and starts."""
        sent = None if weights is None else documents.sparkSession.sparkContext.broadcast(weights)

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                w = untrained() if sent is None else sent.value
                l, m, r, n = (pdf[x].to_numpy() for x in "lmrn")  # noqa: E741
                mid = m >= 0
                odds = w.mark[np.maximum(m, 0)] + w.right[r & (WIDTH - 1)] + w.right_shape[np.maximum(r, 0) // WIDTH]
                odds = odds + np.where(l >= 0, w.left[l & (WIDTH - 1)] + w.left_shape[np.maximum(l, 0) // WIDTH], 0)
                within = np.where(mid, n / (1 + np.exp(np.clip(odds, -40, 40))), 0.0)
                has_l, has_r, end, start = mid & (l >= 0), mid, ~mid & (l >= 0), ~mid & (r >= 0)
                rows = []
                for name, keep, slot, x in (
                    ("L", has_l, l & (WIDTH - 1), n), ("LI", has_l, l & (WIDTH - 1), within), ("S", has_l, l // WIDTH, n), ("SI", has_l, l // WIDTH, within), ("R", has_r, r & (WIDTH - 1), n), ("RI", has_r, r & (WIDTH - 1), within), ("K", has_r, r // WIDTH, n), ("KI", has_r, r // WIDTH, within),
                    ("M", mid, m, n), ("MI", mid, m, within), ("LE", end, l & (WIDTH - 1), n), ("SE", end, l // WIDTH, n), ("RS", start, r & (WIDTH - 1), n), ("KS", start, r // WIDTH, n),
                ):
                    if keep.any():
                        slots, at = np.unique(slot[keep], return_inverse=True)
                        rows.append(pd.DataFrame({"name": name, "slot": slots.astype(np.int64), "x": np.bincount(at, x[keep].astype(float))}))
                if rows:
                    yield pd.concat(rows)

        got = table.mapInPandas(part, "name string, slot long, x double").groupBy("name", "slot").agg(F.sum("x").alias("x")).toPandas()
        sizes = {"L": WIDTH, "R": WIDTH, "S": SHAPES, "K": SIDES, "M": MARKS}
        out = {}
        for name in ("L", "LI", "S", "SI", "R", "RI", "K", "KI", "M", "MI", "LE", "SE", "RS", "KS"):
            a = np.zeros(sizes[name[0]])
            g = got[got["name"] == name]
            a[g["slot"].to_numpy()] = g["x"].to_numpy()
            out[name] = a
        return out

    model = None
    for _ in range(rounds):
        model = fit(sums(model))
    return model if model is not None else untrained()


def fit(c: dict[str, np.ndarray]) -> Boundaries:
    """Log-likelihood ratios from counts: boundaries by block ends and starts, insides by the last round."""
    start = untrained()
    if c["M"].sum() == 0:
        return start

    def side(all_, inside, known, shape_all, shape_in, shape_known, prior):
        total_known, total_in = shape_known.sum(), shape_in.sum()
        p_b = (shape_known + np.exp(prior.clip(max=0))) / (total_known + 1)
        p_i = (shape_in + np.exp((-prior).clip(max=0))) / (total_in + 1)
        shape = np.log(p_b / p_i)
        both = all_ + known
        n = both.sum()
        # what the ends (or starts) let expect of boundaries; the rest stands inside, whatever the last round thought
        expected = known * ((shape_all.sum() - total_in) / max(total_known, 1))
        inside = np.maximum(inside, np.minimum(all_, all_ - expected))
        # a word's lift over what its frequency lets expect
        lift_b = (known + PSEUDO) / (both * (known.sum() / max(n, 1)) + PSEUDO)
        lift_i = (inside + PSEUDO) / (both * (inside.sum() / max(n, 1)) + PSEUDO)
        return (np.log(lift_b) - np.log(lift_i)).astype(np.float32), shape

    left, left_shape = side(c["L"], c["LI"], c["LE"], c["S"], c["SI"], c["SE"], start.left_shape)
    right, right_shape = side(c["R"], c["RI"], c["RS"], c["K"], c["KI"], c["KS"], start.right_shape)
    b, i = c["M"] - c["MI"], c["MI"]
    prior = 1 / (1 + np.exp(-start.mark))
    mark = np.log((b + 5 * prior) / (i + 5 * (1 - prior)))
    return Boundaries(left, right, left_shape, right_shape, mark)


def decode(block: str, places: list[tuple[int, float]]) -> list[int]:
    """The boundaries of highest total odds, by Viterbi; a unit of less than ``SHORT`` characters costs ``SHORT_COST``.

    The state after a place is where the last boundary is.  A unit is short or not by that place
    alone, so of boundaries more than a short unit behind only the best history is kept.
    """
    scores = [0.0]  # of the best histories with the last boundary at the start or at places[i - 1]
    back = [0]
    far, live = None, [0]  # best history of far boundaries; near ones, which may still make a unit short
    where = [0, *(p for p, _ in places)]
    for i, (p, odds) in enumerate(places):
        near = []
        for k in live:
            if len(block[where[k] : p].strip()) >= SHORT:
                if far is None or scores[k] > scores[far]:
                    far = k
            else:
                near.append(k)
        live = near
        score, k = max([(scores[k] - SHORT_COST, -k) for k in live] + ([(scores[far], -far)] if far is not None else []))
        scores.append(score + odds if odds > -20 else -1e9)
        back.append(-k)
        live.append(i + 1)
    k = max(range(len(scores)), key=lambda j: (scores[j], -j))
    out = []
    while k:
        out.append(where[k])
        k = back[k]
    return out[::-1]


def block_ends(block: str, model: Boundaries) -> list[int]:
    """Ends of the units of one block without outer space."""
    places = []
    for x in candidates(block):
        odds = float(model.mark[x.mark]) + model.right_of(x.right, x.thai)
        if x.left:
            odds += model.left_of(x.left, x.thai)
        places.append((x.place, odds))
    return [*(decode(block, places) if places else ()), len(block)]


def sentence_ends(text: str | None, model: Boundaries) -> list[int]:
    """Places right after the last character of each unit of a text."""
    out: list[int] = []
    for at, block, row in _text_blocks(text or ""):
        out += [at + len(block)] if row else [at + p for p in block_ends(block, model)]
    return out


def split_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, end_pos): one row for each sentence unit."""
    model = documents.sparkSession.sparkContext.broadcast(train(documents))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model.value
        for pdf in batches:
            rows = [(i, e) for i, t in zip(pdf["doc_id"], pdf["text"]) for e in sentence_ends(t, m)]
            yield pd.DataFrame(rows, columns=["doc_id", "end_pos"])

    return documents.select("doc_id", "text").filter("doc_id IS NOT NULL AND length(text) > 0").mapInPandas(run, "doc_id long, end_pos int")


def sentence_texts(documents: DataFrame) -> DataFrame:
    """(doc_id, sentence_no, sentence): the text of each unit."""
    model = documents.sparkSession.sparkContext.broadcast(train(documents))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model.value
        for pdf in batches:
            rows = []
            for i, t in zip(pdf["doc_id"], pdf["text"]):
                at = 0
                for n, e in enumerate(sentence_ends(t, m)):
                    rows.append((i, n, re.sub(r"\s+", " ", t[at:e]).strip()))
                    at = e
            yield pd.DataFrame(rows, columns=["doc_id", "sentence_no", "sentence"])

    return documents.select("doc_id", "text").filter("doc_id IS NOT NULL AND length(text) > 0").mapInPandas(run, "doc_id long, sentence_no int, sentence string")
