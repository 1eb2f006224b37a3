"""Text of scanned pages: label lines, repair words, reassemble paragraphs.

Lines of a page are labelled by a linear-chain model over the states header, page number, body,
footer and break (blank).  Emissions are log-odds of layout features: place on the page, whether
the line would have wrapped there, repetition of the folded line on other pages of the document
and in other documents, numbering, final punctuation, case.  Transitions let furniture stand
only above and below the body; Viterbi gives the labels.

Misread characters: a word that the corpus hardly knows and that becomes a well known word (or
one of far likelier letters) by undoing one or two confusions of shapes.  Words that confusions
turn into each other have the same strokes, so each distinct word is judged among the words of its
strokes, with exact counts; pages' words pass a bit filter of the misread words and are joined with
them.  A cut word is a last word with a hyphen whose joint form the corpus knows better than the
compound; the counts of each distinct pair are joined.

Defined cases: null and empty texts have no lines; blank lines have no defect; a null page
number is replaced by the ordinal; repeated rows count once; texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakepost.llm.filters import BitFilter, build_filter
from lakepost.llm.lexicon import Letters, build_letters, with_counts, word_counts
from lakepost.session import cut

# What a scanner shows -> what stood there.
CONFUSIONS = [
    ("5", "s"), ("5", "S"), ("cl", "d"), ("c", "e"), ("e", "c"), ("9", "g"), ("9", "q"), ("rn", "m"), ("ri", "n"), ("1", "l"), ("1", "i"), ("1", "I"), ("l", "i"), ("i", "l"), ("I", "l"), ("l", "I"),
    ("@", "a"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("m", "rn"), ("0", "o"), ("0", "O"), ("O", "o"), ("ii", "u"), ("ii", "ü"), ("b", "h"), ("h", "b"), ("f", "t"), ("t", "f"), ("vv", "w"), ("8", "B"), ("6", "b"), ("6", "G"), ("2", "z"), ("2", "Z"),
    ("li", "h"), ("in", "m"), ("!", "l"), ("|", "l"), ("|", "I"), ("€", "e"), ("£", "E"), ("q", "g"), ("7", "T"), ("4", "A"), ("3", "e"), ("3", "з"), ("з", "3"), ("0", "о"),
    ("п", "л"), ("л", "п"), ("н", "и"), ("и", "н"), ("ш", "щ"), ("щ", "ш"), ("е", "с"), ("с", "е"), ("б", "6"), ("6", "б"), ("ц", "и"), ("ь", "ъ"), ("ii", "й"), ("ll", "U"), ("$", "S"), ("$", "ś"), ("$", "Ś"), ("q", "ą"), ("t", "ł"), ("é", "ć"), ("ć", "é"), ("d", "cl"), ("l", "ł"), ("9", "ą"), ("ó", "6"), ("¢", "c"), ("°", "o"),
]
#: Shapes that are one letter in the folded key of a line.
_FOLD = str.maketrans({c: r for r, cs in {"o": "oO0aAcCeEóòöáàäéèê@€", "l": "lL1iI!|tTfFjJíì", "s": "sS5$", "g": "gG9qQ", "n": "nNuUvVyYńü", "h": "hHbB68"}.items() for c in cs})
_ROMAN = r"(?=[ivxlcIVXLC])[ivxlcIVXLC]{1,7}"
_NUM = rf"(?P<n>[\dlIiOoSs|]{{1,4}}|{_ROMAN})"
_PAGE = re.compile(rf"[\W_]*(?:(?P<word>[^\W\d_]+)(?:\.\s*|\s+))?{_NUM}(?:\s*(?:/|\b(?:z|of|von|de|di|sur|av|van|из|з|ze)\b)\s*(?P<total>[\dlIiOoS]{{1,4}}))?[\W_]*")
# Words for page in page-number lines.
PAGE_WORDS = {"p", "pp", "pg", "page", "s", "str", "strona", "seite", "pagina", "página", "pág", "pag", "strana", "sida", "sid", "bladzijde", "blz", "страница", "стр", "с", "сторінка", "стор", "ページ"}
_TRAILING_NO = re.compile(r"\s{2,}\S{1,5}\s*$|^\s*\S{1,5}\s{2,}")
_END = tuple(".!?…:;,。！？»”\"“’)")
_WORD = re.compile(r"\S+")
_STRIP = "„“”‘’‚«»‹›\"'()[]{}<>.,;:!?…–—-•*/。、！？「」（）：¿¡"
EDGE = 2
#: Shares of all scanned documents from which a line at the edge is common furniture, or known.
COMMON, KNOWN = 0.02, 0.005
#: Strokes that letters are drawn with, lower case: what confusions turn into each other has the same ones.
STROKES = str.maketrans(
    {c: k for k, cs in {"i": "il1!|tfj7łríì", "ii": "nuühb6йбgq9ąóú8", "iii": "m", "ci": "d", "c": "ce€3зéć¢£", "s": "s5$ś", "o": "o0°о", "a": "a@4", "z": "z2", "v": "v", "vv": "w", "p": "пл", "N": "ниц", "W": "шщ", "E": "ес", "B": "ьъ"}.items() for c in cs}
    | {"ﬁ": "ii", "ﬂ": "ii", "ﬀ": "ii"}
)
#: Up to this share of all words a part of a cut word counts as no word of its own.
SELDOM = 1.2e-5
#: How often, at most, one and the same misreading of a word is met, as a share of the word itself.
RARE = 0.006
HEADER, PAGE, BODY, BLANK = "header", "page_number", "body", "break"


def words(text: str) -> list[str]:
    return [w for t in text.split() if len(w := t.strip(_STRIP)) >= 2 and (w.isalpha() or sum(map(str.isalpha, w)) >= 3)]


def strokes(word: str) -> str:
    return word.lower().translate(STROKES)


def page_words(text: str) -> tuple[list[str], list[str]]:
    """Words of a page, and the joint forms of words that may be cut at line ends."""
    joints = []
    if "-" in text or "‐" in text or "\xad" in text:
        lines = [x for x in text.split("\n") if x.strip()]
        for a, b in zip(lines, lines[1:]):
            if a.rstrip()[-1:] in "-‐\xad" and (head := cut_word(a)) is not None and (t := first_token(b)) is not None:
                joints.append(head + t[0])
    return words(text), joints


def fold(line: str) -> str:
    """Key of a line that misread characters and its page number don't change."""
    text = _TRAILING_NO.sub("", line.strip()) if len(line.strip()) > 6 else line.strip()
    text = text.replace("rn", "m").replace("cl", "d").replace("ri", "n").replace("ii", "u").replace("ﬁ", "fi")
    return re.sub(r"[\W_]+", "", text.translate(_FOLD).lower().translate(_FOLD))


def edges(text: str) -> list[str]:
    """Folded lines at the edges of a page."""
    lines = [x for x in text.split("\n") if x.strip()]
    return list({k for x in [*lines[: EDGE + 1], *lines[-EDGE - 1 :]] if 3 <= len(k := fold(x))})


def lex_distance(word: str) -> int:
    """Fewest letters in which a word differs from a word for page of its length."""
    return min((sum(a != b for a, b in zip(word, w)) for w in PAGE_WORDS if len(w) == len(word)), default=99)


def page_value(line: str) -> tuple[int, bool] | None:
    """(number, told by more than a bare number) of a line that may only tell the page."""
    m = _PAGE.fullmatch(line.strip())
    if m is None or len(line.strip()) > 32:
        return None
    if m["word"] and m["word"].lower() not in PAGE_WORDS and (not m["total"] or lex_distance(m["word"].lower()) > 2):
        return None
    if line.strip().endswith(".") and not m["word"]:
        return None
    n = m["n"].translate(str.maketrans("lIiOoSs|", "11100551")) if re.search(r"\d", m["n"]) or len(m["n"]) == 1 else m["n"]
    if n.isdigit():
        value = int(n)
    else:
        value, last = 0, 0
        for c in reversed(n.lower()):
            v = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}.get(c, 0)
            value, last = (value - v, last) if v < last else (value + v, v)
    return value, bool(m["word"] or m["total"] or re.search(r"[-\[(–—]", line))


def label_lines(text: str, ordinal: int, repeats: dict[str, tuple[int, float]]) -> list[str]:
    """Label of each line of a page; ``repeats`` has (pages of the document, share of all documents) of folded edge lines."""
    lines = text.split("\n")
    at = [i for i, x in enumerate(lines) if x.strip()]
    out = [BLANK] * len(lines)
    n = len(at)
    if not n:
        return out
    width = max(len(lines[i].strip()) for i in at)
    neg = -1e9
    # states: 0 header above, 1 number above, 2 body, 3 header below, 4 number below
    score = [[neg] * 5 for _ in range(n)]
    for j, i in enumerate(at):
        line = lines[i].strip()
        top, bottom = j <= EDGE, n - 1 - j <= EDGE
        score[j][2] = 0.0
        if not (top or bottom):
            continue
        if j == 0 or j == n - 1 or (top and j == 1) or (bottom and n - 2 == j):
            pv = page_value(line)
            if pv is not None:
                near = abs(pv[0] - (ordinal + 1)) <= 30
                p = 5.0 if near and (pv[1] or j in (0, n - 1)) else (1.0 if pv[1] and pv[0] < 2000 else -8.0)
                if j not in (0, n - 1):
                    p -= 2.0
                if top:
                    score[j][1] = p
                if bottom:
                    score[j][4] = p
        pages, docs = repeats.get(fold(line), (1, 0.0))
        base = -3.0 + (4.0 if pages >= 2 else 0.0) + (1.5 if pages >= 4 else 0.0) + (5.0 if docs >= COMMON else 3.5 if docs >= KNOWN else 0.0)
        base += 1.0 if not line.endswith(_END) else -5.0
        base += -4.0 if line[0].islower() else 0.0
        base += 1.0 if line.isupper() else 0.0
        if re.search(r"\s{3,}\S{1,5}$|^\S{1,5}\s{3,}", line):
            base += 4.0
        if line.endswith("-"):
            base -= 6.0
        if top and j + 1 < n:
            nxt = lines[at[j + 1]].split()
            broke = at[j + 1] > i + 1 or len(line) + 1 + len(nxt[0]) < width - 1
            score[j][0] = base + (2.0 if broke else -2.5) + (1.0 if len(line) < 0.7 * width else 0.0)
        if bottom and j > 0:
            apart = i > at[j - 1] + 1
            score[j][3] = base + (1.5 if apart else -0.5) + (0.5 if len(line) < 0.7 * width else -0.5 if pages > 1 or len(line) < 0.85 * width else -4.0)
    step = {0: (0, 1, 2), 1: (0, 1, 2), 2: (2, 3, 4), 3: (3, 4), 4: (3, 4)}
    cost = {(0, 0): -4.0, (1, 1): -6.0, (3, 3): -4.0, (4, 4): -6.0}
    best = [score[0][s] if s < 3 else (score[0][s] if n == 1 else neg) for s in range(5)]
    back = []
    for j in range(1, n):
        nxt, ptr = [neg] * 5, [0] * 5
        for a in range(5):
            if best[a] <= neg:
                continue
            for b in step[a]:
                v = best[a] + cost.get((a, b), 0.0) + score[j][b]
                if v > nxt[b]:
                    nxt[b], ptr[b] = v, a
        back.append(ptr)
        best = nxt
    s = max(range(5), key=lambda k: best[k])
    for j in range(n - 1, -1, -1):
        out[at[j]] = (HEADER, PAGE, BODY, HEADER, PAGE)[s]
        if j:
            s = back[j - 1][s]
    return out


def corrections(word: str) -> Iterator[str]:
    """Words that may have stood there: one confusion undone, then two."""
    once = []
    for shown, meant in CONFUSIONS:
        p = word.find(shown)
        while p >= 0:
            once.append(word[:p] + meant + word[p + len(shown) :])
            p = word.find(shown, p + 1)
    yield from once
    if any(c in word for c in "0123456789@ﬁﬂ|!$€£"):
        for w in once:
            for shown, meant in CONFUSIONS:
                p = w.find(shown)
                if p >= 0:
                    yield w[:p] + meant + w[p + len(shown) :]


_CODE = re.compile(r"[@/\\:_=#]|\.\w|^\W*\d|\d\W*$")
_ODD = re.compile(r"[0-9@|!$€£ﬁﬂﬀ]")


def misread_words(counts: DataFrame, letters) -> DataFrame:
    """(word, fixed) of the distinct words that have misread characters; ``letters`` is a broadcast model."""

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(strokes(w), w, n) for w, n in zip(pdf["word"], pdf["n"]) if sum(map(str.isalpha, w)) >= 3]
            yield pd.DataFrame(rows, columns=["strokes", "word", "n"])

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = letters.value
        for pdf in batches:
            rows = []
            for group in pdf["words"]:
                m.known = {"w:" + x["word"]: x["n"] for x in group}
                for x in group:
                    fixed = _corrected(x["word"], m)
                    if fixed is not None:
                        rows.append((x["word"], fixed))
            yield pd.DataFrame(rows, columns=["word", "fixed"])

    # a group holds the distinct words of one row of strokes
    groups = counts.mapInPandas(keyed, "strokes string, word string, n long").groupBy("strokes").agg(F.collect_list(F.struct("word", "n")).alias("words"))
    return groups.select("words").mapInPandas(judge, "word string, fixed string")


def _corrected(word: str, lex: Letters) -> str | None:
    odd = _ODD.search(word)
    letters = sum(c.isalpha() for c in word)
    if letters < 3 or (letters < len(word) - 3 and not odd):
        return None
    if "ﬁ" in word or "ﬂ" in word:
        return word.replace("ﬁ", "fi").replace("ﬂ", "fl")
    if odd and ("@" in word[1:-1] and "." in word or re.search(r"[/\\:_=#.]|\d.*\d|[A-Z]-?\d{2,}|^\d", word) and not re.fullmatch(r"[^\W\d]?[^\W\d]*[0-9@|!][^\W\d]{2,}", word)):
        return None
    seen = lex.count("w:" + word)
    if not odd and seen > 2 + RARE * lex.top:
        return None
    best, gain = None, 0.0
    for cand in corrections(word):
        if not all(c.isalpha() or c in "’'-" for c in cand):
            continue
        known = max(lex.count("w:" + cand), lex.count("w:" + cand.lower()) if cand[0].isupper() else 0)
        need = 15 if len(word) >= 5 else 40
        if known > gain and known >= (5 if len(word) >= 5 else 40) and (odd and known > seen or known >= need * seen and seen <= 2 + RARE * known):
            best, gain = cand, float(known)
    if best is not None:
        return best
    if odd and re.fullmatch(r"[^\W\d_]*[0-9@|!$][^\W\d_]*", word) and letters >= 3 and not re.fullmatch(r"[A-Z]+\d|\d[A-Z]+", word):
        cands = [c for c in corrections(word) if c.isalpha()]
        return max(cands, key=lex.letters) if cands else None
    if seen <= 2 and word.isalpha() and len(word) >= 6:
        here = lex.letters(word)
        for cand in corrections(word):
            if cand.isalpha():
                g = lex.letters(cand) - here
                if g > max(9.0, gain):
                    best, gain = cand, g
    return best


def cut_word(line: str) -> str | None:
    """The part of a word before a hyphen at the end of a line."""
    m = re.search(r"([^\W\d_][\w’']*|[^\W\d_])[-‐­]$", line.rstrip())
    return m[1] if m else None


def first_token(following: str) -> tuple[str, str] | None:
    """(word, all of it with what it is joined to by a hyphen) that a line begins with."""
    t = following.lstrip()
    m = re.match(r"\W*?([\w’']+)(-[\w’']+)?", t)
    return None if m is None or t[:1] not in m[0][:1] else (m[1], m[0])


def pair_keys(head: str, tail: str) -> list[str]:
    """The keys whose counts tell whether ``head`` goes on with ``tail``."""
    joint, compound = head + tail, f"{head}-{tail}"
    return sorted({"w:" + x for x in (joint, joint.lower(), compound, compound.lower(), head, tail)})


def goes_on(head: str, tail: str, lex: Letters, misread: bool = False) -> bool:
    """Whether a word cut after ``head`` goes on with ``tail``, and isn't a compound cut at its own hyphen.

    ``misread`` tells that the joint form is a misread word.
    """
    if not tail[0].isalpha():
        return tail[0] in "0159" and len(tail) > 1 and misread
    joint, compound = head + tail, f"{head}-{tail}"
    a = max(lex.count("w:" + joint), lex.count("w:" + joint.lower()))
    b = max(lex.count("w:" + compound), lex.count("w:" + compound.lower()))
    if a == b == 0:
        if tail[0].isupper():
            return head.isupper() and tail.isupper() and len(head) > 1 and lex.letters(joint) > lex.letters(head) + lex.letters(tail) + 6
        seldom = max(3.0, SELDOM * lex.total)
        return lex.count("w:" + head) < seldom or lex.count("w:" + tail) < seldom or lex.letters(joint) > lex.letters(head) + lex.letters(tail) - 4
    if tail[0].isupper() and not head.isupper():
        return a > 3 * b
    return a >= b


def ocr_segments(segments: DataFrame, documents: DataFrame) -> DataFrame:
    scanned = documents.filter("extractor_name = 'ocr'").select("document_id").distinct()
    return segments.join(scanned, "document_id", "left_semi")


def edge_repeats(pages: DataFrame) -> DataFrame:
    """(segment_id, keys array<struct<key, pages, docs>>): how often edge lines repeat."""

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(s, d, k) for s, d, t in zip(pdf["segment_id"], pdf["document_id"], pdf["raw_text"]) if t for k in edges(t)]
            yield pd.DataFrame(rows, columns=["segment_id", "document_id", "key"])

    each = cut(pages.select("segment_id", "document_id", "raw_text").mapInPandas(keys, "segment_id long, document_id long, key string").distinct())
    per_doc = each.groupBy("document_id", "key").agg(F.count(F.lit(1)).alias("pages"))
    per_key = per_doc.groupBy("key").agg(F.count(F.lit(1)).alias("docs")).filter("docs > 2")
    total = pages.agg(F.count_distinct("document_id").alias("all"))
    wide = each.join(per_doc, ["document_id", "key"]).join(per_key, "key", "left").join(F.broadcast(total))  # one row
    share = F.coalesce(F.col("docs") / F.col("all"), F.lit(0.0))
    return wide.withColumn("share", share).filter(F.expr("pages > 1") | (F.col("share") >= KNOWN)).groupBy("segment_id").agg(F.collect_set(F.struct("key", "pages", "share")).alias("keys"))


class Corpus:
    """What is learned of all segments' words: letters, counts, misread words."""

    def __init__(self, segments: DataFrame) -> None:
        spark = segments.sparkSession
        self.counts = cut(word_counts(segments, ["raw_text"], page_words))
        stat = self.counts.agg(F.max("n").alias("top"), F.sum("n").alias("total")).head()
        model = build_letters(self.counts, lambda w: w if w.isalpha() else None)
        model.top, model.total = stat["top"] or 0, stat["total"] or 0
        self.letters = spark.sparkContext.broadcast(model)
        self.misread = cut(misread_words(self.counts, self.letters))
        self.filter = spark.sparkContext.broadcast(build_filter(self.misread, "word"))
        self.keys = self.counts.select(F.concat(F.lit("w:"), "word").alias("key"), "n").filter("n > 0")

    def decide(self, pairs: DataFrame) -> DataFrame:
        """(head, tail, fixed) of the pairs (head, tail) that go on; ``fixed`` is the joint word without misread characters, if it has any."""
        keys = F.udf(pair_keys, "array<string>", useArrow=True)
        letters = self.letters

        def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            m = letters.value
            for pdf in batches:
                rows = []
                for h, t, known, fixed in zip(pdf["word"], pdf["tail"], pdf["known"], pdf["fixed"]):
                    m.known = dict(known) if known is not None else {}
                    if goes_on(h, t, m, fixed is not None):
                        rows.append((h, t, fixed))
                yield pd.DataFrame(rows, columns=["head", "tail", "fixed"], dtype=object)

        asked = pairs.select(F.col("head").alias("word"), "tail").distinct().withColumn("keys", keys("word", "tail"))
        counted = with_counts(asked, self.keys).withColumn("joint", F.concat("word", "tail"))
        fixes = self.misread.select(F.col("word").alias("joint"), "fixed")
        return counted.join(fixes, "joint", "left").select("word", "tail", "known", "fixed").mapInPandas(judge, "head string, tail string, fixed string")


_PAGE_SCHEMA = "segment_id long, document_id long, ordinal int, defects array<struct<line_no: int, defect: string>>, pairs array<struct<line: int, below: int, head: string, tail: string>>, odd array<struct<line: int, word: string, first: boolean, last: boolean>>, open_head string, first_token string, last_body int"


def _label_pages(misread):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: BitFilter = misread.value
        memo: dict[str, bool] = {}
        for pdf in batches:
            rows = []
            for seg, doc, ordinal, text, keys in zip(pdf["segment_id"], pdf["document_id"], pdf["ordinal"], pdf["raw_text"], pdf["keys"]):
                if not text:
                    continue
                repeats = {k["key"]: (k["pages"], k["share"]) for k in keys} if keys is not None else {}
                lines = text.split("\n")
                labels = label_lines(text, int(ordinal), repeats)
                body = [i for i, x in enumerate(labels) if x == BODY]
                defects = [{"line_no": i + 1, "defect": x} for i, x in enumerate(labels) if x in (HEADER, PAGE)]
                pairs, open_head = [], None
                for a, b in zip(body, [*body[1:], None]):
                    head = cut_word(lines[a])
                    if head is None:
                        continue
                    if b is None:
                        open_head = head
                    elif (t := first_token(lines[b])) is not None:
                        pairs.append({"line": a + 1, "below": b + 1, "head": head, "tail": t[0]})
                odd = []
                if len(memo) > 300_000:
                    memo.clear()
                for i in body:
                    parts = lines[i].split()
                    for j, p in enumerate(parts):
                        hit = memo.get(p)
                        if hit is None:
                            w = p.strip(_STRIP)
                            hit = memo[p] = len(w) >= 3 and w in known
                        if hit:
                            odd.append({"line": i + 1, "word": p.strip(_STRIP), "first": j == 0, "last": j == len(parts) - 1})
                lead = first_token(lines[body[0]]) if body else None
                rows.append((seg, doc, ordinal, defects, pairs, odd, open_head, lead[0] if lead else None, body[-1] + 1 if body else None))
            out = pd.DataFrame(rows, columns=["segment_id", "document_id", "ordinal", "defects", "pairs", "odd", "open_head", "first_token", "last_body"])
            out["last_body"] = out["last_body"].astype("Int32")
            yield out

    return run


def scanned_pages(segments: DataFrame, documents: DataFrame) -> DataFrame:
    return ocr_segments(segments, documents).select("segment_id", "document_id", "ordinal", "raw_text").filter("raw_text IS NOT NULL AND ordinal IS NOT NULL AND segment_id IS NOT NULL")


def labelled_pages(pages: DataFrame, corpus: Corpus) -> DataFrame:
    return cut(pages.join(edge_repeats(pages), "segment_id", "left").mapInPandas(_label_pages(corpus.filter), _PAGE_SCHEMA))


def joined_lines(labelled: DataFrame, corpus: Corpus) -> tuple[DataFrame, DataFrame]:
    """(pairs within pages, pairs over pages) that go on: (segment_id, line, below, head, tail, fixed); below is null over pages."""
    inner = labelled.select("segment_id", F.explode("pairs").alias("p")).select("segment_id", "p.*")
    heads = labelled.filter("open_head IS NOT NULL").select("segment_id", "document_id", (F.col("ordinal") + 1).alias("ordinal"), F.col("open_head").alias("head"), F.col("last_body").alias("line")).distinct()
    nexts = labelled.filter("first_token IS NOT NULL").groupBy("document_id", "ordinal").agg(F.max("first_token").alias("tail"))
    over = heads.join(nexts, ["document_id", "ordinal"])
    going = cut(corpus.decide(inner.select("head", "tail").unionByName(over.select("head", "tail"))))
    return inner.join(going, ["head", "tail"]).select("segment_id", "line", "below", "head", "tail", "fixed"), over.join(going, ["head", "tail"]).select("segment_id", "line", "head", "tail", "fixed")


def scan_defects(segments: DataFrame, documents: DataFrame) -> DataFrame:
    """(segment_id, line_no, defect) of scanned pages."""
    corpus = Corpus(segments)
    labelled = labelled_pages(scanned_pages(segments, documents), corpus)
    furniture = labelled.select("segment_id", F.explode("defects").alias("d")).select("segment_id", "d.line_no", "d.defect")
    joined, over = joined_lines(labelled, corpus)
    joined = cut(joined)
    line = lambda c: F.col(c).cast("int").alias("line_no")
    hyphens = joined.select("segment_id", line("line")).unionByName(over.select("segment_id", line("line"))).withColumn("defect", F.lit("hyphen"))
    # the ends of a cut word are no words of their own: the joint word is judged instead
    odd = labelled.select("segment_id", "last_body", "open_head", F.explode("odd").alias("o")).select("segment_id", "last_body", "open_head", "o.*").join(corpus.misread.select("word"), "word", "left_semi")
    odd = odd.filter(~(F.col("last") & (F.col("line") == F.col("last_body")) & F.col("open_head").isNotNull()))
    ends = joined.select("segment_id", "line", F.lit(True).alias("cut_last")).distinct()
    starts = joined.select("segment_id", F.col("below").alias("line"), F.lit(True).alias("cut_first")).distinct()
    whole = odd.join(ends, ["segment_id", "line"], "left").join(starts, ["segment_id", "line"], "left").filter("NOT (last AND coalesce(cut_last, false)) AND NOT (first AND coalesce(cut_first, false))")
    parted = joined.filter("fixed IS NOT NULL").select("segment_id", F.when(F.col("fixed").startswith(F.col("head")), F.col("below")).otherwise(F.col("line")).alias("line"))
    misread = whole.select("segment_id", line("line")).unionByName(parted.select("segment_id", line("line"))).withColumn("defect", F.lit("misread"))
    return furniture.unionByName(hyphens).unionByName(misread).distinct()


def _page_paragraphs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for doc, ordinal, text, defects, joins, fixes in zip(pdf["document_id"], pdf["ordinal"], pdf["raw_text"], pdf["defects"], pdf["joins"], pdf["fixes"]):
            lines = (text or "").split("\n")
            furniture = {d["line_no"] for d in defects} if defects is not None else set()
            going = {j["line"] for j in joins} if joins is not None else set()
            known = {f["word"]: f["fixed"] for f in fixes} if fixes is not None else {}
            body = [i for i, x in enumerate(lines) if x.strip() and i + 1 not in furniture]
            width = max((len(lines[i].strip()) for i in body), default=0)
            paragraphs: list[str] = []
            held, broke = "", True
            for j, i in enumerate(body):
                line = lines[i].strip()
                if broke and held:
                    paragraphs.append(held)
                    held = ""
                nxt = lines[body[j + 1]] if j + 1 < len(body) else None
                held = f"{held} {line}" if held and not held.endswith("\u00ad") else held.rstrip("\u00ad") + line
                if i + 1 in going:
                    held = held.rstrip("-‐\u00ad") + "\u00ad"
                blank = nxt is not None and body[j + 1] > i + 1
                short = nxt is not None and len(line) + 1 + len(nxt.split()[0]) < width - 1
                broke = line.endswith(_END) and (blank or short)
            if held:
                paragraphs.append(held)
            # a page begins a paragraph of its own unless its first letter goes on in lower case
            starts = bool(paragraphs) and (int(ordinal) == 0 or not paragraphs[0][:1].islower())
            fix = lambda t: t.replace(w, known[w]) if (w := t.strip(_STRIP)) in known else t
            paragraphs = [" ".join(fix(t) for t in p.replace("\u00ad", "").split()) for p in paragraphs]
            # only a page's first paragraph may go on from the page before, and only its last one on the next
            rows += [(doc, ordinal, n, bool(n or starts), n == len(paragraphs) - 1, p) for n, p in enumerate(paragraphs)]
        yield pd.DataFrame(rows, columns=["document_id", "ordinal", "piece", "starts", "last", "text"])


def scan_paragraphs(segments: DataFrame, documents: DataFrame) -> DataFrame:
    """(document_id, ordinal, paragraph_no, text): the continuous paragraphs of each scanned document.

    ``ordinal`` and ``paragraph_no`` are the page on which a paragraph begins and its number there.  A
    paragraph that goes on over pages is put together from its pieces; a piece that ends in a hyphen
    is joined without a space.  Only the first piece of a page can go on: which page a piece belongs to
    is found by doubling over pages, so no document is gathered, and only the pieces of one paragraph meet.
    """
    corpus = Corpus(segments)
    pages = scanned_pages(segments, documents)
    labelled = labelled_pages(pages, corpus)
    joined, _ = joined_lines(labelled, corpus)
    joins = joined.groupBy("segment_id").agg(F.collect_set(F.struct("line")).alias("joins"))
    odd = labelled.select("segment_id", F.explode("odd.word").alias("word")).distinct().join(corpus.misread, "word")
    joint = joined.filter("fixed IS NOT NULL").select("segment_id", F.concat("head", "tail").alias("word"), "fixed")
    fixes = odd.select("segment_id", "word", "fixed").unionByName(joint).groupBy("segment_id").agg(F.collect_set(F.struct("word", "fixed")).alias("fixes"))
    full = pages.join(labelled.select("segment_id", "defects").dropDuplicates(["segment_id"]), "segment_id", "left").join(joins, "segment_id", "left").join(fixes, "segment_id", "left")
    pieces = cut(full.select("document_id", "ordinal", "raw_text", "defects", "joins", "fixes").mapInPandas(_page_paragraphs, "document_id long, ordinal int, piece int, starts boolean, last boolean, text string").distinct())
    # a first piece that goes on hangs on the page before; pages of one piece hand on what hangs on them
    hang = pieces.filter("piece = 0 AND NOT starts").select("document_id", "ordinal", (F.col("ordinal") - 1).alias("to"), F.col("last").alias("through"))
    ends = pieces.filter("last").groupBy("document_id", F.col("ordinal").alias("to")).agg(F.max("piece").alias("to_piece"))
    chain = cut(hang.join(ends, ["document_id", "to"], "left").select("document_id", "ordinal", F.when(F.col("to_piece").isNotNull(), F.col("to")).alias("to"), F.col("to_piece")))
    for _ in range(40):
        up = chain.select("document_id", F.col("ordinal").alias("to"), F.lit(0).alias("to_piece"), F.col("to").alias("to2"), F.col("to_piece").alias("piece2"))
        step = chain.join(up, ["document_id", "to", "to_piece"], "left")
        if step.filter("to2 IS NOT NULL").isEmpty():
            break
        chain = cut(step.select("document_id", "ordinal", F.coalesce("to2", "to").alias("to"), F.coalesce("piece2", "to_piece").alias("to_piece")))
    placed = pieces.join(chain.withColumn("piece", F.lit(0)), ["document_id", "ordinal", "piece"], "left").select("document_id", F.coalesce("to", "ordinal").alias("at"), F.coalesce("to_piece", "piece").alias("no"), "ordinal", "piece", "text")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "piece", "text"))), lambda x: x["text"])
    whole = F.aggregate(parts, F.lit(""), lambda a, x: F.when(a == "", x).when(a.rlike("\\p{L}-$") & x.rlike("^\\p{Ll}"), F.concat(F.regexp_replace(a, "-$", ""), x)).otherwise(F.concat(a, F.lit(" "), x)))
    return placed.groupBy("document_id", "at", "no").agg(whole.alias("text")).select("document_id", F.col("at").alias("ordinal"), F.col("no").alias("paragraph_no"), "text")
