"""Languages of texts and of their parts, by error-correcting output codes.

Each language has a codeword of ``BITS`` bits.  For each bit a binary classifier over hashed
character n-grams tells the languages whose bit is set from the others (log ratios of smoothed
n-gram frequencies, learned from documents whose language is known, at most ``PER_LANGUAGE`` of
each language: a bounded sample, a fifth of which is held out to weigh the bits).  A sentence is decoded to the codeword of least weighted
loss, bits weighted by how well they separate the training texts; neighbouring sentences are
smoothed by Viterbi with a cost of switching; each run of sentences of one language is a part
with its place in the text; the confidence is the share of the best codeword among all, and ties
or small margins are flagged as ambiguous.

Defined cases: null, empty and too short texts have no language, and come out as one row without
it; damaged UTF-8 is read as what it was, but places are those of the text as given; runs of a
language that is too short to count in its text come out and are marked; repeated rows count
once; texts are read whole.
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

from lakepost.llm.mojibake import _utf8_chain
from lakepost.llm.furniture import _CLOSING, _DEVICE, _FROM, _HEAD, _RULE, _SEPARATOR, _WROTE, _notice, strip_quote
from lakepost.session import cut

LANGUAGES = ["pl", "en", "de", "fr", "es", "pt", "it", "cs", "nl", "sv", "uk", "ru", "ja"]
BITS = 31
WIDTH = 1 << 15
PER_LANGUAGE = 500
SLOTS = 1 << 30
LEAST, LEAST_JA = 45, 15
SWITCH = 5.0
# Spellings of language names in labels, besides codes with regions.
SPELLINGS = {
    "pl": "pl pol polish polski polnisch", "en": "en eng english englisch angielski", "de": "de deu ger german deutsch niemiecki", "fr": "fr fra fre french français francais", "es": "es spa spanish español espanol castellano",
    "pt": "pt por portuguese português portugues", "it": "it ita italian italiano", "cs": "cs ces cze cz czech čeština cesky česky", "nl": "nl nld dut dutch nederlands", "sv": "sv swe swedish svenska", "uk": "uk ukr ua ukrainian українська",
    "ru": "ru rus russian русский", "ja": "ja jpn jp japanese 日本語",
}
LABEL_OF = {s: lang for lang, names in SPELLINGS.items() for s in names.split()}
_WORDS = regex.compile(r"[\p{Hiragana}\p{Katakana}\p{Han}ー]+|[\p{L}\p{M}’']+")
_CJK = regex.compile(r"[\p{Hiragana}\p{Katakana}\p{Han}ー]")
_SPLIT = regex.compile(r"(?<=[.!?…][”“\"’»)]?)\s+(?=[\p{Lu}\p{N}¿¡„“«\"‘])|(?<=[。！？」])")
_COUNTED = regex.compile(r"[\p{L} ,.'’-]+")
_WIDE = re.compile(r"\S*[\u0080-￿]\S*")
_ADDRESS = re.compile(r"\S+@\S+|\w+://[!-~]+")
_HYPHEN = re.compile(r"(?<=\w)-\n(?=[^\W\d_])")
_RETURN = re.compile("\r")
_DAMAGE = re.compile("[ÂÃÄÅĂĹÐÑРС├┼√≈ƒ][\u0080-¿‐-›€™Œœ–—˜ˆ‚„…†‡‰ŠšŽžŸ„ȚĄŁąłĽľ°±-¿ѓЃЂђ]")


def label_language(label: str | None) -> str | None:
    """Language that a label names, in whatever spelling, or null."""
    if not label or not label.strip():
        return None
    t = label.strip().lower()
    return LABEL_OF.get(t) or LABEL_OF.get(re.split(r"[-_ ]", t)[0] if re.fullmatch(r"[a-z]{2,3}[-_][a-z]{2,4}", t) else "")


def codewords(seed: int = 5) -> np.ndarray:
    """One row of +-1 for each language; rows differ in as many bits as a short search finds."""
    best, far = None, -1
    for s in range(200):
        m = np.where(np.random.default_rng(seed + s).random((len(LANGUAGES), BITS)) < 0.5, -1, 1)
        gaps = [(m[i] != m[j]).sum() for i in range(len(m)) for j in range(i)]
        if min(gaps) > far and all(2 <= (m[:, b] > 0).sum() <= len(m) - 2 for b in range(BITS)):
            best, far = m, min(gaps)
    return best


def pieces(text: str) -> list[str]:
    """Words; runs of Han and kana in pairs of characters."""
    out = []
    for w in _WORDS.findall(text):
        if _CJK.match(w):
            out += [w[i : i + 2] for i in range(max(1, len(w) - 1))]
        else:
            out.append(w.lower())
    return out


def grams(word: str) -> list[int]:
    w = f"^{word}$"
    return [xxhash.xxh32_intdigest(w[i : i + n]) & (WIDTH - 1) for n in (2, 3, 4) for i in range(len(w) - n + 1)] + [xxhash.xxh32_intdigest(w) & (WIDTH - 1)]


class Model:
    """Bit classifiers: ``weights`` WIDTH x BITS, ``code`` languages x BITS, ``trust`` BITS."""

    def __init__(self, weights: np.ndarray, code: np.ndarray, trust: np.ndarray) -> None:
        self.weights, self.code, self.trust = weights, code, trust
        self.index: dict[str, int] = {}
        self.rows: list[np.ndarray] = []

    def __getstate__(self):
        return {"weights": self.weights, "code": self.code, "trust": self.trust, "index": {}, "rows": []}

    def bits(self, text: str) -> tuple[np.ndarray, int]:
        """Margins of the bit classifiers over a text and its number of pieces."""
        total, n = np.zeros(BITS, np.float32), 0
        if len(self.index) > 200_000:
            self.index, self.rows = {}, []
        for w in pieces(text):
            k = self.index.get(w)
            if k is None:
                k = self.index[w] = len(self.rows)
                self.rows.append(self.weights[grams(w)].sum(axis=0))
            total = total + self.rows[k]
            n += 1
        return total, n

    def scores(self, text: str) -> np.ndarray:
        """Negative weighted loss of each codeword; differences grow with the evidence."""
        f, n = self.bits(text)
        if not n:
            return np.zeros(len(LANGUAGES))
        return self.losses(f[None, :])[0]

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Scores of each row of margins; a bit has one loss if it is set and one if it isn't."""
        one, zero = np.logaddexp(0, -margins / 4), np.logaddexp(0, margins / 4)
        return -(one @ ((self.code > 0) * self.trust).T + zero @ ((self.code < 0) * self.trust).T) * (12.0 / BITS)

    def all_scores(self, texts: list[str]) -> np.ndarray:
        """Scores of each text, one row each."""
        got = [self.bits(t) for t in texts]
        out = self.losses(np.array([f for f, _ in got]))
        out[[n == 0 for _, n in got]] = 0.0
        return out


def labelled_sample(documents: DataFrame, per_language: int) -> pd.DataFrame:
    """(lang, text) of about ``per_language`` documents of each language, those of the least hashes: two scans, a bounded result."""
    h = F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS))
    known = documents.filter(F.col("lang").isin(LANGUAGES))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most 13 rows
    # twice as many as are wanted, for short texts are left out
    bound = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(SLOTS, 2 * per_language * SLOTS // n + 1))) for k, n in counts.items()], F.lit(0))
    got = known.select("lang", "text", h.alias("h")).filter((F.col("h") < bound) & (F.length("text") > 30)).toPandas()
    return got.sort_values(["lang", "h", "text"], kind="stable").groupby("lang").head(per_language)


def train(documents: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Fit the bit classifiers on at most ``per_language`` documents of each language; a fifth of them is held out to weigh the bits."""
    got = labelled_sample(documents, per_language)
    held = got.groupby("lang").cumcount() % 5 == 4
    counts = np.zeros((len(LANGUAGES), WIDTH), np.float64)
    for lang, text in zip(got["lang"][~held], got["text"][~held]):
        row = counts[LANGUAGES.index(lang)]
        for w, n in Counter(pieces(text)).items():
            np.add.at(row, grams(w), min(n, 3))
    code = codewords()
    share = (np.minimum(counts, 400) + 0.02) / (np.minimum(counts, 400) + 0.02).sum(axis=1, keepdims=True)
    weights = np.zeros((WIDTH, BITS), np.float32)
    seen = counts.sum(axis=0) > 0
    for b in range(BITS):
        one, zero = share[code[:, b] > 0].mean(axis=0), share[code[:, b] < 0].mean(axis=0)
        weights[:, b] = np.where(seen, np.clip(np.log(one / zero), -4, 4), 0)
    model = Model(weights, code, np.ones(BITS))
    right, n = np.zeros(BITS), 0
    for lang, text in zip(got["lang"][held], got["text"][held]):
        right += np.sign(model.bits(text)[0]) == code[LANGUAGES.index(lang)]
        n += 1
    rate = np.clip((right + 1) / (n + 2), 0.51, 0.999)
    trust = np.log(rate / (1 - rate))
    return Model(weights, code, trust / trust.mean())


#: Start and end after, start and end before, of each replacement in a text.
Edits = list[tuple[int, int, int, int]]


def replaced(pattern: re.Pattern, to, text: str) -> tuple[str, Edits]:
    """``pattern.sub(to, text)`` and its replacements."""
    out, edits, at, size = [], [], 0, 0
    for m in pattern.finditer(text):
        new = to(m) if callable(to) else to
        out += (text[at : m.start()], new)
        size += m.start() - at
        edits.append((size, size + len(new), *m.span()))
        size, at = size + len(new), m.end()
    return "".join([*out, text[at:]]), edits


def before(edits: Edits, start: int, end: int) -> tuple[int, int]:
    """Where a piece of the changed text stood before; what was replaced counts whole."""
    if not edits:
        return start, end

    def back(p: int, side: int) -> int:
        k = bisect_right(edits, p, key=lambda e: e[0]) - 1
        if k < 0:
            return p + side
        _, b, a0, b0 = edits[k]
        return (a0, b0)[side] if p < b else p - b + b0 + side

    return back(start, 0), back(end - 1, 1)


def mended(text: str) -> tuple[str, Edits]:
    """Text with words of UTF-8 read as another charset put right, and the replacements."""
    if text.isascii() or not _DAMAGE.search(text):
        return text, []

    def fix(m: re.Match) -> str:
        for dec in ("cp1252", "cp1250", "cp1251", "iso8859-2", "cp437", "cp852", "mac_roman"):
            got = _utf8_chain(m[0], dec)
            if got is not None and got[1] and got[2] <= got[1] // 3:
                again = _utf8_chain(got[0], dec)
                return again[0] if again is not None and again[1] and not again[2] else got[0]
        return m[0]

    return replaced(_WIDE, fix, text)


def running_text(text: str) -> list[tuple[str, int, int]]:
    """(sentence, start, end) of the running text: without greetings, signatures, notices, headers and page headers."""
    out: list[tuple[str, int, int]] = []
    held: list[tuple[str, int]] = []
    closed = 0

    def flush() -> None:
        nonlocal held
        if held:
            changed = [replaced(_ADDRESS, " ", x) if "@" in x or "://" in x else (x, []) for x, _ in held]
            firsts = [0]
            for x, _ in changed:
                firsts.append(firsts[-1] + len(x) + 1)
            joined, hyphens = replaced(_HYPHEN, "", "\n".join(x for x, _ in changed))
            joined = joined.replace("\n", " ")

            def place(p: int, side: int) -> int:
                """Place in the text of the start (0) or end (1) of the character p of what is joined."""
                p = before(hyphens, p, p + 1)[0]
                k = bisect_right(firsts, p) - 1
                return at_end(held[k][1] + before(changed[k][1], p - firsts[k], p - firsts[k] + 1)[side], side)

            at = 0
            for s in _SPLIT.split(joined):
                if s and (s := s.strip()):
                    at = joined.index(s, at)
                    out.append((s, place(at, 0), place(at + len(s) - 1, 1)))
                    at += len(s)
        held = []

    def at_end(p: int, side: int) -> int:
        return before(returns, p, p + 1)[0] if side == 0 else before(returns, p - 1, p)[1]

    text, returns = replaced(_RETURN, "", text) if "\r" in text else (text, [])
    lines = text.split("\n")
    following = 0
    for i, raw in enumerate(lines):
        line = strip_quote(raw).strip()
        start, following = following + len(raw.rstrip()) - len(line), following + len(raw) + 1
        if not line or _RULE.match(line):
            flush()
            if line:
                closed = 4
            continue
        ends = line.endswith((".", "!", "?", "…", "。", "！", "？", "”", "»", "“", ")"))
        if _CLOSING.match(line) and len(line) < 60:
            flush()
            closed = 6
            continue
        if _DEVICE.match(line) or _notice(line) or _SEPARATOR.match(line) or _FROM.match(line) and len(line) < 120 and not ends:
            flush()
            if _notice(line):
                closed = 99
            continue
        if (line.endswith((":", "：")) and (_WROTE.search(line) and (re.search(r"\d", line) or "@" in line))) or re.search(r"<\S+@\S+>|\[mailto", line):
            flush()
            closed = 0
            continue
        if _HEAD.match(line) and not ends and len(line) < 110 and re.match(r"^\W*\w+\W{1,3}:?", line) and (re.search(r"\d{4}|@", line) or i and _HEAD.match(strip_quote(lines[i - 1]).strip() or "")):
            flush()
            closed = 0
            continue
        if closed and closed < 99 and len(line) < 50 and not ends and not held:
            closed -= 1
            continue
        if closed == 99 and held == [] and len(line) > 0:
            prev = strip_quote(lines[i - 1]).strip() if i else ""
            if prev:
                continue
            closed = 0
        if not held and len(line) < 40 and not ends and (line.endswith((",", ":", "！", "!")) or i + 1 >= len(lines) or not strip_quote(lines[i + 1]).strip()):
            continue
        held.append((line, start))
        closed = 0
    flush()
    return out


def languages(text: str, model: Model) -> list[tuple[str, int, float, bool]]:
    """(language, characters, confidence, ambiguous) of a text, the most frequent first."""
    return read(text, model)[0]


def read(text: str, model: Model) -> tuple[list[tuple[str, int, float, bool]], list[tuple[int, int, str, int, float, bool]]]:
    """Languages of a text, and (start, end, language, characters, confidence, ambiguous) of each run of sentences of one language."""
    clean, edits = mended(text)
    placed = running_text(clean)
    if not placed:
        return [], []
    sentences = [s for s, _, _ in placed]
    emit = model.all_scores(sentences)
    back = np.zeros(emit.shape, int)
    best = emit[0].copy()
    for i in range(1, len(emit)):
        stay, jump = best, best.max() - SWITCH
        back[i] = np.where(stay >= jump, np.arange(len(LANGUAGES)), best.argmax())
        best = np.maximum(stay, jump) + emit[i]
    path = [int(best.argmax())]
    for i in range(len(emit) - 1, 0, -1):
        path.append(int(back[i][path[-1]]))
    path.reverse()
    sizes = [len("".join((_CJK if LANGUAGES[k] == "ja" else _COUNTED).findall(s))) for k, s in zip(path, sentences)]
    runs = []
    first = 0
    for i in range(1, len(path) + 1):
        if i == len(path) or path[i] != path[first]:
            conf = _share(emit[first:i].sum(axis=0), path[first])
            runs.append((*before(edits, placed[first][1], placed[i - 1][2]), LANGUAGES[path[first]], sum(sizes[first:i]), conf, conf < 0.8))
            first = i
    size: Counter[int] = Counter()
    evidence: dict[int, np.ndarray] = {}
    for k, n, e in zip(path, sizes, emit):
        size[k] += n
        evidence[k] = evidence.get(k, 0) + e
    total = sum(size.values())
    out = []
    for k, n in size.most_common():
        lang = LANGUAGES[k]
        if n < (LEAST_JA if lang == "ja" else LEAST) and not (len(size) == 1 and n >= 20):
            continue
        conf = _share(evidence[k], k)
        out.append((lang, n, conf, conf < 0.8))
    return out if out or total < 30 else [(LANGUAGES[size.most_common(1)[0][0]], total, 0.5, True)], runs


def _share(evidence: np.ndarray, k: int) -> float:
    p = np.exp(np.clip(evidence - evidence[k], -50, 50))
    return float(p[k] / p.sum())


def item_texts(mails: DataFrame, segments: DataFrame) -> DataFrame:
    """(item_kind, item_key, text) of every mail and segment."""
    return mails.select(F.lit("mail").alias("item_kind"), F.col("entry_id").alias("item_key"), F.col("body").alias("text")).unionByName(
        segments.select(F.lit("segment").alias("item_kind"), F.col("segment_id").cast("string").alias("item_key"), F.col("clean_text").alias("text"))
    )


def labelled_texts(labels: DataFrame, mails: DataFrame, segments: DataFrame, how: str = "left") -> DataFrame:
    """Every item with the set of its labels, null without any; ``how`` = "inner" for those of ``labels`` alone."""
    wanted = labels.groupBy("item_kind", "item_key").agg(F.collect_set(F.coalesce(F.trim("label"), F.lit(""))).alias("labels"))
    return item_texts(mails, segments).filter("item_key IS NOT NULL").join(wanted, ["item_kind", "item_key"], how)


def assign_languages(items: DataFrame, documents: DataFrame) -> DataFrame:
    """One row for each run of sentences of one language of each item, and one without language for items that have none.

    ``start_pos`` and ``end_pos`` are places in the text, ``chars`` and ``confidence`` those of the
    run; ``item_lang`` and ``item_confidence`` are the main language of the item, ``counts`` whether
    the run's language reaches the least size in its item, ``wrong`` whether the item has no label, a
    wrong one or several languages.
    """
    model = items.sparkSession.sparkContext.broadcast(train(documents))
    columns = ["item_kind", "item_key", "start_pos", "end_pos", "lang", "chars", "confidence", "ambiguous", "main", "counts", "item_lang", "item_confidence", "wrong"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model.value
        for pdf in batches:
            rows = []
            for kind, key, text, labels in zip(pdf["item_kind"], pdf["item_key"], pdf["text"], pdf["labels"]):
                found, runs = read(text, m) if text else ([], [])
                wrong = bool(found) and (len(found) > 1 or labels is None or any(label_language(x) != found[0][0] for x in labels))
                main, sure = (found[0][0], found[0][2]) if found else (None, None)
                known = {f[0] for f in found}
                rows += [(kind, key, a, b, lang, n, conf, amb, lang == main, lang in known, main, sure, wrong) for a, b, lang, n, conf, amb in runs] or [(kind, key, None, None, None, None, None, None, None, None, None, None, wrong)]
            frame = pd.DataFrame(rows, columns=columns, dtype=object)
            yield frame.astype({"start_pos": "Int32", "end_pos": "Int32", "chars": "Int32", "confidence": "Float64", "item_confidence": "Float64"})

    schema = "item_kind string, item_key string, start_pos int, end_pos int, lang string, chars int, confidence double, ambiguous boolean, main boolean, counts boolean, item_lang string, item_confidence double, wrong boolean"
    return items.select("item_kind", "item_key", "text", "labels").mapInPandas(run, schema)
