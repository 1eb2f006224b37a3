"""Text decoded with the wrong charset: find it and restore it.

A latent encoding chain (bytes of charset ``enc`` read as ``dec``, that twice, or a chain that
lost characters) is looked for behind each distinct word of the corpus, once.  The likelihood of a
word under a chain is that of the word before the chain, by exact corpus counts, which are joined,
and character trigrams.  Words of a value add up: the values' words pass a bit filter of the damaged
words and are joined with their chains; expectation-maximization over pools (store, field) learns how common each chain is in
a pool, so that weak evidence in one record is judged by the others of its source.  Values
whose posterior of any chain exceeds one half are damaged; they are repaired word by word by
the chain of the highest posterior, and characters that were lost stay as they are.

Defined cases: null and empty values are no cases; U+FFFD is always damage; equal rows count
once; texts of any length are read whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakepost.llm.filters import build_filter
from lakepost.llm.lexicon import TOKEN, Asking, Letters, build_letters, with_counts, word_counts
from lakepost.session import cut

# Charsets that chains are made of.
READ_AS = ["cp1252", "latin-1", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp437", "cp850", "cp852", "mac_roman", "cp866", "iso8859-15", "mac_latin2"]
WRITTEN_AS = ["cp1250", "iso8859-2", "cp852", "cp1252", "mac_roman", "mac_latin2", "cp1251", "koi8-r", "koi8-u", "cp866", "iso8859-5", "cp437", "cp850"]
EAST_ASIAN = ["shift_jis", "euc_jp", "gb18030", "euc_kr"]
LOST = "lost"
START_PRIOR = 0.01
SURE = 12.0
#: Longer tokens are judged in pieces, which share so many characters.
LONG, OVERLAP = 2000, 50
_EDGE = "„“”‘’‚«»‹›–—…¿¡。、！？「」（）：・?’'"
#: Characters that a word of one or two damaged letters may have had.
_PLAIN = re.compile("[ -~\xa0-\u017f\u0218-\u021b\u0370-\u045f\u0490\u0491\u2000-\u206f\u20ac\u2116\u2122\u3000-\u30ff\u4e00-\u9fff\uff00-\uffef\ufffd]*")
_CYRILLIC = re.compile("[\u0400-\u04ff]")
_LOST_C1 = set("ŚŹŤŽŠśźťžš")


_URL = re.compile(r"\w+://[!-~]+")
_URL_OR_TOKEN = re.compile(rf"{_URL.pattern}|{TOKEN.pattern}")


def tokens(text: str) -> list[str]:
    return TOKEN.findall(_URL.sub(" ", text) if "://" in text else text)


def pieces(token: str) -> list[str]:
    """A token, or where it is long the overlapping pieces it is judged by."""
    return [token] if len(token) <= LONG else [token[i : i + LONG] for i in range(0, len(token) - OVERLAP, LONG - OVERLAP)]


@lru_cache(maxsize=32)
def _bytes_of(charset: str) -> dict[str, int]:
    """Character -> byte of a charset; bytes without a character stand for the C1 control."""
    out = {}
    for b in range(256):
        try:
            out[bytes([b]).decode(charset)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    return out


def raw_bytes(word: str, charset: str) -> bytes | None:
    table = _bytes_of(charset)
    try:
        return bytes([table[c] for c in word])
    except KeyError:
        return None


def _collapse(masked: str) -> str:
    return re.sub(r"[?�]+", "?", masked)


def lossy_masks(word: str) -> list[str]:
    """What is left of a clean word after common losses, as sketch keys."""
    everything = "".join("?" if c > "\x7f" else c for c in word)
    western = "".join("?" if c > "\x7f" and c not in _bytes_of("cp1252") else c for c in word)
    c1 = "".join("?" if c in _LOST_C1 else c for c in word)
    out = set()
    for m in (everything, western, c1):
        if m != word:
            out.add("m:" + _collapse(m))
            if len(d := m.replace("?", "")) >= 3:
                out.add("d:" + d)
    return list(out)


def bare_word(word: str) -> str | None:
    """What of a word the letters are learned from; null for numbers and lossy words."""
    bare = word.strip(_EDGE)
    return bare if bare and not bare.isdigit() and "?" not in bare and "�" not in bare else None


def word_keys(word: str) -> list[str]:
    """Keys that a word is counted under: itself, and what is left of it after common losses."""
    bare = word.strip(_EDGE)
    keys = ["w:" + bare] if bare else []
    if not bare.isascii() and bare_word(word) is not None:
        keys += lossy_masks(bare)
    return keys


def _lettered(word: str) -> bool:
    return all(c.isalpha() or c in "’'-" or c.isdigit() or c in "ºª" for c in word)


def _utf8_chain(word: str, dec: str) -> tuple[str, int, int] | None:
    """(text, good, bad) if the word's bytes under ``dec`` hold UTF-8 sequences."""
    raw = raw_bytes(word, dec)
    if raw is None:
        return None
    text = raw.decode("utf-8", errors="replace")
    bad = text.count("�")
    good = sum(c > "\x7f" for c in text) - bad
    return (text, good, bad) if good or bad else None


#: How the first byte of two-byte UTF-8 letters looks in the charsets of READ_AS.
_UTF8_LEADS = set("ÂÃÄÅĂĹĽĆ├┼─√ƒ≈")


def _latin_frame(text: str) -> bool:
    return sum(c.isascii() and c.isalpha() for c in text) >= 3


def judge_word(word: str, lex: Letters) -> tuple[str, float, str] | None:
    """(chain, log likelihood ratio against clean, word before the chain), or null for a clean word."""
    bare = word.strip(_EDGE)
    if "�" in word:
        return LOST, SURE, word
    if word.isascii():
        return _judge_ascii(word, bare, lex)
    seen = lex.count("w:" + bare)
    best: tuple[str, float, str] | None = None
    for dec in READ_AS:
        got = _utf8_chain(word, dec)
        if got is None:
            continue
        text, good, bad = got
        if good == 0 and bad > 0:
            known = lex.count("m:" + _collapse(text).strip(_EDGE.replace("?", ""))) if bad <= 3 and _latin_frame(text) and set(word) & _UTF8_LEADS else 0
            if known > 8 and known > 4 * seen:
                best = max(best or (LOST, 0.0, word), (LOST, 7.0, word), key=lambda x: x[1])
            continue
        if good < 3 and not _PLAIN.fullmatch(text):
            continue
        if bad == 0:
            again = _utf8_chain(text, dec)
            twice = again is not None and again[2] == 0 and again[1] > 0
            before = again[0] if twice else text
            inner = before.strip(_EDGE)
            sure = good >= 3 or not inner or lex.count("w:" + inner) * 3 >= seen or lex.letters(inner) > lex.letters(bare) + 3
            ratio = SURE if sure else 2.0
            if best is None or ratio > best[1] or ratio == best[1] and before != best[2] and lex.letters(inner) > lex.letters(best[2].strip(_EDGE)):
                best = (f"utf-8>{dec}" + (">twice" if twice else ""), ratio, before)
        elif good >= 2 and bad <= good:
            if best is None or best[1] < 9.0:
                best = (f"utf-8>{dec}", 9.0, text)
        elif bad <= 2:
            known = lex.count("m:" + _collapse(text).strip("„“”‘’«»")) if _latin_frame(text) else 0
            if known > 8 and known > 4 * seen and (best is None or best[1] < 7.0):
                best = (f"utf-8>{dec}", 7.0, text)
    if best is not None and best[1] >= 7.0:
        return best
    dropped = lex.count("d:" + bare) if len(bare) >= 4 else 0
    if dropped > 20 * (seen + 1):
        cand = (LOST, 6.0, word)
        best = cand if best is None or best[1] < 6.0 else best
    symbol = not _lettered(bare)
    if len(bare) < 2:
        return best
    slavic = _CYRILLIC.search(bare) is not None
    if not symbol and lex.least_likely(bare) > -6.0:
        return best
    here = lex.letters(bare)
    for dec in READ_AS:
        raw = raw_bytes(bare, dec)
        if raw is None:
            continue
        for enc in WRITTEN_AS:
            if enc == dec:
                continue
            try:
                text = raw.decode(enc)
            except UnicodeDecodeError:
                continue
            if text == bare or not _lettered(text):
                continue
            n = lex.count("w:" + text)
            if seen >= 5 and seen > 0.3 * n:
                continue
            ratio = lex.letters(text) - here + (4.0 if n >= 5 and n >= 10 * (seen + 1) else 0.0) + (2.0 if symbol else 0.0) - 3.0
            if text != text.lower() and text[1:] != text[1:].lower() and bare[1:] == bare[1:].lower():
                ratio -= 4.0
            if slavic and len(bare) < 3:
                continue
            if ratio > 2.0 and (best is None or ratio > best[1]):
                best = (f"{enc}>{dec}", min(ratio, SURE), text)
    return best


def _judge_ascii(word: str, bare: str, lex: Letters) -> tuple[str, float, str] | None:
    if "?" in word.strip("?") or (word[0] == "?" and len(word) > 1):
        w = _collapse(word).rstrip("?") if not word.startswith("??") else _collapse(word)
        for key in {w, _collapse(word)}:
            if "?" in key and lex.count("m:" + key) >= 4:
                return LOST, 8.0, word
        inner = word.strip("?")
        if re.fullmatch(r"[A-Za-z]+\?[A-Za-z]+(\?[A-Za-z]+)*", inner) and inner.count("?") and not re.search(r"[a-z]\?[A-Z]", inner):
            return LOST, 5.0, word
        return None
    if len(bare) >= 4 and bare.isalpha():
        dropped = lex.count("d:" + bare)
        if dropped >= 30:
            seen = lex.count("w:" + bare)
            if dropped > 8 * seen:
                return LOST, 6.0 if len(bare) >= 5 else 3.0, word
    return None


_KANA = re.compile(r"[぀-ヿ]")
_HAN = re.compile(r"[一-鿿]")
_HIGH = re.compile(r"[\u0080-ÿŒ-ž–-›€™ˆ˜ƒ�]")


def judge_line(line: str) -> tuple[str, float, str] | None:
    """East Asian chains are judged over whole lines, for their bytes hold ASCII punctuation."""
    high = len(_HIGH.findall(line))
    if high < 4 or high < 0.25 * len(line) or _KANA.search(line):
        return None
    for dec in ("cp1252", "latin-1"):
        raw = raw_bytes(line, dec)
        if raw is None:
            continue
        for enc in EAST_ASIAN[:2]:
            text = raw.decode(enc, errors="ignore")
            east = len(_KANA.findall(text)) + len(_HAN.findall(text))
            if len(_KANA.findall(text)) >= 2 and east * 2.2 >= high:
                return f"{enc}>{dec}", SURE, raw.decode(enc, errors="replace")
    return None


def key_counts(counts: DataFrame) -> DataFrame:
    """(key, n) of all keys of words that are met at least twice."""

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, n) for w, n in zip(pdf["word"], pdf["n"]) for k in word_keys(w)]
            yield pd.DataFrame(rows, columns=["key", "n"])

    return counts.filter("n > 1").mapInPandas(keys, "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))


def judged_words(words: DataFrame, keys: DataFrame, letters) -> DataFrame:
    """(word, chain, llr, before) of the words that a chain explains better than clean text; ``letters`` is a broadcast model.

    First each word tells which counts it wants to know, then they are joined, then it is judged.
    """

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for w in pdf["word"]:
                bare = w.strip(_EDGE)
                plain = w.isascii() and "?" not in w
                if plain and not (len(bare) >= 4 and bare.isalpha()):
                    continue
                a = Asking(letters.value, {"w:" + bare})
                judge_word(w, a)
                # a plain word is judged only if it may be what is left of another
                rows.append((w, sorted(a.asked), plain))
            yield pd.DataFrame(rows, columns=["word", "keys", "plain"])

    asked = cut(words.select("word").mapInPandas(ask, "word string, keys array<string>, plain boolean"))
    left = keys.filter(F.col("key").startswith("d:")).select(F.substring("key", 3, 1 << 30).alias("word"))
    asked = asked.filter("NOT plain").unionByName(asked.filter("plain").join(left, "word", "left_semi").select(*asked.columns))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = letters.value
        for pdf in batches:
            rows = []
            for w, known in zip(pdf["word"], pdf["known"]):
                m.known = dict(known) if known is not None else {}
                got = judge_word(w, m)
                if got is not None:
                    rows.append((w, *got))
            yield pd.DataFrame(rows, columns=["word", "chain", "llr", "before"])

    return with_counts(asked.select("word", "keys"), keys).mapInPandas(judge, "word string, chain string, llr double, before string")


def value_pieces(value: str) -> set[str]:
    return {p for t in tokens(value) for p in pieces(t)}


def evidence(df: DataFrame, key: str, pool: str, fields: list[str], verdicts: DataFrame, damaged) -> DataFrame:
    """(key, pool, field, chain, llr): what speaks for each chain in each value; ``damaged`` is a broadcast filter of the words of ``verdicts``."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[str, bool] = {}
        known = damaged.value
        for pdf in batches:
            rows = []
            for f in fields:
                for k, p, v in zip(pdf[key], pdf[pool], pdf[f]):
                    if not v:
                        continue
                    for w in value_pieces(v):
                        got = memo.get(w)
                        if got is None:
                            if len(memo) > 400_000:
                                memo.clear()
                            got = memo[w] = w in known
                        if got:
                            rows.append((k, p, f, w, None, None))
                    if not v.isascii():
                        for line in v.split("\n"):
                            if not line.isascii() and (x := judge_line(line)) is not None:
                                rows.append((k, p, f, None, x[0], x[1]))
            yield pd.DataFrame(rows, columns=["key", "pool", "field", "word", "chain", "llr"]).astype({"llr": "Float64"})

    found = cut(df.select(key, pool, *fields).mapInPandas(scan, "key string, pool string, field string, word string, chain string, llr double").distinct())
    words = found.filter("word IS NOT NULL").select("key", "pool", "field", "word").join(verdicts.select("word", "chain", "llr"), "word").select("key", "pool", "field", "chain", "llr")
    lines = found.filter("chain IS NOT NULL").select("key", "pool", "field", "chain", "llr")
    return words.unionByName(lines).groupBy("key", "pool", "field", "chain").agg(F.sum("llr").alias("llr"))


def pooled_posterior(found: DataFrame, sizes: DataFrame, rounds: int = 3) -> DataFrame:
    """(key, field, chain, posterior): EM over the pools' chain frequencies.

    ``sizes`` has (pool, field, n), the number of values of each pool.  The chain tables of the
    pools are small: pools x fields x chains.
    """
    prior = None
    for _ in range(rounds):
        rows = found if prior is None else found.join(prior, ["pool", "field", "chain"], "left")
        p = F.lit(START_PRIOR) if prior is None else F.coalesce("prior", F.lit(START_PRIOR))
        rows = rows.withColumn("odds", F.exp(F.least("llr", F.lit(30.0))) * p / (1 - p))
        total = rows.groupBy("key", "pool", "field").agg(F.sum("odds").alias("all"))
        posterior = rows.drop("prior").join(total, ["key", "pool", "field"]).withColumn("posterior", F.col("odds") / (1 + F.col("all")))
        prior = (
            posterior.groupBy("pool", "field", "chain")
            .agg(F.sum("posterior").alias("mass"))
            .join(sizes, ["pool", "field"])
            .select("pool", "field", "chain", F.greatest(F.lit(0.006), F.least(F.lit(0.3), (F.col("mass") + 0.5) / (F.col("n") + 50.0))).alias("prior"))
        )
        prior = cut(prior)
    return posterior.select("key", "field", "chain", "posterior")


class Corpus:
    """What is learned of a table's words: letters, counts of keys, damaged words."""

    def __init__(self, mails: DataFrame, fields: list[str]) -> None:
        counts = cut(word_counts(mails, fields, lambda t: ([p for x in tokens(t) for p in pieces(x)], [])))
        self.letters = mails.sparkSession.sparkContext.broadcast(build_letters(counts, bare_word, least=2))
        self.keys = cut(key_counts(counts))
        self.verdicts = cut(judged_words(counts, self.keys, self.letters))
        self.damaged = mails.sparkSession.sparkContext.broadcast(build_filter(self.verdicts, "word"))


def chain_posteriors(mails: DataFrame, key: str, pool: str, fields: list[str], corpus: Corpus) -> DataFrame:
    """(key, field, chain, posterior) of the chains that anything speaks for."""
    rows = mails.select(key, F.coalesce(pool, F.lit("")).alias(pool), *fields).filter(F.col(key).isNotNull())
    found = cut(evidence(rows, key, pool, fields, corpus.verdicts, corpus.damaged))
    sizes = rows.groupBy(F.col(pool).alias("pool")).agg(F.count(F.lit(1)).alias("n")).select("pool", "n", F.explode(F.array(*[F.lit(f) for f in fields])).alias("field"))
    return pooled_posterior(found, sizes)


def damaged_values(mails: DataFrame, key: str = "entry_id", pool: str = "store_id", fields: tuple[str, ...] = ("subject", "body", "sender_name")) -> DataFrame:
    """(entry_id, field, chain, posterior) of the values that hold damaged text."""
    fields = list(fields)
    best = chain_posteriors(mails, key, pool, fields, Corpus(mails, fields)).groupBy("key", "field").agg(F.sum("posterior").alias("posterior"), F.max_by("chain", "posterior").alias("chain"))
    return best.filter("posterior > 0.5").select(F.col("key").alias(key), "field", "chain", "posterior")


def repaired_values(mails: DataFrame, key: str = "entry_id", pool: str = "store_id", fields: tuple[str, ...] = ("subject", "body", "sender_name")) -> DataFrame:
    """(entry_id, fields): every mail, the values that hold damaged text with their original text where it can be regained."""
    fields = list(fields)
    corpus = Corpus(mails, fields)
    chains = chain_posteriors(mails, key, pool, fields, corpus).groupBy("key", "field", "chain").agg(F.max("posterior").alias("posterior"))
    chains = cut(chains.groupBy("key", "field").agg(F.map_from_entries(F.collect_list(F.struct("chain", "posterior"))).alias("chains"), F.sum("posterior").alias("all")).filter("all > 0.5").select("key", "field", "chains"))
    long = mails.select(F.col(key).alias("key"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])).alias("x")).select("key", "x.field", "x.value").filter("length(value) > 0").distinct()
    broken = cut(long.join(chains, ["key", "field"]))
    options = cut(word_options(broken, corpus))
    # each value's words with what they may have been
    words = broken.select("key", "field", "value", F.explode(_words_of("value")).alias("word"))
    of_value = words.join(options, "word").groupBy("key", "field", "value").agg(F.map_from_entries(F.collect_list(F.struct("word", "options"))).alias("options"))
    letters = corpus.letters

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["repaired"] = [repair_by(v, dict(c), dict(o) if o is not None else {}, letters.value) for v, c, o in zip(pdf["value"], pdf["chains"], pdf["options"])]
            yield pdf[["key", "field", "value", "repaired"]]

    fixed = broken.join(of_value, ["key", "field", "value"], "left").select("key", "field", "value", "chains", "options").mapInPandas(run, "key string, field string, value string, repaired string")
    out = mails.select(key, *fields).distinct()
    for f in fields:
        mine = fixed.filter(F.col("field") == f).select(F.col("key").alias(key), F.col("value").alias(f), "repaired")
        out = out.join(mine, [key, f], "left").withColumn(f, F.coalesce("repaired", f)).drop("repaired")
    return out.select(key, *fields)


def _words_of(column: str):
    """The words of values that a chain may stand behind."""

    @F.pandas_udf("array<string>")
    def words(values: pd.Series) -> pd.Series:
        return values.map(lambda v: sorted({m[0] for m in _URL_OR_TOKEN.finditer(v) if not m[0].isascii() and "://" not in m[0]}))

    return words(column)


def word_options(broken: DataFrame, corpus: Corpus) -> DataFrame:
    """(word, options array<struct<chain, llr, before>>): what each word of damaged values (value, chains) may have been under their chains."""
    pairs = broken.select(F.explode(_words_of("value")).alias("word"), F.map_keys("chains").alias("chains"))
    pairs = pairs.select("word", F.explode("chains").alias("chain")).filter(~F.col("chain").isin(LOST) & ~F.split_part("chain", F.lit(">"), F.lit(1)).isin(EAST_ASIAN)).distinct()
    letters = corpus.letters

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for w, c in zip(pdf["word"], pdf["chain"]):
                a = Asking(letters.value, {"w:" + w.strip(_EDGE)})
                under_chain(w, c, a)
                rows.append((w, c, sorted(a.asked)))
            yield pd.DataFrame(rows, columns=["word", "chain", "keys"])

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = letters.value
        for pdf in batches:
            rows = []
            for w, c, known in zip(pdf["word"], pdf["chain"], pdf["known"]):
                m.known = dict(known) if known is not None else {}
                got = under_chain(w, c, m)
                if got is not None:
                    rows.append((w, c, *got))
            yield pd.DataFrame(rows, columns=["word", "chain", "llr", "before"])

    asked = pairs.mapInPandas(ask, "word string, chain string, keys array<string>")
    got = with_counts(asked, corpus.keys).mapInPandas(judge, "word string, chain string, llr double, before string")
    return got.groupBy("word").agg(F.collect_list(F.struct("chain", "llr", "before")).alias("options"))


def _read_utf8(word: str, dec: str) -> str:
    """The word's bytes under ``dec`` read as UTF-8; characters that are no UTF-8 stay as they are."""
    chars = {b: c for c, b in _bytes_of(dec).items()}
    text = raw_bytes(word, dec).decode("utf-8", errors="surrogateescape")
    return "".join(chars[ord(c) - 0xDC00] if "\udc80" <= c <= "\udcff" else c for c in text)


def under_chain(word: str, chain: str, lex: Letters) -> tuple[float, str] | None:
    """(log likelihood ratio against clean, word before the chain) of one chain, or null where it explains nothing."""
    enc, dec, *again = chain.split(">")
    if enc == "utf-8":
        got = _utf8_chain(word, dec)
        if got is not None and again:
            got = _utf8_chain(got[0], dec) if got[2] == 0 else None
        if got is None or got[1] == 0 or got[2] > got[1] or got[1] < 3 and not _PLAIN.fullmatch(got[0]):
            return None
        text = _read_utf8(word, dec)
        text = _read_utf8(text, dec) if again else text
        inner, bare = text.strip(_EDGE), word.strip(_EDGE)
        n, seen = lex.count("w:" + inner), lex.count("w:" + bare)
        sure = got[1] >= 3 or not inner or n * 3 >= seen or lex.letters(inner) > lex.letters(bare) + 3
        # read once more is better, if that is possible
        return (SURE if sure else 2.0) + (1.0 if again else 0.0) - got[2], text
    bare = word.strip(_EDGE)
    raw = raw_bytes(bare, dec)
    if raw is None or len(bare) < 2:
        return None
    try:
        text = raw.decode(enc)
    except UnicodeDecodeError:
        return None
    seen, n = lex.count("w:" + bare), lex.count("w:" + text)
    if text == bare or not _lettered(text) or seen >= 5 and seen > 0.3 * n:
        return None
    ratio = lex.letters(text) - lex.letters(bare) + (4.0 if n >= 5 and n >= 10 * (seen + 1) else 0.0) + (2.0 if not _lettered(bare) else 0.0) - 3.0
    if text != text.lower() and text[1:] != text[1:].lower() and bare[1:] == bare[1:].lower():
        ratio -= 4.0
    k = word.index(bare)
    return min(ratio, SURE), word[:k] + text + word[k + len(bare) :]


def repair_by(value: str, chains: dict[str, float], options: dict, letters: Letters) -> str:
    """A damaged value with each word as it was before the chain that explains it best, by the chains' posteriors in the value.

    ``options`` are the words' readings under chains (chain, llr, before).  A chain of little or no
    posterior counts with the prior of any chain, for parts of a value may be damaged in another
    way; what no chain explains better than clean text stays.
    """
    weight = {c: math.log(max(p, START_PRIOR)) for c, p in chains.items() if c != LOST}

    def word_before(w: str) -> str:
        fit = [(o["llr"] + weight[o["chain"]] + letters.letters(o["before"]), o["before"]) for o in options.get(w, ()) if o["chain"] in weight and o["llr"] + weight[o["chain"]] > 0]
        return max(fit)[1] if fit else w

    lines = []
    for line in value.split("\n"):
        v = judge_line(line) if not line.isascii() else None
        lines.append(v[2] if v is not None and v[0] in weight else _URL_OR_TOKEN.sub(lambda m: m[0] if m[0].isascii() or "://" in m[0] else word_before(m[0]), line))
    return "\n".join(lines)
