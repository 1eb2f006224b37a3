"""Word statistics of the corpus: exact counts as a table, letters as a model of one size.

Counts stay distributed: who wants the counts of words joins them (``with_counts``), so nothing
grows on the driver or in the tasks.  Only the model of letters is sent around: counts of character
trigrams of lower-case words in ``TRIGRAMS`` and ``BIGRAMS`` hashed places, 9 MB at any corpus size;
alphabetic scripts have far fewer trigrams than places.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRIGRAMS, BIGRAMS = 1 << 20, 1 << 17
#: Counts of a task are handed on when it holds so many distinct words.
FLUSH = 200_000

TOKEN = re.compile(r"[0-9A-Za-z?\u0080-\U0010ffff]+")


def word_counts(df: DataFrame, columns: list[str], words: Callable[[str], tuple[list[str], list[str]]]) -> DataFrame:
    """(word, n) over all texts of the columns; ``words`` gives the words of a text, and words that aren't met but asked for (n = 0)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c: Counter[str] = Counter()
        for pdf in batches:
            for col in columns:
                for t in pdf[col]:
                    if t:
                        met, asked = words(t)
                        c.update(met)
                        for w in asked:
                            c.setdefault(w, 0)
            if len(c) > FLUSH:
                yield _frame(c)
                c = Counter()
        if c:
            yield _frame(c)

    return df.select(*columns).mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _frame(c: Counter) -> pd.DataFrame:
    return pd.DataFrame({"word": list(c), "n": list(c.values())})


def _third(three: str) -> int:
    return xxhash.xxh32_intdigest(three) & (TRIGRAMS - 1)


def _second(two: str) -> int:
    return xxhash.xxh32_intdigest(two) & (BIGRAMS - 1)


class Letters:
    """Probabilities of characters after the two before them, and counts of a few known keys.

    ``known`` maps keys to exact counts: those that one word's judgement asks for; ``top`` is the count of
    the most frequent word, ``total`` that of all words.
    """

    def __init__(self, tri: np.ndarray, bi: np.ndarray, known: dict[str, int] | None = None, top: int = 0, total: int = 0) -> None:
        self.tri, self.bi, self.known, self.top, self.total, self.logs = tri, bi, known or {}, top, total, {}

    def __getstate__(self):
        return {"tri": self.tri, "bi": self.bi, "known": {}, "top": self.top, "total": self.total, "logs": {}}

    def count(self, key: str) -> int:
        return self.known.get(key, 0)

    def letter(self, three: str) -> float:
        """Log probability of the third character after the first two."""
        got = self.logs.get(three)
        if got is None:
            if len(self.logs) > 300_000:
                self.logs.clear()
            got = self.logs[three] = math.log((self.tri[_third(three)] + 0.05) / (self.bi[_second(three[:2])] + 10.0))
        return got

    def letters(self, word: str) -> float:
        """Log probability of a word's characters by trigrams."""
        w = f"  {word.lower()} "
        return sum(self.letter(w[i : i + 3]) for i in range(len(w) - 2))

    def least_likely(self, word: str) -> float:
        w = f"  {word.lower()} "
        return min(self.letter(w[i : i + 3]) for i in range(len(w) - 2))


class Asking:
    """Stands for a model whose counts aren't known yet: notes every key that is asked for.

    The word's own keys count as if they were met very often and all others as if never, so that a
    judgement looks at all it may want to know.
    """

    def __init__(self, letters: Letters, own: set[str]) -> None:
        self._letters, self._own, self.asked, self.top = letters, own, set(own), 0
        self.letters, self.letter, self.least_likely = letters.letters, letters.letter, letters.least_likely

    def count(self, key: str) -> int:
        self.asked.add(key)
        return 1 << 40 if key in self._own else 0


def build_letters(counts: DataFrame, use: Callable[[str], str | None], least: int = 1) -> Letters:
    """Letters of ``use(word)`` of each word of ``counts`` with at least ``least`` occurrences (null: not used)."""

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part: Counter[int] = Counter()
        for pdf in batches:
            for word, n in zip(pdf["word"], pdf["n"]):
                if (bare := use(word)) is None:
                    continue
                w = f"  {bare.lower()} "
                for i in range(len(w) - 2):
                    part[_third(w[i : i + 3])] += n
                    part[TRIGRAMS + _second(w[i : i + 2])] += n
        if part:
            yield pd.DataFrame({"slot": list(part), "n": list(part.values())})

    # at most TRIGRAMS + BIGRAMS rows
    got = counts.filter(F.col("n") >= least).mapInPandas(fill, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    arr = np.zeros(TRIGRAMS + BIGRAMS, np.int64)
    arr[got["slot"].to_numpy()] = got["n"].to_numpy()
    return Letters(arr[:TRIGRAMS], arr[TRIGRAMS:])


def with_counts(asked: DataFrame, keys: DataFrame) -> DataFrame:
    """``asked`` (word, keys array<string>, ...) with ``known`` map<string, long>: the counts of its keys in ``keys`` (key, n)."""
    rest = [c for c in asked.columns if c not in ("word", "keys")]
    long = asked.select("word", *rest, F.explode("keys").alias("key")).join(keys, "key", "left")
    return long.groupBy("word", *rest).agg(F.map_from_entries(F.collect_list(F.when(F.col("n").isNotNull(), F.struct("key", "n")))).alias("known"))
