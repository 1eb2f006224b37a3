"""Byte-level BPE encoding by a tokenization automaton.

The merges of a public vocabulary are compiled into a deterministic automaton over token
arcs.  Merge gadget of the rule (u, v) -> w: wherever u is followed by v, that path is taken
out and an arc w is put in its place, so after u the automaton is in a state without the arc
v.  After all gadgets a state is told by the token read last, and the arc from state a to
token b survives exactly if no gadget of a rule inside a or b, in order of priority, joins
the end of a with the start of b.  Arcs are compiled when first met and kept in a table;
labels of the arcs are the ids.  A word has exactly one path: for each prefix the table gives
the one token that ends it, found from the trie of reversed tokens.  Decoding emits the bytes
of the arc labels.

Defined cases: null and empty texts have the empty list; strings of special tokens are
ordinary text; texts of any length are encoded whole.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.json"
# Fixed value: the public pre-splitting pattern of this vocabulary.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEMO = 400_000


def _byte_letters() -> dict[str, int]:
    """The public printable stand-ins of the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    extra = 0
    for b in range(256):
        if b not in plain:
            out[chr(256 + extra)] = b
            extra += 1
    return out


class TokenAutomaton:
    """Automaton of one vocabulary; arcs and words are compiled on first use."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = _byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.id_of = {raw(s): i for s, i in model["vocab"].items() if all(c in letters for c in s)}
        self.label = {i: b for b, i in self.id_of.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.order = {}
        for r, m in enumerate(model["merges"]):
            u, v = m.split(" ") if isinstance(m, str) else m
            a, b = self.id_of[raw(u)], self.id_of[raw(v)]
            w = self.id_of[raw(u + v)]
            self.rank[(a, b)] = r
            if w not in self.halves:
                self.halves[w] = (a, b)
                self.order[w] = r
        self.trie: dict[int, int] = {}
        self.ends: dict[int, int] = {}
        nodes = 1
        for token, i in self.id_of.items():
            if len(token) > 1 and i not in self.halves:
                continue  # no gadget makes it
            at = 0
            for byte in reversed(token):
                step = at * 256 + byte
                if (nxt := self.trie.get(step)) is None:
                    nxt = self.trie[step] = nodes
                    nodes += 1
                at = nxt
            self.ends[at] = i
        self.arcs: dict[tuple[int, int], bool] = {}
        self.words: dict[str, list[int]] = {}

    def arc(self, a: int, b: int) -> bool:
        """Whether the arc b leaves state a."""
        if (known := self.arcs.get((a, b))) is not None:
            return known
        x, y, bound, alive = a, b, 1 << 30, True
        while True:
            r = self.rank.get((x, y))
            if r is not None and r < bound:
                alive = False
                break
            ox, oy = self.order.get(x, -1), self.order.get(y, -1)
            if ox < 0 and oy < 0:
                break
            # undo the younger of the two outer merges; of equal ones the right one, as words merge from the left
            if ox > oy:
                bound, x = ox, self.halves[x][1]
            else:
                bound, y = oy + 1, self.halves[y][0]
        if len(self.arcs) > MEMO:
            self.arcs.clear()
        self.arcs[(a, b)] = alive
        return alive

    def encode_word(self, word: str) -> list[int]:
        if (known := self.words.get(word)) is not None:
            return known
        data = word.encode("utf-8")
        n = len(data)
        last, back = [-1] * (n + 1), [0] * (n + 1)
        trie, ends, arc = self.trie, self.ends, self.arc
        for end in range(1, n + 1):
            at, p = 0, end
            found = []
            while p:
                nxt = trie.get(at * 256 + data[p - 1])
                if nxt is None:
                    break
                at, p = nxt, p - 1
                if at in ends:
                    found.append((ends[at], p))
            for token, start in reversed(found):
                if start == 0 or (last[start] >= 0 and arc(last[start], token)):
                    last[end], back[end] = token, start
                    break
        ids, at = [], n
        while at:
            ids.append(last[at])
            at = back[at]
        ids.reverse()
        if n <= 64:
            if len(self.words) > MEMO:
                self.words.clear()
            self.words[word] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        for word in _SPLIT.findall(text):
            out += self.encode_word(word)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(self.label[int(i)] for i in ids).decode("utf-8", errors="replace")


_SPLIT = regex.compile(WORDS)


@lru_cache(maxsize=4)
def automaton(folder: str = TOKENIZERS, name: str = VOCABULARY) -> TokenAutomaton:
    """The automaton of a vocabulary file, once for each Python worker."""
    return TokenAutomaton(os.path.join(folder, name))


def encode_column(text: Column, folder: str = TOKENIZERS, name: str = VOCABULARY) -> Column:
    @F.pandas_udf(ArrayType(IntegerType()))
    def encode(texts: pd.Series) -> pd.Series:
        a = automaton(folder, name)
        return pd.Series([a.encode(t) for t in texts])

    return encode(text)


def count_column(text: Column, folder: str = TOKENIZERS, name: str = VOCABULARY) -> Column:
    """Number of tokens, without sending the ids back."""

    @F.pandas_udf(IntegerType())
    def count(texts: pd.Series) -> pd.Series:
        a = automaton(folder, name)
        return pd.Series([len(a.encode(t)) for t in texts], dtype="int32")

    return count(text)


def decode_column(ids: Column, folder: str = TOKENIZERS, name: str = VOCABULARY) -> Column:
    @F.pandas_udf(StringType())
    def decode(rows: pd.Series) -> pd.Series:
        a = automaton(folder, name)
        return pd.Series([None if r is None else a.decode(r) for r in rows])

    return decode(ids)


def encode_documents(documents: DataFrame, folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids): one row for each row of documents, no shuffle."""
    return documents.select("doc_id", encode_column(F.col("text"), folder, name).alias("ids"))
