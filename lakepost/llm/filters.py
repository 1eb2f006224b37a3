"""Bit filters of a set of words, sized by the number of words.

``BITS_EACH`` bits and ``HASHES`` places for each word keep the rate of words that are in by chance
at ``(1 - exp(-HASHES / BITS_EACH)) ** HASHES`` = 0.24 %, at any size of the set.  A filter only spares
work: what it lets pass is looked up exactly where that matters.  Beyond ``MOST_BITS`` (64 MB) it
grows no more and lets more pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame

BITS_EACH, HASHES = 16, 4
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 29
CHUNK = 1 << 16  # bytes


class BitFilter:
    def __init__(self, bits: np.ndarray) -> None:
        self.bits, self.mask = bits, len(bits) * 8 - 1

    def __contains__(self, word: str) -> bool:
        h = xxhash.xxh3_64_intdigest(word)
        bits, mask = self.bits, self.mask
        for k in range(HASHES):
            p = (h + k * (h >> 32)) & mask
            if not bits[p >> 3] >> (p & 7) & 1:
                return False
        return True


def places(word: str, mask: int) -> list[int]:
    h = xxhash.xxh3_64_intdigest(word)
    return [(h + k * (h >> 32)) & mask for k in range(HASHES)]


def filter_of(words: list[str]) -> BitFilter:
    """A filter of words at hand."""
    size = _size(len(words))
    bits = np.zeros(size // 8, np.uint8)
    for w in words:
        for p in places(w, size - 1):
            bits[p >> 3] |= 1 << (p & 7)
    return BitFilter(bits)


def _size(n: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, 1 << max(0, n * BITS_EACH - 1).bit_length()))


def build_filter(words: DataFrame, column: str) -> BitFilter:
    """The filter of the distinct words of a column, put together in the tasks by chunks."""
    size = _size(words.count())

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for pdf in batches:
            for w in pdf[column]:
                for p in places(w, size - 1):
                    byte = p >> 3
                    got = held.get(byte // CHUNK)
                    if got is None:
                        got = held[byte // CHUNK] = np.zeros(CHUNK, np.uint8)
                    got[byte % CHUNK] |= 1 << (p & 7)
        if held:
            yield pd.DataFrame({"chunk": list(held), "bits": [b.tobytes() for b in held.values()]})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(CHUNK, np.uint8)
        for b in pdf["bits"]:
            out |= np.frombuffer(b, np.uint8)
        return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "bits": [out.tobytes()]})

    schema = "chunk long, bits binary"
    rows = words.select(column).mapInPandas(part, schema).groupBy("chunk").applyInPandas(merge, schema).collect()
    bits = np.zeros(size // 8, np.uint8)
    for r in rows:
        at = r["chunk"] * CHUNK
        b = np.frombuffer(r["bits"], np.uint8)
        bits[at : at + CHUNK] = b[: max(0, min(CHUNK, len(bits) - at))]
    return BitFilter(bits)
