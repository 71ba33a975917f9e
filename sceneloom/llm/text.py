"""Normal forms shared by the operators: splits, bodies, words, white-space tokens, hashes."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the problems define it: space, tab, CR, LF, U+00A0.
WHITE = " \t\r\n\u00a0"
_TOKEN = re.compile(f"[^{WHITE}]+")
_WORD = re.compile(r"[^\W_]+")
_BLANK_LINE = re.compile(r"(?:\A|(?<=\n)|(?<=\r)(?!\n))[ \t\u00a0]*(?:\r\n|\n|\r)")

MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(MULT), -1, 1 << 64))


def trimmed(c: Column) -> Column:
    """``c`` without white space at both ends, lower-cased."""
    return F.lower(F.regexp_replace(c, f"^[{WHITE}]+|[{WHITE}]+$", ""))


def split_name(c: Column) -> Column:
    """train, validation or test; null for null, other names as they are (trimmed, lower-cased)."""
    s = trimmed(c)
    return F.when(s.isin("val", "dev"), F.lit("validation")).otherwise(s)


def body(text: str | None) -> str | None:
    """What follows the first blank line; null where there is none."""
    if text is None:
        return None
    m = _BLANK_LINE.search(text)
    return text[m.end() :] if m else None


def words(text: str | None) -> list[str]:
    """NFC, lower case, ß as ss; maximal runs of letters or digits."""
    return [] if text is None else _WORD.findall(unicodedata.normalize("NFC", text).lower().replace("ß", "ss"))


def tokens(text: str | None) -> list[str]:
    """Runs of anything but white space, unchanged."""
    return [] if text is None else _TOKEN.findall(text)


class TokenHashes(dict):
    """64-bit hashes of strings, kept by string. The store is emptied when it grows past ``most`` entries."""

    def __init__(self, most: int = 1_000_000):
        super().__init__()
        self.most = most

    def __missing__(self, s: str) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[s] = xxhash.xxh3_64_intdigest(s)
        return h

    def of(self, lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all lists, one after another, and each list's offset (one more than lists)."""
        offsets = np.zeros(len(lists) + 1, np.int64)
        np.cumsum([len(x) for x in lists], out=offsets[1:])
        flat = np.fromiter((h for x in lists for h in map(self.__getitem__, x)), np.uint64, offsets[-1])
        return flat, offsets


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the output."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Rolling:
    """Rolling hashes over a sequence of 64-bit hashes: the hash of any run [i, j) in constant time."""

    def __init__(self, h: np.ndarray):
        n = len(h)
        up = np.full(n + 1, MULT, np.uint64)
        down = np.full(n + 1, _INV, np.uint64)
        up[0] = down[0] = 1
        np.multiply.accumulate(up, out=up)
        np.multiply.accumulate(down, out=down)
        self.down = down
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(h * up[:n], out=self.sums[1:])

    def run(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The hash of [i, j): equal for equal runs, wherever they stand."""
        return mix((self.sums[j] - self.sums[i]) * self.down[i] + (j - i).astype(np.uint64))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a bounded number of rows, which bounds a worker's memory for word lists."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def text_key(parts: list[str]) -> bytes:
    """A 128-bit key of a list of words or tokens."""
    return xxhash.xxh3_128_digest("\x1f".join(parts))
