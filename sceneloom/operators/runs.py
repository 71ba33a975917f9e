"""Shared word runs of many prompts and many targets, without moving what they share.

Hits grow with the product of both sides, so none is shuffled, sorted or grouped. Targets are written once, as word
hashes. A task holds a block of prompts with an index of their windows and reads the written targets batch by batch:
what a block and a batch share is worked out where it is found. Disk grows with the texts alone, memory with the block and
the batch. Every task reads all targets, once for each of its blocks; that grows with the product too, at a few
hundredths of a microsecond for each word of the targets and block.

Words are told apart by 63-bit hashes; windows that meet by their hash are compared word by word. Keys are unique on
either side; null texts and texts under n words have no window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import materialise
from .windows import digests, padded, places

#: Words of prompts held at a time, texts read at a time, hits made at a time.
BLOCK, BATCH, HITS = 2_000_000, 4000, 200_000
_PROMPT_PAD, _TARGET_PAD = 0, 2
_NONE = np.zeros(0, np.int64)


class Block:
    """Texts with an index of their windows: sorted by hash, in classes of equal windows."""

    def __init__(self, keys: pa.Array, words: pa.Array, n: int):
        self.keys, self.n = keys, n
        self.w, self.starts, count = padded(words, _PROMPT_PAD)
        at, text = places(self.starts, count, n)
        for self.seed in range(1000):
            h = digests(self.w, at, n, self.seed)
            order = np.argsort(h, kind="stable")
            h, self.at, self.text = h[order], at[order], text[order].astype(np.int32)
            self.first = np.flatnonzero(np.concatenate([np.ones(min(1, len(h)), bool), h[1:] != h[:-1]]))
            self.size = np.diff(np.append(self.first, len(h)))
            least = np.repeat(self.at[self.first], self.size)
            if all((self.w[self.at + i] == self.w[least + i]).all() for i in range(n)):
                break  # else two windows have one hash, so that another seed is needed
        else:
            raise ValueError("no hash tells the windows apart")
        self.h = h[self.first]
        self.seen = np.zeros(1 << 24, bool)
        self.seen[self.h >> np.uint64(40)] = True

    def known(self, w: np.ndarray, starts: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place, text and class of every window of other texts that the block has."""
        at, text = places(starts, count, self.n)
        if not len(self.h) or not len(at):
            return _NONE, _NONE, _NONE
        h = digests(w, at, self.n, self.seed)
        maybe = np.flatnonzero(self.seen[h >> np.uint64(40)])
        h, at, text = h[maybe], at[maybe], text[maybe]
        k, same = _find(self.h, h)
        at, text, k = at[same], text[same], k[same]
        least = self.at[self.first[k]]
        same = np.ones(len(k), bool)
        for i in range(self.n):
            same &= w[at + i] == self.w[least + i]
        return at[same], text[same], k[same]

    def reach(self, most: np.ndarray, w: np.ndarray, at: np.ndarray, k: np.ndarray) -> None:
        """Raises ``most``, by text, to the longest run that begins at windows of the block and at known windows of others.

        Equal beginnings are one class, and a class is split by its next word where both sides have it: each word more
        costs what is left of the windows, not what they make together."""
        hit = np.zeros(len(self.first), bool)
        hit[k] = True
        mine = np.flatnonzero(np.repeat(hit, self.size))
        i, text, ci, length = self.at[mine], self.text[mine], np.repeat(np.arange(len(self.first)), self.size * hit), self.n
        while len(i):
            most[text] = np.maximum(most[text], length)
            a, b = self.w[i + length], w[at + length]
            goes, known = a != _PROMPT_PAD, b != _TARGET_PAD
            i, text, ci, a, at, k, b = i[goes], text[goes], ci[goes], a[goes], at[known], k[known], b[known]
            if not len(i):
                break
            words, word = np.unique(a, return_inverse=True)
            found, same = _find(words, b)
            at, b = at[same], k[same] * len(words) + found[same]
            classes, ci = np.unique(ci * len(words) + word, return_inverse=True)
            k, same = _find(classes, b)
            at, k = at[same], k[same]
            hit = np.zeros(len(classes), bool)
            hit[k] = True
            goes = hit[ci]
            i, text, ci, length = i[goes], text[goes], ci[goes], length + 1

    def by_text(self) -> tuple[np.ndarray, np.ndarray]:
        """The windows by text and class: text * classes + class, sorted, and the place of each."""
        code = self.text.astype(np.int64) * len(self.first) + np.repeat(np.arange(len(self.first)), self.size)
        order = np.argsort(code, kind="stable")
        return code[order], self.at[order]


def _find(known: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each x stands among the sorted known ones, of which there is one at least, and whether it does. Looked up in
    order, which is several times faster than here and there in memory."""
    order = np.argsort(x)
    k = np.empty(len(x), np.int64)
    k[order] = np.minimum(np.searchsorted(known, x[order]), len(known) - 1)
    return k, known[k] == x


def lengths(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """How many words agree from i and j on, where n do."""
    out = np.full(len(i), n, np.int32)
    alive, i, j = np.arange(len(i)), i + n, j + n
    while len(alive):
        same = a[i] == b[j]
        alive, i, j = alive[same], i[same] + 1, j[same] + 1
        out[alive] += 1
    return out


def _spans(first: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, element) for all elements first, first + 1, ... of each row, about ``HITS`` at a time."""
    ends, lo = np.cumsum(size), 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + HITS, "right")))
        row = np.repeat(np.arange(lo, hi), size[lo:hi])
        before = np.repeat(ends[lo:hi] - size[lo:hi], size[lo:hi])
        yield row, np.arange(len(row)) + (ends[lo - 1] if lo else 0) - before + first[row]
        lo = hi


def _blocks(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[Block]:
    kept: list[pa.RecordBatch] = []
    words = 0
    for whole in batches:
        for i in range(0, whole.num_rows, BATCH):
            b = whole.slice(i, BATCH)
            kept.append(b)
            words += pc.sum(pc.list_value_length(b.column(1))).as_py() or 0
            if words >= BLOCK:
                yield _block(kept, n)
                kept, words = [], 0
    if kept:
        yield _block(kept, n)


def _block(kept: list[pa.RecordBatch], n: int) -> Block:
    t = pa.Table.from_batches(kept).combine_chunks()
    return Block(*(pa.concat_arrays(c.chunks) for c in t.columns), n)


def _stored(files: list[str]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Key, hashes, beginnings and numbers of words of the written targets."""
    for uri in files:
        fs, path = pafs.FileSystem.from_uri(uri)
        with fs.open_input_file(path) as f:
            for b in pq.ParquetFile(f).iter_batches(BATCH):
                yield b.column(0), *padded(b.column(1), _TARGET_PAD)


def _hashed(df: DataFrame, key: str, words: Column) -> DataFrame:
    return df.select(key, F.transform(words, lambda x: F.xxhash64(x)).alias("w"))


def _by_blocks(prompts: DataFrame, key: str, words: Column, targets: DataFrame, target_key: str, target_words: Column, n: int, schema: str, of: Callable[[Block, list[str]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """What ``of`` makes of each block of prompts and the files of the targets."""
    spark = prompts.sparkSession
    files = list(materialise(_hashed(targets, target_key, target_words), "targets").inputFiles())
    blocks = _hashed(prompts, key, words).repartition(spark.sparkContext.defaultParallelism, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, n):
            yield from of(block, files)

    return blocks.mapInArrow(run, schema)


def matches(prompts: DataFrame, prompt_key: str, prompt_words: Column, targets: DataFrame, target_key: str, target_words: Column, n: int = 4) -> DataFrame:
    """The rows of ``overlap.matches``."""

    def of(block: Block, files: list[str]) -> Iterator[pa.RecordBatch]:
        for keys, w, starts, count in _stored(files):
            at, text, k = block.known(w, starts, count)
            for row, x in _spans(block.first[k], block.size[k]):
                i, j, p, t = block.at[x], at[row], block.text[x], text[row]
                columns = [(i - block.starts[p]).astype(np.int32), (j - starts[t]).astype(np.int32), lengths(block.w, i, w, j, n)]
                yield pa.RecordBatch.from_arrays([block.keys.take(pa.array(p)), keys.take(pa.array(t)), *map(pa.array, columns)], [prompt_key, target_key, "pos", "target_pos", "length"])

    schema = f"`{prompt_key}` string, `{target_key}` string, pos int, target_pos int, length int"
    return _by_blocks(prompts, prompt_key, prompt_words, targets, target_key, target_words, n, schema, of)


def longest(prompts: DataFrame, prompt_key: str, prompt_words: Column, targets: DataFrame, target_key: str, target_words: Column, n: int = 4, fail_at: int = 6) -> DataFrame:
    """The rows of ``overlap.longest`` for these matches, of which none is made but those of a prompt with its own target."""

    def of(block: Block, files: list[str]) -> Iterator[pa.RecordBatch]:
        most, own = np.zeros(len(block.keys), np.int32), np.zeros(len(block.keys), np.int32)
        codes, places_ = block.by_text()
        for keys, w, starts, count in _stored(files):
            at, text, k = block.known(w, starts, count)
            block.reach(most, w, at, k)
            p = pc.fill_null(pc.index_in(keys, value_set=block.keys), -1).to_numpy(zero_copy_only=False).astype(np.int64)[text]
            mine = p >= 0
            p, at, code = p[mine], at[mine], p[mine] * len(block.first) + k[mine]
            first = np.searchsorted(codes, code)
            for row, x in _spans(first, np.searchsorted(codes, code, "right") - first):
                np.maximum.at(own, p[row], lengths(block.w, places_[x], w, at[row], n))
        yield pa.RecordBatch.from_arrays([block.keys, pa.array(most), pa.array(own), pa.array(most < fail_at)], [prompt_key, "longest_any", "longest_own", "passes"])

    schema = f"`{prompt_key}` string, longest_any int, longest_own int, passes boolean"
    return _by_blocks(prompts, prompt_key, prompt_words, targets, target_key, target_words, n, schema, of)
