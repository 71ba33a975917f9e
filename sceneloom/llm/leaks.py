"""Problem 6: passages of held-out items inside training documents.

The documents' words go into a positional inverted index: documents are taken in blocks, and for each block and term
the index stores the sorted places of the term in the block (documents one after another with a gap between them). The
index is a table in the shared folder and may be kept for further queries.

A held-out passage is asked for by its rarest terms: windows of ``least`` words with the same rarest word are one piece,
which is sent only to the blocks that hold this word. There its list, shifted by the word's offset, is intersected with
the shifted lists of the words around it, and what is left with ``least`` words in a row is an exact phrase match. A
proximity match lacks at most ``least - near`` words of a window, so that one of the ``least - near + 1`` rarest is there:
passages are sent to the blocks that hold one of these, several of the rarest words must stand near their offsets there,
and then all words are counted that do.

Scale: a block is indexed where its documents are read and no text is shuffled; only the lists of query terms move, and
only those of blocks that are asked, to one task a block, whose size ``block_rows`` and ``block_words`` bound. Held-out
items are tables like the others, in chunks of about ``query_bytes`` of text that meet a block one by one, so that
neither the driver nor a task holds them all.

Defined results: null and blank texts or passages hold nothing; a passage under ``least`` words can't leak; copies of a
document are rows of their own; a case leaks once a document however often it stands there; repeated case rows count
once; an empty table on either side gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialise
from .text import body, words


@dataclass(frozen=True)
class Params:
    """least: words of an exact passage; near, slack: a proximity match holds at least ``near`` of a window's ``least``
    words at most ``slack`` words from their offsets; block_rows, block_words: bounds of an index block; query_bytes: text of
    the held-out items of a chunk, about."""

    least: int = 13
    near: int = 10
    slack: int = 2
    block_rows: int = 20_000
    block_words: int = 2_000_000
    query_bytes: int = 8_000_000


_INDEX = "block string, term string, n int, places binary"
#: The term under which a block's documents are stored: their first places, and their ids.
DOCS = ""


def _block(name: str, ids: list[int], texts: list[list[str]], gap: int) -> pa.RecordBatch:
    """The postings of a block: places as 32-bit differences, which compress well."""
    numbers: dict[str, int] = {}
    sizes = np.array([len(x) for x in texts], np.int64)
    begin = np.concatenate(([0], np.cumsum(sizes + gap)))[:-1]
    n = int(sizes.sum())
    flat = np.fromiter((numbers.setdefault(w, len(numbers)) for x in texts for w in x), np.int32, n)
    place = np.arange(n, dtype=np.int64) + np.repeat(np.arange(len(texts)) * gap, sizes)
    order = np.argsort(flat, kind="stable")
    counts = np.bincount(flat, minlength=len(numbers))
    ends = np.cumsum(counts)
    place = place[order].astype(np.int32)
    steps = np.diff(place, prepend=np.int32(0))
    first = ends - counts
    steps[first] = place[first]
    raw = steps.tobytes()
    stored = [raw[4 * (e - c) : 4 * e] for c, e in zip(counts.tolist(), ends.tolist())]
    names = [DOCS, *numbers]
    docs = begin.astype(np.int64).tobytes() + np.array(ids, np.int64).tobytes()
    return pa.RecordBatch.from_arrays(
        [pa.array([name] * len(names)), pa.array(names), pa.array([len(ids), *counts.tolist()], pa.int32()), pa.array([docs, *stored], pa.binary())], names=["block", "term", "n", "places"]
    )


def index(df: DataFrame, p: Params = Params()) -> DataFrame:
    """The positional index of doc_id, text as a written table: block, term, n, places."""
    gap = p.least + p.slack + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        ids: list[int] = []
        texts: list[list[str]] = []
        held = 0
        for b in batches:
            for i, x in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                w = words(x)
                if not w:
                    continue
                if texts and (len(texts) >= p.block_rows or held + len(w) > p.block_words):
                    yield _block(f"{part}-{number}", ids, texts, gap)
                    ids, texts, held, number = [], [], 0, number + 1
                ids.append(i)
                texts.append(w)
                held += len(w)
        if texts:
            yield _block(f"{part}-{number}", ids, texts, gap)

    rows = df.select("doc_id", "text").where("doc_id is not null and text is not null")
    return materialise(rows.mapInArrow(run, _INDEX), "p6-index")


class Postings:
    """The lists of one block."""

    def __init__(self, rows: pd.DataFrame):
        docs = rows.loc[rows["term"] == DOCS, "places"].iloc[0]
        half = len(docs) // 2
        self.begin, self.ids = np.frombuffer(docs[:half], np.int64), np.frombuffer(docs[half:], np.int64)
        self.lists = {t: np.cumsum(np.frombuffer(x, np.int32), dtype=np.int64) for t, x in zip(rows["term"], rows["places"]) if t != DOCS}

    def doc(self, places: np.ndarray) -> np.ndarray:
        return self.ids[np.searchsorted(self.begin, places, "right") - 1]

    def within(self, places: np.ndarray, term: str, slack: int = 0) -> np.ndarray:
        """For each place, whether the term stands there, or at most ``slack`` from it."""
        x = self.lists[term]
        k = np.searchsorted(x, places - slack)
        k[k == len(x)] = len(x) - 1
        return (x[k] >= places - slack) & (x[k] <= places + slack)

    def around(self, x: list[str], at: int, least: int) -> np.ndarray:
        """Places of the word x[at] from which at least ``least`` words of x, this one among them, stand in a row."""
        here = self.lists.get(x[at])
        if here is None:
            return np.zeros(0, np.int64)
        length = np.ones(len(here), np.int64)
        for step, stop in ((1, len(x)), (-1, -1)):
            alive = np.arange(len(here))
            for k in range(at + step, stop, step):
                if x[k] not in self.lists or not len(alive):
                    break
                alive = alive[self.within(here[alive] + k - at, x[k])]
                length[alive] += 1
        return here[length >= least]

    def near(self, x: list[str], p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(documents, windows, words matched) of the windows of a passage that match nearby: at some start at least
        ``near`` of the window's ``least`` words stand at most ``slack`` from their offsets.

        Of the rarest words of such a window several must stand near, too. So only these words' diagonals (place less
        position) are sorted, in cells of the passage that hold each window whole, and only where enough of them lie
        together are all words looked up.
        """
        empty = np.zeros(0, np.int64)
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        n, width = len(x), p.least
        if n < width:
            return none
        lists = [self.lists.get(t, empty) for t in x]
        sizes = np.array([len(c) for c in lists])
        together = min(4, p.near)
        rare = np.zeros(n, bool)  # among the rarest of some window
        for k in range(n - width + 1):
            rare[k + np.argsort(sizes[k : k + width], kind="stable")[: width - p.near + together]] = True
        out = [none]
        for lo in range(0, n - width + 1, width):
            hi = min(n, lo + 2 * width - 1)
            parts = [lists[j] - j for j in range(lo, hi) if rare[j] and sizes[j]]
            d = np.sort(np.concatenate(parts)) if parts else empty
            if len(d) < together:
                continue
            first, last = d[: len(d) - together + 1], d[together - 1 :]
            seed = last - first <= 2 * p.slack
            if not seed.any():
                continue
            at = np.unique(np.concatenate([first[seed] + s for s in range(-p.slack, p.slack + 1)]))
            hit = np.zeros((len(at), hi - lo + 1), np.int64)
            for j in range(lo, hi):
                if sizes[j]:
                    hit[:, j - lo + 1] = self.within(at + j, x[j], p.slack)
            sums = np.cumsum(hit, axis=1)
            count = sums[:, width:] - sums[:, :-width]
            row, k = np.nonzero(count >= p.near)
            if len(row):
                out.append((self.doc(at[row] + lo + k + width // 2), lo + k, count[row, k]))
        return tuple(np.concatenate(c) for c in zip(*out))


def passages(cases: DataFrame, p: Params) -> DataFrame:
    """case_id, field, chunk, x: the words of the held-out passages of ``least`` words and more."""
    rows = cases.select("case_id", "target_text", "instruction_de").where("case_id is not null").distinct()
    size = rows.agg(F.sum(F.coalesce(F.length("target_text"), F.lit(0)) + F.coalesce(F.length("instruction_de"), F.lit(0)))).first()[0] or 0
    chunks = -(-size // p.query_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for case, target, instruction in zip(*(b.column(c).to_pylist() for c in ("case_id", "target_text", "instruction_de"))):
                chunk = xxhash.xxh3_64_intdigest(case) % max(1, chunks)
                out += [(case, field, chunk, x) for field, x in (("target_text", words(target)), ("instruction_de", words(body(instruction)))) if len(x) >= p.least]
            columns = list(zip(*out)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.list_(pa.string())))], names=["case_id", "field", "chunk", "x"])

    return materialise(rows.mapInArrow(run, "case_id string, field string, chunk int, x array<string>").distinct(), "p6-passages")


def _rated(asked: DataFrame, stored: DataFrame) -> DataFrame:
    """asked with ``counts``: how often each word of the passage stands in the corpus."""
    terms = asked.select(F.explode("x").alias("term")).distinct()
    totals = stored.select("term", "n").join(terms, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("total"))
    places = asked.select("case_id", "field", "x", "chunk", F.posexplode("x").alias("k", "term")).join(totals, "term", "left")
    # two passages of a case and field differ in their words, so that these belong to the key
    counts = F.transform(F.array_sort(F.collect_list(F.struct("k", F.coalesce("total", F.lit(0)).alias("n")))), lambda s: s["n"])
    return places.groupBy("case_id", "field", "chunk", "x").agg(counts.alias("counts"))


def _pieces(rated: DataFrame, p: Params) -> DataFrame:
    """case_id, field, chunk, term, x, at: the windows with one rarest word, x[at], as one piece x of the passage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for case, field, chunk, x, counts in zip(*(b.column(c).to_pylist() for c in ("case_id", "field", "chunk", "x", "counts"))):
                view = sliding_window_view(np.array(counts), p.least)
                rarest = view.argmin(1) + np.arange(len(view))
                begins = np.flatnonzero(np.diff(rarest, prepend=-1))
                for lo, hi in zip(begins.tolist(), [*begins[1:].tolist(), len(view)]):
                    at = int(rarest[lo])
                    if counts[at]:
                        out.append((case, field, chunk, x[at], x[lo : hi + p.least - 1], at - lo))
            columns = list(zip(*out)) or [[]] * 6
            kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["case_id", "field", "chunk", "term", "x", "at"])

    return rated.mapInArrow(run, "case_id string, field string, chunk int, term string, x array<string>, at int")


def _rare_terms(rated: DataFrame, p: Params) -> DataFrame:
    """case_id, field, chunk, x, term: for each window of the passage the rarest words of which a proximity match holds one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, terms = [], []
            for i, (x, counts) in enumerate(zip(b.column("x").to_pylist(), b.column("counts").to_pylist())):
                view = sliding_window_view(np.array(counts), p.least)
                some = np.unique(np.argsort(view, axis=1, kind="stable")[:, : p.least - p.near + 1] + np.arange(len(view))[:, None])
                mine = sorted({x[k] for k in some.tolist() if counts[k]})
                at += [i] * len(mine)
                terms += mine
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in ("case_id", "field", "chunk", "x")), pa.array(terms, pa.string())], names=["case_id", "field", "chunk", "x", "term"])

    return rated.mapInArrow(run, "case_id string, field string, chunk int, x array<string>, term string")


def _search(stored: DataFrame, asked: DataFrame, routed: DataFrame, schema: str, match: Callable[[Postings, pd.DataFrame], Iterator[tuple]]) -> DataFrame:
    """Rows of ``match`` for the lists of every block and the queries sent to it (routed: block, chunk and more)."""
    names = [x.split()[0] for x in schema.split(", ")]
    terms = asked.select("chunk", F.explode("x").alias("term")).distinct()
    terms = terms.union(asked.select("chunk", F.lit(DOCS)).distinct())
    lists = stored.join(terms, "term").join(routed.select("block", "chunk").distinct(), ["block", "chunk"], "left_semi")

    def run(lists: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        rows = match(Postings(lists), queries) if len(lists) and len(queries) else ()
        return pd.DataFrame(list(rows), columns=names)

    return lists.groupBy("block", "chunk").cogroup(routed.groupBy("block", "chunk")).applyInPandas(run, schema)


def found(docs: DataFrame, cases: DataFrame, p: Params = Params(), stored: DataFrame | None = None) -> DataFrame:
    """doc_id, case_id: documents holding at least ``least`` consecutive words of the case's target_text or body. stored: an
    ``index`` of the documents kept from before."""
    stored = index(docs, p) if stored is None else stored
    asked = passages(cases, p)
    pieces = materialise(_pieces(_rated(asked, stored), p), "p6-pieces")
    routed = materialise(stored.select("block", "term").join(pieces, "term").drop("term"), "p6-routed")

    def match(lists: Postings, queries: pd.DataFrame) -> Iterator[tuple]:
        hits: dict[str, list[np.ndarray]] = {}
        for case, x, at in zip(queries["case_id"], queries["x"], queries["at"]):
            places = lists.around(list(x), int(at), p.least)
            if len(places):
                hits.setdefault(case, []).append(lists.doc(places))
        for case, some in hits.items():
            yield from ((int(d), case) for d in np.unique(np.concatenate(some)))

    return _search(stored, asked, routed, "doc_id bigint, case_id string", match).distinct()


def proximity(docs: DataFrame, cases: DataFrame, p: Params = Params(), stored: DataFrame | None = None) -> DataFrame:
    """doc_id, case_id, field, windows, best: windows of the case's field with a proximity match in the document, and the
    most words matched in one. Exact matches are among them. stored: as in ``found``."""
    if p.least - p.near + p.slack > p.least // 2:
        raise ValueError("near is too small or slack too large for least")
    stored = index(docs, p) if stored is None else stored
    asked = passages(cases, p)
    terms = materialise(_rare_terms(_rated(asked, stored), p), "p6-rare")
    routed = materialise(stored.select("block", "term").join(terms, "term").drop("term").distinct(), "p6-routed")

    def match(lists: Postings, queries: pd.DataFrame) -> Iterator[tuple]:
        for case, field, x in zip(queries["case_id"], queries["field"], queries["x"]):
            # the middle of a window lies in the document, also where the window's first words are missing
            at, windows, hits = lists.near(list(x), p)
            if len(at):
                t = pd.DataFrame({"d": at, "k": windows, "b": hits}).groupby("d").agg(n=("k", "nunique"), m=("b", "max"))
                yield from ((int(d), case, field, int(n), int(m)) for d, n, m in zip(t.index, t["n"], t["m"]))

    return _search(stored, asked, routed, "doc_id bigint, case_id string, field string, windows bigint, best bigint", match)
