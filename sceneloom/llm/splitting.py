"""Problem 4: cutting oversized texts at natural boundaries, with overlap.

Every place where a text may be cut has a strength: paragraph 4, line 3, sentence 2, word 1; between any other two
characters 0. A sparse table over the strengths answers, for any window of places, which is the strongest, the rightmost
of equals. The splitter asks for the strongest cut in each permissible window (at least ``fill`` of the limit, at most
the limit), cuts there, steps back by the overlap to the next word, and goes on. The boundary a text needs comes from
the same index: it is the weakest among the strongest cuts of all windows as wide as the limit.

White space and line ends are those of ``text.WHITE``; a blank line is empty or of white space only. Lengths are code
points. Everything is done text by text in Arrow batches: no shuffle but the one that drops repeated deliveries.

Defined results: null, blank and fitting texts give no row in ``found`` and one piece in ``pieces`` (none for null; a
blank text is one piece as it is); a word longer than the limit is cut inside; a segment delivered repeatedly counts
once; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import WHITE, slices

WORD, SENTENCE, LINE, PARAGRAPH = 1, 2, 3, 4
NAMES = {PARAGRAPH: "paragraph", LINE: "line", SENTENCE: "sentence", WORD: "word", 0: "none"}

_GAP = re.compile(f"[{WHITE}]+")
_LINE_END = re.compile(r"\r\n|\n|\r")


@dataclass(frozen=True)
class Params:
    """limit: code points of a piece at most; overlap: code points that consecutive pieces share (the next piece
    begins at the first word within them, so that the shared part is shorter by less than a word; a word longer than
    the overlap is entered in the middle); fill: the part of the
    limit a piece reaches at least, where the text goes on."""

    limit: int = 2400
    overlap: int = 200
    fill: float = 0.5


class Boundaries:
    """The gaps of white space in a text with their strengths: gap k lies over [start[k], end[k])."""

    def __init__(self, text: str):
        start, end, strength = [], [], []
        for m in _GAP.finditer(text):
            a, b = m.span()
            lines = len(_LINE_END.findall(m[0]))
            start.append(a)
            end.append(b)
            # a gap with two line ends holds a blank line; so does one with a line end at either end of the text
            strength.append(PARAGRAPH if lines > 1 or lines and (a == 0 or b == len(text)) else LINE if lines else SENTENCE if a and text[a - 1] in ".!?…" else WORD)
        self.length = len(text)
        self.start, self.end, self.strength = np.array(start, np.int64), np.array(end, np.int64), np.array(strength, np.int8)


class RangeMax:
    """Sparse table: the rightmost of the largest values in any range, in constant time. Spans up to ``widest`` are kept."""

    def __init__(self, values: np.ndarray, widest: int):
        n = len(values)
        # strength first, place second: the largest key is the rightmost strongest
        self.rows = [values.astype(np.int64) * (n + 1) + np.arange(n)]
        self.n = n
        while 2 ** len(self.rows) <= min(n, widest):
            half, last = 2 ** (len(self.rows) - 1), self.rows[-1]
            self.rows.append(np.maximum(last[:-half], last[half:]))

    def best(self, lo: int, hi: int) -> int:
        """The place of the rightmost largest value in [lo, hi)."""
        k = (hi - lo).bit_length() - 1
        return int(max(self.rows[k][lo], self.rows[k][hi - 2**k])) % (self.n + 1)

    def largest(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The largest value in each [lo, hi); -1 for an empty range."""
        out = np.full(len(lo), -1, np.int64)
        some = np.flatnonzero(hi > lo)
        k = np.frexp((hi - lo)[some])[1] - 1
        for j in np.unique(k):
            at = some[k == j]
            out[at] = np.maximum(self.rows[j][lo[at]], self.rows[j][hi[at] - 2**j]) // (self.n + 1)
        return out


def level_of(text: str, limit: int) -> int:
    """The strongest boundary that leaves no unit over the limit; 0 where even words are too long.

    Cut at every gap of a strength, no unit is over the limit just if behind the text's begin and behind each gap another
    gap at least as strong begins within the limit, unless the text ends first. So the answer is the least, over all these
    places, of the strongest gap in the permissible window: one question to the index for each place.
    """
    b = Boundaries(text)
    inner = (b.start > 0) & (b.end < b.length)
    # white space at either end is stripped and belongs to no unit
    begin = int(b.end[0]) if len(b.end) and b.start[0] == 0 else 0
    stop = int(b.start[-1]) if len(b.end) and b.end[-1] == b.length else b.length
    starts, ends, strength = b.start[inner], b.end[inner], b.strength[inner]
    at = np.concatenate(([begin], ends))
    at = at[stop - at > limit]
    if not len(at):
        return PARAGRAPH
    strongest = RangeMax(strength, limit + 1).largest(np.searchsorted(starts, at), np.searchsorted(starts, at + limit, "right"))
    return max(0, int(strongest.min()))


def pieces_of(text: str, p: Params) -> list[tuple[int, int, int]]:
    """(start, end, strength of the cut at its end) of each piece; the last ends the text, with strength PARAGRAPH."""
    if not 0 <= p.overlap < p.limit * p.fill:
        raise ValueError("overlap must be below fill times limit")
    if len(text) <= p.limit:
        return [(0, len(text), PARAGRAPH)]
    b = Boundaries(text)
    index = RangeMax(b.strength, p.limit)
    stops, begins = b.start, b.end
    out, at = [], 0
    while len(text) - at > p.limit:
        # gaps whose white space begins within the permissible window; the gap belongs to neither piece
        lo, hi = np.searchsorted(stops, at + max(1, int(p.limit * p.fill))), np.searchsorted(stops, at + p.limit, "right")
        if lo < hi:
            g = index.best(int(lo), int(hi))
            end, strength, then = int(stops[g]), int(b.strength[g]), int(begins[g])
        else:  # no gap in the window: the strongest gap before it is better than a cut inside a word
            early = int(np.searchsorted(stops, at + p.overlap, "right"))
            if early < hi:
                g = index.best(early, int(hi))
                end, strength, then = int(stops[g]), int(b.strength[g]), int(begins[g])
            else:
                end, strength, then = at + p.limit, 0, at + p.limit
        out.append((at, end, strength))
        if p.overlap:
            # step back: the first place at most ``overlap`` before the end; inside a word where there is none
            g = int(np.searchsorted(begins, end - p.overlap))
            then = int(begins[g]) if g < len(begins) and begins[g] < end else end - p.overlap
        at = then
    if at < len(text):
        out.append((at, len(text), PARAGRAPH))
    return out


def found(df: DataFrame, p: Params = Params()) -> DataFrame:
    """segment_id, boundary of the segments over the limit: the strongest boundary that suffices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            level = [NAMES[level_of(x, p.limit)] for x in b.column("target_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("segment_id"), pa.array(level, pa.string())], names=["segment_id", "boundary"])

    rows = df.select("segment_id", "target_text").where(F.col("segment_id").isNotNull() & (F.length("target_text") > p.limit))
    return rows.mapInArrow(run, "segment_id string, boundary string").distinct()


def pieces(df: DataFrame, p: Params = Params()) -> DataFrame:
    """segment_id, scene_id, piece, start, end, boundary, text: the ordered pieces of every segment; ``boundary`` is what
    ends the piece, start and end are code points. Of repeated deliveries one stays, with the least scene_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = b.column("target_text").to_pylist()
            cuts = [pieces_of(x, p) for x in texts]
            at = pa.array([k for k, x in enumerate(cuts) for _ in x], pa.int64())
            flat = [c for x in cuts for c in x]
            yield pa.RecordBatch.from_arrays(
                [b.column("segment_id").take(at), b.column("scene_id").take(at), pa.array([i for x in cuts for i in range(len(x))], pa.int32())]
                + [pa.array([c[k] for c in flat], pa.int32()) for k in (0, 1)]
                + [pa.array([NAMES[c[2]] for c in flat], pa.string()), pa.array([t[s:e] for t, x in zip(texts, cuts) for s, e, _ in x], pa.string())],
                names=["segment_id", "scene_id", "piece", "start", "end", "boundary", "text"],
            )

    rows = df.select("segment_id", "scene_id", "target_text").where("segment_id is not null and target_text is not null")
    rows = rows.groupBy("segment_id").agg(F.min("scene_id").alias("scene_id"), F.first("target_text").alias("target_text"))
    return rows.mapInArrow(run, "segment_id string, scene_id string, piece int, start int, end int, boundary string, text string")


def check(df: DataFrame, p: Params = Params()) -> DataFrame:
    """segments, too_long, gaps, disorder: one row over all pieces; pieces over the limit, places where text other than white
    space is lost, and pieces that don't go on from the one before with at most the stated overlap."""
    x = pieces(df, p)
    rows = x.groupBy("segment_id").agg(F.array_sort(F.collect_list(F.struct("piece", "start", "end", "text"))).alias("x"))
    whole = df.where("segment_id is not null and target_text is not null").groupBy("segment_id").agg(F.first("target_text").alias("t"))
    # a text and its pieces: a bounded unit
    blank = lambda c: F.regexp_replace(c, f"[{WHITE}]+", "") == ""
    rows = whole.join(rows, "segment_id", "left").withColumn("n", F.size("x"))
    steps = F.transform(F.sequence(F.lit(1), F.col("n") - 1), lambda k: F.struct(F.get("x", k - 1).alias("a"), F.get("x", k).alias("b"), k.alias("k")))
    steps = F.when(F.col("n") > 1, steps).otherwise(F.slice(F.array(F.struct(F.get("x", F.lit(0)).alias("a"), F.get("x", F.lit(0)).alias("b"), F.lit(0).alias("k"))), 1, 0))
    lost = F.exists(steps, lambda s: ~blank(F.substring(F.col("t"), s["a"]["end"] + 1, F.greatest(F.lit(0), s["b"]["start"] - s["a"]["end"]))))
    lost = lost | F.coalesce(F.get("x", F.lit(0))["start"] != 0, F.lit(True)) | ~blank(F.substring(F.col("t"), F.element_at("x", -1)["end"] + 1, F.length("t")))
    wrong = F.exists(steps, lambda s: (s["b"]["piece"] != s["k"]) | (s["b"]["start"] <= s["a"]["start"]) | (s["b"]["end"] <= s["a"]["end"]) | (s["a"]["end"] - s["b"]["start"] > p.overlap))
    said = F.exists("x", lambda s: s["text"] != F.substring(F.col("t"), s["start"] + 1, s["end"] - s["start"]))
    return rows.agg(F.count(F.lit(1)).alias("segments"), F.count_if(F.exists("x", lambda s: F.length(s["text"]) > p.limit)).alias("too_long"), F.count_if(lost).alias("gaps"), F.count_if(wrong | said).alias("disorder"))
