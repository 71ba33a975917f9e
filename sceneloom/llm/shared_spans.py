"""Problem 3: long spans standing word for word in more than one record.

Every window of ``k`` tokens has a minimiser, the smallest hash of its runs of ``m`` tokens. Consecutive windows with
the same minimiser travel as one packed string (k + windows - 1 tokens) to the bucket of that minimiser: equal windows
have equal minimisers and meet. In its bucket a minimiser that only one text has is dropped; the windows of the others
are unpacked and sorted by a 128-bit hash of their tokens, which counts them exactly. The packed strings are shuffled
once, and everything in the bucket happens where it arrives.

Skew: records with the same tokens are one text; a task sends a text once, and the records are expanded at the end.
Minimisers with more than about ``bucket`` packed strings (or a millionth of all, if that is more) have no bucket: their
windows are counted one by one with partial aggregation and meet their counts in a join that Spark may split. So a bucket
stays about 10 MB up to 10^11 strings, and the minimisers without one are at most two millions. Which route a minimiser
takes is told by a fixed part of its strings; what is found is the same on both. The buckets are spread over as many
partitions as there are ``partition`` strings. Of all windows standing in the same set of texts only one goes into the
join that makes pairs (sets are told by count, least and greatest key and 128 bits of hashes, as texts and windows are),
so that a long shared span makes a pair once and not once a window. ``groups`` gives the same links without pairs.

Defined results: a null or blank field has no tokens; a field under ``k`` tokens has no window; both fields of one
record may hold the span, which makes no pair and no share for that record alone; a record delivered repeatedly counts
once; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialise
from .text import Rolling, TokenHashes, body, mix, slices, text_key, tokens


@dataclass(frozen=True)
class Params:
    """k: tokens of a window, the least length of a shared span; m: tokens of the runs minimisers are taken from; bucket:
    packed strings from which a minimiser has no bucket; every: one string in so many is counted for that; partition:
    packed strings of a partition, about."""

    k: int = 16
    m: int = 5
    bucket: int = 100_000
    every: int = 64
    partition: int = 60_000


def _super_windows(h: np.ndarray, off: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, first window, number of windows) of each run of windows with one minimiser; positions are in ``h``."""
    none = np.zeros(0, np.int64)
    if len(h) < p.k:
        return none, none, none
    runs = np.arange(len(h) - p.m + 1)
    view = sliding_window_view(Rolling(h).run(runs, runs + p.m), p.k - p.m + 1)
    least = view.argmin(1) + np.arange(len(view))
    first = np.arange(len(view))
    rec = np.searchsorted(off, first, "right") - 1
    ok = first + p.k <= off[rec + 1]
    new = np.ones(len(view), bool)
    new[1:] = (least[1:] != least[:-1]) | (rec[1:] != rec[:-1])
    begins = np.flatnonzero(new & ok)
    group = np.cumsum(new & ok) - 1
    count = np.bincount(group[ok], minlength=len(begins)) if len(begins) else none
    return view.min(1)[begins].view(np.int64), begins, count


def _fields(b: pa.RecordBatch, p: Params) -> tuple[list[list[str]], list[str], list[int]]:
    """Tokens, segment_id and field of both fields of a batch, where they are long enough."""
    lists, owner, field = [], [], []
    ids = b.column("segment_id").to_pylist()
    for f, column in enumerate(("target_text", "instruction_de")):
        for i, x in zip(ids, b.column(column).to_pylist()):
            t = tokens(body(x) if f else x)
            if len(t) >= p.k:
                lists.append(t)
                owner.append(i)
                field.append(f)
    return lists, owner, field


def _read(df: DataFrame) -> DataFrame:
    return df.select("segment_id", "target_text", "instruction_de").where("segment_id is not null")


def members(df: DataFrame, p: Params) -> tuple[DataFrame, np.ndarray, int]:
    """(text_key, segment_id, field, n_tokens of all fields long enough; the hot minimisers, sorted; number of packed strings)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = TokenHashes()
        for b in slices(batches):
            lists, owner, field = _fields(b, p)
            h, off = hashes.of(lists)
            least, begins, _ = _super_windows(h, off, p)
            keys = [text_key(x) for x in lists]
            rec = np.searchsorted(off, begins, "right") - 1
            # strings are chosen by text and place, so that copies of a text show the same ones
            salt = np.array([int.from_bytes(k[:8], "big") for k in keys], np.uint64)
            counted = mix(salt[rec] + (begins - off[rec]).astype(np.uint64)) % np.uint64(p.every) == 0
            ends = np.concatenate(([0], np.cumsum(np.bincount(rec[counted], minlength=len(lists))))).astype(np.int32)
            strings = np.bincount(rec, minlength=len(lists)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array(owner, pa.string()), pa.array(field, pa.int32()), pa.array([len(x) for x in lists], pa.int32()), pa.array(strings), pa.ListArray.from_arrays(pa.array(ends), pa.array(least[counted]))],
                names=["text_key", "segment_id", "field", "n_tokens", "strings", "counted"],
            )

    schema = "text_key binary, segment_id string, field int, n_tokens int, strings int, counted array<bigint>"
    rows = materialise(_read(df).mapInArrow(run, schema), "p3-members")
    total = rows.agg(F.sum("strings")).first()[0] or 0
    limit = max(p.bucket, total // 1_000_000)
    hot = rows.select(F.explode("counted").alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(1, limit / p.every / 2))
    found = np.array(sorted(r["x"] for r in hot.collect()), np.int64)  # at most 2 * total / limit
    return rows.select("text_key", "segment_id", "field", "n_tokens").distinct(), found, total


def packed(df: DataFrame, p: Params, hot: np.ndarray) -> DataFrame:
    """text_key, bucket, start, packed: the packed strings of all texts, without those of hot minimisers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sent = TokenHashes(), _Sent()
        for b in slices(batches):
            lists = _fields(b, p)[0]
            keys = [text_key(x) for x in lists]
            fresh = [k for k, x in enumerate(keys) if sent.new(x)]
            lists, keys = [lists[k] for k in fresh], [keys[k] for k in fresh]
            h, off = hashes.of(lists)
            least, begins, count = _super_windows(h, off, p)
            keep = ~np.isin(least, hot)
            least, begins, count = least[keep], begins[keep], count[keep]
            rec = np.searchsorted(off, begins, "right") - 1
            start = begins - off[rec]
            text = [" ".join(lists[r][s : s + c + p.k - 1]) for r, s, c in zip(rec.tolist(), start.tolist(), count.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()).take(pa.array(rec)), pa.array(least), pa.array(start.astype(np.int32)), pa.array(text, pa.string())],
                names=["text_key", "bucket", "start", "packed"],
            )

    return _read(df).mapInArrow(run, "text_key binary, bucket bigint, start int, packed string")


def _hot_windows(df: DataFrame, p: Params, hot: np.ndarray) -> DataFrame:
    """h1, h2, text_key, pos of the windows whose minimiser is hot."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sent = TokenHashes(), _Sent()
        for b in slices(batches):
            lists = _fields(b, p)[0]
            keys = [text_key(x) for x in lists]
            fresh = [k for k, x in enumerate(keys) if sent.new(x)]
            lists, keys = [lists[k] for k in fresh], [keys[k] for k in fresh]
            h, off = hashes.of(lists)
            least, begins, count = _super_windows(h, off, p)
            keep = np.isin(least, hot)
            begins, count = begins[keep], count[keep].astype(np.int64)
            at = np.repeat(begins, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            one, two = Rolling(h).run(at, at + p.k), Rolling(mix(h)).run(at, at + p.k)
            rec = np.searchsorted(off, at, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(keys, pa.binary()).take(pa.array(rec)), pa.array((at - off[rec]).astype(np.int32))], names=["h1", "h2", "text_key", "pos"]
            )

    return _read(df).mapInArrow(run, "h1 bigint, h2 bigint, text_key binary, pos int")


class _Sent:
    """Texts a task has sent already. Forgets all when it is full: a text may then be sent again, which changes nothing."""

    def __init__(self, most: int = 1_000_000):
        self.keys: set[bytes] = set()
        self.most = most

    def new(self, key: bytes) -> bool:
        if key in self.keys:
            return False
        if len(self.keys) >= self.most:
            self.keys.clear()
        self.keys.add(key)
        return True


def shared_windows(df: DataFrame, p: Params) -> tuple[DataFrame, DataFrame]:
    """(members, windows). windows: win, text_key, pos of all windows that stand in two or more texts."""
    mine, hot, strings = members(df, p)
    bucket = Window.partitionBy("bucket")
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-strings // p.partition))
    rows = packed(df, p, hot).repartition(n, "bucket")
    rows = rows.withColumn("a", F.min("text_key").over(bucket)).withColumn("b", F.max("text_key").over(bucket)).where("a <> b")
    # the tokens are named twice below, so that the split stays a column and is not done again for each window
    rows = rows.select("bucket", "text_key", "start", F.split("packed", " ").alias("t"))
    window = f"slice(t, i + 1, {p.k})"
    unpack = F.expr(f"transform(sequence(0, size(t) - {p.k}), i -> struct(start + i as pos, xxhash64({window}) as h1, xxhash64(1, {window}) as h2))")
    rows = rows.select("bucket", "text_key", F.explode(unpack).alias("w")).select("bucket", "text_key", "w.h1", "w.h2", "w.pos")
    same = Window.partitionBy("bucket", "h1", "h2")
    rows = rows.withColumn("a", F.min("text_key").over(same)).withColumn("b", F.max("text_key").over(same)).where("a <> b")
    windows = rows.select(F.struct("h1", "h2", F.lit(False).alias("hot")).alias("win"), "text_key", "pos")
    if len(hot):
        h = _hot_windows(df, p, hot)
        twice = h.groupBy("h1", "h2").agg(F.min("text_key").alias("a"), F.max("text_key").alias("b")).where("a <> b").select("h1", "h2")
        windows = windows.union(h.join(twice, ["h1", "h2"]).select(F.struct("h1", "h2", F.lit(True).alias("hot")).alias("win"), "text_key", "pos"))
    return mine, materialise(windows, "p3-windows")


def _chosen(windows: DataFrame) -> DataFrame:
    """win, text_key, pos: of all windows standing in the same set of texts one, where it first stands in each."""
    held = materialise(windows.groupBy("win", "text_key").agg(F.min("pos").alias("pos")), "p3-shared")
    key = F.struct(F.count(F.lit(1)), F.min("text_key"), F.max("text_key"), F.bit_xor(F.xxhash64("text_key")), F.bit_xor(F.xxhash64(F.lit(1), "text_key")))
    chosen = held.groupBy("win").agg(key.alias("set")).groupBy("set").agg(F.min("win").alias("win")).select("win")
    return held.join(chosen, "win")


def found_pairs(df: DataFrame, p: Params = Params()) -> DataFrame:
    """segment_id_a, segment_id_b: record pairs that share a window, the smaller id first."""
    mine, windows = shared_windows(df, p)
    mine = materialise(mine, "p3-texts")
    rep = _chosen(windows).select("win", "text_key")
    pairs = rep.withColumnRenamed("text_key", "ka").join(rep.withColumnRenamed("text_key", "kb"), "win").where("ka < kb").select("ka", "kb").distinct()
    copies = mine.groupBy("text_key").agg(F.min("segment_id").alias("a"), F.max("segment_id").alias("b")).where("a <> b").select(F.col("text_key").alias("ka"), F.col("text_key").alias("kb"))
    a, b = (mine.select(F.col("text_key").alias(f"k{x}"), F.col("segment_id").alias(x)) for x in "ab")
    both = pairs.union(copies).join(a, "ka").join(b, "kb").where("a <> b")
    return both.select(F.least("a", "b").alias("segment_id_a"), F.greatest("a", "b").alias("segment_id_b")).distinct()


def groups(df: DataFrame, p: Params = Params()) -> DataFrame:
    """span, segment_id, records: the links of ``found_pairs`` without pairs, a row for each record and shared span. Two records
    share a window just if they stand under one span; of spans in the same set of texts there is one. A record whose whole
    text is copied stands under the text's own span with its copies."""
    mine, windows = shared_windows(df, p)
    mine = materialise(mine, "p3-texts")
    of = _chosen(windows).select(F.format_string("%016x%016x", "win.h1", "win.h2").alias("span"), "text_key")
    copied = mine.groupBy("text_key").agg(F.min("segment_id").alias("a"), F.max("segment_id").alias("b")).where("a <> b").select(F.hex("text_key").alias("span"), "text_key")
    rows = of.union(copied).join(mine.select("text_key", "segment_id"), "text_key").select("span", "segment_id").distinct()
    sizes = rows.groupBy("span").agg(F.count(F.lit(1)).alias("records")).where("records > 1")
    return rows.join(sizes, "span")


def coverage(df: DataFrame, p: Params = Params()) -> DataFrame:
    """segment_id, field, n_tokens, shared_tokens, share: tokens of the field that lie in a span of at least ``k`` tokens
    that another record holds too; a row for each field of at least ``k`` tokens."""
    mine, windows = shared_windows(df, p)
    mine = materialise(mine, "p3-texts")
    owners = mine.groupBy("text_key").agg(F.min("segment_id").alias("a"), F.max("segment_id").alias("b"))
    whole = owners.where("a <> b").select("text_key", F.lit(True).alias("copied"))
    # a window counts where two different records hold it: one record alone may hold it in both its fields
    spread = windows.join(owners, "text_key").groupBy("win").agg(F.min("a").alias("a"), F.max("b").alias("b")).where("a <> b").select("win")
    order = Window.partitionBy("text_key").orderBy("pos")
    step = F.least(F.lit(p.k), F.coalesce(F.lead("pos").over(order) - F.col("pos"), F.lit(p.k)))
    covered = windows.join(spread, "win").select("text_key", "pos").distinct().withColumn("step", step).groupBy("text_key").agg(F.sum("step").alias("covered"))
    rows = mine.join(whole, "text_key", "left").join(covered, "text_key", "left")
    shared = F.when(F.col("copied"), F.col("n_tokens")).otherwise(F.coalesce("covered", F.lit(0))).cast("int")
    return rows.select("segment_id", F.when(F.col("field") == 0, "target_text").otherwise("instruction_de").alias("field"), "n_tokens", shared.alias("shared_tokens"), (shared / F.col("n_tokens")).alias("share"))
