"""Problem 1: the same or nearly the same records on both sides of a split.

Records are normalised to words and cut into chunks by content: a cut falls behind a word where the rolling hash of
it and the word before is divisible by ``avg_words``. Chunk digests are joined across the sides; the lengths of shared
chunks give the overlap fraction of each record (``record_overlaps``). Records with a fraction of ``overlap`` become
candidate pairs.

Scattered single changes leave few chunks whole, so that a near copy may stay below that fraction. Candidates are
therefore also records that meet in a prefix of their word sequences: of n distinct ones, a record with the needed
similarity shares ceil(similarity * n) at least, so in any order that holds for all records two such records share
``common`` of their first n - ceil(similarity * n) + ``common`` (or all they share, where that is less). This misses no
pair. The order puts word sequences last that were seen
often while the chunks were made; it decides how many pairs meet, never which are found. Candidates alone are compared
exactly by their distinct word sequences.

Skew: exact copies are one class (grouped while still packed, one row a record); digests are counted with partial
aggregation; a chunk that many records share is joined only where a record could not reach the needed fraction without
it (prefix order by rising frequency, which loses no pair with that fraction). No record and no pair is capped. Where a
class of copies is large, ``links`` and ``classes`` give the same pairs as pairs of classes and their members.

Chunks, words and word sequences are told apart by 64-bit hashes, classes by 128-bit ones.

Defined results: a null or blank field has no chunks and is in no pair; a field with fewer than ``gram`` words has no
word sequence and is in no pair; a null or unknown split belongs to no side; a record delivered repeatedly counts once;
an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialise
from .text import Rolling, TokenHashes, body, mix, slices, split_name, text_key, words

TRAIN, HELD_OUT = 1, 2


@dataclass(frozen=True)
class Params:
    """avg_words: mean chunk length; overlap: fraction of a record's words, in chunks, that makes it a candidate for that alone;
    gram and similarity: the exact comparison; often: how many word sequences are told apart by frequency in the order of
    the prefixes, all others count as rare; common: how many word sequences the prefixes of a pair must share."""

    avg_words: int = 6
    overlap: float = 0.2
    gram: int = 3
    similarity: float = 0.6
    often: int = 200_000
    common: int = 3


_CHUNKED = "segment_id string, side int, field int, text_key binary, key bigint, n_words int, digests array<bigint>, lengths array<int>"
#: The field of rows that hold no record but the word sequences a slice has often, with their counts.
_OFTEN = -1


def _chunks(roll: Rolling, off: np.ndarray, fields: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digest and length of each chunk, and each record's offset in them."""
    n, size = len(off) - 1, int(off[-1])
    if not size:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(n + 1, np.int32)
    at = np.arange(size)
    cut = np.zeros(size, bool)
    cut[1:] = roll.run(at[:-1], at[1:] + 1) % np.uint64(p.avg_words) == 0
    full = off[:-1] < off[1:]
    cut[off[:-1][full]] = False
    cut[off[1:][full] - 1] = True
    ends = np.flatnonzero(cut) + 1
    starts = np.concatenate(([0], ends[:-1]))
    length = ends - starts
    rec = np.searchsorted(off, starts, "right") - 1
    digest = mix(roll.run(starts, ends) + fields[rec].astype(np.uint64)).view(np.int64)
    counts = np.bincount(rec, minlength=n)
    return digest, length.astype(np.int32), np.concatenate(([0], np.cumsum(counts))).astype(np.int32)


def _sequences(roll: Rolling, off: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word sequence, and the record it stands in."""
    at, rec = np.arange(off[-1]), np.repeat(np.arange(len(off) - 1), np.diff(off))
    whole = at + p.gram <= off[1:][rec]
    return roll.run(at[whole], at[whole] + p.gram).view(np.int64), rec[whole]


def _prefixes(g: np.ndarray, rec: np.ndarray, n: int, often: np.ndarray, counts: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, record, place from 1, sizes): the prefix of each record's distinct sequences, ordered by their count in
    ``often`` (sorted; 0 if not there) and by hash. sizes: distinct sequences by record."""
    order = np.lexsort((g, rec))
    g, rec = g[order], rec[order]
    first = np.ones(len(g), bool)
    first[1:] = (g[1:] != g[:-1]) | (rec[1:] != rec[:-1])
    g, rec = g[first], rec[first]
    sizes = np.bincount(rec, minlength=n)
    if len(often) and len(g):
        at = np.minimum(np.searchsorted(often, g), len(often) - 1)
        order = np.lexsort((g, np.where(often[at] == g, counts[at], 0), rec))
        g = g[order]
    place = np.arange(len(g)) - np.concatenate(([0], np.cumsum(sizes)[:-1]))[rec] + 1 if len(g) else np.zeros(0, np.int64)
    needed = np.ceil(p.similarity * sizes - 1e-6).astype(np.int64)
    keep = place <= (sizes - needed + p.common)[rec]
    return g[keep], rec[keep], place[keep], sizes


def _key(text_key: bytes) -> int:
    return int.from_bytes(text_key[:8], "big", signed=True)


def _texts(b: pa.RecordBatch) -> tuple[np.ndarray, list[list[str]], np.ndarray]:
    """The words of both fields of a batch where there are any: row (of twice the batch), words, field."""
    texts = [words(x) for x in b.column("target_text").to_pylist()] + [words(body(x)) for x in b.column("instruction_de").to_pylist()]
    rows = np.array([k for k, x in enumerate(texts) if x], np.int64)
    return rows, [texts[k] for k in rows], (rows >= b.num_rows).astype(np.int32)


def _sided(df: DataFrame) -> DataFrame:
    s = split_name(F.col("split"))
    side = F.when(s == "train", TRAIN).when(s.isin("validation", "test"), HELD_OUT)
    return df.select("segment_id", side.alias("side"), "target_text", "instruction_de").where("segment_id is not null and side is not null")


def chunked(df: DataFrame, p: Params) -> DataFrame:
    """A row for each record and field: its side, the key of its words, the digests and lengths of its chunks. Besides, a row
    of field _OFTEN for each slice of records: word sequences that stand in it more than once, and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = TokenHashes()
        for b in slices(batches):
            ids, side = b.column("segment_id"), b.column("side")
            rows, lists, fields = _texts(b)
            h, word_off = hashes.of(lists)
            roll = Rolling(h)
            digest, length, off = _chunks(roll, word_off, fields, p)
            at = pa.array(rows % max(1, b.num_rows))
            keys = [text_key(x) for x in lists]
            names = ["segment_id", "side", "field", "text_key", "key", "n_words", "digests", "lengths"]
            yield pa.RecordBatch.from_arrays(
                [ids.take(at), side.take(at), pa.array(fields), pa.array(keys, pa.binary()), pa.array(map(_key, keys), pa.int64()), pa.array([len(x) for x in lists], pa.int32()), pa.ListArray.from_arrays(pa.array(off), pa.array(digest)), pa.ListArray.from_arrays(pa.array(off), pa.array(length))], names=names
            )
            g, counts = np.unique(_sequences(roll, word_off, p)[0], return_counts=True)
            g, counts = g[counts > 1], counts[counts > 1]
            yield pa.RecordBatch.from_arrays(
                [pa.array([None], pa.string()), pa.array([0], pa.int32()), pa.array([_OFTEN], pa.int32()), pa.array([b""], pa.binary()), pa.array([0], pa.int64()), pa.array([0], pa.int32()), pa.array([g], pa.list_(pa.int64())), pa.array([counts.astype(np.int32)], pa.list_(pa.int32()))], names=names
            )

    return _sided(df).mapInArrow(run, _CHUNKED)


def _often(chunks: DataFrame, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """The word sequences counted most often in the slices, ``often`` of them at most, sorted by hash, and their counts."""
    c = chunks.where(F.col("field") == _OFTEN).select(F.explode(F.arrays_zip("digests", "lengths")).alias("c"))
    counts = materialise(c.groupBy(F.col("c.digests").alias("g")).agg(F.sum("c.lengths").alias("n")), "p1-often")
    # a bound on the counts, told by how many sequences have each order of magnitude (at most 1,024 of them), and not an
    # ordering, for which every task would send as many
    size = F.floor(16 * F.log2("n"))
    left, least = p.often, None
    for r in sorted(counts.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("m")).collect(), reverse=True):
        if r.m > left:
            break
        left, least = left - r.m, r["size"]
    top = (counts.limit(0) if least is None else counts.where(size >= least)).toArrow()
    g, n = (np.asarray(top.column(x).combine_chunks(), np.int64) for x in ("g", "n"))
    order = np.argsort(g)
    return g[order], n[order]


def _near_by_prefix(df: DataFrame, often: np.ndarray, counts: np.ndarray, p: Params) -> DataFrame:
    """field, key_a, key_b: all texts of the two sides that share ``common`` word sequences of both prefixes at places
    that allow the similarity. A text that a task meets again is left out, so copies are few before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = TokenHashes()
        seen: set[tuple[int, int]] = set()
        for b in slices(batches):
            _, lists, fields = _texts(b)
            keys = [_key(text_key(x)) for x in lists]
            new = [k for k, x in enumerate(zip(keys, fields.tolist())) if not (x in seen or seen.add(x))]
            key, field = np.array([keys[k] for k in new], np.int64), fields[new]
            h, off = hashes.of([lists[k] for k in new])
            g, rec, place, sizes = _prefixes(*_sequences(Rolling(h), off, p), len(new), often, counts, p)
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(field[rec]), pa.array(key[rec]), pa.array(sizes[rec].astype(np.int32)), pa.array(place.astype(np.int32))], names=["g", "field", "key", "n", "place"])

    def side(which: int, x: str) -> DataFrame:
        rows = _sided(df).where(F.col("side") == which).select("target_text", "instruction_de").mapInArrow(run, "g bigint, field int, key bigint, n int, place int")
        rows = rows.repartition("g", "field").distinct()  # the join needs no second shuffle
        return rows.select("g", "field", *[F.col(c).alias(f"{c}_{x}") for c in ("key", "n", "place")])

    # at each of the first common sequences, what is left of both must do for the sequences two similar records share
    shared = F.lit(p.similarity / (1 + p.similarity)) * (F.col("n_a") + F.col("n_b"))
    left = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b")) + p.common
    met = side(TRAIN, "a").join(side(HELD_OUT, "b"), ["g", "field"])
    met = met.where((F.col("key_a") != F.col("key_b")) & (left >= shared - 1e-6)).groupBy("field", "key_a", "key_b").agg(F.count(F.lit(1)).alias("met"), F.max(F.greatest("n_a", "n_b")).alias("n"))
    return met.where(F.col("met") >= F.least(F.lit(p.common), F.ceil(F.lit(p.similarity) * F.col("n") - 1e-6))).select("field", "key_a", "key_b")


def _grams(df: DataFrame, p: Params) -> DataFrame:
    """segment_id, field → the hashes of its distinct word sequences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = TokenHashes()
        for b in slices(batches):
            field = np.array(b.column("field").to_pylist(), np.int32)
            texts = [words(body(x) if f else x) for f, x in zip(field, b.column("text").to_pylist())]
            h, off = hashes.of(texts)
            roll = Rolling(h)
            lists = []
            for k in range(len(texts)):
                i = np.arange(off[k], max(off[k], off[k + 1] - p.gram + 1))
                lists.append(np.unique(roll.run(i, i + p.gram).view(np.int64)))
            ends = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
            flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("segment_id"), pa.array(field), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["segment_id", "field", "grams"])

    return df.mapInArrow(run, "segment_id string, field int, grams array<bigint>")


def overlaps(df: DataFrame, p: Params) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, fractions, pairs) of a table with segment_id, split, target_text, instruction_de.

    members: field, rep, segment_id, side, each record under the representative of its class (records with the same
    words); fractions: rep, field, overlap, the share of chunk words that also stand on the other side; pairs: field,
    rep_a, rep_b, similarity of all class pairs at or above ``similarity`` with sides apart, of which both may be the
    same class.
    """
    chunks = materialise(chunked(df, p), "p1-chunks")
    rows = chunks.where(F.col("field") != _OFTEN)
    classes = rows.groupBy("field", "text_key").agg(
        F.min("segment_id").alias("rep"), F.bit_or("side").alias("sides"), F.first("key").alias("key"), F.first("n_words").alias("n_words"), F.first("digests").alias("digests"), F.first("lengths").alias("lengths")
    )
    classes = materialise(classes, "p1-classes")
    members = rows.select("field", "text_key", "segment_id", "side").distinct().join(classes.select("field", "text_key", "rep"), ["field", "text_key"]).select("field", "rep", "segment_id", "side")

    parts = classes.select("rep", "field", "sides", F.expr("aggregate(lengths, 0, (a, x) -> a + x)").alias("weight"), F.explode(F.arrays_zip("digests", "lengths")).alias("c"))
    parts = parts.select("rep", "field", "sides", "weight", F.col("c.digests").alias("digest"), F.col("c.lengths").alias("length"))
    shared = parts.groupBy("digest").agg(F.bit_or("sides").alias("both"), F.count(F.lit(1)).alias("df")).where(F.col("both") == (TRAIN | HELD_OUT)).select("digest", "df")
    parts = parts.join(shared, "digest")
    fractions = parts.groupBy("rep", "field").agg((F.sum("length") / F.max("weight")).alias("overlap"))
    by = Window.partitionBy("rep", "field")
    falling = by.orderBy(F.desc("df"), "digest").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("shared", F.sum("length").over(by)).withColumn("so_far", F.sum("length").over(falling))
    # a class on both sides shares all its chunks with itself, so that only chunks found in another class tell candidates
    needed = p.overlap * F.col("weight")
    prefix = materialise(parts.where(F.col("so_far") >= needed).select("rep", "field", "sides", "digest", "shared", "weight"), "p1-prefix")

    a = prefix.where(F.col("sides").bitwiseAND(TRAIN) != 0).select("digest", "field", F.col("rep").alias("rep_a"))
    b = prefix.where(F.col("sides").bitwiseAND(HELD_OUT) != 0).select("digest", "field", F.col("rep").alias("rep_b"))
    by_chunk = a.join(b, ["digest", "field"]).where("rep_a <> rep_b").select("field", "rep_a", "rep_b")
    by_prefix = _near_by_prefix(df, *_often(chunks, p), p)
    for x in "ab":
        by_prefix = by_prefix.join(classes.select("field", F.col("key").alias(f"key_{x}"), F.col("rep").alias(f"rep_{x}")), ["field", f"key_{x}"])
    candidates = materialise(by_chunk.union(by_prefix.select("field", "rep_a", "rep_b")).distinct(), "p1-candidates")

    wanted = candidates.select(F.col("rep_a").alias("segment_id"), "field").union(candidates.select(F.col("rep_b").alias("segment_id"), "field")).distinct()
    texts = df.select("segment_id", "target_text", "instruction_de").join(wanted, "segment_id").select("segment_id", "field", F.when(F.col("field") == 0, F.col("target_text")).otherwise(F.col("instruction_de")).alias("text"))
    grams = _grams(texts, p).groupBy("segment_id", "field").agg(F.first("grams").alias("grams"))
    grams = materialise(grams, "p1-grams")
    ga, gb = (grams.select("field", F.col("segment_id").alias(f"rep_{x}"), F.col("grams").alias(f"g{x}")) for x in "ab")
    both = candidates.join(ga, ["field", "rep_a"]).join(gb, ["field", "rep_b"]).withColumn("both", F.size(F.array_intersect("ga", "gb")))
    near = both.select("field", "rep_a", "rep_b", (F.col("both") / (F.size("ga") + F.size("gb") - F.col("both"))).alias("similarity")).where(F.col("similarity") >= p.similarity - 1e-12)
    same = classes.where((F.col("sides") == (TRAIN | HELD_OUT)) & (F.col("n_words") >= p.gram)).select("field", F.col("rep").alias("rep_a"), F.col("rep").alias("rep_b"), F.lit(1.0).alias("similarity"))
    return members, fractions, near.union(same)


def found_pairs(df: DataFrame, p: Params = Params()) -> DataFrame:
    """segment_id_a, segment_id_b: all record pairs of the class pairs, the smaller id first."""
    members, _, pairs = overlaps(df, p)
    t = members.where(F.col("side") == TRAIN).select("field", F.col("rep").alias("rep_a"), F.col("segment_id").alias("t"))
    h = members.where(F.col("side") == HELD_OUT).select("field", F.col("rep").alias("rep_b"), F.col("segment_id").alias("h"))
    both = pairs.join(t, ["field", "rep_a"]).join(h, ["field", "rep_b"]).where("t <> h")
    return both.select(F.least("t", "h").alias("segment_id_a"), F.greatest("t", "h").alias("segment_id_b")).distinct()


def links(df: DataFrame, p: Params = Params()) -> DataFrame:
    """field, rep_a, rep_b, similarity: the classes (records with the same words) near to each other, rep_a with a record in
    train, rep_b with a held-out one; both are the same for a class on both sides."""
    return overlaps(df, p)[2].select(_field(), "rep_a", "rep_b", "similarity")


def classes(df: DataFrame, p: Params = Params()) -> DataFrame:
    """field, rep, segment_id, side: the members of every class, under the least segment_id of the class."""
    chunks = materialise(chunked(df, p), "p1-chunks")
    rows = chunks.where(F.col("field") != _OFTEN).select("field", "text_key", "segment_id", "side").distinct()
    reps = rows.groupBy("field", "text_key").agg(F.min("segment_id").alias("rep"))
    return rows.join(reps, ["field", "text_key"]).select(_field(), "rep", "segment_id", F.when(F.col("side") == TRAIN, "train").otherwise("held out").alias("side"))


def _field() -> Column:
    return F.when(F.col("field") == 0, "target_text").otherwise("instruction_de").alias("field")


def record_overlaps(df: DataFrame, p: Params = Params()) -> DataFrame:
    """segment_id, field, overlap, near: of each held-out record the fraction of its words that stand in chunks of train
    records, and whether one of these is near to it as a whole. A row for each field with a word."""
    members, fractions, pairs = overlaps(df, p)
    held = members.where(F.col("side") == HELD_OUT).select("segment_id", "field", "rep")
    near = pairs.select("field", F.col("rep_b").alias("rep"), F.lit(True).alias("near")).distinct()
    rows = held.join(fractions, ["field", "rep"], "left").join(near, ["field", "rep"], "left")
    return rows.select("segment_id", _field(), F.coalesce("overlap", F.lit(0.0)).alias("overlap"), F.coalesce("near", F.lit(False)).alias("near"))


def report(df: DataFrame, p: Params = Params()) -> DataFrame:
    """split, work_id, records, overlapping: held-out records and those with a near copy in train, for each split and work."""
    s = split_name(F.col("split"))
    held = df.where("segment_id is not null").select("segment_id", "work_id", s.alias("split")).where("split in ('validation', 'test')").distinct()
    members, _, pairs = overlaps(df, p)
    # a class on both sides is near to itself, but a record alone in it is no copy of another
    both = members.groupBy("field", "rep").agg(F.min("segment_id").alias("a"), F.max("segment_id").alias("b")).where("a <> b")
    same = pairs.where("rep_a = rep_b").join(both.select("field", F.col("rep").alias("rep_b")), ["field", "rep_b"])
    near = pairs.where("rep_a <> rep_b").union(same.select(pairs.columns))
    trained = members.where(F.col("side") == TRAIN).select("field", F.col("rep").alias("rep_a"), F.col("segment_id").alias("t"))
    spread = trained.join(near.select("field", "rep_a").distinct(), ["field", "rep_a"]).groupBy("field", "rep_a").agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    of = near.join(spread, ["field", "rep_a"]).groupBy("field", F.col("rep_b").alias("rep")).agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"))
    hit = members.where(F.col("side") == HELD_OUT).join(of, ["field", "rep"]).where("t0 <> segment_id or t1 <> segment_id").select("segment_id", F.lit(1).alias("hit")).distinct()
    rows = held.join(hit, "segment_id", "left")
    return rows.groupBy("split", "work_id").agg(F.count_distinct("segment_id").alias("records"), F.count_distinct(F.when(F.col("hit") == 1, F.col("segment_id"))).alias("overlapping"))
