"""Shared word runs between prompts and targets, reuse ratios, and the pick of a reference passage.

Words are exploded once with their positions; the join is an equi-join on a 64-bit hash of the word window whose words
are compared again, so that a collision makes no match. Hot windows are left to Spark's skew handling; none is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import spread
from .windows import digests, padded, places


def _worded(df: DataFrame, key: str, words: Column) -> DataFrame:
    """key, w. Finding words costs more than moving texts, so a few files are spread over the cores first."""
    needed = [c for c in df.columns if c == key or df.schema[c].dataType.simpleString() == "string"]
    return spread(df.select(*needed)).select(key, words.alias("w"))


def windows(df: DataFrame, key: str, words: Column, n: int) -> DataFrame:
    """key, pos, h, gram: every window of n words, with its position from 0. Texts under n words have none.

    The windows are made inside one array and exploded as a whole: to explode positions and slice afterwards would copy
    the text's words into every row.
    """
    rows = _worded(df, key, words)
    grams = F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: F.struct(i.alias("pos"), F.slice("w", i + 1, n).alias("gram")))
    grams = F.when(F.size("w") >= n, grams)  # not a filter: one would be pushed below the words and find them twice
    return rows.select(key, F.explode(grams).alias("x")).select(key, "x.pos", F.xxhash64("x.gram").alias("h"), "x.gram")


def hashed_windows(df: DataFrame, key: str, words: Column, n: int) -> DataFrame:
    """key, h1, h2: the windows of n words as hashes of 96 bits, made of 64-bit hashes of the words; repeated windows too."""
    rows = df.select(key, F.transform(words, lambda x: F.xxhash64(x)).alias("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                w, starts, count = padded(part.column(1), 0)
                at, text = places(starts, count, n)
                h2 = (digests(w, at, n, 1) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(text)), pa.array(digests(w, at, n).view(np.int64)), pa.array(h2)], [key, "h1", "h2"])

    return rows.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, h1 bigint, h2 int")


def matches(prompts: DataFrame, prompt_key: str, prompt_words: Column, targets: DataFrame, target_key: str, target_words: Column, n: int = 4) -> DataFrame:
    """prompt_key, target_key, pos, target_pos, length: for each window of n words that stands in both, how many words
    agree from there on. Windows on one diagonal that follow each other are one run, so a suffix of a run is listed too."""
    a = windows(prompts, prompt_key, prompt_words, n).select(F.col(prompt_key).alias("p"), "pos", "h", "gram")
    b = windows(targets, target_key, target_words, n).select(F.col(target_key).alias("t"), F.col("pos").alias("tpos"), "h", F.col("gram").alias("tgram"))
    hits = a.join(b, "h").where("gram = tgram").select("p", "t", "pos", "tpos", (F.col("tpos") - F.col("pos")).alias("d"))
    run = Window.partitionBy("p", "t", "d").orderBy("pos")
    hits = hits.withColumn("run", F.col("pos") - F.row_number().over(run))
    last = F.max("pos").over(Window.partitionBy("p", "t", "d", "run"))
    return hits.select(F.col("p").alias(prompt_key), F.col("t").alias(target_key), "pos", F.col("tpos").alias("target_pos"), (last - F.col("pos") + n).cast("int").alias("length"))


def longest(prompts: DataFrame, found: DataFrame, prompt_key: str, target_key: str, fail_at: int = 6) -> DataFrame:
    """prompt_key, longest_any, longest_own, passes: 0 where nothing matches; a prompt passes below ``fail_at`` words."""
    own = F.max(F.when(F.col(prompt_key) == F.col(target_key), F.col("length")))
    best = found.groupBy(prompt_key).agg(F.max("length").alias("a"), own.alias("o"))
    rows = prompts.select(prompt_key).distinct().join(best, prompt_key, "left")
    return rows.select(prompt_key, F.coalesce("a", F.lit(0)).alias("longest_any"), F.coalesce("o", F.lit(0)).alias("longest_own"), (F.coalesce("a", F.lit(0)) < fail_at).alias("passes"))


def reuse(texts: DataFrame, key: str, words: Column, pool: DataFrame, pool_words: Column, n: int = 8) -> DataFrame:
    """key, grams, reused, ratio: distinct windows of each text and how many of them the pool holds; 0 without windows. A
    key is a row of its own; windows are told apart by a 96-bit hash, so that two numbers travel and not eight words.

    Windows of either side are shuffled once, by their hash: distinct rows, join and counts stay where they arrive. The
    sort-merge join is asked for: Spark takes a pool's windows for as few bytes as its files and would broadcast them."""
    own = hashed_windows(spread(texts), key, words, n).repartition("h1", "h2").distinct()
    known = hashed_windows(pool.withColumn("_pool", F.lit(0)), "_pool", pool_words, n).select("h1", "h2").distinct().withColumn("hit", F.lit(1))
    counts = own.join(known.hint("merge"), ["h1", "h2"], "left").groupBy(key).agg(F.count(F.lit(1)).alias("grams"), F.count("hit").alias("reused"))
    rows = texts.select(key).join(counts, key, "left")
    n_, r = F.coalesce("grams", F.lit(0)), F.coalesce("reused", F.lit(0))
    return rows.select(key, n_.alias("grams"), r.alias("reused"), (r / F.greatest(n_, F.lit(1))).alias("ratio"))


def pick_reference(cases: DataFrame, pool: DataFrame, length: int = 1500) -> DataFrame:
    """case_id, segment_id: the pool text nearest to ``length`` code points among those of the case's form; among all where
    no form matches. Ties go to the smaller id. cases: case_id, form; pool: segment_id, form, text."""
    distance = F.struct(F.abs(F.length("text") - length), F.col("segment_id"))
    by_form = pool.where("text is not null").groupBy("form").agg(F.min_by("segment_id", distance).alias("in_form"))
    overall = pool.where("text is not null").agg(F.min_by("segment_id", distance).alias("overall")).withColumn("one", F.lit(1))
    rows = cases.withColumn("one", F.lit(1)).join(by_form, "form", "left").join(F.broadcast(overall), "one", "left")  # one row
    return rows.select("case_id", F.coalesce("in_form", "overall").alias("segment_id"))
