"""Problem 5: filling containers of fixed capacity with whole texts.

First-fit decreasing, with a tournament tree over the containers' free room: the leftmost container with enough room is
found in logarithmic time. It runs independently in randomised groups of texts, so that the work spreads over the
cluster; a group's number follows from the number of texts alone, and a group holds about ``group_items`` of them.
Only ids and token counts are shuffled. First-fit leaves at most one container of a group half empty or less.

Token counts are those of a public byte-level tokenizer. A count is the sum over the units its pre-tokenizer can't
join (a word with the space before it, a run of white space), and units recur, so that most counts are looked up.

Defined results: a text over the capacity is cut into full containers and a rest that is packed like a text (``piece``
counts the parts); null and empty texts have no tokens and come out with a null container; copies are items of their
own; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialise
from .text import slices

# The Unicode property White_Space, as the tokenizer's pattern has it.
_WS = r"\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_UNIT = re.compile(rf" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")


@dataclass(frozen=True)
class Params:
    """capacity: tokens of a container; group_items: texts of a group, about; tokenizers: folder of the vocabulary files;
    vocabulary: the file to use; seed: of the groups."""

    capacity: int = 2048
    group_items: int = 20_000
    tokenizers: str = "/opt/tokenizers"
    vocabulary: str = "byte_bpe_50k.tiktoken"
    seed: int = 20


# Fixed value: the pre-tokenizer pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Counts(dict):
    """Tokens of a unit, kept by unit. Emptied when it grows past ``most`` entries; long units are not kept."""

    def __init__(self, file: str, most: int = 500_000, longest: int = 64):
        import tiktoken

        with open(file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.most, self.longest = most, longest

    def __missing__(self, unit: str) -> int:
        n = len(self.encoding.encode_ordinary(unit))
        if len(unit) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[unit] = n
        return n

    def of(self, text: str | None) -> int:
        return sum(map(self.__getitem__, _UNIT.findall(text))) if text else 0


@lru_cache(1)
def counts(file: str) -> Counts:
    """One a worker: loading a vocabulary takes a while."""
    return Counts(file)


def sized(df: DataFrame, p: Params) -> DataFrame:
    """doc_id, n_tokens."""
    file = f"{p.tokenizers}/{p.vocabulary}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counts(file)
        for b in slices(batches):
            n = [known.of(x) for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint")


class Tournament:
    """Free room of the containers, in a tree whose inner nodes hold the most room below them."""

    def __init__(self, containers: int, capacity: int):
        self.leaves = 1
        while self.leaves < max(1, containers):
            self.leaves *= 2
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """Puts an item into the leftmost container with room for it and returns the container."""
        room, k = self.room, 1
        while k < self.leaves:
            k *= 2
            if room[k] < size:
                k += 1
        found = k - self.leaves
        room[k] -= size
        while k > 1:
            k //= 2
            a, b = room[2 * k], room[2 * k + 1]
            most = a if a > b else b
            if room[k] == most:
                break
            room[k] = most
        return found


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The container of each size; sizes must fall and be at most the capacity."""
    tree = Tournament(len(sizes), capacity)
    return [tree.place(s) for s in sizes]


def pack(df: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, piece, first_token, n_tokens, container of a table with doc_id and text; containers are strings that are
    unique over all groups."""
    groups = max(1, -(-df.count() // p.group_items))
    items = sized(df, p)
    full = F.floor(F.col("n_tokens") / p.capacity).cast("long")
    rest = F.col("n_tokens") - full * p.capacity
    # full pieces fill a container each and need no packing; what is left is an item
    whole = F.when(full > 0, F.transform(F.sequence(F.lit(0).cast("long"), full - 1), lambda i: F.struct(i.alias("piece"), F.lit(p.capacity).cast("long").alias("size")))).otherwise(F.array().cast("array<struct<piece:bigint,size:bigint>>"))
    part = F.when((rest > 0) | (full == 0), F.array(F.struct(full.alias("piece"), rest.alias("size")))).otherwise(F.array().cast("array<struct<piece:bigint,size:bigint>>"))
    items = items.select("doc_id", F.explode(F.concat(whole, part)).alias("x")).select("doc_id", "x.piece", "x.size")
    items = items.withColumn("grp", F.pmod(F.xxhash64("doc_id", F.lit(p.seed)), F.lit(groups)).cast("int"))

    def fill(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        some = rows["size"] > 0
        place = first_fit_decreasing(rows.loc[some, "size"].tolist(), p.capacity)
        rows["container"] = None
        rows.loc[some, "container"] = [f"{key[0]:06d}-{c:06d}" for c in place]
        rows["first_token"] = rows["piece"] * p.capacity
        return rows[["doc_id", "piece", "first_token", "size", "container"]].rename(columns={"size": "n_tokens"})

    return items.groupBy("grp").applyInPandas(fill, "doc_id bigint, piece bigint, first_token bigint, n_tokens bigint, container string")


def fill_report(df: DataFrame, p: Params = Params()) -> DataFrame:
    """containers, tokens, capacity, unused_share: how well the containers are filled, in one row."""
    c = pack(df, p).where("container is not null").groupBy("container").agg(F.sum("n_tokens").alias("used"))
    return c.agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"), (1 - F.sum("used") / (F.count(F.lit(1)) * p.capacity)).alias("unused_share"))


def check(df: DataFrame, p: Params = Params()) -> DataFrame:
    """documents, lost, overfull, split_small, well_filled: one row; documents that came out nowhere or with another number of
    tokens, containers over the capacity, texts cut though they fit, and whether at most a hundredth of the room and one
    container of each group are left unused."""
    x = materialise(pack(df, p), "p5-packed")
    sizes = x.groupBy("doc_id").agg(F.sum("n_tokens").alias("packed"), F.count(F.lit(1)).alias("parts"))
    docs = sized(df.where("doc_id is not null"), p).groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("copies"))
    rows = docs.join(sizes, "doc_id", "left")
    one = rows.agg(F.sum("copies").alias("documents"), F.count_if(~F.col("n").eqNullSafe(F.col("packed"))).alias("lost"), F.count_if((F.col("copies") == 1) & (F.col("n") <= p.capacity) & (F.col("parts") > 1)).alias("split_small"), F.sum("n").alias("tokens"))
    used = x.where("container is not null").groupBy("container").agg(F.sum("n_tokens").alias("used"))
    full = used.agg(F.count_if(F.col("used") > p.capacity).alias("overfull"), F.count(F.lit(1)).alias("containers"), F.count_distinct(F.substring("container", 1, 6)).alias("groups"))
    room = (F.col("containers") - F.col("groups")) * p.capacity
    # both are one row
    return one.withColumn("k", F.lit(1)).join(full.withColumn("k", F.lit(1)), "k").select(F.coalesce("documents", F.lit(0)).alias("documents"), "lost", "overfull", "split_small", (F.coalesce("tokens", F.lit(0)) >= 0.99 * room).alias("well_filled"))
