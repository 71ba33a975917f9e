"""Frozen splits, exports, guards and blind orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sequence import row_index

# Spellings of the splits.
VALIDATION = ("val", "dev", "validation")


def split_name(c: Column) -> Column:
    """Trimmed and lower-cased, spellings of validation made one; null stays null."""
    s = F.lower(F.regexp_replace(c, r"^[ \t\r\n\x{a0}]+|[ \t\r\n\x{a0}]+\z", ""))
    return F.when(s.isin(*VALIDATION), F.lit("validation")).otherwise(s)


def frozen(df: DataFrame, plan: DataFrame, group: str) -> DataFrame:
    """df with ``split`` of a frozen plan (group, split); a group without a plan raises an error."""
    p = plan.select(F.col(group), F.col("split").alias("_split"))
    rows = df.drop("split").join(p, group, "left")
    found = F.when(F.col("_split").isNull(), F.raise_error(F.concat(F.lit("no split for group "), F.coalesce(F.col(group), F.lit("null"))))).otherwise(F.col("_split"))
    return rows.withColumn("split", found).drop("_split")


def hashed_split(group: Column, train: str = "cc", validation: str = "e6") -> Column:
    """A split by the first byte of the group's hash, in hexadecimal: below ``train``, below ``validation``, the rest."""
    byte = F.substring(F.sha2(group, 256), 1, 2)
    return F.when(byte < train, "train").when(byte < validation, "validation").when(byte.isNotNull(), "test")


def export_index(pairs: DataFrame) -> DataFrame:
    """split, row_index_zero_based, segment_id, instruction_sha256, target_text_sha256 in export order."""
    rows = pairs.select("split", "segment_id", F.sha2("instruction_de", 256).alias("instruction_sha256"), F.sha2("target_text", 256).alias("target_text_sha256"))
    return row_index(rows, "split", "segment_id")


def write_splits(pairs: DataFrame, path: str) -> None:
    """prompt and completion of each pair as JSON lines, a folder for each split."""
    pairs.select("split", F.col("instruction_de").alias("prompt"), F.col("target_text").alias("completion")).write.partitionBy("split").json(path)


def for_training(df: DataFrame, split: str) -> DataFrame:
    """The rows of a split for training or validation; the test split is refused."""
    if split not in ("train", "validation"):
        raise ValueError(f"split {split!r} may not be read for training")
    return df.where(F.col("split") == split)


def blind_order(df: DataFrame, case: str, condition: str, seed: str) -> DataFrame:
    """df with ``label`` (A, B, ...): the candidates of each case in an order that the seed alone decides."""
    from pyspark.sql import Window

    key = F.sha2(F.concat_ws("|", F.lit(seed), F.col(case), F.col(condition)), 256)
    rank = F.row_number().over(Window.partitionBy(case).orderBy(key, condition))
    return df.withColumn("label", F.char(F.lit(64) + rank))
